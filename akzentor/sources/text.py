"""Text files of unknown encoding."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from akzentor.operators.tokenize import BREAKS, lines, strip

ENCODINGS = ("utf-8", "cp1251", "cp866", "koi8-r", "iso-8859-5")


def decode(data: bytes, encodings: tuple[str, ...] = ENCODINGS) -> str:
    """The first strict decoding that works; UnicodeError if none does."""
    for name in encodings:
        try:
            return data.decode(name)
        except UnicodeDecodeError:
            continue
    raise UnicodeError(f"none of {', '.join(encodings)} fits")


def decode_output(data: bytes) -> str:
    """A program's output: the same chain, with Latin-1 for what is left, which always works."""
    return decode(data, (*ENCODINGS[:4], "latin-1"))


def read_text(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(path, text) of whole files; Spark passes over empty ones. UTF-8 is decoded by Spark; only other files reach the Arrow
    function that tries the other encodings, for Spark's own decoder doesn't know them all."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    @F.pandas_udf("string")
    def fallback(content: pd.Series) -> pd.Series:
        return content.map(lambda b: None if b is None else decode(bytes(b)))

    good = F.is_valid_utf8(F.col("content").cast("string"))
    rest = fallback(F.when(~good, F.col("content")))
    return files.select("path", F.when(good, F.col("content").cast("string")).otherwise(rest).alias("text"))


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(path, line_no, text): the lines of text files that aren't blank, stripped, numbered by file. Files
    in UTF-8 are read line by line, so that they may be of any size; only others are read whole."""
    raw = spark.read.text(path).select(F.col("_metadata.file_path").alias("path"), "value", F.monotonically_increasing_id().alias("_at"))
    other = [r["path"] for r in raw.filter(~F.is_valid_utf8("value")).select("path").distinct().toLocalIterator()]  # names of files
    good = raw.filter(~F.col("path").isin(other)) if other else raw
    cut = good.select("path", "_at", F.posexplode(F.filter(F.transform(F.split("value", BREAKS), strip), lambda x: x != "")).alias("_no", "text"))
    own = cut.select("path", (F.row_number().over(Window.partitionBy("path").orderBy("_at", "_no")) - 1).alias("line_no"), "text")
    return own.unionByName(lines(read_text(spark, other), key="path")) if other else own
