"""Words with their stress from marked text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from akzentor.functions import scan
from akzentor.operators.tokenize import words


def marked_words(sentences: DataFrame, keys: list[str], text: str = "text", method: str | None = None) -> DataFrame:
    """(keys, word_no, text, start, end, stress_char_index, stress_vowel_index, method) of marked
    text: a mark belongs to the word that it stands in, and the first of a word counts."""
    return words(sentences, keys, text, marked=True).withColumn("method", F.when(F.col("stress_char_index").isNotNull(), F.lit(method)))


def word_array(text: Column | str) -> Column:
    """A marked sentence's words, in the row: array of (text, stress)."""
    return F.arrow_udf(scan.word_lists, scan.WORDS)(F.col(text) if isinstance(text, str) else text)


def flag_dubious(word_rows: DataFrame, dubious: DataFrame, text: str = "text", strict: bool = False) -> DataFrame:
    """Words with a hyphen or in the list dubious(key) get `dubious`, and lose their stress unless
    `strict`: the list of a language is small, and Spark broadcasts it by its size."""
    listed = dubious.select(F.lower("key").alias("_key"), F.lit(True).alias("_listed")).distinct()
    out = word_rows.join(listed, F.lower(text) == F.col("_key"), "left").withColumn("dubious", F.coalesce("_listed", F.lit(False)) | F.contains(F.col(text), F.lit("-"))).drop("_key", "_listed")
    if strict:
        return out
    return out.withColumns({c: F.when(~F.col("dubious"), F.col(c)) for c in ("stress_char_index", "stress_vowel_index") if c in out.columns})
