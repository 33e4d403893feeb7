"""Dictionaries, vocabularies and word lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RECORDS = "array<struct<pos:string,morph_tags:array<string>,stressed_form:string>>"


def read_stress_dictionary(spark: SparkSession, path: str) -> DataFrame:
    """(word, variants_json) of a Parquet dictionary, by place of its columns."""
    raw = spark.read.parquet(path)
    return raw.select(F.col(raw.columns[0]).alias("word"), F.col(raw.columns[1]).alias("variants_json"))


def read_legacy_dictionary(spark: SparkSession, path: str) -> DataFrame:
    """(word, variants_json) of the older tab-separated form: at least three columns, of which the
    second and the third are read; rows whose JSON is no object are passed over."""
    part = spark.read.text(path).select(F.split("value", "\t").alias("p")).filter(F.size("p") >= 3)
    rows = part.select(F.col("p")[1].alias("word"), F.col("p")[2].alias("variants_json"))
    return rows.filter(F.json_object_keys("variants_json").isNotNull())


def read_forms(spark: SparkSession, path: str) -> DataFrame:
    """(form, positions): the vocabulary for unknown words."""
    raw = spark.read.parquet(path)
    return raw.select(F.col(raw.columns[0]).alias("form"), F.col(raw.columns[1]).alias("positions"))


def read_tails(spark: SparkSession, path: str) -> DataFrame:
    """(word_suffix, norm_suffix)."""
    raw = spark.read.parquet(path)
    return raw.select(F.col(raw.columns[0]).alias("word_suffix"), F.col(raw.columns[1]).alias("norm_suffix"))


def explode_records(raw: DataFrame) -> DataFrame:
    """(form, ordinal, pos, morph_tags, stressed_form) of raw(form, records_json)."""
    own = raw.select("form", F.posexplode(F.from_json("records_json", RECORDS)).alias("ordinal", "r"))
    return own.select("form", "ordinal", "r.pos", "r.morph_tags", "r.stressed_form")


def read_morphology(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.read.parquet(path)
    return explode_records(raw.select(F.col(raw.columns[0]).alias("form"), F.col(raw.columns[1]).alias("records_json")))


def read_morphology_lines(spark: SparkSession, path: str) -> DataFrame:
    """The same from lines of [form, [record, ...]]; blank and broken lines are passed over."""
    line = spark.read.text(path).filter(F.trim("value") != "")
    own = line.select(F.get_json_object("value", "$[0]").alias("form"), F.get_json_object("value", "$[1]").alias("records_json"))
    return explode_records(own.filter("form is not null and records_json is not null"))


def read_dubious(spark: SparkSession, path: str) -> DataFrame:
    """(key) of a word list: the first of exactly two tab-separated parts, stripped."""
    part = spark.read.text(path).select(F.split("value", "\t").alias("p")).filter(F.size("p") == 2)
    return part.select(F.trim(F.col("p")[0]).alias("key")).filter("key <> ''").distinct()


def read_vocabulary(spark: SparkSession, path: str) -> dict[str, int]:
    """A model's token list, token -> line number: a file of the model's size, kept on the driver."""
    rows = spark.read.text(path, wholetext=True).first()
    return {t: i for i, t in enumerate((rows["value"] if rows else "").splitlines())}


def write_vocabulary(vocabulary: dict[str, int], path: str) -> None:
    with open(path, "w", encoding="utf-8") as f:
        f.writelines(f"{t}\n" for t, _ in sorted(vocabulary.items(), key=lambda x: x[1]))
