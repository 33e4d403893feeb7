"""JSON documents of the evaluation: patterns, annotators' results, word lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

WORDS = "array<struct<text:string,start:int,end:int,method:string,stress_vowel_index:int,stress_char_index:int>>"
ERRORS = "array<struct<type:string,message:string,traceback:string>>"
SENTENCE = f"struct<text:string,original_text:string,accented_text:string,process_time_seconds:double,errors:{ERRORS},words:{WORDS}>"
METADATA = "struct<library_name:string,library_description:string,input_file:string,source_file:string,timestamp:string,load_time_seconds:double,total_process_time_seconds:double,total_time_seconds:double,sentence_count:bigint,errors_count:bigint>"
SCHEMA = f"metadata {METADATA}, sentences array<{SENTENCE}>"
GOLD = "GOLD"


def read_results(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(lib, sent_no, original_text, accented_text, process_time_seconds, errors, words) of result
    files; `lib` is the file's library name, else the file's own without _results.json."""
    own = spark.read.schema(SCHEMA).json(paths, multiLine=True)
    name = F.coalesce(F.col("metadata.library_name"), F.regexp_extract(F.input_file_name(), r"([^/]+)_results\.json$", 1))
    rows = own.select(name.alias("lib"), F.posexplode("sentences").alias("sent_no", "s"))
    text = F.coalesce(F.col("s.original_text"), F.col("s.text"))
    return rows.select("lib", "sent_no", text.alias("original_text"), "s.accented_text", "s.process_time_seconds", "s.errors", "s.words")


def read_directory(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """(gold, libraries) of a folder of *_results.json files; both must be there."""
    rows = read_results(spark, f"{folder}/*_results.json")
    gold, libs = rows.filter(F.col("lib") == GOLD), rows.filter(F.col("lib") != GOLD)
    if gold.isEmpty() or libs.isEmpty():
        raise FileNotFoundError(f"{folder}: results of {GOLD} and of one library at least are needed")
    return gold, libs


def write_results(sentences: DataFrame, path: str) -> None:
    """Results as JSON lines, partitioned by library, written by the executors."""
    sentences.write.mode("overwrite").partitionBy("lib").json(path, ignoreNullFields=False)


def words_of(rows: DataFrame) -> DataFrame:
    """Word rows of `read_results`."""
    return rows.select("lib", "sent_no", F.posexplode("words").alias("word_no", "w")).select("lib", "sent_no", "word_no", "w.*")
