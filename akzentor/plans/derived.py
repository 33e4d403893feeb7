"""Evaluation inputs derived from the Latin test documents, by rules that SQL can state too."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from akzentor.functions import marks, scan
from akzentor.functions.alphabet import CYRILLIC, LATIN, W
from akzentor.operators.tokenize import by_document, distinct_words, line_array, lines

KEYS = ["doc_id", "line_no"]
LIBS = ["first", "last", "near"]


def latin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, text) of documents as they are, dealt out by document, once for a plan."""
    return by_document(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, text) of documents, read as Cyrillic and dealt out by document, once for a plan."""
    docs = latin(spark, sf_dir)
    return docs.select("doc_id", F.arrow_udf(scan.cyrillic, "string")("text").alias("text"))


def sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, line_no, text)."""
    return lines(documents(spark, sf_dir))


def words(spark: SparkSession, sf_dir: str, folded: bool = False, parts: bool = False) -> DataFrame:
    """(word): `distinct_words` of documents, read as Cyrillic."""
    return distinct_words(latin(spark, sf_dir), folded=folded, parts=parts, reading=scan.read)


def _gold_vowel(w: scan.Written, ids: np.ndarray) -> np.ndarray:
    return np.fmod(w.length + ids[w.row], w.n)


def _gold(texts: pa.Array, ids: pa.Array) -> pa.Array:
    """The sentence with a plus in each word that needs a stress, at the vowel that its length and the document pick."""
    texts, ids, out = scan.plain(texts), np.asarray(ids), []
    for a, b in scan.pieces(texts):
        w = scan.Written(texts.slice(a, b - a))
        out.append(w.at(_gold_vowel(w, ids[a:b])))
    return pa.concat_arrays(out) if out else texts


def _said(texts: pa.Array, ids: pa.Array) -> pa.Array:
    texts, ids, out, names = scan.plain(texts), np.asarray(ids), [], ["first", "last", "near"]
    for a, b in scan.pieces(texts):
        w = scan.Written(texts.slice(a, b - a))
        turn = w.span + ids[a:b][w.row]
        near = w.at(np.where(turn % 7 == 0, 0, _gold_vowel(w, ids[a:b])), turn % 11 != 0)
        out.append(pa.StructArray.from_arrays([w.at(np.zeros_like(w.n)), w.at(w.n - 1), near], names))
    return pa.concat_arrays(out) if out else pa.array([], pa.struct([(c, pa.string()) for c in names]))


def gold_text() -> Column:
    """The marked text of a sentence, from its columns text and doc_id."""
    return F.arrow_udf(_gold, "string")("text", "doc_id")


def _round_trips(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts, ids = scan.plain(batch.column("text")), batch.column("doc_id")
        for a, b in scan.pieces(texts):
            own, counts = scan.cut(scan.read(scan.Signs(texts.slice(a, b - a))))
            row = np.repeat(np.arange(a, b), counts)
            w = scan.Written(own)
            found = scan.round_trip(w.signs_at(_gold_vowel(w, np.asarray(ids)[row])))
            line_no = np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(row)), pa.array(line_no, pa.int32()), *found], [*KEYS, "plus_text", "clean", "n_marks"])


def round_trips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, line_no, plus_text, clean, n_marks): `scan.round_trip` of `gold_text` of each line of documents. Reading,
    cutting and marking are done on the signs, which become strings at the end alone."""
    docs = latin(spark, sf_dir)
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(_round_trips, f"doc_id {kind}, line_no int, plus_text string, clean string, n_marks int")


def _gold_lists(lists: pa.Array, ids: pa.Array) -> pa.Array:
    counts = np.asarray(lists.value_lengths().fill_null(0), np.int64)
    return scan.nested(lambda t: _gold(t, pa.array(np.repeat(np.asarray(ids), counts))), lists)


def gold_lines() -> Column:
    """`gold_text` of each line of a document, from its columns text and doc_id."""
    return F.arrow_udf(_gold_lists, "array<string>")(line_array("text"), "doc_id")


def annotated(own: DataFrame) -> DataFrame:
    """(lib, doc_id, line_no, accented_text, error): three made-up annotators. `first` and `last`
    stress those vowels; `near` is the gold but for gaps at every 11th span, errors at every 7th,
    a leading sign more in every 17th line and a failure in every 50th."""
    own = own.select(*KEYS, F.arrow_udf(_said, "struct<first:string,last:string,near:string>")("text", "doc_id").alias("_t"))
    near = F.when(F.col("line_no") % 17 == 5, F.concat(F.lit("а "), "_t.near")).otherwise(F.col("_t.near"))
    libs = {"first": F.col("_t.first"), "last": F.col("_t.last"), "near": near}
    rows = F.explode(F.array(*(F.struct(F.lit(k).alias("lib"), t.alias("accented_text")) for k, t in libs.items())))
    out = own.select(*KEYS, rows.alias("r")).select("r.lib", *KEYS, "r.accented_text")
    return out.withColumn("error", (F.col("lib") == "near") & ((F.col("doc_id") + F.col("line_no")) % 50 == 49))


def dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(form, positions): words of `benchmark`, stressed at the vowel that their length picks, and at
    the first one too where it is divisible by five."""
    base = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select(F.translate("text", LATIN, CYRILLIC).alias("text"))
    form = base.select(F.explode(F.regexp_extract_all("text", F.lit(f"({W}+)"), F.lit(1))).alias("w")).select(marks.fold("w").alias("form")).distinct()
    own = form.withColumns({"_v": marks.vowel_positions("form"), "_n": F.length("form")}).filter(F.size("_v") > 0)
    main = F.get("_v", F.col("_n") % F.size("_v"))
    both = F.when(F.col("_n") % 5 == 0, F.array(main, F.get("_v", F.lit(0)))).otherwise(F.array(main))
    return own.select("form", F.array_sort(F.array_distinct(both)).alias("positions"))
