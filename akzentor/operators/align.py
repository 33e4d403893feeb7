"""Alignment of a gold sentence's words with an annotator's."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from akzentor.functions import scan
from akzentor.functions.marks import fold


def run_of_equals(a: Column, b: Column, limit: Column) -> Column:
    """How many leading elements of two arrays are equal, at most `limit`."""
    equal = F.zip_with(F.slice(a, 1, limit), F.slice(b, 1, limit), lambda x, y: x.eqNullSafe(y))
    miss = F.array_position(equal, False).cast("int")
    return F.when(miss == 0, limit).otherwise(miss - 1)


def join_sentences(gold: DataFrame, lib: DataFrame, keys: list[str], libs: list[str]) -> DataFrame:
    """Gold and annotator sentences side by side, either of which may lack some: gold(keys, words,
    error), lib(lib, keys, words, error); `libs` names the annotators that are compared. Rows of one
    sentence meet by one exchange on its keys, the gold once for all annotators; what is gathered
    is a row each. Repeated rows of a sentence meet each other, as in a join. `words` may as well be a marked text,
    which takes less room to exchange; a sentence that one side lacks then has an empty one."""
    row = lambda name: F.struct(name.alias("lib"), "words", "error").alias("r")
    rows = gold.select(*keys, row(F.lit(None).cast("string"))).unionByName(lib.filter(F.col("lib").isin(libs)).select(*keys, row(F.col("lib"))))
    met = rows.groupBy(*keys).agg(F.collect_list("r").alias("_r"))
    kind = gold.schema["words"].dataType
    none = F.lit("") if kind == StringType() else F.array().cast(kind)
    missing = F.array(F.struct(F.lit(None).cast("string").alias("lib"), none.alias("words"), F.lit(False).alias("error")))
    golds = F.filter("_r", lambda r: r["lib"].isNull())
    met = met.withColumns({"_g": F.when(F.size(golds) > 0, golds).otherwise(missing), "_any": F.size(golds) > 0})
    own = met.select("*", F.explode(F.array(*map(F.lit, libs))).alias("lib")).withColumn("_l", F.filter("_r", lambda r: r["lib"] == F.col("lib")))
    own = own.filter(F.col("_any") | (F.size("_l") > 0)).withColumn("_l", F.explode(F.when(F.size("_l") > 0, F.col("_l")).otherwise(missing)))
    own = own.withColumn("_g", F.explode("_g"))
    return own.select("lib", *keys, F.col("_g.words").alias("gold_words"), F.col("_g.error").alias("gold_error"), F.col("_l.words").alias("lib_words"), F.col("_l.error").alias("lib_error"))


def align(both: DataFrame) -> DataFrame:
    """Adds prefix and suffix, the lengths of the equal ends: word i of the gold meets word i within
    the prefix, and the words counted from the end meet within the suffix, which never reaches into
    the prefix on either side. Sentences that are equal throughout are all prefix."""
    g, l = (F.transform(F.col(c), lambda w: fold(w["text"])) for c in ("gold_words", "lib_words"))  # noqa: E741
    out = both.withColumns({"_g": g, "_l": l}).withColumns({"gold_count": F.size("_g"), "lib_count": F.size("_l")})
    out = out.withColumn("_n", F.least("gold_count", "lib_count"))
    out = out.withColumn("prefix", F.when(F.col("_g") == F.col("_l"), F.col("_n")).otherwise(run_of_equals(F.col("_g"), F.col("_l"), F.col("_n"))))
    room = F.col("_n") - F.col("prefix")
    out = out.withColumn("suffix", F.when(room == 0, F.lit(0)).otherwise(run_of_equals(F.reverse("_g"), F.reverse("_l"), room)))
    failed = F.col("gold_error") | F.col("lib_error")
    return out.withColumns({c: F.when(failed, F.lit(0)).otherwise(F.col(c)) for c in ("prefix", "suffix")}).drop("_g", "_l", "_n")


def align_texts(both: DataFrame) -> DataFrame:
    """`align` and the counts of it for sentences whose words are marked texts: adds gold_count, lib_count, prefix,
    suffix, and matched, scored, checked, from which `metrics.text_metrics` goes on."""
    own = both.withColumn("_c", F.arrow_udf(scan.compare, scan.COMPARED)("gold_words", "lib_words", F.col("gold_error") | F.col("lib_error")))
    return own.select("*", "_c.*").drop("_c")


def pairs(aligned: DataFrame) -> Column:
    """Aligned words as an array of (g, l, text, gold, lib): indices, gold text, stress places."""
    head = F.when(F.col("prefix") > 0, F.sequence(F.lit(0), F.col("prefix") - 1)).otherwise(F.array().cast("array<int>"))
    tail = F.when(F.col("suffix") > 0, F.sequence(F.col("gold_count") - F.col("suffix"), F.col("gold_count") - 1)).otherwise(F.array().cast("array<int>"))
    shift = F.col("lib_count") - F.col("gold_count")
    at = lambda c, i: F.get(F.col(c), i)
    pair = lambda g, l: F.struct(g.alias("g"), l.alias("l"), at("gold_words", g)["text"].alias("text"), at("gold_words", g)["stress"].alias("gold"), at("lib_words", l)["stress"].alias("lib"))
    return F.concat(F.transform(head, lambda i: pair(i, i)), F.transform(tail, lambda i: pair(i, i + shift)))
