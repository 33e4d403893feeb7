"""Error counts of annotators against the gold standard."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from akzentor.functions.marks import is_scored
from akzentor.operators.align import pairs

TOTALS = ["matched_pairs", "unmatched_diff", "unmatched_same", "stress_errors", "missing_stress", "gold_words_with_stress"]


def sentence_metrics(aligned: DataFrame, keys: list[str]) -> DataFrame:
    """A row per annotator and sentence: counts, and `checked`, the array of (g, wrong) of words
    that count and that the annotator stressed. Sentences with an error on either side count
    nothing. All of it is worked out within the row."""
    own = aligned.withColumn("_pairs", pairs(aligned)).withColumn("_scored", F.filter("_pairs", lambda p: is_scored(p["text"], p["gold"])))
    own = own.withColumn("checked", F.transform(F.filter("_scored", lambda p: p["lib"].isNotNull()), lambda p: F.struct(p["g"].alias("g"), (p["gold"] != p["lib"]).alias("wrong"))))
    return _counted(own.withColumns({"matched": F.size("_pairs"), "scored": F.size("_scored")}), keys)


def text_metrics(aligned: DataFrame, keys: list[str]) -> DataFrame:
    """`sentence_metrics` of what `align_texts` gives."""
    return _counted(aligned, keys)


def _counted(own: DataFrame, keys: list[str]) -> DataFrame:
    failed = F.col("gold_error") | F.col("lib_error")
    loose = F.when(failed, F.lit(0)).otherwise(F.col("gold_count") + F.col("lib_count") - 2 * F.col("matched"))
    same = (F.col("gold_count") == F.col("lib_count")) & (F.col("gold_count") > 0)
    return own.select(
        "lib", *keys, "gold_count", "lib_count", "gold_error", "lib_error", "checked",
        F.col("matched").alias("matched_pairs"),
        F.when(same, F.lit(0)).otherwise(loose).alias("unmatched_diff"),
        F.when(same, loose).otherwise(F.lit(0)).alias("unmatched_same"),
        (loose > 0).alias("has_unmatched"),
        F.size(F.filter("checked", lambda c: c["wrong"])).alias("stress_errors"),
        (F.col("scored") - F.size("checked")).alias("missing_stress"),
        F.col("scored").alias("gold_words_with_stress"),
    )


def common_words(metrics: DataFrame, keys: list[str], libs: list[str]) -> DataFrame:
    """(lib, common, errors): over the words that every annotator stressed, none of which can then
    lack a stress. The annotators' rows of a sentence meet, each with the indices of its words as
    an array; intersections of these are all that has to be worked out."""
    index = lambda c: F.transform(c, lambda x: x["g"])
    row = F.struct("lib", index(F.col("checked")).alias("all"), index(F.filter("checked", lambda x: x["wrong"])).alias("bad"))
    met = metrics.filter(F.col("lib").isin(libs)).groupBy(*keys).agg(F.collect_list(row).alias("r")).filter(F.size("r") == len(libs))
    shared = F.aggregate(F.slice("r", 2, len(libs)), F.col("r")[0]["all"], lambda acc, x: F.array_intersect(acc, x["all"]))
    met = met.withColumn("shared", shared).filter(F.size("shared") > 0).select("shared", F.explode("r").alias("r"))
    own = met.groupBy("r.lib").agg(F.sum(F.size("shared")).alias("common"), F.sum(F.size(F.array_intersect("r.bad", "shared"))).alias("errors"))
    names = metrics.sparkSession.range(1).select(F.explode(F.array(*map(F.lit, sorted(libs)))).alias("lib"))
    return names.join(own, "lib", "left").select("lib", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("common", "errors")))


def library_totals(metrics: DataFrame) -> DataFrame:
    """A row per annotator: sums over sentences, and how many had words without a partner."""
    sums = [F.sum(c).cast("long").alias(c) for c in TOTALS]
    return metrics.groupBy("lib").agg(F.count(F.lit(1)).alias("sentences"), F.count_if("has_unmatched").alias("sentences_unmatched"), F.count_if("lib_error").alias("exceptions"), *sums)


def grand_totals(totals: DataFrame) -> DataFrame:
    """`library_totals` with a row for all annotators together, whose lib is null."""
    return totals.rollup("lib").agg(*(F.sum(c).cast("long").alias(c) for c in totals.columns if c != "lib"))


def accuracy(common: DataFrame) -> DataFrame:
    """`common_words` with its share of right words, null where there are none."""
    return common.withColumn("accuracy", F.when(F.col("common") > 0, F.round((F.col("common") - F.col("errors")) / F.col("common"), 4)))


def consistent(common: DataFrame) -> DataFrame:
    """One row: whether all annotators have the same number of common words."""
    return common.agg((F.count_distinct("common") <= 1).alias("consistent"), F.min("common").alias("common"))
