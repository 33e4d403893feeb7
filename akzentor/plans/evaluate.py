"""The evaluation as one lazy plan: sentences, annotators' texts, words, alignment, counts."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from akzentor.operators import metrics
from akzentor.operators.align import align, align_texts, join_sentences
from akzentor.operators.extract import flag_dubious, word_array
from akzentor.sources.scratch import keep


@dataclass
class Evaluation:
    """What an evaluation gives, as plans over its sentence counts."""

    sentences: DataFrame
    keys: list[str]
    libs: list[str]

    def stored(self) -> Evaluation:
        """The same over a stored table of sentence counts, for when more than one result is wanted."""
        return replace(self, sentences=keep(self.sentences, "sentences"))

    @property
    def totals(self) -> DataFrame:
        return metrics.library_totals(self.sentences)

    @property
    def common(self) -> DataFrame:
        return metrics.common_words(self.sentences, self.keys, self.libs)

    @property
    def accuracy(self) -> DataFrame:
        return metrics.accuracy(self.common)

    @property
    def grand_totals(self) -> DataFrame:
        return metrics.grand_totals(self.totals)


def aligned(gold: DataFrame, libs: DataFrame, keys: list[str], names: list[str], dubious: DataFrame | None = None) -> DataFrame:
    """gold(keys, text marked), libs(lib, keys, accented_text, error): sentences side by side with the
    lengths of their equal ends. Texts meet as they are and are taken apart into words where they have met; only
    with a list dubious(key), whose words have no stress in the gold, do they meet as words."""
    no = F.lit(False).alias("error")
    if dubious is None:
        return align_texts(join_sentences(gold.select(*keys, F.col("text").alias("words"), no), libs.select("lib", *keys, F.col("accented_text").alias("words"), "error"), keys, names))
    g = _without_dubious(gold.select(*keys, word_array("text").alias("words"), no), keys, dubious)
    l = libs.select("lib", *keys, word_array("accented_text").alias("words"), "error")  # noqa: E741
    return align(join_sentences(g, l, keys, names))


def _without_dubious(gold: DataFrame, keys: list[str], dubious: DataFrame) -> DataFrame:
    cut = gold.select(*keys, "error", F.posexplode_outer("words").alias("_no", "_w"))
    rows = flag_dubious(cut.select(*keys, "error", "_no", F.col("_w.text").alias("text"), F.col("_w.stress").alias("stress_char_index")), dubious)
    word = F.when(F.col("_no").isNotNull(), F.struct("_no", F.struct("text", F.col("stress_char_index").alias("stress")).alias("w")))
    met = rows.groupBy(*keys, "error").agg(F.array_sort(F.collect_list(word)).alias("_ws"))
    return met.select(*keys, F.transform("_ws", lambda x: x["w"]).alias("words"), "error")


def evaluate(gold: DataFrame, libs: DataFrame, keys: list[str], names: list[str], dubious: DataFrame | None = None) -> Evaluation:
    counts = metrics.text_metrics if dubious is None else metrics.sentence_metrics
    return Evaluation(counts(aligned(gold, libs, keys, names, dubious), keys), keys, sorted(names))
