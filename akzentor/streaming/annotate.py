"""Stress placement on streams: the stateless part of the engine, row by row."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from akzentor.functions import marks
from akzentor.functions.alphabet import NOT_W, W
from akzentor.operators.cascade import AccentConfig, simple_position
from akzentor.operators.tokenize import lines


def annotate_lines(docs: DataFrame, config: AccentConfig = AccentConfig()) -> DataFrame:
    """(doc_id, line_no, text) of docs(doc_id, text), batch or stream: each word is stressed by the
    rules that need no table (yo, single vowels, the first vowel). No state, no exchange."""

    def one(w):
        place, _ = simple_position(w, F.lit(None).cast("array<int>"), config)
        place = F.coalesce(place, marks.first_vowel(w) if config.use_heuristic else F.lit(None).cast("int"))
        return F.when(F.rlike(w, F.lit(f"^{W}")) & place.isNotNull(), F.concat(F.substr(w, F.lit(1), place), F.lit("+"), F.substr(w, place + 1, F.length(w)))).otherwise(w)

    spans = F.regexp_extract_all("text", F.lit(f"({W}+|{NOT_W}+)"), F.lit(1))
    return lines(docs).withColumn("text", F.array_join(F.transform(spans, one), ""))
