"""Quality classifier, language ID, near-duplicate removal and packing over `documents`.

Each stage is a function of (spark, docs, sf_dir); its result is written as Parquet and reread as
the next one's docs. All but the last return the columns of `documents`.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from akzentor.llm import langid, minhash, packing, quality
from akzentor.llm.common import keep, table
from akzentor.session import ready

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
#: Documents nearer to no language than this are rejected. Of 5,000 clean documents the lowest scored 0.42 and
#: single words 0.49 and more; Polish, Finnish and random letters, with profiles of four other languages, 0.20 to 0.28.
LEAST_LANGUAGE_SCORE = 0.35


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifier doesn't reject; it learns from `labels`. Null and blank
    texts go; null metadata and ids are values like others; repeated rows stay or go alike. Without labels of
    both classes all others stay. An empty table gives one."""
    return quality.keep_good(docs.select(*COLUMNS), table(ready(spark), sf_dir, "labels"))


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the learned languages; those without a text or a letter or like none of them go.
    Null ids stay; repeated rows stay or go alike; ties are no matter. An empty table gives one."""
    ready(spark)
    return langid.keep_known(docs.select(*COLUMNS), langid.fit(langid.training_rows(docs)), LEAST_LANGUAGE_SCORE)


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles, similarity 0.8 or more. All
    rows of a doc_id are one document and stay or go together; those without a doc_id stay, as do null and
    empty texts. Of a group the smallest doc_id stays. An empty table gives one."""
    ready(spark)
    docs = docs.select(*COLUMNS)
    kept = keep(minhash.near_duplicates(docs, words=5, percent=80).filter("kept").select("doc_id").distinct(), "kept")
    return docs.join(kept.hint("merge"), "doc_id", "left_semi").select(*COLUMNS).unionByName(docs.filter("doc_id is null"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents left and their places in sequences of 2048 tokens. Null texts are a
    separator alone; repeated rows have pieces each. An empty table gives one."""
    ready(spark)
    return packing.pack(packing.pieces(docs, TOKENIZER))


STAGES = [("quality", quality_stage), ("language", language_stage), ("near_duplicates", dedup_stage), ("packing", packing_stage)]

#: None of the stages can be told in SQL; tests hold them against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over `documents`, each written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents").select(*COLUMNS)
    for name, stage in STAGES[:-1]:
        docs = keep(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
