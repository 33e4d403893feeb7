"""Language ID by rank-order profiles.

A profile is the list of a language's most frequent letter n-grams (one to three signs, words
padded with a blank), most frequent first. A document gets the language whose profile has the
least out-of-place distance to its own list: the sum of the differences of ranks, with the
profile's length for an n-gram that the profile doesn't have.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from akzentor.llm.common import slices

PROFILE = 400
#: Labelled documents that profiles are learned from, about: a hash of the key picks them.
FIT_ROWS = 40_000
BLOCK = 1 << 18
UNKNOWN = "und"


@lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """By code point: part of a word (letter or mark); letter."""
    kinds = [unicodedata.category(chr(c))[0] for c in range(0x110000)]
    return np.array([k in "LM" for k in kinds]), np.array([k == "L" for k in kinds])


def ngrams(text: str) -> tuple[np.ndarray, np.ndarray, bool]:
    """(codes in rising order, counts, any letter?) of a whole text's n-grams. Texts are taken in
    blocks cut between words, which counts the same."""
    word, letter = _tables()
    codes, counts, any_letter, at = np.zeros(0, np.int64), np.zeros(0, np.int64), False, 0
    while at < len(text):
        end = at + BLOCK
        while end < len(text) and word[ord(text[end])]:
            end += 1
        cp = np.frombuffer(text[at:end].lower().encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
        at = end
        any_letter = any_letter or bool(letter[cp].any())
        cp[~word[cp]] = 32
        cp = np.concatenate([[32], cp, [32]])
        cp = cp[np.concatenate([[True], (cp[1:] != 32) | (cp[:-1] != 32)])]
        two = cp[:-1] << 21 | cp[1:]  # never two blanks: runs of them are one
        own = np.sort(np.concatenate([cp[cp != 32], two, (two[:-1] << 21 | cp[2:])[cp[1:-1] != 32]]))
        first = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]])) if len(own) else np.zeros(0, np.int64)
        own, n = own[first], np.diff(np.concatenate([first, [len(own)]]))
        if len(codes):
            merged, where = np.unique(np.concatenate([codes, own]), return_inverse=True)
            counts = np.bincount(where, np.concatenate([counts, n])).astype(np.int64)
            codes = merged
        else:
            codes, counts = own, n
    return codes, counts, any_letter


def ranked(codes: np.ndarray, counts: np.ndarray, k: int = PROFILE) -> np.ndarray:
    """The k most frequent codes, most frequent first, ties in order of code."""
    if len(codes) > k:
        least = np.partition(counts, len(counts) - k)[len(counts) - k]
        above = np.flatnonzero(counts > least)
        some = np.sort(np.concatenate([above, np.flatnonzero(counts == least)[: k - len(above)]]))
        codes, counts = codes[some], counts[some]
    return codes[np.argsort(-counts, kind="stable")]


def fit(docs: DataFrame, text: str = "text", lang: str = "lang", profile: int = PROFILE) -> dict[str, list[int]]:
    """Profiles from all rows of `docs` whose text and language aren't null: language -> codes.

    Tasks add up the counts of what they read; sums and the top of each list are Spark's.
    No rows give no profiles. What reaches the driver is `profile` codes a language.
    """
    schema = T.StructType([T.StructField("lang", T.StringType()), T.StructField("code", T.LongType()), T.StructField("n", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
            for t, name in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                held.setdefault(name, []).append(ngrams(t)[:2])
            for name, parts in held.items():
                codes, where = np.unique(np.concatenate([c for c, _ in parts]), return_inverse=True)
                total = np.bincount(where, np.concatenate([n for _, n in parts]), len(codes)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(codes), pa.string()), pa.array(codes, pa.int64()), pa.array(total)], names=schema.names)

    source = docs.select(F.col(text), F.col(lang)).filter(F.col(text).isNotNull() & F.col(lang).isNotNull())
    sums = source.mapInArrow(run, schema).groupBy("lang", "code").agg(F.sum("n").alias("n"))
    top = sums.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "code"))).filter(F.col("r") <= profile)
    found: dict[str, list[int]] = {}
    for row in top.orderBy("lang", "r").toLocalIterator():
        found.setdefault(row["lang"], []).append(row["code"])
    return found


def distances(top: np.ndarray, known: np.ndarray, ranks: np.ndarray, profile: int) -> np.ndarray:
    """Out-of-place distances of a document's list to each profile; ranks[language, known code]."""
    at = np.minimum(np.searchsorted(known, top), len(known) - 1)
    found = np.where(known[at] == top, ranks[:, at], -1)
    return np.where(found < 0, profile, np.abs(found - np.arange(len(top)))).sum(axis=1)


class Profiles:
    """Profiles laid out for comparison; a call gives (language, score) of a text."""

    def __init__(self, profiles: dict[str, list[int]], profile: int) -> None:
        self.profile, self.names = profile, sorted(n for n in profiles if profiles[n])
        self.known = np.unique(np.concatenate([np.zeros(0, np.int64), *(np.array(profiles[n], np.int64) for n in self.names)]))
        self.ranks = np.full((len(self.names), len(self.known)), -1, np.int64)
        for i, n in enumerate(self.names):
            self.ranks[i, np.searchsorted(self.known, profiles[n])] = np.arange(len(profiles[n]))

    def __call__(self, text: str | None) -> tuple[str, float]:
        codes, counts, any_letter = ngrams(text or "")
        if not any_letter or not self.names:
            return UNKNOWN, 0.0
        top = ranked(codes, counts, self.profile)
        d = distances(top, self.known, self.ranks, self.profile)
        return self.names[int(d.argmin())], 1 - float(d.min()) / (self.profile * len(top))


def predict(docs: DataFrame, profiles: dict[str, list[int]], key: str = "doc_id", text: str = "text", profile: int = PROFILE) -> DataFrame:
    """(key, lang_pred, score) from the whole text alone.

    `score` is 1 less the least distance over the greatest possible one. A text that is null or
    has no letter gets "und" and 0, as do all where no profile is known; ties go to the first
    language by name. Repeated rows give a row each; an empty table gives none; other columns aren't read. No shuffle.
    """
    of = Profiles(profiles, profile)
    schema = T.StructType([T.StructField("k", docs.schema[key].dataType), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = [of(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([n for n, _ in found], pa.string()), pa.array([s for _, s in found], pa.float64())], names=schema.names)

    return docs.select(F.col(key).alias("k"), F.col(text).alias("t")).mapInArrow(run, schema).withColumnRenamed("k", key)


def keep_known(docs: DataFrame, profiles: dict[str, list[int]], least: float, text: str = "text", profile: int = PROFILE) -> DataFrame:
    """The rows of docs, with all their columns, whose language is one of the profiles' with a score
    of at least `least`; decided where they are read. Null texts go, and repeated rows stay or go alike."""
    of = Profiles(profiles, profile)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = [of(t) for t in batch.column(batch.schema.get_field_index(text)).to_pylist()]
            yield batch.filter(pa.array([n != UNKNOWN and s >= least for n, s in found], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def held_out(key: str | Column = "doc_id") -> Column:
    """True for the documents that nothing is learned from: crc32 of the key as text, mod 4, is 2."""
    return F.coalesce(F.crc32((F.col(key) if isinstance(key, str) else key).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def training_rows(docs: DataFrame, fit_rows: int = FIT_ROWS, key: str = "doc_id", lang: str = "lang") -> DataFrame:
    """About `fit_rows` labelled documents that aren't held out, picked by a hash of the key."""
    labelled = docs.filter(F.col(lang).isNotNull() & ~held_out(key))
    n = labelled.count()
    return labelled.filter(F.pmod(F.xxhash64(key), F.lit(max(n, 1))) < fit_rows)
