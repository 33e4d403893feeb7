"""Quality classifier by co-training.

Two views of a document, its text and its metadata (source, language, length), have a logistic
classifier each, first fitted on labelled documents. In each round a view labels those of all
unlabelled documents that it is surest of, among the ones it hasn't labelled yet, and the other
view takes Newton-like steps on the labelled documents and on these. Both are then calibrated on
labelled documents kept apart, and a last logistic step on their calibrated log-odds gives the
score of every document.

The features of all documents are written once. A round reads them for histograms of calibrated
chances, from which comes how sure is sure enough, and for sums of gradients and curvatures; only
such sums leave the executors. Which documents a view has labelled isn't stored: it follows from
its past weights.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from akzentor.llm.common import keep, slices

#: Labelled documents that the classifiers are fitted on, about.
FIT_ROWS = 8_000
#: Rounds, Newton steps of each, and the share of its unlabelled documents that a view labels in one.
ROUNDS, STEPS, QUOTA = 3, 2, 0.1
#: A view labels a document only where its chance of being wrong is this share of what the class's share gives.
SURE = 0.6
#: Bins of the histograms of log-odds, whose inverse hyperbolic sines lie within SPAN.
BINS, SPAN = 4000, 12.0
#: Documents with a lower score are rejected.
THRESHOLD = 0.5
META = 96
_EXTRA = 12
#: Rows whose features are worked on at a time, and rows to which a pass's sums are brought down.
ROWS, SUMS = 4096, 32


def text_features(text: str) -> np.ndarray:
    """The text view: shares of byte values, and shapes of words and lines."""
    data = text.encode("utf-8", "surrogatepass")
    n = len(data)
    out = np.zeros(256 + _EXTRA, np.float32)
    if not n:
        return out
    hist = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    out[:256] = np.sqrt(hist / n)
    words = data.split()
    m = len(words)
    if m:
        counts = Counter(words)
        most = counts.most_common(1)[0][1]
        again = sum(map(bytes.__eq__, words, words[1:]))
        pairs = len(set(zip(words, words[1:]))) if m > 1 else 1
        lines = data.split(b"\n")
        ends = Counter(w[-1] for w in counts)
        signs = sum(v for k, v in ends.items() if k < 128 and not chr(k).isalnum()) / len(counts)
        out[256:] = [
            np.log1p(m) / 10, np.log1p(n / m), len(counts) / m, most / m, again / m, pairs / max(1, m - 1),
            len(set(lines)) / len(lines), signs, hist[65:91].sum() / max(1, hist[65:91].sum() + hist[97:123].sum()),
            hist[48:58].sum() / n, (hist[33:48].sum() + hist[58:65].sum() + hist[91:97].sum() + hist[123:127].sum()) / n, m / (n / 6),
        ]
    return out.astype(np.float16).astype(np.float32)  # as it is stored


def meta_features(source: str | None, lang: str | None, n_chars: int | None) -> tuple[int, int, int]:
    """The metadata view: which three of META features are one: hashed source and language, bands of
    length. Nulls are a value too."""
    return zlib.crc32(f"s{source}".encode()) % 64, 64 + zlib.crc32(f"l{lang}".encode()) % 16, 80 + (0 if n_chars is None else 1 + min(14, int(np.log2(max(1, n_chars)))))


def meta_rows(places: np.ndarray) -> np.ndarray:
    out = np.zeros((len(places), META), np.float32)
    np.put_along_axis(out, places.astype(np.int64), 1, axis=1)
    return out


def logistic(x: np.ndarray, y: np.ndarray, ridge: float, steps: int = 12) -> np.ndarray:
    """Weights, intercept last, of a ridge logistic regression by Newton's method."""
    x = np.column_stack([x, np.ones(len(x))]).astype(np.float64)
    w, penalty = np.zeros(x.shape[1]), np.full(x.shape[1], ridge)
    penalty[-1] = 1e-6
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x.T * (p * (1 - p) + 1e-9)) @ x + np.diag(penalty), x.T @ (y - p) - penalty * w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w


def logits(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return np.clip(x @ w[:-1] + w[-1], -30, 30)


def _bins(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Bins of a view's log-odds, which are as fine for great odds as for small ones in proportion."""
    return np.clip(_bin(x @ w[:-1] + w[-1]), 0, BINS - 1).astype(np.int64)


def _bin(z: np.ndarray | float) -> np.ndarray:
    return np.floor((np.arcsinh(z) + SPAN) * (BINS / (2 * SPAN)))


@dataclass(frozen=True)
class Round:
    """How the views label: weights, and the bins from which on, and up to which, they are sure."""

    weights: list[np.ndarray]
    high: list[int]
    low: list[int]


def labels_of(views: list[np.ndarray], rounds: list[Round], k: int) -> np.ndarray:
    """What view k has said of rows over the rounds: 1, 0 or -1; its first word counts."""
    out = np.full(len(views[k]), -1, np.int64)
    for r in rounds:
        at = np.flatnonzero(out < 0)
        if len(at):
            b = _bins(views[k][at], r.weights[k])
            out[at] = np.where(b >= r.high[k], 1, np.where(b <= r.low[k], 0, -1))
    return out


def histograms(views: list[np.ndarray], rounds: list[Round], weights: list[np.ndarray]) -> np.ndarray:
    """For both views, rows not yet labelled by bins of the view's log-odds."""
    out = np.zeros((2, BINS))
    for k in (0, 1):
        left = views[k][labels_of(views, rounds, k) < 0]
        out[k] = np.bincount(_bins(left, weights[k]), minlength=BINS)
    return out.ravel()


def _newton(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Rows, gradient and curvature of the log-likelihood, as one vector. The curvature is that of the
    quadratic bound which touches it at w, so that a step never makes it worse."""
    x = np.column_stack([x, np.ones(len(x))]).astype(np.float64)
    z = np.clip(x @ w, -30, 30)
    bend = np.tanh(np.abs(z) / 2 + 1e-9) / (2 * np.abs(z) + 4e-9)
    return np.concatenate([[len(x)], x.T @ (y - 1 / (1 + np.exp(-z))), ((x.T * bend) @ x).ravel()])


def lessons(views: list[np.ndarray], rounds: list[Round], weights: list[np.ndarray]) -> np.ndarray:
    """`_newton` of each view over the rows that the other one has labelled."""
    out = []
    for k in (0, 1):
        said = labels_of(views, rounds, 1 - k)
        out.append(_newton(views[k][said >= 0], said[said >= 0], weights[k]))
    return np.concatenate(out)


class Pool(Protocol):
    """Unlabelled rows: sums of a function of their views' features."""

    def total(self, of: Callable[[list[np.ndarray]], np.ndarray]) -> np.ndarray: ...


@dataclass
class ArrayPool:
    views: list[np.ndarray]

    def total(self, of: Callable[[list[np.ndarray]], np.ndarray]) -> np.ndarray:
        return of(self.views)


@dataclass
class TablePool:
    """The rows of a features table that aren't labelled."""

    features: DataFrame
    mean: np.ndarray
    scale: np.ndarray

    def total(self, of: Callable[[list[np.ndarray]], np.ndarray]) -> np.ndarray:
        mean, scale = self.mean, self.scale

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums = None
            for batch in slices(batches, ROWS):
                text, meta = _loaded(batch)
                found = of([(text - mean) / scale, meta])
                sums = found if sums is None else sums + found
            if sums is not None:
                yield pa.RecordBatch.from_arrays([pa.array([sums.tobytes()], pa.binary())], names=["sums"])

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums = None
            for batch in batches:
                for x in batch.column(0):
                    found = np.frombuffer(x.as_buffer())
                    sums = found.copy() if sums is None else sums + found
            if sums is not None:
                yield pa.RecordBatch.from_arrays([pa.array([sums.tobytes()], pa.binary())], names=["sums"])

        rows = self.features.filter("there and quality is null").select("text", "meta").mapInArrow(run, "sums binary").repartition(SUMS).mapInArrow(add, "sums binary").collect()
        return np.sum([np.frombuffer(r["sums"]) for r in rows], axis=0) if rows else of([np.zeros((0, 256 + _EXTRA)), np.zeros((0, META))])


@dataclass
class Model:
    text: np.ndarray
    meta: np.ndarray
    text_line: np.ndarray  # calibration: slope, intercept
    meta_line: np.ndarray
    both: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    #: Labels passed on in each round, by view (text, metadata) and class (0, 1).
    passed: list[tuple[tuple[int, int], tuple[int, int]]] = field(default_factory=list)

    def score(self, text: np.ndarray, meta: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(p_text, p_meta, score), calibrated."""
        a = logits(logits((text - self.mean) / self.scale, self.text)[:, None], self.text_line)
        b = logits(logits(meta, self.meta)[:, None], self.meta_line)
        c = logits(np.column_stack([a, b]), self.both)
        return tuple(1 / (1 + np.exp(-z)) for z in (a, b, c))


def _surest(counts: np.ndarray, quota: float) -> int:
    """The lowest of the highest bins that hold at most `quota` rows, or the highest with any row if that has more."""
    there = np.flatnonzero(counts)
    fits = np.flatnonzero(np.cumsum(counts[::-1]) <= quota)
    return min(there[-1] if len(there) else BINS, BINS - 1 - fits[-1] if len(fits) else BINS)


def _limits(counts: np.ndarray, line: np.ndarray, share: float, quota: float, sure: float) -> tuple[int, int]:
    """(low, high): the bins up to which, and from which on, a view labels: its surest rows, a quota of them by
    the classes' shares, as far as it is sure enough. None where its calibration doesn't rise."""
    if line[0] <= 0:
        return -1, BINS
    odds = lambda p: (np.log(p / (1 - p)) - line[1]) / line[0]
    left = quota * counts.sum()
    high = max(_surest(counts, left * share), int(_bin(odds(1 - (1 - share) * sure))) + 1)
    low = min(BINS - 1 - _surest(counts[::-1], left * (1 - share)), int(_bin(odds(share * sure))) - 1)
    return low, high


def teach(text: np.ndarray, meta: np.ndarray, y: np.ndarray, fold: np.ndarray, pool: Pool, mean: np.ndarray, scale: np.ndarray, rounds: int = ROUNDS, quota: float = QUOTA, sure: float = SURE) -> Model | None:
    """Co-training from labelled rows (y 1 or 0; `fold` is kept apart for calibration) and a pool of
    unlabelled ones. None if the labels don't have both classes on both sides."""
    views, ridge = [(text - mean) / scale, meta], [5.0, 2.0]
    train, apart = ~fold, fold
    if min(len(set(y[train])), len(set(y[apart]))) < 2:
        return None
    share = float(y[train].mean())
    weights = [logistic(v[train], y[train], g) for v, g in zip(views, ridge, strict=True)]
    calibrate = lambda: [logistic(logits(v[apart], w)[:, None], y[apart], 1e-2) for v, w in zip(views, weights, strict=True)]
    past: list[Round] = []
    passed = []
    for _ in range(rounds):
        lines = calibrate()
        left = pool.total(lambda v: histograms(v, past, weights)).reshape(2, BINS)  # noqa: B023
        low, high = zip(*(_limits(left[k], lines[k], share, quota, sure) for k in (0, 1)), strict=True)
        passed.append(tuple((int(left[k][: max(0, low[k] + 1)].sum()), int(left[k][high[k] :].sum())) for k in (0, 1)))
        if not any(map(sum, passed[-1])):
            break
        past.append(Round([w.copy() for w in weights], list(high), list(low)))
        for _ in range(STEPS):
            sums = pool.total(lambda v: lessons(v, past, weights))  # noqa: B023
            for k in (0, 1):
                d = len(weights[k])
                told, sums = sums[: 1 + d + d * d], sums[1 + d + d * d :]
                own = _newton(views[k][train], y[train], weights[k])
                # What was passed on weighs no more than what is known.
                both = own[1:] + told[1:] * min(1.0, own[0] / max(1.0, told[0]))
                penalty = np.full(d, ridge[k])
                penalty[-1] = 1e-6
                weights[k] = weights[k] + np.linalg.solve(both[d:].reshape(d, d) + np.diag(penalty), both[:d] - penalty * weights[k])
    lines = calibrate()
    both = logistic(np.column_stack([logits(logits(v[apart], w)[:, None], c) for v, w, c in zip(views, weights, lines, strict=True)]), y[apart], 1e-1)
    return Model(weights[0], weights[1], lines[0], lines[1], both, mean, scale, passed)


def co_train(text: np.ndarray, meta: np.ndarray, y: np.ndarray, fold: np.ndarray, **options) -> Model | None:
    """`teach` over arrays; y: 1, 0, or -1 for the unlabelled pool."""
    known = y >= 0
    if not known.any():
        return None
    mean, scale = text[known].mean(axis=0), text[known].std(axis=0) + 1e-3
    return teach(text[known], meta[known], y[known], fold[known], ArrayPool([(text[~known] - mean) / scale, meta[~known]]), mean, scale, **options)


def _loaded(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """(text, meta) matrices of a batch's stored features."""
    text, meta = (b"".join(batch.column(batch.schema.get_field_index(c)).to_pylist()) for c in ("text", "meta"))
    return np.frombuffer(text, np.float16).reshape(-1, 256 + _EXTRA).astype(np.float64), meta_rows(np.frombuffer(meta, np.uint8).reshape(-1, 3))


def featured(docs: DataFrame, labels: DataFrame, fit_rows: int) -> DataFrame:
    """(doc_id, there, quality, text, meta) of every row, written to the shared folder: whether it has a
    text, the label if it is one of those learned from, and both views' features as bytes."""
    marked = labels.filter("doc_id is not null and quality in (0, 1)").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    n = marked.count()
    marked = marked.filter(F.pmod(F.xxhash64("doc_id"), F.lit(max(n, 1))) < fit_rows)
    schema = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("there", T.BooleanType()), T.StructField("quality", T.IntegerType()), T.StructField("text", T.BinaryType()), T.StructField("meta", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts, sources, langs, sizes = (batch.column(i).to_pylist() for i in range(1, 5))
            text = [text_features(t or "").astype(np.float16).tobytes() for t in texts]
            meta = [bytes(meta_features(*m)) for m in zip(sources, langs, sizes, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([bool(t and t.strip()) for t in texts]), batch.column(5).cast(pa.int32()), pa.array(text, pa.binary()), pa.array(meta, pa.binary())], names=schema.names)

    own = docs.select("doc_id", "text", "source", "lang", "n_chars").join(F.broadcast(marked), "doc_id", "left")
    return keep(own.select("doc_id", "text", "source", "lang", "n_chars", "quality").mapInArrow(run, schema), "features")


def fit(features: DataFrame) -> Model | None:
    """The co-trained model of a features table; a fifth of the labelled documents is for calibration. Of
    rows that share a labelled doc_id one is learned from."""
    known = features.filter("quality is not null").groupBy("doc_id").agg(F.min(F.struct("text", "meta", "quality")).alias("f"))
    rows = sorted((r["doc_id"], bytes(r["f"]["text"]), bytes(r["f"]["meta"]), r["f"]["quality"]) for r in known.toLocalIterator())
    if not rows:
        return None
    text = np.frombuffer(b"".join(r[1] for r in rows), np.float16).reshape(len(rows), -1).astype(np.float64)
    meta = meta_rows(np.frombuffer(b"".join(r[2] for r in rows), np.uint8).reshape(len(rows), 3))
    y, fold = np.array([r[3] for r in rows], np.int64), np.array([zlib.crc32(str(r[0]).encode()) % 5 == 0 for r in rows], bool)
    mean, scale = text.mean(axis=0), text.std(axis=0) + 1e-3
    return teach(text, meta, y, fold, TablePool(features, mean, scale), mean, scale)


def _scored(text: np.ndarray, meta: np.ndarray, there: np.ndarray, model: Model | None) -> list[np.ndarray]:
    """p_text, p_meta and score of rows."""
    found = [np.ones(len(text))] * 3 if model is None else model.score(text, meta)
    return [np.where(there, f, 0.0) for f in found]


def classify(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, fit_rows: int = FIT_ROWS) -> DataFrame:
    """(doc_id, p_text, p_meta, score, keep) for every row of docs.

    labels(doc_id, quality 0 or 1) may cover some documents; of several labels the lowest counts.
    About `fit_rows` labelled documents at most are learned from, and all others without their
    labels. Null or blank texts get 0 and aren't kept. Null metadata is a value of its own. If labels
    don't hold both classes, every other document gets 1. An empty table gives none. Equal rows get
    equal scores, and repeated rows a row each; a score of the threshold itself is kept. Other
    columns of docs aren't read. Texts are read once, without a shuffle.
    """
    features = featured(docs, labels, fit_rows)
    model = fit(features)
    schema = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), *(T.StructField(c, T.DoubleType()) for c in ("p_text", "p_meta", "score")), T.StructField("keep", T.BooleanType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, ROWS):
            there = batch.column(1).to_numpy(zero_copy_only=False)
            found = _scored(*_loaded(batch), there, model)
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, found), pa.array(there & (found[2] >= threshold))], names=schema.names)

    return features.select("doc_id", "there", "text", "meta").mapInArrow(run, schema)


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, fit_rows: int = FIT_ROWS) -> DataFrame:
    """The rows of docs, with all their columns, that `classify` keeps; decided where they are read, so
    texts are read once more but not shuffled."""
    model = fit(featured(docs, labels, fit_rows))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts, sources, langs, sizes = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("text", "source", "lang", "n_chars"))
            there = np.array([bool(t and t.strip()) for t in texts], bool)
            text = np.stack([text_features(t or "") for t in texts]).astype(np.float64)
            meta = meta_rows(np.array([meta_features(*m) for m in zip(sources, langs, sizes, strict=True)]))
            yield batch.filter(pa.array(there & (_scored(text, meta, there, model)[2] >= threshold)))

    return docs.mapInArrow(run, docs.schema)
