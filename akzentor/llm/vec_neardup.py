"""Embedding near-duplicates by sorted projection passes.

Equal vectors are one representative with a count. Each pass orders the representatives
lexicographically by label and the concatenated signs of random projections, compares each with
the next WINDOW ones, and keeps a spanning forest of the verified pairs; components unite the
forests of all passes. What windows pass over is then found by whole buckets: a label is one
bucket where that costs least, so that all its pairs are compared, and else it is dealt by the
first signs of as many passes as bring any pair at the threshold into one bucket but for a chance
of MISS. Within buckets of any size all pairs of unlike components are compared, in blocks.
Links are then counted exactly within each component, in blocks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from akzentor.llm.common import keep
from akzentor.llm.components import connected_components
from akzentor.llm.vectors import matrices, projections, usable

PASSES, WINDOW, BITS = 4, 64, 48
#: Rows of a block in which links are counted.
BLOCK = 512
#: Chance that no pass brings a pair at the threshold into one bucket, whatever the vectors; rows of a block of a bucket.
MISS, BUCKET = 1e-4, 1024
#: Most signs of a bucket's key, and the passes by which the work of a number of signs is measured.
SIGNS, TRIALS = 24, 2


def keys_of(x: np.ndarray, passes: int, bits: int, seed: int) -> np.ndarray:
    """A sortable 64-bit key for each vector and pass: the signs of `bits` random projections,
    first one highest."""
    signs = (x @ projections(x.shape[1], passes * bits, seed) > 0).reshape(len(x), passes, bits)
    return signs @ (np.int64(1) << np.arange(bits - 1, -1, -1, dtype=np.int64))


def _exact(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosines of paired rows, in double precision."""
    return (a * b).sum(axis=1) / (np.sqrt((a * a).sum(axis=1)) * np.sqrt((b * b).sum(axis=1)))


def linked(a: np.ndarray, b: np.ndarray, threshold: float) -> np.ndarray:
    """Which rows of a and b have a cosine of at least the threshold; a matrix product first, and
    the exact form where rounding could decide."""
    s = (a / np.sqrt((a * a).sum(axis=1))[:, None]) @ (b / np.sqrt((b * b).sum(axis=1))[:, None]).T
    out = s >= threshold
    i, j = np.nonzero(np.abs(s - threshold) < 1e-12)
    out[i, j] = _exact(a[i], b[j]) >= threshold
    return out


def _forest(pairs: np.ndarray, n: int) -> list[tuple[int, int]]:
    up = list(range(n))

    def root(x: int) -> int:
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    out = []
    for i, j in pairs.tolist():
        if (a := root(i)) != (b := root(j)):
            up[max(a, b)] = min(a, b)
            out.append((i, j))
    return out


def _windows(reps: DataFrame, threshold: float, passes: int, window: int, seed: int) -> DataFrame:
    """Verified links (a, b) between representatives, a spanning forest of each window run."""
    kind = reps.schema["v"].dataType
    keyed = T.StructType([T.StructField("pass", T.IntegerType()), T.StructField("key", T.LongType()), *reps.select("label", "rep", "v").schema.fields])

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                part = part.set_column(2, "v", pa.concat_arrays([part.column(2)]))
                for rows, x in matrices(part.column(2)):
                    keys = keys_of(x.astype(np.float64), passes, BITS, seed)
                    own = part.take(pa.array(rows))
                    for p in range(passes):
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(rows), p, np.int32)), pa.array(keys[:, p]), *own.columns], names=["pass", "key", "label", "rep", "v"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tail: pa.Table | None = None
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = pa.Table.from_batches([batch.slice(at, 1024)])
                held = pa.concat_tables([tail, part]).combine_chunks() if tail is not None else part
                old = 0 if tail is None else tail.num_rows
                tail = held.slice(max(0, held.num_rows - window))
                ids = held.column("rep").to_numpy()
                group = np.column_stack([held.column("pass").to_numpy(), held.column("label").to_numpy()])
                found = []
                for rows, x in matrices(held.column("v").combine_chunks() if held.column("v").num_chunks != 1 else pa.concat_arrays(held.column("v").chunks)):
                    x = x.astype(np.float64)
                    for s in range(0, len(rows), window):
                        e, f = min(len(rows), s + window), min(len(rows), s + 2 * window)
                        hit = linked(x[s:e], x[s:f], threshold)
                        i, j = np.nonzero(hit)
                        i, j = rows[i + s], rows[j + s]
                        ok = (j > i) & (j - i <= window) & (j >= old) & (group[i] == group[j]).all(axis=1)
                        found.append(np.column_stack([i[ok], j[ok]]))
                pairs = _forest(np.concatenate(found), held.num_rows) if found else []
                if pairs:
                    a, b = np.array(pairs).T
                    yield pa.RecordBatch.from_arrays([pa.array(ids[a]), pa.array(ids[b])], names=["a", "b"])

    assert isinstance(kind, T.ArrayType)
    rows = reps.select("label", "rep", "v").mapInArrow(spread, keyed)
    ordered = rows.repartitionByRange("pass", "label", "key", "rep").sortWithinPartitions("pass", "label", "key", "rep")
    return ordered.mapInArrow(compare, "a long, b long")


def passes_for(bits: int, threshold: float, miss: float = MISS) -> int:
    """Passes that bring a pair at the threshold into one bucket of `bits` signs but for a chance of
    `miss`: signs of a random projection agree with chance 1 - angle / pi, whatever the vectors."""
    p = (1 - math.acos(max(-1.0, min(1.0, threshold))) / math.pi) ** bits
    return 1 if p >= 1 else max(1, math.ceil(math.log(miss) / math.log1p(-p)))


@cache
def _directions(dim: int, seed: int) -> np.ndarray:
    return projections(dim, SIGNS, seed)


def _bucketed(rows: DataFrame, seed: int, vectors: bool) -> DataFrame:
    """rows(label, rep, component, bits, passes, v) -> (label, pass, key, component, rep[, v]) for each
    pass, the key of as many signs as the row's bits."""
    kinds = [T.StructField("label", T.LongType()), T.StructField("pass", T.IntegerType()), T.StructField("key", T.LongType()), T.StructField("component", T.LongType()), T.StructField("rep", T.LongType())]
    kinds += [rows.schema["v"]] if vectors else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                v = pa.concat_arrays([part.column(5)])
                bits, passes = part.column(3).to_numpy(), part.column(4).to_numpy()
                for own, x in matrices(v):
                    x = x.astype(np.float64)
                    for p in range(int(passes[own].max())):
                        on = np.flatnonzero(passes[own] > p)
                        at_rows, key = own[on], np.zeros(len(on), np.int64)
                        if bits[at_rows].any():
                            signs = x[on] @ _directions(x.shape[1], seed + 1 + p) > 0
                            key = (signs @ (np.int64(1) << np.arange(SIGNS - 1, -1, -1, dtype=np.int64))) >> (SIGNS - bits[at_rows].astype(np.int64))
                        take = pa.array(at_rows)
                        out = [part.column(0).take(take), pa.array(np.full(len(on), p, np.int32)), pa.array(key), part.column(2).take(take), part.column(1).take(take)]
                        yield pa.RecordBatch.from_arrays(out + ([v.take(take)] if vectors else []), names=[f.name for f in kinds])

    return rows.select("label", "rep", "component", "bits", "passes", "v").mapInArrow(run, T.StructType(kinds))


def _shapes(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, size, major, n_major, n_minor) of buckets: their largest component, and the blocks of its
    rows and of the others. Two rows of the largest component needn't meet."""
    own = rows.groupBy(*keys, "component").agg(F.count(F.lit(1)).alias("n"))
    own = own.groupBy(*keys).agg(F.sum("n").alias("size"), F.max(F.struct("n", "component")).alias("most"))
    blocks = lambda n: F.ceil(n / F.lit(BUCKET)).cast("int")
    return own.select(*keys, "size", F.col("most.component").alias("major"), F.col("most.n").alias("rest"), blocks(F.col("most.n")).alias("n_major"), blocks(F.col("size") - F.col("most.n")).alias("n_minor"))


def _plans(own: DataFrame, threshold: float, miss: float, seed: int) -> DataFrame:
    """(label, bits, passes) for labels that cost less in buckets than in one, by the rows that meet."""
    choices = {k: passes_for(k, threshold, miss) for k in range(0, SIGNS + 1, 2)}
    large = own.groupBy("label").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > BUCKET * min(n for k, n in choices.items() if k))
    large = keep(large.select("label"), "large")
    tried = _bucketed(own.join(large, "label", "left_semi").withColumns({"bits": F.lit(SIGNS), "passes": F.lit(TRIALS)}), seed, False)
    tried = tried.withColumn("choice", F.explode(F.array(*(F.struct(F.lit(k).alias("bits"), F.lit(n).alias("passes")) for k, n in choices.items()))))
    tried = tried.select("label", "pass", "component", "choice.bits", "choice.passes", F.expr(f"shiftright(key, {SIGNS} - choice.bits)").alias("key"))
    met = F.col("rest") * F.col("n_minor") + (F.col("size") - F.col("rest")) * (F.col("n_major") + F.col("n_minor"))
    shapes = _shapes(tried, ["label", "pass", "bits", "passes", "key"]).withColumn("met", F.when(F.col("size") <= BUCKET, F.col("size")).otherwise(met))
    work = shapes.groupBy("label", "bits", "passes").agg((F.sum("met") * F.col("passes") / TRIALS).alias("work"))
    return work.groupBy("label").agg(F.min_by(F.struct("bits", "passes"), F.struct("work", "bits")).alias("p")).select("label", "p.bits", "p.passes")


def _between(own: DataFrame, plans: DataFrame, threshold: float, seed: int) -> DataFrame:
    """own(label, rep, component, v) -> verified links (a, b) between unlike components, a spanning forest
    of each pair of blocks of a bucket."""
    planned = own.join(plans, "label", "left").withColumns({"bits": F.coalesce("bits", F.lit(0)), "passes": F.coalesce("passes", F.lit(1))})
    keys = ["label", "pass", "key"]
    large = keep(_shapes(_bucketed(planned, seed, False), keys).filter(F.col("size") > BUCKET).select(*keys, "major", "n_major", "n_minor"), "buckets")
    met = _bucketed(planned, seed, True).join(large, keys, "left")
    h, in_major = F.xxhash64("rep"), F.col("component") == F.col("major")
    met = met.withColumn("block", F.when(F.col("major").isNull(), 0).when(in_major, F.pmod(h, F.col("n_major").cast("long"))).otherwise(F.col("n_major") + F.pmod(h, F.greatest("n_minor", F.lit(1)).cast("long"))).cast("int"))
    last = F.col("n_major") + F.col("n_minor") - 1
    others = F.when(F.col("major").isNull(), F.array(F.lit(0))).when(~in_major, F.sequence(F.lit(0), last)).when(F.col("n_minor") > 0, F.sequence(F.col("n_major"), last))
    met = met.withColumn("other", F.explode(others)).withColumns({"i": F.least("block", "other"), "j": F.greatest("block", "other")})
    group = [*keys, "i", "j"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def compare(t: pa.Table) -> Iterator[pa.RecordBatch]:
            block, comp = t.column("block").to_numpy(), t.column("component").to_numpy()
            if len(comp) < 2 or (comp == comp[0]).all():
                return
            i, j = t.column("i")[0].as_py(), t.column("j")[0].as_py()
            found = []
            for rows, x in matrices(pa.concat_arrays(t.column("v").chunks)):
                x = x.astype(np.float64)
                left, right = (np.flatnonzero(block[rows] == k) for k in (i, j))
                if len(left) and len(right):
                    a, b = comp[rows[left]], comp[rows[right]]
                    m, n = np.nonzero(linked(x[left], x[right], threshold) & (a[:, None] != b[None]))
                    found.append(np.column_stack([np.minimum(a[m], b[n]), np.maximum(a[m], b[n])]))
            pairs = np.unique(np.concatenate(found), axis=0) if found else np.empty((0, 2), np.int64)
            if len(pairs):
                names, places = np.unique(pairs, return_inverse=True)
                forest = names[np.array(_forest(places.reshape(pairs.shape), len(names)))]
                yield pa.RecordBatch.from_arrays([pa.array(forest[:, 0]), pa.array(forest[:, 1])], names=["a", "b"])

        last_key = None
        for batch in batches:
            key = np.column_stack([batch.column(batch.schema.get_field_index(c)).to_numpy() for c in group])
            cuts = [0, *(np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1).tolist(), len(key)]
            for a, b in zip(cuts, cuts[1:]):
                if a == b:
                    continue
                if held and tuple(key[a]) != last_key:
                    yield from compare(pa.Table.from_batches(held))
                    held = []
                held.append(batch.slice(a, b - a))
                last_key = tuple(key[a])
        if held:
            yield from compare(pa.Table.from_batches(held))

    ordered = met.select(*group, "block", "component", "v").repartition(*group).sortWithinPartitions(*group)
    return ordered.mapInArrow(run, "a long, b long")


def _counts(members: DataFrame, threshold: float) -> DataFrame:
    """members(rep, component, size, n, v) -> (rep, links): exact counts within each component.

    A component of more than BLOCK representatives is dealt into blocks, and each pair of blocks
    is a group of its own, so no group grows with a component.
    """
    n_blocks = F.ceil(F.col("size") / F.lit(BLOCK)).cast("int")
    own = members.withColumn("nb", n_blocks).withColumn("block", F.pmod(F.xxhash64("rep"), F.col("nb").cast("long")).cast("int"))
    sent = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
    sent = sent.withColumns({"i": F.least("block", "other"), "j": F.greatest("block", "other")})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None

        def count(t: pa.Table) -> Iterator[pa.RecordBatch]:
            t = t.combine_chunks()
            rep, block, n = t.column("rep").to_numpy(), t.column("block").to_numpy(), t.column("n").to_numpy()
            i, j = t.column("i")[0].as_py(), t.column("j")[0].as_py()
            total = np.zeros(len(rep), np.int64)
            for rows, x in matrices(pa.concat_arrays(t.column("v").chunks)):
                x = x.astype(np.float64)
                left, right = (np.flatnonzero(block[rows] == k) for k in (i, j))
                hit = linked(x[left], x[right], threshold)
                if i == j:
                    np.fill_diagonal(hit, False)
                total[rows[left]] += hit @ n[rows[right]]
                if i != j:
                    total[rows[right]] += n[rows[left]] @ hit
            yield pa.RecordBatch.from_arrays([pa.array(rep), pa.array(total)], names=["rep", "links"])

        for batch in batches:
            t = pa.Table.from_batches([batch])
            t = pa.concat_tables([held, t]).combine_chunks() if held is not None else t
            key = np.column_stack([t.column(c).to_numpy() for c in ("component", "i", "j")])
            cuts = [0, *(np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1).tolist()]
            for a, b in zip(cuts, cuts[1:]):
                yield from count(t.slice(a, b - a))
            held = t.slice(cuts[-1])
        if held is not None and held.num_rows:
            yield from count(held)

    ordered = sent.select("component", "i", "j", "block", "rep", "n", "v").repartition("component", "i", "j").sortWithinPartitions("component", "i", "j", "rep")
    return ordered.mapInArrow(run, "rep long, links long").groupBy("rep").agg(F.sum("links").alias("links"))


def near_duplicates(
    vectors: DataFrame, threshold: float = 0.93, passes: int = PASSES, window: int = WINDOW, seed: int = 20_011, key: str = "vec_id", vector: str = "embedding", label: str = "label", miss: float = MISS
) -> DataFrame:
    """(key, n_links, component_id, kept) for every row; links hold between rows with equal labels
    and a cosine of at least `threshold`. In labels of up to seven BUCKET distinct vectors all pairs
    are compared; in larger ones a pair is passed over with a chance of at most `miss`, whatever
    the label's size and the lie of its vectors, and its rows can be linked by others even so.

    Rows with a null label, and vectors that are null, empty, zero or hold nulls or non-finite
    numbers, have no links and are their own component; so do rows of unlike dimensions between
    each other. Repeated rows are vectors of their own. `kept` is true for the row whose key
    is its component's smallest. Null keys get null components. An empty table gives none. Other
    columns aren't read.
    """
    base = vectors.select(F.col(key).cast("long").alias("id"), F.col(label).cast("long").alias("label"), F.col(vector).alias("v"))
    base = base.withColumn("ok", usable("v") & F.col("label").isNotNull() & F.col("id").isNotNull())
    hashed = base.filter("ok").select("id", "label", F.xxhash64("v").alias("h1"), F.xxhash64(F.lit(1), "v").alias("h2"), "v")
    reps = keep(hashed.groupBy("label", "h1", "h2").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("n"), F.first("v").alias("v")), "reps")
    links = _windows(reps, threshold, passes, window, seed)
    comp = keep(connected_components(links), "first")
    own = keep(reps.join(comp.withColumnRenamed("node", "rep"), "rep", "left").select("label", "rep", F.coalesce("component", "rep").alias("component"), "v"), "own")
    plans = keep(_plans(own, threshold, miss, seed), "plans")
    more = keep(connected_components(_between(own, plans, threshold, seed)), "more")
    roots = more.select(F.col("node").alias("component"), F.col("component").alias("root"))
    alone = more.join(comp.select("node"), "node", "left_anti")
    comp = keep(comp.join(roots, "component", "left").select("node", F.coalesce("root", "component").alias("component")).unionByName(alone), "components")
    sized = keep(comp.groupBy("component").agg(F.count(F.lit(1)).alias("size")), "sizes")
    members = keep(comp.join(sized, "component").withColumnRenamed("node", "rep").join(reps.select("rep", "n", "v"), "rep"), "members")
    counted = keep(_counts(members, threshold).join(comp.withColumnRenamed("node", "rep"), "rep"), "counted")
    known = keep(reps.select("label", "h1", "h2", "rep", "n").join(counted, "rep", "left").select("label", "h1", "h2", F.coalesce("component", "rep").alias("component_id"), (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links")), "known")
    rows = base.select("id", F.when(F.col("ok"), F.col("label")).alias("label"), F.when(F.col("ok"), F.xxhash64("v")).alias("h1"), F.when(F.col("ok"), F.xxhash64(F.lit(1), "v")).alias("h2"))
    out = rows.join(known, ["label", "h1", "h2"], "left").select(F.col("id").alias(key), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "id").alias("component_id"))
    return out.withColumn("kept", F.col(key) == F.col("component_id"))
