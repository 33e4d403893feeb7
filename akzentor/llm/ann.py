"""Approximate nearest neighbours with randomly rotated one-bit codes.

A unit vector o is turned by a random orthonormal map into L >= 256 dimensions (short vectors are
padded by it) and coded by the signs of what comes out; one scalar s = <sign(o')/sqrt(L), o'>
corrects the estimate <q, o> ~ <q', sign(o')>/(sqrt(L) s). A query's turned vector is quantised
to PLANES bits a component, so the estimate is a weighted sum of popcounts of its bit planes
against a packed code. The estimate's error stays within eps * sqrt((1/s^2 - 1)/(L - 1) + r^2/s^2),
r being the query's rounding error, but for a share that falls exponentially in eps^2.

A search passes twice over the codes, in cells of a block of queries and a group of codes. The
first pass finds the k best estimates of each query, whose exact cosines give one floor a query for
all cells; the second gives the vectors whose upper bound reaches that floor. Only those meet
the original vectors. Equal vectors share a code.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from akzentor.llm.common import keep, slices
from akzentor.llm.vectors import matrices, projections, usable

#: Least bits of a code, bits of a query's component, and error bounds in standard deviations.
BITS, PLANES, EPS = 256, 4, 1.9
#: Bytes of a block of queries, about, and pairs of a cell below which cells aren't made smaller.
BLOCK, CELL_PAIRS = 64 << 20, 1 << 22
#: Pairs whose ids or cosines are held at a time, and queries of a row of pairs.
PAIRS, TOGETHER = 1 << 18, 4096
#: Queries and codes whose estimates are held at a time.
TILE_QUERIES, TILE_CODES = 16, 2048


def length(dim: int) -> int:
    """Bits of the codes of vectors of a dimension: whole 64-bit words."""
    return max(BITS, -(-dim // 64) * 64)


@lru_cache(maxsize=8)
def rotation(dim: int, seed: int) -> np.ndarray:
    """A random orthonormal map from `dim` to `length(dim)` dimensions."""
    q, r = np.linalg.qr(projections(length(dim), dim, seed).reshape(length(dim), dim))
    return (q * np.sign(np.diag(r))).T.copy()


def turn(x: np.ndarray, seed: int) -> np.ndarray:
    return (x / np.sqrt((x * x).sum(axis=1))[:, None]) @ rotation(x.shape[1], seed)


def encode(x: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """(words of the packed signs, correction scalars) of rows of x."""
    turned = turn(x, seed)
    return np.packbits(turned > 0, axis=1, bitorder="little").view(np.uint64), np.abs(turned).sum(axis=1) / np.sqrt(turned.shape[1])


def quantise(x: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """(bit planes, numbers) of rows of x as queries: planes are words by row and plane, numbers
    the lowest component, the step and the sum of the turned and rounded vector."""
    turned = turn(x, seed)
    low = turned.min(axis=1)
    step = np.maximum((turned.max(axis=1) - low) / ((1 << PLANES) - 1), 1e-12)
    level = np.rint((turned - low[:, None]) / step[:, None]).astype(np.uint8)
    planes = np.stack([np.packbits((level >> p) & 1, axis=1, bitorder="little") for p in range(PLANES)], axis=1)
    return np.ascontiguousarray(planes).view(np.uint64), np.column_stack([low, step, low * turned.shape[1] + step * level.sum(axis=1)])


def estimates(planes: np.ndarray, numbers: np.ndarray, codes: np.ndarray, ones: np.ndarray, scales: np.ndarray) -> np.ndarray:
    """Estimated cosines, queries by codes, from popcounts of packed bits."""
    both = np.zeros((len(planes), len(codes)), np.uint32)
    bits, count = np.empty(both.shape, np.uint64), np.empty(both.shape, np.uint8)
    for p in reversed(range(planes.shape[1])):
        both += both
        for w in range(codes.shape[1]):
            np.bitwise_and(planes[:, p, w, None], codes[None, :, w], out=bits)
            both += np.bitwise_count(bits, out=count)
    low, step, total = (numbers[:, i, None].astype(np.float32) for i in range(3))
    inner = both * (2 * step) + (ones * (2 * low) - total)
    return inner * (1 / (np.sqrt(64 * codes.shape[1]) * scales)).astype(np.float32)


def slack(steps: np.ndarray, bits: int, scales: np.ndarray, eps: float) -> np.ndarray:
    """Error bound of the estimates of codes for queries with such steps (the coarsest decides)."""
    rounding = steps.max() ** 2 / 12
    return (eps * np.sqrt(np.maximum(1 / scales**2 - 1, 0) / (bits - 1) + rounding / scales**2) + 1e-5).astype(np.float32)


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosines of paired rows, in double precision."""
    return (a * b).sum(axis=1) / (np.sqrt((a * a).sum(axis=1)) * np.sqrt((b * b).sum(axis=1)))


def _unique(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """(id, v): usable rows with a key; of rows that share one, the least vector."""
    own = vectors.filter(usable(vector) & F.col(key).isNotNull()).select(F.col(key).cast("long").alias("id"), F.col(vector).alias("v"))
    again = own.groupBy("id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("id")
    if again.isEmpty():
        return own
    least = own.join(again, "id", "left_semi").groupBy("id").agg(F.min("v").alias("v"))
    return own.join(again, "id", "left_anti").unionByName(least)


def _hashes(own: DataFrame) -> DataFrame:
    return own.withColumns({"h1": F.xxhash64("v"), "h2": F.xxhash64(F.lit(1), "v")})


def _words(column: pa.Array, width: int) -> np.ndarray:
    """Words of a binary column, each value of `width` of them."""
    ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2], np.uint8)[ends[0] : ends[-1]].copy().view(np.uint64).reshape(len(column), width)


def build_index(vectors: DataFrame, seed: int = 7, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(dim, h1, h2, code, scale, rep, n): a code for each distinct usable vector; every row with a key is
    in one, `n` of them, `rep` being the smallest key. Vectors aren't shuffled, codes are.

    Null, empty, zero and non-finite vectors and null keys are left out; of rows that share a key the
    least vector counts; an empty table gives an empty index; other columns aren't read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, TILE_CODES):
                part = batch.slice(at, TILE_CODES)
                for rows, x in matrices(pa.concat_arrays([part.column(3)])):
                    codes, scales = encode(x.astype(np.float64), seed)
                    own = part.take(pa.array(rows))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(rows), x.shape[1], np.int32)), *(own.column(i) for i in range(3)), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(scales.astype(np.float32))], names=["dim", "id", "h1", "h2", "code", "scale"])

    coded = _hashes(_unique(vectors, key, vector)).select("id", "h1", "h2", "v").mapInArrow(run, "dim int, id long, h1 long, h2 long, code binary, scale float")
    return coded.groupBy("dim", "h1", "h2", "code", "scale").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("n"))


def _asked(queries: DataFrame, seed: int) -> DataFrame:
    """(dim, id, code, low, step, total): queries as bit planes and their numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, x in matrices(pa.concat_arrays([batch.column(1)])):
                planes, numbers = quantise(x.astype(np.float64), seed)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(rows), x.shape[1], np.int32)), batch.column(0).take(pa.array(rows)), pa.array([p.tobytes() for p in planes], pa.binary()), *(pa.array(c) for c in numbers.T)], names=["dim", "id", "code", "low", "step", "total"])

    return queries.mapInArrow(run, "dim int, id long, code binary, low double, step double, total double")


class _Block:
    """The queries of a cell of one dimension, and what is known of their neighbours."""

    def __init__(self, dim: int, k: int, eps: float) -> None:
        self.words, self.k, self.eps, self.parts = length(dim) // 64, k, eps, []

    def add(self, batch: pa.RecordBatch) -> None:
        self.parts.append((batch.column(3).to_numpy(), _words(batch.column(4), PLANES * self.words).reshape(-1, PLANES, self.words), np.column_stack([batch.column(i).to_numpy() for i in (6, 7, 8)]), batch.column(9).to_numpy(zero_copy_only=False)))

    def close(self) -> None:
        self.ids, self.planes, self.numbers, self.floor = (np.concatenate(p) for p in zip(*self.parts, strict=True))
        self.best = np.full((len(self.ids), self.k), -np.inf, np.float32)
        self.near = np.zeros((len(self.ids), self.k), np.int64)

    def tiles(self, batch: pa.RecordBatch) -> Iterator[tuple[slice, np.ndarray, np.ndarray, np.ndarray]]:
        """(queries, reps, scalars, estimates) of a batch of codes, in tiles."""
        reps, codes, scales = batch.column(3).to_numpy(), _words(batch.column(4), self.words), batch.column(5).to_numpy(zero_copy_only=False).astype(np.float64)
        for c in range(0, len(reps), TILE_CODES):
            own = slice(c, c + TILE_CODES)
            ones = np.bitwise_count(codes[own]).sum(axis=1, dtype=np.float32)
            for q in range(0, len(self.ids), TILE_QUERIES):
                some = slice(q, q + TILE_QUERIES)
                yield some, reps[own], scales[own], estimates(self.planes[some], self.numbers[some], codes[own], ones, scales[own])

    def rank(self, batch: pa.RecordBatch) -> None:
        """Take the batch's codes into the k best estimates of each query, its own vector apart."""
        for some, reps, _, near in self.tiles(batch):
            best, ids = self.best[some], self.near[some]
            if np.isneginf(best[:, -1]).any():
                m = min(self.k + 1, near.shape[1])
                j = np.argpartition(near, near.shape[1] - m, axis=1)[:, -m:]
                i = np.repeat(np.arange(len(near)), m)
                j = j.ravel()
            else:
                i, j = np.nonzero(near > best[:, -1:])
            new = reps[j] != self.ids[some][i]
            i, j = i[new], j[new]
            if not len(i):
                continue
            self.best[some], self.near[some] = _merged(best, ids, i, near[i, j], reps[j])

    def ranked(self) -> pa.RecordBatch:
        i, j = np.nonzero(~np.isneginf(self.best))
        return pa.RecordBatch.from_arrays([pa.array(self.ids[i]), pa.array(self.near[i, j]), pa.array(self.best[i, j])], names=["query_id", "rep", "near"])

    def reached(self, batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        """The queries whose floor a code's upper bound reaches, in rows (rep, queries)."""
        parts: list[tuple[np.ndarray, np.ndarray]] = []

        def rows() -> pa.RecordBatch:
            q, reps = (np.concatenate(p) for p in zip(*parts, strict=True))
            parts.clear()
            order = np.argsort(reps, kind="stable")
            q, reps = q[order], reps[order]
            new = np.ones(len(reps), bool)
            new[1:] = reps[1:] != reps[:-1]
            start = np.maximum.accumulate(np.where(new, np.arange(len(reps)), 0))
            cuts = np.flatnonzero((np.arange(len(reps)) - start) % TOGETHER == 0)
            lists = pa.ListArray.from_arrays(pa.array(np.append(cuts, len(reps)).astype(np.int32)), pa.array(q))
            return pa.RecordBatch.from_arrays([pa.array(reps[cuts]), lists], names=["rep", "asked"])

        for some, reps, scales, near in self.tiles(batch):
            i, j = np.nonzero(near + slack(self.numbers[some, 1], 64 * self.words, scales, self.eps) >= self.floor[some, None])
            if len(i):
                parts.append((self.ids[some][i], reps[j]))
                if sum(len(p[0]) for p in parts) >= PAIRS:
                    yield rows()
        if parts:
            yield rows()


def _merged(best: np.ndarray, near: np.ndarray, i: np.ndarray, values: np.ndarray, names: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """best values and their names by query, and found ones (query, value, name): the new best ones,
    of equal values those with smaller names."""
    k = best.shape[1]
    rows = np.concatenate([np.repeat(np.arange(len(best)), k), i])
    values, names = np.concatenate([best.ravel(), values]), np.concatenate([near.ravel(), names])
    order = np.lexsort([names, -values, rows])
    take = order[np.searchsorted(rows[order], np.arange(len(best)))[:, None] + np.arange(k)]
    return values[take], names[take]


@dataclass(frozen=True)
class _Grid:
    """Blocks of queries by groups of codes."""

    blocks: int
    groups: int

    @classmethod
    def over(cls, queries: DataFrame, index: DataFrame) -> _Grid:
        conf = index.sparkSession.conf
        n, dim = queries.agg(F.count(F.lit(1)), F.max(F.size("v"))).first()
        blocks = max(1, -(-n * (8 * (dim or 0) + length(dim or 1)) // BLOCK))
        tasks = 4 * max(int(conf.get("spark.sql.shuffle.partitions")), index.sparkSession.sparkContext.defaultParallelism)
        return cls(blocks, max(1, min(-(-index.count() * -(-n // blocks) // CELL_PAIRS), -(-tasks // blocks))))

    def block(self, key: str) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(self.blocks)).cast("int")

    def group(self, key: str) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(self.groups)).cast("int")

    def cell(self, block: Column, group: Column) -> Column:
        return (block * self.groups + group).alias("cell")

    def deal(self, rows: DataFrame, *order: str) -> DataFrame:
        return rows.repartitionById(self.blocks * self.groups, F.col("cell")).sortWithinPartitions("cell", *order)


def _every(n: int) -> Column:
    return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))


def _cells(index: DataFrame, asked: DataFrame, grid: _Grid) -> DataFrame:
    """Queries (kind 0) and codes (kind 1) dealt into cells, each a partition: (cell, dim, kind, id, code,
    scale, low, step, total, floor), sorted by dim and kind."""
    none = [F.lit(None).cast("double").alias(c) for c in ("low", "step", "total", "floor")]
    q = asked.withColumns({"block": grid.block("id"), "group": _every(grid.groups)}).select("block", "group", "dim", F.lit(0).alias("kind"), "id", "code", F.lit(None).cast("float").alias("scale"), "low", "step", "total", "floor")
    c = index.withColumns({"block": _every(grid.blocks), "group": grid.group("rep")}).select("block", "group", "dim", F.lit(1).alias("kind"), F.col("rep").alias("id"), "code", "scale", *none)
    both = q.unionByName(c).select(grid.cell(F.col("block"), F.col("group")), "dim", "kind", "id", "code", "scale", "low", "step", "total", "floor")
    return grid.deal(both, "dim", "kind")


def _pass(cells: DataFrame, k: int, eps: float, first: bool) -> DataFrame:
    """The first pass's (query_id, rep, near), or the second's (cell, rep, asked array)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block: _Block | None = None
        dim, open_ = None, False
        for whole in batches:
            key = whole.column(1).to_numpy().astype(np.int64) * 2 + whole.column(2).to_numpy()
            cuts = [0, *(np.flatnonzero(key[1:] != key[:-1]) + 1).tolist(), len(key)]
            for a, b in zip(cuts, cuts[1:]):
                if a == b:
                    continue
                d, kind, part = int(key[a]) >> 1, int(key[a]) & 1, whole.slice(a, b - a)
                if d != dim:
                    if first and block is not None and not open_:
                        yield block.ranked()
                    dim, block, open_ = d, None, False
                if kind == 0:
                    if block is None:
                        block, open_ = _Block(d, k, eps), True
                    block.add(part)
                elif block is not None:
                    if open_:
                        block.close()
                        open_ = False
                    if first:
                        block.rank(part)
                    else:
                        cell = part.column(0)[0]
                        for found in block.reached(part):
                            yield pa.RecordBatch.from_arrays([pa.array(np.full(found.num_rows, cell.as_py(), np.int32)), *found.columns], names=["cell", "rep", "asked"])
        if first and block is not None and not open_:
            yield block.ranked()

    return cells.mapInArrow(run, "query_id long, rep long, near float" if first else "cell int, rep long, asked array<long>")


def _scored(pairs: DataFrame, own: DataFrame, asked: DataFrame) -> DataFrame:
    """pairs(query_id, rep) with `score`, the exact cosine of the original vectors."""
    met = pairs.join(own.select(F.col("id").alias("rep"), F.col("v").alias("a")), "rep").join(asked.select(F.col("id").alias("query_id"), F.col("v").alias("b")), "query_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, a in matrices(pa.concat_arrays([batch.column(2)])):
                (_, b), *_ = matrices(batch.column(3).take(pa.array(rows)))
                take = pa.array(rows)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), pa.array(cosines(a.astype(np.float64), b.astype(np.float64)))], names=["query_id", "rep", "score"])

    return met.select("query_id", "rep", "a", "b").mapInArrow(run, "query_id long, rep long, score double")


def _best(reached: DataFrame, own: DataFrame, asked: DataFrame, grid: _Grid, k: int) -> DataFrame:
    """(query_id, rep, score): of reached(cell, rep, asked) the k best of each query in each cell by exact
    cosine, ties to the smaller rep. Queries go to all cells of their block, vectors to those reached."""
    q = asked.withColumn("group", _every(grid.groups)).select(grid.cell(grid.block("id"), F.col("group")), F.lit(0).alias("kind"), "id", "v", F.lit(None).cast("array<long>").alias("asked"))
    c = reached.join(own.select(F.col("id").alias("rep"), "v"), "rep").select("cell", F.lit(1).alias("kind"), F.col("rep").alias("id"), "v", "asked")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        ids = where = best = near = None
        matrix: dict[int, np.ndarray] = {}

        def ready() -> None:
            nonlocal ids, where, best, near
            t = pa.Table.from_batches(held).combine_chunks()
            held.clear()
            t = t.take(pa.array(np.argsort(t.column("id").to_numpy(), kind="stable")))
            ids, where = t.column("id").to_numpy(), np.zeros(t.num_rows, np.int64)
            for rows, x in matrices(pa.concat_arrays(t.column("v").chunks)):
                where[rows], matrix[x.shape[1]] = np.arange(len(rows)), x
            best, near = np.full((len(ids), k), -np.inf), np.zeros((len(ids), k), np.int64)

        def rank(part: pa.RecordBatch) -> None:
            names = part.column(2).to_numpy()
            for rows, x in matrices(pa.concat_arrays([part.column(3)])):
                lists = part.column(4).take(pa.array(rows))
                i, j = np.searchsorted(ids, lists.flatten().to_numpy()), np.repeat(np.arange(len(rows)), lists.value_lengths().to_numpy())
                score = np.concatenate([cosines(x[j[a : a + 8192]].astype(np.float64), matrix[x.shape[1]][where[i[a : a + 8192]]].astype(np.float64)) for a in range(0, len(i), 8192)])
                good = score >= best[i, -1]
                hit, i = np.unique(i[good], return_inverse=True)
                if len(hit):
                    best[hit], near[hit] = _merged(best[hit], near[hit], i, score[good], names[rows][j[good]])

        for batch in slices(batches, TILE_CODES):
            split = int(np.searchsorted(batch.column(1).to_numpy(), 1))
            if split:
                held.append(batch.slice(0, split).select(["id", "v"]))
            if split < batch.num_rows:
                if held:
                    ready()
                rank(batch.slice(split))
        if best is not None:
            i, j = np.nonzero(~np.isneginf(best))
            yield pa.RecordBatch.from_arrays([pa.array(ids[i]), pa.array(near[i, j]), pa.array(best[i, j])], names=["query_id", "rep", "score"])

    return grid.deal(q.unionByName(c), "kind").mapInArrow(run, "query_id long, rep long, score double")


def search(index: DataFrame, vectors: DataFrame, queries: DataFrame, k: int = 5, seed: int = 7, key: str = "vec_id", vector: str = "embedding", eps: float = EPS) -> DataFrame:
    """(query_id, rank from 1, vec_id, score): each query's k nearest rows of `vectors` by cosine, ties
    to the smaller key; the row with the query's own key is no candidate. `index` is what
    `build_index` made of `vectors` with the same seed; it should be a stored table, as it is read
    several times.

    Null, empty, zero and non-finite vectors and null keys take no part; vectors meet those of their own
    dimension only. Of rows that share a key the least vector counts, on either side. Empty tables
    give no rows. What misses a true neighbour is an error beyond eps standard deviations. Of near
    copies whose cosines differ by less than the bound all meet the originals: a search for a
    member of a group of m such rows takes time with m.
    """
    own = _unique(vectors, key, vector)
    q = keep(_unique(queries, key, vector), "queries")
    grid = _Grid.over(q, index)
    planes = keep(_asked(q, seed), "planes")
    order = lambda c, *by: F.row_number().over(Window.partitionBy(c).orderBy(*by))
    near = _pass(_cells(index, planes.withColumn("floor", F.lit(None).cast("double")), grid), k, eps, True)
    near = near.withColumn("r", order("query_id", F.desc("near"), "rep")).filter(F.col("r") <= k).select("query_id", "rep")
    floors = _scored(near, own, q).groupBy("query_id").agg(F.min("score").alias("floor"), F.count(F.lit(1)).alias("n")).filter(F.col("n") == k)
    planes = keep(planes.join(floors.select(F.col("query_id").alias("id"), "floor"), "id", "left").withColumn("floor", F.coalesce("floor", F.lit(float("-inf")))), "floors")
    # A query's own code may come first with no other row to it, so k + 1 codes give k rows.
    found = _best(_pass(_cells(index, planes, grid), k, eps, False), own, q, grid, k + 1)
    top = keep(found.withColumn("r", order("query_id", F.desc("score"), "rep")).filter(F.col("r") <= k + 1).select("query_id", "rep", "score"), "top")
    copied = keep(index.filter("n > 1").join(top.select("rep").distinct(), "rep", "left_semi").select("h1", "h2", "rep"), "copied")
    members = _hashes(own).select("id", "h1", "h2").join(copied, ["h1", "h2"])
    members = members.withColumn("r", order("rep", "id")).filter(F.col("r") <= k + 1).select("rep", F.col("id").alias("member"))
    rows = top.join(members, "rep", "left").select("query_id", F.coalesce("member", "rep").alias("vec_id"), "score").filter("vec_id <> query_id")
    return rows.withColumn("rank", order("query_id", F.desc("score"), "vec_id")).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
