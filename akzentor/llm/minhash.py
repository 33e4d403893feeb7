"""MinHash near-duplicates with b-bit signatures.

Documents with equal shingle sets are one class. A class keeps PERMUTATIONS minima; bands of them
make candidate keys, and of each minimum only the low bits stay, packed in planes of 64-bit
numbers. Similarity is estimated from counts of equal bits, corrected for chance collisions,
and pairs that the estimate doesn't rule out are confirmed on the full shingle sets.

No group of a key is expanded into its pairs. First every member of a key is paired with two hubs;
what is confirmed forms components, and most near copies are then in one with each other. The
members of a key outside of its largest component are compared with all others of the key, so
that no link between different texts is lost, but in blocks that send out no pairs: the
time for that grows with the number of such members times the size of the key.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from akzentor.llm.common import discard, keep, slices
from akzentor.llm.components import connected_components

#: 25 bands of 5 minima miss a pair of similarity 0.8 once in 20,000 times, nearer ones far less often.
PERMUTATIONS, BANDS, ROWS, BITS = 128, 25, 5, 2
#: Standard errors by which an estimate may fall short of the threshold before a pair is ruled out.
SLACK = 5.0
MEMO_WORDS = 200_000
#: Rows of a block in which sets meet, and columns of an incidence matrix.
BLOCK, COLUMNS = 256, 4096


class _Words(dict):
    """Word -> 64-bit hash, for the words met lately."""

    def __missing__(self, word: bytes) -> int:
        made = xxhash.xxh3_64_intdigest(word)
        if len(self) >= MEMO_WORDS:
            self.clear()
        self[word] = made
        return made


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def shingles(text: str | None, words: int, memo: dict[bytes, int]) -> np.ndarray:
    """The sorted distinct 64-bit shingles of a whole text: A-Z in lower case, words between
    ASCII white space, runs of `words`; of fewer words all as one; none for no word."""
    own = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not own:
        return np.zeros(0, np.uint64)
    if len(own) < words:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(own), seed=len(own))], np.uint64)
    h = np.fromiter(map(memo.__getitem__, own), np.uint64, len(own))
    n = len(h) - words + 1
    total = np.zeros(n, np.uint64)
    for i in range(words):
        total = _mix(total + h[i : i + n])
    return np.unique(total)


class Sketcher:
    def __init__(self, seed: int = 4_099) -> None:
        rng = np.random.default_rng(seed)
        self.a = rng.integers(1 << 31, size=(PERMUTATIONS, 1), dtype=np.uint32) * np.uint32(2) + np.uint32(1)
        self.b = rng.integers(1 << 32, size=(PERMUTATIONS, 1), dtype=np.uint32)

    def minima(self, s: np.ndarray) -> np.ndarray:
        x = (s >> np.uint64(32)).astype(np.uint32)
        least = np.full(PERMUTATIONS, 0xFFFFFFFF, np.uint32)
        for i in range(0, len(x), 2048):
            np.minimum(least, (x[i : i + 2048] * self.a + self.b).min(axis=1), out=least)
        return least

    @staticmethod
    def keys(least: np.ndarray) -> np.ndarray:
        """A 64-bit key for each band; the band's number is part of it."""
        rows = least[: BANDS * ROWS].reshape(BANDS, ROWS).astype(np.uint64)
        out = np.arange(1, BANDS + 1, dtype=np.uint64)
        for i in range(ROWS):
            out = _mix(out * np.uint64(0x9E3779B97F4A7C15) + rows[:, i])
        return out.view(np.int64)

    @staticmethod
    def planes(least: np.ndarray) -> np.ndarray:
        """BITS planes of PERMUTATIONS bits, as 64-bit numbers."""
        low = _mix(least.astype(np.uint64))
        bits = np.stack([(low >> np.uint64(i)) & np.uint64(1) for i in range(BITS)]).astype(np.uint8)
        return np.packbits(bits, axis=1).view(np.int64).ravel()


def similarity(a: list[Column], b: list[Column]) -> Column:
    """The collision-corrected estimate from two packed signatures."""
    per = PERMUTATIONS // 64
    apart = [F.bit_count(_any([a[p * per + i].bitwiseXOR(b[p * per + i]) for p in range(BITS)])) for i in range(per)]
    same = F.lit(1.0) - sum(apart[1:], apart[0]) / F.lit(float(PERMUTATIONS))
    chance = 2.0**-BITS
    return (same - F.lit(chance)) / F.lit(1 - chance)


def _any(bits: list[Column]) -> Column:
    out = bits[0]
    for b in bits[1:]:
        out = out.bitwiseOR(b)
    return out


def floor_of(percent: int) -> float:
    """The least estimate that doesn't rule out a pair at the threshold."""
    t, chance = percent / 100, 2.0**-BITS
    same = t + (1 - t) * chance
    return t - SLACK * (same * (1 - same) / PERMUTATIONS) ** 0.5 / (1 - chance)


SIG = [f"s{i}" for i in range(BITS * PERMUTATIONS // 64)]


def sketch(docs: DataFrame, words: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, n, h1, h2, keys, s0...): set size, fingerprint of the set, band keys, packed signature."""
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("n", T.LongType()), T.StructField("h1", T.LongType()), T.StructField("h2", T.LongType()), T.StructField("keys", T.ArrayType(T.LongType())), *(T.StructField(s, T.LongType()) for s in SIG)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo, make = _Words(), Sketcher()
        for batch in slices(batches):
            size, prints, keys, sigs = [], [], [], []
            for t in batch.column(1).to_pylist():
                s = shingles(t, words, memo)
                least = make.minima(s)
                size.append(len(s))
                prints.append(np.frombuffer(xxhash.xxh3_128_digest(s.tobytes()), np.int64))
                keys.append(make.keys(least) if len(s) else np.zeros(0, np.int64))
                sigs.append(make.planes(least))
            if not size:
                continue
            h, sig = np.stack(prints), np.stack(sigs)
            ends = np.cumsum([0, *map(len, keys)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(keys)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(size, pa.int64()), pa.array(h[:, 0]), pa.array(h[:, 1]), lists, *(pa.array(np.ascontiguousarray(sig[:, i])) for i in range(len(SIG)))], names=schema.names)

    return docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text")).mapInArrow(run, schema)


def _sets(docs: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """(id, set) of the documents in wanted(id): the whole sorted shingle sets as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = _Words()
        for batch in slices(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([shingles(t, words, memo).tobytes() for t in batch.column(1).to_pylist()], pa.binary())], names=["id", "set"])

    return docs.join(wanted, "id", "left_semi").mapInArrow(run, "id long, set binary")


def _confirm(pairs: DataFrame, docs: DataFrame, words: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose whole shingle sets reach the threshold."""
    wanted = keep(pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct(), "wanted")
    sets = keep(_sets(docs, wanted, words), "sets")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                if len(x) > len(y):
                    x, y = y, x
                both = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum()) if len(x) else 0
                good.append(100 * both >= percent * (len(x) + len(y) - both) and both > 0)
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(good, pa.bool_())) for c in (batch.column(0), batch.column(1))], names=["a", "b"])

    with_b = pairs.join(sets.select(F.col("id").alias("b"), F.col("set").alias("y")), "b")
    both = with_b.join(sets.select(F.col("id").alias("a"), F.col("set").alias("x")), "a").select("a", "b", "x", "y")
    found = keep(both.mapInArrow(run, "a long, b long"), "links")
    discard(sets)
    discard(wanted)
    return found


def _rest(member: DataFrame, docs: DataFrame, words: int, percent: int) -> DataFrame:
    """Links (a, b) between members of a key in different components; member has (key, rep, c,
    minor, s0...), and of two members in different components one at least is minor.

    Semi joins leave the members that an estimate pairs with another; these meet in blocks of a
    key, where products of incidence matrices give all intersections exactly. What comes out of a
    block is a spanning forest of its links.
    """
    close = similarity([F.col(f"a_{s}") for s in SIG], [F.col(f"b_{s}") for s in SIG]) >= F.lit(floor_of(percent))
    a = member.select("key", F.col("rep").alias("a_rep"), F.col("c").alias("a_c"), "minor", *(F.col(s).alias(f"a_{s}") for s in SIG))
    b = member.select(F.col("key").alias("b_key"), F.col("c").alias("b_c"), F.col("minor").alias("b_minor"), *(F.col(s).alias(f"b_{s}") for s in SIG))
    apart = (F.col("key") == F.col("b_key")) & (F.col("a_c") != F.col("b_c")) & close
    lone = a.filter("minor").join(b, apart, "left_semi").select("key", F.col("a_rep").alias("id"), F.col("a_c").alias("c"), F.lit(True).alias("minor"))
    rest = a.filter("not minor").join(b.filter("b_minor"), apart, "left_semi").select("key", F.col("a_rep").alias("id"), F.col("a_c").alias("c"), F.lit(False).alias("minor"))
    near = keep(lone.unionByName(rest), "near")
    size = keep(near.groupBy("key").agg(F.ceil(F.sum(F.col("minor").cast("long")) / BLOCK).cast("int").alias("rows"), F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("cols")), "blocks")
    near = keep(near.join(size.filter("rows > 0"), "key"), "near")
    slot = lambda n: F.pmod(F.xxhash64("id"), F.col(n).cast("long")).cast("int")
    left = near.filter("minor").select("key", "id", "c", F.lit(True).alias("left"), slot("rows").alias("i"), F.explode(F.sequence(F.lit(0), F.col("cols") - 1)).alias("j"))
    right = near.select("key", "id", "c", F.lit(False).alias("left"), F.explode(F.sequence(F.lit(0), F.col("rows") - 1)).alias("i"), slot("cols").alias("j"))
    wanted = keep(near.select("id").distinct(), "wanted")
    sets = keep(_sets(docs, wanted, words), "sets")
    met = left.unionByName(right).join(sets, "id").select("key", "i", "j", "left", "id", "c", "set")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            t = pa.Table.from_batches([batch])
            t = pa.concat_tables([held, t]) if held is not None else t
            key = np.column_stack([t.column(c).to_numpy() for c in ("key", "i", "j")])
            cuts = [0, *(np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1).tolist()]
            for x, y in zip(cuts, cuts[1:]):
                yield _block_links(t.slice(x, y - x), percent)
            held = t.slice(cuts[-1])
        if held is not None and held.num_rows:
            yield _block_links(held, percent)

    ordered = met.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "left", "id")
    found = keep(ordered.mapInArrow(run, "a long, b long"), "links")
    discard(sets)
    return found


def _block_links(t: pa.Table, percent: int) -> pa.RecordBatch:
    """A spanning forest of the links between the left and the right rows of one block, over what
    their components join already."""
    sets = [np.frombuffer(x.as_buffer(), np.uint64) for chunk in t.column("set").chunks for x in chunk]
    ids, comp, left = (t.column(c).to_numpy() for c in ("id", "c", "left"))
    size = np.array([len(s) for s in sets])
    # Shingles of one row alone are in no intersection.
    flat, row = np.concatenate(sets), np.repeat(np.arange(len(sets)), size)
    _, column, times = np.unique(flat, return_inverse=True, return_counts=True)
    some = times[column] > 1
    column, row = np.cumsum(times > 1)[column[some]] - 1, row[some]
    l, r = np.flatnonzero(left), np.flatnonzero(~left)
    both = np.zeros((len(l), len(r)), np.float32)
    wide = int(column.max()) + 1 if len(column) else 0
    for at in range(0, wide, COLUMNS):
        here = (column >= at) & (column < at + COLUMNS)
        m = np.zeros((len(sets), min(COLUMNS, wide - at)), np.float32)
        m[row[here], column[here] - at] = 1
        both += m[l] @ m[r].T
    both = both.astype(np.int64)
    hit = (100 * both >= percent * (size[l][:, None] + size[r][None] - both)) & (both > 0) & (comp[l][:, None] != comp[r][None])
    up: dict[int, int] = {}

    def root(x: int) -> int:
        while (y := up.get(x, x)) != x:
            up[x] = up.get(y, y)
            x = y
        return x

    a, b = [], []
    for i, j in zip(*(x.tolist() for x in np.nonzero(hit)), strict=True):
        x, y = root(int(comp[l[i]])), root(int(comp[r[j]]))
        if x != y:
            up[max(x, y)] = min(x, y)
            a.append(int(ids[l[i]]))
            b.append(int(ids[r[j]]))
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_shingles, component_id, kept) for every row.

    Documents are linked if 100 * |intersection| >= percent * |union| of their sets of `words`-word
    shingles; `component_id` is the smallest key reachable by links, the row's own included, and
    `kept` is true where it is the own one. Null texts and texts without a word have no
    shingles and no links. Rows that share a key are one document with the links of all. Null keys
    have no links and a null component. An empty table gives none. Other columns aren't read.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"))
    all_ = keep(sketch(docs, words, key, text), "sketches")
    linkable = all_.filter("n > 0 and id is not null")
    classes = keep(linkable.groupBy("n", "h1", "h2").agg(F.min("id").alias("rep")), "classes")
    reps = keep(linkable.join(classes.select(F.col("rep").alias("id"), "n", "h1", "h2"), ["id", "n", "h1", "h2"], "left_semi").select(F.col("id").alias("rep"), "keys", *SIG), "reps")
    entries = reps.select(F.explode("keys").alias("key"), "rep")

    # Pairs of each member with its key's hubs: the smallest and the largest one.
    hubs = entries.groupBy("key").agg(F.min("rep").alias("lo"), F.max("rep").alias("hi")).filter("lo <> hi")
    hubs = keep(hubs, "hubs")
    shared = keep(entries.join(hubs, "key").select("key", "rep", "lo", "hi"), "shared")
    star = shared.select(F.col("rep").alias("b"), F.explode(F.array("lo", "hi")).alias("a")).filter("a <> b")
    star = keep(star.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "star")
    sig = reps.select("rep", *SIG)
    left = sig.select(F.col("rep").alias("a"), *(F.col(s).alias(f"a_{s}") for s in SIG))
    right = sig.select(F.col("rep").alias("b"), *(F.col(s).alias(f"b_{s}") for s in SIG))
    close = similarity([F.col(f"a_{s}") for s in SIG], [F.col(f"b_{s}") for s in SIG]) >= F.lit(floor_of(percent))
    likely = keep(keep(star.join(left, "a"), "half").join(right, "b").filter(close).select("a", "b"), "likely")
    links = _confirm(likely, texts, words, percent)

    # What is left: members of a key outside of the component that most of the key's members are in.
    first = keep(connected_components(links), "first")
    placed = keep(shared.select("key", "rep").join(first.withColumnRenamed("node", "rep"), "rep", "left").select("key", "rep", F.coalesce("component", "rep").alias("c")), "placed")
    most = placed.groupBy("key", "c").agg(F.count(F.lit(1)).alias("n")).groupBy("key").agg(F.max(F.struct("n", "c"))["c"].alias("major"), F.count(F.lit(1)).alias("parts"))
    most = keep(most.filter("parts > 1").select("key", "major"), "majors")
    member = keep(placed.join(most, "key").select("key", "rep", "c", (F.col("c") != F.col("major")).alias("minor")), "inside")
    member = keep(member.join(sig, "rep"), "signed")
    more = _rest(member, texts, words, percent)
    comp = connected_components(links.unionByName(more)).withColumnRenamed("node", "rep")

    known = keep(classes.join(comp, "rep", "left").select("n", "h1", "h2", F.coalesce("component", "rep").alias("component_id")), "known")
    out = all_.select("id", "n", "h1", "h2").join(known, ["n", "h1", "h2"], "left")
    out = out.select(F.col("id").alias(key), F.col("n").alias("n_shingles"), F.when(F.col("id").isNull(), F.lit(None)).otherwise(F.coalesce("component_id", "id")).alias("component_id"))
    return out.withColumn("kept", F.col(key) == F.col("component_id"))
