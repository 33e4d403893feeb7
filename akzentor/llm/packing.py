"""Best-fit packing of documents' tokens into sequences of a fixed capacity.

Only lengths are moved: documents are tokenised where they are read, and the small rows of
their pieces are dealt out by a hash. Each task packs what it gets with bounded-space online
best-fit: a fixed number of open bins in a bitset keyed by free space. A piece goes to the open
bin with the least free space that holds it; if none does, a bin is opened, and the fullest open
bin closes when there are too many. Pieces pass through a fixed buffer in which the longest come
first, which leaves the short ones to fill the gaps.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from akzentor.llm.bpe import fast_codec
from akzentor.llm.common import slices

OPEN_BINS = 32_768
BUFFER = 65_536

PIECES = T.StructType([T.StructField(n, k) for n, k in (("doc_id", T.LongType()), ("piece", T.IntegerType()), ("start", T.LongType()), ("length", T.LongType()), ("ids_crc32", T.LongType()))])
PACKED = T.StructType([*PIECES.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])


def spans(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens: one, or with n over the capacity full pieces
    after a first one that takes the remainder."""
    if n <= capacity:
        return [(0, n)]
    first = n % capacity or capacity
    return [(0, first), *((i, capacity) for i in range(first, n, capacity))]


def pieces(docs: DataFrame, tokenizer: str, capacity: int = 2048, separator: int = 0, key: str = "doc_id", text: str = "text") -> DataFrame:
    """A row per piece: doc_id, piece, start, length, ids_crc32.

    A document's tokens are its text's ids, then `separator`. Null or empty texts are the
    separator alone. Repeated rows give pieces each. Null keys stay null. Other columns of
    `docs` aren't read.
    """
    last = np.array([separator], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = fast_codec(tokenizer)
        for batch in slices(batches):
            rows = []
            for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = c.encode(t or "") + last
                rows += [(k, p, s, n, zlib.crc32(ids[4 * s : 4 * (s + n)])) for p, (s, n) in enumerate(spans(len(ids) // 4, capacity))]
            cols = list(zip(*rows, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], names=PIECES.names)

    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, PIECES)


class BestFit:
    """Bounded-space online best-fit; gives each piece (bin, offset)."""

    def __init__(self, capacity: int, open_bins: int = OPEN_BINS) -> None:
        self.capacity, self.limit = capacity, open_bins
        self.bits, self.count, self.opened = 0, 0, 0
        self.by_free: dict[int, list[int]] = defaultdict(list)

    def _take(self, free: int) -> int:
        bins = self.by_free[free]
        found = bins.pop()
        if not bins:
            self.bits &= ~(1 << free)
        self.count -= 1
        return found

    def place(self, length: int) -> tuple[int, int]:
        if not 0 < length <= self.capacity:
            raise ValueError(f"a piece of {length} tokens")
        if fits := self.bits >> length:
            free = length + (fits & -fits).bit_length() - 1
            own = self._take(free)
        else:
            free, own = self.capacity, self.opened
            self.opened += 1
        if left := free - length:
            if self.count >= self.limit:  # the fullest closes, be it this one
                least = (self.bits & -self.bits).bit_length() - 1
                if least >= left:
                    return own, self.capacity - free
                self._take(least)
            self.by_free[left].append(own)
            self.bits |= 1 << left
            self.count += 1
        return own, self.capacity - free


def pack(parts: DataFrame, capacity: int = 2048, open_bins: int = OPEN_BINS) -> DataFrame:
    """The rows of `pieces` with sequence_id and offset; sequences have no gaps.

    Rows are dealt out and ordered by hashes of their content, so a task that runs again packs
    alike. An empty table gives an empty table.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fit, base = BestFit(capacity, open_bins), TaskContext.get().partitionId() << 36

        def out(rows: list[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
            t = pa.Table.from_batches(rows).combine_chunks()
            n = t.column("length").to_numpy()
            seq, off = np.zeros(len(n), np.int64), np.zeros(len(n), np.int64)
            for i in np.argsort(-n, kind="stable").tolist():
                seq[i], off[i] = fit.place(int(n[i]))
            t = t.append_column("sequence_id", pa.array(seq + base)).append_column("offset", pa.array(off))
            return t.to_batches(max_chunksize=8192)

        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) >= BUFFER:
                yield from out(held)
                held = []
        if held:
            yield from out(held)

    own = [F.col(c) for c in PIECES.names]
    dealt = parts.select(*own).repartition(F.xxhash64("doc_id", "piece")).sortWithinPartitions(F.xxhash64("piece", "doc_id"), *own)
    return dealt.mapInArrow(run, PACKED)
