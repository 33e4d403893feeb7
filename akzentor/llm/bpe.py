"""Byte-level BPE as a bounded-lookahead streaming transducer, and its incremental decoder.

Bound. Run the rules of a merge list in rank order over a text w and over w + x. Both runs share
every token boundary up to some place d, at first len(w). Rule (u, v) moves d left only if the
token that ends at d is u and the other run has v right of it; d then moves by len(u), and the
token right of d now begins with u. So a later move needs a rule whose right side begins, by
its own derivation, with u. The costliest chain of such rules, the sum of their len(u), bounds
how far text still unseen can reach back: `sufficient_lookahead`. A token that ends at least
that far before the end of what was read is stable and is emitted.

The pre-tokeniser (letters, numbers, other signs, white space, English contractions) needs at
most three characters beyond a match's start and one beyond its end. Runs longer than a window
are fed to the merge stage piecewise, so the memory of a stream is bounded by the window
whatever the text. Added tokens' strings inside a text become their ids, as in the library.
"""

from __future__ import annotations

import codecs
import heapq
import json
import sys
import unicodedata
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from akzentor.llm.common import slices

#: Characters that a stream takes at once.
CHUNK = 1 << 16
#: Pieces that a worker remembers, and the longest of them.
MEMO_PIECES, MEMO_CHARS = 150_000, 48
_BITS = 20


def byte_signs() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies: itself where
    that is printable Latin-1, else the next free character from U+0100 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(spare)) for b in range(256)]


def sufficient_lookahead(merges: list[tuple[bytes, bytes]]) -> int:
    """Bytes of unseen context that can change a token; see the module's text."""
    left: dict[bytes, bytes] = {}  # a merged token's left part
    reach: dict[bytes, int] = {}  # by u, the costliest chain so far that ends in a rule (u, _)
    most = 0
    for u, v in merges:
        before, spine = 0, v
        while True:
            before = max(before, reach.get(spine, 0))
            if spine not in left:
                break
            spine = left[spine]
        cost = before + len(u)
        reach[u] = max(reach.get(u, 0), cost)
        left[u + v] = u
        most = max(most, cost)
    return most


def _unknown_signs() -> str:
    """Ranges of code points that `regex` calls letters or numbers, but that this Python's Unicode
    (no newer than the tokenizers library's) doesn't have yet."""
    odd = [c for c in map(chr, range(sys.maxunicode + 1)) if unicodedata.category(c) == "Cn" and regex.match(r"[\p{L}\p{N}]", c)]
    runs: list[list[int]] = []
    for c in map(ord, odd):
        if runs and runs[-1][1] == c - 1:
            runs[-1][1] = c
        else:
            runs.append([c, c])
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in runs)


class _Memo(dict):
    def __init__(self, make) -> None:
        super().__init__()
        self.make, self.older = make, {}

    def __missing__(self, piece: str) -> bytes:
        made = self.older.get(piece) or self.make(piece)
        if len(piece) <= MEMO_CHARS:
            if len(self) >= MEMO_PIECES:  # those not asked for since the last time go
                self.older = dict(self)
                self.clear()
            self[piece] = made
        return made


class Codec:
    """Encoder and decoder for a byte-level BPE file of the tokenizers library.

    The merge list must be proper: each side of a rule is a byte or made by an earlier rule, and
    no two rules make the same token; ValueError otherwise.
    """

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        signs = byte_signs()
        raw = {c: b for b, c in enumerate(signs)}
        model = spec["model"]
        vocab: dict[str, int] = model["vocab"]
        rules = [tuple(m.split(" ") if isinstance(m, str) else m) for m in model["merges"]]
        self.of_byte = [vocab[c] for c in signs]
        self.rules: dict[int, int] = {}
        made = {c for c in signs}
        for rank, (u, v) in enumerate(rules):
            if u not in made or v not in made or u + v in made:
                raise ValueError(f"merge rule {rank} isn't proper")
            made.add(u + v)
            self.rules[vocab[u] << _BITS | vocab[v]] = rank << _BITS | vocab[u + v]
        self.bytes_of: dict[int, bytes] = {i: bytes(map(raw.__getitem__, s)) for s, i in vocab.items() if s in made}
        self.added = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.bytes_of |= {i: s.encode() for s, i in self.added.items()}
        self.specials = regex.compile("|".join(map(regex.escape, sorted(self.added, key=len, reverse=True)))) if self.added else None
        self.lookahead = sufficient_lookahead([(bytes(map(raw.__getitem__, u)), bytes(map(raw.__getitem__, v))) for u, v in rules])
        self.window = 4096 + 2 * self.lookahead
        self.memo = _Memo(self._piece)
        self._patterns: dict[bool, tuple] = {}

    # -- pre-tokenisation ---------------------------------------------------------------------

    def _pattern(self, text: str):
        """The splitter and its classes for this text; the careful one where a text holds code
        points beyond U+0557, the first that needs care."""
        try:
            text.encode("latin-1")
            careful = False
        except UnicodeEncodeError:
            careful = max(text) >= "՘"
        if careful not in self._patterns:
            cut = f"--[{_unknown_signs()}]" if careful else ""
            letter, number = f"[\\p{{L}}{cut}]", f"[\\p{{N}}{cut}]"
            other = f"[^\\s{letter}{number}]"
            self._patterns[careful] = (
                regex.compile(f"(?V1)'s|'t|'re|'ve|'m|'ll|'d| ?{letter}+| ?{number}+| ?{other}+|\\s+(?!\\S)|\\s+"),
                [regex.compile(f"(?V1){c}+") for c in (letter, number, other, "\\s")],
            )
        return self._patterns[careful]

    # -- merging ------------------------------------------------------------------------------

    def merge(self, data: bytes) -> list[int]:
        """BPE of one window."""
        ids = [self.of_byte[b] for b in data]
        rules, none = self.rules, 1 << 62
        if len(ids) > 200:
            return self._merge_long(ids)
        ranks = [rules.get(a << _BITS | b, none) for a, b in zip(ids, ids[1:])]
        ranks.append(none)
        while (best := min(ranks)) != none:
            i = ranks.index(best)  # the leftmost of the lowest rank
            ids[i] = new = best & (1 << _BITS) - 1
            del ids[i + 1], ranks[i + 1]
            ranks[i] = rules.get(new << _BITS | ids[i + 1], none) if i + 1 < len(ids) else none
            if i:
                ranks[i - 1] = rules.get(ids[i - 1] << _BITS | new, none)
        return ids

    def _merge_long(self, ids: list[int]) -> list[int]:
        rules, n = self.rules, len(ids)
        after, before = [*range(1, n), -1], [*range(-1, n - 1)]
        heap = [(r >> _BITS, i, r) for i in range(n - 1) if (r := rules.get(ids[i] << _BITS | ids[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, rule = heapq.heappop(heap)
            j = after[i]
            if ids[i] < 0 or j < 0 or rules.get(ids[i] << _BITS | ids[j]) != rule:
                continue
            ids[i], ids[j] = rule & (1 << _BITS) - 1, -1
            after[i] = k = after[j]
            if k >= 0:
                before[k] = i
            for a, b in ((before[i], i), (i, k)):
                if a >= 0 and b >= 0 and (r := rules.get(ids[a] << _BITS | ids[b])) is not None:
                    heapq.heappush(heap, (r >> _BITS, a, r))
        return [x for x in ids if x >= 0]

    def _piece(self, piece: str) -> bytes:
        data = piece.encode()
        if len(data) <= self.window:
            return np.array(self.merge(data), "<u4").tobytes()
        stage = _MergeStage(self)
        return stage.feed(data) + stage.finish()

    # -- whole texts --------------------------------------------------------------------------

    def encode(self, text: str) -> bytes:
        """The ids of a whole text as little-endian unsigned 32-bit numbers."""
        if len(text) > CHUNK:
            stream = Encoder(self)
            parts = [stream.feed(text[i : i + CHUNK]) for i in range(0, len(text), CHUNK)]
            return b"".join([*parts, stream.finish()])
        if self.specials is None or not self.specials.search(text):
            return b"".join(map(self.memo.__getitem__, self._pattern(text)[0].findall(text)))
        out, at = [], 0
        for m in self.specials.finditer(text):
            out += [self.encode(text[at : m.start()]) if m.start() > at else b"", np.array([self.added[m[0]]], "<u4").tobytes()]
            at = m.end()
        return b"".join([*out, self.encode(text[at:])])

    def decode(self, ids: Iterable[int]) -> str:
        """The text of ids; bytes that are no UTF-8 become U+FFFD, unknown ids nothing."""
        stream = Decoder(self)
        return stream.feed(ids) + stream.finish()


class _MergeStage:
    """One piece of unbounded length: takes bytes, emits stable tokens."""

    def __init__(self, codec: Codec) -> None:
        self.codec, self.held = codec, b""

    def feed(self, data: bytes) -> bytes:
        c, out = self.codec, []
        self.held += data
        at = 0
        while len(self.held) - at >= c.window:
            end = at + c.window - c.lookahead
            for i in c.merge(self.held[at : at + c.window]):
                if at + len(c.bytes_of[i]) > end:
                    break
                at += len(c.bytes_of[i])
                out.append(i)
        self.held = self.held[at:]
        return np.array(out, "<u4").tobytes()

    def finish(self) -> bytes:
        ids = self.codec.merge(self.held)
        self.held = b""
        return np.array(ids, "<u4").tobytes()


class Encoder:
    """Text in, in any cuts; ids out once they are stable, as little-endian 32-bit numbers.

    Holds at most a window of bytes and about two chunks of text.
    """

    def __init__(self, codec: Codec) -> None:
        self.codec, self.held, self.run, self.stage = codec, "", None, None

    def feed(self, text: str) -> bytes:
        c, out = self.codec, []
        self.held += text
        if c.specials is not None:
            while m := c.specials.search(self.held):
                rest = self.held[m.end() :]
                self.held = self.held[: m.start()]
                out += [self._close(), np.array([c.added[m[0]]], "<u4").tobytes()]
                self.held = rest
            longest = max(map(len, c.added)) - 1
            back = next((k for k in range(min(longest, len(self.held)), 0, -1) if any(s.startswith(self.held[-k:]) for s in c.added)), 0)
        else:
            back = 0
        ready, self.held = (self.held[:-back], self.held[-back:]) if back else (self.held, "")
        ids, kept = self._split(ready)
        self.held = kept + self.held
        return b"".join([*out, ids])

    def finish(self) -> bytes:
        return self._close()

    def _continue(self, text: str, last: bool) -> tuple[bytes, str]:
        """Go on with a piece that is longer than a chunk."""
        if self.run is None or not text:
            return b"", text
        white = self.run == 3
        m = self.codec._pattern(text)[1][self.run].match(text)
        end = m.end() if m else 0
        over = end < len(text)
        if white and (over or not last) and end:
            end -= 1  # the last white character belongs to what follows
        if white and over and not end and not m:
            raise AssertionError("a held white run always keeps its last character")
        out = self.stage.feed(text[:end].encode())
        if over:
            out += self.stage.finish()
            self.run = self.stage = None
        return out, text[end:]

    def _split(self, text: str) -> tuple[bytes, str]:
        c = self.codec
        head, text = self._continue(text, False)
        if self.run is not None or not text:
            return head, text
        pieces, at, n = [], 0, len(text)
        pattern, classes = c._pattern(text)
        for m in pattern.finditer(text):
            if m.end() >= n or m.start() + 3 > n:
                break
            pieces.append(m[0])
            at = m.end()
        out = [head, *map(c.memo.__getitem__, pieces)]
        tail = text[at:]
        if len(tail) > CHUNK:  # one unbounded run: pass on what is certain
            self.run = next(k for k, p in enumerate(classes) if p.match(tail[-1]))
            self.stage = _MergeStage(c)
            out.append(self.stage.feed(tail[:-1].encode()))
            tail = tail[-1:]
        return b"".join(out), tail

    def _close(self) -> bytes:
        """End of text: what is held is all there is."""
        out, text = self._continue(self.held, True)
        if self.run is not None:
            out += self.stage.finish()
        self.held, self.run, self.stage = "", None, None
        return out + b"".join(map(self.codec.memo.__getitem__, self.codec._pattern(text)[0].findall(text))) if text else out


class Decoder:
    """Ids in, in any cuts; text out as soon as its bytes are complete."""

    def __init__(self, codec: Codec) -> None:
        self.codec, self.state = codec, codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, ids: Iterable[int]) -> str:
        return self.state.decode(b"".join([self.codec.bytes_of.get(i, b"") for i in ids]))

    def finish(self) -> str:
        return self.state.decode(b"", final=True)


@lru_cache(maxsize=4)
def codec(path: str) -> Codec:
    """One per worker process."""
    return Codec(path)


def round_trip(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Encode every whole text and decode the ids again: (key, ids array<int>, decoded string).

    A null text counts as empty and gives no ids and an empty string; an empty table gives none.
    Repeated rows give a row each; further columns of the input are left out, so no name can clash. One pass, no shuffle.
    """
    source = docs.select(F.col(key).alias("k"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    kind = docs.schema[key].dataType
    schema = T.StructType([T.StructField("k", kind), T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(tokenizer)
        for batch in slices(batches):
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                ids = [np.frombuffer(c.encode(t), "<u4").astype(np.int32) for t in part.column(1).to_pylist()]
                ends = np.cumsum([0, *map(len, ids)]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, np.int32), *ids])))
                decoded = []
                for x in ids:
                    stream = Decoder(c)
                    decoded.append("".join([*(stream.feed(x[i : i + CHUNK].tolist()) for i in range(0, len(x), CHUNK)), stream.finish()]))
                yield pa.RecordBatch.from_arrays([part.column(0), lists, pa.array(decoded, pa.string())], names=["k", "ids", "decoded"])

    return source.mapInArrow(run, schema).withColumnRenamed("k", key)


#: A place where no token of the byte-level pre-tokeniser can span, in the text whole or cut: before
#: a single space between other signs. (No added token may hold a space.)
_SAFE = regex.compile(r"(?<=\S)(?= [^\s])")


def safe_parts(text: str, size: int) -> list[str]:
    """Cut a text into parts of about `size` characters at safe boundaries; a stretch without any
    stays whole."""
    if len(text) <= size:
        return [text]
    parts, at = [], 0
    while len(text) - at > size and (m := _SAFE.search(text, at + size)):
        parts.append(text[at : m.start()])
        at = m.start()
    parts.append(text[at:])
    return parts


class FastCodec(Codec):
    """The same ids from a compiled merge loop, for passes that only need lengths or checksums.

    Falls back on `Codec` for code points that the two libraries' Unicode tables may class
    apart, and for stretches without a safe boundary.
    """

    PART = 1 << 14

    def __init__(self, path: str) -> None:
        import tiktoken

        super().__init__(path)
        ranks = {b: i for i, b in self.bytes_of.items() if i not in self.added.values()}
        order = [b for b, _ in sorted(ranks.items(), key=lambda x: x[1])]
        merged = [u for u in order if len(u) > 1]
        rank_of = sorted(self.rules.values())
        if [self.bytes_of[r & (1 << _BITS) - 1] for r in rank_of] != merged:
            raise ValueError("token ids don't follow the merge order")
        self.core = tiktoken.Encoding("fast", pat_str=self._pattern("")[0].pattern.removeprefix("(?V1)"), mergeable_ranks=ranks, special_tokens=self.added)._core_bpe

    def encode(self, text: str) -> bytes:
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            if max(text) >= "՘":
                return super().encode(text)
        parts = safe_parts(text, self.PART)
        if len(parts) == 1 and len(text) <= 4 * self.PART:
            return bytes(self.core.encode_to_tiktoken_buffer(text, set(self.added)))
        return b"".join(bytes(self.core.encode_to_tiktoken_buffer(p, set(self.added))) if len(p) <= 4 * self.PART else super(FastCodec, self).encode(p) for p in parts)


@lru_cache(maxsize=4)
def fast_codec(path: str) -> FastCodec:
    return FastCodec(path)
