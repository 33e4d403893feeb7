"""Words, spans and stresses of many texts at once, as arrays of signs.

Column functions over Arrow batches. A batch's texts are one array of code points, and words, marks
and vowels are masks over it, so that no sign and no word costs a call. Texts are worked on in pieces
of a few megabytes; a text is never cut.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from akzentor.functions.alphabet import ACUTE, CYRILLIC, GRAVE, LATIN, LETTERS, MARKS, PLUS, VOWELS, WORD

#: Bytes of text that are worked on at a time, so that their arrays stay in a core's cache; longer texts alone.
PIECE = 1 << 18
WORD_BIT, VOWEL_BIT, MARK_BIT, HYPHEN_BIT, YO_BIT, COMBINING_BIT, PLUS_BIT = 1, 2, 4, 8, 16, 32, 64
SIZE = 0x500
_KIND = np.zeros(SIZE, np.uint8)
for _signs, _bit in ((WORD, WORD_BIT), (VOWELS, VOWEL_BIT), (MARKS, MARK_BIT), ("-", HYPHEN_BIT), ("ёЁ", YO_BIT), (ACUTE + GRAVE, COMBINING_BIT), (PLUS, PLUS_BIT)):
    for _c in _signs:
        _KIND[ord(_c)] |= _bit
#: Small letters, yo as ye: `marks.fold` for the signs of words.
_FOLD = np.arange(SIZE, dtype=np.uint16)
for _c in LETTERS:
    _FOLD[[ord(_c), ord(_c.upper())]] = ord("е" if _c == "ё" else _c)

#: What is white space to `lines`, and what ends one; the last is for all signs beyond.
_BLANK = np.zeros(0x3002, np.uint8)
_BLANK[[*range(9, 14), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]] = 1
_BLANK[[*range(10, 14), *range(0x1C, 0x1F), 0x85, 0x2028, 0x2029]] = 3
#: The stand-in for Cyrillic, all of whose signs are Latin-1.
_READ = np.arange(256, dtype=np.uint32)
_READ[[ord(c) for c in LATIN]] = [ord(c) for c in CYRILLIC]

WORDS = "array<struct<text:string,stress:int>>"
RULES = "struct<vowels:int,yo:int,first:int,russian:boolean>"
COMPARED = "struct<gold_count:int,lib_count:int,prefix:int,suffix:int,matched:int,scored:int,checked:array<struct<g:int,wrong:boolean>>>"


def _ends(counts: np.ndarray) -> np.ndarray:
    """Running sums from 0: where each of the counted begins, and the end."""
    out = np.zeros(len(counts) + 1, np.int64)
    np.cumsum(counts, out=out[1:])
    return out


def _strings(data: np.ndarray, at: np.ndarray) -> pa.Array:
    return pa.StringArray.from_buffers(len(at) - 1, pa.py_buffer(np.ascontiguousarray(at, np.int32)), pa.py_buffer(np.ascontiguousarray(data)))


def _written(cps: np.ndarray, rows: np.ndarray) -> pa.Array:
    """Code points as strings; `rows` are the first of each, and the end."""
    lens = 1 + (cps >= 0x80) + (cps >= 0x800) + (cps >= 0x10000).astype(np.int64)
    return _strings(np.frombuffer(cps.astype("<u4").tobytes().decode("utf-32-le").encode(), np.uint8), _ends(lens)[rows])


def _each(texts: pa.Array, run: Callable[[Signs], pa.Array]) -> pa.Array:
    """Strings made of texts piece by piece, null where the text is."""
    own = plain(texts)
    out = _together([run(Signs(own.slice(a, b - a))) for a, b in pieces(own)], pa.string())
    return pc.if_else(texts.is_valid(), out, pa.scalar(None, pa.string())) if texts.null_count else out


def offsets(texts: pa.Array) -> np.ndarray:
    """Where each of the strings begins in their bytes, and the end."""
    found = texts.buffers()[1]
    if found is None or not len(texts):
        return np.zeros(len(texts) + 1, np.int64)
    return np.frombuffer(found, np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)


def plain(texts: pa.Array) -> pa.Array:
    """Texts as 32-bit strings, nulls as empty."""
    texts = texts if pa.types.is_string(texts.type) else texts.cast(pa.string())
    return texts.fill_null("") if texts.null_count else texts


def nested(run: Callable[[pa.Array], pa.Array], lists: pa.Array) -> pa.Array:
    """What `run` makes of the elements of lists, in lists of the same lengths; null for null."""
    counts = np.asarray(lists.value_lengths().fill_null(0), np.int64)
    return pa.ListArray.from_arrays(_nulled(_ends(counts), lists), run(lists.flatten()))


def starts(parts: pa.Array) -> pa.Array:
    """Lists of strings as lists of the places, in signs, where each begins in all of its list."""
    counts = np.asarray(parts.value_lengths().fill_null(0), np.int64)
    first = _ends(counts)
    upto = _ends(np.asarray(pc.fill_null(pc.utf8_length(parts.flatten()), 0), np.int64))
    return pa.ListArray.from_arrays(_nulled(first, parts), _ints(upto[:-1] - np.repeat(upto[first[:-1]], counts)))


def pieces(*texts: pa.Array) -> Iterator[tuple[int, int]]:
    """(first row, row after the last) of runs of rows whose texts hold at most PIECE bytes, or of one row."""
    held = sum((offsets(t) for t in texts[1:]), offsets(texts[0]))
    at, n = 0, len(texts[0])
    while at < n:
        end = max(at + 1, int(np.searchsorted(held, held[at] + PIECE, "right")) - 1)
        yield at, end
        at = end


class Signs:
    """Texts as code points: `cps`, `kind` of each, `at`, its place in `data`, and `rows`, the first of each text.
    `at` and `rows` have the end besides. Those made by `of` have no `data` and no `at`."""

    def __init__(self, texts: pa.Array) -> None:
        off = offsets(texts)
        buffer = texts.buffers()[2]
        self.data = np.frombuffer(buffer, np.uint8)[off[0] : off[-1]] if buffer is not None and off[-1] > off[0] else np.zeros(0, np.uint8)
        self.cps = np.frombuffer(self.data.tobytes().decode().encode("utf-32-le"), np.uint32)
        self.at = np.append(np.flatnonzero((self.data & 0xC0) != 0x80), len(self.data))
        self._set(self.cps, np.searchsorted(self.at, off - off[0]))

    def _set(self, cps: np.ndarray, rows: np.ndarray) -> None:
        self.cps, self.rows, self.n = cps, rows, len(cps)
        self.kind = _KIND[np.minimum(cps, SIZE - 1)]

    @classmethod
    def of(cls, cps: np.ndarray, rows: np.ndarray) -> Signs:
        """Texts that are code points already, so that what is made in steps is written as strings only at its end."""
        own = cls.__new__(cls)
        own._set(cps, rows)
        return own

    def written(self) -> pa.Array:
        return _written(self.cps, self.rows)

    def has(self, bit: int) -> np.ndarray:
        return (self.kind & bit) != 0

    def runs(self, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places, rows): where signs inside and outside take turns, with the end, and the text of each run."""
        turn = np.ones(self.n, bool)
        np.not_equal(inside[1:], inside[:-1], out=turn[1:])
        turn[self.rows[self.rows < self.n]] = True
        starts = np.flatnonzero(turn)
        return np.append(starts, self.n), np.repeat(np.arange(len(self.rows) - 1), np.diff(np.searchsorted(starts, self.rows)))

    def stressed(self) -> np.ndarray:
        """Vowels after a plus or before a combining mark of the same text."""
        first = np.zeros(self.n + 1, bool)
        first[self.rows] = True
        plus, mark = self.has(PLUS_BIT), self.has(COMBINING_BIT)
        out = np.zeros(self.n, bool)
        out[1:] = plus[:-1] & ~first[1 : self.n]
        out[:-1] |= mark[1:] & ~first[1 : self.n]
        return out & self.has(VOWEL_BIT)

    def without_marks(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(bytes, place of each sign in them, signs kept before each one), both with the end."""
        kept = ~self.has(MARK_BIT)
        lens = np.diff(self.at)
        return self.data[np.repeat(kept, lens)], _ends(lens * kept), _ends(kept)


def read(s: Signs) -> Signs:
    """Latin texts read as Cyrillic, sign by sign."""
    return Signs.of(np.where(s.cps < 256, _READ[np.minimum(s.cps, 255)], s.cps), s.rows)


def cyrillic(texts: pa.Array) -> pa.Array:
    """`read` of strings."""
    return _each(texts, lambda s: read(s).written())


def _line_places(s: Signs) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of texts' lines that aren't blank, without the white space around them, the first signs and those after the last,
    and how many a text has."""
    kind = _BLANK[np.minimum(s.cps, len(_BLANK) - 1)]
    part = np.zeros(s.n + 1, np.int32)  # which line of which text
    part[s.rows] = 1
    part[:-1] += kind == 3
    signs = np.flatnonzero(kind == 0)
    own_part = np.cumsum(part)[signs]
    turn = np.flatnonzero(np.diff(own_part, prepend=-1))
    first, last = signs[turn], signs[np.append(turn[1:], len(signs))[: len(turn)] - 1] + 1
    return first, last, np.bincount(np.searchsorted(s.rows, first, "right") - 1, minlength=len(s.rows) - 1)


def _within(first: np.ndarray, last: np.ndarray, n: int) -> np.ndarray:
    """Which of n places are in one of the ranges, none of which meet."""
    inside = np.zeros(n + 1, np.int8)
    inside[first] += 1
    inside[last] -= 1
    return np.cumsum(inside, dtype=np.int8)[:-1] > 0


def cut(s: Signs) -> tuple[Signs, np.ndarray]:
    """Texts' lines as `line_lists` has them, and how many a text has."""
    first, last, counts = _line_places(s)
    return Signs.of(s.cps[_within(first, last, s.n)], _ends(last - first)), counts


def line_lists(texts: pa.Array) -> pa.Array:
    """Lists of texts' lines that aren't blank, without the white space around them; of nulls, null."""
    own, out = plain(texts), []
    for a, b in pieces(own):
        s = Signs(own.slice(a, b - a))
        first, last, per_row = _line_places(s)
        begin, end = s.at[first], s.at[last]
        rows = _strings(s.data[_within(begin, end, len(s.data))], _ends(end - begin))
        out.append(pa.ListArray.from_arrays(_nulled(_ends(per_row), texts.slice(a, b - a)), rows))
    return _together(out, pa.list_(pa.string()))


def unmarked(texts: pa.Array) -> pa.Array:
    """`marks.remove_marks` of texts."""

    def run(s: Signs) -> pa.Array:
        data, at, _ = s.without_marks()
        return _strings(data, at[s.rows])

    return _each(texts, run)


def stress_places(texts: pa.Array) -> pa.Array:
    """Lists of `marks.stress_positions`; of nulls, null."""
    own, out = plain(texts), []
    for a, b in pieces(own):
        s = Signs(own.slice(a, b - a))
        found, kept = np.flatnonzero(s.stressed()), _ends(~s.has(MARK_BIT))
        upto = np.searchsorted(found, s.rows)
        places = kept[found] - np.repeat(kept[s.rows[:-1]], np.diff(upto))
        out.append(pa.ListArray.from_arrays(_nulled(upto, texts.slice(a, b - a)), _ints(places)))
    return _together(out, pa.list_(pa.int32()))


def with_acutes(s: Signs) -> Signs:
    """Texts with an acute after each stressed vowel and no other mark."""
    clean = ~s.has(MARK_BIT)
    kept = _ends(clean)
    put = kept[np.flatnonzero(s.stressed()) + 1]  # a stressed vowel is kept, so this is the place after it
    rows = kept[s.rows]
    return Signs.of(np.insert(s.cps[clean], put, ord(ACUTE)), rows + np.searchsorted(put, rows, "right"))


def acutes(texts: pa.Array) -> pa.Array:
    """`with_acutes` of strings."""
    return _each(texts, lambda s: with_acutes(s).written())


def with_pluses(s: Signs) -> Signs:
    """Texts with combining marks, and pluses that stand after their vowel, as a plus before the vowel. A combining mark
    belongs to the sign before it, whatever that is, unless that is itself one's mark."""
    mark = np.flatnonzero(s.has(COMBINING_BIT))
    begins = s.rows[np.minimum(np.searchsorted(s.rows, mark), len(s.rows) - 1)] == mark  # at a text's start there is no sign to belong to
    turn = np.flatnonzero(np.append(True, np.diff(mark) != 1)[: len(mark)] | begins)
    lens = np.diff(np.append(turn, len(mark)))
    nth, alone = np.arange(len(mark)) - np.repeat(turn, lens), np.repeat(begins[turn], lens)
    after = mark[~begins] - 1
    marked = after[s.has(VOWEL_BIT)[after]]
    cps = s.cps.copy()
    cps[marked], cps[marked + 1] = ord(PLUS), s.cps[marked]  # the vowel takes its mark's place
    gone = np.setdiff1d(mark[(nth % 2 == 1) == alone], marked + 1, assume_unique=True)
    cps, rows = np.delete(cps, gone), s.rows - np.searchsorted(gone, s.rows)
    if not s.has(PLUS_BIT).any():
        return Signs.of(cps, rows)
    vowel = (_KIND[np.minimum(cps, SIZE - 1)] & VOWEL_BIT) != 0
    first = np.zeros(len(cps) + 1, bool)
    first[rows] = True
    after = np.append(vowel, False)[1:] & ~first[1:]
    late = np.flatnonzero((cps == ord(PLUS)) & np.append(False, vowel)[:-1] & ~first[:-1] & ~after)
    cps[late], cps[late - 1] = cps[late - 1], ord(PLUS)
    return Signs.of(cps, rows)


def pluses(texts: pa.Array) -> pa.Array:
    """`with_pluses` of strings."""
    return _each(texts, lambda s: with_pluses(s).written())


def round_trip(s: Signs) -> tuple[pa.Array, pa.Array, pa.Array]:
    """Marked texts with acutes: of these the form with pluses, the text without marks and the number of stresses, as
    `pluses`, `unmarked` and the lengths of `stress_places` have them."""
    a = with_acutes(s)
    marked = a.has(MARK_BIT)
    clean = _written(a.cps[~marked], a.rows - np.searchsorted(np.flatnonzero(marked), a.rows))
    return with_pluses(a).written(), clean, _ints(np.diff(np.searchsorted(np.flatnonzero(a.stressed()), a.rows)))


def _first_of(found: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """The first of the ascending places within each run, or -1."""
    held = np.append(found, np.iinfo(np.int64).max)
    own = held[np.searchsorted(found, bounds[:-1])]
    return np.where(own < bounds[1:], own, -1)


class Words:
    """A marked text's words, as `extract.word_array` has them: runs of signs and marks that aren't marks alone."""

    def __init__(self, signs: Signs) -> None:
        s, word = signs, signs.has(WORD_BIT)
        bounds, row = s.runs(word | s.has(MARK_BIT))
        letters = _ends(word)
        is_word = letters[bounds[1:]] > letters[bounds[:-1]]
        first, last = bounds[:-1][is_word], bounds[1:][is_word]
        self.signs, self.row = s, row[is_word]
        stressed = np.flatnonzero(s.stressed())
        place = _first_of(stressed, bounds)[is_word]
        self.stress = np.where(place >= 0, letters[np.maximum(place, 0)] - letters[first], -1)  # every sign of a word but its marks is a letter
        self.at = np.append(letters[first], letters[-1]) if len(first) else np.zeros(1, np.int64)  # words follow each other among the letters
        self.letters = word
        count = lambda bit: (lambda c: c[last] - c[first])(_ends(s.has(bit)))
        self.counts = count
        self.per_row = np.bincount(self.row, minlength=len(s.rows) - 1)
        self.first = _ends(self.per_row)

    def texts(self) -> pa.Array:
        s = self.signs
        lens = np.diff(s.at)
        return _strings(s.data[np.repeat(self.letters, lens)], _ends(lens[self.letters])[self.at])

    def folded(self) -> pa.Array:
        """The words folded, two bytes a sign."""
        held = _FOLD[self.signs.cps[self.letters]]
        return pa.BinaryArray.from_buffers(pa.binary(), len(self.at) - 1, [None, pa.py_buffer((2 * self.at).astype(np.int32)), pa.py_buffer(held)])

    def scored(self) -> np.ndarray:
        """`marks.is_scored`: two vowels or more, a stress, no hyphen and no yo."""
        return (self.stress >= 0) & (self.counts(VOWEL_BIT) >= 2) & (self.counts(HYPHEN_BIT) == 0) & (self.counts(YO_BIT) == 0)


def _ints(x: np.ndarray, none: np.ndarray | None = None) -> pa.Array:
    return pa.array(np.asarray(x, np.int32), mask=none)


def word_lists(texts: pa.Array) -> pa.Array:
    """WORDS of marked texts; of nulls, null."""
    own, out = plain(texts), []
    for a, b in pieces(own):
        w = Words(Signs(own.slice(a, b - a)))
        rows = pa.StructArray.from_arrays([w.texts(), _ints(w.stress, w.stress < 0)], ["text", "stress"])
        out.append(pa.ListArray.from_arrays(_nulled(w.first, texts.slice(a, b - a)), rows))
    return _together(out, pa.list_(pa.struct([("text", pa.string()), ("stress", pa.int32())])))


def _nulled(first: np.ndarray, texts: pa.Array) -> pa.Array:
    """Offsets of lists, null where the text is."""
    none = np.append(np.asarray(texts.is_null()), False)
    return pa.array(first.astype(np.int32), mask=none if none.any() else None)


def _together(parts: list[pa.Array], kind: pa.DataType) -> pa.Array:
    return pa.concat_arrays(parts) if parts else pa.array([], kind)


def span_fields(marked: bool, words_only: bool, folded: bool = False) -> dict[str, pa.DataType]:
    """What `span_lists` has of each span."""
    stress = {"stress_char_index": pa.int32(), "stress_vowel_index": pa.int32()} if marked else {}
    if words_only:
        return {"text": pa.string(), "start": pa.int32(), "end": pa.int32(), **stress, "word_no": pa.int32(), **({"folded": pa.string()} if folded else {})}
    raw = {"raw": pa.string()} if marked else {}
    return {"span_no": pa.int32(), **raw, "text": pa.string(), "start": pa.int32(), "end": pa.int32(), "is_word": pa.bool_(), **stress}


def span_lists(texts: pa.Array, marked: bool, words_only: bool, folded: bool = False) -> pa.Array:
    """Lists of texts' spans: words and what stands between them, numbered and placed by the text without marks; with
    `words_only`, words alone, numbered by themselves, and with `folded` as `marks.fold` has them besides. Of nulls, null."""
    own, out, fields = plain(texts), [], span_fields(marked, words_only, folded)
    for a, b in pieces(own):
        s = Signs(own.slice(a, b - a))
        word = s.has(WORD_BIT)
        bounds, row = s.runs(word | s.has(MARK_BIT) if marked else word)
        letters = _ends(word)
        found = {"is_word": letters[bounds[1:]] > letters[bounds[:-1]]}
        texts_ = {"raw": _strings(s.data, s.at[bounds])}
        data, at, kept = s.without_marks() if marked else (s.data, s.at, np.arange(s.n + 1))
        texts_["text"] = _strings(data, at[bounds]) if marked else texts_["raw"]
        base = kept[s.rows[:-1]][row]
        found |= {"start": kept[bounds[:-1]] - base, "end": kept[bounds[1:]] - base}
        if marked:
            place, vowels = _first_of(np.flatnonzero(s.stressed()), bounds), _ends(s.has(VOWEL_BIT))
            p = np.maximum(place, 0)
            found |= {"none": place < 0, "stress_char_index": kept[p] - kept[bounds[:-1]], "stress_vowel_index": vowels[p] - vowels[bounds[:-1]]}
        if words_only:
            pick = np.flatnonzero(found["is_word"])
            row, found = row[pick], {k: x[pick] for k, x in found.items()}
            texts_ = {"text": texts_["text"].take(pa.array(pick))}
            if folded:
                low = Signs(texts_["text"])
                texts_["folded"] = _written(_FOLD[low.cps].astype(np.uint32), low.rows)  # words hold letters and hyphens alone
        first = _ends(np.bincount(row, minlength=b - a))
        found["word_no" if words_only else "span_no"] = np.arange(len(row)) - first[row]
        column = lambda c: texts_[c] if c in texts_ else pa.array(found[c]) if c == "is_word" else _ints(found[c], found["none"] if c.startswith("stress") else None)  # noqa: E731, B023
        rows = pa.StructArray.from_arrays([column(c) for c in fields], list(fields))
        out.append(pa.ListArray.from_arrays(_nulled(first, texts.slice(a, b - a)), rows))
    return _together(out, pa.list_(pa.struct(list(fields.items()))))


def distinct_words(texts: pa.Array, folded: bool = False, parts: bool = False, reading: Callable[[Signs], Signs] | None = None) -> pa.Array:
    """The different words of all the texts, or with `parts` the parts of words at hyphens; with `folded` as
    `marks.fold` has them. `reading` is done to the texts before."""
    own, found = plain(texts), [pa.array([], pa.binary())]
    for a, b in pieces(own):
        s = Signs(own.slice(a, b - a))
        s = reading(s) if reading else s
        word = s.has(WORD_BIT) & ~s.has(HYPHEN_BIT) if parts else s.has(WORD_BIT)
        bounds, _ = s.runs(word)
        at = 2 * _ends(np.diff(bounds)[word[bounds[:-1]]])
        letters = s.cps[word]
        held = _FOLD[letters] if folded else letters.astype(np.uint16)  # two bytes a sign are enough for words
        found.append(pc.unique(pa.BinaryArray.from_buffers(pa.binary(), len(at) - 1, [None, pa.py_buffer(at.astype(np.int32)), pa.py_buffer(held)])))
    words = pc.unique(pa.concat_arrays(found))
    at = offsets(words)
    return _written(np.frombuffer(words.buffers()[2] or b"", np.uint16)[at[0] // 2 : at[-1] // 2].astype(np.uint32), (at - at[0]) // 2)


def rules(texts: pa.Array) -> pa.Array:
    """RULES of words, all that the rules ask of their signs: how many vowels, the places of yo as `marks.yo_position` has
    it and of the first vowel, null if none, and whether it is a Russian word; nulls of a null."""
    own, out, names = plain(texts), [], ["vowels", "yo", "first", "russian"]
    for a, b in pieces(own):
        s = Signs(own.slice(a, b - a))
        counts = lambda mask: (lambda c: c[s.rows[1:]] - c[s.rows[:-1]])(_ends(mask))  # noqa: E731, B023
        place = lambda mask: (lambda p: np.where(p < 0, -1, p - s.rows[:-1]))(_first_of(np.flatnonzero(mask), s.rows))  # noqa: E731, B023
        small = place(s.cps == ord("ё"))
        yo = np.where(small >= 0, small, place(s.cps == ord("Ё")))
        first, lens = place(s.has(VOWEL_BIT)), np.diff(s.rows)
        none = np.asarray(texts.slice(a, b - a).is_null())
        fields = [_ints(counts(s.has(VOWEL_BIT)), none), _ints(yo, none), _ints(first, none | (first < 0)), pa.array((counts(s.has(WORD_BIT)) == lens) & (lens > 0), mask=none)]
        out.append(pa.StructArray.from_arrays(fields, names))
    return _together(out, pa.struct(list(zip(names, [pa.int32()] * 3 + [pa.bool_()], strict=True))))


def _run(a: np.ndarray, b: np.ndarray, a_at: np.ndarray, b_at: np.ndarray, step: int, limit: np.ndarray) -> np.ndarray:
    """How many elements from the places on, forwards or backwards, are equal, at most `limit`, a row each."""
    ends = _ends(limit)
    k = step * (np.arange(ends[-1]) - np.repeat(ends[:-1], limit))
    miss = np.flatnonzero(a[np.repeat(a_at, limit) + k] != b[np.repeat(b_at, limit) + k])
    found = _first_of(miss, ends)
    return np.where(found >= 0, found - ends[:-1], limit)


def compare(gold: pa.Array, lib: pa.Array, failed: pa.Array) -> pa.Array:
    """COMPARED of marked texts side by side: numbers of words, the lengths of their equal ends as `align.align` has
    them, and of the words that meet how many, how many count, and those of these that the annotator stressed."""
    gold, lib, failed = plain(gold), plain(lib), np.asarray(failed.fill_null(False))
    names = ["gold_count", "lib_count", "prefix", "suffix", "matched", "scored", "checked"]
    check = pa.struct([("g", pa.int32()), ("wrong", pa.bool_())])
    out = []
    for a, b in pieces(gold, lib):
        g, l = Words(Signs(gold.slice(a, b - a))), Words(Signs(lib.slice(a, b - a)))  # noqa: E741
        ids = np.asarray(pa.concat_arrays([g.folded(), l.folded()]).dictionary_encode().indices)
        gid, lid = ids[: len(g.row)], ids[len(g.row) :]
        gc, lc = g.per_row, l.per_row
        n = np.where(failed[a:b], 0, np.minimum(gc, lc))
        prefix = _run(gid, lid, g.first[:-1], l.first[:-1], 1, n)
        suffix = _run(gid, lid, g.first[1:] - 1, l.first[1:] - 1, -1, n - prefix)
        met = prefix + suffix
        ends = _ends(met)
        row = np.repeat(np.arange(b - a), met)
        t = np.arange(ends[-1]) - ends[:-1][row]
        head = t < prefix[row]
        gi, li = np.where(head, t, gc[row] - met[row] + t), np.where(head, t, lc[row] - met[row] + t)
        gw, lw = g.first[:-1][row] + gi, l.first[:-1][row] + li
        counts = g.scored()[gw]
        checked = counts & (l.stress[lw] >= 0)
        checks = pa.StructArray.from_arrays([_ints(gi[checked]), pa.array((g.stress[gw] != l.stress[lw])[checked])], fields=list(check))
        lists = pa.ListArray.from_arrays(_ints(_ends(np.bincount(row[checked], minlength=b - a))), checks)
        numbers = [_ints(x) for x in (gc, lc, prefix, suffix, met, np.bincount(row[counts], minlength=b - a))]
        out.append(pa.StructArray.from_arrays([*numbers, lists], names))
    return _together(out, pa.struct([*((c, pa.int32()) for c in names[:-1]), ("checked", pa.list_(check))]))


class Written:
    """Unmarked texts' words with two vowels or more, for writing a plus into some of them: `n` vowels, `length`,
    `span` number and `row` of each."""

    def __init__(self, texts: pa.Array | Signs) -> None:
        s = self.signs = texts if isinstance(texts, Signs) else Signs(texts)
        word, vowel = s.has(WORD_BIT), s.has(VOWEL_BIT)
        bounds, row = s.runs(word)
        before = _ends(vowel)
        n = before[bounds[1:]] - before[bounds[:-1]]
        pick = n >= 2
        self.n, self.row, self.length = n[pick], row[pick], np.diff(bounds)[pick]
        self.span = (np.arange(len(row)) - np.searchsorted(bounds[:-1], s.rows[:-1])[row])[pick]
        self.base, self.vowels = before[bounds[:-1]][pick], np.flatnonzero(vowel)

    def at(self, k: np.ndarray, use: np.ndarray | None = None) -> pa.Array:
        """The texts with a plus before the k-th vowel, from 0, of each word that is used."""
        s, where = self.signs, self.base + k
        put = s.at[self.vowels[where if use is None else where[use]]]
        rows = s.at[s.rows]
        return _strings(np.insert(s.data, put, ord(PLUS)), rows + np.searchsorted(put, rows))

    def signs_at(self, k: np.ndarray) -> Signs:
        """`at` of all these words, as signs."""
        s, put = self.signs, self.vowels[self.base + k]
        return Signs.of(np.insert(s.cps, put, ord(PLUS)), s.rows + np.searchsorted(put, s.rows))
