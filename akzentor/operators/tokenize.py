"""Lines, sentences, words and spans, with code-point offsets.

Everything that belongs to a document is dealt out once, by document; a sentence's spans and their offsets
are found within its row, as are a document's sentences.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from akzentor.functions import scan

#: Where a text is cut into lines, and what is white space to it.
BREAKS = "\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029]"
SPACE = "[\\s\x1c-\x1f\x85\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"


def strip(text: Column) -> Column:
    return F.regexp_replace(text, f"^{SPACE}+|{SPACE}+$", "")


def by_document(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """Deal documents out by key, once; offsets and sentences of a document then stay together."""
    return docs.repartition(F.col(key))


def line_array(text: Column | str = "text") -> Column:
    """A text's `lines`, in the row."""
    return F.arrow_udf(scan.line_lists, "array<string>")(F.col(text) if isinstance(text, str) else text)


def lines(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, line_no, text): a row for each line that isn't blank, stripped, numbered from 0.

    Lines are cut, cleaned and numbered within the row, so nothing is exchanged. Null texts have
    no lines. The array has no name of its own: of a named one Spark would ask before the documents are dealt out
    whether it is empty, and so cut all lines twice, the first time in as few tasks as the table has row groups.
    """
    return docs.select(key, F.posexplode(line_array(text)).alias("line_no", "text"))


def split_sentences(docs: DataFrame, key: str = "doc_id", text: str = "text", carried: Sequence[str] = ()) -> DataFrame:
    """(key, sent_no, start, text): sentences end after full stops and their like with the white
    space that follows, or at blank lines. Blank ones count in offsets but not in numbers. A document's
    sentences are placed within its row; columns `carried` go along with each."""
    parts = F.regexp_extract_all(F.col(text), F.lit(r"(?sU)(.*?(?:[.!?…]+\s*|\n{2,})|.+$)"), F.lit(1))
    cut = docs.select(key, *carried, parts.alias("_parts")).withColumn("_at", F.arrow_udf(scan.starts, "array<int>")("_parts"))
    placed = F.filter(F.transform("_parts", lambda p, i: F.struct(F.get("_at", i).alias("start"), p.alias("text"))), lambda x: strip(x["text"]) != "")
    return cut.select(key, *carried, F.posexplode(placed).alias("sent_no", "_s")).select(key, "sent_no", "_s.start", "_s.text", *carried)


def _listed(marked: bool, words_only: bool, folded: bool = False) -> Callable[[Column], Column]:
    def run(texts: pa.Array) -> pa.Array:
        return scan.span_lists(texts, marked, words_only, folded)

    return F.arrow_udf(run, _span_type(marked, words_only, folded))


def _span_type(marked: bool, words_only: bool, folded: bool = False) -> str:
    kinds = {pa.string(): "string", pa.int32(): "int", pa.bool_(): "boolean"}
    return "array<struct<" + ",".join(f"{k}:{kinds[t]}" for k, t in scan.span_fields(marked, words_only, folded).items()) + ">>"


def spans(sentences: DataFrame, keys: list[str], text: str = "text", marked: bool = False) -> DataFrame:
    """(keys, span_no, text, start, end, is_word): words and what stands between them, lossless.

    With `marked`, stress marks are signs of a word; text and offsets are those without marks, `raw`
    is the span as written, and stress_char_index and stress_vowel_index are its first stress. A sentence's
    spans are found, numbered and placed within its row: nothing is exchanged or sorted.
    """
    return sentences.select(*keys, F.explode(_listed(marked, False)(F.col(text))).alias("_s")).select(*keys, "_s.*")


def span_arrays(texts: Column | str, marked: bool = False) -> Column:
    """The `spans` of each of a row's sentences, an array of texts, in the row."""

    def run(lists: pa.Array) -> pa.Array:
        return scan.nested(lambda t: scan.span_lists(t, marked, False), lists)

    return F.arrow_udf(run, f"array<{_span_type(marked, False)}>")(F.col(texts) if isinstance(texts, str) else texts)


def words(sentences: DataFrame, keys: list[str], text: str = "text", marked: bool = False, folded: bool = False) -> DataFrame:
    """The words of `spans`, numbered from 0 in word_no; without `raw`. With `folded`, a column of that name has
    `marks.fold` of the text."""
    return sentences.select(*keys, F.explode(_listed(marked, True, folded)(F.col(text))).alias("_s")).select(*keys, "_s.*")


def distinct_words(docs: DataFrame, text: str = "text", folded: bool = False, parts: bool = False, reading: Callable[[scan.Signs], scan.Signs] | None = None) -> DataFrame:
    """(word): the different words of all texts, or with `parts` the parts of words at hyphens; with `folded` as
    `marks.fold` has them. They are made distinct in each batch of texts, so that no word is a row each time it is
    written. `reading` is done to the texts' signs before."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([scan.distinct_words(batch.column(0), folded, parts, reading)], ["word"])

    return docs.select(text).mapInArrow(run, "word string").distinct()


def part_array(text: str = "text") -> Column:
    """The parts of a word at hyphens, as an array of (part_no, part, part_start); empty ones count a sign."""
    parts = F.split(F.col(text), "-")
    start = lambda i: F.length(F.array_join(F.slice(parts, 1, i), "-")) + F.when(i > 0, 1).otherwise(0)
    rows = F.transform(parts, lambda p, i: F.struct(i.alias("part_no"), p.alias("part"), start(i).alias("part_start")))
    return F.filter(rows, lambda r: r["part"] != "")


def hyphen_parts(word_rows: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """(keys, part_no, part, part_start): the parts of words at hyphens."""
    return word_rows.select(*keys, F.explode(part_array(text)).alias("p")).select(*keys, "p.part_no", "p.part", "p.part_start")


def within(regions: Column | str, start: Column, end: Column) -> Column:
    """True for a span inside any of the regions (array of structs with start and end)."""
    r = F.col(regions) if isinstance(regions, str) else regions
    return F.coalesce(F.exists(r, lambda t: (t["start"] <= start) & (end <= t["end"])), F.lit(False))
