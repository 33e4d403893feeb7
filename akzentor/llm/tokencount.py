"""Token counts: batch encoding in Arrow functions that return lengths only."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from akzentor.llm.bpe import safe_parts
from akzentor.llm.common import slices

#: Bytes of text in one call of the library, and characters beyond which a text is split.
BATCH_BYTES, PART_CHARS = 1 << 18, 1 << 15


@lru_cache(maxsize=4)
def _counter(path: str) -> tuple[Callable[[list[str]], list[int]], bool]:
    """The batch counter for a vocabulary file, and whether texts may be split for it."""
    if path.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        return (lambda texts: [len(x) for x in model.encode(texts, num_threads=1)]), False
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's task slots are the parallelism
    import json

    from tokenizers import Tokenizer

    library = Tokenizer.from_file(path)
    library.no_padding()
    library.no_truncation()
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    pre = spec.get("pre_tokenizer") or {}
    # Cutting before a lone space changes nothing if words are split there anyway and no added token holds or swallows one.
    split = pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and not spec.get("normalizer") and not any(" " in t["content"] or t["lstrip"] or t["rstrip"] for t in spec.get("added_tokens", []))
    return (lambda texts: [len(x.ids) for x in library.encode_batch_fast(texts, add_special_tokens=False)]), split


def batches_of(parts: Iterator[tuple[int, str]], size: int = BATCH_BYTES) -> Iterator[list[tuple[int, str]]]:
    """Group (row, part) into lists of about `size` bytes; a larger part stands alone."""
    held, total = [], 0
    for row, part in parts:
        n = len(part) if part.isascii() else len(part.encode())
        if held and total + n > size:
            yield held
            held, total = [], 0
        held.append((row, part))
        total += n
    if held:
        yield held


def count_tokens(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_bytes, n_tokens) of every whole text, as the library for the file counts them.

    Null texts count as empty: 0 bytes and the library's count for "". An empty table gives none.
    Repeated rows give a row each; other columns aren't read, so none can clash. A pass without a shuffle.
    """
    source = docs.select(F.col(key).alias("k"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    schema = T.StructType([T.StructField("k", docs.schema[key].dataType), T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, split = _counter(tokenizer)
        for batch in slices(batches):
            texts = batch.column(1).to_pylist()
            total = [0] * len(texts)
            cut = ((i, p) for i, t in enumerate(texts) for p in (safe_parts(t, PART_CHARS) if split else [t]))
            for group in batches_of(cut):
                for (i, _), n in zip(group, count([p for _, p in group]), strict=True):
                    total[i] += n
            size = pc.binary_length(batch.column(1)).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), size, pa.array(total, pa.int64())], names=["k", "n_bytes", "n_tokens"])

    return source.mapInArrow(run, schema).withColumnRenamed("k", key)
