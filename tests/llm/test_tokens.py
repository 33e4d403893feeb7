import random
import zlib

import numpy as np
import pytest

from akzentor.llm import bpe, packing, tokencount

FRAGMENTS = ["a", "aaaa", "the", " ", "  ", "\n", "\n\n", "'s", "'re", "'r", "'", "<|endoftext|>", "<|endof", "1", "234", "é", "ß", "日本", "😀", "!!", "\t", " ", "՘", "౜", "x" * 50, "ab" * 40, " " * 30, "Ġ"]


def some_text(rng, n):
    return "".join(rng.choice(FRAGMENTS) for _ in range(rng.randint(0, n)))


@pytest.mark.parametrize("seed", range(6))
def test_streams_give_the_librarys_ids_in_any_cuts(tokenizer_path, library, seed, monkeypatch):
    monkeypatch.setattr(bpe, "CHUNK", 64)
    codec, rng = bpe.codec(tokenizer_path), random.Random(seed)
    for _ in range(80):
        text = some_text(rng, 120)
        want = library.encode(text, add_special_tokens=False).ids
        stream, got, at = bpe.Encoder(codec), b"", 0
        while at < len(text):
            n = rng.randint(1, 100)
            got += stream.feed(text[at : at + n])
            at += n
        got = np.frombuffer(got + stream.finish(), "<u4").tolist()
        assert got == want
        assert np.frombuffer(codec.encode(text), "<u4").tolist() == want
        assert np.frombuffer(bpe.fast_codec(tokenizer_path).encode(text), "<u4").tolist() == want
        assert codec.decode(got) == library.decode(want, skip_special_tokens=False) == text


def test_memory_of_a_stream_is_bounded(tokenizer_path, library):
    codec = bpe.codec(tokenizer_path)
    for unit in ("a", "ThE", " "):
        stream, got, most = bpe.Encoder(codec), b"", 0
        for _ in range(20):
            got += stream.feed(unit * 20_000)
            most = max(most, len(stream.held) + len(stream.stage.held if stream.stage else b""))
        got += stream.finish()
        assert np.frombuffer(got, "<u4").tolist() == library.encode(unit * 400_000, add_special_tokens=False).ids
        assert most <= 4 * bpe.CHUNK


def test_lookahead_is_that_of_the_costliest_chain():
    assert bpe.sufficient_lookahead([]) == 0
    assert bpe.sufficient_lookahead([(b"a", b"b")]) == 1
    # b+c first, then a+bc: text after b can reach back over b and a.
    assert bpe.sufficient_lookahead([(b"b", b"c"), (b"a", b"b")]) == 2
    assert bpe.sufficient_lookahead([(b"a", b"b"), (b"b", b"c")]) == 1


def test_broken_utf8_and_cut_characters(tokenizer_path, library):
    codec = bpe.codec(tokenizer_path)
    ids = library.encode("日本😀é", add_special_tokens=False).ids
    for n in range(len(ids) + 1):
        assert codec.decode(ids[:n]) == library.decode(ids[:n], skip_special_tokens=False)
    stream = bpe.Decoder(codec)
    assert "".join(stream.feed([i]) for i in ids) + stream.finish() == "日本😀é"
    assert codec.decode([]) == "" and codec.decode([10**7]) == ""


def test_round_trip(docs, no_docs, tokenizer_path, library):
    rows = bpe.round_trip(docs, tokenizer_path).collect()
    assert bpe.round_trip(docs, tokenizer_path).columns == ["doc_id", "ids", "decoded"]
    want = sorted((r["doc_id"] or -1, library.encode(r["text"] or "", add_special_tokens=False).ids, r["text"] or "") for r in docs.collect())
    assert sorted((r["doc_id"] or -1, list(r["ids"]), r["decoded"]) for r in rows) == want
    assert bpe.round_trip(no_docs, tokenizer_path).collect() == []


def test_counts(docs, no_docs, tokenizer_path, library):
    rows = tokencount.count_tokens(docs, tokenizer_path).collect()
    want = sorted((r["doc_id"] or -1, len((r["text"] or "").encode()), len(library.encode(r["text"] or "", add_special_tokens=False).ids)) for r in docs.collect())
    assert sorted((r["doc_id"] or -1, r["n_bytes"], r["n_tokens"]) for r in rows) == want
    assert tokencount.count_tokens(no_docs, tokenizer_path).collect() == []


def test_counts_with_sentencepiece(docs):
    import public_tokenizers
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    rows = tokencount.count_tokens(docs.filter("doc_id in (1, 2, 3, 6)"), path).collect()
    text = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    assert all(r["n_tokens"] == len(model.encode(text[r["doc_id"]])) for r in rows) and len(rows) == 5


def test_parts_are_safe(library):
    rng = random.Random(3)
    for _ in range(200):
        text = some_text(rng, 200)
        parts = bpe.safe_parts(text, 20)
        assert "".join(parts) == text
        assert sum(len(library.encode(p, add_special_tokens=False).ids) for p in parts) == len(library.encode(text, add_special_tokens=False).ids)


def test_batches_are_balanced_by_bytes():
    groups = list(tokencount.batches_of(((i, "é" * n) for i, n in enumerate([3, 3, 10, 1])), 12))
    assert [[i for i, _ in g] for g in groups] == [[0, 1], [2], [3]]


def test_packing(docs, no_docs, tokenizer_path, library):
    rows = packing.pack(packing.pieces(docs, tokenizer_path, 512), 512).collect()
    check_packing(rows, [(r["doc_id"], library.encode(r["text"] or "", add_special_tokens=False).ids + [0]) for r in docs.collect()], 512)
    assert packing.pack(packing.pieces(no_docs, tokenizer_path)).collect() == []


def check_packing(rows, want, capacity):
    """Every piece of every document once, and sequences without gaps."""
    own = []
    for k, ids in want:
        first = len(ids) if len(ids) <= capacity else len(ids) % capacity or capacity
        cuts = [0, *range(first, len(ids), capacity), len(ids)]
        own += [(k or -1, p, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())) for p, (a, b) in enumerate(zip(cuts, cuts[1:]))]
    assert sorted((r["doc_id"] or -1, r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == sorted(own)
    at = {}
    for r in sorted(rows, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == at.get(r["sequence_id"], 0)
        at[r["sequence_id"]] = r["offset"] + r["length"]
    assert max(at.values()) <= capacity


def test_best_fit_against_a_plain_version():
    rng = random.Random(1)
    fit, free = packing.BestFit(100, 10_000), {}
    for _ in range(3000):
        n = rng.randint(1, 100)
        fits = [f for f in free.values() if f >= n]
        own, offset = fit.place(n)
        assert free.get(own, 100) == (min(fits) if fits else 100) and offset == 100 - free.get(own, 100)
        free[own] = free.get(own, 100) - n


def test_open_bins_are_bounded_and_the_fullest_closes():
    fit = packing.BestFit(100, 2)
    a, b, c = fit.place(60), fit.place(70), fit.place(80)
    assert len({a[0], b[0], c[0]}) == 3 and fit.count == 2
    assert fit.place(20)[0] == b[0]  # the one with 80 closed at once
    with pytest.raises(ValueError):
        fit.place(101)
