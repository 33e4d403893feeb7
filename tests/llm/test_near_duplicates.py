import random
import re

import numpy as np
import pytest

from akzentor.llm import ann, minhash, vec_neardup
from akzentor.llm.components import connected_components


def union_find(nodes, links):
    up = {n: n for n in nodes}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        if a != b:
            up[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


@pytest.mark.parametrize("seed", range(3))
def test_components(spark, seed):
    rng = random.Random(seed)
    links = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(i, i + 1) for i in range(100, 130)] + [(200, x) for x in range(201, 230)]
    rows = connected_components(spark.createDataFrame([*links, (None, 1), (3, None)], "a long, b long")).collect()
    want = union_find({x for link in links for x in link}, links)
    linked = {x for a, b in links if a != b for x in (a, b)}
    assert {(r["node"], r["component"]) for r in rows} == {(n, want[n]) for n in linked} and len(rows) == len(linked)
    assert connected_components(spark.createDataFrame([], "a long, b long")).collect() == []


def shingle_set(text, k):
    w = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    return frozenset(zip(*[w[i:] for i in range(k)])) if len(w) >= k else frozenset([tuple(w)] if w else [])


def brute(rows, k, percent=80):
    sets = {}
    for i, t in rows:
        sets.setdefault(i, []).append(shingle_set(t, k))
    ids = sorted(sets)
    links = [(a, b) for n, a in enumerate(ids) for b in ids[:n] if any(x and y and 100 * len(x & y) >= percent * len(x | y) for x in sets[a] for y in sets[b])]
    return union_find(ids, links)


def near_copies(seed):
    rng = random.Random(seed)
    word = lambda: rng.choice("abcdefgh") + str(rng.randrange(400))
    rows, bases = [], [[word() for _ in range(n)] for n in (5, 12, 40, 80, 150)]
    for base in bases:
        for _ in range(30):
            w = list(base)
            for _ in range(rng.randrange(4)):
                w[rng.randrange(len(w))] = word()
            rows.append(" ".join(w))
    rows += [" ".join(word() for _ in range(rng.randrange(1, 60))) for _ in range(40)]
    rng.shuffle(rows)
    return [(i * 3 + 1, t) for i, t in enumerate(rows)]


@pytest.mark.parametrize(("seed", "words"), [(1, 4), (2, 5)])
def test_minhash_against_all_pairs(spark, seed, words):
    rows = near_copies(seed)
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), words=words).collect()
    want = brute(rows, words)
    assert {r["doc_id"]: r["component_id"] for r in got} == want
    text = dict(rows)
    assert all(r["n_shingles"] == len(shingle_set(text[r["doc_id"]], words)) and r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)


def test_minhash_blocks(spark, monkeypatch):
    """Keys that take several blocks give the same."""
    monkeypatch.setattr(minhash, "BLOCK", 4)
    monkeypatch.setattr(minhash, "COLUMNS", 16)
    rows = near_copies(5)
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), words=4).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == brute(rows, 4)


def test_estimate_is_unbiased_and_corrected(spark):
    from pyspark.sql import functions as F

    rng, make = np.random.default_rng(0), minhash.Sketcher()
    pool = rng.integers(0, 1 << 63, 3000, dtype=np.uint64)
    for share in (0.0, 0.5, 0.8, 1.0):
        n = int(1000 * (2 - share))  # |a| = |b| = n, common part so that Jaccard is `share`
        both = round(2 * n * share / (1 + share))
        a, b = np.unique(pool[:n]), np.unique(np.concatenate([pool[:both], rng.integers(0, 1 << 63, n - both, dtype=np.uint64)]))
        x, y = make.planes(make.minima(a)).tolist(), make.planes(make.minima(b)).tolist()
        got = spark.range(1).select(minhash.similarity([F.lit(v) for v in x], [F.lit(v) for v in y]).alias("s")).first()["s"]
        assert abs(got - share) < 0.2


def test_minhash_edge_rows(spark, docs, no_docs):
    rows = minhash.near_duplicates(docs, words=4).collect()
    assert len(rows) == docs.count()
    by = {r["doc_id"]: r for r in rows}
    assert by[2]["n_shingles"] == by[3]["n_shingles"] == by[4]["n_shingles"] == 0 and all(by[i]["kept"] and by[i]["component_id"] == i for i in range(1, 9))
    assert by[None]["component_id"] is None and by[None]["kept"] is None
    assert minhash.near_duplicates(no_docs).collect() == []


def vectors(seed, n=400, d=16):
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n, d))
    for i in range(n // 2, n):
        x[i] = x[rng.integers(0, n // 2)] + rng.choice([0.0, 0.05, 0.3, 0.38]) * rng.standard_normal(d)
    x[n - 60 :] = x[0] + 0.2 * rng.standard_normal((60, d))
    x[n - 20 :] = x[1]
    return x.astype(np.float32), rng.integers(0, 3, n)


EDGES = [(9001, None, 1), (9002, [0.0] * 16, 1), (9003, [None, *[1.0] * 15], 1), (9004, [float("nan")] * 16, 1), (9005, [float("inf")] * 16, 1), (9006, [], 1), (9007, [1.0, 2.0], 1), (9008, [2.0, 4.0], 1), (9009, [1.0] * 16, None), (9010, [1.0] * 16, None)]


@pytest.mark.parametrize("seed", [1, 2])
def test_embedding_links_against_all_pairs(spark, seed, monkeypatch):
    monkeypatch.setattr(vec_neardup, "BLOCK", 16)
    x, label = vectors(seed)
    rows = [(i + 1, v.tolist(), int(k)) for i, (v, k) in enumerate(zip(x, label))]
    got = {r["vec_id"]: r for r in vec_neardup.near_duplicates(spark.createDataFrame([(*r, "c", "r") for r in rows + EDGES], "vec_id long, embedding array<float>, label int, component string, rep string")).collect()}
    unit = x.astype(float) / np.linalg.norm(x.astype(float), axis=1)[:, None]
    hit = (unit @ unit.T >= 0.93) & (label[:, None] == label[None])
    np.fill_diagonal(hit, False)
    want = union_find(range(1, 401), [(int(a) + 1, int(b) + 1) for a, b in zip(*np.nonzero(hit))])
    assert {i: got[i]["component_id"] for i in want} == want
    assert [got[i + 1]["n_links"] for i in range(400)] == hit.sum(axis=1).tolist()
    assert all(got[i]["n_links"] == 0 and got[i]["component_id"] == i and got[i]["kept"] for i in (9001, 9002, 9003, 9004, 9005, 9006, 9009, 9010))
    assert got[9008]["component_id"] == 9007 and got[9007]["n_links"] == 1


def crowd(shared, apart, n=3000, pairs=300, d=64):
    """Vectors whose neighbours are nearly all just too far, and lone near pairs among them."""
    rng = np.random.default_rng(11)
    x = shared * rng.standard_normal(d) + rng.standard_normal((n, d))
    x[n - pairs :] = x[:pairs] + apart * rng.standard_normal((pairs, d))
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    hit = unit @ unit.T >= 0.93
    np.fill_diagonal(hit, False)
    return x, hit


@pytest.mark.parametrize("shared, apart, bucket", [(2.5, 0.9, 1024), (2.5, 0.9, 64), (0.0, 0.38, 32)])
def test_embedding_lone_pairs_in_a_crowd(spark, monkeypatch, shared, apart, bucket):
    monkeypatch.setattr(vec_neardup, "BUCKET", bucket, raising=False)
    x, hit = crowd(shared, apart)
    want = union_find(range(len(x)), list(zip(*(a.tolist() for a in np.nonzero(hit)))))
    assert 100 < hit.sum() // 2 < 300
    rows = spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int")
    # Few window passes, so that the buckets have something to find even without a crowd.
    got = {r["vec_id"]: r for r in vec_neardup.near_duplicates(rows, passes=12 if shared else 1, window=64 if shared else 8).collect()}
    assert {i: got[i]["component_id"] for i in want} == want
    assert [got[i]["n_links"] for i in range(len(x))] == hit.sum(axis=1).tolist()
    if not shared:
        own = rows.selectExpr("cast(label as long) label", "vec_id rep", "vec_id component", "embedding v")
        assert vec_neardup._plans(own, 0.93, vec_neardup.MISS, 1).first()["bits"] > 0


def test_embedding_buckets_miss_no_more_than_stated():
    angle = np.arccos(0.93) / np.pi
    for bits in range(2, vec_neardup.SIGNS + 1, 2):
        assert (1 - (1 - angle) ** bits) ** vec_neardup.passes_for(bits, 0.93) <= vec_neardup.MISS
    assert vec_neardup.passes_for(0, 0.93) == 1


def test_embedding_empty_and_repeated(spark):
    kind = "vec_id long, embedding array<float>, label int"
    assert vec_neardup.near_duplicates(spark.createDataFrame([], kind)).collect() == []
    rows = vec_neardup.near_duplicates(spark.createDataFrame([(5, [1.0, 0.0], 1), (5, [1.0, 0.0], 1), (4, [0.0, 1.0], 1), (None, [1.0, 0.0], 1)], kind)).collect()
    assert sorted((r["vec_id"] or -1, r["n_links"], r["component_id"], r["kept"]) for r in rows if r["vec_id"]) == [(4, 0, 4, True), (5, 1, 5, True), (5, 1, 5, True)]
    assert len(rows) == 4


def test_search_against_all_pairs(spark):
    x, _ = vectors(3, 600)
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [r[:2] for r in EDGES]
    data = spark.createDataFrame([(*r, "q", "s") for r in rows], "vec_id long, embedding array<float>, dim string, ids string")
    got = ann.search(ann.build_index(data), data, data.filter("vec_id % 50 = 0")).collect()
    x = x.astype(float)
    hits = total = 0
    for q in range(0, 600, 50):
        score = np.array([(x[i] * x[q]).sum() / (np.linalg.norm(x[i]) * np.linalg.norm(x[q])) for i in range(600)] + [(x[q] / np.linalg.norm(x[q])).sum() / 4] * 2)
        ids = np.array([*range(600), 9009, 9010])
        score[q] = -np.inf
        best = np.lexsort([ids, -np.round(score, 12)])[:5]
        own = sorted((r["rank"], r["vec_id"], r["score"]) for r in got if r["query_id"] == q)
        assert [r for r, _, _ in own] == [1, 2, 3, 4, 5]
        hits += len({v for _, v, _ in own} & set(ids[best].tolist()))
        total += 5
        assert all(abs(s - score[list(ids).index(v)]) < 1e-12 for _, v, s in own)
    assert hits / total >= 0.95
    assert not any(r["query_id"] >= 9000 and r["query_id"] not in (9007, 9008, 9009, 9010) for r in got)


def test_search_small_and_equal(spark):
    kind = "vec_id long, embedding array<float>"
    same = spark.createDataFrame([(i, [1.0, 1.0]) for i in range(100, 120)] + [(100, [1.0, 1.0])], kind)
    got = sorted((r["query_id"], r["rank"], r["vec_id"]) for r in ann.search(ann.build_index(same), same, same.filter("vec_id = 100")).collect())
    assert got == [(100, k, 100 + k) for k in range(1, 6)]
    two = spark.createDataFrame([(50, [1.0, 0.0]), (51, [0.0, 1.0])], kind)
    assert [(r["vec_id"], r["score"]) for r in ann.search(ann.build_index(two), two, two.filter("vec_id = 50")).collect()] == [(51, 0.0)]
    none = spark.createDataFrame([], kind)
    assert ann.search(ann.build_index(none), none, none).collect() == []


def test_bounds_hold():
    """Popcounts give the product of the rounded query with the code's signs, and the estimate's error
    stays within the bound as often as a normal error would."""
    rng = np.random.default_rng(4)
    for dim in (64, 300):
        x = rng.standard_normal((2000, dim))
        codes, scales = ann.encode(x, 7)
        planes, numbers = ann.quantise(x[:50], 7)
        near = ann.estimates(planes, numbers, codes, np.bitwise_count(codes).sum(axis=1, dtype=np.float32), scales)
        bits = ann.length(dim)
        signs = np.unpackbits(codes.view(np.uint8), axis=1, bitorder="little").astype(float) * 2 - 1
        level = sum(np.unpackbits(planes[:, p].copy().view(np.uint8), axis=1, bitorder="little").astype(float) * 2**p for p in range(ann.PLANES))
        plain = (numbers[:, :1] + numbers[:, 1:2] * level) @ signs.T / (np.sqrt(bits) * scales)
        assert np.abs(near - plain).max() < 1e-4
        unit = x / np.linalg.norm(x, axis=1)[:, None]
        inside = np.abs(near - unit[:50] @ unit.T) <= ann.slack(numbers[:, 1], bits, scales, ann.EPS)
        assert inside.mean() > 0.93


def test_search_in_many_cells(spark, monkeypatch):
    """Blocks of queries and groups of codes, two dimensions: the same rows as in one cell."""
    x, _ = vectors(8, 500)
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(1000 + i, v[:40].tolist()) for i, v in enumerate(x)]
    data = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    asked = data.filter("vec_id % 10 = 0")
    index = ann.build_index(data).cache()
    want = sorted(map(tuple, ann.search(index, data, asked, eps=8.0).collect()))
    monkeypatch.setattr(ann, "BLOCK", 30_000)
    monkeypatch.setattr(ann, "CELL_PAIRS", 4000)
    assert sorted(map(tuple, ann.search(index, data, asked, eps=8.0).collect())) == want and len(want) == 500
    own = dict(rows)
    for q in (0, 490, 1000, 1490):
        others = [i for i in own if i != q and len(own[i]) == len(own[q])]
        score = ann.cosines(np.array([own[i] for i in others], np.float32).astype(float), np.tile(np.array(own[q], np.float32).astype(float), (len(others), 1)))
        assert [r[2] for r in want if r[0] == q] == [others[j] for j in np.lexsort([others, -score])[:5]]

