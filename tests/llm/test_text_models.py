import collections
import unicodedata

import numpy as np

from pyspark.sql import functions as F

from akzentor.llm import langid, quality

TEXTS = {"en": "the cat and the dog were in the house with that other thing ", "de": "der hund und die katze waren in dem haus mit einer anderen sache ", "fr": "le chat et le chien étaient dans la maison avec une autre chose "}


def plain_ngrams(text):
    """n-grams of one to three signs of words padded with a blank."""
    words, word = [], ""
    for c in text.lower() + " ":
        if unicodedata.category(c)[0] in "LM":
            word += c
        elif word:
            words.append(word)
            word = ""
    joined = " " + "".join(w + " " for w in words) if words else " "
    out = collections.Counter(c for c in joined if c != " ")
    for n in (2, 3):
        out.update(g for i in range(len(joined) - n + 1) if " " not in (g := joined[i : i + n])[1:-1] and g.strip())
    return out


def test_ngrams_against_a_plain_version(monkeypatch):
    monkeypatch.setattr(langid, "BLOCK", 16)
    for text in ("", "  ", "a", "Hello, World! it's", "naïve café\n\nzwei  Wörter 12 x" * 5, "длинноесловобезпробелов" * 3, "हिन्दी"):
        codes, counts, letters = langid.ngrams(text)
        got = {"".join(chr(c >> s & 0x1FFFFF) for s in (42, 21, 0) if c >> s): int(n) for c, n in zip(codes.tolist(), counts)}
        assert got == dict(plain_ngrams(text))
        assert letters == any(c.isalpha() for c in text)


def test_rank_order_against_a_plain_version():
    profiles = {k: langid.ranked(*langid.ngrams(t)[:2], 20).tolist() for k, t in TEXTS.items()}
    of = langid.Profiles(profiles, 20)
    for text in (*TEXTS.values(), "und die dame", "zzz qqq"):
        top = langid.ranked(*langid.ngrams(text)[:2], 20).tolist()
        want = {k: sum(abs(i - p.index(g)) if g in p else 20 for i, g in enumerate(top)) for k, p in profiles.items()}
        best = min(sorted(want), key=want.get)
        assert of(text) == (best, 1 - want[best] / (20 * len(top)))


def test_ranked_breaks_ties_by_code():
    codes, counts = np.arange(10), np.array([1, 3, 3, 1, 1, 2, 1, 1, 1, 1])
    assert langid.ranked(codes, counts, 5).tolist() == [1, 2, 5, 0, 3]


def test_languages_of_edge_rows(spark, docs, no_docs):
    train = spark.createDataFrame([(i, t * 3, k) for i, (k, t) in enumerate(list(TEXTS.items()) * 8)], "doc_id long, text string, lang string")
    profiles = langid.fit(langid.training_rows(train))
    assert set(profiles) == set(TEXTS) and all(0 < len(p) <= langid.PROFILE for p in profiles.values())
    rows = [(r["doc_id"], r["lang_pred"], r["score"]) for r in langid.predict(docs, profiles).collect()]
    assert len(rows) == docs.count() and all(0 <= s <= 1 for _, _, s in rows)
    by = {k: (p, s) for k, p, s in rows}
    assert by[1][0] == "en" and by[2] == by[3] == by[4] == by[8] == ("und", 0.0)
    assert langid.predict(no_docs, profiles).collect() == [] and langid.fit(no_docs) == {}
    assert {r["lang_pred"] for r in langid.predict(docs, {}).collect()} == {"und"}
    kept = langid.keep_known(docs, profiles, 0.0)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {1, 5, 6, 7, None}


def test_nothing_is_learned_from_held_out_rows(spark):
    import zlib

    rows = spark.createDataFrame([(i, "x", "en") for i in range(200)], "doc_id long, text string, lang string")
    used = {r["doc_id"] for r in langid.training_rows(rows).collect()}
    assert used == {i for i in range(200) if zlib.crc32(str(i).encode()) % 4 != 2}
    small = langid.training_rows(rows, fit_rows=30).count()
    assert 5 <= small <= 80


def labelled(spark, n=400):
    good = "This is a plain sentence about the number %d and its many friends in the town. "
    bad = "BUY!! NOW!! %d BUY!! NOW!! CHEAP!! $$$ "
    rows = [(i, (good if i % 4 else bad) % i * (1 + i % 3), "en", f"s{i % 5}", 50) for i in range(n)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame([(i, int(i % 4 > 0), 0) for i in range(0, n, 2)], "doc_id long, quality int, toxic int")
    return docs, labels


def test_quality_on_rows_it_has_not_seen(spark):
    docs, labels = labelled(spark)
    rows = quality.classify(docs, labels).collect()
    assert len(rows) == 400
    unseen = [r for r in rows if r["doc_id"] % 2]
    assert np.mean([r["keep"] == (r["doc_id"] % 4 > 0) for r in unseen]) > 0.97
    assert all(0 <= r[c] <= 1 for r in rows for c in ("p_text", "p_meta", "score"))
    kept = quality.keep_good(docs, labels)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {r["doc_id"] for r in rows if r["keep"]}


def test_quality_of_edge_rows(spark, docs, no_docs):
    _, labels = labelled(spark)
    rows = {r["doc_id"]: r for r in quality.classify(docs, labels).collect()}
    assert len(rows) == 9 and not rows[2]["keep"] and not rows[3]["keep"] and not rows[4]["keep"] and rows[2]["score"] == 0
    assert quality.classify(no_docs, labels).collect() == []
    nothing = labels.limit(0)
    assert {r["keep"] for r in quality.classify(docs.filter("doc_id = 1"), nothing).collect()} == {True}
    one = quality.classify(docs.filter("doc_id = 1"), labels.filter("quality = 1")).collect()
    assert one[0]["score"] == 1.0


def test_views_teach_each_other():
    """The metadata tell only the labelled rows' classes through the text view's labels."""
    rng = np.random.default_rng(0)
    y = rng.integers(0, 2, 1200)
    text = rng.standard_normal((1200, 4)).astype(np.float32) + 4 * y[:, None]
    meta = np.eye(8, dtype=np.float32)[np.where(rng.random(1200) < 0.9, y * 4, 7 - y * 4) % 8]
    seen = np.where(np.arange(1200) < 160, y, -1)
    model = quality.co_train(text, meta, seen, np.arange(1200) % 5 == 0)
    p_text, p_meta, score = model.score(text.astype(float), meta.astype(float))
    rest = np.arange(1200) >= 160
    assert ((score > 0.5) == y)[rest].mean() > 0.97 and ((p_meta > 0.5) == y)[rest].mean() > 0.8 and ((p_text > 0.5) == y)[rest].mean() > 0.97


def test_labels_pass_both_ways_and_never_twice():
    """Where both views carry signal, each teaches the other in every round that leaves it rows."""
    rng = np.random.default_rng(1)
    y = rng.integers(0, 2, 3000)
    text = rng.standard_normal((3000, 4)).astype(np.float32) + 1.5 * y[:, None]
    meta = np.eye(8, dtype=np.float32)[np.where(rng.random(3000) < 0.9, y * 4, 7 - y * 4) % 8]
    meta += rng.standard_normal(meta.shape).astype(np.float32) * 0.2
    seen = np.where(np.arange(3000) < 200, y, -1)
    model = quality.co_train(text, meta, seen, np.arange(3000) % 5 == 0)
    assert len(model.passed) == quality.ROUNDS and all(n > 0 for r in model.passed for view in r for n in view)
    for k in (0, 1):
        assert sum(sum(r[k]) for r in model.passed) <= 2800
        first, second = (sum(model.passed[r][k]) for r in (0, 1))
        assert first <= 0.1 * 2800 + 1 and second <= 0.1 * (2800 - first) + 1


def test_rounds_over_the_table_are_those_over_arrays(spark):
    docs, labels = labelled(spark, 600)
    labels = labels.filter("doc_id % 4 <> 2 or doc_id % 8 = 2")
    features = quality.featured(docs, labels, 8000)
    model = quality.fit(features)
    rows = sorted(features.collect())
    text = np.frombuffer(b"".join(bytes(r["text"]) for r in rows), np.float16).reshape(len(rows), -1).astype(float)
    meta = quality.meta_rows(np.frombuffer(b"".join(bytes(r["meta"]) for r in rows), np.uint8).reshape(-1, 3))
    import zlib

    y = np.array([-1 if r["quality"] is None else r["quality"] for r in rows])
    plain = quality.co_train(text, meta, y, np.array([zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0 for r in rows]))
    assert model.passed == plain.passed and sum(map(sum, model.passed[0])) > 0
    assert np.allclose(model.text, plain.text) and np.allclose(model.meta, plain.meta) and np.allclose(model.both, plain.both)


def test_a_repeated_doc_id_is_learned_from_once(spark):
    docs, labels = labelled(spark)
    again = docs.unionByName(docs.filter("doc_id = 0").withColumn("n", F.explode(F.sequence(F.lit(1), F.lit(300)))).drop("n"))
    rows = {r["doc_id"]: r["score"] for r in quality.classify(docs, labels).collect()}
    more = quality.classify(again, labels).collect()
    assert len(more) == 700 and all(abs(rows[r["doc_id"]] - r["score"]) < 0.2 for r in more)
