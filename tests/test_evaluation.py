"""Alignment, counts, cascade, neighbours and morphology against plain versions."""

import bisect
import random

import pytest
from pyspark.sql import functions as F

from akzentor.functions.alphabet import VOWELS
from akzentor.operators import cascade, metrics, oov
from akzentor.operators.align import align, join_sentences, pairs
from akzentor.plans import report
from akzentor.plans.evaluate import evaluate

WORD = "array<struct<text:string,stress:int>>"


def aligned(spark, cases):
    g = spark.createDataFrame([(i, [(w, None) for w in a.split()], False) for i, (a, _) in enumerate(cases)], f"s int, words {WORD}, error boolean")
    l = spark.createDataFrame([("x", i, [(w, None) for w in b.split()], False) for i, (_, b) in enumerate(cases)], f"lib string, s int, words {WORD}, error boolean")  # noqa: E741
    return align(join_sentences(g, l, ["s"], ["x"]))


def plain_pairs(g, l):  # noqa: E741
    fold = lambda w: w.lower().replace("ё", "е")
    g, l = list(map(fold, g)), list(map(fold, l))  # noqa: E741
    n = min(len(g), len(l))
    a = next((i for i in range(n) if g[i] != l[i]), n)
    b = next((i for i in range(n - a) if g[-1 - i] != l[-1 - i]), n - a)
    return [(i, i) for i in range(a)] + [(len(g) - k, len(l) - k) for k in range(b, 0, -1)]


def test_alignment(spark):
    rng = random.Random(2)
    some = lambda: " ".join(rng.choice(["а", "б", "ёж", "Еж"]) for _ in range(rng.randint(0, 7)))
    cases = [("a b c", "a b c"), ("ёж b", "ЕЖ b"), ("a b c d", "a x c d"), ("a b c", "a c"), ("a a", "a a a"), ("", "a b"), ("", ""), *((some(), some()) for _ in range(300))]
    rows = aligned(spark, cases)
    got = {r["s"]: [(p["g"], p["l"]) for p in r["p"]] for r in rows.select("s", pairs(rows).alias("p")).collect()}
    assert got == {i: plain_pairs(a.split(), b.split()) for i, (a, b) in enumerate(cases)}
    counts = {r["s"]: (r["unmatched_diff"], r["unmatched_same"]) for r in metrics.sentence_metrics(rows, ["s"]).collect()}
    assert [counts[i] for i in range(6)] == [(0, 0), (0, 0), (0, 2), (1, 0), (1, 0), (2, 0)]


def test_scores_and_common_words(spark):
    gold = [(0, "м+ама р+ама ёж по-м+оре дом кошк+а"), (1, "вод+а"), (2, "рек+а ног+а"), (3, "лун+а")]
    libs = [("a", 0, "м+ама рам+а +ёж п+о-море д+ом кошка", False), ("b", 0, "м+ама р+ама +ёж по-м+оре дом кошк+а", False), ("a", 1, "вод+а", True), ("b", 1, "в+ода", False), ("a", 2, "рек+а ног+а", False), ("b", 2, "рек+а н+ога", False), ("a", 3, "лун+а", False)]
    found = evaluate(spark.createDataFrame(gold, "s int, text string"), spark.createDataFrame(libs, "lib string, s int, accented_text string, error boolean"), ["s"], ["a", "b"])
    rows = {(r["lib"], r["s"]): r for r in found.sentences.collect()}
    a0 = rows["a", 0]
    assert (a0["gold_words_with_stress"], a0["stress_errors"], a0["missing_stress"], a0["matched_pairs"]) == (3, 1, 1, 6)
    assert rows["a", 1]["lib_error"] and rows["a", 1]["matched_pairs"] == rows["a", 1]["unmatched_diff"] == 0
    assert rows["b", 3]["unmatched_diff"] == 1 and rows["b", 3]["has_unmatched"]
    common = {r["lib"]: (r["common"], r["errors"], r["accuracy"]) for r in found.accuracy.collect()}
    assert common == {"a": (4, 1, 0.75), "b": (4, 1, 0.75)}
    assert metrics.consistent(found.common).first()["consistent"]
    total = {r["lib"]: r["stress_errors"] for r in found.grand_totals.collect()}
    assert total[None] == total["a"] + total["b"] and total["b"] == 2
    table = report.report_rows(found.totals, found.common)
    for language, word in (("en", "## Comparison on Common Words"), ("ru", "## Сравнение по общим словам")):
        text = report.markdown(table, language, {"gold_file": "g.txt"})
        assert word in text and "75.00%" in text and "`g.txt`" in text and "| `a` |" in text
    assert report.number(1234567) == "1 234 567" and report.percent(1, 0) == "—"


def plain_predict(q, vocabulary, tails, strict):
    lcp = lambda a, b: next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    pos = bisect.bisect_left(vocabulary, (q, ""))
    if strict and pos >= len(vocabulary):
        return -1
    near = {i for i in (pos - 1, pos, pos + 1) if 0 <= i < len(vocabulary)}
    most = max((lcp(q, vocabulary[i][0]) for i in near), default=0)
    if most >= 3:
        near |= {i for i, (f, _) in enumerate(vocabulary) if lcp(q, f) == most}
    good = [(n, vocabulary[i]) for i in near if (q[(n := lcp(q, vocabulary[i][0])) :], vocabulary[i][0][n:]) in tails]
    if not good:
        return -1
    n, (_, places) = max(good)
    at = int(places.split(",")[-1])
    return at if 0 <= at < n else -1


@pytest.mark.parametrize("strict", [True, False])
def test_neighbours(spark, strict):
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("абв") for _ in range(rng.randint(1, 7)))
    vocabulary = sorted({(word(), ",".join(map(str, sorted(rng.sample(range(5), rng.randint(1, 2)))))) for _ in range(150)})
    queries = sorted({word() for _ in range(250)} | {"я", "вввввввв", "а"})
    ends = ["", "а", "б", "в", "аб", "ва"]
    tails = {(a, b) for a in ends for b in ends if rng.random() < 0.7}
    got = oov.predict(spark.createDataFrame([(q,) for q in queries], "query string"), spark.createDataFrame(vocabulary, "form string, positions string"), spark.createDataFrame(sorted(tails), "word_suffix string, norm_suffix string"), strict)
    assert {r["query"]: r["position"] for r in got.collect()} == {q: plain_predict(q, vocabulary, tails, strict) for q in queries}


@pytest.mark.parametrize("strict", [True, False])
def test_neighbours_in_memory_are_those_of_the_join(spark, strict, monkeypatch):
    rng = random.Random(8)
    word = lambda least: "".join(rng.choice("абвa") for _ in range(rng.randint(least, 7)))
    vocabulary = [(word(1), p) for p in ("0", "1,2", "3", "-1", "2,4") for _ in range(60)]
    asked = spark.createDataFrame([(word(0),) for _ in range(400)] + [(None,), ("я",), ("-",)], "query string")
    known = spark.createDataFrame([*vocabulary, (None, "1")], "form string, positions string")
    ends = ["", "а", "б", "аб", "ваб"]
    tails = spark.createDataFrame([(a, b) for a in ends for b in ends if rng.random() < 0.7], "word_suffix string, norm_suffix string")
    held = oov.predict(asked, known, tails, strict)
    assert "Window" not in held._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(oov, "HELD", 5)
    joined = oov.predict(asked, known, tails, strict)
    assert "Window" in joined._jdf.queryExecution().executedPlan().toString()
    rows = {(r["query"], r["position"]) for r in held.collect()}
    assert rows == {(r["query"], r["position"]) for r in joined.filter("query is not null").collect()} | {(None, -1)} and len({p for _, p in rows}) > 3


def test_cascade(spark):
    known = spark.createDataFrame([("замок", [1, 3]), ("мама", [1]), ("над", [1]), ("по", [1]), ("бр", [1])], "form string, positions array<int>")
    words = spark.createDataFrame(list(enumerate(["Ёлка", "мама", "Замок", "брр", "ворона", "по-над", "бр", "да-да", "-", "кто-ёж"])), "k int, text string")
    rows = {r["text"]: (r["stress_char_index"], r["method"], r["sub_stresses"]) for r in cascade.resolve(words, known, ["k"]).collect()}
    assert rows == {
        "Ёлка": (0, "YO", []), "мама": (1, "DICT_SINGLE", []), "Замок": (1, "DICT_MULTI", []), "брр": (None, "NON_WORD", []), "ворона": (1, "HEURISTIC", []), "по-над": (1, "DICT_SINGLE", [4]),
        "бр": (None, "NON_WORD", []), "да-да": (1, "HEURISTIC", []), "-": (None, "NON_WORD", []), "кто-ёж": (4, "YO", []),
    }
    scored = spark.createDataFrame([(2, 3), (1, 3)], "k int, position int")
    rows = {r["text"]: (r["stress_char_index"], r["method"]) for r in cascade.resolve(words, known, ["k"], scored=scored).collect()}
    assert rows["Замок"] == (3, "BERT") and rows["мама"] == (1, "DICT_SINGLE")
    predicted = spark.createDataFrame([(4, 3), (7, 0)], "k int, position int")
    rows = {r["text"]: (r["stress_char_index"], r["method"]) for r in cascade.resolve(words, known, ["k"], predicted=predicted).collect()}
    assert rows["ворона"] == (3, "HEURISTIC") and rows["да-да"] == (None, "UNKNOWN")
    off = cascade.AccentConfig(use_heuristic=False, stress_yo=False)
    rows = {r["text"]: r["method"] for r in cascade.resolve(words, known, ["k"], off).collect()}
    assert rows["ворона"] == "UNKNOWN" and rows["Ёлка"] == "UNKNOWN"
    mono = cascade.resolve(spark.createDataFrame([(0, "кот")], "k int, text string"), known, ["k"], cascade.AccentConfig(stress_monosyllabic=True)).first()
    assert (mono["stress_char_index"], mono["method"]) == (1, "MONO") and set("кот") & set(VOWELS)


def test_cascade_late_parts(spark):
    known = spark.createDataFrame([("по", [1])], "form string, positions array<int>")
    words = spark.createDataFrame(list(enumerate(["да-да", "ворона-брр-сова", "по-да", "-", "брр-", "ворона", "да--да"])), "k int, text string")
    rows = {r["text"]: (r["stress_char_index"], r["stress_vowel_index"], r["method"], r["sub_stresses"]) for r in cascade.resolve(words, known, ["k"], late_parts=True).collect()}
    assert rows == {
        "да-да": (1, 0, "HEURISTIC", [4]), "ворона-брр-сова": (1, 0, "HEURISTIC", [12]), "по-да": (1, 0, "DICT_SINGLE", []), "-": (None, None, "NON_WORD", []),
        "брр-": (None, None, "NON_WORD", []), "ворона": (1, 0, "HEURISTIC", []), "да--да": (1, 0, "HEURISTIC", [5]),
    }
    predicted = spark.createDataFrame([(0, 0), (1, 1), (5, 3)], "k int, position int")
    by_part = spark.createDataFrame([(0, 1, 1), (1, 0, 3), (1, 2, 3), (6, 0, 0)], "k int, part_no int, position int")
    rows = {r["text"]: (r["stress_char_index"], r["method"], r["sub_stresses"]) for r in cascade.resolve(words, known, ["k"], predicted=predicted, late_parts=True, predicted_parts=by_part).collect()}
    assert rows["да-да"] == (4, "HEURISTIC", []) and rows["ворона-брр-сова"] == (3, "HEURISTIC", [14]) and rows["ворона"] == (3, "HEURISTIC", []) and rows["да--да"] == (None, "UNKNOWN", [])


def test_query_late_parts(spark, tmp_path):
    from akzentor.plans import queries

    spark.createDataFrame([(1, "Zurna-borla zurna.")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "lorem ipsum")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = {r["word_no"]: (r["method"], r["n_sub"]) for r in queries.resolver_cascade(spark, str(tmp_path)).collect()}
    assert rows == {0: ("HEURISTIC", 1), 1: ("HEURISTIC", 0)}


def test_engine_late_parts(spark):
    from akzentor.engine import StressEngine

    engine = StressEngine(spark, spark.createDataFrame([("по", [1])], "form string, positions array<int>"))
    assert engine("Говорит: дам-дам.") == "Г+оворит: д+ам-д+ам."
    forms, tails = spark.createDataFrame([("замок", "3")], "form string, positions string"), spark.createDataFrame([("а", ""), ("", "а")], "word_suffix string, norm_suffix string")
    asked = StressEngine(spark, engine.dictionary, forms, tails)
    assert asked("замока-замока") == "зам+ока-зам+ока"


def test_morphology_compatible(spark):
    from akzentor.operators import morph

    own = spark.createDataFrame([(["singular", "nominative"], ["singular"], True), (["singular"], ["plural"], False), ([], ["plural"], True), (["prepositional", "locative"], ["locative"], True), (["past"], ["masculine"], True)], "a array<string>, b array<string>, ok boolean")
    assert all(r["ok"] == r["got"] for r in own.withColumn("got", morph.compatible("a", "b")).collect())
    tags = spark.range(1).select(morph.tags_of(F.create_map(F.lit("Case"), F.lit("Loc"), F.lit("Foo"), F.lit("x"))).alias("t")).first()["t"]
    assert tags == ["prepositional", "locative"]


def test_options_that_agree_with_tags(spark):
    """Part of speech and categories decide; equal forms are one option; one option gives the stress."""
    from akzentor.operators import morph

    tokens = [
        (0, "Замок", "NOUN", "Case", "Nom"), (1, "стоит", "VERB", "Tense", "Pres"), (2, "дома", "NOUN", "Number", "Plur"), (3, "дома", "NOUN", "Number", "Sing"),
        (4, ",", "PUNCT", "", ""), (5, "лесу", "NOUN", "Case", "Loc"), (6, "мука", "NOUN", "Gender", "Fem"), (7, "белка", "NOUN", "Animacy", "Anim"),
    ]
    records = [
        ("замок", "noun", "nominative singular", "за́мок"), ("замок", "noun", "nominative singular inanimate", "замо́к"), ("замок", "verb", "past", "замо́к"),
        ("дома", "noun", "nominative plural", "дома́"), ("дома", "noun", "genitive singular", "до́ма"), ("лесу", "noun", "dative singular", "ле́су"),
        ("лесу", "noun", "locative singular", "лесу́"), ("мука", "noun", "feminine nominative", "му́ка"), ("мука", "noun", "feminine accusative", "му́ка"),
        ("белка", "noun", "inanimate", "белка́"), ("стоит", "verb", "present third-person", "стои́т"), ("стоит", "verb", "past", "сто́ит"),
    ]
    asked = spark.createDataFrame(tokens, "token int, text string, pos string, k string, v string").selectExpr("token", "text", "pos", "map(k, v) AS feats")
    known = spark.createDataFrame([(f, i, p, t.split(), s) for i, (f, p, t, s) in enumerate(records)], "form string, ordinal int, pos string, morph_tags array<string>, stressed_form string")
    found = morph.stress_options(asked, known, ["token"])
    words = asked.selectExpr("token", "text", "CAST(NULL AS INT) AS stress_char_index", "CAST(NULL AS INT) AS stress_vowel_index", "'UNKNOWN' AS method")
    place = {r["token"]: r["stress_char_index"] for r in morph.refine(words, found.select("token", "options"), ["token"]).collect()}
    options = {r["token"]: r["options"] for r in found.collect()}
    assert options == {0: ["за́мок", "замо́к"], 1: ["стои́т"], 2: ["дома́"], 3: ["до́ма"], 4: [], 5: ["лесу́"], 6: ["му́ка"], 7: []}
    assert place == {0: None, 1: 3, 2: 3, 3: 1, 4: None, 5: 3, 6: 1, 7: None}
