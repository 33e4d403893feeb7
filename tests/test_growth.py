"""What the plans of large inputs may hold, and the arrays of signs against plain versions."""

import random
import re

import pyarrow as pa
from pyspark.sql import functions as F

from akzentor.functions import marks, scan
from akzentor.functions.alphabet import MW, NOT_MW, NOT_W, W
from akzentor.operators import cascade, render, tokenize
from akzentor.plans import derived, queries

SIGNS = "аеёиЁОбвгнТ-+́̀ .,яюz\U0001f600"
SMOKE = "/root/testdata/sf0.001"


def _texts(n, seed=7):
    rng = random.Random(seed)
    return [None, "", "+", "-", *("".join(rng.choice(SIGNS) for _ in range(rng.randrange(60))) for _ in range(n))]


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_spans_and_words_are_those_of_the_expressions(spark):
    texts = spark.createDataFrame(list(enumerate(_texts(300))), "k int, t string")
    for marked, (a, b) in ((False, (W, NOT_W)), (True, (MW, NOT_MW))):
        want = {}
        for k, t in enumerate(_texts(300)):
            at, no = 0, 0
            for raw in re.findall(f"{a}+|{b}+", t or ""):
                text = re.sub("[+̀́]", "", raw) if marked else raw
                want[k, no] = (text, at, at + len(text), bool(re.match(W, text)))
                at, no = at + len(text), no + 1
        got = tokenize.spans(texts, ["k"], "t", marked).collect()
        assert {(r["k"], r["span_no"]): (r["text"], r["start"], r["end"], r["is_word"]) for r in got} == want
    rows = tokenize.spans(texts, ["k"], "t", marked=True).withColumn("_p", marks.first_stress("raw")).withColumn("_v", marks.vowel_index("text", "_p"))
    assert rows.filter("not (stress_char_index <=> _p and stress_vowel_index <=> _v)").count() == 0 and rows.filter("_p is not null").count() > 100


def test_texts_are_never_cut(monkeypatch):
    texts = pa.array(_texts(200))
    whole = scan.span_lists(texts, True, False)
    monkeypatch.setattr(scan, "PIECE", 16)
    assert scan.span_lists(texts, True, False).equals(whole) and scan.span_lists(texts.slice(3, 50), True, False).equals(whole.slice(3, 50))


def test_sentences_meet_as_texts_and_not_as_words(spark):
    own = derived.sentences(spark, SMOKE)
    plan = _plan(queries.alignment(spark, SMOKE))
    aggregate = [x for x in plan.split("\n") if "collect_list" in x]
    assert aggregate and "array<struct<text" not in plan and "regexp_extract_all" not in plan
    a, b = queries.alignment(spark, SMOKE), own.count()
    assert a.count() == 3 * b


def test_spans_and_sentences_are_not_sorted(spark):
    own = derived.sentences(spark, SMOKE)
    for df in (tokenize.words(own, derived.KEYS), tokenize.spans(own, derived.KEYS), tokenize.split_sentences(derived.documents(spark, SMOKE))):
        assert "Window" not in _plan(df) and "Sort" not in _plan(df)


def test_only_words_at_hyphens_pass_the_window(spark):
    words = spark.createDataFrame([(1, "мама"), (2, "мама-раз"), (3, "--"), (4, "ёж"), (5, None)], "k int, text string")
    known = spark.createDataFrame([("мама", [1]), ("раз", [1])], "form string, positions array<int>")
    got = {r["k"]: (r["stress_char_index"], r["method"], r["sub_stresses"]) for r in cascade.resolve(words, known, ["k"], late_parts=True).collect()}
    assert got[1] == (1, "DICT_SINGLE", []) and got[2] == (1, "DICT_SINGLE", [6]) and got[4] == (0, "YO", []) and got[3][0] is None and set(got) == {1, 2, 3, 4, 5}
    plan = cascade.resolve(words, known, ["k"], late_parts=True)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Union") < plan.index("Window")  # above it in the tree: other words go past the window


def test_runs_are_gathered_in_any_order(spark):
    rows = [(k, n, f"{k}.{n}") for k in (None, 1, 2) for n in range(25)]
    random.Random(3).shuffle(rows)
    for some in (rows, sorted(rows, key=lambda r: (r[0] or 0, r[1]))):
        df = spark.createDataFrame(some, "k int, n int, t string").repartition(3)
        got = {r["k"]: [x["t"] for x in r["_rows"]] for r in render.gathered(df, ["k"], F.struct("n", "t")).collect()}
        assert got == {k: [f"{k}.{n}" for n in range(25)] for k in (None, 1, 2)}
    assert render.gathered(df.filter("false"), ["k"], F.struct("n", "t")).count() == 0


def test_word_lists_of_odd_sentences(spark):
    rows = [(1, [(True, "а"), (True, "б"), (False, ", ")]), (2, []), (3, [(False, "."), (False, "!")]), (4, [(False, "«"), (False, " "), (True, "в")])]
    flat = [(k, n, w, t, None, None) for k, ws in rows for n, (w, t) in enumerate(ws)]
    df = spark.createDataFrame(flat, "k int, n int, is_word boolean, text string, stress_char_index int, sub_stresses array<int>")
    got = {r["k"]: [tuple(w) for w in r["words"]] for r in render.word_list(df, ["k"], ["n"]).collect()}
    assert got == {1: [("", "а"), ("", "б"), (", ", "")], 3: [(".!", "")], 4: [("« ", "в")]}


def test_rules_of_words_are_those_of_the_expressions(spark):
    words = [*_texts(300, 11), "ёж", "Ёж", "ЁЁё", "мама", "-", "ммм"]
    df = spark.createDataFrame([(w,) for w in words], "w string").select("w", F.arrow_udf(scan.rules, scan.RULES)("w").alias("r"))
    same = (F.col("r.vowels").eqNullSafe(marks.count_vowels("w")), F.col("r.yo").eqNullSafe(marks.yo_position("w")), F.col("r.first").eqNullSafe(marks.first_vowel("w")), F.col("r.russian").eqNullSafe(marks.is_russian("w")))
    for test in same:
        assert df.filter(~test).collect() == []
    plan = _plan(queries.resolver_cascade(spark, SMOKE))
    assert "RLIKE" not in plan  # tests of a word's signs are made once, and not in each branch
