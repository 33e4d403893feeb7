"""Marks and lines as arrays of signs against the expressions and plain versions."""

import random
import re

import pyarrow as pa
from pyspark.sql import functions as F

from akzentor.functions import marks, scan
from akzentor.functions.alphabet import CYRILLIC, LATIN, NOT_V, VOWELS, V
from akzentor.operators import tokenize, wordpiece
from akzentor.operators.tokenize import BREAKS, SPACE
from akzentor.plans import derived, queries, queries_engine

SIGNS = "аеёиЁОбвТ-++́̀́ .,яюz\U0001f600\n\r"
SMOKE = "/root/testdata/sf0.001"


def _texts(n, signs, seed):
    rng = random.Random(seed)
    return [None, "", "+", "́", "\n", *("".join(rng.choice(signs) for _ in range(rng.randrange(14))) for _ in range(n))]


def _pluses(t):
    units = re.findall("(?s).[̀́]|.", t)
    own = "".join((("+" if u[0] in VOWELS else "") + u[0]) if len(u) == 2 else u for u in units)
    return re.sub(rf"({V})\+({NOT_V}|\Z)", r"+\1\2", own)


def _acutes(t):
    units = re.findall(f"(?s)\\+{V}|{V}[̀́]|.", t)
    return "".join(u.strip("+̀́") + "́" if len(u) == 2 else re.sub("[+̀́]", "", u) for u in units)


def test_marks_of_texts(spark, monkeypatch):
    texts = _texts(2000, SIGNS, 5)
    plain = lambda f: [None if t is None else f(t) for t in texts]
    want = {"pluses": plain(_pluses), "acutes": plain(_acutes)}
    for piece in (scan.PIECE, 16):
        monkeypatch.setattr(scan, "PIECE", piece)
        assert {k: getattr(scan, k)(pa.array(texts)).to_pylist() for k in want} == want
        assert scan.pluses(pa.array(texts).slice(7, 100)).to_pylist() == want["pluses"][7:107]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert df.filter(~marks.unmarked("t").eqNullSafe(marks.remove_marks("t"))).count() == 0
    assert df.filter(~marks.stress_places("t").eqNullSafe(marks.stress_positions("t"))).count() == 0
    assert scan.pluses(pa.array([], pa.string())).to_pylist() == [] and scan.line_lists(pa.array([None, ""])).to_pylist() == [None, []]


def test_lines_of_texts(spark):
    texts = _texts(2000, "аb \t\n\r\x0b\x0c\x1c\x1e\x1f\x85   ​　、\U0001f600", 6)
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    strip = lambda x: F.regexp_replace(x, f"^{SPACE}+|{SPACE}+$", "")
    own = F.filter(F.transform(F.split("t", BREAKS), strip), lambda x: x != "")
    assert df.filter(~own.eqNullSafe(F.arrow_udf(scan.line_lists, "array<string>")("t"))).collect() == []


def test_latin_is_read_as_before(spark):
    texts = _texts(500, LATIN + "ЁÿĀж\U0001f600 1", 7)
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert df.filter(~F.translate("t", LATIN, CYRILLIC).eqNullSafe(F.arrow_udf(scan.cyrillic, "string")("t"))).collect() == []


def test_texts_are_not_taken_apart_into_arrays_of_signs(spark):
    for f in (queries.marks_round_trip, queries.stress_positions, queries.lines):
        plan = f(spark, SMOKE)._jdf.queryExecution().executedPlan().toString()
        assert "regexp_extract_all" not in plan and "split(" not in plan


def test_words_are_folded_where_they_are_found(spark):
    df = spark.createDataFrame(list(enumerate(_texts(500, SIGNS + "ЁёЯ", 8))), "k int, t string")
    rows = tokenize.words(df, ["k"], "t", folded=True)
    assert rows.count() > 300 and rows.filter(~marks.fold("text").eqNullSafe(F.col("folded"))).collect() == []
    for f in (queries.scorer_routing, queries_engine.sign_scores):
        plan = f(spark, SMOKE)._jdf.queryExecution().optimizedPlan().toString().split("benchmark")[0]
        assert "lower(text" not in plan.replace("lower(translate", "")


def test_pieces_are_looked_for_no_longer_than_any_is():
    class Counted(dict):
        n = 0

        def __contains__(self, key):
            Counted.n += 1
            return super().__contains__(key)

    vocabulary = Counted({"з": 4, "за": 5, "##м": 6, "##о": 7, "##к": 8})
    most = wordpiece.longest(vocabulary)
    for word in ("замок", "з" + "мок" * 30, "мз", "заж"):
        assert wordpiece.pieces(word, vocabulary, most=most) == wordpiece.pieces(word, vocabulary)
    Counted.n = 0
    wordpiece.engine_tokens("з" + "мок" * 30, vocabulary, most)
    assert Counted.n <= 91 * most


def test_marks_are_turned_on_signs(monkeypatch):
    texts = _texts(1000, SIGNS, 9)
    own = scan.plain(pa.array(texts))
    want = scan.acutes(own)
    for piece in (scan.PIECE, 16):
        monkeypatch.setattr(scan, "PIECE", piece)
        got = [scan.round_trip(scan.Signs(own.slice(a, b - a))) for a, b in scan.pieces(own)]
        plus, clean, n = (pa.concat_arrays(x) for x in zip(*got, strict=True))
        assert plus.equals(scan.pluses(want)) and clean.equals(scan.unmarked(want))
        assert n.to_pylist() == [len(x) for x in scan.stress_places(want).to_pylist()]
    lines, counts = scan.cut(scan.read(scan.Signs(own)))
    want = scan.line_lists(scan.cyrillic(own))
    assert lines.written().equals(want.flatten()) and counts.tolist() == [len(x) for x in want.to_pylist()]


def test_round_trips_are_those_of_the_single_steps(spark):
    own = derived.sentences(spark, SMOKE).select(*derived.KEYS, derived.gold_text().alias("marked")).withColumn("acute", marks.acutes("marked"))
    want = own.select(*derived.KEYS, marks.to_plus("acute").alias("plus_text"), marks.unmarked("acute").alias("clean"), F.size(marks.stress_places("acute")).alias("n_marks"))
    got = queries.marks_round_trip(spark, SMOKE)
    assert got.dtypes == want.dtypes
    assert got.count() == want.count() > 100 and got.exceptAll(want).count() == 0


def test_lines_are_cut_once_and_after_documents_are_dealt_out(spark):
    for f in (queries.lines, queries.marks_round_trip, queries.stress_positions, queries.sentence_split, queries_engine.sign_scores):
        plan = f(spark, SMOKE)._jdf.queryExecution().executedPlan().toString()
        dealt = plan.index("REPARTITION_BY_COL")
        assert plan.count("line_lists(") <= 1 and "Python" not in plan[dealt:] and "InArrow" not in plan[dealt:]


def test_words_are_made_distinct_in_their_batch(spark, monkeypatch):
    texts = _texts(700, SIGNS + "ЁёЯ-", 10)
    df = spark.createDataFrame([(t,) for t in texts], "t string").coalesce(1)
    words = tokenize.words(df, [], "t").select("text")
    parts = words.select(F.explode(F.split("text", "-")).alias("text")).filter("text <> ''")
    for piece in (scan.PIECE, 16):
        monkeypatch.setattr(scan, "PIECE", piece)
        for own, by_part in ((words, False), (parts, True)):
            for folded in (False, True):
                want = {r[0] for r in own.select(marks.fold("text") if folded else "text").collect()}
                got = scan.distinct_words(pa.array(texts), folded, by_part).to_pylist()
                assert len(got) == len(set(got)) and set(got) == want and len(want) > 100
    assert {r["word"] for r in tokenize.distinct_words(df, "t").collect()} == {r["text"] for r in words.collect()}
    assert scan.distinct_words(pa.array([None, "", " "])).to_pylist() == []
    assert scan.distinct_words(pa.array(["а", "б в", "г"]).slice(1, 1)).to_pylist() == ["б", "в"]


def test_words_are_no_rows_before_they_are_distinct(spark):
    for f in (queries.unknown_words, queries.sign_ids, queries_engine.sign_scores):
        plan = f(spark, SMOKE)._jdf.queryExecution().executedPlan().toString()
        documents = plan[plan.index("MapInArrow run(text") :]
        assert "Generate" not in plan.split("benchmark")[0].split("BroadcastExchange")[0] and "Window" not in plan and "REPARTITION_BY_COL" in documents
