"""Documents in the JSON form."""

import json

from akzentor.operators import render
from akzentor.plans import queries_engine

SMOKE = "/root/testdata/sf0.001"


def test_documents_in_json(spark):
    spans = [("а\"б", 0, 3, True, 0, 0, [2, 1], "M\"", True), (' \\\n"', 3, 7, False, None, None, None, None, False), ("Ёж-еж", 7, 12, True, None, None, [], None, None)]
    rows = [(1, k, n, *s) for k in (12, 3) for n, s in enumerate(spans)] + [(None, 0, 0, *spans[0])]
    names = "k int, s int, n int, text string, start int, end int, is_word boolean, stress_char_index int, stress_vowel_index int, sub_stresses array<int>, method string, is_preserved boolean"
    df = spark.createDataFrame(rows, names).repartition(3)
    got = {r["k"]: json.loads(r["json"]) for r in render.document_json(df, ["k"], "s", "n").collect()}
    own = [dict(zip(("text", "start", "end", "is_word", "is_preserved"), (*s[:4], s[8]))) for s in spans]
    words = [{"text": "а\"б", "start": 0, "end": 3, "length": 3, "stress_vowel_index": 0, "stress_char_index": 0, "sub_stresses": [{"vowel_index": None, "char_index": 2}, {"vowel_index": None, "char_index": 1}], "method": "M\"", "is_russian_word": False}]
    words += [{"text": "Ёж-еж", "start": 7, "end": 12, "length": 5, "stress_vowel_index": None, "stress_char_index": None, "sub_stresses": [], "method": None, "is_russian_word": True}]
    text = "".join(s[0] for s in spans)
    assert got[1] == {"text": text * 2, "sentences": [{"sentence": k, "text": text, "words": words, "spans": own} for k in (3, 12)]}
    assert got[None]["text"] == "а\"б" and set(got) == {1, None}


def test_json_is_written_where_sentences_stand(spark):
    plan = queries_engine.json_words(spark, SMOKE)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1  # documents are dealt out, and that is all
