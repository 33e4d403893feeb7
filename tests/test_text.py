"""Marks, tokens and extraction against short statements of the rules."""

import random
import re

import pytest
from pyspark.sql import functions as F

from akzentor.functions import marks
from akzentor.functions.alphabet import CYRILLIC, LATIN, VOWELS, WORD
from akzentor.operators import extract, render, ssml, tokenize, wordpiece

A, G = "́", "̀"


def column(spark, expression, values):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x string").select("i", expression("x").alias("y"))
    return [r["y"] for r in sorted(rows.collect(), key=lambda r: r["i"])]


def random_marked(seed, n=400):
    rng = random.Random(seed)
    signs = "аеоябвгй ё-.!\n😀x1" + "+" * 4 + A * 3 + G
    return ["", "+", "а+", A, f"+а{A}", f"б{A}", f"а{A}{A}", "++а", *("".join(rng.choice(signs) for _ in range(rng.randint(0, 24))) for _ in range(n))]


def scan(text):
    """Clean text and stress places, sign by sign."""
    clean, places, i = "", [], 0
    while i < len(text):
        c, d = text[i], text[i + 1 : i + 2]
        if c == "+" and d and d in VOWELS:
            places.append(len(clean))
            clean += d
            i += 2
        elif c in VOWELS and d in (A, G) and d:
            places.append(len(clean))
            clean += c
            i += 2
        else:
            clean += "" if c in "+" + A + G else c
            i += 1
    return clean, places


def plus(text):
    out, i = "", 0
    while i < len(text):
        if text[i + 1 : i + 2] in (A, G) and text[i + 1 : i + 2]:
            out += ("+" if text[i] in VOWELS else "") + text[i]
            i += 2
        else:
            out += text[i]
            i += 1
    return re.sub(rf"([{VOWELS}])\+([^{VOWELS}]|\Z)", r"+\1\2", out)


@pytest.mark.parametrize("seed", [1, 2])
def test_marks(spark, seed):
    texts = random_marked(seed)
    assert column(spark, marks.remove_marks, texts) == [t.translate({ord(c): None for c in "+" + A + G}) for t in texts]
    assert column(spark, marks.remove_marks, texts) == [scan(t)[0] for t in texts]
    assert column(spark, marks.stress_positions, texts) == [scan(t)[1] for t in texts]
    assert column(spark, marks.to_plus, texts) == [plus(t) for t in texts]
    assert column(spark, marks.first_stress, texts) == [(scan(t)[1] or [None])[0] for t in texts]
    back = column(spark, lambda x: marks.annotate(marks.remove_marks(x), marks.stress_positions(x)), texts)
    assert [scan(b) for b in back] == [scan(t) for t in texts]
    assert [scan(b) for b in column(spark, marks.acutes, texts)] == [scan(t) for t in texts]


def test_words_of_marked_text(spark):
    cases = {
        "М+ама м+ыла р+аму.": [("Мама", 0, 4, 1, 0), ("мыла", 5, 9, 1, 0), ("раму", 10, 14, 1, 0)],
        "Он приш+ёл дом+ой.": [("Он", 0, 2, None, None), ("пришёл", 3, 9, 4, 1), ("домой", 10, 15, 3, 1)],
        f"Баргамо{A}т и Гара{A}ська\nавтор Леони{A}д": [("Баргамот", 0, 8, 6, 2), ("и", 9, 10, None, None), ("Гараська", 11, 19, 3, 1), ("автор", 20, 25, None, None), ("Леонид", 26, 32, 4, 2)],
        f"по-насто{A}ящему": [("по-настоящему", 0, 13, 7, 2)], f"С+олнце свет+ит я{A}рко.": [("Солнце", 0, 6, 1, 0), ("светит", 7, 13, 4, 1), ("ярко", 14, 18, 0, 0)],
        "+7 (1) +а": [("а", 6, 7, 0, 0)], "": [], "...": [],
    }
    rows = spark.createDataFrame(list(enumerate(cases)), "k int, text string")
    got = extract.marked_words(rows, ["k"], method="GOLD").orderBy("k", "word_no").collect()
    for k, want in enumerate(cases.values()):
        assert [(r["text"], r["start"], r["end"], r["stress_char_index"], r["stress_vowel_index"]) for r in got if r["k"] == k] == want
    assert all((r["method"] == "GOLD") == (r["stress_char_index"] is not None) for r in got)
    arrays = {r["k"]: [(w["text"], w["stress"]) for w in r["w"]] for r in rows.select("k", extract.word_array("text").alias("w")).collect()}
    assert all(arrays[k] == [(w[0], w[3]) for w in want] for k, want in enumerate(cases.values()))


@pytest.mark.parametrize("seed", [3, 4])
def test_spans_are_lossless(spark, seed):
    texts = [t for t in random_marked(seed) if t]
    rows = tokenize.spans(spark.createDataFrame(list(enumerate(texts)), "k int, text string"), ["k"]).orderBy("k", "span_no").collect()
    for k, text in enumerate(texts):
        own = [r for r in rows if r["k"] == k]
        assert "".join(r["text"] for r in own) == text
        assert [(m.start(), m.end()) for m in re.finditer(f"[{re.escape(WORD)}]+", text)] == [(r["start"], r["end"]) for r in own if r["is_word"]]


def test_sentences(spark):
    rng = random.Random(5)
    texts = ["", "Да. Нет!  \n Кто?…", "а\n\n\nб", "  .  ", "x" * 10, *("".join(rng.choice("аб .!?…\n ") for _ in range(rng.randint(0, 30))) for _ in range(200))]
    got = tokenize.split_sentences(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")).orderBy("doc_id", "sent_no").collect()
    for k, text in enumerate(texts):
        want, at = [], 0
        for m in re.finditer(r"[.!?…]+\s*|\n{2,}", text):
            want.append((at, text[at : m.end()]))
            at = m.end()
        want.append((at, text[at:]))
        assert [(r["start"], r["text"]) for r in got if r["doc_id"] == k] == [w for w in want if w[1].strip()]


def test_lines(spark):
    texts = [None, "", "a\r\nb\rc\n\n  d  e\x0bf\x1cg\x85h", "  x　 ", "one"]
    got = tokenize.lines(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")).orderBy("doc_id", "line_no").collect()
    for k, text in enumerate(texts):
        assert [(r["line_no"], r["text"]) for r in got if r["doc_id"] == k] == list(enumerate(s.strip() for s in (text or "").splitlines() if s.strip()))


def test_word_functions(spark):
    words = ["мама", "ЁЖ", "елка", "ёлка", "Кот", "по-над", "аэё", "", "брр", "Ё", "моё"]
    vowel = lambda w: [i for i, c in enumerate(w) if c in VOWELS]
    assert column(spark, marks.count_vowels, words) == [len(vowel(w)) for w in words]
    assert column(spark, marks.vowel_positions, words) == [vowel(w) for w in words]
    assert column(spark, marks.first_vowel, ["😀" + w for w in words]) == [vowel(w)[0] + 1 if vowel(w) else None for w in words]
    assert column(spark, lambda x: marks.nth_vowel(x, F.lit(1)), ["😀" + w for w in words]) == [vowel(w)[1] + 1 if len(vowel(w)) > 1 else None for w in words]
    assert column(spark, marks.fold, words) == [w.lower().replace("ё", "е") for w in words]
    assert column(spark, marks.needs_stress, words) == [len(vowel(w)) >= 2 and not set("ёЁ") & set(w) for w in words]
    assert column(spark, marks.yo_position, words) == [w.find("ё") if "ё" in w else w.find("Ё") for w in words]
    assert column(spark, marks.is_russian, ["да", "да!", "", "д-а", "yes"]) == [True, False, False, True, False]
    pairs = [("замок", "замком", 3), ("", "а", 0), ("аб", "вб", 0), ("абв", "абв", 3), ("аб", "абв", 2)]
    rows = spark.createDataFrame(pairs, "a string, b string, n int").select("n", marks.common_prefix("a", "b").alias("m")).collect()
    assert all(r["n"] == r["m"] for r in rows)
    forms = [("замок", f"за{A}мок", 1), ("замок", f"замо{A}к", 3), ("замка", f"замо{A}к", 3 + 1), ("замок", "замок", None), ("дом", f"дома{A}", None), ("мор", f"мр{A}", None), ("Ели", f"е{A}ли", 0), ("еж", f"ё{A}ж", 0)]
    rows = spark.createDataFrame(forms, "w string, f string, n int").select("*", marks.form_position("w", "f").alias("m")).collect()
    assert [r["m"] for r in rows] == [r["n"] for r in rows]
    assert column(spark, marks.variant_positions, ['{"зам+ок":0.5,"з+амок":0.5}', '{"замок":1}', "[]", "no", None]) == [[1, 3], [], None, None, None]
    numbers = spark.createDataFrame([(1234567, 1.5)], "n long, x double").select(marks.number_text("n"), marks.number_text("x", True), marks.percent_text("n", F.lit(0)), marks.percent_text(F.lit(1), F.lit(3))).first()
    assert list(numbers) == ["1 234 567", "1.5000", "—", "33.33%"]


def test_dubious_words(spark):
    words = spark.createDataFrame([("Слово", 1, 0), ("да-да", 0, 0), ("нет", 1, 0)], "text string, stress_char_index int, stress_vowel_index int")
    listed = spark.createDataFrame([("слово",), ("слово",)], "key string")
    got = {r["text"]: (r["dubious"], r["stress_char_index"]) for r in extract.flag_dubious(words, listed).collect()}
    assert got == {"Слово": (True, None), "да-да": (True, None), "нет": (False, 1)}
    assert {r["stress_char_index"] for r in extract.flag_dubious(words, listed, strict=True).collect()} == {0, 1}


def test_ssml(spark):
    rows = [(0, "Да <p>тут <b>и</b> <break time='1'/>там</p> <voice>конец"), (1, None), (2, "нет"), (3, "</p>x<p/>y<speak>z</p></speak>")]
    got = {r["k"]: r for r in ssml.extract(spark.createDataFrame(rows, "k int, text string")).collect()}
    assert got[0]["clean"] == "Да тут и там конец" and [(t["tag"], t["start"], t["end"]) for t in got[0]["regions"]] == [("p", 3, 12), ("voice", 13, 18)]
    assert got[1]["regions"] == [] and got[2]["regions"] == [] and got[3]["clean"] == "xyz" and [(t["start"], t["end"]) for t in got[3]["regions"]] == [(2, 3)]


def test_renderers(spark):
    rows = [(0, 0, "Да", True, 1, [], "MONO"), (0, 1, ", ", False, None, None, None), (0, 2, "по-над", True, 1, [4], "DICT_SINGLE"), (0, 3, "!", False, None, None, None), (1, 0, "...", False, None, None, None)]
    spans = spark.createDataFrame(rows, "s int, n int, text string, is_word boolean, stress_char_index int, sub_stresses array<int>, method string").withColumns({"start": F.lit(0), "end": F.lit(0), "stress_vowel_index": F.lit(0)})
    text = lambda df: {r["s"]: r[1] for r in df.collect()}
    assert text(render.render(spans, ["s"], ["n"], "annotated")) == {0: "Д+а, п+о-н+ад!", 1: "..."} == text(render.render(spans, ["s"], ["n"], "raw"))
    assert text(render.render(spans, ["s"], ["n"], "stress_mark"))[0] == f"Да{A}, по{A}-на{A}д!"
    assert [tuple(w) for w in text(render.word_list(spans, ["s"], ["n"]))[0]] == [("", "Д+а"), (", ", "п+о-н+ад"), ("!", "")]
    assert '"method":"DICT_SINGLE"' in text(render.render(spans, ["s"], ["n"], "json"))[0]
    with pytest.raises(ValueError):
        render.render(spans, ["s"], ["n"], "html")


def test_wordpiece(spark):
    vocabulary = wordpiece.load_vocabulary(["[PAD]\n", "[UNK]\n", "[CLS]\n", "[SEP]\n", "за\n", "##мок\n", "##м\n", ",\n", "дом\n"])
    assert wordpiece.pieces("замок", vocabulary) == ["за", "##мок"] and wordpiece.pieces("кот", vocabulary) == ["[UNK]"] == wordpiece.pieces("за" * 60, vocabulary)
    assert wordpiece.basic("Да, 日本!\x00 x\ty") == ["Да", ",", "日", "本", "!", "x", "y"] and wordpiece.basic("Ёж", lower=True) == ["еж"]
    ids, places = wordpiece.engine_tokens("З+амок, дом", vocabulary)
    assert ids == [2, 1, 1, 7, 8, 3] and [p[:2] for p in places] == [(0, 1), (2, 6), (8, 11)]
    assert wordpiece.engine_tokens("Замок, дом", vocabulary) == ([2, 4, 5, 7, 8, 3], [(0, 5, 1, 3), (7, 10, 4, 5)])
    row = wordpiece.encode(spark.createDataFrame([("Замок, дом",)], "text string"), vocabulary).first()
    assert row["ids"] == [2, 4, 5, 7, 8, 3] and row["places"][1]["first"] == 4
    assert wordpiece.vowel_table(vocabulary)[5] == (3, [1]) and wordpiece.tokens_of([4, 99], vocabulary) == ["за", "[UNK]"]
    alphabet = " абвгдеёжзийклмнопрстуфхцчшщъыьэюя"
    assert column(spark, wordpiece.framed_signs, ["Ё+ж", "a", ""]) == [[1, 3 + alphabet.index("ё"), 3 + alphabet.index("ж"), 2], [1, 0, 2], [1, 2]]


def test_stand_in_letters_are_one_to_one():
    assert len(LATIN) == len(CYRILLIC) == len(set(LATIN))
