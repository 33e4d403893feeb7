"""Registered queries of the stress engine, and what each of them is in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from akzentor.functions import marks
from akzentor.functions.alphabet import CYRILLIC, LATIN, NOT_V, NOT_W, VOWELS, W
from akzentor.operators import cascade, dictionary, extract, metrics, oov, render, ssml, tokenize, wordpiece
from akzentor.plans import derived, evaluate, report
from akzentor.plans.derived import KEYS, LIBS
from akzentor.sources.scratch import keep

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


# -- SQL of the derived inputs ----------------------------------------------------------------

SPACE = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
BREAKS = r"\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x{85}\x{2028}\x{2029}]"
SPANS = f"'({W}+|{NOT_W}+)'"


def nv(w: str) -> str:
    return f"len(regexp_replace({w}, '{NOT_V}', '', 'g'))"


def vowel_at(w: str, k: str) -> str:
    """Place, from 1, of the vowel with a number."""
    return f"(list_filter(range(1, len({w}) + 1), lambda p: contains('{VOWELS}', substr({w}, p, 1))))[{k} + 1]"


def plus_at(w: str, k: str) -> str:
    return f"substr({w}, 1, {vowel_at(w, k)} - 1) || '+' || substr({w}, {vowel_at(w, k)})"


def written(k: str, test: str = "true") -> str:
    """The sentence with a plus at each word's k-th vowel."""
    return f"list_aggregate(list_transform(regexp_extract_all(text, {SPANS}), lambda s, i: CASE WHEN {nv('s')} >= 2 AND regexp_matches(s, '^{W}') AND {test} THEN {plus_at('s', k)} ELSE s END), 'string_agg', '')"


GOLD_K = f"((len(s) + doc_id) % {nv('s')})"
NEAR_K = f"CASE WHEN (i - 1 + doc_id) % 7 = 0 THEN 0 ELSE {GOLD_K} END"
SENT = f"""docs AS (SELECT doc_id, translate(text, '{LATIN}', '{CYRILLIC}') AS text FROM documents),
cut AS (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(text, '{BREAKS}'), lambda x: regexp_replace(x, '^{SPACE}+|{SPACE}+$', '', 'g')), lambda x: x <> '') AS l FROM docs WHERE text IS NOT NULL),
sent AS (SELECT doc_id, CAST(unnest(range(len(l))) AS INTEGER) AS line_no, unnest(l) AS text FROM cut)"""
#: A plus that stands before no vowel is no mark, and goes.
MARKS_ONLY = f"regexp_replace(marked, '\\+({NOT_V}|$)', '\\1', 'g')"
MARKED = f"gold AS (SELECT doc_id, line_no, text, {written(GOLD_K)} AS marked FROM sent)"


def spans_of(source: str, text: str) -> str:
    return f"(SELECT *, unnest(regexp_extract_all({text}, {SPANS})) AS w, unnest(range(len(regexp_extract_all({text}, {SPANS})))) AS k FROM {source})"


WORDS = f"""spans AS (SELECT doc_id, line_no, k, w, sum(len(w)) OVER (PARTITION BY doc_id, line_no ORDER BY k) - len(w) AS s FROM {spans_of('sent', 'text')}),
words AS (SELECT doc_id, line_no, CAST(row_number() OVER (PARTITION BY doc_id, line_no ORDER BY k) - 1 AS INTEGER) AS word_no, w AS text, CAST(s AS INTEGER) AS start, CAST(s + len(w) AS INTEGER) AS "end" FROM spans WHERE regexp_matches(w, '^{W}'))"""
CLEAN_WORDS = WORDS.replace(spans_of('sent', 'text'), spans_of('sent', "replace(text, '+', '')"))
LINES_OF = {"first": ("0", "true"), "last": (f"({nv('s')} - 1)", "true"), "near": (NEAR_K, "(i - 1 + doc_id) % 11 <> 0")}


def _words_list(t: str) -> str:
    clean = "replace(w, '+', '')"
    return f"list_transform(list_filter(regexp_extract_all({t}, '((?:\\+|{W})+)'), lambda w: regexp_matches(w, '{W}')), lambda w: struct_pack(t := replace(lower({clean}), 'ё', 'е'), o := {clean}, p := CASE WHEN contains(w, '+') THEN strpos(w, '+') - 1 END))"


def _near_text() -> str:
    return f"CASE WHEN line_no % 17 = 5 THEN 'а ' ELSE '' END || {written(*LINES_OF['near'])}"


ALIGNED = f"""libs AS (
SELECT 'first' AS lib, doc_id, line_no, {written(*LINES_OF['first'])} AS said, false AS failed FROM sent
UNION ALL SELECT 'last', doc_id, line_no, {written(*LINES_OF['last'])}, false FROM sent
UNION ALL SELECT 'near', doc_id, line_no, {_near_text()}, (doc_id + line_no) % 50 = 49 FROM sent),
both_ AS (SELECT lib, l.doc_id, l.line_no, failed, {_words_list('marked')} AS g, {_words_list('said')} AS l FROM libs l JOIN gold g ON l.doc_id = g.doc_id AND l.line_no = g.line_no),
heads AS (SELECT *, least(len(g), len(l)) AS n, list_position(list_transform(range(1, least(len(g), len(l)) + 1), lambda i: g[i].t = l[i].t), false) AS miss FROM both_),
fronts AS (SELECT *, CASE WHEN miss IS NULL OR miss = 0 THEN n ELSE miss - 1 END AS a FROM heads),
tails_ AS (SELECT *, list_position(list_transform(range(1, n - a + 1), lambda i: g[len(g) + 1 - i].t = l[len(l) + 1 - i].t), false) AS back FROM fronts),
ends AS (SELECT *, CASE WHEN back IS NULL OR back = 0 THEN n - a ELSE back - 1 END AS b FROM tails_),
aligned AS (SELECT lib, doc_id, line_no, failed, g, l, len(g) AS gc, len(l) AS lc, CASE WHEN failed THEN 0 ELSE a END AS prefix, CASE WHEN failed THEN 0 ELSE b END AS suffix FROM ends)"""
SCORED = f"({nv('g[i].o')} >= 2 AND NOT regexp_matches(g[i].o, '[ёЁ-]') AND g[i].p IS NOT NULL)"
METRICS = f"""pairs AS (SELECT *, list_concat(list_transform(range(1, prefix + 1), lambda i: struct_pack(i := i, j := i)), list_transform(range(1, suffix + 1), lambda k: struct_pack(i := gc - suffix + k, j := lc - suffix + k))) AS ps FROM aligned),
flags AS (SELECT *, list_filter(ps, lambda q: {SCORED.replace('g[i]', 'g[q.i]')}) AS sc FROM pairs),
checks AS (SELECT *, list_filter(sc, lambda q: l[q.j].p IS NOT NULL) AS ck FROM flags),
sm AS (SELECT lib, doc_id, line_no, gc, lc, failed, ck, g, l, len(ps) AS matched, CASE WHEN failed THEN 0 ELSE gc + lc - 2 * len(ps) END AS loose, len(list_filter(ck, lambda q: g[q.i].p <> l[q.j].p)) AS wrong, len(sc) - len(ck) AS lacking, len(sc) AS scored FROM checks)"""
BASE = f"WITH {SENT}, {MARKED}, {ALIGNED}, {METRICS}"
DICT = f"""forms AS (SELECT DISTINCT replace(lower(w), 'ё', 'е') AS form FROM (SELECT unnest(regexp_extract_all(translate(text, '{LATIN}', '{CYRILLIC}'), '({W}+)')) AS w FROM benchmark)),
dict AS (SELECT form, {vowel_at('form', f"(len(form) % {nv('form')})")} - 1 AS main, CASE WHEN len(form) % 5 = 0 THEN {vowel_at('form', '0')} - 1 END AS other FROM forms WHERE {nv('form')} > 0),
entries AS (SELECT form, list_sort(list_distinct(list_filter([main, other], lambda x: x IS NOT NULL))) AS positions FROM dict)"""
TOTAL_COLUMNS = "CAST(count(*) AS BIGINT) AS sentences, CAST(count_if(loose > 0) AS BIGINT) AS sentences_unmatched, CAST(count_if(failed AND lib = 'near') AS BIGINT) AS exceptions, CAST(sum(matched) AS BIGINT) AS matched_pairs, CAST(sum(CASE WHEN gc = lc AND gc > 0 THEN 0 ELSE loose END) AS BIGINT) AS unmatched_diff, CAST(sum(CASE WHEN gc = lc AND gc > 0 THEN loose ELSE 0 END) AS BIGINT) AS unmatched_same, CAST(sum(wrong) AS BIGINT) AS stress_errors, CAST(sum(lacking) AS BIGINT) AS missing_stress, CAST(sum(scored) AS BIGINT) AS gold_words_with_stress"
COMMON = """ck AS (SELECT lib, doc_id, line_no, unnest(list_transform(ck, lambda q: struct_pack(i := q.i, bad := g[q.i].p <> l[q.j].p))) AS c FROM sm),
shared AS (SELECT doc_id, line_no, c.i AS i FROM ck GROUP BY ALL HAVING count(DISTINCT lib) = 3),
common AS (SELECT lib, CAST(count(*) AS BIGINT) AS common, CAST(count_if(c.bad) AS BIGINT) AS errors FROM ck JOIN shared s ON ck.doc_id = s.doc_id AND ck.line_no = s.line_no AND ck.c.i = s.i GROUP BY lib)"""


# -- Queries ----------------------------------------------------------------------------------


def _evaluation(spark: SparkSession, sf_dir: str) -> evaluate.Evaluation:
    own = derived.sentences(spark, sf_dir)
    return evaluate.evaluate(own.select(*KEYS, derived.gold_text().alias("text")), derived.annotated(own), KEYS, LIBS)


@query(f"WITH {SENT} SELECT doc_id, line_no, text FROM sent")
def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived.sentences(spark, sf_dir)


@query(f"WITH {SENT}, {MARKED} SELECT doc_id, line_no, {MARKS_ONLY} AS plus_text, replace(text, '+', '') AS clean, CAST(len({MARKS_ONLY}) - len(replace(text, '+', '')) AS INTEGER) AS n_marks FROM gold")
def marks_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pluses to acutes and back, and the text without marks."""
    return derived.round_trips(spark, sf_dir)


@query(f"WITH {SENT}, {MARKED}, own AS (SELECT doc_id, line_no, string_split({MARKS_ONLY}, '+') AS l FROM gold), parts AS (SELECT doc_id, line_no, unnest(l) AS part, unnest(range(len(l))) AS k, len(l) AS n FROM own), ends AS (SELECT *, sum(len(part)) OVER (PARTITION BY doc_id, line_no ORDER BY k) AS e FROM parts) SELECT doc_id, line_no, CAST(k AS INTEGER) AS stress_no, CAST(e AS INTEGER) AS position FROM ends WHERE k < n - 1")
def stress_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = derived.sentences(spark, sf_dir).select(*KEYS, derived.gold_text().alias("marked"))
    return own.select(*KEYS, F.posexplode(marks.stress_places("marked")).alias("stress_no", "position"))


@query(f"WITH {SENT}, cuts AS (SELECT doc_id, regexp_extract_all(text, '(?s)(.*?(?:[.!?…]+{SPACE}*|\\n{{2,}})|.+$)') AS l FROM docs WHERE text IS NOT NULL), parts AS (SELECT doc_id, unnest(l) AS text, unnest(range(len(l))) AS k FROM cuts), placed AS (SELECT *, sum(len(text)) OVER (PARTITION BY doc_id ORDER BY k) - len(text) AS s FROM parts) SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY k) - 1 AS INTEGER) AS sent_no, CAST(s AS INTEGER) AS start, text FROM placed WHERE regexp_replace(text, '{SPACE}+', '', 'g') <> ''")
def sentence_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenize.split_sentences(derived.documents(spark, sf_dir))


@query(f"WITH {SENT}, {MARKED}, {CLEAN_WORDS}, known AS (SELECT *, (len(text) + doc_id) % nullif({nv('text')}, 0) AS vk FROM words) SELECT doc_id, line_no, word_no, text, start, \"end\", CASE WHEN {nv('text')} >= 2 THEN CAST({vowel_at('text', 'vk')} - 1 AS INTEGER) END AS stress_char_index, CASE WHEN {nv('text')} >= 2 THEN CAST(vk AS INTEGER) END AS stress_vowel_index, CASE WHEN {nv('text')} >= 2 THEN 'GOLD' END AS method FROM known")
def gold_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of the marked text with offsets and stress."""
    own = derived.sentences(spark, sf_dir).select(*KEYS, derived.gold_text().alias("text"))
    return extract.marked_words(own, KEYS, method="GOLD")


@query(f"WITH {SENT}, {DICT}, {WORDS} SELECT doc_id, line_no, word_no, text, (contains(text, '-') OR d.form IS NOT NULL) AS dubious FROM words LEFT JOIN (SELECT form FROM forms WHERE len(form) % 7 = 0) d ON lower(text) = d.form")
def dubious_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = tokenize.words(derived.sentences(spark, sf_dir), KEYS).select(*KEYS, "word_no", "text")
    base = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select(F.explode(F.regexp_extract_all(F.translate("text", LATIN, CYRILLIC), F.lit(f"({W}+)"), F.lit(1))).alias("w"))
    return extract.flag_dubious(own, base.select(marks.fold("w").alias("key")).filter("length(key) % 7 = 0"))


@query(f"{BASE} SELECT lib, doc_id, line_no, CAST(gc AS INTEGER) AS gold_count, CAST(lc AS INTEGER) AS lib_count, CAST(prefix AS INTEGER) AS prefix, CAST(suffix AS INTEGER) AS suffix FROM aligned")
def alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = derived.sentences(spark, sf_dir)
    found = evaluate.aligned(own.select(*KEYS, derived.gold_text().alias("text")), derived.annotated(own), KEYS, LIBS)
    return found.select("lib", *KEYS, "gold_count", "lib_count", "prefix", "suffix")


@query(f"{BASE} SELECT lib, doc_id, line_no, CAST(matched AS INTEGER) AS matched_pairs, CAST(CASE WHEN gc = lc AND gc > 0 THEN 0 ELSE loose END AS INTEGER) AS unmatched_diff, CAST(CASE WHEN gc = lc AND gc > 0 THEN loose ELSE 0 END AS INTEGER) AS unmatched_same, loose > 0 AS has_unmatched, CAST(wrong AS INTEGER) AS stress_errors, CAST(lacking AS INTEGER) AS missing_stress, CAST(scored AS INTEGER) AS gold_words_with_stress, failed AS lib_error FROM sm")
def sentence_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _evaluation(spark, sf_dir).sentences.select("lib", *KEYS, "matched_pairs", "unmatched_diff", "unmatched_same", "has_unmatched", "stress_errors", "missing_stress", "gold_words_with_stress", "lib_error")


@query(f"{BASE} SELECT lib, {TOTAL_COLUMNS} FROM sm GROUP BY lib")
def library_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _evaluation(spark, sf_dir).totals


@query(f"{BASE} SELECT lib, {TOTAL_COLUMNS} FROM sm GROUP BY ROLLUP (lib)")
def grand_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _evaluation(spark, sf_dir).grand_totals


@query(f"{BASE}, {COMMON} SELECT lib, common, errors FROM common")
def common_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _evaluation(spark, sf_dir).common


@query(f"{BASE}, {COMMON} SELECT lib, common, errors, round((common - errors) / common, 4) AS accuracy FROM common")
def accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _evaluation(spark, sf_dir).accuracy


@query(f"{BASE}, {COMMON} SELECT count(DISTINCT common) <= 1 AS consistent, min(common) AS common FROM common")
def consistency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.consistent(_evaluation(spark, sf_dir).common)


@query(f"{BASE}, {COMMON}, totals AS (SELECT lib, {TOTAL_COLUMNS} FROM sm GROUP BY lib) SELECT t.*, common, errors AS common_errors, 0.0::DOUBLE AS load_time_seconds, 0.0::DOUBLE AS process_time_seconds FROM totals t JOIN common c ON t.lib = c.lib")
def report_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the Markdown reports are written from; both of its parts read the sentences' counts, stored once."""
    own = _evaluation(spark, sf_dir).stored()
    return report.report_rows(own.totals, own.common)


@query(f"WITH {DICT} SELECT form, array_to_string(positions, ',') AS positions FROM entries")
def stress_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dictionary, by way of its JSON variants."""
    own = derived.dictionary(spark, sf_dir)
    keys = F.transform("positions", lambda p: F.concat(F.substr("form", F.lit(1), p), F.lit("+"), F.substr("form", p + 1)))
    raw = own.select(F.col("form").alias("word"), F.to_json(F.map_from_arrays(keys, F.transform("positions", lambda p: F.lit(0.5)))).alias("variants_json"))
    return dictionary.decode(raw).select("form", F.concat_ws(",", F.col("positions").cast("array<string>")).alias("positions"))


CASCADE = f"""asked AS (SELECT DISTINCT text FROM words),
known AS (SELECT text, {nv('text')} AS n, e.positions AS ps, strpos(text, 'ё') AS y1, strpos(text, 'Ё') AS y2 FROM asked LEFT JOIN entries e ON replace(lower(text), 'ё', 'е') = e.form),
tried AS (SELECT *, CASE WHEN y1 > 0 THEN y1 - 1 WHEN y2 > 0 THEN y2 - 1 WHEN n = 0 THEN NULL WHEN ps IS NOT NULL THEN ps[1] END AS at1, CASE WHEN y1 + y2 > 0 THEN 'YO' WHEN n = 0 THEN 'NON_WORD' WHEN len(ps) = 1 THEN 'DICT_SINGLE' WHEN len(ps) > 1 THEN 'DICT_MULTI' ELSE 'UNKNOWN' END AS m1 FROM known),
part AS (SELECT text, unnest(string_split(text, '-')) AS p, unnest(range(len(string_split(text, '-')))) AS k, string_split(text, '-') AS l FROM tried WHERE contains(text, '-') AND at1 IS NULL),
placed AS (SELECT *, k + CASE WHEN k = 0 THEN 0 ELSE list_sum(list_transform(l[1:k], lambda x: len(x))) END AS o FROM part),
hit AS (SELECT p.*, CASE WHEN strpos(p, 'ё') > 0 THEN strpos(p, 'ё') - 1 WHEN strpos(p, 'Ё') > 0 THEN strpos(p, 'Ё') - 1 ELSE e.positions[1] END + o AS place, CASE WHEN regexp_matches(p, '[ёЁ]') THEN 'YO' WHEN len(e.positions) = 1 THEN 'DICT_SINGLE' ELSE 'DICT_MULTI' END AS m FROM placed p LEFT JOIN entries e ON replace(lower(p), 'ё', 'е') = e.form WHERE regexp_matches(p, '[ёЁ]') OR (e.form IS NOT NULL AND {nv('p')} > 0)),
first_hit AS (SELECT text, min(place) AS at2, arg_min(m, place) AS m2, count(*) - 1 AS more FROM hit GROUP BY text),"""
#: Parts that nothing resolves go to the heuristic one by one; a word without hyphens as a whole.
FIRST_VOWELS = f"""guess AS (SELECT text, o + {vowel_at('w', '0')} - 1 AS g FROM (SELECT text, o, p AS w FROM placed) WHERE {nv('w')} > 0),
whole AS (SELECT text, {vowel_at('text', '0')} - 1 AS g FROM tried WHERE NOT contains(text, '-') AND n > 0 AND at1 IS NULL),"""
DONE = """late AS (SELECT text, min(g) AS at4, count(*) - 1 AS more4 FROM (SELECT * FROM guess UNION ALL SELECT * FROM whole) GROUP BY text),
done AS (SELECT t.text, CAST(coalesce(at1, at2, at4) AS INTEGER) AS at3, CASE WHEN at1 IS NOT NULL THEN m1 WHEN at2 IS NOT NULL THEN m2 WHEN at4 IS NOT NULL THEN 'HEURISTIC' ELSE m1 END AS m, CAST(CASE WHEN at1 IS NOT NULL THEN 0 WHEN at2 IS NOT NULL THEN more WHEN at4 IS NOT NULL THEN more4 ELSE 0 END AS INTEGER) AS n_sub FROM tried t LEFT JOIN first_hit h ON t.text = h.text LEFT JOIN late ON t.text = late.text)"""


def _resolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = tokenize.words(derived.sentences(spark, sf_dir), KEYS)
    return cascade.resolve(own, derived.dictionary(spark, sf_dir), [*KEYS, "word_no"], late_parts=True)


@query(f"WITH {SENT}, {DICT}, {WORDS}, {CASCADE} {FIRST_VOWELS} {DONE} SELECT doc_id, line_no, word_no, w.text, at3 AS stress_char_index, m AS method, n_sub FROM words w JOIN done d ON w.text = d.text")
def resolver_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every word of `documents` stressed by rules, dictionary and first vowel."""
    return _resolved(spark, sf_dir).select(*KEYS, "word_no", "text", "stress_char_index", "method", F.size("sub_stresses").alias("n_sub"))


@query(f"WITH {SENT}, {DICT}, {WORDS} SELECT doc_id, line_no, coalesce(bool_or(len(e.positions) > 1), false) AS needs_bert FROM words w LEFT JOIN entries e ON replace(lower(text), 'ё', 'е') = e.form GROUP BY doc_id, line_no")
def scorer_routing(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = dictionary.look_up(tokenize.words(derived.sentences(spark, sf_dir), KEYS, folded=True), derived.dictionary(spark, sf_dir), folded="folded")
    return cascade.route(own, KEYS)


LCP = "len(list_filter(range(1, least(len({a}), len({b})) + 1), lambda i: left({a}, i) = left({b}, i)))"
OOV = f"""vocab AS (SELECT form, array_to_string(positions, ',') AS ps, row_number() OVER (ORDER BY form) AS r FROM entries),
q AS (SELECT DISTINCT replace(lower(x), 'ё', 'е') AS q FROM (SELECT unnest(string_split(text, '-')) AS x FROM (SELECT DISTINCT text FROM words)) WHERE x <> '' AND replace(lower(x), 'ё', 'е') NOT IN (SELECT form FROM entries)),
rank AS (SELECT q, count(form) AS p FROM q LEFT JOIN vocab ON form < q GROUP BY q),
base AS (SELECT q, form, ps, {LCP.format(a='q', b='form')} AS n FROM rank JOIN vocab ON r BETWEEN p AND p + 2),
most AS (SELECT q, max(n) AS most FROM base GROUP BY q HAVING max(n) >= 3),
near AS (SELECT DISTINCT q, form, ps, n FROM base UNION SELECT m.q, form, ps, {LCP.format(a='m.q', b='form')} FROM most m JOIN vocab ON starts_with(form, left(m.q, most))),
s AS (SELECT '' AS x UNION SELECT right(form, 1) FROM entries UNION SELECT right(form, 2) FROM entries WHERE len(form) >= 2),
tails AS (SELECT a.x AS word_suffix, b.x AS norm_suffix FROM s a JOIN s b ON len(a.x) = len(b.x)),
good AS (SELECT q, max(struct_pack(n := n, form := form, ps := ps)) AS best FROM near JOIN tails ON substr(q, n + 1) = word_suffix AND substr(form, n + 1) = norm_suffix GROUP BY q)"""


@query(f"WITH {SENT}, {DICT}, {WORDS}, {OOV} SELECT q.q AS query, CASE WHEN best IS NOT NULL AND CAST(string_split(best.ps, ',')[-1] AS INTEGER) < best.n THEN CAST(string_split(best.ps, ',')[-1] AS INTEGER) ELSE -1 END AS position FROM q LEFT JOIN good ON q.q = good.q")
def unknown_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stress of all words, and parts of words at hyphens, outside of the dictionary by their neighbours in it."""
    known, forms, tails = _unknown(spark, sf_dir)
    asked = derived.words(spark, sf_dir, folded=True, parts=True).select(F.col("word").alias("query"))
    return oov.predict(asked.join(known.select(F.col("form").alias("query")), "query", "left_anti"), forms, tails)


def _unknown(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The dictionary, its forms with places as text, and pairs of its forms' ends of a length, stored: they
    are read several times."""
    known = keep(derived.dictionary(spark, sf_dir), "dictionary")
    ends = keep(known.select(F.explode(F.array(F.lit(""), F.expr("right(form, 1)"), F.expr("if(length(form) >= 2, right(form, 2), '')"))).alias("x")).distinct(), "ends")
    tails = ends.select(F.col("x").alias("word_suffix"), F.length("x").alias("n")).join(ends.select(F.col("x").alias("norm_suffix"), F.length("x").alias("n")), "n")
    return known, known.select("form", F.concat_ws(",", F.col("positions").cast("array<string>")).alias("positions")), tails


@query(f"WITH {SENT}, {MARKED} SELECT doc_id, line_no, {MARKS_ONLY} AS text FROM gold")
def rendered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Marked text taken apart into spans and written again."""
    own = derived.sentences(spark, sf_dir).select(*KEYS, derived.gold_text().alias("text"))
    parts = tokenize.spans(own, KEYS, marked=True)
    return render.annotated(parts.withColumn("sub_stresses", F.array().cast("array<int>")), KEYS, ["span_no"])


@query(f"WITH {SENT}, {WORDS} SELECT DISTINCT text, array_to_string(list_transform(string_split(replace(lower(text), '+', ''), ''), lambda c: CASE WHEN strpos(' абвгдеёжзийклмнопрстуфхцчшщъыьэюя', c) = 0 THEN 0 ELSE strpos(' абвгдеёжзийклмнопрстуфхцчшщъыьэюя', c) + 2 END), ',') AS ids FROM words")
def sign_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = derived.words(spark, sf_dir).select(F.col("word").alias("text"))
    return own.select("text", F.concat_ws(",", wordpiece.encode_signs("text").cast("array<string>")).alias("ids"))


@query("SELECT page_id, regexp_replace(html, '<(/?)([a-zA-Z][a-zA-Z0-9]*)[^>]*?(/?)>', '', 'g') AS clean FROM pages")
def without_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", ssml.without_tags("html").alias("clean"))


@query(f"WITH t AS (SELECT role, turn, unnest(regexp_extract_all(translate(text, '{LATIN}', '{CYRILLIC}'), '({W}+)')) AS w FROM conversations) SELECT role, turn, count(*) AS n_words, CAST(sum({nv('w')}) AS BIGINT) AS n_vowels, CAST(count_if({nv('w')} >= 2 AND NOT regexp_matches(w, '[ёЁ]')) AS BIGINT) AS n_stressable FROM t GROUP BY role, turn")
def conversation_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    own = base.select("role", "turn", F.explode(F.regexp_extract_all(F.translate("text", LATIN, CYRILLIC), F.lit(f"({W}+)"), F.lit(1))).alias("w"))
    return own.groupBy("role", "turn").agg(F.count(F.lit(1)).alias("n_words"), F.sum(marks.count_vowels("w")).cast("long").alias("n_vowels"), F.count_if(marks.needs_stress("w")).alias("n_stressable"))


@query("SELECT doc_id, sha256(text) AS digest FROM documents")
def text_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.sha2("text", 256).alias("digest"))

