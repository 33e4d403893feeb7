"""Registered queries of files, models' inputs and the engine as a whole, and what each is in SQL.

Their inputs are derived from the test tables by rules that SQL can state too. Fixtures are written
to the shared folder by the executors and read back by the package's own sources.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from akzentor.engine import StressEngine
from akzentor.functions import marks
from akzentor.functions.alphabet import ACUTE, CYRILLIC, LATIN, MODEL_LETTERS, NOT_W, VOWELS, VOWELS_LOWER, V, W
from akzentor.operators import annotators, dictionary, morph, render, scorers, ssml, tokenize, wordpiece
from akzentor.plans import derived, report
from akzentor.plans.derived import KEYS
from akzentor.plans.queries import CASCADE, COMMON, BASE, DICT, DONE, MARKED, MARKS_ONLY, OOV, ORACLE_SQL, QUERIES, SENT, SPACE, TOTAL_COLUMNS, WORDS, _evaluation, _unknown, nv, plus_at, query, vowel_at
from akzentor.sources import lexicons, results
from akzentor.sources.scratch import work_path
from akzentor.sources.text import read_text

__all__ = ["ORACLE_SQL", "QUERIES"]

ITEMS = f"items AS (SELECT item_id, translate(text, '{LATIN}', '{CYRILLIC}') AS text FROM benchmark WHERE text IS NOT NULL)"


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(item_id, text) of `benchmark`, read as Cyrillic."""
    return spark.read.parquet(f"{sf_dir}/benchmark.parquet").filter("text is not null").select("item_id", F.translate("text", LATIN, CYRILLIC).alias("text"))


# -- Files ------------------------------------------------------------------------------------


def _write_files(rows: DataFrame, path: str, encodings: tuple[str, ...]) -> None:
    """rows(name, kind, text): a file each, in the encoding of that number; written where the rows are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            there, base = fs.FileSystem.from_uri(path)
            there.create_dir(base, recursive=True)
            for name, kind, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                with there.open_output_stream(f"{base}/{name}") as out:
                    out.write(text.encode(encodings[kind], "replace"))
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], names=["n"])

    rows.select("name", "kind", "text").mapInArrow(run, "n long").write.format("noop").mode("overwrite").save()


PLAIN = "regexp_replace(replace(text, 'ё', 'е'), '[^а-яА-Я .,!?-]', '', 'g')"


@query(f"WITH {ITEMS}, own AS (SELECT item_id, regexp_replace({PLAIN}, '^ +| +$', '', 'g') AS text FROM items) SELECT CAST(item_id AS BIGINT) AS item_id, 0 AS line_no, 'первая ' || text AS text FROM own UNION ALL SELECT item_id, 1, 'вторая' FROM own")
def text_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every item of `benchmark` as a file in UTF-8 or an older encoding, read back as lines."""
    path = work_path(spark, "texts")
    plain = F.regexp_replace(F.regexp_replace(F.replace("text", F.lit("ё"), F.lit("е")), "[^а-яА-Я .,!?-]", ""), "^ +| +$", "")
    text = F.concat(F.lit("  первая "), plain, F.lit("\r\n \nвторая\n"))
    _write_files(_items(spark, sf_dir).select(F.concat("item_id", F.lit(".txt")).alias("name"), (F.col("item_id") % 2).cast("int").alias("kind"), text.alias("text")), path, ("utf-8", "cp1251"))
    own = tokenize.lines(read_text(spark, f"{path}/*.txt"), key="path")
    return own.select(F.regexp_extract("path", r"(\d+)\.txt$", 1).cast("long").alias("item_id"), "line_no", "text")


@query(f"WITH {DICT}, own AS (SELECT form, array_to_string(positions, ',') AS positions FROM entries) SELECT source, form, positions FROM own, (SELECT unnest(['parquet', 'legacy', 'forms']) AS source) UNION ALL SELECT 'dubious', form, NULL FROM entries WHERE len(form) % 7 = 0 UNION ALL SELECT 'tails', right(form, 1) || '>' || right(form, 2), NULL FROM entries GROUP BY ALL UNION ALL SELECT 'vocabulary', form, CAST(row_number() OVER (ORDER BY form) - 1 AS VARCHAR) FROM entries WHERE len(form) <= 4")
def lexicon_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dictionary in each of its file forms, the word lists and a vocabulary, written and read back."""
    base = work_path(spark, "lexicons")
    own = derived.dictionary(spark, sf_dir)
    keys = F.transform("positions", lambda p: F.concat(F.substr("form", F.lit(1), p), F.lit("+"), F.substr("form", p + 1)))
    raw = own.select(F.col("form").alias("word"), F.to_json(F.map_from_arrays(keys, F.transform("positions", lambda p: F.lit(0.5)))).alias("variants_json"))
    raw.write.parquet(f"{base}/words.pq")
    raw.select(F.concat_ws("\t", F.lit("1"), "word", "variants_json").alias("value")).unionByName(spark.createDataFrame([("broken\tline",), ("2\tх\tno json",)], "value string")).write.text(f"{base}/old.vcb")
    joined = F.concat_ws(",", F.col("positions").cast("array<string>"))
    own.select("form", joined.alias("positions")).write.parquet(f"{base}/forms.pq")
    own.select(F.expr("right(form, 1)").alias("a"), F.expr("right(form, 2)").alias("b")).distinct().write.parquet(f"{base}/tails.pq")
    own.filter("length(form) % 7 = 0").select(F.concat("form", F.lit("\tx")).alias("value")).write.text(f"{base}/dubious.tsv")
    own.filter("length(form) <= 4").select("form").coalesce(1).sortWithinPartitions("form").write.text(f"{base}/vocab")
    decoded = lambda rows: dictionary.decode(rows).select("form", joined.alias("positions"))
    none = F.lit(None).cast("string").alias("positions")
    vocabulary = spark.read.text(f"{base}/vocab/part-*.txt", wholetext=True).select(F.posexplode(F.split(F.regexp_replace("value", "\n$", ""), "\n")).alias("n", "form")).select("form", F.col("n").cast("string").alias("positions"))
    found = {
        "parquet": decoded(lexicons.read_stress_dictionary(spark, f"{base}/words.pq")), "legacy": decoded(lexicons.read_legacy_dictionary(spark, f"{base}/old.vcb")), "forms": lexicons.read_forms(spark, f"{base}/forms.pq"),
        "dubious": lexicons.read_dubious(spark, f"{base}/dubious.tsv").select(F.col("key").alias("form"), none), "vocabulary": vocabulary.filter("form <> ''"),
        "tails": lexicons.read_tails(spark, f"{base}/tails.pq").select(F.concat("word_suffix", F.lit(">"), "norm_suffix").alias("form"), none),
    }
    out = None
    for source, rows in found.items():
        rows = rows.select(F.lit(source).alias("source"), "form", "positions")
        out = rows if out is None else out.unionByName(rows)
    return out


TAG_OF = "CASE WHEN k % 2 = 0 THEN 'nominative singular' ELSE 'genitive plural' END"
MORPH_RECORDS = f"recs AS (SELECT form, CAST(k AS INTEGER) AS ordinal, CASE len(form) % 3 WHEN 0 THEN 'noun' WHEN 1 THEN 'verb' ELSE 'adjective' END AS pos, k, {TAG_OF} AS tags, substr(form, 1, ps[k + 1] + 1) || '{ACUTE}' || substr(form, ps[k + 1] + 2) AS stressed_form FROM (SELECT form, positions AS ps, unnest(range(len(positions))) AS k FROM entries))"


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(form, records): the dictionary's places as morphological records, tags by their number."""
    own = derived.dictionary(spark, sf_dir)
    n = F.length("form") % 3
    pos = F.when(n == 0, "noun").when(n == 1, "verb").otherwise("adjective")
    tags = lambda k: F.when(k % 2 == 0, F.array(F.lit("nominative"), F.lit("singular"))).otherwise(F.array(F.lit("genitive"), F.lit("plural")))
    form = lambda p: F.concat(F.substr("form", F.lit(1), p + 1), F.lit(ACUTE), F.substr("form", p + 2))
    return own.select("form", F.transform("positions", lambda p, k: F.struct(pos.alias("pos"), tags(k).alias("morph_tags"), form(p).alias("stressed_form"))).alias("records"))


@query(f"WITH {DICT}, {MORPH_RECORDS} SELECT source, form, ordinal, pos, tags, stressed_form FROM recs, (SELECT unnest(['parquet', 'lines']) AS source)")
def morph_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The morphological index as Parquet and as JSON lines, written and read back."""
    base, own = work_path(spark, "morph"), _records(spark, sf_dir)
    own.select("form", F.to_json("records").alias("r")).write.parquet(f"{base}/morph.pq")
    own.select(F.concat(F.lit("["), F.to_json(F.array("form")).substr(F.lit(2), F.length(F.to_json(F.array("form"))) - 2), F.lit(", "), F.to_json("records"), F.lit("]")).alias("value")).unionByName(spark.createDataFrame([("",), ("broken",)], "value string")).write.text(f"{base}/morph.jsonl")
    rows = lexicons.read_morphology(spark, f"{base}/morph.pq").withColumn("source", F.lit("parquet")).unionByName(lexicons.read_morphology_lines(spark, f"{base}/morph.jsonl").withColumn("source", F.lit("lines")))
    return rows.select("source", "form", "ordinal", "pos", F.array_join("morph_tags", " ").alias("tags"), "stressed_form")


@query(f"WITH {ITEMS}, own AS (SELECT *, regexp_extract_all(text, '({W}+)') AS l FROM items), w AS (SELECT item_id, unnest(l) AS word, unnest(range(len(l))) AS k FROM own) SELECT lib, CAST(item_id AS BIGINT) AS item_id, CAST(k AS INTEGER) AS word_no, word AS text, CASE WHEN {nv('word')} > 0 THEN CAST({vowel_at('word', 'CASE WHEN lib = $$GOLD$$ THEN 0 ELSE ' + nv('word') + ' - 1 END')} - 1 AS INTEGER) END AS stress_char_index FROM w, (SELECT unnest(['GOLD', 'last']) AS lib)".replace("$$", "'"))
def result_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results of the gold standard and of an annotator as JSON documents, a file for each item, read back
    as a folder."""
    base = work_path(spark, "results")
    own = _items(spark, sf_dir).withColumn("lib", F.explode(F.array(F.lit(results.GOLD), F.lit("last"))))
    n = lambda w: marks.count_vowels(w)
    at = lambda w: F.when(n(w) > 0, marks.nth_vowel(w, F.when(F.col("lib") == results.GOLD, F.lit(0)).otherwise((n(w) - 1).cast("int"))))
    word = F.transform(F.regexp_extract_all("text", F.lit(f"({W}+)"), F.lit(1)), lambda w: F.struct(w.alias("text"), F.lit(0).alias("start"), F.length(w).alias("end"), F.lit("GOLD").alias("method"), at(w).alias("stress_char_index")))
    sentence = F.array(F.struct(F.col("item_id").cast("string").alias("original_text"), F.array().cast(results.ERRORS).alias("errors"), word.alias("words")))
    doc = F.to_json(F.struct(F.struct(F.when(F.col("lib") == results.GOLD, F.col("lib")).alias("library_name")).alias("metadata"), sentence.alias("sentences")))
    gold, last = F.col("lib") == results.GOLD, F.col("lib") != results.GOLD
    for test, name in ((gold, F.concat(F.lit("GOLD-"), "item_id", F.lit("_results.json"))), (last, F.concat("item_id", F.lit("/last_results.json")))):
        _write_nested(own.filter(test).select(name.alias("name"), doc.alias("text")), base)
    gold_rows = results.read_results(spark, f"{base}/GOLD-*_results.json")
    rows = gold_rows.unionByName(results.read_results(spark, f"{base}/*/last_results.json"))
    ids = rows.select("lib", F.col("original_text").cast("long").alias("item_id"), F.posexplode("words").alias("word_no", "w"))
    return ids.select("lib", "item_id", "word_no", "w.text", "w.stress_char_index")


def _write_nested(rows: DataFrame, path: str) -> None:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            there, base = fs.FileSystem.from_uri(path)
            for name, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                there.create_dir(f"{base}/{name}".rpartition("/")[0], recursive=True)
                with there.open_output_stream(f"{base}/{name}") as out:
                    out.write(text.encode())
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], names=["n"])

    rows.mapInArrow(run, "n long").write.format("noop").mode("overwrite").save()


# -- Output forms -----------------------------------------------------------------------------


def _gold_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = derived.sentences(spark, sf_dir).select(*KEYS, derived.gold_text().alias("text"))
    parts = tokenize.spans(own, KEYS, marked=True)
    parts = parts.withColumns({"method": F.when(F.col("stress_char_index").isNotNull(), "GOLD"), "sub_stresses": F.array().cast("array<int>")})
    return parts.drop("raw")


@query(f"WITH {SENT}, {MARKED} SELECT doc_id, line_no, regexp_replace({MARKS_ONLY}, '\\+({V})', '\\1{ACUTE}', 'g') AS text FROM gold")
def stress_marked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences with an acute after each stressed vowel."""
    return render.stress_marks(_gold_spans(spark, sf_dir), KEYS, ["span_no"])


GOLD_WORDS = f"known AS (SELECT *, (len(text) + doc_id) % nullif({nv('text')}, 0) AS vk FROM words)"


@query(f"WITH {SENT}, {MARKED}, {WORDS.replace('FROM sent', 'FROM bare').replace('spans AS', 'bare AS (SELECT doc_id, line_no, replace(text, $$+$$, $$$$) AS text FROM sent), spans AS')}, {GOLD_WORDS} SELECT doc_id, line_no, word_no, text, start, \"end\", CASE WHEN {nv('text')} >= 2 THEN 'GOLD' END AS method, CASE WHEN {nv('text')} >= 2 THEN CAST({vowel_at('text', 'vk')} - 1 AS INTEGER) END AS char_index, CASE WHEN {nv('text')} >= 2 THEN CAST(vk AS INTEGER) END AS vowel_index FROM known".replace("$$", "'"))
def json_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in the JSON form, taken apart again into words; sentences stand by their number."""
    own = derived.documents(spark, sf_dir).select("doc_id", tokenize.span_arrays(derived.gold_lines(), marked=True).alias("spans"))
    body = "struct<text:string,sentences:array<struct<sentence:int,text:string,words:array<struct<text:string,start:int,end:int,method:string,stress_vowel_index:int,stress_char_index:int>>>>>"
    docs = render.documents_json(own, ["doc_id"], "GOLD").select("doc_id", F.from_json("json", body).alias("j"))
    sents = docs.select("doc_id", F.explode("j.sentences").alias("s"))
    rows = sents.select("doc_id", F.col("s.sentence").alias("line_no"), F.posexplode("s.words").alias("word_no", "w"))
    return rows.select("doc_id", "line_no", "word_no", "w.text", "w.start", "w.end", "w.method", F.col("w.stress_char_index").alias("char_index"), F.col("w.stress_vowel_index").alias("vowel_index"))


@query(f"WITH {SENT}, {MARKED}, own AS (SELECT doc_id, line_no, regexp_extract_all({MARKS_ONLY}, '([^+{W[1:-1]}]+|(?:\\+|{W})+)') AS l FROM gold), parts AS (SELECT doc_id, line_no, unnest(l) AS p, unnest(range(len(l))) AS k, l FROM own) SELECT doc_id, line_no, CASE WHEN k > 0 THEN l[k] ELSE '' END AS before, p AS word, CAST(row_number() OVER (PARTITION BY doc_id, line_no ORDER BY k) - 1 AS INTEGER) AS entry FROM parts WHERE regexp_matches(p, '{W}')")
def word_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The word list form: what stands before each word, and the word with its plus."""
    own = render.word_list(_gold_spans(spark, sf_dir), KEYS, ["span_no"])
    return own.select(*KEYS, F.posexplode("words").alias("entry", "w")).select(*KEYS, "entry", "w.before", "w.word").filter("word <> ''")


NUMBER = "regexp_replace(replace(format('{{:,}}', CAST({} AS BIGINT)), ',', ' '), '^$', '')"
SHARE = "CASE WHEN common = 0 THEN '—' ELSE printf('%.2f%%', round(100.0 * (common - errors) / common, 2)) END"


@query(f"{BASE}, {COMMON}, totals AS (SELECT lib, {TOTAL_COLUMNS} FROM sm GROUP BY lib), own AS (SELECT t.*, common, errors FROM totals t JOIN common c ON t.lib = c.lib) SELECT language, table_no, line FROM (SELECT 1 AS table_no, '| `' || lib || '` | 0.0000 | 0.0000 | ' || CASE WHEN exceptions > 0 THEN '**' || exceptions || '** ❌' ELSE '0 ✅' END || ' |' AS line FROM own UNION ALL SELECT 2, '| `' || lib || '` | ' || {NUMBER.format('stress_errors')} || ' | ' || {NUMBER.format('missing_stress')} || ' | ' || {NUMBER.format('unmatched_diff')} || ' | ' || {NUMBER.format('unmatched_same')} || ' | ' || {NUMBER.format('sentences_unmatched')} || ' |' FROM own UNION ALL SELECT 3, '| `' || lib || '` | ' || {NUMBER.format('common')} || ' | ' || {NUMBER.format('errors')} || ' | ' || {SHARE} || ' |' FROM own), (SELECT unnest(['en', 'ru']) AS language)")
def report_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The annotators' lines of the Markdown reports' tables, in both languages."""
    found = _evaluation(spark, sf_dir).stored()
    rows = report.report_rows(found.totals, found.common)
    held = spark.createDataFrame(rows.collect(), rows.schema)  # a row an annotator
    out = []
    for language in ("en", "ru"):
        lines = [x for x in report.markdown(held, language).split("\n") if x.startswith("| `")]
        n = len(lines) // 3
        out += [(language, 1 + i // n, x) for i, x in enumerate(lines)] if n else []
    return spark.createDataFrame(out, "language string, table_no int, line string")


# -- SSML -------------------------------------------------------------------------------------

TAGGED = "own AS (SELECT doc_id, line_no, replace(replace(text, '<', ''), '>', '') AS t, (doc_id + line_no) % 4 AS rule FROM sent)"
HALF = "len(t) // 2"


def _tagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, line_no, text): sentences in which a tag encloses all, or the first half, or none."""
    own = derived.sentences(spark, sf_dir).withColumn("t", F.translate("text", "<>", ""))
    rule, half = (F.col("doc_id") + F.col("line_no")) % 4, F.floor(F.length("t") / 2).cast("int")
    text = F.when(rule == 0, F.concat(F.lit("<speak>"), "t", F.lit("</speak>"))).when(rule == 1, F.concat(F.lit('<P class="a">'), F.substr("t", F.lit(1), half), F.lit("</p><break/>"), F.substr("t", half + 1)))
    return own.select(*KEYS, text.when(rule == 2, F.concat(F.lit("</s><b>"), "t", F.lit("</b>"))).otherwise(F.col("t")).alias("text"))


@query(f"WITH {SENT}, {TAGGED} SELECT doc_id, line_no, t AS clean, CASE rule WHEN 0 THEN 'speak:0-' || len(t) || ':0-' || (len(t) + 15) WHEN 1 THEN 'p:0-' || ({HALF}) || ':0-' || ({HALF} + 17) ELSE '' END AS regions FROM own")
def ssml_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts without tags, and the regions that are to stay as they are."""
    own = ssml.extract(_tagged(spark, sf_dir))
    span = lambda r: F.concat(r["tag"], F.lit(":"), r["start"], F.lit("-"), r["end"], F.lit(":"), r["original_start"], F.lit("-"), r["original_end"])
    return own.select(*KEYS, "clean", F.array_join(F.transform("regions", span), " ").alias("regions"))


# -- The engine -------------------------------------------------------------------------------

PREDICTED = f"""said AS (SELECT q.q AS q, CASE WHEN best IS NOT NULL AND CAST(string_split(best.ps, ',')[-1] AS INTEGER) < best.n THEN CAST(string_split(best.ps, ',')[-1] AS INTEGER) ELSE -1 END AS at5 FROM q LEFT JOIN good ON q.q = good.q),
guess AS (SELECT text, o + at5 AS g FROM placed JOIN said ON replace(lower(p), 'ё', 'е') = q WHERE at5 >= 0 AND contains('{VOWELS}', substr(p, at5 + 1, 1)) AND substr(p, at5 + 1, 1) <> ''),
whole AS (SELECT text, at5 AS g FROM tried JOIN said ON replace(lower(text), 'ё', 'е') = q WHERE NOT contains(text, '-') AND n > 0 AND at1 IS NULL AND at5 >= 0 AND contains('{VOWELS}', substr(text, at5 + 1, 1)) AND substr(text, at5 + 1, 1) <> ''),"""
ENGINE_DOCS = f"""marked_docs AS (SELECT doc_id, replace(replace(text, '<', ''), '>', '') AS text, doc_id % 3 = 0 AS kept FROM docs WHERE text IS NOT NULL),
cuts AS (SELECT doc_id, kept, regexp_extract_all(text, '(?s)(.*?(?:[.!?…]+{SPACE}*|\\n{{2,}})|.+$)') AS l FROM marked_docs),
parts AS (SELECT doc_id, kept, unnest(l) AS text, unnest(range(len(l))) AS k FROM cuts),
based AS (SELECT *, sum(len(text)) OVER (PARTITION BY doc_id ORDER BY k) - len(text) AS base FROM parts),
numbered AS (SELECT doc_id, kept, text, base, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY k) - 1 AS INTEGER) AS line_no FROM based WHERE regexp_replace(text, '{SPACE}+', '', 'g') <> ''),
spans AS (SELECT doc_id, line_no, kept, base, unnest(regexp_extract_all(text, '({W}+|{NOT_W}+)')) AS w, unnest(range(len(regexp_extract_all(text, '({W}+|{NOT_W}+)')))) AS k FROM numbered),
words AS (SELECT doc_id, line_no, kept, CAST(k AS INTEGER) AS span_no, w AS text, CAST(base + sum(len(w)) OVER (PARTITION BY doc_id, line_no ORDER BY k) - len(w) AS INTEGER) AS start FROM spans)"""


@query(
    f"WITH {SENT}, {DICT}, {ENGINE_DOCS.replace('words AS (', 'every_span AS (')}, words AS (SELECT * FROM every_span WHERE regexp_matches(text, '^{W}') AND NOT kept), {CASCADE} {OOV}, {PREDICTED} {DONE} SELECT s.doc_id, s.line_no AS sent_no, s.span_no, s.text, start, regexp_matches(s.text, '^{W}') AS is_word, CASE WHEN NOT kept THEN at3 END AS stress_char_index, CASE WHEN NOT kept THEN m END AS method, CASE WHEN kept THEN 0 ELSE coalesce(n_sub, 0) END AS n_sub FROM every_span s LEFT JOIN done d ON s.text = d.text AND regexp_matches(s.text, '^{W}')"
)
def engine_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The engine over all documents, every third of which is one region to be left alone: sentences,
    spans, rules, dictionary, hyphen parts, and neighbours for what is unknown."""
    known, forms, tails = _unknown(spark, sf_dir)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").filter("text is not null").select("doc_id", F.translate(F.translate("text", LATIN, CYRILLIC), "<>", "").alias("text"))
    docs = docs.withColumn("text", F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("<speak>"), "text", F.lit("</speak>"))).otherwise(F.col("text")))
    own = StressEngine(spark, known, forms, tails).spans(docs)
    return own.select("doc_id", "sent_no", "span_no", "text", "start", "is_word", "stress_char_index", "method", F.size("sub_stresses").alias("n_sub"))


# -- Morphology -------------------------------------------------------------------------------

MORPH_TOKENS = f"t AS (SELECT item_id, unnest(regexp_extract_all(text, '({W}+)')) AS w, unnest(range(len(regexp_extract_all(text, '({W}+)')))) AS k FROM items), tokens AS (SELECT item_id, CAST(k AS INTEGER) AS word_no, w, replace(lower(w), 'ё', 'е') AS form, CASE (len(w) + k // 5) % 4 WHEN 0 THEN 'noun' WHEN 1 THEN 'verb' WHEN 2 THEN 'adjective' ELSE NULL END AS pos, CASE k % 3 WHEN 0 THEN 'nominative' WHEN 1 THEN 'genitive' END AS kase, CASE (k // 3) % 3 WHEN 0 THEN 'singular' WHEN 1 THEN 'plural' END AS num FROM t)"


@query(
    f"WITH {DICT}, {ITEMS}, {MORPH_RECORDS}, {MORPH_TOKENS}, met AS (SELECT item_id, word_no, list_distinct(list(stressed_form)) AS o, min(r.ordinal) AS first_, any_value(w) AS w, list(r.stressed_form ORDER BY ordinal) AS l FROM tokens t JOIN recs r ON t.form = r.form AND t.pos = r.pos AND (kase IS NULL OR contains(tags, kase)) AND (num IS NULL OR contains(tags, num)) GROUP BY item_id, word_no) SELECT CAST(t.item_id AS BIGINT) AS item_id, t.word_no, t.w AS text, CAST(coalesce(len(o), 0) AS INTEGER) AS n_options, coalesce(array_to_string(l, '|'), '') AS options, CASE WHEN len(o) = 1 THEN CAST(strpos(l[1], '{ACUTE}') - 2 AS INTEGER) END AS position, CASE WHEN len(o) = 1 THEN 'MORPH' ELSE 'UNKNOWN' END AS method FROM tokens t LEFT JOIN met m ON t.item_id = m.item_id AND t.word_no = m.word_no"
)
def morphology(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tagged words of `benchmark` against the records of its dictionary: the options that agree, and
    the place of single ones. Tags follow from a word's length and number."""
    own = _items(spark, sf_dir).select("item_id", F.posexplode(F.regexp_extract_all("text", F.lit(f"({W}+)"), F.lit(1))).alias("word_no", "text"))
    k, turn = F.col("word_no"), (F.length("text") + F.floor(F.col("word_no") / 5)) % 4
    pos = F.when(turn == 0, "NOUN").when(turn == 1, "VERB").when(turn == 2, "ADJ").otherwise("PUNCT")
    case = F.when(k % 3 == 0, "Nom").when(k % 3 == 1, "Gen").otherwise("Unheard")
    number = F.when(F.floor(k / 3) % 3 == 0, "Sing").when(F.floor(k / 3) % 3 == 1, "Plur").otherwise("Dual")
    tokens = own.select("item_id", "word_no", "text", pos.alias("pos"), F.create_map(F.lit("Case"), case, F.lit("Number"), number).alias("feats"))
    records = _records(spark, sf_dir).select("form", F.posexplode("records").alias("ordinal", "r")).select("form", "ordinal", "r.*")
    keys = ["item_id", "word_no"]
    found = morph.stress_options(tokens, records, keys).select(*keys, "text", "options")
    none = F.lit(None).cast("int")
    done = morph.refine(found.withColumns({"stress_char_index": none, "stress_vowel_index": none, "method": F.lit("UNKNOWN")}), found, keys)
    return done.select(*keys, "text", F.size("options").alias("n_options"), F.array_join("options", "|").alias("options"), F.col("stress_char_index").alias("position"), "method")


# -- Models -----------------------------------------------------------------------------------

#: Ids of the tokens that the word pieces' vocabulary has: four marks, then letters, letters inside words,
#: and the first and last three letters of the dictionary's forms, each in the order of its signs.
VOCAB = f"""pieces AS (SELECT 0 AS part, unnest(string_split('{MODEL_LETTERS[1:]}', '')) AS t UNION SELECT 1, '##' || unnest(string_split('{MODEL_LETTERS[1:]}', '')) UNION SELECT 2, left(form, 3) FROM forms WHERE len(form) >= 3 UNION SELECT 3, '##' || right(form, 3) FROM forms WHERE len(form) >= 4),
voc AS (SELECT t, CAST(3 + row_number() OVER (ORDER BY part, t) AS INTEGER) AS id FROM (SELECT t, min(part) AS part FROM pieces GROUP BY t))"""


def _vocabulary(spark: SparkSession, sf_dir: str) -> dict[str, int]:
    """Word pieces of the dictionary's forms: a model's vocabulary, which is bounded by its letters."""
    form = _items(spark, sf_dir).select(F.explode(F.regexp_extract_all("text", F.lit(f"({W}+)"), F.lit(1))).alias("w")).select(marks.fold("w").alias("form"))
    ends = form.select(F.explode(F.array(F.when(F.length("form") >= 3, F.struct(F.lit(2).alias("part"), F.expr("left(form, 3)").alias("t"))), F.when(F.length("form") >= 4, F.struct(F.lit(3).alias("part"), F.concat(F.lit("##"), F.expr("right(form, 3)")).alias("t"))))).alias("p")).filter("p is not null").distinct()
    letters = list(MODEL_LETTERS[1:])
    parts = {t: 0 for t in letters} | {f"##{t}": 1 for t in letters}
    for r in ends.select("p.*").toLocalIterator():
        parts[r["t"]] = min(parts.get(r["t"], 9), r["part"])
    order = sorted(parts, key=lambda t: (parts[t], t.encode()))
    return {t: i for i, t in enumerate(["[PAD]", "[UNK]", "[BOS]", "[EOS]", *order])}


PIECES = """asked AS (SELECT DISTINCT lower(text) AS w FROM words WHERE NOT contains(text, '-')),
pcut AS (SELECT w, 0 AS pos, 0 AS id, 0 AS n, true AS ok FROM asked UNION ALL SELECT w, pos + coalesce(b.k, 1000), b.id, n + 1, b.id IS NOT NULL FROM (SELECT c.w, c.pos, c.n, max(CASE WHEN v.id IS NOT NULL THEN struct_pack(k := i, id := v.id) END) AS b FROM (SELECT *, unnest(range(1, len(w) - pos + 1)) AS i FROM pcut WHERE pos < len(w) AND ok) c LEFT JOIN voc v ON v.t = CASE WHEN c.pos > 0 THEN '##' ELSE '' END || substr(c.w, c.pos + 1, i) GROUP BY c.w, c.pos, c.n)),
tok AS (SELECT w, CASE WHEN bool_and(ok) AND len(w) <= 100 THEN list(struct_pack(id := id, pos := pos) ORDER BY n) FILTER (n > 0) ELSE [struct_pack(id := 1, pos := len(w))] END AS l FROM pcut GROUP BY w)"""


@query(f"WITH RECURSIVE {SENT}, {DICT}, {WORDS}, {VOCAB}, {PIECES} SELECT w AS word, array_to_string(list_transform(l, lambda x: x.id), ',') AS ids FROM tok")
def word_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word pieces of every word of `documents`."""
    own = tokenize.words(derived.sentences(spark, sf_dir), KEYS).filter(~F.contains("text", F.lit("-"))).select(F.lower("text").alias("word")).distinct()
    coded = wordpiece.encode(own, _vocabulary(spark, sf_dir), "word")
    place = F.col("places")[0]
    return coded.select("word", F.concat_ws(",", F.slice("ids", place["first"] + 1, place["last"] - place["first"]).cast("array<string>")).alias("ids"))


STUB = "list_transform(range(10), lambda c: (id * 31 + c * 17) % 23)"


@query(
    f"""WITH RECURSIVE {SENT}, {DICT}, {WORDS}, {VOCAB}, {PIECES},
amb AS (SELECT DISTINCT lower(text) AS w, e.positions AS ps FROM words JOIN entries e ON replace(lower(text), 'ё', 'е') = e.form WHERE len(e.positions) > 1 AND NOT regexp_matches(text, '[ёЁ-]')),
pieces_ AS (SELECT amb.w, ps, unnest(l) AS x, unnest(range(len(l))) AS k, l FROM amb JOIN tok ON amb.w = tok.w),
named AS (SELECT w, ps, k, x.id AS id, CASE WHEN k = 0 THEN 0 ELSE l[k].pos END AS o, v.t AS t FROM pieces_ LEFT JOIN voc v ON v.id = x.id),
own_ AS (SELECT w, ps, k, id, o, {STUB} AS g, list_filter(range(0, len(regexp_replace(t, '^##', ''))), lambda p: contains('{VOWELS_LOWER}', substr(regexp_replace(t, '^##', ''), p + 1, 1))) AS vs FROM named WHERE t IS NOT NULL),
scored_ AS (SELECT w, k, o + vs[j] AS place, g[j + 1] - list_max(g) AS score, j FROM (SELECT *, unnest(range(1, least(len(vs), 9) + 1)) AS j FROM own_) WHERE list_contains(ps, o + vs[j])),
best_ AS (SELECT w, arg_max(place, struct_pack(s := score, k := -k, j := -j)) AS place FROM scored_ GROUP BY w)
SELECT w AS word, CAST(place AS INTEGER) AS position FROM best_"""
)
def homograph_choices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every ambiguous word of `documents` as a sentence of its own, routed to the stand-in scorer and
    its choice taken over by the resolvers."""
    vocabulary, known = _vocabulary(spark, sf_dir), derived.dictionary(spark, sf_dir)
    own = tokenize.words(derived.sentences(spark, sf_dir), KEYS).filter(~F.contains("text", F.lit("-"))).select(F.lower("text").alias("text")).distinct().withColumn("word", F.col("text"))
    return StressEngine(spark, known, scorer=scorers.StubScorer(), vocabulary=vocabulary).choices(own, ["word"]).select("word", "position")


@query(f"WITH {SENT}, {WORDS}, u AS (SELECT DISTINCT replace(lower(text), 'ё', 'е') AS q FROM words), c AS (SELECT q, list_transform(string_split(q, ''), lambda c: CASE WHEN strpos('{MODEL_LETTERS}', c) = 0 THEN 0 ELSE strpos('{MODEL_LETTERS}', c) + 2 END) AS ids FROM u WHERE q <> '') SELECT q AS query, CAST(list_position(list_transform(ids, lambda i: (i * 31) % 23), list_max(list_transform(ids, lambda i: (i * 31) % 23))) - 1 AS INTEGER) AS position FROM c WHERE NOT list_contains(ids, 0)")
def sign_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stand-in character model's place for every word without unknown signs."""
    own = derived.words(spark, sf_dir, folded=True).select(F.col("word").alias("query"))
    return scorers.score_unknown(own.select("query", wordpiece.framed_signs("query").alias("ids")), scorers.StubScorer(1))


# -- Annotators -------------------------------------------------------------------------------


class FirstVowel:
    """Stresses the first vowel of every word; texts with a question fail."""

    def accentuate(self, text: str) -> str:
        import re

        if "?" in text:
            raise ValueError("a question")
        return re.sub(f"(?<!{W})((?:(?!{V}){W})*)({V})", rf"\1\2{ACUTE}", text)


@query(f"WITH {ITEMS}, own AS (SELECT item_id, replace(text, '+', '') AS t FROM items) SELECT CAST(item_id AS BIGINT) AS item_id, 'first-vowel' AS lib, t AS original_text, CASE WHEN contains(t, '?') THEN t ELSE list_aggregate(list_transform(regexp_extract_all(t, '({W}+|{NOT_W}+)'), lambda s: CASE WHEN regexp_matches(s, '^{W}') AND {nv('s')} > 0 THEN {plus_at('s', '0')} ELSE s END), 'string_agg', '') END AS accented_text, CASE WHEN contains(t, '?') THEN 'ValueError' END AS error FROM own")
def annotator_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An annotator run over `benchmark`, its failures kept as results."""
    runs = annotators.annotate(_items(spark, sf_dir), "first-vowel", ["item_id"], make=FirstVowel)
    return runs.select("item_id", "lib", "original_text", "accented_text", F.get("errors", F.lit(0))["type"].alias("error"))


@query(f"WITH {ITEMS} SELECT 'first-vowel' AS lib, CAST(count(*) AS BIGINT) AS texts, CAST(count_if(contains(text, '?')) AS BIGINT) AS exceptions, true AS timed FROM items")
def annotator_performance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exceptions of that run, and whether its times were taken."""
    runs = annotators.annotate(_items(spark, sf_dir), "first-vowel", ["item_id"], make=FirstVowel)
    n = runs.groupBy("lib").agg(F.count(F.lit(1)).alias("texts"))
    own = annotators.performance(runs).join(n, "lib")
    return own.select("lib", "texts", "exceptions", ((F.col("load_time_seconds") >= 0) & (F.col("process_time_seconds") >= 0)).alias("timed"))
