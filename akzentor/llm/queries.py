"""The registered queries of the training-data operators, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from akzentor.llm import ann, bpe, html_extract, langid, minhash, packing, quality, tokencount, vec_neardup, warc
from akzentor.llm.common import keep, table

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's pieces and their places in sequences of at most 2048 tokens."""
    return packing.pack(packing.pieces(table(spark, sf_dir, "documents"), TOKENIZER))


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The co-trained classifier's score of every document, learned from `labels`."""
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links, component and survivor for every row of `embeddings`."""
    return vec_neardup.near_duplicates(table(spark, sf_dir, "embeddings"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learned from those that aren't held out."""
    docs = table(spark, sf_dir, "documents")
    profiles = langid.fit(langid.training_rows(docs))
    return langid.predict(docs, profiles).select("doc_id", langid.held_out("doc_id").alias("held_out"), "lang_pred", "score")


def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every row of `pages`."""
    return html_extract.extract(table(spark, sf_dir, "pages"))


def op6_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every document's ids and of the text decoded from them."""
    done = bpe.round_trip(table(spark, sf_dir, "documents"), TOKENIZER)
    return done.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")).cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


def op7_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Set size, component and survivor for every document, by 4-word shingles and 0.8."""
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), words=4, percent=80)


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of `pages` written to WARC archives and read back."""
    back = warc.write_and_read(table(spark, sf_dir, "pages"))
    return back.select("page_id", "payload_bytes", "payload_digest", F.col("warc_type").alias("record_type"), "refers_to")


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes and tokens of every document, and whether it has more than 1024."""
    return tokencount.count_tokens(table(spark, sf_dir, "documents"), TOKENIZER).withColumn("over_limit", F.col("n_tokens") > 1024)


def op10_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest rows of `embeddings` for each row whose vec_id is divisible by 50."""
    vectors = table(spark, sf_dir, "embeddings")
    return ann.search(keep(ann.build_index(vectors), "index"), vectors, vectors.filter("vec_id % 50 = 0"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_best_fit_packing, op2_quality_classifier, op3_embedding_near_dedup, op4_language_id, op5_html_extraction, op6_bpe_round_trip, op7_minhash_near_dedup, op8_warc, op9_token_counts, op10_nearest_neighbours)}
_REACH = "reach(a, b) AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a), lowest AS (SELECT a, min(b) AS low FROM reach GROUP BY a)"
_HEX = "(strpos('0123456789abcdef', substr(x, CAST({} AS INTEGER), 1)) - 1)"

ORACLE_SQL: dict[str, str] = {
    "op3_embedding_near_dedup": f"""WITH RECURSIVE usable AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (SELECT p.vec_id AS a, q.vec_id AS b FROM usable p JOIN usable q ON p.label = q.label AND p.vec_id <> q.vec_id WHERE list_cosine_similarity(p.v, q.v) >= 0.93),
{_REACH}, degree AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT e.vec_id, coalesce(n, 0) AS n_links, least(e.vec_id, coalesce(low, e.vec_id)) AS component_id, e.vec_id <= coalesce(low, e.vec_id) AS kept FROM embeddings e LEFT JOIN degree d ON e.vec_id = d.a LEFT JOIN lowest w ON e.vec_id = w.a""",
    "op7_minhash_near_dedup": f"""WITH RECURSIVE words AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
sets AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i : i + 3], ' '))) END AS s FROM words),
members AS (SELECT doc_id, len(s) AS n, unnest(s) AS h FROM sets),
links AS (SELECT p.doc_id AS a, q.doc_id AS b FROM members p JOIN members q ON p.h = q.h AND p.doc_id <> q.doc_id GROUP BY p.doc_id, q.doc_id, p.n, q.n HAVING 100 * count(*) >= 80 * (p.n + q.n - count(*))),
{_REACH}
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, least(doc_id, coalesce(low, doc_id)) AS component_id, doc_id <= coalesce(low, doc_id) AS kept FROM sets LEFT JOIN lowest ON doc_id = a""",
    "op8_warc": f"""WITH payloads AS (SELECT page_id, coalesce(html, '') AS h, sha1(coalesce(html, '')) AS x, min(page_id) OVER (PARTITION BY coalesce(html, '')) AS f FROM pages)
SELECT page_id, CAST(strlen(h) AS BIGINT) AS payload_bytes, list_aggregate(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((((16 * {_HEX.format("5 * i // 4 + 1")} + {_HEX.format("5 * i // 4 + 2")}) >> (3 - 5 * i % 4)) & 31) + 1 AS INTEGER), 1)), 'string_agg', '') AS payload_digest, CASE WHEN page_id = f THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> f THEN f END AS refers_to FROM payloads""",
}
