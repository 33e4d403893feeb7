import random

import corpus_pipeline
from tests.llm.test_tokens import check_packing
from tests.llm.test_near_duplicates import brute

WORDS = {
    "en": "the cat and a dog were in that house with other things which they had when it was cold",
    "de": "der hund und die katze waren in dem haus mit einer sache die sie hatten als es kalt war",
}


def corpus(tmp_path, spark):
    rng = random.Random(9)
    rows, labels = [], []
    for i in range(240):
        lang = rng.choice(list(WORDS))
        text = " ".join(rng.choice(WORDS[lang].split()) for _ in range(rng.randint(20, 200))) + "."
        if i % 4 == 0:
            text = "BUY!! " + " ".join(w.upper() + "!!" for w in text.split()) + " $$$ %%%"
        rows.append((i, text, lang, f"s{i % 3}", len(text)))
        if i % 2 == 0 or i % 3 == 0:
            labels.append((i, int(i % 4 != 0), 0))
    rows += [(300 + i, rows[4 * i + 1][1] + " extra", rows[4 * i + 1][2], "s0", 1) for i in range(20)] + [(400, rows[1][1], "en", None, None), (401, None, "en", "s1", 0), (402, "12 34 56", None, "s1", 8), (403, "", "en", "s1", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    return {r[0]: r[1] for r in rows}


def test_stages_against_plain_versions(spark, tmp_path, library):
    text = corpus(tmp_path, spark)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = [set(text)]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        docs = stage(spark, docs, str(tmp_path))
        docs.write.parquet(f"{tmp_path}/stage{k}")
        docs = spark.read.parquet(f"{tmp_path}/stage{k}")
        assert docs.columns == corpus_pipeline.COLUMNS
        kept.append({r["doc_id"] for r in docs.select("doc_id").collect()})
        assert kept[-1] <= kept[-2], name
    clean = {i for i, t in text.items() if t and "!!" not in t and any(c.isalpha() for c in t)}
    assert kept[2] == clean
    groups = brute([(i, text[i]) for i in sorted(kept[2])], 5)
    assert kept[3] == {i for i, g in groups.items() if i == g} and len(kept[3]) < len(kept[2])
    rows = corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).collect()
    check_packing(rows, [(i, library.encode(text[i], add_special_tokens=False).ids + [0]) for i in kept[3]], 2048)
    whole = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted((r["doc_id"], r["piece"], r["length"]) for r in whole) == sorted((r["doc_id"], r["piece"], r["length"]) for r in rows)


def test_languages_that_were_not_learned_go(spark):
    rng = random.Random(4)
    rows = [(i, " ".join(rng.choice(WORDS[lang].split()) for _ in range(60)), lang, "s", 1) for i, lang in enumerate(["en", "de"] * 30)]
    rows += [(100, "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw.", None, "s", 1), (101, "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan.", None, "s", 1), (102, "все люди рождаются свободными", None, "s", 1), (103, None, "en", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert {r["doc_id"] for r in corpus_pipeline.language_stage(spark, docs, "").collect()} == set(range(60))


def test_entry_has_all_eleven_queries():
    import __spark_entry__

    names = __spark_entry__.queries()
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11))


def test_edge_rows(spark, tmp_path, docs, no_docs):
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for data in (docs, no_docs):
        own = data
        for _, stage in corpus_pipeline.STAGES:
            own = stage(spark, own, str(tmp_path))
        rows = own.collect()
        assert (len(rows) > 0) == (data is docs)
    assert {r["doc_id"] for r in corpus_pipeline.dedup_stage(spark, docs, str(tmp_path)).collect()} == {None, *range(1, 9)}
