from __future__ import annotations

import corpus_pipeline
from cases import documents, empty
from pyspark.sql import functions as F
from test_simhash import classes, plain

FOLDER = "/root/testdata/sf0.001"
STAGES = dict(corpus_pipeline.STAGES)


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_each_stage_by_brute_force(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{FOLDER}/labels.parquet").collect()}
    kept = STAGES["language"](spark, docs, FOLDER)
    assert kept.columns == docs.columns and {r["doc_id"] for r in docs.collect()} - {r["doc_id"] for r in kept.collect()} == {r["doc_id"] for r in docs.collect() if not any(c.isalpha() for c in r["text"])}
    good = STAGES["quality"](spark, kept, FOLDER)
    ids = {r["doc_id"] for r in good.collect()}
    assert good.columns == docs.columns and ids == {i for i in (r["doc_id"] for r in kept.collect()) if labels.get(i, int(i in ids))}
    single = STAGES["near_duplicates"](spark, good, FOLDER)
    want = {i for i, _, least in classes([(r["doc_id"], plain(r["text"])) for r in good.collect()]) if i == least}
    assert single.columns == docs.columns and {r["doc_id"] for r in single.collect()} == want
    clean = STAGES["leaks"](spark, single, FOLDER)
    items = [set(zip(*(r["text"].lower().split()[k:] for k in range(13)))) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    leaked = {r["doc_id"] for r in single.collect() if any(set(zip(*(r["text"].lower().split()[k:] for k in range(13)))) & i for i in items)}
    assert clean.columns == docs.columns and {r["doc_id"] for r in clean.collect()} == want - leaked
    last = STAGES["tokens"](spark, clean, FOLDER).collect()
    assert {r["doc_id"] for r in last} == want - leaked and all(r["round_trip"] and len(r["ids"]) == 4 * r["n_tokens"] for r in last)
    assert {r["doc_id"] for r in corpus_pipeline.run(spark, FOLDER).collect()} == {r["doc_id"] for r in last}


def test_awkward_rows(spark):
    docs = documents(spark).withColumns({c: F.lit("clash") for c in ("k0", "key", "doc", "lang_pred", "quality_score", "component_id", "ids", "sha")})
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, FOLDER)
        rows = out.collect()
        assert rows if name != "quality" else True
        if name != "tokens":
            assert out.columns == docs.columns
        assert stage(spark, empty(spark), FOLDER).collect() == []
    single = [(r["doc_id"], r["text"]) for r in STAGES["near_duplicates"](spark, docs, FOLDER).collect()]
    assert single.count((3, "One")) == 1 and (None, "no id") in single and (6, "same text here and there") not in single
    assert {t for _, t in single} >= {"One", "two words", "same text here and there"} and sum(t in ("", None, " \n\t ") for _, t in single) == 1
