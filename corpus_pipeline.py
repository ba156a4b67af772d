"""A corpus pipeline of five operators: language, quality, near-duplicates, benchmark leaks, tokens.

``run(spark, sf_dir)`` applies the stages to ``documents``; each stage works on all rows that the one before kept. Stages but
the last return the columns they were given.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillmark.llm import bpe, langid, quality, simhash, templates
from tillmark.llm.queries import BYTE_BPE, LANGUAGE_TEXTS, TRAINING_ROWS, remainder
from tillmark.llm.store import keep

#: Texts without a letter, and texts of which no language holds this share of the letters, are rejected.
LEAST_SHARE = 0.4


def _aside(docs: DataFrame):
    """``docs`` with columns named k0, k1, ..., which no result of an operator clashes with; their names by old name; and the way back."""
    names = {c: f"k{n}" for n, c in enumerate(docs.columns)}
    return docs.toDF(*names.values()), names, lambda df: df.select(*(F.col(k).alias(c) for c, k in names.items()))


def languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents without a language of their own: no letters, or letters scattered over languages.

    The languages are those of ``lang``; if no row has one, only documents without a letter go.
    """
    model = langid.train(langid.training_texts(docs, F.lit(True), most=LANGUAGE_TEXTS))
    if not model.labels:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    rows, name, back = _aside(docs)
    found = langid.predict(rows, model, rows.columns, text=name["text"])
    return back(found.where((F.col("lang_pred") != langid.UNKNOWN) & (F.col("lang_score") >= LEAST_SHARE)))


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents more likely of label 0 than of label 1.

    A null text is scored like an empty one, a long one as a whole; equal texts have equal scores. Without
    labelled rows every score is 0.5 and all stay. An empty table gives no rows.
    """
    rows = quality.training_rows(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), F.lit(True), most=TRAINING_ROWS)
    plain, name, back = _aside(docs)
    return back(quality.score(plain, quality.train(rows), plain.columns, text=name["text"]).where("quality_score >= 0.5"))


def one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each near-duplicate class: that of the smallest doc_id (a null one comes last).

    Near duplicates have SimHash fingerprints of three-word shingles at most two bits apart, directly or over others.
    Texts that are null or have no words have fingerprint zero and are one class. Rows that are equal in doc_id and text are one document.
    An empty table gives no rows.
    """
    plain, name, back = _aside(docs)
    doc, text = F.coalesce(name["doc_id"], F.lit((1 << 63) - 1)).alias("doc"), F.xxhash64(name["text"]).alias("text")
    classes = simhash.near_duplicates(plain.select(F.struct(doc, text).alias("key"), name["text"]), id="key", text=name["text"])
    kept = classes.where("key = component_id").select("key.doc", "key.text").distinct()
    return back(plain.withColumns({"doc": doc, "text": text}).join(kept, ["doc", "text"]).dropDuplicates(["doc", "text"]))


def without_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents that hold a benchmark item, in its words or re-parameterised.

    Null and empty texts hold none and stay; long ones are searched as a whole. Rows equal in doc_id and text go or stay together. Without
    benchmark items all stay. An empty table gives no rows.
    """
    plain, name, back = _aside(docs)
    keyed = plain.withColumn("key", F.xxhash64(name["doc_id"], name["text"]))
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    leaked = keep(templates.leaks(keyed, benchmark, id="key", text=name["text"]).select("key").distinct(), "leaked")
    return back(keyed.join(leaked, "key", "left_anti"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens, ids, and whether decoding the ids gives the text again.

    One row per row, whole texts. A null text has the tokens of an empty one: none. An empty table gives no rows.
    """
    columns = ["doc_id", "lang", "source"]
    rows = docs.select(*columns, "text", F.sha2(F.coalesce("text", F.lit("")), 256).alias("sha"))
    made = bpe.encode(rows, public_tokenizers.path(BYTE_BPE), [*columns, "sha"], decoded=True)
    return made.select(*columns, "n_tokens", "ids", (F.sha2("decoded", 256) == F.col("sha")).alias("round_trip"))


STAGES = [
    ("language", languages),
    ("quality", good_quality),
    ("near_duplicates", one_of_near_duplicates),
    ("leaks", without_leaks),
    ("tokens", tokens),
]

#: SQL can't express the stages; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over ``documents``; each stage's result is a table in the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = keep(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
