"""The registered queries of this folder: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillmark.llm import bpe, codebooks, ctw, flatfiles, langid, manifest, minhash, oracles, pages, quality, simhash, templates, transducer, vamana
from tillmark.llm.store import new_path

#: The vocabulary of the token queries, and the most tokens that fit a context.
BYTE_BPE = "byte_bpe_50k.json"
CONTEXT = 1024
#: Labelled texts of each language that the language model learns from, at most.
LANGUAGE_TEXTS = 100
#: Labelled texts of each label that the quality model learns from, at most.
TRAINING_ROWS = 2000

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {"op11_merkle": oracles.OP11, "op12_codebooks": oracles.OP12, "op13_minhash": oracles.OP13}


def query(f):
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def remainder(column, n: int):
    """crc32 of the id as text, modulo n: which documents a model may learn from."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % n


@query
def op1_simhash(spark: SparkSession, folder: str) -> DataFrame:
    """Near-duplicate classes of all documents by 3-word SimHash at two bits or fewer."""
    return simhash.near_duplicates(table(spark, folder, "documents"))


@query
def op6_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Bytes and tokens of every document, and whether it exceeds the context."""
    return transducer.token_counts(table(spark, folder, "documents"), public_tokenizers.path(BYTE_BPE), CONTEXT)


@query
def op9_bpe(spark: SparkSession, folder: str) -> DataFrame:
    """Every document encoded and decoded again, as digests."""
    made = bpe.encode(table(spark, folder, "documents"), public_tokenizers.path(BYTE_BPE), ["doc_id"], decoded=True)
    return made.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"))


@query
def op10_flat_files(spark: SparkSession, folder: str) -> DataFrame:
    """All documents written as flat token files, and what a reader finds in them."""
    place = new_path(spark, "flat-tokens")
    flatfiles.write(table(spark, folder, "documents"), place, public_tokenizers.path(BYTE_BPE), end_token=2)
    return flatfiles.read(spark, place, flatfiles.crc32, "ids_crc32 long")


@query
def op7_nearest(spark: SparkSession, folder: str) -> DataFrame:
    """The five nearest vectors found for every fiftieth vector."""
    return vamana.nearest(table(spark, folder, "embeddings"))


@query
def op2_context_tree(spark: SparkSession, folder: str) -> DataFrame:
    """Context-tree and unigram scores of every document."""
    scored = ctw.score(table(spark, folder, "documents"), remainder("doc_id", 7) != 2)
    return scored.withColumn("learnt", ~F.col("learnt")).withColumnRenamed("learnt", "held_out")


@query
def op4_main_text(spark: SparkSession, folder: str) -> DataFrame:
    """Main text of every page."""
    rows = table(spark, folder, "pages")
    field = pages.train(pages.labelled_pages(pages.training_sentences(rows)))
    return pages.main_text(rows, field, ["page_id", "url"])


@query
def op5_quality(spark: SparkSession, folder: str) -> DataFrame:
    """Quality score of every document."""
    docs = table(spark, folder, "documents")
    held_out = remainder("doc_id", 3) == 1
    rows = quality.training_rows(docs, table(spark, folder, "labels"), ~held_out, most=TRAINING_ROWS)
    scored = quality.score(docs, quality.train(rows), ["doc_id"])
    return scored.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), F.col("quality_score").alias("score"), (F.col("quality_score") >= 0.5).cast("int").alias("predicted"))


@query
def op3_language(spark: SparkSession, folder: str) -> DataFrame:
    """Language of every document."""
    docs = table(spark, folder, "documents")
    held_out = remainder("doc_id", 5) == 0
    model = langid.train(langid.training_texts(docs, ~held_out, most=LANGUAGE_TEXTS))
    found = langid.predict(docs, model, ["doc_id"])
    return found.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "lang_pred", F.col("lang_score").alias("score"))


@query
def op8_template_leaks(spark: SparkSession, folder: str) -> DataFrame:
    """Every document that holds a benchmark item, word for word or with other numbers, names or units."""
    return templates.leaks(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


@query
def op11_merkle(spark: SparkSession, folder: str) -> DataFrame:
    """A Merkle manifest of all documents, and every document's proof held against it, half of them without their line feeds."""
    docs = table(spark, folder, "documents")
    digest = manifest.leaf(*(F.col(c) for c in ("doc_id", "source", "lang", "n_chars", "text")))
    shorter = manifest.leaf(*(F.col(c) for c in ("doc_id", "source", "lang", "n_chars")), F.replace("text", F.lit("\n"), F.lit("")))
    tampered = (remainder("doc_id", 2) == 0) & F.contains("text", F.lit("\n"))
    return manifest.prove(docs, digest, F.when(tampered, shorter).otherwise(digest))


@query
def op12_codebooks(spark: SparkSession, folder: str) -> DataFrame:
    """Every vector as four bytes, its squared error, and the errors summed by label."""
    coded, books = codebooks.compress(table(spark, folder, "embeddings"))
    made = codebooks.with_group_errors(coded).withColumn("codebooks_sha256", F.lit(codebooks.digest(books)))
    return made.select("vec_id", "code", "error", "label_error", "codebooks_sha256")


@query
def op13_minhash(spark: SparkSession, folder: str) -> DataFrame:
    """Near-duplicate classes of all documents by the similarity of their 4-word shingles."""
    return minhash.near_duplicates(table(spark, folder, "documents"))
