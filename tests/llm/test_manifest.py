"""The Merkle manifest and its proofs against a plain tree on the driver."""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pytest
from cases import documents, empty
from pyspark.sql import functions as F

from tillmark.llm import manifest
from tillmark.llm.queries import QUERIES


def h(*texts):
    return hashlib.sha256("".join(texts).encode()).hexdigest()


def leaf(row, text):
    return h(*("-" if x is None else f"{len(str(x).encode())}:{x}" for x in (*row[:4], text)))


def up(nodes):
    """All levels above, and for each leaf its siblings."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([h(*levels[-1][k : k + 3]) for k in range(0, len(levels[-1]), 3)])
    paths = []
    for place in range(len(nodes)):
        path = []
        for level in levels[:-1]:
            begin = place // 3 * 3
            path.append((level[begin:place], level[place + 1 : begin + 3]))
            place //= 3
        paths.append(path)
    return levels[-1][0], paths


def proofs(rows):
    """Rows of (doc_id, source, lang, n_chars, text) -> the result of the query, in any order."""
    by_source = {}
    for r in rows:
        by_source.setdefault(r[1], []).append(r)
    order = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: up([leaf(r, r[4]) for r in sorted(by_source[s], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r, r[4])))]) for s in order}
    root, above = up([trees[s][0] for s in order])
    out = []
    for s, upper in zip(order, above):
        for r, path in zip(sorted(by_source[s], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r, r[4]))), trees[s][1]):
            own = leaf(r, r[4])
            cut = r[4] is not None and r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0
            digest = leaf(r, r[4].replace("\n", "") if cut else r[4])
            for left, right in path + upper:
                digest = h(*left, digest, *right)
            out.append((r[0], own, trees[s][0], root, h(*(x for left, right in path + upper for x in left + right)), digest, digest == root))
    return sorted(out, key=str)


COLUMNS = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


def query(tmp_path, df):
    df.write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
    out = QUERIES["op11_merkle"](df.sparkSession, str(tmp_path))
    assert out.columns == COLUMNS
    return sorted((tuple(r) for r in out.collect()), key=str)


def test_query_on_awkward_rows(spark, tmp_path):
    df = documents(spark, ["a\nb", "\n", "x\n\ny"]).withColumn("n_chars", F.col("n_chars").cast("int")).withColumns({"leaf": F.lit("x"), "root": F.lit("y"), "tree": F.lit(1), "one": F.lit(2)})
    rows = [(r["doc_id"], r["source"], r["lang"], r["n_chars"], r["text"]) for r in df.collect()]
    assert query(tmp_path, df) == proofs(rows)
    assert query(tmp_path, df.where("false")) == []
    assert query(tmp_path, df.limit(1)) == proofs(rows[:1])


@pytest.mark.parametrize("levels", [1, 2, 7])
def test_query_on_sources_of_many_sizes(spark, tmp_path, monkeypatch, levels):
    """Blocks of 3, 9 and 2,187 leaves: trees of many rounds, and one block each."""
    monkeypatch.setattr(manifest, "BLOCK_LEVELS", levels)
    monkeypatch.setattr(manifest, "BLOCK", 3**levels)
    sources = {"one": 1, "three": 3, "four": 4, "\U0001f600": 9, "￿": 10, "zz": 27, "hot": 400, None: 28, "": 2}
    rows, at = [], 0
    for source, n in sources.items():
        for _ in range(n):
            rows.append((at * 7 % 1000, source, "en", at, f"text {at}\n" if at % 3 else None))
            at += 1
    rows += rows[:5]
    df = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars int, text string").repartition(4)
    assert query(tmp_path, df) == proofs(rows)


def test_octopus_is_what_cannot_be_derived():
    for n in (1, 2, 3, 7, 27, 50):
        for at in ([0], [n - 1], list(range(n)), list(range(0, n, 4))):
            known, size, places, level = {(0, k) for k in at} | set(manifest.missing(np.array(at), n)), n, set(at), 0
            assert len(known) == len(set(at)) + len(manifest.missing(np.array(at), n))
            while size > 1:
                places = {k // 3 for k in places}
                children = {(level, c) for k in places for c in range(3 * k, min(3 * k + 3, size))}
                assert children <= known
                level, size = level + 1, -(-size // 3)
                known |= {(level, k) for k in places}
            assert not any(level == 0 and k in at for level, k in manifest.missing(np.array(at), n))


def test_siblings_are_the_proof(spark):
    df = spark.createDataFrame([(k, "s", f"t{k}") for k in range(5)], "doc_id long, source string, text string")
    rows = manifest.prove(df, manifest.leaf(F.col("text")), siblings=True).collect()
    leaves = [h(f"2:t{k}") for k in range(5)]
    got = {r["doc_id"]: r for r in rows}
    assert got[0]["siblings"] == leaves[1] + leaves[2] + h(*leaves[3:]) and got[4]["siblings"] == leaves[3] + h(*leaves[:3])
    assert all(r["verified"] and r["root"] == r["subroot"] == h(h(*leaves[:3]), h(*leaves[3:])) and r["proof_sha256"] == h(r["siblings"]) for r in rows)


def test_empty(spark):
    assert manifest.prove(empty(spark), manifest.leaf(F.col("text"))).collect() == []
