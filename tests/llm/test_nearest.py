from __future__ import annotations

import numpy as np
import pytest

from tillmark.llm import vamana
from tillmark.llm.queries import QUERIES

SCHEMA = "vec_id long, embedding array<double>, label int, v string, shard int"


def exact(rows, every, k):
    live = [(i, np.array(v, dtype=float)) for i, v in rows if i is not None and v and all(c is not None and np.isfinite(c) for c in v) and any(v)]
    out = {}
    for i, v in live:
        if i % every == 0:
            near = [(-round(float(v @ w) / float(np.linalg.norm(v) * np.linalg.norm(w)), 12), j) for j, w in live if j != i and len(w) == len(v)]
            out[i] = sorted(set(near))[:k]
    return out


def found(spark, rows, **more):
    df = spark.createDataFrame([(i, v, 1, "x", 2) for i, v in rows], SCHEMA)
    out = {}
    for r in sorted(vamana.nearest(df, **more).collect(), key=lambda r: (r["query_id"], r["rank"])):
        out.setdefault(r["query_id"], []).append((-round(r["score"], 12), r["vec_id"]))
        assert r["rank"] == len(out[r["query_id"]])
    return out


def test_small_tables_are_exact(spark):
    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(size=6).tolist()) for i in range(120)]
    rows += [(i, rows[7][1]) for i in range(120, 160)] + [(i, rows[10][1]) for i in (200, 210, 201)]
    rows += [(300, None), (310, []), (320, [0.0] * 6), (330, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (340, [float("nan"), 1.0, 0.0, 0.0, 0.0, 0.0]), (350, [float("inf"), 1.0, 0.0, 0.0, 0.0, 0.0]), (None, [1.0] * 6), (360, [1.0, 2.0]), (361, [2.0, 4.0]), (362, [-0.0, 1.0])]
    got = found(spark, rows, every=10)
    want = {i: near for i, near in exact(rows, 10, 5).items() if near}
    assert got == want
    assert found(spark, [(0, [1.0, 1.0])]) == {} and found(spark, []) == {}


@pytest.mark.parametrize("shard_rows", [600, 5000])
def test_recall(spark, shard_rows):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(20, 32))
    rows = [(i, (centres[i % 20] + rng.normal(size=32)).tolist()) for i in range(3000)]
    got, want = found(spark, rows, shard_rows=shard_rows), exact(rows, 50, 5)
    assert got.keys() == want.keys()
    assert sum(len(set(got[q]) & set(want[q])) for q in want) / sum(map(len, want.values())) >= 0.9


def test_recall_over_many_shards(spark):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(20, 32))
    rows = [(i, (centres[i % 20] + rng.normal(size=32)).tolist()) for i in range(5000)]
    got, want = found(spark, rows, shard_rows=200), exact(rows, 50, 5)  # 25 shards
    assert got.keys() == want.keys()
    assert sum(len(set(got[q]) & set(want[q])) for q in want) / sum(map(len, want.values())) >= 0.9


def test_repeated_ids_and_parallel_vectors(spark):
    """An id with two vectors counts as one row of each; vectors in one direction tie, and scores are the cosines of the vectors as they are."""
    rows = [(0, [1.0, 2.0, 3.0]), (7, [2.0, 4.0, 6.0]), (3, [4.0, 8.0, 12.0]), (5, [0.5, 1.0, 1.5]), (9, [3.0, 1.0, 0.0]), (9, [1.0, 2.0, 3.5]), (4, [1e200, 2e200, 3e200]), (6, [-1.0, 0.0, 0.0])]
    got = found(spark, rows, every=50)
    assert got == {0: [(-1.0, 3), (-1.0, 4), (-1.0, 5), (-1.0, 7), *exact(rows[:1] + [rows[5]], 50, 1)[0]]}


def test_query(spark):
    folder = "/root/testdata/sf0.001"
    rows = [(r["vec_id"], list(r["embedding"])) for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect()]
    got = {}
    for r in QUERIES["op7_nearest"](spark, folder).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    want = {q: {j for _, j in near} for q, near in exact(rows, 50, 5).items()}
    assert got.keys() == want.keys() and sum(len(got[q] & want[q]) for q in want) / (5 * len(want)) >= 0.9


def test_graph_of_vectors_that_all_but_coincide():
    """Every node can be reached, whichever ones pruning leaves without a link."""
    rng = np.random.default_rng(6)
    x = np.ones((300, 8)) + np.where(np.arange(300)[:, None] % 3 == 0, rng.normal(size=(300, 8)), rng.normal(size=(300, 8)) * 1e-8)
    graph = vamana.Graph(x / np.linalg.norm(x, axis=1, keepdims=True))
    reached, front = set(graph.entries.tolist()), list(graph.entries)
    while front:
        front = [int(n) for f in front for n in graph.links[f] if n >= 0 and n not in reached and not reached.add(int(n))]
    assert len(reached) == 300
