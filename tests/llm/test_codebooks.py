"""Vector codes against the definition in plain Python whole numbers."""

from __future__ import annotations

import hashlib
import math
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tillmark.llm import codebooks
from tillmark.llm.queries import QUERIES

SCHEMA = "vec_id long, embedding array<float>, label int"


def compressed(rows, entries=256):
    """(vec_id, code, error, label_error, sha) of rows (vec_id, vector, label) whose vectors are all usable."""
    kept = [(i, [math.floor(1024 * x) for x in v], label) for i, v, label in rows]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    wide = len(kept[0][1]) // 4
    parts = [[v[p * wide : (p + 1) * wide] for _, v, _ in kept] for p in range(4)]
    books = [own[:entries] for own in parts]

    def nearest(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, e)), k) for k, e in enumerate(book))

    for _ in range(4):
        for p in range(4):
            sums = defaultdict(list)
            for x in parts[p]:
                sums[nearest(x, books[p])[1]].append(x)
            books[p] = [[sum(c) // len(sums[k]) for c in zip(*sums[k])] if k in sums else e for k, e in enumerate(books[p])]
    found = [[nearest(parts[p][n], books[p]) for p in range(4)] for n in range(len(kept))]
    errors = defaultdict(int)
    for (_, _, label), f in zip(kept, found):
        errors[label] += sum(e for e, _ in f)
    sha = hashlib.sha256(",".join(str(x) for book in books for e in book for x in e).encode()).hexdigest()
    return sorted(((i, "".join(f"{k:02x}" for _, k in f), sum(e for e, _ in f), errors[label], sha) for (i, _, label), f in zip(kept, found)), key=str)


def query(spark, tmp_path, rows, schema=SCHEMA):
    df = spark.createDataFrame(rows, schema).withColumns({"code": F.lit("x"), "error": F.lit(1), "id": F.lit(2), "v": F.lit(3)})
    df.repartition(3).write.mode("overwrite").parquet(f"{tmp_path}/embeddings.parquet")
    out = QUERIES["op12_codebooks"](spark, str(tmp_path))
    assert out.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    return sorted((tuple(r) for r in out.collect()), key=str)


def vectors(seed, n, wide=8, values=0):
    rng = random.Random(seed)
    draw = (lambda: rng.randrange(-values, values + 1) / 1024) if values else (lambda: rng.uniform(-1, 1))
    return [(7 * k % 10_007, [np.float32(draw()).item() for _ in range(wide)], rng.choice([None, 1, 2])) for k in range(n)]


@pytest.mark.parametrize("rows", [vectors(1, 400), vectors(2, 500, 4, 2), vectors(3, 10), vectors(4, 1), [*vectors(5, 300), *vectors(5, 300)[:20]], [(1, [0.5, 0.25, 0.1, -0.1], 1)] * 300])
def test_against_plain_python(spark, tmp_path, rows):
    assert query(spark, tmp_path, rows) == compressed(rows)


def test_awkward_rows(spark, tmp_path):
    good = vectors(6, 300)
    bad = [(1000, None, 1), (1001, [None] * 8, 1), (1002, [float("nan")] + [0.0] * 7, 1), (1003, [float("inf")] * 8, 1), (-5, [float("-inf")] * 8, None)]
    good += [(None, [0.5] * 8, 1), (None, [0.25] * 8, None)]
    assert query(spark, tmp_path, good + bad) == compressed(good)
    odd = [(2000, [0.5] * 4, 1), (2001, [], 1), (2002, [1e30] * 8, 9)]  # of another length, or too large to compare
    got = query(spark, tmp_path, good + odd)
    assert [r[:3] for r in got if r[1]] == [r[:3] for r in compressed(good)] and sorted(r[:3] for r in got if not r[1]) == [(2000, None, None), (2001, None, None), (2002, None, None)]
    assert query(spark, tmp_path, bad) == [] and query(spark, tmp_path, []) == []


def test_large_components_are_exact(spark, tmp_path):
    rng = random.Random(8)
    rows = [(k, [float(rng.randrange(-65_536, 65_537)) for _ in range(8)], k % 2) for k in range(280)]
    assert query(spark, tmp_path, rows) == compressed(rows)


def test_restored_vectors(spark):
    rows = vectors(9, 600)
    coded, books = codebooks.compress(spark.createDataFrame(rows, SCHEMA))
    restored = {r["vec_id"]: r["restored"] for r in codebooks.restore(coded, books, ["vec_id"]).collect()}
    errors = {r["vec_id"]: r["error"] for r in coded.collect()}
    for i, v, _ in rows:
        assert sum((math.floor(1024 * x) - round(1024 * y)) ** 2 for x, y in zip(v, restored[i])) == errors[i]
