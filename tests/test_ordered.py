"""Order-dependent operators against plain Python, over several stretches and over one."""

from __future__ import annotations

import datetime as dt
import random
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from tillmark.operators import ordered

TASKS = [None, 5]


def rows(seed=1, n=600):
    """Three groups, one with a third of the rows and more, many ties."""
    rng = random.Random(seed)
    out = []
    for i in range(n):
        g = "hot" if rng.random() < 0.6 else rng.choice(["a", "b"])
        v = None if rng.random() < 0.3 else float(rng.randrange(12))
        out.append((i, g, v, dt.date(2024, 1, 1) + dt.timedelta(days=rng.randrange(400))))
    return out


@pytest.fixture(scope="module")
def frame(spark):
    return spark.createDataFrame(rows(), "id long, g string, v double, day date")


def by_group(data):
    groups = {}
    for r in data:
        groups.setdefault(r[1], []).append(r)
    return groups


@pytest.mark.parametrize("tasks", TASKS)
@pytest.mark.parametrize("by", [[], ["g"]])
def test_running_matches_a_loop(frame, tasks, by):
    out = ordered.running(
        frame.fillna(0, subset=["v"]).withColumn("w", F.col("v")),
        [F.col("v").desc(), F.col("id")],
        by,
        sums={"run": "v"},
        position="pos",
        totals={"total": "w"},
        tasks=tasks,
    )
    got = {r["id"]: (r["run"], r["pos"], r["total"]) for r in out.collect()}
    groups = by_group(rows()) if by else {"all": rows()}
    want = {}
    for members in groups.values():
        members = sorted(members, key=lambda r: (-(r[2] or 0.0), r[0]))
        total, run = sum(r[2] or 0.0 for r in members), 0.0
        for i, r in enumerate(members, 1):
            run += r[2] or 0.0
            want[r[0]] = (run, i, total)
    assert got == want


def test_several_stretches_are_really_used(frame):
    assert len(ordered.stretches(frame, [F.col("id")], tasks=5).inputFiles()) > 1


@pytest.mark.parametrize("tasks", TASKS)
def test_percentiles_match_numpy(frame, tasks):
    points = {"p10": 0.1, "p50": 0.5, "p95": 0.95, "p100": 1.0}
    got = {r["g"]: [r[p] for p in points] for r in ordered.percentiles(frame, "v", points, ["g"], tasks).collect()}
    for g, members in by_group(rows()).items():
        values = [r[2] for r in members if r[2] is not None]
        assert got[g] == pytest.approx([float(np.percentile(values, p * 100)) for p in points.values()])


@pytest.mark.parametrize("tasks", TASKS)
def test_upper_median(spark, frame, tasks):
    four = spark.createDataFrame([(1.0,), (2.0,), (3.0,), (4.0,)], "v double")
    assert ordered.upper_median(four, "v", "m", tasks=tasks).first()["m"] == 3.0
    got = {r["g"]: r["m"] for r in ordered.upper_median(frame, "v", "m", ["g"], tasks).collect()}
    for g, members in by_group(rows()).items():
        values = sorted(r[2] for r in members if r[2] is not None)
        assert got[g] == values[len(values) // 2]


@pytest.mark.parametrize("tasks", TASKS)
def test_avg_rank(spark, tasks):
    df = spark.createDataFrame([("a", 10), ("b", 10), ("c", 5), ("d", None)], "k string, v int")
    got = {r["k"]: r["rank"] for r in ordered.avg_rank(df, "v", tasks=tasks).collect()}
    assert got == {"a": 1.5, "b": 1.5, "c": 3.0, "d": None}


@pytest.mark.parametrize("tasks", TASKS)
def test_pareto_cut_keeps_the_crossing_row(spark, tasks):
    df = spark.createDataFrame([("w", 50.0), ("x", 30.0), ("y", 15.0), ("z", 5.0)], "k string, v double")
    kept = lambda cut: {r["k"] for r in ordered.pareto_cut(df, ["k"], "v", cut, tasks=tasks).collect()}
    assert kept(0.8) == {"w", "x"}
    assert kept(0.81) == {"w", "x", "y"}
    assert sum(r["share"] for r in ordered.pareto(df, ["k"], "v", tasks=tasks).collect()) == pytest.approx(1)


@pytest.mark.parametrize("tasks", TASKS)
def test_fill_forward_then_backward(spark, tasks):
    data = [("k", 1, None), ("k", 2, 7.0), ("k", 3, None), ("k", 4, 9.0), ("k", 5, None), ("none", 1, None), ("none", 2, None)]
    df = spark.createDataFrame(data, "k string, o int, v double")
    got = {(r["k"], r["o"]): r["v"] for r in ordered.ffill_bfill(df, ["k"], ["o"], ["v"], tasks).collect()}
    assert got == {("k", 1): 7.0, ("k", 2): 7.0, ("k", 3): 7.0, ("k", 4): 9.0, ("k", 5): 9.0, ("none", 1): None, ("none", 2): None}


@pytest.mark.parametrize("tasks", TASKS)
def test_nearest_value(spark, tasks):
    known = {1: 10.0, 5: 50.0, 9: 90.0}
    data = [("k", dt.date(2024, 1, d), known.get(d)) for d in (1, 2, 3, 5, 7, 9)]
    df = spark.createDataFrame(data, "k string, day date, v double")
    got = {r["day"].day: r["v"] for r in ordered.nearest_impute(df, ["k"], "day", "v", tasks).collect()}
    # days 3 and 7 lie halfway: the earlier value is taken
    assert got == {1: 10.0, 2: 10.0, 3: 10.0, 5: 50.0, 7: 50.0, 9: 90.0}


@pytest.mark.parametrize("tasks", TASKS)
def test_hot_group_fills(frame, tasks):
    out = ordered.running(frame, [F.col("day"), F.col("id")], ["g"], fills={"last": "v"}, tasks=tasks)
    got = {r["id"]: r["last"] for r in out.collect()}
    for members in by_group(rows()).values():
        last = None
        for r in sorted(members, key=lambda r: (r[3], r[0])):
            last = r[2] if r[2] is not None else last
            assert got[r[0]] == last


def test_rank_slice(spark):
    df = spark.range(20)
    got = [r["id"] for r in ordered.rank_slice(df, [F.col("id")], 5, 8).orderBy("id").collect()]
    assert got == list(range(20))[5:8]


def test_median_of_all_rows_is_the_statistics_median(frame):
    values = [r[2] for r in rows() if r[2] is not None]
    assert ordered.percentiles(frame, "v", {"m": 0.5}).first()["m"] == statistics.median(values)
