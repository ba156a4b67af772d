from __future__ import annotations

import math
import random
import statistics

import pytest
from pyspark.sql import functions as F

from tillmark.functions.stats import t_two_sided
from tillmark.operators import campaigns


@pytest.fixture(scope="module")
def people():
    rng = random.Random(11)
    return [(i, rng.gammavariate(2, 50)) for i in range(203)]


def test_split_has_exact_size_and_reported_p(spark, people):
    df = spark.createDataFrame(people, "customer_id long, spend double")
    split, report = campaigns.validated_split(df, "customer_id", "spend", 0.2, seeds=12)
    sets = {r["customer_id"]: r["campaign_set"] for r in split.collect()}
    assert len(sets) == 203 and sum(v == "test" for v in sets.values()) == 41
    best = report.orderBy(F.col("p_value").desc(), "seed").first()
    test = [x for i, x in people if sets[i] == "test"]
    control = [x for i, x in people if sets[i] == "control"]
    n, m = len(test), len(control)
    vt, vc = statistics.variance(test), statistics.variance(control)
    gap = statistics.mean(test) - statistics.mean(control)
    dev = [[abs(x - statistics.median(part)) for x in part] for part in (test, control)]
    grand = statistics.mean(dev[0] + dev[1])
    between = sum(len(z) * (statistics.mean(z) - grand) ** 2 for z in dev)
    within = sum((x - statistics.mean(z)) ** 2 for z in dev for x in z)
    levene = t_two_sided(math.sqrt(between * (n + m - 2) / within), n + m - 2)
    assert best["p_levene"] == pytest.approx(levene, rel=1e-6)
    pooled = ((n - 1) * vt + (m - 1) * vc) / (n + m - 2)
    if levene < 0.05:
        a, b = vt / n, vc / m
        p = t_two_sided(gap / math.sqrt(a + b), (a + b) ** 2 / (a * a / (n - 1) + b * b / (m - 1)))
    else:
        p = t_two_sided(gap / math.sqrt(pooled * (1 / n + 1 / m)), n + m - 2)
    assert best["p_value"] == pytest.approx(p, rel=1e-6) and p > 0.05
    again, _ = campaigns.validated_split(df.repartition(3), "customer_id", "spend", 0.2, seeds=12)
    assert {r["customer_id"]: r["campaign_set"] for r in again.collect()} == sets


def test_constant_metric_is_refused(spark):
    df = spark.createDataFrame([(i, 1.0) for i in range(20)], "customer_id long, spend double")
    with pytest.raises(ValueError):
        campaigns.validated_split(df, "customer_id", "spend", 0.5, seeds=3)


def test_allocation_is_disjoint_and_follows_the_turns(spark):
    rng = random.Random(2)
    lists = [(c, i) for i in range(120) for c in ("a", "b", "c") if rng.random() < 0.5]
    df = spark.createDataFrame(lists, "campaign string, customer_id long")
    caps = {"a": 20, "b": 10, "c": 200}
    got = [(r["campaign"], r["customer_id"]) for r in campaigns.allocate_audience(df, ["a", "b", "c"], caps, seed=5).collect()]
    assert len({i for _, i in got}) == len(got)
    ranks = {(r["campaign"], r["customer_id"]) for r in campaigns.sample_cap(df, caps, seed=5).collect()}
    only = {i: next(c for c, j in lists if j == i) for _, i in lists if sum(j == i for _, j in lists) == 1}
    taken, want = set(), set()
    for c in ("a", "b", "c"):
        mine = {i for i, x in only.items() if x == c} | {i for x, i in ranks if x == c and i not in taken}
        want |= {(c, i) for i in mine}
        taken |= mine
    assert set(got) == want


def test_tiles_are_even(spark):
    df = spark.range(47).withColumnRenamed("id", "customer_id")
    rows = campaigns.ntile_split(df, "customer_id", tiles=10, test_tiles=9).collect()
    sizes = sorted(sum(r["tile"] == t for r in rows) for t in range(1, 11))
    assert sizes == [4, 4, 4, 5, 5, 5, 5, 5, 5, 5]
    assert {r["campaign_set"] for r in rows if r["tile"] == 10} == {"control"}
    few = campaigns.ntile_split(spark.range(3).withColumnRenamed("id", "customer_id"), "customer_id", tiles=10).collect()
    assert sorted(r["tile"] for r in few) == [1, 2, 3]


def test_unknown_members_are_reported(spark):
    a, b = spark.createDataFrame([(1,), (2,)], "k int"), spark.createDataFrame([(1,)], "k int")
    with pytest.raises(ValueError, match="1 rows"):
        campaigns.assert_members(a, b, "k")
