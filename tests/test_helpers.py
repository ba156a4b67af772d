"""Small helpers that no query uses by themselves."""

from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

from tillmark.operators import campaigns, customers, joins, metrics, series
from tillmark.sources import writers


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_rows_without_keys_or_with_negative_values_go(spark):
    df = spark.createDataFrame([(1, 2.0), (None, 1.0), (2, -1.0), (3, None), (4, 0.0)], "k int, v double")
    assert rows(metrics.require_keys(df, ["k"])) == [(1, 2.0), (2, -1.0), (3, None), (4, 0.0)]
    assert rows(metrics.require_keys(df, ["k"], ["v"])) == [(1, 2.0), (4, 0.0)]


def test_one_row_per_key(spark):
    df = spark.createDataFrame([("a", 2, "x"), ("a", 1, "y"), ("b", 5, "z"), (None, 1, "n"), (None, 2, "m")], "k string, v int, w string")
    assert rows(metrics.dedupe(df, ["k"], [F.col("v").asc()])) == [("a", 1, "y"), ("b", 5, "z"), (None, 1, "n")]
    assert {r[0] for r in rows(metrics.dedupe(df, ["k"]))} == {"a", "b", None} and metrics.dedupe(df, ["k"]).count() == 3


def test_distinct_counts(spark):
    df = spark.createDataFrame([("a", 1, 7), ("a", 1, 8), ("a", None, 8), ("b", 2, 9)], "g string, x int, y int")
    assert rows(metrics.distinct_counts(df, ["g"], {"nx": "x", "ny": F.col("y")})) == [("a", 1, 2), ("b", 1, 1)]


def test_returns_by_type(spark):
    kept = "no return"
    df = spark.createDataFrame([(t,) for t in [*metrics.RETURN_TYPE_IDS, kept, None]], "transaction_type_id string")
    assert set(rows(metrics.not_returned(df))) == {(None,), (kept,)}


def test_growth_tiers_leave_out_falls(spark):
    df = spark.createDataFrame([(float(x),) for x in range(-5, 101)], "g double")
    assert series.growth_tiers(df, "g").first() == pytest.approx((33.0, 66.0))


def test_lists(spark):
    one, two = (spark.createDataFrame([(i,) for i in ids], "customer_id int") for ids in ((1, 2, 2), (2, 3, None)))
    assert rows(campaigns.campaign_lists({"one": one, "two": two})) == sorted([("one", 1), ("one", 2), ("two", 2), ("two", 3), ("two", None)], key=str)
    people = spark.createDataFrame([(1,), (2,), (3,), (4,)], "customer_id int")
    assert rows(joins.keep(people, one, two, keys=["customer_id"])) == [(1,), (2,), (3,)]
    assert rows(customers.never_bought(people, one)) == [(3,), (4,)]
    assert rows(campaigns.touched_before(people, one)) == [(1, 1), (2, 1), (3, 0), (4, 0)]
    assert rows(people.select("customer_id", campaigns.threshold_met("customer_id", 3))) == [(1, 0), (2, 0), (3, 1), (4, 1)]


def test_conversion_by_feature(spark):
    df = spark.createDataFrame([("m", 1), ("m", 0), ("f", 1), ("f", 1)], "sex string, hit int")
    got = {str(v) for r in customers.conversion_by_feature(df, ["sex"], "hit").collect() for v in r}
    assert {"0.5", "1.0"} <= got


@pytest.mark.parametrize("mode", ["static", "dynamic"])
def test_writers_under_either_overwrite_mode(spark, mode):
    before = spark.conf.get("spark.sql.sources.partitionOverwriteMode")
    spark.conf.set("spark.sql.sources.partitionOverwriteMode", mode)
    try:
        name = f"sales_{mode}"
        spark.sql(f"DROP TABLE IF EXISTS {name}")
        spark.createDataFrame([(1, "a"), (2, "b"), (3, "b")], "v int, p string").write.partitionBy("p").saveAsTable(name)
        writers.delete_slice(name, spark, "p = 'b'")
        assert rows(spark.table(name)) == [(1, "a")]
        writers.append_if_absent(spark.createDataFrame([(4, "c")], "v int, p string"), name, ["v"])
        writers.replace_slice(spark.createDataFrame([(5, "c")], "v int, p string"), name, ["p"])
        assert rows(spark.table(name)) == [(1, "a"), (5, "c")]
        assert spark.conf.get("spark.sql.sources.partitionOverwriteMode") == mode
    finally:
        spark.conf.set("spark.sql.sources.partitionOverwriteMode", before)


def test_staged_tables_can_be_released(spark):
    from tillmark.session import release_stages, stage

    release_stages(spark)
    frame = stage(spark.range(3))
    path = frame.inputFiles()[0].rsplit("/", 1)[0].removeprefix("file:")
    assert os.path.isdir(path) and release_stages(spark) == 1 and not os.path.exists(path) and release_stages(spark) == 0
