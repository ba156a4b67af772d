from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tillmark.operators import joins, metrics, pricing, series

D = dt.date(2024, 1, 1)


def test_join_keys_matches_nulls(spark):
    a = spark.createDataFrame([("x", 1), (None, 2)], "k string, v int")
    b = spark.createDataFrame([("x", 10), (None, 20)], "k string, w int")
    assert {(r["k"], r["w"]) for r in joins.join_keys(a, b, ["k"]).collect()} == {("x", 10), (None, 20)}


def test_exclude_ignores_null_keys(spark):
    a = spark.createDataFrame([(1,), (2,), (3,)], "k int")
    b = spark.createDataFrame([(1,), (None,)], "k int")
    c = spark.createDataFrame([(3,)], "k int")
    assert [r["k"] for r in joins.exclude(a, b, c, keys=["k"]).collect()] == [2]


@pytest.mark.parametrize("low,high", [(0, 90), (1, 30), (-10, 10), (5, 5)])
def test_range_join_equals_brute_force(spark, low, high):
    rng = random.Random(3)
    make = lambda n: [(rng.choice(["hot", "hot", "b"]), D + dt.timedelta(days=rng.randrange(300)), i) for i in range(n)]
    left, right = make(120), make(120)
    a = spark.createDataFrame(left, "k string, d date, i int")
    b = spark.createDataFrame(right, "k string, e date, j int")
    got = sorted((r["i"], r["j"]) for r in joins.range_join(a, b, ["k"], "d", "e", low, high).collect())
    want = sorted((i, j) for k, d, i in left for m, e, j in right if k == m and low <= (d - e).days <= high)
    assert got == want


def test_compare_and_override(spark):
    a = spark.createDataFrame([(1, "g"), (2, "g"), (2, "g")], "k int, g string")
    b = spark.createDataFrame([(2, "g"), (3, "g")], "k int, g string")
    row = joins.compare_sets(a, b, ["k"], ["g"]).first()
    assert (row["both"], row["left_only"], row["right_only"]) == (1, 1, 1)
    base = spark.createDataFrame([(1, "Grow"), (2, "Delist")], "k int, bucket string")
    new = spark.createDataFrame([(2, "Observe")], "k int, bucket string")
    assert {tuple(r) for r in joins.override_values(base, new, ["k"], ["bucket"]).collect()} == {(1, "Grow"), (2, "Observe")}


def test_growth_is_against_the_previous_present_row(spark):
    df = spark.createDataFrame([("s", 1, 10.0), ("s", 3, 15.0), ("s", 4, 0.0), ("s", 5, 5.0)], "k string, week int, v double")
    got = {r["week"]: r["v_growth"] for r in series.pop_growth(df, ["k"], "week", ["v"]).collect()}
    assert got == {1: 0.0, 3: 0.5, 4: -1.0, 5: 0.0}


def test_moving_average_needs_a_full_window(spark):
    df = spark.createDataFrame([("s", i, float(i)) for i in range(1, 5)], "k string, o int, v double")
    got = [r["v_ma3"] for r in series.moving_average(df, ["k"], "o", "v", 3).orderBy("o").collect()]
    assert got == [None, None, 2.0, 3.0]


def test_percentile_labels(spark):
    df = spark.createDataFrame([(float(i),) for i in range(1, 11)], "v double")
    got = {r["v"]: r["band"] for r in metrics.quantile_label(df, "v", [0.5, 0.8], ["L", "M", "H"]).collect()}
    assert got == {float(i): "L" if i <= 5 else "M" if i <= 8 else "H" for i in range(1, 11)}


def test_constant_columns_go(spark):
    df = spark.createDataFrame([(1, "x", None, 1), (1, "y", None, None)], "a int, b string, c int, d int")
    assert metrics.drop_constant_columns(df).columns == ["b", "d"]


def test_base_price_of_three_months(spark):
    rows = []

    def sell(day, price, n):
        rows.extend((f"{day}-{price}-{i}", day, price, price, 1.0, "r", 1) for i in range(n))

    sell(dt.date(2024, 1, 1), 10.0, 1)
    sell(dt.date(2024, 2, 1), 12.0, 2)
    sell(dt.date(2024, 3, 1), 8.0, 5)
    sell(dt.date(2024, 7, 1), 9.0, 1)
    df = spark.createDataFrame(rows, "transaction_id string, business_day date, unit_price double, amount double, quantity double, region string, product_id int")
    got = {r["month"]: r for r in pricing.base_price_discounts(df, ["region", "product_id"]).collect()}
    assert {m: r["base_price"] for m, r in got.items()} == {"2024-M01": 10.0, "2024-M02": 12.0, "2024-M03": 8.0, "2024-M07": 9.0}
    assert [r["discount_flag"] for r in got.values()] == [0, 0, 0, 0]
    sell(dt.date(2024, 3, 1), 12.0, 6)
    got = {r["month"]: r for r in pricing.base_price_discounts(spark.createDataFrame(rows, df.schema), ["region", "product_id"]).collect()}
    march = got["2024-M03"]  # prices 8 x5, 10 x1, 12 x8: median 12, average 10.18
    assert (march["base_price"], march["discount_flag"], march["price_increase_flag"]) == (12.0, 1, 0)
    assert march["discount_amount"] == pytest.approx((12 - 112 / 11) * 11)


def test_quartiles_with_few_values(spark):
    df = spark.createDataFrame([("one", 5.0), ("one", 5.0), ("two", 1.0), ("two", 9.0)] + [("many", float(i)) for i in range(8)], "g string, v double")
    got = {(r["g"], r["v"]): r["v_ordinal"] for r in pricing.quartile_ordinal(df, "v", ["g"]).collect()}
    assert got[("one", 5.0)] == 1
    assert (got[("two", 1.0)], got[("two", 9.0)]) == (1, 2)
    assert [got[("many", float(i))] for i in range(8)] == [1, 1, 2, 2, 3, 3, 4, 4]


def test_price_slabs(spark):
    slabs = spark.createDataFrame([("g", "0 - 99", "99-199", "200-299", "300&Above")], "g string, a string, b string, c string, d string")
    cols = ["a", "b", "c", "d"]
    clean = pricing.normalize_slabs(slabs, cols)
    assert tuple(clean.first())[1:] == ("99&Below", "100-199", "200-299", "300&Above")
    items = spark.createDataFrame([("g", p) for p in (50.0, 99.0, 100.0, 199.5, 250.0, 300.0)], "g string, price double")
    got = {r["price"]: r["price_band"] for r in pricing.price_band(items, clean, ["g"], "price", cols).collect()}
    assert got == {50.0: "99&Below", 99.0: "99&Below", 100.0: "100-199", 199.5: "100-199", 250.0: "200-299", 300.0: "300&Above"}


def test_with_group_does_not_lose_null_groups(spark):
    df = spark.createDataFrame([(None, 1.0), (None, 2.0), ("a", 5.0)], "g string, v double")
    assert sorted(r["t"] for r in joins.with_group(df, ["g"], [F.sum("v").alias("t")]).collect()) == [3.0, 3.0, 5.0]


def test_split_counts_leave_out_unknown_customers(spark):
    rows = [("d", 1, 10.0, 1), ("d", 1, 5.0, 0), ("d", 2, 5.0, 0), ("d", None, 20.0, 1)]
    df = spark.createDataFrame(rows, "g string, customer_id int, amount double, pl int")
    r = metrics.conditional_split(df, ["g"], "pl").first()
    assert (r["pl_sales"], r["total_sales"], r["pl_customers"], r["total_customers"]) == (30.0, 40.0, 1, 2)
