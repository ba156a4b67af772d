from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tillmark.functions import dates, exprs, stats
from tillmark.schema import TRANSACTIONS, require_columns


def column(spark, values, kind, expr):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r["out"] for r in df.select("i", expr("v").alias("out")).orderBy("i").collect()]


def test_buckets_close_on_the_right_and_include_the_lowest(spark):
    got = column(spark, [-0.1, 0.0, 0.3, 0.31, 0.7, 1.0, 1.1, None], "double", lambda c: exprs.bucketize(c, (0, 0.3, 0.7, 1), ("L", "M", "H")))
    assert got == [None, "L", "L", "M", "M", "H", None, None]
    got = column(spark, [0.0, 0.3, 1.0], "double", lambda c: exprs.bucketize(c, (0, 0.3, 1), ("L", "H"), right=False))
    assert got == ["L", "H", None]


def test_safe_division(spark):
    df = spark.createDataFrame([(6.0, 3.0), (1.0, 0.0), (1.0, None), (None, 2.0)], "a double, b double")
    assert [r[0] for r in df.select(exprs.safe_div("a", "b")).collect()] == [2.0, None, None, None]
    assert [r[0] for r in df.select(exprs.safe_div("a", "b", 0)).collect()] == [2.0, 0.0, 0.0, 0.0]
    assert [r[0] for r in df.select(exprs.growth("a", "b")).collect()] == [1.0, 0.0, 0.0, 0.0]


def test_clip_keeps_null(spark):
    assert column(spark, [-3.0, 0.5, 9.0, None], "double", lambda c: exprs.clip(c, 0.0, 1.0)) == [0.0, 0.5, 1.0, None]


def test_finite(spark):
    assert column(spark, [1.0, float("inf"), float("nan"), None], "double", exprs.finite) == [1.0, 0.0, 0.0, 0.0]


def test_rounding_points_and_multiples(spark):
    assert column(spark, [1.24, 1.25, 1.75], "double", lambda c: exprs.round_to(c, 0.5)) == [1.0, 1.5, 2.0]
    assert column(spark, [10.0, 300.0], "double", lambda c: exprs.reward_points(c, 19, 3800)) == [190.0, 3800.0]
    assert column(spark, [9999.0, 25000.0], "double", lambda c: exprs.whole_multiples(c, 10_000)) == [0, 20_000]


def test_text_parsing(spark):
    packs = ["6x1.5L", "500ml", "12 x 330 ML", "loose"]
    assert column(spark, packs, "string", exprs.pack_count) == [6, 1, 12, 1]
    assert column(spark, packs, "string", exprs.pack_volume) == [1.5, 500.0, 330.0, None]
    assert column(spark, packs, "string", exprs.pack_unit) == ["L", "ML", "ML", None]
    assert column(spark, ["still-water"], "string", exprs.title_case) == ["Still Water"]
    assert column(spark, ["12.5", " 7 ", "n/a"], "string", exprs.to_number) == [12.5, 7.0, None]


def test_private_label_and_units(spark):
    brands = ["HOUSE", "FARM IMP", "IMPERIAL", None]
    assert column(spark, brands, "string", lambda c: exprs.private_label_flag(c, "HOUSE")) == [1, 1, 0, 0]
    df = spark.createDataFrame([(1.0, "oz"), (2.0, "kg"), (3.0, "pcs")], "v double, u string")
    assert [r[0] for r in df.select(exprs.convert_units("v", "u")).collect()] == [28.3495, 2000.0, 3.0]


def test_business_key_is_null_when_a_part_is(spark):
    df = spark.createDataFrame([("a", 1), (None, 2)], "x string, y int")
    assert [r[0] for r in df.select(exprs.business_key("x", "y")).collect()] == ["a|1", None]


def test_calendar(spark):
    days = [dt.date(2024, 12, 30), dt.date(2024, 1, 1), dt.date(2023, 1, 1)]
    assert column(spark, days, "date", dates.week_label) == ["2025-W01", "2024-W01", "2022-W52"]
    assert column(spark, days, "date", dates.day_name) == ["Monday", "Monday", "Sunday"]
    assert column(spark, days, "date", dates.year_month) == [202412, 202401, 202301]
    assert column(spark, [dt.date(2024, 1, 7), dt.date(2024, 1, 8)], "date", lambda c: dates.week_index(c, "2024-01-01")) == [1, 2]
    assert column(spark, ["20240229"], "string", dates.compact_date) == [dt.date(2024, 2, 29)]


@pytest.mark.parametrize("t,df,p", [(0.0, 10, 1.0), (2.228138852, 10, 0.05), (1.959963985, 1e7, 0.05), (12.7062047364, 1, 0.05), (-2.228138852, 10, 0.05)])
def test_t_probability(t, df, p):
    assert stats.t_two_sided(t, df) == pytest.approx(p, rel=1e-6)


def test_required_columns(spark):
    df = spark.createDataFrame([], TRANSACTIONS)
    assert require_columns(df, ["amount"]) is df
    with pytest.raises(ValueError, match="missing columns: nope"):
        require_columns(df.select("amount"), ["amount", "nope"])


def test_seeded_order_is_stable(spark):
    df = spark.range(5)
    first = [r[0] for r in df.select(exprs.seeded_order(1, "id")).collect()]
    again = [r[0] for r in df.repartition(3).orderBy("id").select(exprs.seeded_order(1, "id")).collect()]
    other = [r[0] for r in df.select(exprs.seeded_order(2, "id")).collect()]
    assert first == again != other
    assert df.select(F.md5(F.lit("1|0"))).first()[0] == first[0]
