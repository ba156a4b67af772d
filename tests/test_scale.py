"""What a task holds and how often the lines are read, on hand-made rows."""

from __future__ import annotations

import contextlib
import io
import random

import pytest
import tables

from tillmark.operators import customers, models
from tillmark.plans import prices, star
from tillmark.plans.catalog import QUERIES


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    return tables.star(tmp_path_factory.mktemp("scale") / "star", random.Random(3), orders=300)


def plan(df):
    said = io.StringIO()
    with contextlib.redirect_stdout(said):
        df.explain()
    return said.getvalue()


@pytest.mark.parametrize("name", ["one_timer_index", "repeat_index", "first_purchase_spend"])
def test_large_tables_are_dealt_by_their_size(spark, folder, monkeypatch, name):
    assert "REPARTITION_BY_NUM" not in plan(QUERIES[name](spark, folder))
    small = sorted(map(tuple, QUERIES[name](spark, folder).collect()))
    monkeypatch.setattr(star, "TASK_BYTES", 100)
    assert plan(QUERIES[name](spark, folder)).count("REPARTITION_BY_NUM") >= 2
    assert sorted(map(tuple, QUERIES[name](spark, folder).collect())) == small


def test_base_price_lines_are_dealt_by_their_size(spark, folder, monkeypatch):
    small = sorted(map(tuple, QUERIES["base_price_discounts"](spark, folder).collect()))
    monkeypatch.setattr(star, "TASK_BYTES", 100)
    assert "REPARTITION_BY_NUM" in plan(star.sales(spark, folder))
    assert sorted(map(tuple, QUERIES["base_price_discounts"](spark, folder).collect())) == small


@pytest.mark.parametrize("window", [1, 2, 3, 5])
def test_retention_by_brute_force_without_rows_per_customer_and_window(spark, window):
    rng = random.Random(window)
    rows = [(rng.choice(["a", "b", None]), rng.choice([*range(9), None]), 2023 * 12 + rng.randrange(1, 15)) for _ in range(60)]
    days = [(r, c, f"{(m - 1) // 12}-{(m - 1) % 12 + 1:02d}-07") for r, c, m in rows] + [("a", 1, None)]
    df = spark.createDataFrame(days, "region string, customer_id long, d string").selectExpr("region", "customer_id", "CAST(d AS DATE) AS business_day")
    made = customers.rolling_retention(df, window=window, by=["region"])
    assert not [line for line in plan(made).splitlines() if "hashpartitioning(" in line and "target" in line and "customer_id" in line]
    want, low, high = {}, min(m for *_, m in rows), max(m for *_, m in rows)
    for region in ("a", "b", None):
        of = {(c, m) for r, c, m in rows if r == region and c is not None}
        for t in range(low + window, high + 1):
            seen = {c for c, m in of if t - window <= m < t}
            if seen:
                want[region, (t - 1) // 12 * 100 + (t - 1) % 12 + 1] = len(seen), sum((c, t) in of for c in seen)
    assert {(r["region"], r["year_month"]): (r["window_customers"], r["returning"]) for r in made.collect()} == want


def test_weighted_elasticity_reads_the_lines_once(spark, folder):
    assert "lineitem" not in plan(prices.weighted(spark, folder))  # all of it comes from the staged months


def test_choice_rows_are_not_sorted_as_a_whole(spark, monkeypatch):
    rng = random.Random(9)
    rows = [(t, f"2024-01-{1 + t % 9:02d}", rng.choice("abc"), rng.choice("xy"), float(rng.randrange(5, 20))) for t in range(150) for _ in range(2)]
    df = spark.createDataFrame(rows, "t int, day string, a string, b string, price double").selectExpr("t", "CAST(day AS DATE) AS day", "a", "b", "price")
    sorted_rows, running = [], models.running

    def counted(frame, *args, **kwargs):
        sorted_rows.append((frame.count(), "t" in frame.columns))
        return running(frame, *args, **kwargs)

    monkeypatch.setattr(models, "running", counted)
    out, _ = models.choice_dataset(df, "t", "day", ["a", "b"], "price")
    got = {(r["t"], r["a"], r["b"]): (r["price"], r["purchase_flag"]) for r in out.collect()}
    assert all(n < 20 for n, of_receipts in sorted_rows if of_receipts)  # those at the cut only
    cells = {}
    for t, day, a, b, price in rows:
        cells.setdefault((t, a, b), []).append((day, price))
    bought = {key: (min(d for d, _ in x), sum(p for _, p in x) / len(x)) for key, x in cells.items()}
    low, high = (f(p for _, p in bought.values()) for f in (min, max))
    for (t, a, b), (price, flag) in got.items():
        line = sorted((day, u, p) for (u, *own), (day, p) in bought.items() if own == [a, b])
        at = (f"2024-01-{1 + t % 9:02d}", t)
        want = bought[t, a, b][1] if flag else next((p for d, u, p in line if (d, u) > at), line[-1][2])
        assert price == pytest.approx((want - low) / (high - low))
