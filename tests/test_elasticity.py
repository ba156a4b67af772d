"""Promo elasticities, pooling, ratios and tree responses against plain Python and planted values."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tillmark.operators import elasticity, models, pricing

PANEL = "sku string, month string, price double, share double, quantity double"


def panel(seed=3, skus=4, months=30):
    rng = random.Random(seed)
    rows = []
    for s in range(skus):
        for m in range(months):
            share = rng.choice([0.0, 0.0, 0.05, 0.1, 0.15, 0.2, 0.25]) if s else rng.choice([0.0, 0.1, 0.2])
            price = rng.uniform(5, 9)
            rows.append((f"s{s}", f"2024-M{m:02d}", price, share, 100 - 4 * price + (60 + 20 * s) * share + rng.gauss(0, 0.5)))
    return rows


def test_promo_elasticity_by_hand(spark):
    rows = panel(months=60) + [("flat", f"2024-M{m:02d}", 5.0, 0.1, 10.0 + m) for m in range(8)]
    df = spark.createDataFrame(rows, PANEL)
    fit = elasticity.fit_price_promo(df, ["sku"], "price", "share", "quantity")
    betas = {r["sku"]: r for r in fit.collect()}
    got = {r["sku"]: r["promo_elasticity"] for r in elasticity.promo_elasticity(df, fit, ["sku"], "month", "price", "share").collect()}
    want = {}
    for s in sorted({r[0] for r in rows} - {"flat"}):
        own = sorted(r for r in rows if r[0] == s)
        x = np.array([[1, r[2], r[3]] for r in own])
        y = np.array([r[4] for r in own])
        b = np.linalg.lstsq(x, y, rcond=None)[0]
        assert [betas[s][c] for c in ("intercept", "price_beta", "promo_beta")] == pytest.approx(b.tolist(), rel=1e-6)
        assert betas[s]["r2"] == pytest.approx(1 - ((y - x @ b) ** 2).sum() / ((y - y.mean()) ** 2).sum())
        shown = [r for r in own if r[3]]
        shown = [r for k, r in enumerate(shown) if not k or shown[k - 1][3] != r[3]]  # repeats of the row before count once
        if len({r[3] for r in shown}) >= 5:
            price = np.mean([r[2] for r in shown])
            want[s] = np.mean([b[2] * d / (b[0] + b[1] * price + b[2] * d) for d in {r[3] for r in shown}])
    assert "flat" not in betas and "s0" not in want and len(want) == 3
    assert got == pytest.approx(want)


def test_held_out_r2_by_hand(spark):
    rows = [(*r, k % 5 == 0) for k, r in enumerate(panel(5))]
    df = spark.createDataFrame(rows, f"{PANEL}, held boolean")
    got = {r["sku"]: r for r in elasticity.held_out_fit(df, ["sku"], "price", "quantity", F.col("held")).collect()}
    for s in got:
        fit, test = ([r for r in rows if r[0] == s and r[5] == held] for held in (False, True))
        b, a = np.polyfit([r[2] for r in fit], [r[4] for r in fit], 1)
        for part, name in ((fit, "r2_train"), (test, "r2_test")):
            y = np.array([r[4] for r in part])
            e = y - a - b * np.array([r[2] for r in part])
            assert got[s][name] == pytest.approx(1 - (e**2).sum() / ((y - y.mean()) ** 2).sum())
        assert (got[s]["n_train"], got[s]["n_test"]) == (len(fit), len(test))


def test_ratios_to_every_sku_of_the_group(spark):
    rows = [("g", f"s{k:02d}", "m1", float(k + 1)) for k in range(30)] + [("g", "s00", "m2", 4.0), ("h", "s99", "m1", 0.0), (None, "x", "m1", 2.0)]
    df = spark.createDataFrame(rows, "demand_group string, sku string, month string, price double")
    got = {(r["demand_group"], r["month"], r["sku"], r["reference"]): r["price_ratio"] for r in pricing.price_ratios(df, "sku", "month", ["demand_group"], "price").collect()}
    assert len(got) == 30 * 30 + 3 and got["g", "m1", "s29", "s00"] == 30 and got["g", "m2", "s00", "s00"] == 1
    assert got["h", "m1", "s99", "s99"] is None and got[None, "m1", "x", "x"] == 1


def test_ratio_query_compares_all_brands_of_a_region_and_month(spark, tmp_path):
    import random

    import tables
    from tillmark.plans.catalog import QUERIES

    rows = QUERIES["price_ratios"](spark, tables.star(tmp_path / "star", random.Random(1), orders=400)).collect()
    own = {}
    for r in rows:
        own.setdefault((r["region"], r["month"]), {})[r["brand"]] = r["avg_unit_price"]
    assert len(rows) == sum(len(brands) ** 2 for brands in own.values())
    for r in rows:
        assert r["price_ratio"] == pytest.approx(r["avg_unit_price"] / own[r["region"], r["month"]][r["reference"]])
    assert any(r["brand"][:7] != r["reference"][:7] for r in rows) and {"sales", "quantity", "stores", "demand_group"} <= set(rows[0].asDict())


def test_skus_without_a_model_are_pooled(spark):
    rows = [("r", "good", "m1", 5.0, 9.0), ("r", "poor", "m1", 2.0, 4.0), ("r", "none", "m1", 3.0, 6.0), (None, "good", "m1", 1.0, 1.0)]
    df = spark.createDataFrame(rows, "region string, sku string, month string, quantity double, sales double")
    accepted = spark.createDataFrame([("r", "good"), ("r", "other")], "region string, sku string")
    got = pricing.pool_skus(pricing.without_model(df, accepted, ["region", "sku"]), "month", ["region"]).collect()
    assert {(r["region"], r["quantity"], r["sales"], r["avg_unit_price"]) for r in got} == {("r", 5.0, 10.0, 2.0), (None, 1.0, 1.0, 1.0)}


def test_event_themes_are_those_of_the_data(spark):
    days = spark.createDataFrame([("a", "2024-01-01"), ("a", "2024-01-01"), ("new", "2024-01-02"), (None, "2024-02-02")], "event_theme string, event_date string").withColumn("event_date", F.to_date("event_date"))
    got = {r["month"]: (r["ev_a"], r["ev_new"]) for r in pricing.event_features(days).collect()}
    assert got == {"2024-M01": (1, 1), "2024-M02": (0, 0)}


def test_imputation_by_a_flag_of_its_own(spark):
    """The neighbours come from the promo flag, the case from the price flag."""
    rows = [("g", f"s{k}", int(k != 9), int(k % 2), -1.0 - k, 0.5 + k, 1 + k % 3, 1 + k % 4, [float(k), float(k * k), 1.0], ["a"]) for k in range(10)]
    schema = "g string, sku string, accepted int, accepted_promo int, price_elasticity double, promo_elasticity double, content_ordinal int, price_ordinal int, series array<double>, attributes array<string>"
    df = spark.createDataFrame(rows, schema)
    got = {r["sku"]: r for r in elasticity.impute_elasticity(df, ["g"], "sku", flag="accepted_promo", value="promo_elasticity", share="accepted").collect()}
    assert set(got) == {"s0", "s2", "s4", "s6", "s8"} and all(r["case"] == "case 1" for r in got.values())
    assert all(r["elasticity_nearest"] == 0.5 + int(r["nearest_sku"][1:]) and int(r["nearest_sku"][1:]) % 2 for r in got.values())
    own = elasticity.accepted_and_imputed(df, elasticity.impute_elasticity(df, ["g"], "sku", flag="accepted", value="price_elasticity"), ["g", "sku"], "accepted", "price_elasticity").collect()
    assert len(own) == 10 and sum(r["criteria"] == "accepted set" for r in own) == 9


@pytest.mark.parametrize("kind", ["rf", "gbt"])
def test_trees_find_the_slope_of_each_key(spark, kind):
    rng = random.Random(2)
    slopes = {(f"s{k:02d}", r): -0.5 - 0.25 * ((k * 3 + (r == "south")) % 10) for k in range(12) for r in ("north", "south")}
    rows = []
    for (sku, region), slope in slopes.items():
        level, size = rng.uniform(3, 20), rng.uniform(50, 500)
        for m in range(80):
            price = level * math.exp(rng.uniform(-0.4, 0.4))
            rows.append((sku, region, m, price, size * (price / level) ** slope * math.exp(rng.gauss(0, 0.03))))
    rows += [("one", "north", m, 5.0, 10.0 + m) for m in range(20)] + [("few", "north", 1, 5.0, 9.0)]
    df = spark.createDataFrame(rows, "sku string, region string, month int, price double, quantity double")
    got = models.tree_elasticities(df, ["sku", "region"], "price", "quantity", models.held_out("sku", "region", "month", tenths=2), kind=kind).collect()
    found = {(r["sku"], r["region"]): r for r in got}
    assert set(found) == set(slopes)
    errors = [abs(found[k]["elasticity"] - slopes[k]) for k in slopes]
    assert np.mean(errors) < 0.25 and max(errors) < 0.8
    assert np.corrcoef([found[k]["elasticity"] for k in slopes], list(slopes.values()))[0, 1] > 0.95
    assert min(r["r2_test"] for r in got) > 0.5 and np.mean([r["r2_train"] for r in got]) > 0.9


def test_possible_neighbours_hold_the_nearest_under_any_scaling():
    rng = np.random.default_rng(4)
    for _ in range(30):
        d = [rng.integers(0, 6, (12, 40)) * 0.2, rng.random((12, 40)) * 1.5, rng.integers(0, 4, (12, 40)) / 4]
        d[1][rng.random((12, 40)) < 0.2] = np.nan
        most = (3.0, 2.0, 1.0)
        possible = elasticity._possible(d, most, 3)
        for _ in range(20):
            ranges = [rng.uniform(np.nanmax(x) - np.nanmin(x), m) for x, m in zip(d, most)]
            mean = np.round(np.nanmean(np.stack([(x - np.nanmin(x)) / r for x, r in zip(d, ranges)]), axis=0), 9)
            order = np.argsort(mean, axis=1, kind="stable")[:, :3]
            assert np.take_along_axis(possible, order, 1).all()
        assert possible.mean() < 0.6
