"""Assortment, delisting, elasticity and model operators on small fixtures."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tillmark.operators import assortment, delisting, elasticity, models


def skus(seed=4, n=14):
    rng = random.Random(seed)
    out = []
    for g in ("g1", "g2"):
        for i in range(n):
            out.append((g, f"s{i:02d}", rng.uniform(1, 9), rng.uniform(0.05, 0.6), math.exp(rng.uniform(-2, 1)), rng.uniform(10, 500), int(rng.random() < 0.8)))
    return out


COLUMNS = "g string, sku string, price double, margin double, beta_exp double, prob_units double, candidate int"


def value(kept, removed):
    b = sum(s[4] for s in kept)
    u = sum(s[5] for s in removed)
    return sum(s[2] * s[3] * (s[5] + s[4] / b * u) for s in kept)


def test_greedy_equals_brute_force(spark):
    data = skus()
    got = delisting.greedy_delist(spark.createDataFrame(data, COLUMNS), "sku", ["g"], limit_share=0.4).collect()
    got = {(r["g"], r["sku"]): r["removed_round"] for r in got if r["delist_flag"]}
    want = {}
    for g in ("g1", "g2"):
        kept, removed = [s for s in data if s[0] == g], []
        previous = value(kept, removed)
        for i in range(1, round(len(kept) * 0.4) + 1):
            options = [(value([k for k in kept if k is not s], [*removed, s]), s) for s in kept if s[6]]
            if not options:
                break
            best, s = max(options, key=lambda o: o[0])
            if best < previous:
                break
            previous = best
            kept.remove(s)
            removed.append(s)
            want[(g, s[1])] = i
    assert got == want and want


def test_half_a_sku_is_rounded_to_the_even_number(spark):
    """A quarter of 10 SKUs are 2 and of 14 are 4: halves go to the even number."""
    for n, want in ((10, 2), (14, 4), (6, 2), (2, 0)):
        data = [("g", f"s{k:02d}", 1.0 + k, 0.1, 0.01, 0.0 if k < 8 else 500.0, int(k < 8)) for k in range(n)]
        got = delisting.greedy_delist(spark.createDataFrame(data, COLUMNS), "sku", ["g"]).filter("delist_flag = 1").count()
        assert got == want


def test_closed_form_of_leaving_one_out(spark):
    data = [s for s in skus(9, 5) if s[0] == "g1"]
    out = delisting.leave_one_out(spark.createDataFrame(data, COLUMNS), F.col("sku") == "s03", ["g"]).collect()
    gone = [s for s in data if s[1] == "s03"]
    for r in out:
        s = next(x for x in data if x[1] == r["sku"])
        assert r["value_without"] == pytest.approx(value([k for k in data if k not in (s, *gone)], [*gone, s]))
    assert len(out) == 4


def test_cap_keeps_the_largest_until_the_excess_is_covered(spark):
    rows = [("g", "a", 0.4, 0), ("g", "b", 0.3, 1), ("g", "c", 0.2, 1), ("g", "d", 0.1, 1)]
    df = spark.createDataFrame(rows, "g string, sku string, share double, delist_flag int")
    flags = lambda cap: {r["sku"] for r in delisting.cap_share(df, "sku", "share", cap, ["g"]).collect() if r["delist_flag"]}
    assert flags(0.7) == {"b", "c", "d"}
    assert flags(0.35) == {"c", "d"}
    assert flags(0.25) == {"d"}


def test_variety_keeps_its_best_sku(spark):
    rows = [("t", "a", 5.0, 1), ("t", "b", 9.0, 1), ("u", "c", 1.0, 1), ("u", "d", 1.0, 0)]
    df = spark.createDataFrame(rows, "variety string, sku string, units double, delist_flag int")
    out = {r["sku"]: r["delist_flag"] for r in delisting.protect_variety(df, "sku", "variety", "units").collect()}
    assert out == {"a": 1, "b": 0, "c": 1, "d": 0}


def test_recommendation_buckets(spark):
    S, N = assortment.SELLING, assortment.NO_SALES
    rows = [
        ("t1", "Top", S, "High", 0.2, 0.1, 0), ("t2", "Top", S, "High", 0.3, 0.1, 0),
        ("m1", "Middle", S, "High", 0.1, 0.05, 0), ("m2", "Middle", S, "Low", 0.5, 0.05, 0), ("m3", "Middle", S, "High", 0.3, 0.05, 0),
        ("l1", "Low", S, "Middle", 0.3, 0.01, 0), ("l2", "Low", N, "Low", 0.1, 0.01, 0), ("l3", "Low", S, "Low", 0.1, 0.01, 0), ("l4", "Low", N, "Low", 0.4, 0.01, 0),
        ("n1", "Low", S, "Low", 0.5, 0.5, 1), ("n2", "Low", S, "Low", 0.0, 0.5, 1), ("n3", "Low", S, "Low", 0.0, 0.0, 1), ("n4", "Low", N, "Low", 0.0, 0.0, 1),
    ]
    df = spark.createDataFrame(rows, "sku string, tier string, life string, pen_class string, avg_growth double, contri double, is_new int")
    got = {r["sku"]: r["bucket"] for r in assortment.recommend(df, lookalike_growth=0.2, new_floor=0.1).collect()}
    assert got == {
        "t1": "Grow", "t2": "Maintain", "m1": "Observe", "m2": "Grow", "m3": "Maintain", "l1": "Maintain", "l2": "Delist", "l3": "Observe",
        "l4": "Observe", "n1": "Grow", "n2": "Maintain", "n3": "Observe", "n4": "Delist",
    }


def test_new_launch_classes(spark):
    df = spark.createDataFrame([(105,), (53,), (52,), (40,), (27,), (26,), (1,)], "first_week int")
    got = [r[0] for r in df.select(assortment.first_sale_class(max_week=104)).collect()]
    assert got == ["New Launch", "New Launch", "Settling", "Settling", "Stable", "Established", "Established"]


def test_known_elasticity_is_found(spark):
    rows = [("a", p, 100 * p**-1.5) for p in (1.0, 2.0, 3.0, 5.0)] + [("b", p, 50 - 4 * p) for p in (1.0, 2.0, 4.0)]
    df = spark.createDataFrame(rows, "sku string, p double, q double")
    a = {r["sku"]: r for r in elasticity.fit_elasticity(df, ["sku"], "p", "q").collect()}["a"]
    assert (a["elasticity"], a["r2"], a["rmse"]) == pytest.approx((-1.5, 1.0, 0.0), abs=1e-6)
    b = {r["sku"]: r for r in elasticity.fit_elasticity(df, ["sku"], "p", "q", "linear").collect()}["b"]
    assert b["elasticity"] == pytest.approx(np.mean([-4 * p / (50 - 4 * p) for p in (1, 2, 4)]))


def test_several_predictors(spark):
    rng = np.random.default_rng(0)
    x, z = rng.normal(size=60), rng.normal(size=60)
    y = 2 + 3 * x - z + rng.normal(scale=0.1, size=60)
    df = spark.createDataFrame([("g", float(a), float(b), float(c)) for a, b, c in zip(x, z, y)], "g string, x double, z double, y double")
    r = elasticity.fit_ols(df, ["g"], ["x", "z"], "y").first()
    want, sse, *_ = np.linalg.lstsq(np.c_[np.ones(60), x, z], y, rcond=None)
    assert r["coefficients"] == pytest.approx(list(want))
    assert r["r2"] == pytest.approx(1 - sse[0] / ((y - y.mean()) ** 2).sum())


def _impute_by_hand(rows):
    weak, strong = [r for r in rows if r["acceptable"] == 0], [r for r in rows if r["acceptable"] == 1]
    parts = np.full((3, len(weak), len(strong)), np.nan)
    for i, a in enumerate(weak):
        for j, b in enumerate(strong):
            parts[0, i, j] = 0.2 * abs(a["content_ordinal"] - b["content_ordinal"]) + 0.8 * abs(a["price_ordinal"] - b["price_ordinal"])
            both = [(p, q) for p, q in zip(a["series"], b["series"]) if p is not None and q is not None]
            if len(both) >= 2 and len({p for p, _ in both}) > 1 and len({q for _, q in both}) > 1:
                parts[1, i, j] = 1 - np.corrcoef(*zip(*both))[0, 1]
            parts[2, i, j] = 1 - np.mean([p == q for p, q in zip(a["attributes"], b["attributes"])])
    scaled = np.stack([(p - np.nanmin(p)) / (np.nanmax(p) - np.nanmin(p)) for p in parts])
    mean = np.round(np.nanmean(scaled, axis=0), 9)
    out = {}
    for i, a in enumerate(weak):
        order = sorted(range(len(strong)), key=lambda j: (mean[i, j], strong[j]["sku"]))[:3]
        out[a["sku"]] = (strong[order[0]]["sku"], strong[order[0]]["elasticity"], float(np.mean([strong[j]["elasticity"] for j in order])))
    return out


@pytest.mark.parametrize("block", [500, 3])
def test_imputation_from_similar_skus(spark, block):
    rng = random.Random(8)
    rows = [
        {
            "g": "g", "sku": f"s{i:02d}", "acceptable": int(i % 3 > 0), "elasticity": -rng.uniform(0.5, 3), "content_ordinal": rng.randrange(1, 6),
            "price_ordinal": rng.randrange(1, 5), "series": [None if rng.random() < 0.3 else float(rng.randrange(50)) for _ in range(12)],
            "attributes": [rng.choice("ab"), rng.choice("xyz")],
        }
        for i in range(16)
    ]
    schema = "g string, sku string, acceptable int, elasticity double, content_ordinal int, price_ordinal int, series array<double>, attributes array<string>"
    got = elasticity.impute_elasticity(spark.createDataFrame(rows, schema), ["g"], "sku", block=block).collect()
    want = _impute_by_hand(rows)
    assert {r["sku"] for r in got} == set(want)
    for r in got:
        nearest, one, three = want[r["sku"]]
        assert r["nearest_sku"] == nearest
        assert (r["elasticity_nearest"], r["elasticity_top3"]) == pytest.approx((one, three))
        assert r["case"] == "case 2"


def test_boxcox_finds_the_log(spark):
    rng = np.random.default_rng(1)
    df = spark.createDataFrame([(float(v),) for v in np.exp(rng.normal(size=800))], "v double")
    assert abs(elasticity.boxcox_lambda(df, "v")) < 0.12


def test_choice_rows_are_balanced_and_never_contradict(spark):
    rng = random.Random(6)
    rows = [(t, f"2024-01-{1 + t % 28:02d}", rng.choice("abc"), rng.choice("xy"), float(rng.randrange(5, 20))) for t in range(150) for _ in range(2)]
    df = spark.createDataFrame(rows, "t int, day string, a string, b string, price double").withColumn("day", F.to_date("day"))
    out, rate = models.choice_dataset(df, "t", "day", ["a", "b"], "price")
    got = out.collect()
    bought = {(t, a, b) for t, _, a, b, _ in rows}
    ones = {(r["t"], r["a"], r["b"]) for r in got if r["purchase_flag"] == 1}
    zeros = [(r["t"], r["a"], r["b"]) for r in got if r["purchase_flag"] == 0]
    assert ones == bought and len(zeros) == len(set(zeros)) == len(bought) and not set(zeros) & bought
    assert rate == pytest.approx(len(bought) / (150 * 6))
    assert all(0 <= r["price"] <= 1 for r in got)


def test_logistic_recovers_preferences(spark):
    rng = random.Random(0)
    rows = []
    for k in range(4000):
        a, x = rng.choice("abc"), rng.random()
        u = {"a": 0.0, "b": 1.0, "c": -1.0}[a] - 2 * x + 0.5
        rows.append((k, a, x, int(rng.random() < 1 / (1 + math.exp(-u)))))
    df = spark.createDataFrame(rows, "k int, a string, x double, purchase_flag int").withColumn("test", models.held_out("k"))
    assert df.filter("test").count() == pytest.approx(1200, abs=100)
    model = models.fit_choice(df.filter("NOT test"), ["a"], ["x"])
    betas = {(r["attribute"], r["level"]): r["beta"] for r in models.choice_coefficients(spark, model, ["a"], ["x"]).collect()}
    assert betas[("x", None)] == pytest.approx(-2, abs=0.4)
    assert betas[("a", "b")] == pytest.approx(1, abs=0.3) and betas[("a", "c")] == pytest.approx(-1, abs=0.3)
    report = {r["test"]: r["accuracy"] for r in models.classification_report(model.transform(df), by=["test"]).collect()}
    assert report[True] > 0.6 and report[False] > 0.6


def test_intercept_goes_back_to_the_base_rate():
    assert delisting.recalibrated_intercept(1.0, 0.1, 0.5) == pytest.approx(1.0 - math.log(0.1 / 0.9))
