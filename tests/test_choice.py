"""The choice model and the chain behind it against Newton's method on the same rows."""

from __future__ import annotations

import numpy as np
import pytest

from tillmark.operators import delisting, models
from tillmark.plans import learned, ranging
from tillmark.plans.registry import QUERIES

FOLDER = "/root/testdata/sf0.001"


def newton(x, y, rounds=40):
    beta = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-x @ beta))
        step = np.linalg.lstsq((x * (p * (1 - p))[:, None]).T @ x, x.T @ (y - p), rcond=None)[0]
        beta += step
        if np.abs(step).max() < 1e-10:
            break
    return beta


@pytest.fixture(scope="module")
def chain(spark):
    model, rows, rate, resampled = learned.fitted_choice(spark, FOLDER)
    data = rows.collect()
    levels = {a: sorted({r[a] for r in data if r["part"] == "train"})[1:] for a in learned.ATTRIBUTES}  # the first one is the base
    names = [(a, level) for a in learned.ATTRIBUTES for level in levels[a]] + [("price", None), ("intercept", None)]
    x = np.array([[*(float(r[a] == level) for a, level in names[:-2]), r["price"], 1.0] for r in data])
    y = np.array([r["purchase_flag"] for r in data], dtype=float)
    train = np.array([r["part"] == "train" for r in data])
    return model, rate, resampled, names, x, y, train, newton(x[train], y[train])


def test_coefficients(spark, chain):
    model, _, _, names, _, _, _, beta = chain
    got = {(r["attribute"], r["level"]): r["beta"] for r in models.choice_coefficients(spark, model, learned.ATTRIBUTES, ["price"]).collect()}
    assert got == pytest.approx(dict(zip(names, beta)), abs=2e-3)


def test_report_on_both_parts(spark, chain):
    _, _, _, _, x, y, train, beta = chain
    said = x @ beta > 0
    got = {r["part"]: r for r in QUERIES["fit_choice"](spark, FOLDER).collect()}
    for part, own in (("train", train), ("test", ~train)):
        r = got[part]
        assert r["tp"] + r["fn"] == y[own].sum() and r["tp"] + r["fp"] + r["fn"] + r["tn"] == own.sum()
        assert abs(r["tp"] - (said & (y == 1))[own].sum()) <= 0.01 * own.sum() and abs(r["fp"] - (said & (y == 0))[own].sum()) <= 0.01 * own.sum()


def test_utilities_of_the_chain(spark, chain):
    """Utility is the sum of the coefficients of a SKU's levels, with the intercept at the true purchase rate."""
    _, rate, resampled, names, _, _, _, beta = chain
    of = dict(zip(names, beta))
    base = delisting.recalibrated_intercept(of["intercept", None], rate, resampled)
    got = {(r["department"], r["sku"]): r["utility"] for r in QUERIES["choice_chain"](spark, FOLDER).collect()}
    want = {
        (r["department"], f"{r['brand']} {r['category']}"): base + sum(of.get((a, r[a]), 0.0) for a in learned.ATTRIBUTES)
        for r in ranging.choice_base(spark, FOLDER).collect()
    }
    assert got == pytest.approx(want, abs=5e-3)


def test_share_coefficients_maximise_the_likelihood(spark):
    """Units bought, level by level, are what the model expects."""
    rng = np.random.default_rng(2)
    rows = [(b, c, float(rng.integers(1, 100))) for b in "xyz" for c in "pq"]
    got = delisting.share_coefficients(spark.createDataFrame(rows, "brand string, category string, units double"), ["brand", "category"]).collect()
    beta = {(r["attribute"], r["level"]): r["beta"] for r in got}
    assert beta["brand", "x"] == beta["category", "p"] == 0
    weight = {(b, c): np.exp(beta["brand", b] + beta["category", c]) for b, c, _ in rows}
    total = sum(u for *_, u in rows)
    for n, level in [(0, b) for b in "xyz"] + [(1, c) for c in "pq"]:
        expected = total * sum(w for k, w in weight.items() if k[n] == level) / sum(weight.values())
        assert expected == pytest.approx(sum(r[2] for r in rows if r[n] == level))
