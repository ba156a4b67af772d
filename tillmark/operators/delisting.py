"""Demand choice, reallocation of delisted demand and constrained delisting."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillmark.functions.exprs import safe_div
from tillmark.operators.joins import join_keys, with_group
from tillmark.operators.ordered import running


def share_coefficients(skus: DataFrame, attributes: Sequence[str], units: str = "units") -> DataFrame:
    """(attribute, level, beta) of an additive logit over attribute levels, from what was bought.

    With one constant for each level the likelihood is highest where the choice probabilities give back the levels' shares of units; over
    the product of the levels a constant is the logarithm of its level's units over those of the base level, the first one in
    order. No model is fitted row by row; :func:`tillmark.operators.models.fit_choice` does that where prices matter. Levels without units have no row.
    """
    out = None
    for a in attributes:
        per = skus.groupBy(F.col(a).cast("string").alias("level")).agg(F.sum(units).alias("__u")).filter(F.col("__u") > 0)
        base = per.agg(F.min_by("__u", "level").alias("__base"))  # one row
        part = per.crossJoin(F.broadcast(base)).select(F.lit(a).alias("attribute"), "level", F.ln(F.col("__u") / F.col("__base")).alias("beta"))
        out = part if out is None else out.unionByName(part)
    return out


def choice_value(
    skus: DataFrame, attributes: Sequence[str], coefficients: DataFrame, intercept: float, by: Sequence[str] = ()
) -> DataFrame:
    """Utility of each SKU from its attribute values, its choice probability and its expected value.

    ``coefficients`` has (attribute, level, beta); levels without an entry are the base levels. ``skus``
    has units, price and margin.
    """
    out = skus
    utility: Column = F.lit(float(intercept))
    for a in attributes:
        betas = coefficients.filter(F.col("attribute") == a).select(
            F.col("level").alias("__level"), F.col("beta").alias(f"__b_{a}")
        )
        out = out.join(betas, F.col(a).cast("string") == F.col("__level"), "left").drop("__level")
        utility = utility + F.coalesce(F.col(f"__b_{a}"), F.lit(0.0))
    out = out.withColumn("utility", utility).drop(*[f"__b_{a}" for a in attributes])
    out = with_group(out.withColumn("beta_exp", F.exp("utility")), by, [F.sum("beta_exp").alias("__sum")])
    p = safe_div("beta_exp", "__sum")
    units = p * F.col("units")
    return out.select(
        "*", p.alias("probability"), units.alias("prob_units"), (F.col("price") * units * F.col("margin")).alias("value")
    ).drop("__sum")


def recalibrated_intercept(intercept: float, true_rate: float, resampled_rate: float) -> float:
    """Intercept of a model fitted on undersampled data, moved back to the true base rate."""
    from math import log

    return intercept - log(true_rate / (1 - true_rate)) + log(resampled_rate / (1 - resampled_rate))


def _pair_sums(kept: Column) -> list[Column]:
    weight = F.col("price") * F.col("margin") * F.col("beta_exp")
    value = F.col("price") * F.col("margin") * F.col("prob_units")
    return [
        F.sum(F.when(kept, weight).otherwise(0.0)).alias("__a"),
        F.sum(F.when(kept, F.col("beta_exp")).otherwise(0.0)).alias("__b"),
        F.sum(F.when(kept, value).otherwise(0.0)).alias("__v"),
        F.sum(F.when(kept, 0.0).otherwise(F.col("prob_units"))).alias("__u"),
    ]


def reallocated_value(skus: DataFrame, removed: Column, by: Sequence[str] = ()) -> DataFrame:
    """Value of each group once the removed SKUs' units are spread over the rest by choice probability."""
    sums = skus.groupBy(*by).agg(
        *_pair_sums(~removed), F.sum(F.when(removed, 1).otherwise(0)).alias("removed_skus"), F.count(F.lit(1)).alias("skus")
    )
    return sums.select(
        *by, "skus", "removed_skus", (F.coalesce(safe_div("__a", "__b"), F.lit(0.0)) * F.col("__u") + F.col("__v")).alias("value")
    )


def leave_one_out(skus: DataFrame, removed: Column, by: Sequence[str] = ()) -> DataFrame:
    """Value of the group if one more SKU went, for each SKU still kept: a closed form over group sums."""
    out = with_group(skus.withColumn("__kept", ~removed), by, _pair_sums(F.col("__kept")), reread=False)
    a = F.col("price") * F.col("margin") * F.col("beta_exp")
    v = F.col("price") * F.col("margin") * F.col("prob_units")
    rate = F.coalesce(safe_div(F.col("__a") - a, F.col("__b") - F.col("beta_exp")), F.lit(0.0))
    value = rate * (F.col("__u") + F.col("prob_units")) + (F.col("__v") - v)
    return out.filter("__kept").withColumn("value_without", value).drop("__kept", "__a", "__b", "__v", "__u")


def delist_candidates(
    skus: DataFrame, protected: Column | None = None, max_gp_share: float = 0.1, max_sales_share: float = 0.1
) -> DataFrame:
    """Mark the SKUs that may go: not protected (brand, new listing) and with small profit and sales shares."""
    ok = (F.col("gp_share") <= max_gp_share) & (F.col("sales_share") <= max_sales_share)
    if protected is not None:
        ok = ok & ~protected
    return skus.withColumn("candidate", ok.cast("int"))


def greedy_delist(skus: DataFrame, key: str, by: Sequence[str], limit_share: float = 0.25) -> DataFrame:
    """Remove SKUs one at a time, each time the candidate whose removal leaves the highest value.

    A group ends at its limit (a share of its SKUs, halves rounded to the even number), without candidates, or when the best removal lowers its value. ``skus``
    has price, margin, beta_exp, prob_units and candidate. The SKUs of a group (a demand group of one region, one row
    for each SKU) meet in a task after one shuffle, where a round is a handful of array operations.
    """
    needed = ["price", "margin", "beta_exp", "prob_units", "candidate"]
    keys = [c for c in [*by, key] if c not in needed]
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in skus.select(*keys).schema)

    def rounds(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(key, ignore_index=True)
        order = _removals(*(group[c].to_numpy(dtype=float) for c in needed), round(len(group) * limit_share))
        return group.loc[order, keys].assign(removed_round=np.arange(1, len(order) + 1, dtype=np.int32))

    gone = skus.select(*keys, *needed).groupBy(*by).applyInPandas(rounds, f"{fields}, removed_round int")
    out = join_keys(skus, gone, [*by, key])
    return out.withColumn("delist_flag", F.col("removed_round").isNotNull().cast("int"))


def _removals(price, margin, beta, units, candidate, limit: int) -> list[int]:
    """Rows in the order of removal; of equal values the first row goes."""
    weight, value = price * margin * beta, price * margin * units
    kept = np.ones(len(price), dtype=bool)
    free = candidate == 1
    held, order = value.sum(), []
    while len(order) < limit and free.any():
        left = beta[kept].sum() - beta
        rate = np.divide(weight[kept].sum() - weight, left, out=np.zeros(len(left)), where=left != 0)
        without = rate * (units[~kept].sum() + units) + (value[kept].sum() - value)
        best = int(np.argmax(np.where(free, without, -np.inf)))
        if not without[best] >= held:
            break
        held = without[best]
        kept[best] = free[best] = False
        order.append(best)
    return order


def protect_variety(skus: DataFrame, key: str, variety: str, units: str, by: Sequence[str] = ()) -> DataFrame:
    """Where every SKU of a variety is delisted, the best selling one stays."""
    best = skus.groupBy(*by, variety).agg(
        F.min("delist_flag").alias("__all"), F.min_by(key, F.struct(-F.col(units), F.col(key))).alias("__best")
    )
    out = join_keys(skus, best, [*by, variety])
    saved = (F.col("__all") == 1) & (F.col(key) == F.col("__best"))
    return out.withColumn("delist_flag", F.when(saved, 0).otherwise(F.col("delist_flag"))).drop("__all", "__best")


def cap_share(skus: DataFrame, key: str, share: str, cap: float, by: Sequence[str] = ()) -> DataFrame:
    """When the delisted SKUs hold ``cap`` or more, the largest of them stay until the excess is covered."""
    delisted = skus.filter(F.col("delist_flag") == 1).select(*by, key, F.col(share).alias("__s"))
    order = [F.col("__s").desc(), F.col(key).asc()]
    ranked = running(delisted, order, by, sums={"__c": "__s"}, position="__p", totals={"__t": "__s"})
    before = F.col("__c") - F.col("__s")
    saved = ranked.filter(
        (F.col("__t") >= cap) & ((F.col("__p") == 1) | (before < F.col("__t") - F.lit(cap)))
    ).select(*by, key, F.lit(1).alias("__saved"))
    out = join_keys(skus, saved, [*by, key])
    return out.withColumn(
        "delist_flag", F.when(F.col("__saved") == 1, 0).otherwise(F.col("delist_flag"))
    ).drop("__saved")


def enforce_constraints(
    skus: DataFrame, key: str, variety: str, units: str, caps: Mapping[str, float], by: Sequence[str] = ()
) -> DataFrame:
    """Variety protection, then the caps in the order given (profit share, sales share)."""
    out = protect_variety(skus, key, variety, units, by)
    for share, cap in caps.items():
        out = cap_share(out, key, share, cap, by)
    return out


def scenario_summary(skus: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """SKUs, shares, value and margin before and after delisting; a fall in margin recommends no delisting."""
    hit = F.col("delist_flag") == 1
    rate = F.col("price") * F.col("margin")
    sums = skus.groupBy(*by).agg(
        F.count(F.lit(1)).alias("skus"),
        F.sum("delist_flag").alias("delisted"),
        F.sum(F.when(hit, F.col("sales_share")).otherwise(0.0)).alias("delist_sales_share"),
        F.sum(F.when(hit, F.col("gp_share")).otherwise(0.0)).alias("delist_gp_share"),
        F.sum(rate * F.col("prob_units")).alias("value_before"),
        F.sum(F.col("price") * F.col("prob_units")).alias("__sales_before"),
        *_pair_sums(~hit),
        F.sum(F.when(hit, 0.0).otherwise(F.col("price") * F.col("beta_exp"))).alias("__sb"),
        F.sum(F.when(hit, 0.0).otherwise(F.col("price") * F.col("prob_units"))).alias("__sv"),
    )
    after = F.coalesce(safe_div("__a", "__b"), F.lit(0.0)) * F.col("__u") + F.col("__v")
    sales_after = F.coalesce(safe_div("__sb", "__b"), F.lit(0.0)) * F.col("__u") + F.col("__sv")
    out = sums.select(
        *by,
        "skus",
        "delisted",
        "delist_sales_share",
        "delist_gp_share",
        "value_before",
        after.alias("value_after"),
        safe_div("value_before", "__sales_before").alias("margin_before"),
        safe_div(after, sales_after).alias("margin_after"),
    )
    return out.withColumn("recommend_delisting", (F.col("margin_after") >= F.col("margin_before")).cast("int"))
