"""Measuring an assortment change: periods around delisting, adoption, incremental profit, promotions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillmark.functions.exprs import growth, safe_div
from tillmark.operators.joins import flag_present, join_keys
from tillmark.operators.series import seasonality_index

POST, PRE = "Post delist", "Pre-delist"


def tag_periods(
    df: DataFrame, events: DataFrame, sku: Sequence[str], group: Sequence[str], day: str, py_end: str, event_day: str = "delisted_date", offset: int = 364
) -> DataFrame:
    """Pre/post labels by the SKU's own delisting day, the group's latest one, and the group's like-for-like one."""
    per_sku = events.groupBy(*sku).agg(F.max(event_day).alias("sku_event"))
    per_group = events.groupBy(*group).agg(F.max(event_day).alias("group_event"))
    out = join_keys(join_keys(df, per_sku, sku), per_group, group)
    d = F.col(day)
    label = lambda test: F.when(test, F.lit(POST)).otherwise(F.lit(PRE))
    lfl = (d >= F.col("group_event")) | (
        (d >= F.date_sub("group_event", offset)) & (d <= F.lit(py_end).cast("date"))
    )
    return out.select(
        "*",
        label(d >= F.col("sku_event")).alias("period_type"),
        label(d >= F.col("group_event")).alias("group_period_type"),
        label(lfl).alias("group_period_type_lfl"),
    )


def new_sku_flag(df: DataFrame, region: str, sku: str, period: str = "group_period_type") -> DataFrame:
    """1 for SKUs of a region sold after the change and never before it."""
    per = df.groupBy(region, sku).agg(
        F.max((F.col(period) == POST).cast("int")).alias("__post"), F.max((F.col(period) == PRE).cast("int")).alias("__pre")
    )
    return per.select(region, sku, F.expr("CASE WHEN __post = 1 AND __pre = 0 THEN 1 ELSE 0 END").alias("new_sku_flag"))


def adoption(recommended: DataFrame, sales: DataFrame, sku: Sequence[str], by: Sequence[str]) -> DataFrame:
    """Recommended against actually delisted SKUs, in number and in sales, volume and profit."""
    totals = sales.groupBy(*sku).agg(F.sum("amount").alias("sales"), F.sum("quantity").alias("volume"), F.sum("gp").alias("gp"))
    joined = join_keys(recommended, totals, sku).na.fill(0, subset=["sales", "volume", "gp"])
    done = F.col("delisted") == 1
    out = joined.groupBy(*by).agg(
        F.count(F.lit(1)).alias("recommended_skus"),
        F.sum(F.when(done, 1).otherwise(0)).alias("delisted_skus"),
        *[F.sum(m).alias(f"recommended_{m}") for m in ("sales", "volume", "gp")],
        *[F.sum(F.when(done, F.col(m)).otherwise(0.0)).alias(f"delisted_{m}") for m in ("sales", "volume", "gp")],
    )
    return out.withColumn("adoption", safe_div("delisted_skus", "recommended_skus", 0))


def pre_post_rca(df: DataFrame, by: Sequence[str], pre: Column, post: Column, day: str = "business_day") -> DataFrame:
    """Sales, profit, margin and rate of sales before and after, with the changes."""
    aggs = []
    for name, test in (("pre", pre), ("post", post)):
        aggs += [
            F.sum(F.when(test, F.col("amount")).otherwise(0.0)).alias(f"{name}_sales"),
            F.sum(F.when(test, F.col("gp")).otherwise(0.0)).alias(f"{name}_gp"),
            F.countDistinct(F.when(test, F.col(day))).alias(f"{name}_days"),
        ]
    out = df.filter(pre | post).groupBy(*by).agg(*aggs)
    for name in ("pre", "post"):
        out = out.withColumn(f"{name}_margin", safe_div(f"{name}_gp", f"{name}_sales", 0)).withColumn(
            f"{name}_ros", safe_div(f"{name}_sales", f"{name}_days", 0)
        )
    return out.select(
        "*",
        (F.col("post_margin") - F.col("pre_margin")).alias("margin_delta"),
        growth("post_sales", "pre_sales").alias("sales_growth"),
        growth("post_ros", "pre_ros").alias("ros_growth"),
    )


def season_adjusted(df: DataFrame, sku: Sequence[str], year: str, month: str, metric: str, gp: str | None = None) -> DataFrame:
    """Sales per SKU and month divided by the seasonality index of the calendar month."""
    index = seasonality_index(df, year, month, metric).select(month, "seasonality_index")
    aggs = [F.sum(metric).alias("sales")] + ([F.sum(gp).alias("gp")] if gp else [])
    cells = df.groupBy(*sku, year, month).agg(*aggs)
    out = join_keys(cells, index, [month], "inner").withColumn("sales_adj", safe_div("sales", "seasonality_index"))
    return out.withColumn("gp_adj", safe_div("gp", "seasonality_index")) if gp else out


def incremental_gp(adjusted: DataFrame, delists: DataFrame, sku: Sequence[str], pre: Column, post: Column, measures: Sequence[str] = ("sales_adj", "gp_adj")) -> DataFrame:
    """After, less what the delisted SKUs made before, less before; per adjusted measure."""
    tagged = flag_present(adjusted, delists, sku, "__gone")
    aggs = []
    for m in measures:
        aggs += [
            F.sum(F.when(pre, F.col(m)).otherwise(0.0)).alias(f"pre_{m}"),
            F.sum(F.when(post, F.col(m)).otherwise(0.0)).alias(f"post_{m}"),
            F.sum(F.when(pre & (F.col("__gone") == 1), F.col(m)).otherwise(0.0)).alias(f"expected_{m}"),
        ]
    out = tagged.agg(*aggs)
    return out.select(
        "*", *[(F.col(f"post_{m}") - F.col(f"expected_{m}") - F.col(f"pre_{m}")).alias(f"incremental_{m}") for m in measures]
    )


def promo_lines(
    promo: DataFrame,
    excluded_groups: Sequence[str] = (),
    excluded_reasons: Sequence[str] = (),
    excluded_media: Sequence[str] = (),
) -> DataFrame:
    """Campaign lines that count as promotion: not voided, with a campaign, exclusions applied.

    An absent group or medium passes; an absent reason does not.
    """
    out = promo.filter(F.col("void_flag").isNull() & F.col("campaign_id").isNotNull())
    if excluded_groups:
        out = out.filter(F.col("pm_campaign_group").isNull() | ~F.col("pm_campaign_group").isin(*excluded_groups))
    if excluded_reasons:
        out = out.filter(~F.col("pm_reason_code").isin(*excluded_reasons))
    if excluded_media:
        out = out.filter(F.col("pm_discount_media_type").isNull() | ~F.col("pm_discount_media_type").isin(*excluded_media))
    return out


def promo_flag(tx: DataFrame, promo: DataFrame, keys: Sequence[str] = ("business_day", "product_id")) -> DataFrame:
    """1 for lines whose day and SKU appear among the promotion lines."""
    return flag_present(tx, promo, keys, "promo_flag")


def monthly_discounts(promo: DataFrame, by: Sequence[str], month: str, points_media: Sequence[str] = (), points_rate: float = 400.0) -> DataFrame:
    """Discount per month and campaign group; amounts given in points are converted to money."""
    amount = F.col("pm_discount_amount")
    money = F.when(F.col("pm_discount_media_type").isin(*points_media), amount / points_rate).otherwise(amount) if points_media else amount
    lines = promo.groupBy(*by, month, "pm_campaign_group").agg(F.sum(money).alias("group_discount"))
    return lines.groupBy(*by, month).agg(
        F.count(F.lit(1)).alias("campaign_groups"), F.sum("group_discount").alias("discount")
    )


def gp_mismatch(sales: DataFrame, gp: DataFrame, keys: Sequence[str], percent: str = "gp_percent") -> DataFrame:
    """Keys where profit exceeds sales, and keys known to one source only."""
    left = sales.select(*keys, F.lit(1).alias("__s")).distinct()
    right = gp.groupBy(*keys).agg(F.max(percent).alias(percent), F.max(F.lit(1)).alias("__g"))
    renamed = right.select(*[F.col(k).alias(f"__right_{k}") for k in keys], percent, "__g")
    cond = None
    for k in keys:
        test = F.col(k).eqNullSafe(F.col(f"__right_{k}"))
        cond = test if cond is None else cond & test
    joined = left.join(renamed, cond, "full")
    issue = (
        F.when(F.col("__g").isNull(), F.lit("no profit entry"))
        .when(F.col("__s").isNull(), F.lit("no sales"))
        .when(F.col(percent) > 100, F.lit("profit above sales"))
    )
    return joined.select(*[F.coalesce(k, f"__right_{k}").alias(k) for k in keys], percent, issue.alias("issue")).filter(
        F.col("issue").isNotNull()
    )
