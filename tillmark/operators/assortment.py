"""Assortment rationalisation: lifecycle, contribution, recommendation rules and their corrections.

Input frames hold one row per (group, SKU, week) or one per (group, SKU); ``by`` names the columns that
separate runs (region, material group), so every run is decided in the same job.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillmark.functions.exprs import bucketize, growth, safe_div, seeded_order
from tillmark.operators.joins import join_keys, with_group
from tillmark.operators.ordered import avg_rank, pareto, pareto_cut, percentiles, running, upper_median
from tillmark.operators.series import avg_growth, blended_growth, top_n
from tillmark.session import stage

SELLING, LOW_SUPPLY, NO_SALES = "Currently selling", "Low/No supply", "No recent sales"
FAR = 1_000_000


def listing_status(df: DataFrame, key: Sequence[str], day: str, as_of: str, new_days: int, gone_days: int) -> DataFrame:
    """New listing when first sold within ``new_days`` of the date, delisted when unsold for ``gone_days``."""
    ref = F.lit(as_of).cast("date")
    span = df.groupBy(*key).agg(F.min(day).alias("first_sale"), F.max(day).alias("last_sale"))
    return span.select(
        *key,
        "first_sale",
        "last_sale",
        (F.datediff(ref, "first_sale") < new_days).cast("int").alias("new_listing"),
        (F.datediff(ref, "last_sale") >= gone_days).cast("int").alias("delisted"),
    )


def lifecycle(
    weekly: DataFrame, sku: Sequence[str], week: str, last_week: int = 52, current_from: int = 51, low_from: int = 44
) -> DataFrame:
    """First and last selling week of each SKU with its last-sale class, in a year of numbered weeks."""
    span = weekly.groupBy(*sku).agg(
        F.min(week).alias("first_week"), F.max(week).alias("last_selling_week"), F.countDistinct(week).alias("weeks")
    )
    since = F.lit(last_week) - F.col("last_selling_week")
    return span.withColumn(
        "life",
        F.when(since <= last_week - current_from, F.lit(SELLING))
        .when(since <= last_week - low_from, F.lit(LOW_SUPPLY))
        .otherwise(F.lit(NO_SALES)),
    )


def first_sale_class(first_week: str = "first_week", max_week: int = 52) -> Column:
    """New Launch, Settling, Stable or Established by the distance of the first sale from the year start.

    The distance is ``(max_week - 51) - first_week`` on week numbers that may reach back before the year.
    """
    y = F.lit(max_week - 51) - F.col(first_week)
    return bucketize(y, (-FAR, 0, 13, 26, FAR), ("New Launch", "Settling", "Stable", "Established"))


def new_sku_flag_by_week(first_week: str = "first_week", max_week: int = 52, months: int = 6) -> Column:
    """1 when the SKU first sold within the last ``months`` of the numbered weeks."""
    return (F.col(first_week) >= F.lit(max_week - int(months / 3 * 13) + 1)).cast("int")


def analysis_weeks(week: str, max_week: int = 52, months: int = 3) -> Column:
    return F.col(week) > F.lit(max_week - int(months / 3 * 13))


def contribution(
    weekly: DataFrame, sku: str, weights: Mapping[str, float], by: Sequence[str] = (), name: str = "contri"
) -> DataFrame:
    """Weighted sum of a SKU's shares in several metrics."""
    sums = weekly.groupBy(*by, sku).agg(*[F.sum(m).alias(m) for m in weights])
    out = with_group(sums, by, [F.sum(m).alias(f"__{m}") for m in weights])
    blended = sum((safe_div(m, f"__{m}", 0) * F.lit(w) for m, w in weights.items()), F.lit(0.0))
    return out.withColumn(name, blended).drop(*[f"__{m}" for m in weights])


def contribution_tier(
    skus: DataFrame,
    column: str = "contri",
    by: Sequence[str] = (),
    rows: DataFrame | None = None,
    sku: str = "product_id",
    name: str = "tier",
) -> DataFrame:
    """Low, Middle or Top by the 50th and 80th percentile of the non-zero values; zero is Low.

    ``rows`` (one row per SKU and week) makes the percentiles count a SKU once per week it sold.
    """
    skus = stage(skus)
    basis = skus.filter(F.col(column) != 0)
    if rows is not None:
        basis = join_keys(rows.select(*by, sku), basis.select(*by, sku, column), [*by, sku], "inner")
    cuts = percentiles(basis, column, {"__p50": 0.5, "__p80": 0.8}, by)
    out = join_keys(skus, cuts, by) if by else skus.crossJoin(F.broadcast(cuts))
    tier = (
        F.when((F.col(column) == 0) | (F.col(column) <= F.col("__p50")), F.lit("Low"))
        .when(F.col(column) <= F.col("__p80"), F.lit("Middle"))
        .when(F.col(column).isNotNull(), F.lit("Top"))
    )
    return out.withColumn(name, tier).drop("__p50", "__p80")


def sku_growth(weekly: DataFrame, sku: Sequence[str], week: str, weights: Mapping[str, float]) -> DataFrame:
    """Mean of the blended week-on-week growth, first week left out."""
    return avg_growth(blended_growth(weekly, sku, week, weights), sku, week, "growth")


def lookalike_base(
    weekly: DataFrame, sku: Sequence[str], week: str, min_weeks: int = 26, within: int = 32, last_week: int = 52, new_from: int | None = None
) -> DataFrame:
    """First 26 selling weeks of established SKUs: 26 weeks sold in the first 32, still selling, not new."""
    new_from = last_week - 25 if new_from is None else new_from
    span = weekly.groupBy(*sku).agg(F.min(week).alias("__first"), F.max(week).alias("__last"))
    rows = join_keys(weekly, span, sku, "inner")
    early = rows.groupBy(*sku).agg(
        F.countDistinct(F.when(F.col(week) < F.col("__first") + within, F.col(week))).alias("__n"),
        F.max("__first").alias("__f"),
        F.max("__last").alias("__l"),
    )
    chosen = early.filter((F.col("__n") >= min_weeks) & (F.col("__l") >= last_week - 1) & (F.col("__f") < new_from))
    kept = weekly.join(chosen.select(*sku), list(sku), "left_semi")
    return top_n(kept, sku, [F.col(week)], min_weeks, "selling_week")


def new_sku_contribution(
    weekly: DataFrame, sku: str, week: str, weights: Mapping[str, float], new_skus: DataFrame, by: Sequence[str] = ()
) -> DataFrame:
    """Weighted share of each new SKU among the new SKUs of its group since its own first week.

    Group totals per week are few rows; each launch week reads the totals from then on.
    """
    rows = stage(weekly.join(new_skus.select(*by, sku), [*by, sku], "left_semi").select(*by, sku, week, *weights))
    own = rows.groupBy(*by, sku).agg(F.min(week).alias("launch_week"), *[F.sum(m).alias(m) for m in weights])
    totals = rows.groupBy(*by, week).agg(*[F.sum(m).alias(m) for m in weights])
    later = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    onward = later.orderBy(F.col(week).desc()).rowsBetween(Window.unboundedPreceding, 0)
    since = totals.select(*by, F.col(week).alias("launch_week"), *[F.sum(m).over(onward).alias(f"__{m}") for m in weights])
    out = join_keys(own, since, [*by, "launch_week"])
    blended = sum((safe_div(m, f"__{m}", 0) * F.lit(w) for m, w in weights.items()), F.lit(0.0))
    return out.withColumn("contri", blended).drop(*[f"__{m}" for m in weights])


def sku_facts(
    weekly: DataFrame,
    sku: str,
    week: str,
    weights: Mapping[str, float],
    by: Sequence[str] = (),
    max_week: int = 52,
    months: int = 3,
    new_months: int = 6,
    min_weeks: int = 26,
    within: int = 32,
) -> DataFrame:
    """Everything the recommendation looks at that a SKU's own weeks tell, in one pass over the weekly sums.

    Life cycle, mean growth, sums of the analysis weeks and their number, the new-SKU flag, and for look-alikes (see :func:`lookalike_base`) the mean growth of
    their first ``min_weeks`` weeks. ``weekly`` has one row per SKU and week, so a window holds a SKU's year. Sums read ``recent_x`` (analysis weeks) and
    ``all_x`` for each metric x.
    """
    keys = [*by, sku]
    own = Window.partitionBy(*keys)
    ordered = own.orderBy(week)
    step = sum((safe_div(F.col(m) - F.lag(m).over(ordered), F.lag(m).over(ordered), 0) * F.lit(w) for m, w in weights.items()), F.lit(0.0))
    rows = weekly.select(*keys, week, *weights, step.alias("__g"), F.row_number().over(ordered).alias("__n"), F.min(week).over(own).alias("__first"))
    recent = analysis_weeks(week, max_week, months)
    facts = rows.groupBy(*keys).agg(
        F.max("__first").alias("first_week"),
        F.max(week).alias("last_selling_week"),
        F.count(F.lit(1)).alias("weeks"),
        F.avg(F.when(F.col("__n") > 1, F.col("__g"))).alias("avg_growth"),
        F.avg(F.when((F.col("__n") > 1) & (F.col("__n") <= min_weeks), F.col("__g"))).alias("__early"),
        F.sum(F.when(F.col(week) < F.col("__first") + within, 1).otherwise(0)).alias("__within"),
        F.sum(F.when(recent, 1).otherwise(0)).alias("recent_weeks"),
        *[F.sum(F.when(recent, F.col(m))).alias(f"recent_{m}") for m in weights],
        *[F.sum(m).alias(f"all_{m}") for m in weights],
    )
    since = F.lit(max_week) - F.col("last_selling_week")
    life = F.when(since <= 1, F.lit(SELLING)).when(since <= max_week - 44, F.lit(LOW_SUPPLY)).otherwise(F.lit(NO_SALES))
    is_new = new_sku_flag_by_week("first_week", max_week, new_months)
    alike = (F.col("__within") >= min_weeks) & (F.col("last_selling_week") >= max_week - 1) & (is_new == 0)
    return facts.withColumns({"life": life, "is_new": is_new, "alike_growth": F.when(alike, F.col("__early"))}).drop("__early", "__within")


def recommend(
    skus: DataFrame,
    by: Sequence[str] = (),
    growth_col: str = "avg_growth",
    lookalike_growth: Column | float = 0.0,
    new_floor: Column | float = 0.0,
) -> DataFrame:
    """Grow, Maintain, Observe or Delist.

    ``skus`` has columns tier, life, pen_class, is_new, contri and the growth column. New SKUs are judged
    against the growth of look-alikes and the smallest Middle contribution, the others against the upper
    median growth of their tier.
    """
    g = F.col(growth_col)
    skus = stage(skus)
    established = skus.filter((F.col("is_new") == 0) & g.isNotNull())
    medians = upper_median(established, growth_col, "__median", [*by, "tier"])
    out = join_keys(skus, medians, [*by, "tier"])
    look = lookalike_growth if isinstance(lookalike_growth, Column) else F.lit(float(lookalike_growth))
    floor = new_floor if isinstance(new_floor, Column) else F.lit(float(new_floor))
    selling = F.col("life") == SELLING
    fast, worthy = g >= look, F.col("contri") >= floor
    new = (
        F.when(fast & worthy, F.lit("Grow"))
        .when(fast | worthy, F.lit("Maintain"))
        .when(selling, F.lit("Observe"))
        .otherwise(F.lit("Delist"))
    )
    ahead = g >= F.col("__median")
    pen = F.col("pen_class")
    top = F.when(ahead, F.lit("Maintain")).otherwise(F.lit("Grow"))
    middle = (
        F.when(ahead & selling & (pen == "High"), F.lit("Maintain"))
        .when(ahead & selling, F.lit("Grow"))
        .otherwise(F.lit("Observe"))
    )
    low = (
        F.when(ahead & selling & (pen != "Low"), F.lit("Maintain"))
        .when(ahead, F.lit("Observe"))
        .when(selling & (pen == "Low"), F.lit("Observe"))
        .otherwise(F.lit("Delist"))
    )
    bucket = (
        F.when(F.col("is_new") == 1, new)
        .when(F.col("tier") == "Top", top)
        .when(F.col("tier") == "Middle", middle)
        .otherwise(low)
    )
    return out.withColumn("bucket", bucket).drop("__median")


def tail_delist(
    skus: DataFrame, key: str, metric: str, share_percent: float, count_percent: float, by: Sequence[str] = ()
) -> DataFrame:
    """Low-tier SKUs in the last ``share_percent`` of cumulative contribution go to Delist.

    Done only where they are at most ``count_percent`` of the SKUs of the group.
    """
    skus = stage(skus)
    low = pareto(skus.filter(F.col("tier") == "Low"), [key], metric, by).select(*by, key, F.col("cum_share").alias("__cum"))
    marked = join_keys(skus, low, [*by, key]).withColumn(
        "__tail", F.coalesce((F.col("__cum") > 1 - share_percent / 100).cast("int"), F.lit(0))
    )
    guarded = with_group(marked, by, [F.sum("__tail").alias("__tails"), F.count(F.lit(1)).alias("__n")])
    allowed = F.col("__tails") <= F.floor(F.col("__n") * count_percent / 100)
    return guarded.withColumn(
        "bucket", F.when(allowed & (F.col("__tail") == 1), F.lit("Delist")).otherwise(F.col("bucket"))
    ).drop("__cum", "__tail", "__tails", "__n")


def adjust_by_gp(skus: DataFrame, own_label: str | None = None) -> DataFrame:
    """Move buckets up or down by the gross-profit tier (column gp_tier); optionally protect the house label."""
    b, gp, pen = F.col("bucket"), F.col("gp_tier"), F.col("pen_class")
    top = (
        F.when((b == "Grow") & (gp == "Low"), F.lit("Maintain"))
        .when((b == "Maintain") & (gp == "Top"), F.lit("Grow"))
        .otherwise(b)
    )
    middle = (
        F.when((b == "Grow") & (gp == "Low"), F.lit("Maintain"))
        .when((b == "Maintain") & (gp == "Top"), F.lit("Grow"))
        .when((b == "Maintain") & (gp == "Low"), F.lit("Observe"))
        .when((b == "Observe") & (gp == "Top"), F.lit("Maintain"))
        .otherwise(b)
    )
    low = (
        F.when((b == "Maintain") & (gp == "Low") & (pen != "Low"), F.lit("Observe"))
        .when((b == "Observe") & (gp == "Top") & (pen != "Low"), F.lit("Maintain"))
        .when((b == "Delist") & (gp != "Low") & (pen != "Low"), F.lit("Observe"))
        .otherwise(b)
    )
    tier = F.col("tier")
    moved = F.when(F.col("is_new") == 1, b).when(tier == "Top", top).when(tier == "Middle", middle).otherwise(low)
    if own_label:
        protected = (F.col(own_label) == 1) & ((tier == "Low") | (F.col("is_new") == 1))
        moved = F.when(protected & (moved == "Delist"), F.lit("Observe")).otherwise(moved)
    return skus.withColumn("new_bucket", moved)


def rescue_delists(delists: DataFrame, by: Sequence[str] = (), rank: int = 15) -> DataFrame:
    """Delisted SKUs with high profit and rising sales go back to Observe.

    ``delists`` has gp, sales_q4 and sales_q3 per SKU. The mean growth is that of the SKUs ranked within
    ``rank`` on profit.
    """
    ranked = avg_rank(delists, "gp", "gp_rank", by)
    ranked = avg_rank(ranked, "sales_q4", "sales_rank", by).withColumn("q_growth", growth("sales_q4", "sales_q3"))
    out = with_group(ranked, by, [F.avg(F.when(F.col("gp_rank") <= rank, F.col("q_growth"))).alias("__g")])
    keep = (
        (F.col("gp_rank") <= rank)
        & (F.col("q_growth") > F.col("__g"))
        & (F.col("q_growth") > 0)
        & (F.col("sales_rank") <= rank)
    )
    return out.withColumn("bucket", F.when(keep, F.lit("Observe")).otherwise(F.lit("Delist"))).drop("__g")


def gross_profit(sales: DataFrame, gp: DataFrame, keys: Sequence[str], percent: str = "gp_percent", metric: str = "sales") -> DataFrame:
    """Absolute gross profit from a monthly percentage table; no entry means 0."""
    out = join_keys(sales, gp.select(*keys, percent), keys)
    return out.withColumn("gp", F.coalesce(F.col(metric) * F.col(percent) / 100, F.lit(0.0)))


def compress_attribute(df: DataFrame, column: str, metric: str, cut: float = 0.8, other: str = "Others", by: Sequence[str] = ()) -> DataFrame:
    """Values outside the first ``cut`` of cumulative sales become ``other``."""
    return compress_attributes(df, [column], metric, cut, by, other)


def compress_attributes(
    df: DataFrame, columns: Sequence[str], metric: str, cut: float = 0.8, by: Sequence[str] = (), other: str = "Others"
) -> DataFrame:
    """As ``compress_attribute`` for several columns: their values are summed in one pass over the rows."""
    sums = stage(df.groupBy(*by, *columns).agg(F.sum(metric).alias(metric)))
    for c in columns:
        kept = pareto_cut(sums, [c], metric, cut, by).select(*by, c, F.lit(1).alias("__kept"))
        df = join_keys(df, kept, [*by, c]).withColumn(c, F.when(F.col("__kept") == 1, F.col(c)).otherwise(F.lit(other))).drop("__kept")
    return df


def stratified_sample(df: DataFrame, by: Sequence[str], key: Sequence[str], fraction: float, seed: int = 42, margin: float = 0.25) -> DataFrame:
    """A share of each stratum, at least one row, chosen by a seeded hash so that reruns agree.

    The rows of a stratum with the smallest hashes are taken, and most rows need not move to find them: those with a hash under a threshold a
    ``margin`` above the share are kept where they are read. A stratum that has as many of them as it is to give is settled, since its smallest
    hashes are then all among them. The others (mostly small ones, which give one row) are looked at again under a threshold eight times as
    high, up to all rows. Rows with the same key have the same hash and place.
    """
    hashed = df.withColumn("__h", seeded_order(seed, *key))
    wanted = stage(hashed.groupBy(*by).agg(F.count(F.lit(1)).alias("__all")).select(*by, F.greatest(F.lit(1), F.round(F.col("__all") * fraction)).cast("long").alias("__k")))
    out, open_, share = None, None, fraction * (1 + margin)
    while True:
        low = hashed if share >= 1 else hashed.filter(F.substring("__h", 1, 8) < F.lit(f"{int(share * 2**32):08x}"))
        if open_ is not None:
            low = join_keys(low, open_, by, "left_semi")
        low = stage(low)
        got = join_keys(wanted if open_ is None else open_, low.groupBy(*by).agg(F.count(F.lit(1)).alias("__got")), by)
        settled = F.lit(True) if share >= 1 else F.coalesce(F.col("__got") >= F.col("__k"), F.lit(False))
        got = stage(got.withColumn("__settled", settled))
        ranked = running(join_keys(low, got.filter("__settled").select(*by, "__k"), by, "inner"), [F.col("__h"), *[F.col(k) for k in key]], by, position="__rn")
        part = ranked.filter(F.col("__rn") <= F.col("__k")).select(*df.columns)
        out = part if out is None else out.unionByName(part)
        open_ = got.filter("NOT __settled").select(*by, "__k")
        if share >= 1 or open_.isEmpty():
            return out
        share = min(1.0, share * 8)


def delist_impact(skus: DataFrame, by: Sequence[str], sales: str = "sales") -> DataFrame:
    """SKUs, delisted SKUs and the sales they hold, per type or brand."""
    hit = F.col("delist_flag") == 1
    out = skus.groupBy(*by).agg(
        F.count(F.lit(1)).alias("total_count"),
        F.sum(F.when(hit, 1).otherwise(0)).alias("delist_count"),
        F.sum(sales).alias("sales"),
        F.sum(F.when(hit, F.col(sales)).otherwise(0.0)).alias("delist_sales"),
    )
    return out.select(
        "*",
        safe_div("delist_count", "total_count", 0).alias("delist_share"),
        safe_div("delist_sales", "sales", 0).alias("delist_sales_share"),
    )


def delist_priority(skus: DataFrame, key: str, contri: str = "contri", growth_col: str = "growth", by: Sequence[str] = ()) -> DataFrame:
    """Running numbers over four tiers: mean 0; no sales and growth -1; sales but no growth; the rest by mean."""
    c, g = F.col(contri), F.col(growth_col)
    mean = (c + g) / 2
    tier = F.when(mean == 0, 1).when((c == 0) & (g == -1), 2).when((c != 0) & (g == 0), 3).otherwise(4)
    tagged = skus.withColumn("priority_mean", mean).withColumn("priority_tier", tier)
    inside = F.when(F.col("priority_tier") < 4, c).otherwise(F.col("priority_mean"))
    order = [F.col("priority_tier"), inside, F.when(F.col("priority_tier") < 4, g), F.col(key)]
    return running(tagged, order, by, position="delist_priority")
