"""Price features: base price and discounts, ratios, launches, events, weather."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillmark.functions.dates import month_label, month_number
from tillmark.functions.exprs import bucketize, round_to, safe_div, seeded_order
from tillmark.operators.joins import join_keys, with_group
from tillmark.operators.metrics import share_of
from tillmark.operators.ordered import pareto, percentiles, running
from tillmark.session import stage

# Discount bands, right-closed and contiguous.
DISCOUNT_EDGES = (0.0, 0.05, 0.10, 0.20, 1.0)
DISCOUNT_LABELS = ("<5%", "5-10%", "10-20%", ">20%")


def base_price_discounts(
    tx: DataFrame,
    keys: Sequence[str],
    price: str = "unit_price",
    day: str = "business_day",
    step: float = 0.5,
    days: int = 90,
    discount_from: float = 0.03,
    increase_from: float = 0.1,
) -> DataFrame:
    """Monthly average price against a base price, with discount and price-increase flags.

    The base price is the median, each price counted once per receipt, over the prices first seen 0 to
    ``days`` days before the first sale of the month. Lines are reduced to price points per month before
    anything is joined; a price point is then sent to the at most four months it can bear on, so the
    comparison is an equi-join and not one over date ranges.
    """
    # one pass over the lines: price points and months both come from these cells
    cells = stage(
        tx.withColumn("__month", month_number(day)).groupBy(*keys, "__month", price).agg(
            F.countDistinct("transaction_id").alias("__n"),
            F.min(day).alias("__seen"),
            F.sum("amount").alias("sales"),
            F.sum("quantity").alias("quantity"),
        )
    )
    points = cells.groupBy(*keys, "__month", round_to(price, step).alias("__price")).agg(
        F.sum("__n").alias("__n"), F.min("__seen").alias("__seen")
    )
    months = cells.groupBy(*keys, "__month").agg(
        F.sum("sales").alias("sales"), F.sum("quantity").alias("quantity"), F.min("__seen").alias("__first")
    )
    reach = F.sequence(month_number("__seen"), month_number(F.date_add("__seen", days)))
    sent = points.select(*keys, "__price", "__n", "__seen", F.explode(reach).alias("__month"))
    history = (
        join_keys(sent, months.select(*keys, "__month", "__first"), [*keys, "__month"], "inner")
        .filter(F.datediff("__first", "__seen").between(0, days))
        .groupBy(*keys, "__month", "__price")
        .agg(F.sum("__n").alias("__n"))
    )
    # one row per rounded price of a SKU and month: a handful
    w = Window.partitionBy(*keys, "__month")
    upto = w.orderBy("__price").rowsBetween(Window.unboundedPreceding, 0)
    base = (
        history.withColumn("__c", F.sum("__n").over(upto))
        .withColumn("__t", F.sum("__n").over(w))
        .filter(F.col("__c") * 2 >= F.col("__t"))
        .groupBy(*keys, "__month")
        .agg(F.min("__price").alias("base_price"))
    )
    out = join_keys(months, base, [*keys, "__month"], "inner").withColumn("avg_price", safe_div("sales", "quantity"))
    gap = safe_div(F.col("base_price") - F.col("avg_price"), "base_price")
    flag = F.coalesce(gap >= discount_from, F.lit(False)).cast("int")
    amount = F.when(flag == 1, (F.col("base_price") - F.col("avg_price")) * F.col("quantity")).otherwise(0.0)
    out = out.select(
        *keys,
        month_label("__first").alias("month"),
        "sales",
        "quantity",
        "avg_price",
        "base_price",
        F.coalesce(-gap >= increase_from, F.lit(False)).cast("int").alias("price_increase_flag"),
        flag.alias("discount_flag"),
        amount.alias("discount_amount"),
    )
    percent = F.round(safe_div("discount_amount", "sales", 0), 4)
    band = F.when(percent <= 0, F.lit("No discount")).otherwise(
        F.coalesce(bucketize(percent, DISCOUNT_EDGES, DISCOUNT_LABELS), F.lit(DISCOUNT_LABELS[-1]))
    )
    return out.withColumn("discount_perc", percent).withColumn("discount_band", band)


def monthly_sales(
    tx: DataFrame, keys: Sequence[str], day: str = "business_day", store: str = "store_id", discount: str | None = None, gross: str | None = None
) -> DataFrame:
    """Sales, quantity, stores and average price per month; with ``discount`` and ``gross`` also the share of the undiscounted value given away."""
    given = [F.sum(discount).alias("__d"), F.sum(gross).alias("__g")] if discount else []
    out = tx.groupBy(*keys, month_label(day).alias("month")).agg(
        F.sum("amount").alias("sales"),
        F.sum("quantity").alias("quantity"),
        F.countDistinct(store).alias("stores"),
        *given,
    )
    out = out.withColumn("avg_unit_price", safe_div("sales", "quantity"))
    return out.withColumn("discount_share", safe_div("__d", "__g", 0)).drop("__d", "__g") if discount else out


def price_ratios(df: DataFrame, sku: str, period: str, by: Sequence[str], price: str = "avg_unit_price") -> DataFrame:
    """Each row with its price over that of every SKU of its group in the same period: one row per SKU and reference SKU, itself included.

    ``by`` names the groups whose members are compared (demand group and region, say). The references are the SKUs that the
    data has, met over an equi-join on group and period, so a group of n SKUs gives n rows to each of its SKUs and no list is kept.
    """
    keys = [*by, period]
    other = df.select(*keys, F.col(sku).alias("reference"), F.col(price).alias("__reference_price"))
    return join_keys(df, other, keys, "inner").select(
        *df.columns, "reference", safe_div(price, "__reference_price").alias("price_ratio")
    )


def complement_price(df: DataFrame, period: str, by: Sequence[str], sales: str = "sales", quantity: str = "quantity") -> DataFrame:
    """Average price of all other SKUs of the period and group, and the ratio of the own price to it."""
    out = with_group(df, [*by, period], [F.sum(sales).alias("__s"), F.sum(quantity).alias("__q")])
    other = safe_div(F.col("__s") - F.col(sales), F.col("__q") - F.col(quantity))
    return out.withColumn("comp_price", other).withColumn(
        "price_ratio_comp", safe_div(safe_div(sales, quantity), F.col("comp_price"))
    ).drop("__s", "__q")


def launch_index(
    tx: DataFrame, keys: Sequence[str], store: str = "store_id", day: str = "business_day", floor: float = 0.1, first_month: str | None = None
) -> DataFrame:
    """Stores selling the SKU for the first time over stores selling it, per month.

    Values under ``floor`` and those of the first month of the data (where every store is new) are 0.
    """
    cells = tx.groupBy(*keys, store, month_number(day).alias("__m")).agg(F.min(day).alias("__day"))
    first = F.row_number().over(Window.partitionBy(*keys, store).orderBy("__m")) == 1
    out = cells.withColumn("__new", first.cast("int")).groupBy(*keys, "__m").agg(
        month_label(F.min("__day")).alias("month"),
        F.count(F.lit(1)).alias("stores"),
        F.sum("__new").alias("new_stores"),
    )
    index = F.round(safe_div("new_stores", "stores", 0), 4)
    kept = index >= floor
    if first_month is not None:
        kept = kept & (F.col("month") != first_month)
    return out.select(
        *keys, "month", "stores", "new_stores", F.when(kept, index).otherwise(0.0).alias("new_launch_idx")
    )


def event_days(events: DataFrame, theme: str = "event_theme", start: str = "start_date", end: str = "end_date") -> DataFrame:
    """One row per event theme and day."""
    return events.select(theme, F.explode(F.sequence(F.col(start), F.col(end))).alias("event_date"))


def event_index(days: DataFrame, theme: str = "event_theme", day: str = "event_date", weights: Sequence[float] = (0.45, 0.45, 0.10)) -> DataFrame:
    """Monthly presence of events: their number, days and longest one against the monthly averages."""
    per_theme = days.groupBy(month_label(day).alias("month"), theme).agg(F.countDistinct(day).alias("__d"))
    per_month = per_theme.groupBy("month").agg(
        F.count(F.lit(1)).alias("num_events"), F.sum("__d").alias("event_days"), F.max("__d").alias("longest_event")
    )
    measures = ("num_events", "event_days", "longest_event")
    out = with_group(per_month, [], [F.avg(m).alias(f"__{m}") for m in measures])
    index = sum((safe_div(m, f"__{m}", 0) * F.lit(w) for m, w in zip(measures, weights)), F.lit(0.0))
    return out.select("month", *measures, F.round(index, 3).alias("event_presence_idx"))


def event_features(days: DataFrame, themes: Sequence[str] | None = None, theme: str = "event_theme", day: str = "event_date", most: int = 1000) -> DataFrame:
    """Days per theme and month, one column per theme; without ``themes`` those of the data, up to ``most`` columns."""
    per = days.groupBy(month_label(day).alias("month"), theme).agg(F.countDistinct(day).alias("__n"))
    if themes is None:
        found = [r[0] for r in per.select(theme).where(F.col(theme).isNotNull()).distinct().orderBy(theme).limit(most + 1).collect()]
        if len(found) > most:
            raise ValueError(f"more than {most} themes: keep the long form")
        themes = found
    return per.groupBy("month").agg(
        *[F.coalesce(F.max(F.when(F.col(theme) == t, F.col("__n"))), F.lit(0)).alias(f"ev_{t}") for t in themes]
    )


def monthly_weather(df: DataFrame, by: Sequence[str], day: str = "date") -> DataFrame:
    """Average temperature and total rainfall per month, with their min-max scaled forms."""
    out = df.groupBy(*by, month_label(day).alias("month")).agg(
        F.avg("temp").alias("avg_temp"), F.sum("rainfall").alias("total_rainfall")
    )
    ends = [f(c).alias(f"__{n}_{c}") for c in ("avg_temp", "total_rainfall") for n, f in (("lo", F.min), ("hi", F.max))]
    out = with_group(out, by, ends)
    for c in ("avg_temp", "total_rainfall"):
        out = out.withColumn(
            f"{c}_norm", safe_div(F.col(c) - F.col(f"__lo_{c}"), F.col(f"__hi_{c}") - F.col(f"__lo_{c}"), 0)
        ).drop(f"__lo_{c}", f"__hi_{c}")
    return out


def holiday_months(df: DataFrame, day: str = "holiday_date") -> DataFrame:
    return df.groupBy(month_label(day).alias("month")).agg(F.count(day).alias("num_holidays")).withColumn(
        "has_holidays", F.lit(1)
    )


def jitter_constant(df: DataFrame, by: Sequence[str], price: str, order: Sequence[str], amount: float = 0.1, seed: int = 42) -> DataFrame:
    """Where a SKU has one price only, raise it on one row chosen by a seeded order.

    The row is found by an aggregate (the smallest hash), so no group is sorted.
    """
    spread = df.groupBy(*by).agg(
        F.min(price).alias("__lo"), F.max(price).alias("__hi"), F.min(seeded_order(seed, *by, *order)).alias("__pick")
    )
    out = join_keys(df, spread, by)
    hit = (F.col("__lo") == F.col("__hi")) & (seeded_order(seed, *by, *order) == F.col("__pick"))
    return out.withColumn(price, F.when(hit, F.col(price) + amount).otherwise(F.col(price))).select(*df.columns)


def without_model(panel: DataFrame, accepted: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The rows of a panel whose SKU has no accepted model, be it a poor one or none at all."""
    return join_keys(panel, accepted.select(*keys), keys, "left_anti")


def pool_skus(df: DataFrame, period: str, by: Sequence[str], means: Sequence[str] = ()) -> DataFrame:
    """SKUs without a usable model of their own become one pseudo SKU per group and period, with lags and ratios."""
    from tillmark.operators.series import lag_features, moving_average

    out = df.groupBy(*by, period).agg(
        F.sum("quantity").alias("quantity"), F.sum("sales").alias("sales"), *[F.avg(m).alias(m) for m in means]
    ).withColumn("avg_unit_price", F.round(safe_div("sales", "quantity"), 2))
    out = lag_features(out, by, period, "quantity", (1, 2))
    for n in (2, 4):
        out = moving_average(out, by, period, "avg_unit_price", n, name=f"__ma{n}")
        ratio = F.round(safe_div("avg_unit_price", F.round(F.col(f"__ma{n}"), 2)), 2)
        out = out.withColumn(f"price_ratio_ma{n}", F.coalesce(ratio, F.lit(1.0))).drop(f"__ma{n}")
    return out


def l12_metrics(tx: DataFrame, keys: Sequence[str], period: str, months: int = 12) -> DataFrame:
    """Price, average quantity per selling period and unit discount, over all lines and over discounted ones."""
    per = tx.groupBy(*keys, period).agg(
        F.sum("amount").alias("__s"),
        F.sum("quantity").alias("__q"),
        F.sum("discount_amount").alias("__d"),
        F.sum(F.when(F.col("discount_amount") > 0, F.col("quantity")).otherwise(0.0)).alias("__dq"),
    )
    return per.groupBy(*keys).agg(
        safe_div(F.sum("__s"), F.sum("__q")).alias("avg_unit_price_l12"),
        F.avg("__q").alias("avg_qty_l12"),
        safe_div(F.sum("__d"), F.sum("__q"), 0).alias("unit_discount_overall"),
        safe_div(F.sum("__d"), F.sum("__dq"), 0).alias("unit_discount_conditional"),
    )


def quartile_ordinal(df: DataFrame, column: str, by: Sequence[str], name: str | None = None) -> DataFrame:
    """Quantile class 1..4 per group; fewer classes where there are fewer distinct values."""
    df = stage(df)
    points = {"__q25": 0.25, "__q50": 0.5, "__q75": 0.75, "__t1": 1 / 3, "__t2": 2 / 3}
    cuts = percentiles(df, column, points, by)
    size = df.groupBy(*by).agg(F.countDistinct(column).alias("__u"), F.min(column).alias("__lo"))
    out = join_keys(df, join_keys(size, cuts, by), by)
    edges = (
        F.when(F.col("__u") >= 4, F.array("__q25", "__q50", "__q75"))
        .when(F.col("__u") == 3, F.array("__t1", "__t2"))
        .otherwise(F.array("__q50"))
    )
    inside = F.filter(F.array_distinct(edges), lambda e: (e > F.col("__lo")) & (e < F.col(column)))
    return out.select(*df.columns, F.when(F.col(column).isNotNull(), F.size(inside) + 1).alias(name or f"{column}_ordinal"))


def dense_ordinal(df: DataFrame, column: str, by: Sequence[str], name: str | None = None) -> DataFrame:
    """Dense position of a value among the distinct values of its group."""
    df = stage(df)
    values = df.select(*by, column).distinct()
    # among distinct values the dense rank is the position
    return join_keys(df, running(values, [F.col(column)], by, position=name or f"{column}_ordinal"), [*by, column])


def price_band(items: DataFrame, slabs: DataFrame, keys: Sequence[str], price: str, slab_cols: Sequence[str]) -> DataFrame:
    """Price band of each item by the slab texts of its group (``99&Below``, ``100-199``, ``500&Above``)."""
    out = join_keys(items, slabs.select(*keys, *slab_cols), keys)
    p = F.col(price)
    label: Column | None = None
    for c in slab_cols:
        text = F.col(c)
        below = text.endswith("&Below") & (p <= F.substring_index(text, "&", 1).try_cast("double"))
        above = text.endswith("&Above") & (p >= F.substring_index(text, "&", 1).try_cast("double"))
        between = text.contains("-") & (p >= F.substring_index(text, "-", 1).try_cast("double")) & (
            p < F.substring_index(text, "-", -1).try_cast("double") + 1
        )
        hit = F.coalesce(below | above | between, F.lit(False))
        label = F.when(hit, text) if label is None else label.when(hit, text)
    return out.withColumn("price_band", label).drop(*slab_cols)


def normalize_slabs(slabs: DataFrame, slab_cols: Sequence[str]) -> DataFrame:
    """Blank-free slab texts whose ranges do not overlap.

    The first slab ``lo-hi`` becomes ``hi&Below``; a range starting where the slab before it ends starts one above.
    """
    out = slabs
    for c in slab_cols:
        out = out.withColumn(c, F.regexp_replace(F.col(c), r"\s", ""))
    first = F.col(slab_cols[0])
    out = out.withColumn(
        slab_cols[0], F.when(first.contains("-"), F.concat(F.substring_index(first, "-", -1), F.lit("&Below"))).otherwise(first)
    )
    for before, c in zip(slab_cols, slab_cols[1:]):
        end = F.when(F.col(before).contains("-"), F.substring_index(before, "-", -1)).otherwise(
            F.substring_index(before, "&", 1)
        ).try_cast("int")
        low, high = F.substring_index(c, "-", 1).try_cast("int"), F.substring_index(c, "-", -1)
        shifted = F.concat((low + 1).cast("string"), F.lit("-"), high)
        out = out.withColumn(c, F.when(F.col(c).contains("-") & (low == end), shifted).otherwise(F.col(c)))
    return out


def weighted_elasticity(df: DataFrame, sku: str, value: str, sales: str = "sales") -> DataFrame:
    """Sales-weighted value per SKU over its regions, with the SKU's class of cumulative sales."""
    sums = df.groupBy(sku).agg(F.sum(F.col(value) * F.col(sales)).alias("__w"), F.sum(sales).alias(sales))
    classes = pareto(sums, [sku], sales).select(
        sku, "cum_share", bucketize("cum_share", (0.0, 0.2, 0.5, 1.0 + 1e-9), ("Top 20%", "Middle 30%", "Bottom 50%")).alias("sales_bin")
    )
    return join_keys(sums, classes, [sku]).select(
        sku, sales, safe_div("__w", sales).alias(value), "cum_share", "sales_bin"
    )


def cap_second_max(df: DataFrame, column: str, by: Sequence[str] = ()) -> DataFrame:
    """Replace the largest value by the second largest distinct one."""
    top = with_group(df, by, [F.max(column).alias("__m1")])
    top = with_group(top, by, [F.max(F.when(F.col(column) < F.col("__m1"), F.col(column))).alias("__m2")])
    capped = F.when(F.col(column) == F.col("__m1"), F.coalesce("__m2", column)).otherwise(F.col(column))
    return top.withColumn(column, capped).select(*df.columns)


def sales_mix(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return share_of(df.groupBy(*keys).agg(F.sum("amount").alias("sales")), "sales")
