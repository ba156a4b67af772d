"""Sales metrics, conditional splits, pivots and shares."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillmark.functions.exprs import bucketize, safe_div
from tillmark.operators.joins import join_keys, with_group
from tillmark.operators.ordered import column_counts, pareto, percentiles, percentiles_of_counts
from tillmark.session import stage

SALE_TYPES = ("SALE", "SELL_MEDIA")
RETURN_TYPE_IDS = ("RR", "RT")


def valid_sales(df: DataFrame, types: Sequence[str] = SALE_TYPES, decimals: int | None = None) -> DataFrame:
    """Sold lines with a positive amount and quantity; ``decimals`` rounds the amount before the test."""
    amount = F.col("amount") if decimals is None else F.round("amount", decimals)
    return df.filter(F.col("transaction_type").isin(*types) & (amount > 0) & (F.col("quantity") > 0))


def not_returned(df: DataFrame) -> DataFrame:
    """The rule for countries that only mark returns: a line without a type is a sale."""
    return df.filter(~F.coalesce(F.col("transaction_type_id").isin(*RETURN_TYPE_IDS), F.lit(False)))


def distinct_counts(df: DataFrame, by: Sequence[str], columns: Mapping[str, str | Column]) -> DataFrame:
    return df.groupBy(*by).agg(*[F.countDistinct(c).alias(name) for name, c in columns.items()])


def kpi_summary(
    df: DataFrame,
    by: Sequence[str] = (),
    customer: str = "customer_id",
    transaction: str = "transaction_id",
    product: str = "product_id",
) -> DataFrame:
    """Sales, volume, receipts, customers, products, discount, weighted price, ATV and RPC per group.

    Lines are reduced to receipts in one pass, each with its sums and its few different products. Receipts, customers and
    products are then counted as rows of one key each, and the counts meet per group, so no line is multiplied for the sake of a distinct count.
    Lines without a receipt number share one set of products, which the catalog bounds.
    """
    receipts = stage(df.groupBy(*by, transaction, customer).agg(
        F.sum("amount").alias("__s"), F.sum("quantity").alias("__q"), F.sum("discount_amount").alias("__d"), F.collect_set(product).alias("__products"),
    ))
    sums = receipts.groupBy(*by).agg(F.sum("__s").alias("sales"), F.sum("__q").alias("volume"), F.sum("__d").alias("discount"))
    items = receipts.select(*by, F.explode("__products").alias("__product"))
    out = _with_counts(sums, by, {
        "transactions": receipts.select(*by, transaction),
        "customers": receipts.select(*by, customer),
        "products": items,
    })
    return out.select(
        "*",
        safe_div("sales", "volume").alias("avg_price"),
        safe_div("sales", "transactions").alias("atv"),
        safe_div("sales", "customers").alias("rpc"),
    )


def _with_counts(sums: DataFrame, by: Sequence[str], keys: Mapping[str, DataFrame]) -> DataFrame:
    """Add to each group the number of different values of the last column of each frame; NULL is none."""
    for name, rows in keys.items():
        per = rows.dropna(subset=[rows.columns[-1]]).distinct().groupBy(*by).agg(F.count(F.lit(1)).alias(name))
        sums = join_keys(sums, per, by) if by else sums.crossJoin(F.broadcast(per))  # one row each
    return sums.na.fill(0, subset=list(keys))


def rollup_distinct(df: DataFrame, levels: Sequence[str], sums: Mapping[str, str], distinct: Mapping[str, str], overall: str = "overall") -> DataFrame:
    """Sums and distinct counts at every level of a hierarchy; collapsed levels read ``overall``.

    Each key's presence per finest group is found once; a level's keys are those of the level below it, so that each level works on
    what the one before has left, and the rows of ``df`` are read once and multiplied by nothing.
    """
    keys = list(distinct.values())
    cells = stage(df.groupBy(*levels, *keys).agg(*[F.sum(c).alias(name) for name, c in sums.items()]))
    totals = cells.groupBy(*levels).agg(*[F.sum(name).alias(name) for name in sums])
    present = {name: cells.select(*levels, key).dropna(subset=[key]).distinct() for name, key in distinct.items()}
    out = None
    for depth in range(len(levels), -1, -1):
        by = list(levels[:depth])
        if depth < len(levels):
            totals = totals.groupBy(*by).agg(*[F.sum(name).alias(name) for name in sums])
            present = {name: rows.select(*by, distinct[name]).distinct() for name, rows in present.items()}
        level = _with_counts(totals, by, present)
        shown = [F.col(c).cast("string").alias(c) if c in by else F.lit(overall).alias(c) for c in levels]
        level = level.select(*shown, *sums, *distinct)
        out = level if out is None else out.unionByName(level)
    return out


def rollup_levels(
    df: DataFrame, levels: Sequence[str], aggs: Sequence[Column], overall: str = "overall"
) -> DataFrame:
    """Totals at every level of a hierarchy in one pass; collapsed levels read ``overall``."""
    out = df.rollup(*levels).agg(*aggs, *[F.grouping(c).alias(f"__g_{c}") for c in levels])
    cols = [F.when(F.col(f"__g_{c}") == 1, F.lit(overall)).otherwise(F.col(c).cast("string")).alias(c) for c in levels]
    return out.select(*cols, *[c for c in out.columns if c not in levels and not c.startswith("__g_")])


def conditional_split(
    df: DataFrame, by: Sequence[str], flag: str, metric: str = "amount", key: str = "customer_id", name: str = "pl"
) -> DataFrame:
    """Sums and distinct keys of flagged rows against all rows, with both shares.

    Rows are first reduced to one per (group, key), which turns both distinct counts into plain sums.
    """
    hit = F.coalesce(F.col(flag) == 1, F.lit(False))
    per = df.groupBy(*by, key).agg(
        F.sum(F.when(hit, F.col(metric)).otherwise(0.0)).alias("__f"),
        F.sum(metric).alias("__m"),
        F.max(hit.cast("int")).alias("__hit"),
    )
    known = F.col(key).isNotNull()
    out = per.groupBy(*by).agg(
        F.sum("__f").alias(f"{name}_sales"),
        F.sum("__m").alias("total_sales"),
        F.sum(F.when(known, F.col("__hit")).otherwise(0)).alias(f"{name}_customers"),
        F.count(key).alias("total_customers"),
    )
    return out.select(
        "*",
        safe_div(f"{name}_sales", "total_sales", 0).alias(f"{name}_sales_share"),
        safe_div(f"{name}_customers", "total_customers", 0).alias(f"{name}_customer_share"),
    )


def share_of(df: DataFrame, metric: str, by: Sequence[str] = (), name: str = "share") -> DataFrame:
    """Share of each row of an aggregated frame in its group (or in all rows)."""
    return with_group(df, by, [F.sum(metric).alias("__t")]).withColumn(name, safe_div(metric, "__t")).drop("__t")


def pivot_metric(df: DataFrame, by: Sequence[str], pivot_col: str, values: Sequence, agg: Column, fill=None) -> DataFrame:
    """One column per listed value; listing them spares Spark a pass to find them."""
    out = df.groupBy(*by).pivot(pivot_col, list(values)).agg(agg)
    return out if fill is None else out.na.fill(fill, subset=[str(v) for v in values])


def pivot_counts(df: DataFrame, by: str, pivot_col: str, values: Sequence, total: str | None = "Total") -> DataFrame:
    """Counts per value with a grand total row."""
    hits = [F.sum(F.when(F.col(pivot_col) == F.lit(v), 1).otherwise(0)).alias(str(v)) for v in values]
    if total is None:
        return df.groupBy(by).agg(*hits)
    return rollup_levels(df, [by], hits, overall=total)


def unpivot_measures(
    df: DataFrame, ids: Sequence[str], columns: Sequence[str], name: str = "measure", value: str = "value"
) -> DataFrame:
    return df.select(*ids, *[F.col(c).cast("double").alias(c) for c in columns]).unpivot(
        list(ids), list(columns), name, value
    )


def transpose_periods(df: DataFrame, period: str, periods: Sequence[str], columns: Sequence[str], ids: Sequence[str] = ()) -> DataFrame:
    """Periods become columns and measures become rows."""
    long = unpivot_measures(df, [*ids, period], columns)
    return long.groupBy(*ids, "measure").pivot(period, list(periods)).agg(F.first("value"))


def quantile_label(
    df: DataFrame, column: str, points: Sequence[float], labels: Sequence[str], name: str = "band", by: Sequence[str] = ()
) -> DataFrame:
    """Label rows by exact percentiles of a column, right-closed (at most the first point: first label)."""
    df = stage(df)
    cuts = percentiles(df, column, {f"__q{i}": p for i, p in enumerate(points)}, by)
    joined = join_keys(df, cuts, by) if by else df.crossJoin(F.broadcast(cuts))
    label = None
    for i in range(len(points)):
        below = F.col(column) <= F.col(f"__q{i}")
        label = F.when(below, F.lit(labels[i])) if label is None else label.when(below, F.lit(labels[i]))
    label = label.when(F.col(column).isNotNull(), F.lit(labels[-1]))
    return joined.withColumn(name, label).select(*df.columns, name)


def growth_flag(df: DataFrame, column: str, name: str = "growth_flag", labels=("Low", "Medium", "High"), negative="Negative") -> DataFrame:
    """Tiers by the 33rd and 66th percentile of the non-negative growths; negative growth apart."""
    df = stage(df)
    cuts = percentiles(df.filter(F.col(column) >= 0), column, {"__p33": 0.33, "__p66": 0.66})
    label = (
        F.when(F.col(column) < 0, F.lit(negative))
        .when(F.col(column) <= F.col("__p33"), F.lit(labels[0]))
        .when(F.col(column) <= F.col("__p66"), F.lit(labels[1]))
        .when(F.col(column).isNotNull(), F.lit(labels[2]))
    )
    return df.crossJoin(F.broadcast(cuts)).withColumn(name, label).select(*df.columns, name)


def quadrants(df: DataFrame, x: str, y: str, x_point: float = 0.95, name: str = "quadrant") -> DataFrame:
    """Four fields: x against a percentile of x, y against the mean of y."""
    df = stage(df)
    cuts = percentiles(df, x, {"__x": x_point}).crossJoin(F.broadcast(df.agg(F.avg(y).alias("__y"))))
    label = F.concat(
        F.when(F.col(x) >= F.col("__x"), F.lit("high ")).otherwise(F.lit("low ")),
        F.lit("x / "),
        F.when(F.col(y) >= F.col("__y"), F.lit("high y")).otherwise(F.lit("low y")),
    )
    return df.crossJoin(F.broadcast(cuts)).withColumn(name, label).select(*df.columns, name)


def quadrant_summary(df: DataFrame, metric: str, name: str = "quadrant") -> DataFrame:
    """Count, metric and share of the metric per quadrant."""
    agg = df.groupBy(name).agg(F.count(F.lit(1)).alias("n"), F.sum(metric).alias(metric))
    return share_of(agg, metric)


def mean_split(df: DataFrame, x: str, y: str, by: Sequence[str], name: str = "move") -> DataFrame:
    """Rows against the group means of two measures: promote, grow, maintain or review."""
    joined = with_group(df, by, [F.avg(x).alias("__mx"), F.avg(y).alias("__my")])
    hi_x, hi_y = F.col(x) >= F.col("__mx"), F.col(y) >= F.col("__my")
    label = (
        F.when(hi_x & hi_y, F.lit("maintain"))
        .when(hi_x, F.lit("grow"))
        .when(hi_y, F.lit("promote"))
        .otherwise(F.lit("review"))
    )
    return joined.withColumn(name, label).drop("__mx", "__my")


def rate_by(df: DataFrame, features: Sequence[str], flag: str) -> DataFrame:
    """Share of flagged rows per level of each feature, long form, in one pass."""
    long = df.select(flag, F.explode(F.array(*[
        F.struct(F.lit(f).alias("feature"), F.col(f).cast("string").alias("level")) for f in features
    ])).alias("__e")).select(flag, "__e.*")
    return long.groupBy("feature", "level").agg(F.count(F.lit(1)).alias("n"), F.avg(flag).alias("rate"))


def summary_stats(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Count, mean, deviation, extremes and exact quartiles, one row per column.

    Everything follows from the rows per (column, value), which are counted before the shuffle.
    """
    counts = stage(column_counts(df, columns))
    basic = counts.groupBy("column").agg(
        F.sum("__n").alias("n"),
        (F.sum(F.col("value") * F.col("__n")) / F.sum("__n")).alias("mean"),
        F.min("value").alias("min"),
        F.max("value").alias("max"),
    )
    gaps = join_keys(counts, basic.select("column", "mean"), ["column"]).groupBy("column").agg(
        F.sqrt(safe_div(F.sum(F.col("__n") * (F.col("value") - F.col("mean")) * (F.col("value") - F.col("mean"))), F.sum("__n") - 1)).alias("std")
    )
    quartiles = percentiles_of_counts(counts, "value", {"p25": 0.25, "p50": 0.5, "p75": 0.75}, ["column"])
    named = df.sparkSession.createDataFrame([(c,) for c in columns], "column string")  # a column without values has a row as well
    out = join_keys(join_keys(join_keys(named, basic, ["column"]), gaps, ["column"]), quartiles, ["column"])
    return out.select("column", F.coalesce("n", F.lit(0)).alias("n"), "mean", "std", "min", "max", "p25", "p50", "p75")


def iqr_bounds(df: DataFrame, columns: Sequence[str], factor: float = 1.5) -> DataFrame:
    """Quartiles and outlier bounds per column."""
    long = df.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("value")) for c in columns
    ])).alias("__e")).select("__e.*")
    q = percentiles(long, "value", {"q1": 0.25, "q3": 0.75}, ["column"])
    spread = (F.col("q3") - F.col("q1")) * F.lit(factor)
    return q.select("column", "q1", "q3", (F.col("q1") - spread).alias("lower"), (F.col("q3") + spread).alias("upper"))


def completeness(df: DataFrame, key: str, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Share of distinct keys with a value, per attribute, long form.

    Keys are reduced to one row of presence flags first, so that the count of each attribute is a
    sum and not one more distinct count over all rows.
    """
    present = df.groupBy(*by, key).agg(*[F.max(F.col(c).isNotNull().cast("int")).alias(c) for c in columns])
    sums = present.filter(F.col(key).isNotNull()).groupBy(*by).agg(
        F.count(F.lit(1)).alias("keys"), *[F.sum(c).cast("double").alias(c) for c in columns]
    )
    return sums.unpivot([*by, "keys"], list(columns), "attribute", "with_value").withColumn(
        "completeness", safe_div("with_value", "keys", 0)
    )


def profile(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows, non-null and distinct values per column."""
    long = df.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns
    ])).alias("__e")).select("__e.*")
    return long.groupBy("column").agg(
        F.count(F.lit(1)).alias("rows"), F.count("value").alias("non_null"), F.countDistinct("value").alias("distinct")
    )


def drop_constant_columns(df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Drop columns with a single value, found in one pass of minima and maxima (one row comes back)."""
    tested = [c for c in df.columns if c not in keep]
    row = df.agg(
        *[(F.min(c) == F.max(c)).alias(c) for c in tested],
        *[(F.count(c) < F.count(F.lit(1))).alias(f"__null_{c}") for c in tested],
    ).first()
    constant = [c for c in tested if row[c] is None or (row[c] and not row[f"__null_{c}"])]
    return df.drop(*constant)


def require_keys(df: DataFrame, keys: Sequence[str], non_negative: Sequence[str] = ()) -> DataFrame:
    out = df.dropna(subset=list(keys))
    for c in non_negative:
        out = out.filter(F.col(c) >= 0)
    return out


def dedupe(df: DataFrame, keys: Sequence[str], order: Sequence[Column] | None = None) -> DataFrame:
    """One row per key: any row, or the first by ``order``."""
    if order is None:
        return df.dropDuplicates(list(keys))
    best = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("__rn", best).filter("__rn = 1").drop("__rn")


def store_penetration(df: DataFrame, product: str, store: str, by: Sequence[str] = (), classes: bool = True) -> DataFrame:
    """Stores selling a product over all stores of the group, with Low/Middle/High classes."""
    carried = df.groupBy(*by, product).agg(F.countDistinct(store).alias("stores"))
    total = df.groupBy(*by).agg(F.countDistinct(store).alias("all_stores"))
    out = join_keys(carried, total, by) if by else carried.crossJoin(F.broadcast(total))
    out = out.withColumn("penetration", F.round(safe_div("stores", "all_stores"), 2))
    if classes:
        out = out.withColumn("pen_class", bucketize("penetration", (0.0, 0.3, 0.7, 1.0), ("Low", "Middle", "High")))
    return out


def customer_penetration(
    df: DataFrame, by: Sequence[str], segment: str, segments: Sequence[str], customer: str = "customer_id"
) -> DataFrame:
    """Customers of a product or brand over all customers, in total and per chosen segment."""
    def counts(prefix: str) -> list[Column]:
        out = [F.countDistinct(customer).alias(f"{prefix}customers")]
        for s in segments:
            out.append(F.countDistinct(F.when(F.col(segment) == s, F.col(customer))).alias(f"{prefix}{s.lower()}_customers"))
        return out

    # one row per (group, customer) before the distinct counts: both sides read the same small frame
    pairs = stage(df.select(*by, customer, segment).distinct())
    own = pairs.groupBy(*by).agg(*counts(""))
    out = own.crossJoin(F.broadcast(pairs.agg(*counts("all_"))))
    names = ["customers", *[f"{s.lower()}_customers" for s in segments]]
    combined = sum((F.col(f"{s.lower()}_customers") for s in segments[1:]), F.col(f"{segments[0].lower()}_customers"))
    return out.select(
        *by,
        *names,
        *[safe_div(n, f"all_{n}", 0).alias(n.replace("customers", "penetration")) for n in names],
        safe_div(combined, "customers", 0).alias("segment_share"),
    )


def numeric_distribution(df: DataFrame, product: str, category: str, store: str = "store_id", by: Sequence[str] = ()) -> DataFrame:
    """Stores selling the product over stores selling its category."""
    triples = stage(df.select(*by, category, product, store).distinct())
    sku = triples.groupBy(*by, category, product).agg(F.countDistinct(store).alias("stores"))
    cat = triples.groupBy(*by, category).agg(F.countDistinct(store).alias("category_stores"))
    return join_keys(sku, cat, [*by, category]).withColumn("numeric_dist", safe_div("stores", "category_stores"))


def weighted_distribution(df: DataFrame, product: str, store: str, week: str, metric: str = "amount") -> DataFrame:
    """Per week: sales of all products in the stores that sold the product over the sales of all stores."""
    cells = stage(df.groupBy(product, store, week).agg(F.sum(metric).alias("__m")))
    store_week = cells.groupBy(store, week).agg(F.sum("__m").alias("__s"))
    week_total = store_week.groupBy(week).agg(F.sum("__s").alias("all_store_sales"))
    carried = (
        cells.select(product, store, week)
        .join(store_week, [store, week])
        .groupBy(product, week)
        .agg(F.count(F.lit(1)).alias("stores"), F.sum("__s").alias("carrying_store_sales"))
    )
    return carried.join(week_total, week).withColumn("cwd", safe_div("carrying_store_sales", "all_store_sales"))


def basket_size(df: DataFrame, by: Sequence[str] = (), transaction: str = "transaction_id", product: str = "product_id") -> DataFrame:
    """Average number of distinct products per receipt."""
    per_receipt = df.groupBy(*by, transaction).agg(F.countDistinct(product).alias("__n"))
    return per_receipt.groupBy(*by).agg(
        F.count(F.lit(1)).alias("receipts"), F.sum("__n").alias("items"), F.avg("__n").alias("basket_size")
    )


def period_average(df: DataFrame, period: str, by: Sequence[str] = ()) -> DataFrame:
    """KPIs per period, then the mean of the periods."""
    per = kpi_summary(df, [*by, period])
    return per.groupBy(*by).agg(
        F.count(F.lit(1)).alias("periods"),
        *[F.avg(c).alias(f"avg_{c}") for c in ("sales", "transactions", "customers", "atv", "rpc")],
    )


def rate_of_sales(df: DataFrame, by: Sequence[str], unit: str) -> DataFrame:
    """Sales per distinct day (or week) with sales."""
    out = df.groupBy(*by).agg(F.sum("amount").alias("sales"), F.countDistinct(unit).alias("periods"))
    return out.withColumn("rate_of_sales", safe_div("sales", "periods"))


def reconcile(df: DataFrame, transaction: str, amount: str, billed: str, tolerance: float = 0.01) -> DataFrame:
    """Line sums against the billed amount of each receipt: match rate."""
    per = df.groupBy(transaction).agg(F.sum(amount).alias("lines"), F.avg(billed).alias("billed"))
    return per.agg(
        F.count(F.lit(1)).alias("receipts"),
        F.sum((F.abs(F.col("lines") - F.col("billed")) <= tolerance).cast("int")).alias("matched"),
    ).withColumn("match_rate", safe_div("matched", "receipts"))


def modal_value(df: DataFrame, by: Sequence[str], column: str, name: str = "modal_value") -> DataFrame:
    """Most frequent value per group, ties kept. The largest count of a group comes from an aggregation."""
    counts = df.groupBy(*by, column).agg(F.count(F.lit(1)).alias("n"))
    return with_group(counts, by, [F.max("n").alias("__n")]).filter("n = __n").select(*by, F.col(column).alias(name), "n")


def count_histogram(df: DataFrame, by: Sequence[str], key: str, item: str, top: int = 4) -> DataFrame:
    """How many keys have 1, 2, ... items, the last class being open (``4+``)."""
    per = df.groupBy(*by, key).agg(F.countDistinct(item).alias("__n"))
    cls = F.when(F.col("__n") >= top, F.lit(f"{top}+")).otherwise(F.col("__n").cast("string"))
    return per.withColumn("class", cls).groupBy(*by, "class").agg(F.count(F.lit(1)).alias("keys"))


def store_deciles(df: DataFrame, store: str, product: str, metric: str = "amount") -> DataFrame:
    """Stores in tenths of cumulative sales share, largest stores first; stores and SKUs per tenth."""
    pairs = stage(df.groupBy(store, product).agg(F.sum(metric).alias(metric)))  # the only pass over the rows
    ranked = pareto(pairs, [store], metric)
    decile = F.least(F.floor(F.col("cum_before") * 10) + 1, F.lit(10)).cast("int")
    tagged = ranked.select(store, F.col(metric).alias("__sales"), decile.alias("decile"))
    skus = pairs.join(tagged, store).groupBy("decile").agg(F.countDistinct(product).alias("skus"))
    stores = tagged.groupBy("decile").agg(F.count(F.lit(1)).alias("stores"), F.sum("__sales").alias("sales"))
    per_store = pairs.join(tagged, store).groupBy("decile").agg(F.count(F.lit(1)).alias("listings"))
    return (
        stores.join(skus, "decile")
        .join(per_store, "decile")
        .select("decile", "stores", "sales", "skus", safe_div("listings", "stores").alias("skus_per_store"))
    )


def share_in_family(df: DataFrame, column: str, value: str, pattern: str, metric: str = "amount") -> DataFrame:
    """Share of one attribute value among the values matching a LIKE pattern."""
    family = df.filter(F.col(column).like(pattern))
    hit = F.sum(F.when(F.col(column) == value, F.col(metric)).otherwise(0.0))
    return family.agg(hit.alias("value_sales"), F.sum(metric).alias("family_sales")).withColumn(
        "share", safe_div("value_sales", "family_sales")
    )
