"""Running totals, positions, fills and exact percentiles over orders of any length.

A window without a partition, or one whose partition holds a large part of the rows, runs in a single
task. The operators here range-partition the rows on (group, order) instead, so that a group is cut
into consecutive stretches held by different tasks, run the window inside each stretch, and add what
came before from a table with one row per (group, stretch).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillmark.operators.joins import join_keys
from tillmark.session import stage


def stretches(df: DataFrame, order: Sequence[Column], by: Sequence[str] = (), tasks: int | None = None) -> DataFrame:
    """``df`` written out in range order with its stretch number in ``_stretch``.

    The number is stored with the row, so every later reader sees the same cut. Without ``tasks``
    adaptive execution sizes the stretches: it only ever merges neighbours, which keeps the order.
    """
    keys = [*[F.col(c) for c in by], *order]
    ranged = df.repartitionByRange(tasks, *keys) if tasks else df.repartitionByRange(*keys)
    return stage(ranged.withColumn("_stretch", F.spark_partition_id()))


def running(
    df: DataFrame,
    order: Sequence[Column],
    by: Sequence[str] = (),
    sums: Mapping[str, str] | None = None,
    position: str | None = None,
    fills: Mapping[str, str] | None = None,
    totals: Mapping[str, str] | None = None,
    tasks: int | None = None,
) -> DataFrame:
    """Add running values along ``order`` within ``by``.

    ``sums``: new column -> summed column, current row included. ``position``: 1-based row number.
    ``fills``: new column -> column carried forward over NULLs. ``totals``: new column -> column
    summed over the whole group. ``order`` must be a total order for repeatable results.
    """
    sums, fills, totals = dict(sums or {}), dict(fills or {}), dict(totals or {})
    base = stretches(df, order, by, tasks)
    summed = sorted(set(sums.values()) | set(totals.values()))
    within = Window.partitionBy(*by, "_stretch").orderBy(*order)
    upto = within.rowsBetween(Window.unboundedPreceding, 0)

    parts = base.groupBy(*by, "_stretch").agg(
        F.count(F.lit(1)).alias("__n"), *[F.sum(c).alias(f"__s_{c}") for c in summed]
    )
    if fills:
        last_rows = base
        for c in set(fills.values()):
            last_rows = last_rows.withColumn(f"__f_{c}", F.last(c, ignorenulls=True).over(upto))
        last_rows = last_rows.withColumn("__p", F.row_number().over(within))
        carried = last_rows.groupBy(*by, "_stretch").agg(
            *[F.max_by(f"__f_{c}", "__p").alias(f"__f_{c}") for c in set(fills.values())]
        )
        parts = join_keys(parts, carried, [*by, "_stretch"])
    # one row per (group, stretch): a group has at most as many rows here as there are tasks
    groups = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    before = groups.orderBy("_stretch").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.select(
        *by,
        "_stretch",
        F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__n0"),
        *[F.coalesce(F.sum(f"__s_{c}").over(before), F.lit(0)).alias(f"__o_{c}") for c in summed],
        *[F.sum(f"__s_{c}").over(groups).alias(f"__t_{c}") for c in sorted(set(totals.values()))],
        *[F.last(f"__f_{c}", ignorenulls=True).over(before).alias(f"__c_{c}") for c in sorted(set(fills.values()))],
    )
    out = base
    for name, c in sums.items():
        out = out.withColumn(f"__w_{name}", F.coalesce(F.sum(c).over(upto), F.lit(0)))
    for name, c in fills.items():
        out = out.withColumn(f"__w_{name}", F.last(c, ignorenulls=True).over(upto))
    if position:
        out = out.withColumn("__w_pos", F.row_number().over(within))
    out = join_keys(out, offsets, [*by, "_stretch"])
    extra = [(F.col(f"__w_{name}") + F.col(f"__o_{c}")).alias(name) for name, c in sums.items()]
    extra += [F.coalesce(f"__w_{name}", f"__c_{c}").alias(name) for name, c in fills.items()]
    extra += [F.col(f"__t_{c}").alias(name) for name, c in totals.items()]
    if position:
        extra.append((F.col("__w_pos") + F.col("__n0")).alias(position))
    return out.select(*df.columns, *extra)


def value_counts(df: DataFrame, column: str, by: Sequence[str] = ()) -> DataFrame:
    """Rows per (group, value), NULL values left out."""
    return df.filter(F.col(column).isNotNull()).groupBy(*by, column).agg(F.count(F.lit(1)).alias("__n"))


def percentiles(
    df: DataFrame,
    column: str,
    points: Mapping[str, float],
    by: Sequence[str] = (),
    tasks: int | None = None,
) -> DataFrame:
    """Exact percentiles with linear interpolation, one output column per entry of ``points``.

    Equal values are counted before the shuffle and positions come from a running count, so no task
    holds the values of a whole group.
    """
    return percentiles_of_counts(value_counts(df, column, by), column, points, by, tasks)


def percentiles_of_counts(
    counts: DataFrame, column: str, points: Mapping[str, float], by: Sequence[str] = (), tasks: int | None = None
) -> DataFrame:
    """:func:`percentiles` of values whose rows per group have been counted by :func:`value_counts`."""
    ranked = running(counts, [F.col(column).asc()], by, sums={"__c": "__n"}, totals={"__t": "__n"}, tasks=tasks)

    def at(index: Column) -> Column:
        return F.min(F.when(F.col("__c") > index, F.col(column)))

    aggs = [F.max("__t").alias("__t")]
    for name, p in points.items():
        place = (F.col("__t") - 1) * F.lit(float(p))
        aggs += [at(F.floor(place)).alias(f"__lo_{name}"), at(F.ceil(place)).alias(f"__hi_{name}")]
    picked = ranked.groupBy(*by).agg(*aggs)
    out = []
    for name, p in points.items():
        place = (F.col("__t") - 1) * F.lit(float(p))
        fraction = place - F.floor(place)
        out.append((F.col(f"__lo_{name}") + (F.col(f"__hi_{name}") - F.col(f"__lo_{name}")) * fraction).alias(name))
    return picked.select(*by, *out)


def column_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows per (column, value) of several numeric columns, NULL values left out: one pass, counted before the shuffle."""
    cells = [F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("value")) for c in columns]
    return value_counts(df.select(F.explode(F.array(*cells)).alias("__e")).select("__e.*"), "value", ["column"])


def upper_median(df: DataFrame, column: str, name: str, by: Sequence[str] = (), tasks: int | None = None) -> DataFrame:
    """The element at 0-based position n // 2 of the sorted values."""
    ranked = running(
        value_counts(df, column, by), [F.col(column).asc()], by, sums={"__c": "__n"}, totals={"__t": "__n"}, tasks=tasks
    )
    return ranked.groupBy(*by).agg(F.min(F.when(F.col("__c") > F.floor(F.col("__t") / 2), F.col(column))).alias(name))


def avg_rank(
    df: DataFrame, column: str, name: str = "rank", by: Sequence[str] = (), ascending: bool = False, tasks: int | None = None
) -> DataFrame:
    """Rank with ties sharing the mean of their positions; NULL values get a NULL rank."""
    df = stage(df)
    order = F.col(column).asc() if ascending else F.col(column).desc()
    ranked = running(value_counts(df, column, by), [order], by, sums={"__c": "__n"}, tasks=tasks)
    ranks = ranked.select(*by, column, (F.col("__c") - (F.col("__n") - 1) / 2).alias(name))
    return join_keys(df, ranks, [*by, column])


def pareto(
    df: DataFrame,
    key: Sequence[str],
    metric: str,
    by: Sequence[str] = (),
    tasks: int | None = None,
) -> DataFrame:
    """Metric per key with its share and cumulative share, largest first (ties by key).

    ``df`` may be raw rows: they are summed per (by, key) first.
    """
    sums = df.groupBy(*by, *key).agg(F.sum(metric).alias(metric))
    order = [F.col(metric).desc(), *[F.col(k).asc() for k in key]]
    out = running(sums, order, by, sums={"__c": metric}, position="position", totals={"__t": metric}, tasks=tasks)
    return out.select(
        *by,
        *key,
        metric,
        "position",
        F.try_divide(metric, "__t").alias("share"),
        F.try_divide("__c", "__t").alias("cum_share"),
        F.try_divide(F.col("__c") - F.col(metric), F.col("__t")).alias("cum_before"),
    )


def pareto_cut(df: DataFrame, key: Sequence[str], metric: str, cut: float, by: Sequence[str] = (), tasks: int | None = None) -> DataFrame:
    """The largest keys up to and including the one whose cumulative share reaches ``cut``."""
    return pareto(df, key, metric, by, tasks).filter(F.col("cum_before") < cut)


def ffill_bfill(
    df: DataFrame, by: Sequence[str], order: Sequence[str], columns: Sequence[str], tasks: int | None = None
) -> DataFrame:
    """Carry values forward, then backward, within each group. A group of NULLs stays NULL."""
    forward = running(df, [F.col(o).asc() for o in order], by, fills={f"__ff_{c}": c for c in columns}, tasks=tasks)
    both = running(
        forward, [F.col(o).desc() for o in order], by, fills={f"__bf_{c}": f"__ff_{c}" for c in columns}, tasks=tasks
    )
    return both.select(*[F.coalesce(f"__ff_{c}", f"__bf_{c}").alias(c) if c in columns else F.col(c) for c in df.columns])


def nearest_impute(df: DataFrame, by: Sequence[str], day: str, column: str, tasks: int | None = None) -> DataFrame:
    """NULLs take the value of the nearest dated row of the group; the earlier one when equally near."""
    known = F.when(F.col(column).isNotNull(), F.struct(F.col(day).alias("d"), F.col(column).alias("v")))
    tie = [c for c in df.columns if c != day]
    marked = df.withColumn("__k", known)
    order = [F.col(day), *[F.col(c) for c in tie]]
    a = running(marked, [o.asc() for o in order], by, fills={"__prev": "__k"}, tasks=tasks)
    b = running(a, [o.desc() for o in order], by, fills={"__next": "__k"}, tasks=tasks)
    back = F.abs(F.datediff(F.col(day), F.col("__prev.d")))
    ahead = F.abs(F.datediff(F.col("__next.d"), F.col(day)))
    pick = (
        F.when(F.col("__prev").isNull(), F.col("__next.v"))
        .when(F.col("__next").isNull(), F.col("__prev.v"))
        .when(back <= ahead, F.col("__prev.v"))
        .otherwise(F.col("__next.v"))
    )
    return b.select(*[F.coalesce(F.col(c), pick).alias(c) if c == column else F.col(c) for c in df.columns])


def rank_slice(df: DataFrame, order: Sequence[Column], start: int, end: int, by: Sequence[str] = ()) -> DataFrame:
    """Rows at positions ``start`` (inclusive) to ``end`` (exclusive), counted from 0 as Python slices do."""
    return running(df, order, by, position="__pos").filter(
        (F.col("__pos") > start) & (F.col("__pos") <= end)
    ).drop("__pos")
