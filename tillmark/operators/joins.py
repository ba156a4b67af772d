"""Joins, comparisons and grids.

No side is broadcast by hint unless it is one row by construction; dimension tables are left to
Spark's own size check, so the same code runs when a dimension outgrows a broadcast.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillmark.functions.exprs import col
from tillmark.session import stage


def all_of(conditions: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions)


def join_keys(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "left") -> DataFrame:
    """Equi-join on columns of the same name where NULL keys match each other.

    For left, inner, semi and anti joins. Right columns other than the keys are added.
    """
    renamed = right.select(*[F.col(k).alias(f"__right_{k}") for k in keys], *[c for c in right.columns if c not in keys])
    condition = all_of([F.col(k).eqNullSafe(F.col(f"__right_{k}")) for k in keys])
    return left.join(renamed, condition, how).drop(*[f"__right_{k}" for k in keys])


def with_total(df: DataFrame, totals: Sequence[Column], reread: bool = True) -> DataFrame:
    """Add one-row totals of ``df`` to each of its rows; see :func:`with_group` for ``reread``."""
    df = stage(df) if reread else df
    return df.crossJoin(F.broadcast(df.agg(*totals)))


def with_group(df: DataFrame, by: Sequence[str], aggs: Sequence[Column], reread: bool = True) -> DataFrame:
    """Add per-group aggregates to each row.

    Aggregating first combines on the map side, so a group holding a large part of the rows is never
    gathered in one task, as it would be by a window without a frame. ``df`` is meant to be an aggregated
    frame; it feeds both the totals and the rows, so it is written once unless ``reread`` is off.
    """
    if not by:
        return with_total(df, aggs, reread)
    df = stage(df) if reread else df
    return join_keys(df, df.groupBy(*by).agg(*aggs), by)


def star(
    transactions: DataFrame,
    product: DataFrame,
    store: DataFrame,
    product_key: str = "product_id",
    store_key: str = "store_id",
) -> DataFrame:
    """Receipt lines with their product and store columns."""
    return transactions.join(product, product_key).join(store, store_key)


def exclude(df: DataFrame, *others: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of ``df`` whose keys are in none of the other frames.

    The lists are united first: one anti-join, whatever their number. NULL keys in a list exclude
    nothing (a literal NOT IN would return no row at all).
    """
    listed = reduce(DataFrame.unionByName, [o.select(*keys) for o in others]).dropna(subset=list(keys))
    return df.join(listed.distinct(), list(keys), "left_anti")


def keep(df: DataFrame, *others: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of ``df`` whose keys are in at least one of the other frames."""
    listed = reduce(DataFrame.unionByName, [o.select(*keys) for o in others]).dropna(subset=list(keys))
    return df.join(listed.distinct(), list(keys), "left_semi")


def full_compare(
    current: DataFrame, previous: DataFrame, keys: Sequence[str], metrics: Sequence[str], names=("cy", "py")
) -> DataFrame:
    """Two aggregated frames side by side, with keys of either side and 0 where one is absent."""
    sides = []
    for name, df in zip(names, (current, previous)):
        sides.append(
            df.select(*[F.col(k).alias(f"{name}__{k}") for k in keys], *[F.col(m).alias(f"{name}_{m}") for m in metrics])
        )
    a, b = names
    joined = sides[0].join(
        sides[1], all_of([F.col(f"{a}__{k}").eqNullSafe(F.col(f"{b}__{k}")) for k in keys]), "full"
    )
    return joined.select(
        *[F.coalesce(f"{a}__{k}", f"{b}__{k}").alias(k) for k in keys],
        *[F.coalesce(F.col(f"{n}_{m}"), F.lit(0)).alias(f"{n}_{m}") for n in names for m in metrics],
    )


def compare_sets(left: DataFrame, right: DataFrame, keys: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Counts of distinct keys found in both frames or in one only, per group."""
    cols = [*by, *[k for k in keys if k not in by]]
    side = lambda df, is_left: df.select(*cols, F.lit(is_left).alias("__l"), F.lit(not is_left).alias("__r"))
    return compare_parts(side(left, True).unionByName(side(right, False)), F.col("__l"), F.col("__r"), keys, by)


def compare_parts(df: DataFrame, left: Column, right: Column, keys: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """:func:`compare_sets` of two parts of one frame, told apart by conditions, in one pass over it."""
    cols = [*by, *[k for k in keys if k not in by]]
    flag = lambda c: F.coalesce(c, F.lit(False))
    used = df.filter(flag(left) | flag(right))
    present = used.groupBy(*cols).agg(F.max(flag(left)).alias("__a"), F.max(flag(right)).alias("__b"))
    count = lambda test: F.sum(F.when(test, 1).otherwise(0))
    a, b = F.col("__a"), F.col("__b")
    return present.groupBy(*by).agg(count(a & b).alias("both"), count(a & ~b).alias("left_only"), count(b & ~a).alias("right_only"))


def range_join(
    left: DataFrame, right: DataFrame, keys: Sequence[str], left_date: str, right_date: str, low: int, high: int
) -> DataFrame:
    """Pairs with equal keys and ``low <= datediff(left_date, right_date) <= high``.

    Days are cut into stretches as long as the range; each right row goes to the two stretches its
    partners can lie in. The stretch joins the key in the shuffle, so one key is spread over time
    and only neighbours in time are compared.
    """
    width = max(high - low, 1)
    origin = F.lit("1970-01-01").cast("date")
    stretch = lambda days: F.floor(days / F.lit(width))
    right_day = F.datediff(F.col(right_date), origin)
    a = left.withColumn("__stretch", stretch(F.datediff(F.col(left_date), origin)))
    b = right.select(
        *[F.col(k).alias(f"__right_{k}") for k in keys],
        *[c for c in right.columns if c not in keys],
        F.explode(F.sequence(stretch(right_day + low), stretch(right_day + high))).alias("__to_stretch"),
    )
    gap = F.datediff(F.col(left_date), F.col(right_date))
    condition = all_of(
        [F.col(k) == F.col(f"__right_{k}") for k in keys]
        + [F.col("__stretch") == F.col("__to_stretch"), gap.between(low, high)]
    )
    return a.join(b, condition).drop("__stretch", "__to_stretch", *[f"__right_{k}" for k in keys])


def after_first(df: DataFrame, first: DataFrame, keys: Sequence[str], day: str, first_day: str) -> DataFrame:
    """Rows on or after the first date of their key."""
    return join_keys(df, first.select(*keys, first_day), keys, "inner").filter(F.col(day) >= F.col(first_day))


def complete_grid(
    df: DataFrame, left_keys: Sequence[str], right_keys: Sequence[str], fill: Mapping | None = None
) -> DataFrame:
    """Every combination of the two distinct key sets with the rows of ``df`` where they exist.

    The result has |left| x |right| rows because that is what is asked for. Right keys are packed into
    arrays of a few thousand; each left key is sent once per array and opened there, so no single row
    holds all right keys and the left keys stay distributed.
    """
    df = stage(df)
    right = stage(df.select(F.struct(*right_keys).alias("__r")).distinct())
    packs = right.count() // 5000 + 1
    packed = right.groupBy(F.pmod(F.xxhash64("__r"), F.lit(packs)).alias("__pack")).agg(F.collect_list("__r").alias("__rs"))
    left = df.select(*left_keys).distinct()
    grid = (
        left.select(*left_keys, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(packs - 1).cast("long"))).alias("__pack"))
        .join(packed, "__pack")
        .select(*left_keys, F.explode("__rs").alias("__r"))
        .select(*left_keys, *[F.col(f"__r.{k}").alias(k) for k in right_keys])
    )
    out = join_keys(grid, df, [*left_keys, *right_keys])
    return out.na.fill(dict(fill)) if fill else out


def densify(
    df: DataFrame, keys: Sequence[str], day: str, start: str, end: str, metrics: Sequence[str], step: str = "1 day"
) -> DataFrame:
    """One row per key and calendar step between two dates; metrics absent from ``df`` are 0."""
    steps = F.sequence(F.lit(start).cast("date"), F.lit(end).cast("date"), F.expr(f"INTERVAL {step}"))
    grid = df.select(*keys).distinct().select(*keys, F.explode(steps).alias(day))
    return join_keys(grid, df.select(*keys, day, *metrics), [*keys, day]).na.fill(0, subset=list(metrics))


def lfl_calendar(start: str, end: str, spark, offset: int = 364) -> DataFrame:
    """Current days with the comparable day of the previous year (same weekday) and a running day number."""
    n = F.datediff(F.lit(end).cast("date"), F.lit(start).cast("date"))
    days = spark.range(1).select(F.posexplode(F.sequence(F.lit(0), n)).alias("dayno", "__d"))
    cy = F.date_add(F.lit(start).cast("date"), F.col("__d"))
    return days.select((F.col("dayno") + 1).alias("dayno"), cy.alias("cy_date"), F.date_sub(cy, offset).alias("py_date"))


def lfl_daily(df: DataFrame, by: Sequence[str], day: str, metric: str, start: str, end: str, offset: int = 364) -> DataFrame:
    """Metric of each comparable day pair, per group.

    The pair is found by shifting the day, so both years come from one scan and one aggregation.
    """
    first, last = F.lit(start).cast("date"), F.lit(end).cast("date")
    shifted = F.date_add(F.col(day), offset)
    rows = df.select(*by, F.col(metric).alias("__m"), F.explode(F.array(
        F.struct(F.col(day).alias("cy_date"), F.lit(1).alias("is_cy")),
        F.struct(shifted.alias("cy_date"), F.lit(0).alias("is_cy")),
    )).alias("__s")).select(*by, "__m", "__s.*").filter(F.col("cy_date").between(first, last))
    return rows.groupBy(*by, "cy_date").agg(
        F.sum(F.when(F.col("is_cy") == 1, F.col("__m")).otherwise(0.0)).alias(f"cy_{metric}"),
        F.sum(F.when(F.col("is_cy") == 0, F.col("__m")).otherwise(0.0)).alias(f"py_{metric}"),
    ).withColumn("py_date", F.date_sub("cy_date", offset))


def resolve_hierarchy(ids: DataFrame, product: DataFrame, id_col: str, levels: Sequence[tuple[str, str]]) -> DataFrame:
    """Products meant by an id that may name any hierarchy level; ``levels`` lists (level, column).

    Each product is listed once per level as (level, id), so one equi-join on both answers all levels.
    """
    listed = product.select(
        "product_id",
        F.explode(
            F.array(*[F.struct(F.lit(name).alias("level"), F.col(c).cast("string").alias("__id")) for name, c in levels])
        ).alias("__e"),
    ).select("product_id", "__e.level", "__e.__id")
    return ids.join(listed, ids[id_col].cast("string") == F.col("__id")).drop("__id")


def flag_present(df: DataFrame, other: DataFrame, keys: Sequence[str], name: str) -> DataFrame:
    """1 where the keys also occur in ``other``, else 0."""
    marked = other.select(*keys).distinct().withColumn(name, F.lit(1))
    return join_keys(df, marked, keys).withColumn(name, F.coalesce(F.col(name), F.lit(0)))


def override_values(df: DataFrame, overrides: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Replace the listed columns where the key has an override (an UPDATE, as a rewrite)."""
    renamed = overrides.select(*keys, *[F.col(c).alias(f"__new_{c}") for c in columns])
    out = join_keys(df, renamed, keys)
    for c in columns:
        out = out.withColumn(c, F.coalesce(col(f"__new_{c}"), col(c)))
    return out.select(*df.columns)
