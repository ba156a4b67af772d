"""Period series: growth, lags, moving windows and like-for-like comparisons.

Every function here works on rows already summed per (key, period); a window partition then holds
the periods of one key, which stay few however many receipts the key has.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillmark.functions.exprs import growth, safe_div
from tillmark.operators.joins import with_group
from tillmark.operators.metrics import share_of
from tillmark.operators.ordered import avg_rank, percentiles


def _series(by: Sequence[str], period: str):
    return Window.partitionBy(*by).orderBy(period)


def pop_growth(df: DataFrame, by: Sequence[str], period: str, metrics: Sequence[str], default: float | None = 0.0) -> DataFrame:
    """Growth against the previous row present in the series; the first row gets ``default``."""
    w = _series(by, period)
    out = df
    for m in metrics:
        out = out.withColumn(f"{m}_growth", growth(F.col(m), F.lag(m).over(w), default))
    return out


def blended_growth(
    df: DataFrame, by: Sequence[str], period: str, weights: Mapping[str, float], name: str = "growth"
) -> DataFrame:
    """Weighted sum of the growths of several metrics (0.5 sales and 0.5 quantity, say)."""
    out = pop_growth(df, by, period, list(weights))
    blended = sum((F.col(f"{m}_growth") * F.lit(w) for m, w in weights.items()), F.lit(0.0))
    return out.withColumn(name, blended)


def avg_growth(df: DataFrame, by: Sequence[str], period: str, column: str, weight: str | None = None) -> DataFrame:
    """Mean of a growth column per key, the first period left out; with its weighted form."""
    later = F.row_number().over(_series(by, period)) > 1
    marked = df.withColumn("__later", later).filter("__later")
    aggs = [F.avg(column).alias("avg_growth")]
    if weight:
        aggs.append(safe_div(F.sum(F.col(column) * F.col(weight)), F.sum(weight), 0).alias("weighted_growth"))
    return marked.groupBy(*by).agg(*aggs)


def ranked_growth(df: DataFrame, column: str) -> DataFrame:
    return avg_rank(df, column, f"{column}_rank")


def share_growth(df: DataFrame, key: Sequence[str], period: str, metric: str) -> DataFrame:
    """Share of each key in its period total, and the growth of that share."""
    shared = share_of(df, metric, [period], "share")
    return pop_growth(shared, key, period, ["share"])


def lag_features(
    df: DataFrame, by: Sequence[str], period: str, column: str, lags: Sequence[int], fill_mean: bool = True
) -> DataFrame:
    """Lagged values; where there is no earlier row, the mean of the key's available lags."""
    w = _series(by, period)
    out = df
    for n in lags:
        out = out.withColumn(f"{column}_lag{n}", F.lag(column, n).over(w))
    if fill_mean:
        names = [f"{column}_lag{n}" for n in lags]
        out = with_group(out, by, [F.avg(c).alias(f"__{c}") for c in names])
        for c in names:
            out = out.withColumn(c, F.coalesce(F.col(c), F.col(f"__{c}")))
        out = out.drop(*[f"__{c}" for c in names])
    return out


def moving_average(
    df: DataFrame, by: Sequence[str], period: str, column: str, n: int, min_periods: int | None = None, name: str | None = None
) -> DataFrame:
    """Mean of the last ``n`` rows, NULL while fewer than ``min_periods`` (default ``n``) are there."""
    w = _series(by, period).rowsBetween(-(n - 1), 0)
    enough = F.count(column).over(w) >= F.lit(n if min_periods is None else min_periods)
    return df.withColumn(name or f"{column}_ma{n}", F.when(enough, F.avg(column).over(w)))


def trailing_price_ratio(
    df: DataFrame, by: Sequence[str], period: str, ns: Sequence[int] = (2, 3), sales: str = "sales", quantity: str = "quantity"
) -> DataFrame:
    """Price of the row over the average price of the ``n`` rows before it; 1 where there is none."""
    out = df.withColumn("avg_unit_price", safe_div(sales, quantity))
    for n in ns:
        w = _series(by, period).rowsBetween(-n, -1)
        past = safe_div(F.sum(sales).over(w), F.sum(quantity).over(w))
        out = out.withColumn(f"price_ratio_ma{n}", F.coalesce(safe_div(F.col("avg_unit_price"), past), F.lit(1.0)))
    return out


def lfl_growth(
    df: DataFrame,
    by: Sequence[str],
    current: Column,
    previous: Column,
    metrics: Mapping[str, tuple[str, str]],
) -> DataFrame:
    """Current against previous period for sums and distinct counts, in one aggregation.

    ``metrics``: name -> (``sum`` or ``distinct``, column). Growth is 0 where the previous is absent.
    """
    aggs = []
    for name, (kind, column) in metrics.items():
        for side, test in (("cy", current), ("py", previous)):
            if kind == "sum":
                value = F.sum(F.when(test, F.col(column)).otherwise(0.0))
            else:
                value = F.countDistinct(F.when(test, F.col(column)))
            aggs.append(value.alias(f"{side}_{name}"))
    out = df.filter(current | previous).groupBy(*by).agg(*aggs)
    return out.select("*", *[growth(f"cy_{n}", f"py_{n}").alias(f"{n}_growth") for n in metrics])


def ytd_growth(df: DataFrame, by: Sequence[str], period: str, metric: str) -> DataFrame:
    """Mean of the month-on-month growths per key (first month left out)."""
    grown = pop_growth(df, by, period, [metric], default=None)
    return grown.groupBy(*by).agg(
        F.count(F.lit(1)).alias("months"), F.coalesce(F.avg(f"{metric}_growth"), F.lit(0.0)).alias("ytd_growth")
    )


def rank_by(df: DataFrame, by: Sequence[str], metric: str, name: str = "rank", top: int | None = None) -> DataFrame:
    """Rank within group with equal ranks for ties. With ``top`` the cut is made before the shuffle."""
    out = df.withColumn(name, F.rank().over(Window.partitionBy(*by).orderBy(F.col(metric).desc())))
    return out if top is None else out.filter(F.col(name) <= top)


def top_n(df: DataFrame, by: Sequence[str], order: Sequence[Column], n: int, position: str = "position") -> DataFrame:
    """First ``n`` rows per group. Spark cuts each task to ``n`` rows per group before the shuffle."""
    return df.withColumn(position, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(
        F.col(position) <= n
    )


def top_k(df: DataFrame, order: Sequence[Column], k: int) -> DataFrame:
    return df.orderBy(*order).limit(k)


def arg_min(df: DataFrame, by: Sequence[str], metric: str, columns: Sequence[str], tie: str | None = None) -> DataFrame:
    """Columns of the row with the smallest metric per group, by aggregation (ties by ``tie``)."""
    order = F.struct(metric, tie) if tie else F.col(metric)
    return df.groupBy(*by).agg(F.min(metric).alias(metric), *[F.min_by(c, order).alias(c) for c in columns])


def seasonality_index(df: DataFrame, year: str, month: str, metric: str, by: Sequence[str] = ()) -> DataFrame:
    """Average of a calendar month over its non-zero years, over the average of all months."""
    cells = df.groupBy(*by, year, month).agg(F.sum(metric).alias("__m")).filter("__m > 0")
    per_month = cells.groupBy(*by, month).agg(
        F.sum("__m").alias("__sum"), F.count(F.lit(1)).alias("years"), F.avg("__m").alias("avg_sales")
    )
    return with_group(per_month, by, [F.sum("__sum").alias("__all"), F.sum("years").alias("__months")]).select(
        *by, month, "years", "avg_sales", safe_div("avg_sales", safe_div("__all", "__months")).alias("seasonality_index")
    )


def range_churn(df: DataFrame, by: Sequence[str], key: str, current: Column, previous: Column, metric: str = "amount") -> DataFrame:
    """Keys added, removed and kept between two periods, with the share of sales of the new ones.

    One row of presence flags per key replaces a set difference each way.
    """
    per = df.filter(current | previous).groupBy(*by, key).agg(
        F.max(current.cast("int")).alias("__c"),
        F.max(previous.cast("int")).alias("__p"),
        F.sum(F.when(current, F.col(metric)).otherwise(0.0)).alias("__s"),
    )
    out = per.groupBy(*by).agg(
        F.sum(F.expr("CASE WHEN __c = 1 AND __p = 0 THEN 1 ELSE 0 END")).alias("added"),
        F.sum(F.expr("CASE WHEN __c = 0 AND __p = 1 THEN 1 ELSE 0 END")).alias("removed"),
        F.sum(F.expr("CASE WHEN __c = 1 AND __p = 1 THEN 1 ELSE 0 END")).alias("kept"),
        F.sum(F.expr("CASE WHEN __p = 0 THEN __s ELSE 0D END")).alias("new_sales"),
        F.sum("__s").alias("sales"),
    )
    return out.withColumn("new_sales_share", safe_div("new_sales", "sales", 0))


def growth_tiers(df: DataFrame, column: str) -> DataFrame:
    """33rd and 66th percentile of the non-negative growths."""
    return percentiles(df.filter(F.col(column) >= 0), column, {"p33": 0.33, "p66": 0.66})
