"""Receipt contents: co-purchase, coverage, receipt-value gaps."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillmark.functions.exprs import safe_div
from tillmark.operators.joins import with_group
from tillmark.operators.series import top_n


def co_purchase(df: DataFrame, item: str, column: str, transaction: str = "transaction_id") -> DataFrame:
    """Receipts holding ``item``: how many of them hold each value of ``column``, ``item`` included.

    A receipt is reduced to its set of distinct values, as small as the number of categories; the
    set is then opened once per value, so no pairs are formed.
    """
    baskets = df.groupBy(transaction).agg(F.collect_set(column).alias("__set"))
    with_item = baskets.filter(F.array_contains("__set", item))
    return with_item.select(
        F.explode("__set").alias(column), (F.size("__set") == 1).cast("int").alias("__solo")
    ).groupBy(column).agg(F.count(F.lit(1)).alias("receipts"), F.sum("__solo").alias("solo_receipts"))


def solo_share(df: DataFrame, item: str, column: str, transaction: str = "transaction_id") -> DataFrame:
    """Share of the receipts with ``item`` that hold nothing else."""
    own = co_purchase(df, item, column, transaction).filter(F.col(column) == item)
    return own.select(column, "receipts", "solo_receipts", safe_div("solo_receipts", "receipts").alias("solo_share"))


def basket_coverage(df: DataFrame, parent: Sequence[str], child: Sequence[str]) -> DataFrame:
    """Share of each child group in all lines, divided by the number of child groups of its parent."""
    counts = df.groupBy(*parent, *child).agg(F.count(F.lit(1)).alias("lines"))
    out = with_group(counts, [], [F.sum("lines").alias("__all")])
    out = with_group(out, parent, [F.count(F.lit(1)).alias("groups")])
    share = safe_div("lines", "__all")
    return out.select(
        *parent, *child, "lines", share.alias("share"), "groups", safe_div(share, "groups").alias("normalized_share")
    )


def atv_gap(df: DataFrame, by: Sequence[str], flag: str, transaction: str = "transaction_id", metric: str = "amount") -> DataFrame:
    """Receipt value of receipts with a flagged item against those without, per group.

    A receipt counts as flagged when any of its lines in the group is.
    """
    receipts = df.groupBy(*by, transaction).agg(F.max(flag).alias("__f"), F.sum(metric).alias("__v"))
    hit = F.col("__f") == 1
    out = receipts.groupBy(*by).agg(
        F.sum(F.when(hit, 1).otherwise(0)).alias("flagged_receipts"),
        F.sum(F.when(hit, F.col("__v")).otherwise(0.0)).alias("flagged_sales"),
        F.sum(F.when(hit, 0).otherwise(1)).alias("other_receipts"),
        F.sum(F.when(hit, 0.0).otherwise(F.col("__v"))).alias("other_sales"),
    )
    a, b = safe_div("flagged_sales", "flagged_receipts"), safe_div("other_sales", "other_receipts")
    return out.select("*", a.alias("flagged_atv"), b.alias("other_atv"), (a - b).alias("atv_gap"))


def best_atv_gap(df: DataFrame, parent: Sequence[str], child: str, flag: str) -> DataFrame:
    """The child group with the widest gap in each parent."""
    gaps = atv_gap(df, [*parent, child], flag).filter(F.col("atv_gap").isNotNull())
    return top_n(gaps, parent, [F.col("atv_gap").desc(), F.col(child)], 1)
