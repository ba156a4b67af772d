"""All queries, gathered by importing the modules that register them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tillmark.operators.metrics import share_of
from tillmark.plans import core, growth, learned, outreach, people, prices, ranging, upkeep  # noqa: F401
from tillmark.plans.registry import ORACLES, QUERIES

# Columns that Spark gives as 32-bit integers where the SQL gives 64-bit ones.
NARROW = {
    "period": ["period_growth", "share_growth", "lag_features", "moving_average", "trailing_price_ratio", "peak_month_rank", "weighted_distribution"],
    "rank": ["peak_month_rank"],
    "position": [
        "top_skus_per_group", "sample_cap", "one_timer_index", "repeat_index", "best_atv_gap", "top_brands_by_nationality", "top_brands_in_top_stores",
    ],
    "month": ["seasonality_index", "season_adjusted_sales"],
    "year": ["loyalty_share", "basket_size_lfl", "stratified_sample", "season_adjusted_sales"],
    "recency": ["rfm_features", "propensity_features"],
    "tenure": ["rfm_features", "propensity_features"],
    "visit": ["visit_gaps", "second_visit_gap"],
    "gap_days": ["visit_gaps"],
    "selling_week": ["lookalike_base"],
}
for _column, _names in NARROW.items():
    for _name in _names:
        ORACLES[_name] = f'SELECT * REPLACE (CAST("{_column}" AS INTEGER) AS "{_column}") FROM (\n{ORACLES[_name]}\n)'

__all__ = ["ORACLES", "QUERIES", "flagship"]


def flagship(spark: SparkSession, folder: str) -> DataFrame:
    return share_of(core.kpi_by_region_segment(spark, folder), "sales", name="sales_share")
