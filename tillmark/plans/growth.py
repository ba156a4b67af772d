"""Period series, like-for-like growth and range changes."""

from __future__ import annotations

from pyspark.sql import functions as F

from tillmark.functions import dates
from tillmark.functions.exprs import safe_div
from tillmark.operators import assortment, metrics, series
from tillmark.plans import star
from tillmark.plans.core import SQL_CY, SQL_PY, cy, py
from tillmark.plans.registry import query
from tillmark.plans.star import sql

BRAND_MONTH = """
bm AS (SELECT brand, year(business_day) * 12 + month(business_day) AS period, sum(amount) AS sales, sum(quantity) AS quantity FROM ps GROUP BY 1, 2)"""
BRAND_WEEK = """
bw AS (SELECT brand, CAST(floor(date_diff('day', DATE '2000-01-01', business_day) / 7.0) + 1 AS INTEGER) AS week, sum(amount) AS sales, sum(quantity) AS quantity
  FROM ps WHERE business_day BETWEEN DATE '2000-01-01' AND DATE '2000-12-29' GROUP BY 1, 2)"""


def brand_months(spark, d):
    return star.product_sales(spark, d).groupBy("brand", dates.month_number("business_day").alias("period")).agg(
        F.sum("amount").alias("sales"), F.sum("quantity").alias("quantity")
    )


def brand_weeks(spark, d):
    year = star.product_sales(spark, d).filter(dates.in_period("business_day", "2000-01-01", "2000-12-29"))
    return year.groupBy("brand", dates.week_index("business_day", "2000-01-01").alias("week")).agg(
        F.sum("amount").alias("sales"), F.sum("quantity").alias("quantity")
    )


@query("period_growth", sql(f"""
WITH {BRAND_MONTH}, l AS (SELECT *, lag(sales) OVER w ls, lag(quantity) OVER w lq FROM bm WINDOW w AS (PARTITION BY brand ORDER BY period))
SELECT brand, period, sales, quantity, coalesce((sales - ls) / nullif(ls, 0), 0) AS sales_growth, coalesce((quantity - lq) / nullif(lq, 0), 0) AS quantity_growth FROM l"""))
def _(spark, d):
    return series.pop_growth(brand_months(spark, d), ["brand"], "period", ["sales", "quantity"])


WEEK_GROWTH = """
g0 AS (SELECT *, lag(sales) OVER w ls, lag(quantity) OVER w lq, row_number() OVER w AS rn FROM bw WINDOW w AS (PARTITION BY brand ORDER BY week)),
g1 AS (SELECT *, 0.5 * coalesce((sales - ls) / nullif(ls, 0), 0) + 0.5 * coalesce((quantity - lq) / nullif(lq, 0), 0) AS growth FROM g0)"""


@query("weekly_growth", sql(f"WITH {BRAND_WEEK}, {WEEK_GROWTH} SELECT brand, week, round(growth, 8) AS growth FROM g1"))
def _(spark, d):
    out = series.blended_growth(brand_weeks(spark, d), ["brand"], "week", {"sales": 0.5, "quantity": 0.5})
    return out.select("brand", "week", F.round("growth", 8).alias("growth"))


@query("average_growth", sql(f"""
WITH {BRAND_WEEK}, {WEEK_GROWTH},
a AS (SELECT brand, round(avg(growth), 6) AS avg_growth, round(sum(growth * sales) / sum(sales), 6) AS weighted_growth FROM g1 WHERE rn > 1 GROUP BY 1)
SELECT *, rank() OVER (ORDER BY avg_growth DESC) + (count(*) OVER (PARTITION BY avg_growth) - 1) / 2.0 AS avg_growth_rank FROM a"""))
def _(spark, d):
    grown = series.blended_growth(brand_weeks(spark, d), ["brand"], "week", {"sales": 0.5, "quantity": 0.5})
    out = series.avg_growth(grown, ["brand"], "week", "growth", "sales")
    out = out.select("brand", F.round("avg_growth", 6).alias("avg_growth"), F.round("weighted_growth", 6).alias("weighted_growth"))
    return series.ranked_growth(out, "avg_growth")


@query("share_growth", sql(f"""
WITH {BRAND_MONTH}, s AS (SELECT brand, period, sales, quantity, sales / sum(sales) OVER (PARTITION BY period) AS share FROM bm),
l AS (SELECT *, lag(share) OVER (PARTITION BY brand ORDER BY period) p FROM s)
SELECT brand, period, sales, quantity, share, coalesce((share - p) / nullif(p, 0), 0) AS share_growth FROM l"""))
def _(spark, d):
    return series.share_growth(brand_months(spark, d), ["brand"], "period", "sales")


@query("lag_features", sql(f"""
WITH {BRAND_MONTH}, l AS (SELECT brand, period, quantity, lag(quantity, 1) OVER w a, lag(quantity, 2) OVER w b FROM bm WINDOW w AS (PARTITION BY brand ORDER BY period))
SELECT brand, period, quantity, round(coalesce(a, avg(a) OVER (PARTITION BY brand)), 6) AS quantity_lag1, round(coalesce(b, avg(b) OVER (PARTITION BY brand)), 6) AS quantity_lag2 FROM l"""))
def _(spark, d):
    out = series.lag_features(brand_months(spark, d), ["brand"], "period", "quantity", (1, 2)).drop("sales")
    return out.withColumn("quantity_lag1", F.round("quantity_lag1", 6)).withColumn("quantity_lag2", F.round("quantity_lag2", 6))


@query("moving_average", sql(f"""
WITH {BRAND_MONTH} SELECT brand, period, CASE WHEN count(sales) OVER w >= 4 THEN avg(sales) OVER w END AS sales_ma4,
  avg(sales) OVER (PARTITION BY brand ORDER BY period ROWS 29 PRECEDING) AS sales_ma30 FROM bm WINDOW w AS (PARTITION BY brand ORDER BY period ROWS 3 PRECEDING)"""))
def _(spark, d):
    out = series.moving_average(brand_months(spark, d), ["brand"], "period", "sales", 4)
    return series.moving_average(out, ["brand"], "period", "sales", 30, 1).select("brand", "period", "sales_ma4", "sales_ma30")


@query("trailing_price_ratio", sql(f"""
WITH {BRAND_MONTH}, p AS (SELECT *, sales / quantity AS avg_unit_price, sum(sales) OVER a / sum(quantity) OVER a AS p2, sum(sales) OVER b / sum(quantity) OVER b AS p3 FROM bm
  WINDOW a AS (PARTITION BY brand ORDER BY period ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING), b AS (PARTITION BY brand ORDER BY period ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING))
SELECT brand, period, sales, quantity, avg_unit_price, coalesce(avg_unit_price / p2, 1.0) AS price_ratio_ma2, coalesce(avg_unit_price / p3, 1.0) AS price_ratio_ma3 FROM p"""))
def _(spark, d):
    return series.trailing_price_ratio(brand_months(spark, d), ["brand"], "period")


def _lfl_sql(by: str, source: str) -> str:
    return f"""
WITH a AS (SELECT {by}, sum(CASE WHEN {SQL_CY} THEN amount ELSE 0 END) AS cy_sales, sum(CASE WHEN {SQL_PY} THEN amount ELSE 0 END) AS py_sales,
  count(DISTINCT CASE WHEN {SQL_CY} THEN transaction_id END) AS cy_receipts, count(DISTINCT CASE WHEN {SQL_PY} THEN transaction_id END) AS py_receipts
  FROM {source} WHERE ({SQL_CY}) OR ({SQL_PY}) GROUP BY {by})
SELECT *, coalesce((cy_sales - py_sales) / nullif(py_sales, 0), 0) AS sales_growth, coalesce((cy_receipts - py_receipts) / nullif(py_receipts, 0), 0) AS receipts_growth FROM a"""


LFL = {"sales": ("sum", "amount"), "receipts": ("distinct", "transaction_id")}


@query("lfl_growth_by_sku", sql(_lfl_sql("product_id", "tx")))
def _(spark, d):
    return series.lfl_growth(star.transactions(spark, d), ["product_id"], cy(), py(), LFL)


@query("lfl_growth_by_brand_region", sql(_lfl_sql("brand, region", "sales")))
def _(spark, d):
    return series.lfl_growth(star.sales(spark, d), ["brand", "region"], cy(), py(), LFL)


@query("ytd_growth", sql(f"""
WITH {BRAND_MONTH}, y AS (SELECT * FROM bm WHERE period BETWEEN 24001 AND 24012), l AS (SELECT *, lag(sales) OVER (PARTITION BY brand ORDER BY period) p FROM y)
SELECT brand, count(*) AS months, round(coalesce(avg((sales - p) / nullif(p, 0)), 0), 8) AS ytd_growth FROM l GROUP BY 1"""))
def _(spark, d):
    year = brand_months(spark, d).filter(F.col("period").between(24001, 24012))
    out = series.ytd_growth(year, ["brand"], "period", "sales")
    return out.withColumn("ytd_growth", F.round("ytd_growth", 8))


@query("peak_month_rank", sql(f"""
WITH {BRAND_MONTH} SELECT brand, period, sales, rank FROM (SELECT *, rank() OVER (PARTITION BY brand ORDER BY sales DESC) AS rank FROM bm) WHERE rank <= 3"""))
def _(spark, d):
    return series.rank_by(brand_months(spark, d).drop("quantity"), ["brand"], "sales", top=3)


@query("top_skus_per_group", sql("""
WITH s AS (SELECT material_group, product_id, sum(amount) AS sales FROM ps GROUP BY 1, 2)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY material_group ORDER BY sales DESC, product_id) AS position FROM s) WHERE position <= 5"""))
def _(spark, d):
    per = star.product_sales(spark, d).groupBy("material_group", "product_id").agg(F.sum("amount").alias("sales"))
    return series.top_n(per, ["material_group"], [F.col("sales").desc(), F.col("product_id")], 5)


@query("top_skus", sql("SELECT product_id, sum(amount) AS sales FROM tx GROUP BY 1 ORDER BY sales DESC, product_id LIMIT 10"))
def _(spark, d):
    per = star.transactions(spark, d).groupBy("product_id").agg(F.sum("amount").alias("sales"))
    return series.top_k(per, [F.col("sales").desc(), F.col("product_id")], 10)


@query("arg_min", sql("""
WITH s AS (SELECT material_group, product_id, sum(amount) AS sales, sum(quantity) AS volume FROM ps GROUP BY 1, 2)
SELECT material_group, product_id, sales, volume FROM (SELECT *, row_number() OVER (PARTITION BY material_group ORDER BY sales, product_id) k FROM s) WHERE k = 1"""))
def _(spark, d):
    per = star.product_sales(spark, d).groupBy("material_group", "product_id").agg(
        F.sum("amount").alias("sales"), F.sum("quantity").alias("volume")
    )
    return series.arg_min(per, ["material_group"], "sales", ["product_id", "volume"], "product_id")


SEASON = """
cells AS (SELECT department, year(business_day) y, month(business_day) AS month, sum(amount) m FROM ps GROUP BY ALL),
pm AS (SELECT department, month, sum(m) sm, count(*) AS years, avg(m) AS avg_sales FROM cells WHERE m > 0 GROUP BY 1, 2),
season AS (SELECT department, month, years, avg_sales, avg_sales / (sum(sm) OVER (PARTITION BY department) / sum(years) OVER (PARTITION BY department)) AS seasonality_index FROM pm)"""


@query("seasonality_index", sql(f"WITH {SEASON} SELECT * FROM season"))
def _(spark, d):
    df = star.product_sales(spark, d).select(
        "department", F.year("business_day").alias("year"), F.month("business_day").alias("month"), "amount"
    )
    return series.seasonality_index(df, "year", "month", "amount", ["department"])


@query("range_churn", sql(f"""
WITH p AS (SELECT region, product_id, max(CASE WHEN {SQL_CY} THEN 1 ELSE 0 END) c, max(CASE WHEN {SQL_PY} THEN 1 ELSE 0 END) p,
  sum(CASE WHEN {SQL_CY} THEN amount ELSE 0 END) s FROM ss WHERE ({SQL_CY}) OR ({SQL_PY}) GROUP BY 1, 2)
SELECT region, count(*) FILTER (WHERE c = 1 AND p = 0) AS added, count(*) FILTER (WHERE c = 0 AND p = 1) AS removed, count(*) FILTER (WHERE c = 1 AND p = 1) AS kept,
  sum(CASE WHEN p = 0 THEN s ELSE 0 END) AS new_sales, sum(s) AS sales, sum(CASE WHEN p = 0 THEN s ELSE 0 END) / sum(s) AS new_sales_share FROM p GROUP BY 1"""))
def _(spark, d):
    return series.range_churn(star.store_sales(spark, d), ["region"], "product_id", cy(), py())


GROUP_LFL = f"""
gl AS (SELECT material_group, sum(CASE WHEN {SQL_CY} THEN amount ELSE 0 END) AS sales, round((sum(CASE WHEN {SQL_CY} THEN amount ELSE 0 END) - sum(CASE WHEN {SQL_PY} THEN amount ELSE 0 END))
  / nullif(sum(CASE WHEN {SQL_PY} THEN amount ELSE 0 END), 0), 9) AS growth, count(DISTINCT CASE WHEN {SQL_CY} THEN customer_id END) AS customers, department_of AS department
  FROM (SELECT *, 'D' || length(material_group) % 3 AS department_of FROM ps) WHERE ({SQL_CY}) OR ({SQL_PY}) GROUP BY material_group, department_of)"""


def group_lfl(spark, d):
    df = star.product_sales(spark, d).filter(cy() | py())
    s = lambda t: F.sum(F.when(t, F.col("amount")).otherwise(0.0))
    return df.groupBy(
        "material_group", F.concat(F.lit("D"), (F.length("material_group") % 3).cast("string")).alias("department")
    ).agg(
        s(cy()).alias("sales"),
        F.round(safe_div(s(cy()) - s(py()), s(py())), 9).alias("growth"),
        F.countDistinct(F.when(cy(), F.col("customer_id"))).alias("customers"),
    )


@query("growth_flag", sql(f"""
WITH {GROUP_LFL}, c AS (SELECT quantile_cont(growth, 0.33) a, quantile_cont(growth, 0.66) b FROM gl WHERE growth >= 0)
SELECT material_group, sales, growth, CASE WHEN growth IS NULL THEN NULL WHEN growth < 0 THEN 'Negative' WHEN growth <= a THEN 'Low' WHEN growth <= b THEN 'Medium' ELSE 'High' END AS growth_flag FROM gl, c"""))
def _(spark, d):
    return metrics.growth_flag(group_lfl(spark, d), "growth").select("material_group", "sales", "growth", "growth_flag")


@query("quadrants", sql(f"""
WITH {GROUP_LFL}, c AS (SELECT quantile_cont(sales, 0.75) x, avg(growth) y FROM gl),
q AS (SELECT *, CASE WHEN sales >= x THEN 'high x / ' ELSE 'low x / ' END || CASE WHEN growth >= y THEN 'high y' ELSE 'low y' END AS quadrant FROM gl, c)
SELECT quadrant, count(*) AS n, sum(sales) AS sales, sum(sales) / sum(sum(sales)) OVER () AS share FROM q GROUP BY 1"""))
def _(spark, d):
    return metrics.quadrant_summary(metrics.quadrants(group_lfl(spark, d), "sales", "growth", 0.75), "sales")


@query("mean_split", sql(f"""
WITH {GROUP_LFL}, m AS (SELECT *, avg(sales) OVER (PARTITION BY department) a, avg(growth) OVER (PARTITION BY department) b FROM gl)
SELECT material_group, department, CASE WHEN sales >= a AND growth >= b THEN 'maintain' WHEN sales >= a THEN 'grow' WHEN growth >= b THEN 'promote' ELSE 'review' END AS move FROM m"""))
def _(spark, d):
    return metrics.mean_split(group_lfl(spark, d), "sales", "growth", ["department"]).select("material_group", "department", "move")


@query("listing_status", sql("""
WITH s AS (SELECT store_id, product_id, min(business_day) f, max(business_day) l FROM tx GROUP BY 1, 2)
SELECT store_id, count(*) AS skus, count(*) FILTER (WHERE date_diff('day', f, DATE '2001-08-01') < 365) AS new_listings,
  count(*) FILTER (WHERE date_diff('day', l, DATE '2001-08-01') >= 365) AS delisted FROM s GROUP BY 1"""))
def _(spark, d):
    out = assortment.listing_status(star.transactions(spark, d), ["store_id", "product_id"], "business_day", "2001-08-01", 365, 365)
    return out.groupBy("store_id").agg(
        F.count(F.lit(1)).alias("skus"), F.sum("new_listing").alias("new_listings"), F.sum("delisted").alias("delisted")
    )
