"""Models, association measures and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from tillmark.operators import models, pricing
from tillmark.plans import star
from tillmark.plans.prices import monthly
from tillmark.plans.registry import query
from tillmark.plans.star import sql
from tillmark.session import stage
from tillmark.streaming import windows


@query("spearman_matrix", sql("""
WITH c AS (SELECT customer_id, count(DISTINCT transaction_id) AS orders, sum(amount) AS spend, count(DISTINCT store_id) AS stores FROM tx GROUP BY 1),
r AS (SELECT rank() OVER (ORDER BY orders) + (count(*) OVER (PARTITION BY orders) - 1) / 2.0 AS a, rank() OVER (ORDER BY spend) + (count(*) OVER (PARTITION BY spend) - 1) / 2.0 AS b,
  rank() OVER (ORDER BY stores) + (count(*) OVER (PARTITION BY stores) - 1) / 2.0 AS c FROM c)
SELECT 'orders' AS a, 'spend' AS b, round(corr(a, b), 8) AS rho FROM r UNION ALL SELECT 'orders', 'stores', round(corr(a, c), 8) FROM r UNION ALL SELECT 'spend', 'stores', round(corr(b, c), 8) FROM r"""))
def _(spark, d):
    per = star.transactions(spark, d).groupBy("customer_id").agg(
        F.countDistinct("transaction_id").alias("orders"), F.sum("amount").alias("spend"), F.countDistinct("store_id").alias("stores")
    )
    return models.spearman(stage(per), ["orders", "spend", "stores"]).withColumn("rho", F.round("rho", 8))


def _cramer(a: str, b: str) -> str:
    return f"""SELECT '{a}' AS a, '{b}' AS b, CAST(max(n) AS BIGINT) AS n, round(sqrt(greatest(sum(o * o / (r * c)) - 1, 0) / least(count(DISTINCT x) - 1, count(DISTINCT y) - 1)), 8) AS v FROM (
  SELECT x, y, o, sum(o) OVER (PARTITION BY x) r, sum(o) OVER (PARTITION BY y) c, sum(o) OVER () n FROM (SELECT {a} x, {b} y, CAST(count(*) AS DOUBLE) o FROM z GROUP BY 1, 2))"""


@query("cramers_v", sql(f"""
WITH z AS (SELECT department, region, transaction_type FROM sales)
{_cramer('department', 'region')} UNION ALL {_cramer('department', 'transaction_type')} UNION ALL {_cramer('region', 'transaction_type')}"""))
def _(spark, d):
    df = star.sales(spark, d).select("department", "region", "transaction_type")
    return models.cramers_v(df, ["department", "region", "transaction_type"]).withColumn("v", F.round("v", 8))


ATTRIBUTES = ["department", "category"]


# the walks of receipts over numbered combinations, as in the operator
CHOICE_ROWS = """
bought AS MATERIALIZED (SELECT transaction_id, department, category, min(business_day) AS business_day, avg(amount / quantity) AS price FROM ps GROUP BY 1, 2, 3),
combos AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY department, category) AS c FROM (SELECT DISTINCT department, category FROM bought)),
size AS MATERIALIZED (SELECT (SELECT count(*) FROM bought) AS p, (SELECT count(DISTINCT transaction_id) FROM bought) AS t, (SELECT count(*) FROM combos) AS k),
par AS MATERIALIZED (SELECT *, least(p, t * k - p) AS wanted, least(k, CAST(ceil(2 * p / t) AS BIGINT)) AS steps, list_filter(range(1, greatest(2, k)), lambda x: gcd(x, k) = 1)[1:64] AS units FROM size),
heads AS (SELECT transaction_id, min(business_day) AS business_day, CAST('0x' || substr(md5('42|' || transaction_id), 1, 8) AS BIGINT) AS a, CAST('0x' || substr(md5('43|' || transaction_id), 1, 8) AS BIGINT) AS b FROM bought GROUP BY 1),
walks AS (SELECT transaction_id, business_day, (a + j * units[b % len(units) + 1]) % k + 1 AS c FROM (SELECT heads.*, par.*, unnest(range(0, steps)) AS j FROM heads, par)),
drawn AS (SELECT transaction_id, department, category, walks.business_day FROM walks JOIN combos USING (c) ANTI JOIN bought USING (transaction_id, department, category)),
others AS (SELECT transaction_id, department, category, business_day FROM (SELECT *, row_number() OVER (ORDER BY md5('44|' || transaction_id || '|' || department || '|' || category), transaction_id, department, category) AS pos FROM drawn), par WHERE pos <= wanted),
both_ AS (SELECT transaction_id, department, category, business_day, price, 1 AS purchase_flag FROM bought UNION ALL SELECT *, NULL, 0 FROM others),
filled AS (SELECT *, coalesce(price, last_value(price IGNORE NULLS) OVER (PARTITION BY department, category ORDER BY business_day DESC, transaction_id DESC ROWS UNBOUNDED PRECEDING),
  last_value(price IGNORE NULLS) OVER (PARTITION BY department, category ORDER BY business_day, transaction_id ROWS UNBOUNDED PRECEDING)) AS known FROM both_),
choice_rows AS (SELECT transaction_id, department, category, coalesce((known - min(known) OVER ()) / nullif(max(known) OVER () - min(known) OVER (), 0), 0) AS price, purchase_flag FROM filled)"""


def choice_rows(spark, d):
    df = star.product_sales(spark, d).withColumn("price", F.col("amount") / F.col("quantity"))
    return models.choice_dataset(df, "transaction_id", "business_day", ATTRIBUTES, "price")


@query("choice_dataset", sql(f"WITH {CHOICE_ROWS} SELECT transaction_id, department, category, round(price, 9) AS price, purchase_flag FROM choice_rows"))
def _(spark, d):
    return choice_rows(spark, d)[0].withColumn("price", F.round("price", 9))


def fitted_choice(spark, d):
    """Model of the 70 % of receipts that are not held out, all rows with their part, and the purchase rates of grid and rows."""
    rows, rate = choice_rows(spark, d)
    rows = stage(rows.withColumn("part", F.when(models.held_out("transaction_id"), "test").otherwise("train")))
    model = models.fit_choice(rows.filter("part = 'train'"), ATTRIBUTES, ["price"])
    return model, rows, rate, rows.agg(F.avg("purchase_flag")).first()[0]


@query("fit_choice")
def _(spark, d):
    model, rows, *_ = fitted_choice(spark, d)
    return models.classification_report(model.transform(rows), by=["part"])


@query("choice_chain")
def _(spark, d):
    """From receipts to delisted SKUs: rows, model, intercept at the true rate, utilities, greedy search."""
    from tillmark.operators import delisting, metrics
    from tillmark.plans.ranging import choice_base

    model, _, rate, resampled = fitted_choice(spark, d)
    betas = models.choice_coefficients(spark, model, ATTRIBUTES, ["price"])
    intercept = betas.filter("attribute = 'intercept'").first()["beta"]
    intercept = delisting.recalibrated_intercept(intercept, rate, resampled)
    valued = delisting.choice_value(choice_base(spark, d), ATTRIBUTES, betas, intercept, ["department"])
    out = metrics.share_of(metrics.share_of(valued, "sales", ["department"], "sales_share"), "gp", ["department"], "gp_share")
    out = out.withColumn("sku", F.concat_ws(" ", "brand", "category"))
    marked = delisting.delist_candidates(out, F.col("brand") == "Brand#1", 0.02, 0.02)
    done = delisting.greedy_delist(marked, "sku", ["department"])
    return done.select("department", "sku", F.round("utility", 6).alias("utility"), "removed_round", "delist_flag")


@query("forest_elasticity")
def _(spark, d):
    rows = stage(monthly(spark, d).select("avg_unit_price", F.col("stores").cast("double").alias("stores"), "quantity"))
    model = models.fit_trees(rows, ["avg_unit_price", "stores"], "quantity", "rf")
    curve = stage(models.partial_dependence(model, rows, "avg_unit_price"))
    return models.curve_elasticity(curve, "avg_unit_price")


def _events(spark, d):
    stream = windows.file_stream(spark, d, star.table(spark, d, "events").schema, "events.parquet")
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


# complete mode returns every window and session, those still open with what they have so far
# event times carry no zone in the files; they are read as session time and written back the same way
TIME = "yyyy-MM-dd HH:mm:ss"


@query("stream_window_kpis", """
SELECT strftime(time_bucket(INTERVAL 1 DAY, ts), '%Y-%m-%d %H:%M:%S') AS window_start, event_type, count(*) AS events, round(sum(value), 4) AS total, round(avg(value), 6) AS mean FROM events GROUP BY 1, 2""")
def _(spark, d):
    out = windows.run_once(windows.window_kpis(_events(spark, d), ["event_type"], "1 day"), "complete")
    return out.select(
        F.date_format("window_start", TIME).alias("window_start"), "event_type", "events", F.round("total", 4).alias("total"), F.round("mean", 6).alias("mean")
    )


@query("stream_session_kpis", """
WITH g AS (SELECT *, CASE WHEN date_diff('microsecond', lag(ts) OVER w, ts) < 3600000000 THEN 0 ELSE 1 END AS st FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT *, sum(st) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) k FROM g)
SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, count(*) AS events, round(sum(value), 4) AS total FROM s GROUP BY user_id, k""")
def _(spark, d):
    out = windows.run_once(windows.session_kpis(_events(spark, d), "user_id", "1 hour"), "complete")
    return out.select("user_id", F.date_format("start", TIME).alias("start"), "events", F.round("total", 4).alias("total"))


@query("stream_first_seen", "SELECT count(*) AS keys FROM (SELECT DISTINCT user_id, event_type FROM events)")
def _(spark, d):
    out = windows.run_once(windows.first_seen(_events(spark, d), ["user_id", "event_type"], "60 days"), "append")
    return out.agg(F.count(F.lit(1)).alias("keys"))


@query("boosted_elasticity")
def _(spark, d):
    rows = stage(monthly(spark, d).select("avg_unit_price", F.col("stores").cast("double").alias("stores"), "quantity"))
    model = models.fit_trees(rows, ["avg_unit_price", "stores"], "quantity", "gbt")
    return models.marginal_elasticity(model, rows, "avg_unit_price")


def _trees_by_sku(spark, d, kind):
    panel = pricing.monthly_sales(star.sales(spark, d), ["region", "brand"], discount="discount_amount", gross="gross_amount")
    test = models.held_out("region", "brand", "month", tenths=2, seed=42)
    return models.tree_elasticities(panel, ["region", "brand"], "avg_unit_price", "quantity", test, ["discount_share"], kind)


@query("forest_elasticity_by_sku")
def _(spark, d):
    return _trees_by_sku(spark, d, "rf")


@query("boosted_elasticity_by_sku")
def _(spark, d):
    return _trees_by_sku(spark, d, "gbt")
