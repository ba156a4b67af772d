"""Customers, baskets, distribution and stores."""

from __future__ import annotations

from pyspark.sql import functions as F

from tillmark.functions import dates
from tillmark.operators import baskets, customers, metrics, ordered, series, sets
from tillmark.plans import star
from tillmark.plans.core import SQL_CY, SQL_PY, cy, py
from tillmark.plans.registry import query
from tillmark.plans.star import sql

REPEAT = """count(*) AS customers, CAST(sum(CASE WHEN n = 1 THEN 1 ELSE 0 END) AS BIGINT) AS one_timers,
  CAST(sum(CASE WHEN n > 1 THEN 1 ELSE 0 END) AS BIGINT) AS repeaters,
  sum(CASE WHEN n = 1 THEN 1 ELSE 0 END) / count(*) AS one_timer_share, sum(CASE WHEN n > 1 THEN 1 ELSE 0 END) / count(*) AS repeat_share"""


@query("customer_repeat", sql(f"""
WITH p AS (SELECT department, material_group, customer_id, count(DISTINCT transaction_id) AS n FROM ps WHERE {SQL_CY} GROUP BY ALL)
SELECT department, material_group, {REPEAT} FROM p GROUP BY 1, 2"""))
def _(spark, d):
    return customers.customer_repeat(star.product_sales(spark, d).filter(cy()), ["department", "material_group"])


@query("one_timer_index", sql("""
WITH a AS (SELECT department, material_group, customer_id, count(DISTINCT transaction_id) n FROM ps GROUP BY ALL),
ca AS (SELECT department, material_group, count(*) AS customers, sum(CASE WHEN n = 1 THEN 1 ELSE 0 END) / count(*) AS child_share FROM a GROUP BY 1, 2),
b AS (SELECT department, customer_id, count(DISTINCT transaction_id) n FROM ps GROUP BY ALL),
cb AS (SELECT department, sum(CASE WHEN n = 1 THEN 1 ELSE 0 END) / count(*) AS parent_share FROM b GROUP BY 1)
SELECT department, material_group, customers, child_share, parent_share, child_share / nullif(parent_share, 0) AS index,
  row_number() OVER (PARTITION BY department ORDER BY child_share / nullif(parent_share, 0) DESC NULLS LAST, material_group) AS position
FROM ca JOIN cb USING (department)"""))
def _(spark, d):
    return customers.share_index(star.product_sales(spark, d), ["material_group"], ["department"])


@query("repeat_index", sql("""
WITH a AS (SELECT department, material_group, customer_id, count(DISTINCT transaction_id) n FROM ps GROUP BY ALL),
ca AS (SELECT department, material_group, count(*) AS customers, sum(CASE WHEN n > 1 THEN 1 ELSE 0 END) / count(*) AS child_share FROM a GROUP BY 1, 2),
b AS (SELECT department, customer_id, count(DISTINCT transaction_id) n FROM ps GROUP BY ALL),
cb AS (SELECT department, sum(CASE WHEN n > 1 THEN 1 ELSE 0 END) / count(*) AS parent_share FROM b GROUP BY 1)
SELECT department, material_group, customers, child_share, parent_share, child_share / nullif(parent_share, 0) AS index,
  row_number() OVER (PARTITION BY department ORDER BY child_share / nullif(parent_share, 0) DESC NULLS LAST, material_group) AS position
FROM ca JOIN cb USING (department)"""))
def _(spark, d):
    return customers.share_index(star.product_sales(spark, d), ["material_group"], ["department"], "repeat")


@query("segment_affinity_index", sql("""
WITH p AS (SELECT department, segment, customer_id, max(own_label) f FROM ps JOIN cust USING (customer_id) GROUP BY ALL),
s AS (SELECT department, segment, CAST(sum(f) AS BIGINT) flagged, CAST(sum(1 - f) AS BIGINT) others FROM p GROUP BY 1, 2),
t AS (SELECT department, CAST(sum(f) AS BIGINT) all_flagged, CAST(sum(1 - f) AS BIGINT) all_others FROM p GROUP BY 1)
SELECT department, segment, flagged, others, all_flagged, all_others, flagged / nullif(all_flagged, 0) AS flagged_penetration,
  others / nullif(all_others, 0) AS other_penetration, (flagged / nullif(all_flagged, 0)) / nullif(others / nullif(all_others, 0), 0) AS index
FROM s JOIN t USING (department) WHERE all_flagged > 20"""))
def _(spark, d):
    df = star.product_sales(spark, d).join(star.customers(spark, d), "customer_id")
    return customers.affinity_index(df, ["department"], "segment", "own_label", min_customers=20)


@query("wallet_share_index", sql("""
WITH s AS (SELECT department, segment, sum(CASE WHEN own_label = 1 THEN amount ELSE 0 END) AS flagged_sales,
  sum(CASE WHEN own_label = 1 THEN 0 ELSE amount END) AS other_sales FROM ps JOIN cust USING (customer_id) GROUP BY 1, 2),
w AS (SELECT *, flagged_sales / nullif(sum(flagged_sales) OVER (PARTITION BY department), 0) AS flagged_share,
  other_sales / nullif(sum(other_sales) OVER (PARTITION BY department), 0) AS other_share FROM s)
SELECT *, flagged_share / nullif(other_share, 0) AS index FROM w"""))
def _(spark, d):
    df = star.product_sales(spark, d).join(star.customers(spark, d), "customer_id")
    return customers.wallet_index(df, ["department"], "segment", "own_label")


@query("rfm_features", sql("""
SELECT customer_id, CAST(date_diff('day', max(business_day), DATE '2001-09-01') AS BIGINT) AS recency,
  CAST(date_diff('day', min(business_day), DATE '2001-09-01') AS BIGINT) AS tenure, count(DISTINCT business_day) AS visit_days,
  count(DISTINCT transaction_id) AS orders, sum(amount) AS spend, sum(amount) / count(DISTINCT transaction_id) AS atv,
  date_diff('day', min(business_day), max(business_day)) / nullif(count(DISTINCT business_day) - 1, 0) AS inter_purchase_time
FROM tx GROUP BY 1"""))
def _(spark, d):
    return customers.rfm_features(star.transactions(spark, d), "2001-09-01")


POINTS = """
pts AS (SELECT customer_id, transaction_id, floor(billed_amount / 1000) AS loyalty_points, CASE WHEN priority = '1-URGENT' THEN floor(billed_amount / 2000) END AS redeemed_points,
  CASE WHEN priority = '2-HIGH' THEN floor(billed_amount / 4000) END AS forced_redemption_points FROM tx),
bal AS (SELECT customer_id, sum(loyalty_points) AS issued, coalesce(sum(redeemed_points), 0) AS redeemed, coalesce(sum(forced_redemption_points), 0) AS forced
  FROM (SELECT DISTINCT * FROM pts) GROUP BY 1)"""


def _with_points(spark, d):
    billed = F.col("billed_amount")
    return star.transactions(spark, d).select(
        "*",
        F.floor(billed / 1000).cast("double").alias("loyalty_points"),
        F.when(F.col("priority") == "1-URGENT", F.floor(billed / 2000).cast("double")).alias("redeemed_points"),
        F.when(F.col("priority") == "2-HIGH", F.floor(billed / 4000).cast("double")).alias("forced_redemption_points"),
    )


@query("points_balance", sql(f"WITH {POINTS} SELECT *, issued - redeemed - forced AS balance FROM bal"))
def _(spark, d):
    return customers.points_balance(_with_points(spark, d))


@query("propensity_features", sql(f"""
WITH {POINTS},
r AS (SELECT customer_id, CAST(date_diff('day', max(business_day), DATE '2001-09-01') AS BIGINT) AS recency,
  CAST(date_diff('day', min(business_day), DATE '2001-09-01') AS BIGINT) AS tenure, count(DISTINCT business_day) AS visit_days,
  count(DISTINCT transaction_id) AS orders, sum(amount) AS spend, sum(amount) / count(DISTINCT transaction_id) AS atv,
  date_diff('day', min(business_day), max(business_day)) / nullif(count(DISTINCT business_day) - 1, 0) AS inter_purchase_time FROM tx GROUP BY 1)
SELECT r.*, issued, redeemed, forced, issued - redeemed - forced AS balance FROM r JOIN bal USING (customer_id)
WHERE recency >= 0 AND spend > 0 AND issued - redeemed - forced >= 0"""))
def _(spark, d):
    return customers.propensity_features(_with_points(spark, d), "2001-09-01")


VISITS = """
v AS (SELECT customer_id, business_day, row_number() OVER w AS visit, CAST(date_diff('day', lag(business_day) OVER w, business_day) AS BIGINT) AS gap_days
  FROM (SELECT DISTINCT customer_id, business_day FROM tx) WINDOW w AS (PARTITION BY customer_id ORDER BY business_day))"""


@query("visit_gaps", sql(f"WITH {VISITS} SELECT customer_id, CAST(business_day AS VARCHAR) AS day, visit, gap_days FROM v"))
def _(spark, d):
    out = customers.visit_gaps(star.transactions(spark, d))
    return out.select("customer_id", F.col("business_day").cast("string").alias("day"), "visit", "gap_days")


@query("second_visit_gap", sql(f"""
WITH {VISITS} SELECT visit, count(*) AS customers, avg(gap_days) AS avg_gap_days FROM v WHERE visit BETWEEN 2 AND 3 GROUP BY 1"""))
def _(spark, d):
    return customers.nth_visit_gap(star.transactions(spark, d), 3)


@query("first_purchase_spend", sql("""
WITH f AS (SELECT department, customer_id, min(business_day) AS fd FROM ps GROUP BY 1, 2)
SELECT f.department, f.customer_id, CAST(fd AS VARCHAR) AS first_day, sum(amount) AS first_spend, count(DISTINCT transaction_id) AS first_orders
FROM f JOIN ps ON ps.department = f.department AND ps.customer_id = f.customer_id AND ps.business_day = fd GROUP BY ALL"""))
def _(spark, d):
    out = customers.first_purchase_spend(star.product_sales(spark, d), by=["department"])
    return out.withColumn("first_day", F.col("first_day").cast("string"))


@query("store_loyalists", sql("""
WITH c AS (SELECT segment, customer_id, store_id, sum(amount) s FROM cs GROUP BY ALL),
p AS (SELECT segment, customer_id, max(s) / sum(s) AS top FROM c GROUP BY 1, 2)
SELECT segment, count(*) AS customers, count(*) FILTER (WHERE round(top, 4) > 0.3) AS loyal_customers,
  count(*) FILTER (WHERE round(top, 4) > 0.3) / count(*) AS customer_perc FROM p GROUP BY 1"""))
def _(spark, d):
    return customers.store_loyalists(star.segment_sales(spark, d), 0.3, by=["segment"])


@query("loyalty_share", sql("""
WITH t AS (SELECT *, balance > 5000 AS m FROM cs)
SELECT year(business_day) AS year, count(DISTINCT transaction_id) AS receipts, count(DISTINCT CASE WHEN m THEN transaction_id END) AS member_receipts,
  count(DISTINCT customer_id) AS customers, count(DISTINCT CASE WHEN m THEN customer_id END) AS member_customers,
  count(DISTINCT CASE WHEN m THEN transaction_id END) / count(DISTINCT transaction_id) AS member_receipt_share,
  count(DISTINCT transaction_id) / count(DISTINCT customer_id) AS frequency,
  count(DISTINCT CASE WHEN m THEN transaction_id END) / nullif(count(DISTINCT CASE WHEN m THEN customer_id END), 0) AS member_frequency
FROM t GROUP BY 1"""))
def _(spark, d):
    df = star.segment_sales(spark, d).withColumn("year", F.year("business_day"))
    return customers.loyalty_share(df, ["year"], F.col("balance") > 5000)


@query("atv_stretch_cohort", sql("""
WITH r AS (SELECT customer_id, transaction_id, sum(amount) v FROM tx GROUP BY 1, 2)
SELECT customer_id, count(*) AS orders, sum(v) AS spend, avg(v) AS atv, count(*) FILTER (WHERE v >= 15000000) AS breaches FROM r GROUP BY 1
HAVING avg(v) BETWEEN 5000000 AND 10000000 AND count(*) FILTER (WHERE v >= 15000000) > 0"""))
def _(spark, d):
    return customers.atv_stretch_cohort(star.transactions(spark, d), 5_000_000, 10_000_000, 15_000_000)


@query("breach_count", sql("""
WITH r AS (SELECT customer_id, transaction_id, sum(amount) v FROM tx GROUP BY 1, 2)
SELECT customer_id, count(*) FILTER (WHERE v >= 10000000) AS breaches FROM r GROUP BY 1 HAVING count(*) FILTER (WHERE v >= 10000000) > 3"""))
def _(spark, d):
    return customers.breach_count(star.transactions(spark, d), 10_000_000, 3)


@query("inactive_base", sql(f"""
WITH p AS (SELECT segment, customer_id, max(CASE WHEN {SQL_CY} THEN 1 ELSE 0 END) e FROM cs GROUP BY 1, 2)
SELECT segment, customer_id FROM p WHERE e = 0"""))
def _(spark, d):
    return customers.inactive_base(star.segment_sales(spark, d), ["segment"], cy())


@query("activation", sql(f"""
WITH p AS (SELECT segment, customer_id, max(CASE WHEN {SQL_PY} THEN 1 ELSE 0 END) b, max(CASE WHEN {SQL_CY} THEN 1 ELSE 0 END) e FROM cs GROUP BY 1, 2)
SELECT segment, count(*) AS inactive, CAST(sum(e) AS BIGINT) AS activated, sum(e) / count(*) AS activation_rate FROM p WHERE b = 0 GROUP BY 1"""))
def _(spark, d):
    return customers.activation(star.segment_sales(spark, d), py(), cy(), ["segment"])


@query("compare_cohorts", sql(f"""
WITH c AS (SELECT customer_id, sum(amount) spend, count(DISTINCT transaction_id) orders FROM tx GROUP BY 1),
a AS (SELECT DISTINCT customer_id FROM ps WHERE department = 'PROMO' AND {SQL_CY})
SELECT CAST(a.customer_id IS NOT NULL AS INTEGER) AS activated, count(*) AS customers, avg(spend) AS avg_spend, avg(orders) AS avg_orders
FROM c LEFT JOIN a USING (customer_id) GROUP BY 1"""))
def _(spark, d):
    per = star.transactions(spark, d).groupBy("customer_id").agg(
        F.sum("amount").alias("spend"), F.countDistinct("transaction_id").alias("orders")
    )
    cohort = star.product_sales(spark, d).filter((F.col("department") == "PROMO") & cy())
    return customers.compare_cohorts(per, cohort, "customer_id", ["spend", "orders"])


@query("rolling_retention", sql("""
WITH m AS (SELECT DISTINCT region, customer_id, year(business_day) * 12 + month(business_day) AS m FROM ss),
span AS (SELECT min(m) lo, max(m) hi FROM m),
t AS (SELECT unnest(generate_series(lo + 3, hi)) AS target FROM span),
w AS (SELECT DISTINCT region, customer_id, target FROM m, t WHERE m BETWEEN target - 3 AND target - 1)
SELECT w.region, CAST((w.target - 1) // 12 * 100 + (w.target - 1) % 12 + 1 AS INTEGER) AS year_month, count(*) AS window_customers,
  count(m.customer_id) AS returning, count(m.customer_id) / count(*) AS retention
FROM w LEFT JOIN m ON m.region = w.region AND m.customer_id = w.customer_id AND m.m = w.target GROUP BY 1, 2"""))
def _(spark, d):
    return customers.rolling_retention(star.store_sales(spark, d), by=["region"])


@query("lapse_new", sql("""
WITH m AS (SELECT DISTINCT customer_id, year(business_day) * 12 + month(business_day) AS m FROM tx), span AS (SELECT min(m) lo, max(m) hi FROM m)
SELECT CAST((a.m - 1) // 12 * 100 + (a.m - 1) % 12 + 1 AS INTEGER) AS year_month, count(*) AS customers,
  count(*) FILTER (WHERE NOT EXISTS (SELECT 1 FROM m b WHERE b.customer_id = a.customer_id AND b.m = a.m - 1)) AS new_customers,
  count(*) FILTER (WHERE NOT EXISTS (SELECT 1 FROM m b WHERE b.customer_id = a.customer_id AND b.m BETWEEN a.m + 1 AND a.m + 5)) AS lapsed
FROM m a, span WHERE a.m > lo AND a.m + 5 <= hi GROUP BY a.m"""))
def _(spark, d):
    return customers.lapse_new(star.transactions(spark, d))


MIGRATION = """CASE WHEN n >= 4 THEN 'Frequentist' WHEN n >= 2 THEN 'Regular' ELSE 'Slider' END"""


@query("segment_migration", sql(f"""
WITH a AS (SELECT customer_id, {MIGRATION} s FROM (SELECT customer_id, count(DISTINCT transaction_id) n FROM tx WHERE {SQL_PY} GROUP BY 1)),
b AS (SELECT customer_id, {MIGRATION} s FROM (SELECT customer_id, count(DISTINCT transaction_id) n FROM tx WHERE {SQL_CY} GROUP BY 1))
SELECT a.s AS from_segment, b.s AS to_segment, count(*) AS customers FROM a JOIN b USING (customer_id) GROUP BY 1, 2"""))
def _(spark, d):
    def snapshot(test):
        n = star.transactions(spark, d).filter(test).groupBy("customer_id").agg(F.countDistinct("transaction_id").alias("n"))
        label = F.when(F.col("n") >= 4, "Frequentist").when(F.col("n") >= 2, "Regular").otherwise("Slider")
        return n.select("customer_id", label.alias("segment"))

    return customers.segment_migration(snapshot(py()), snapshot(cy()))


@query("organic_share", sql("""
WITH p AS (SELECT DISTINCT transaction_id, product_id FROM tx WHERE discount_percent >= 8)
SELECT tx.customer_id, sum(amount) AS spend, sum(CASE WHEN p.product_id IS NOT NULL THEN amount ELSE 0 END) AS promo_spend,
  sum(amount) - sum(CASE WHEN p.product_id IS NOT NULL THEN amount ELSE 0 END) AS organic_spend,
  sum(CASE WHEN p.product_id IS NOT NULL THEN amount ELSE 0 END) / sum(amount) AS promo_share
FROM tx LEFT JOIN p USING (transaction_id, product_id) GROUP BY 1"""))
def _(spark, d):
    tx = star.transactions(spark, d)
    promo = tx.filter("discount_percent >= 8").select("transaction_id", "product_id")
    return customers.organic_share(tx, promo, ["transaction_id", "product_id"])


@query("customer_penetration", sql("""
WITH p AS (SELECT DISTINCT brand, customer_id, segment FROM ps JOIN cust USING (customer_id)),
t AS (SELECT count(DISTINCT customer_id) n, count(DISTINCT CASE WHEN segment = 'BUILDING' THEN customer_id END) nb,
  count(DISTINCT CASE WHEN segment = 'FURNITURE' THEN customer_id END) nf FROM p),
b AS (SELECT brand, count(DISTINCT customer_id) AS customers, count(DISTINCT CASE WHEN segment = 'BUILDING' THEN customer_id END) AS building_customers,
  count(DISTINCT CASE WHEN segment = 'FURNITURE' THEN customer_id END) AS furniture_customers FROM p GROUP BY 1)
SELECT b.*, customers / n AS penetration, building_customers / nb AS building_penetration, furniture_customers / nf AS furniture_penetration,
  (building_customers + furniture_customers) / customers AS segment_share FROM b, t"""))
def _(spark, d):
    df = star.product_sales(spark, d).join(star.customers(spark, d), "customer_id")
    return metrics.customer_penetration(df, ["brand"], "segment", ["BUILDING", "FURNITURE"])


@query("store_penetration_classes", sql("""
WITH s AS (SELECT region, product_id, count(DISTINCT store_id) stores FROM ss GROUP BY 1, 2),
t AS (SELECT region, count(DISTINCT store_id) all_stores FROM ss GROUP BY 1), j AS (SELECT *, round(stores / all_stores, 2) AS penetration FROM s JOIN t USING (region))
SELECT *, CASE WHEN penetration <= 0.3 THEN 'Low' WHEN penetration <= 0.7 THEN 'Middle' ELSE 'High' END AS pen_class FROM j"""))
def _(spark, d):
    return metrics.store_penetration(star.store_sales(spark, d), "product_id", "store_id", ["region"])


@query("store_penetration_top_skus", sql("""
WITH t AS (SELECT product_id, sum(amount) s FROM tx GROUP BY 1 ORDER BY s DESC, product_id LIMIT 20)
SELECT product_id, s AS sales, count(DISTINCT store_id) AS stores, count(DISTINCT store_id) / (SELECT count(DISTINCT store_id) FROM tx) AS penetration
FROM t JOIN tx USING (product_id) GROUP BY 1, 2"""))
def _(spark, d):
    per = star.transactions(spark, d).groupBy("product_id").agg(F.sum("amount").alias("sales"), F.countDistinct("store_id").alias("stores"))
    top = series.top_k(per, [F.col("sales").desc(), F.col("product_id")], 20)
    total = star.transactions(spark, d).agg(F.countDistinct("store_id").alias("n"))
    return top.crossJoin(F.broadcast(total)).select("product_id", "sales", "stores", (F.col("stores") / F.col("n")).alias("penetration"))


@query("numeric_distribution", sql("""
WITH s AS (SELECT region, category, brand, count(DISTINCT store_id) stores FROM sales GROUP BY ALL),
c AS (SELECT region, category, count(DISTINCT store_id) category_stores FROM sales GROUP BY ALL)
SELECT *, stores / category_stores AS numeric_dist FROM s JOIN c USING (region, category)"""))
def _(spark, d):
    return metrics.numeric_distribution(star.sales(spark, d), "brand", "category", by=["region"])


@query("weighted_distribution", sql("""
WITH c AS (SELECT material_group, store_id, year(business_day) * 100 + month(business_day) AS period, sum(amount) m FROM ps GROUP BY ALL),
s AS (SELECT store_id, period, sum(m) s FROM c GROUP BY ALL), t AS (SELECT period, sum(s) all_store_sales FROM s GROUP BY 1),
k AS (SELECT material_group, period, count(*) stores, sum(s) carrying_store_sales FROM c JOIN s USING (store_id, period) GROUP BY ALL)
SELECT *, carrying_store_sales / all_store_sales AS cwd FROM k JOIN t USING (period)"""))
def _(spark, d):
    df = star.product_sales(spark, d).withColumn("period", dates.year_month("business_day"))
    return metrics.weighted_distribution(df, "material_group", "store_id", "period")


@query("basket_size_lfl", sql(f"""
WITH r AS (SELECT year(business_day) AS year, transaction_id, count(DISTINCT product_id) n FROM tx WHERE {SQL_CY} OR {SQL_PY} GROUP BY ALL)
SELECT year, count(*) AS receipts, CAST(sum(n) AS BIGINT) AS items, avg(n) AS basket_size FROM r GROUP BY 1"""))
def _(spark, d):
    df = star.transactions(spark, d).filter(cy() | py()).withColumn("year", F.year("business_day"))
    return metrics.basket_size(df, ["year"])


@query("basket_coverage", sql("""
WITH c AS (SELECT department, material_group, count(*) lines FROM ps GROUP BY 1, 2),
s AS (SELECT *, lines / sum(lines) OVER () AS share, count(*) OVER (PARTITION BY department) AS groups FROM c)
SELECT *, share / groups AS normalized_share FROM s"""))
def _(spark, d):
    return baskets.basket_coverage(star.product_sales(spark, d), ["department"], ["material_group"])


@query("co_purchase", sql("""
WITH b AS (SELECT DISTINCT transaction_id, category FROM ps), x AS (SELECT transaction_id FROM b WHERE category = 'widget'),
n AS (SELECT transaction_id, count(*) k FROM b GROUP BY 1)
SELECT category, count(*) AS receipts, count(*) FILTER (WHERE k = 1) AS solo_receipts FROM b JOIN x USING (transaction_id) JOIN n USING (transaction_id) GROUP BY 1"""))
def _(spark, d):
    return baskets.co_purchase(star.product_sales(spark, d), "widget", "category")


@query("solo_share", sql("""
WITH b AS (SELECT transaction_id, max(CAST(category = 'gear' AS INTEGER)) x, count(DISTINCT category) k FROM ps GROUP BY 1)
SELECT 'gear' AS category, count(*) AS receipts, count(*) FILTER (WHERE k = 1) AS solo_receipts, count(*) FILTER (WHERE k = 1) / count(*) AS solo_share FROM b WHERE x = 1"""))
def _(spark, d):
    return baskets.solo_share(star.product_sales(spark, d), "gear", "category")


GAP = """
g AS (SELECT department, category, transaction_id, max(own_label) f, sum(amount) v FROM ps GROUP BY ALL),
h AS (SELECT department, category, count(*) FILTER (WHERE f = 1) AS flagged_receipts, sum(CASE WHEN f = 1 THEN v ELSE 0 END) AS flagged_sales,
  count(*) FILTER (WHERE f = 0) AS other_receipts, sum(CASE WHEN f = 1 THEN 0 ELSE v END) AS other_sales FROM g GROUP BY 1, 2),
gap AS (SELECT *, flagged_sales / nullif(flagged_receipts, 0) AS flagged_atv, other_sales / nullif(other_receipts, 0) AS other_atv,
  flagged_sales / nullif(flagged_receipts, 0) - other_sales / nullif(other_receipts, 0) AS atv_gap FROM h)"""


@query("atv_gap", sql(f"WITH {GAP} SELECT * FROM gap"))
def _(spark, d):
    return baskets.atv_gap(star.product_sales(spark, d), ["department", "category"], "own_label")


@query("best_atv_gap", sql(f"""
WITH {GAP} SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY department ORDER BY atv_gap DESC, category) AS position FROM gap WHERE atv_gap IS NOT NULL) WHERE position = 1"""))
def _(spark, d):
    return baskets.best_atv_gap(star.product_sales(spark, d), ["department"], "category", "own_label")


@query("weekly_average_kpis", sql("""
WITH w AS (SELECT region, date_trunc('week', business_day) AS wk, sum(amount) s, count(DISTINCT transaction_id) t, count(DISTINCT customer_id) c FROM ss GROUP BY 1, 2)
SELECT region, count(*) AS periods, avg(s) AS avg_sales, avg(t) AS avg_transactions, avg(c) AS avg_customers, round(avg(s / t), 4) AS avg_atv, round(avg(s / c), 4) AS avg_rpc FROM w GROUP BY 1"""))
def _(spark, d):
    df = star.store_sales(spark, d).withColumn("week", F.date_trunc("week", "business_day"))
    out = metrics.period_average(df, "week", ["region"])
    return out.withColumn("avg_atv", F.round("avg_atv", 4)).withColumn("avg_rpc", F.round("avg_rpc", 4))


@query("rate_of_sales", sql("""
SELECT brand, sum(amount) AS sales, count(DISTINCT business_day) AS periods, sum(amount) / count(DISTINCT business_day) AS rate_of_sales FROM ps GROUP BY 1"""))
def _(spark, d):
    return metrics.rate_of_sales(star.product_sales(spark, d), ["brand"], "business_day")


@query("avg_weekly", sql("""
SELECT product_id, sum(amount) AS sales, count(DISTINCT date_trunc('week', business_day)) AS periods, sum(amount) / count(DISTINCT date_trunc('week', business_day)) AS rate_of_sales FROM tx GROUP BY 1"""))
def _(spark, d):
    df = star.transactions(spark, d).withColumn("week", F.date_trunc("week", "business_day"))
    return metrics.rate_of_sales(df, ["product_id"], "week")


@query("reconcile", sql("""
WITH p AS (SELECT transaction_id, sum(amount) lines, max(billed_amount) billed FROM all_tx GROUP BY 1)
SELECT count(*) AS receipts, count(*) FILTER (WHERE abs(lines - billed) <= 10000000) AS matched,
  count(*) FILTER (WHERE abs(lines - billed) <= 10000000) / count(*) AS match_rate FROM p"""))
def _(spark, d):
    return metrics.reconcile(star.all_transactions(spark, d), "transaction_id", "amount", "billed_amount", 10_000_000)


@query("modal_discount", sql("""
WITH c AS (SELECT brand, discount_percent, count(*) n FROM ps GROUP BY 1, 2), r AS (SELECT *, rank() OVER (PARTITION BY brand ORDER BY n DESC) k FROM c)
SELECT brand, discount_percent AS modal_value, n FROM r WHERE k = 1"""))
def _(spark, d):
    return metrics.modal_value(star.product_sales(spark, d), ["brand"], "discount_percent")


@query("purchase_histogram", sql("""
WITH p AS (SELECT segment, customer_id, count(DISTINCT transaction_id) n FROM cs GROUP BY 1, 2)
SELECT segment, CASE WHEN n >= 4 THEN '4+' ELSE CAST(n AS VARCHAR) END AS class, count(*) AS keys FROM p GROUP BY 1, 2"""))
def _(spark, d):
    return metrics.count_histogram(star.segment_sales(spark, d), ["segment"], "customer_id", "transaction_id")


@query("store_deciles", sql("""
WITH s AS (SELECT store_id, sum(amount) m FROM tx GROUP BY 1), r AS (SELECT *, (sum(m) OVER (ORDER BY m DESC, store_id ROWS UNBOUNDED PRECEDING) - m) / sum(m) OVER () AS b FROM s),
t AS (SELECT store_id, m, CAST(least(floor(b * 10) + 1, 10) AS INTEGER) AS decile FROM r), p AS (SELECT DISTINCT store_id, product_id FROM tx)
SELECT decile, count(DISTINCT store_id) AS stores, (SELECT sum(m) FROM t t2 WHERE t2.decile = t.decile) AS sales, count(DISTINCT product_id) AS skus,
  count(*) / count(DISTINCT store_id) AS skus_per_store FROM t JOIN p USING (store_id) GROUP BY 1"""))
def _(spark, d):
    return metrics.store_deciles(star.transactions(spark, d), "store_id", "product_id")


@query("share_in_family", sql("""
SELECT sum(CASE WHEN material_group = 'red widget' THEN amount ELSE 0 END) AS value_sales, sum(amount) AS family_sales,
  sum(CASE WHEN material_group = 'red widget' THEN amount ELSE 0 END) / sum(amount) AS share FROM ps WHERE material_group LIKE '%widget'"""))
def _(spark, d):
    return metrics.share_in_family(star.product_sales(spark, d), "material_group", "red widget", "%widget")


@query("attribute_completeness", sql("""
WITH a AS (SELECT department, product_id, CASE WHEN content > 5 THEN content END AS content, CASE WHEN brand <> 'Brand#3' THEN brand END AS brand,
  CASE WHEN category <> 'bolt' THEN category END AS category FROM product),
c AS (SELECT department, count(*) AS keys, count(content) AS content, count(brand) AS brand, count(category) AS category FROM a GROUP BY 1)
SELECT department, keys, attribute, CAST(n AS DOUBLE) AS with_value, n / keys AS completeness FROM (UNPIVOT c ON content, brand, category INTO NAME attribute VALUE n)"""))
def _(spark, d):
    a = star.products(spark, d).select(
        "department",
        "product_id",
        F.when(F.col("content") > 5, F.col("content")).alias("content"),
        F.when(F.col("brand") != "Brand#3", F.col("brand")).alias("brand"),
        F.when(F.col("category") != "bolt", F.col("category")).alias("category"),
    )
    return metrics.completeness(a, "product_id", ["content", "brand", "category"], ["department"])


@query("iqr_bounds", sql("""
WITH c AS (SELECT CAST(sum(amount) AS DOUBLE) spend, CAST(count(DISTINCT transaction_id) AS DOUBLE) orders FROM tx GROUP BY customer_id), l AS (UNPIVOT c ON spend, orders INTO NAME col VALUE v),
q AS (SELECT col, quantile_cont(v, 0.25) q1, quantile_cont(v, 0.75) q3 FROM l GROUP BY 1)
SELECT col AS "column", q1, q3, q1 - (q3 - q1) * 1.5 AS lower, q3 + (q3 - q1) * 1.5 AS upper FROM q"""))
def _(spark, d):
    per = star.transactions(spark, d).groupBy("customer_id").agg(
        F.sum("amount").alias("spend"), F.countDistinct("transaction_id").alias("orders")
    )
    return metrics.iqr_bounds(per, ["spend", "orders"])


@query("summary_stats", sql("""
WITH l AS (UNPIVOT (SELECT quantity, amount FROM tx) ON quantity, amount INTO NAME col VALUE v)
SELECT col AS "column", count(*) AS n, avg(v) AS mean, round(stddev_samp(v), 4) AS std, min(v) AS min, max(v) AS max,
  quantile_cont(v, 0.25) AS p25, quantile_cont(v, 0.5) AS p50, quantile_cont(v, 0.75) AS p75 FROM l GROUP BY 1"""))
def _(spark, d):
    return metrics.summary_stats(star.transactions(spark, d), ["quantity", "amount"]).withColumn("std", F.round("std", 4))


@query("rate_by_feature", sql(f"""
WITH c AS (SELECT customer_id, segment, nationality, max(CASE WHEN {SQL_CY} THEN 1 ELSE 0 END) f FROM cs GROUP BY ALL)
SELECT 'segment' AS feature, segment AS level, count(*) AS n, avg(f) AS rate FROM c GROUP BY 2
UNION ALL SELECT 'nationality', nationality, count(*), avg(f) FROM c GROUP BY 2"""))
def _(spark, d):
    per = star.segment_sales(spark, d).groupBy("customer_id", "segment", "nationality").agg(F.max(cy().cast("int")).alias("f"))
    return metrics.rate_by(per, ["segment", "nationality"], "f")


@query("data_profile", sql("""
WITH l AS (SELECT 'brand' AS col, brand AS v FROM ps UNION ALL SELECT 'category', category FROM ps UNION ALL SELECT 'transaction_id', CAST(transaction_id AS VARCHAR) FROM ps)
SELECT col AS "column", count(*) AS rows, count(v) AS non_null, count(DISTINCT v) AS "distinct" FROM l GROUP BY 1"""))
def _(spark, d):
    return metrics.profile(star.product_sales(spark, d), ["brand", "category", "transaction_id"])


@query("top_brands_by_nationality", sql("""
WITH a AS (SELECT nationality, brand, sum(amount) s FROM ps JOIN cust USING (customer_id) GROUP BY 1, 2)
SELECT * EXCLUDE (s), s AS sales FROM (SELECT *, row_number() OVER (PARTITION BY nationality ORDER BY s DESC, brand) AS position FROM a) WHERE position <= 5"""))
def _(spark, d):
    df = star.product_sales(spark, d).join(star.customers(spark, d), "customer_id")
    per = df.groupBy("nationality", "brand").agg(F.sum("amount").alias("sales"))
    return series.top_n(per, ["nationality"], [F.col("sales").desc(), F.col("brand")], 5)


@query("top_brands_in_top_stores", sql("""
WITH s AS (SELECT nationality, store_id, sum(amount) v FROM cs GROUP BY 1, 2),
t AS (SELECT nationality, store_id FROM (SELECT *, row_number() OVER (PARTITION BY nationality ORDER BY v DESC, store_id) k FROM s) WHERE k <= 3),
b AS (SELECT nationality, store_id, brand, sum(amount) v FROM ps JOIN cust USING (customer_id) WHERE (nationality, store_id) IN (SELECT (nationality, store_id) FROM t) GROUP BY ALL)
SELECT nationality, store_id, brand, v AS sales, position FROM (SELECT *, row_number() OVER (PARTITION BY nationality, store_id ORDER BY v DESC, brand) AS position FROM b) WHERE position <= 2"""))
def _(spark, d):
    df = star.segment_sales(spark, d)
    best = series.top_n(
        df.groupBy("nationality", "store_id").agg(F.sum("amount").alias("v")), ["nationality"], [F.col("v").desc(), F.col("store_id")], 3
    )
    kept = df.join(best.select("nationality", "store_id"), ["nationality", "store_id"], "left_semi").join(star.products(spark, d), "product_id")
    per = kept.groupBy("nationality", "store_id", "brand").agg(F.sum("amount").alias("sales"))
    return series.top_n(per, ["nationality", "store_id"], [F.col("sales").desc(), F.col("brand")], 2)


@query("one_timer_recency", sql("""
WITH o AS (SELECT customer_id, segment, max(business_day) l FROM cs GROUP BY 1, 2 HAVING count(DISTINCT transaction_id) <= 5), r AS (SELECT segment, CAST(date_diff('day', l, DATE '2001-09-01') AS DOUBLE) d FROM o)
SELECT segment, quantile_cont(d, 0.25) AS p25, quantile_cont(d, 0.5) AS p50, quantile_cont(d, 0.75) AS p75 FROM r GROUP BY 1"""))
def _(spark, d):
    few = customers.rfm_features(star.transactions(spark, d), "2001-09-01").filter("orders <= 5")
    rows = few.join(star.customers(spark, d), "customer_id").select("segment", F.col("recency").cast("double").alias("recency"))
    return ordered.percentiles(rows, "recency", {"p25": 0.25, "p50": 0.5, "p75": 0.75}, ["segment"])


@query("band_cohort", sql("""
WITH r AS (SELECT customer_id, count(DISTINCT transaction_id) AS orders, sum(amount) / count(DISTINCT transaction_id) AS atv, date_diff('day', max(business_day), DATE '2001-09-01') AS recency FROM tx GROUP BY 1)
SELECT customer_id, orders, atv FROM r WHERE orders BETWEEN 5 AND 12 AND atv BETWEEN 3000000 AND 9000000 AND recency BETWEEN 0 AND 400"""))
def _(spark, d):
    rfm = customers.rfm_features(star.transactions(spark, d), "2001-09-01")
    chosen = customers.band_filter(rfm, {"orders": (5, 12), "atv": (3_000_000, 9_000_000), "recency": (0, 400)})
    return chosen.select("customer_id", "orders", "atv")


@query("set_operations", sql(f"""
WITH a AS (SELECT DISTINCT product_id FROM tx WHERE {SQL_CY}), b AS (SELECT DISTINCT product_id FROM tx WHERE {SQL_PY})
SELECT 'kept' AS part, count(*) AS products FROM (SELECT * FROM a INTERSECT SELECT * FROM b) UNION ALL SELECT 'added', count(*) FROM (SELECT * FROM a EXCEPT SELECT * FROM b)"""))
def _(spark, d):
    tx = star.transactions(spark, d)
    a, b = tx.filter(cy()).select("product_id"), tx.filter(py()).select("product_id")
    count = lambda name, df: df.agg(F.lit(name).alias("part"), F.count(F.lit(1)).alias("products"))
    return sets.union_all([count("kept", sets.intersect(a, b)), count("added", sets.difference(a, b))])
