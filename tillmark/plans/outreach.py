"""Campaign audiences, splits and results.

The events play campaign delivery: a purchase or signup counts as opened, a click as not opened, and the
week of the event names the campaign.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tillmark.functions import dates
from tillmark.functions.exprs import seeded_order
from tillmark.operators import campaigns, customers, joins, metrics, series
from tillmark.plans import star
from tillmark.plans.core import SQL_CY, SQL_PY, cy, py
from tillmark.plans.registry import query
from tillmark.plans.star import sql
from tillmark.session import stage

AUDIENCE = f"""
aud AS (SELECT customer_id, segment, sum(amount) AS rpc, count(DISTINCT transaction_id) AS orders, sum(amount) / count(DISTINCT transaction_id) AS atv FROM cs
  WHERE segment IN ('BUILDING', 'FURNITURE') AND {SQL_CY} AND customer_id NOT IN (SELECT DISTINCT user_id FROM events WHERE event_type = 'purchase')
  AND customer_id NOT IN (SELECT customer_id FROM ps WHERE department = 'PROMO' AND {SQL_PY}) GROUP BY 1, 2)"""


@query("build_audience", sql(f"WITH {AUDIENCE} SELECT * FROM aud"))
def _(spark, d):
    engaged = star.table(spark, d, "events").filter("event_type = 'purchase'").select(F.col("user_id").alias("customer_id"))
    promo = star.product_sales(spark, d).filter((F.col("department") == "PROMO") & py())
    return campaigns.build_audience(
        star.transactions(spark, d).filter(cy()), star.customers(spark, d), ["BUILDING", "FURNITURE"], engaged, promo
    )


LISTS = f"""
lists AS (SELECT DISTINCT CASE WHEN department = 'PROMO' THEN 'promo intro' WHEN department = 'LARGE' THEN 'large intro' ELSE 'small boost' END AS campaign, customer_id FROM ps
  WHERE department IN ('PROMO', 'LARGE', 'SMALL') AND {SQL_CY})"""
ORDER = ["promo intro", "large intro", "small boost"]
CAPS = {"promo intro": 60, "large intro": 90, "small boost": 150}


def lists(spark, d):
    df = star.product_sales(spark, d).filter(cy() & F.col("department").isin("PROMO", "LARGE", "SMALL"))
    name = F.when(F.col("department") == "PROMO", "promo intro").when(F.col("department") == "LARGE", "large intro").otherwise("small boost")
    return df.select(name.alias("campaign"), "customer_id").distinct()


@query("exclusive_audience", sql(f"WITH {LISTS} SELECT min(campaign) AS campaign, customer_id FROM lists GROUP BY customer_id HAVING count(*) = 1"))
def _(spark, d):
    return campaigns.exclusive_audience(lists(spark, d))


CAPPED = f"""{LISTS},
rk AS (SELECT *, row_number() OVER (PARTITION BY campaign ORDER BY md5('42|' || customer_id || '|' || campaign), customer_id) AS position FROM lists),
cap AS (SELECT * FROM rk WHERE position <= CASE campaign WHEN 'promo intro' THEN 60 WHEN 'large intro' THEN 90 ELSE 150 END)"""


@query("sample_cap", sql(f"WITH {CAPPED} SELECT * FROM cap"))
def _(spark, d):
    return campaigns.sample_cap(lists(spark, d), CAPS)


@query("allocate_audience", sql(f"""
WITH {CAPPED}, uq AS (SELECT min(campaign) AS campaign, customer_id FROM lists GROUP BY customer_id HAVING count(*) = 1),
c1 AS (SELECT customer_id FROM uq WHERE campaign = 'promo intro' UNION SELECT customer_id FROM cap WHERE campaign = 'promo intro'),
c2 AS (SELECT customer_id FROM uq WHERE campaign = 'large intro' UNION SELECT customer_id FROM cap WHERE campaign = 'large intro' AND customer_id NOT IN (SELECT customer_id FROM c1)),
c3 AS (SELECT customer_id FROM uq WHERE campaign = 'small boost' UNION SELECT customer_id FROM cap WHERE campaign = 'small boost' AND customer_id NOT IN (SELECT customer_id FROM c1) AND customer_id NOT IN (SELECT customer_id FROM c2))
SELECT 'promo intro' AS campaign, customer_id FROM c1 UNION ALL SELECT 'large intro', customer_id FROM c2 UNION ALL SELECT 'small boost', customer_id FROM c3"""))
def _(spark, d):
    return campaigns.allocate_audience(lists(spark, d), ORDER, CAPS)


@query("ntile_split", sql("""
SELECT customer_id, CAST(t AS INTEGER) AS tile, CASE WHEN t <= 19 THEN 'test' ELSE 'control' END AS campaign_set
FROM (SELECT customer_id, ntile(20) OVER (ORDER BY md5('42|' || customer_id), customer_id) t FROM cust)"""))
def _(spark, d):
    return campaigns.ntile_split(star.customers(spark, d).select("customer_id"), "customer_id")


@query("sample_rows", sql("SELECT customer_id, segment FROM cust ORDER BY md5('42|' || customer_id), customer_id LIMIT 100"))
def _(spark, d):
    return campaigns.sample_rows(star.customers(spark, d).select("customer_id", "segment"), 100, ["customer_id"])


# two-sided 5 % point of t, by its expansion in the degrees of freedom f, at the normal one
_Z = 1.959963984540054
_CRIT = f"({_Z} + {(_Z**3 + _Z) / 4} / f + {(5 * _Z**5 + 16 * _Z**3 + 3 * _Z) / 96} / f ** 2 + {(3 * _Z**7 + 19 * _Z**5 + 17 * _Z**3 - 15 * _Z) / 384} / f ** 3 + {(79 * _Z**9 + 776 * _Z**7 + 1482 * _Z**5 - 1920 * _Z**3 - 945 * _Z) / 92160} / f ** 4)"


# the largest p is that of the smallest |t|; degrees of freedom differ by little between seeds and enter to first order
@query("validated_split", sql(f"""
WITH pl AS (SELECT *, row_number() OVER (ORDER BY md5('0|' || customer_id), customer_id) AS p FROM (SELECT customer_id, sum(amount) AS x FROM tx GROUP BY 1)),
sz AS (SELECT count(*) AS n, avg(x) AS mean, CAST(floor(count(*) * 0.2 + 0.5) AS BIGINT) AS size FROM pl),
s0 AS (SELECT s, CAST('0x' || substr(md5('a|' || s), 1, 8) AS BIGINT) % least(n, 1000000000) + 1 AS a0, CAST('0x' || substr(md5('b|' || s), 1, 8) AS BIGINT) % n AS b FROM (SELECT unnest(range(0, 1000)) AS s), sz),
sd AS (SELECT s, list_filter(range(a0, a0 + 1000), lambda y: gcd(y, n) = 1)[1] AS a, b FROM s0, sz),
gr AS (SELECT s, (a * p + b) % n < size AS test, x - mean AS z FROM pl, sz, sd),
st AS (SELECT s, test, count(*) AS n, avg(z) AS m, var_samp(z) AS v, quantile_cont(z, 0.5) AS med FROM gr GROUP BY 1, 2),
dv AS (SELECT s, test, count(*) AS n, avg(abs(z - med)) AS m, var_samp(abs(z - med)) AS v FROM gr JOIN st USING (s, test) GROUP BY 1, 2),
gm AS (SELECT s, sum(n * m) / sum(n) AS g, sum(n) - 2 AS f FROM dv GROUP BY 1),
lw AS (SELECT s, sum(n * (m - g) ** 2) / (sum((n - 1) * v) / max(f)) AS w, max(f) AS f FROM dv JOIN gm USING (s) GROUP BY 1),
tt AS (SELECT t.s, w > {_CRIT} ** 2 AS unequal, f, (t.m - c.m) / sqrt(((t.n - 1) * t.v + (c.n - 1) * c.v) / f * (1 / t.n + 1 / c.n)) AS tp, (t.m - c.m) / sqrt(t.v / t.n + c.v / c.n) AS tw,
  (t.v / t.n + c.v / c.n) ** 2 / ((t.v / t.n) ** 2 / (t.n - 1) + (c.v / c.n) ** 2 / (c.n - 1)) AS fw FROM st t JOIN st c ON t.s = c.s AND t.test AND NOT c.test JOIN lw ON lw.s = t.s),
be AS (SELECT s FROM tt ORDER BY CASE WHEN unequal THEN abs(tw) * (1 - 1 / (4 * fw)) ELSE abs(tp) * (1 - 1 / (4 * f)) END, s LIMIT 1)
SELECT customer_id, CASE WHEN (a * p + b) % n < size THEN 'test' ELSE 'control' END AS campaign_set FROM pl, sz, sd WHERE s = (SELECT s FROM be)"""))
def _(spark, d):
    per = star.transactions(spark, d).groupBy("customer_id").agg(F.sum("amount").alias("spend"))
    split, report = campaigns.validated_split(per, "customer_id", "spend", 0.2)
    return split


DELIVERY = """
dl AS (SELECT DISTINCT CAST(floor((day(ts) - 1) / 7) + 1 AS INTEGER) AS campaign_id, user_id AS customer_id, event_type FROM events),
deliv AS (SELECT campaign_id, customer_id, CASE WHEN max(CASE WHEN event_type IN ('purchase', 'signup') THEN 1 ELSE 0 END) = 1 THEN 'opened' ELSE 'not_opened' END AS delivery_status
  FROM dl WHERE event_type IN ('purchase', 'signup', 'click') GROUP BY 1, 2),
audi AS (SELECT DISTINCT campaign_id, customer_id, CASE WHEN substr(md5('7|' || customer_id || '|' || campaign_id), 1, 1) < 'c' THEN 'test' ELSE 'control' END AS campaign_set FROM dl),
csales AS (SELECT CAST(year(business_day) - 1997 AS INTEGER) AS campaign_id, customer_id, count(DISTINCT transaction_id) AS num_trans, count(DISTINCT CASE WHEN discount_percent >= 5 THEN transaction_id END) AS num_offer_trans,
  sum(amount) AS total_spend, sum(CASE WHEN discount_percent >= 5 THEN amount ELSE 0 END) AS total_offer_spend FROM tx WHERE year(business_day) BETWEEN 1998 AND 2001 GROUP BY 1, 2)"""


def delivery_log(spark, d):
    return star.table(spark, d, "events").select(
        (F.floor((F.dayofmonth("ts") - 1) / 7) + 1).cast("int").alias("campaign_id"), F.col("user_id").alias("customer_id"), "event_type"
    ).distinct()


def delivery(spark, d):
    opened = F.col("event_type").isin("purchase", "signup").cast("int")
    log = delivery_log(spark, d).filter(F.col("event_type").isin("purchase", "signup", "click"))
    status = F.when(F.max(opened) == 1, F.lit("opened")).otherwise(F.lit("not_opened"))
    return log.groupBy("campaign_id", "customer_id").agg(status.alias("delivery_status"))


def audience(spark, d):
    part = F.when(F.substring(seeded_order(7, "customer_id", "campaign_id"), 1, 1) < "c", "test").otherwise("control")
    return delivery_log(spark, d).select("campaign_id", "customer_id").distinct().withColumn("campaign_set", part)


def campaign_sales(spark, d):
    offer = F.col("discount_percent") >= 5
    tx = star.transactions(spark, d).filter(F.year("business_day").between(1998, 2001))
    return tx.groupBy((F.year("business_day") - 1997).alias("campaign_id"), "customer_id").agg(
        F.countDistinct("transaction_id").alias("num_trans"),
        F.countDistinct(F.when(offer, F.col("transaction_id"))).alias("num_offer_trans"),
        F.sum("amount").alias("total_spend"),
        F.sum(F.when(offer, F.col("amount")).otherwise(0.0)).alias("total_offer_spend"),
    )


@query("campaign_metrics", sql(f"""
WITH {DELIVERY}, m AS (SELECT a.*, delivery_status AS s, coalesce(num_trans, 0) n, coalesce(num_offer_trans, 0) o, coalesce(total_spend, 0) v, coalesce(total_offer_spend, 0) w
  FROM audi a LEFT JOIN deliv USING (campaign_id, customer_id) LEFT JOIN csales USING (campaign_id, customer_id)),
f AS (SELECT campaign_id, campaign_set, count(customer_id) AS customers, count(*) FILTER (WHERE campaign_set = 'test' AND s = 'opened') AS read_customers, count(*) FILTER (WHERE campaign_set = 'test' AND s = 'not_opened') AS unread_customers,
  count(*) FILTER (WHERE ((campaign_set = 'test' AND s = 'opened') OR campaign_set = 'control') AND n > 0) AS read_returning, count(*) FILTER (WHERE ((campaign_set = 'test' AND s = 'not_opened') OR campaign_set = 'control') AND n > 0) AS unread_returning,
  count(*) FILTER (WHERE s = 'opened' AND o > 0) AS read_offer, count(*) FILTER (WHERE s = 'not_opened' AND o > 0) AS unread_offer,
  sum(CASE WHEN (campaign_set = 'test' AND s = 'opened') OR campaign_set = 'control' THEN v ELSE 0 END) AS spend, sum(CASE WHEN campaign_set = 'test' AND s = 'opened' THEN w ELSE 0 END) AS offer_spend,
  CAST(sum(CASE WHEN (campaign_set = 'test' AND s = 'opened') OR campaign_set = 'control' THEN n ELSE 0 END) AS BIGINT) AS transactions, CAST(sum(CASE WHEN campaign_set = 'test' AND s = 'opened' THEN o ELSE 0 END) AS BIGINT) AS offer_transactions FROM m GROUP BY 1, 2)
SELECT *, spend / nullif(transactions, 0) AS atv, spend / nullif(read_returning, 0) AS rpc, coalesce(read_returning / nullif(CASE WHEN campaign_set = 'test' THEN read_customers ELSE customers END, 0), 0) AS returning_share FROM f"""))
def _(spark, d):
    return campaigns.campaign_metrics(audience(spark, d), delivery(spark, d), campaign_sales(spark, d))


@query("offer_conversion", sql(f"""
WITH {DELIVERY}, a AS (SELECT customer_id, campaign_set FROM audi LEFT JOIN deliv USING (campaign_id, customer_id) WHERE campaign_id = 2 AND (campaign_set = 'control' OR delivery_status = 'opened')),
r AS (SELECT customer_id, sum(amount) rpc FROM tx WHERE {SQL_CY} GROUP BY 1)
SELECT campaign_set, count(DISTINCT customer_id) AS addressed, count(DISTINCT CASE WHEN rpc >= 10000000 THEN customer_id END) AS converted, avg(CASE WHEN rpc >= 10000000 THEN rpc END) AS converted_rpc,
  count(DISTINCT CASE WHEN rpc >= 10000000 THEN customer_id END) / count(DISTINCT customer_id) AS conversion FROM a LEFT JOIN r USING (customer_id) GROUP BY 1"""))
def _(spark, d):
    a = audience(spark, d).join(delivery(spark, d), ["campaign_id", "customer_id"], "left").filter("campaign_id = 2")
    return campaigns.offer_conversion(star.transactions(spark, d).filter(cy()), a, 10_000_000)


@query("expected_conversion", sql(f"""
WITH sg(campaign, segment) AS (VALUES ('A', 'BUILDING'), ('A', 'FURNITURE'), ('B', 'BUILDING')), ct(campaign, category) AS (VALUES ('A', 'widget'), ('B', 'gear'), ('B', 'ring')),
w AS (SELECT campaign, date_trunc('week', business_day) wk, count(DISTINCT customer_id) n FROM ps JOIN cust USING (customer_id) JOIN sg USING (segment) JOIN ct USING (campaign, category) WHERE {SQL_CY} GROUP BY 1, 2)
SELECT campaign, count(*) AS weeks, avg(n) AS avg_weekly_customers FROM w GROUP BY 1"""))
def _(spark, d):
    df = star.product_sales(spark, d).filter(cy()).join(star.customers(spark, d), "customer_id")
    df = df.withColumn("week", F.date_trunc("week", "business_day"))
    seg = spark.createDataFrame([("A", "BUILDING"), ("A", "FURNITURE"), ("B", "BUILDING")], "campaign string, segment string")
    cat = spark.createDataFrame([("A", "widget"), ("B", "gear"), ("B", "ring")], "campaign string, category string")
    return campaigns.expected_conversion(df, seg, cat, "week")


@query("campaign_open_rate", sql(f"""
WITH {DELIVERY}, o AS (SELECT customer_id, count(*) AS campaigns, count(*) FILTER (WHERE delivery_status = 'opened') AS opens FROM deliv GROUP BY 1)
SELECT *, opens / campaigns AS open_rate, CAST(campaigns >= 3 AND opens = 0 AS INTEGER) AS exclude_flag FROM o"""))
def _(spark, d):
    return campaigns.campaign_open_rate(delivery(spark, d))


@query("reachability", sql("""
WITH p AS (SELECT segment, CASE WHEN balance > 0 THEN 'm' END AS email, CASE WHEN balance > 4000 THEN '1' END AS mobile FROM cust)
SELECT segment, count(*) AS customers, count(email) AS with_email, count(mobile) AS with_mobile, count(email) / count(*) AS email_share, count(mobile) / count(*) AS mobile_share FROM p GROUP BY 1"""))
def _(spark, d):
    p = star.customers(spark, d).select(
        "segment", F.when(F.col("balance") > 0, "m").alias("email"), F.when(F.col("balance") > 4000, "1").alias("mobile")
    )
    return campaigns.reachability(p, ["segment"], ["email", "mobile"])


@query("members_check", sql(f"SELECT segment, count(*) AS customers FROM cust WHERE customer_id IN (SELECT customer_id FROM tx WHERE {SQL_CY}) GROUP BY 1"))
def _(spark, d):
    buyers = star.transactions(spark, d).filter(cy()).select("customer_id").distinct()
    profile = star.customers(spark, d)
    return campaigns.assert_members(stage(buyers), profile, "customer_id").join(profile, "customer_id").groupBy("segment").agg(
        F.count(F.lit(1)).alias("customers")
    )


@query("weekday_orders_of_promo_buyers", sql("""
WITH p AS (SELECT customer_id, sum(CASE WHEN discount_percent >= 6 THEN amount ELSE 0 END) / sum(amount) AS s FROM tx GROUP BY 1)
SELECT dayname(business_day) AS day_name, count(DISTINCT transaction_id) AS orders, sum(amount) AS sales FROM tx JOIN p USING (customer_id) WHERE s >= 0.5 GROUP BY 1"""))
def _(spark, d):
    tx = star.transactions(spark, d)
    promo = F.sum(F.when(F.col("discount_percent") >= 6, F.col("amount")).otherwise(0.0)) / F.sum("amount")
    chosen = tx.groupBy("customer_id").agg(promo.alias("s")).filter("s >= 0.5")
    return tx.join(chosen.select("customer_id"), "customer_id", "left_semi").groupBy(dates.day_name("business_day").alias("day_name")).agg(
        F.countDistinct("transaction_id").alias("orders"), F.sum("amount").alias("sales")
    )


@query("list_conversion", sql("""
WITH l AS (SELECT 'balance' AS campaign, customer_id FROM cust WHERE balance > 5000 UNION SELECT 'household', customer_id FROM cust WHERE segment = 'HOUSEHOLD'),
sp AS (SELECT customer_id, sum(amount) AS spend FROM tx GROUP BY 1),
a AS (SELECT campaign, c.customer_id, segment, CAST(c.customer_id IN (SELECT user_id FROM events WHERE event_type = 'click') AS INTEGER) AS touched, CAST(coalesce(spend, 0) >= 5e7 AS INTEGER) AS hit
  FROM l JOIN cust c USING (customer_id) LEFT JOIN sp USING (customer_id))
SELECT campaign, 'segment' AS feature, segment AS level, count(*) AS n, round(avg(hit), 8) AS rate FROM a GROUP BY 1, 3 UNION ALL SELECT campaign, 'touched', CAST(touched AS VARCHAR), count(*), round(avg(hit), 8) FROM a GROUP BY 1, 3"""))
def _(spark, d):
    """Of two lists, the share of customers over a spend, by segment and by whether an earlier campaign reached them."""
    people = star.customers(spark, d)
    lists = campaigns.campaign_lists({"balance": people.filter("balance > 5000"), "household": people.filter("segment = 'HOUSEHOLD'")})
    spend = star.transactions(spark, d).groupBy("customer_id").agg(F.sum("amount").alias("spend"))
    clicked = star.table(spark, d, "events").filter("event_type = 'click'").select(F.col("user_id").alias("customer_id")).distinct()
    reached = campaigns.touched_before(joins.keep(people, lists, keys=["customer_id"]), clicked)
    reached = joins.join_keys(reached, spend, ["customer_id"]).na.fill(0.0, subset=["spend"]).withColumn("hit", campaigns.threshold_met("spend", 5e7))
    parts = [
        customers.conversion_by_feature(reached.join(lists.filter(F.col("campaign") == name), "customer_id"), ["segment", "touched"], "hit").withColumn("campaign", F.lit(name))
        for name in ("balance", "household")
    ]
    return parts[0].unionByName(parts[1]).select("campaign", "feature", "level", "n", F.round("rate", 8).alias("rate"))


@query("never_bought", sql("SELECT customer_id, segment FROM cust WHERE customer_id NOT IN (SELECT customer_id FROM ps WHERE brand = 'Brand#1')"))
def _(spark, d):
    buyers = star.product_sales(spark, d).filter("brand = 'Brand#1'")
    return customers.never_bought(star.customers(spark, d).select("customer_id", "segment"), buyers)


@query("unreturned_lines", sql("SELECT year(business_day) AS year, count(*) AS lines, sum(amount) AS sales FROM all_tx WHERE transaction_type <> 'RETURN' GROUP BY 1"))
def _(spark, d):
    """Where only returns carry a type."""
    lines = star.all_transactions(spark, d).withColumn("transaction_type_id", F.when(F.col("transaction_type") == "RETURN", F.lit(metrics.RETURN_TYPE_IDS[0])))
    return metrics.not_returned(lines).groupBy(F.year("business_day").cast("long").alias("year")).agg(F.count(F.lit(1)).alias("lines"), F.sum("amount").alias("sales"))


@query("growth_tiers", sql(f"""
WITH c AS (SELECT product_id, sum(amount) AS s FROM ps WHERE {SQL_CY} GROUP BY 1), p AS (SELECT product_id, sum(amount) AS s FROM ps WHERE {SQL_PY} GROUP BY 1),
g AS (SELECT (c.s - p.s) / p.s AS g FROM c JOIN p USING (product_id)) SELECT round(quantile_cont(g, 0.33), 8) AS p33, round(quantile_cont(g, 0.66), 8) AS p66 FROM g WHERE g >= 0"""))
def _(spark, d):
    """Thirds of the SKUs that grew."""
    df = star.product_sales(spark, d)
    both = df.groupBy("product_id").agg(F.sum(F.when(cy(), F.col("amount"))).alias("c"), F.sum(F.when(py(), F.col("amount"))).alias("p")).dropna()
    grown = both.select(((F.col("c") - F.col("p")) / F.col("p")).alias("g"))
    return series.growth_tiers(grown, "g").select(F.round("p33", 8).alias("p33"), F.round("p66", 8).alias("p66"))
