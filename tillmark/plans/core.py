"""Filters, expressions, joins and sales metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from tillmark.functions import dates, exprs
from tillmark.operators import joins, metrics, ordered, sets
from tillmark.plans import star
from tillmark.plans.registry import query
from tillmark.plans.star import sql
from tillmark.session import stage


def cy():
    return dates.in_period("business_day", "2000-01-01", "2000-12-31")


def py():
    return dates.in_period("business_day", "1999-01-01", "1999-12-31")


SQL_CY = "business_day BETWEEN DATE '2000-01-01' AND DATE '2000-12-31'"
SQL_PY = "business_day BETWEEN DATE '1999-01-01' AND DATE '1999-12-31'"

KPI = """sum(amount) AS sales, sum(quantity) AS volume, sum(discount_amount) AS discount,
  count(DISTINCT transaction_id) AS transactions, count(DISTINCT customer_id) AS customers,
  count(DISTINCT product_id) AS products, sum(amount) / sum(quantity) AS avg_price,
  sum(amount) / count(DISTINCT transaction_id) AS atv, sum(amount) / count(DISTINCT customer_id) AS rpc"""


@query("valid_sales", sql("""
SELECT transaction_type, count(*) AS lines, sum(amount) AS sales, sum(quantity) AS volume FROM tx GROUP BY 1"""))
def _(spark, d):
    df = metrics.valid_sales(star.lines(spark, d))
    return df.groupBy("transaction_type").agg(
        F.count(F.lit(1)).alias("lines"), F.sum("amount").alias("sales"), F.sum("quantity").alias("volume")
    )


@query("star_join", sql("""
SELECT region, department, count(*) AS lines, sum(quantity) AS volume FROM sales GROUP BY 1, 2"""))
def _(spark, d):
    return star.sales(spark, d).groupBy("region", "department").agg(
        F.count(F.lit(1)).alias("lines"), F.sum("quantity").alias("volume")
    )


@query("kpi_by_region_segment", sql(f"""
SELECT region, segment, {KPI} FROM ss JOIN cust USING (customer_id) GROUP BY 1, 2"""))
def kpi_by_region_segment(spark, d):
    df = star.store_sales(spark, d).join(star.customers(spark, d), "customer_id")
    return metrics.kpi_summary(df, ["region", "segment"])


@query("kpi_by_hierarchy", sql(f"SELECT department, category, {KPI} FROM ps GROUP BY 1, 2"))
def _(spark, d):
    return metrics.kpi_summary(star.product_sales(spark, d), ["department", "category"])


@query("kpi_total", sql(f"SELECT {KPI} FROM tx"))
def _(spark, d):
    return metrics.kpi_summary(star.transactions(spark, d))


@query("period_labels", sql(f"""
WITH t AS (SELECT amount, business_day d FROM tx)
SELECT CAST(year(d) * 100 + month(d) AS INTEGER) AS year_month,
  year(d) || '-M' || lpad(CAST(month(d) AS VARCHAR), 2, '0') AS month_label,
  year(d) || ' Q' || quarter(d) AS quarter_label,
  isoyear(d) || '-W' || lpad(CAST(weekofyear(d) AS VARCHAR), 2, '0') AS week_label,
  dayname(d) AS day_name,
  CASE WHEN day(d) <= 10 THEN 'P1' WHEN day(d) <= 20 THEN 'P2' ELSE 'P3' END AS month_third,
  CASE WHEN day(d) <= 7 THEN 'W1' WHEN day(d) <= 14 THEN 'W2' WHEN day(d) <= 21 THEN 'W3' WHEN day(d) <= 28 THEN 'W4' ELSE 'W5' END AS month_week,
  CAST(floor(date_diff('day', DATE '1995-01-01', d) / 7.0) + 1 AS INTEGER) AS week_index,
  count(*) AS lines, sum(amount) AS sales
FROM t GROUP BY ALL"""))
def _(spark, d):
    day = "business_day"
    return star.transactions(spark, d).groupBy(
        dates.year_month(day).alias("year_month"),
        dates.month_label(day).alias("month_label"),
        dates.quarter_label(day).alias("quarter_label"),
        dates.week_label(day).alias("week_label"),
        dates.day_name(day).alias("day_name"),
        dates.month_part(day).alias("month_third"),
        dates.month_part(day, (0, 7, 14, 21, 28, 31), ("W1", "W2", "W3", "W4", "W5")).alias("month_week"),
        dates.week_index(day, "1995-01-01").alias("week_index"),
    ).agg(F.count(F.lit(1)).alias("lines"), F.sum("amount").alias("sales"))


WINDOWS = [
    ("event", "2000-03-01", "2000-03-31"),
    ("W-1", "2000-02-23", "2000-02-29"),
    ("W-2", "2000-02-16", "2000-02-22"),
    ("after", "2000-04-01", "2000-04-30"),
]


@query("named_windows", sql("""
WITH t AS (SELECT *, CASE WHEN business_day BETWEEN DATE '2000-03-01' AND DATE '2000-03-31' THEN 'event'
  WHEN business_day BETWEEN DATE '2000-02-23' AND DATE '2000-02-29' THEN 'W-1'
  WHEN business_day BETWEEN DATE '2000-02-16' AND DATE '2000-02-22' THEN 'W-2'
  WHEN business_day BETWEEN DATE '2000-04-01' AND DATE '2000-04-30' THEN 'after' END AS period FROM tx)
SELECT period, count(DISTINCT transaction_id) AS transactions, sum(amount) AS sales FROM t WHERE period IS NOT NULL GROUP BY 1"""))
def _(spark, d):
    df = star.transactions(spark, d).withColumn("period", dates.label_windows("business_day", WINDOWS))
    return df.filter(F.col("period").isNotNull()).groupBy("period").agg(
        F.countDistinct("transaction_id").alias("transactions"), F.sum("amount").alias("sales")
    )


@query("atv_buckets", sql("""
WITH r AS (SELECT transaction_id, sum(amount) / 100 AS v FROM tx GROUP BY 1)
SELECT CASE WHEN v >= 0 AND v <= 10000 THEN '0-10k' WHEN v > 10000 AND v <= 50000 THEN '10k-50k'
  WHEN v > 50000 AND v <= 100000 THEN '50k-100k' WHEN v > 100000 AND v <= 1000000 THEN '100k+' END AS bucket, count(*) AS receipts
FROM r GROUP BY 1"""))
def _(spark, d):
    r = star.transactions(spark, d).groupBy("transaction_id").agg((F.sum("amount") / 100).alias("v"))
    bucket = exprs.bucketize("v", (0, 10_000, 50_000, 100_000, 1_000_000), ("0-10k", "10k-50k", "50k-100k", "100k+"))
    return r.groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("receipts"))


@query("code_mapping", sql("""
SELECT CASE region WHEN 'AFRICA' THEN 'AFR' WHEN 'AMERICA' THEN 'AMR' WHEN 'ASIA' THEN 'ASI' WHEN 'EUROPE' THEN 'EUR' ELSE 'OTH' END AS code,
  CASE WHEN material_group LIKE '%widget' THEN 'widgets' WHEN material_group LIKE 'red%' THEN 'red goods' ELSE 'other' END AS label,
  count(*) AS lines FROM sales GROUP BY 1, 2"""))
def _(spark, d):
    code = exprs.map_values("region", {"AFRICA": "AFR", "AMERICA": "AMR", "ASIA": "ASI", "EUROPE": "EUR"}, "OTH")
    label = exprs.label_like("material_group", [("%widget", "widgets"), ("red%", "red goods")], "other")
    return star.sales(spark, d).groupBy(code.alias("code"), label.alias("label")).agg(F.count(F.lit(1)).alias("lines"))


@query("reward_points", sql("""
WITH r AS (SELECT customer_id, transaction_id, sum(amount) / 100 AS spend FROM tx GROUP BY 1, 2)
SELECT customer_id, count(*) AS receipts, sum(least(round(spend * 0.5), 3800.0)) AS points,
  sum(floor(least(round(spend * 0.5), 3800.0) / 1000) * 1000) AS whole_thousands
FROM r GROUP BY 1"""))
def _(spark, d):
    r = star.transactions(spark, d).groupBy("customer_id", "transaction_id").agg((F.sum("amount") / 100).alias("spend"))
    r = r.withColumn("p", exprs.reward_points("spend", 0.5, 3800))
    return r.groupBy("customer_id").agg(
        F.count(F.lit(1)).alias("receipts"),
        F.sum("p").alias("points"),
        F.sum(exprs.whole_multiples("p", 1000)).cast("double").alias("whole_thousands"),
    )


@query("unit_price", sql("""
SELECT brand, sum(quantity * content) AS volume, sum(amount) / sum(quantity * content) AS unit_price,
  floor(sum(amount) / sum(quantity) / 100 * 2 + 0.5) / 2 AS rounded_price FROM ps GROUP BY 1"""))
def _(spark, d):
    out = star.product_sales(spark, d).groupBy("brand").agg(
        F.sum("amount").alias("a"), F.sum("quantity").alias("q"), F.sum(exprs.volume_sold("quantity")).alias("volume")
    )
    return out.select(
        "brand",
        "volume",
        exprs.safe_div("a", "volume").alias("unit_price"),
        exprs.round_to(F.col("a") / F.col("q") / 100, 0.5).cast("double").alias("rounded_price"),
    )


@query("discount_columns", sql("""
WITH t AS (SELECT brand, sum(amount) AS net, sum(discount_amount) AS discount,
  count(*) FILTER (WHERE discount_percent > 0) AS discounted_lines, count(*) AS lines FROM ps GROUP BY 1)
SELECT brand, net, discount, discounted_lines, lines,
  greatest(least(1.0 - net / (net + discount), 1.0), 0.0) AS promo_share FROM t"""))
def _(spark, d):
    out = star.product_sales(spark, d).groupBy("brand").agg(
        F.sum("amount").alias("net"),
        F.sum("discount_amount").alias("discount"),
        F.expr("count(1) FILTER (WHERE discount_percent > 0)").alias("discounted_lines"),
        F.count(F.lit(1)).alias("lines"),
    )
    return out.withColumn("promo_share", exprs.promo_share("net", "discount"))


@query("private_label_split", sql("""
SELECT department, sum(CASE WHEN own_label = 1 THEN amount ELSE 0 END) AS pl_sales, sum(amount) AS total_sales,
  count(DISTINCT CASE WHEN own_label = 1 THEN customer_id END) AS pl_customers, count(DISTINCT customer_id) AS total_customers,
  sum(CASE WHEN own_label = 1 THEN amount ELSE 0 END) / sum(amount) AS pl_sales_share,
  count(DISTINCT CASE WHEN own_label = 1 THEN customer_id END) / count(DISTINCT customer_id) AS pl_customer_share
FROM ps GROUP BY 1"""))
def _(spark, d):
    df = star.product_sales(spark, d).withColumn("pl", exprs.private_label_flag("brand", "Brand#1"))
    return metrics.conditional_split(df, ["department"], "pl")


@query("having_filter", sql("""
SELECT material_group, sum(amount) AS sales, count(DISTINCT store_id) AS stores FROM ps GROUP BY 1
HAVING sum(amount) > (SELECT sum(amount) / count(DISTINCT material_group) FROM ps)"""))
def _(spark, d):
    agg = star.product_sales(spark, d).groupBy("material_group").agg(
        F.sum("amount").alias("sales"), F.countDistinct("store_id").alias("stores")
    )
    mean = joins.with_total(agg, [(F.sum("sales") / F.count(F.lit(1))).alias("m")])
    return mean.filter(F.col("sales") > F.col("m")).drop("m")


@query("full_compare", sql(f"""
WITH a AS (SELECT material_group, store_id, sum(amount) s, sum(quantity) q FROM ps WHERE {SQL_CY} GROUP BY 1, 2),
b AS (SELECT material_group, store_id, sum(amount) s, sum(quantity) q FROM ps WHERE {SQL_PY} GROUP BY 1, 2)
SELECT coalesce(a.material_group, b.material_group) AS material_group, coalesce(a.store_id, b.store_id) AS store_id,
  coalesce(a.s, 0) AS cy_sales, coalesce(a.q, 0) AS cy_volume, coalesce(b.s, 0) AS py_sales, coalesce(b.q, 0) AS py_volume
FROM a FULL JOIN b ON a.material_group = b.material_group AND a.store_id = b.store_id"""))
def _(spark, d):
    both = star.product_sales(spark, d).filter(cy() | py()).groupBy("material_group", "store_id", cy().alias("current")).agg(
        F.sum("amount").alias("sales"), F.sum("quantity").alias("volume")
    )
    both = stage(both)  # sums of both years from one pass
    return joins.full_compare(both.filter("current"), both.filter("NOT current"), ["material_group", "store_id"], ["sales", "volume"])


@query("exclude_lists", sql(f"""
SELECT segment, count(*) AS customers FROM cust
WHERE customer_id NOT IN (SELECT customer_id FROM tx WHERE business_day >= DATE '2001-01-01' AND customer_id IS NOT NULL)
  AND customer_id NOT IN (SELECT customer_id FROM ps WHERE department = 'PROMO' AND {SQL_CY})
GROUP BY 1"""))
def _(spark, d):
    recent = star.transactions(spark, d).filter(F.col("business_day") >= F.lit("2001-01-01").cast("date"))
    promo = star.product_sales(spark, d).filter((F.col("department") == "PROMO") & cy())
    left = joins.exclude(star.customers(spark, d), recent, promo, keys=["customer_id"])
    return left.groupBy("segment").agg(F.count(F.lit(1)).alias("customers"))


@query("compare_sets", sql(f"""
WITH a AS (SELECT DISTINCT department, product_id FROM ps WHERE {SQL_CY}), b AS (SELECT DISTINCT department, product_id FROM ps WHERE {SQL_PY}),
j AS (SELECT coalesce(a.department, b.department) AS department, a.product_id x, b.product_id y
  FROM a FULL JOIN b ON a.product_id = b.product_id AND a.department = b.department)
SELECT department, count(*) FILTER (WHERE x IS NOT NULL AND y IS NOT NULL) AS both,
  count(*) FILTER (WHERE y IS NULL) AS left_only, count(*) FILTER (WHERE x IS NULL) AS right_only FROM j GROUP BY 1"""))
def _(spark, d):
    return joins.compare_parts(star.product_sales(spark, d), cy(), py(), ["product_id"], ["department"])


@query("range_join", sql("""
WITH p AS (SELECT DISTINCT store_id, customer_id, business_day FROM tx)
SELECT a.store_id, count(*) AS pairs, CAST(sum(date_diff('day', b.business_day, a.business_day)) AS BIGINT) AS days
FROM p a JOIN p b ON a.store_id = b.store_id AND a.customer_id = b.customer_id
 AND date_diff('day', b.business_day, a.business_day) BETWEEN 1 AND 90 GROUP BY 1"""))
def _(spark, d):
    visits = star.transactions(spark, d).select("store_id", "customer_id", "business_day").distinct()
    earlier = visits.withColumnRenamed("business_day", "earlier_day")
    pairs = joins.range_join(visits, earlier, ["store_id", "customer_id"], "business_day", "earlier_day", 1, 90)
    return pairs.groupBy("store_id").agg(
        F.count(F.lit(1)).alias("pairs"), F.sum(F.datediff("business_day", "earlier_day")).alias("days")
    )


@query("lfl_calendar", sql("""
WITH t AS (SELECT region, business_day, sum(amount) s FROM ss GROUP BY 1, 2),
cal AS (SELECT CAST(DATE '2000-01-03' + CAST(i AS INTEGER) AS DATE) AS cy_date, i + 1 AS dayno FROM range(0, 182) r(i)),
g AS (SELECT region, dayno, cy_date, CAST(cy_date - 364 AS DATE) AS py_date FROM cal, (SELECT DISTINCT region FROM t))
SELECT g.region, CAST(dayno AS INTEGER) AS dayno, CAST(cy_date AS VARCHAR) AS cy_date, CAST(py_date AS VARCHAR) AS py_date,
  coalesce(a.s, 0) AS cy_amount, coalesce(b.s, 0) AS py_amount
FROM g LEFT JOIN t a ON a.region = g.region AND a.business_day = g.cy_date LEFT JOIN t b ON b.region = g.region AND b.business_day = g.py_date
WHERE a.s IS NOT NULL OR b.s IS NOT NULL"""))
def _(spark, d):
    daily = joins.lfl_daily(star.store_sales(spark, d), ["region"], "business_day", "amount", "2000-01-03", "2000-07-02")
    cal = joins.lfl_calendar("2000-01-03", "2000-07-02", spark).select("dayno", "cy_date")
    return daily.join(cal, "cy_date").select(
        "region",
        "dayno",
        F.col("cy_date").cast("string").alias("cy_date"),
        F.col("py_date").cast("string").alias("py_date"),
        "cy_amount",
        "py_amount",
    )


@query("after_first", sql("""
WITH f AS (SELECT product_id, min(business_day) AS first_day FROM tx WHERE transaction_type = 'SELL_MEDIA' GROUP BY 1)
SELECT store_id, count(*) AS lines, sum(amount) AS sales FROM tx JOIN f USING (product_id) WHERE business_day >= first_day GROUP BY 1"""))
def _(spark, d):
    tx = star.transactions(spark, d)
    first = tx.filter("transaction_type = 'SELL_MEDIA'").groupBy("product_id").agg(F.min("business_day").alias("first_day"))
    out = joins.after_first(tx, first, ["product_id"], "business_day", "first_day")
    return out.groupBy("store_id").agg(F.count(F.lit(1)).alias("lines"), F.sum("amount").alias("sales"))


@query("complete_grid", sql("""
WITH t AS (SELECT store_id, department, sum(quantity) q FROM ps GROUP BY 1, 2)
SELECT s.store_id, k.department, coalesce(q, 0) AS quantity, CAST(q IS NOT NULL AS INTEGER) AS purchase_flag
FROM (SELECT DISTINCT store_id FROM t) s CROSS JOIN (SELECT DISTINCT department FROM t) k LEFT JOIN t USING (store_id, department)"""))
def _(spark, d):
    sums = star.product_sales(spark, d).groupBy("store_id", "department").agg(F.sum("quantity").alias("quantity"))
    grid = joins.complete_grid(sums.withColumn("purchase_flag", F.lit(1)), ["store_id"], ["department"])
    return grid.na.fill(0, subset=["quantity", "purchase_flag"])


@query("densify", sql("""
WITH t AS (SELECT brand, date_trunc('month', business_day) m, sum(quantity) q FROM ps GROUP BY 1, 2),
cal AS (SELECT unnest(generate_series(DATE '1999-01-01', DATE '2000-12-01', INTERVAL 1 MONTH)) AS m)
SELECT b.brand, CAST(CAST(cal.m AS DATE) AS VARCHAR) AS month, coalesce(q, 0) AS quantity
FROM (SELECT DISTINCT brand FROM t) b CROSS JOIN cal LEFT JOIN t ON t.brand = b.brand AND t.m = cal.m"""))
def _(spark, d):
    monthly = star.product_sales(spark, d).groupBy("brand", F.trunc("business_day", "month").alias("month")).agg(
        F.sum("quantity").alias("quantity")
    )
    out = joins.densify(monthly, ["brand"], "month", "1999-01-01", "2000-12-01", ["quantity"], "1 month")
    return out.withColumn("month", F.col("month").cast("string"))


@query("resolve_hierarchy", sql("""
WITH ids(id) AS (VALUES ('LARGE'), ('widget'), ('red bolt'), ('Brand#7')),
lv AS (SELECT product_id, 'department' AS level, department AS v FROM product UNION ALL SELECT product_id, 'category', category FROM product
  UNION ALL SELECT product_id, 'material_group', material_group FROM product UNION ALL SELECT product_id, 'brand', brand FROM product)
SELECT id, level, count(DISTINCT product_id) AS products, sum(amount) AS sales
FROM ids JOIN lv ON id = v JOIN tx USING (product_id) GROUP BY 1, 2"""))
def _(spark, d):
    ids = spark.createDataFrame([("LARGE",), ("widget",), ("red bolt",), ("Brand#7",)], "id string")
    levels = [(c, c) for c in ("department", "category", "material_group", "brand")]
    meant = joins.resolve_hierarchy(ids, star.products(spark, d), "id", levels)
    return star.transactions(spark, d).join(meant, "product_id").groupBy("id", "level").agg(
        F.countDistinct("product_id").alias("products"), F.sum("amount").alias("sales")
    )


@query("union_distinct", sql(f"""
SELECT count(*) AS customers, CAST(sum(customer_id) AS BIGINT) AS id_sum FROM (
  SELECT customer_id FROM ps WHERE department = 'PROMO' AND {SQL_CY} UNION SELECT customer_id FROM ps WHERE department = 'LARGE' AND {SQL_CY}
  UNION SELECT customer_id FROM ps WHERE category = 'widget' AND {SQL_CY})"""))
def _(spark, d):
    df = star.product_sales(spark, d).filter(cy())
    parts = [df.filter(t).select("customer_id") for t in ("department = 'PROMO'", "department = 'LARGE'", "category = 'widget'")]
    return sets.union_distinct(*parts).agg(F.count(F.lit(1)).alias("customers"), F.sum("customer_id").alias("id_sum"))


@query("rollup_levels", sql("""
SELECT CASE WHEN grouping(department) = 1 THEN 'overall' ELSE department END AS department,
  CASE WHEN grouping(category) = 1 THEN 'overall' ELSE category END AS category,
  sum(amount) AS sales, count(DISTINCT transaction_id) AS transactions FROM ps GROUP BY ROLLUP (department, category)"""))
def _(spark, d):
    return metrics.rollup_distinct(star.product_sales(spark, d), ["department", "category"], {"sales": "amount"}, {"transactions": "transaction_id"})


SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]


@query("pivot_segments", sql(f"""
SELECT category, {', '.join(f"sum(CASE WHEN segment = '{s}' THEN amount ELSE 0 END) AS {s}" for s in SEGMENTS)}
FROM ps JOIN cust USING (customer_id) GROUP BY 1"""))
def _(spark, d):
    df = star.product_sales(spark, d).join(star.customers(spark, d), "customer_id")
    return metrics.pivot_metric(df, ["category"], "segment", SEGMENTS, F.sum("amount"), fill=0)


@query("pivot_counts_total", sql(f"""
SELECT CASE WHEN grouping(region) = 1 THEN 'Total' ELSE region END AS region,
  {', '.join(f"CAST(sum(CASE WHEN segment = '{s}' THEN 1 ELSE 0 END) AS BIGINT) AS {s}" for s in SEGMENTS)}
FROM ss JOIN cust USING (customer_id) GROUP BY ROLLUP (region)"""))
def _(spark, d):
    df = star.store_sales(spark, d).join(star.customers(spark, d), "customer_id")
    return metrics.pivot_counts(df, "region", "segment", SEGMENTS)


@query("transpose_quarters", sql("""
WITH q AS (SELECT department, 'Q' || quarter(business_day) AS quarter, CAST(sum(amount) AS DOUBLE) AS sales,
  CAST(sum(quantity) AS DOUBLE) AS volume, CAST(count(DISTINCT transaction_id) AS DOUBLE) AS transactions
  FROM ps WHERE year(business_day) = 2000 GROUP BY 1, 2),
l AS (UNPIVOT q ON sales, volume, transactions INTO NAME measure VALUE value)
SELECT department, measure, max(CASE WHEN quarter = 'Q1' THEN value END) AS Q1, max(CASE WHEN quarter = 'Q2' THEN value END) AS Q2,
  max(CASE WHEN quarter = 'Q3' THEN value END) AS Q3, max(CASE WHEN quarter = 'Q4' THEN value END) AS Q4 FROM l GROUP BY 1, 2"""))
def _(spark, d):
    df = star.product_sales(spark, d).filter(cy())
    q = df.groupBy("department", F.concat(F.lit("Q"), F.quarter("business_day").cast("string")).alias("quarter")).agg(
        F.sum("amount").alias("sales"), F.sum("quantity").alias("volume"), F.countDistinct("transaction_id").alias("transactions")
    )
    return metrics.transpose_periods(q, "quarter", ["Q1", "Q2", "Q3", "Q4"], ["sales", "volume", "transactions"], ["department"])


@query("exact_percentiles", sql("""
SELECT region, quantile_cont(amount, 0.25) AS p25, quantile_cont(amount, 0.5) AS p50, round(quantile_cont(amount, 0.9), 4) AS p90
FROM ss GROUP BY 1"""))
def _(spark, d):
    out = ordered.percentiles(star.store_sales(spark, d), "amount", {"p25": 0.25, "p50": 0.5, "p90": 0.9}, ["region"])
    return out.withColumn("p90", F.round("p90", 4))


@query("quantile_label", sql("""
WITH s AS (SELECT product_id, sum(amount) AS sales FROM tx GROUP BY 1),
q AS (SELECT quantile_cont(sales, 0.33) a, quantile_cont(sales, 0.66) b FROM s),
l AS (SELECT *, CASE WHEN sales <= a THEN 'Low' WHEN sales <= b THEN 'Medium' ELSE 'High' END AS band FROM s, q)
SELECT band, count(*) AS products, sum(sales) AS sales, min(sales) AS min_sales FROM l GROUP BY 1"""))
def _(spark, d):
    per = star.transactions(spark, d).groupBy("product_id").agg(F.sum("amount").alias("sales"))
    out = metrics.quantile_label(per, "sales", [0.33, 0.66], ["Low", "Medium", "High"])
    return out.groupBy("band").agg(
        F.count(F.lit(1)).alias("products"), F.sum("sales").alias("sales"), F.min("sales").alias("min_sales")
    )


@query("upper_median", sql("""
WITH s AS (SELECT store_id, product_id, sum(amount) AS sales FROM tx GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY store_id ORDER BY sales) - 1 AS i, count(*) OVER (PARTITION BY store_id) AS n FROM s)
SELECT store_id, sales AS median_sales FROM r WHERE i = n // 2"""))
def _(spark, d):
    per = star.transactions(spark, d).groupBy("store_id", "product_id").agg(F.sum("amount").alias("sales"))
    return ordered.upper_median(per, "sales", "median_sales", ["store_id"])


@query("average_rank", sql("""
WITH s AS (SELECT region, customer_id, count(*) AS n FROM ss GROUP BY 1, 2)
SELECT region, customer_id, n, rank() OVER (PARTITION BY region ORDER BY n DESC) + (count(*) OVER (PARTITION BY region, n) - 1) / 2.0 AS rank FROM s"""))
def _(spark, d):
    per = star.store_sales(spark, d).groupBy("region", "customer_id").agg(F.count(F.lit(1)).alias("n"))
    return ordered.avg_rank(per, "n", "rank", ["region"])


@query("share_of_total", sql("""
WITH s AS (SELECT region, department, sum(amount) AS sales FROM sales GROUP BY 1, 2)
SELECT region, department, sales, sales / sum(sales) OVER () AS total_share, sales / sum(sales) OVER (PARTITION BY region) AS region_share FROM s"""))
def _(spark, d):
    s = star.sales(spark, d).groupBy("region", "department").agg(F.sum("amount").alias("sales"))
    return metrics.share_of(metrics.share_of(s, "sales", name="total_share"), "sales", ["region"], "region_share")


PARETO = """
WITH s AS (SELECT customer_id, sum(amount) AS amount FROM tx GROUP BY 1),
c AS (SELECT *, row_number() OVER w AS position, sum(amount) OVER w AS run, sum(amount) OVER () AS total FROM s
  WINDOW w AS (ORDER BY amount DESC, customer_id ROWS UNBOUNDED PRECEDING))"""


@query("pareto_customers", sql(PARETO + """
SELECT customer_id, amount, position, amount / total AS share, run / total AS cum_share FROM c WHERE (run - amount) / total < 0.8"""))
def _(spark, d):
    return ordered.pareto_cut(star.transactions(spark, d), ["customer_id"], "amount", 0.8).drop("cum_before")


@query("pareto_by_department", sql("""
WITH s AS (SELECT department, brand, sum(amount) AS amount FROM ps GROUP BY 1, 2),
c AS (SELECT *, row_number() OVER w AS position, sum(amount) OVER w AS run, sum(amount) OVER (PARTITION BY department) AS total FROM s
  WINDOW w AS (PARTITION BY department ORDER BY amount DESC, brand ROWS UNBOUNDED PRECEDING))
SELECT department, brand, amount, position, amount / total AS share, run / total AS cum_share FROM c"""))
def _(spark, d):
    return ordered.pareto(star.product_sales(spark, d), ["brand"], "amount", ["department"]).drop("cum_before")


@query("rank_slice", sql("""
WITH s AS (SELECT product_id, sum(amount) AS sales FROM tx GROUP BY 1),
r AS (SELECT *, row_number() OVER (ORDER BY sales DESC, product_id) AS i FROM s)
SELECT product_id, sales FROM r WHERE i > 10 AND i <= 40"""))
def _(spark, d):
    per = star.transactions(spark, d).groupBy("product_id").agg(F.sum("amount").alias("sales"))
    return ordered.rank_slice(per, [F.col("sales").desc(), F.col("product_id")], 10, 40)


@query("fill_gaps", sql("""
WITH t AS (SELECT store_id, business_day, max(discount_percent) AS v FROM tx GROUP BY 1, 2),
u AS (SELECT store_id, business_day, CASE WHEN v >= 5 THEN v END AS v FROM t),
f AS (SELECT *, last_value(v IGNORE NULLS) OVER (PARTITION BY store_id ORDER BY business_day ROWS UNBOUNDED PRECEDING) AS a FROM u),
g AS (SELECT *, first_value(a IGNORE NULLS) OVER (PARTITION BY store_id ORDER BY business_day ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS b FROM f)
SELECT store_id, CAST(business_day AS VARCHAR) AS day, coalesce(a, b) AS v FROM g"""))
def _(spark, d):
    t = star.transactions(spark, d).groupBy("store_id", "business_day").agg(F.max("discount_percent").alias("v"))
    t = t.withColumn("v", F.when(F.col("v") >= 5, F.col("v")))
    out = ordered.ffill_bfill(t, ["store_id"], ["business_day"], ["v"])
    return out.select("store_id", F.col("business_day").cast("string").alias("day"), "v")


@query("nearest_impute", sql("""
WITH t AS (SELECT store_id, business_day, max(discount_percent) AS v FROM tx GROUP BY 1, 2),
u AS (SELECT store_id, business_day, CASE WHEN v >= 8 THEN v END AS v FROM t),
k AS (SELECT *, CASE WHEN v IS NOT NULL THEN business_day END AS kd FROM u),
p AS (SELECT *, last_value(v IGNORE NULLS) OVER a AS pv, last_value(kd IGNORE NULLS) OVER a AS pd,
  first_value(v IGNORE NULLS) OVER b AS nv, first_value(kd IGNORE NULLS) OVER b AS nd FROM k
  WINDOW a AS (PARTITION BY store_id ORDER BY business_day ROWS UNBOUNDED PRECEDING),
  b AS (PARTITION BY store_id ORDER BY business_day ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
SELECT store_id, CAST(business_day AS VARCHAR) AS day, CASE WHEN pd IS NULL THEN nv WHEN nd IS NULL THEN pv
  WHEN date_diff('day', pd, business_day) <= date_diff('day', business_day, nd) THEN pv ELSE nv END AS v FROM p"""))
def _(spark, d):
    t = star.transactions(spark, d).groupBy("store_id", "business_day").agg(F.max("discount_percent").alias("v"))
    t = t.withColumn("v", F.when(F.col("v") >= 8, F.col("v")))
    out = ordered.nearest_impute(t, ["store_id"], "business_day", "v")
    return out.select("store_id", F.col("business_day").cast("string").alias("day"), "v")
