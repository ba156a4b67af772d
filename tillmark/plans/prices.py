"""Prices, discounts, elasticities."""

from __future__ import annotations

from pyspark.sql import functions as F

from tillmark.functions import dates
from tillmark.functions.exprs import safe_div
from tillmark.operators import elasticity, joins, metrics, pricing
from tillmark.operators.models import held_out
from tillmark.plans import star
from tillmark.plans.registry import query
from tillmark.plans.star import sql

MONTH = "year(business_day) || '-M' || lpad(CAST(month(business_day) AS VARCHAR), 2, '0')"

MONTHLY = f"""
mo AS (SELECT region, brand, {MONTH} AS month, sum(amount) AS sales, sum(quantity) AS quantity, count(DISTINCT store_id) AS stores, sum(amount) / sum(quantity) AS avg_unit_price
  FROM sales GROUP BY ALL)"""


def demand_group():
    """A brand's demand group in the test tables."""
    return F.substring("brand", 1, 7)


def monthly(spark, d):
    return pricing.monthly_sales(star.sales(spark, d), ["region", "brand"])


@query("monthly_sales", sql(f"WITH {MONTHLY} SELECT * FROM mo"))
def _(spark, d):
    return monthly(spark, d)


@query("base_price_discounts", sql(f"""
WITH t AS (SELECT region, material_group, business_day, transaction_id, amount, quantity, gross_amount / quantity AS unit_price, year(business_day) * 12 + month(business_day) AS m FROM sales),
p0 AS (SELECT region, material_group, m, unit_price, count(DISTINCT transaction_id) n, min(business_day) f FROM t GROUP BY ALL),
p AS (SELECT region, material_group, m, floor(unit_price / 5000.0 + 0.5) * 5000.0 AS price, sum(n) n, min(f) f FROM p0 GROUP BY ALL),
s AS (SELECT region, material_group, m, sum(amount) AS sales, sum(quantity) AS quantity, min(business_day) f FROM t GROUP BY ALL),
h AS (SELECT s.region, s.material_group, s.m, p.price, sum(p.n) n FROM s JOIN p ON s.region = p.region AND s.material_group = p.material_group AND date_diff('day', p.f, s.f) BETWEEN 0 AND 90 GROUP BY ALL),
c AS (SELECT *, sum(n) OVER (PARTITION BY region, material_group, m ORDER BY price ROWS UNBOUNDED PRECEDING) AS cn, sum(n) OVER (PARTITION BY region, material_group, m) AS tn FROM h),
b AS (SELECT region, material_group, m, min(price) AS base_price FROM c WHERE cn * 2 >= tn GROUP BY 1, 2, 3),
j AS (SELECT s.region, s.material_group, year(s.f) || '-M' || lpad(CAST(month(s.f) AS VARCHAR), 2, '0') AS month, sales, quantity, sales / quantity AS avg_price, base_price,
  (base_price - sales / quantity) / nullif(base_price, 0) AS gap FROM s JOIN b USING (region, material_group, m)),
k AS (SELECT *, CAST(coalesce(-gap >= 0.1, false) AS INTEGER) AS price_increase_flag, CAST(coalesce(gap >= 0.03, false) AS INTEGER) AS discount_flag, CASE WHEN gap >= 0.03 THEN (base_price - avg_price) * quantity ELSE 0 END AS discount_amount FROM j),
z AS (SELECT * EXCLUDE (gap), round(discount_amount / sales, 4) AS discount_perc FROM k)
SELECT * REPLACE (round(discount_amount, 2) AS discount_amount), CASE WHEN discount_perc <= 0 THEN 'No discount' WHEN discount_perc <= 0.05 THEN '<5%' WHEN discount_perc <= 0.1 THEN '5-10%' WHEN discount_perc <= 0.2 THEN '10-20%' ELSE '>20%' END AS discount_band FROM z"""))
def _(spark, d):
    tx = star.sales(spark, d).withColumn("unit_price", F.col("gross_amount") / F.col("quantity"))
    out = pricing.base_price_discounts(tx, ["region", "material_group"], step=5000.0)
    return out.withColumn("discount_amount", F.round("discount_amount", 2))


@query("price_ratios", sql(f"""
WITH {MONTHLY}, g AS (SELECT substr(brand, 1, 7) AS demand_group, * FROM mo)
SELECT a.*, b.brand AS reference, a.avg_unit_price / b.avg_unit_price AS price_ratio FROM g a JOIN mo b USING (region, month)"""))
def _(spark, d):
    """Every brand against every brand of its region and month, those of other demand groups included."""
    rows = monthly(spark, d).withColumn("demand_group", demand_group())
    return pricing.price_ratios(rows, "brand", "month", ["region"])


@query("complement_price", sql(f"""
WITH {MONTHLY}, c AS (SELECT *, (sum(sales) OVER w - sales) / nullif(sum(quantity) OVER w - quantity, 0) AS comp_price FROM mo WINDOW w AS (PARTITION BY region, month))
SELECT *, avg_unit_price / comp_price AS price_ratio_comp FROM c"""))
def _(spark, d):
    return pricing.complement_price(monthly(spark, d), "month", ["region"])


@query("launch_index", sql(f"""
WITH c AS (SELECT material_group, store_id, year(business_day) * 12 + month(business_day) AS m, min(business_day) f FROM ps GROUP BY ALL),
n AS (SELECT *, CAST(m = min(m) OVER (PARTITION BY material_group, store_id) AS INTEGER) AS nw FROM c),
g AS (SELECT material_group, {MONTH.replace('business_day', 'min(f)')} AS month, count(*) AS stores, CAST(sum(nw) AS BIGINT) AS new_stores FROM n GROUP BY material_group, m)
SELECT *, CASE WHEN round(new_stores / stores, 4) >= 0.1 AND month <> '1995-M01' THEN round(new_stores / stores, 4) ELSE 0.0 END AS new_launch_idx FROM g"""))
def _(spark, d):
    return pricing.launch_index(star.product_sales(spark, d), ["material_group"], first_month="1995-M01")


EVENT_CTE = """
ed AS (SELECT o_orderpriority AS event_theme, CAST(unnest(generate_series(CAST(o_orderdate AS DATE), CAST(o_orderdate AS DATE) + CAST(o_orderkey % 5 AS INTEGER), INTERVAL 1 DAY)) AS DATE) AS event_date
  FROM orders)"""
EVENT_MONTH = MONTH.replace("business_day", "event_date")


def events(spark, d):
    o = star.table(spark, d, "orders")
    start = F.col("o_orderdate").cast("date")
    days = o.select(
        F.col("o_orderpriority").alias("event_theme"),
        start.alias("start_date"),
        F.date_add(start, (F.col("o_orderkey") % 5).cast("int")).alias("end_date"),
    )
    return pricing.event_days(days)


@query("event_index", sql(f"""
WITH {EVENT_CTE}, t AS (SELECT {EVENT_MONTH} AS month, event_theme, count(DISTINCT event_date) d FROM ed GROUP BY 1, 2),
m AS (SELECT month, count(*) AS num_events, CAST(sum(d) AS BIGINT) AS event_days, max(d) AS longest_event FROM t GROUP BY 1), a AS (SELECT avg(num_events) x, avg(event_days) y, avg(longest_event) z FROM m)
SELECT m.*, round(num_events / x * 0.45 + event_days / y * 0.45 + longest_event / z * 0.10, 3) AS event_presence_idx FROM m, a"""))
def _(spark, d):
    return pricing.event_index(events(spark, d))


THEMES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


# columns need names in SQL; the query takes the themes from the events
@query("event_features", sql(f"""
WITH {EVENT_CTE} SELECT {EVENT_MONTH} AS month, {', '.join(f'''count(DISTINCT CASE WHEN event_theme = '{t}' THEN event_date END) AS "ev_{t}"''' for t in THEMES)} FROM ed GROUP BY 1"""))
def _(spark, d):
    return pricing.event_features(events(spark, d))


WEATHER = """
w AS (SELECT region, business_day AS date, avg(discount_percent) AS temp, CAST(count(*) AS DOUBLE) AS rainfall FROM ss GROUP BY 1, 2),
wm AS (SELECT region, year(date) || '-M' || lpad(CAST(month(date) AS VARCHAR), 2, '0') AS month, avg(temp) AS avg_temp, sum(rainfall) AS total_rainfall FROM w GROUP BY 1, 2)"""


@query("monthly_weather", sql(f"""
WITH {WEATHER} SELECT region, month, round(avg_temp, 6) AS avg_temp, total_rainfall, round((avg_temp - min(avg_temp) OVER v) / (max(avg_temp) OVER v - min(avg_temp) OVER v), 6) AS avg_temp_norm,
  (total_rainfall - min(total_rainfall) OVER v) / (max(total_rainfall) OVER v - min(total_rainfall) OVER v) AS total_rainfall_norm FROM wm WINDOW v AS (PARTITION BY region)"""))
def _(spark, d):
    daily = star.store_sales(spark, d).groupBy("region", F.col("business_day").alias("date")).agg(
        F.avg("discount_percent").alias("temp"), F.count(F.lit(1)).cast("double").alias("rainfall")
    )
    out = pricing.monthly_weather(daily, ["region"])
    return out.withColumn("avg_temp", F.round("avg_temp", 6)).withColumn("avg_temp_norm", F.round("avg_temp_norm", 6))


@query("l12_metrics", sql("""
WITH p AS (SELECT region, brand, date_trunc('week', business_day) w, sum(amount) s, sum(quantity) q, sum(discount_amount) d, sum(CASE WHEN discount_amount > 0 THEN quantity ELSE 0 END) dq
  FROM sales WHERE business_day BETWEEN DATE '2000-08-02' AND DATE '2001-08-01' GROUP BY ALL)
SELECT region, brand, sum(s) / sum(q) AS avg_unit_price_l12, avg(q) AS avg_qty_l12, sum(d) / sum(q) AS unit_discount_overall, coalesce(sum(d) / nullif(sum(dq), 0), 0) AS unit_discount_conditional FROM p GROUP BY 1, 2"""))
def _(spark, d):
    df = star.sales(spark, d).filter(dates.in_period("business_day", "2000-08-02", "2001-08-01"))
    return pricing.l12_metrics(df.withColumn("week", F.date_trunc("week", "business_day")), ["region", "brand"], "week")


@query("quartile_ordinal", sql("""
WITH p AS (SELECT category, product_id, round(sum(amount) / sum(quantity)) AS price, max(content) AS content FROM ps GROUP BY 1, 2),
s AS (SELECT category, count(DISTINCT price) u, min(price) lo, quantile_cont(price, 0.25) a, quantile_cont(price, 0.5) b, quantile_cont(price, 0.75) c FROM p GROUP BY 1)
SELECT category, product_id, CAST(1 + CASE WHEN price > a THEN 1 ELSE 0 END + CASE WHEN price > b THEN 1 ELSE 0 END + CASE WHEN price > c THEN 1 ELSE 0 END AS INTEGER) AS price_ordinal,
  dense_rank() OVER (PARTITION BY category ORDER BY content) AS content_ordinal FROM p JOIN s USING (category)"""))
def _(spark, d):
    p = star.product_sales(spark, d).groupBy("category", "product_id").agg(
        F.round(safe_div(F.sum("amount"), F.sum("quantity"))).alias("price"), F.max("content").alias("content")
    )
    out = pricing.dense_ordinal(pricing.quartile_ordinal(p, "price", ["category"]), "content", ["category"])
    return out.select("category", "product_id", "price_ordinal", "content_ordinal")


@query("price_band", sql("""
WITH s AS (SELECT category, CAST(quantile_disc(floor(p_retailprice), 0.2) AS INTEGER) a, CAST(quantile_disc(floor(p_retailprice), 0.6) AS INTEGER) b FROM part JOIN product ON p_partkey = product_id GROUP BY 1)
SELECT category, product_id, CASE WHEN p <= a THEN a || '&Below' WHEN p >= a + 1 AND p < b + 1 THEN (a + 1) || '-' || b WHEN p >= b + 1 THEN (b + 1) || '&Above' END AS price_band
FROM (SELECT category, product_id, floor(p_retailprice) p FROM part JOIN product ON p_partkey = product_id) JOIN s USING (category)"""))
def _(spark, d):
    items = star.table(spark, d, "part").select(
        F.col("p_partkey").alias("product_id"), F.split("p_name", " ")[1].alias("category"), F.floor("p_retailprice").cast("double").alias("price")
    )
    cuts = items.groupBy("category").agg(
        F.expr("percentile_disc(0.2) WITHIN GROUP (ORDER BY price)").cast("int").alias("a"),
        F.expr("percentile_disc(0.6) WITHIN GROUP (ORDER BY price)").cast("int").alias("b"),
    )
    text = lambda *parts: F.concat(*[p.cast("string") for p in parts])
    slabs = cuts.select(
        "category",
        text(F.lit("0 - "), F.col("a")).alias("slab_1"),
        text(F.col("a"), F.lit("-"), F.col("b")).alias("slab_2"),
        text(F.col("b") + 1, F.lit("&Above")).alias("slab_3"),
    )
    cols = ["slab_1", "slab_2", "slab_3"]
    out = pricing.price_band(items, pricing.normalize_slabs(slabs, cols), ["category"], "price", cols)
    return out.select("category", "product_id", "price_band")


LOGLOG = f"""{MONTHLY},
el AS (SELECT region, brand, count(*) AS n, regr_slope(ln(quantity), ln(avg_unit_price)) AS slope, regr_intercept(ln(quantity), ln(avg_unit_price)) AS intercept,
  regr_r2(ln(quantity), ln(avg_unit_price)) AS r2, regr_syy(ln(quantity), ln(avg_unit_price)) AS syy FROM mo GROUP BY 1, 2 HAVING count(*) >= 3)"""


def fitted(spark, d, form="loglog"):
    return elasticity.fit_elasticity(monthly(spark, d), ["region", "brand"], "avg_unit_price", "quantity", form)


@query("fit_elasticity_loglog", sql(f"""
WITH {LOGLOG} SELECT region, brand, n, round(slope, 6) AS slope, round(intercept, 6) AS intercept, round(r2, 6) AS r2, round(sqrt(greatest(syy * (1 - r2) / n, 0)), 6) AS rmse, round(slope, 6) AS elasticity FROM el"""))
def _(spark, d):
    out = fitted(spark, d)
    return out.select("region", "brand", "n", *[F.round(c, 6).alias(c) for c in ("slope", "intercept", "r2", "rmse", "elasticity")])


@query("fit_elasticity_linear", sql(f"""
WITH {MONTHLY}, f AS (SELECT region, brand, count(*) AS n, regr_slope(quantity, avg_unit_price) AS s, regr_intercept(quantity, avg_unit_price) AS i, regr_r2(quantity, avg_unit_price) AS r2 FROM mo GROUP BY 1, 2 HAVING count(*) >= 3),
e AS (SELECT region, brand, avg(s * avg_unit_price / (i + s * avg_unit_price)) e FROM mo JOIN f USING (region, brand) GROUP BY 1, 2)
SELECT region, brand, n, round(r2, 6) AS r2, round(e, 5) AS elasticity FROM f JOIN e USING (region, brand)"""))
def _(spark, d):
    return fitted(spark, d, "linear").select("region", "brand", "n", F.round("r2", 6).alias("r2"), F.round("elasticity", 5).alias("elasticity"))


@query("linear_held_out", sql(f"""
WITH {MONTHLY}, s AS (SELECT *, CAST('0x' || substr(md5('42|' || region || '|' || brand || '|' || month), 1, 8) AS BIGINT) % 10 >= 8 AS test FROM mo),
f AS (SELECT region, brand, count(*) FILTER (NOT test) AS n_train, regr_slope(quantity, avg_unit_price) FILTER (NOT test) AS b, regr_intercept(quantity, avg_unit_price) FILTER (NOT test) AS a,
  regr_r2(quantity, avg_unit_price) FILTER (NOT test) AS r2 FROM s GROUP BY 1, 2 HAVING count(*) FILTER (NOT test) >= 3),
t AS (SELECT region, brand, count(*) AS n_test, sum((quantity - a - b * avg_unit_price) ** 2) AS sse, var_pop(quantity) * count(*) AS sst FROM s JOIN f USING (region, brand) WHERE test GROUP BY 1, 2)
SELECT region, brand, n_train, coalesce(n_test, 0) AS n_test, round(r2, 6) AS r2_train, round(1 - sse / nullif(sst, 0), 5) AS r2_test, round(sqrt(sse / n_test), 4) AS rmse_test FROM f LEFT JOIN t USING (region, brand) WHERE b IS NOT NULL"""))
def _(spark, d):
    test = held_out("region", "brand", "month", tenths=2, seed=42)
    out = elasticity.held_out_fit(monthly(spark, d), ["region", "brand"], "avg_unit_price", "quantity", test)
    return out.select("region", "brand", "n_train", "n_test", F.round("r2_train", 6).alias("r2_train"), F.round("r2_test", 5).alias("r2_test"), F.round("rmse_test", 4).alias("rmse_test"))


@query("fit_several_predictors", sql(f"""
WITH {MONTHLY}, c AS (SELECT region, count(*) n, avg(ln(quantity)) my, avg(ln(avg_unit_price)) mx, avg(stores) mz, covar_pop(ln(avg_unit_price), ln(avg_unit_price)) xx, covar_pop(stores, stores) zz,
  covar_pop(ln(avg_unit_price), stores) xz, covar_pop(ln(quantity), ln(avg_unit_price)) xy, covar_pop(ln(quantity), stores) zy, var_pop(ln(quantity)) yy FROM mo GROUP BY 1),
b AS (SELECT *, (xy * zz - zy * xz) / (xx * zz - xz * xz) AS b1, (zy * xx - xy * xz) / (xx * zz - xz * xz) AS b2 FROM c WHERE zz > 0)
SELECT region, n, round(my - b1 * mx - b2 * mz, 4) AS intercept, round(b1, 4) AS price_beta, round(b2, 4) AS stores_beta, round((b1 * xy + b2 * zy) / yy, 5) AS r2 FROM b"""))
def _(spark, d):
    rows = monthly(spark, d).select("region", F.ln("avg_unit_price").alias("x"), F.col("stores").cast("double").alias("z"), F.ln("quantity").alias("y"))
    # a region whose brands never sell in more than one store at a time has no store effect to estimate
    varied = joins.with_group(rows, ["region"], [(F.max("z") > F.min("z")).alias("varies")]).filter("varies")
    out = elasticity.fit_ols(varied, ["region"], ["x", "z"], "y")
    b = F.col("coefficients")
    return out.select(
        "region", "n", F.round(b[0], 4).alias("intercept"), F.round(b[1], 4).alias("price_beta"), F.round(b[2], 4).alias("stores_beta"), F.round("r2", 5).alias("r2")
    )


MODELS = f"""{MONTHLY}, md AS (
SELECT 'loglog' AS model, region, brand, substr(brand, 1, 7) AS demand_group, round(regr_r2(ln(quantity), ln(avg_unit_price)), 9) AS r2, round(regr_slope(ln(quantity), ln(avg_unit_price)), 9) AS elasticity FROM mo GROUP BY region, brand
UNION ALL SELECT 'stores', region, brand, substr(brand, 1, 7), round(regr_r2(ln(quantity), ln(stores)), 9), round(-regr_slope(ln(quantity), ln(stores)), 9) FROM mo GROUP BY region, brand)"""


def models(spark, d):
    from tillmark.session import stage

    mo = stage(monthly(spark, d))
    group = F.substring("brand", 1, 7).alias("demand_group")
    a = elasticity.fit_elasticity(mo, ["region", "brand"], "avg_unit_price", "quantity", min_rows=1)
    b = elasticity.fit_elasticity(mo, ["region", "brand"], "stores", "quantity", min_rows=1)
    rows = lambda df, name, sign: df.select(
        F.lit(name).alias("model"), "region", "brand", group, F.round("r2", 9).alias("r2"), F.round(F.col("elasticity") * sign, 9).alias("elasticity")
    )
    return rows(a, "loglog", 1).unionByName(rows(b, "stores", -1))


@query("select_models", sql(f"""
WITH {MODELS}, g AS (SELECT demand_group, region, model, count(*) AS skus, avg(r2) AS avg_r2, avg(elasticity) AS avg_elasticity FROM md WHERE r2 >= 0.1 AND elasticity < 0 GROUP BY ALL)
SELECT demand_group, region, model AS best_model, skus, round(avg_r2, 6) AS avg_r2, round(avg_elasticity, 6) AS avg_elasticity FROM (
  SELECT *, row_number() OVER (PARTITION BY demand_group, region ORDER BY skus DESC, round(avg_r2, 9) DESC, model DESC) k FROM g) WHERE k = 1"""))
def _(spark, d):
    out = elasticity.select_models(models(spark, d), ["demand_group", "region"], r2=0.1)
    return out.withColumn("avg_r2", F.round("avg_r2", 6)).withColumn("avg_elasticity", F.round("avg_elasticity", 6))


@query("quality_matrix", sql(f"""
WITH {MODELS} SELECT demand_group, region, count(DISTINCT brand) AS total_skus, count(DISTINCT CASE WHEN r2 >= 0.1 AND elasticity < 0 THEN brand END) AS good_fit_good_sign,
  count(DISTINCT CASE WHEN r2 >= 0.1 AND elasticity >= 0 THEN brand END) AS good_fit_bad_sign, count(DISTINCT CASE WHEN r2 < 0.1 AND elasticity < 0 THEN brand END) AS bad_fit_good_sign,
  count(DISTINCT CASE WHEN r2 < 0.1 AND elasticity >= 0 THEN brand END) AS bad_fit_bad_sign FROM md WHERE model = 'loglog' GROUP BY 1, 2"""))
def _(spark, d):
    return elasticity.quality_matrix(models(spark, d).filter("model = 'loglog'"), ["demand_group", "region"], "brand", 0.1)


#: The pooled SKU of a demand group and region: its SKUs without an acceptable model.
POOLED = f"""{MONTHLY}, ok AS (SELECT region, brand FROM mo GROUP BY 1, 2 HAVING round(regr_r2(ln(quantity), ln(avg_unit_price)), 9) >= 0.1 AND round(regr_slope(ln(quantity), ln(avg_unit_price)), 9) < 0),
po AS (SELECT region, substr(brand, 1, 7) AS demand_group, month, sum(quantity) AS quantity, sum(sales) AS sales, avg(stores) AS stores, round(sum(sales) / sum(quantity), 2) AS avg_unit_price FROM mo ANTI JOIN ok USING (region, brand) GROUP BY ALL)"""


def pooled(spark, d):
    from tillmark.session import stage

    panel = stage(monthly(spark, d))
    fit = elasticity.fit_elasticity(panel, ["region", "brand"], "avg_unit_price", "quantity", min_rows=1)
    fit = fit.withColumn("r2", F.round("r2", 9)).withColumn("elasticity", F.round("elasticity", 9))
    weak = pricing.without_model(panel, fit.filter(elasticity.acceptable(0.1) == 1), ["region", "brand"])
    return pricing.pool_skus(weak.withColumn("demand_group", demand_group()), "month", ["region", "demand_group"], ["stores"])


@query("pool_skus", sql(f"""
WITH {POOLED},
l AS (SELECT *, lag(quantity, 1) OVER w a, lag(quantity, 2) OVER w b, CASE WHEN count(*) OVER w2 = 2 THEN avg(avg_unit_price) OVER w2 END m2, CASE WHEN count(*) OVER w4 = 4 THEN avg(avg_unit_price) OVER w4 END m4 FROM po
  WINDOW w AS (PARTITION BY region, demand_group ORDER BY month), w2 AS (PARTITION BY region, demand_group ORDER BY month ROWS 1 PRECEDING), w4 AS (PARTITION BY region, demand_group ORDER BY month ROWS 3 PRECEDING))
SELECT region, demand_group, month, quantity, sales, stores, avg_unit_price, round(coalesce(a, avg(a) OVER r), 6) AS quantity_lag1, round(coalesce(b, avg(b) OVER r), 6) AS quantity_lag2,
  coalesce(round(avg_unit_price / m2, 2), 1.0) AS price_ratio_ma2, coalesce(round(avg_unit_price / m4, 2), 1.0) AS price_ratio_ma4 FROM l WINDOW r AS (PARTITION BY region, demand_group)"""))
def _(spark, d):
    out = pooled(spark, d)
    return out.withColumn("quantity_lag1", F.round("quantity_lag1", 6)).withColumn("quantity_lag2", F.round("quantity_lag2", 6))


@query("pooled_elasticity", sql(f"""
WITH {POOLED} SELECT region, demand_group, count(*) AS n, round(regr_slope(ln(quantity), ln(avg_unit_price)), 6) AS elasticity, round(regr_r2(ln(quantity), ln(avg_unit_price)), 6) AS r2
FROM po GROUP BY 1, 2 HAVING count(*) >= 3 AND regr_slope(ln(quantity), ln(avg_unit_price)) IS NOT NULL"""))
def _(spark, d):
    out = elasticity.fit_elasticity(pooled(spark, d), ["region", "demand_group"], "avg_unit_price", "quantity")
    return out.select("region", "demand_group", "n", F.round("elasticity", 6).alias("elasticity"), F.round("r2", 6).alias("r2"))


IMPUTE = f"""{MONTHLY},
fe AS (SELECT region, brand, round(regr_slope(ln(quantity), ln(avg_unit_price)), 9) AS elasticity, sum(sales) / sum(quantity) AS price FROM mo GROUP BY 1, 2 HAVING count(DISTINCT avg_unit_price) > 1),
qt AS (SELECT region, quantile_cont(price, 0.25) a, quantile_cont(price, 0.5) b, quantile_cont(price, 0.75) c FROM fe GROUP BY 1),
br AS (SELECT brand, CAST(max(content) AS BIGINT) % 7 AS ct, mode_attr AS at1, count(*) % 3 AS at2 FROM (SELECT *, length(brand) AS mode_attr FROM product) GROUP BY brand, mode_attr),
sk AS (SELECT fe.*, CAST(CAST(split_part(brand, '#', 2) AS INTEGER) % 3 > 0 AS INTEGER) AS acceptable, 1 + (price > a)::INT + (price > b)::INT + (price > c)::INT AS po, dense_rank() OVER (PARTITION BY region ORDER BY ct) AS co, at1, at2
  FROM fe JOIN qt USING (region) JOIN br USING (brand)),
co AS (SELECT x.region, x.brand AS b0, y.brand AS b1, CASE WHEN count(DISTINCT x.quantity) >= 2 AND count(DISTINCT y.quantity) >= 2 THEN 1 - corr(x.quantity, y.quantity) END AS d2 FROM mo x JOIN mo y USING (region, month)
  WHERE CAST(split_part(x.brand, '#', 2) AS INTEGER) % 3 = 0 AND CAST(split_part(y.brand, '#', 2) AS INTEGER) % 3 > 0 GROUP BY 1, 2, 3),
pr AS (SELECT u.region, u.brand AS b0, m.brand AS b1, m.elasticity, 0.2 * abs(u.co - m.co) + 0.8 * abs(u.po - m.po) AS d1, d2, 1 - ((u.at1 = m.at1)::INT + (u.at2 = m.at2)::INT) / 2 AS d3
  FROM sk u JOIN sk m ON u.region = m.region AND u.acceptable = 0 AND m.acceptable = 1 LEFT JOIN co ON co.region = u.region AND co.b0 = u.brand AND co.b1 = m.brand),
nm AS (SELECT region, b0, b1, elasticity, (d1 - min(d1) OVER w) / nullif(max(d1) OVER w - min(d1) OVER w, 0) n1, (d2 - min(d2) OVER w) / nullif(max(d2) OVER w - min(d2) OVER w, 0) n2,
  (d3 - min(d3) OVER w) / nullif(max(d3) OVER w - min(d3) OVER w, 0) n3 FROM pr WINDOW w AS (PARTITION BY region)),
av AS (SELECT *, round((coalesce(n1, 0) + coalesce(n2, 0) + coalesce(n3, 0)) / nullif((n1 IS NOT NULL)::INT + (n2 IS NOT NULL)::INT + (n3 IS NOT NULL)::INT, 0), 9) AS dist FROM nm),
rk AS (SELECT *, row_number() OVER (PARTITION BY region, b0 ORDER BY dist, b1) k FROM av WHERE dist IS NOT NULL)"""


@query("impute_elasticity", sql(f"""
WITH {IMPUTE}, sh AS (SELECT region, avg(acceptable) s FROM sk GROUP BY 1)
SELECT region, b0 AS brand, max(CASE WHEN k = 1 THEN b1 END) AS nearest_sku, max(CASE WHEN k = 1 THEN elasticity END) AS elasticity_nearest, round(avg(elasticity), 6) AS elasticity_top3,
  CASE WHEN max(s) >= 0.77 THEN 'case 1' WHEN max(s) >= 0.36 THEN 'case 2' ELSE 'case 3' END AS "case" FROM rk JOIN sh USING (region) WHERE k <= 3 GROUP BY 1, 2"""))
def _(spark, d):
    from tillmark.session import stage

    mo = stage(monthly(spark, d))
    fit = elasticity.fit_elasticity(mo, ["region", "brand"], "avg_unit_price", "quantity", min_rows=1).select("region", "brand", F.round("elasticity", 9).alias("elasticity"))
    skus = described(spark, d, mo, fit).withColumn("acceptable", (F.split("brand", "#")[1].cast("int") % 3 > 0).cast("int"))
    out = elasticity.impute_elasticity(skus, ["region"], "brand")
    return out.withColumn("elasticity_top3", F.round("elasticity_top3", 6))


def described(spark, d, mo, fit):
    """The SKUs of ``fit`` with what makes them alike: ordinals of price and content, attributes, and quantities by month."""
    price = mo.groupBy("region", "brand").agg(safe_div(F.sum("sales"), F.sum("quantity")).alias("price"))
    attrs = star.products(spark, d).groupBy("brand").agg(
        (F.max("content").cast("long") % 7).alias("content"),
        F.array(F.length("brand").cast("string"), (F.count(F.lit(1)) % 3).cast("string")).alias("attributes"),
    )
    number_of = (F.substring("month", 1, 4).cast("int") * 12 + F.substring("month", 7, 2).cast("int")).alias("k")
    span = mo.select(number_of).agg(F.min("k").alias("lo"), F.max("k").alias("hi"))
    # a (region, brand) has one entry per month of the data
    cells = mo.groupBy("region", "brand").agg(F.map_from_entries(F.collect_list(F.struct(number_of, "quantity"))).alias("__c"))
    series = F.transform(F.sequence("lo", "hi"), lambda i: F.col("__c")[i])
    cells = cells.crossJoin(F.broadcast(span))
    skus = joins.join_keys(price, fit, ["region", "brand"], "inner").join(attrs, "brand")
    skus = joins.join_keys(skus, cells.select("region", "brand", series.alias("series")), ["region", "brand"])
    return pricing.dense_ordinal(pricing.quartile_ordinal(skus, "price", ["region"]), "content", ["region"])


PROMO = f"""
mo AS (SELECT region, brand, {MONTH} AS month, sum(amount) AS sales, sum(quantity) AS quantity, sum(amount) / sum(quantity) AS avg_unit_price, sum(discount_amount) / sum(gross_amount) AS discount_share
  FROM sales GROUP BY ALL),
cm AS (SELECT region, brand, count(*) n, avg(avg_unit_price) mp, avg(discount_share) md, avg(quantity) mq, var_pop(avg_unit_price) pp, var_pop(discount_share) dd, var_pop(quantity) qq,
  covar_pop(avg_unit_price, discount_share) pd, covar_pop(quantity, avg_unit_price) qp, covar_pop(quantity, discount_share) qd FROM mo GROUP BY 1, 2),
cb AS (SELECT *, (qp * dd - qd * pd) / (pp * dd - pd * pd) AS bp, (qd * pp - qp * pd) / (pp * dd - pd * pd) AS bd FROM cm WHERE n >= 4 AND pp * dd - pd * pd > 1e-9 * pp * dd),
fi AS (SELECT region, brand, n, mq - bp * mp - bd * md AS b0, bp, bd, round((bp * qp + bd * qd) / nullif(qq, 0), 6) AS r2 FROM cb),
ra AS (SELECT *, lag(discount_share) OVER (PARTITION BY region, brand ORDER BY month) AS was FROM mo WHERE discount_share <> 0),
ro AS (SELECT * FROM ra WHERE was IS NULL OR was <> discount_share),
me AS (SELECT region, brand, avg(avg_unit_price) AS m, count(DISTINCT discount_share) AS u FROM ro GROUP BY 1, 2),
pe AS (SELECT region, brand, round(avg(bd * x / nullif(b0 + bd * x + bp * m, 0)), 3) AS promo_elasticity FROM (SELECT DISTINCT region, brand, discount_share AS x FROM ro) JOIN me USING (region, brand) JOIN fi USING (region, brand) WHERE u >= 5 GROUP BY 1, 2),
mf AS (SELECT region, brand, avg(discount_share) AS m FROM mo GROUP BY 1, 2),
pf AS (SELECT region, brand, round(avg(bp * x / nullif(b0 + bp * x + bd * m, 0)), 3) AS price_elasticity FROM (SELECT DISTINCT region, brand, avg_unit_price AS x FROM mo) JOIN mf USING (region, brand) JOIN fi USING (region, brand) GROUP BY 1, 2),
el AS (SELECT region, brand, n, r2, price_elasticity, promo_elasticity FROM fi JOIN pf USING (region, brand) LEFT JOIN pe USING (region, brand))"""


def price_and_promo(spark, d):
    """The monthly panel with discount shares, and per (region, brand) the two-predictor model with both elasticities."""
    from tillmark.session import stage

    keys = ["region", "brand"]
    panel = stage(pricing.monthly_sales(star.sales(spark, d), keys, discount="discount_amount", gross="gross_amount"))
    fit = stage(elasticity.fit_price_promo(panel, keys, "avg_unit_price", "discount_share", "quantity"))
    price = elasticity.response_elasticity(panel, fit, keys, "avg_unit_price", "discount_share", ("price_beta", "promo_beta"), "price_elasticity")
    promo = elasticity.promo_elasticity(panel, fit, keys, "month", "avg_unit_price", "discount_share")
    out = joins.join_keys(joins.join_keys(fit, price, keys, "inner"), promo, keys)
    return panel, out.select(*keys, "n", F.round("r2", 6).alias("r2"), F.round("price_elasticity", 3).alias("price_elasticity"), F.round("promo_elasticity", 3).alias("promo_elasticity"))


@query("promo_elasticity", sql(f"WITH {PROMO} SELECT * FROM el"))
def _(spark, d):
    return price_and_promo(spark, d)[1]


def _nearest(p: str, flag: str, value: str) -> str:
    """CTE ``{p}i``: per SKU whose ``flag`` is 0 the value of the nearest SKU whose flag is 1, and the mean of the nearest three."""
    scaled = ", ".join(f"(d{k} - min(d{k}) OVER w) / nullif(max(d{k}) OVER w - min(d{k}) OVER w, 0) n{k}" for k in (1, 2, 3))
    return f"""
{p}c AS (SELECT x.region, x.brand AS b0, y.brand AS b1, CASE WHEN count(DISTINCT x.quantity) >= 2 AND count(DISTINCT y.quantity) >= 2 THEN 1 - corr(x.quantity, y.quantity) END AS d2
  FROM mo x JOIN mo y USING (region, month) JOIN sk u ON u.region = x.region AND u.brand = x.brand AND u.{flag} = 0 JOIN sk m ON m.region = y.region AND m.brand = y.brand AND m.{flag} = 1 GROUP BY 1, 2, 3),
{p}p AS (SELECT u.region, u.brand AS b0, m.brand AS b1, m.{value} AS e, 0.2 * abs(u.co - m.co) + 0.8 * abs(u.po - m.po) AS d1, d2, 1 - ((u.at1 = m.at1)::INT + (u.at2 = m.at2)::INT) / 2 AS d3
  FROM sk u JOIN sk m ON u.region = m.region AND u.{flag} = 0 AND m.{flag} = 1 LEFT JOIN {p}c c ON c.region = u.region AND c.b0 = u.brand AND c.b1 = m.brand),
{p}n AS (SELECT region, b0, b1, e, {scaled} FROM {p}p WINDOW w AS (PARTITION BY region)),
{p}a AS (SELECT *, round((coalesce(n1, 0) + coalesce(n2, 0) + coalesce(n3, 0)) / nullif((n1 IS NOT NULL)::INT + (n2 IS NOT NULL)::INT + (n3 IS NOT NULL)::INT, 0), 9) AS dist FROM {p}n),
{p}r AS (SELECT *, row_number() OVER (PARTITION BY region, b0 ORDER BY dist, b1) k FROM {p}a WHERE dist IS NOT NULL),
{p}i AS (SELECT region, b0 AS brand, max(CASE WHEN k = 1 THEN e END) AS top_1, avg(e) AS top_3 FROM {p}r WHERE k <= 3 GROUP BY 1, 2)"""


@query("final_elasticity", sql(f"""
WITH {PROMO},
fe AS (SELECT region, brand, sum(sales) / sum(quantity) AS price FROM mo JOIN el USING (region, brand) GROUP BY 1, 2),
qt AS (SELECT region, quantile_cont(price, 0.25) a, quantile_cont(price, 0.5) b, quantile_cont(price, 0.75) c FROM fe GROUP BY 1),
br AS (SELECT brand, CAST(max(content) AS BIGINT) % 7 AS ct, length(brand) AS at1, count(*) % 3 AS at2 FROM product GROUP BY brand),
sk AS (SELECT el.*, CAST(r2 >= 0.1 AND price_elasticity < 0 AS INTEGER) AS accepted, CAST(coalesce(r2 >= 0.1 AND price_elasticity < 0 AND promo_elasticity > 0, false) AS INTEGER) AS accepted_promo,
  1 + (price > a)::INT + (price > b)::INT + (price > c)::INT AS po, dense_rank() OVER (PARTITION BY region ORDER BY ct) AS co, at1, at2 FROM el JOIN fe USING (region, brand) JOIN qt USING (region) JOIN br USING (brand)),
cs_ AS (SELECT region, 'imputed: case ' || CASE WHEN avg(accepted) >= 0.77 THEN 1 WHEN avg(accepted) >= 0.36 THEN 2 ELSE 3 END AS criteria FROM sk GROUP BY 1),
{_nearest("x", "accepted", "price_elasticity")}, {_nearest("y", "accepted_promo", "promo_elasticity")},
fp AS (SELECT region, brand, 'accepted set' AS criteria, price_elasticity AS top_1, price_elasticity AS top_3 FROM sk WHERE accepted = 1 UNION ALL SELECT region, brand, criteria, top_1, top_3 FROM xi JOIN cs_ USING (region)),
fq AS (SELECT region, brand, promo_elasticity AS top_1, promo_elasticity AS top_3 FROM sk WHERE accepted_promo = 1 UNION ALL SELECT * FROM yi),
fj AS (SELECT fp.*, substr(brand, 1, 7) AS demand_group, fq.top_1 AS q1, fq.top_3 AS q3 FROM fp LEFT JOIN fq USING (region, brand))
SELECT region, brand, demand_group, criteria, round(top_1, 6) AS price_elasticity_top_1, round(top_3, 6) AS price_elasticity_top_3, round(coalesce(q1, avg(q1) OVER g), 6) AS promo_elasticity_top_1,
  round(coalesce(q3, avg(q3) OVER g), 6) AS promo_elasticity_top_3 FROM fj WINDOW g AS (PARTITION BY demand_group)"""))
def _(spark, d):
    from tillmark.session import stage

    keys = ["region", "brand"]
    panel, fit = price_and_promo(spark, d)
    good = (F.col("r2") >= 0.1) & (F.col("price_elasticity") < 0)
    flags = {"accepted": good, "accepted_promo": good & (F.col("promo_elasticity") > 0)}
    fit = fit.withColumns({c: F.coalesce(test, F.lit(False)).cast("int") for c, test in flags.items()})
    skus = stage(described(spark, d, panel, fit))
    both = []
    for flag, value in (("accepted", "price_elasticity"), ("accepted_promo", "promo_elasticity")):
        imputed = elasticity.impute_elasticity(skus, ["region"], "brand", flag=flag, value=value, share="accepted")
        both.append(elasticity.accepted_and_imputed(skus, imputed, keys, flag, value))
    out = elasticity.final_elasticity(both[0].withColumn("demand_group", demand_group()), both[1], keys, ["demand_group"])
    return out.select(*keys, "demand_group", "criteria", *[F.round(f"{kind}_elasticity_top_{n}", 6).alias(f"{kind}_elasticity_top_{n}") for kind in ("price", "promo") for n in (1, 3)])


WEIGHTED = f"""{LOGLOG}, sl AS (SELECT region, brand, sum(sales) AS sales FROM mo GROUP BY 1, 2),
we AS (SELECT brand, sum(sales) AS sales, sum(round(slope, 9) * sales) / sum(sales) AS elasticity FROM el JOIN sl USING (region, brand) GROUP BY 1)"""


def weighted(spark, d):
    from tillmark.session import stage

    panel = stage(monthly(spark, d))  # the fit and the sales come from one pass over the lines
    fit = elasticity.fit_elasticity(panel, ["region", "brand"], "avg_unit_price", "quantity", "loglog")
    fit = stage(fit.select("region", "brand", F.round("elasticity", 9).alias("elasticity")))
    s = panel.groupBy("region", "brand").agg(F.sum("sales").alias("sales"))
    return pricing.weighted_elasticity(joins.join_keys(fit, s, ["region", "brand"], "inner"), "brand", "elasticity")


@query("weighted_elasticity", sql(f"""
WITH {WEIGHTED}, c AS (SELECT *, sum(sales) OVER (ORDER BY sales DESC, brand ROWS UNBOUNDED PRECEDING) / sum(sales) OVER () AS cum_share FROM we)
SELECT brand, sales, round(elasticity, 6) AS elasticity, cum_share, CASE WHEN cum_share <= 0.2 THEN 'Top 20%' WHEN cum_share <= 0.5 THEN 'Middle 30%' ELSE 'Bottom 50%' END AS sales_bin FROM c"""))
def _(spark, d):
    return weighted(spark, d).withColumn("elasticity", F.round("elasticity", 6))


@query("cap_second_max", sql(f"""
WITH {WEIGHTED}, r AS (SELECT brand, round(elasticity, 6) AS e FROM we), m AS (SELECT max(e) a FROM r), m2 AS (SELECT max(e) b FROM r, m WHERE e < a)
SELECT brand, CASE WHEN e = a THEN b ELSE e END AS elasticity FROM r, m, m2"""))
def _(spark, d):
    w = weighted(spark, d).select("brand", F.round("elasticity", 6).alias("elasticity"))
    return pricing.cap_second_max(w, "elasticity")


@query("jitter_constant", sql("""
WITH p AS (SELECT category, product_id, CASE WHEN category IN ('bolt', 'gear') THEN 500.0 ELSE content * 10 END AS price FROM product),
s AS (SELECT category, min(price) lo, max(price) hi, min(md5('42|' || category || '|' || product_id)) pick FROM p GROUP BY 1)
SELECT category, product_id, CASE WHEN lo = hi AND md5('42|' || category || '|' || product_id) = pick THEN price + 0.1 ELSE price END AS price FROM p JOIN s USING (category)"""))
def _(spark, d):
    p = star.products(spark, d).select(
        "category", "product_id", F.when(F.col("category").isin("bolt", "gear"), 500.0).otherwise(F.col("content") * 10).alias("price")
    )
    return pricing.jitter_constant(p, ["category"], "price", ["product_id"])


BETA = """
sw AS (SELECT material_group, year(business_day) * 12 + month(business_day) AS m, count(DISTINCT store_id) AS stores, sum(amount) / 100 / count(DISTINCT store_id) AS ssw FROM ps GROUP BY 1, 2)"""


def store_rates(spark, d):
    return star.product_sales(spark, d).groupBy("material_group", dates.month_number("business_day").alias("m")).agg(
        F.countDistinct("store_id").alias("stores"), (F.sum("amount") / 100 / F.countDistinct("store_id")).alias("ssw")
    )


@query("beta_by_sku_log", sql(f"WITH {BETA} SELECT material_group, count(*) AS n, round(sum(ln(stores) * ln(ssw)) / nullif(sum(ln(stores) * ln(stores)), 0), 6) AS beta FROM sw GROUP BY 1"))
def _(spark, d):
    out = elasticity.beta_by_sku(store_rates(spark, d), ["material_group"], "stores", "ssw", "log")
    return out.withColumn("beta", F.round("beta", 6))


@query("beta_by_sku_minmax", sql(f"""
WITH {BETA}, z AS (SELECT min(stores) a, max(stores) b, min(ssw) c, max(ssw) e FROM sw), s AS (SELECT material_group, (stores - a) / (b - a) x, (ssw - c) / (e - c) y FROM sw, z)
SELECT material_group, count(*) AS n, round(sum(x * y) / nullif(sum(x * x), 0), 6) AS beta FROM s GROUP BY 1"""))
def _(spark, d):
    from tillmark.session import stage

    out = elasticity.beta_by_sku(stage(store_rates(spark, d)), ["material_group"], "stores", "ssw", "minmax")
    return out.withColumn("beta", F.round("beta", 6))


def _box(v: str, g: str) -> str:
    return f"CASE WHEN abs({g}) < 1e-12 THEN ln({v}) ELSE ({v} ** ({g}) - 1) / ({g}) END"


# rounds of a likelihood grid of 17 exponents, as in the operator: the grid moves on and doubles while its best point is an end, then narrows
_GRID = "(l.low + i * (l.high - l.low) / 16)"
BOXCOX = f"""{BETA},
bx AS MATERIALIZED (SELECT 'x' AS c, stores - min(stores) OVER () + 1e-10 AS v FROM sw UNION ALL SELECT 'y', ssw - min(ssw) OVER () + 1e-10 FROM sw),
vc AS MATERIALIZED (SELECT c, v, count(*) AS w FROM bx GROUP BY 1, 2),
lam AS (SELECT c, -2.0::DOUBLE AS low, 2.0::DOUBLE AS high, NULL::DOUBLE AS best, false AS done FROM (VALUES ('x'), ('y')) t(c) UNION ALL
  SELECT c, CASE WHEN falls THEN best - 2 * (high - low) ELSE best - step END, CASE WHEN falls THEN best + step WHEN rises THEN best + 2 * (high - low) ELSE best + step END, best, NOT falls AND NOT rises AND step < 1e-4
  FROM (SELECT *, top = 0 AND best > -64 AND s0 > s1 AS falls, top = 16 AND best < 64 AND s16 > s15 AS rises
    FROM (SELECT c, low, high, (high - low) / 16 AS step, arg_max(g, (score, -i)) AS best, arg_max(i, (score, -i)) AS top,
        max(score) FILTER (i = 0) AS s0, max(score) FILTER (i = 1) AS s1, max(score) FILTER (i = 16) AS s16, max(score) FILTER (i = 15) AS s15
      FROM (SELECT c, low, high, i, g, CASE WHEN vr > 0 AND vr < 'Infinity'::DOUBLE THEN -n / 2 * ln(vr) + (g - 1) * s ELSE '-Infinity'::DOUBLE END AS score
        FROM (SELECT c, low, high, i, g, sum(w) AS n, sum(w * ln(v)) AS s, sum(w * b * b) / sum(w) - (sum(w * b) / sum(w)) ** 2 AS vr
          FROM (SELECT l.c, l.low, l.high, i, {_GRID} AS g, v, w, {_box("v", _GRID)} AS b FROM lam l JOIN vc ON l.c = vc.c, range(0, 17) r(i) WHERE NOT done) GROUP BY ALL)) GROUP BY ALL))),
px AS (SELECT best FROM lam WHERE done AND c = 'x'), py AS (SELECT best FROM lam WHERE done AND c = 'y'),
bc AS (SELECT material_group, {_box("(stores - min(stores) OVER () + 1e-10)", "px.best")} AS x, {_box("(ssw - min(ssw) OVER () + 1e-10)", "py.best")} AS y FROM sw, px, py)"""


@query("beta_by_sku_boxcox", sql(f"WITH RECURSIVE {BOXCOX} SELECT material_group, count(*) AS n, round(sum(x * y) / nullif(sum(x * x), 0), 6) AS beta FROM bc GROUP BY 1"))
def _(spark, d):
    from tillmark.session import stage

    out = elasticity.beta_by_sku(stage(store_rates(spark, d)), ["material_group"], "stores", "ssw", "boxcox")
    return out.withColumn("beta", F.round("beta", 6))


@query("sales_mix", sql("WITH s AS (SELECT region, brand, sum(amount) AS sales FROM sales GROUP BY 1, 2) SELECT *, sales / sum(sales) OVER () AS share FROM s"))
def _(spark, d):
    return pricing.sales_mix(star.sales(spark, d), ["region", "brand"])


@query("price_outlier_bounds", sql("""
WITH p AS (SELECT CAST(sum(amount) / sum(quantity) AS DOUBLE) AS price FROM tx GROUP BY product_id), q AS (SELECT quantile_cont(price, 0.25) a, quantile_cont(price, 0.75) b FROM p)
SELECT 'price' AS "column", round(a, 4) AS q1, round(b, 4) AS q3, round(a - (b - a) * 1.5, 4) AS lower, round(b + (b - a) * 1.5, 4) AS upper FROM q"""))
def _(spark, d):
    p = star.transactions(spark, d).groupBy("product_id").agg(safe_div(F.sum("amount"), F.sum("quantity")).alias("price"))
    out = metrics.iqr_bounds(p, ["price"])
    return out.select("column", *[F.round(c, 4).alias(c) for c in ("q1", "q3", "lower", "upper")])


@query("holiday_months", sql(f"""
WITH h AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS holiday_date FROM orders WHERE day(o_orderdate) = 6)
SELECT {MONTH.replace('business_day', 'holiday_date')} AS month, count(*) AS num_holidays, 1 AS has_holidays FROM h GROUP BY 1"""))
def _(spark, d):
    days = star.table(spark, d, "orders").select(F.col("o_orderdate").cast("date").alias("holiday_date"))
    return pricing.holiday_months(days.filter(F.dayofmonth("holiday_date") == 6).distinct())
