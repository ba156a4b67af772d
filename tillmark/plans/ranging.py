"""Assortment rationalisation and its measurement."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tillmark.functions import dates
from tillmark.functions.exprs import safe_div
from tillmark.operators import assortment, delisting, joins, measurement, metrics, ordered
from tillmark.plans import star
from tillmark.plans.growth import BRAND_WEEK, brand_weeks
from tillmark.plans.registry import query
from tillmark.plans.star import sql
from tillmark.session import stage

HALF = {"sales": 0.5, "quantity": 0.5}
YEAR = "business_day BETWEEN DATE '2000-01-01' AND DATE '2000-12-29'"

WEEKLY = f"""
wk AS (SELECT department, product_id, CAST(floor(date_diff('day', DATE '2000-01-01', business_day) / 7.0) + 1 AS INTEGER) AS week,
  sum(amount) AS sales, sum(quantity) AS quantity FROM ps WHERE {YEAR} GROUP BY 1, 2, 3)"""
LIFE = """
life0 AS (SELECT department, product_id, min(week) AS first_week, max(week) AS last_selling_week, count(DISTINCT week) AS weeks FROM wk GROUP BY 1, 2),
life AS (SELECT *, CASE WHEN 52 - last_selling_week <= 1 THEN 'Currently selling' WHEN 52 - last_selling_week <= 8 THEN 'Low/No supply' ELSE 'No recent sales' END AS life FROM life0)"""
CONTRI = """
c0 AS (SELECT department, product_id, sum(sales) s, sum(quantity) q FROM wk WHERE week > 39 GROUP BY 1, 2),
contri AS (SELECT department, product_id, s / sum(s) OVER w * 0.5 + q / sum(q) OVER w * 0.5 AS contri FROM c0 WINDOW w AS (PARTITION BY department)),
cut AS (SELECT department, quantile_cont(contri, 0.5) p50, quantile_cont(contri, 0.8) p80 FROM wk JOIN contri USING (department, product_id) WHERE week > 39 AND contri <> 0 GROUP BY 1),
tiers AS (SELECT l.department, l.product_id, coalesce(contri, 0.0) AS contri, CASE WHEN coalesce(contri, 0.0) = 0 OR contri <= p50 THEN 'Low' WHEN contri <= p80 THEN 'Middle' ELSE 'Top' END AS tier
  FROM life l LEFT JOIN contri USING (department, product_id) JOIN cut USING (department))"""
GROWTH = """
g0 AS (SELECT *, lag(sales) OVER w ls, lag(quantity) OVER w lq, row_number() OVER w rn FROM wk WINDOW w AS (PARTITION BY department, product_id ORDER BY week)),
g AS (SELECT department, product_id, round(avg(0.5 * ((sales - ls) / ls) + 0.5 * ((quantity - lq) / lq)), 9) AS avg_growth FROM g0 WHERE rn > 1 GROUP BY 1, 2)"""
PEN = f"""
pn0 AS (SELECT department, product_id, count(DISTINCT region) n FROM sales WHERE {YEAR} GROUP BY 1, 2),
pn AS (SELECT department, product_id, CASE WHEN round(n / 5, 2) <= 0.3 THEN 'Low' WHEN round(n / 5, 2) <= 0.7 THEN 'Middle' ELSE 'High' END AS pen_class FROM pn0)"""
LOOKALIKES = """
lk AS (SELECT department, product_id FROM wk JOIN life0 USING (department, product_id) WHERE first_week < 27 AND last_selling_week >= 51
  GROUP BY 1, 2 HAVING count(DISTINCT CASE WHEN week < first_week + 32 THEN week END) >= 26),
lg AS (SELECT department, round(avg(a), 9) AS look FROM (SELECT department, product_id, avg(0.5 * ((sales - ls) / ls) + 0.5 * ((quantity - lq) / lq)) AS a
  FROM g0 JOIN lk USING (department, product_id) WHERE rn BETWEEN 2 AND 26 GROUP BY 1, 2) GROUP BY 1)"""
NEW_CONTRI = """
nw AS (SELECT wk.* FROM wk JOIN life0 USING (department, product_id) WHERE first_week >= 27),
no AS (SELECT department, product_id, min(week) AS launch_week, sum(sales) AS s, sum(quantity) AS q FROM nw GROUP BY 1, 2),
nc AS (SELECT no.department, no.product_id, s / (SELECT sum(sales) FROM nw WHERE nw.department = no.department AND nw.week >= launch_week) * 0.5
  + q / (SELECT sum(quantity) FROM nw WHERE nw.department = no.department AND nw.week >= launch_week) * 0.5 AS new_contri FROM no)"""
SKUS = f"""{WEEKLY}, {LIFE}, {CONTRI}, {GROWTH}, {PEN}, {LOOKALIKES}, {NEW_CONTRI},
skus AS (SELECT department, product_id, tier, life, pen_class, coalesce(new_contri, contri) AS contri, coalesce(avg_growth, 0.0) AS avg_growth, CAST(first_week >= 27 AS INTEGER) AS is_new, coalesce(look, 0.0) AS look
  FROM tiers JOIN life USING (department, product_id) LEFT JOIN g USING (department, product_id) JOIN pn USING (department, product_id) LEFT JOIN nc USING (department, product_id) LEFT JOIN lg USING (department)),
med AS (SELECT department, tier, avg_growth AS m FROM (SELECT *, row_number() OVER (PARTITION BY department, tier ORDER BY avg_growth) - 1 i,
  count(*) OVER (PARTITION BY department, tier) n FROM skus WHERE is_new = 0) WHERE i = n // 2),
fl AS (SELECT department, min(contri) AS f FROM skus WHERE is_new = 0 AND tier = 'Middle' GROUP BY 1),
reco AS (SELECT skus.* EXCLUDE (look), CASE
  WHEN is_new = 1 AND avg_growth >= look AND contri >= f THEN 'Grow'
  WHEN is_new = 1 AND (avg_growth >= look OR contri >= f) THEN 'Maintain'
  WHEN is_new = 1 AND life = 'Currently selling' THEN 'Observe'
  WHEN is_new = 1 THEN 'Delist'
  WHEN tier = 'Top' AND avg_growth < m THEN 'Grow' WHEN tier = 'Top' THEN 'Maintain'
  WHEN tier = 'Middle' AND avg_growth >= m AND life = 'Currently selling' THEN CASE WHEN pen_class = 'High' THEN 'Maintain' ELSE 'Grow' END
  WHEN tier = 'Middle' THEN 'Observe'
  WHEN avg_growth >= m AND life = 'Currently selling' AND pen_class <> 'Low' THEN 'Maintain'
  WHEN avg_growth >= m THEN 'Observe'
  WHEN life = 'Currently selling' AND pen_class = 'Low' THEN 'Observe' ELSE 'Delist' END AS bucket
  FROM skus LEFT JOIN med USING (department, tier) JOIN fl USING (department))"""


def year_sales(spark, d):
    return star.product_sales(spark, d).filter(dates.in_period("business_day", "2000-01-01", "2000-12-29"))


def weekly(spark, d):
    return year_sales(spark, d).groupBy(
        "department", "product_id", dates.week_index("business_day", "2000-01-01").alias("week")
    ).agg(F.sum("amount").alias("sales"), F.sum("quantity").alias("quantity"))


KEYS = ["department", "product_id"]


def life_of(wk):
    return assortment.lifecycle(wk, KEYS, "week")


def tiers_of(wk, life):
    recent = wk.filter(assortment.analysis_weeks("week"))
    contri = assortment.contribution(recent, "product_id", HALF, ["department"]).select(*KEYS, "contri")
    every = joins.join_keys(life.select(*KEYS), contri, KEYS).na.fill(0.0, subset=["contri"])
    return assortment.contribution_tier(every, "contri", ["department"], rows=recent)


def sku_frame(spark, d):
    """One row per SKU with everything the recommendation rules look at; a department without look-alikes has growth 0 for them.

    The facts are read once, into sums per SKU, week and region; a SKU's weeks are gone through once.
    """
    week = dates.week_index("business_day", "2000-01-01").alias("week")
    lines = star.sales(spark, d).filter(dates.in_period("business_day", "2000-01-01", "2000-12-29"))
    cells = stage(lines.groupBy(*KEYS, week, "region").agg(F.sum("amount").alias("sales"), F.sum("quantity").alias("quantity")))
    wk = cells.groupBy(*KEYS, "week").agg(*[F.sum(m).alias(m) for m in HALF])
    facts = stage(assortment.sku_facts(wk, "product_id", "week", HALF, ["department"]))

    group = facts.groupBy("department").agg(*[F.sum(f"recent_{m}").alias(f"__{m}") for m in HALF], F.round(F.avg("alike_growth"), 9).alias("look"))
    blend = sum((safe_div(f"recent_{m}", f"__{m}", 0) * F.lit(w) for m, w in HALF.items()), F.lit(0.0))
    out = joins.join_keys(facts, group, ["department"]).withColumn("contri", blend)
    # a SKU counts once for each analysis week it sold in
    counted = out.filter("contri <> 0").groupBy("department", "contri").agg(F.sum("recent_weeks").alias("__n"))
    cuts = ordered.percentiles_of_counts(counted, "contri", {"p50": 0.5, "p80": 0.8}, ["department"])
    tier = F.when((F.col("contri") == 0) | (F.col("contri") <= F.col("p50")), "Low").when(F.col("contri") <= F.col("p80"), "Middle").otherwise("Top")
    out = joins.join_keys(out, cuts, ["department"], "inner").withColumn("tier", tier)

    # new SKUs against the sums of all new SKUs from their own first week on: few rows, one per department and week
    fresh = wk.join(facts.filter("is_new = 1").select(*KEYS), KEYS, "left_semi").groupBy("department", "week").agg(*[F.sum(m).alias(m) for m in HALF])
    onward = Window.partitionBy("department").orderBy(F.desc("week"))
    since = fresh.select("department", F.col("week").alias("first_week"), *[F.sum(m).over(onward).alias(f"__new_{m}") for m in HALF])
    out = joins.join_keys(out, since, ["department", "first_week"])
    new = sum((safe_div(f"all_{m}", f"__new_{m}", 0) * F.lit(w) for m, w in HALF.items()), F.lit(0.0))

    pen = metrics.store_penetration(cells.select(*KEYS, "region").distinct(), "product_id", "region", ["department"])
    out = joins.join_keys(out, pen.select(*KEYS, "pen_class"), KEYS)
    return stage(out.select(
        *KEYS, "tier", "life", "pen_class", F.when(F.col("is_new") == 1, new).otherwise(F.col("contri")).alias("contri"),
        F.coalesce(F.round("avg_growth", 9), F.lit(0.0)).alias("avg_growth"), "is_new", F.coalesce("look", F.lit(0.0)).alias("look"),
    ))


def recommended(spark, d):
    skus = sku_frame(spark, d)
    middle = F.when((F.col("is_new") == 0) & (F.col("tier") == "Middle"), F.col("contri"))
    with_floor = joins.with_group(skus, ["department"], [F.min(middle).alias("floor")])
    return assortment.recommend(with_floor, ["department"], lookalike_growth=F.col("look"), new_floor=F.col("floor")).drop("floor", "look")


@query("lifecycle", sql(f"""
WITH {WEEKLY}, {LIFE} SELECT *, CASE WHEN 53 - first_week <= 0 THEN 'New Launch' WHEN 53 - first_week <= 13 THEN 'Settling' WHEN 53 - first_week <= 26 THEN 'Stable' ELSE 'Established' END AS first_class FROM life"""))
def _(spark, d):
    return life_of(weekly(spark, d)).withColumn("first_class", assortment.first_sale_class(max_week=104))


@query("contribution_tier", sql(f"WITH {WEEKLY}, {LIFE}, {CONTRI} SELECT * FROM tiers"))
def _(spark, d):
    wk = stage(weekly(spark, d))
    return tiers_of(wk, life_of(wk))


@query("lookalike_base", sql(f"""
WITH {BRAND_WEEK}, f AS (SELECT brand, min(week) a, max(week) b FROM bw GROUP BY 1),
k AS (SELECT brand FROM bw JOIN f USING (brand) WHERE a < 27 AND b >= 51 GROUP BY 1 HAVING count(DISTINCT CASE WHEN week < a + 32 THEN week END) >= 26)
SELECT brand, week, sales, quantity, selling_week FROM (SELECT bw.*, row_number() OVER (PARTITION BY brand ORDER BY week) AS selling_week FROM bw JOIN k USING (brand)) WHERE selling_week <= 26"""))
def _(spark, d):
    return assortment.lookalike_base(brand_weeks(spark, d), ["brand"], "week")


@query("new_sku_contribution", sql(f"""
WITH {WEEKLY}, {LIFE}, n AS (SELECT wk.* FROM wk JOIN life USING (department, product_id) WHERE first_week >= 27),
o AS (SELECT department, product_id, min(week) AS launch_week, sum(sales) AS sales, sum(quantity) AS quantity FROM n GROUP BY 1, 2)
SELECT o.*, sales / (SELECT sum(sales) FROM n WHERE n.department = o.department AND n.week >= o.launch_week) * 0.5
  + quantity / (SELECT sum(quantity) FROM n WHERE n.department = o.department AND n.week >= o.launch_week) * 0.5 AS contri FROM o"""))
def _(spark, d):
    wk = stage(weekly(spark, d))
    new = life_of(wk).filter(assortment.new_sku_flag_by_week() == 1)
    return assortment.new_sku_contribution(wk, "product_id", "week", HALF, new, ["department"])


COLS = "department, product_id, tier, life, pen_class, contri, avg_growth, is_new"


@query("recommend", sql(f"WITH {SKUS} SELECT {COLS}, bucket FROM reco"))
def _(spark, d):
    return recommended(spark, d)


TAIL = """
tl AS (SELECT department, product_id, sum(contri) OVER (PARTITION BY department ORDER BY contri DESC, product_id ROWS UNBOUNDED PRECEDING) / sum(contri) OVER (PARTITION BY department) AS cum FROM reco WHERE tier = 'Low'),
tm AS (SELECT reco.*, CASE WHEN round(cum, 9) > 1 - 2 / 100.0 THEN 1 ELSE 0 END AS t FROM reco LEFT JOIN tl USING (department, product_id)),
tail AS (SELECT * REPLACE (CASE WHEN t = 1 AND sum(t) OVER (PARTITION BY department) <= floor(count(*) OVER (PARTITION BY department) * 60 / 100.0) THEN 'Delist' ELSE bucket END AS bucket) FROM tm)"""


@query("tail_delist", sql(f"WITH {SKUS}, {TAIL} SELECT department, bucket, count(*) AS skus FROM tail GROUP BY 1, 2"))
def _(spark, d):
    out = assortment.tail_delist(recommended(spark, d), "product_id", "contri", 2, 60, ["department"])
    return out.groupBy("department", "bucket").agg(F.count(F.lit(1)).alias("skus"))


GP_TIER = f"""
gp0 AS (SELECT department, product_id, sum(amount * gp_percent / 100) AS gp FROM ps WHERE {YEAR} GROUP BY 1, 2),
gp1 AS (SELECT department, product_id, gp / sum(gp) OVER (PARTITION BY department) AS gp_share, gp FROM gp0),
gp2 AS (SELECT department, quantile_cont(gp_share, 0.5) a, quantile_cont(gp_share, 0.8) b FROM gp1 GROUP BY 1),
gpt AS (SELECT department, product_id, gp, CASE WHEN gp_share <= a THEN 'Low' WHEN gp_share <= b THEN 'Middle' ELSE 'Top' END AS gp_tier FROM gp1 JOIN gp2 USING (department))"""


def gp_tiers(spark, d):
    gp = year_sales(spark, d).groupBy(*KEYS).agg(F.sum(F.col("amount") * F.col("gp_percent") / 100).alias("gp"))
    shares = metrics.share_of(stage(gp), "gp", ["department"], "gp_share")
    return assortment.contribution_tier(shares, "gp_share", ["department"], name="gp_tier")


@query("adjust_by_gp", sql(f"""
WITH {SKUS}, {GP_TIER} SELECT {COLS}, bucket, gp_tier, own_label, CASE WHEN own_label = 1 AND (tier = 'Low' OR is_new = 1) AND nb = 'Delist' THEN 'Observe' ELSE nb END AS new_bucket FROM (
SELECT reco.*, gp_tier, own_label, CASE WHEN is_new = 1 THEN bucket
  WHEN tier = 'Top' THEN CASE WHEN bucket = 'Grow' AND gp_tier = 'Low' THEN 'Maintain' WHEN bucket = 'Maintain' AND gp_tier = 'Top' THEN 'Grow' ELSE bucket END
  WHEN tier = 'Middle' THEN CASE WHEN bucket = 'Grow' AND gp_tier = 'Low' THEN 'Maintain' WHEN bucket = 'Maintain' AND gp_tier = 'Top' THEN 'Grow'
    WHEN bucket = 'Maintain' AND gp_tier = 'Low' THEN 'Observe' WHEN bucket = 'Observe' AND gp_tier = 'Top' THEN 'Maintain' ELSE bucket END
  WHEN pen_class = 'Low' THEN bucket
  WHEN bucket = 'Maintain' AND gp_tier = 'Low' THEN 'Observe' WHEN bucket = 'Observe' AND gp_tier = 'Top' THEN 'Maintain' WHEN bucket = 'Delist' AND gp_tier <> 'Low' THEN 'Observe'
  ELSE bucket END AS nb FROM reco JOIN gpt USING (department, product_id) JOIN product USING (department, product_id))"""))
def _(spark, d):
    out = joins.join_keys(recommended(spark, d), gp_tiers(spark, d).select(*KEYS, "gp_tier"), KEYS, "inner")
    out = out.join(star.products(spark, d).select("product_id", "own_label"), "product_id")
    return assortment.adjust_by_gp(out, "own_label")


QUARTERS = f"""
qd AS (SELECT department, product_id, sum(CASE WHEN business_day >= DATE '2000-10-01' THEN amount ELSE 0 END) AS sales_q4,
  sum(CASE WHEN business_day BETWEEN DATE '2000-07-01' AND DATE '2000-09-30' THEN amount ELSE 0 END) AS sales_q3,
  sum(amount * gp_percent) AS gp FROM ps WHERE {YEAR} AND business_day >= DATE '2000-07-01' GROUP BY 1, 2)"""


def quarters(spark, d):
    df = year_sales(spark, d).filter(F.col("business_day") >= F.lit("2000-07-01").cast("date"))
    q4 = F.col("business_day") >= F.lit("2000-10-01").cast("date")
    return df.groupBy(*KEYS).agg(
        F.sum(F.when(q4, F.col("amount")).otherwise(0.0)).alias("sales_q4"),
        F.sum(F.when(~q4, F.col("amount")).otherwise(0.0)).alias("sales_q3"),
        F.sum(F.col("amount") * F.col("gp_percent")).alias("gp"),
    )


@query("rescue_delists", sql(f"""
WITH {SKUS}, {QUARTERS}, dq AS (SELECT qd.* FROM qd JOIN reco USING (department, product_id) WHERE bucket = 'Delist'),
r AS (SELECT *, rank() OVER (PARTITION BY department ORDER BY gp DESC) + (count(*) OVER (PARTITION BY department, gp) - 1) / 2.0 AS gp_rank,
  rank() OVER (PARTITION BY department ORDER BY sales_q4 DESC) + (count(*) OVER (PARTITION BY department, sales_q4) - 1) / 2.0 AS sales_rank,
  coalesce((sales_q4 - sales_q3) / nullif(sales_q3, 0), 0) AS q_growth FROM dq),
m AS (SELECT *, avg(CASE WHEN gp_rank <= 15 THEN q_growth END) OVER (PARTITION BY department) AS a FROM r)
SELECT department, product_id, sales_q4, sales_q3, gp, gp_rank, sales_rank, q_growth, CASE WHEN gp_rank <= 15 AND q_growth > a AND q_growth > 0 AND sales_rank <= 15 THEN 'Observe' ELSE 'Delist' END AS bucket FROM m"""))
def _(spark, d):
    delisted = recommended(spark, d).filter("bucket = 'Delist'").select(*KEYS)
    return assortment.rescue_delists(joins.join_keys(quarters(spark, d), delisted, KEYS, "inner"), ["department"])


@query("delist_priority", sql(f"""
WITH {QUARTERS}, p AS (SELECT department, product_id, sales_q4 / sum(sales_q4) OVER (PARTITION BY department) AS contri, coalesce((sales_q4 - sales_q3) / nullif(sales_q3, 0), 0) AS growth FROM qd),
t AS (SELECT *, (contri + growth) / 2 AS priority_mean, CASE WHEN (contri + growth) / 2 = 0 THEN 1 WHEN contri = 0 AND growth = -1 THEN 2 WHEN contri <> 0 AND growth = 0 THEN 3 ELSE 4 END AS priority_tier FROM p)
SELECT *, row_number() OVER (PARTITION BY department ORDER BY priority_tier, CASE WHEN priority_tier < 4 THEN contri ELSE priority_mean END,
  CASE WHEN priority_tier < 4 THEN growth END NULLS FIRST, product_id) AS delist_priority FROM t"""))
def _(spark, d):
    q = metrics.share_of(stage(quarters(spark, d)), "sales_q4", ["department"], "contri")
    q = q.select(*KEYS, "contri", F.coalesce(safe_div(F.col("sales_q4") - F.col("sales_q3"), "sales_q3"), F.lit(0.0)).alias("growth"))
    return assortment.delist_priority(q, "product_id", by=["department"])


@query("gross_profit", sql("""
WITH s AS (SELECT region, year(business_day) * 100 + month(business_day) AS ym, product_id, sum(amount) AS sales FROM ss GROUP BY ALL),
g AS (SELECT product_id, gp_percent FROM product WHERE content > 3)
SELECT region, CAST(ym AS INTEGER) AS year_month, count(*) AS skus, sum(sales) AS sales, round(sum(coalesce(sales * gp_percent / 100, 0)), 4) AS gp,
  round(sum(coalesce(sales * gp_percent / 100, 0)) / sum(sales), 6) AS margin FROM s LEFT JOIN g USING (product_id) GROUP BY 1, 2"""))
def _(spark, d):
    s = star.store_sales(spark, d).groupBy("region", dates.year_month("business_day").alias("year_month"), "product_id").agg(
        F.sum("amount").alias("sales")
    )
    gp = star.products(spark, d).filter("content > 3").select("product_id", "gp_percent")
    out = assortment.gross_profit(s, gp, ["product_id"])
    return out.groupBy("region", "year_month").agg(
        F.count(F.lit(1)).alias("skus"), F.sum("sales").alias("sales"), F.round(F.sum("gp"), 4).alias("gp"),
        F.round(safe_div(F.sum("gp"), F.sum("sales")), 6).alias("margin"),
    )


@query("compress_attributes", sql("""
WITH b AS (SELECT brand, sum(amount) s FROM ps GROUP BY 1), bk AS (SELECT brand FROM (SELECT brand, (sum(s) OVER (ORDER BY s DESC, brand ROWS UNBOUNDED PRECEDING) - s) / sum(s) OVER () c FROM b) WHERE c < 0.5),
m AS (SELECT material_group, sum(amount) s FROM ps GROUP BY 1), mk AS (SELECT material_group FROM (SELECT material_group, (sum(s) OVER (ORDER BY s DESC, material_group ROWS UNBOUNDED PRECEDING) - s) / sum(s) OVER () c FROM m) WHERE c < 0.5)
SELECT coalesce(bk.brand, 'Others') AS brand, coalesce(mk.material_group, 'Others') AS material_group, count(*) AS lines, sum(amount) AS sales
FROM ps LEFT JOIN bk USING (brand) LEFT JOIN mk USING (material_group) GROUP BY 1, 2"""))
def _(spark, d):
    df = star.product_sales(spark, d).select("brand", "material_group", "amount")
    out = assortment.compress_attributes(df, ["brand", "material_group"], "amount", 0.5)
    return out.groupBy("brand", "material_group").agg(F.count(F.lit(1)).alias("lines"), F.sum("amount").alias("sales"))


@query("stratified_sample", sql("""
WITH t AS (SELECT DISTINCT store_id, year(business_day) AS year, transaction_id FROM tx),
r AS (SELECT *, row_number() OVER (PARTITION BY store_id, year ORDER BY md5('42|' || transaction_id), transaction_id) i, count(*) OVER (PARTITION BY store_id, year) n FROM t)
SELECT store_id, year, transaction_id FROM r WHERE i <= greatest(1, round(n * 0.05))"""))
def _(spark, d):
    t = star.transactions(spark, d).select("store_id", F.year("business_day").alias("year"), "transaction_id").distinct()
    return assortment.stratified_sample(stage(t), ["store_id", "year"], ["transaction_id"], 0.05)


@query("delist_impact", sql(f"""
WITH {SKUS}, s AS (SELECT department, product_id, sum(amount) AS sales FROM ps WHERE {YEAR} GROUP BY 1, 2)
SELECT brand, count(*) AS total_count, count(*) FILTER (WHERE bucket = 'Delist') AS delist_count, sum(sales) AS sales, sum(CASE WHEN bucket = 'Delist' THEN sales ELSE 0 END) AS delist_sales,
  count(*) FILTER (WHERE bucket = 'Delist') / count(*) AS delist_share, sum(CASE WHEN bucket = 'Delist' THEN sales ELSE 0 END) / sum(sales) AS delist_sales_share
FROM reco JOIN s USING (department, product_id) JOIN product USING (department, product_id) GROUP BY 1"""))
def _(spark, d):
    reco = recommended(spark, d).withColumn("delist_flag", (F.col("bucket") == "Delist").cast("int"))
    s = year_sales(spark, d).groupBy(*KEYS, "brand").agg(F.sum("amount").alias("sales"))
    return assortment.delist_impact(joins.join_keys(reco, s, KEYS, "inner"), ["brand"])


# choice: one group per department, the brands being the SKUs

CHOICE = f"""
u0 AS (SELECT department, brand, category, sum(quantity) AS units, sum(amount) / sum(quantity) AS price, sum(amount) AS sales, sum(amount * gp_percent / 100) AS gp,
  sum(amount * gp_percent / 100) / sum(amount) AS margin FROM ps WHERE {YEAR} GROUP BY ALL),
bb AS (SELECT brand, ln(u / first_value(u) OVER (ORDER BY brand)) AS b FROM (SELECT brand, sum(units) AS u FROM u0 GROUP BY 1)),
bc AS (SELECT category, ln(u / first_value(u) OVER (ORDER BY category)) AS b FROM (SELECT category, sum(units) AS u FROM u0 GROUP BY 1)),
u1 AS (SELECT u0.*, bb.b + bc.b AS utility, exp(bb.b + bc.b) AS beta_exp FROM u0 JOIN bb USING (brand) JOIN bc USING (category)),
ch AS (SELECT *, beta_exp / sum(beta_exp) OVER w AS probability, beta_exp / sum(beta_exp) OVER w * units AS prob_units, price * (beta_exp / sum(beta_exp) OVER w * units) * margin AS value,
  sales / sum(sales) OVER w AS sales_share, gp / sum(gp) OVER w AS gp_share FROM u1 WINDOW w AS (PARTITION BY department))"""


def choice_base(spark, d):
    """Units, price, sales and profit of each brand in a category."""
    return year_sales(spark, d).groupBy("department", "brand", "category").agg(
        F.sum("quantity").alias("units"),
        safe_div(F.sum("amount"), F.sum("quantity")).alias("price"),
        F.sum("amount").alias("sales"),
        F.sum(F.col("amount") * F.col("gp_percent") / 100).alias("gp"),
        safe_div(F.sum(F.col("amount") * F.col("gp_percent") / 100), F.sum("amount")).alias("margin"),
    )


def choice(spark, d):
    base = stage(choice_base(spark, d))
    betas = delisting.share_coefficients(base, ["brand", "category"], "units")
    valued = delisting.choice_value(base, ["brand", "category"], betas, 0.0, ["department"])
    out = metrics.share_of(valued, "sales", ["department"], "sales_share")
    return stage(metrics.share_of(out, "gp", ["department"], "gp_share").withColumn("sku", F.concat_ws(" ", "brand", "category")))


@query("choice_value", sql(f"""
WITH {CHOICE} SELECT department, brand, category, units, round(utility, 6) AS utility, round(probability, 8) AS probability, round(prob_units, 6) AS prob_units, round(value, 2) AS value FROM ch"""))
def _(spark, d):
    return choice(spark, d).select(
        "department", "brand", "category", "units", F.round("utility", 6).alias("utility"), F.round("probability", 8).alias("probability"),
        F.round("prob_units", 6).alias("prob_units"), F.round("value", 2).alias("value"),
    )


@query("reallocated_value", sql(f"""
WITH {CHOICE}, k AS (SELECT *, sales_share < 0.003 AS r FROM ch),
s AS (SELECT department, count(*) AS skus, count(*) FILTER (WHERE r) AS removed_skus, sum(CASE WHEN r THEN 0 ELSE beta_exp END) b, sum(CASE WHEN r THEN prob_units ELSE 0 END) u FROM k GROUP BY 1)
SELECT department, s.skus, s.removed_skus, round(sum(price * margin * (prob_units + beta_exp / b * u)), 2) AS value FROM k JOIN s USING (department) WHERE NOT r GROUP BY 1, 2, 3"""))
def _(spark, d):
    out = delisting.reallocated_value(choice(spark, d), F.col("sales_share") < 0.003, ["department"])
    return out.withColumn("value", F.round("value", 2))


@query("leave_one_out_value", sql(f"""
WITH {CHOICE}, x AS (SELECT department, brand || ' ' || category AS sku, beta_exp AS be, prob_units AS pu FROM ch),
y AS (SELECT x.department, x.sku, sum(price * margin * (prob_units + beta_exp / (t.b - x.be) * x.pu)) v FROM x JOIN ch ON ch.department = x.department AND ch.brand || ' ' || ch.category <> x.sku
  JOIN (SELECT department, sum(beta_exp) b FROM ch GROUP BY 1) t ON t.department = x.department GROUP BY 1, 2)
SELECT department, sku, round(v, 2) AS value_without FROM y"""))
def _(spark, d):
    out = delisting.leave_one_out(choice(spark, d), F.lit(False), ["department"])
    return out.select("department", "sku", F.round("value_without", 2).alias("value_without"))


# one row for each round and department; a round scores every SKU still kept against the sums of its department
GREEDY = f"""{CHOICE},
k0 AS MATERIALIZED (SELECT department, brand || ' ' || category AS sku, price * margin * beta_exp AS w, beta_exp AS be, price * margin * prob_units AS v, prob_units AS pu,
  brand <> 'Brand#1' AND sales_share <= 0.02 AND gp_share <= 0.02 AS cand FROM ch),
lim AS MATERIALIZED (SELECT department, CAST(round_even(count(*) * 0.25, 0) AS INTEGER) AS lim, sum(v) AS pv FROM k0 GROUP BY 1),
rounds AS (
  SELECT department, 0 AS rnd, pv, CAST([] AS VARCHAR[]) AS gone FROM lim
  UNION ALL
  SELECT department, rnd + 1, val, list_append(gone, sku) FROM (
    SELECT *, row_number() OVER (PARTITION BY department ORDER BY val DESC, sku) AS rk FROM (
      SELECT *, (sum(CASE WHEN o THEN 0 ELSE w END) OVER p - w) / (sum(CASE WHEN o THEN 0 ELSE be END) OVER p - be) * (sum(CASE WHEN o THEN pu ELSE 0 END) OVER p + pu) + sum(CASE WHEN o THEN 0 ELSE v END) OVER p - v AS val
      FROM (SELECT rounds.*, lim.lim, k0.sku, k0.w, k0.be, k0.v, k0.pu, k0.cand, list_contains(gone, k0.sku) AS o FROM rounds JOIN lim USING (department) JOIN k0 USING (department) WHERE rnd < lim.lim)
      WINDOW p AS (PARTITION BY department)) WHERE cand AND NOT o) WHERE rk = 1 AND val >= pv)"""


def greedy(spark, d):
    marked = delisting.delist_candidates(choice(spark, d), F.col("brand") == "Brand#1", 0.02, 0.02)
    return delisting.greedy_delist(marked, "sku", ["department"])


@query("greedy_delist", sql(f"WITH RECURSIVE {GREEDY} SELECT department, gone[rnd] AS sku, rnd AS removed_round FROM rounds WHERE rnd > 0"))
def _(spark, d):
    return greedy(spark, d).filter("delist_flag = 1").select("department", "sku", "removed_round")


FLAGGED = f"""{CHOICE},
f0 AS (SELECT *, brand || ' ' || category AS sku, CAST(sales_share < 0.006 OR category = 'bolt' AS INTEGER) AS delist_flag FROM ch),
f1 AS (SELECT * REPLACE (CASE WHEN min(delist_flag) OVER (PARTITION BY department, category) = 1 AND row_number() OVER (PARTITION BY department, category ORDER BY units DESC, sku) = 1 THEN 0 ELSE delist_flag END AS delist_flag) FROM f0),
r1 AS (SELECT department, sku, sum(gp_share) OVER w - gp_share AS bef, sum(gp_share) OVER (PARTITION BY department) AS tot, row_number() OVER w AS p FROM f1 WHERE delist_flag = 1 WINDOW w AS (PARTITION BY department ORDER BY gp_share DESC, sku ROWS UNBOUNDED PRECEDING)),
f2 AS (SELECT f1.* REPLACE (CASE WHEN tot >= 0.3 AND (p = 1 OR bef < tot - 0.3) THEN 0 ELSE delist_flag END AS delist_flag) FROM f1 LEFT JOIN r1 USING (department, sku)),
r2 AS (SELECT department, sku, sum(sales_share) OVER w - sales_share AS bef, sum(sales_share) OVER (PARTITION BY department) AS tot, row_number() OVER w AS p FROM f2 WHERE delist_flag = 1 WINDOW w AS (PARTITION BY department ORDER BY sales_share DESC, sku ROWS UNBOUNDED PRECEDING)),
f3 AS (SELECT f2.* REPLACE (CASE WHEN tot >= 0.25 AND (p = 1 OR bef < tot - 0.25) THEN 0 ELSE delist_flag END AS delist_flag) FROM f2 LEFT JOIN r2 USING (department, sku))"""


def constrained(spark, d):
    flag = ((F.col("sales_share") < 0.006) | (F.col("category") == "bolt")).cast("int")
    skus = choice(spark, d).withColumn("delist_flag", flag)
    return delisting.enforce_constraints(skus, "sku", "category", "units", {"gp_share": 0.3, "sales_share": 0.25}, ["department"])


@query("enforce_constraints", sql(f"WITH {FLAGGED} SELECT department, sku, delist_flag FROM f3"))
def _(spark, d):
    return constrained(spark, d).select("department", "sku", "delist_flag")


@query("scenario_summary", sql(f"""
WITH {FLAGGED}, s AS (SELECT department, sum(CASE WHEN delist_flag = 1 THEN 0 ELSE beta_exp END) b, sum(CASE WHEN delist_flag = 1 THEN prob_units ELSE 0 END) u FROM f3 GROUP BY 1),
z AS (SELECT department, count(*) AS skus, CAST(sum(delist_flag) AS BIGINT) AS delisted, sum(CASE WHEN delist_flag = 1 THEN sales_share ELSE 0 END) AS ds, sum(CASE WHEN delist_flag = 1 THEN gp_share ELSE 0 END) AS dg,
  sum(price * margin * prob_units) AS vb, sum(price * prob_units) AS sb, sum(CASE WHEN delist_flag = 0 THEN price * margin * (prob_units + beta_exp / b * u) END) AS va,
  sum(CASE WHEN delist_flag = 0 THEN price * (prob_units + beta_exp / b * u) END) AS sa FROM f3 JOIN s USING (department) GROUP BY 1)
SELECT department, skus, delisted, round(ds, 6) AS delist_sales_share, round(dg, 6) AS delist_gp_share, round(vb, 2) AS value_before, round(va, 2) AS value_after, round(vb / sb, 8) AS margin_before,
  round(va / sa, 8) AS margin_after, CAST(va / sa >= vb / sb AS INTEGER) AS recommend_delisting FROM z"""))
def _(spark, d):
    out = delisting.scenario_summary(constrained(spark, d), ["department"])
    digits = {"delist_sales_share": 6, "delist_gp_share": 6, "value_before": 2, "value_after": 2, "margin_before": 8, "margin_after": 8}
    for c, n in digits.items():
        out = out.withColumn(c, F.round(c, n))
    return out


# measurement

ADJ = """
sc AS (SELECT year(business_day) y, month(business_day) m, sum(amount) s FROM ps GROUP BY 1, 2), sm AS (SELECT m, sum(s) t, count(*) n, avg(s) a FROM sc GROUP BY 1),
si AS (SELECT m, a / (sum(t) OVER () / sum(n) OVER ()) AS idx FROM sm),
adj AS (SELECT category, material_group, year(business_day) AS year, month(business_day) AS month, sum(amount) AS sales, sum(amount * gp_percent / 100) AS gp,
  sum(amount) / max(idx) AS sales_adj, sum(amount * gp_percent / 100) / max(idx) AS gp_adj FROM ps JOIN si ON si.m = month(business_day) GROUP BY ALL)"""


def adjusted(spark, d):
    df = star.product_sales(spark, d).select(
        "category", "material_group", F.year("business_day").alias("year"), F.month("business_day").alias("month"), "amount",
        (F.col("amount") * F.col("gp_percent") / 100).alias("gp"),
    )
    return measurement.season_adjusted(df, ["category", "material_group"], "year", "month", "amount", "gp")


@query("season_adjusted_sales", sql(f"""
WITH {ADJ} SELECT category, material_group, year, month, sales, round(gp, 4) AS gp, round(sales_adj, 2) AS sales_adj, round(gp_adj, 2) AS gp_adj FROM adj"""))
def _(spark, d):
    out = adjusted(spark, d).drop("seasonality_index")
    return out.withColumn("gp", F.round("gp", 4)).withColumn("sales_adj", F.round("sales_adj", 2)).withColumn("gp_adj", F.round("gp_adj", 2))


@query("incremental_gp", sql(f"""
WITH {ADJ}, t AS (SELECT *, year = 1999 AND month >= 10 AS pre, year = 2000 AND month BETWEEN 4 AND 6 AS post, category = 'bolt' AS gone FROM adj),
s AS (SELECT sum(CASE WHEN pre THEN sales_adj ELSE 0 END) a, sum(CASE WHEN post THEN sales_adj ELSE 0 END) b, sum(CASE WHEN pre AND gone THEN sales_adj ELSE 0 END) c,
  sum(CASE WHEN pre THEN gp_adj ELSE 0 END) x, sum(CASE WHEN post THEN gp_adj ELSE 0 END) y, sum(CASE WHEN pre AND gone THEN gp_adj ELSE 0 END) z FROM t)
SELECT round(a, 2) AS pre_sales_adj, round(b, 2) AS post_sales_adj, round(c, 2) AS expected_sales_adj, round(x, 2) AS pre_gp_adj, round(y, 2) AS post_gp_adj, round(z, 2) AS expected_gp_adj,
  round(b - c - a, 2) AS incremental_sales_adj, round(y - z - x, 2) AS incremental_gp_adj FROM s"""))
def _(spark, d):
    gone = star.products(spark, d).filter("category = 'bolt'").select("material_group")
    pre = (F.col("year") == 1999) & (F.col("month") >= 10)
    post = (F.col("year") == 2000) & F.col("month").between(4, 6)
    out = measurement.incremental_gp(adjusted(spark, d), gone, ["material_group"], pre, post)
    return out.select(*[F.round(c, 2).alias(c) for c in out.columns])


EVENTS = """
ev AS (SELECT region, department, product_id, min(business_day) AS delisted_date FROM sales WHERE business_day >= DATE '2000-03-01' AND discount_percent = 10 GROUP BY ALL)"""
TAGGED = f"""{EVENTS}, es AS (SELECT region, product_id, max(delisted_date) AS sku_event FROM ev GROUP BY 1, 2), eg AS (SELECT region, department, max(delisted_date) AS group_event FROM ev GROUP BY 1, 2),
tg AS (SELECT s.*, CASE WHEN business_day >= sku_event THEN 'Post delist' ELSE 'Pre-delist' END AS period_type, CASE WHEN business_day >= group_event THEN 'Post delist' ELSE 'Pre-delist' END AS group_period_type,
  CASE WHEN business_day >= group_event OR (business_day >= group_event - 364 AND business_day <= DATE '2000-09-30') THEN 'Post delist' ELSE 'Pre-delist' END AS group_period_type_lfl
  FROM sales s LEFT JOIN es USING (region, product_id) LEFT JOIN eg USING (region, department))"""


def tagged(spark, d):
    df = star.sales(spark, d)
    start = F.col("business_day") >= F.lit("2000-03-01").cast("date")
    ev = df.filter(start & (F.col("discount_percent") == 10)).groupBy("region", "department", "product_id").agg(
        F.min("business_day").alias("delisted_date")
    )
    return measurement.tag_periods(df, ev, ["region", "product_id"], ["region", "department"], "business_day", "2000-09-30")


@query("tag_periods", sql(f"""
WITH {TAGGED} SELECT region, period_type, group_period_type, group_period_type_lfl, count(*) AS lines, sum(amount) AS sales FROM tg GROUP BY ALL"""))
def _(spark, d):
    return tagged(spark, d).groupBy("region", "period_type", "group_period_type", "group_period_type_lfl").agg(
        F.count(F.lit(1)).alias("lines"), F.sum("amount").alias("sales")
    )


@query("new_sku_flag", sql(f"""
WITH {TAGGED} SELECT region, product_id, CAST(min(group_period_type) = 'Post delist' AND max(group_period_type) = 'Post delist' AS INTEGER) AS new_sku_flag FROM tg GROUP BY 1, 2"""))
def _(spark, d):
    return measurement.new_sku_flag(tagged(spark, d), "region", "product_id")


@query("adoption", sql(f"""
WITH {WEEKLY}, {LIFE}, t AS (SELECT product_id, sum(amount) AS sales, sum(quantity) AS volume, sum(amount * gp_percent / 100) AS gp FROM ps WHERE {YEAR} GROUP BY 1)
SELECT department, count(*) AS recommended_skus, count(*) FILTER (WHERE life = 'No recent sales') AS delisted_skus, sum(sales) AS recommended_sales, sum(volume) AS recommended_volume, round(sum(gp), 4) AS recommended_gp,
  sum(CASE WHEN life = 'No recent sales' THEN sales ELSE 0 END) AS delisted_sales, sum(CASE WHEN life = 'No recent sales' THEN volume ELSE 0 END) AS delisted_volume,
  round(sum(CASE WHEN life = 'No recent sales' THEN gp ELSE 0 END), 4) AS delisted_gp, count(*) FILTER (WHERE life = 'No recent sales') / count(*) AS adoption
FROM life JOIN t USING (product_id) WHERE life <> 'Currently selling' GROUP BY 1"""))
def _(spark, d):
    life = life_of(weekly(spark, d)).filter(F.col("life") != assortment.SELLING)
    reco = life.select(*KEYS, (F.col("life") == assortment.NO_SALES).cast("int").alias("delisted"))
    s = year_sales(spark, d).withColumn("gp", F.col("amount") * F.col("gp_percent") / 100)
    out = measurement.adoption(reco, s, ["product_id"], ["department"])
    return out.withColumn("recommended_gp", F.round("recommended_gp", 4)).withColumn("delisted_gp", F.round("delisted_gp", 4))


@query("pre_post_rca", sql("""
WITH t AS (SELECT category, business_day BETWEEN DATE '2000-01-01' AND DATE '2000-03-31' AS pre, business_day BETWEEN DATE '2000-04-01' AND DATE '2000-06-30' AS post, business_day, amount, amount * gp_percent / 100 AS gp FROM ps),
s AS (SELECT category, sum(CASE WHEN pre THEN amount ELSE 0 END) AS pre_sales, sum(CASE WHEN pre THEN gp ELSE 0 END) AS pre_gp, count(DISTINCT CASE WHEN pre THEN business_day END) AS pre_days,
  sum(CASE WHEN post THEN amount ELSE 0 END) AS post_sales, sum(CASE WHEN post THEN gp ELSE 0 END) AS post_gp, count(DISTINCT CASE WHEN post THEN business_day END) AS post_days FROM t WHERE pre OR post GROUP BY 1)
SELECT category, pre_sales, round(pre_gp, 4) AS pre_gp, pre_days, post_sales, round(post_gp, 4) AS post_gp, post_days, round(pre_gp / pre_sales, 8) AS pre_margin, pre_sales / pre_days AS pre_ros,
  round(post_gp / post_sales, 8) AS post_margin, post_sales / post_days AS post_ros, round(post_gp / post_sales - pre_gp / pre_sales, 8) AS margin_delta, (post_sales - pre_sales) / pre_sales AS sales_growth,
  round((post_sales / post_days - pre_sales / pre_days) / (pre_sales / pre_days), 8) AS ros_growth FROM s"""))
def _(spark, d):
    df = star.product_sales(spark, d).withColumn("gp", F.col("amount") * F.col("gp_percent") / 100)
    pre, post = (dates.in_period("business_day", *p) for p in (("2000-01-01", "2000-03-31"), ("2000-04-01", "2000-06-30")))
    out = measurement.pre_post_rca(df, ["category"], pre, post)
    for c, n in {"pre_gp": 4, "post_gp": 4, "pre_margin": 8, "post_margin": 8, "margin_delta": 8, "ros_growth": 8}.items():
        out = out.withColumn(c, F.round(c, n))
    return out


PROMO = """
pl AS (SELECT transaction_id, product_id, business_day, discount_amount AS pm_discount_amount, CASE WHEN priority = '1-URGENT' THEN 1 END AS void_flag,
  CASE WHEN discount_percent > 0 THEN CAST(discount_percent AS INTEGER) END AS campaign_id, CASE WHEN priority <> '5-LOW' THEN department END AS pm_campaign_group, category AS pm_reason_code,
  CASE WHEN quantity > 10 THEN CASE WHEN quantity > 40 THEN 'COUNTER_POINT' ELSE 'VOUCHER' END END AS pm_discount_media_type FROM ps),
pk AS (SELECT * FROM pl WHERE void_flag IS NULL AND campaign_id IS NOT NULL AND (pm_campaign_group IS NULL OR pm_campaign_group NOT IN ('PROMO'))
  AND pm_reason_code NOT IN ('bolt') AND (pm_discount_media_type IS NULL OR pm_discount_media_type NOT IN ('VOUCHER')))"""


def promo(spark, d):
    lines = star.product_sales(spark, d).select(
        "transaction_id",
        "product_id",
        "business_day",
        F.col("discount_amount").alias("pm_discount_amount"),
        F.when(F.col("priority") == "1-URGENT", 1).alias("void_flag"),
        F.when(F.col("discount_percent") > 0, F.col("discount_percent").cast("int")).alias("campaign_id"),
        F.when(F.col("priority") != "5-LOW", F.col("department")).alias("pm_campaign_group"),
        F.col("category").alias("pm_reason_code"),
        F.when(F.col("quantity") > 40, "COUNTER_POINT").when(F.col("quantity") > 10, "VOUCHER").alias("pm_discount_media_type"),
    )
    return measurement.promo_lines(lines, ["PROMO"], ["bolt"], ["VOUCHER"])


@query("promo_flag", sql(f"""
WITH {PROMO}, k AS (SELECT DISTINCT business_day, product_id FROM pk)
SELECT CAST(k.product_id IS NOT NULL AS INTEGER) AS promo_flag, count(*) AS lines, sum(amount) AS sales FROM tx LEFT JOIN k USING (business_day, product_id) GROUP BY 1"""))
def _(spark, d):
    out = measurement.promo_flag(star.transactions(spark, d), promo(spark, d))
    return out.groupBy("promo_flag").agg(F.count(F.lit(1)).alias("lines"), F.sum("amount").alias("sales"))


@query("monthly_discounts", sql(f"""
WITH {PROMO}, g AS (SELECT pm_reason_code, year(business_day) * 100 + month(business_day) AS m, pm_campaign_group, sum(CASE WHEN pm_discount_media_type = 'COUNTER_POINT' THEN pm_discount_amount / 400 ELSE pm_discount_amount END) x FROM pk GROUP BY ALL)
SELECT pm_reason_code, CAST(m AS INTEGER) AS month, count(*) AS campaign_groups, round(sum(x), 4) AS discount FROM g GROUP BY 1, 2"""))
def _(spark, d):
    lines = promo(spark, d).withColumn("month", dates.year_month("business_day"))
    out = measurement.monthly_discounts(lines, ["pm_reason_code"], "month", ["COUNTER_POINT"])
    return out.withColumn("discount", F.round("discount", 4))


@query("gp_mismatch", sql("""
WITH s AS (SELECT DISTINCT region, product_id FROM ss), g AS (SELECT region, product_id, max(gp_percent * CASE WHEN content > 28 THEN 3 ELSE 1 END) AS gp_percent
  FROM (SELECT DISTINCT region FROM store) CROSS JOIN product WHERE content <> 7 GROUP BY 1, 2)
SELECT * FROM (SELECT coalesce(s.region, g.region) AS region, coalesce(s.product_id, g.product_id) AS product_id, gp_percent,
  CASE WHEN g.product_id IS NULL THEN 'no profit entry' WHEN s.product_id IS NULL THEN 'no sales' WHEN gp_percent > 100 THEN 'profit above sales' END AS issue
  FROM s FULL JOIN g ON s.region = g.region AND s.product_id = g.product_id) WHERE issue IS NOT NULL"""))
def _(spark, d):
    regions = star.stores(spark, d).select("region").distinct().agg(F.collect_set("region").alias("r"))
    gp = star.products(spark, d).filter("content <> 7").crossJoin(F.broadcast(regions)).select(
        F.explode("r").alias("region"), "product_id",
        (F.col("gp_percent") * F.when(F.col("content") > 28, 3).otherwise(1)).alias("gp_percent"),
    )
    return measurement.gp_mismatch(star.store_sales(spark, d), gp, ["region", "product_id"])
