"""Tables written, appended to and rewritten, files read back, and the cleaning of columns and rows."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillmark.functions import exprs
from tillmark.operators import joins, metrics
from tillmark.plans import star
from tillmark.plans.registry import query
from tillmark.plans.star import sql
from tillmark.session import stage, stage_root
from tillmark.sources import readers, writers


def _place(spark, name: str) -> str:
    return f"{stage_root(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


class _Table:
    """A table of a name of its own, dropped when its content has been taken."""

    def __init__(self, spark):
        self.spark, self.name = spark, f"upkeep_{uuid.uuid4().hex}"

    def __enter__(self) -> str:
        writers.drop_table(self.spark, self.name)
        return self.name

    def __exit__(self, *_):
        writers.drop_table(self.spark, self.name)


YEARLY = "ye AS (SELECT year(business_day) AS year, brand, sum(amount) AS sales, sum(quantity) AS quantity FROM ps GROUP BY 1, 2)"


def yearly(spark, d):
    return star.product_sales(spark, d).groupBy(F.year("business_day").cast("long").alias("year"), "brand").agg(
        F.sum("amount").alias("sales"), F.sum("quantity").alias("quantity")
    )


@query("derived_table", sql(f"WITH {YEARLY} SELECT year, count(*) AS brands, sum(sales) AS sales FROM ye GROUP BY 1"))
def _(spark, d):
    """A table created, replaced by what a query gives, read by name and through a view."""
    with _Table(spark) as name:
        writers.create_table(spark, name, "year BIGINT, brand STRING, sales DOUBLE, quantity DOUBLE")
        writers.save_table(yearly(spark, d), name)
        view = f"v_{name}"
        writers.temp_view(readers.load(spark, name), view)
        out = stage(spark.sql(f"SELECT year, count(*) AS brands, sum(sales) AS sales FROM {view} GROUP BY year"))
        spark.catalog.dropTempView(view)
    return out


@query("table_formats", sql(f"WITH {YEARLY} SELECT f.format, year, brand, sales, quantity FROM ye, (VALUES ('orc'), ('parquet')) f(format)"))
def _(spark, d):
    """The same table in two formats."""
    rows, parts = stage(yearly(spark, d)), []
    for fmt in ("orc", "parquet"):
        with _Table(spark) as name:
            writers.save_table(rows, name, fmt=fmt, partition_by=["year"])
            parts.append(stage(spark.table(name).select(F.lit(fmt).alias("format"), F.col("year").cast("long").alias("year"), "brand", "sales", "quantity")))
    return parts[0].unionByName(parts[1])


@query("appended_results", sql(f"WITH {YEARLY} SELECT * FROM ye UNION ALL SELECT year + 100, brand, sales, quantity FROM ye WHERE year = 1995"))
def _(spark, d):
    """A master table that results are appended to: plainly, and only where their keys are not there yet."""
    rows = stage(yearly(spark, d))
    with _Table(spark) as name:
        writers.append_if_absent(rows.filter("year < 1999"), name, ["year", "brand"])
        writers.append_if_absent(rows.filter("year >= 1997"), name, ["year", "brand"])  # overlaps
        if writers.append_if_absent(rows, name, ["year", "brand"]):
            raise AssertionError("a rerun added rows")
        late = rows.filter("year = 1995").withColumn("year", F.col("year") + 100)
        writers.save_table(late, name, mode="append")
        return stage(spark.table(name))


@query("updated_rows", sql(f"""
WITH {YEARLY} SELECT year, brand, CASE WHEN brand IN ('Brand#1', 'Brand#2') AND year >= 2000 THEN 0.0 ELSE sales END AS sales, quantity FROM ye"""))
def _(spark, d):
    """Rows of a table overridden by key."""
    rows = stage(yearly(spark, d))
    changes = rows.filter(F.col("brand").isin("Brand#1", "Brand#2") & (F.col("year") >= 2000)).select("year", "brand", F.lit(0.0).alias("sales"))
    with _Table(spark) as name:
        writers.save_table(rows, name)
        writers.update_table(name, changes, ["year", "brand"], ["sales"])
        return stage(spark.table(name))


@query("replaced_slices", sql(f"""
WITH {YEARLY} SELECT brand, sales, quantity, year FROM ye WHERE year NOT IN (1996, 1998) UNION ALL SELECT brand, sales * 2, quantity, year FROM ye WHERE year = 1998"""))
def _(spark, d):
    """One slice of a partitioned table loaded anew, another one deleted."""
    rows = stage(yearly(spark, d).select("brand", "sales", "quantity", "year"))
    with _Table(spark) as name:
        writers.save_table(rows, name, partition_by=["year"])
        writers.replace_slice(rows.filter("year = 1998").withColumn("sales", F.col("sales") * 2), name, ["year"])
        writers.delete_slice(name, spark, "year = 1996")
        return stage(spark.table(name))


PART = "p_partkey BIGINT, p_name STRING, p_brand STRING, p_type STRING, p_size INT, p_retailprice DOUBLE"


@query("csv_round_trip", """
SELECT p_brand, count(*) AS parts, count(CASE WHEN p_size % 7 > 0 THEN 1 END) AS sized, round(avg(p_retailprice), 6) AS mean_price, CAST(sum(CASE WHEN p_size % 7 > 0 THEN p_size END) AS BIGINT) AS sizes, min(p_name) AS first_name FROM part GROUP BY 1""")
def _(spark, d):
    """A table written as CSV and read under its schema, missing values being written as NA."""
    path = _place(spark, "csv")
    size = F.when(F.col("p_size") % 7 > 0, F.col("p_size")).cast("string")
    writers.write_csv(star.table(spark, d, "part").withColumn("p_size", F.coalesce(size, F.lit("NA"))), path)
    back = readers.read_csv(spark, path, T._parse_datatype_string(PART), nullValue="NA")
    return back.groupBy("p_brand").agg(
        F.count(F.lit(1)).alias("parts"), F.count("p_size").alias("sized"), F.round(F.avg("p_retailprice"), 6).alias("mean_price"), F.sum("p_size").alias("sizes"), F.min("p_name").alias("first_name")
    )


@query("stacked_files", "SELECT c_mktsegment AS segment, count(*) AS customers, round(sum(c_acctbal), 4) AS balance FROM customer GROUP BY 1")
def _(spark, d):
    """One file for each segment, with empty rows in them, read as one frame without these."""
    people = star.table(spark, d, "customer").select("c_custkey", "c_mktsegment", "c_acctbal")
    blank = people.select(*(F.lit(None).cast(t).alias(c) for c, t in people.dtypes)).limit(3)
    segments = [r[0] for r in people.select("c_mktsegment").distinct().orderBy("c_mktsegment").collect()]
    root, paths = _place(spark, "sheets"), []
    for k, segment in enumerate(segments):
        paths.append(f"{root}/{k}")
        writers.write_csv(people.filter(F.col("c_mktsegment") == segment).unionByName(blank), paths[-1])
    rows = readers.drop_empty_rows(readers.read_many(spark, paths, people.schema, ignoreLeadingWhiteSpace=True))
    return rows.groupBy(F.col("c_mktsegment").alias("segment")).agg(F.count(F.lit(1)).alias("customers"), F.round(F.sum("c_acctbal"), 4).alias("balance"))


@query("finite_values", """
SELECT event_id, CASE WHEN event_id % 5 = 0 THEN 0.0 WHEN event_id % 7 = 0 THEN 0.0 WHEN event_id % 11 = 0 THEN 0.0 ELSE value END AS value FROM events""")
def _(spark, d):
    """Infinite, undefined and missing values become 0."""
    e = star.table(spark, d, "events")
    odd = F.when(F.col("event_id") % 5 == 0, float("inf")).when(F.col("event_id") % 7 == 0, float("nan")).when(F.col("event_id") % 11 != 0, F.col("value"))
    return e.select("event_id", exprs.finite(odd).alias("value"))


@query("text_numbers", "SELECT event_id, TRY_CAST(CASE WHEN event_id % 7 = 0 THEN NULL WHEN event_id % 5 = 0 THEN NULL ELSE trim(' ' || value || ' ') END AS DOUBLE) AS number, nullif(event_type, 'view') AS event_type FROM events")
def _(spark, d):
    """Numbers out of text that may be none, and a code that stands for a missing value."""
    e = star.table(spark, d, "events")
    text = F.when(F.col("event_id") % 7 == 0, "n/a").when(F.col("event_id") % 5 == 0, "").otherwise(F.concat(F.lit(" "), F.col("value").cast("string"), F.lit(" ")))
    return e.select("event_id", exprs.to_number(text).alias("number"), F.nullif("event_type", F.lit("view")).alias("event_type"))


@query("pack_texts", """
SELECT p_partkey, CASE WHEN p_partkey % 3 > 0 THEN p_size ELSE 1 END AS pieces, p_partkey % 9 + 1.5 AS volume, CASE WHEN p_partkey % 2 = 0 THEN 'KG' ELSE 'OZ' END AS unit,
  round((p_partkey % 9 + 1.5) * CASE WHEN p_partkey % 2 = 0 THEN 1000.0 ELSE 28.3495 END, 6) AS grams, upper(p_name[1]) || split_part(p_name[2:], ' ', 1) || ' ' || upper(split_part(p_name, ' ', 2)[1]) || split_part(p_name, ' ', 2)[2:] AS label FROM part""")
def _(spark, d):
    """Pieces, content and unit of pack texts, the content in grams, and labels in title case."""
    part = star.table(spark, d, "part")
    unit = F.when(F.col("p_partkey") % 2 == 0, " kg").otherwise("oz")
    size = F.concat((F.col("p_partkey") % 9 + 1).cast("string"), F.lit(".5"), unit)
    text = F.when(F.col("p_partkey") % 3 > 0, F.concat(F.col("p_size").cast("string"), F.lit("x"), size)).otherwise(size)
    rows = part.select("p_partkey", exprs.pack_count(text).alias("pieces"), exprs.pack_volume(text).alias("volume"), exprs.pack_unit(text).alias("unit"), exprs.title_case(F.translate("p_name", " ", "-")).alias("label"))
    return rows.withColumn("grams", F.round(exprs.convert_units("volume", "unit"), 6))


@query("business_keys", sql("""
WITH k AS (SELECT region || '|' || brand AS key, sum(amount) AS s FROM sales GROUP BY 1), w AS (SELECT key FROM k ORDER BY s DESC, key LIMIT 10)
SELECT region || '|' || brand AS key, count(*) AS lines, sum(amount) AS sales FROM sales WHERE (region || '|' || brand) IN (SELECT key FROM w) GROUP BY 1"""))
def _(spark, d):
    """Lines of the ten (region, brand) with most sales, by a composite key."""
    df = star.sales(spark, d).withColumn("key", exprs.business_key("region", "brand"))
    cells = stage(df.groupBy("key").agg(F.count(F.lit(1)).alias("lines"), F.sum("amount").alias("sales")))
    top = cells.orderBy(F.desc("sales"), "key").limit(10)
    return joins.join_keys(cells, top.select("key"), ["key"], "left_semi")


@query("one_row_per_key", sql("""
SELECT customer_id, transaction_id, business_day FROM (SELECT customer_id, transaction_id, business_day, row_number() OVER (PARTITION BY customer_id ORDER BY business_day DESC, transaction_id) AS k FROM receipts) WHERE k = 1"""))
def _(spark, d):
    """Each customer's latest receipt."""
    r = star.receipts(spark, d).select("customer_id", "transaction_id", "business_day")
    return metrics.dedupe(r, ["customer_id"], [F.desc("business_day"), F.col("transaction_id")])


@query("required_keys", "SELECT event_type, count(*) AS events, round(sum(value - 5), 4) AS total FROM events WHERE user_id % 10 <> 0 AND value - 5 >= 0 GROUP BY 1")
def _(spark, d):
    """Events of known users whose value is not negative."""
    e = star.table(spark, d, "events")
    e = e.select("event_type", F.when(F.col("user_id") % 10 != 0, F.col("user_id")).alias("user_id"), (F.col("value") - 5).alias("value"))
    rows = metrics.require_keys(e, ["user_id"], ["value"])
    return rows.groupBy("event_type").agg(F.count(F.lit(1)).alias("events"), F.round(F.sum("value"), 4).alias("total"))


@query("varying_columns", "SELECT p_brand AS brand, p_partkey AS part_id, p_size AS size FROM part")
def _(spark, d):
    """Columns without a second value dropped, the others renamed and put in another order."""
    part = star.table(spark, d, "part").select("p_partkey", F.lit("EUR").alias("p_currency"), "p_size", F.lit(None).cast("string").alias("p_note"), "p_brand")
    kept = metrics.drop_constant_columns(part, keep=["p_partkey"])
    renamed = kept.withColumnsRenamed({c: c.removeprefix("p_").replace("partkey", "part_id") for c in kept.columns})
    return renamed.select(*sorted(renamed.columns))
