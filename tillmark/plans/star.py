"""The retail star over the test tables.

Amounts are whole cents held in doubles: sums of whole numbers are exact whatever the order of
addition, so a result does not depend on how the rows were spread.

``l_returnflag`` plays the transaction type, ``p_brand`` the brand (Brand#1 the house brand),
``p_type`` the department, the second word of ``p_name`` the category, ``p_name`` the material group,
the supplier the store, its region the region, ``c_mktsegment`` the customer segment.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillmark.functions.exprs import map_values
from tillmark.operators.joins import star
from tillmark.operators.metrics import SALE_TYPES, valid_sales

# Return flag to transaction type.
TRANSACTION_TYPES = {"N": "SALE", "A": "SELL_MEDIA", "R": "RETURN"}


# Declared, so that building a query opens no file.
SCHEMAS = {
    "region": "r_regionkey INT, r_name STRING",
    "nation": "n_nationkey INT, n_name STRING, n_regionkey INT",
    "customer": "c_custkey BIGINT, c_name STRING, c_nationkey INT, c_acctbal DOUBLE, c_mktsegment STRING",
    "supplier": "s_suppkey BIGINT, s_name STRING, s_nationkey INT, s_acctbal DOUBLE",
    "part": "p_partkey BIGINT, p_name STRING, p_brand STRING, p_type STRING, p_size INT, p_retailprice DOUBLE",
    "orders": "o_orderkey BIGINT, o_custkey BIGINT, o_orderstatus STRING, o_totalprice DOUBLE, "
    "o_orderdate TIMESTAMP_NTZ, o_orderpriority STRING",
    "lineitem": "l_orderkey BIGINT, l_partkey BIGINT, l_suppkey BIGINT, l_linenumber INT, l_quantity DOUBLE, "
    "l_extendedprice DOUBLE, l_discount DOUBLE, l_tax DOUBLE, l_returnflag STRING, l_linestatus STRING, "
    "l_shipdate TIMESTAMP_NTZ",
    "events": "event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT, event_type STRING, value DOUBLE, props STRING",
}


#: Bytes of the line file for each task of the join with the receipts, and how many tasks make it worth dealing.
TASK_BYTES = 4 << 20
LEAST_TASKS = 16


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{folder}/{name}.parquet")


def whole(value):
    """Nearest whole number of a positive value; ``round`` on doubles goes through decimals and is slower."""
    return F.floor(value + 0.5).cast("double")


def lines(spark: SparkSession, d: str, flags: tuple[str, ...] = tuple(TRANSACTION_TYPES)) -> DataFrame:
    """Receipt lines without the receipt header; the flags wanted are filtered at the scan."""
    gross = whole(F.col("l_extendedprice") * 100)
    percent = whole(F.col("l_discount") * 100)
    amount = whole(gross * (F.lit(100.0) - percent) / 100)
    raw = table(spark, d, "lineitem").filter(F.col("l_returnflag").isin(*flags))
    return raw.select(
        F.col("l_orderkey").alias("transaction_id"),
        F.col("l_partkey").alias("product_id"),
        F.col("l_suppkey").alias("store_id"),
        F.col("l_quantity").alias("quantity"),
        gross.alias("gross_amount"),
        amount.alias("amount"),
        (gross - amount).alias("discount_amount"),
        percent.alias("discount_percent"),
        map_values("l_returnflag", TRANSACTION_TYPES).alias("transaction_type"),
    )


def receipts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select(
        F.col("o_orderkey").alias("transaction_id"),
        F.col("o_custkey").alias("customer_id"),
        F.col("o_orderdate").cast("date").alias("business_day"),
        F.col("o_orderpriority").alias("priority"),
        whole(F.col("o_totalprice") * 100).alias("billed_amount"),
    )


def with_header(sold: DataFrame, d: str) -> DataFrame:
    """Lines with their receipt header. Large tables are dealt to tasks by their size, so that what a task sorts and
    aggregates behind this join does not grow with them; small ones are left to Spark."""
    spark = sold.sparkSession
    place = spark._jvm.org.apache.hadoop.fs.Path(f"{d}/lineitem.parquet")
    size = place.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(place).getLength()
    tasks, header = size // TASK_BYTES, receipts(spark, d)
    if tasks >= LEAST_TASKS:
        sold, header = (df.repartition(tasks, "transaction_id") for df in (sold, header))
    return sold.join(header, "transaction_id")


def all_transactions(spark: SparkSession, d: str) -> DataFrame:
    return with_header(lines(spark, d), d)


def transactions(spark: SparkSession, d: str) -> DataFrame:
    """Valid sales with their header. Filtered before the join, so the filter reaches the scan."""
    sold = tuple(f for f, t in TRANSACTION_TYPES.items() if t in SALE_TYPES)
    return with_header(valid_sales(lines(spark, d, sold)), d)


def products(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select(
        F.col("p_partkey").alias("product_id"),
        F.col("p_name").alias("material_group"),
        F.split("p_name", " ")[1].alias("category"),
        F.col("p_type").alias("department"),
        F.col("p_brand").alias("brand"),
        F.col("p_size").cast("double").alias("content"),
        (F.col("p_size") % 30 + 10).cast("double").alias("gp_percent"),
        (F.col("p_brand") == "Brand#1").cast("int").alias("own_label"),
    )


def stores(spark: SparkSession, d: str) -> DataFrame:
    s, n, r = (table(spark, d, t) for t in ("supplier", "nation", "region"))
    return s.join(n, F.col("s_nationkey") == F.col("n_nationkey")).join(
        r, F.col("n_regionkey") == F.col("r_regionkey")
    ).select(F.col("s_suppkey").alias("store_id"), F.col("r_name").alias("region"), F.col("n_name").alias("city"))


def customers(spark: SparkSession, d: str) -> DataFrame:
    c, n = table(spark, d, "customer"), table(spark, d, "nation")
    return c.join(n, F.col("c_nationkey") == F.col("n_nationkey")).select(
        F.col("c_custkey").alias("customer_id"),
        F.col("c_mktsegment").alias("segment"),
        F.col("n_name").alias("nationality"),
        F.col("c_acctbal").alias("balance"),
    )


def sales(spark: SparkSession, d: str) -> DataFrame:
    """Valid sales with product and store columns."""
    return star(transactions(spark, d), products(spark, d), stores(spark, d))


def product_sales(spark: SparkSession, d: str) -> DataFrame:
    return transactions(spark, d).join(products(spark, d), "product_id")


def store_sales(spark: SparkSession, d: str) -> DataFrame:
    return transactions(spark, d).join(stores(spark, d), "store_id")


def segment_sales(spark: SparkSession, d: str) -> DataFrame:
    return transactions(spark, d).join(customers(spark, d), "customer_id")


CTES = """
lines AS (
  SELECT l_orderkey AS transaction_id, l_partkey AS product_id, l_suppkey AS store_id, l_quantity AS quantity,
         floor(l_extendedprice * 100 + 0.5) AS gross_amount,
         floor(floor(l_extendedprice * 100 + 0.5) * (100.0 - floor(l_discount * 100 + 0.5)) / 100 + 0.5) AS amount,
         floor(l_discount * 100 + 0.5) AS discount_percent,
         CASE l_returnflag WHEN 'N' THEN 'SALE' WHEN 'A' THEN 'SELL_MEDIA' WHEN 'R' THEN 'RETURN' END AS transaction_type
  FROM lineitem),
receipts AS (
  SELECT o_orderkey AS transaction_id, o_custkey AS customer_id, CAST(o_orderdate AS DATE) AS business_day,
         o_orderpriority AS priority, floor(o_totalprice * 100 + 0.5) AS billed_amount
  FROM orders),
all_tx AS (
  SELECT lines.*, gross_amount - amount AS discount_amount, customer_id, business_day, priority, billed_amount
  FROM lines JOIN receipts USING (transaction_id)),
tx AS (
  SELECT * FROM all_tx WHERE transaction_type IN ('SALE', 'SELL_MEDIA') AND amount > 0 AND quantity > 0),
product AS (
  SELECT p_partkey AS product_id, p_name AS material_group, split_part(p_name, ' ', 2) AS category,
         p_type AS department, p_brand AS brand, CAST(p_size AS DOUBLE) AS content,
         CAST(p_size % 30 + 10 AS DOUBLE) AS gp_percent, CAST(p_brand = 'Brand#1' AS INTEGER) AS own_label
  FROM part),
store AS (
  SELECT s_suppkey AS store_id, r_name AS region, n_name AS city
  FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
cust AS (
  SELECT c_custkey AS customer_id, c_mktsegment AS segment, n_name AS nationality, c_acctbal AS balance
  FROM customer JOIN nation ON c_nationkey = n_nationkey),
ps AS (SELECT tx.*, material_group, category, department, brand, content, gp_percent, own_label
       FROM tx JOIN product USING (product_id)),
ss AS (SELECT tx.*, region, city FROM tx JOIN store USING (store_id)),
cs AS (SELECT tx.*, segment, nationality, balance FROM tx JOIN cust USING (customer_id)),
sales AS (SELECT ps.*, region, city FROM ps JOIN store USING (store_id))"""


def sql(body: str) -> str:
    """SQL over the star: ``body`` is a SELECT, or further CTEs followed by one (starting with WITH)."""
    text = body.strip()
    if text[:15].upper() == "WITH RECURSIVE ":
        return f"WITH RECURSIVE {CTES},\n{text[15:]}"
    if text[:5].upper() == "WITH ":
        return f"WITH {CTES},\n{text[5:]}"
    return f"WITH {CTES}\n{text}"
