"""Table and file sinks."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillmark.operators.joins import join_keys, override_values
from tillmark.session import stage, stage_root


def save_table(
    df: DataFrame,
    name: str,
    mode: str = "overwrite",
    fmt: str = "parquet",
    partition_by: Sequence[str] = (),
    bucket_by: tuple[int, Sequence[str]] | None = None,
) -> None:
    """Create, replace or append to a managed table.

    Rows are clustered by the partition columns before the write, so each task writes few files; adaptive
    execution splits a partition value that holds much of the data. Bucketing spares later joins on the
    bucket columns their shuffle. ``fmt='delta'`` works where its library is on the class path.
    """
    out = df.hint("rebalance", *partition_by) if partition_by and not bucket_by else df
    writer = out.write.mode(mode).format(fmt)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if bucket_by:
        writer = writer.bucketBy(bucket_by[0], *bucket_by[1]).sortBy(*bucket_by[1])
    writer.saveAsTable(name)


def table_exists(spark: SparkSession, name: str) -> bool:
    return spark.catalog.tableExists(name)


def drop_table(spark: SparkSession, name: str) -> None:
    spark.sql(f"DROP TABLE IF EXISTS {name}")


def create_table(spark: SparkSession, name: str, ddl: str, fmt: str = "parquet") -> None:
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({ddl}) USING {fmt}")


def append_if_absent(df: DataFrame, name: str, keys: Sequence[str]) -> int:
    """Append the rows whose key the table does not hold yet; returns how many. A rerun adds nothing.

    The new rows are written to the shared folder first: they are read off the table they go to.
    """
    spark = df.sparkSession
    if not table_exists(spark, name):
        fresh = stage(df)
        save_table(fresh, name, "errorifexists")
        return fresh.count()
    present = spark.table(name).select(*keys).distinct()
    fresh = stage(join_keys(df, present, keys, "left_anti"))
    added = fresh.count()
    if added:
        columns = spark.table(name).columns
        fresh.select(*columns).write.mode("append").insertInto(name)
    return added


def _overwrite(df: DataFrame, name: str, mode: str) -> None:
    """Rewrite a table, all of it (``static``) or only the partitions with rows (``dynamic``), whatever the session's setting.

    insertInto takes the mode from its session only. The rows go to the shared folder first (they are read off the table
    they go to) and from there through a session with settings of its own, so queries that run meanwhile see no change.
    """
    spark = df.sparkSession
    path = f"{stage_root(spark).rstrip('/')}/rewrite-{uuid.uuid4().hex}"
    df.write.parquet(path)
    own = spark.newSession()
    own.conf.set("spark.sql.sources.partitionOverwriteMode", mode)
    own.catalog.setCurrentDatabase(spark.catalog.currentDatabase())
    own.read.schema(df.schema).parquet(path).write.mode("overwrite").insertInto(name)
    spark.catalog.refreshTable(name)


def update_table(name: str, overrides: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> None:
    """UPDATE by rewrite: overridden values replace those of the table."""
    spark = overrides.sparkSession
    changed = override_values(spark.table(name), overrides, keys, columns)
    _overwrite(changed.select(*spark.table(name).columns), name, "static")


def replace_slice(df: DataFrame, name: str, partition_by: Sequence[str]) -> None:
    """Replace only the partitions of the table that ``df`` has rows for."""
    _overwrite(df.select(*df.sparkSession.table(name).columns), name, "dynamic")


def delete_slice(name: str, spark: SparkSession, condition: str) -> None:
    """DELETE by rewrite for tables without it; partitions left without rows go."""
    _overwrite(spark.table(name).filter(~F.coalesce(F.expr(condition), F.lit(False))), name, "static")


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """CSV files with a header, written by the tasks in parallel."""
    df.write.mode(mode).option("header", True).csv(path)


def temp_view(df: DataFrame, name: str) -> DataFrame:
    df.createOrReplaceTempView(name)
    return df
