"""Table and file sources. Schemas are declared, never inferred from the data."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def load(spark: SparkSession, name_or_path: str, fmt: str = "parquet") -> DataFrame:
    """A catalog table by name, or files by path (anything with a slash)."""
    if "/" in name_or_path:
        return spark.read.format(fmt).load(name_or_path)
    return spark.table(name_or_path)


def read_csv(spark: SparkSession, path: str | Sequence[str], schema: T.StructType, **options) -> DataFrame:
    """CSV with a header under a declared schema; a malformed value becomes NULL."""
    paths = [path] if isinstance(path, str) else list(path)
    return spark.read.options(header=True, enforceSchema=False, mode="PERMISSIVE", **options).schema(schema).csv(paths)


def read_many(spark: SparkSession, paths: Sequence[str], schema: T.StructType, **options) -> DataFrame:
    """Several files of one schema (sheets saved one by one, say) as one frame, in one scan."""
    return read_csv(spark, paths, schema, **options)


def drop_empty_rows(df: DataFrame) -> DataFrame:
    return df.na.drop(how="all")


def inline(spark: SparkSession, rows: Sequence[tuple], schema: T.StructType | str) -> DataFrame:
    """A small relation written in the program."""
    return spark.createDataFrame(list(rows), schema)
