"""Session settings and the shared folder used to cut lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Tables written by each application, by its id.
_staged: dict[str, list[str]] = {}

RECOMMENDED = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(app_name: str = "tillmark", master: str | None = None, **conf) -> SparkSession:
    """Session with adaptive execution on; partition counts are left to the cluster unless given."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in {**RECOMMENDED, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def stage_root(spark: SparkSession) -> str:
    """The folder shared by the executors; only a local session may fall back to a temporary one."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    folder = tempfile.mkdtemp(prefix="tillmark-stage-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def stage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and return a scan of it.

    Used where one aggregated frame feeds several branches (totals and rows, say), so that the fact
    table behind it is read once, and to end the lineage of a loop. The files outlive lost executors.
    """
    if getattr(df, "_staged", False):
        return df
    spark = df.sparkSession
    path = f"{stage_root(spark).rstrip('/')}/stage-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _staged.setdefault(spark.sparkContext.applicationId, []).append(path)
    written = spark.read.schema(df.schema).parquet(path)
    written._staged = True  # a second call for the same frame writes nothing
    return written


def release_stages(spark: SparkSession) -> int:
    """Delete what :func:`stage` has written in this application so far; frames that still read it are to be used up before.

    A query's result is lazy and reads staged tables until it is written, so only the caller knows when they may go: after a report, or between
    queries of a long session. Returns the number of tables deleted.
    """
    paths = _staged.pop(spark.sparkContext.applicationId, [])
    for path in paths:
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
    return len(paths)
