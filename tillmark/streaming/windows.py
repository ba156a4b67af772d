"""Windowed metrics over an event stream.

Every function takes a streaming (or batch) frame with an event time column and returns the transformed
frame; the caller chooses sink, trigger and checkpoint folder. Windows and sessions are meant for append mode: each is returned once, when the
watermark (the latest event time seen, less the delay) has passed its end, and its state is dropped then, so that state is bounded by the
delay and not by the length of the stream. Events of a window that is closed already no longer count; :func:`late_rows` keeps them for a correction.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillmark.session import stage_root


def window_kpis(events: DataFrame, by: Sequence[str], length: str, slide: str | None = None, delay: str = "1 hour", time: str = "ts", value: str = "value") -> DataFrame:
    """Events, value and mean value per tumbling (or sliding) window.

    In append mode a window comes out once the watermark has passed its end; events that arrive later are left out.
    """
    out = events.withWatermark(time, delay).groupBy(F.window(time, length, slide or length), *by).agg(
        F.count(F.lit(1)).alias("events"), F.sum(value).alias("total"), F.avg(value).alias("mean")
    )
    return out.select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), *by, "events", "total", "mean")


def session_kpis(events: DataFrame, user: str, gap: str, delay: str = "1 hour", time: str = "ts", value: str = "value") -> DataFrame:
    """Events and value per session, a session ending after ``gap`` without an event of the user.

    In append mode a session comes out once the watermark has passed its end. An event older than the watermark by the gap starts no session.
    """
    out = events.withWatermark(time, delay).groupBy(user, F.session_window(time, gap)).agg(
        F.count(F.lit(1)).alias("events"), F.sum(value).alias("total")
    )
    return out.select(user, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "events", "total")


def first_seen(events: DataFrame, keys: Sequence[str], delay: str = "1 hour", time: str = "ts") -> DataFrame:
    """First occurrence of each key, repeats within the watermark being dropped."""
    return events.withWatermark(time, delay).dropDuplicatesWithinWatermark(list(keys))


def late_rows(events: DataFrame, length: str, delay: str = "1 hour", time: str = "ts") -> DataFrame:
    """The events of a stream that came after their window was closed, as a table in the shared folder.

    The rule is that of :func:`window_kpis`: an event is late when its window's end is not after the watermark that the batches before its own
    have left. Each batch notes its latest time in a table of one row per batch, and a batch that is run again replaces what it wrote before.
    """
    spark = events.sparkSession
    root = f"{stage_root(spark).rstrip('/')}/late-{uuid.uuid4().hex}"
    seen = f"{root}/seen"

    def each(batch: DataFrame, number: int) -> None:
        batch.agg(F.max(time).alias("latest")).withColumn("number", F.lit(number).cast("long")).write.mode("overwrite").parquet(f"{seen}/batch={number}")
        before = spark.read.schema("latest timestamp, number long").option("recursiveFileLookup", "true").parquet(seen).filter(F.col("number") < number)
        mark = before.agg((F.max("latest") - F.expr(f"INTERVAL {delay}")).alias("__mark"))  # one row
        late = batch.crossJoin(F.broadcast(mark)).filter(F.window(time, length)["end"] <= F.col("__mark")).drop("__mark")
        late.write.mode("overwrite").parquet(f"{root}/out/batch={number}")

    events.writeStream.trigger(availableNow=True).option("checkpointLocation", f"{root}/checkpoint").foreachBatch(each).start().awaitTermination()
    return spark.read.schema(events.schema).option("recursiveFileLookup", "true").parquet(f"{root}/out")


def file_stream(
    spark: SparkSession, folder: str, schema: T.StructType, pattern: str | None = None, files_per_batch: int | None = None
) -> DataFrame:
    """Parquet files arriving in a folder, optionally those matching a glob pattern."""
    reader = spark.readStream.schema(schema)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(folder)


def run_once(df: DataFrame, mode: str, progress: list | None = None) -> DataFrame:
    """Process what is there and return the result as a table in the shared folder.

    Complete results replace each other per batch; appended rows go to the file sink. ``progress`` receives, per batch, the rows held
    as state and the rows dropped as too late.
    """
    spark = df.sparkSession
    root = f"{stage_root(spark).rstrip('/')}/stream-{uuid.uuid4().hex}"
    writer = df.writeStream.trigger(availableNow=True).option("checkpointLocation", f"{root}/checkpoint")
    if mode == "append":
        query = writer.outputMode("append").format("parquet").option("path", f"{root}/out").start()
    else:
        query = writer.outputMode(mode).foreachBatch(
            lambda batch, _: batch.write.mode("overwrite").parquet(f"{root}/out")
        ).start()
    query.awaitTermination()
    if progress is not None:
        for batch in query.recentProgress:
            states = batch.stateOperators
            progress.append((sum(s.numRowsTotal for s in states), sum(s.numRowsDroppedByWatermark for s in states)))
    return spark.read.schema(df.schema).parquet(f"{root}/out")
