from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tillmark.sources import readers, writers


@pytest.fixture
def name(spark):
    table = "t_" + __import__("uuid").uuid4().hex[:8]
    yield table
    writers.drop_table(spark, table)


def test_csv_round_trip_and_stacking(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, None)], "k int, v string")
    for part in ("x", "y"):
        writers.write_csv(df, str(tmp_path / part))
    one = readers.read_csv(spark, str(tmp_path / "x"), df.schema)
    both = readers.read_many(spark, [str(tmp_path / p) for p in ("x", "y")], df.schema)
    assert sorted(r["k"] for r in one.collect()) == [1, 2] and both.count() == 4
    assert readers.load(spark, str(tmp_path / "x"), "csv").count() >= 2


def test_empty_rows_go(spark):
    df = readers.inline(spark, [(None, None), (1, None)], "a int, b int")
    assert readers.drop_empty_rows(df).count() == 1


def test_append_is_idempotent(spark, name):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    assert writers.append_if_absent(df, name, ["k"]) == 2
    assert writers.append_if_absent(df, name, ["k"]) == 0
    more = spark.createDataFrame([(2, "z"), (3, "c")], "k int, v string")
    assert writers.append_if_absent(more, name, ["k"]) == 1
    assert {tuple(r) for r in spark.table(name).collect()} == {(1, "a"), (2, "b"), (3, "c")}


def test_update_delete_and_slices(spark, name):
    df = spark.createDataFrame([(1, "a", "p"), (2, "b", "q")], "k int, v string, part string")
    writers.save_table(df, name, partition_by=["part"])
    writers.replace_slice(spark.createDataFrame([(9, "n", "q")], df.schema), name, ["part"])
    assert {tuple(r) for r in spark.table(name).collect()} == {(1, "a", "p"), (9, "n", "q")}
    writers.update_table(name, spark.createDataFrame([(1, "A")], "k int, v string"), ["k"], ["v"])
    assert {r["v"] for r in spark.table(name).collect()} == {"A", "n"}
    writers.delete_slice(name, spark, "part = 'q'")
    assert [r["k"] for r in spark.table(name).collect()] == [1]


def test_buckets_spare_the_join_its_shuffle(spark, name):
    df = spark.range(100).withColumn("v", F.col("id") * 2)
    writers.save_table(df, name, bucket_by=(4, ["id"]))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        t = spark.table(name)
        plan = t.join(t.withColumnRenamed("v", "w"), "id")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "Exchange" not in plan
