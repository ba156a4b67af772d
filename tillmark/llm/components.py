"""Connected components by repeated propagation of the smallest label."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillmark.llm.store import drop, keep


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Columns node and root: for each node of an edge the smallest node that it reaches.

    Each round joins every node to the smallest node next to it and keeps, instead of the edges between
    neighbours, edges to that smallest one (large-star and small-star in turn); the number of rounds grows with the logarithm
    of the longest path. Rounds end when a round changes no edge. Each is a table in the shared folder, so
    a lost executor costs one round at most. Neighbours are never gathered in a list: both
    operations are a minimum by key and a join, and a node of very many edges is split by the skew join.
    Null ends and loops are no edges. An empty input gives an empty result.
    """
    now = keep(edges.select(F.least(a, b).alias("lo"), F.greatest(a, b).alias("hi")).where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))).distinct(), "edges")
    state = None
    while True:
        starred = _small_star(_large_star(now))
        after = keep(starred, "edges")
        drop(now)
        now = after
        found = now.agg(F.count("*"), F.sum(F.xxhash64("lo", "hi").cast("decimal(38,0)"))).first()
        if tuple(found) == state:
            break
        state = tuple(found)
    # all edges are stars now: hi -> lo
    return now.select(F.col("hi").alias("node"), F.col("lo").alias("root")).unionByName(now.select(F.col("lo").alias("node"), F.col("lo").alias("root")).distinct())


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is linked to the smallest of the node and its neighbours."""
    both = edges.unionByName(edges.select(F.col("hi").alias("lo"), F.col("lo").alias("hi"))).withColumnsRenamed({"lo": "u", "hi": "v"})
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("m").alias("lo"), F.col("v").alias("hi")).where("lo < hi").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Every smaller neighbour of a node, and the node, are linked to the smallest of them."""
    least = edges.groupBy("hi").agg(F.min("lo").alias("m"))
    moved = edges.join(least, "hi").where("lo > m").select(F.col("m").alias("lo"), F.col("lo").alias("hi"))
    return moved.unionByName(least.select(F.col("m").alias("lo"), "hi")).distinct()
