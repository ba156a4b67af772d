"""Merkle manifest of a dataset with octopus multiproofs: one root for all rows, and a proof for every row.

Rows of a group (a source, say) are the leaves of a tree of runs of three, in order of id; the roots of all groups are the
leaves of one more tree. Consecutive leaves are worked through in aligned blocks of 3^7: a block's task hashes its subtree up to
the block's root, and the roots of blocks are the leaves of the next round, so that ten thousand million leaves need three rounds.

Proofs are made block by block. A block's leaves together lack few nodes: the octopus, the smallest set of coordinates (level, place) from which, with
the leaves, all their paths follow. A block asks for that set once, derives every shared interior node itself, and expands the
proof of each of its leaves from there; nothing is fetched leaf by leaf.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillmark.llm.grouped import dealt, group_keys, whole_groups
from tillmark.llm.store import drop, keep
from tillmark.operators.ordered import running

RUN = 3
BLOCK_LEVELS = 7
BLOCK = RUN**BLOCK_LEVELS


def h(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(*columns: Column) -> Column:
    """The digest of a row: of each value its UTF-8 byte count, a colon and the value, or ``-`` for null, behind one another."""
    fields = [c.cast("string") for c in columns]
    return F.sha2(F.concat(*(F.when(c.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c)) for c in fields)).cast("binary"), 256)


def depth(n: int) -> int:
    """Levels above ``n`` leaves."""
    levels = 0
    while n > 1:
        n, levels = -(-n // RUN), levels + 1
    return levels


def missing(at: np.ndarray, n: int) -> list[tuple[int, int]]:
    """The octopus of the leaves at places ``at`` (ascending) of a tree of ``n``: the (level, place) to fetch so that all their proofs follow."""
    out, level = [], 0
    while n > 1:
        parents = np.unique(at // RUN)
        children = (parents[:, None] * RUN + np.arange(RUN)).ravel()
        out += [(level, int(k)) for k in np.setdiff1d(children[children < n], at)]
        at, n, level = parents, -(-n // RUN), level + 1
    return out


def _hashed(level: int, place: int, digests: list[str], top: int):
    """Nodes (level, place, digest) above consecutive ones whose first has a place that all levels up to ``top`` divide."""
    while level < top:
        digests = [h("".join(digests[k : k + RUN])) for k in range(0, len(digests), RUN)]
        level, place = level + 1, place // RUN
        yield from ((level, place + k, d) for k, d in enumerate(digests))


def _grow(leaves: DataFrame, most: int) -> DataFrame:
    """tree, n, level, place, digest of the interior nodes of all trees, the leaves of trees of one leaf included; root marks roots.

    ``leaves`` has tree, n (leaves of the tree), place (from 0) and digest; no tree has more than ``most``.
    """
    kind = leaves.schema["tree"].dataType.simpleString()

    def run(level):
        def each(batches):
            for table, starts in whole_groups(batches):
                place, n, digest = table.column("place").to_numpy(), table.column("n").to_numpy(), table.column("digest").to_pylist()
                rows, levels, places, digests = [], [], [], []
                for a, b in zip(starts, starts[1:]):
                    high = depth(int(n[a]))
                    made = [(0, 0, digest[a])] if high == 0 else _hashed(level, int(place[a]), digest[a:b], min(high, level + BLOCK_LEVELS))
                    for up, k, d in made:
                        rows.append(a)
                        levels.append(up)
                        places.append(k)
                        digests.append(d)
                size = n[np.array(rows, dtype=np.int64)].tolist()
                root = [up == depth(x) for up, x in zip(levels, size)]
                yield pa.RecordBatch.from_arrays([table.column("tree").take(pa.array(rows, pa.int64())).combine_chunks(), pa.array(size, pa.int64()), pa.array(levels, pa.int32()), pa.array(places, pa.int64()), pa.array(digests, pa.string()), pa.array(root)], ["tree", "n", "level", "place", "digest", "root"])

        return each

    out, level, below = None, 0, leaves.select("tree", "n", "place", "digest")
    while out is None or level < depth(most):
        grouped = below.select(*group_keys("tree", F.floor(F.col("place") / BLOCK)), "tree", "n", "place", "digest")
        made = keep(dealt(grouped, "place").mapInArrow(run(level), f"tree {kind}, n long, level int, place long, digest string, root boolean"), "nodes")
        level += BLOCK_LEVELS
        below = made.where((F.col("level") == level) & ~F.col("root"))
        out = made if out is None else out.unionByName(made)
    return out


def _asked(rows: DataFrame, kind: str) -> DataFrame:
    """tree, block, level, place: what the places of each (tree, block) lack; ``rows`` has tree, block, n, place."""

    def run(batches):
        for table, starts in whole_groups(batches):
            place, n = table.column("place").to_numpy(), table.column("n").to_numpy()
            found = [(a, *x) for a, b in zip(starts, starts[1:]) for x in missing(place[a:b], int(n[a]))]
            at = pa.array([x[0] for x in found], pa.int64())
            yield pa.RecordBatch.from_arrays([table.column("tree").take(at).combine_chunks(), table.column("block").take(at).combine_chunks(), pa.array([x[1] for x in found], pa.int32()), pa.array([x[2] for x in found], pa.int64())], ["tree", "block", "level", "place"])

    keyed = rows.select(*group_keys("tree", "block"), "tree", "block", "n", "place")
    return dealt(keyed, "place").mapInArrow(run, f"tree {kind}, block long, level int, place long")


def _fetched(rows: DataFrame, nodes: DataFrame, kind: str, name: str) -> DataFrame:
    """One row for each (tree, block): the nodes it lacks, as an array of (level, place, digest). A block lacks at most two nodes a level."""
    asked = _asked(rows, kind).withColumnsRenamed({"tree": "t", "level": "l", "place": "p"})
    same = F.col("t").eqNullSafe(F.col("tree")) & (F.col("l") == F.col("level")) & (F.col("p") == F.col("place"))
    return asked.join(nodes.select("tree", "level", "place", "digest"), same).groupBy("tree", "block").agg(F.collect_list(F.struct("level", "place", "digest")).alias(name))


class _Paths:
    """A block's part of a tree: the nodes it has, was given and derives, and for each node what stands beside it and above."""

    def __init__(self, first: int, digests: list[str], n: int, given: list[dict]):
        self.sizes = [n]  # nodes of each level
        while self.sizes[-1] > 1:
            self.sizes.append(-(-self.sizes[-1] // RUN))
        self.known = {(x["level"], x["place"]): x["digest"] for x in given} | {(0, first + k): d for k, d in enumerate(digests)}
        self.sides: dict[tuple[int, int], tuple[str, str, str]] = {}
        at = set(range(first, first + len(digests)))
        for level, size in enumerate(self.sizes[:-1]):  # every interior node is derived once
            at = {k // RUN for k in at}
            for k in at:
                self.known[level + 1, k] = h("".join(self.known[level, c] for c in range(k * RUN, min(k * RUN + RUN, size))))
        self.root = self.known[len(self.sizes) - 1, 0]
        self.above: tuple[_Paths, int] | None = None  # the tree whose leaf this root is, and its place there

    def beside(self, level: int, place: int) -> tuple[str, str, str]:
        """The digests left and right of a node in its run, and all siblings from this level up to the last root."""
        found = self.sides.get((level, place))
        if found is None:
            if level == len(self.sizes) - 1:
                found = "", "", self.above[0].beside(0, self.above[1])[2] if self.above else ""
            else:
                begin = place // RUN * RUN
                left = "".join(self.known[level, k] for k in range(begin, place))
                right = "".join(self.known[level, k] for k in range(place + 1, min(begin + RUN, self.sizes[level])))
                found = left, right, left + right + self.beside(level + 1, place // RUN)[2]
            self.sides[level, place] = found
        return found

    def folded(self, place: int, digest: str) -> str:
        """The last root that follows from a leaf's digest and the siblings on its path."""
        for level in range(len(self.sizes) - 1):
            left, right, _ = self.beside(level, place)
            digest, place = h(left + digest + right), place // RUN
        return self.above[0].folded(self.above[1], digest) if self.above else digest


def prove(docs: DataFrame, digest: Column, claim: Column | None = None, id: str = "doc_id", group: str = "source", siblings: bool = False) -> DataFrame:
    """One row per row: ``id``, leaf, subroot, root, proof_sha256, folded_root, verified and, if asked for, siblings.

    ``digest`` gives each row's leaf, ``claim`` the digest that is held against its proof (the leaf itself, if not given). Rows of a ``group`` (null is one)
    are leaves in order of ``id``, null first, then of digest; equal rows are leaves of their own. While more than one node remains, each three consecutive ones
    (fewer at the end) become the sha256 of their hex digests behind one another. subroot is what remains of a group, root the same over all groups in
    their order, null first. siblings is the proof: all others of the runs on the path from leaf to root, left to right. folded_root follows from claim and
    siblings; verified says whether it is the root. An empty table gives no rows.
    """
    rows = docs.select(F.col(id).alias("id"), F.col(group).alias("tree"), digest.alias("leaf"), (digest if claim is None else claim).alias("claim"), F.lit(1).alias("one"))
    rows = keep(rows, "leaves")
    id_kind, kind = (rows.schema[c].dataType.simpleString() for c in ("id", "tree"))
    placed = running(rows, [F.col("id").asc_nulls_first(), F.col("leaf")], ["tree"], position="position", totals={"n": "one"})
    placed = keep(placed.select("id", "tree", "n", (F.col("position") - 1).alias("place"), "leaf", "claim"), "leaves")
    drop(rows)
    own = _grow(placed.withColumnRenamed("leaf", "digest"), placed.agg(F.coalesce(F.max("n"), F.lit(1))).first()[0])

    roots = own.where("root").select(F.col("tree").alias("of"), "digest", F.lit(1).alias("one"))
    roots = running(roots, [F.col("of").asc_nulls_first()], position="position", totals={"n": "one"})
    roots = keep(roots.select(F.lit(0).alias("tree"), "of", "n", (F.col("position") - 1).alias("place"), "digest"), "roots")
    size = roots.agg(F.coalesce(F.max("n"), F.lit(1))).first()[0]
    top = _grow(roots, size)
    root = top.where("root").select("digest").first()
    root = root[0] if root else h("")

    # what a group's root lacks on its way to the root of all, and what a block lacks on its way to its group's root
    single = roots.select("tree", F.col("place").alias("block"), "n", "place")
    every = top.where("level > 0").select("tree", "level", "place", "digest").unionByName(roots.select("tree", F.lit(0).alias("level"), "place", "digest"))
    above = _fetched(single, every, "int", "above").select(F.col("block").alias("at"), "above")
    above = keep(roots.select("of", F.col("place").alias("root_place"), F.col("n").alias("roots")).join(above, F.col("root_place") == F.col("at"), "left").drop("at"), "above")
    blocks = placed.withColumn("block", F.floor(F.col("place") / BLOCK))
    # blocks hold whole runs of all levels below their own root, so they lack nothing there
    lacking = _fetched(blocks, own.where(F.col("level") >= BLOCK_LEVELS), kind, "fetched").withColumnsRenamed({"tree": "t", "block": "b"})
    there = blocks.select("tree", "block").distinct().join(lacking, F.col("tree").eqNullSafe(F.col("t")) & (F.col("block") == F.col("b")), "left").drop("t", "b")
    given = there.join(above, F.col("tree").eqNullSafe(F.col("of")))

    nodes = "array<struct<level: int, place: long, digest: string>>"
    none = lambda kind, name: F.lit(None).cast(kind).alias(name)
    first = given.select(*group_keys("tree", "block"), none(id_kind, "id"), none("long", "n"), F.lit(-1).cast("long").alias("place"), none("string", "leaf"), none("string", "claim"), F.coalesce("fetched", F.array().cast(nodes)).alias("fetched"), F.coalesce("above", F.array().cast(nodes)).alias("above"), "root_place", "roots")
    leaves = blocks.select(*group_keys("tree", "block"), "id", "n", "place", "leaf", "claim", none(nodes, "fetched"), none(nodes, "above"), none("long", "root_place"), none("long", "roots"))
    def run(batches):
        for table, starts in whole_groups(batches):
            place, leaf_of, claim_of = (table.column(c).to_pylist() for c in ("place", "leaf", "claim"))
            at, out = [], []
            for a, b in zip(starts.tolist(), starts[1:].tolist()):
                head = table.slice(a, 1).to_pylist()[0]  # the nodes given to the block; its leaves follow
                own = _Paths(place[a + 1], leaf_of[a + 1 : b], table.column("n")[a + 1].as_py(), head["fetched"])
                upper = _Paths(head["root_place"], [own.root], head["roots"], head["above"])
                own.above = upper, head["root_place"]
                for k in range(a + 1, b):
                    proof = own.beside(0, place[k])[2]
                    at.append(k)
                    out.append((leaf_of[k], own.root, h(proof), own.folded(place[k], claim_of[k]), proof if siblings else None))
            columns = [pa.array(x, pa.string()) for x in zip(*out)] or [pa.array([], pa.string())] * len(results)
            yield pa.RecordBatch.from_arrays([table.column("id").take(pa.array(at, pa.int64())).combine_chunks(), *columns], ["id", *results])

    results = ["leaf", "subroot", "proof_sha256", "folded_root", "siblings"]
    made = dealt(first.unionByName(leaves), "place").mapInArrow(run, f"id {id_kind}, " + ", ".join(f"{c} string" for c in results))
    chosen = ["leaf", "subroot", F.lit(root).alias("root"), "proof_sha256", "folded_root", (F.col("folded_root") == F.lit(root)).alias("verified"), *(["siblings"] if siblings else [])]
    return made.select(F.col("id").alias(id), *chosen)
