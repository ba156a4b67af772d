"""Approximate nearest neighbours by a robust-pruned directed graph for each shard.

Different vectors are dealt to shards of bounded size. In a shard, nodes join the graph in batches: greedy beam searches
from the medoid propose neighbours, relaxed distance pruning keeps those that no kept one is closer to by a factor ``alpha``,
and reverse edges are added under the same pruning. Every query then runs a beam search in every shard, and the
shards' answers are merged by exact cosines. Searches run for many nodes in lockstep as array operations.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tillmark.llm.grouped import runs_of_keys
from tillmark.llm.store import keep
from tillmark.llm.texts import ragged


class Graph:
    """A graph over unit vectors; nearness is the inner product, distance its complement to 1."""

    def __init__(self, vectors: np.ndarray, degree: int = 32, beam: int = 48, alpha: float = 1.2, seed: int = 7, batch: int = 256):
        self.x = np.ascontiguousarray(vectors, dtype=np.float32)
        self.n, self.degree, self.alpha = len(vectors), degree, alpha
        self.links = np.full((self.n, degree), -1, dtype=np.int32)
        centre = self.x.mean(axis=0)
        self.start = int(np.argmax(self.x @ centre)) if self.n else 0
        order = np.random.default_rng(seed).permutation(self.n)
        joined = np.array([self.start], dtype=np.int32)
        self.entries = joined
        size = 16  # batches grow with the graph, so that members of a batch, who don't see one another, are few
        order = order[order != self.start]
        at = 0
        while at < len(order):
            size = min(batch, max(16, len(joined) // 2))
            nodes = order[at : at + size].astype(np.int32)
            at += size
            found, _ = self.search(self.x[nodes], beam)
            own = self._among(nodes)
            self._set(nodes, np.concatenate([found, own], axis=1))
            self._reverse(nodes)
            joined = np.append(joined, nodes)
            self.entries = self._entries(joined)

    def _entries(self, nodes: np.ndarray) -> np.ndarray:
        """The start, and as many more nodes as it takes that all given ones can be reached.

        Where many vectors all but coincide, pruning may leave one without a link to it, and this one may be the start.
        """
        waiting = np.zeros(self.n, dtype=bool)
        waiting[nodes] = True
        entries, front = [self.start], np.array([self.start])
        while True:
            while len(front):
                waiting[front] = False
                front = self.links[front].ravel()
                front = np.unique(front[front >= 0])
                front = front[waiting[front]]
            left = np.flatnonzero(waiting)
            if not len(left):
                return np.array(entries, dtype=np.int32)
            entries.append(int(left[0]))
            front = left[:1]

    def _among(self, nodes: np.ndarray, near: int = 8) -> np.ndarray:
        """The nearest of a batch to each of its members, which the graph doesn't hold yet."""
        sims = self.x[nodes] @ self.x[nodes].T
        np.fill_diagonal(sims, -np.inf)
        near = min(near, len(nodes) - 1)
        return nodes[np.argpartition(-sims, near - 1, axis=1)[:, :near]] if near > 0 else np.zeros((len(nodes), 0), np.int32)

    def _set(self, nodes: np.ndarray, candidates: np.ndarray) -> None:
        self.links[nodes] = self._prune(nodes, candidates)

    def _prune(self, nodes: np.ndarray, candidates: np.ndarray) -> np.ndarray:
        """For each node the kept ones of its candidates (-1: none), nearest first."""
        rows = np.arange(len(nodes))
        candidates = np.where(candidates == nodes[:, None], -1, candidates)
        order = np.argsort(candidates, axis=1, kind="stable")
        candidates = np.take_along_axis(candidates, order, axis=1)
        candidates[:, 1:][candidates[:, 1:] == candidates[:, :-1]] = -1  # named twice
        vectors = self.x[candidates]
        far = 1.0 - np.einsum("nd,ncd->nc", self.x[nodes], vectors)
        far[candidates < 0] = np.inf
        order = np.argsort(far, axis=1)
        candidates, far, vectors = (np.take_along_axis(candidates, order, 1), np.take_along_axis(far, order, 1), np.take_along_axis(vectors, order[:, :, None], 1))
        between = 1.0 - np.matmul(vectors, vectors.transpose(0, 2, 1))
        alive = np.isfinite(far)
        kept = np.full((len(nodes), self.degree), -1, dtype=np.int32)
        count = np.zeros(len(nodes), dtype=np.int64)
        for c in range(candidates.shape[1]):
            take = alive[:, c] & (count < self.degree)
            kept[rows[take], count[take]] = candidates[take, c]
            count[take] += 1
            alive &= ~(take[:, None] & (self.alpha * between[:, c, :] <= far))
        return kept

    def _reverse(self, nodes: np.ndarray) -> None:
        source = np.repeat(nodes, self.degree)
        target = self.links[nodes].ravel()
        source, target = source[target >= 0], target[target >= 0]
        order = np.argsort(target, kind="stable")
        source, target = source[order], target[order]
        targets, first, counts = np.unique(target, return_index=True, return_counts=True)
        at = np.arange(len(target)) - np.repeat(first, counts)
        wide = 64
        for done in range(0, int(counts.max(initial=0)), wide):
            now = counts > done
            more = np.full((int(now.sum()), wide), -1, dtype=np.int32)
            ok = (at >= done) & (at < done + wide)
            row = np.cumsum(now) - 1
            more[row[np.searchsorted(targets, target[ok])], at[ok] - done] = source[ok]
            some = targets[now]
            for lo in range(0, len(some), 1024):
                part = some[lo : lo + 1024]
                self.links[part] = self._add(part, more[lo : lo + 1024])

    def _add(self, nodes: np.ndarray, more: np.ndarray) -> np.ndarray:
        both = np.concatenate([self.links[nodes], more], axis=1)
        room = (both >= 0).sum(axis=1) <= self.degree
        out = np.empty((len(nodes), self.degree), dtype=np.int32)
        if room.any():
            order = np.argsort(both[room] < 0, axis=1, kind="stable")
            out[room] = np.take_along_axis(both[room], order, axis=1)[:, : self.degree]
        if (~room).any():
            out[~room] = self._prune(nodes[~room], both[~room])
        return out

    def search(self, queries: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """Beam search from the entries for all queries in lockstep: nodes found (-1: none) and their nearness, nearest first."""
        m = len(queries)
        queries = np.asarray(queries, dtype=np.float32)
        ids = np.full((m, beam), -1, dtype=np.int32)
        near = np.full((m, beam), -np.inf, dtype=np.float32)
        open_ = np.zeros((m, beam), dtype=bool)
        begin = queries @ self.x[self.entries].T
        first = np.argsort(-begin, axis=1, kind="stable")[:, :beam]
        few = first.shape[1]
        ids[:, :few], near[:, :few], open_[:, :few] = self.entries[first], np.take_along_axis(begin, first, 1), True
        seen = np.zeros((m, self.n), dtype=bool)
        seen[np.arange(m)[:, None], ids[:, :few]] = True
        active = np.arange(m)
        wide = 4  # nodes opened at a time
        while len(active):
            at = np.argsort(~open_[active], axis=1, kind="stable")[:, :wide]  # the nearest open ones: rows are in order
            chosen = np.take_along_axis(ids[active], at, 1)
            live = np.take_along_axis(open_[active], at, 1)
            open_[active[:, None], at] = False
            new = self.links[chosen].reshape(len(active), -1)
            new = np.where(np.repeat(live, self.degree, axis=1), new, -1)
            known = seen[active[:, None], new] | (new < 0)
            order = np.argsort(np.where(known, np.iinfo(np.int32).max, new), axis=1)
            new, known = np.take_along_axis(new, order, 1), np.take_along_axis(known, order, 1)
            known[:, 1:] |= new[:, 1:] == new[:, :-1]
            width = int((~known).sum(axis=1).max(initial=0))
            if width:
                order = np.argsort(known, axis=1, kind="stable")[:, :width]
                new, known = np.take_along_axis(new, order, 1), np.take_along_axis(known, order, 1)
                rows, _ = np.nonzero(~known)
                seen[active[rows], new[~known]] = True
                score = np.einsum("md,mcd->mc", queries[active], self.x[new])
                score[known] = -np.inf
                all_ids = np.concatenate([ids[active], np.where(known, -1, new)], axis=1)
                all_near = np.concatenate([near[active], score], axis=1)
                all_open = np.concatenate([open_[active], ~known], axis=1)
                order = np.argsort(-all_near, axis=1, kind="stable")[:, :beam]
                ids[active], near[active], open_[active] = (np.take_along_axis(all_ids, order, 1), np.take_along_axis(all_near, order, 1), np.take_along_axis(all_open, order, 1))
            active = active[open_[active].any(axis=1)]
        return ids, near


def valid_vectors(vectors: DataFrame, id: str, vector: str) -> DataFrame:
    """Columns id and v (doubles) of the rows that take part: not null, not empty, finite, with a direction."""
    v = F.transform(F.col(vector), lambda x: x.cast("double"))
    rows = vectors.select(F.col(id).cast("long").alias("id"), v.alias("v")).where("id is not null and v is not null and size(v) > 0")
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.where(fine & F.exists("v", lambda x: x != 0))


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _scaled(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The vectors times a power of two each, which leaves every digit and keeps squares finite, and their lengths."""
    _, power = np.frexp(np.abs(x).max(axis=1))
    x = np.ldexp(x, -power[:, None])
    return x, np.sqrt(np.einsum("nd,nd->n", x, x))


def nearest(vectors: DataFrame, every: int = 50, k: int = 5, id: str = "vec_id", vector: str = "embedding", shard_rows: int = 5000, degree: int = 32, beam: int = 48, search_beam: int = 64) -> DataFrame:
    """query_id, rank (from 1), ``id`` and score (cosine in double precision): the ``k`` nearest found of each query.

    Queries are the rows whose ``id`` is divisible by ``every``; candidates all rows but the query's own. Ties go to the smaller
    id. Vectors that are null, zero, empty or hold null or non-finite components take no part, as query or candidate. Vectors of different
    length are never near each other. Rows of the same vector enter the graph once: only the ``k`` + 1 smallest ids of a
    vector can be among the answers, so they stand for all, and nothing else is left out. A repeated id counts as
    one row of each of its vectors. Shards hold about ``shard_rows`` vectors, so their number grows with the table and a graph's memory does not. A
    shard's queries follow its vectors to the task in batches and are answered batch by batch, so their number does not matter to its memory.
    """
    rows = valid_vectors(vectors, id, vector).withColumn("v", F.transform("v", lambda x: F.when(x == 0, 0.0).otherwise(x))).withColumn("width", F.size("v"))
    smallest = Window.partitionBy("v").orderBy("id")
    copies = rows.distinct().withColumn("n", F.row_number().over(smallest)).where(F.col("n") <= k + 1)
    distinct = keep(copies.groupBy("v", "width").agg(F.sort_array(F.collect_list("id")).alias("ids")), "vectors")  # k + 1 ids at most
    total = distinct.groupBy("width").count().withColumn("shards", F.ceil(F.col("count") / F.lit(shard_rows)).cast("int"))
    tasks = total.agg(F.sum("shards")).first()[0] or 1
    total = F.broadcast(total.select("width", "shards"))  # a row for each vector length
    none = lambda kind, name: F.lit(None).cast(kind).alias(name)
    nodes = distinct.join(total, "width").select("width", F.pmod(F.hash(F.element_at("ids", 1), F.lit(11)), "shards").alias("shard"), F.lit(0).alias("place"), none("long", "id"), "ids", "v")
    asked = rows.where(F.col("id") % every == 0).distinct().join(total, "width")
    asked = asked.select("width", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)).alias("shard"), F.lit(1).alias("place"), "id", none("array<long>", "ids"), "v")

    def answers(block, asked_ids, graph, at_node, of_node, x, size, ids):
        """Query, id and score of the ``k`` nearest found in the shard for each query of the block.

        Nodes of the graph are directions: ``at_node`` and ``of_node`` give the vectors of each.
        """
        q, length = _scaled(block)
        found, _ = graph.search(q / length[:, None], max(search_beam, 2 * k))
        found = found[:, : 4 * k]
        row, col = np.nonzero(found >= 0)
        node = found[row, col]
        many = np.diff(at_node)[node]
        row, node = np.repeat(row, many), of_node[ragged(at_node[node], many)]
        score = np.einsum("nd,nd->n", q[row], x[node]) / (length[row] * size[node])
        # all copies of the nodes found; the best k of the shard for each query
        first, members = ids.offsets.to_numpy(), ids.values.to_numpy()
        many = np.diff(first)[node]
        row, score, other = np.repeat(row, many), np.repeat(score, many), members[ragged(first[node], many)]
        apart = asked_ids[row] != other
        row, score, other = row[apart], score[apart], other[apart]
        order = np.lexsort((other, -score, row))
        row, score, other = row[order], score[order], other[order]
        best = np.arange(len(row)) - np.searchsorted(row, np.arange(len(block)))[row] < k
        return pa.RecordBatch.from_arrays([pa.array(asked_ids[row[best]]), pa.array(other[best]), pa.array(score[best])], ["query_id", "id", "score"])

    def run(batches):
        now, held, shard = None, [], None
        for (*place, asks), part in runs_of_keys(batches, "width", "shard", "place"):
            if place != now:
                now, held, shard = place, [], None
            if not asks:
                held.append(part)
                continue
            if shard is None and held:
                table = pa.Table.from_batches(held).combine_chunks()
                x, size = _scaled(_matrix(table.column("v")))
                unit = (x / size[:, None]).astype(np.float32)
                unit, node = np.unique(unit, axis=0, return_inverse=True)  # vectors of one direction are one node
                of_node = np.argsort(node.ravel(), kind="stable")
                at_node = np.searchsorted(node.ravel()[of_node], np.arange(len(unit) + 1))
                shard = Graph(unit, degree, beam), at_node, of_node, x, size, table.column("ids").combine_chunks()
                held = []
            for at in range(0, part.num_rows if shard else 0, 512):
                some = part.slice(at, 512)
                yield answers(_matrix(some.column("v")), some.column("id").to_numpy(), *shard)

    # by ranges, since hashes would put several shards into some tasks and none into others
    both = nodes.unionByName(asked).repartitionByRange(tasks, "width", "shard").sortWithinPartitions("width", "shard", "place")
    found = both.mapInArrow(run, "query_id long, id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    best = found.distinct().withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return best.select("query_id", "rank", F.col("id").alias(id), "score")
