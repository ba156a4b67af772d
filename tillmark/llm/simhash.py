"""SimHash fingerprints of word shingles, and near-duplicate classes over an inverted index of byte positions.

Two 64-bit fingerprints that differ in at most two bits differ in at most two of their eight bytes, so they share
six positional bytes at least: that is the guaranteed minimum of the count filter. The index files a fingerprint under its bytes at three disjoint groups
of positions, of which two differing bytes leave one whole, so that every such pair meets in a posting. A posting that holds more than
``BOUND`` fingerprints is split by three disjoint groups of the positions that its key leaves open, again and again, until it is small or its key has six
positions. Within a posting the shared positional bytes of each pair are tallied, pairs reaching six are retained, and these are verified
by their bits. Postings of six positions have two bytes free and at most 65,536 fingerprints whatever the input; equal fingerprints have been merged before, and only a
spanning set of its links leaves a posting, so a large group of near copies costs its size and not its square.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillmark.llm.components import components
from tillmark.llm.store import keep
from tillmark.llm.texts import strings

SEED = 42
MOST_BITS = 2
SHARED_BYTES = 8 - MOST_BITS
#: Fingerprints in a posting that is not split, at most.
BOUND = 256


def _parts(key: int) -> list[int]:
    """Bit sets of positions: ``key`` with each of three disjoint groups of the open positions, of which two differing bytes leave one whole."""
    open_ = [p for p in range(8) if not key >> p & 1]
    size, rest = divmod(len(open_), MOST_BITS + 1)
    groups, at = [], 0
    for k in range(MOST_BITS + 1):
        to = at + size + (k < rest)
        groups.append(sum(1 << p for p in open_[at:to]))
        at = to
    return [key | g for g in groups]


def _families() -> dict[int, list[int]]:
    """For each set of key positions that splitting can lead to, the sets it is split into; sets of six and more are not split."""
    out, todo = {}, [0]
    while todo:
        key = todo.pop()
        if key not in out and key.bit_count() < SHARED_BYTES:
            out[key] = _parts(key)
            todo += out[key]
    return out


FAMILIES = _families()


def fingerprint(text: bytes, words_per_shingle: int = 3) -> int:
    """A bit is set when over half of the shingle hashes have it; no words give 0."""
    words = text.lower().split()  # of bytes: A-Z, and the six ASCII separators
    if not words:
        return 0
    if len(words) < words_per_shingle:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    shingles = map(b" ".join, zip(*(words[k:] for k in range(words_per_shingle))))
    n = len(words) - words_per_shingle + 1
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(s, SEED) for s in shingles), dtype=np.uint64, count=n)
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, n, 1 << 14):
        part = hashes[at : at + (1 << 14)].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id: str = "doc_id", text: str = "text", words_per_shingle: int = 3) -> DataFrame:
    """Columns ``id`` and fp (the fingerprint's 64 bits as a signed long) for each row. A null text has no words."""

    def run(batches):
        for batch in batches:
            values = strings(batch.column(1).cast(pa.large_string())).cast(pa.large_binary()).to_pylist()
            made = np.fromiter((fingerprint(t, words_per_shingle) for t in values), dtype=np.uint64, count=len(values))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made.view(np.int64))], ["id", "fp"])

    kind = docs.schema[id].dataType.simpleString()
    return docs.select(F.col(id).alias("id"), F.col(text).cast("string").alias("text")).mapInArrow(run, f"id {kind}, fp bigint").withColumnRenamed("id", id)


_BITS = np.array([bin(x).count("1") for x in range(1 << 16)], dtype=np.uint8)
_MASKS = np.array([x for x in range(1, 1 << 16) if _BITS[x] <= MOST_BITS], dtype=np.int64)


def _free_bytes(family: int, fp: np.ndarray) -> np.ndarray:
    """The 16 bits that a key of six positions leaves open."""
    one, other = (np.uint64(8 * p) for p in range(8) if not family >> p & 1)
    byte = np.uint64(255)
    return ((fp >> one) & byte | ((fp >> other) & byte) << np.uint64(8)).astype(np.int64)


def shared_bytes(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The tally: at how many of the eight positions two fingerprints have the same byte."""
    return ((a ^ b)[..., None].view(np.uint8) == 0).sum(axis=-1)


def _near(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which pairs the count filter retains and the bits confirm."""
    retained = np.flatnonzero(shared_bytes(a, b) >= SHARED_BYTES)
    apart = (a[retained] ^ b[retained])[:, None].view(np.uint16)
    return retained[_BITS[apart].sum(axis=1) <= MOST_BITS]


def _links(family: np.ndarray, key: np.ndarray, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links of whole postings, rows in order of (family, key)."""
    n = len(fp)
    new = np.ones(n, dtype=bool)
    new[1:] = (family[1:] != family[:-1]) | (key[1:] != key[:-1])
    starts = np.flatnonzero(new)
    sizes = np.diff(np.append(starts, n))
    size_of, posting = np.repeat(sizes, sizes), np.cumsum(new)
    left, right = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)]
    few = 16
    for step in range(1, few):  # all pairs of all small postings at that distance
        at = np.flatnonzero((size_of[:-step] <= few) & (posting[:-step] == posting[step:])) if n > step else []
        if len(at):
            ok = at[_near(fp[at], fp[at + step])]
            left.append(fp[ok])
            right.append(fp[ok + step])
    for start, size in zip(starts[sizes > few], sizes[sizes > few]):
        own, its = fp[start : start + size], int(family[start])
        root = _roots(_free_bytes(its, own)) if its.bit_count() >= SHARED_BYTES else _connected(own)
        other = np.flatnonzero(root != np.arange(size))
        left.append(own[other])
        right.append(own[root[other]])
    return np.concatenate(left), np.concatenate(right)


def _connected(own: np.ndarray) -> np.ndarray:
    """For each fingerprint of a posting of up to ``BOUND`` the index of the first one reachable over retained and confirmed pairs."""
    n = len(own)
    one, other = np.triu_indices(n, 1)
    ok = _near(own[one], own[other])
    near = np.eye(n, dtype=bool)
    near[one[ok], other[ok]] = near[other[ok], one[ok]] = True
    root = np.arange(n)
    while True:
        new = np.where(near, root[None, :], n).min(axis=1)
        new = np.minimum(new, new[new])
        if (new == root).all():
            return root
        root = new


def _roots(free: np.ndarray) -> np.ndarray:
    """For different 16-bit values the index of the first one reachable over steps of at most two bits.

    The tally of shared bytes of any two is six or more here, so only their bits are verified: a value looks up
    its 136 possible partners in a table of all 65,536 values.
    """
    n = len(free)
    root = np.arange(n)
    table = np.full(1 << 16, -1, dtype=np.int64)
    table[free] = root
    if n <= 136:
        near = _BITS[free[:, None] ^ free[None, :]] <= MOST_BITS
    while True:
        if n <= 136:
            new = np.where(near, root[None, :], n).min(axis=1)
        else:
            new = root.copy()
            for mask in _MASKS:
                partner = table[free ^ mask]
                there = partner >= 0
                new[there] = np.minimum(new[there], root[partner[there]])
        new = new[new]
        if (new == root).all():
            return root
        root = new


def _filed(rows: DataFrame, family: Column) -> DataFrame:
    """family, key and fp under each of the sets of positions that ``family`` is split into; the key is the fingerprint's bytes there."""

    def mask(positions: int) -> int:
        value = sum(255 << 8 * p for p in range(8) if positions >> p & 1)
        return value - (1 << 64) if value >> 63 else value

    reached = sorted({x for parts in FAMILIES.values() for x in parts})
    masks = F.create_map(*(F.lit(v) for x in reached for v in (x, mask(x))))
    parts = F.create_map(*(v for x, to in FAMILIES.items() for v in (F.lit(x), F.array(*map(F.lit, to)))))
    out = rows.select("fp", F.explode(parts[family]).alias("family"))
    return out.select("family", F.col("fp").bitwiseAND(masks[F.col("family")].cast("long")).alias("key"), "fp")


def postings(prints: DataFrame, fp: str = "fp", bound: int = BOUND) -> DataFrame:
    """family, key and fp: the index, in which any two fingerprints that share six positional bytes have a posting (family, key) in common.

    Postings over ``bound`` are split where they are, level by level; there are at most four levels, each a count of the level's postings and a join.
    """
    rows, done = _filed(prints.select(F.col(fp).alias("fp")), F.lit(0)), None
    whole = F.col("family").isin([x for x in FAMILIES if x])  # can be split
    while True:
        rows = keep(rows, "postings")
        large = keep(rows.where(whole).groupBy("family", "key").agg(F.count("*").alias("n")).where(F.col("n") > bound), "large")
        if large.isEmpty():
            return rows if done is None else done.unionByName(rows)
        fine = rows.join(large, ["family", "key"], "left_anti")
        done = fine if done is None else done.unionByName(fine)
        rows = _filed(rows.join(large, ["family", "key"], "left_semi"), F.col("family"))


def links(prints: DataFrame, fp: str = "fp", bound: int = BOUND) -> DataFrame:
    """Pairs (a, b) of different fingerprints that connect all fingerprints within two bits of one another.

    ``prints`` holds each fingerprint once. Not every pair within two bits is returned, but any two are connected by
    returned pairs within one posting.
    """

    def run(batches):
        held = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            table = pa.concat_tables([held, table]) if held is not None else table
            family, key = table.column(0).to_numpy(), table.column(1).to_numpy()
            if not len(key):
                continue
            same = np.flatnonzero((family != family[-1]) | (key != key[-1]))
            whole = int(same[-1]) + 1 if len(same) else 0  # the last posting may go on in the next batch
            held = table.slice(whole)
            if whole:
                yield out(table.slice(0, whole))
        if held is not None and held.num_rows:
            yield out(held)

    def out(table):
        a, b = _links(table.column(0).to_numpy().astype(np.int64), table.column(1).to_numpy(), table.column(2).to_numpy().view(np.uint64))
        return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

    index = postings(prints, fp, bound)
    return index.repartition("family", "key").sortWithinPartitions("family", "key").mapInArrow(run, "a bigint, b bigint").distinct()


def near_duplicates(docs: DataFrame, id: str = "doc_id", text: str = "text", words_per_shingle: int = 3) -> DataFrame:
    """Columns ``id``, fingerprint (16 lower-case hex digits) and component_id, one row per input row.

    component_id is the smallest ``id`` of all documents reachable over fingerprints at most two bits apart, itself
    included. Rows with a null or repeated ``id`` keep their rows; a null id is never a component's id unless no other is there. Texts that are null,
    empty or have no words have fingerprint 0 and are linked like any other. An empty table gives no rows.
    """
    rows = keep(fingerprints(docs, id, text, words_per_shingle), "fingerprints")
    prints = keep(rows.groupBy("fp").agg(F.min(id).alias("least")), "prints")
    found = keep(components(links(prints.select("fp"))), "components")
    # tables on both sides of the joins by class and by fingerprint, so that Spark can split those that hold many rows
    classes = keep(found.join(prints, F.col("node") == F.col("fp")).groupBy("root").agg(F.min("least").alias("class_least")), "classes")
    of_class = found.join(classes, "root").select(F.col("node").alias("fp"), "class_least")
    of_print = keep(prints.join(of_class, "fp", "left").select("fp", F.coalesce("class_least", "least").alias("component_id")), "classes")
    return rows.join(of_print, "fp").select(id, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
