"""MinHash near-duplicates: circulant signatures, banding, exact Jaccard verification on whole shingle sets.

Two permutations of the 64-bit ring make all coordinates of a signature: sigma scatters the shingles once, and coordinate k is the smallest
value of pi over them, pi being shifted circularly by k. Texts that agree in all coordinates of a band meet in a bucket; two texts of
similarity s meet with probability 1 - (1 - s^5)^30, which is 0.999993 at 0.8.

Equal sets are merged first. Texts that meet, directly or over others, form a candidate group, found as components over one edge
for each posting and not over pairs. A group's sets are fetched once and dealt to blocks of about 256 sets. All pairs of a block are compared exactly, by one
product of its incidence matrix with itself; only a spanning set of the links leaves the task. Groups of more than one block get eight leaders that
every block is compared with, so a large group of near copies soon is one class, and what is left are pairs of blocks of
different classes, each compared exactly in a task of its own. Thus no link within a candidate group is lost, no task holds more
than two blocks, and pairs inside a class that is already connected are not compared across blocks.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillmark.llm.components import components
from tillmark.llm.grouped import dealt, group_keys, whole_groups
from tillmark.llm.store import drop, keep
from tillmark.llm.texts import LOWER, coded, flat, pieces, ragged, strings, token_array, word_spans

WORDS = 4
#: Linked from a similarity of 0.8 on: 9 * shared >= 4 * (one size + other size).
SHARED, SIZES = 9, 4
BANDS, IN_BAND = 30, 5
#: Sets and shingles in a block, about; leaders of a group of several blocks.
BLOCK, BLOCK_SHINGLES, LEADERS = 256, 1 << 20, 8
#: Shingles that an incidence matrix has at a time.
COLUMNS = 4096
_ODD = np.uint64(0x9E3779B97F4A7C15)
_A, _B, _C = (np.uint64(x) for x in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53, 0xD6E8FEB86659FD93))


def _sigma(x: np.ndarray) -> np.ndarray:
    """The first permutation: xor-shifts and odd factors, each of which can be undone."""
    x = (x ^ (x >> np.uint64(33))) * _A
    x = (x ^ (x >> np.uint64(29))) * _B
    return x ^ (x >> np.uint64(32))


def sets(column: pa.Array, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """The different shingle hashes of each text in ascending order, and where each text's start (one more entry for the end).

    Words stand between ASCII white space, A-Z lowered. A text of fewer words than a shingle is one shingle, one without words none.
    """
    data, offsets = flat(column)
    data = LOWER[data]
    starts, ends, first = word_spans(data, offsets)
    distinct, index = coded(token_array(data, starts, ends))
    word = np.fromiter(map(xxhash.xxh64_intdigest, distinct), dtype=np.uint64, count=len(distinct))[index] if len(index) else np.zeros(0, np.uint64)
    many = np.diff(first)
    texts, hashes = [], []
    for length in range(1, words + 1):
        own = np.flatnonzero(many >= words if length == words else many == length)
        count = many[own] - length + 1
        at = ragged(first[own], count)
        x = np.full(len(at), length, dtype=np.uint64)
        for k in range(length):
            x = _sigma(x * _ODD + word[at + k])
        texts.append(np.repeat(own, count))
        hashes.append(x)
    text, x = np.concatenate(texts), np.concatenate(hashes)
    order = np.lexsort((x, text))
    text, x = text[order], x[order]
    new = np.ones(len(x), dtype=bool)
    new[1:] = (x[1:] != x[:-1]) | (text[1:] != text[:-1])
    return x[new], np.searchsorted(text[new], np.arange(len(column) + 1))


def signatures(x: np.ndarray, begin: np.ndarray, coordinates: range) -> np.ndarray:
    """The given coordinates (a row each) of the sets that start at ``begin``: the smallest pi(sigma(shingle) - k).

    pi(y) multiplies by an odd number, folds the upper half into the lower and multiplies again; shifting it by k takes k times the
    first factor from the first product, which therefore is made once.
    """
    made = _sigma(x ^ _ODD) * _C
    out = np.empty((len(coordinates), len(begin)), dtype=np.uint64)
    y, fold = np.empty_like(made), np.empty_like(made)
    for row, k in enumerate(coordinates):
        np.subtract(made, np.uint64(k * int(_C) & (1 << 64) - 1), out=y)
        np.right_shift(y, np.uint64(32), out=fold)
        np.bitwise_xor(y, fold, out=y)
        np.multiply(y, _B, out=y)
        np.minimum.reduceat(y, begin, out=out[row])
    return out


def buckets(x: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The key of each band of each set that is not empty (sets x bands)."""
    begin = at[:-1][np.diff(at) > 0]
    out = np.empty((len(begin), BANDS), dtype=np.uint64)
    for band in range(BANDS if len(begin) else 0):
        key = np.full(len(begin), band, dtype=np.uint64)
        for row in signatures(x, begin, range(band * IN_BAND, (band + 1) * IN_BAND)):
            key = _sigma(key * _ODD + row)
        out[:, band] = key
    return out


def _sketches(rows: DataFrame, kind: str, words: int) -> DataFrame:
    """id, key and other (the row's hashes), unit (16 bytes that stand for the set), n (its size) and buckets of each row."""

    def run(batches):
        for batch in batches:
            for part in pieces(batch, 1 << 20):
                x, at = sets(strings(part.column("text")), words)
                keys = buckets(x, at)
                size = np.diff(at)
                units = [hashlib.md5(x[a:b].tobytes()).digest() for a, b in zip(at, at[1:])]
                ends = np.append(0, np.cumsum((size > 0) * BANDS)).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(keys.ravel().view(np.int64)))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("id", "key", "other")), pa.array(units, pa.binary()), pa.array(size.astype(np.int64)), lists], ["id", "key", "other", "unit", "n", "buckets"])

    return rows.mapInArrow(run, f"id {kind}, key long, other long, unit binary, n long, buckets array<long>")


def _contents(rows: DataFrame, members: DataFrame, words: int) -> DataFrame:
    """unit, root and shingles (8 bytes each) of the members, each from the one row that stands for it."""

    def run(batches):
        for batch in batches:
            for part in pieces(batch, 1 << 20):
                x, at = sets(strings(part.column("text")), words)
                made = [x[a:b].tobytes() for a, b in zip(at, at[1:])]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("unit", "root", "block", "blocks")), pa.array(made, pa.binary())], ["unit", "root", "block", "blocks", "shingles"])

    chosen = rows.join(members.select("key", "other", "unit", "root", "block", "blocks"), ["key", "other"]).dropDuplicates(["unit"])
    return chosen.select("unit", "root", "block", "blocks", "text").mapInArrow(run, "unit binary, root long, block long, blocks long, shingles binary")


def connected(found: list[np.ndarray], apart: np.ndarray | None = None) -> np.ndarray:
    """For each set the first one that it is connected with over pairs of similarity 0.8 or more; pairs of equal ``apart`` are not compared."""
    m = len(found)
    size = np.fromiter(map(len, found), dtype=np.int64, count=m)
    owner, x = np.repeat(np.arange(m), size), np.concatenate(found)
    order = np.argsort(x, kind="stable")
    x, owner = x[order], owner[order]
    column = np.cumsum(np.append(True, x[1:] != x[:-1])) - 1
    shared = np.bincount(column)[column] > 1  # the others cannot be in two sets
    owner, column = owner[shared], column[shared]
    column = np.cumsum(np.append(True, column[1:] != column[:-1])) - 1 if len(column) else column
    both = np.zeros((m, m), dtype=np.int64)
    cuts = np.searchsorted(column, np.arange(0, (int(column[-1]) if len(column) else 0) + 1, COLUMNS))
    for a, b in zip(cuts, np.append(cuts[1:], len(column))):
        matrix = np.zeros((m, min(COLUMNS, int(column[b - 1] - column[a]) + 1)) if b > a else (m, 0), dtype=np.float32)
        if b > a:
            matrix[owner[a:b], column[a:b] - column[a]] = 1
        both += (matrix @ matrix.T).astype(np.int64)
    linked = SHARED * both >= SIZES * (size[:, None] + size[None, :])
    if apart is not None:
        linked &= apart[:, None] != apart[None, :]
    np.fill_diagonal(linked, True)
    label = np.arange(m)
    while True:
        new = np.where(linked, label[None, :], m).min(axis=1)
        new = np.minimum(new, new[new])
        if (new == label).all():
            return label
        label = new


def _links(members: DataFrame) -> DataFrame:
    """Links (a, b) that connect the sets of each (g, h) as ``connected`` finds them; members has unit, shingles and class (null: of none)."""

    def run(batches):
        for table, starts in whole_groups(batches, rows=512):
            unit, shingles, own = table.column("unit"), table.column("shingles"), table.column("class").to_pylist()
            a_side, b_side = [], []
            for a, b in zip(starts.tolist(), starts[1:].tolist()):
                if b - a > 1:
                    number = {c: k for k, c in enumerate(dict.fromkeys(own[a:b]))}
                    apart = np.array([number[c] for c in own[a:b]]) if own[a] is not None else None
                    label = connected([np.frombuffer(shingles[k].as_buffer(), dtype=np.uint64) for k in range(a, b)], apart)
                    other = np.flatnonzero(label != np.arange(b - a))
                    a_side.append(a + other)
                    b_side.append(a + label[other])
            at = [pa.array(np.concatenate(x) if x else np.zeros(0, np.int64)) for x in (a_side, b_side)]
            yield pa.RecordBatch.from_arrays([unit.take(x).combine_chunks() for x in at], ["a", "b"])

    return dealt(members.select("g", "h", "unit", "class", "shingles"), "unit").mapInArrow(run, "a binary, b binary").distinct()


def _blocks_of(count: str, shingles: str):
    return F.greatest(F.ceil(F.col(count) / BLOCK), F.ceil(F.col(shingles) / BLOCK_SHINGLES))


def _first_links(contents: DataFrame) -> DataFrame:
    """Links within each block, and of each block with the leaders of its group."""
    none = F.lit(None).cast("binary").alias("class")
    several = contents.where("blocks > 1")
    drawn = several.groupBy("root").agg(F.array_distinct(F.array(*(F.min_by("unit", F.xxhash64("unit", F.lit(k))) for k in range(LEADERS)))).alias("units"))
    leaders = drawn.select(F.col("root").alias("r"), F.explode("units").alias("u"))
    sent = several.join(leaders, (F.col("root") == F.col("r")) & (F.col("unit") == F.col("u")))
    sent = sent.select("unit", "root", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("to"), "block", "shingles").where("to <> block").drop("block")
    both = contents.select("unit", "root", F.col("block").alias("to"), "shingles").unionByName(sent)
    return _links(both.select(*group_keys("root", "to"), "unit", none, "shingles"))


def _other_links(contents: DataFrame, classes: DataFrame) -> DataFrame | None:
    """Links between sets of different classes of the groups of several blocks; ``classes`` has node and root of the links so far.

    Classes of a block's size and more have blocks of their own, the others share blocks. All pairs of blocks are compared but those within one class.
    """
    named = classes.select(F.col("node").alias("unit"), F.col("root").alias("class"))
    own = contents.where("blocks > 1").join(named, "unit", "left").withColumn("class", F.coalesce("class", "unit"))
    own = keep(own.select("unit", "root", "class", F.expr("octet_length(shingles) div 8").alias("n")), "classed")
    open_ = own.groupBy("root").agg(F.min("class").alias("x"), F.max("class").alias("y")).where("x <> y").select("root")
    sizes = own.join(open_, "root").groupBy("root", "class").agg(F.count("*").alias("count"), F.sum("n").alias("n"))
    sizes = keep(sizes.withColumn("alone", (F.col("count") >= BLOCK) | (F.col("n") >= BLOCK_SHINGLES)), "sizes")
    if sizes.isEmpty():
        return None
    mixed = sizes.where("not alone").groupBy("root").agg(F.sum("count").alias("count"), F.sum("n").alias("n")).select("root", _blocks_of("count", "n").alias("mixed"))
    plan = sizes.join(mixed, "root", "left")
    block = F.when(F.col("alone"), F.pmod(F.xxhash64("unit"), _blocks_of("count", "n"))).otherwise(F.pmod(F.xxhash64("class"), F.col("mixed")))
    placed = own.select("unit", "root", "class").join(plan, ["root", "class"])
    placed = keep(placed.select("unit", "root", "class", F.when(F.col("alone"), F.col("class")).alias("of"), block.alias("block")), "placed")
    blocks = placed.select("root", "of", "block").distinct()
    one, other = (blocks.select(F.col("root").alias(f"root{k}"), F.col("of").alias(f"of{k}"), F.col("block").alias(f"block{k}"), F.xxhash64("of", "block").alias(f"place{k}")) for k in (1, 2))
    pairs = one.join(other, (F.col("root1") == F.col("root2")) & (F.col("place1") <= F.col("place2")) & F.coalesce(F.col("of1") != F.col("of2"), F.lit(True)))
    sides = F.array(*(F.struct(F.col(f"of{k}").alias("of"), F.col(f"block{k}").alias("block")) for k in (1, 2)))
    sides = pairs.select(F.col("root1").alias("r"), *group_keys("root1", "of1", "block1", "of2", "block2"), F.explode(F.array_distinct(sides)).alias("side"))
    sides = keep(sides.select("r", "g", "h", F.col("side.of").alias("o"), F.col("side.block").alias("b")), "sides")
    sent = placed.join(sides, (F.col("root") == F.col("r")) & F.col("of").eqNullSafe(F.col("o")) & (F.col("block") == F.col("b"))).select("g", "h", "unit", "class")
    return _links(sent.join(contents.select("unit", "shingles"), "unit"))


def near_duplicates(docs: DataFrame, id: str = "doc_id", text: str = "text", words: int = WORDS) -> DataFrame:
    """Columns ``id``, n_shingles, component_id and kept, one row per input row.

    n_shingles is the size of the set of different shingles of the whole text. component_id is the smallest ``id`` reachable over texts of
    similarity 0.8 or more, itself included; kept says whether it is the row's own. Texts that are null or have no words have no shingles and
    are linked with nothing. Rows with a repeated ``id`` keep their rows; a null id is a component's id only if no other is there. An empty table gives no rows.
    """
    kind = docs.schema[id].dataType.simpleString()
    source = docs.select(F.col(id).alias("id"), F.col(text).cast("string").alias("text"))
    source = source.select("id", "text", F.xxhash64("id", "text").alias("key"), F.xxhash64(F.lit(77), "id", "text").alias("other"))
    rows = keep(_sketches(source, kind, words), "sketches")
    least = F.min(F.struct("key", "other"))
    known = rows.where("n > 0").groupBy("unit").agg(F.min("id").alias("least"), least.alias("row"), F.first("n").alias("n"), F.first("buckets").alias("buckets"))
    known = keep(known.select("unit", F.xxhash64("unit").alias("node"), "least", "row.key", "row.other", "n", "buckets"), "sets")
    # candidate groups: each posting is tied to the smallest of its bucket
    posted = known.select("node", F.explode("buckets").alias("bucket"))
    met = posted.groupBy("bucket").agg(F.min("node").alias("center"), F.count("*").alias("m")).where("m > 1")
    edges = keep(posted.join(met, "bucket").where("node <> center").select("node", "center").distinct(), "edges")
    groups = keep(components(edges, "node", "center"), "groups")
    drop(edges)
    members = keep(known.select("unit", "node", "key", "other", "n").join(groups, "node").select("unit", "root", "key", "other", "n"), "members")
    sizes = keep(members.groupBy("root").agg(F.count("*").alias("count"), F.sum("n").alias("total")).select("root", _blocks_of("count", "total").alias("blocks")), "sizes")
    members = members.join(sizes, "root").withColumn("block", F.pmod(F.xxhash64("unit"), F.col("blocks")))
    contents = keep(_contents(source, members, words), "contents")
    links = keep(_first_links(contents), "links")
    found = keep(components(links), "components")
    more = _other_links(contents, found)
    if more is not None:
        # classes so far as stars, and the new links
        found = keep(components(found.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(more)), "components")
    drop(contents)
    # tables on both sides of the joins by class and by set, so that Spark can split those that hold many rows
    classes = keep(found.join(known.select("unit", "least"), F.col("node") == F.col("unit")).groupBy("root").agg(F.min("least").alias("class_least")), "classes")
    of_class = found.join(classes, "root").select(F.col("node").alias("unit"), "class_least")
    of_set = keep(known.select("unit", "least").join(of_class, "unit", "left").select("unit", F.coalesce("class_least", "least").alias("component")), "classes")
    made = rows.select("id", "n", "unit").where("n > 0").join(of_set, "unit").select("id", "n", "component")
    made = made.unionByName(rows.where("n = 0").select("id", "n", F.col("id").alias("component")))
    return made.select(F.col("id").alias(id), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"), F.col("id").eqNullSafe(F.col("component")).alias("kept"))
