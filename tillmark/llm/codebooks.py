"""Vector code compression: integer vectors in parts, each part named by the nearest entry of its codebook.

Distances go over per-dimension value dictionaries. Of a block of vectors each dimension holds few different integers: their squared
differences to all entries are tabulated once, and the distance of a part is gathered from these tables by the block's dictionary codes and
added up over the part's dimensions. All is exact in whole numbers. A task keeps nothing but one block, the codebooks and its sums; Spark adds the
sums of all tasks, and the codebooks (a fixed size) are all that reaches the driver.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillmark.llm.store import drop, keep

SCALE, PARTS, ENTRIES, ROUNDS = 1024, 4, 256, 4
#: Vectors in a block.
BLOCK = 2048


def largest(wide: int) -> int:
    """The largest integer component for which the squared distance of a part of ``wide`` dimensions fits a long."""
    return 1 << min(26, (60 - int(wide).bit_length()) // 2)


def finite(vector: Column) -> Column:
    """Whether a vector is there and all its components are there and finite (Spark ranks NaN above infinity)."""
    return vector.isNotNull() & F.forall(vector, lambda x: x.isNotNull() & (F.abs(x) < float("inf")))


def distances(block: np.ndarray, book: np.ndarray) -> np.ndarray:
    """Squared distances of each row of ``block`` (rows x dimensions) to each entry of ``book`` (entries x dimensions)."""
    reach = int(np.abs(block).max(initial=0)) + int(np.abs(book).max(initial=0))
    kind = np.int32 if block.shape[1] * reach * reach < 1 << 31 else np.int64
    total = np.zeros((len(block), len(book)), dtype=kind)
    gathered = np.empty_like(total)
    for j in range(block.shape[1]):
        values, code = np.unique(block[:, j], return_inverse=True)
        table = (values.astype(kind)[:, None] - book[:, j].astype(kind)[None, :]) ** 2
        total += np.take(table, code, axis=0, out=gathered, mode="clip")
    return total


def assign(block: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row the nearest entry of every part (ties to the lower index) and the squared distance to it, both rows x parts."""
    wide = books.shape[2]
    codes, errors = np.zeros((len(block), len(books)), np.int64), np.zeros((len(block), len(books)), np.int64)
    for p, book in enumerate(books):
        apart = distances(block[:, p * wide : (p + 1) * wide], book)
        codes[:, p] = apart.argmin(axis=1)
        errors[:, p] = apart[np.arange(len(block)), codes[:, p]]
    return codes, errors


def _blocks(batch: pa.RecordBatch, wide: int):
    """Slices of a batch and their vectors as rows of integers."""
    for at in range(0, batch.num_rows, BLOCK):
        part = batch.slice(at, BLOCK)
        yield part, part.column("v").flatten().to_numpy().astype(np.int64).reshape(part.num_rows, wide)


def _sums(rows: DataFrame, books: np.ndarray) -> dict[int, int]:
    """Per cell (part, entry, dimension, or one more for the count) the total over all rows."""
    parts, entries, wide = books.shape

    def run(batches):
        total = np.zeros((parts, entries, wide + 1), dtype=np.int64)
        for batch in batches:
            for _, block in _blocks(batch, parts * wide):
                codes, _ = assign(block, books)
                for p in range(parts):
                    order = np.argsort(codes[:, p], kind="stable")
                    own = codes[order, p]
                    first = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
                    entry = own[first]
                    total[p, entry, :wide] += np.add.reduceat(block[order, p * wide : (p + 1) * wide], first, axis=0)
                    total[p, entry, wide] += np.diff(np.append(first, len(own)))
        flat = total.ravel()
        cell = np.flatnonzero(flat)
        yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(flat[cell])], ["cell", "total"])

    made = rows.select("v").mapInArrow(run, "cell long, total long").groupBy("cell").agg(F.sum("total").alias("total"))
    return {r["cell"]: r["total"] for r in made.collect()}  # at most parts x entries x (dimensions + 1) rows


def train(rows: DataFrame, start: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """Codebooks (parts x entries x dimensions) after ``rounds`` rounds from ``start``; ``rows`` has the integer vectors in v.

    An entry becomes floor(sum / count) of its parts in each dimension; one without parts stays.
    """
    books = start
    for _ in range(rounds):
        flat = np.zeros(books.shape[:2] + (books.shape[2] + 1,), dtype=np.int64)
        for cell, total in _sums(rows, books).items():
            flat.ravel()[cell] = total
        count = flat[..., -1:]
        books = np.where(count > 0, flat[..., :-1] // np.maximum(count, 1), books)
    return books


def digest(books: np.ndarray) -> str:
    """sha256 of all components as decimal text, by part, entry and position."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def compress(df: DataFrame, id: str = "vec_id", vector: str = "embedding", carried: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, np.ndarray]:
    """Columns ``id``, ``carried``, code (two hex digits a part) and error (squared distance) of each row, and the codebooks.

    Components are floor(1024 x). Rows whose vector is null or has a component that is null or not finite are left out. Codebooks start from the
    vectors of the smallest ids (null ids last, rows of one id in the order of their vectors, repeats count). Rows that cannot be compared
    with the others keep a null code and error: those of another length than the vector of the smallest id, and those with components
    beyond ``largest`` (65,536 before scaling, for parts of up to 128 dimensions). An empty table gives no rows and codebooks without entries. A length that ``parts`` does not divide is an error.
    """
    if entries > 256:
        raise ValueError("a code has two hex digits")
    x = F.col(vector).cast("array<double>")
    whole = F.transform(x, lambda c: F.floor(c * F.lit(float(SCALE))))
    fits = F.forall(x, lambda c: F.abs(c) <= float((1 << 26) // SCALE))
    rows = keep(df.where(finite(x)).select(F.col(id).alias("id"), F.col(carried).alias("carried"), F.size(x).alias("length"), F.when(fits, F.transform(whole, lambda c: c.cast("int"))).alias("v")), "vectors")
    order = [F.col("id").asc_nulls_last(), F.col("v")]
    first = rows.where("v is not null").orderBy(*order).limit(1).collect()
    length = first[0]["length"] if first else 0
    if length % parts:
        raise ValueError(f"vectors of {length} components cannot be cut into {parts} equal parts")
    wide = length // parts
    bound = F.lit(largest(max(wide, 1)))
    fine = F.col("v").isNotNull() & (F.col("length") == length) & F.forall("v", lambda c: F.abs(c) <= bound)
    coded = rows.where(fine)
    start = coded.orderBy(*order).limit(entries).select("v").collect()  # a fixed number of vectors
    books = np.array([r["v"] for r in start], dtype=np.int64).reshape(len(start), parts, wide).transpose(1, 0, 2)
    books = train(coded, books, rounds) if len(start) and wide else books

    def run(batches):
        for batch in batches:
            for part, block in _blocks(batch, parts * wide):
                codes, errors = assign(block, books)
                text = [row.tobytes().hex() for row in codes.astype(np.uint8)]
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("carried"), pa.array(text, pa.string()), pa.array(errors.sum(axis=1))], ["id", "carried", "code", "error"])

    kinds = f"id {rows.schema['id'].dataType.simpleString()}, carried {rows.schema['carried'].dataType.simpleString()}, code string, error long"
    none = rows.where(~F.coalesce(fine, F.lit(False))).select("id", "carried", F.lit(None).cast("string").alias("code"), F.lit(None).cast("long").alias("error"))
    made = keep(coded.select("id", "carried", "v").mapInArrow(run, kinds).unionByName(none), "codes")
    drop(rows)
    return made.select(F.col("id").alias(id), F.col("carried").alias(carried), "code", "error"), books


def restore(coded: DataFrame, books: np.ndarray, columns: list[str]) -> DataFrame:
    """The given columns and restored: the vectors that the codes stand for, scaled back. A null code gives null."""
    kinds = "".join(f"k{n} {coded.schema[c].dataType.simpleString()}, " for n, c in enumerate(columns))

    def run(batches):
        for batch in batches:
            vectors = [None if c is None else np.concatenate([books[p, e] for p, e in enumerate(bytes.fromhex(c))]) / SCALE for c in batch.column("code").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(f"k{n}") for n in range(len(columns))), pa.array(vectors, pa.list_(pa.float64()))], [*(f"k{n}" for n in range(len(columns))), "restored"])

    made = coded.select(*(F.col(c).alias(f"k{n}") for n, c in enumerate(columns)), "code").mapInArrow(run, f"{kinds}restored array<double>")
    return made.select(*(F.col(f"k{n}").alias(c) for n, c in enumerate(columns)), "restored")


def with_group_errors(coded: DataFrame, carried: str = "label", name: str = "label_error") -> DataFrame:
    """``coded`` with the errors summed over rows of equal ``carried`` (nulls are equal). A hot value is summed before it is shuffled; Spark can split its join."""
    totals = keep(coded.groupBy(F.col(carried).alias("of")).agg(F.sum("error").alias(name)), "errors")
    return coded.join(totals, F.col(carried).eqNullSafe(F.col("of"))).drop("of")
