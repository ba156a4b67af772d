"""Whole groups of rows out of sorted batches, for functions of mapInArrow."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows that are worked through together, about; a group that is larger comes alone.
ROWS = 20_000
#: The two hashes that stand for a group.
KEYS = ("g", "h")


def group_keys(*columns: Column | str) -> list[Column]:
    """128 bits of hash of the given columns, nulls included, as columns g and h."""
    return [F.xxhash64(*columns).alias("g"), F.xxhash64(F.lit(77), *columns).alias("h")]


def dealt(df: DataFrame, *order: Column | str) -> DataFrame:
    """``df`` with the rows of each (g, h) together in one task, in the given order."""
    return df.repartition(*KEYS).sortWithinPartitions(*KEYS, *order)


def whole_groups(batches: Iterator[pa.RecordBatch], rows: int = ROWS) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole groups, and where each group starts (one more entry for the end)."""
    held, many = [], 0
    for batch in batches:
        held.append(batch)
        many += batch.num_rows
        if many < rows:
            continue
        table = pa.Table.from_batches(held)
        starts = _starts(table)
        whole = int(starts[-2])  # the last group may go on
        if whole:
            yield table.slice(0, whole).combine_chunks(), starts[:-1]
            held, many = table.slice(whole).to_batches(), many - whole
        else:
            rows = max(rows, 2 * many)  # one large group: look again when it has doubled
    if many:
        table = pa.Table.from_batches(held).combine_chunks()
        yield table, _starts(table)


def _starts(table: pa.Table) -> np.ndarray:
    new = np.zeros(table.num_rows, dtype=bool)
    new[:1] = True
    for key in KEYS:
        x = table.column(key).to_numpy()
        new[1:] |= x[1:] != x[:-1]
    return np.append(np.flatnonzero(new), table.num_rows)


def runs_of_keys(batches: Iterator[pa.RecordBatch], *keys: str) -> Iterator[tuple[tuple[int, ...], pa.RecordBatch]]:
    """Slices of sorted batches in which the given integer columns do not change, with their values."""
    for batch in batches:
        columns = [batch.column(c).to_numpy() for c in keys]
        new = np.zeros(batch.num_rows, dtype=bool)
        new[:1] = True
        for x in columns:
            new[1:] |= x[1:] != x[:-1]
        starts = np.flatnonzero(new)
        for a, b in zip(starts, np.append(starts[1:], batch.num_rows)):
            yield tuple(int(x[a]) for x in columns), batch.slice(a, b - a)
