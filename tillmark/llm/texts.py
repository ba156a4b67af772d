"""Whole columns of text as flat byte arrays, so that splitting and counting run in numpy and Arrow.

A record batch is cut into pieces of bounded size at row borders; one very long text makes a piece of its own.
"""

from __future__ import annotations

import ctypes

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: The separators of words: space and U+0009 to U+000D.
SEPARATOR = np.zeros(256, dtype=bool)
SEPARATOR[[32, 9, 10, 11, 12, 13]] = True

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def strings(column) -> pa.Array:
    """A text column as one Arrow array without nulls (a null text is an empty one)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    return pc.fill_null(column, "") if column.null_count else column


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts behind each other, and where each text starts (one more entry for the end)."""
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def pieces(batch, limit: int = 2 << 20, text: str = "text"):
    """Slices of a record batch (or table) of about ``limit`` bytes of text each."""
    n = batch.num_rows
    if not n:
        return
    sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < n:
        used = sizes[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(sizes, used + limit, side="right")))
        yield batch.slice(at, to - at)
        at = to


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words, and for each text the index of its first word (one more entry for the end)."""
    inside = np.zeros(len(data) + 2, dtype=bool)
    inside[1:-1] = ~SEPARATOR[data]
    border = np.zeros(len(data) + 1, dtype=bool)
    border[offsets] = True
    starts = np.flatnonzero(inside[1:-1] & (~inside[:-2] | border[:-1]))
    ends = np.flatnonzero(inside[1:-1] & (~inside[2:] | border[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def token_array(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The given spans (ascending, not overlapping) as an Arrow array of byte strings."""
    lengths = ends - starts
    offsets = np.zeros(len(lengths) + 1, dtype=np.int64)
    np.cumsum(lengths, out=offsets[1:])
    if len(starts) and offsets[-1] != ends[-1] - starts[0]:
        step = np.zeros(len(data) + 1, dtype=np.int8)
        step[starts] += 1
        np.subtract.at(step, ends, 1) if len(np.unique(ends)) != len(ends) else step.__setitem__(ends, step[ends] - 1)
        data = data[np.cumsum(step[:-1], dtype=np.int8).astype(bool)]
    elif len(starts):
        data = data[starts[0] : ends[-1]]
    return pa.Array.from_buffers(pa.large_binary(), len(lengths), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))])


def coded(tokens: pa.Array) -> tuple[list[bytes], np.ndarray]:
    """Distinct tokens, and for each token the index of its own among them."""
    made = tokens.dictionary_encode()
    return made.dictionary.to_numpy(zero_copy_only=False).tolist(), made.indices.to_numpy(zero_copy_only=False)


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """All positions start, start + 1, ... of runs of the given lengths, behind each other."""
    ends = np.cumsum(lengths)
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(ends[-1] if len(ends) else 0)


def give_back() -> None:
    """Hand freed memory back to the system: Python workers live on after a task, and would keep the most it ever held."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim:
        trim(0)
