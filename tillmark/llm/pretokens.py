"""Pre-tokens of byte-level BPE vocabularies over whole batches of text.

The splitting pattern of these vocabularies is: contractions; letters, digits or other signs, each run with one
space before it; white space, whose last character goes with what follows if it is a space. Where a run starts depends on the
neighbouring characters only, so the starts of all texts of a batch are found by array operations.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import regex

SPACE, WHITE, LETTER, DIGIT, OTHER, QUOTE = range(6)
#: The endings of contractions. Fixed values.
ENDINGS = ("s", "t", "re", "ve", "m", "ll", "d")
#: Unicode white space. Fixed values.
WHITE_SPACE = "\t\n\x0b\x0c\r \x85\xa0                　"

_classes: list[np.ndarray] = []


def classes() -> np.ndarray:
    """The class of each code point, made once in a process from its Unicode properties."""
    if not _classes:
        points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
        every = "".join(map(chr, points))
        table = np.full(0x110000, OTHER, dtype=np.uint8)
        where = np.array(points)
        for kind, pattern in ((LETTER, r"\p{L}+"), (DIGIT, r"\p{N}+")):
            for m in regex.finditer(pattern, every):
                table[where[m.start() : m.end()]] = kind
        table[[ord(c) for c in WHITE_SPACE]] = WHITE
        table[ord(" ")] = SPACE
        table[ord("'")] = QUOTE
        _classes.append(table)
    return _classes[0]


def code_points(data: np.ndarray) -> np.ndarray:
    return np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), dtype=np.uint32)


def starts_of(points: np.ndarray, texts: np.ndarray) -> np.ndarray:
    """True where a pre-token starts. ``texts``: where each text starts, and the end."""
    n = len(points)
    kind = classes()[points]
    white = kind <= WHITE
    group = np.minimum(kind, OTHER)  # an apostrophe is another sign, but for contractions
    first = np.zeros(n + 1, dtype=bool)
    first[texts] = True
    first, last = first[:n], first[1:]
    before = np.empty(n, dtype=np.uint8)
    before[1:] = kind[:-1]
    before[:1] = 255
    before[first] = 255  # nothing
    white_before = before <= WHITE
    white_after = np.zeros(n, dtype=bool)
    white_after[:-1] = white[1:]
    white_after[last] = True  # the end of a text: the white space stays in one piece
    starts = np.where(white, ~white_before | ~white_after, np.where(white_before, before == WHITE, np.minimum(before, OTHER) != group))
    starts[first] = True
    quotes = np.flatnonzero((kind == QUOTE) & starts & (before != SPACE))
    if len(quotes):
        end_of_text = texts[np.searchsorted(texts, quotes, side="right")]
        done = np.zeros(len(quotes), dtype=bool)
        for ending in ENDINGS:
            ok = ~done & (quotes + len(ending) < end_of_text)
            for k, c in enumerate(ending, 1):
                ok &= points[np.minimum(quotes + k, n - 1)] == ord(c)
            done |= ok
            at = quotes[ok]
            starts[at + 1] = False
            after = at + 1 + len(ending)
            after = after[after < n]
            starts[after] = True
    return starts


def spans(data: np.ndarray, offsets: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """The pre-tokens of all texts as byte strings, and for each text the index of its first (one more entry)."""
    points = code_points(data)
    if len(points) == len(data):
        texts, place = offsets, None
    else:
        width = 1 + (points >= 0x80).astype(np.int64) + (points >= 0x800) + (points >= 0x10000)
        place = np.zeros(len(points) + 1, dtype=np.int64)
        np.cumsum(width, out=place[1:])
        texts = np.searchsorted(place, offsets)
    at = np.flatnonzero(starts_of(points, texts)) if len(points) else np.zeros(0, dtype=np.int64)
    first = np.searchsorted(at, texts)
    at = at if place is None else place[at]
    borders = np.append(at, len(data)).astype(np.int64)
    return pa.Array.from_buffers(pa.large_binary(), len(at), [None, pa.py_buffer(borders), pa.py_buffer(np.ascontiguousarray(data))]), first


def split_special(texts: pa.Array, special: str) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Texts cut at a special string: the parts between, where each text's parts start, and which texts have it.

    Parts of one text lie behind each other; the special token stands between any two of them.
    """
    import pyarrow.compute as pc

    count = pc.count_substring(texts, special).to_numpy(zero_copy_only=False).astype(np.int64) if len(texts) else np.zeros(0, np.int64)
    if count.any():
        parts = pc.split_pattern(texts, special)
        first = np.asarray(parts.offsets.to_numpy(), dtype=np.int64)
        return parts.flatten(), first - first[0], count
    return texts, np.arange(len(texts) + 1), count
