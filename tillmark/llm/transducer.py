"""Token counts of byte-level BPE vocabularies by finite-state transducers.

Two machines are compiled. The first reads classes of code points and marks where pre-tokens start. Texts are cut
into chunks of equal length, each chunk's map from every entry state to its exit state is found for all chunks at once, the
maps are composed by a parallel prefix scan, and a second pass from the then known entry states writes the marks. The second machine
reads the bytes of a pre-token. Its state holds what later tokens can depend on: the longest suffix that begins some token, and
the last token and count at each position of that suffix. Transitions are compiled when first
taken and carry by how much the count of emitted tokens changes.
"""

from __future__ import annotations

from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillmark.llm.bpe import Vocabulary
from tillmark.llm.pretokens import DIGIT, LETTER, OTHER, QUOTE, SPACE, WHITE, classes, code_points, split_special
from tillmark.llm.texts import coded, flat, pieces, strings

#: Classes beyond those of ``pretokens``: letters that contractions end with, and the end of a text.
SINGLE, R, V, L, E, END = range(6, 12)
N_CLASSES = 12
STATES = ("begin", "letters", "digits", "others", "space", "spaces", "white", "whites", "quote", "quote_r", "quote_v", "quote_l", "contracted")
HERE, PREVIOUS = 1, 2  # marks: a pre-token starts at this code point, at the one before it


def compile_splitter() -> tuple[np.ndarray, np.ndarray]:
    """Next state and mark for each (state, class)."""
    name = {s: n for n, s in enumerate(STATES)}
    step = np.zeros((len(STATES), N_CLASSES), dtype=np.uint8)
    mark = np.zeros((len(STATES), N_CLASSES), dtype=np.uint8)
    letters = (LETTER, SINGLE, R, V, L, E)
    run_of = {**{c: "letters" for c in letters}, DIGIT: "digits", OTHER: "others", QUOTE: "quote", SPACE: "space", WHITE: "white", END: "begin"}
    for state in STATES:
        for c in range(N_CLASSES):
            to, m = run_of[c], HERE
            if c == END:
                m = 0
            elif c in (SPACE, WHITE):
                if state in ("space", "spaces", "white", "whites"):
                    to, m = to + "s", 0
            elif state in ("space", "spaces"):  # the last space goes with this run
                to, m = ("others" if c == QUOTE else to), (PREVIOUS if state == "spaces" else 0)
            elif state == "whites":
                m = HERE | PREVIOUS
            elif state == "letters" and c in letters or state == "digits" and c == DIGIT:
                m = 0
            elif state in ("others", "quote") and c in (OTHER, QUOTE):
                to, m = "others", 0
            elif state == "quote" and c == SINGLE:
                to, m = "contracted", 0
            elif state == "quote" and c in (R, V, L):
                to, m = {R: "quote_r", V: "quote_v", L: "quote_l"}[c], 0
            elif (state, c) in (("quote_r", E), ("quote_v", E), ("quote_l", L)):
                to, m = "contracted", 0
            if state in ("quote_r", "quote_v", "quote_l") and to != "contracted":  # no contraction: its letter starts a run
                m = PREVIOUS | (0 if c in letters else m)
            step[name[state], c], mark[name[state], c] = name[to], m
    return step, mark


def splitter_classes() -> np.ndarray:
    table = classes().copy()
    for c, kind in (*((ord(x), SINGLE) for x in "stmd"), (ord("r"), R), (ord("v"), V), (ord("l"), L), (ord("e"), E)):
        table[c] = kind
    return table


def run_splitter(kinds: np.ndarray, step: np.ndarray, mark: np.ndarray, chunk: int = 256) -> np.ndarray:
    """Marks of a row of classes in which every text is followed by END."""
    n = len(kinds)
    rows = -(-n // chunk)
    grid = np.full(rows * chunk, END, dtype=np.uint8)
    grid[:n] = kinds
    grid = np.ascontiguousarray(grid.reshape(rows, chunk).T)  # one row for each position within chunks
    flat_step, flat_mark, width = step.ravel(), mark.ravel(), np.uint8(N_CLASSES)
    # chunk maps: the exit state for every entry state
    maps = np.repeat(np.arange(len(STATES), dtype=np.uint8)[:, None], rows, axis=1)
    for at in range(chunk):
        maps = flat_step[maps * width + grid[at]]
    # prefix scan: after it, a chunk's map leads from the state before the first chunk
    reach = 1
    while reach < rows:
        maps[:, reach:] = np.take_along_axis(maps[:, reach:], maps[:, :-reach].copy(), axis=0)
        reach *= 2
    state = np.zeros(rows, dtype=np.uint8)
    state[1:] = maps[0, :-1]
    marks = np.empty((chunk, rows), dtype=np.uint8)
    for at in range(chunk):
        taken = state * width + grid[at]
        marks[at] = flat_mark[taken]
        state = flat_step[taken]
    return marks.T.reshape(-1)[:n]


class Counter:
    """The transducer over the bytes of a pre-token."""

    #: Compiled transitions kept at once; beyond it they are compiled afresh.
    MOST = 2_000_000

    def __init__(self, vocabulary: Vocabulary):
        special = set(vocabulary.special.values())
        self.tokens = {b: i for i, b in vocabulary.bytes_of.items() if i not in special}
        self.begins = {b[:k] for b in self.tokens for k in range(1, len(b) + 1)}
        self.rank = {pair: rank for pair, (rank, _) in vocabulary.merges.items()}
        made = {token: (pair, rank) for pair, (rank, token) in sorted(vocabulary.merges.items(), key=lambda x: -x[1][0])}
        self.made = made
        self.fits: dict[tuple[int, int], bool] = {}
        self.spines: tuple[dict, dict] = {}, {}
        self._clear()

    def _clear(self):
        self.states, self.numbers, self.steps = [], {}, {}
        self._number((b"", (-1,), (0,)))

    def _number(self, state) -> int:
        if state not in self.numbers:
            self.numbers[state] = len(self.states)
            self.states.append(state)
        return self.numbers[state]

    def _spine(self, token: int, side: int) -> list[tuple[int, float]]:
        """The parts of a token that lie at its edge while it is made, with the rank that absorbs each."""
        out = self.spines[side].get(token)
        if out is None:
            whole, out = token, [(token, float("inf"))]
            while token in self.made:
                pair, rank = self.made[token]
                token = pair[side]
                out.append((token, rank))
            self.spines[side][whole] = out
        return out

    def _fit(self, left: int, right: int) -> bool:
        """Whether the merges keep the two tokens apart: no merge across their border comes before the parts are absorbed."""
        key = left, right
        if key not in self.fits:
            rights = self._spine(right, 0)
            self.fits[key] = not any((r := self.rank.get((x, y))) is not None and r < absorbed_x and r <= absorbed_y for x, absorbed_x in self._spine(left, 1) for y, absorbed_y in rights)
        return self.fits[key]

    def _compile(self, number: int, byte: int) -> tuple[int, int]:
        suffix, last, count = self.states[number]
        text = suffix + bytes((byte,))
        for at in range(len(text)):  # longest token first; position ``at`` is where it starts
            token = self.tokens.get(text[at:])
            if token is not None and (last[at] < 0 or self._fit(last[at], token)):
                break
        change = count[at] + 1
        keep = next(k for k in range(len(text) + 1) if k == len(text) or text[k:] in self.begins)
        last, count = (*last, token), (*count, change)
        state = text[keep:], last[keep:], tuple(c - change for c in count[keep:])
        made = self._number(state), change
        self.steps[number << 8 | byte] = made
        return made

    def count(self, word: bytes) -> int:
        if len(self.steps) > self.MOST:
            self._clear()
        steps, state, total = self.steps, 0, 0
        for byte in word:
            found = steps.get(state << 8 | byte)
            state, change = found if found is not None else self._compile(state, byte)
            total += change
        return total


class TextCounter:
    """Token counts of batches of whole texts."""

    STORE = 500_000

    def __init__(self, content: str):
        vocabulary = Vocabulary(content)
        self.special, self.counter = vocabulary.special, Counter(vocabulary)
        if len(self.special) > 1:
            raise ValueError("vocabularies with several special strings are not supported")
        self.step, self.mark = compile_splitter()
        self.kinds = splitter_classes()
        self.store: dict[bytes, int] = {}

    def _starts(self, points: np.ndarray, texts: np.ndarray) -> np.ndarray:
        """Positions of code points at which pre-tokens start."""
        n, many = len(points), len(texts) - 1
        place = np.ones(n + many, dtype=bool)
        ends = texts[1:] + np.arange(many)
        place[ends] = False
        kinds = np.full(n + many, END, dtype=np.uint8)
        kinds[place] = self.kinds[points]
        marks = run_splitter(kinds, self.step, self.mark)
        start = (marks & HERE).astype(bool)
        start[:-1] |= (marks[1:] & PREVIOUS).astype(bool)
        return np.flatnonzero(start[place])

    def batch(self, texts: pa.Array) -> np.ndarray:
        (name, _), *_ = [*self.special.items(), ("", -1)]
        parts, first_part, marks = split_special(texts, name) if name else (texts, np.arange(len(texts) + 1), np.zeros(len(texts), np.int64))
        data, offsets = flat(parts)
        points = code_points(data)
        place = np.zeros(len(points) + 1, dtype=np.int64)
        np.cumsum(1 + (points >= 0x80).astype(np.int64) + (points >= 0x800) + (points >= 0x10000), out=place[1:])
        borders = np.searchsorted(place, offsets)
        at = self._starts(points, borders) if len(points) else np.zeros(0, np.int64)
        first = np.searchsorted(at, borders)
        edges = np.append(place[at], len(data)).astype(np.int64)
        words, index = coded(pa.Array.from_buffers(pa.large_binary(), len(at), [None, pa.py_buffer(edges), pa.py_buffer(np.ascontiguousarray(data))]))
        if len(self.store) > self.STORE:
            self.store = {}
        counts = np.zeros(len(words), dtype=np.int64)
        for k, w in enumerate(words):
            found = self.store.get(w)
            if found is None:
                found = self.store[w] = self.counter.count(w)
            counts[k] = found
        total = np.append(0, np.cumsum(counts[index] if len(index) else np.zeros(0, np.int64)))
        return np.diff(total[first][first_part]) + marks


def token_counts(docs: DataFrame, vocabulary: str, limit: int, id: str = "doc_id", text: str = "text") -> DataFrame:
    """``id``, n_bytes (UTF-8), n_tokens and over_limit (n_tokens > limit) of each row's whole text.

    A null or empty text has 0 bytes and tokens. Special strings inside texts count as their one token. One row per row, repeated rows
    included; an empty table gives none.
    """
    content = docs.sparkSession.sparkContext.broadcast(Path(vocabulary).read_text(encoding="utf-8"))
    kind = docs.schema[id].dataType.simpleString()

    def run(batches):
        counter = TextCounter(content.value)
        for batch in batches:
            for part in pieces(batch):
                texts = strings(part.column("text"))
                n = counter.batch(texts)
                size = np.diff(flat(texts)[1])
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(size), pa.array(n), pa.array(n > limit)], ["id", "n_bytes", "n_tokens", "over_limit"])

    made = docs.select(F.col(id).alias("id"), F.col(text).cast("string").alias("text")).mapInArrow(run, f"id {kind}, n_bytes bigint, n_tokens bigint, over_limit boolean")
    return made.withColumnRenamed("id", id)
