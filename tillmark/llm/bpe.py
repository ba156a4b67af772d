"""Byte-pair encoding and decoding with a public byte-level vocabulary.

Each different pre-token of a task is encoded once: its bytes form a doubly linked list of symbols, a priority
queue holds the merges of neighbours by rank, entries whose symbols have changed meanwhile are skipped. Decoding
concatenates the byte strings of the vocabulary.
"""

from __future__ import annotations

import heapq
import json
from array import array
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillmark.llm.pretokens import spans, split_special
from tillmark.llm.texts import coded, flat, pieces, ragged, strings


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in vocabulary files: itself if it can be printed, else one from U+0100 on."""
    printed = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in printed]
    return {**{chr(b): b for b in printed}, **{chr(256 + n): b for n, b in enumerate(hidden)}}


class Vocabulary:
    """The merges, tokens and special strings of a byte-level vocabulary file (its text)."""

    def __init__(self, content: str):
        made = json.loads(content)
        letters = byte_letters()
        ids = made["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in made["added_tokens"]}
        self.bytes_of: dict[int, bytes] = {i: bytes(letters[c] for c in t) for t, i in ids.items() if t not in self.special}
        self.bytes_of |= {i: t.encode() for t, i in self.special.items()}
        self.of_byte = [ids[c] for c, _ in sorted(letters.items(), key=lambda x: x[1])]
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}  # pair of ids -> rank, id of the merged token
        for rank, pair in enumerate(made["model"]["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            self.merges[ids[left], ids[right]] = rank, ids[left + right]
        self.size = max(self.bytes_of) + 1


def encode_word(word: bytes, vocabulary: Vocabulary) -> list[int]:
    """Token ids of one pre-token."""
    merges = vocabulary.merges
    symbol = [vocabulary.of_byte[b] for b in word]
    n = len(symbol)
    if n < 2:
        return symbol
    after = list(range(1, n + 1))
    before = list(range(-1, n - 1))
    queue = []
    for i in range(n - 1):
        found = merges.get((symbol[i], symbol[i + 1]))
        if found:
            queue.append((found[0], i, symbol[i], symbol[i + 1], found[1]))
    heapq.heapify(queue)
    while queue:
        _, i, left, right, made = heapq.heappop(queue)
        j = after[i]
        if symbol[i] != left or j >= n or symbol[j] != right:
            continue  # one of the two has been merged since
        symbol[i], symbol[j] = made, -1
        k = after[i] = after[j]
        if k < n:
            before[k] = i
            found = merges.get((made, symbol[k]))
            if found:
                heapq.heappush(queue, (found[0], i, made, symbol[k], found[1]))
        h = before[i]
        if h >= 0:
            found = merges.get((symbol[h], made))
            if found:
                heapq.heappush(queue, (found[0], h, symbol[h], made, found[1]))
    return [s for s in symbol if s >= 0]


class Encoder:
    """Ids of whole batches of text; ``new_words`` encodes pre-tokens not seen before."""

    #: Bytes of words kept for later batches of the same task; beyond it the store starts afresh.
    STORE = 64 << 20

    def __init__(self, special: dict[str, int], new_words):
        self.special, self.new_words = special, new_words
        self._forget()

    def _forget(self) -> None:
        self.store: dict[bytes, int] = {}  # word -> its number
        self.ids, self.borders = array("I"), array("q", [0])  # the ids of all stored words by number, and where each word's end
        self.stored = 0

    def _words(self, tokens: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all pre-tokens behind each other, and how many each has."""
        if self.stored > self.STORE:
            self._forget()
        words, index = coded(tokens)
        if not len(index):
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        get = self.store.get
        number = np.array([get(w, -1) for w in words], dtype=np.int64)
        unknown = np.flatnonzero(number < 0)
        if len(unknown):
            new = [words[k] for k in unknown.tolist()]
            lengths = []
            for made in self.new_words(new):
                self.ids.extend(made)
                lengths.append(len(made))
            self.borders.extend((self.borders[-1] + np.cumsum(lengths)).tolist())
            number[unknown] = np.arange(len(self.store), len(self.store) + len(new))
            self.store.update(zip(new, number[unknown].tolist()))
            self.stored += sum(map(len, new)) * 5 + 180 * len(new)
        borders = np.array(self.borders, dtype=np.int64)
        begin = borders[number]
        length = (borders[number + 1] - begin)[index]
        return np.array(self.ids, dtype=np.uint32)[ragged(begin[index], length)], length

    def batch(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts behind each other, and where each text's ids start (one more entry)."""
        if len(self.special) > 1:
            raise ValueError("vocabularies with several special strings are not supported")
        (name, token), *_ = [*self.special.items(), ("", -1)]
        parts, first_part, marks = split_special(texts, name) if name else (texts, np.arange(len(texts) + 1), np.zeros(len(texts), np.int64))
        tokens, first = spans(*flat(parts))
        ids, length = self._words(tokens)
        at = np.append(0, np.cumsum(length))[first]  # ids before each part
        if marks.any():
            inner = np.setdiff1d(np.arange(len(parts)), first_part[:-1])  # parts after a special string
            ids = np.insert(ids, at[inner], token)
            before = np.zeros(len(parts) + 1, dtype=np.int64)
            before[inner + 1] = 1
            at = at + np.cumsum(before)
            return ids.astype(np.uint32), at[first_part]
        return ids, at[first_part]


def own_encoder(content: str) -> Encoder:
    vocabulary = Vocabulary(content)
    return Encoder(vocabulary.special, lambda words: [encode_word(w, vocabulary) for w in words])


class Decoder:
    def __init__(self, known: Vocabulary):
        self.table = [known.bytes_of.get(i, b"") for i in range(known.size)]

    def text(self, packed: bytes | None) -> str | None:
        """The text of ids packed as little-endian unsigned 32-bit integers. Bytes that are no UTF-8 become U+FFFD."""
        return None if packed is None else b"".join(map(self.table.__getitem__, np.frombuffer(packed, "<u4").tolist())).decode("utf-8", "replace")


def encode(docs: DataFrame, vocabulary: str, columns: list[str], text: str = "text", decoded: bool = False) -> DataFrame:
    """The given columns, n_tokens and ids (little-endian unsigned 32-bit integers) of each row's whole text.

    With ``decoded`` also the text that decoding these ids gives, made by the same Python worker (a second one for each
    task would need as much memory again).

    ``vocabulary`` is the path of the vocabulary file as the driver sees it; the tasks get its content. Special strings
    inside texts become their special token, no token is added. A null or empty text has no tokens. One row per row, repeated rows included; an
    empty table gives none. A given column named like a result gives way to it.
    """
    columns = [c for c in columns if c not in ("n_tokens", "ids", "decoded")]
    content = docs.sparkSession.sparkContext.broadcast(Path(vocabulary).read_text(encoding="utf-8"))
    kinds = ", ".join(f"k{n} {docs.schema[c].dataType.simpleString()}" for n, c in enumerate(columns))

    def run(batches):
        encoder = own_encoder(content.value)
        decoder = Decoder(Vocabulary(content.value)) if decoded else None
        for batch in batches:
            for part in pieces(batch):
                ids, at = encoder.batch(strings(part.column("text")))
                data = ids.astype("<u4").tobytes()
                packed = pa.Array.from_buffers(pa.large_binary(), len(at) - 1, [None, pa.py_buffer((at * 4).astype(np.int64)), pa.py_buffer(data)])
                more = [pa.array([decoder.text(p) for p in packed.to_pylist()], pa.string())] if decoder else []
                yield pa.RecordBatch.from_arrays([*(part.column(f"k{n}") for n in range(len(columns))), pa.array(np.diff(at)), packed.cast(pa.binary()), *more], [*(f"k{n}" for n in range(len(columns))), "n_tokens", "ids", "decoded"][: len(columns) + 2 + len(more)])

    chosen = docs.select(*(F.col(c).alias(f"k{n}") for n, c in enumerate(columns)), F.col(text).cast("string").alias("text"))
    made = chosen.mapInArrow(run, f"{kinds}{', ' * bool(columns)}n_tokens bigint, ids binary{', decoded string' * decoded}")
    return made.select(*(F.col(f"k{n}").alias(c) for n, c in enumerate(columns)), "n_tokens", "ids", *["decoded"] * decoded)


def decode(tokens: DataFrame, vocabulary: str, columns: list[str], ids: str = "ids") -> DataFrame:
    """The given columns and decoded: the text of each row's ids (null for null), specials written out.

    One row per row; an empty table gives none. A given column named like the result gives way to it.
    """
    columns = [c for c in columns if c != "decoded"]
    content = tokens.sparkSession.sparkContext.broadcast(Path(vocabulary).read_text(encoding="utf-8"))
    kinds = ", ".join(f"k{n} {tokens.schema[c].dataType.simpleString()}" for n, c in enumerate(columns))

    def run(batches):
        decoder = Decoder(Vocabulary(content.value))
        for batch in batches:
            for part in pieces(batch, text="ids"):
                texts = [decoder.text(p) for p in part.column("ids").to_pylist()]
                yield pa.RecordBatch.from_arrays([*(part.column(f"k{n}") for n in range(len(columns))), pa.array(texts, pa.string())], [*(f"k{n}" for n in range(len(columns))), "decoded"])

    made = tokens.select(*(F.col(c).alias(f"k{n}") for n, c in enumerate(columns)), F.col(ids).alias("ids")).mapInArrow(run, f"{kinds}{', ' * bool(columns)}decoded string")
    return made.select(*(F.col(f"k{n}").alias(c) for n, c in enumerate(columns)), "decoded")
