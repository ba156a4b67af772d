"""Quality scores by logistic regression over hashed word n-grams, trained with follow-the-regularised-leader updates."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillmark.llm.texts import SEPARATOR, flat, pieces, ragged, strings

#: A sequence of ASCII letters or digits or of bytes beyond ASCII is a word, a sequence of other signs is one too.
_KIND = np.full(256, 2, dtype=np.uint8)
_KIND[SEPARATOR] = 0
_KIND[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = 1
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)  # 2^64 over the golden ratio


REPEATS = (1, 2, 3, 4)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(29))) * _MULTIPLIER
    return x ^ (x >> np.uint64(32))


def hashed(data: np.ndarray, offsets: np.ndarray, bits: int, longest: int = 2) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers (below 2 ** bits) of the word n-grams of all texts, text by text, and where each text's start.

    The features of a text are its words in order, then its pairs of words (and so on up to ``longest``), then one for each word
    that is the same as the one 1, 2, 3 or 4 places before it: n-grams of equal words share a feature, whatever the word.
    """
    kind = _KIND[data]
    n = len(data)
    new = np.ones(n, dtype=bool)
    new[1:] = kind[1:] != kind[:-1]
    new[offsets[:-1][offsets[:-1] < n]] = True
    starts = np.flatnonzero(new)
    starts = starts[kind[starts] > 0]
    first = np.searchsorted(starts, offsets)
    edge = np.flatnonzero(np.append(new, True))
    ends = edge[np.searchsorted(edge, starts) + 1] if len(starts) else starts
    # a polynomial of the word's bytes modulo 2^64, eight bytes at most in each step
    word = np.full(len(starts), 0x243F6A88, dtype=np.uint64)
    length = ends - starts
    live = np.arange(len(starts))
    k = 0
    while len(live):
        live = live[length[live] > k]
        word[live] = (word[live] ^ data[starts[live] + k]) * _MULTIPLIER
        word[live] ^= word[live] >> np.uint64(31)
        k += 1
    size = np.diff(first)
    made = [_mixed(word)]
    for step in range(1, longest):
        longer = np.zeros_like(word)
        longer[:-step or None] = _mixed(made[-1][: len(word) - step] * np.uint64(3) + np.roll(word, -step)[: len(word) - step]) if len(word) > step else longer[: len(word) - step]
        made.append(longer)
    firsts = [first[:-1]] * longest
    counts = [np.maximum(size - step, 0) for step in range(longest)]
    text_of = np.repeat(np.arange(len(size)), size)
    for back in REPEATS:
        again = np.flatnonzero((word[back:] == word[:-back]) & (text_of[back:] == text_of[:-back]))
        counts.append(np.bincount(text_of[again], minlength=len(size)))
        firsts.append(np.cumsum(counts[-1]) - counts[-1])
        made.append(np.full(len(again), back, dtype=np.uint64) << np.uint64(64 - bits))
    total = np.append(0, np.cumsum(sum(counts)))
    out = np.empty(total[-1], dtype=np.int64)
    at = total[:-1].copy()
    for values, many, begin in zip(made, counts, firsts):
        out[ragged(at, many)] = (values >> np.uint64(64 - bits)).astype(np.int64)[ragged(begin, many)]
        at = at + many
    return out, total


class Ftrl:
    """Per-coordinate follow-the-regularised-leader for logistic loss, one example at a time."""

    def __init__(self, bits: int, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.0, l2: float = 1e-3):
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z, self.n = np.zeros(1 << bits), np.zeros(1 << bits)
        self.zb = self.nb = 0.0

    def _weights(self, z, n):
        return np.where(np.abs(z) <= self.l1, 0.0, -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2))

    def learn(self, ids: np.ndarray, label: int) -> None:
        ids, counts = np.unique(ids, return_counts=True)
        x = values(counts)
        w, bias = self._weights(self.z[ids], self.n[ids]), float(self._weights(self.zb, self.nb))
        p = 1 / (1 + np.exp(-np.clip(w @ x + bias, -35, 35)))
        g = (p - label) * x
        sigma = (np.sqrt(self.n[ids] + g * g) - np.sqrt(self.n[ids])) / self.alpha
        self.z[ids] += g - sigma * w
        self.n[ids] += g * g
        gb = p - label
        sigma = (np.sqrt(self.nb + gb * gb) - np.sqrt(self.nb)) / self.alpha
        self.zb += gb - sigma * bias
        self.nb += gb * gb

    def model(self) -> tuple[np.ndarray, float]:
        return self._weights(self.z, self.n).astype(np.float32), float(self._weights(self.zb, self.nb))


#: Length of a text's vector of feature shares, so that weights of moderate size decide.
SCALE = 20.0


def values(counts: np.ndarray) -> np.ndarray:
    return counts * (SCALE / max(1, counts.sum()))


def training_rows(docs: DataFrame, labels: DataFrame, learn: Column, most: int, id: str = "doc_id", text: str = "text", label: str = "quality") -> list[tuple[str, int]]:
    """Up to ``most`` whole texts of each label, those first in the order of a hash of ``id``, each label's in turn.

    The sample is bounded and the same for the same tables. Rows without a label, and texts that are null, are left out; of
    several labels of one id the smallest counts.
    """
    marks = labels.where(F.col(label).isNotNull()).groupBy(F.col(id).alias("id")).agg(F.min(F.col(label).cast("int")).alias("label"))
    known = docs.where(learn & F.col(text).isNotNull()).select(F.col(id).alias("id"), F.col(text).cast("string").alias("text"), F.xxhash64(id).alias("order"), F.xxhash64(text).alias("hash"))
    chosen = []
    for value in (0, 1):
        # hashes first, so that texts of the chosen rows only are moved, and repeated rows once
        keys = marks.where(F.col("label") == value).join(known.select("id", "order", "hash"), "id").select("order", "id", "hash").distinct().orderBy("order", "id", "hash").limit(most)
        rows = known.join(F.broadcast(keys.select("id", "hash")), ["id", "hash"]).dropDuplicates(["id", "hash"]).select("order", "id", "text")  # ``most`` keys
        chosen.append([(r["text"], value) for r in sorted(rows.collect(), key=lambda r: (r["order"], r["id"], r["text"]))])
    longest = max(map(len, chosen))
    both = [[rows[k % len(rows)] for k in range(longest)] if rows else [] for rows in chosen]  # labels in equal parts
    return [row for pair in zip(*both) for row in pair] if all(both) else chosen[0] + chosen[1]


def train(rows: list[tuple[str, int]], bits: int = 20, rounds: int = 3) -> tuple[np.ndarray, float]:
    """Weights of all features and the bias. Without rows all are zero, so that every score is one half."""
    leader = Ftrl(bits)
    if rows:
        ids, at = hashed(*flat(strings(pa.array([t for t, _ in rows], pa.string()))), bits)
        for _ in range(rounds):
            for k, (_, label) in enumerate(rows):
                leader.learn(ids[at[k] : at[k + 1]], label)
    return leader.model()


def score(docs: DataFrame, model: tuple[np.ndarray, float], columns: list[str], text: str = "text") -> DataFrame:
    """The given columns and quality_score (0 to 1) of each row's whole text, by a sparse dot product.

    A null or empty text has the score of the bias. One row per row, repeated rows included; an empty table gives none. A given column named
    like the result gives way to it.
    """
    columns = [c for c in columns if c != "quality_score"]
    weights, bias = model
    bits = int(len(weights)).bit_length() - 1
    shared = docs.sparkSession.sparkContext.broadcast(weights.tobytes())  # 4 bytes for each of 2 ** bits weights, whatever the input
    kinds = "".join(f"k{n} {docs.schema[c].dataType.simpleString()}, " for n, c in enumerate(columns))

    def run(batches):
        w = np.frombuffer(shared.value, dtype=np.float32)
        for batch in batches:
            for part in pieces(batch):
                ids, at = hashed(*flat(strings(part.column("text"))), bits)
                size = np.diff(at)
                sums = np.zeros(len(size))
                full = size > 0
                if full.any():
                    sums[full] = np.add.reduceat(w[ids].astype(np.float64), at[:-1][full])
                x = np.clip(sums * SCALE / np.maximum(1, size) + bias, -35, 35)
                yield pa.RecordBatch.from_arrays([*(part.column(f"k{n}") for n in range(len(columns))), pa.array(1 / (1 + np.exp(-x)))], [*(f"k{n}" for n in range(len(columns))), "score"])

    made = docs.select(*(F.col(c).alias(f"k{n}") for n, c in enumerate(columns)), F.col(text).cast("string").alias("text")).mapInArrow(run, f"{kinds}score double")
    return made.select(*(F.col(f"k{n}").alias(c) for n, c in enumerate(columns)), F.col("score").alias("quality_score"))
