"""Languages of words and texts by a linear-chain conditional random field.

The labels are the languages of the training texts. A word's features are its affixes, its inner byte n-grams and
itself as a lexicon entry, hashed; transitions between the languages of neighbouring words are learned, so a text that
switches languages is labelled word by word. Forward-backward gives each word's distribution; a text's language is
the one with the most expected letters.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillmark.llm.texts import coded, pieces, ragged, strings

_WORD = regex.compile(r"\p{L}+")
_P = np.uint64(0x100000001B3)
BITS = 18
LONGEST = 4  # bytes of affixes and n-grams
UNKNOWN = "und"


def words_of(texts: list[str]) -> tuple[pa.Array, np.ndarray]:
    """The lower-cased runs of letters of all texts as byte strings, and where each text's start."""
    found = [_WORD.findall(t.lower()) for t in texts]
    at = np.append(0, np.cumsum(np.fromiter(map(len, found), dtype=np.int64, count=len(found)))).astype(np.int64)
    return pa.array([w.encode() for words in found for w in words], pa.large_binary()), at


def word_features(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features of different words, and where each word's start: n-grams with marked ends (so affixes differ from inner ones), and the word."""
    data = np.frombuffer(b"".join(b"\x01" + w + b"\x02" for w in words), dtype=np.uint8).astype(np.uint64) + np.uint64(1)
    length = np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 2
    start = np.cumsum(length) - length
    ids, counts = [], []
    shift = np.uint64(64 - BITS)
    for n in range(2, LONGEST + 1):
        code = np.zeros(max(0, len(data) - n + 1), dtype=np.uint64)
        for k in range(n):
            code = code * _P + data[k : k + len(code)] * np.uint64(0x9E3779B97F4A7C15)
        many = np.maximum(length - n + 1, 0)
        ids.append(((code ^ np.uint64(n)) * np.uint64(0xD6E8FEB86659FD93) >> shift)[ragged(start, many)])
        counts.append(many)
    whole = np.zeros(len(words), dtype=np.uint64)  # lexicon entries
    power = np.cumsum(data * _powers(len(data)), dtype=np.uint64) if len(data) else data
    before = np.append(np.uint64(0), power)
    if len(words):
        whole = (before[start + length] - before[start]) * _inverse_powers(start)
    ids.append((whole ^ np.uint64(77)) * np.uint64(0xD6E8FEB86659FD93) >> shift)
    counts.append(np.ones(len(words), dtype=np.int64))
    total = np.append(0, np.cumsum(sum(counts))).astype(np.int64)
    out = np.empty(total[-1], dtype=np.int64)
    at = total[:-1].copy()
    for values, many in zip(ids, counts):
        out[ragged(at, many)] = values.astype(np.int64)
        at += many
    return out, total


def _powers(n: int) -> np.ndarray:
    return np.cumprod(np.concatenate([[1], np.full(max(0, n - 1), 0x100000001B3)]).astype(np.uint64), dtype=np.uint64)[:n]


def _inverse_powers(at: np.ndarray) -> np.ndarray:
    inverse = pow(0x100000001B3, -1, 1 << 64)
    n = int(at.max()) + 1 if len(at) else 0
    return np.cumprod(np.concatenate([[1], np.full(max(0, n - 1), inverse, dtype=np.uint64)]).astype(np.uint64), dtype=np.uint64)[at]


def sums(weights: np.ndarray, ids: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Emission scores of each word: the mean weight of its features, times a fixed scale."""
    if len(at) == 1:
        return np.zeros((0, weights.shape[1]))
    return np.add.reduceat(weights[ids], at[:-1], axis=0) / np.sqrt(np.diff(at))[:, None]


def forward_backward(e: np.ndarray, at: np.ndarray, moves: np.ndarray, begin: np.ndarray, each) -> None:
    """Calls ``each(texts, marginals, live)`` for groups of texts of like length; marginals: texts x words x labels.

    Works on probabilities scaled at each word, for many texts at a time.
    """
    size = np.diff(at)
    order = np.argsort(size, kind="stable")
    order = order[size[order] > 0]
    step, start = np.exp(moves), np.exp(begin)
    labels = e.shape[1]
    lo = 0
    while lo < len(order):
        hi = lo + 1
        while hi < len(order) and size[order[hi]] <= max(16, size[order[lo]] * 1.25) and (hi - lo + 1) * size[order[hi]] <= 200_000:
            hi += 1
        texts = order[lo:hi]
        lo = hi
        t = int(size[texts].max())
        live = np.arange(t)[:, None] < size[texts][None, :]
        place = np.where(live, at[texts][None, :] + np.arange(t)[:, None], 0)
        x = e[place]
        x = np.exp(x - x.max(axis=2, keepdims=True))
        x[~live] = 1.0
        a, b = np.empty_like(x), np.empty_like(x)
        row = x[0] * start
        a[0] = row / row.sum(axis=1, keepdims=True)
        for k in range(1, t):
            row = (a[k - 1] @ step) * x[k]
            a[k] = row / row.sum(axis=1, keepdims=True)
        b[-1] = 1.0 / labels
        back = step.T.copy()
        for k in range(t - 2, -1, -1):
            row = (b[k + 1] * x[k + 1]) @ back
            row /= row.sum(axis=1, keepdims=True)
            b[k] = np.where(live[k + 1][:, None], row, 1.0 / labels)
        m = a * b
        m /= m.sum(axis=2, keepdims=True)
        each(texts, m, live, x, a, b)


class Model:
    def __init__(self, labels: list[str], weights: np.ndarray, moves: np.ndarray, begin: np.ndarray):
        self.labels, self.weights, self.moves, self.begin = labels, weights, moves, begin

    def label(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The likeliest language of each word, where each text's words start, and each text's expected letters of each language."""
        words, at = words_of(texts)
        distinct, index = coded(words)
        e = sums(self.weights, *word_features(distinct))
        letters = np.fromiter(map(len, distinct), dtype=np.float64, count=len(distinct))[index] if len(index) else np.zeros(0)
        of_word = np.zeros(len(index), dtype=np.int64)
        held = np.zeros((len(texts), len(self.labels)))

        def each(chosen, m, live, *_):
            place = np.where(live, at[chosen][None, :] + np.arange(len(m))[:, None], 0)
            of_word[place[live]] = m.argmax(axis=2)[live]
            held[chosen] = (m * (letters[place] * live)[:, :, None]).sum(axis=0)

        if len(index) and self.labels:
            forward_backward(e[index], at, self.moves, self.begin, each)
        return of_word, at, held

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        """Language and score (the language's share of the expected letters) of each text."""
        _, _, held = self.label(texts)
        total = held.sum(axis=1)
        best = held.argmax(axis=1) if self.labels else np.zeros(len(texts), np.int64)
        score = np.divide(held.max(axis=1, initial=0), total, out=np.zeros(len(texts)), where=total > 0)
        return [self.labels[k] if n > 0 else UNKNOWN for k, n in zip(best, total)], np.minimum(score, 1.0)


def training_texts(docs: DataFrame, learn: Column, most: int, label: str = "lang", text: str = "text", id: str = "doc_id", languages: int = 64) -> list[tuple[str, str]]:
    """Whole texts with their language, up to ``most`` of each of the ``languages`` most frequent, those first in the order of a hash of (id, text).

    Repeated rows count once. Null texts and rows without a language are left out.
    """
    rows = docs.where(learn & F.col(label).isNotNull() & F.col(text).isNotNull()).select(F.col(label).cast("string").alias("label"), F.col(text).cast("string").alias("text"), F.xxhash64(F.col(id), F.col(text)).alias("order"))
    frequent = [r["label"] for r in rows.groupBy("label").count().orderBy(F.desc("count"), "label").limit(languages).collect()]
    if not frequent:
        return []
    rows = rows.where(F.col("label").isin(frequent))
    # the hashes first, so that texts of the chosen rows only leave their tasks; repeats go before they are ranked and before they are collected
    first = F.row_number().over(Window.partitionBy("label").orderBy("order"))
    chosen = rows.select("label", "order").distinct().withColumn("n", first).where(F.col("n") <= most).select("label", "order").collect()
    wanted = {(r["label"], r["order"]) for r in chosen}
    found = rows.where(F.col("order").isin(sorted({r["order"] for r in chosen}))).dropDuplicates(["label", "order"]).collect()
    return [(text, lang) for lang, _, text in sorted((r["label"], r["order"], r["text"]) for r in found if (r["label"], r["order"]) in wanted)]


def train(rows: list[tuple[str, str]], rounds: int = 12, rate: float = 0.3) -> Model:
    """Fit emissions and transitions by gradient steps on the conditional likelihood of the words' labels.

    A word of a training text has the text's language. Texts of different languages follow one another in joined sequences, so
    that switches are seen. Without rows the model has no labels and predicts ``und``.
    """
    labels = sorted({label for _, label in rows})
    k = len(labels)
    weights, moves, begin = np.zeros((1 << BITS, max(1, k))), np.zeros((max(1, k),) * 2), np.zeros(max(1, k))
    if not k:
        return Model([], weights, moves, begin)
    number = {label: n for n, label in enumerate(labels)}
    by_label = {label: [t for t, own in rows if own == label] for label in labels}
    mixed = []  # texts in turn, so that neighbours differ in language
    for n in range(max(map(len, by_label.values()))):
        mixed += [(by_label[label][n % len(by_label[label])], number[label]) for label in labels]
    words, at = words_of([t for t, _ in mixed])
    truth = np.repeat([y for _, y in mixed], np.diff(at))
    distinct, index = coded(words)
    if not len(index):
        return Model(labels, weights, moves, begin)
    ids, first = word_features(distinct)
    scale = 1 / np.sqrt(np.diff(first))
    owner = np.repeat(np.arange(len(distinct)), np.diff(first))
    groups = np.unique(np.append(at[:: 2 * k], at[-1]))  # two texts of each language in a sequence
    past_w, past_m = np.full_like(weights, 1e-4), np.full_like(moves, 1e-4)
    used, column = np.unique(ids, return_inverse=True)
    for _ in range(rounds):
        e = sums(weights, ids, first)
        grad = np.zeros((len(distinct), k))
        move_grad = np.zeros_like(moves)

        def each(chosen, m, live, x, a, b):
            place = np.where(live, groups[chosen][None, :] + np.arange(len(m))[:, None], 0)
            y = truth[place]
            diff = (np.eye(k)[y] - m) * live[:, :, None]
            word = index[place].ravel()
            for j in range(k):
                grad[:, j] += np.bincount(word, diff[:, :, j].ravel(), len(distinct))
            step = np.exp(moves)
            pair = a[:-1, :, :, None] * step * (x[1:] * b[1:])[:, :, None, :]
            pair /= pair.sum(axis=(2, 3), keepdims=True)
            both = live[1:]
            move_grad[:] -= (pair * both[:, :, None, None]).sum(axis=(0, 1))
            np.add.at(move_grad, (y[:-1][both], y[1:][both]), 1)

        forward_backward(e[index], groups, moves, begin, each)
        grad *= scale[:, None] / len(index)
        move_grad /= len(index)
        g = np.stack([np.bincount(column, grad[owner, j], len(used)) for j in range(k)], axis=1)
        past_w[used] += g * g * 1e4
        weights[used] += rate * g / np.sqrt(past_w[used]) * 1e2 - 1e-4 * weights[used]
        past_m += move_grad * move_grad * 1e4
        moves += 0.1 * move_grad / np.sqrt(past_m) * 1e2
    return Model(labels, weights.astype(np.float32), moves, begin)


def _each_text(docs: DataFrame, model: Model, columns: list[str], text: str, result: str, kind: str, made) -> DataFrame:
    """The given columns and those of ``result``, which ``made(model, texts)`` gives as Arrow arrays for a list of texts."""
    columns = [c for c in columns if c not in result.split()]
    shared = docs.sparkSession.sparkContext.broadcast((model.labels, model.weights, model.moves, model.begin))  # 2 ** BITS weights a language
    own, names = [f"k{n}" for n in range(len(columns))], result.split()

    def run(batches):
        known = Model(*shared.value)
        for batch in batches:
            for part in pieces(batch):
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in own), *made(known, strings(part.column("text")).to_pylist())], [*own, *names])

    schema = "".join(f"{k} {docs.schema[c].dataType.simpleString()}, " for k, c in zip(own, columns)) + kind
    rows = docs.select(*(F.col(c).alias(k) for k, c in zip(own, columns)), F.col(text).cast("string").alias("text")).mapInArrow(run, schema)
    return rows.select(*(F.col(k).alias(c) for k, c in zip(own, columns)), *names)


def predict(docs: DataFrame, model: Model, columns: list[str], text: str = "text") -> DataFrame:
    """The given columns, lang_pred and lang_score of each row's whole text; ``und`` and 0 for texts that are null or have no letter.

    One row per row, repeated rows included; an empty table gives none. A given column named like a result gives way to it.
    """

    def made(known, texts):
        langs, score = known.predict(texts)
        return pa.array(langs, pa.string()), pa.array(score)

    return _each_text(docs, model, columns, text, "lang_pred lang_score", "lang_pred string, lang_score double", made)


def spans(docs: DataFrame, model: Model, columns: list[str], text: str = "text") -> DataFrame:
    """The given columns and lang_spans: the runs of words of one language in each whole text, in order.

    A span has lang, start and stop (places in the text lower-cased, stop behind its last letter) and words. The labels are the likeliest ones of
    forward-backward, whose expected letters also give ``predict`` its answer. Texts that are null or have no letter have no spans.
    """

    def made(known, texts):
        of_word, at, _ = known.label(texts)
        out = []
        for k, t in enumerate(texts):
            found: list[dict] = []
            for y, m in zip(of_word[at[k] : at[k + 1]] if known.labels else (), _WORD.finditer(t.lower())):
                if found and found[-1]["lang"] == known.labels[y]:
                    found[-1]["stop"], found[-1]["words"] = m.end(), found[-1]["words"] + 1
                else:
                    found.append({"lang": known.labels[y], "start": m.start(), "stop": m.end(), "words": 1})
            out.append(found)
        return (pa.array(out, pa.list_(pa.struct([("lang", pa.string()), ("start", pa.int64()), ("stop", pa.int64()), ("words", pa.int64())]))),)

    return _each_text(docs, model, columns, text, "lang_spans", "lang_spans array<struct<lang: string, start: long, stop: long, words: long>>", made)
