"""MinHash near-duplicates against brute-force Jaccard similarity of 4-word shingles."""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import pytest
from cases import LONG, documents, empty
from test_simhash import TEXTS

from tillmark.llm import minhash
from tillmark.llm.queries import QUERIES


def shingle_set(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        words = words.replace(c, " ")
    words = tuple(w for w in words.split(" ") if w)
    return frozenset(words[i : i + 4] for i in range(max(1, len(words) - 3))) if words else frozenset()


def classes(rows):
    """Result rows of (doc_id, text), and the number of linked pairs of different sets."""
    own = [shingle_set(t) for _, t in rows]
    distinct = [s for s in dict.fromkeys(own) if s]
    root, pairs = {s: s for s in distinct}, 0

    def find(s):
        while root[s] is not s:
            s = root[s]
        return s

    for i, a in enumerate(distinct):
        for b in distinct[:i]:
            shared = len(a & b)
            if 100 * shared >= 80 * (len(a) + len(b) - shared):
                pairs += 1
                root[find(a)] = find(b)
    least = {}
    for (i, _), s in zip(rows, own):
        if s and i is not None:
            least[find(s)] = min(i, least.get(find(s), i))
    out = []
    for (i, _), s in zip(rows, own):
        component = least.get(find(s)) if s else i
        out.append((i, len(s), component, i == component))
    return sorted(out, key=str), pairs


def copies(seed, groups, most, shares=(0.01, 0.02, 0.03, 0.05), lengths=(5, 30, 100, 300)):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(3000)]
    texts = []
    for _ in range(groups):
        base = [rng.choice(words) for _ in range(rng.choice(lengths))]
        texts.append(" ".join(base))
        for _ in range(rng.randint(0, most)):
            share = rng.choice(shares)
            texts.append(" ".join(rng.choice(words) if rng.random() < share else w for w in base))
    return texts


def found(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return sorted((tuple(r) for r in minhash.near_duplicates(df).collect()), key=str)


def chain(seed, length):
    """Each text is like the next one, the first unlike the last."""
    rng = random.Random(seed)
    words = [f"c{seed}x{i}" for i in range(100)]
    out = []
    for k in range(length):
        out.append(" ".join(words))
        words = list(words)
        words[(k * 37) % 100] = f"n{seed}x{rng.random()}"
    return out


@pytest.mark.parametrize("texts", [[*TEXTS, *copies(5, 60, 5)], copies(6, 2, 150), copies(7, 8, 60, (0.02, 0.03)), [*chain(1, 40), *chain(2, 40)]])
def test_against_brute_force(spark, texts):
    want, pairs = classes(list(enumerate(texts)))
    assert pairs > 20 and found(spark, list(enumerate(texts))) == want


@pytest.mark.parametrize("block", [8, 64])
def test_groups_of_many_blocks(spark, monkeypatch, block):
    """A large group of near copies, some of them too far from most others, and a loose one without links; blocks so small that each group has many."""
    monkeypatch.setattr(minhash, "BLOCK", block)
    texts = [*copies(8, 1, 1, lengths=(120,)), *copies(9, 1, 260, (0.01, 0.03, 0.06, 0.1), (120,)), *copies(10, 1, 200, (0.07,), (120,)), *chain(3, 60)]
    rows = list(enumerate(texts))
    want, pairs = classes(rows)
    assert pairs > 100 and len({r[2] for r in want}) > 5 and found(spark, rows) == want


def test_blocks_of_long_texts(spark, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK_SHINGLES", 2000)
    rows = list(enumerate(copies(11, 2, 40, (0.01, 0.04), (500,))))
    assert found(spark, rows) == classes(rows)[0]


def test_query_on_awkward_rows(spark, tmp_path):
    df = documents(spark, ["same text here and", LONG + "end"])
    df.write.parquet(f"{tmp_path}/documents.parquet")
    out = QUERIES["op13_minhash"](spark, str(tmp_path))
    assert out.columns == ["doc_id", "n_shingles", "component_id", "kept"]
    assert sorted((tuple(r) for r in out.collect()), key=str) == classes([(r["doc_id"], r["text"]) for r in df.collect()])[0]
    assert minhash.near_duplicates(empty(spark)).collect() == []


def test_thresholds_are_exact():
    """8 of 10 shingles link, 79 of 99 do not, 80 of 100 do."""
    for shared, extra, want in ((8, 2, True), (79, 20, False), (80, 20, True), (4, 1, True), (3, 1, False)):
        a, b = np.arange(shared, dtype=np.uint64), np.arange(shared + extra, dtype=np.uint64)
        assert (minhash.connected([a, b])[1] == 0) == want
        assert minhash.connected([a, b, np.arange(50, 5050, dtype=np.uint64)], np.array([0, 0, 1])).tolist() == [0, 1, 2]


def test_signatures_are_minima_of_a_shifted_permutation():
    x, at = minhash.sets(pa.array(["a b c d e f g", "h i j k"], pa.large_string()))
    assert np.diff(at).tolist() == [4, 1]
    pi = lambda y: ((y * 0xD6E8FEB86659FD93 % 2**64 ^ y * 0xD6E8FEB86659FD93 % 2**64 >> 32) * 0xC4CEB9FE1A85EC53) % 2**64
    sigma = [int(v) for v in minhash._sigma(x ^ np.uint64(0x9E3779B97F4A7C15))]
    got = minhash.signatures(x, at[:-1], range(3, 6))
    assert got.tolist() == [[min(pi((s - k) % 2**64) for s in sigma[:4]), pi((sigma[4] - k) % 2**64)] for k in range(3, 6)]
    rng = np.random.default_rng(1)
    agree = []
    for _ in range(200):
        u = rng.integers(0, 1 << 63, 200, dtype=np.uint64)
        s = minhash.signatures(np.concatenate([u[:180], u[20:]]), np.array([0, 180]), range(150))
        agree.append((s[:, 0] == s[:, 1]).mean())
    assert abs(np.mean(agree) - 0.8) < 0.01 and np.std(agree) < 0.05
