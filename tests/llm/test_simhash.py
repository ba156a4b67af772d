from __future__ import annotations

import random

import numpy as np
import pytest
import xxhash

from tillmark.llm import simhash
from tillmark.llm.components import components

TEXTS = ["", None, " \t\n", "One", "one two", "ONE two", "a b c d e f g", "a b c d e f g", "é ü ß words here", "x " * 30_000, "the same line\n" * 500]


def plain(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def classes(prints):
    """component_id by brute force; prints: [(id, fingerprint)]."""
    fps = sorted({f for _, f in prints})
    root = {f: f for f in fps}

    def find(f):
        while root[f] != f:
            f = root[f]
        return f

    for i, a in enumerate(fps):
        for b in fps[:i]:
            if bin(a ^ b).count("1") <= 2:
                root[find(a)] = find(b)
    least = {}
    for i, f in prints:
        if i is not None:
            least[find(f)] = min(i, least.get(find(f), i))
    return sorted(((i, f"{f:016x}", least.get(find(f))) for i, f in prints), key=str)


def test_against_brute_force(spark):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(50)]
    texts = list(TEXTS)
    for _ in range(40):
        base = [rng.choice(words) for _ in range(rng.randint(3, 300))]
        texts.append(" ".join(base))
        for _ in range(rng.randint(0, 6)):
            other = list(base)
            other[rng.randrange(len(other))] = rng.choice(words)
            texts.append(" ".join(other))
    rows = [(i, t, "x", "y") for i, t in enumerate(texts)] + [(None, "one two", "x", "y"), (3, "One", "x", "y"), (None, "nothing like it", "x", "y")]
    df = spark.createDataFrame(rows, "doc_id long, text string, fp string, component_id string")
    got = sorted((tuple(r) for r in simhash.near_duplicates(df).collect()), key=str)
    assert got == classes([(r[0], plain(r[1])) for r in rows])


def test_the_tally_decides():
    """Pairs reach the bits only with six shared positional bytes, wherever the others are."""
    rng = np.random.default_rng(2)
    a = rng.integers(0, 1 << 63, 400, dtype=np.uint64)
    b = a.copy()
    for k in range(400):
        for p in rng.permutation(8)[: k % 5]:
            b[k] ^= np.uint64(1 << int(8 * p + rng.integers(0, 8)))
    assert simhash.shared_bytes(a, b).tolist() == [8 - k % 5 for k in range(400)]
    assert sorted(simhash._near(a, b).tolist()) == [k for k in range(400) if k % 5 <= 2]
    asked = []
    simhash_bits = simhash._BITS
    try:
        simhash._BITS = type("Counted", (), {"__getitem__": lambda _, x: asked.append(len(x)) or simhash_bits[x]})()
        simhash._near(a, b)
    finally:
        simhash._BITS = simhash_bits
    assert asked == [240]  # of 400 pairs: the others were left out by the tally


def test_every_family_keeps_pairs_that_differ_in_two_bytes():
    for key, parts in simhash.FAMILIES.items():
        open_ = [p for p in range(8) if not key >> p & 1]
        for x in open_:
            for y in open_:
                assert any(not part >> x & 1 and not part >> y & 1 for part in parts)


@pytest.mark.parametrize("bound", [2, 20, 256])
def test_postings_are_bounded_and_lose_no_pair(spark, bound):
    rng = random.Random(9)
    base = [rng.getrandbits(64) for _ in range(6)]
    made = {b ^ (rng.getrandbits(8) << 8 * rng.randrange(8)) ^ (rng.getrandbits(8) << 8 * rng.randrange(8)) for b in base for _ in range(120)}
    signed = sorted(int(np.array(f, dtype=np.uint64).view(np.int64)) for f in made)
    rows = simhash.postings(spark.createDataFrame([(f,) for f in signed], "fp long"), bound=bound).collect()
    met, sizes = {}, {}
    for r in rows:
        met.setdefault((r["family"], r["key"]), []).append(r["fp"])
    assert all(len(x) <= bound for (family, _), x in met.items() if family.bit_count() < 6)
    together = {frozenset((x, y)) for group in met.values() for x in group for y in group if x != y}
    fps = np.array(signed, dtype=np.int64).view(np.uint64)
    for k, f in enumerate(fps):
        for j in np.flatnonzero(simhash.shared_bytes(np.full(len(fps), f), fps) >= 6):
            assert j == k or frozenset((signed[k], signed[j])) in together


def test_words_of_fingerprints_near_each_other(spark):
    """Fingerprints made so that postings hold many: 400 within a ball, and far ones that share six bytes."""
    rng = random.Random(7)
    made = set()
    for _ in range(3):
        center = rng.getrandbits(64)
        for _ in range(400):
            made.add(center ^ (1 << rng.randrange(64)) ^ (rng.getrandbits(16) << 8 * rng.randrange(7)))
            made.add(center ^ (1 << rng.randrange(6)) ^ (1 << rng.randrange(12)))
    signed = [int(np.array(f, dtype=np.uint64).view(np.int64)) for f in made]
    df = spark.createDataFrame([(f,) for f in signed], "fp long")
    got = simhash.links(df)
    roots = {r["node"]: r["root"] for r in components(got).collect()}
    fps = np.array(signed, dtype=np.int64)
    want = {f: f for f in signed}
    changed = True
    near = [[int(x) for x in fps[[bin(int(d) & (1 << 64) - 1).count("1") <= 2 for d in (fps ^ f)]]] for f in fps]
    while changed:
        changed = False
        for f, others in zip(signed, near):
            m = min(want[o] for o in others)
            if m < want[f]:
                want[f], changed = m, True
    assert {f: roots.get(f, f) for f in signed} == want


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.near_duplicates(df).collect() == []


def test_components_of_a_long_path(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 100), (None, 3), (200, 201), (201, 200)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(61)}, 200: 200, 201: 200}


@pytest.mark.parametrize("text", TEXTS)
def test_fingerprint(text):
    assert simhash.fingerprint((text or "").encode()) == plain(text)
