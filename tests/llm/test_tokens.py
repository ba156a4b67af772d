"""Encoding, decoding, token counts and flat files against the tokenizers library."""

from __future__ import annotations

import hashlib
import json
import time
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from cases import documents, empty
from tillmark.llm import bpe, flatfiles, transducer
from tillmark.llm.store import new_path
from tillmark.llm.texts import strings

PATH = public_tokenizers.path("byte_bpe_50k.json")
CONTENT = open(PATH, encoding="utf-8").read()
LIBRARY = Tokenizer.from_file(PATH)
OWN, OTHER, COUNTER = bpe.own_encoder(CONTENT), flatfiles.library_encoder(CONTENT)[0], transducer.TextCounter(CONTENT)


def wanted(text):
    return LIBRARY.encode(text or "", add_special_tokens=False).ids


PIECES = st.one_of(st.sampled_from([*"ab \n'strvemld.1\x85\xa0é東", "'re", "<|endoftext|>", "   ", "the"]), st.characters(codec="utf-8"))


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(PIECES, max_size=30).map("".join), max_size=5))
def test_any_text(texts):
    column = strings(pa.array(texts, pa.string()))
    for encoder in (OWN, OTHER):
        ids, at = encoder.batch(column)
        assert [ids[a:b].tolist() for a, b in zip(at, at[1:])] == [wanted(t) for t in texts]
    assert COUNTER.batch(column).tolist() == [len(wanted(t)) for t in texts]


def test_chunks_of_the_splitter():
    """Marks don't depend on where chunks end."""
    step, mark = transducer.compile_splitter()
    kinds = np.random.default_rng(3).integers(0, transducer.N_CLASSES, 5000).astype(np.uint8)
    state, one = 0, []
    for c in kinds:
        one.append(mark[state, c])
        state = step[state, c]
    for chunk in (1, 7, 64, 8192):
        assert transducer.run_splitter(kinds, step, mark, chunk).tolist() == one


def test_long_words():
    for word in ("a" * 5000, "ab" * 3000, "=" * 4000, " " * 3000, "thing" * 1000):
        assert bpe.encode_word(word.encode(), bpe.Vocabulary(CONTENT)) == wanted(word)
        assert COUNTER.batch(strings(pa.array([word])))[0] == len(wanted(word))


def test_new_words_cost_less_than_calls_of_the_library():
    """Of many different words, splitting, storing and merging together take less CPU than the library alone takes for these words as texts."""
    rng = np.random.default_rng(5)
    words = [" " + "".join(w) for w in rng.choice(list("etaoinshrdlu"), (60_000, 9))]
    text = strings(pa.array(["".join(words[at : at + 500]) for at in range(0, len(words), 500)]))
    own, library = [], []
    for _ in range(3):
        encoder, tokenizer = flatfiles.library_encoder(CONTENT)[0], Tokenizer.from_str(CONTENT)
        began = time.process_time()
        ids, _ = encoder.batch(text)
        own.append(time.process_time() - began)
        began = time.process_time()
        made = [e.ids for e in tokenizer.encode_batch_fast(words, add_special_tokens=False)]
        library.append(time.process_time() - began)
        assert ids.tolist() == [i for m in made for i in m]
    assert min(own) < min(library)


def test_store_starts_afresh(monkeypatch):
    monkeypatch.setattr(bpe.Encoder, "STORE", 400)
    texts = ["one two three", "three four", "", "one two", "five six seven one", "one"]
    for encoder in (bpe.own_encoder(CONTENT), flatfiles.library_encoder(CONTENT)[0]):
        for text in texts * 2:
            assert encoder.batch(strings(pa.array([text])))[0].tolist() == wanted(text)
            assert len(encoder.store) < 8


def test_normalizer():
    made = json.loads(CONTENT)
    made["normalizer"] = {"type": "Lowercase"}
    encoder = flatfiles.library_encoder(json.dumps(made))[0]
    assert encoder.batch(strings(pa.array(["ONE Two", "\u00c9"])))[0].tolist() == [*wanted("one two"), *wanted("\u00e9")]


def test_counts(spark):
    docs = documents(spark)
    got = Counter(tuple(r) for r in transducer.token_counts(docs, PATH, 5).collect())
    assert got == Counter((r["doc_id"], len((r["text"] or "").encode()), n := len(wanted(r["text"])), n > 5) for r in docs.collect())
    assert transducer.token_counts(empty(spark), PATH, 5).collect() == []


def test_round_trip(spark):
    docs = documents(spark)
    ids = bpe.encode(docs, PATH, ["doc_id"])
    back = bpe.decode(ids, PATH, ["doc_id", "ids"])
    got = Counter((r["doc_id"], bytes(r["ids"]), r["decoded"]) for r in back.collect())
    assert got == Counter((r["doc_id"], np.array(wanted(r["text"]), dtype="<u4").tobytes(), r["text"] or "") for r in docs.collect())
    assert bpe.encode(empty(spark), PATH, ["doc_id"]).collect() == []
    assert bpe.decode(spark.createDataFrame([(None,), (b"",)], "ids binary"), PATH, []).collect() == [(None,), ("",)]


@pytest.mark.parametrize("kind", ["some", "none"])
def test_flat_files(spark, kind):
    docs = documents(spark) if kind == "some" else empty(spark)
    place = new_path(spark, "flat")
    manifest = flatfiles.write(docs.repartition(3), place, PATH, end_token=2)
    rows = docs.collect()
    assert sum(r["docs"] for r in manifest.collect()) == len(rows)
    got = sorted(flatfiles.read(spark, place).collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in got] == sorted((r["doc_id"] for r in rows), key=lambda i: (i is not None, i))
    start = 0
    texts = {}
    for r in rows:
        texts.setdefault(r["doc_id"], []).append([*wanted(r["text"]), 2])
    for r in got:
        assert r["start"] == start and r["n_tokens"] == len(r["ids"]) and r["ids"] in texts[r["doc_id"]]
        start += r["n_tokens"]
    sums = {r["start"]: r["ids_crc32"] for r in flatfiles.read(spark, place, flatfiles.crc32, "ids_crc32 long").collect()}
    assert all(sums[r["start"]] == zlib.crc32(np.array(r["ids"], dtype="<u4").tobytes()) for r in got)


def test_query(spark):
    from tillmark.llm.queries import QUERIES

    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    for r in QUERIES["op9_bpe"](spark, "/root/testdata/sf0.001").collect():
        text = docs[r["doc_id"]]
        assert r["ids_sha256"] == hashlib.sha256(np.array(wanted(text), dtype="<u4").tobytes()).hexdigest() and r["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()
    counts = {r["doc_id"]: (r["n_tokens"], r["over_limit"]) for r in QUERIES["op6_token_counts"](spark, "/root/testdata/sf0.001").collect()}
    assert counts == {i: (n := len(wanted(t)), n > 1024) for i, t in docs.items()}
    start = 0
    found = sorted(QUERIES["op10_flat_files"](spark, "/root/testdata/sf0.001").collect())
    for r, (i, t) in zip(found, sorted(docs.items()), strict=True):
        ids = np.array([*wanted(t), 2], dtype="<u4")
        assert (r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) == (i, start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)


def test_freed_memory_is_given_back():
    import os

    from tillmark.llm.texts import give_back

    def held():
        with open("/proc/self/statm") as f:
            return int(f.read().split()[1]) * os.sysconf("SC_PAGE_SIZE") >> 20

    many = [bytearray(b"x" * 20_000) for _ in range(10_000)]
    last, full = many[-1], held()
    del many
    give_back()
    assert last and held() < full - 100
