"""The language model, language identification, quality, page and leak operators against brute force and held-out labels."""

from __future__ import annotations

import math
import random
import re
import zlib
from collections import Counter, defaultdict
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pytest
from cases import LONG, documents, empty
from pyspark.sql import functions as F

from tillmark.llm import ctw, langid, pages, quality, templates
from tillmark.llm.queries import QUERIES, remainder
from tillmark.llm.texts import flat, strings

FOLDER = "/root/testdata/sf0.001"


# --- context tree


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def tokens(text):
    return [*re.findall(r"[^\x20\x09-\x0D]+", lower(text)), "\0end"]


def tree_score(train, texts, depth):
    """log10 probabilities by the recursive definition, node by node."""
    count = defaultdict(lambda: [0, 0])

    def steps(text):
        row = bytes(depth) + lower(text).encode() + b"\0"
        for at in range(depth, len(row)):
            for k in range(8):
                yield row[at - depth : at], (k, row[at] >> (8 - k)), row[at] >> (7 - k) & 1

    for text in train:
        for context, prefix, bit in steps(text):
            for d in range(depth + 1):
                count[context[depth - d :], prefix][bit] += 1
    below = defaultdict(set)
    for context, prefix in list(count):
        if context:
            below[context[1:], prefix].add(context)

    @lru_cache(None)
    def mixture(context, prefix):
        own = kt(*count[context, prefix])
        if len(context) == depth:
            return own, own, own
        rest = sum(mixture(c, prefix)[2] for c in below[context, prefix])
        return own, rest, np.logaddexp(own, rest) - math.log(2)

    def kt(a, b):
        return math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.log(math.pi) - math.lgamma(a + b + 1)

    def one(context, prefix, d=0, above=0.5):
        node = context[depth - d :], prefix
        a, b = count.get(node, (0, 0))
        own = (b + 0.5) / (a + b + 1) if a + b else above
        if d == depth:
            return own
        left, right, _ = mixture(*node) if a + b else (0.0, 0.0, 0.0)
        share = 1 / (1 + math.exp(right - left))
        return share * own + (1 - share) * one(context, prefix, d + 1, own)

    return [sum(math.log10(p if bit else 1 - p) for c, x, bit in steps(t) for p in [one(c, x)]) for t in texts]


def test_context_tree(spark):
    rng = random.Random(3)
    texts = ["", None, "Aa b", "the end\tof The\nend", "é é", *(" ".join(rng.choice(["the", "then", "Other", "of", "é"]) for _ in range(rng.randint(1, 25))) for _ in range(20))]
    rows = [(i, t, "clash", 1.5) for i, t in enumerate(texts)] + [(None, "the end", "", 0.0), (4, "é é", "", 0.0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, chunk string, score double")
    learnt = [r[1] for r in rows if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 != 2]
    got = defaultdict(list)
    for depth in (0, 2, 4):
        for r in ctw.score(df, remainder("doc_id", 7) != 2, depth=depth).collect():
            got[depth].append((r["doc_id"], r["n_tokens"], r["n_known"], r["train_tokens"], r["learnt"], round(r["base_score"], 6), round(r["score"], 6)))
        words = Counter(w for t in learnt for w in tokens(t))
        n, v = sum(words.values()), len(words)
        want = []
        for (i, text, *_), score in zip(rows, tree_score(learnt, [r[1] for r in rows], depth)):
            own = tokens(text)
            want.append((i, len(own), sum(words[w] > 0 for w in own), n, i is not None and zlib.crc32(str(i).encode()) % 7 != 2, round(sum(math.log10((words[w] + 1) / (n + v + 1)) for w in own), 6), round(score, 6)))
        assert sorted(map(str, got[depth])) == sorted(map(str, want))


def test_context_tree_in_many_chunks(spark):
    """Chunks so small that words and strings are asked for many times give the same scores."""
    rng = random.Random(4)
    rows = [(k, " ".join(rng.choice(["the", "then", "Other", "of", "é"]) for _ in range(rng.randint(0, 25)))) for k in range(200)] + [(5, "of of")] * 9
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    one, many = (sorted((r["doc_id"], r["n_known"], r["train_tokens"], round(r["base_score"], 9), round(r["score"], 9)) for r in ctw.score(df, remainder("doc_id", 7) != 2, chunk_bytes=b).collect()) for b in (1 << 20, 500))
    assert one == many and len(one) == 209


def test_words_that_share_a_hash_are_told_apart(monkeypatch):
    words, counts = pa.array([b"a", b"b", b""], pa.large_binary()), np.array([3.0, 5.0, 7.0])
    asked = pa.array([b"", b"b", b"a", b"b"], pa.large_binary())
    assert ctw._Words(words, counts).of(asked).tolist() == [7, 5, 3, 5] and ctw._Words(words, counts).words is None
    monkeypatch.setattr(ctw.xxhash, "xxh64_intdigest", lambda w: 1)
    assert ctw._Words(words, counts).of(asked).tolist() == [7, 5, 3, 5]


def test_context_tree_of_nothing(spark):
    assert ctw.score(empty(spark), F.lit(True)).collect() == []
    alone = ctw.score(spark.createDataFrame([(1, "ab")], "doc_id long, text string"), F.lit(False)).first()
    assert alone["score"] == pytest.approx(3 * 8 * math.log10(0.5)) and alone["train_tokens"] == 0 and alone["n_known"] == 0


def test_context_tree_beats_words(spark):
    """On held-out texts. It takes some ten megabytes to learn from: contexts of five bytes are too rare in less."""
    rows = [r for r in QUERIES["op2_context_tree"](spark, "/root/testdata/sf0.1").collect() if r["held_out"]]
    assert sum(r["score"] for r in rows) > sum(r["base_score"] for r in rows)


# --- languages


def test_columns_named_like_results_give_way(spark):
    from tillmark.llm import bpe

    df = documents(spark).withColumns({c: F.lit("x") for c in ("quality_score", "n_chars", "ids", "decoded")})
    assert quality.score(df, quality.train([]), ["doc_id", "quality_score"]).columns == ["doc_id", "quality_score"]
    field = pages.train(pages.labelled_pages(["A sentence here."]))
    assert pages.main_text(df, field, ["doc_id", "text", "n_chars"], html="text").columns == ["doc_id", "text", "n_chars"]
    import public_tokenizers

    made = bpe.encode(df, public_tokenizers.path("byte_bpe_50k.json"), ["doc_id", "ids", "n_tokens"])
    assert made.columns == ["doc_id", "n_tokens", "ids"] and made.count() == df.count()
    assert bpe.decode(made.withColumn("decoded", F.lit("x")), public_tokenizers.path("byte_bpe_50k.json"), ["doc_id", "decoded"]).columns == ["doc_id", "decoded"]


def test_training_samples_take_repeated_rows_once(spark):
    rows = [(1, "one text")] * 40 + [(1, "another text of the id")] + [(k, f"text {k}") for k in range(2, 8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    labels = spark.createDataFrame([(k, k % 2) for k in range(1, 8)], "doc_id long, quality int")
    got = [quality.training_rows(docs.repartition(n), labels, F.lit(True), most=5) for n in (2, 7)]
    assert got[0] == got[1] and {t for t, y in got[0] if y} == {"one text", "another text of the id", "text 3", "text 5", "text 7"}
    web = spark.createDataFrame([("u", "<p>Same sentence here.</p>")] * 30 + [(f"v{k}", f"<p>Sentence {k} here.</p>") for k in range(3)] + [("n", None)], "url string, html string")
    assert sorted(pages.training_sentences(web, rows=10)) == ["Same sentence here.", "Sentence 0 here.", "Sentence 1 here.", "Sentence 2 here."]
    assert len(pages.training_sentences(web, rows=2)) == 2 and len(pages.training_sentences(web.where("false"))) == 3


def test_ftrl_step_by_a_plain_loop():
    """Weights after some examples against the update rule, feature by feature."""
    leader = quality.Ftrl(4)
    z, n, zb, nb = [0.0] * 16, [0.0] * 16, 0.0, 0.0
    w = lambda z, n: -z / ((leader.beta + math.sqrt(n)) / leader.alpha + leader.l2) if abs(z) > leader.l1 else 0.0
    rng = np.random.default_rng(3)
    for _ in range(12):
        ids, label = rng.integers(0, 16, 6), int(rng.integers(0, 2))
        used, counts = np.unique(ids, return_counts=True)
        x = counts * (quality.SCALE / counts.sum())
        weights, bias = [w(z[i], n[i]) for i in used], w(zb, nb)
        p = 1 / (1 + math.exp(-(sum(a * b for a, b in zip(weights, x)) + bias)))
        leader.learn(ids.astype(np.int64), label)
        for i, wi, xi in zip(used, weights, x):
            g = (p - label) * xi
            z[i] += g - (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / leader.alpha * wi
            n[i] += g * g
        g = p - label
        zb += g - (math.sqrt(nb + g * g) - math.sqrt(nb)) / leader.alpha * bias
        nb += g * g
    model, bias = leader.model()
    assert model == pytest.approx([w(a, b) for a, b in zip(z, n)], rel=1e-5, abs=1e-7) and bias == pytest.approx(w(zb, nb), rel=1e-5)


def test_forward_backward():
    """Marginals against the sum over all labellings."""
    rng = np.random.default_rng(1)
    e, moves, begin = rng.normal(size=(9, 3)), rng.normal(size=(3, 3)), rng.normal(size=3)
    at = np.array([0, 4, 4, 9])
    got = {}
    langid.forward_backward(e, at, moves, begin, lambda texts, m, live, *_: got.update({(t, k): m[k, n] for n, t in enumerate(texts) for k in range(len(m)) if live[k, n]}))
    from itertools import product

    for t, (a, b) in enumerate(zip(at, at[1:])):
        total = np.zeros((b - a, 3))
        for path in product(range(3), repeat=b - a):
            if path:
                weight = math.exp(begin[path[0]] + sum(e[a + k, y] for k, y in enumerate(path)) + sum(moves[y, z] for y, z in zip(path, path[1:])))
                for k, y in enumerate(path):
                    total[k, y] += weight
        for k in range(b - a):
            assert got[t, k] == pytest.approx(total[k] / total[k].sum())


def test_languages(spark):
    rows = QUERIES["op3_language"](spark, "/root/testdata/sf0.01").collect()
    truth = {r["doc_id"]: r["lang"] for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    held = [r for r in rows if r["held_out"]]
    assert len(rows) == len(truth) and len(held) == sum(zlib.crc32(str(i).encode()) % 5 == 0 for i in truth)
    assert sum(truth[r["doc_id"]] == r["lang_pred"] for r in held) / len(held) > 0.98
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_language_cases(spark):
    model = langid.train([("the cat and the dog", "en"), ("der hund und die katze", "de")] * 5)
    got = {(r["doc_id"], r["lang_pred"], r["lang_score"] > 0) for r in langid.predict(documents(spark), model, ["doc_id", "n_tokens", "fp"]).collect()}
    assert {(0, "und", False), (1, "und", False), (2, "und", False), (8, "und", False)} <= got and len(got) >= 12
    assert langid.predict(empty(spark), model, ["doc_id"]).collect() == []
    clash = documents(spark).withColumn("lang_pred", F.lit("x"))
    assert langid.predict(clash, model, ["doc_id", "lang_pred"]).columns == ["doc_id", "lang_pred", "lang_score"]
    none = langid.train(langid.training_texts(empty(spark), F.lit(True), 5))
    assert {r["lang_pred"] for r in langid.predict(documents(spark), none, ["doc_id"]).collect()} == {"und"}
    langs, share = model.predict(["the dog and the cat und der hund und die katze und der hund"])
    assert langs == ["de"] and 0.5 < share[0] < 1


def test_numerals_are_no_letters(spark):
    model = langid.train([("the cat and the dog", "en"), ("der hund und die katze", "de")] * 5)
    df = spark.createDataFrame([(1, "\u00b2 \u00bd \u2460"), (2, "the \u00b2 dog")], "doc_id long, text string")
    assert {r["doc_id"]: r["lang_pred"] for r in langid.predict(df, model, ["doc_id"]).collect()} == {1: "und", 2: "en"}


def test_repeated_rows_count_once_in_the_sample(spark):
    rows = [(1, "the cat", "en")] * 50 + [(k, f"the dog {k}", "en") for k in range(2, 6)] + [(9, "rare", "xx")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert sorted(langid.training_texts(df, F.lit(True), 3)) == sorted(set(langid.training_texts(df, F.lit(True), 3))) and len(langid.training_texts(df, F.lit(True), 10)) == 6
    assert {lang for _, lang in langid.training_texts(df, F.lit(True), 3, languages=1)} == {"en"}


def test_spans_of_a_switched_text(spark):
    en, de = "the cat and the dog are in the house", "der hund und die katze sind in dem haus"
    model = langid.train([(en, "en"), (de, "de")] * 5)
    df = spark.createDataFrame([(1, f"{en}. {de}!"), (2, None), (3, "1 2")], "doc_id long, text string")
    got = {r["doc_id"]: r["lang_spans"] for r in langid.spans(df, model, ["doc_id"]).collect()}
    assert [s["lang"] for s in got[1]] == ["en", "de"] and got[2] == got[3] == []
    assert abs(got[1][0]["words"] - 9) <= 1 and got[1][0]["start"] == 0 and got[1][1]["stop"] == len(en) + 2 + len(de)


def test_gradient_of_the_field_by_finite_differences():
    """d log p(labels) / d emission is (label - marginal), for each word and label."""
    rng = np.random.default_rng(1)
    e, moves, begin, y = rng.normal(size=(4, 3)), rng.normal(size=(3, 3)), rng.normal(size=3), [0, 2, 1, 1]

    def log_p(e):
        path = begin[y[0]] + sum(e[k, y[k]] for k in range(4)) + sum(moves[y[k], y[k + 1]] for k in range(3))
        a = begin + e[0]
        for k in range(1, 4):
            a = np.logaddexp.reduce(a[:, None] + moves, axis=0) + e[k]
        return path - np.logaddexp.reduce(a)

    out = []
    langid.forward_backward(e, np.array([0, 4]), moves, begin, lambda t, m, *_: out.append(m[:, 0]))
    for k in range(4):
        for j in range(3):
            step = np.zeros_like(e)
            step[k, j] = 1e-5
            assert abs((log_p(e + step) - log_p(e - step)) / 2e-5 - ((y[k] == j) - out[0][k, j])) < 1e-6



# --- quality


def test_quality(spark):
    rows = QUERIES["op5_quality"](spark, "/root/testdata/sf0.01").collect()
    label = {r["doc_id"]: r["quality"] for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    held = [r for r in rows if r["held_out"] and r["doc_id"] in label]
    assert len(rows) == 1000 and all(r["predicted"] == int(r["score"] >= 0.5) for r in rows)
    assert sum(r["predicted"] == label[r["doc_id"]] for r in held) / len(held) > 0.97


def test_quality_features():
    """Features of a text don't depend on the texts around it."""
    texts = ["", "one two", "One two, two, two!", "x", "é ü 12 a-b", " ", "a a a a a a"]
    ids, at = quality.hashed(*flat(strings(pa.array(texts))), 20, 3)
    for k, t in enumerate(texts):
        alone, _ = quality.hashed(*flat(strings(pa.array([t]))), 20, 3)
        assert ids[at[k] : at[k + 1]].tolist() == alone.tolist()
    assert quality.hashed(*flat(strings(pa.array(["a a"]))), 20, 2)[0].tolist()[-1] == 1  # one repeat, one place back


def test_quality_cases(spark):
    labels = spark.createDataFrame([(1, 1), (4, 1), (5, 0), (5, None), (99, 0)], "doc_id long, quality int")
    rows = quality.training_rows(documents(spark), labels, F.lit(True), 10)
    assert set(rows) == {("two words", 1), ("same text here and there", 0)}
    scores = quality.score(documents(spark), quality.train(rows), ["doc_id", "fp"]).collect()
    assert len(scores) == documents(spark).count() and all(0 <= r["quality_score"] <= 1 for r in scores)
    none = quality.train(quality.training_rows(empty(spark), labels, F.lit(True), 10))
    assert {r["quality_score"] for r in quality.score(documents(spark), none, ["doc_id"]).collect()} == {0.5}
    assert quality.score(empty(spark), none, []).collect() == []


# --- pages


@pytest.fixture(scope="module")
def field():
    sentences = ["The first thing is said here.", "Another follows, with marks; and more.", "Short one.", "What does the last of them say?", "Il y a aussi une phrase.", "Something longer goes on and on, so that a paragraph has a size."]
    return pages.train(pages.labelled_pages(sentences))


def shown(field, page):
    blocks = pages.leaf_blocks(page)
    return " ".join(b[0] for b, y in zip(blocks, field.decode(pages.features(blocks))) if y) if blocks else ""


def test_blocks():
    page = "<p>a<b>b</b> c &amp; &lt;x&gt;<p>d\n\n e<ul><li>f<li>g</ul><!-- <p>no --><script>if (a<b) '<p>'</script><table><tr><td>h<td>i</table>j<br>k<div title='>'>l</div"
    assert [b[0] for b in pages.leaf_blocks(page)] == ["ab c & <x>", "d e", "f", "g", "h", "i", "j k", "l"]
    assert pages.leaf_blocks("") == [] and [b[0] for b in pages.leaf_blocks("just text &eacute;")] == ["just text é"]
    assert [b[0] for b in pages.leaf_blocks("</div></p>x<title>t</title><noscript>n</noscript><p>y</b></i>")] == ["x", "y"]


def test_viterbi(field):
    rows = [{"<p>"}, {"<nav>", "<li>"}, {"<article>", "<p>"}, {"nothing known"}, {"<footer>"}]
    e = field.emissions(rows)
    from itertools import product

    best = max(product((0, 1), repeat=5), key=lambda y: field.begin[y[0]] + sum(e[k, v] for k, v in enumerate(y)) + sum(field.moves[a, b] for a, b in zip(y, y[1:])))
    assert field.decode(rows) == list(best)


def test_held_out_pages(field):
    sentences = ["Quite other words stand here.", "They are new, of course.", "None was seen before!", "So the place decides."]
    made = pages.labelled_pages(sentences, 150, seed=5)
    right = [a == b for rows, labels in made if rows for a, b in zip(field.decode(rows), labels)]
    assert np.mean(right) > 0.96


def test_layouts(field):
    body = "<h1>Title</h1><p>First para of it.</p><p>Second para of it, too.</p>"
    want = "Title First para of it. Second para of it, too."
    around = [
        f"<body><nav><a href=/>Home</a></nav><main>{body}</main><footer>(c) them</footer>",
        f'<div class="cookie-banner"><p>We use cookies, as you know.</p></div><div id="content">{body}<div class="comments"><p>I like it.</p></div></div>',
        f'<header><h1>Site</h1></header><article>{body}<div class="advert">Buy it now.</div></article><aside>Related: more.</aside>',
        f'<article>{body}<form><p>Sign up now.</p><button>Go</button></form></article><div class="sidebar"><ul><li><a href=x>One</a></ul></div>',
    ]
    assert [shown(field, page) for page in around] == [want] * 4


def test_page_table(spark, field):
    rows = [(1, "u", None, "x"), (2, None, "", "x"), (None, "u", "<article><p>Said here, at length.</p></article>", "x"), (2, None, "", "x"), (5, "v", f"<article><p>{LONG}</p></article>", None)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = sorted(((r["page_id"], r["text"], r["n_chars"]) for r in pages.main_text(df, field, ["page_id", "url"]).collect()), key=str)
    assert got == sorted([(1, "", 0), (2, "", 0), (2, "", 0), (None, "Said here, at length.", 21), (5, LONG.strip(), len(LONG) - 1)], key=str)
    assert pages.main_text(df.limit(0), field, ["page_id"]).collect() == []


def test_pages_of_the_table(spark):
    html = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{FOLDER}/pages.parquet").collect()}
    for r in QUERIES["op4_main_text"](spark, FOLDER).collect():
        article = re.search(r"<article>(.*?)</article>", html[r["page_id"]], re.S)[1]
        want = " ".join(b[0] for b in pages.leaf_blocks(article))
        assert r["text"] == want and r["n_chars"] == len(want)


# --- leaks

ITEM = "If a train leaves Boston at 10 km per hour and Alice waits 3 hours for it, how far does the train go before Alice sees it?"


def leaks_of(spark, texts, items):
    docs = spark.createDataFrame([(i, t, "c", 1) for i, t in enumerate(texts)], "doc_id long, text string, item_id string, h long")
    bench = spark.createDataFrame([(i, t, "c") for i, t in enumerate(items)], "item_id long, text string, doc_id string")
    return {(r["doc_id"], r["item_id"]) for r in templates.leaks(docs, bench).collect()}


def test_leaks(spark):
    other = ITEM.replace("Boston", "Leeds").replace("Alice", "Bert Smith").replace("10 km", "25.5 miles").replace("3 hours", "7 minutes")
    twisted = other.replace("before Bert Smith", "before Carol")  # one slot of the item, two values
    texts = ["", None, f"Before it. {ITEM} After it.", f"Well. {other}", f"Well. {twisted}", ITEM.upper(), "If a train leaves Boston at 10 km per hour it is slow.", "Nothing of the kind stands in this text at all, not a bit of it. " * 20, f"{ITEM} {ITEM}", LONG + ITEM]
    got = leaks_of(spark, texts, [ITEM, "", None, "Too short", "A short item has six words."])
    assert {(2, 0), (3, 0), (8, 0), (9, 0)} <= got
    assert not {d for d, _ in got} & {0, 1, 6, 7} and (4, 0) not in got
    assert leaks_of(spark, ["Say it: a short item has six words, yes.", "a short item has five words"], ["A short item has six words."]) == {(0, 0)}


def test_no_leaks(spark):
    assert leaks_of(spark, [], [ITEM]) == set() and leaks_of(spark, [ITEM], []) == set()


def test_leaks_of_the_tables(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").collect()
    items = spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()
    where = defaultdict(list)
    for item in items:
        words = item["text"].lower().split()
        for k in range(len(words) - 12):
            where[tuple(words[k : k + 13])].append(item["item_id"])
    want = set()
    for r in docs:
        words = (r["text"] or "").lower().split()
        want |= {(r["doc_id"], i) for k in range(len(words) - 12) for i in where.get(tuple(words[k : k + 13]), ())}
    assert {(r["doc_id"], r["item_id"]) for r in QUERIES["op8_template_leaks"](spark, FOLDER).collect()} == want
