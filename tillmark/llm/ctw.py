"""Context-tree weighting over bytes: the code length of texts under counts of a whole corpus.

Each byte is eight binary decisions. A node of the tree is a context of d bytes (d = 0 .. depth) with the bits of the byte
decided so far; it counts the zeros and ones that followed. Its Krichevsky-Trofimov estimate and the product of what the
contexts one byte longer say are mixed half and half, from the deepest contexts up. The share that a node's own
estimate has in its mixture, after all counts are in, weighs it in the prediction; so every depth has a say where the
counts support it.

Nothing is gathered in one place. Texts are dealt to chunks of bounded size, each of which counts its (depth + 1)-byte strings and words; Spark sums these
counts, each level of the tree is an aggregation of the level below and the weights come down by joins. For scoring, a
chunk asks for the values of the strings and words that occur in it, and its task reads these before the chunk's texts, which stream past.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillmark.llm.grouped import runs_of_keys
from tillmark.llm.store import drop, keep
from tillmark.llm.texts import LOWER, flat, give_back, pieces, strings, token_array, word_spans

#: Bytes of text in a chunk, about.
CHUNK = 24 << 20
#: Bytes of text that are worked through at a time; their strings and codes take some fifty times as much.
PIECE = 512 << 10
#: Contexts are dealt to tasks by this many of their latest bytes.
TOP = 3


def _grams(data: np.ndarray, offsets: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """For each byte of each text and its end (byte 0) the ``depth`` bytes before it and itself as one integer.

    Contexts that begin before the text are filled with byte 0. Also: where each text's integers start.
    """
    many = len(offsets) - 1
    step = depth + 1  # room before each text for the filling, and one for the end of the text before it
    at = offsets[:-1] + step * np.arange(many)
    row = np.zeros(len(data) + step * many + 1, dtype=np.uint64)
    place = np.ones(len(row), dtype=bool)
    place[-1] = False
    gap = np.zeros(len(row), dtype=bool)
    for k in range(step):
        gap[at + k] = True
    body = place & ~gap
    row[body] = LOWER[data]
    code = np.zeros(len(row), dtype=np.uint64)
    for k in range(depth, -1, -1):  # the byte k places before
        code <<= np.uint64(8)
        code[k:] |= row[: len(row) - k]
    wanted = body
    wanted[np.append(at[1:], len(row) - 1)] = True  # the place after a text's last byte
    first = offsets + np.arange(many + 1)
    return code[wanted].astype(np.int64), first


def _ln_gamma(x: Column) -> Column:
    """Stirling's series after a shift by eight; for x of 0.5 and more its error is under 1e-12 of the value."""
    shift = F.lit(1.0)
    for k in range(8):
        shift = shift * (x + k)
    z = x + 8
    return (z - 0.5) * F.log(z) - z + 0.9189385332046727 + 1 / (12 * z) - 1 / (360 * z * z * z) + 1 / (1260 * z * z * z * z * z) - F.log(shift)


def _ln_kt(zeros: Column, ones: Column) -> Column:
    return _ln_gamma(zeros + 0.5) + _ln_gamma(ones + 0.5) - 1.1447298858494002 - _ln_gamma(zeros + ones + 1.0)


def _spread(ordered: DataFrame, schema: str, each) -> DataFrame:
    """``each`` over blocks of whole groups of equal ``group``; rows are dealt and sorted by it. Blocks have about half a million rows, or one group."""

    def run(batches):
        held, rows = [], 0
        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows < 500_000:
                continue
            table = pa.Table.from_batches(held).combine_chunks()
            group = table.column("group").to_numpy()
            whole = int(np.searchsorted(group, group[-1]))  # the last group may go on
            if whole:
                yield from each(table.slice(0, whole)).to_batches()
            held, rows = table.slice(whole).to_batches(), len(group) - whole
        if rows:
            yield from each(pa.Table.from_batches(held).combine_chunks()).to_batches()
        held = group = table = None
        give_back()

    return ordered.repartition("group").sortWithinPartitions("group").mapInArrow(run, schema)


def _runs(x: np.ndarray) -> np.ndarray:
    """Where a new value begins in sorted ``x``."""
    return np.flatnonzero(np.append(True, x[1:] != x[:-1])) if len(x) else np.zeros(0, np.int64)


def _np_ln_gamma(x: np.ndarray) -> np.ndarray:
    shift, z = np.ones_like(x), x + 8
    for k in range(8):
        shift = shift * (x + k)
    return (z - 0.5) * np.log(z) - z + 0.9189385332046727 + 1 / (12 * z) - 1 / (360 * z**3) + 1 / (1260 * z**5) - np.log(shift)


def _np_ln_kt(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    return _np_ln_gamma(n0 + 0.5) + _np_ln_gamma(n1 + 0.5) - 1.1447298858494002 - _np_ln_gamma(n0 + n1 + 1.0)


def _levels(grams: np.ndarray, n: np.ndarray, depth: int, top: int) -> dict[int, list[dict[str, np.ndarray]]]:
    """For each depth from ``depth`` up to ``top`` the nodes of the eight bits: key, n0, n1, own (ln KT), below and all (ln of the mixture).

    ``grams`` are sorted and hold whole contexts of ``top`` bytes. A key is the context and the bits decided, as one integer.
    """
    out, codes = {}, grams
    for d in range(depth, top - 1, -1):
        if d < depth:
            codes = codes & ((1 << 8 * (d + 1)) - 1)
            order = np.argsort(codes, kind="stable")
            begin = _runs(codes[order])
            n = np.add.reduceat(n[order], begin) if len(begin) else n
            codes = codes[order][begin]
        nodes = []
        for k in range(8):
            key = codes >> (8 - k)
            begin = _runs(key)
            ones = np.where(codes >> (7 - k) & 1, n, 0)
            total, n1 = np.add.reduceat(n, begin), np.add.reduceat(ones, begin)
            node = {"key": key[begin], "n0": total - n1, "n1": n1, "own": _np_ln_kt((total - n1).astype(float), n1.astype(float))}
            if d == depth:
                node["below"] = node["all"] = node["own"]
            else:
                child = out[d + 1][k]
                parent = np.searchsorted(node["key"], child["key"] & ((1 << 8 * d + k) - 1))
                node["below"] = np.bincount(parent, child["all"], len(begin))
                node["all"] = np.logaddexp(node["own"], node["below"]) - np.log(2.0)
            nodes.append(node)
        out[d] = nodes
    return out


def tree(counts: DataFrame, depth: int) -> DataFrame:
    """gram, value: log10 of the probability of the last byte of each string after the bytes before it.

    ``counts`` has gram and n. A context without counts has no say: its string is predicted by the deepest context that has some.
    Contexts that share their ``TOP`` latest bytes form a subtree that a task can work through; the levels above it are aggregated by Spark.
    """
    top = min(TOP, depth)
    grouped = counts.select(F.shiftright("gram", 8).bitwiseAND(F.lit((1 << 8 * top) - 1)).alias("group"), "gram", "n")

    def up(table):
        order = np.argsort(table.column("gram").to_numpy())
        nodes = _levels(table.column("gram").to_numpy()[order], table.column("n").to_numpy()[order], depth, top)[top]
        key = np.concatenate([(node["key"] >> k) << 8 | 1 << k | node["key"] & ((1 << k) - 1) for k, node in enumerate(nodes)])
        return pa.table({"node": key, **{c: np.concatenate([node[c] for node in nodes]) for c in ("n0", "n1", "own", "below", "all")}})

    zeros, ones = F.col("n0").cast("double"), F.col("n1").cast("double")
    levels = [keep(_spread(grouped, "node long, n0 long, n1 long, own double, below double, all double", up), "tree")]
    for d in range(top - 1, -1, -1):
        mask = (1 << 8 * (d + 1)) - 1
        level = levels[-1].groupBy(F.col("node").bitwiseAND(F.lit(mask)).alias("node")).agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"), F.sum("all").alias("below"))
        level = level.withColumn("own", _ln_kt(zeros, ones))
        most = F.greatest("own", "below")
        mixed = most + F.log(F.exp(F.col("own") - most) + F.exp(F.col("below") - most)) - F.log(F.lit(2.0))
        levels.append(keep(level.withColumn("all", mixed), "tree"))
    levels.reverse()
    one = (F.col("n1") + 0.5) / (F.col("n0") + F.col("n1") + 1.0)
    share = 1 / (1 + F.exp(F.least(F.col("below") - F.col("own"), F.lit(700.0))))
    # one: the estimate of the deepest context with counts; sum: what the mixture has so far; rest: the weight of deeper contexts
    state = levels[0].select("node", one.alias("one"), (share * one).alias("sum"), (1 - share).alias("rest"))
    for d in range(1, top + 1):
        above = state.select(F.col("node").alias("up"), F.col("one").alias("up_one"), F.col("sum").alias("up_sum"), "rest")
        both = levels[d].join(above, F.col("node").bitwiseAND(F.lit((1 << 8 * d) - 1)) == F.col("up"))
        own = F.when(F.col("n0") + F.col("n1") > 0, one).otherwise(F.col("up_one"))
        state = both.select("node", own.alias("one"), (F.col("up_sum") + F.col("rest") * share * own).alias("sum"), (F.col("rest") * (1 - share)).alias("rest"))
    none = F.lit(None)
    stream = grouped.select("group", "gram", "n", *(none.cast("double").alias(c) for c in ("one", "sum", "rest"))).unionByName(
        state.select(F.shiftright("node", 8).alias("group"), F.col("node").alias("gram"), none.cast("long").alias("n"), "one", "sum", "rest")
    )

    def down(table):
        is_gram = table.column("n").combine_chunks().is_valid()
        known, table = table.filter(is_gram.cast(pa.int8()).to_numpy(zero_copy_only=False) == 0), table.filter(is_gram)
        order = np.argsort(table.column("gram").to_numpy())
        grams, n = table.column("gram").to_numpy()[order], table.column("n").to_numpy()[order]
        nodes = known.column("gram").to_numpy()
        order = np.argsort(nodes)
        nodes = nodes[order]
        start = [known.column(c).to_numpy()[order] for c in ("one", "sum", "rest")]
        made = _levels(grams, n, depth, top)
        value = np.zeros(len(grams))
        for k in range(8):
            key = made[top][k]["key"]
            at = np.searchsorted(nodes, (key >> k) << 8 | 1 << k | key & ((1 << k) - 1))
            one, sum_, rest = (x[at] for x in start)
            for d in range(top + 1, depth + 1):
                node = made[d][k]
                above = np.searchsorted(key, node["key"] & ((1 << 8 * (d - 1) + k) - 1))
                key = node["key"]
                total = node["n0"] + node["n1"]
                one = np.where(total > 0, (node["n1"] + 0.5) / (total + 1.0), one[above])
                sum_, rest = sum_[above], rest[above]
                part = 1.0 if d == depth else 1 / (1 + np.exp(np.minimum(node["below"] - node["own"], 700.0)))
                sum_, rest = sum_ + rest * part * one, rest * (1 - part)
            p = sum_ + rest * one if depth == top else sum_
            p = p[np.searchsorted(key, grams >> (8 - k))]
            value += np.log10(np.where(grams >> (7 - k) & 1, p, 1 - p))
        return pa.table({"gram": grams, "value": value})

    made = keep(_spread(stream, "gram long, value double", down), "tree")
    for level in levels:
        drop(level)
    return made


def _merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Ascending different keys of several lists, with their counts added up."""
    key, n = (np.concatenate(x) for x in zip(*parts))
    order = np.argsort(key)
    key = key[order]
    begin = _runs(key)
    return key[begin], np.add.reduceat(n[order], begin)


def _strings_of(codes: np.ndarray, learn: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different strings of a piece, ascending, and how often training rows have each."""
    both = np.sort(codes << 1 | learn)
    begin = _runs(both >> 1)
    return both[begin] >> 1, np.add.reduceat(both & 1, begin)


def _asks(dealt: DataFrame, depth: int) -> DataFrame:
    """What each chunk of texts has and asks for: its different strings (key) and words, with their counts in its training rows (n).

    The empty word stands for the end of a text.
    """

    def out(chunk, grams, words):
        key, count = _merged(grams)
        counted = pa.concat_tables(words).group_by("word", use_threads=False).aggregate([("n", "sum")])
        for at in range(0, len(key), 1 << 18):
            part = key[at : at + (1 << 18)]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), chunk, np.int32)), pa.array(part), pa.nulls(len(part), pa.binary()), pa.array(count[at : at + (1 << 18)])], names)
        few = counted.num_rows
        word = counted.column("word").combine_chunks().cast(pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(np.full(few, chunk, np.int32)), pa.nulls(few, pa.int64()), word, counted.column("n_sum").combine_chunks()], names)

    names = ["at", "key", "word", "n"]

    def run(batches):
        now, grams, words, held = None, [], [], 0
        for (chunk,), rows in runs_of_keys(batches, "chunk"):
            if chunk != now and now is not None:
                yield from out(now, grams, words)
                grams, words, held = [], [], 0
                give_back()
            now = chunk
            for part in pieces(rows, PIECE):
                data, offsets = flat(strings(part.column("text")))
                codes, first = _grams(data, offsets, depth)
                learn = part.column("learn").to_numpy(zero_copy_only=False).astype(np.int64)
                grams.append(_strings_of(codes, np.repeat(learn, np.diff(first))))
                held += len(grams[-1][0])
                if held > 4_000_000:
                    grams = [_merged(grams)]
                    held = 0
                data = LOWER[data]
                starts, ends, first = word_spans(data, offsets)
                tokens = token_array(data, starts, ends).dictionary_encode()
                index = tokens.indices.to_numpy(zero_copy_only=False)
                n = np.bincount(index, np.repeat(learn, np.diff(first)), len(tokens.dictionary)).astype(np.int64) if len(index) else np.zeros(0, np.int64)
                words.append(pa.table({"word": pa.concat_arrays([tokens.dictionary, pa.array([b""], pa.large_binary())]), "n": np.append(n, learn.sum())}))
        if now is not None:
            yield from out(now, grams, words)
        grams = words = part = data = offsets = codes = tokens = None
        give_back()

    placed = dealt.select("chunk", "text", "learn").repartition("chunk").sortWithinPartitions("chunk")
    return placed.mapInArrow(run, "at int, key long, word binary, n long")


def _packed(answers: DataFrame, column: str, blob) -> DataFrame:
    """at and blob: the ``column`` and value of each chunk, many in one row, in the order they are read."""

    def run(batches):
        held, rows = [], 0
        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows >= 1 << 18:
                yield out(held)
                held, rows = [], 0
        if rows:
            yield out(held)
        held = None
        give_back()

    def out(held):
        table = pa.Table.from_batches(held).combine_chunks()
        at = table.column("at").to_numpy()
        order = np.argsort(at, kind="stable")
        at, table = at[order], table.take(pa.array(order)).combine_chunks()
        begin = _runs(at)
        own, value = table.column(column).chunk(0), table.column("value").to_numpy()
        blobs = [blob(own.slice(a, b - a), value[a:b]) for a, b in zip(begin, np.append(begin[1:], len(at)))]
        return pa.RecordBatch.from_arrays([pa.array(at[begin]), pa.array(blobs, pa.binary())], ["at", "blob"])

    return answers.select("at", column, "value").mapInArrow(run, "at int, blob binary")


def _string_blob(key: pa.Array, value: np.ndarray) -> bytes:
    """Ascending keys as differences, by byte planes (most of which are zero), and their values."""
    key = key.to_numpy()
    order = np.argsort(key)
    step = np.diff(key[order], prepend=np.int64(0)).astype("<i8")
    return step.view(np.uint8).reshape(-1, 8).T.tobytes() + value[order].astype("<f8").tobytes()


def _strings_in(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = len(blob) // 16
    planes = np.frombuffer(blob, dtype=np.uint8, count=8 * n).reshape(8, n)
    return np.cumsum(np.ascontiguousarray(planes.T).view("<i8").ravel()), np.frombuffer(blob, dtype="<f8", offset=8 * n)


def _word_blob(word: pa.Array, value: np.ndarray) -> bytes:
    """The number of words, their values and lengths, and their bytes behind one another."""
    data, offsets = flat(word.cast(pa.large_binary()))
    return np.int64(len(word)).tobytes() + value.astype("<f8").tobytes() + np.diff(offsets).astype("<i4").tobytes() + data.tobytes()


def _words_in(blob: bytes) -> tuple[pa.Array, np.ndarray]:
    n = int(np.frombuffer(blob, dtype="<i8", count=1)[0])
    value, length = np.frombuffer(blob, dtype="<f8", count=n, offset=8), np.frombuffer(blob, dtype="<i4", count=n, offset=8 + 8 * n)
    offsets = np.append(0, np.cumsum(length)).astype(np.int64)
    return pa.Array.from_buffers(pa.large_binary(), n, [None, pa.py_buffer(offsets), pa.py_buffer(blob[8 + 12 * n :])]), value


class _Words:
    """Counts of a chunk's words by their hash; should two words of the chunk share one, by the words themselves."""

    def __init__(self, words: pa.Array, counts: np.ndarray):
        key = np.fromiter(map(xxhash.xxh64_intdigest, words.to_pylist()), dtype=np.uint64, count=len(words))
        order = np.argsort(key)
        self.key, self.counts, self.words = key[order], counts[order], None
        if (self.key[1:] == self.key[:-1]).any():
            self.words, self.counts = words, counts

    def of(self, words: pa.Array) -> np.ndarray:
        if self.words is not None:
            return self.counts[pc.index_in(words, self.words).to_numpy(zero_copy_only=False)]
        return self.counts[np.searchsorted(self.key, np.fromiter(map(xxhash.xxh64_intdigest, words.to_pylist()), dtype=np.uint64, count=len(words)))]


def score(docs: DataFrame, learn: Column, depth: int = 5, id: str = "doc_id", text: str = "text", chunk_bytes: int = CHUNK) -> DataFrame:
    """``id``, learnt, n_tokens, n_known, train_tokens, base_score, score and n_bytes for each row.

    Rows for which ``learn`` holds (null: not) teach the model, all are scored. A-Z are lower-cased. Tokens are the words between
    ASCII white space and one end for each text; base_score is the add-one unigram log10 probability of a text's tokens. score is the context tree's
    log10 probability of the text's bytes and its end. A null text is an empty one: its end is all that is scored. Without
    any training row every decision has probability one half. Repeated rows are scored each. An empty table gives no rows.

    A task of the first and last pass holds the strings and words of one chunk of about ``chunk_bytes`` of texts, and one piece of its texts at a time.
    """
    kind = docs.schema[id].dataType.simpleString()
    rows = docs.select(F.col(id).alias("id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"), F.coalesce(learn, F.lit(False)).alias("learn"))
    chunks = 1 + (rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // chunk_bytes
    # the hash of the whole row, so that no id, however frequent, fills a chunk; equal rows may meet in one
    dealt = rows.withColumn("chunk", F.pmod(F.xxhash64("id", "text"), F.lit(chunks)).cast("int"))
    asks = keep(_asks(dealt, depth), "asks")
    counts = keep(asks.where("key is not null").groupBy(F.col("key").alias("gram")).agg(F.sum("n").alias("n")), "strings")
    values = tree(counts, depth)
    drop(counts)
    words = keep(asks.where("word is not null").groupBy("word").agg(F.sum("n").alias("n")), "words")
    total = words.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count(F.when(F.col("n") > 0, 1)).alias("v")).first()  # two numbers
    trained, vocabulary = total["n"], total["v"]

    empty = {"blob": "binary", "id": kind, "text": "string", "learn": "boolean"}

    def streamed(df, place, has):
        return df.select("at", F.lit(place).cast("byte").alias("place"), *(F.col(c) if c in has else F.lit(None).cast(k).alias(c) for c, k in empty.items()))

    # a chunk's strings come first, then its words, then its texts
    of_strings = asks.where("key is not null").select("at", F.col("key").alias("gram")).join(values, "gram").select("at", F.col("gram").alias("key"), "value")
    of_words = asks.where("word is not null").select("at", "word").join(words, "word").select("at", "word", F.col("n").cast("double").alias("value"))
    stream = streamed(_packed(of_strings, "key", _string_blob), 0, ("blob",)).unionByName(streamed(_packed(of_words, "word", _word_blob), 1, ("blob",)))
    stream = stream.unionByName(streamed(dealt.withColumnRenamed("chunk", "at"), 2, ("id", "text", "learn")))

    def scored(part, grams, log10, words, end):
        data, offsets = flat(strings(part.column("text")))
        codes, at = _grams(data, offsets, depth)
        order = np.argsort(codes)
        codes = codes[order]
        begin = _runs(codes)
        of_code = np.empty(len(codes))
        of_code[order] = np.repeat(log10[np.searchsorted(grams, codes[begin])], np.diff(np.append(begin, len(codes))))
        # the sums of single texts, not differences of long sums, where rounding would add up
        value = np.add.reduceat(of_code, at[:-1])
        data = LOWER[data]
        starts, ends, begin = word_spans(data, offsets)
        tokens = token_array(data, starts, ends).dictionary_encode()
        of_token = words.of(tokens.dictionary)[tokens.indices.to_numpy(zero_copy_only=False)] if len(starts) else np.zeros(0)
        many = np.diff(begin)
        sums, seen, full = np.zeros(len(many)), np.zeros(len(many), dtype=np.int64), many > 0
        if full.any():
            sums[full] = np.add.reduceat(np.log10(of_token + 1), begin[:-1][full])
            seen[full] = np.add.reduceat((of_token > 0).astype(np.int64), begin[:-1][full])
        columns = [part.column("id"), part.column("learn"), many + 1, seen + int(end > 0), sums + np.log10(end + 1), value, np.diff(offsets)]
        return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], names)

    names = ["id", "learnt", "n_tokens", "n_known", "logs", "score", "n_bytes"]

    def run(batches):
        now, known = None, None
        for (chunk, place), rows in runs_of_keys(batches, "at", "place"):
            if chunk != now:
                now, held, known = chunk, ([], []), None
                give_back()
            if place < 2:
                held[place].extend((_words_in if place else _strings_in)(b) for b in rows.column("blob").to_pylist())
            else:
                if known is None:
                    grams, log10 = (np.concatenate(x) for x in zip(*held[0]))
                    order = np.argsort(grams)
                    words, counts = zip(*held[1])
                    words = _Words(pa.concat_arrays(words), np.concatenate(counts))
                    known = grams[order], log10[order], words, words.of(pa.array([b""], pa.large_binary()))[0]
                    held, grams, log10, order = ([], []), None, None, None
                for part in pieces(rows, PIECE):
                    yield scored(part, *known)
        held = known = words = counts = part = rows = None
        give_back()

    schema = f"id {kind}, learnt boolean, n_tokens long, n_known long, logs double, score double, n_bytes long"
    made = keep(stream.repartition("at").sortWithinPartitions("at", "place").mapInArrow(run, schema), "scores")
    for table in (values, asks, words):
        drop(table)
    base = F.col("logs") - F.col("n_tokens") * F.log10(F.lit(float(trained + vocabulary + 1)))
    return made.select(F.col("id").alias(id), "learnt", "n_tokens", "n_known", F.lit(trained).cast("long").alias("train_tokens"), base.alias("base_score"), "score", "n_bytes")
