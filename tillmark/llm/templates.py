"""Benchmark leaks by canonical templates.

Numbers, names and units become typed placeholders, everything else lower-case words; windows of the canonical tokens are
hashed and joined between benchmark and documents. Where windows meet, the placeholders' values are compared: a leak that was
given other numbers or names has to change equal slots equally, in both directions. Each text has three forms, which meet only their own
kind: in one a capitalised word that opens a sentence is a word, in another a name, and in the third every token is its lower-cased self, so that
copies are found whatever their case, their numbers and the rest of the alignment.

Documents send only windows that a Bloom filter of the benchmark's windows lets through. The filter has a fixed size; with a very large
benchmark it lets more through, and the join decides all the same.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillmark.llm.store import keep
from tillmark.llm.texts import coded, flat, pieces, ragged, strings, token_array

WINDOW = 8
#: Tokens in a row, about, that make a leak; a shorter item has to be there whole.
LEAK_TOKENS = 13
#: Items of fewer canonical tokens, and windows with fewer plain words, are too common to tell a leak by their template; they count in their own words only.
LEAST_TOKENS, LEAST_WORDS = 5, 3
#: Items of fewer tokens than this are found only where they are a whole line: words like "yes" stand in most texts.
INSIDE_TOKENS = 3
BLOOM_BITS = 23

#: Unit words that follow a number. Fixed values.
UNITS = set("m km cm mm mi ft in yd g kg mg lb lbs oz t l ml s sec h hr hrs min ms kmh mph w kw v a hz ghz mb gb meter meters metre metres kilometer kilometers kilometre kilometres mile miles foot feet inch inches yard yards gram grams kilogram kilograms pound pounds ounce ounces ton tons liter liters litre litres second seconds minute minutes hour hours day days week weeks month months year years dollar dollars cent cents euro euros percent degree degrees".split())

#: The longest stretch of consecutive numbers in ``qs``.
LONGEST = """aggregate(array_sort(qs), named_struct('now', cast(array() as array<bigint>), 'best', cast(array() as array<bigint>)),
(s, q) -> named_struct('now', if(size(s.now) > 0 and element_at(s.now, -1) = q - 1, concat(s.now, array(q)), array(q)),
  'best', if(size(s.best) > if(size(s.now) > 0 and element_at(s.now, -1) = q - 1, size(s.now) + 1, 1), s.best, if(size(s.now) > 0 and element_at(s.now, -1) = q - 1, concat(s.now, array(q)), array(q)))),
s -> s.best)"""

_LETTER, _DIGIT, _END = 1, 2, 3
_KIND = np.zeros(256, dtype=np.uint8)
_KIND[[*range(65, 91), *range(97, 123), *range(128, 256)]] = _LETTER
_KIND[48:58] = _DIGIT
_SENTENCE_END = np.zeros(256, dtype=bool)
_SENTENCE_END[[ord(c) for c in ".!?:\n\""]] = True
_MIX = np.uint64(0x9E3779B97F4A7C15)
WORD, NUMBER, NAME, UNIT = range(4)
OPENERS_PLAIN, OPENERS_NAMED, LITERAL = range(3)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _token_facts(tokens: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of different tokens: a hash of the lower-cased form, whether it is written as a name, whether it is a unit word."""
    import xxhash

    value = np.empty(len(tokens), dtype=np.uint64)
    named = np.zeros(len(tokens), dtype=bool)
    unit = np.zeros(len(tokens), dtype=bool)
    for k, token in enumerate(tokens):
        text = token.decode("utf-8", "replace")
        lower = text.lower()
        value[k] = xxhash.xxh64_intdigest(lower.encode())
        named[k] = text[0] != lower[0] and text[1:] == lower[1:]
        unit[k] = lower in UNITS
    return value, named, unit


def canonical(data: np.ndarray, offsets: np.ndarray) -> tuple[list[tuple[np.ndarray, np.ndarray, np.ndarray]], np.ndarray]:
    """Of each form the kind and value of each token of all texts, and where each text's start; and which tokens of the literal form begin a line (one more entry).

    A capitalised word is a name, unless a sentence starts with it and the form has openers plain; names in a row are one. A unit is a
    unit word right after a number. The literal form has plain words only.
    """
    n = len(data)
    kind = _KIND[data]
    if n > 2:  # a point or comma between digits belongs to the number
        inner = (data[1:-1] == 46) | (data[1:-1] == 44)
        kind[1:-1][inner & (kind[:-2] == _DIGIT) & (kind[2:] == _DIGIT)] = _DIGIT
    new = np.ones(n, dtype=bool)
    new[1:] = kind[1:] != kind[:-1]
    new[offsets[:-1][offsets[:-1] < n]] = True
    edge = np.flatnonzero(np.append(new, True))
    starts, ends = edge[:-1], edge[1:]
    live = kind[starts] > 0 if n else np.zeros(0, dtype=bool)
    starts, ends = starts[live], ends[live]
    first = np.searchsorted(starts, offsets)
    m = len(starts)
    if not m:
        return [(np.zeros(0, np.uint8), np.zeros(0, np.uint64), first)] * 3, np.ones(1, dtype=bool)
    words, index = coded(token_array(data, starts, ends))
    value, named, unit = (x[index] for x in _token_facts(words))
    stops = np.append(0, np.cumsum(_SENTENCE_END[data]))
    opens = np.ones(m, dtype=bool)  # a sentence or text starts with the token
    opens[1:] = stops[starts[1:]] != stops[ends[:-1]]
    opens[first[:-1][first[:-1] < m]] = True
    number = kind[starts] == _DIGIT
    after_number = np.zeros(m, dtype=bool)
    after_number[1:] = number[:-1] & ~opens[1:]
    made = []
    for name in (named & ~opens & ~number, named & ~number):
        what = np.where(number, NUMBER, np.where(unit & after_number, UNIT, np.where(name, NAME, WORD))).astype(np.uint8)
        again = np.zeros(m, dtype=bool)
        again[1:] = (what[1:] == NAME) & (what[:-1] == NAME) & ~opens[1:]
        keep_ = np.flatnonzero(~again)
        whole = np.add.reduceat(_mixed(value + np.where(again, np.uint64(1), np.uint64(0))), keep_)  # names in a row: the value of all
        made.append((what[keep_], whole, np.searchsorted(keep_, first)))
    feeds = np.append(0, np.cumsum(data == 10))
    line = np.ones(m + 1, dtype=bool)
    line[1:-1] = feeds[starts[1:]] != feeds[ends[:-1]]
    line[first] = True
    return [*made, (np.zeros(m, np.uint8), value, first)], line


def windows(form: int, what: np.ndarray, value: np.ndarray, first: np.ndarray, length: int, line: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start (token number) and hash of each window of ``length`` tokens that lies in one text and, but in the literal form, has enough plain words.

    Literal windows of few tokens have to be a whole line, or several.
    """
    n = len(what)
    if n < length:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    code = np.where(what == WORD, value, what.astype(np.uint64) + np.uint64(1))
    count = n - length + 1
    h = np.full(count, length + (form << 8), dtype=np.uint64)
    for k in range(length):
        h = h * _MIX + code[k : k + count]
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))
    ok = text[:count] == text[length - 1 :]
    if form != LITERAL:
        plain = np.append(0, np.cumsum(what == WORD))
        ok &= plain[length:] - plain[:count] >= LEAST_WORDS
    elif length < INSIDE_TOKENS:
        ok &= line[:count] & line[length:]
    at = np.flatnonzero(ok)
    return at, _mixed(h[at])


def _out(ids, form, what, value, first, at, h, length, text, made) -> pa.RecordBatch:
    slot = np.append(0, np.cumsum(what != WORD))
    slots_at = np.flatnonzero(what != WORD)
    begin, many = slot[at], slot[at + length] - slot[at]
    values = (value[slots_at[ragged(begin, many)]]).view(np.int64)
    lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(many)).astype(np.int32)), pa.array(values))
    width = np.diff(first)[text]
    columns = [ids.take(pa.array(text)), pa.array(np.full(len(at), form)), pa.array(h.view(np.int64)), pa.array((at - first[text]).astype(np.int64)), lists, pa.array(width.astype(np.int64)), pa.array(made[text].astype(np.int64))]
    return pa.RecordBatch.from_arrays(columns, ["id", "form", "h", "at", "slots", "tokens", "made"])


def _windows_of(rows: DataFrame, lengths_for, passes=None) -> DataFrame:
    """id, form, h, at, slots, tokens and made (how many there are of the text, form and length) of the windows of each row's text.

    ``lengths_for``: form and token counts -> {length: which texts}.
    """
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches):
        test = passes() if passes else None
        for batch in batches:
            for part in pieces(batch):
                forms, line = canonical(*flat(strings(part.column("text"))))
                for form, (what, value, first) in enumerate(forms):
                    for length, chosen in lengths_for(form, np.diff(first)).items():
                        at, h = windows(form, what, value, first, length, line)
                        text = np.searchsorted(first, at, side="right") - 1
                        made = np.bincount(text, minlength=len(first) - 1)
                        ok = chosen[text]
                        ok &= test(h) if test else True
                        at, h, text = at[ok], h[ok], text[ok]
                        for lo in range(0, len(at), 1 << 16):
                            some = slice(lo, lo + (1 << 16))
                            yield _out(part.column("id"), form, what, value, first, at[some], h[some], length, text[some], made)

    return rows.mapInArrow(run, f"id {kind}, form long, h long, at long, slots array<long>, tokens long, made long")


def leaks(docs: DataFrame, benchmark: DataFrame, id: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """``id``, ``item``, windows, item_windows and coverage for each document and benchmark item it leaks.

    An item leaks when windows that make up about ``LEAK_TOKENS`` tokens of it (all, if it is shorter) occur in the document
    with consistent slots, or in a row in the item's own words, in whatever case. Windows are counted in the form that covers the item best.
    Null and empty texts match nothing. Items under ``LEAST_TOKENS`` canonical tokens, and those without windows of ``LEAST_WORDS``
    plain words, are found in their own words only, and items under ``INSIDE_TOKENS`` tokens only where they are a whole line of the document. Rows with one id count as one document
    or item; null ids are an id of their own. An empty table on either side gives no rows.
    """
    spark = docs.sparkSession

    def of_item(form, n):
        return {k: (n >= k) if k == WINDOW else n == k for k in range(1 if form == LITERAL else LEAST_TOKENS, WINDOW + 1)}

    items = benchmark.select(F.col(item).alias("id"), F.col(item_text).cast("string").alias("text"))
    wanted = keep(_windows_of(items, of_item), "windows")
    bit = F.shiftrightunsigned("h", 64 - BLOOM_BITS)
    filled = wanted.groupBy(F.shiftright(bit, 5).alias("word")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(shiftrightunsigned(h, {64 - BLOOM_BITS}) & 31 as int))")).alias("bits"))
    bloom = np.zeros(1 << BLOOM_BITS - 5, dtype=np.uint32)
    for row in filled.collect():  # 2 ** 18 rows at most
        bloom[row["word"]] = row["bits"]
    lengths = sorted(tuple(r) for r in wanted.select("form", F.least("tokens", F.lit(WINDOW)).alias("n")).distinct().collect())  # of 16 possible ones
    shared = spark.sparkContext.broadcast(bloom.tobytes())  # a megabyte, whatever the input

    def passes():
        table = np.frombuffer(shared.value, dtype=np.uint32)
        down = np.uint64(64 - BLOOM_BITS)

        def test(h):
            bit = (h >> down).astype(np.int64)
            return (table[bit >> 5] >> (bit & 31).astype(np.uint32) & np.uint32(1)).astype(bool)

        return test

    texts = docs.select(F.col(id).alias("id"), F.col(text).cast("string").alias("text"))
    found = _windows_of(texts, lambda form, n: {k: n >= k for f, k in lengths if f == form}, passes)
    left = found.select(F.col("id").alias("doc"), "form", "h", F.col("at").alias("p"), F.col("slots").alias("said"))
    right = wanted.select(F.col("id").alias("item"), "form", "h", F.col("at").alias("q"), F.col("slots").alias("asked"), "tokens", "made")
    met = left.join(right, ["form", "h"]).withColumn("pairs", F.arrays_zip("asked", "said"))
    consistent = (F.size(F.array_distinct("pairs")) == F.size(F.array_distinct("pairs.asked"))) & (F.size(F.array_distinct("pairs")) == F.size(F.array_distinct("pairs.said")))
    met = met.where(consistent).withColumn("line", F.col("p") - F.col("q"))
    # the slots of all windows of one alignment together; an item's tokens bound them
    facts = [F.max("tokens").alias("tokens"), F.max("made").alias("made")]
    runs = met.groupBy("doc", "item", "form", "line").agg(F.array_distinct(F.flatten(F.collect_set("pairs"))).alias("pairs"), F.collect_set("q").alias("qs"), *facts).where(consistent)
    # own words count in a row: the positions of an alignment's longest stretch
    literal = F.col("form") == LITERAL
    runs = runs.withColumn("qs", F.when(literal, F.expr(LONGEST)).otherwise(F.col("qs")))
    pairs = runs.groupBy("doc", "item", "form").agg(F.array_distinct(F.flatten(F.collect_list("qs"))).alias("all"), F.max(F.size("qs")).alias("longest"), *facts)
    # the first word of a passage may look like a name where no sentence ends before it, so one template window of a whole set may be missing
    whole = F.col("made") >= F.greatest(F.lit(1), F.col("tokens") - WINDOW + 1)
    need = F.least(F.lit(LEAK_TOKENS - WINDOW + 1), F.when(~literal & whole, F.greatest(F.lit(1), F.col("made") - 1)).otherwise(F.col("made")))
    many = F.when(literal, F.col("longest")).otherwise(F.size("all")).cast("long")
    pairs = pairs.select("doc", "item", "form", "tokens", "made", many.alias("windows")).where(F.col("windows") >= need)
    best = F.struct(F.least(F.lit(1.0), F.col("windows") / F.col("made")).alias("coverage"), "windows", F.col("made").alias("item_windows"))
    pairs = pairs.groupBy("doc", "item").agg(F.max(best).alias("best"))
    return pairs.select(F.col("doc").alias(id), F.col("item").alias(item), "best.windows", "best.item_windows", "best.coverage")
