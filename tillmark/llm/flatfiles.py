"""Token ids as flat unsigned integer files with 64-bit document offsets, for memory-mapped reading.

A data set is a folder. ``part-N-*.bin`` holds the ids of a range of documents behind each other, as the smallest
unsigned type (16 or 32 bits, little-endian) that fits the vocabulary. ``part-N-*.idx`` holds signed 64-bit integers: how many documents,
their offsets in ids (one more for the end), whether each document has an id, and these ids. ``manifest`` is a small
table of the files that count, with each one's base: the ids in all files before it, from a prefix sum.
"""

from __future__ import annotations

import os
import uuid
import zlib
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillmark.llm.bpe import Encoder, byte_letters
from tillmark.llm.texts import pieces, strings


def library_encoder(content: str) -> tuple[Encoder, int]:
    """An encoder whose pre-tokens the tokenizers library encodes, and the size of the vocabulary.

    Pre-tokens go straight to the library's merges, in the letters of the vocabulary file; all of the library runs on them only if the vocabulary
    has a normalizer or another splitter before the merges.
    """
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer, pre_tokenizers

    tokenizer = Tokenizer.from_str(content)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    special = {t.content: i for i, t in tokenizer.get_added_tokens_decoder().items()}
    fast = getattr(tokenizer, "encode_batch_fast", tokenizer.encode_batch)
    tokenize = tokenizer.model.tokenize
    letter = np.zeros(256, dtype="<u4")
    for c, b in byte_letters().items():
        letter[b] = ord(c)

    def merged(words):
        letters = letter[np.frombuffer(b"".join(words), dtype=np.uint8)].tobytes().decode("utf-32-le")
        at = 0
        for word in words:
            yield [t.id for t in tokenize(letters[at : at + len(word)])]
            at += len(word)

    def whole(words):
        for at in range(0, len(words), 1 << 14):
            for made in fast([w.decode() for w in words[at : at + (1 << 14)]], add_special_tokens=False):
                yield made.ids

    splitter = tokenizer.pre_tokenizer
    plain = tokenizer.normalizer is None and isinstance(splitter, pre_tokenizers.ByteLevel) and not splitter.add_prefix_space
    return Encoder(special, merged if plain else whole), tokenizer.get_vocab_size()


def _make_folder(uri: str) -> None:
    store, path = fs.FileSystem.from_uri(uri)
    store.create_dir(path, recursive=True)


def write(docs: DataFrame, folder: str, vocabulary: str, end_token: int | None = None, id: str = "doc_id", text: str = "text") -> DataFrame:
    """Encode all texts, write them in ascending order of ``id``, and return the manifest.

    Documents are dealt by ranges of (id, hash of the text), so that rows of one id (or of null, which comes first) can fill several files.
    Each try of a task writes files of its own name; the manifest names those of the tries that Spark took, so a lost
    executor or a repeated task leaves at most files that nobody reads. A null text is an empty one: it has the end token only.
    An empty table gives a manifest without files.
    """
    spark = docs.sparkSession
    with open(vocabulary, encoding="utf-8") as f:
        content = spark.sparkContext.broadcast(f.read())
    _make_folder(folder)

    def run(batches):
        encoder, size = library_encoder(content.value)
        kind = "<u2" if max(size, (end_token or 0) + 1) <= 1 << 16 else "<u4"
        store, place = fs.FileSystem.from_uri(folder)
        part = TaskContext.get().partitionId()
        name = f"part-{part:06d}-{uuid.uuid4().hex}"
        lengths, ids, known, out = [], [], [], None
        for batch in batches:
            for piece in pieces(batch):
                out = out or store.open_output_stream(f"{place}/{name}.bin")
                made, at = encoder.batch(strings(piece.column("text")))
                if end_token is not None:
                    made = np.insert(made, at[1:], end_token)
                    at = at + np.arange(len(at))
                out.write(made.astype(kind).tobytes())
                lengths.append(np.diff(at))
                column = piece.column("id")
                known.append(column.is_valid().to_numpy(zero_copy_only=False).astype("<i8"))
                ids.append(column.fill_null(0).to_numpy(zero_copy_only=False).astype("<i8"))
        if out is None:
            return
        out.close()
        length = np.concatenate(lengths)
        offsets = np.append(0, np.cumsum(length))
        with store.open_output_stream(f"{place}/{name}.idx") as index:
            index.write(np.concatenate([[len(length)], offsets, *known, *ids]).astype("<i8").tobytes())
        yield pa.RecordBatch.from_pydict({"part": [part], "name": [name], "kind": [kind], "docs": [len(length)], "ids": [int(offsets[-1])]})

    chosen = docs.select(F.col(id).cast("long").alias("id"), F.col(text).cast("string").alias("text")).withColumn("tie", F.xxhash64("text"))
    ordered = chosen.repartitionByRange("id", "tie").sortWithinPartitions("id", "tie")
    files = sorted(tuple(r) for r in ordered.mapInArrow(run, "part long, name string, kind string, docs long, ids long").collect())  # one row for each file
    bases = [0, *accumulate(f[4] for f in files)]
    rows = [(*f, base) for f, base in zip(files, bases)]
    manifest = spark.createDataFrame(rows, "part long, name string, kind string, docs long, ids long, base long")
    manifest.coalesce(1).write.parquet(f"{folder}/manifest")
    return spark.read.parquet(f"{folder}/manifest")


def open_part(folder: str, name: str, kind: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """ids, offsets, which documents have an id, document ids; local files are memory-mapped."""
    store, place = fs.FileSystem.from_uri(folder)

    def numbers(path, dtype):
        if isinstance(store, fs.LocalFileSystem):
            return np.asarray(np.memmap(path, dtype=dtype, mode="r")) if os.path.getsize(path) else np.zeros(0, dtype)
        with store.open_input_file(path) as f:
            return np.frombuffer(f.read(), dtype=dtype)

    index = numbers(f"{place}/{name}.idx", "<i8")
    n = int(index[0])
    return numbers(f"{place}/{name}.bin", kind), index[1 : n + 2], index[n + 2 : 2 * n + 2].astype(bool), index[2 * n + 2 :]


def read(spark: SparkSession, folder: str, each=None, schema: str = "ids array<long>") -> DataFrame:
    """One row per document: doc_id, start (ids of all documents before it), n_tokens, and what ``each`` makes of its ids."""
    manifest = spark.read.parquet(f"{folder}/manifest")
    each = each or (lambda ids: ids.astype(np.int64).tolist())
    field = schema.split()[0]
    out = spark.createDataFrame([], schema).schema
    from pyspark.sql.pandas.types import to_arrow_type

    kind = to_arrow_type(out[0].dataType)

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                ids, offsets, known, doc_ids = open_part(folder, row["name"], row["kind"])
                step = 4096
                for at in range(0, len(doc_ids), step):
                    to = min(at + step, len(doc_ids))
                    made = [each(ids[offsets[k] : offsets[k + 1]]) for k in range(at, to)]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(doc_ids[at:to], pa.int64(), mask=~known[at:to]), pa.array(offsets[at:to] + row["base"]), pa.array(np.diff(offsets[at : to + 1])), pa.array(made, kind)],
                        ["doc_id", "start", "n_tokens", field],
                    )

    files = max(1, manifest.count())
    return manifest.repartition(files, "part").mapInArrow(run, f"doc_id long, start long, n_tokens long, {schema}")


def crc32(ids: np.ndarray) -> int:
    """Unsigned crc32 of ids as little-endian unsigned 32-bit integers."""
    return zlib.crc32(ids.astype("<u4").tobytes())
