"""Chunks of documents that ask sharded tables about their distinct words or pairs.

A text operator that needs a table over all words cannot broadcast it (it grows with the corpus) and should not shuffle
every occurrence. So each task packs its documents into chunks (distinct words once, documents as indexes into them), and
a chunk sends each shard one request with what it wants to know, at most once a word. A shard merges the requests of all
chunks, and answers each. Requests and answers are compressed columns; a frequent word costs one entry a chunk, so no
key is hot. Shards grow in number with ``spark.sql.shuffle.partitions``, which is to grow with the data.

Chunk ids come from the task's place and the chunk's, so a task that is run again must read the same rows in the same order.
Tables and written stages are read so; an input that comes out of a shuffle is written first.
A blob holds what one chunk asks one shard, so blobs grow in number with both: choose chunks and shards so that a blob
still holds hundreds of entries.
"""

from __future__ import annotations

import io
import pickle
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import give_back, partitions, written

CHUNK_SPEC = "chunk_id long, payload binary"


def from_planes(planes: bytes, kind: str) -> np.ndarray:
    dtype = np.dtype(kind)
    return np.frombuffer(planes, np.uint8).reshape(dtype.itemsize, -1).T.copy().view(dtype).ravel()


class Planes(pickle.Pickler):
    """Whole numbers are written byte by byte (all first bytes, all second ones ...), which compresses better."""

    def reducer_override(self, x):
        if type(x) is np.ndarray and x.ndim == 1 and x.dtype.kind in "iu" and x.dtype.itemsize > 1 and len(x):
            return from_planes, (np.ascontiguousarray(x).view(np.uint8).reshape(-1, x.dtype.itemsize).T.tobytes(), x.dtype.str)
        return NotImplemented


def squeeze(x) -> bytes:
    out = io.BytesIO()
    Planes(out, protocol=5).dump(x)
    return zstandard.ZstdCompressor(level=1).compress(out.getbuffer())


def expand(b: bytes):
    return pickle.loads(zstandard.ZstdDecompressor().decompress(b))


def narrow(x: np.ndarray) -> np.ndarray:
    """The same whole numbers in the smallest unsigned type."""
    most = int(x.max(initial=0))
    return x.astype(np.uint8 if most < 2**8 else np.uint16 if most < 2**16 else np.uint32 if most < 2**32 else np.uint64)


def shard_count(spark) -> int:
    return 4 * partitions(spark)


def encoded(flat: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Indexes and distinct values."""
    d = flat.dictionary_encode()
    return d.indices.to_numpy(), d.dictionary


def rereadable(df: DataFrame) -> DataFrame:
    """df, written first if its rows come out of a shuffle, whose order may change when it is made again."""
    return written(df, "input") if "Exchange" in df._jdf.queryExecution().executedPlan().toString() else df


def pack(docs: DataFrame, words: Callable[[pa.RecordBatch], tuple[np.ndarray, pa.Array]], chunk_tokens: int = 4_000_000) -> DataFrame:
    """docs: the columns to keep, text last. words: of a batch, each row's number of words, and all words in order.

    A payload is (kept columns, words a row, distinct words, indexes of all words). A chunk ends with the batch at which it
    has chunk_tokens words; rows are never split.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, made, held, size = TaskContext.get().partitionId(), 0, [], 0

        def emit():
            flat = pa.chunked_array([pa.DictionaryArray.from_arrays(pa.array(i, pa.int32()), d) for _, _, i, d in held]).unify_dictionaries()
            kept = pa.Table.from_batches([k for k, _, _, _ in held]).combine_chunks()
            payload = (kept, narrow(np.concatenate([n for _, n, _, _ in held])), flat.chunk(0).dictionary, narrow(np.concatenate([c.indices.to_numpy() for c in flat.chunks])))
            return pa.RecordBatch.from_pylist([{"chunk_id": (task << 32) + made, "payload": squeeze(payload)}], schema=pa.schema([("chunk_id", pa.int64()), ("payload", pa.binary())]))

        for b in batches:
            for at in range(0, b.num_rows, 2000):
                part = b.slice(at, 2000)
                n, flat = words(part)
                held.append((part.select(part.schema.names[:-1]), n, *encoded(flat)))
                size += len(flat)
                if size >= chunk_tokens:
                    yield emit()
                    made, held, size = made + 1, [], 0
        if held:
            yield emit()
            held = []
        give_back()

    return rereadable(docs).mapInArrow(run, CHUNK_SPEC)


def pack_bytes(docs: DataFrame, chunk_bytes: int, more: Callable[[np.ndarray, np.ndarray], tuple]) -> DataFrame:
    """docs: the columns to keep, text last. A payload is (kept columns, each text's bytes, all texts end to end, what ``more``
    makes of the latter two)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, made, held, size = TaskContext.get().partitionId(), 0, [], 0

        def emit():
            text = pa.concat_arrays([t for _, t in held])
            n = pc.binary_length(text).to_numpy(zero_copy_only=False)
            data = np.frombuffer(b"".join(t.as_py() for t in text), np.uint8)
            payload = (pa.Table.from_batches([k for k, _ in held]).combine_chunks(), narrow(n), data, more(data, n.astype(np.int64)))
            return pa.RecordBatch.from_pylist([{"chunk_id": (task << 32) + made, "payload": squeeze(payload)}], schema=pa.schema([("chunk_id", pa.int64()), ("payload", pa.binary())]))

        for b in batches:
            for at in range(0, b.num_rows, 2000):
                part = b.slice(at, 2000)
                text = part.column(part.num_columns - 1).cast(pa.large_binary())
                held.append((part.select(part.schema.names[:-1]), text))
                size += pc.sum(pc.binary_length(text)).as_py() or 0
                if size >= chunk_bytes:
                    yield emit()
                    made, held, size = made + 1, [], 0
        if held:
            yield emit()
            held = []
        give_back()

    return rereadable(docs).mapInArrow(run, CHUNK_SPEC)


def placed(chunks: DataFrame) -> DataFrame:
    """Shuffled once by chunk, for all the steps that follow (they reuse the exchange)."""
    return chunks.repartition(partitions(chunks.sparkSession), "chunk_id")


def ask(chunks: DataFrame, request: Callable[[object], Iterable[tuple[int, object]]], serve: Callable[[int, list], Iterable[tuple[int, object]]]) -> DataFrame:
    """chunk_id, shard, blob: the shards' answers. request: of a payload, pairs of shard and question. serve: of a shard
    and its list of (chunk_id, question), pairs of chunk_id and answer."""

    def asking(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for chunk, payload in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                yield from asks(chunk, request(expand(payload.as_py()))).to_batches()
        give_back()

    return served(chunks.mapInArrow(asking, ASKS), serve)


def answered(chunks: DataFrame, answers: DataFrame, finish: Callable[[int, object, dict], pa.Table], spec: str) -> DataFrame:
    """finish: of a chunk's id, payload (None: none has this id) and the answers by shard, the rows to return."""

    def run(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        payload = expand(left.column("payload")[0].as_py()) if left.num_rows else None
        got = finish(key[0].as_py(), payload, {k: expand(x) for k, x in (zip(right.column("shard").to_pylist(), right.column("blob").to_pylist(), strict=True) if right.num_rows else ())})
        payload = None
        give_back()
        return got

    return chunks.groupBy("chunk_id").cogroup(answers.groupBy("chunk_id")).applyInArrow(run, spec)


def ascii_words(b: pa.RecordBatch) -> tuple[np.ndarray, pa.Array]:
    """Words between ASCII white space, A-Z lower-cased; the text is the last column."""
    text = b.column(b.num_columns - 1)
    text = text.take(pa.array(np.arange(len(text)))).cast(pa.large_string())  # the kernels below misread slices
    parts = pc.ascii_split_whitespace(pc.ascii_lower(text))
    flat = parts.flatten()
    some = pc.not_equal(pc.binary_length(flat), 0)
    n = np.diff(np.concatenate([[0], np.cumsum(some.to_numpy(zero_copy_only=False))])[parts.offsets.to_numpy() - parts.offsets[0].as_py()])
    return n, flat.filter(some)


#: Rounds of questions that one chunk can ask, at most.
ROUNDS = 8


def tagged(answers: DataFrame, k: int) -> DataFrame:
    """Answers of round k (from 0), told apart by their shard's number."""
    return answers.withColumn("shard", F.col("shard") * ROUNDS + k)


def rounds(answers: dict) -> list[dict]:
    """Answers by round and shard."""
    out: list[dict] = [{} for _ in range(ROUNDS)]
    for s, x in answers.items():
        out[s % ROUNDS][s // ROUNDS] = x
    return out


ASKS = "chunk_id long, shard long, blob binary"


def asks(chunk: int, rows: Iterable[tuple[int, object]]) -> pa.Table:
    """A chunk's questions to shards."""
    rows = [(k, squeeze(x)) for k, x in rows]
    return pa.table({"chunk_id": pa.array([chunk] * len(rows), pa.int64()), "shard": pa.array([k for k, _ in rows], pa.int64()), "blob": pa.array([x for _, x in rows], pa.binary())})


def served(requests: DataFrame, serve: Callable[[int, list], Iterable[tuple[int, object]]]) -> DataFrame:
    """chunk_id, shard, blob: the shards' answers to requests of that shape."""

    def serving(key: tuple, t: pa.Table) -> pa.Table:
        asked = sorted(zip(t.column("chunk_id").to_pylist(), t.column("blob").to_pylist(), strict=True))
        got = [(c, squeeze(x)) for c, x in serve(key[0].as_py(), [(c, expand(x)) for c, x in asked])]
        out = pa.table({"chunk_id": pa.array([c for c, _ in got], pa.int64()), "shard": pa.array([key[0].as_py()] * len(got), pa.int64()), "blob": pa.array([x for _, x in got], pa.binary())})
        asked = got = None
        give_back()
        return out

    return requests.groupBy("shard").applyInArrow(serving, ASKS)
