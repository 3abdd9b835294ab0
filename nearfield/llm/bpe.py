"""BPE encoding and decoding by a distinct-word table.

Texts are split into the tokenizer's words; each distinct word of the corpus goes to one shard and is encoded there once;
ids come back to the chunk that asked and are put in place by position. Decoding joins ids to pieces.

The split is done here for texts of characters whose classes and lower case are the same in all Unicode tables, and by
the tokenizer's own normalizer and pre-tokenizer for any other text. Special strings in a text become their ids.

Null texts count as empty (no ids, empty decoded text); rows are kept one for one; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chunks import answered, ask, narrow, pack, placed, shard_count
from .common import text_or_empty

KNOWN = re.compile("[\t\n\r\x20-\x7e -įı-ňŊ-ž‐-‧‰-›€]*")
WORD = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")


class WordBpe:
    """A word-level BPE tokenizer file: split a text into words, encode words, name pieces."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.no_truncation()
        self.tok.no_padding()
        self.special = sorted((t.content for t in self.tok.get_added_tokens_decoder().values()), key=len, reverse=True)
        self.cut = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        self.pieces = pa.array([self.tok.id_to_token(i) for i in range(self.tok.get_vocab_size())], pa.string())

    def plain_words(self, text: str) -> list[str]:
        if KNOWN.fullmatch(text):
            return WORD.findall(text.lower())
        text = self.tok.normalizer.normalize_str(text)
        return [m for m in (text[a:b] for _, (a, b) in self.tok.pre_tokenizer.pre_tokenize_str(text)) if m]

    def words(self, text: str) -> list[str]:
        if self.cut is None or not self.cut.search(text):
            return self.plain_words(text)
        return [w for part in self.cut.split(text) for w in ([part] if part in self.special else self.plain_words(part))]

    def encode(self, words: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tok.encode_batch(words, add_special_tokens=False)]


@lru_cache(4)
def word_bpe(path: str) -> WordBpe:
    return WordBpe(path)


def shards_of(words: pa.Array, shards: int) -> np.ndarray:
    return np.fromiter((xxhash.xxh3_64_intdigest(w) for w in words.cast(pa.binary()).to_pylist()), np.uint64, len(words)).astype(np.uint64) % np.uint64(shards)


def split(path: str) -> Callable[[pa.RecordBatch], tuple[np.ndarray, pa.Array]]:
    def run(b: pa.RecordBatch) -> tuple[np.ndarray, pa.Array]:
        bpe = word_bpe(path)
        rows = [bpe.words(t) for t in b.column(b.num_columns - 1).to_pylist()]
        return np.fromiter(map(len, rows), np.int64, len(rows)), pa.array([w for r in rows for w in r], pa.string())

    return run


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", chunk_tokens: int = 2_500_000) -> DataFrame:
    """id, ids array<int>, decoded string for each row."""
    shards, kind = shard_count(docs.sparkSession), dict(docs.dtypes)[id_col]
    chunks = placed(pack(docs.select(id_col, text_or_empty(text_col).alias("text")), split(path), chunk_tokens))

    def request(payload):
        words = payload[2]
        of = shards_of(words, shards)
        for k in np.unique(of):
            yield int(k), words.filter(pa.array(of == k))

    def serve(shard: int, asked: list):
        bpe = word_bpe(path)
        every = pa.concat_arrays([w for _, w in asked]).dictionary_encode()
        ids = bpe.encode(every.dictionary.to_pylist())  # each distinct word once
        size = np.fromiter(map(len, ids), np.int64, len(ids))
        start, flat = np.cumsum(size) - size, np.fromiter((i for x in ids for i in x), np.int64, int(size.sum()))
        codes, at = every.indices.to_numpy(), 0
        for chunk, words in asked:
            mine = codes[at : at + len(words)]
            at += len(words)
            yield chunk, (narrow(size[mine]), narrow(flat[spread(start[mine], size[mine])]))

    def finish(chunk: int, payload, answers: dict) -> pa.Table:
        kept, n, words, seq = payload
        of = shards_of(words, shards)
        size, parts = np.zeros(len(words), np.int64), []
        for k, (sizes, flat) in answers.items():
            size[of == k] = sizes
            parts.append((np.flatnonzero(of == k), sizes.astype(np.int64), flat))
        start = np.cumsum(size) - size
        ids = np.zeros(int(size.sum()), np.int32)
        for at, sizes, flat in parts:
            ids[spread(start[at], sizes)] = flat
        seq, out, n = seq.astype(np.int64), [], n.astype(np.int64)
        ends, at = np.concatenate([[0], np.cumsum(n)]), 0
        pieces = word_bpe(path).pieces
        while at < len(n):  # rows in blocks of bounded size
            to = max(at + 1, int(np.searchsorted(ends, ends[at] + 500_000, "right")) - 1)
            mine = seq[ends[at] : ends[to]]
            flat = ids[spread(start[mine], size[mine])]
            upto = np.concatenate([[0], np.cumsum(size[mine])])[ends[at : to + 1] - ends[at]].astype(np.int32)
            named = pa.ListArray.from_arrays(pa.array(upto, pa.int32()), pieces.take(pa.array(flat)))  # ids joined to pieces
            out.append(pa.table([kept.column(0).slice(at, to - at), pa.ListArray.from_arrays(pa.array(upto, pa.int32()), pa.array(flat, pa.int32())), pa.compute.binary_join(named, " ")], names=[id_col, "ids", "decoded"]))
            at = to
        return pa.concat_tables(out).combine_chunks()

    return answered(chunks, ask(chunks, request, serve), finish, f"{id_col} {kind}, ids array<int>, decoded string")


def spread(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The places start, start + 1 ... of each run, one after the other."""
    size = size.astype(np.int64)
    before = np.cumsum(size) - size
    return np.repeat(start.astype(np.int64) - before, size) + np.arange(int(size.sum()))


def digests(coded: DataFrame, id_col: str = "doc_id") -> DataFrame:
    return coded.select(id_col, F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.concat_ws(" ", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
