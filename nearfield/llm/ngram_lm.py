"""N-gram language model of order three in Elias-Fano tries.

Two passes over packed chunks. The first counts words over all training rows and numbers them. The second sends each distinct
triple of a chunk, under its first two words, to a shard by hash of the pair; a shard adds up the counts of all chunks and
builds its part of the trie, a level of pairs and a level of triples: contexts are one monotone Elias-Fano sequence, pointers
a second, and the successors of all contexts a third (made monotone by the context's rank), beside quantised smoothed
probabilities; pairs have quantised weights of what is below them, too. A level lies in one anonymous memory map. An n-gram
is found by the context's rank and a search for the successor relative to its context.

p(w) = (c(w) + 0.1) / (N + 0.1 * (V + 1)); p(w | v) = (c(v w) + mass2 * p(w)) / (c(v) + mass2);
p(w | u v) = (c(u v w) + mass3 * p(w | v)) / (c(u v) + mass3), kept as its first part and the weight of the second. The first
word's context is the end token alone; the second word's is the end token and the first word. N-grams that training lacks
get the same formulas with a count of 0.

A pair of two frequent words is split by its successors over several shards, in proportion to how many it can have; each of
them is told the pair's whole count.

Null texts count as empty (only the end token); an id of null counts as the empty text in the split; rows are kept one
for one; with no training rows all counts are 0.
"""

from __future__ import annotations

import mmap

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import shards_of
from .chunks import answered, ascii_words, ask, narrow, pack, placed, shard_count, squeeze
from .common import text_or_empty, written

#: Steps of the quantised negative log10 probabilities.
STEP = 1024
POPULATION = np.array([bin(i).count("1") for i in range(256)], np.uint8)
#: The place of the k-th one in a byte.
PLACE = np.array([[next((p for p in range(8) if (b >> p) & 1 and bin(b & ((1 << p) - 1)).count("1") == k), 0) for k in range(8)] for b in range(256)], np.uint8)


class EliasFano:
    """A monotone sequence of whole numbers: low bits packed, high bits in unary."""

    @staticmethod
    def levels(x: np.ndarray) -> dict[str, np.ndarray]:
        x = x.astype(np.uint64)
        n, top = len(x), int(x[-1]) if len(x) else 0
        low = max(0, (top // max(n, 1)).bit_length() - 1)
        high = (x >> np.uint64(low)).astype(np.int64) + np.arange(n)
        bits = np.zeros((top >> low) + n + 9, np.uint8)
        bits[high] = 1
        rest = x & np.uint64((1 << low) - 1)
        packed = np.zeros(0, np.uint8) if not low else np.packbits(((rest[:, None] >> np.arange(low, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8).ravel(), bitorder="little")
        return {"shape": np.array([n, low, top], np.int64), "low": np.concatenate([packed, np.zeros(8, np.uint8)]), "high": np.packbits(bits, bitorder="little")}

    def __init__(self, shape: np.ndarray, low: np.ndarray, high: np.ndarray):
        (self.n, self.l, self.top), self.low, self.high = map(int, shape), low, high
        ones = POPULATION[high]
        self.ones = np.concatenate([[0], np.cumsum(ones, dtype=np.int64)])
        self.zeros = np.arange(len(high) + 1) * 8 - self.ones

    def _select(self, k: np.ndarray, sums: np.ndarray, flip: int) -> np.ndarray:
        byte = np.searchsorted(sums, k, "right") - 1
        return byte * 8 + PLACE[self.high[byte] ^ flip, k - sums[byte]]

    def _low(self, i: np.ndarray) -> np.ndarray:
        if not self.l:
            return np.zeros(len(i), np.int64)
        at = i * self.l
        byte, shift = at >> 3, (at & 7).astype(np.uint64)
        word = np.zeros(len(i), np.uint64)
        for j in range(8):
            word |= self.low[np.minimum(byte + j, len(self.low) - 1)].astype(np.uint64) << np.uint64(8 * j)
        return ((word >> shift) & np.uint64((1 << self.l) - 1)).astype(np.int64)

    def at(self, i: np.ndarray) -> np.ndarray:
        return ((self._select(i, self.ones, 0) - i) << self.l) | self._low(i)

    def successor(self, x: np.ndarray) -> np.ndarray:
        """The first place with a value >= x each (n: none)."""
        out = np.full(len(x), self.n, np.int64)
        live = np.flatnonzero(x <= self.top) if self.n else np.zeros(0, np.int64)
        if not len(live):
            return out
        h, low = x[live] >> self.l, x[live] & ((1 << self.l) - 1)
        begin = np.where(h == 0, 0, self._select(np.maximum(h - 1, 0), self.zeros, 255) - h + 1)  # the ones before h zeros
        end = self._select(h, self.zeros, 255) - h
        out[live] = begin
        some = np.flatnonzero(begin < end)  # values with the same high bits: halve where they may be many
        begin, end, low, live = begin[some], end[some], low[some], live[some]
        while len(live):
            mid = (begin + end) >> 1
            less = self._low(mid) < low
            begin, end = np.where(less, mid + 1, begin), np.where(less, end, mid)
            out[live] = begin
            on = np.flatnonzero(begin < end)
            begin, end, low, live = begin[on], end[on], low[on], live[on]
        return out


class Level:
    """Contexts, pointers, successors and quantised values of n-grams of one order, mapped in one piece of memory."""

    def __init__(self, v: np.ndarray, w: np.ndarray, code: np.ndarray):
        """Distinct (context, word) in that order."""
        first = starts(v)
        self.span = int(w.max(initial=0)) + 1
        rank = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(v))))
        parts = {f"{k}.{name}": x for k, seq in (("contexts", v[first]), ("pointers", np.append(first, len(v))), ("successors", rank * self.span + w)) for name, x in EliasFano.levels(seq).items()}
        parts["codes"] = code
        self.map = mmap.mmap(-1, sum(-(-x.nbytes // 8) * 8 for x in parts.values()) or 8)
        at, view = 0, {}
        for k, x in parts.items():
            self.map[at : at + x.nbytes] = x.tobytes()
            view[k] = np.frombuffer(self.map, x.dtype, len(x), at)
            at += -(-x.nbytes // 8) * 8
        self.contexts, self.pointers, self.successors = (EliasFano(*(view[f"{k}.{n}"] for n in ("shape", "low", "high"))) for k in ("contexts", "pointers", "successors"))
        self.codes = view["codes"]

    def find(self, v: np.ndarray, w: np.ndarray) -> np.ndarray:
        """The code of each n-gram, -1 where it isn't held."""
        out = np.full(len(v), -1, np.int64)
        if not self.contexts.n:
            return out
        distinct, back = np.unique(v, return_inverse=True)
        at = self.contexts.successor(distinct)
        held = (at < self.contexts.n) & (self.contexts.at(np.minimum(at, self.contexts.n - 1)) == distinct)
        rank = np.where(held, at, -1)[back]
        live = np.flatnonzero((rank >= 0) & (w < self.span))
        end = self.pointers.at(np.minimum(rank, self.contexts.n - 1)[live] + 1)
        key = rank[live] * self.span + w[live]
        place = self.successors.successor(key)
        ok = place < end
        ok[ok] = self.successors.at(place[ok]) == key[ok]
        out[live[ok]] = self.codes[place[ok]]
        return out


def starts(*keys: np.ndarray) -> np.ndarray:
    """Where groups of equals begin in sorted keys."""
    if not len(keys[0]):
        return np.zeros(0, np.int64)
    return np.flatnonzero(np.concatenate([[True], np.logical_or.reduce([k[1:] != k[:-1] for k in keys])]))


def quantise(p: np.ndarray) -> np.ndarray:
    return np.minimum(np.round(-np.log10(p) * STEP), 2**16 - 1).astype(np.uint16)


#: A pair of words that each make up more than one in so many tokens is split.
SPLIT = 512


def mixed(v: np.ndarray, w: np.ndarray | int) -> np.ndarray:
    x = v.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.asarray(w).astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
    x ^= x >> np.uint64(31)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(29))


def told_apart(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys in order, and each key's place among them."""
    order = np.argsort(key)
    key = key[order]
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    back = np.empty(len(key), np.int32)
    back[order] = np.cumsum(new) - 1
    return key[new], back


class Grams:
    """Of a numbered chunk: its distinct triples in order of words' numbers, the pairs they begin with, and where all go.

    A text is read as end, its words, end, nothing: as many triples as tokens, whose pairs are all of the text's pairs."""

    def __init__(self, payload, shards: int, n_all: int):
        kept, n, ids, c, seq = payload
        order = np.argsort(ids, kind="stable")
        self.ids = np.concatenate([[0], ids[order].astype(np.int64) + 1])  # 0: nothing
        self.c = np.concatenate([[0], c[order].astype(np.int64)])
        rank = np.empty(len(ids), np.int32)
        rank[order] = np.arange(1, len(ids) + 1)
        n, size = n.astype(np.int64), len(self.ids)
        stops = np.cumsum(n + 3)
        inside = np.ones(int(stops[-1]) if len(n) else 0, bool)
        inside[np.concatenate([stops - n - 3, stops - 2, stops - 1])] = False
        s = np.full(len(inside), rank[-1], np.int32)
        s[inside], s[stops - 1] = rank[seq], 0
        inside[:] = True
        inside[np.concatenate([stops - 2, stops - 1])] = False
        at = np.flatnonzero(inside)
        self.tokens = s[at + 2]
        pair = s[at].astype(np.int64) * size + s[at + 1]
        distinct = None if size**3 < 2**63 else np.unique(pair)
        key, self.back = told_apart((pair if distinct is None else np.searchsorted(distinct, pair)) * size + self.tokens)
        del s, at, inside, pair
        self.w = (key % size).astype(np.int32)
        key //= size
        first = starts(key)
        pair = key[first] if distinct is None else distinct
        self.u, self.v = np.divmod(pair, size)
        del key
        self.first, self.many = first, np.diff(np.append(first, len(self.w)))
        self.n, self.train = n + 1, kept.column("train").to_numpy().astype(bool)
        # shards: those of a split pair follow one another
        parts = np.minimum(shards, 1 + SPLIT * np.minimum(self.c[self.u], self.c[self.v]) // max(1, n_all))
        base = (mixed(self.ids[self.u], self.ids[self.v]) % np.uint64(shards)).astype(np.int64)
        self.pair_of = np.repeat(np.arange(len(pair), dtype=np.int32), self.many)
        shard = base[self.pair_of]
        split = np.flatnonzero(parts[self.pair_of] > 1)
        shard[split] += (mixed(self.ids[self.w[split]], 7) % parts[self.pair_of[split]].astype(np.uint64)).astype(np.int64)
        self.row_pair = np.repeat(np.arange(len(pair), dtype=np.int32), parts)
        row_shard = base[self.row_pair] + np.arange(len(self.row_pair)) - np.repeat(np.cumsum(parts) - parts, parts)
        small = np.uint16 if shards < 2**16 else np.int64  # sixteen bits are sorted by radix
        row_shard, shard = (row_shard % shards).astype(small), (shard % shards).astype(small)
        self.row_order, self.order = np.argsort(row_shard, kind="stable").astype(np.int32), np.argsort(shard, kind="stable").astype(np.int32)
        self.row_shard, self.shard = row_shard[self.row_order], shard[self.order]

    def runs(self):
        """shard, its pairs' rows (first, end), its triples (first, end)."""
        cut = starts(self.row_shard)
        ends = np.append(cut[1:], len(self.row_shard))
        found = self.row_shard[cut]
        for k, a, b, lo, hi in zip(found, cut, ends, np.searchsorted(self.shard, found), np.searchsorted(self.shard, found, "right"), strict=True):
            yield int(k), self.row_pair[self.row_order[a:b]], self.row_order[a:b], self.order[lo:hi]


def score(docs: DataFrame, train, mass2: float = 200.0, mass3: float = 20.0, id_col: str = "doc_id", text_col: str = "text", chunk_tokens: int = 2_000_000) -> DataFrame:
    """id, held_out, n_tokens, n_known, train_tokens, base_score, score. train: a boolean column expression."""
    spark, kind = docs.sparkSession, dict(docs.dtypes)[id_col]
    shards = shard_count(spark)
    slim = docs.select(id_col, train.alias("train"), text_or_empty(text_col).alias("text"))
    chunks = placed(pack(slim, ascii_words, chunk_tokens))

    def counts(payload):
        """Training counts by local word; the end token (the empty string) is last."""
        kept, n, words, seq = payload
        mask = kept.column("train").to_numpy().astype(bool)
        c = np.bincount(seq[np.repeat(mask, n.astype(np.int64))].astype(np.int64), minlength=len(words))
        return pa.concat_arrays([words.cast(pa.large_string()), pa.array([""], pa.large_string())]), np.append(c, mask.sum()).astype(np.int64)

    def ask_words(payload):
        words, c = counts(payload)
        of = shards_of(words, shards)
        for k in np.unique(of):
            yield int(k), (words.filter(pa.array(of == k)), narrow(c[of == k]))

    def count_words(shard: int, asked: list):
        every = pa.concat_arrays([w for _, (w, _) in asked]).dictionary_encode()
        codes = every.indices.to_numpy().astype(np.int64)
        c = np.bincount(codes, weights=np.concatenate([x.astype(np.float64) for _, (_, x) in asked]), minlength=len(every.dictionary)).astype(np.int64)
        yield -1 - shard, (int((c > 0).sum()), int(c.sum()))
        frequent = np.empty(len(c), np.int64)  # small numbers for frequent words: they compress better
        frequent[np.argsort(-c, kind="stable")] = np.arange(len(c))
        at = 0
        for chunk, (words, _) in asked:
            mine = codes[at : at + len(words)]
            at += len(words)
            yield chunk, (narrow(frequent[mine]), narrow(c[mine]))

    def number(chunk: int, payload, answers: dict) -> pa.Table:
        """The chunk with each word's number and count in place of its text; of a shard, its totals."""
        if payload is None:
            (v, n), out = next(iter(answers.values())), b""
        else:
            kept, n, words, seq = payload
            words, _ = counts(payload)
            of, ids, c = shards_of(words, shards).astype(np.int64), np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
            for k, (codes, got) in answers.items():
                ids[of == k], c[of == k] = codes.astype(np.int64) * shards + k, got
            out, v, n = squeeze((kept, n, narrow(ids), narrow(c), seq)), 0, 0
        return pa.table({"chunk_id": pa.array([chunk], pa.int64()), "payload": pa.array([out], pa.binary()), "v": pa.array([v], pa.int64()), "n": pa.array([n], pa.int64())})

    numbered = written(answered(chunks, ask(chunks, ask_words, count_words), number, "chunk_id long, payload binary, v long, n long"), "lm")
    total = numbered.agg(F.sum("v").alias("v"), F.sum("n").alias("n")).first()
    vocabulary, n_all = int(total.v or 0), int(total.n or 0)
    chunks = placed(numbered.where("chunk_id >= 0").select("chunk_id", "payload"))

    def base(c: np.ndarray) -> np.ndarray:
        return (c + 0.1) / (n_all + 0.1 * (vocabulary + 1))

    def ask_grams(payload):
        g = Grams(payload, shards, n_all)
        t = np.bincount(g.back[np.repeat(g.train, g.n)], minlength=len(g.w))
        total = np.add.reduceat(t, g.first) if len(t) else t
        for k, pair, _, triple in g.runs():
            place = np.searchsorted(pair, g.pair_of[triple])  # both in order
            many = np.bincount(place, minlength=len(pair))
            other = total[pair] - np.bincount(place, t[triple], len(pair)).astype(np.int64)
            seen = total[pair] > 0
            u, v = g.u[pair], g.v[pair]
            yield k, (narrow(np.diff(g.ids[u], prepend=0)), narrow(g.ids[v]), narrow(many), narrow(other), narrow(g.c[u][seen]), narrow(g.c[v][seen]), narrow(g.ids[g.w[triple]]), narrow(t[triple]))

    def answer_grams(shard: int, asked: list):
        cat = lambda k: np.concatenate([x[k] for _, x in asked]).astype(np.int64)
        u, v = np.concatenate([np.cumsum(x[0].astype(np.int64)) for _, x in asked]), cat(1)
        w, t, of = cat(6), cat(7), np.repeat(np.arange(len(u)), cat(2))
        count = cat(3) + np.bincount(of, t, len(u)).astype(np.int64)
        cu, cv = np.zeros(len(u), np.int64), np.zeros(len(u), np.int64)  # a chunk says them of what its training rows have
        cu[count > 0], cv[count > 0] = cat(4), cat(5)
        order = np.lexsort((v, u))
        first = starts(u[order], v[order])
        place = np.empty(len(u), np.int64)
        place[order] = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(u))))
        count, cu, cv = np.add.reduceat(count[order], first), np.maximum.reduceat(cu[order], first), np.maximum.reduceat(cv[order], first)
        u, v = u[order][first], v[order][first]
        held = count > 0
        two = Level(u[held], v[held], quantise((count[held] + mass2 * base(cv[held])) / (cu[held] + mass2)))
        code2 = narrow(two.find(u, v) + 1)[place]
        below = quantise(mass3 / (count + mass3))[place]
        span = int(w.max(initial=0)) + 1
        key, back = np.unique(place[of] * span + w, return_inverse=True)
        at, w = np.divmod(key, span)
        t = np.bincount(back, t, len(key))
        held = t > 0
        three = Level(at[held], w[held], quantise(t[held] / (count[at[held]] + mass3)))
        code3 = narrow(three.find(at, w) + 1)[back]
        a = b = 0
        for chunk, x in asked:
            a, b, lo, hi = a + len(x[1]), b + len(x[6]), a, b
            yield chunk, (code2[lo:a], below[lo:a], code3[hi:b])

    def finish(chunk: int, payload, answers: dict) -> pa.Table:
        g = Grams(payload, shards, n_all)
        code2, below, code3 = np.zeros(len(g.u), np.uint32), np.zeros(len(g.u), np.uint16), np.zeros(len(g.w), np.uint32)
        for k, pair, _, triple in g.runs():
            code2[pair], below[pair], code3[triple] = answers[k]
        p2 = np.where(code2 > 0, 10 ** ((1 - code2.astype(float)) / STEP), mass2 * base(g.c[g.v]) / (g.c[g.u] + mass2))
        p3 = np.where(code3 > 0, 10 ** ((1 - code3.astype(float)) / STEP), 0)
        pair = g.pair_of[g.back]
        # a token's own pair begins the next triple; that of a text's first word begins its first
        ends = np.cumsum(g.n)
        p = p2[np.append(pair[1:], 0)] if len(pair) else p2[:0]
        p *= (10 ** (-below.astype(float) / STEP))[pair]
        p += p3[g.back]
        p[ends - 1] = p2[pair[ends - g.n]]
        sums = lambda x: np.add.reduceat(x, ends - g.n)
        c = np.where(g.tokens > 0, g.c[g.tokens], 0)
        c[ends - 1] = g.c[g.v[pair[ends - g.n]]]
        return pa.table({id_col: payload[0].column(0), "held_out": pa.array(~g.train), "n_tokens": pa.array(g.n), "n_known": pa.array(sums((c > 0).astype(np.int64))), "train_tokens": pa.array(np.full(len(g.n), n_all)), "base_score": pa.array(sums(np.log10(base(c)))), "score": pa.array(sums(np.log10(p)))})

    return answered(chunks, ask(chunks, ask_grams, answer_grams), finish, f"{id_col} {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
