"""Suffix-array dedup: removal of every passage of ``length`` bytes that occurs more than once in the corpus.

Bucket-pointer refinement over sampled suffixes. Each passage has its anchor (see anchors.py), so the suffixes at anchors
suffice. Initial buckets hold the suffixes with one q-gram, q an eighth of the length. A bucket with one suffix is settled:
nothing in it occurs twice. The others are refined by doubling: a bucket of grams twice as long is named by the identifiers of
two buckets of the round before, at the suffix and at a later offset, and those in turn by buckets of the round before
them. Identifiers come from the bytes alone, so any task can name the bucket of any offset without asking. A gram grows to the
right where it still lies in the passage, and to the left of the anchor where it doesn't, so a run of passages with one anchor
is parted in two. When grams have half the length, what is left is refined
* by the whole run of passages: where a run occurs again, all its passages are repeats, and if its bucket holds no other run,
  that is all;
* then passage by passage, by the identifiers of its first gram and of that at the later offset length - half, which settle
  it, as both halves make up the passage. One suffix stands for each run that occurs again.
A round settles buckets for all chunks; the next reuses its result and asks about the rest alone. Buckets are summed up in each
chunk first, so a chunk sends an identifier once, however many copies it has.

Texts are taken as UTF-8 bytes. Null texts count as empty; rows are kept one for one (a repeated row's text is a repeat);
shorter texts are returned whole; extra columns are ignored. Identifiers are 64-bit hashes, used in pairs where they decide
that bytes go.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .anchors import anchors, hashes, mixed
from .chunks import ASKS, answered, ask, asks, narrow, pack_bytes, placed, rounds, served, tagged
from .common import partitions, text_or_empty


def groups(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order that sorts by the keys (the first is the major one), and where in it each group of equals begins."""
    order = np.lexsort(keys[::-1])
    new = np.ones(len(order), bool)
    new[1:] = np.logical_or.reduce([k[order][1:] != k[order][:-1] for k in keys]) if len(order) > 1 else new[1:]
    return order, np.flatnonzero(new)


def sums(x: np.ndarray, first: np.ndarray) -> np.ndarray:
    return np.add.reduceat(x, first) if len(first) else np.zeros(0, np.int64)


def by_shard(of: np.ndarray, *columns: np.ndarray):
    """(shard, columns of its rows); rows keep their order."""
    if not len(of):
        return
    order = np.argsort(of, kind="stable")
    first = np.flatnonzero(np.concatenate([[True], of[order][1:] != of[order][:-1]]))
    for a, b in zip(first, np.append(first[1:], len(of)), strict=True):
        yield int(of[order[a]]), tuple(c[order[a:b]] for c in columns)


def back(of: np.ndarray, answers: dict) -> np.ndarray:
    """The shards' answers in the order of the rows."""
    out = np.zeros(len(of), np.uint8)
    for k, got in answers.items():
        out[of == k] = got
    return out


def gram_sizes(length: int) -> list[int]:
    """Of each round's grams; each is at most twice the one before, and the last at least half the length."""
    return [-(-length // 8), -(-length // 4), -(-length // 2)]


def pointers(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The name of a bucket by those of two buckets of the round before."""
    return mixed(a * np.uint64(0x9E3779B97F4A7C15) + b)


def named(level: int, sizes: list[int], base: dict[int, np.ndarray], at: int) -> np.ndarray:
    """Identifiers of the grams of a round at an offset, from those of q-grams by offset."""
    if not level:
        return base[at]
    later = sizes[level] - sizes[level - 1]
    return pointers(named(level - 1, sizes, base, at), named(level - 1, sizes, base, at + later))


def offsets(level: int, sizes: list[int]) -> list[int]:
    """At which offsets of a gram of a round its q-grams begin."""
    out = [0]
    for k in range(level):
        out = sorted({o + later for o in out for later in (0, sizes[k + 1] - sizes[k])})
    return out


class Marked:
    """What a chunk finds out, round by round. Open units are runs of passages, or parts of them: (run, first, last)."""

    def __init__(self, payload, length: int, shards: int):
        self.kept, self.sizes, self.data = payload[0], payload[1].astype(np.int64), payload[2]
        jump, span, place = (x.astype(np.int64) for x in payload[3])
        first = np.cumsum(jump)
        self.length, self.grams, self.shards = length, gram_sizes(length), np.uint64(shards)
        self.anchor, self.unit = first + place, (np.arange(len(first)), first, first + span)
        self.base: dict[int, np.ndarray] = {}

    def q_grams(self, levels: int) -> None:
        """Identifiers of the q-grams at all offsets from the anchors that grams of so many rounds need."""
        places = sorted({o + side for k in range(levels) for o in offsets(k, self.grams) for side in (0, self.grams[0] - self.grams[k])})
        order = np.argsort(self.anchor, kind="stable")
        for at, found in zip(places, hashes(self.data, self.anchor[order], self.grams[0], places, 1), strict=True):
            self.base[at] = np.empty(len(order), np.uint64)
            self.base[at][order] = found

    def parted(self, level: int) -> None:
        """Open units with the sides to which their grams grow: those whose gram begins at the anchor, and before it."""
        run, first, last = self.unit
        cut = np.clip(self.anchor[run] - (self.length - self.grams[level]), first, last + 1)
        left, right = cut > first, cut <= last
        order = np.argsort(np.concatenate([run[left], run[right]]), kind="stable")
        join = lambda a, b: np.concatenate([a[left], b[right]])[order]
        self.unit = join(run, run), join(first, cut), join(cut - 1, last)
        self.before = join(np.ones(len(run), bool), np.zeros(len(run), bool))

    def keys(self, level: int) -> np.ndarray:
        """Identifiers of the open units' grams of a round."""
        run, _, _ = self.unit
        if not level:
            self.before = np.zeros(len(run), bool)
            return self.base[0][run]
        out = np.empty(len(run), np.uint64)
        for left in (False, True):
            some = self.before == left
            at = self.grams[0] - self.grams[level] if left else 0
            base = {o: self.base[o + at][run[some]] for o in offsets(level, self.grams)}
            out[some] = named(level, self.grams, base, 0)
        return out

    def asked(self, a: np.ndarray, b: np.ndarray | None = None, spread: bool = True):
        """Distinct identifiers, dealt to shards (spread: by both): each with 1, or 2 if the chunk has several."""
        self.order, self.first = groups(a) if b is None else groups(a, b)
        n = np.minimum(np.diff(np.append(self.first, len(self.order))), 2).astype(np.uint8)
        columns = [x[self.order][self.first] for x in (a, b) if x is not None]
        self.of = ((columns[0] ^ (columns[-1] >> np.uint64(7))) if spread else columns[0]) % self.shards
        return by_shard(self.of, *columns, n)

    def told(self, answers: dict) -> np.ndarray:
        """Of each identifier that was asked about: 0: once, 1: several times, 2: that, and the chunk stands for it; 3: several
        times, and nothing else is in the bucket."""
        out = np.zeros(len(self.order), np.uint8)
        out[self.order] = np.repeat(back(self.of, answers), np.diff(np.append(self.first, len(self.order))))
        return out

    def ask(self, k: int, answers: list[dict]):
        """The questions of round k, given the answers to those before."""
        levels = len(self.grams)
        self.q_grams(min(k + 1, levels))
        for level in range(min(k, levels - 1) + 1):
            if level:
                self.parted(level)
            key = self.keys(level)
            questions = self.asked(key)
            if level == k:
                return questions
            self.keep(self.told(answers[level]) > 0)
            key = key[self.kept_units]
        run, first, last = self.unit
        order = np.argsort(first, kind="stable")
        whole = np.empty(len(run), np.uint64)
        whole[order] = hashes(self.data, first[order], (last - first)[order] + self.length, [0], 2)[0]
        place = self.anchor[run]
        questions = self.asked(key, pointers(whole, ((place - first) * self.length + (last - first)).astype(np.uint64)), False)
        if k == levels:
            return questions
        code = self.told(answers[levels])
        # where one run occurs again, one of its suffixes in the chunk that stands for it is enough, and none in a bucket that
        # holds no other run
        stands = np.zeros(len(code), bool)
        stands[self.order[self.first]] = True
        self.again = first[code > 0], last[code > 0]
        self.keep((code == 0) | ((code == 2) & stands))
        _, first, last = self.unit
        size = last - first + 1
        self.start = np.sort(np.repeat(first - (np.cumsum(size) - size), size) + np.arange(int(size.sum())))
        inner, later = offsets(levels - 1, self.grams), self.length - self.grams[-1]
        places = sorted({o + at for o in inner for at in (0, later)})
        ids = dict(zip(places, hashes(self.data, self.start, self.grams[0], places, 1), strict=True))
        return self.asked(*(named(levels - 1, self.grams, {o: ids[o + at] for o in inner}, 0) for at in (0, later)))

    def keep(self, some: np.ndarray) -> None:
        self.kept_units = some
        self.unit = tuple(x[some] for x in self.unit)
        self.before = self.before[some]

    def covered(self, answers: list[dict]) -> np.ndarray:
        """Which bytes go."""
        last_round = len(self.grams) + 1
        for _ in self.ask(last_round, answers):
            pass
        hit = self.start[self.told(answers[last_round]) > 0]
        edge = np.zeros(len(self.data) + 1, np.int32)
        for first, last in (self.again, (hit, hit)):
            np.add.at(edge, first, 1)
            np.add.at(edge, last + self.length, -1)
        return np.cumsum(edge[:-1]) > 0


def serve(shard: int, asked: list, runs: bool = False):
    """0: once in all, 1: several times, 2: that, and the chunk stands for it. runs: the first identifier is that of a bucket,
    which the shard holds whole; 3: several times, and the bucket has nothing else."""
    keys = [np.concatenate([x[i] for _, x in asked]) for i in range(len(asked[0][1]) - 1)]
    many = np.concatenate([x[-1] for _, x in asked])
    order, first = groups(*keys)
    flat = np.empty(len(order), np.uint8)
    flat[order] = np.repeat(sums(many[order].astype(np.int64), first) > 1, np.diff(np.append(first, len(order))))
    flat[order[first]] *= 2  # lexsort is stable: the first chunk
    if runs:
        bucket = keys[0][order]
        begins = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
        kinds = np.add.reduceat(np.isin(np.arange(len(order)), first, assume_unique=True).astype(np.int64), begins)
        alone = np.repeat(kinds == 1, np.diff(np.append(begins, len(order)))) & (flat[order] > 0)
        flat[order[alone]] = 3
    at = 0
    for chunk, x in asked:
        yield chunk, flat[at : at + len(x[0])]
        at += len(x[0])


def remove_repeats(docs: DataFrame, length: int = 200, keep: list[str] | None = None, text_col: str = "text", chunk_bytes: int = 8_000_000) -> DataFrame:
    """keep (columns; default doc_id), n_bytes, spans array<struct<start,end>> in bytes, kept binary, kept_text (whole characters)."""
    keep = keep or ["doc_id"]
    shards, last_round = partitions(docs.sparkSession), len(gram_sizes(length)) + 1

    def runs(data: np.ndarray, sizes: np.ndarray) -> tuple:
        first, last, place = anchors(data, sizes, length, gram_sizes(length)[0])
        return narrow(np.diff(first, prepend=0)), narrow(last - first), narrow(place - first)

    chunks = placed(pack_bytes(docs.select(*keep, text_or_empty(text_col).alias("__text")), chunk_bytes, runs))
    mark = lambda payload: Marked(payload, length, shards)
    told = tagged(ask(chunks, lambda payload: mark(payload).ask(0, []), serve), 0)
    for k in range(1, last_round + 1):
        more = answered(chunks, told, lambda chunk, payload, answers, k=k: asks(chunk, mark(payload).ask(k, rounds(answers))), ASKS)
        told = told.unionByName(tagged(served(more, lambda shard, asked, runs=k == last_round - 1: serve(shard, asked, runs)), k))

    def finish(chunk: int, payload, answers: dict) -> pa.Table:
        m = mark(payload)
        gone = m.covered(rounds(answers))
        ends = np.cumsum(m.sizes)
        starts = ends - m.sizes
        edge = np.zeros(len(gone) + 1, bool)
        edge[1:-1] = gone[1:] != gone[:-1]
        edge[0] = edge[-1] = True
        edge[starts] = True  # spans don't cross texts
        cut = np.flatnonzero(edge)
        raw = m.data.tobytes()
        spans, kept, text = [], [], []
        lo = np.searchsorted(cut, starts)
        hi = np.searchsorted(cut, ends)
        for s, i, j in zip(starts.tolist(), lo.tolist(), hi.tolist(), strict=True):
            pieces, mine = [], []
            for a, b in zip(cut[i:j].tolist(), cut[i + 1 : j + 1].tolist(), strict=True):
                if gone[a]:
                    mine.append({"start": a - s, "end": b - s})
                else:
                    pieces.append(raw[a:b])
            spans.append(mine)
            kept.append(b"".join(pieces))
            text.append("".join(p.decode("utf-8", "ignore") for p in pieces))
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        return pa.table([*m.kept.columns, pa.array(m.sizes), pa.array(spans, kind), pa.array(kept, pa.binary()), pa.array(text, pa.string())], names=[*keep, "n_bytes", "spans", "kept", "kept_text"])

    kinds = dict(docs.dtypes)
    spec = ", ".join([*(f"`{c}` {kinds[c]}" for c in keep), "n_bytes long, spans array<struct<start:long,end:long>>, kept binary, kept_text string"])
    return answered(chunks, told, finish, spec)


def digests(done: DataFrame, id_col: str = "doc_id") -> DataFrame:
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    return done.select(id_col, "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
