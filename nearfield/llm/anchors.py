"""Content-defined anchors of byte strings: sampled suffixes that any two equal passages share.

A passage of ``length`` bytes has ``length - gram + 1`` grams; its anchor is the gram with the least hash, the leftmost of
equals. Equal passages have their anchor at the same offset, so comparing passages by anchor misses none.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

#: Bytes worked on at a time, small enough for a processor's cache.
BLOCK = 1 << 16
PLACE_BITS = 18
PLACE_MASK = np.uint64((1 << PLACE_BITS) - 1)


@lru_cache(8)
def tables(seed: int, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a polynomial hash modulo 2^64: values of bytes, powers of the base and of its inverse."""
    rng = np.random.default_rng(seed)
    values = rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    base = int(rng.integers(1, 2**61, dtype=np.uint64)) * 8 + 5
    power = lambda b: np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(size, b, np.uint64))])
    return values, power(base), power(pow(base, -1, 2**64))


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


class Rolling:
    """Hashes of any substring of a block of bytes."""

    def __init__(self, data: np.ndarray, seed: int):
        values, self.up, self.down = tables(seed, 1 << PLACE_BITS)
        terms = values[data]
        terms *= self.up[: len(data)]
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(terms, out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.sums[end] - self.sums[start]) * self.down[start]

    def grams(self, size: int) -> np.ndarray:
        n = max(0, len(self.sums) - size)
        out = self.sums[size : size + n] - self.sums[:n]
        out *= self.down[:n]
        return out


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    done = 1
    while done * 2 <= width:
        x = np.minimum(x[:-done], x[done:])
        done *= 2
    return np.minimum(x[: len(x) - (width - done)], x[width - done :]) if width > done else x


def blocks(sizes: np.ndarray, length: int):
    """Cut texts laid end to end into blocks: (first byte, end, first passage, end of passages), with no passage twice."""
    total = int(sizes.sum())
    for at in range(0, max(total - length + 1, 0), BLOCK):
        upto = min(total - length + 1, at + BLOCK)
        yield at, upto + length - 1, upto


def anchors(data: np.ndarray, sizes: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For texts laid end to end: runs of passages with one anchor, as arrays (first passage, last passage, anchor). Passages
    never cross texts."""
    ends = np.cumsum(sizes)
    starts = ends - sizes
    ok_to = np.maximum(starts, ends - length + 1)  # passages start in [starts, ok_to)
    out = []
    for at, end, upto in blocks(sizes, length):
        key = mixed(Rolling(data[at:end], 1).grams(gram))
        key &= ~PLACE_MASK
        key |= np.arange(len(key), dtype=np.uint64)
        place = sliding_min(key, length - gram + 1)
        place &= PLACE_MASK
        valid = np.zeros(upto - at + 1, np.int32)
        i, j = np.searchsorted(ok_to, at, "right"), np.searchsorted(starts, upto)
        lo, hi = np.clip(starts[i:j] - at, 0, upto - at), np.clip(ok_to[i:j] - at, 0, upto - at)
        np.add.at(valid, lo, 1)
        np.add.at(valid, hi, -1)
        valid = np.cumsum(valid[:-1]) > 0
        doc = np.zeros(len(valid), bool)
        doc[lo[lo < len(doc)]] = True
        change = np.ones(len(valid), bool)
        change[1:] = place[1:] != place[:-1]
        first = np.flatnonzero(valid & (change | doc | np.concatenate([[True], ~valid[:-1]])))
        stop = np.concatenate([first[1:], [len(valid)]])
        gaps = np.flatnonzero(~valid)
        if len(gaps):
            nxt = np.searchsorted(gaps, first)
            stop = np.minimum(stop, np.where(nxt < len(gaps), gaps[np.minimum(nxt, len(gaps) - 1)], len(valid)))
        out.append((first + at, stop - 1 + at, place[first].astype(np.int64) + at))
    return tuple(np.concatenate([o[i] for o in out]) if out else np.zeros(0, np.int64) for i in range(3))


def hashes(data: np.ndarray, start: np.ndarray, size: np.ndarray | int, offsets: list[int], seed: int) -> list[np.ndarray]:
    """Of the substrings of a size at each offset from some places (in rising order), an array an offset; places that lie
    outside are moved to the ends. A block's rolling hash is made once for all places in it and all offsets."""
    out = [np.empty(len(start), np.uint64) for _ in offsets]
    sizes = np.broadcast_to(np.asarray(size, np.int64), start.shape)
    i = 0
    while i < len(start):
        j = int(np.searchsorted(start, start[i] + BLOCK))
        n = sizes[i:j]
        low = max(0, min(int(start[i]) + min(offsets), len(data) - int(n.max())))
        roll = Rolling(data[low : int(start[j - 1]) + max(offsets) + int(n.max())], seed)
        end = len(roll.sums) - 1
        for o, to in zip(offsets, out, strict=True):
            at = np.clip(start[i:j] + (o - low), 0, end - n)
            to[i:j] = roll.of(at, at + n)
        i = j
    return [mixed(x) for x in out]
