"""Near-duplicates by circulant MinHash, exact Jaccard verification and connected components.

Shingles of ``width`` words are hashed; a first permutation sends a hash to a place in a circle of 2^22, and a second one,
read from that place on, gives all coordinates of the signature: coordinate k is the least value at place + k over the
set. So a shingle costs one contiguous read for all coordinates. Bands of 5 coordinates make buckets; with 40 bands a
pair at similarity 0.8 is missed with probability 1e-7.

Copies with the same set are one node (its smallest id). In a bucket the members are verified against its hub, the member
with most company in all buckets (near copies are nearest to what they were copied from); those it isn't linked with against
a hub of theirs, for ``hub_rounds`` rounds. Members of buckets that still span several components meet by prefixes: each
set's shingles are put in order of how many of these sets hold them, rarest first; sets linked by num / den share one within
the first n - ceil(num * n / den) + 1, at places that leave enough room for the overlap, so a join on the shingles of prefixes
finds every link between components and few other pairs, however many members a bucket has.
Pairs are verified on full sets, after sizes and signatures have ruled out what they can (a true link with probability
1e-8). Joins are plain sort-merge joins, whose hot keys adaptive execution splits. Components are found by alternating large
and small stars.

Texts are lower-cased in A-Z; words lie between ASCII white space. With fewer words than the width, the whole sequence is
the one shingle; null texts and texts without words have none and are linked with nothing. Rows that share an id are one
node. Rows are kept one for one; extra columns are ignored; null ids are kept, alone. Ids are whole numbers (or text of
them; other text fails in Spark's cast).
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chunks import ascii_words
from .common import give_back, text_or_empty, written

CIRCLE = 1 << 22
BANDS, ROWS = 40, 5
COORDINATES = BANDS * ROWS
@lru_cache(1)
def circle() -> np.ndarray:
    """The second permutation, with its beginning repeated behind its end."""
    p = np.random.default_rng(20).permutation(CIRCLE).astype(np.uint32)
    return np.concatenate([p, p[:COORDINATES]])


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_sets(batch: pa.RecordBatch, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of all rows, row by row, and each row's number of them. The text is the last column."""
    n, flat = ascii_words(batch)
    d = flat.dictionary_encode()
    by_word = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in d.dictionary.cast(pa.large_binary()).to_pylist()), np.uint64, len(d.dictionary))
    token = by_word[d.indices.to_numpy()] if len(flat) else np.zeros(0, np.uint64)
    n = n.astype(np.int64)
    start = np.cumsum(n) - n
    many = np.where(n >= width, n - width + 1, (n > 0).astype(np.int64))
    row = np.repeat(np.arange(len(n)), many)
    at = np.repeat(start - (np.cumsum(many) - many), many) + np.arange(int(many.sum()))
    size = np.minimum(n, width)[row]
    h = mix(size.astype(np.uint64))
    for k in range(width):
        inside = k < size
        h = np.where(inside, mix(h * np.uint64(0x9E3779B97F4A7C15) + token[np.minimum(at + k, max(0, len(token) - 1))]), h) if len(token) else h
    order = np.lexsort((h, row))
    h, row = h[order], row[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    return h[new], np.bincount(row[new], minlength=len(n))


def signatures(h: np.ndarray, size: np.ndarray) -> np.ndarray:
    """A row of BANDS * ROWS coordinates for each set; empty sets have none and must not be asked for."""
    view = np.lib.stride_tricks.sliding_window_view(circle(), COORDINATES)
    out = np.empty((len(size), COORDINATES), np.uint32)
    ends = np.cumsum(size)
    i = 0
    while i < len(size):
        first = int(ends[i] - size[i])
        j = max(i + 1, int(np.searchsorted(ends, first + 20_000, "right")))
        least = None
        for a in range(first, int(ends[j - 1]), 20_000):  # one long text, in pieces
            place = (h[a : min(a + 20_000, int(ends[j - 1]))] >> np.uint64(42)).astype(np.int64)
            if j == i + 1:
                got = view[place].min(axis=0)
                least = got if least is None else np.minimum(least, got)
            else:
                out[i:j] = np.minimum.reduceat(view[place], ends[i:j] - size[i:j] - first, axis=0)
        if j == i + 1:
            out[i] = least
        i = j
    return out


def band_keys(sig: np.ndarray) -> np.ndarray:
    key = np.full((len(sig), BANDS), 0, np.uint64) + mix(np.arange(1, BANDS + 1, dtype=np.uint64))
    for r in range(ROWS):
        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + sig[:, r::ROWS].astype(np.uint64))
    return key.view(np.int64)


def sketches(docs: DataFrame, width: int, id_col: str, text_col: str) -> DataFrame:
    """id, n_shingles, f1, f2 (the set's fingerprint), bands (none for empty sets), sig (a byte of each coordinate, by eights)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 1000):
                part = b.slice(at, 1000)
                h, size = shingle_sets(part, width)
                ends = np.cumsum(size)
                prints = [xxhash.xxh3_128_intdigest(h[e - s : e].tobytes()) for s, e in zip(size.tolist(), ends.tolist(), strict=True)]
                signed = lambda x: x - 2**64 if x >= 2**63 else x
                some = np.flatnonzero(size > 0)
                sig = signatures(h, size[some]) if len(some) else np.zeros((0, COORDINATES), np.uint32)
                keys, low = band_keys(sig), np.ascontiguousarray(sig.astype(np.uint8)).view(np.int64)
                listed = lambda x: pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(np.where(size > 0, x.shape[1], 0))]).astype(np.int32)), pa.array(x.ravel()))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(size, pa.int64()), pa.array([signed(p >> 64) for p in prints], pa.int64()), pa.array([signed(p & (2**64 - 1)) for p in prints], pa.int64()), listed(keys), listed(low)], names=["id", "n_shingles", "f1", "f2", "bands", "sig"])
        give_back()

    return docs.select(F.col(id_col).cast("long").alias("id"), text_or_empty(text_col).alias("text")).mapInArrow(run, "id long, n_shingles long, f1 long, f2 long, bands array<long>, sig array<long>")


def verified(pairs: DataFrame, texts: DataFrame, width: int) -> DataFrame:
    """a, b, both, either (intersection and union counted on full sets) of pairs (a, b); texts: id, text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                one, n = shingle_sets(part.select(["a_text"]), width)
                hubs = part.column("b_text").dictionary_encode()
                two, m = shingle_sets(pa.RecordBatch.from_arrays([hubs.dictionary], names=["t"]), width)
                e, f = np.cumsum(n), np.cumsum(m)
                common = [len(np.intersect1d(one[e[i] - n[i] : e[i]], two[f[k] - m[k] : f[k]], assume_unique=True)) for i, k in enumerate(hubs.indices.to_numpy())]
                yield pa.RecordBatch.from_arrays([part.column("a"), part.column("b"), pa.array(common, pa.int64()), pa.array(n + m[hubs.indices.to_numpy()] - np.array(common, np.int64), pa.int64())], names=["a", "b", "both", "either"])
        give_back()

    with_a = pairs.join(texts.select(F.col("id").alias("a"), F.col("text").alias("a_text")), "a")
    with_b = with_a.join(texts.select(F.col("id").alias("b"), F.col("text").alias("b_text")), "b")
    return with_b.select("a", "b", "a_text", "b_text").mapInArrow(run, "a long, b long, both long, either long")


def components(links: DataFrame) -> DataFrame:
    """id, component (smallest id reachable) of the ids in links (a, b), by alternating large and small stars."""
    edges = written(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    before = None
    while True:
        now = edges.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x"), F.sum(F.hash("v", "u").cast("long")).alias("s")).first()
        if now == before:
            return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
        before = now
        # large star: of each node, the larger neighbours go to the smallest of the neighbourhood
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: of each node, its smaller neighbours and itself go to the smallest of them
        down = large.where("u <> v")
        low = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(low, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        edges = written(small, "stars")


def near_duplicates(docs: DataFrame, width: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text", hub_rounds: int = 2) -> DataFrame:
    """id, n_shingles, component_id, kept for each row. Linked: den * intersection >= num * union."""
    sketch = written(sketches(docs, width, id_col, text_col), "sketches")
    full = sketch.where("n_shingles > 0 and id is not null")
    sets = written(full.groupBy("f1", "f2").agg(F.min("id").alias("rep"), *(F.first(c).alias(c) for c in ("n_shingles", "bands", "sig"))), "sets")
    texts = docs.select(F.col(id_col).cast("long").alias("id"), text_or_empty(text_col).alias("text"))
    copies = full.join(sets.select("f1", "f2", "rep"), ["f1", "f2"]).where("id <> rep").select(F.col("id").alias("a"), F.col("rep").alias("b"))

    buckets = written(in_company(sets), "buckets")
    open_, tested, links = buckets, None, None

    def test(pairs: DataFrame, what: str) -> None:
        """Adds to the tested pairs (a < b) and to the links."""
        nonlocal tested, links
        new = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        if tested is not None:
            new = new.join(tested.select("a", "b"), ["a", "b"], "left_anti")
        new = written(verified(not_ruled_out(new, sets, num, den), texts, width), what)
        tested = new if tested is None else tested.unionByName(new)
        links = tested.where(f"{den} * both >= {num} * either").select("a", "b")

    for turn in range(hub_rounds):
        met = open_.join(hubs(open_), "key").where("rep <> hub")
        test(met.select(F.col("rep").alias("a"), F.col("hub").alias("b")), "tested")
        if turn + 1 < hub_rounds:
            either = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
            open_ = written(met.join(either, (met["rep"] == either["a"]) & (met["hub"] == either["b"]), "left_anti").select("rep", "key", "n", "company"), "open")
    apart = written(unsettled(buckets, components(links)), "apart")
    test(by_prefix(apart, texts, width, num, den), "tested")
    of = components(links.unionByName(copies))
    out = sketch.join(of, "id", "left").select(F.col("id").alias(id_col), "n_shingles", F.coalesce("component", "id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col(id_col) == F.col("component_id"), F.lit(True)))


def in_company(sets: DataFrame) -> DataFrame:
    """rep, key, n (members of the bucket), company (of the rep, summed over its buckets), of buckets with several members."""
    rows = sets.select("rep", F.explode("bands").alias("key")).distinct()
    shared = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    rows = rows.join(shared, "key")
    return rows.join(rows.groupBy("rep").agg(F.sum("n").alias("company")), "rep").select("rep", "key", "n", "company")


def hubs(rows: DataFrame) -> DataFrame:
    """key, hub: of each bucket the member with most company."""
    return rows.groupBy("key").agg(F.max(F.struct("company", (-F.col("rep")).alias("less"))).alias("m")).select("key", (-F.col("m.less")).alias("hub"))


def not_ruled_out(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs (a, b) that the sizes of their sets and their signatures leave open."""
    about = lambda x: sets.select(F.col("rep").alias(x), F.col("n_shingles").alias(f"n{x}"), F.col("sig").alias(f"s{x}"))
    fits = (den * F.least("na", "nb") >= num * F.greatest("na", "nb")) & (agreement(F.col("sa"), F.col("sb")) >= int((num / den - 0.16) * COORDINATES))
    return pairs.join(about("a"), "a").join(about("b"), "b").where(fits).select("a", "b").distinct()


def unsettled(buckets: DataFrame, of: DataFrame) -> DataFrame:
    """rep, component of the members of buckets of three and more that span several components (of two: the hub met the other)."""
    named = buckets.where("n > 2").join(of.select(F.col("id").alias("rep"), "component"), "rep", "left").select("key", "rep", F.coalesce("component", "rep").alias("component"))
    several = named.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("key")
    return named.join(several, "key").select("rep", "component").distinct()


def agreement(a, b):
    """How many bytes of two arrays of longs are equal."""

    def equal(x, y):
        d = x.bitwiseXOR(y)
        for shift in (4, 2, 1):  # each byte's bits are gathered in its lowest
            d = d.bitwiseOR(F.shiftrightunsigned(d, shift)).bitwiseAND(F.lit(0x0101010101010101 * (2**shift - 1)))
        return 8 - F.bit_count(d)

    return F.aggregate(F.zip_with(a, b, equal), F.lit(0), lambda s, x: s + x)


def by_prefix(apart: DataFrame, texts: DataFrame, width: int, num: int, den: int) -> DataFrame:
    """Pairs (a, b) of different components, linked ones among them all. apart: rep, component."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 1000):
                part = b.slice(at, 1000)
                h, size = shingle_sets(part, width)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size)]).astype(np.int32)), pa.array(h.view(np.int64)))], names=["rep", "component", "hs"])
        give_back()

    sets = apart.join(texts.withColumnRenamed("id", "rep"), "rep").select("rep", "component", "text").mapInArrow(run, "rep long, component long, hs array<long>")
    sets = written(sets.withColumn("print", F.xxhash64("hs")), "shingles")  # a rep whose id is repeated has several
    each = sets.select("rep", "component", "print", F.explode("hs").alias("h"))
    held = each.groupBy("h").agg(F.count(F.lit(1)).alias("held"))
    ordered = each.join(held, "h").groupBy("rep", "component", "print").agg(F.sort_array(F.collect_set(F.struct("held", "h"))).alias("t"))
    sized = ordered.withColumn("n", F.size("t").cast("long"))
    prefix = sized.select("rep", "component", "n", F.posexplode(F.slice("t", 1, (F.col("n") - F.ceil(F.col("n") * num / den) + 1).cast("int"))).alias("at", "s"))
    rows = written(prefix.where("s.held > 1").select("rep", "component", "n", "at", F.col("s.h").alias("h")), "prefixes")
    # of a shingle's members those of its largest component are met by the others only
    main = rows.groupBy("h", "component").count().groupBy("h").agg(F.max(F.struct("count", "component")).alias("m")).select("h", F.col("m.component").alias("main"))
    few = rows.join(main, "h").where("component <> main").select("h", F.col("rep").alias("a"), F.col("component").alias("ca"), F.col("n").alias("na"), F.col("at").alias("pa"))
    all_ = rows.select(F.col("h").alias("g"), F.col("rep").alias("b"), F.col("component").alias("cb"), F.col("n").alias("nb"), F.col("at").alias("pb"))
    fits = (F.col("ca") != F.col("cb")) & (den * F.least("na", "nb") >= num * F.greatest("na", "nb")) & ((num + den) * F.least(F.col("na") - F.col("pa"), F.col("nb") - F.col("pb")) >= num * (F.col("na") + F.col("nb")))
    return few.join(all_, (F.col("h") == F.col("g")) & fits).select("a", "b")
