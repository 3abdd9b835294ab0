"""Benchmark decontamination: which documents hold a passage of a benchmark item. DataFrame functions only.

1. A window of a document can only resemble an item if they share a shingle, so windows are laid where a document has a
   shingle of some item: as long as the item, aligned on the shared shingle. A pass takes items of at most
   ``block_shingles`` shingles together (or one item, if it has more); a larger benchmark takes more passes.
2. Windows and items get fingerprints: their shingles are dealt into blocks by hash, and each block is the 64-bit SimHash of
   its shingles. The Hamming distance of two fingerprints is the number of blocks in which they differ. Each shingle that only
   one of them has touches one block, so at similarity t a window is within the radius r = 2n(1 - t) / (1 + t) of an item
   of n shingles. There are r + ``spare`` blocks: within the radius at least ``spare`` blocks are equal, and a join on
   (length, block, value) finds every window within the radius, but for blocks without a shingle, which are no keys (all
   equal blocks are empty with a probability of about 6e-7 at nine shingles and less for longer items; of about 7e-5 where
   the end of a text lacks one of an item's five). Values have 64 bits, so the join meets little else.
3. Those within the radius are verified: weighted Jaccard similarity of the shingles, the weight of a shingle being how
   often it occurs, at least ``threshold``.

Texts are lower-cased; words lie between ASCII white space. An item of fewer words than the width is one shingle of all its
words. Null and empty texts and items match nothing. Repeated rows of a document or item count once; extra columns are
ignored. What is broadcast has at most ``block_shingles`` rows of numbers (or those of one item, if it is longer).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPLIT_SQL, text_or_empty, written


def words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), SPLIT_SQL), lambda w: w != "")


def shingle(w: Column, at: Column, width: int) -> Column:
    """The hash of the words from a place (from 0)."""
    return F.xxhash64(*[F.get(w, at + k) for k in range(width)])


def shingles(w: Column, width: int) -> Column:
    return F.when(F.size(w) >= width, F.transform(F.sequence(F.lit(0), F.greatest(F.size(w) - width, F.lit(0))), lambda i: shingle(w, i, width))).otherwise(F.array().cast("array<bigint>"))


def simhash(s: Column) -> Column:
    """Each bit as most shingles have it; null without shingles."""
    one = F.lit(1).cast("long")
    ones = lambda b: F.aggregate(s, F.lit(0), lambda a, x: a + (F.call_function("shiftright", x, b).bitwiseAND(one)).cast("int"))
    bits = F.aggregate(F.sequence(F.lit(0), F.lit(63)), F.lit(0).cast("long"), lambda a, b: a.bitwiseOR(F.when(ones(b) * 2 > F.size(s), F.call_function("shiftleft", one, b)).otherwise(F.lit(0).cast("long"))))
    return F.when(F.size(s) == 1, s[0]).when(F.size(s) > 1, bits)


def radius(n_shingles: Column, threshold: float) -> Column:
    """How many blocks can differ at this similarity to an item of so many shingles."""
    return F.floor(n_shingles * (2 * (1 - threshold) / (1 + threshold)) + 1e-9).cast("int")


def fingerprint(s: Column, blocks: Column) -> Column:
    return F.transform(F.sequence(F.lit(0), blocks - 1), lambda j: simhash(F.filter(s, lambda h: F.pmod(h, blocks) == j)))


def similarity(a: Column, b: Column) -> Column:
    """Weighted Jaccard of two arrays of shingles, by number of occurrences."""
    many = lambda s, x: F.size(F.filter(s, lambda y: y == x))
    both = F.aggregate(F.array_distinct(a), F.lit(0), lambda acc, x: acc + F.least(many(a, x), many(b, x)))
    return both / (F.size(a) + F.size(b) - both)


def contaminated(docs: DataFrame, benchmark: DataFrame, width: int = 5, threshold: float = 0.8, spare: int = 10, block_shingles: int = 200_000, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """id, item, similarity (the best window's), start_word, n_words of each document and item that match."""
    items = benchmark.select(F.col(item_col).alias("item"), words(text_or_empty(item_text_col)).alias("w")).where(F.size("w") > 0).distinct()
    items = items.withColumn("n", F.size("w")).withColumn("k", F.least(F.col("n"), F.lit(width)))
    spark, found = docs.sparkSession, []
    for k in sorted(r.k for r in items.select("k").distinct().collect()):
        own = items.where(F.col("k") == k).select("item", "n", shingles(F.col("w"), k).alias("t"))
        found += [matches(docs, some, k, threshold, spare, id_col, text_col) for some in passes(own, block_shingles)]
    if not found:
        return spark.createDataFrame([], f"{id_col} {dict(docs.dtypes)[id_col]}, {item_col} {dict(benchmark.dtypes)[item_col]}, similarity double, start_word int, n_words int")
    every = found[0]
    for f in found[1:]:
        every = every.unionByName(f)
    best = every.groupBy("id", "item").agg(F.max(F.struct("similarity", (-F.col("start")).alias("less"), "n")).alias("m"))
    return best.select(F.col("id").alias(id_col), F.col("item").alias(item_col), "m.similarity", (-F.col("m.less")).alias("start_word"), F.col("m.n").alias("n_words"))


def passes(items: DataFrame, most: int) -> list[DataFrame]:
    """items (item, n, t) in parts of at most ``most`` shingles, or of one item that has more: runs of neighbouring ranges of a hash.
    Ranges that hold too much are halved twice in each round, so the driver sees a few sums for each pass."""
    total = int(items.agg(F.sum(F.size("t"))).first()[0] or 0)
    if total <= most:
        return [items]
    hashed, h = items.withColumn("hash", F.xxhash64("item", "t")), F.col("hash")
    bits, open_, fit = min(60, (-(-total // most)).bit_length() + 2), None, []
    while True:
        at = F.shiftright(h, 64 - bits)
        wide = hashed if open_ is None else hashed.join(F.broadcast(open_), F.shiftright(h, 66 - bits) == F.col("part")).drop("part")
        sums = wide.groupBy(at.alias("part")).agg(F.sum(F.size("t")).alias("shingles"), F.count(F.lit(1)).alias("items")).collect()
        apart = [r for r in sums if r.shingles > most and r["items"] > 1 and bits < 64]
        halved = {r.part for r in apart}
        fit += [(r.part << (64 - bits), ((r.part + 1) << (64 - bits)) - 1, r.shingles) for r in sums if r.part not in halved]
        if not apart:
            break
        open_ = items.sparkSession.createDataFrame([(r.part,) for r in apart], "part long")  # fewer than there are passes
        bits += 2
    runs: list[list[int]] = []
    for first, last, shingles_ in sorted(fit):
        if runs and runs[-1][2] + shingles_ <= most:
            runs[-1][1:] = [last, runs[-1][2] + shingles_]
        else:
            runs.append([first, last, shingles_])
    return [hashed.where(h.between(first, last)).drop("hash") for first, last, _ in runs]


def matches(docs: DataFrame, items: DataFrame, k: int, threshold: float, spare: int, id_col: str, text_col: str) -> DataFrame:
    """Of the items of one pass: id, item, start, n, similarity."""
    blocks = radius(F.size("s"), threshold) + spare
    items = written(items.select("item", "n", F.col("t").alias("s")).withColumn("m", blocks).withColumn("fp", fingerprint(F.col("s"), F.col("m"))), "items")
    places = items.select("n", F.posexplode("s").alias("offset", "h")).distinct()
    hashes = [r.h for r in places.select("h").distinct().collect()]
    # the generated id keeps the optimizer from computing the words again for every use
    split = docs.select(F.col(id_col).alias("id"), words(text_or_empty(text_col)).alias("w"), F.monotonically_increasing_id().alias("row"))
    met = F.filter(F.sequence(F.lit(0), F.greatest(F.size("w") - k, F.lit(0))), lambda i: shingle(F.col("w"), i, k).isin(hashes))
    hit = split.withColumn("at", F.when(F.size("w") >= k, met).otherwise(F.array().cast("array<int>"))).where(F.size("at") > 0)
    hit = written(hit.select("id", "row", "w", F.transform("at", lambda i: F.struct(i.alias("place"), shingle(F.col("w"), i, k).alias("h"))).alias("at")), "hits")
    aligned = hit.select("row", F.inline("at")).join(F.broadcast(places), "h")
    starts = aligned.select("row", "n", F.greatest(F.col("place") - F.col("offset"), F.lit(0)).alias("start")).distinct()
    cut = starts.join(hit.select("row", "id", "w"), "row").select("row", "id", "n", "start", F.slice("w", F.col("start") + 1, F.col("n")).alias("x"))
    windows = written(cut.select("row", "id", "n", "start", shingles(F.col("x"), k).alias("s")), "windows")
    # the fingerprint has as many blocks as the items of that length
    windows = windows.withColumn("m", radius(F.col("n") - k + 1, threshold) + spare)
    windows = written(windows.withColumn("fp", fingerprint(F.col("s"), F.col("m"))), "fingerprints")
    keys = lambda df, *c: df.select(*c, "n", F.posexplode("fp").alias("block", "value")).where("value is not null")
    near = keys(windows, "row", "start").join(F.broadcast(keys(items, "item")), ["n", "block", "value"]).select("row", "n", "start", "item").distinct()
    pairs = near.join(windows, ["row", "n", "start"]).join(items.select("item", "n", F.col("s").alias("t"), F.col("fp").alias("fq")), ["item", "n"])
    apart = F.size(F.filter(F.zip_with("fp", "fq", lambda a, b: a.eqNullSafe(b)), lambda same: ~same))
    return pairs.where(apart <= F.col("m") - spare).select("id", "item", "start", "n", similarity(F.col("s"), F.col("t")).alias("similarity")).where(F.col("similarity") >= threshold)
