"""Divergence of sources within a language: a baseline for pairs of sources, corrected by an inverted index of terms.

A source's smoothed share of a term is p = 1 + floor(10^9 (count + 2) / (N + 2 V)), and two sources differ by the sum of
f = floor((p - q)^2 / (p + q)) over the V terms of the language. A pair starts at V times the f of two zero counts. What a term
adds to that is in three parts: counts of one source against a zero of the other, for either, which depend on the count alone, so
each source keeps how many of its terms have each share (``shares``); and, for terms of both, what is left. The latter come from
postings: the terms' lists of sources are walked in tasks, and only sums of nonzero corrections leave a task.

Terms are counted in tasks before anything is shuffled, so a source that holds most of the documents costs one row a term and
task. Postings are dealt by term. Ten terms a source are kept by a window whose limit holds before the shuffle as well.
All numbers are whole; products beyond 63 bits are decimals.

Null text, lang and source are ''. Repeated rows count as often as they come. A source without terms is a group of zero counts;
if a language keeps no term, all its values are 0. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import give_back, written

#: What separates terms: ASCII other than letters.
BETWEEN = r"[\x00-\x40\x5B-\x60\x7B-\x7F]+"
SCALE = 1_000_000_000
COUNTED = "lang string, source string, term string, n long, docs long"
ARROW = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("docs", pa.int64())])


def counted(batch: pa.RecordBatch) -> pa.Table:
    """Of lang, source and text: a row (lang, source, term, n, docs) for each group and term, and one without a term a group."""
    langs, sources = (batch.column(k).cast(pa.string()).dictionary_encode() for k in (0, 1))
    group, of_row = np.unique(langs.indices.to_numpy().astype(np.int64) * len(sources.dictionary) + sources.indices.to_numpy(), return_inverse=True)
    text = batch.column(2).take(pa.array(np.arange(batch.num_rows))).cast(pa.large_string())  # the kernels below misread slices
    parts = pc.split_pattern_regex(pc.ascii_lower(text), BETWEEN)
    flat = parts.flatten()
    some = pc.not_equal(pc.binary_length(flat), 0)
    row = np.repeat(np.arange(batch.num_rows), np.diff(parts.offsets.to_numpy()))[some.to_numpy(zero_copy_only=False)]
    words = flat.filter(some).dictionary_encode()
    many = max(1, len(words.dictionary))
    in_row, times = np.unique(row * many + words.indices.to_numpy(), return_counts=True)
    key, at, docs = np.unique(of_row[in_row // many] * many + in_row % many, return_inverse=True, return_counts=True)
    n = np.zeros(len(key), np.int64)
    np.add.at(n, at, times)
    of = np.concatenate([key // many, np.arange(len(group))])
    term = pa.concat_arrays([words.dictionary.cast(pa.string()).take(pa.array(key % many)), pa.nulls(len(group), pa.string())])
    zero = np.zeros(len(group), np.int64)
    lang, source = langs.dictionary.take(pa.array(group[of] // len(sources.dictionary))), sources.dictionary.take(pa.array(group[of] % len(sources.dictionary)))
    return pa.table([lang, source, term, np.concatenate([n, zero]), np.concatenate([docs, zero])], schema=ARROW)


def count_terms(batches: Iterator[pa.RecordBatch], most: int = 500_000) -> Iterator[pa.RecordBatch]:
    """What ``counted`` makes, merged as long as it has at most ``most`` rows."""
    held: list[pa.Table] = []

    def merged() -> pa.Table:
        t = pa.concat_tables(held).group_by(["lang", "source", "term"]).aggregate([("n", "sum"), ("docs", "sum")])
        return pa.table([t["lang"], t["source"], t["term"], t["n_sum"], t["docs_sum"]], schema=ARROW)

    for b in batches:
        for at in range(0, b.num_rows, 2000):
            held.append(counted(b.slice(at, 2000)))
            if sum(t.num_rows for t in held) > most:
                held = [merged()]
                if held[0].num_rows > most // 2:
                    yield from held[0].combine_chunks().to_batches()
                    held = []
    if held:
        yield from merged().combine_chunks().to_batches()
    held = []
    give_back()


def share(n: Column, total: Column, v: Column) -> Column:
    """1 + floor(10^9 (n + 2) / (total + 2 v))."""
    wide = lambda c: c.cast("decimal(20,0)")
    return F.lit(1).cast("long") + F.call_function("div", wide(n + 2) * F.lit(SCALE).cast("decimal(10,0)"), wide(total + 2 * v))


def apart(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), p + q)


def apart_np(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // (p + q)


PAIRED = "lang string, source string, item string, c long"


def corrections(batches: Iterator[pa.RecordBatch], most: int = 1_000_000) -> Iterator[pa.RecordBatch]:
    """Of postings (lang, term, source, p, p0) in that order: sums (lang, source, item, c) of what terms of both sources add to
    that of each against zero, for pairs in order of source."""

    def summed(t: pa.Table) -> pa.Table:
        return t.group_by(["lang", "source", "item"]).aggregate([("c", "sum")]).rename_columns(["lang", "source", "item", "c"])

    def walk(t: pa.Table) -> Iterator[pa.Table]:
        cut = lambda c: t[c].combine_chunks().dictionary_encode()
        lang, term, source = cut("lang"), cut("term"), cut("source")
        p, p0 = t["p"].to_numpy(), t["p0"].to_numpy()
        s, many = source.indices.to_numpy().astype(np.int64), len(source.dictionary)
        posting = lang.indices.to_numpy().astype(np.int64) * len(term.dictionary) + term.indices.to_numpy()
        left, step, keys, values = np.arange(len(p)), 1, [], []

        def drained() -> pa.Table:
            key, at = np.unique(np.concatenate(keys), return_inverse=True)
            c = np.zeros(len(key), np.int64)
            np.add.at(c, at, np.concatenate(values))
            of = lambda d, k: d.dictionary.take(pa.array(k))
            return pa.table({"lang": of(lang, key // many // many), "source": of(source, key // many % many), "item": of(source, key % many), "c": c})

        while True:  # each posting's places with those ``step`` further on
            left = left[left + step < len(p)]
            left = left[posting[left] == posting[left + step]]
            if not len(left):
                break
            for part in np.array_split(left, -(-len(left) // most)):
                a, b = part, part + step
                c = apart_np(p[a], p[b]) - apart_np(p[a], p0[b]) - apart_np(p0[a], p[b]) + apart_np(p0[a], p0[b])
                some = c != 0
                keys.append(((lang.indices.to_numpy().astype(np.int64)[a] * many + s[a]) * many + s[b])[some])
                values.append(c[some])
                if sum(map(len, keys)) > most:
                    yield drained()
                    keys, values = [], []
            step += 1
        if keys:
            yield drained()

    def postings() -> Iterator[pa.Table]:
        """Whole postings, 200,000 rows or more at a time."""
        held, size = [], 0
        for b in batches:
            held.append(b)
            size += b.num_rows
            if size < 200_000:
                continue
            t = pa.Table.from_batches(held)
            other = pc.or_(pc.not_equal(t["term"], t["term"][size - 1]), pc.not_equal(t["lang"], t["lang"][size - 1])).to_numpy()
            whole = int(np.flatnonzero(other)[-1]) + 1 if other.any() else 0  # where the last posting begins
            if whole:
                yield t.slice(0, whole)
            held, size = t.slice(whole).to_batches(), size - whole
        if held:
            yield pa.Table.from_batches(held)

    out: list[pa.Table] = []
    for t in postings():
        for more in walk(t):
            out.append(more)
            if sum(o.num_rows for o in out) > most:
                yield from summed(pa.concat_tables(out)).combine_chunks().to_batches()
                out = []
    if out:
        yield from summed(pa.concat_tables(out)).combine_chunks().to_batches()
    out = []
    give_back()


def audit(docs: DataFrame, min_docs: int = 10, top_terms: int = 10, lang_col: str = "lang", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """lang, source, part, item, value, rank. Part ``pair``: the divergence from each other source of the language. Part ``term``:
    the terms of which the source has more than its language, by their f, ``top_terms`` at most. Terms: runs of letters and of
    characters beyond ASCII, A-Z lower-cased, that at least ``min_docs`` documents of the language hold."""
    given = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(k) for c, k in ((lang_col, "lang"), (source_col, "source"), (text_col, "text"))])
    counts = given.mapInArrow(count_terms, COUNTED).repartition("lang", "term").groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    posting = Window.partitionBy("lang", "term")
    spread = counts.withColumns({"docs": F.sum("docs").over(posting), "total": F.sum("n").over(posting), "first": F.min("source").over(posting) == F.col("source")})
    terms = written(spread.where(F.col("term").isNull() | (F.col("docs") >= min_docs)).drop("docs"), "terms")

    langs = terms.groupBy("lang").agg(F.sum("n").alias("in_lang"), F.sum((F.col("first") & F.col("term").isNotNull()).cast("long")).alias("v"))
    groups = terms.groupBy("lang", "source").agg(F.sum("n").alias("in_source")).join(langs, "lang")
    zero = F.lit(0).cast("long")
    groups = written(groups.withColumn("p0", F.when(F.col("v") > 0, share(zero, F.col("in_source"), F.col("v")))), "groups")
    held = terms.where("term IS NOT NULL").join(groups, ["lang", "source"]).withColumn("p", share(F.col("n"), F.col("in_source"), F.col("v")))

    shares = held.groupBy("lang", "source", "p").agg(F.count(F.lit(1)).alias("m")).groupBy("lang", "source").agg(F.collect_list(F.struct("p", "m")).alias("shares"))
    sides = groups.join(shares, ["lang", "source"], "left").select("lang", "source", "v", "p0", "shares")
    other = sides.select("lang", F.col("source").alias("item"), F.col("p0").alias("q0"), F.col("shares").alias("others"))
    against = lambda c, own, zero_: F.coalesce(F.aggregate(c, zero, lambda s, x: s + x["m"] * (apart(x["p"], zero_) - apart(own, zero_))), zero)
    both = held.select("lang", "term", "source", "p", "p0").repartition("lang", "term").sortWithinPartitions("lang", "term", "source").mapInArrow(corrections, PAIRED)
    both = both.groupBy("lang", "source", "item").agg(F.sum("c").alias("c"))
    once = sides.join(other, "lang").where("source < item").join(both, ["lang", "source", "item"], "left")
    value = F.col("v") * apart(F.col("p0"), F.col("q0")) + against("shares", F.col("p0"), F.col("q0")) + against("others", F.col("q0"), F.col("p0")) + F.coalesce("c", zero)
    once = once.select("lang", "source", "item", F.coalesce(F.when(F.col("v") > 0, value), zero).alias("value"))
    pairs = once.select("lang", "value", F.explode(F.array(F.struct("source", "item"), F.struct(F.col("item").alias("source"), F.col("source").alias("item")))).alias("s")).select("lang", "s.source", "s.item", "value")

    place = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), F.asc("item")))
    q = share(F.col("total"), F.col("in_lang"), F.col("v"))
    more = held.where("n > 0").withColumn("q", q).where("p > q").select("lang", "source", F.col("term").alias("item"), apart(F.col("p"), F.col("q")).alias("value"))
    named = lambda df, part: df.withColumn("rank", place).select("lang", "source", F.lit(part).alias("part"), "item", "value", "rank")
    return named(pairs, "pair").unionByName(named(more, "term").where(F.col("rank") <= top_terms))
