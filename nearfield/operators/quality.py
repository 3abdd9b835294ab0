"""Rank-based quality of embeddings: ranks, co-ranking, rates and curves.

Direction: the first rank is in the high-dimensional space, the second in the embedding. n counts pairs whose
high-dimensional rank is the larger, x the others; B = x - n.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.lineage import written
from .distance import RANKED, beside_all, exactly, roughly, squared

#: Pairs that a task counts at a time.
COUNTED = 2_000_000


def ranks(dist: DataFrame, d: str = "d2", name: str = "k") -> DataFrame:
    """j, i, rank (0: the nearest, in order of distance and id) in each column j."""
    return dist.select("j", "i", (F.row_number().over(Window.partitionBy("j").orderBy(d, "i")) - 1).alias(name))


def places(d: np.ndarray) -> np.ndarray:
    """Of each entry in its row's order."""
    out = np.empty(d.shape, np.int64)
    np.put_along_axis(out, np.argsort(d, axis=1, kind="stable"), np.broadcast_to(np.arange(d.shape[1]), d.shape), axis=1)
    return out


def ordered(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """For each row of x the rows of y in order of squared distance, then of place, as ``squared`` tells it: a product of matrices orders them, and
    only runs whose distances rounding may have mixed up are worked out."""
    d = np.empty((len(x), len(y)))
    slack = 0.0
    for k in range(0, len(y), RANKED):
        part = y[k : k + RANKED].astype(float)
        if x.shape[1] < 8:
            d[:, k : k + RANKED] = squared(x, part)
        else:
            d[:, k : k + RANKED], off = roughly(x, part)
            slack = max(slack, off)
    order = np.argsort(d, axis=1)
    for row, at in enumerate(order):
        there = d[row, at]
        close = np.flatnonzero(~(there[1:] - there[:-1] > 2 * slack))
        if not len(close):
            continue
        if not np.isfinite(there[-1]) or len(close) > len(y) // 4:
            order[row] = np.argsort(squared(x[row : row + 1], y.astype(float))[0], kind="stable")
            continue
        first = np.concatenate([[True], np.diff(close) > 1])
        run = np.cumsum(first) - 1
        begin, end = close[first], close[np.append(first[1:], True)] + 2
        spots = np.repeat(begin - np.concatenate([[0], np.cumsum(end - begin)[:-1]]), end - begin) + np.arange(int((end - begin).sum()))
        run, mixed = np.repeat(np.arange(len(begin)), end - begin), at[spots]
        d2 = exactly(x[row : row + 1], y, np.zeros(len(mixed), np.int64), mixed) if slack else there[spots]
        at[spots] = mixed[np.lexsort((mixed, d2, run))]
    return order


def placed(order: np.ndarray) -> np.ndarray:
    """Of each entry in its row's order."""
    out = np.empty(order.shape, np.int64)
    np.put_along_axis(out, order, np.broadcast_to(np.arange(order.shape[1]), order.shape), axis=1)
    return out


def by_places(points: DataFrame, sources: DataFrame | None, columns: list[str], emit: Callable, spec: str, fold: Callable[[pa.Table, pa.Table], pa.Table] | None = None, cells: int = 2_000_000) -> DataFrame:
    """``beside_all`` with emit(ids of some sources, ids of all points, the places of points in order of distance and id, a matrix a
    column)."""
    return beside_all(points, sources, columns, lambda j, i, own, x: emit(j, i, *(placed(ordered(a, m)) for a, m in zip(own, x, strict=True))), spec, fold, cells)


def ranks_of_points(points: DataFrame, cells: int = 4_000_000) -> DataFrame:
    """j, i, k: what ranks gives of all squared distances of points (id, x), ranked in the task that makes a source's."""

    def emit(j, i, k):
        return pa.table({"j": np.repeat(j, len(i)), "i": np.tile(i, len(j)), "k": k.ravel()})

    return by_places(points, None, ["x"], emit, "j long, i long, k long", cells=cells)


def both_ranks(k: np.ndarray, l: np.ndarray) -> tuple[np.ndarray, np.ndarray]:  # noqa: E741
    """Of places in rows, those of both spaces where neither is 0."""
    k, l = k.ravel(), l.ravel()  # noqa: E741
    some = (k > 0) & (l > 0)
    return k[some], l[some]


def coranking(points: DataFrame, sources: DataFrame | None = None) -> DataFrame:
    """k, l, c of points (id, x, y): pairs by both ranks, rank 0 left out. A source's ranks are made in the task that has its
    distances, and counts leave it packed by runs of k; a rank k has one pair a source, so runs are even. A pair is sent as its place in the run, 4 bytes, and
    how often the batch has it, 1 byte. sources: the landmarks whose ranks count (default: all)."""

    def emit(j, i, k, l):  # noqa: E741
        n = len(i)
        k, l = both_ranks(k, l)  # noqa: E741
        code, c = np.unique(k * n + l, return_counts=True)
        width = n * max(1, min(COUNTED // n, n // 64, (2**32 - 1) // n))
        runs = np.split(np.arange(len(code)), np.flatnonzero(np.diff(code // width)) + 1)
        runs = [r for r in runs if len(r)]
        small = np.uint8 if c.max(initial=0) < 256 else np.int64
        packs = {"run": [int(code[r[0]] // width) for r in runs], "n": [n] * len(runs), "from": [int(code[r[0]] // width * width) for r in runs], "code": [(code[r] % width).astype(np.uint32).tobytes() for r in runs], "c": [c[r].astype(small).tobytes() for r in runs]}
        return pa.table(packs, schema=pa.schema([("run", pa.int64()), ("n", pa.int64()), ("from", pa.int64()), ("code", pa.binary()), ("c", pa.binary())]))

    def count(key: tuple, t: pa.Table) -> pa.Table:
        code = [np.frombuffer(x.as_buffer(), np.uint32) for x in t["code"]]
        c = [np.frombuffer(x.as_buffer(), np.uint8 if len(x.as_buffer()) == len(a) else np.int64) for x, a in zip(t["c"], code, strict=True)]
        code, at = np.unique(np.concatenate(code), return_inverse=True)
        n, total = t["n"][0].as_py(), np.zeros(len(code), np.int64)
        np.add.at(total, at, np.concatenate(c).astype(np.int64))
        code = code.astype(np.int64) + t["from"][0].as_py()
        return pa.table({"k": code // n, "l": code % n, "c": total})

    parts = by_places(points, sources, ["x", "y"], emit, "run long, n long, from long, code binary, c binary")
    return parts.groupBy("run").applyInArrow(count, "k long, l long, c long")


def added(one: pa.Table, other: pa.Table) -> pa.Table:
    """Of tables with the same keys in the same order, the counts (n, x, p or c) added up."""
    return pa.table({c: pa.array(one[c].to_numpy() + other[c].to_numpy()) if c in ("n", "x", "p", "c") else one[c] for c in one.column_names})


def rank_sums(points: DataFrame, sources: DataFrame | None = None) -> DataFrame:
    """K, n, x, p: how many pairs have K as the larger of their ranks, by which of them it is (neither: p). What curves need of
    the co-ranking matrix, with one row a K and task in place of its entries."""
    return rank_sums_of(points, ["y"], sources).select("K", "n", "x", "p")


def rank_sums_of(points: DataFrame, columns: list[str], sources: DataFrame | None = None) -> DataFrame:
    """run, K, n, x, p: the same of several embeddings (columns; run: from 0), against ranks in x that are made once."""

    def emit(j, i, k, *others):
        width, out = max(1, len(i)), []
        for run, one in enumerate(others):
            a, b = both_ranks(k, one)
            top = np.maximum(a, b)
            at = lambda mask: np.bincount(top[mask], minlength=width)[1:]  # noqa: B023, E731
            out.append(pa.table({"run": np.full(width - 1, run), "K": np.arange(1, width), "n": at(a > b), "x": at(b > a), "p": at(a == b)}))
        return pa.concat_tables(out)

    parts = by_places(points, sources, ["x", *columns], emit, "run long, K long, n long, x long, p long", added, 4_000_000 // (1 + len(columns)))
    return parts.groupBy("run", "K").agg(*(F.sum(c).alias(c) for c in "nxp"))


def column_sums(points: DataFrame) -> DataFrame:
    """l, s: the column sums of the co-ranking matrix, without its entries."""

    def emit(j, i, k, l):  # noqa: E741, ARG001
        return pa.table({"l": np.arange(1, max(1, len(i))), "c": np.bincount(both_ranks(k, l)[1], minlength=max(1, len(i)))[1:]})

    parts = by_places(points, None, ["x", "y"], emit, "l long, c long", added)
    return parts.groupBy("l").agg(F.sum("c").alias("s")).where("s > 0")


def per_rank(corank: DataFrame) -> DataFrame:
    """The same of a co-ranking matrix."""
    when = lambda c: F.sum(F.when(c, F.col("c")).otherwise(0))
    return corank.groupBy(F.greatest("k", "l").cast("long").alias("K")).agg(when(F.col("k") > F.col("l")).alias("n"), when(F.col("l") > F.col("k")).alias("x"), when(F.col("l") == F.col("k")).alias("p"))


def coranking_check(corank: DataFrame, columns: int) -> DataFrame:
    """total, the least and largest column sum, valid: all column sums equal the number of sources. corank: the matrix or its column_sums."""
    sums = corank if "s" in corank.columns else corank.groupBy("l").agg(F.sum("c").alias("s"))
    return sums.agg(F.sum("s").alias("total"), F.min("s").alias("least"), F.max("s").alias("largest")).withColumn("valid", (F.col("least") == F.col("largest")) & (F.col("largest") <= columns))


def trusion_counts(counts: DataFrame, n: int) -> DataFrame:
    """K (1 .. n - 1) and the running counts n_count, x_count, p_count, of a co-ranking matrix or of rank_sums."""
    spine = counts.sparkSession.range(1, n).withColumnRenamed("id", "K")
    run = Window.orderBy("K").rowsBetween(Window.unboundedPreceding, 0)  # one row for each K, not for each pair
    full = spine.join(counts if "K" in counts.columns else per_rank(counts), "K", "left").fillna(0)
    return full.select("K", *[F.sum(c).over(run).alias(f"{c}_count") for c in ("n", "x", "p")])


def rates(counts: DataFrame, n: int, m: int | None = None) -> DataFrame:
    """K, n, x, p, b: counts over m * K (m sources, default n), and b = K / (n - 1)."""
    m = m or n
    c = trusion_counts(counts, n)
    return c.select("K", *[(F.col(f"{k}_count") / (F.col("K") * m)).alias(k) for k in ("n", "x", "p")], (F.col("K") / (n - 1)).alias("b"))


def curves(rate: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """by, K, q, bb, lcmc, r (null at the last K)."""
    q = rate.select(*by, "K", (F.col("n") + F.col("x") + F.col("p")).alias("q"), (F.col("x") - F.col("n")).alias("bb"), "b")
    q = q.withColumn("lcmc", F.col("q") - F.col("b"))
    return q.select(*by, "K", "q", "bb", "lcmc", F.when(F.col("b") < 1, F.col("lcmc") / (1 - F.col("b"))).alias("r"))


def summary(curve: DataFrame, by: list[str]) -> DataFrame:
    """by, q_auc, b_auc, r_auc (weights 1 / K) and k_avg = sum K r / sum r."""
    auc = lambda c: F.sum(F.col(c) / F.col("K")) / F.sum(F.when(F.col(c).isNotNull(), 1 / F.col("K")))
    return curve.groupBy(*by).agg(auc("q").alias("q_auc"), auc("bb").alias("b_auc"), auc("r").alias("r_auc"), (F.sum(F.col("K") * F.col("r")) / F.sum("r")).alias("k_avg"))


def over_samples(curve: DataFrame, column: str = "r") -> DataFrame:
    """view, method, K, mean, least, largest over samples."""
    return curve.groupBy("view", "method", "K").agg(F.avg(column).alias("mean"), F.min(column).alias("least"), F.max(column).alias("largest"))


def over_views(samples: DataFrame) -> DataFrame:
    return samples.groupBy("method", "K").agg(*[F.avg(c).alias(c) for c in ("mean", "least", "largest")])


PERCENTS = (5, 10, 25, 50, 75, 90, 95, 100)


def percentiles(values: DataFrame, column: str, by: list[str], percents: tuple[int, ...] = PERCENTS) -> DataFrame:
    """by, percent, value: plotting positions (i - 1/2) / n, linear between them, the ends held."""
    w = Window.partitionBy(*by)
    s = values.where(F.col(column).isNotNull()).select(*by, F.col(column).alias("v"))
    s = s.withColumn("i", F.row_number().over(w.orderBy("v"))).withColumn("n", F.count(F.lit(1)).over(w))
    asked = s.withColumn("percent", F.explode(F.array(*map(F.lit, percents))))
    t = asked.withColumn("at", F.least(F.greatest(F.col("percent") * F.col("n") / 100 + 0.5, F.lit(1.0)), F.col("n").cast("double")))
    near = t.where(F.abs(F.col("i") - F.col("at")) < 1)
    return near.groupBy(*by, "percent").agg(F.sum(F.col("v") * (1 - F.abs(F.col("i") - F.col("at")))).alias("value"))


def stars(curve: DataFrame) -> DataFrame:
    """method, average_rank, stars of curves (method, K, r): at each K methods are ranked (1: worst), weights 1 / K."""
    r = curve.where(F.col("r").isNotNull())
    methods = r.select("method").distinct().count()
    placed = r.withColumn("tr", F.row_number().over(Window.partitionBy("K").orderBy("r", "method")))
    w = F.sum(1 / F.col("K"))
    return placed.groupBy("method").agg(
        (F.sum((methods + 1 - F.col("tr")) / F.col("K")) / w).alias("average_rank"),
        (F.sum((F.col("tr") - 1) * F.lit(5.0 / max(1, methods - 1)) / F.col("K")) / w).alias("stars"),
    )


#: Above so many points, as many landmarks stand for all of them.
LANDMARKS = 6144


def scores(views: DataFrame, embeddings: DataFrame, most: int = LANDMARKS, seed: int = 0) -> DataFrame:
    """view, method, sample, K, q, bb, lcmc, r of every embedding (method, sample, id, y) against every view (view, id, x). All
    points are sources up to ``most``; of more, as many with the least hash of the id. Views, methods and samples are few: a
    view's distances are made once, and every embedding's ranks are held against them in the same tasks. Only points that all
    embeddings have count."""
    runs = sorted((r.method, r["sample"]) for r in embeddings.select("method", "sample").distinct().collect())
    names = [f"y{k}" for k in range(len(runs))]
    own = [F.max(F.when((F.col("method") == m) & (F.col("sample") == s), F.col("y"))).alias(c) for (m, s), c in zip(runs, names, strict=True)]
    wide = embeddings.groupBy("id").agg(*own)
    for c in names:
        wide = wide.where(F.col(c).isNotNull())
    out = None
    for view in sorted(r.view for r in views.select("view").distinct().collect()):
        both = written(views.where(F.col("view") == view).select("id", "x").join(wide, "id"), "scored")
        n = both.count()
        some = both if n <= most else both.orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(most)

        counted = rank_sums_of(both, names, None if n <= most else some)
        upto = Window.partitionBy("run").orderBy("K").rowsBetween(Window.unboundedPreceding, 0)  # a row for each K, not for each pair
        rate = counted.select("run", "K", *[(F.sum(c).over(upto) / (F.col("K") * min(n, most))).alias(c) for c in "nxp"], (F.col("K") / max(1, n - 1)).alias("b"))
        named = embeddings.sparkSession.createDataFrame([(k, *r) for k, r in enumerate(runs)], f"run long, method string, sample {dict(embeddings.dtypes)['sample']}")
        curve = curves(rate, ("run",)).join(F.broadcast(named), "run").select(F.lit(view).alias("view"), "method", "sample", "K", "q", "bb", "lcmc", "r")
        out = curve if out is None else out.unionByName(curve)
    return out
