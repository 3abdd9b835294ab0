"""k-means with annulus search, in whole numbers.

Vectors become whole numbers floor(scale * x). A round sorts the centroids by norm. The distance from a vector to the centroid
whose norm is nearest to its own is an upper bound u for its nearest centroid, which by the triangle inequality has a norm within
u of the vector's. A binary search over the sorted norms finds those candidates (a margin covers the rounding of the roots, so
ties on the boundary are among them), and they are compared by exact squared distances, nearest norms first; the bound shrinks
as nearer ones are found. Of equal distances the centroid with the smaller number wins.

A round is one pass over the table: a task keeps sums for its centroids, sums are merged by centroid, and k rows of sums come
back to the driver. Nothing about single vectors is kept between rounds, so a lost task is made again from its input.

Vectors take part if they have ``dims`` components, none null or non-finite. Repeated rows and ids count as often as they come. A
null id takes part as an empty text in the hash. With fewer vectors than centroids there are as many centroids as vectors; with
none the result is empty. Components so large that sums or squares could pass 63 bits are worked with as Python's whole numbers; what
then doesn't fit the result's columns is given as the largest long.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import give_back

#: Below it, sums of squared differences of 2^8 components fit 63 bits.
SMALL = 2**26
LARGEST = 2**63 - 1
ROWS = 8192


def whole(x: np.ndarray, scale: float) -> np.ndarray:
    """floor(scale * x), exactly; scale is a power of two."""
    with np.errstate(over="ignore"):
        y = np.floor(x * scale)
    if not x.size or np.abs(y).max() < SMALL:
        return y.astype(np.int64)
    flat = [int(v) if np.isfinite(v) else int(u) * int(scale) for u, v in zip(x.ravel().tolist(), y.ravel().tolist(), strict=True)]
    return np.array(flat, dtype=object).reshape(x.shape)


def as_wide(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return (a, b) if a.dtype == b.dtype else (a.astype(object), b.astype(object))


def squares(a: np.ndarray) -> np.ndarray:
    return (a * a).sum(axis=-1)


def roots(a: np.ndarray) -> np.ndarray:
    """Square roots: floats, or of Python's numbers their whole parts."""
    return np.array([math.isqrt(v) for v in a.tolist()], dtype=object) if a.dtype == object else np.sqrt(a.astype(float))


def nearest(x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Of each row of x: the number of its nearest row of c, the squared distance, and how many distances were worked out in all."""
    x, c = as_wide(x, c)
    norms, own = roots(squares(c)), roots(squares(x))
    order = np.argsort(norms, kind="stable")
    norms = norms[order]
    right = np.minimum(np.searchsorted(norms, own), len(c) - 1)
    guess = np.where((right > 0) & (np.abs(norms[np.maximum(right - 1, 0)] - own) <= np.abs(norms[right] - own)), np.maximum(right - 1, 0), right)
    best, number = squares(x - c[order[guess]]), order[guess]
    margin = np.full(len(x), 3) if norms.dtype == object else 1e-9 * (own + norms[-1] + 1)
    bound = roots(best) + margin
    low, high = np.searchsorted(norms, own - bound, "left"), np.searchsorted(norms, own + bound, "right")
    looked = len(x)
    rows = np.arange(len(x))
    for step in range(1, len(c)):  # outwards from the guess, so that the bound shrinks early
        rows = rows[(low[rows] <= guess[rows] - step) | (guess[rows] + step < high[rows])]
        for side in (-step, step):
            at = guess[rows] + side
            mine, at = rows[ok := (low[rows] <= at) & (at < high[rows])], at[ok]
            near = np.abs(norms[at] - own[mine]) <= roots(best[mine]) + margin[mine]
            mine, at = mine[near], at[near]
            looked += len(mine)
            d = squares(x[mine] - c[order[at]])
            nearer = (d < best[mine]) | ((d == best[mine]) & (order[at] < number[mine]))
            best[mine[nearer]], number[mine[nearer]] = d[nearer], order[at[nearer]]
    return number, best, looked


def vectors(batch: pa.RecordBatch, dims: int, scale: float) -> tuple[pa.Array, np.ndarray]:
    """ids and vectors of the rows that take part; ids first, then lists."""
    ids, lists = batch.column(0), batch.column(1)
    ok = pc.fill_null(pc.equal(pc.list_value_length(lists), dims), False)
    ids, lists = ids.filter(ok), lists.filter(ok)
    flat = lists.flatten()
    x = flat.cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(-1, dims)  # nulls become NaN
    fine = np.isfinite(x).all(1)
    return ids.filter(pa.array(fine)), whole(x[fine], scale)


def parts(batches: Iterator[pa.RecordBatch], dims: int, scale: float) -> Iterator[tuple[pa.Array, np.ndarray]]:
    for b in batches:
        for at in range(0, b.num_rows, ROWS):
            ids, x = vectors(b.slice(at, ROWS), dims, scale)
            if len(x):
                yield ids, x


SUMS = "cluster int, n long, inertia string, sums array<string>"


def sums_table(total: dict[int, tuple[int, int, np.ndarray]]) -> pa.Table:
    """Whole numbers of any size, as text."""
    keys = sorted(total)
    return pa.table({
        "cluster": pa.array(keys, pa.int32()), "n": pa.array([total[k][0] for k in keys], pa.int64()), "inertia": pa.array([str(total[k][1]) for k in keys], pa.string()),
        "sums": pa.array([[str(v) for v in total[k][2].tolist()] for k in keys], pa.list_(pa.string())),
    })


def round_sums(points: DataFrame, c: np.ndarray, dims: int, scale: float) -> dict[int, tuple[int, int, list[int]]]:
    """By centroid: the number of vectors nearest to it, their summed distance and their summed components."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, tuple[int, int, np.ndarray]] = {}
        for _, x in parts(batches, dims, scale):
            number, d, _ = nearest(x, c)
            for k in np.unique(number).tolist():
                mine = number == k
                n, inertia, s = total.get(k, (0, 0, np.zeros(dims, object)))
                total[k] = n + int(mine.sum()), inertia + sum(d[mine].tolist()), s + x[mine].sum(0).astype(object)
        yield from sums_table(total).to_batches()
        give_back()

    def merge(key: tuple, t: pa.Table) -> pa.Table:
        n, inertia, s = 0, 0, np.zeros(dims, object)
        for r in t.to_pylist():
            n, inertia, s = n + r["n"], inertia + int(r["inertia"]), s + np.array([int(v) for v in r["sums"]], dtype=object)
        return sums_table({key[0].as_py(): (n, inertia, s)})

    rows = points.mapInArrow(run, SUMS).groupBy("cluster").applyInArrow(merge, SUMS).collect()
    return {r.cluster: (r.n, int(r.inertia), [int(v) for v in r.sums]) for r in rows}


def first_centroids(points: DataFrame, k: int, seed: str, dims: int, scale: float) -> np.ndarray:
    """The k vectors with the smallest sha256 of ``seed:id``; of a repeated id, in order of components."""
    x = F.col("vec").cast("array<double>")
    fine = F.coalesce((F.size("vec") == dims) & ~F.exists("vec", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))), F.lit(False))
    h = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256)
    rows = points.where(fine).select(h.alias("h"), x.alias("x")).orderBy("h", "x").limit(k).collect()
    return whole(np.array([r.x for r in rows], float).reshape(-1, dims), scale)


def clustered(vectors_: DataFrame, k: int = 8, rounds: int = 10, dims: int = 64, scale: float = 1024.0, seed: str = "3", id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """id_col, cluster, distance (squared), cluster_inertia, inertia, centroid_sha256 of every vector that takes part, after
    ``rounds`` rounds (an empty centroid stays where it is) and a last assignment. seed: of the hash that picks the first
    centroids. scale must be a power of two."""
    if scale <= 0 or np.frexp(scale)[0] != 0.5:
        raise ValueError("scale must be a power of two")
    points = vectors_.select(F.col(id_col).alias("id"), F.col(vec_col).alias("vec"))
    c = first_centroids(points, k, seed, dims, scale)
    for _ in range(rounds if len(c) else 0):
        got = round_sums(points, c, dims, scale)
        moved = [[v // got[j][0] for v in got[j][2]] if j in got else c[j].tolist() for j in range(len(c))]
        c = np.array(moved, dtype=np.int64 if all(abs(v) < SMALL for row in moved for v in row) else object)
    kind = points.schema["id"].dataType.simpleString()
    spec = f"`{id_col}` {kind}, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    if not len(c):
        return vectors_.sparkSession.createDataFrame([], spec)
    got = round_sums(points, c, dims, scale)
    of = [min(LARGEST, got[j][1]) if j in got else 0 for j in range(len(c))]
    every = min(LARGEST, sum(g[1] for g in got.values()))
    digest = [hashlib.sha256(",".join(str(int(v)) for v in row).encode()).hexdigest() for row in c.tolist()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, x in parts(batches, dims, scale):
            number, d, _ = nearest(x, c)
            yield pa.RecordBatch.from_arrays([
                ids, pa.array(number, pa.int32()), pa.array([min(LARGEST, v) for v in d.tolist()], pa.int64()), pa.array(np.array(of, np.int64)[number]),
                pa.array(np.full(len(number), every, np.int64)), pa.array(np.array(digest)[number], pa.string()),
            ], names=[id_col, "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"])
        give_back()

    return points.mapInArrow(run, spec)
