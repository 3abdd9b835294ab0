"""Principal components, classical scaling, initial embeddings and alignment."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import center, dims
from ..plans.lineage import ranked, written
from .distance import block_pairs, distance_sums


def pca(points: DataFrame, k: int) -> DataFrame:
    """id, y: the first k principal components, U * S (Spark's PCA doesn't center, so points are centered first)."""
    c = center(points).withColumn("v", array_to_vector("x"))
    model = PCA(k=min(k, dims(points)), inputCol="v", outputCol="pc").fit(c)
    return model.transform(c).select("id", vector_to_array("pc").alias("y"))


def scaled(y: DataFrame, size: float) -> DataFrame:
    """The whole embedding scaled to the Frobenius norm size."""
    norm = y.agg(F.sqrt(F.sum(F.aggregate("y", F.lit(0.0), lambda a, c: a + c * c))).alias("norm"))
    return y.join(F.broadcast(norm)).select("id", F.transform("y", lambda c: c * size / F.col("norm")).alias("y"))


def pca_init(points: DataFrame, dim: int = 2, size: float = 1.0, per_point: bool = False) -> DataFrame:
    """PCA scaled to the norm size (per_point: times the number of points)."""
    return scaled(pca(points, dim), size * (points.count() if per_point else 1))


def random_init(points: DataFrame, dim: int = 2, scale: float = 1e-4, seed: int = 0) -> DataFrame:
    from ..sources.points import normal

    return points.select("id", F.array(*[scale * normal(seed, F.lit(d), F.col("id")) for d in range(dim)]).alias("y"))


def provided_init(points: DataFrame, y: DataFrame) -> DataFrame:
    """The given coordinates, by id; all points must have some."""
    got = points.select("id").join(y.select("id", "y"), "id")
    if got.count() != points.count():
        raise ValueError("the initial embedding doesn't cover all points")
    return got


def double_center(dist: DataFrame, d2: str = "d2") -> DataFrame:
    """j, i, b = -(d2 - row mean - column mean + mean) / 2: means by group-bys."""
    rows = dist.groupBy("i").agg(F.avg(d2).alias("mi"))
    cols = dist.groupBy("j").agg(F.avg(d2).alias("mj"))
    every = dist.agg(F.avg(d2).alias("m"))
    return dist.join(rows, "i").join(cols, "j").join(F.broadcast(every)).select("j", "i", (-0.5 * (F.col(d2) - F.col("mi") - F.col("mj") + F.col("m"))).alias("b"))


def double_center_of_points(points: DataFrame) -> DataFrame:
    """j, i, b: what double_center gives of the squared distances of points (id, x). Means of rows are told by the mean point, and pairs are
    made where they leave."""
    sums = written(distance_sums(points), "sums")
    total = sums.agg(F.count(F.lit(1)).alias("n"), F.sum("s").alias("s")).first()
    n, mean = max(1, total.n), (total.s or 0.0) / max(1, total.n) ** 2

    def emit(j, i, d2, of_j, of_i):
        b = -0.5 * (d2 - of_i[:, 0] - of_j[:, :1] + mean)
        return pa.table({"j": np.repeat(j, len(i)), "i": np.tile(i, len(j)), "b": b.ravel()})

    both = points.select("id", "x").join(sums.select("id", F.array(F.col("s") / n).alias("about")), "id")
    return block_pairs(both, both, ["x"], emit, "j long, i long, b double", carried=("about",))


def pcoa(dist: DataFrame, k: int | None = None, share: float = 0.999, whiten: bool = False, divide: bool = False) -> DataFrame:
    """id, y of squared distances (j, i, d2): top eigenvectors of the centered matrix times the roots of their values (whiten:
    times sqrt(N); divide: over sqrt(N)). Without k, as many as make up share of the positive values, two at least. The
    eigenproblem is one task's, as large as the distance matrix."""

    def run(t: pa.Table) -> pa.Table:
        ids = np.unique(t["j"].to_numpy())
        b = np.zeros((len(ids), len(ids)))
        b[np.searchsorted(ids, t["j"].to_numpy()), np.searchsorted(ids, t["i"].to_numpy())] = t["b"].to_numpy()
        w, v = np.linalg.eigh((b + b.T) / 2)
        w, v = np.maximum(w[::-1], 0), v[:, ::-1]
        m = k or max(2, int(np.searchsorted(np.cumsum(w) / max(w.sum(), 1e-300), share)) + 1)
        y = v[:, :m] * (np.sqrt(len(ids)) if whiten else np.sqrt(w[:m]) / (np.sqrt(len(ids)) if divide else 1))
        return pa.table({"id": ids, "y": pa.array(list(y), pa.list_(pa.float64()))})

    return double_center(dist).groupBy(F.lit(1).alias("g")).applyInArrow(run, "id long, y array<double>")


def distance_init(dist: DataFrame, dim: int, whiten: bool = False) -> DataFrame:
    """Canonically ordered classical scaling: id, pos, y."""
    order = ranked(dist.groupBy(F.col("j").alias("id")).agg(F.round(F.sum("d2"), 9).alias("s")), ["s", "id"], "pos").select("id", "pos")
    return order.join(pcoa(dist, dim, whiten=whiten), "id")


def rotate(y: DataFrame) -> DataFrame:
    """Centered, in its own principal axes."""
    return pca(y.select("id", F.col("y").alias("x")), dims(y.select(F.col("y").alias("x"))))


def procrustes(target: DataFrame, y: DataFrame) -> DataFrame:
    """y moved, scaled and turned to fit target (both id, y): the sums of products are aggregated, the small matrix is decomposed here."""
    both = target.select("id", F.col("y").alias("a")).join(y.select("id", F.col("y").alias("b")), "id")
    d = dims(y.select(F.col("y").alias("x")))
    at = lambda c, k: F.get(c, F.lit(k))
    r = both.agg(F.count(F.lit(1)).alias("n"), *[F.avg(at(c, k)).alias(f"m{c}{k}") for c in "ab" for k in range(d)]).first()
    ma, mb = np.array([r[f"ma{k}"] for k in range(d)]), np.array([r[f"mb{k}"] for k in range(d)])
    s = both.agg(*[F.sum((at("a", i) - float(ma[i])) * (at("b", j) - float(mb[j]))).alias(f"p{i}_{j}") for i in range(d) for j in range(d)], F.sum(sum((at("b", j) - float(mb[j])) ** 2 for j in range(d))).alias("bb")).first()
    m = np.array([[s[f"p{i}_{j}"] for j in range(d)] for i in range(d)])
    u, w, vt = np.linalg.svd(m)
    turn, scale = u @ vt, w.sum() / max(s.bb, 1e-300)
    moved = [F.lit(float(ma[i])) + sum(F.lit(float(scale * turn[i, j])) * (at("y", j) - float(mb[j])) for j in range(d)) for i in range(d)]
    return y.select("id", F.array(*moved).alias("y"))
