"""Grid summaries of planar embeddings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.lineage import ranked


def cells(points: DataFrame, columns: int, rows: int) -> DataFrame:
    """Each point (id, y) with the cells (h, v from 1) that hold it. Cells have both edges, so a point on an inner edge is in
    the cells on both sides. The cell is worked out, not joined: a point has at most four."""
    box = points.agg(*[f(F.get("y", F.lit(d))).alias(f"{n}{d}") for d in (0, 1) for n, f in (("lo", F.min), ("hi", F.max))])
    p = points.join(F.broadcast(box))

    def held(d: int, n: int):
        width = (F.col(f"hi{d}") - F.col(f"lo{d}")) / n
        guess = F.when(width > 0, F.floor((F.get("y", F.lit(d)) - F.col(f"lo{d}")) / width).cast("int")).otherwise(F.lit(0))
        near = F.sequence(F.greatest(guess, F.lit(1)), F.least(guess + 2, F.lit(n)))
        edge = lambda k: F.col(f"lo{d}") + k * width
        return F.filter(near, lambda k: (F.get("y", F.lit(d)) >= edge(k - 1)) & (F.get("y", F.lit(d)) <= edge(k)))

    return p.withColumn("h", F.explode(held(0, columns))).withColumn("v", F.explode(held(1, rows))).drop("lo0", "hi0", "lo1", "hi1")


def counts(points: DataFrame, columns: int, rows: int) -> DataFrame:
    return cells(points, columns, rows).groupBy("h", "v").agg(F.count(F.lit(1)).alias("n"))


def means(points: DataFrame, columns: int, rows: int) -> DataFrame:
    """h, v, dim (from 1), mean of the points' x."""
    return cells(points, columns, rows).select("h", "v", F.posexplode("x").alias("d", "c")).groupBy("h", "v", (F.col("d") + 1).alias("dim")).agg(F.avg("c").alias("mean"))


def clipped_nearest(dist: DataFrame, low: float = 0.05, high: float = 0.95) -> DataFrame:
    """j, nn: the distance to the nearest other point (0 and less don't count), held between two order statistics."""
    near = ranked(dist.groupBy("j").agg(F.min(F.when(F.col("d") <= 0, 1e100).otherwise(F.col("d"))).alias("nn")), ["nn", "j"], "r")
    n = near.count()
    lo, hi = max(1, -(-int(round(low * n * 1000)) // 1000)), max(1, int(high * n))
    ends = near.agg(F.max(F.when(F.col("r") == lo, F.col("nn"))).alias("lo"), F.max(F.when(F.col("r") == hi, F.col("nn"))).alias("hi"))
    return near.join(F.broadcast(ends)).select("j", F.least(F.greatest("nn", "lo"), "hi").alias("nn"))
