"""Column expressions and row transforms on array<double> columns. All run in the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def sq_distance(a: Column | str, b: Column | str) -> Column:
    """Squared Euclidean distance, summed in order of dimension."""
    return F.aggregate(F.zip_with(a, b, lambda u, v: (u - v) * (u - v)), F.lit(0.0), lambda s, t: s + t)


def dims(points: DataFrame) -> int:
    return points.agg(F.max(F.size("x"))).first()[0] or 0


def dimension_stats(points: DataFrame, by: list[str] | None = None) -> DataFrame:
    """by, dim (from 1), n, mean, sd (sample; 0 for one row): one partial aggregation over the exploded components."""
    long = points.select(*(by or []), F.posexplode("x").alias("d", "v"))
    return long.groupBy(*(by or []), (F.col("d") + 1).alias("dim")).agg(F.count("v").alias("n"), F.avg("v").alias("mean"), F.coalesce(F.stddev_samp("v"), F.lit(0.0)).alias("sd"))


def _row(points: DataFrame, column: str) -> DataFrame:
    """One row: the statistic of all dimensions in order. As long as a point: may be broadcast."""
    return dimension_stats(points).agg(F.transform(F.sort_array(F.collect_list(F.struct("dim", column))), lambda s: s[column]).alias(column))


def center(points: DataFrame) -> DataFrame:
    mean = _row(points, "mean").first()
    m = F.array(*[F.lit(v) for v in (mean.mean or [])])
    return points.withColumn("x", F.zip_with("x", m, lambda u, v: u - v))


def zscore(points: DataFrame) -> DataFrame:
    """Minus the mean, by the sample standard deviation (a constant dimension becomes 0)."""
    rows = {r.dim: r for r in dimension_stats(points).collect()}
    order = sorted(rows)
    m, s = F.array(*[F.lit(rows[d].mean) for d in order]), F.array(*[F.lit(rows[d].sd or 1.0) for d in order])
    return points.withColumn("x", F.zip_with(F.zip_with("x", m, lambda u, v: u - v), s, lambda u, v: u / v))


def unit_length(points: DataFrame) -> DataFrame:
    norm = F.sqrt(F.aggregate("x", F.lit(0.0), lambda a, c: a + c * c))
    return points.withColumn("__n", norm).withColumn("x", F.transform("x", lambda c: F.when(F.col("__n") > 0, c / F.col("__n")).otherwise(c))).drop("__n")


def stride(points: DataFrame, step: int) -> DataFrame:
    """Every step-th row by id, ids from 1."""
    return points.where((F.col("id") - 1) % step == 0)


def random_subset(points: DataFrame, m: int, seed: int = 0) -> DataFrame:
    """m rows, the same ones for a seed whatever the partitioning."""
    return points.orderBy(F.xxhash64(F.lit(seed), "id"), "id").limit(m)


def clean_nan(points: DataFrame) -> DataFrame:
    """NaN and null components become 0."""
    return points.withColumn("x", F.transform("x", lambda c: F.coalesce(F.nanvl(c, F.lit(0.0)), F.lit(0.0))))


def zero_count_label(points: DataFrame) -> DataFrame:
    """The label is 1 + the number of zero components."""
    return points.withColumn("label", (1 + F.size(F.filter("x", lambda c: c == 0))).cast("double"))


def gather(points: DataFrame, index: DataFrame) -> DataFrame:
    """Rows by an index table (pos, id): position and row. A join, whatever the order of rows."""
    return index.join(points, "id").select("pos", *points.columns)


def scatter(values: DataFrame, index: DataFrame) -> DataFrame:
    """The inverse of gather: values (pos, ...) back to the ids."""
    return values.join(index, "pos").drop("pos")


def two_children(nodes: DataFrame) -> DataFrame:
    """Rows of node i become rows of its children 2i - 1 and 2i."""
    return nodes.withColumn("node", F.explode(F.array(2 * F.col("node") - 1, 2 * F.col("node"))))
