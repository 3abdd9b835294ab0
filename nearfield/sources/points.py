"""Point sets: DataFrames (id bigint, x array<double>, label double). Readers, writers and generators."""

from __future__ import annotations

import io
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def from_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The embeddings table as points."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return rows.select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("x"), F.col("label").cast("double").alias("label"))


def from_columns(df: DataFrame, id_col: str, columns: list[str], label_col: str | None = None) -> DataFrame:
    """Feature columns of any table as points."""
    label = F.col(label_col).cast("double") if label_col else F.lit(None).cast("double")
    return df.select(F.col(id_col).cast("long").alias("id"), F.array(*[F.col(c).cast("double") for c in columns]).alias("x"), label.alias("label"))


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).select("id", "x", "label")


def read_csv(spark: SparkSession, path: str, schema: str, columns: list[str], id_col: str, stride: int = 1, label_col: str | None = None) -> DataFrame:
    """A CSV table with a given schema (no inference): some columns, every stride-th row by id (from 1)."""
    rows = spark.read.csv(path, schema=schema, header=True)
    return from_columns(rows.where((F.col(id_col) - 1) % stride == 0), id_col, columns, label_col)


def read_npy(spark: SparkSession, path: str) -> DataFrame:
    """NumPy matrices: a row of a file's matrix each; ids run from 1 in each file, and file names its source."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, content in zip(b.column("path").to_pylist(), b.column("content").to_pylist(), strict=True):
                m = np.atleast_2d(np.load(io.BytesIO(content), allow_pickle=False)).astype(float)
                for at in range(0, len(m), 4096):
                    part = m[at : at + 4096]
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(part)), pa.array(np.arange(at + 1, at + 1 + len(part))), pa.array(list(part), pa.list_(pa.float64()))], names=["file", "id", "x"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, "file string, id long, x array<double>")


def write_parquet(points: DataFrame, path: str, mode: str = "errorifexists") -> None:
    points.write.mode(mode).parquet(path)


def write_csv(points: DataFrame, path: str, dims: int, mode: str = "errorifexists") -> None:
    points.select("id", *[F.get("x", F.lit(d)).alias(f"x{d + 1}") for d in range(dims)], "label").write.mode(mode).csv(path, header=True)


# Generators. Normal and uniform numbers are functions of (seed, row, column), so results don't depend on partitioning.


def uniform(seed: int, *keys) -> F.Column:
    """In (0, 1), from a hash of the keys."""
    return (F.shiftrightunsigned(F.xxhash64(F.lit(seed), *keys), 11).cast("double") + 0.5) / F.lit(float(2**53))


def normal(seed: int, *keys) -> F.Column:
    """Box-Muller of two uniform numbers."""
    return F.sqrt(-2 * F.log(uniform(seed, F.lit(1), *keys))) * F.cos(2 * math.pi * uniform(seed, F.lit(2), *keys))


def _ids(spark: SparkSession, n: int) -> DataFrame:
    return spark.range(1, n + 1)


def gen_blobs(spark: SparkSession, levels: int = 4, branch: int = 5, seed: int = 1) -> DataFrame:
    """Hierarchical blobs: branch^levels points; block l of branch dimensions has 2^l * normal, one row for all that agree modulo branch^(levels - l + 1)."""
    n = branch**levels
    x = [2.0**lv * normal(seed, F.lit(lv), F.lit(k), (F.col("id") - 1) % (n // branch ** (lv - 1))) for lv in range(1, levels + 1) for k in range(branch)]
    return _ids(spark, n).select("id", F.array(*x).alias("x"), ((F.col("id") - 1) % branch + 1).cast("double").alias("label"))


def gen_circle(spark: SparkSession, n: int = 6000, seed: int = 2) -> DataFrame:
    """A circle with noise in eight more dimensions."""
    r = uniform(seed, F.col("id"))
    x = [F.cos(2 * math.pi * r), F.sin(2 * math.pi * r), *[0.01 * normal(seed, F.lit(k), F.col("id")) for k in range(8)]]
    return _ids(spark, n).select("id", F.array(*x).alias("x"), F.round(n * r / 72).alias("label"))


def gen_cube(spark: SparkSession, n: int | None = None, seed: int = 3) -> DataFrame:
    """Uniform in a cube around 0 (all of it: not cut to the ball); the label is the octant's number."""
    n = n or math.ceil(8192 * (2 / math.sqrt(math.pi)) ** 3 * math.gamma(2.5))
    x = F.array(*[uniform(seed, F.lit(k), F.col("id")) - 0.5 for k in range(3)])
    return _ids(spark, n).select("id", x.alias("x")).withColumn("label", octant())


def octant() -> F.Column:
    return (1 + sum(F.when(F.get("x", F.lit(k)) > 0, 2.0 ** (k + 1)).otherwise(0.0) for k in range(3))).cast("double")


def gen_sphere(spark: SparkSession, n: int = 3000, seed: int = 4) -> DataFrame:
    """On the unit sphere."""
    raw = _ids(spark, n).select("id", F.array(*[normal(seed, F.lit(k), F.col("id")) for k in range(3)]).alias("v"))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, c: a + c * c))
    return raw.select("id", F.transform("v", lambda c: c / norm).alias("x")).withColumn("label", octant())


def gen_roll(spark: SparkSession, n: int = 6000, seed: int = 5) -> DataFrame:
    """Swiss roll."""
    z1, z2 = 2 * uniform(seed, F.lit(1), F.col("id")) - 1, 2 * uniform(seed, F.lit(2), F.col("id")) - 1
    r = F.sqrt(2 + 2 * z1)
    x = F.array(r * F.cos(2 * math.pi * r), r * F.sin(2 * math.pi * r), 2 * z2)
    return _ids(spark, n).select("id", x.alias("x"), F.ceil(8 + 8 * z2).cast("double").alias("label"))


def gen_toroid(spark: SparkSession, n: int = 8192, loops: int = 30) -> DataFrame:
    """Toroidal helix; deterministic."""
    u = 2 * math.pi * (F.col("id") - 1) / n
    r = 2 + F.cos(loops * u)
    return _ids(spark, n).select("id", F.array(r * F.cos(u), r * F.sin(u), F.sin(loops * u)).alias("x"), ((F.col("id") - 1) % F.lit(n / loops)).alias("label"))
