"""Cutting lineage in loops: a written table in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if spark.sparkContext.getCheckpointDir() is None:
            if not spark.sparkContext.master.startswith("local["):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="nearfield-"))
        found = spark.sparkContext.getCheckpointDir()
    return found


#: Tables that this process has written to the shared folder and not removed.
_WRITTEN: list[str] = []


def place(spark: SparkSession, what: str) -> str:
    """A new path in the shared folder, which ``clean`` removes with the others."""
    path = f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"
    _WRITTEN.append(path)
    return path


def written(df: DataFrame, what: str, compression: str = "snappy") -> DataFrame:
    """Write df to the shared folder and read it again: cuts the lineage, and survives the loss of any executor."""
    path = place(df.sparkSession, what)
    df.write.option("compression", compression).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def clean(spark: SparkSession) -> int:
    """Removes the tables written so far, and says how many. Results are lazy and may read them: call it when they have been
    saved or are not needed any more."""
    paths, _WRITTEN[:] = list(_WRITTEN), []
    for p in paths:
        path = spark._jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return len(paths)


def ranked(df: DataFrame, by: list[str], name: str) -> DataFrame:
    """df with each row's place (from 1) in the order of ``by``, which should tell rows apart. Ranges are sorted side by side
    and written; a place is that in the range plus the sizes of the ranges before it, of which there are few."""
    bits = F.col("__row")
    parts = written(df.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("__row", F.monotonically_increasing_id()), "ranges")
    sizes = parts.groupBy(F.shiftright(bits, 33).alias("part")).count().orderBy("part").collect()
    before, at = [], 0
    for r in sizes:
        before.append((r.part, at))
        at += r["count"]
    offsets = df.sparkSession.createDataFrame(before, "part long, offset long")
    place = F.col("offset") + bits.bitwiseAND(F.lit((1 << 33) - 1)) + 1
    return parts.join(F.broadcast(offsets), F.shiftright(bits, 33) == F.col("part")).select(*df.columns, place.alias(name))
