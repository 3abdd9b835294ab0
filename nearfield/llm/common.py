"""What the operators of this subpackage share: reading, the shared folder, packing of columns."""

from __future__ import annotations

import ctypes

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nearfield.plans import lineage
from nearfield.plans.lineage import shared_dir

__all__ = ["SPLIT_SQL", "give_back", "partitions", "remainder", "shared_dir", "table", "text_or_empty", "written"]
#: ASCII white space as the word contracts define it: space and \t \n \v \f \r.
SPLIT_SQL = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, what: str) -> DataFrame:
    """Written to the shared folder and read again (see plans.lineage, also for removing such tables)."""
    return lineage.written(df, what, "zstd")


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


def text_or_empty(name: str = "text"):
    return F.coalesce(F.col(name), F.lit(""))


def remainder(name: str, n: int):
    """crc32 of the id as text, modulo n: the fixed split between learning and held-out rows."""
    return F.crc32(F.col(name).cast("string").cast("binary")) % F.lit(n)


def give_back() -> None:
    """Returns memory that a Python worker has freed to the system. Workers are used again by other operators."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass
