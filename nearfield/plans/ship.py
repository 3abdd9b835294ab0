"""Make a session ready: ship this package to the executors, so that functions of its modules can be loaded there."""

from __future__ import annotations

import importlib.util
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

#: By application: the folder of the file, which Spark's file server reads for as long as the application runs.
_DONE: dict[str, tempfile.TemporaryDirectory] = {}


BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
#: Spark's own bound, and the one that takes its place: a task holds several copies of a batch, in the JVM and in Python.
LARGE, SMALL = "67108864b", "16m"


def ship(spark: SparkSession) -> None:
    """Once a Spark application: the package's sources as a Python file of the job. Arrow batches are kept small, unless the
    session has a bound of its own."""
    if spark.conf.get(BATCH, None) == LARGE:
        spark.conf.set(BATCH, SMALL)
    app = spark.sparkContext.applicationId
    if app in _DONE:
        return
    root = Path(importlib.util.find_spec("nearfield").origin).parent
    folder = tempfile.TemporaryDirectory()
    target = Path(folder.name) / "nearfield-sources.zip"
    with zipfile.ZipFile(target, "w") as out:
        for f in sorted(root.rglob("*.py")):
            out.write(f, f"nearfield/{f.relative_to(root)}")
    spark.sparkContext.addPyFile(str(target))
    _DONE[app] = folder
