"""Putting the package on the executors, and intermediate tables where all of them can read."""

from __future__ import annotations

import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

PACKAGE = Path(__file__).resolve().parent
#: Bytes of the batches that Python workers get, where the session has no limit of its own, and the setting.
BATCH, BATCH_LIMIT = 1 << 21, "spark.sql.execution.arrow.maxBytesPerBatch"
_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send the package's own code to the executors, once for each application."""
    app = spark.sparkContext.applicationId
    if app not in _shipped:
        target = str(Path(tempfile.mkdtemp(prefix="quarrylane-")) / PACKAGE.name)
        spark.sparkContext.addPyFile(shutil.make_archive(target, "zip", PACKAGE.parent, PACKAGE.name))
        _shipped.add(app)


def bound_batches(spark: SparkSession) -> None:
    """Bound Arrow batches by bytes, for stages on whole texts: 10,000 of these are copied several times on both sides."""
    if spark.conf.get(BATCH_LIMIT, None) is None:
        spark.conf.set(BATCH_LIMIT, BATCH)


def scratch(spark: SparkSession, label: str) -> str:
    """A new folder in the shared folder of ``spark.checkpoint.dir``; a temporary one only where a local session has none."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="quarrylane-")
    return f"{root.rstrip('/')}/quarrylane/{label}-{uuid.uuid4().hex}"


def cut(df: DataFrame, label: str) -> DataFrame:
    """The same rows, written to a shared folder and read again: what rounds need against long plans and lost executors."""
    path = scratch(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
