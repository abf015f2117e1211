"""Helpers that the training-data operators share."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The six characters that separate words.
SPACES = "\x20\t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"

#: A group is hot when it holds this share of the rows; so at most this many are.
HOT_SHARE = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession, label: str) -> str:
    """A new folder in the shared folder of ``spark.checkpoint.dir``.

    Only where that setting is missing (a local session, as in tests) is a temporary folder used.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="quarrylane-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/quarrylane/{label}-{uuid.uuid4().hex}"


def stash(df: DataFrame, label: str) -> DataFrame:
    """Write a narrow intermediate table once and reread it: cuts lineage, survives lost executors."""
    path = scratch(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Workspace:
    """A folder for intermediate tables of one step, which goes once the step's results are written."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark, self.folder, self.tables = spark, scratch(spark, label), 0

    def stash(self, df: DataFrame, label: str) -> DataFrame:
        self.tables += 1
        path = f"{self.folder}/{label}-{self.tables}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def close(self) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def text_of(column: str | Column) -> Column:
    """The text, null as empty."""
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def squeezed(text: Column) -> Column:
    """The text without its space characters."""
    for c in SPACES:
        text = F.replace(text, F.lit(c), F.lit(""))
    return text


def attach(rows: DataFrame, groups: DataFrame, key: str, size: str, total: int, how: str = "inner") -> DataFrame:
    """Inner (or left) join of rows with the record of their group, whatever the group's size.

    ``groups`` has one row per key with the number of its rows in ``size``; ``total`` is at least
    the sum of these. A group with ``total / HOT_SHARE`` rows or more is hot: there are at most
    HOT_SHARE of them, so they are broadcast and their rows stay where they are. The rest shuffle
    on the key, of which none can then fill a partition.
    """
    is_hot = F.col(size) * HOT_SHARE >= F.lit(total)
    hot, cold = groups.filter(is_hot), groups.filter(~is_hot)
    near = rows.join(F.broadcast(hot), key)
    far = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(cold, key, how)
    return near.unionByName(far)


def give_back() -> None:
    """Return a Python worker's free memory to the system, as the worker lives on for other stages.

    Arrow and the C library keep what was freed; the latter for each thread that a tokenizer had.
    """
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc only
    if trim:
        trim(0)


def portions(batches: Iterator[pa.RecordBatch], text: int, limit: int = 1 << 21) -> Iterator[pa.RecordBatch]:
    """Slices of batches with at most ``limit`` bytes in the column numbered ``text``, or one row."""
    for batch in batches:
        sizes = pa.compute.fill_null(pa.compute.binary_length(batch.column(text)), 0).to_pylist()
        start = size = 0
        for i, n in enumerate(sizes):
            if i > start and size + n > limit:
                yield batch.slice(start, i - start)
                start, size = i, 0
            size += n
        if start < len(sizes):
            yield batch.slice(start)
