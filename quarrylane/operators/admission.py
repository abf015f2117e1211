"""Admission in order with feedback: what is refused doesn't count for what comes later.

An amount of the favoured part always enters. Another one enters only if the part's share of all
that has entered, itself included, stays at a limit. As refusals change what later rows are held
against, no window sum states this; rows are scanned in order with two sums as the only state.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def admit(journal: DataFrame, by: list[str], order: list[str], part: str = "part", amount: str = "amount", least: float = 0.72, start: DataFrame | None = None) -> DataFrame:
    """Adds admitted, part_sum and other_sum (sums after the row) to a journal.

    ``start`` has ``by``, part_sum and other_sum from before. Rows of equal ``order`` go in any
    order, so it should end in a key. A null part is none, a null amount nothing. What enters first and
    isn't of the part is refused, as its share would be 0. A group is one sequence by nature: one task
    scans it, batch after batch, so memory doesn't depend on its size.
    """
    sums = ["part_sum", "other_sum"]
    rows = journal.withColumns({"_part": F.coalesce(F.col(part), F.lit(False)), "_amount": F.coalesce(F.col(amount).cast("double"), F.lit(0.0)), "_entry": F.lit(True), **{s: F.lit(0.0) for s in sums}})
    if start is not None:
        first = start.select(*by, *[F.col(s).cast("double").alias(s) for s in sums], F.lit(False).alias("_entry"))
        rows = rows.unionByName(first, allowMissingColumns=True)
    ready = rows.repartition(*by).sortWithinPartitions(*by, "_entry", *order)
    names = ready.columns
    keys, at = [names.index(b) for b in by], {n: names.index(n) for n in ("_part", "_amount", "_entry", *sums)}

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, ours, others = None, 0.0, 0.0
        for batch in batches:
            lists = {n: batch.column(i).to_pylist() for n, i in at.items()}
            groups = list(zip(*(batch.column(i).to_pylist() for i in keys), strict=True))
            admitted = []
            for i, group in enumerate(groups):
                if group != held:
                    held, ours, others = group, 0.0, 0.0
                value, enters = lists["_amount"][i], True
                if not lists["_entry"][i]:
                    ours, others = ours + lists["part_sum"][i], others + lists["other_sum"][i]
                elif lists["_part"][i]:
                    ours += value
                else:
                    whole = ours + others + value
                    enters = whole > 0 and ours / whole >= least
                    others += value if enters else 0.0
                admitted.append(enters)
                lists["part_sum"][i], lists["other_sum"][i] = ours, others
            new = {at[s]: pa.array(lists[s], pa.float64()) for s in sums}
            columns = [new.get(i, c) for i, c in enumerate(batch.columns)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(admitted, pa.bool_())], names=[*batch.schema.names, "admitted"])

    kind = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ready.schema) + ", admitted boolean"
    return ready.mapInArrow(scan, kind).filter("_entry").drop("_part", "_amount", "_entry")


def latest_sums(admitted: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """by, part_sum, other_sum after each group's last row."""
    last = F.max_by(F.struct("part_sum", "other_sum"), F.struct(*order)).alias("s")
    return admitted.groupBy(*by).agg(last).select(*by, "s.*")


def _read(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def gate(path: str, by: list[str], order: list[str], part: str = "part", amount: str = "amount", least: float = 0.72, snapshot_every: int = 20) -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch``: decides a batch's rows and writes them to ``path/decisions/batch=N``.

    The sums after batch N are in ``path/sums/batch=N``: of the groups it touched, or of all groups in
    each ``snapshot_every``-th batch, so that a batch reads few files. Batch N reads sums of earlier
    batches alone and overwrites its own folders, so a batch that is played again gives the same
    and counts once. Rows that a stream brings late are decided when they come.
    """

    def decide(batch: DataFrame, number: int) -> None:
        spark, start = batch.sparkSession, None
        from_batch = max(number - 1, 0) // snapshot_every * snapshot_every
        if number > 0 and (held := _read(spark, f"{path}/sums")) is not None:
            held = held.filter((F.col("batch") >= from_batch) & (F.col("batch") < number))
            start = held.groupBy(*by).agg(F.max_by(F.struct("part_sum", "other_sum"), "batch").alias("s")).select(*by, "s.*")
        decided = f"{path}/decisions/batch={number}"
        admit(batch, by, order, part, amount, least, start).write.mode("overwrite").parquet(decided)
        after = latest_sums(spark.read.parquet(decided), by, order)
        if start is not None and number % snapshot_every == 0:
            both = after.withColumn("_new", F.lit(1)).unionByName(start.withColumn("_new", F.lit(0)))
            place = F.row_number().over(Window.partitionBy(*by).orderBy(F.col("_new").desc()))
            after = both.withColumn("_place", place).filter("_place = 1").drop("_place", "_new")
        after.write.mode("overwrite").parquet(f"{path}/sums/batch={number}")

    return decide
