"""Histories: versions of pages between snapshots, and amounts at the rate that held on their day."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def versions(snapshots: DataFrame, key: str, day: str, content: str) -> DataFrame:
    """key, digest, valid_from, valid_to: for how long a key had a content, over all snapshots.

    ``valid_to`` is the first snapshot without that content, null while it lasts. A key that a snapshot
    lacks is deleted by it, and one that comes back is a new version, also with its old content.
    Null content is empty; null keys or days are left out. A key with several contents in one
    snapshot has the one of the smallest digest. Only digests shuffle, and a window sees one row for each snapshot of a key.
    """
    rows = snapshots.filter(F.col(key).isNotNull() & F.col(day).isNotNull())
    seen = rows.groupBy(F.col(key).alias("k"), F.col(day).alias("d")).agg(F.min(F.sha2(F.coalesce(F.col(content).cast("string"), F.lit("")), 256)).alias("digest"))
    by_day = Window.orderBy("d")  # over snapshots, not rows
    days = rows.select(F.col(day).alias("d")).distinct().withColumns({"number": F.row_number().over(by_day), "following": F.lead("d").over(by_day)})
    own = Window.partitionBy("k").orderBy("number")
    starts = (F.lag("number").over(own) == F.col("number") - 1) & (F.lag("digest").over(own) == F.col("digest"))
    marked = seen.join(days, "d").withColumn("starts", F.when(F.coalesce(starts, F.lit(False)), 0).otherwise(1))
    runs = marked.withColumn("run", F.sum("starts").over(own.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return runs.groupBy(F.col("k").alias(key), "run").agg(F.first("digest").alias("digest"), F.min("d").alias("valid_from"), F.max_by("following", "number").alias("valid_to")).drop("run")


def as_of(history: DataFrame, day) -> DataFrame:
    """The versions that hold on a day: from its own day on, to the day before the next."""
    at = F.lit(day)
    return history.filter((F.col("valid_from") <= at) & (F.col("valid_to").isNull() | (F.col("valid_to") > at)))


def at_rate(rows: DataFrame, rates: DataFrame, key: str, day: str, value: str, since: str = "since", days: int = 90, rate_key: str | None = None) -> DataFrame:
    """Adds ``value``: the newest of a key's dated values that isn't after the row's day; none: null.

    ``rates`` has the key (``rate_key``), ``since`` and ``value``. Both sides are cut into bins of ``days``; the last
    value of each bin is carried on to the bins after it, and then a bin of a key is ordered by
    itself, so that no key is one task. Of several values of a key and day the largest holds. Rows
    with a null key or day get null.
    """
    rate_key = rate_key or key
    number = lambda d: F.floor(F.datediff(d, F.lit("1970-01-01").cast("date")) / days)
    known = rates.filter(F.col(rate_key).isNotNull() & F.col(since).isNotNull()).groupBy(F.col(rate_key).alias("_key"), F.col(since).cast("date").alias("_day")).agg(F.max(value).alias("_value"))
    known = known.withColumn("_bin", number(F.col("_day")))
    asked = rows.withColumns({"_key": F.col(key), "_day": F.col(day).cast("date")}).withColumn("_bin", number(F.col("_day")))
    last = known.groupBy("_key", "_bin").agg(F.max_by("_value", "_day").alias("_last"))
    bins = last.unionByName(asked.filter("_key is not null and _bin is not null").select("_key", "_bin", F.lit(None).cast(known.schema["_value"].dataType).alias("_last")).distinct())
    bins = bins.groupBy("_key", "_bin").agg(F.max("_last").alias("_last"))
    earlier = Window.partitionBy("_key").orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)  # over bins, not rows
    carried = bins.select("_key", "_bin", F.last("_last", ignorenulls=True).over(earlier).alias("_value")).filter("_value is not null")
    point = known.select("_key", "_bin", "_day", "_value").unionByName(carried.withColumn("_day", F.lit(None).cast("date")))
    both = asked.withColumn("_asks", F.lit(True)).unionByName(point.withColumn("_asks", F.lit(False)), allowMissingColumns=True)
    upto = Window.partitionBy("_key", "_bin").orderBy(F.col("_day").asc_nulls_first(), "_asks").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = both.withColumn("_found", F.last("_value", ignorenulls=True).over(upto)).filter("_asks")
    return found.withColumn(value, F.when(F.col("_key").isNotNull() & F.col("_day").isNotNull(), F.col("_found"))).drop("_key", "_day", "_bin", "_value", "_asks", "_found")
