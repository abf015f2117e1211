"""Joins of date intervals that overlap."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrylane.session import cut

FAR = 1 << 30


def _day(column: str, empty: int) -> Column:
    return F.coalesce(F.datediff(F.col(column).cast("date"), F.lit("1970-01-01").cast("date")), F.lit(empty))


def overlapping(a: DataFrame, b: DataFrame, on: list[str] | None = None, days: int = 30, lo: str = "lo", hi: str = "hi") -> DataFrame:
    """All pairs of rows of equal ``on`` whose intervals share a day; columns of ``b`` get the prefix ``b_``.

    Ends belong to an interval; a null end is open, and what ends before it starts matches nothing.
    Intervals stand in each bin of ``days`` that they touch, and a pair is given in the first bin that both
    touch, so once. Open ends reach as far as any end of the tables, so both are written once, for
    their ends and for the join. Take ``days`` near the usual length: an interval stands in its
    length over ``days`` bins.
    """
    on = on or []
    left = cut(a.withColumns({"_lo": _day(lo, -FAR), "_hi": _day(hi, FAR)}).filter("_lo <= _hi"), "spans")
    right = cut(b.select(*[F.col(c).alias(f"b_{c}") for c in b.columns], _day(lo, -FAR).alias("_blo"), _day(hi, FAR).alias("_bhi")).filter("_blo <= _bhi"), "spans")
    shut = lambda c: F.when(F.abs(c) < FAR, F.col(c))
    ends = lambda df, x, y: df.agg(F.least(F.min(shut(x)), F.min(shut(y))), F.greatest(F.max(shut(x)), F.max(shut(y)))).first()
    found = [d for d in (*ends(left, "_lo", "_hi"), *ends(right, "_blo", "_bhi")) if d is not None] or [0]
    first, last = min(found) // days, max(found) // days
    clamp = lambda c: F.greatest(F.lit(first), F.least(F.lit(last), F.floor(F.col(c) / days)))
    left = left.withColumn("_bin", F.explode(F.sequence(clamp("_lo"), clamp("_hi"))))
    right = right.withColumn("_bbin", F.explode(F.sequence(clamp("_blo"), clamp("_bhi"))))
    same = (F.col("_bin") == F.col("_bbin")) & (F.col("_lo") <= F.col("_bhi")) & (F.col("_blo") <= F.col("_hi")) & (F.col("_bin") == F.greatest(clamp("_lo"), clamp("_blo")))
    for c in on:
        same = same & (left[c] == right[f"b_{c}"])
    return left.join(right, same).drop("_lo", "_hi", "_bin", "_blo", "_bhi", "_bbin")
