import random
import statistics

from pyspark.sql import functions as F

from quarrylane.operators import portfolio


def test_quantiles_without_a_width(spark):
    """Bins come from the range of values; equal values, one value, nulls and empty tables."""
    rng = random.Random(4)
    rows = [("a", rng.paretovariate(0.5)) for _ in range(501)] + [("b", 5.0)] * 40 + [("c", None), ("d", -3.0), ("d", 9.0)]
    df = spark.createDataFrame(rows, "g string, v double")
    for width in (None, 0.5):
        got = {r.g: r.m for r in portfolio.quantiles(df, "g", "v", {"m": 0.5}, width).collect()}
        assert got == {"a": statistics.median(v for g, v in rows if g == "a"), "b": 5.0, "d": 3.0}
    assert portfolio.quantiles(df.limit(0), "g", "v", {"m": 0.5}).count() == 0
    assert portfolio.quantiles(df.filter("g = 'b'"), "g", "v", {"m": 0.5}).first().m == 5.0


def test_moving_average_by_origin(spark):
    rows = [("x", f"2026-01-{d:02}", float(d)) for d in (1, 2, 2, 20, 29, 30)] + [("y", "2026-01-05", 7.0)]
    df = spark.createDataFrame(rows, "k string, day string, v double").withColumn("day", F.col("day").cast("date"))
    got = {(r.k, r.day.day): r.average for r in portfolio.moving_average(df, "k", "day", "v").collect()}
    assert got == {("x", 1): 1.0, ("x", 2): 2.5, ("x", 20): 25 / 3, ("x", 29): (4 + 20 + 29) / 3, ("x", 30): (20 + 29 + 30) / 3, ("y", 5): 7.0}
