"""Bloom filters made with Spark's bitmap functions and tested in the scan's own stage.

A filter is a table of 4 KB bitmaps, one for each 32,768 bits. Its size is fixed before it is
built: at most ``2 ** MAX_LOG_BITS`` bits, 32 MB, so that it may be broadcast. On more keys than
that serves, it lets more rows pass as possible members; results stay the same.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrylane.llm.common import stash

MAX_LOG_BITS = 28
BITS_PER_KEY = 16


def log_bits(keys: int) -> int:
    return min(MAX_LOG_BITS, max(15, (max(1, keys) * BITS_PER_KEY - 1).bit_length()))


def positions(key: Column, log2: int) -> list[Column]:
    """Two bit positions from one 64-bit hash."""
    mask = F.lit((1 << log2) - 1)
    return [key.bitwiseAND(mask), F.shiftrightunsigned(key, 32).bitwiseAND(mask)]


def build(keys: DataFrame, key: str, log2: int, at_least: int = 1) -> DataFrame:
    """Bitmaps of the positions that ``at_least`` keys set. ``key``: a 64-bit hash."""
    counts = keys.select(F.explode(F.array(*positions(F.col(key), log2))).alias("pos")).groupBy("pos").agg(F.count("*").alias("n"))
    bitmaps = counts.filter(F.col("n") >= at_least).groupBy(F.shiftright("pos", 15).alias("bucket")).agg(F.bitmap_construct_agg(F.col("pos").bitwiseAND(F.lit(32767))).alias("bits"))
    return stash(bitmaps, "bitmaps")


def flag(df: DataFrame, key: Column, bitmaps: DataFrame, log2: int, name: str) -> DataFrame:
    """Add a boolean column: may the key be in the filter? Never false for a member."""
    kept, tests = df.columns, []
    for i, pos in enumerate(positions(key, log2)):
        side = bitmaps.select(F.col("bucket").alias(f"_bucket{i}"), F.col("bits").alias(f"_bits{i}"))
        df = df.withColumn(f"_pos{i}", pos).withColumn(f"_bucket{i}", F.shiftright(F.col(f"_pos{i}"), 15)).join(F.broadcast(side), f"_bucket{i}", "left")
        place = F.col(f"_pos{i}").bitwiseAND(F.lit(32767)).cast("int")
        byte = F.conv(F.hex(F.substring(F.col(f"_bits{i}"), F.shiftright(place, 3) + 1, F.lit(1))), 16, 10).cast("int")
        bit = F.lit(1).bitwiseAND(F.call_function("shiftright", byte, place.bitwiseAND(F.lit(7))))
        tests.append(F.coalesce(bit == 1, F.lit(False)))
    return df.select(*kept, (tests[0] & tests[1]).alias(name))


def without(df: DataFrame, dropped: DataFrame, id_col: str) -> DataFrame:
    """Rows whose id isn't in ``dropped`` (one column of that name); null ids compare as equal.

    Only rows that the filter lets pass shuffle.
    """
    log2 = log_bits(dropped.count())
    bitmaps = build(dropped.select(F.xxhash64(id_col).alias("key")), "key", log2)
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("packed"), F.col(id_col).alias("id"))
    flagged = flag(rows, F.xxhash64("id"), bitmaps, log2, "maybe")
    gone = dropped.select(F.col(id_col).alias("gone")).distinct()
    maybe = flagged.filter("maybe")
    rest = maybe.join(gone, maybe["id"].eqNullSafe(gone["gone"]), "left_anti")
    return flagged.filter(~F.col("maybe")).select("packed.*").unionByName(rest.select("packed.*"))
