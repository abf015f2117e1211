"""Exact duplicates by two passes over a Bloom filter.

The first pass counts, for each bit position, how many rows set it. Positions set by two rows or
more make a filter of possibly repeated hashes. The second pass tests each row against it: rows
that fail the test are certainly unique and pass straight through; only the others shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylane.llm import bloom
from quarrylane.llm.common import attach, squeezed, stash, text_of


def mark_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256, n_chars.

    Texts are equal if they are equal without their space characters; null counts as empty, and
    all empty texts are one group. The longest original text stays, then the smallest id; null ids
    come last. Of rows that repeat an id with texts of that length, one stays. An empty table
    gives no rows; other columns are not looked at.
    """
    text = text_of(text_col)
    digests = stash(
        docs.select(F.col(id_col).alias("doc_id"), F.length(text).cast("long").alias("n_chars"), F.sha2(squeezed(text).cast("binary"), 256).alias("text_sha256")).withColumn("row", F.monotonically_increasing_id()),
        "digests",
    )
    rows = digests.count()
    log2 = bloom.log_bits(rows)
    keyed = digests.withColumn("key", F.xxhash64("text_sha256"))
    flagged = bloom.flag(keyed, F.col("key"), bloom.build(keyed, "key", log2, at_least=2), log2, "maybe").drop("key")

    alone = flagged.filter(~F.col("maybe")).select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "text_sha256", "n_chars")
    maybe = flagged.filter("maybe").drop("maybe")
    best = F.min(F.struct((-F.col("n_chars")).alias("shorter"), F.col("doc_id").isNull().alias("no_id"), "doc_id", "row")).alias("best")
    groups = stash(maybe.groupBy("text_sha256").agg(best, F.count("*").alias("group_size")), "copies")
    shared = attach(maybe, groups, "text_sha256", "group_size", rows)
    shared = shared.select("doc_id", F.col("best.doc_id").alias("keep_id"), "group_size", (F.col("row") == F.col("best.row")).alias("kept"), "text_sha256", "n_chars")
    return alone.unionByName(shared)


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows that ``mark_copies`` keeps, with all their columns, whatever these are called.

    Whole texts of unique rows don't shuffle. Null and empty texts are one group, of which one row
    stays. Of rows that repeat id, text and length, any one stays. An empty table stays empty.
    """
    marks = stash(mark_copies(docs, id_col, text_col).filter("group_size > 1"), "marks")
    log2 = bloom.log_bits(marks.count())
    bitmaps = bloom.build(marks.select(F.xxhash64("text_sha256").alias("key")), "key", log2)
    text = text_of(text_col)
    packed = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("packed")
    rows = docs.select(packed, F.col(id_col).alias("id"), F.sha2(squeezed(text).cast("binary"), 256).alias("sha"), F.length(text).cast("long").alias("n"))
    flagged = bloom.flag(rows, F.xxhash64("sha"), bitmaps, log2, "maybe")
    maybe = flagged.filter("maybe")
    # a row that the filter lets pass without being a copy has no mark
    marked = marks.groupBy(F.col("doc_id").alias("of_id"), F.col("text_sha256").alias("of_sha"), F.col("n_chars").alias("of_n")).agg(F.max("kept").alias("kept"))
    same = maybe["id"].eqNullSafe(marked["of_id"]) & (maybe["sha"] == marked["of_sha"]) & (maybe["n"] == marked["of_n"])
    joined = maybe.join(marked, same, "left").filter(F.coalesce("kept", F.lit(True)))
    once = joined.filter(F.col("kept").isNotNull()).dropDuplicates(["id", "sha"]).select("packed")
    alone = flagged.filter(~F.col("maybe")).select("packed").unionByName(joined.filter(F.col("kept").isNull()).select("packed"))
    return alone.unionByName(once).select("packed.*")
