"""Mixing sources to target weights by Pareto order sampling.

Each document of a source has its own expected copies: a price of the source times the fourth root
of the document's size in words, as longer documents hold more running text, and at most
MOST_COPIES. The price is set so that the expected words are the source's target. The whole part of
a document's expected copies is certain; what is over is its inclusion probability p for one copy
more. One sample for each source fills the words that the certain copies leave: its documents are
ranked by random odds u / (1 - u) over inclusion odds p / (1 - p) and taken in that order while they
fit. The sample's size is fixed in words, as sources are: where the next document is too long, PASSES
go on behind it with those that still fit.

The last rank taken comes from a histogram of the ranks; only the bin that it is in is ordered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrylane.llm.common import WORD, Workspace, attach, text_of

WEIGHTS = (5, 2, 1)
MOST_COPIES = 3
#: Bins of a source's ranks, and how often the sample goes on behind a document that is too long.
BINS, PASSES = 1 << 12, 3
#: Tables of up to so many sources are broadcast; of larger ones only the sources with many rows.
SMALL = 100_000


def source_targets(sizes: DataFrame, work: Workspace, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_COPIES) -> DataFrame:
    """source, source_size, target from (source, source_size): one row per source.

    Sources by code point, null last, take the weights in turn and share the sum of all sizes.
    No target passes ``most`` times its source's size; what is over is shared again by weight.
    The fixed point has one price: target = min(most * size, price * weight). From the price
    without caps, each round leaves the sources out that are above their cap at the price before
    it, until no more are. Sources are dealt by ranges of their order and places counted from
    the numbers of the ranges before, so that no task holds all of them.
    """
    last = F.col("source").isNull()
    dealt = work.stash(sizes.select("source", "source_size").repartitionByRange(last, "source").withColumn("task", F.spark_partition_id()), "dealt")
    counts = dealt.groupBy("task").agg(F.count("*").alias("n"))  # a row for each task
    before = F.sum("n").over(Window.orderBy("task").rowsBetween(Window.unboundedPreceding, -1))
    counts = counts.select("task", F.coalesce(before, F.lit(0)).alias("before"))
    own = F.row_number().over(Window.partitionBy("task").orderBy(last, "source"))
    turn = (F.col("before") + own - 1) % len(weights)
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (turn + 1).cast("int"))
    caps = dealt.join(F.broadcast(counts), "task").select("source", "source_size", w.alias("weight"), (F.col("source_size") * F.lit(float(most))).alias("cap"))
    caps = work.stash(caps, "caps")
    total, shares = caps.agg(F.coalesce(F.sum("source_size"), F.lit(0)).cast("double"), F.coalesce(F.sum("weight"), F.lit(0.0))).first()
    price, capped = total / shares if shares else 0.0, (0.0, 0.0)
    while True:
        over = caps.filter(F.col("cap") < F.lit(price) * F.col("weight")).agg(F.coalesce(F.sum("cap"), F.lit(0.0)), F.coalesce(F.sum("weight"), F.lit(0.0))).first()
        if tuple(over) == capped:
            break
        capped = tuple(over)
        price = (total - capped[0]) / (shares - capped[1]) if capped[1] < shares else float("inf")
    return caps.select("source", "source_size", F.least("cap", F.lit(price) * F.col("weight")).alias("target"))


def uniform(identifier: Column, text: Column, seed: int) -> Column:
    """A reproducible number in (0, 1) from 52 bits of a hash of id and text."""
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(identifier.cast("string"), F.lit("")), F.md5(text.cast("binary"))).cast("binary"))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) * F.lit(2.0**-52)


def _key(source: Column) -> Column:
    """A source as a join key that is never null."""
    return F.when(source.isNull(), "").otherwise(F.concat(F.lit("="), source.cast("string")))


def _measured(docs: DataFrame, id_col: str, text_col: str, source_col: str, seed: int, *more: Column) -> DataFrame:
    """key, doc_id, source, size in words and draw of each row."""
    text, identifier, source = text_of(text_col), F.col(id_col), F.col(source_col)
    size = F.regexp_count(text, F.lit(WORD)).cast("long")
    return docs.select(_key(source).alias("key"), identifier.alias("doc_id"), source.alias("source"), size.alias("size"), uniform(identifier, text, seed).alias("u"), *more)


def _with_rank(rows: DataFrame, most: int) -> DataFrame:
    """Adds certain copies, the rank in (0, 1) that odds over odds give, and its bin; rows have the price."""
    copies = F.when(F.col("size") > 0, F.least(F.lit(float(most)), F.coalesce(F.col("price") * F.sqrt(F.sqrt("size")), F.lit(float(most))))).otherwise(0.0)
    rows = rows.withColumn("expected", copies).withColumn("whole", F.floor("expected"))
    p = F.col("expected") - F.col("whole")
    ratio = (F.col("u") / (1 - F.col("u"))) / (p / (1 - p))
    rows = rows.withColumn("rank", F.when(p > 0, ratio / (1 + ratio)))
    return rows.withColumn("bin", F.least(F.floor(F.col("rank") * BINS), F.lit(BINS - 1)))


def _taken(k: int) -> Column:
    """Is the row in the sample after k passes?"""
    out = F.lit(False)
    for i in range(k):
        before = (F.col("bin") < F.col(f"bin{i}")) | ((F.col("bin") == F.col(f"bin{i}")) & (F.col("rank") <= F.col(f"rank{i}")))
        out = out | (before & (F.col("size") <= F.col(f"left{i}")))
    return F.coalesce(out, F.lit(False))


def _join(rows: DataFrame, sources: DataFrame, n_sources: int) -> DataFrame:
    """Rows with their source's record, whatever the number of sources and their sizes."""
    if n_sources <= SMALL:
        return rows.join(F.broadcast(sources.drop("rows")), "key")
    total = sources.agg(F.sum("rows").alias("n")).first().n
    return attach(rows, sources, "key", "rows", total).drop("rows")


def _plan(rows: DataFrame, work: Workspace, weights: tuple[int, ...], most: int) -> tuple[DataFrame, int]:
    """key, rows, source_size, target, price and each pass's bin, rank and words left; the number of sources."""
    by_size = work.stash(rows.groupBy("key", "source", "size").agg(F.count("*").alias("n")), "sizes")
    per_source = by_size.groupBy("source").agg(F.sum(F.col("n") * F.col("size")).alias("source_size"), F.sum("n").alias("rows"))
    per_source = work.stash(per_source, "sources")
    targets = source_targets(per_source, work, weights, most).withColumn("key", _key(F.col("source"))).drop("source")
    targets = work.stash(targets.join(per_source.select(_key(F.col("source")).alias("key"), "rows"), "key"), "targets")

    # the price: from the longest document down, the first that stays below ``most`` if all longer ones get ``most``
    upto = Window.partitionBy("key").orderBy("size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    words, root = F.col("n") * F.col("size"), F.sqrt(F.sqrt("size"))
    sized = by_size.filter("size > 0").drop("source").join(targets, "key")
    sized = sized.withColumn("try", (F.col("target") - most * (F.col("source_size") - F.sum(words).over(upto))) / F.sum(words * root).over(upto))
    prices = sized.groupBy("key").agg(F.max(F.when(F.col("try") * root <= most, F.struct("size", "try"))).alias("first")).select("key", F.col("first.try").alias("price"))
    plan = targets.join(prices, "key", "left")
    certain = _with_rank(by_size.drop("source").withColumn("u", F.lit(0.5)).join(plan.select("key", "price"), "key"), most)
    certain = certain.groupBy("key").agg(F.sum(F.col("whole") * F.col("n") * F.col("size")).alias("certain"))
    plan = plan.join(certain, "key", "left").withColumn("left0", F.col("target") - F.coalesce("certain", F.lit(0))).drop("certain")
    plan = work.stash(plan, "plan")
    n_sources = plan.count()
    for k in range(PASSES):
        # left: words that the sample still wants; all documents fit before the first pass
        want = F.col(f"left{k}")
        plan = plan.withColumn("want", want) if k else plan.withColumn("want", want).withColumn("left0", F.lit(float("inf")))
        ranked = _with_rank(_join(rows, plan, n_sources), most).filter(F.col("rank").isNotNull() & ~_taken(k) & (F.col("size") <= F.col(f"left{k}")))
        order = Window.partitionBy("key").orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        bins = ranked.groupBy("key", "bin").agg(F.sum("size").alias("words")).withColumn("upto", F.sum("words").over(order))
        bins = bins.join(plan.select("key", "want"), "key")
        over = F.col("upto") > F.col("want")
        ends = bins.groupBy("key").agg(F.min(F.when(over, F.struct("bin", "upto", "words"))).alias("first"), F.max("upto").alias("all"))
        ends = ends.select("key", F.coalesce("first.bin", F.lit(BINS)).alias(f"bin{k}"), F.coalesce(F.col("first.upto") - F.col("first.words"), F.col("all")).alias("before"))
        plan = work.stash(plan.join(ends, "key", "left"), "plan")
        # of the bin that the last rank is in, the documents that still fit; equal ranks stay together
        inside = _with_rank(_join(rows, plan, n_sources), most).filter(F.col("rank").isNotNull() & ~_taken(k) & (F.col("size") <= F.col(f"left{k}")) & (F.col("bin") == F.col(f"bin{k}")))
        order = Window.partitionBy("key").orderBy("rank").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        inside = inside.groupBy("key", "rank").agg(F.sum("size").alias("words"), F.first("want").alias("want"), F.first("before").alias("before"))
        inside = inside.withColumn("upto", F.col("before") + F.sum("words").over(order)).filter("upto <= want")
        last = inside.groupBy("key").agg(F.max("rank").alias(f"rank{k}"), F.max("upto").alias("reached"))
        plan = plan.join(last, "key", "left").withColumn(f"rank{k}", F.coalesce(f"rank{k}", F.lit(-1.0)))
        plan = plan.withColumn(f"left{k + 1}", F.col("want") - F.coalesce("reached", "before", F.lit(0)))
        plan = work.stash(plan.drop("want", "before", "reached"), "plan")
    return plan, n_sources


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, most: int = MOST_COPIES, seed: int = 10) -> DataFrame:
    """One row per input row: doc_id, source, size, source_size, target, expected, copies, taken.

    ``size`` counts words (null text: 0), ``taken`` is copies times size, ``expected`` the copies
    that the document gets on average. Null sources are one source, the last. Documents without
    words are never taken. The same rows give the same mix: randomness is a hash of id and text.
    Rows equal in id and text have one rank, so beyond whole copies they are all taken or none. An
    empty table gives no rows; other columns are not looked at.
    """
    work = Workspace(docs.sparkSession, "mix")
    rows = work.stash(_measured(docs, id_col, text_col, source_col, seed), "rows")
    plan, n_sources = _plan(rows, work, weights, most)
    out = _with_rank(_join(rows, plan, n_sources), most).withColumn("copies", F.col("whole") + _taken(PASSES).cast("long"))
    return out.select("doc_id", "source", "size", "source_size", "target", "expected", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def mixed_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, most: int = MOST_COPIES, seed: int = 10) -> DataFrame:
    """The mix itself: each document's row as many times as ``mix`` takes it, with all its columns.

    Rows are compared with their source's last ranks where they are; texts don't shuffle. Documents
    without words have no part in the mix. Columns may have any names.
    """
    work = Workspace(docs.sparkSession, "mix")
    rows = work.stash(_measured(docs, id_col, text_col, source_col, seed), "rows")
    plan, n_sources = _plan(rows, work, weights, most)
    packed = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("packed")
    again = _with_rank(_join(_measured(docs, id_col, text_col, source_col, seed, packed), plan, n_sources), most)
    copies = (F.col("whole") + _taken(PASSES).cast("long")).cast("int")
    return again.select("packed", F.explode(F.array_repeat(F.lit(1), copies)).alias("copy")).select("packed.*")
