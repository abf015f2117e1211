"""Choices and chains over edge tables: independent sets, and merges of merges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylane.session import cut


def independent_set(nodes: DataFrame, edges: DataFrame, key: str = "id", score: str = "score", a: str = "a", b: str = "b") -> DataFrame:
    """The nodes that a walk from the best score down takes, if it skips those next to one already taken.

    Each round takes all nodes that are better than all their undecided neighbours, and drops these
    neighbours; that gives what the walk gives. Ties of score go to the smaller key, null scores
    come last. Edges have no direction; loops, repeated edges and edges to keys that are no nodes
    don't count, and a repeated key is one node with its best score. Correlation need not be
    transitive: with a-b and b-c, a and c may both be taken. A round halves the undecided edges as
    a rule; a chain of ever worse neighbours takes one for each two nodes.
    """
    own = nodes.filter(F.col(key).isNotNull()).groupBy(F.col(key).alias("node")).agg(F.max(score).alias("score"))
    left = cut(own, "nodes")
    rank = lambda side: left.select(F.col("node").alias(side), F.struct(F.col("score").isNull().alias("none"), (-F.col("score")).alias("score"), F.col("node")).alias(f"{side}_rank"))
    pairs = edges.select(F.col(a).alias("x"), F.col(b).alias("y")).filter("x <> y")
    ranked = pairs.join(rank("x"), "x").join(rank("y"), "y")
    first = F.col("x_rank") < F.col("y_rank")
    links = cut(ranked.select(F.when(first, F.col("x")).otherwise(F.col("y")).alias("better"), F.when(first, F.col("y")).otherwise(F.col("x")).alias("worse")).distinct(), "links")
    taken = []
    while True:
        best = cut(left.join(links.select(F.col("worse").alias("node")).distinct(), "node", "left_anti"), "best")
        taken.append(best)
        if links.isEmpty():
            break
        gone = cut(links.join(best.select(F.col("node").alias("better")), "better", "left_semi").select(F.col("worse").alias("node")).distinct(), "gone")
        decided = best.select("node").unionByName(gone)
        left = cut(left.join(decided, "node", "left_anti"), "nodes")
        for side in ("worse", "better"):
            links = links.join(decided.select(F.col("node").alias(side)), side, "left_anti")
        links = cut(links.select("better", "worse"), "links")
    out = taken[0]
    for more in taken[1:]:
        out = out.unionByName(more)
    return out.select(F.col("node").alias(key), F.col("score").alias(score))


def last_successors(marks: DataFrame, key: str = "id", of: str = "of") -> DataFrame:
    """Follows merges (id, of) to their end: key, last, hops, cycle.

    ``last`` is the id at the end of the chain and ``hops`` the steps to it. An id whose chain runs into
    a cycle has neither; ``cycle`` is then the cycle's smallest id, and ``in_cycle`` says whether the id
    is on it. An id with several successors follows the smallest; a mark to itself is a cycle of
    one, and null ids or successors are no marks. Pointers double, so a chain of n takes log n rounds,
    and only ids that haven't arrived are joined.
    """
    first = marks.filter(F.col(key).isNotNull() & F.col(of).isNotNull()).groupBy(F.col(key).alias("id")).agg(F.min(of).alias("to"))
    first = cut(first, "marks")
    ends = first.select("to").distinct().join(first.select(F.col("id").alias("to")), "to", "left_anti").withColumn("end", F.lit(True))
    pointers = first.join(ends, "to", "left").select("id", "to", F.lit(1).cast("long").alias("hops"), F.least("id", "to").alias("least"), F.coalesce("end", F.lit(False)).alias("done"))
    pointers = cut(pointers, "pointers")
    for _ in range(first.count().bit_length()):
        moving = pointers.filter("not done")
        if moving.isEmpty():
            break
        there = pointers.select(F.col("id").alias("to"), F.col("to").alias("on"), F.col("hops").alias("more"), F.col("least").alias("lower"), "done")
        moved = moving.drop("done").join(there, "to").select("id", F.col("on").alias("to"), (F.col("hops") + F.col("more")).alias("hops"), F.least("least", "lower").alias("least"), "done")
        pointers = cut(pointers.filter("done").unionByName(moved), "pointers")
    # what hasn't arrived after as many steps as there are ids points into a cycle, and the cycle's ids point at all of it
    astray = pointers.filter("not done")
    on_cycle = astray.select(F.col("to").alias("id")).distinct().withColumn("in_cycle", F.lit(True))
    least = pointers.select(F.col("id").alias("to"), F.col("least").alias("cycle"))
    lost = astray.join(least, "to").join(on_cycle, "id", "left")
    nothing = lambda c: F.lit(None).cast(first.schema[c].dataType)
    lost = lost.select("id", nothing("to").alias("last"), F.lit(None).cast("long").alias("hops"), "cycle", F.coalesce("in_cycle", F.lit(False)).alias("in_cycle"))
    found = pointers.filter("done").select("id", F.col("to").alias("last"), "hops", nothing("id").alias("cycle"), F.lit(False).alias("in_cycle"))
    return found.unionByName(lost).withColumnRenamed("id", key)
