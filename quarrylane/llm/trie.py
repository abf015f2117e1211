"""A prefix trie of conversations by partition refinement.

All conversations start in one class. Each round reads a block of the next turns and splits the
active classes turn by turn; blocks double, so a shared beginning of n turns takes about log n
rounds, and a conversation is compared over at most twice the turns that it shares. A class of one
conversation is retired: the rest of it is a chain of nodes, known from its length alone. The
figures of subtrees are then folded back.

A node is named by its smallest conversation and its depth. The nodes that one conversation names
are a path downwards, which hangs on a node of a smaller conversation; fold-back sums within paths
and carries each path's total to the node it hangs on, the lowest paths first.

Texts are read once, to digests of 128 bits; only these, ids and numbers move. No class is ever
gathered: members learn their new class from a record for each class (``attach``).
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrylane.llm.common import Workspace, attach, text_of

#: Blocks of positions 1, 2-3, 4-7 and so on double up to this many, and have this many from there on.
WIDEST = 256
#: Members of a shared base conversation have ids from it up to this.
GROUP = 5
HEADS = 9
NOTHING = hashlib.sha256(b"").hexdigest()


def block_start(block: int) -> int:
    doubled = WIDEST.bit_length() - 1
    return 1 << block if block <= doubled else WIDEST * (block - doubled + 1)


def block_of(position: Column) -> Column:
    doubled = WIDEST.bit_length() - 1
    bits = F.length(F.bin(position)) - 1
    return F.when(position < WIDEST, bits).otherwise(doubled + F.floor((position - WIDEST) / WIDEST)).cast("int")


def digest(text: Column) -> Column:
    return F.substring(F.sha2(text, 256), 1, 32)


def _places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the task's number and each row's place among the task's rows of its conversation, which come in order."""
    task, last, seen = TaskContext.get().partitionId(), None, 0
    for batch in batches:
        ids = batch.column("conv_id").to_numpy()
        if not len(ids):
            continue
        starts = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]]))
        place = np.arange(1, len(ids) + 1) - np.repeat(starts, np.diff(starts, append=len(ids)))
        if ids[0] == last:
            place[: starts[1] if len(starts) > 1 else len(ids)] += seen
        last, seen = ids[-1], int(place[-1])
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("conv_id", "key", "size")), pa.array(np.full(len(ids), task), pa.int32()), pa.array(place, pa.int64())], names=["conv_id", "key", "size", "task", "place"])


def positions(ws: Workspace, conversations: DataFrame) -> DataFrame:
    """conv_id, pos (from 1), key and size: a digest of role and text, and the text's bytes.

    Turns are dealt by ranges of (conv_id, turn), so a conversation may be in several tasks; a
    task's first place is what the tasks before it hold of the conversation. Only a task's first
    conversation can have begun before, so the table of these is as small as the number of tasks.
    """
    role, text = text_of("role"), text_of("text")
    key = digest(F.concat(F.length(role).cast("string"), F.lit(":"), role, text))
    rows = conversations.filter("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", role.alias("role"), key.alias("key"), F.octet_length(text).cast("long").alias("size"))
    order = ["conv_id", "turn", "role", "key"]
    local = ws.stash(rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_places, "conv_id long, key string, size long, task int, place long"), "places")
    counts = local.groupBy("conv_id", "task").agg(F.count("*").alias("n"))
    parts = F.count("*").over(Window.partitionBy("conv_id"))
    before = F.sum("n").over(Window.partitionBy("conv_id").orderBy("task").rowsBetween(Window.unboundedPreceding, -1))
    begun = counts.withColumns({"parts": parts, "before": before}).filter("parts > 1 and before is not null").select("conv_id", "task", "before")
    joined = local.join(F.broadcast(begun), ["conv_id", "task"], "left")
    return joined.select("conv_id", (F.col("place") + F.coalesce("before", F.lit(0))).alias("pos"), "key", "size")


def rebuilt(ws: Workspace, conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conversations (conv_id, len) and their turns in blocks (conv_id, block, turns), rebuilt.

    The first h turns are those of the base conversation (the next multiple of GROUP downwards), as
    many as it has; then the conversation's own turns after its first h. h is the CRC-32 of the id by HEADS.
    """
    turns = ws.stash(positions(ws, conversations), "turns")
    lengths = turns.groupBy("conv_id").agg(F.count("*").alias("own"))
    base, h = F.col("conv_id") - F.pmod("conv_id", F.lit(GROUP)), F.crc32(F.col("conv_id").cast("string")) % HEADS
    known = lengths.select("conv_id", "own", base.alias("base"), h.alias("h")).join(lengths.select(F.col("conv_id").alias("base"), F.col("own").alias("there")), "base", "left")
    known = known.withColumn("heads", F.least("h", F.coalesce("there", F.lit(0))))
    convs = ws.stash(known.select("conv_id", "base", "h", "heads", "own", (F.col("heads") + F.greatest(F.col("own") - F.col("h"), F.lit(0))).alias("len")), "conversations")
    total = convs.agg(F.coalesce(F.sum("own"), F.lit(0))).first()[0]
    own = attach(turns, convs.select("conv_id", "h", "heads", "own"), "conv_id", "own", total).filter("pos > h")
    own = own.select("conv_id", (F.col("pos") - F.col("h") + F.col("heads")).alias("pos"), "key", "size")
    first = turns.filter(F.col("pos") < HEADS).withColumnRenamed("conv_id", "base").join(convs.filter("heads > 0").select("conv_id", "base", "heads"), "base")
    both = own.unionByName(first.filter("pos <= heads").select("conv_id", "pos", "key", "size"))
    blocks = both.groupBy("conv_id", block_of(F.col("pos")).alias("block")).agg(F.array_sort(F.collect_list(F.struct("pos", "key", "size"))).alias("turns"))
    path = f"{ws.folder}/blocks"
    blocks.write.partitionBy("block").parquet(path)
    return convs.select("conv_id", "len"), ws.spark.read.schema("conv_id long, turns array<struct<pos:long,key:string,size:long>>, block int").parquet(path)


def refine(ws: Workspace, convs: DataFrame, blocks: DataFrame, root: int) -> tuple[DataFrame, DataFrame]:
    """Nodes under the root that hold several conversations, or are where one alone goes on; and ends.

    Nodes: node (the smallest conversation), depth, parent, n, size (bytes of the last text), len (turns of
    the longest). Ends: conversations that have no more turns at a node of several: node, depth, conv_id.
    """
    state = convs.select("conv_id", "len", F.lit(root).alias("cls"), F.lit(0).cast("long").alias("depth"))
    found, ends = [], [state.filter("len = depth")]
    for block in itertools.count():
        depth = block_start(block) - 1
        turns = blocks.filter(F.col("block") == block).select("conv_id", "turns")
        names = F.transform("turns", lambda t, i: digest(F.concat_ws(":", F.col("cls"), F.lit(depth), F.array_join(F.transform(F.slice("turns", 1, i + 1), lambda x: x["key"]), ""))))
        moving = state.filter("len > depth").join(turns, "conv_id").withColumn("names", names)
        steps = F.transform("turns", lambda t, i: F.struct(t["pos"].alias("depth"), F.get("names", i).alias("name"), F.get("names", i - 1).alias("before"), t["size"].alias("size")))
        moving = ws.stash(moving.select("conv_id", "len", "cls", steps.alias("steps")), "moving")
        grouped = moving.select("conv_id", "len", "cls", F.explode("steps").alias("s")).groupBy("s.name").agg(
            F.min("conv_id").alias("node"), F.count("*").alias("n"), F.first("s.before").alias("before"), F.first("s.depth").alias("depth"), F.first("cls").alias("cls"), F.first("s.size").alias("size"), F.max("len").alias("len")
        )
        grouped = ws.stash(grouped, "classes")
        several = grouped.filter("n > 1")
        total = several.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
        first = grouped.filter("before is null").withColumn("parent", F.col("cls"))
        later = attach(grouped.filter("before is not null"), several.select(F.col("name").alias("before"), F.col("node").alias("parent"), F.col("n").alias("held")), "before", "held", total)
        found.append(first.unionByName(later.drop("held")).select("node", "depth", "parent", "n", "size", "len"))
        last = moving.select("conv_id", "len", F.element_at("steps", -1)["name"].alias("name"))
        state = ws.stash(attach(last, several.select("name", F.col("node").alias("cls"), "depth", "n"), "name", "n", total).select("conv_id", "len", "cls", "depth"), "members")
        ends.append(state.filter("len = depth"))
        if state.filter("len > depth").isEmpty():
            break
    union = lambda frames: ws.stash(frames[0] if len(frames) == 1 else frames[0].unionByName(union_all(frames[1:])), "refined")
    return union(found), union([e.select(F.col("cls").alias("node"), "depth", "conv_id") for e in ends])


def union_all(frames: list[DataFrame]) -> DataFrame:
    return frames[0] if len(frames) == 1 else frames[0].unionByName(union_all(frames[1:]))


def fold_back(ws: Workspace, nodes: DataFrame) -> DataFrame:
    """Adds n_leaves and saved_tokens of the subtree to nodes with their own ``leaves`` and ``saved``."""
    done, rest = [], nodes
    upwards = Window.partitionBy("node").orderBy(F.col("depth").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    while True:
        bearing = rest.filter("parent <> node").select(F.col("parent").alias("node")).distinct()
        summed = rest.join(bearing, "node", "left_anti").withColumns({"n_leaves": F.sum("leaves").over(upwards), "saved_tokens": F.sum("saved").over(upwards)})
        summed = ws.stash(summed.drop("leaves", "saved"), "folded")
        done.append(summed)
        up = summed.filter("parent <> node").groupBy(F.col("parent").alias("node"), (F.col("depth") - 1).alias("depth")).agg(F.sum("n_leaves").alias("more_leaves"), F.sum("saved_tokens").alias("more_saved"))
        rest = rest.join(bearing, "node", "left_semi").join(up, ["node", "depth"], "left")
        rest = rest.withColumns({"leaves": F.col("leaves") + F.coalesce("more_leaves", F.lit(0)), "saved": F.col("saved") + F.coalesce("more_saved", F.lit(0))}).drop("more_leaves", "more_saved")
        rest = ws.stash(rest, "rest")
        if rest.isEmpty():
            return union_all(done)


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 over the comma-joined lists of a node, which come in order; a node's lists are never held together."""
    held, state = None, hashlib.sha256()
    for batch in batches:
        out = []
        for node, depth, ids in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if held == (node, depth):
                state.update(b"," + ids.encode())
            else:
                if held:
                    out.append((*held, state.hexdigest()))
                held, state = (node, depth), hashlib.sha256(ids.encode())
        yield _named(out)
    yield _named([(*held, state.hexdigest())] if held else [])


def _named(rows: list[tuple[int, int, str]]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [(), (), ()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int64(), pa.string()), strict=True)], names=["node", "depth", "ends_sha256"])


def ends_digests(ends: DataFrame) -> DataFrame:
    """node, depth, ends_sha256: the conversations that end at a node, by lists of at most 256 neighbouring ids."""
    ids = F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda i: i.cast("string")), ",")
    lists = ends.groupBy("node", "depth", F.shiftright("conv_id", 8).alias("part")).agg(ids.alias("ids"))
    ordered = lists.repartition("node", "depth").sortWithinPartitions("node", "depth", "part").select("node", "depth", "ids")
    return ordered.mapInArrow(_hashed, "node long, depth long, ends_sha256 string")


def trie(conversations: DataFrame) -> DataFrame:
    """One row per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    Input: conv_id, turn, role, text; other columns don't matter. Turns go by turn (null first), ties
    by role, then by a digest; repeated rows are repeated turns. A null role or text is empty. Rows
    without a conv_id are no conversation's. An empty table gives no rows, not even a root. Texts
    of any length are digested where they are read.
    """
    spark = conversations.sparkSession
    ws = Workspace(spark, "trie")
    convs, blocks = rebuilt(ws, conversations)
    root, count = convs.agg(F.min("conv_id"), F.count("*")).first()
    long, none = (lambda c: F.lit(c).cast("long")), F.lit(None).cast("long")
    if count < 2:
        chains = convs.select(F.col("conv_id").alias("node"), long(0).alias("depth"), none.alias("parent"), "len")
        return _chains(chains)
    children, ends = refine(ws, convs, blocks, root)
    below = children.groupBy(F.col("parent").alias("node"), (F.col("depth") - 1).alias("depth")).agg(F.count("*").alias("n_children"), F.count_if(F.col("n") == 1).alias("alone"))
    top = spark.range(1).select(long(root).alias("node"), long(0).alias("depth"), none.alias("parent"), long(count).alias("n"), long(0).alias("size"))
    nodes = top.unionByName(children.filter("n > 1").drop("len")).join(below, ["node", "depth"], "left").fillna(0, ["n_children", "alone"])
    leaves = F.col("alone") + F.when(F.col("n_children") == 0, 1).otherwise(0)
    nodes = ws.stash(nodes.select("node", "depth", "parent", "n", "n_children", leaves.cast("long").alias("leaves"), ((F.col("n") - 1) * F.col("size")).alias("saved")), "nodes")
    shared = fold_back(ws, nodes).join(ends_digests(ends), ["node", "depth"], "left")
    shared = shared.select(F.col("node").alias("conv_id"), "depth", F.col("parent").alias("parent_conv_id"), F.col("n").alias("n_convs"), "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(NOTHING)).alias("ends_sha256"))
    return shared.unionByName(_chains(children.filter("n = 1").select("node", "depth", "parent", "len")))


def _chains(alone: DataFrame) -> DataFrame:
    """The nodes of conversations that are alone from (node, depth) on: one for each further turn."""
    each = alone.select("node", F.col("depth").alias("from"), "parent", "len", F.explode(F.sequence("depth", "len")).alias("depth"))
    last, long = F.col("depth") == F.col("len"), (lambda c: F.lit(c).cast("long"))
    return each.select(
        F.col("node").alias("conv_id"), "depth", F.when(F.col("depth") == F.col("from"), F.col("parent")).otherwise(F.col("node")).alias("parent_conv_id"), long(1).alias("n_convs"),
        F.when(last, long(0)).otherwise(long(1)).alias("n_children"), long(1).alias("n_leaves"), long(0).alias("saved_tokens"), F.when(last, F.sha2(F.col("node").cast("string"), 256)).otherwise(NOTHING).alias("ends_sha256"),
    )
