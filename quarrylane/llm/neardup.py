"""Near duplicates: circulant MinHash, banding, exact verification, connected components.

Signature. One permutation of the 64-bit shingle hashes scatters them, a second one gives every
coordinate: coordinate k is the least value of the second permutation over the scattered hashes
shifted circularly by k. BANDS bands of ROWS coordinates find a pair of similarity 0.8 with
probability 1 - (1 - 0.8 ** 4) ** 24, so one pair in 300,000 at the threshold itself is missed.

Verification without all pairs of a bucket. Documents with one shingle set are one node. In each
bucket the node with most bucket mates, the hub, is compared with all others on full sets. Pairs
of one component need no further comparison. For two others x and y, common shingles lie in the
hub or not, so |x & y| <= min(|x & hub|, |y & hub|) + |(x & y) - hub|. Hence x and y can only be
linked if

* they share a shingle outside the hub. Bucket and shingle make a smaller bucket, a list; a list whose
  members are of one component is no use to anyone. Let a set's other lists be ordered from short to
  long: at the first one that x and y share, all that they share is still to come, so |(x & y) - hub|
  is at most the lesser of the numbers of lists that either has from there on. A set stays in a list
  only if |x & hub| and that number reach num / den of its size, so that long lists lose most
  members, and a pair meets only where the bound lets it be linked; or
* min(|x & hub|, |y & hub|) alone suffices, which only holds for x + y <= min * (1 + T) / T; a join
  on classes of sizes and of the room that this leaves for the other's size finds those pairs.

All first buckets with one hub are one bucket, so a set's shingles are carried on once for each
hub it meets (about one), not for each band. Lists of up to FEW members are compared in full; in
wider ones, while PAIRS allows it, members meet by those classes too, as each further round carries
shingles anew; the largest get hubs of their own in the next round, until no bucket holds two components.
Those that come from one bucket and choose the same hub are one bucket again; it is a part of that
bucket and lacks the hub, so from there on buckets only shrink and rounds come to an end.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarrylane.llm import bloom
from quarrylane.llm.common import HOT_SHARE, Workspace, attach, give_back, portions, stash, text_of

BANDS, ROWS = 24, 4
#: Members of a bucket that are compared without another hub.
FEW = 50
#: Buckets beyond FEW need no hub either, up to FEW << WIDER members, while their pairs of a member
#: that isn't linked to the hub and any other are at most this many for each document.
PAIRS, WIDER = 100, 6
#: Partners of a set that one task compares with it.
PARTNERS = 250
#: Elements of a batch that numpy works on at once.
BLOCK = 1 << 16


def mix64(x: np.ndarray) -> np.ndarray:
    """A permutation of the 64-bit integers."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def permute32(x: np.ndarray) -> np.ndarray:
    """The second permutation, of the 32-bit integers; in place."""
    x ^= x >> np.uint32(16)
    x *= np.uint32(0x7FEB352D)
    x ^= x >> np.uint32(15)
    x *= np.uint32(0x846CA68B)
    x ^= x >> np.uint32(16)
    return x


def shingle_sets(texts: list[str | None], width: int) -> list[np.ndarray]:
    """The sorted distinct 64-bit hashes of each text's word shingles."""
    words = [(t or "").encode().lower().split() for t in texts]
    flat = [w for ws in words for w in ws]
    hashes = pd.util.hash_array(np.array(flat, dtype=object)) if flat else np.zeros(0, np.uint64)
    sets, at, p = [], 0, np.uint64(0x9E3779B97F4A7C15)
    for ws in words:
        h, at = hashes[at : at + len(ws)], at + len(ws)
        n = min(width, len(ws))
        if n:
            s = np.full(len(h) - n + 1, n, np.uint64)
            for i in range(n):
                s = mix64(s * p + h[i : len(h) - n + 1 + i])
            sets.append(np.unique(s))
        else:
            sets.append(np.zeros(0, np.uint64))
    return sets


def signatures(sets: list[np.ndarray], bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """Circulant MinHash of non-empty sets: one 64-bit key for each set and band."""
    sizes = np.array([len(s) for s in sets])
    out = np.empty((len(sets), bands * rows), np.uint32)
    first = 0
    while first < len(sets):
        last = first + max(1, int(np.searchsorted(np.cumsum(sizes[first:]), BLOCK)))
        starts = np.concatenate([[0], np.cumsum(sizes[first:last])[:-1]])
        scattered = (mix64(np.concatenate(sets[first:last])) >> np.uint64(32)).astype(np.uint32)
        for k in range(bands * rows):
            out[first:last, k] = np.minimum.reduceat(permute32(scattered + np.uint32(k)), starts)
        first = last
    keys = np.empty((len(sets), bands), np.uint64)
    for b in range(bands):
        key = np.full(len(sets), b + 1, np.uint64)
        for r in range(rows):
            key = mix64(key * np.uint64(0x9E3779B97F4A7C15) + out[:, b * rows + r])
        keys[:, b] = key
    return keys


def fingerprint(s: np.ndarray) -> str:
    return xxhash.xxh3_128_hexdigest(s.tobytes())


def _sign(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions(batches, 1):
            sets = shingle_sets(batch.column(1).to_pylist(), width)
            full = [i for i, s in enumerate(sets) if len(s)]
            bands: list = [None] * len(sets)
            for i, row in zip(full, signatures([sets[i] for i in full]).view(np.int64) if full else [], strict=True):
                bands[i] = row
            prints = [fingerprint(s) if len(s) else None for s in sets]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(prints, pa.string()), pa.array(bands, pa.list_(pa.int64()))], names=["doc_id", "n_shingles", "print", "bands"])
        give_back()

    return run


def _sets(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions(batches, 0):
            sets = shingle_sets(batch.column(0).to_pylist(), width)
            yield pa.RecordBatch.from_arrays([pa.array([fingerprint(s) if len(s) else "" for s in sets]), pa.array([np.sort(s.view(np.int64)) for s in sets], pa.list_(pa.int64()))], names=["print", "shingles"])
        give_back()

    return run


def components(edges: DataFrame, work: Workspace) -> DataFrame:
    """node, comp (the least node that is reachable) for the nodes of an edge table (a, b).

    Each round takes the least label among a node's neighbours and then that node's own label, so
    chains shorten by halves. Labels are rewritten to the shared folder in each round.
    """
    both = work.stash(edges.select("a", "b").union(edges.select("b", "a")).distinct(), "edges")
    labels = work.stash(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("a")).alias("comp")), "labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "comp"), "b").groupBy(F.col("a").alias("node")).agg(F.min("comp").alias("near"))
        better = labels.join(near, "node").select("node", F.least("comp", "near").alias("next"), F.col("comp").alias("old"))
        jump = labels.select(F.col("node").alias("next"), F.col("comp").alias("far"))
        moved = work.stash(better.join(jump, "next").select("node", F.least("next", "far").alias("comp"), "old"), "labels")
        changed = moved.filter("comp < old").limit(1).count()
        labels = moved.select("node", "comp")
        if not changed:
            return labels


def merge(labels: DataFrame | None, links: DataFrame, work: Workspace) -> DataFrame:
    """Components after more links: only links between different components are walked again."""
    if labels is None:
        return components(links, work)
    ends = links
    for end in ("a", "b"):
        known = labels.select(F.col("node").alias(end), F.col("comp").alias(f"{end}_comp"))
        ends = ends.join(known, end, "left")
    across = ends.select(F.coalesce("a_comp", "a").alias("a"), F.coalesce("b_comp", "b").alias("b")).filter("a <> b").distinct()
    across = work.stash(across, "across")
    if not across.limit(1).count():
        return labels
    moved = components(across, work)
    new = moved.join(labels.select("node"), "node", "left_anti")
    old = labels.join(moved.select(F.col("node").alias("comp"), F.col("comp").alias("to")), "comp", "left")
    return work.stash(old.select("node", F.coalesce("to", "comp").alias("comp")).unionByName(new.select("node", "comp")), "labels")


def _with_comp(rows: DataFrame, labels: DataFrame | None) -> DataFrame:
    if labels is None:
        return rows.withColumn("comp", F.col("node"))
    return rows.join(labels, "node", "left").withColumn("comp", F.coalesce("comp", "node"))


def _open(members: DataFrame, work: Workspace, sift: bool = False) -> DataFrame:
    """Members of buckets that hold two components or more, with the bucket's size m.

    ``sift``: few members are expected to be of such buckets; a filter keeps the others from shuffling again.
    """
    kinds = work.stash(members.groupBy("key").agg(F.count("*").alias("m"), F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo < hi").select("key", "m"), "open")
    count, total = kinds.agg(F.count("*"), F.coalesce(F.sum("m"), F.lit(0))).first()
    if sift:
        log2 = bloom.log_bits(count)
        bitmaps = bloom.build(kinds, "key", log2)
        members = work.stash(bloom.flag(members, F.col("key"), bitmaps, log2, "maybe").filter("maybe").drop("maybe"), "maybe")
    return attach(members, kinds, "key", "m", max(1, total))


def link_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, threshold: tuple[int, int] = (80, 100)) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id, kept.

    Words are lower-cased in A-Z only and split at the six space characters. A text with fewer than
    ``width`` words has one shingle, the whole sequence; a null or empty one has none, is linked to
    nothing and is its own component. ``component_id`` is the smallest id reachable over links of
    similarity ``threshold`` (numerator, denominator) or more; null ids lose to all others. Rows
    that repeat an id are all kept or all dropped. An empty table gives no rows.
    """
    return _linked(docs, id_col, text_col, width, threshold).drop("copies")


def _linked(docs: DataFrame, id_col: str, text_col: str, width: int, threshold: tuple[int, int]) -> DataFrame:
    """What link_documents gives, and how many rows have the row's shingle set (an empty one: 1)."""
    rows = docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text"))
    id_type = rows.schema["doc_id"].dataType.simpleString()
    signed = stash(rows.mapInArrow(_sign(width), f"doc_id {id_type}, n_shingles long, print string, bands array<long>"), "signatures")
    n_docs = signed.count()
    work = Workspace(rows.sparkSession, "near")
    nodes = signed.filter("print is not null").groupBy("print").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("copies"), F.first("n_shingles").alias("n_shingles"), F.first("bands").alias("bands"))
    nodes = work.stash(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")

    turn = Workspace(rows.sparkSession, "round")
    members = _open(nodes.select("node", F.explode("bands").alias("key")).withColumn("comp", F.col("node")), turn, sift=True)
    # all buckets with one hub are one bucket, so that a node has a row for each hub, not for each band
    members = turn.stash(members.select(F.lit(0).cast("long").alias("parent"), "key", "node", "m"), "buckets")
    involved = work.stash(members.groupBy("node").agg(F.sum("m").alias("mates")).join(nodes.select("node", "print", "n_shingles", "first_id"), "node"), "involved")
    sets, sets_table = _involved_sets(rows, involved, width, work)
    labels: DataFrame | None = None
    while True:
        compared, seated = _compare_hubs(members, sets, threshold, turn)
        labels = merge(labels, compared.filter("linked").select(F.col("hub").alias("a"), F.col("node").alias("b")), turn)
        pairs, members = _what_is_left(compared, seated, labels, threshold, n_docs, turn)
        labels = merge(labels, _verify(pairs, sets, threshold, turn).filter("linked").select("a", "b"), turn)
        left = members.limit(1).count()
        if left:
            members = turn.stash(_open(_with_comp(members, labels), turn).select("parent", "key", "node", "m"), "buckets")
            left = members.limit(1).count()
        # only the labels and the buckets live on
        last, turn = turn, Workspace(rows.sparkSession, "round")
        labels, members = turn.stash(labels, "labels"), turn.stash(members, "buckets") if left else members
        last.close()
        if not left:
            break

    first = _with_comp(nodes.select("node", "print", "first_id", "copies"), labels)
    smallest = first.groupBy("comp").agg(F.min("first_id").alias("component_id"), F.sum("copies").alias("_size"))
    final = stash(attach(first, work.stash(smallest, "components"), "comp", "_size", max(1, n_docs)).select("print", "component_id", "copies"), "classes")
    rows.sparkSession.sql(f"DROP TABLE {sets_table}")
    turn.close()
    work.close()
    linked = attach(signed.filter("print is not null").select("doc_id", "n_shingles", "print"), final, "print", "copies", max(1, n_docs))
    alone = signed.filter("print is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"), F.lit(1).cast("long").alias("copies"))
    out = linked.select("doc_id", "n_shingles", "component_id", "copies").unionByName(alone)
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def _involved_sets(rows: DataFrame, involved: DataFrame, width: int, work: Workspace) -> tuple[DataFrame, str]:
    """node, mates, n_shingles and the full shingle set of each node that shares a bucket; its table.

    A filter on the id of one document of each node keeps all other texts out of the second pass.
    """
    log2 = bloom.log_bits(involved.count())
    bitmaps = bloom.build(involved.select(F.xxhash64("first_id").alias("_key")), "_key", log2)
    again = bloom.flag(rows, F.xxhash64("doc_id"), bitmaps, log2, "maybe").filter("maybe").select("text")
    again = again.mapInArrow(_sets(width), "print string, shingles array<long>")
    one = again.join(involved, "print").groupBy("print", "node").agg(F.first("mates").alias("mates"), F.first("n_shingles").alias("n_shingles"), F.first("shingles").alias("shingles"))
    one = one.drop("print")  # the join has dealt by it, so the grouping doesn't shuffle
    # in buckets, so that no round shuffles the sets
    spark, name = rows.sparkSession, f"sets_{uuid.uuid4().hex}"
    count = int(spark.conf.get("spark.sql.shuffle.partitions"))
    one.repartition(count, "node").write.bucketBy(count, "node").sortBy("node").option("path", f"{work.folder}/sets").saveAsTable(name)
    return spark.table(name), name


def _verify(pairs: DataFrame, sets: DataFrame, threshold: tuple[int, int], work: Workspace, outside: bool = False) -> DataFrame:
    """Pairs (a, b) compared on their full sets: sizes, common, linked; if asked for, b's shingles outside a.

    A set with very many partners, on either side, goes to several tasks; there are HOT_SHARE such
    sets a side at most. Sets of few partners are read where they lie, in buckets of their node.
    """
    num, den = threshold
    pairs = work.stash(pairs, "pairs")
    share = max(PARTNERS, pairs.count() // HOT_SHARE)

    def heavy(side: str) -> DataFrame:
        counts = pairs.groupBy(side).agg(F.floor(F.count("*") / F.lit(share)).cast("int").alias(f"{side}_more"))
        return work.stash(counts.filter(f"{side}_more > 0"), f"heavy-{side}")

    heavy_a, heavy_b = heavy("a"), heavy("b")
    hub = sets.select(F.col("node").alias("a"), F.col("n_shingles").alias("a_n"), F.col("shingles").alias("a_set"))
    own = sets.select(F.col("node").alias("b"), F.col("n_shingles").alias("n"), F.col("shingles").alias("b_set"))
    # later rounds need few of the sets
    hub = hub.join(pairs.select("a").distinct(), "a", "left_semi").join(F.broadcast(heavy_a), "a", "left")
    parts = lambda side: F.explode(F.sequence(F.lit(0), F.coalesce(f"{side}_more", F.lit(0))))
    hub = hub.withColumn("part", parts("a")).drop("a_more")
    part = lambda side, other: F.pmod(F.xxhash64(other), F.coalesce(f"{side}_more", F.lit(0)) + 1).cast("int")
    dealt = pairs.join(F.broadcast(heavy_a), "a", "left").withColumn("part", part("a", "b")).drop("a_more")
    few = dealt.join(F.broadcast(heavy_b.select("b")), "b", "left_anti").join(own.join(pairs.select("b").distinct(), "b", "left_semi"), "b")
    many = dealt.join(F.broadcast(heavy_b), "b").withColumn("b_part", part("b", "a")).drop("b_more")
    many = many.join(own.join(F.broadcast(heavy_b), "b").withColumn("b_part", parts("b")).drop("b_more"), ["b", "b_part"]).drop("b_part")
    both = few.unionByName(many).join(hub, ["a", "part"]).withColumn("common", F.size(F.array_intersect("b_set", "a_set")).cast("long"))
    linked = den * F.col("common") >= num * (F.col("n") + F.col("a_n") - F.col("common"))
    beyond = [F.array_except("b_set", "a_set").alias("outside")] if outside else []
    return work.stash(both.select("a", "b", "n", "common", linked.alias("linked"), *beyond), "compared")


def _compare_hubs(members: DataFrame, sets: DataFrame, threshold: tuple[int, int], work: Workspace) -> tuple[DataFrame, DataFrame]:
    """Each bucket's hub against the rest; and the other members with their hub."""
    ranked = members.join(sets.select("node", "mates"), "node")
    hubs = work.stash(ranked.groupBy("key").agg(F.max(F.struct("mates", (-F.col("node")).alias("low"))).alias("top"), F.max("m").alias("m")).select("key", (-F.col("top.low")).alias("hub"), "m"), "hubs")
    seated = attach(members.select("parent", "key", "node"), hubs, "key", "m", max(1, members.count())).filter("node <> hub")
    seated = work.stash(seated.select(F.xxhash64("parent", "hub").alias("key"), "hub", "node").distinct(), "seated")
    pairs = seated.select(F.col("hub").alias("a"), F.col("node").alias("b")).distinct()
    return _verify(pairs, sets, threshold, work, True).withColumnsRenamed({"a": "hub", "b": "node"}), seated


def _what_is_left(compared: DataFrame, seated: DataFrame, labels: DataFrame, threshold: tuple[int, int], n_docs: int, work: Workspace) -> tuple[DataFrame, DataFrame]:
    """Pairs that may still be linked, and the buckets that need another hub."""
    num, den = threshold
    rest = _open(_with_comp(seated, labels), work).select("key", "hub", "node", "comp").join(compared, ["hub", "node"])
    rest = work.stash(rest.select("key", "node", "comp", "n", "common", "linked", "outside"), "rest")
    shared = rest.select(F.explode("outside").alias("s"), F.col("key").alias("parent"), "node", "comp")
    shared = _open(shared.select(F.xxhash64("parent", "s").alias("key"), "parent", "node", "comp"), work, sift=True)
    # rem: how many lists a set has from this one on, the short ones first
    sizes = rest.select(F.col("key").alias("parent"), "node", "n", "common", "linked")
    onward = Window.partitionBy("parent", "node").orderBy(F.desc("m"), F.desc("key"))
    shared = shared.withColumn("rem", F.row_number().over(onward).cast("long")).join(sizes, ["parent", "node"])
    shared = work.stash(shared.filter((F.col("common") + F.col("rem")) * den >= F.col("n") * num), "shared")
    # wider lists too, while their pairs are a bounded number for each document: that saves rounds
    limits = [FEW << i for i in range(WIDER + 1)]
    work_of = shared.agg(*[F.coalesce(F.sum(F.when(~F.col("linked") & (F.col("m") > FEW) & (F.col("m") <= k), F.col("m"))), F.lit(0)) for k in limits]).first()
    few = max(k for k, pairs_of in zip(limits, work_of, strict=True) if k == FEW or pairs_of <= PAIRS * n_docs)
    fields = ("node", "comp", "n", "common", "linked", "rem")
    fits = (F.col("x_comp") != F.col("y_comp")) & (F.col("y_linked") | (F.col("x_node") < F.col("y_node")))
    fits &= (F.least("x_common", "y_common") + F.least("x_rem", "y_rem")) * (num + den) >= (F.col("x_n") + F.col("y_n")) * num
    side = lambda rows, name, *more: rows.select("key", *[F.col(c).alias(f"{name}_{c}") for c in fields], *more)
    narrow = shared.filter(F.col("m") <= FEW)
    by_shingle = side(narrow.filter("not linked"), "x").join(side(narrow, "y"), "key").filter(fits).select("x_node", "y_node")

    # what may be common is |z & hub| + rem, in the bucket itself |z & hub|; with
    # room(z) = that * (1 + T) / T - |z|, a pair needs |y| <= room(x) and |x| <= room(y); sizes in
    # classes of 12 % and rooms in classes of 25 %, so that few but the fitting pairs meet and a set
    # is in few classes; edge takes up rounding
    edge = 1e-9
    cls = lambda v, width: F.floor(F.log(v) / F.lit(math.log(width)))
    classes = lambda low, high, width: F.explode(F.sequence(cls(low * (1 - edge), width), F.greatest(cls(low * (1 - edge), width), cls(high * (1 + edge), width))))
    wide = shared.filter((F.col("m") > FEW) & (F.col("m") <= few)).select("key", *fields)
    roomy = rest.withColumn("rem", F.lit(0).cast("long")).select("key", *fields).unionByName(wide)
    n = F.col("n")
    roomy = roomy.withColumn("room", (F.col("common") + F.col("rem")) * (num + den) / F.lit(num) - n)
    x = side(roomy.filter(~F.col("linked") & (F.col("room") >= n * num / F.lit(den) * (1 - edge))), "x", classes(n * num / F.lit(den), F.col("room"), 1.12).alias("c"))
    x = x.withColumn("r", classes(F.col("x_n"), F.col("x_n") * (den * den) / F.lit(num * num), 1.25))
    y = side(roomy.filter("room > 0.99"), "y", cls(n, 1.12).alias("c"), cls(F.col("room"), 1.25).alias("r"))
    by_size = x.join(y, ["key", "c", "r"]).filter(fits).select("x_node", "y_node")
    pairs = by_shingle.unionByName(by_size).select(F.least("x_node", "y_node").alias("a"), F.greatest("x_node", "y_node").alias("b")).distinct()
    return pairs, shared.filter(F.col("m") > few).select("parent", "key", "node")


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, threshold: tuple[int, int] = (80, 100)) -> DataFrame:
    """One row for each component, with all its columns: the one with the smallest id.

    Null ids lose to all others; of rows that share an id, one with the least hash of its text
    stays, and of rows that share both, any. Rows without shingles all stay.
    """
    # texts tell rows with null or repeated ids apart, by 128 bits of hash; the caller's columns are
    # packed, so that their names can't clash
    text = text_of(text_col)
    key = F.struct(F.col(id_col).isNull().alias("no_id"), F.col(id_col).alias("id"), F.xxhash64(text).alias("h1"), F.xxhash64(F.lit(1), text).alias("h2"))
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("packed"), key.alias("row"), text.alias("text"))
    links = stash(_linked(packed, "row", "text", width, threshold).filter("not kept or copies > 1").select(F.col("doc_id").alias("row"), "kept"), "dropped")
    packed = packed.select("packed", "row")
    left = bloom.without(packed, links.filter("not kept").select("row").distinct(), "row")
    again = stash(links.filter("kept").groupBy("row").count().filter("count > 1").select("row"), "repeated")
    if again.limit(1).count():
        single = left.join(again, "row", "left_semi").dropDuplicates(["row"])
        left = bloom.without(left, again, "row").unionByName(single)
    return left.select("packed.*")
