"""Best-fit packing of documents into sequences of equal room, planned over a length histogram.

What is planned is not documents but counts: best fit, longest first, places all pieces of a length
at once into the runs of sequences that have the same room left. The histogram has at most as many
entries as a sequence has places, so the plan's size doesn't grow with the documents. Each piece
then takes the slot that the plan has for its rank among the pieces of its length.
"""

from __future__ import annotations

import array
import functools
import json
import re
import zlib
from collections import defaultdict
from collections.abc import Iterator, Mapping
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quarrylane.llm.common import portions, stash, text_of

#: The splitting of byte-level vocabularies, a fixed pattern of such files.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: A place where no token can reach across: a single space, which belongs to the word after it.
CUT = re.compile(r"(?<=\S) (?=\S)")
LONG = 1 << 20


class Run(NamedTuple):
    """``n`` pieces of a length, from a rank on, at one offset in as many sequences in a row."""

    length: int
    rank: int
    n: int
    sequence: int
    offset: int


def plan(histogram: Mapping[int, int], room: int) -> list[Run]:
    """Best fit, longest first: a piece goes where the least room is left that still holds it.

    Sequences that have equal room left are kept as ranges of numbers. A sequence that best fit has
    chosen stays its choice while the next piece of that length fits, so it takes ``room // length`` at once.
    """
    runs: list[Run] = []
    ranges: dict[int, list[tuple[int, int]]] = defaultdict(list)
    opened = 0
    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0
        while left:
            free = next((r for r in range(length, room) if ranges[r]), room)
            if free == room:
                ranges[room].append((opened, left))
            first, n = ranges[free].pop()
            each = free // length
            takes = [(min(n, left // each), each)] if left >= each else [(1, left)]
            for m, k in takes:
                for i in range(k):
                    runs.append(Run(length, rank, m, first, room - free + i * length))
                    rank += m
                left -= m * k
                ranges[free - k * length].append((first, m))
                if free == room:
                    opened += m
                elif m < n:
                    ranges[free].append((first + m, n - m))
    return runs


class Encoder:
    """Ids of whole texts, as the tokenizers library has them for a byte-level BPE file.

    Byte-level BPE is fixed by its merges and its splitting, so the merges of the file are run by
    the faster library; special strings in a text are their ids. Very long texts are cut first. A
    file with a normalizer, another splitting or ids out of the order of merges is refused.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        splitter, tokens = spec["pre_tokenizer"] or {}, spec["model"]["vocab"]
        merged = [tokens["".join(m if isinstance(m, list) else m.split(" "))] for m in spec["model"]["merges"]]
        if spec["normalizer"] or splitter.get("type") != "ByteLevel" or splitter["add_prefix_space"] or not splitter.get("use_regex", True) or merged != sorted(merged):
            raise ValueError("not a plain byte-level vocabulary")
        vocabulary = Tokenizer.from_file(path)
        self.special = {t.content: i for i, t in vocabulary.get_added_tokens_decoder().items()}
        visible = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 255 and b != 173]
        others = [b for b in range(256) if b not in visible]
        byte = {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(others)}
        ranks = {bytes(byte[c] for c in t): i for t, i in vocabulary.get_vocab(with_added_tokens=False).items() if t not in self.special}
        self.encoding = tiktoken.Encoding("file", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens=self.special)

    def encode(self, text: str) -> list[int]:
        ids, at = [], 0
        while len(text) - at > LONG and (cut := CUT.search(text, at + LONG)):
            ids += self.encoding.encode(text[at : cut.start()], allowed_special="all")
            at = cut.start()
        return ids + self.encoding.encode(text[at:] if at else text, allowed_special="all")


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def _cut(path: str, room: int, end: int, with_ids: bool):
    fields = "start:bigint,length:int,ids_crc32:bigint" + ",ids:array<int>" * with_ids

    @F.arrow_udf(f"array<struct<{fields}>>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encode = encoder(path).encode
        for texts in batches:
            ends, starts, lengths, sums, kept = [0], [], [], [], []
            for part in portions([pa.RecordBatch.from_arrays([texts], names=["text"])], 0):
                for text in part.column(0).to_pylist():
                    ids = array.array("I", encode(text or ""))
                    ids.append(end)
                    packed = memoryview(ids.tobytes())
                    at, to = 0, len(ids) % room or min(room, len(ids))
                    while at < len(ids):
                        starts.append(at)
                        lengths.append(to - at)
                        sums.append(zlib.crc32(packed[4 * at : 4 * to]))
                        at, to = to, to + room
                    ends.append(len(starts))
                    if with_ids:
                        kept.append(ids)
            columns = {"start": pa.array(starts, pa.int64()), "length": pa.array(lengths, pa.int32()), "ids_crc32": pa.array(sums, pa.int64())}
            if with_ids:
                flat = np.frombuffer(b"".join(k.tobytes() for k in kept), "<i4")
                columns["ids"] = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *lengths]), pa.int32()), pa.array(flat))
            yield pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(list(columns.values()), names=list(columns)))

    return run


def pieces(docs: DataFrame, path: str, room: int = 1024, end: int = 2, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and ids): documents as ids and a last id, cut where longer than ``room``.

    All pieces of a cut document but the first fill a sequence. A null or empty text is the last id
    alone. Repeated rows give repeated pieces; an empty table none.
    """
    cut = docs.select(F.col(id_col).alias("doc_id"), F.posexplode(_cut(path, room, end, with_ids)(text_of(text_col))).alias("piece", "p"))
    return cut.select("doc_id", "piece", "p.*")


def _ranks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the task's number and each row's place among the task's rows of its length; lengths come in order."""
    task, length, seen = TaskContext.get().partitionId(), -1, 0
    for batch in batches:
        own = batch.column("length").to_numpy()
        if not len(own):
            continue
        index = np.arange(len(own))
        starts = np.flatnonzero(np.diff(own, prepend=own[0] - 1))
        rank = index - np.repeat(starts, np.diff(starts, append=len(own)))
        if own[0] == length:
            rank[: starts[1] if len(starts) > 1 else len(own)] += seen
        length, seen = own[-1], int(rank[-1]) + 1
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(own), task), pa.int32()), pa.array(rank, pa.int64())], names=[*batch.schema.names, "task", "rank"])


def ranked(rows: DataFrame) -> DataFrame:
    """Adds ``rank``: the place of a piece among all of its length, by doc_id, piece and checksum.

    Pieces are dealt by ranges of that order, so pieces of one length may be in many tasks. A task's
    first rank is the number of rows of the length in tasks before it. (task, length) pairs are
    fewer than tasks and lengths together, so they are broadcast.
    """
    order = ["length", "doc_id", "piece", "ids_crc32"]
    kind = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + ", task int, rank bigint"
    local = stash(rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_ranks, kind), "ranked")
    counts = local.groupBy("length", "task").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("length", "task", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    return local.join(F.broadcast(counts), ["length", "task"]).withColumn("rank", F.col("rank") + F.col("before")).drop("task", "before")


def _slots(runs: list[Run]):
    runs = sorted(runs)
    lengths, ranks, _, sequences, offsets = (np.array(c, np.int64) for c in zip(*runs, strict=True)) if runs else [np.zeros(0, np.int64)] * 5
    keys = (lengths << 48) + ranks

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(c).to_numpy().astype(np.int64) for c in ("length", "rank"))
            at = np.searchsorted(keys, (length << 48) + rank, "right") - 1
            columns = [*(c for c, name in zip(batch.columns, batch.schema.names, strict=True) if name != "rank"), pa.array(sequences[at] + rank - ranks[at], pa.int64()), pa.array(offsets[at], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=[*(n for n in batch.schema.names if n != "rank"), "sequence_id", "offset"])

    return take


def pack(docs: DataFrame, path: str, room: int = 1024, end: int = 2, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The pieces, each with its sequence_id (from 0, without gaps) and its offset there.

    Ties of best fit don't matter for the number of sequences; pieces of one length take slots in
    order of doc_id (null first), piece and checksum, so that reruns agree.
    """
    rows = stash(pieces(docs, path, room, end, with_ids, id_col, text_col), "pieces")
    histogram = {r.length: r.n for r in rows.groupBy("length").agg(F.count("*").alias("n")).collect()}
    placed = ranked(rows)
    kept = [f for f in placed.schema if f.name != "rank"]
    kind = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept) + ", sequence_id bigint, offset bigint"
    return placed.mapInArrow(_slots(plan(histogram, room)), kind)


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id, ids, and the documents' parts in it, from pieces with their ids: at most ``room`` ids a row."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "doc_id", "piece", "length", "ids")))
    rows = packed.groupBy("sequence_id").agg(parts.alias("p"))
    return rows.select("sequence_id", F.flatten(F.transform("p", lambda x: x["ids"])).alias("ids"), F.transform("p", lambda x: x.dropFields("ids")).alias("parts"))
