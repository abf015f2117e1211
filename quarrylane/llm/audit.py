"""Which of five filters removes what, in each of their 120 orders.

A document is a set of failed filters, so a number below 32. The step at which an order removes it
depends on that number alone: FIRST, a table of 32 by 120, has it. Each task counts its rows by
part, number and label, looks the steps up in FIRST, and gives arrays of all figures by part, order
and step; these are summed. So what shuffles depends on the number of parts and tasks only.
"""

from __future__ import annotations

import functools
import itertools
import operator
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrylane.llm.common import WORD, attach, stash, text_of

LETTERS = "ABCDE"
STEPS = len(LETTERS)
ORDERS = ["".join(o) for o in itertools.permutations(LETTERS)]
#: PLACE[order, filter]: the step of a filter in an order. FILTER[order, step]: the filter at a step.
PLACE = np.array([[o.index(f) for f in LETTERS] for o in ORDERS])
FILTER = np.argsort(PLACE, axis=1)
#: FAILS[number, filter], and FIRST[number, order]: the step that removes such documents; STEPS: none.
FAILS = (np.arange(1 << STEPS)[:, None] >> np.arange(STEPS) & 1).astype(bool)
FIRST = np.where(FAILS[:, None, :], PLACE, STEPS).min(axis=2)

FIGURES = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
#: Parts that a task holds before it gives what it has.
MANY_PARTS = 500


def own_failures(text: Column) -> Column:
    """The filters A to D that a text fails, as bits 0 to 3."""
    words = F.regexp_extract_all(text, F.lit(f"({WORD})"), F.lit(1))
    n, distinct = F.size(words), F.size(F.array_distinct(words))
    fails = [n < 200, 100 * distinct < 50 * n, 100 * F.regexp_count(text, F.lit("[A-Z]")) > 3 * F.length(text), text.rlike("[#$%&*|]")]
    return functools.reduce(operator.add, [f.cast("int") * (1 << i) for i, f in enumerate(fails)])


def failures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """One row per document: doc_id, part, and the filters that it fails as bits 0 (A) to 4 (E).

    A null text is empty, a null part the empty string. E compares with smaller ids only: of rows
    of one text and one id none fails by another, and a row without an id neither fails E nor makes
    others fail it. Each text is read once, by SQL functions; what is joined is its digest of 128 bits.
    """
    text = text_of(text_col)
    digest = F.substring(F.sha2(text.cast("binary"), 256), 1, 32)
    measured = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), own_failures(text).alias("mask"), digest.alias("digest"))
    rows = stash(measured, "audit")
    first = stash(rows.groupBy("digest").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).filter("n > 1 and first is not null"), "repeated")
    late = F.coalesce(F.col("doc_id") > F.col("first"), F.lit(False)).cast("int")
    return attach(rows, first, "digest", "n", max(1, rows.count()), "left").select("doc_id", "part", (F.col("mask") + late * 16).cast("int").alias("mask"))


def judged(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """Adds good and toxic: whether any label of the id says so; without an id or labels, neither."""
    by_id = labels.filter("doc_id is not null").groupBy("doc_id").agg(F.bool_or(F.col("quality") == 1).alias("good"), F.bool_or(F.col("toxic") == 1).alias("toxic"))
    no = F.lit(False)
    return rows.join(by_id, "doc_id", "left").select("part", "mask", F.coalesce("good", no).alias("good"), F.coalesce("toxic", no).alias("toxic"))


def figures(counts: np.ndarray) -> np.ndarray:
    """FIGURES of each order and step, from counts by (all, good, toxic) and number."""
    cells = np.arange(len(ORDERS)) * (STEPS + 1) + FIRST
    removed, good, toxic = (
        np.bincount(cells.ravel(), np.repeat(c, len(ORDERS)), len(ORDERS) * (STEPS + 1)).reshape(len(ORDERS), -1)[:, :STEPS].astype(np.int64) for c in counts
    )
    kept = counts[0].sum() - np.cumsum(removed, axis=1)
    failing, alone = counts[0] @ FAILS, counts[0][1 << np.arange(STEPS)]
    shapley = np.bincount(FILTER.ravel(), removed.ravel(), STEPS).astype(np.int64)
    return np.stack([kept, removed, failing[FILTER] - removed, alone[FILTER], good, toxic, shapley[FILTER]])


def _partials(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[str, np.ndarray] = {}

    def flush() -> Iterator[pa.RecordBatch]:
        for part, counts in held.items():
            found = figures(counts)
            columns = [pa.array([part] * found[0].size, pa.string()), pa.array(np.repeat(ORDERS, STEPS).tolist(), pa.string()), pa.array(np.tile(np.arange(1, STEPS + 1), len(ORDERS)), pa.int32())]
            yield pa.RecordBatch.from_arrays(columns + [pa.array(f.ravel(), pa.int64()) for f in found], names=["part", "filter_order", "step", *FIGURES])
        held.clear()

    for batch in batches:
        parts = batch.column(0).dictionary_encode()
        names, size = parts.dictionary.to_pylist(), len(parts.dictionary) << STEPS
        cell = (parts.indices.to_numpy().astype(np.int64) << STEPS) + batch.column(1).to_numpy()
        flags = [slice(None), *(batch.column(i).to_numpy(zero_copy_only=False) for i in (2, 3))]
        counts = np.stack([np.bincount(cell[f], minlength=size).reshape(-1, 1 << STEPS) for f in flags], axis=1)
        for name, own in zip(names, counts, strict=True):
            held[name] = held[name] + own if name in held else own
        if len(held) >= MANY_PARTS:
            yield from flush()
    yield from flush()


def audit(rows: DataFrame) -> DataFrame:
    """From (part, mask, good, toxic): part, filter_order, step and FIGURES, 600 rows for each part.

    An empty table gives none. Repeated rows count each time.
    """
    kind = f"part string, filter_order string, step int, {', '.join(f'{f} bigint' for f in FIGURES)}"
    partial = rows.select("part", "mask", "good", "toxic").mapInArrow(_partials, kind)
    return partial.groupBy("part", "filter_order", "step").agg(*[F.sum(f).alias(f) for f in FIGURES])


def filter_audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The audit of whole documents with labels (doc_id, quality, toxic); other columns don't matter."""
    return audit(judged(failures(docs), labels))
