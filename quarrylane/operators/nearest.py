"""Exact nearest neighbours by cells: the triangle inequality leaves out cells that can't hold one.

The looked-at rows are dealt to cells by their nearest pivot. A query first looks into the cells
with the nearest pivots, which gives a bound; then into the cells that could hold something closer:
those whose least possible distance, the pivot's less the cell's radius, is under the bound.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrylane.session import cut

#: Rows, and queries, that stand together in a block of a cell, on average, however many the cell has.
BLOCK = 512
#: Pairs whose differences stand in memory at once.
REFINED = 1 << 15


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean, by differences: equal vectors are at 0, and ties stay ties."""
    return np.sqrt(np.stack([((b - x) ** 2).sum(axis=1) for x in a])) if len(a) else np.zeros((0, len(b)))


def _closest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row of a the first of the rows of b that _distances puts nearest, and that distance.

    One matrix product gives all squares but for rounding; only rows of b that are within its error
    of the least are told apart by differences.
    """
    a_2, b_2 = (a * a).sum(axis=1), (b * b).sum(axis=1)
    about = a_2[:, None] + b_2 - 2 * (a @ b.T)
    if not np.isfinite(about).all():
        away = _distances(a, b)
        best = away.argmin(axis=1)
        return best, away[np.arange(len(a)), best]
    error = 16 * (a.shape[1] + 4) * np.finfo(np.float64).eps * (np.sqrt(a_2) + np.sqrt(b_2.max())) ** 2
    row, col = np.nonzero(about <= (about.min(axis=1) + error)[:, None])
    away = np.concatenate([np.sqrt(((b[col[i : i + REFINED]] - a[row[i : i + REFINED]]) ** 2).sum(axis=1)) for i in range(0, len(row), REFINED)])
    order = np.lexsort((col, away, row))
    first = order[np.unique(row[order], return_index=True)[1]]
    return col[first], away[first]


def _placed(pivots: np.ndarray):
    """Adds the distances to all pivots, and the nearest pivot as ``cell``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            away = _distances(_matrix(batch.column("v")), pivots)
            cells = away.argmin(axis=1) if len(away) else np.zeros(0, np.int64)
            far = pa.ListArray.from_arrays(pa.array(np.arange(len(away) + 1) * len(pivots), pa.int32()), pa.array(away.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("v"), pa.array(cells, pa.int64()), far], names=["id", "v", "cell", "away"])

    return run


def _best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(query, id, distance): the nearest of a block for each query of the block beside it, ties to the smaller id."""
    for batch in batches:
        found = []
        for row in range(batch.num_rows):
            queries, asked, ids, held = (batch.column(c)[row].values.to_numpy(zero_copy_only=False) for c in ("queries", "asked", "ids", "held"))
            best, away = _closest(asked.reshape(len(queries), -1), held.reshape(len(ids), -1))  # ids are in order
            found.append((queries, ids[best], away))
        columns = [np.concatenate(c) for c in zip(*found, strict=True)] if found else [np.zeros(0)] * 3
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int64(), pa.float64()), strict=True)], names=["query", "id", "distance"])


def _blocks(rows: DataFrame, key: str, part: Column, ids: str, values: str) -> DataFrame:
    """cell, the keys of a part of the cell's rows in order, and their vectors one after the other."""
    grouped = rows.groupBy("cell", part.alias("part")).agg(F.array_sort(F.collect_list(F.struct(F.col(key).alias("key"), "v"))).alias("rows"))
    return grouped.select("cell", F.transform("rows", lambda r: r["key"]).alias(ids), F.flatten(F.transform("rows", lambda r: r["v"])).alias(values))


def nearest(queries: DataFrame, among: DataFrame, key: str = "id", vector: str = "vector", pivots: int = 32) -> DataFrame:
    """query, id, distance: for each query row the nearest row of ``among`` by Euclidean distance, ties to the smaller id.

    Keys are whole numbers, vectors of one length; rows without a key or vector are left out, and
    without rows to look among there is no result. Pivots are the first ``pivots`` rows by key: they decide
    what is left out, never what is found. Large cells stand in blocks of BLOCK rows, so a cell may
    hold any share of the rows. What can't be left out is compared: vectors without any
    structure leave out little.
    """
    kind = "id long, v array<double>, cell long, away array<double>"
    clean = lambda df: df.filter(F.col(key).isNotNull() & F.col(vector).isNotNull()).select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"))
    there = clean(among)
    chosen = there.orderBy("id").limit(pivots).collect()
    if not chosen:
        return there.select(F.col("id").alias("query"), "id", F.lit(0.0).alias("distance"))
    place = _placed(np.array([r.v for r in chosen], np.float64))
    members = cut(there.mapInArrow(place, kind).select("id", "v", "cell", F.get("away", "cell").alias("reach")), "cells")
    asking = cut(clean(queries).mapInArrow(place, kind), "queries")
    found = members.groupBy("cell").agg(F.max("reach").alias("reach"), F.count("*").alias("n")).collect()  # a row for each pivot at most
    radius = {r.cell: r.reach for r in found}
    parts = F.create_map(*[F.lit(x) for r in found for x in (r.cell, -(-r.n // BLOCK))])
    blocks = cut(_blocks(members, "id", F.pmod(F.xxhash64("id"), F.element_at(parts, F.col("cell"))), "ids", "held"), "blocks")
    cells = F.array(*[F.struct(F.lit(c).cast("long").alias("cell"), F.greatest(F.lit(0.0), F.get("away", F.lit(c)) - F.lit(r)).alias("least")) for c, r in sorted(radius.items())])
    reachable = asking.select(F.col("id").alias("query"), "v", F.explode(cells).alias("c")).select("query", "v", "c.*")
    together = -(-asking.count() // BLOCK) or 1

    def search(pairs: DataFrame) -> DataFrame:
        met = _blocks(pairs, "query", F.pmod(F.xxhash64("query"), F.lit(together)), "queries", "asked").join(blocks, "cell")
        found = met.select("queries", "asked", "ids", "held").mapInArrow(_best, "query long, id long, distance double")
        return found.groupBy("query").agg(F.min(F.struct("distance", "id")).alias("b")).select("query", F.col("b.id").alias("id"), F.col("b.distance").alias("distance"))

    first = reachable.groupBy("query").agg(F.min(F.struct("least", "cell", "v")).alias("f")).select("query", "f.cell", "f.v")
    bound = cut(search(first), "bounds")
    seen = first.select("query", F.col("cell").alias("seen"))
    # a hair over the bound, so that rounding of distances leaves no tie out
    rest = reachable.join(bound.select("query", "distance"), "query").join(seen, "query").filter((F.col("cell") != F.col("seen")) & (F.col("least") <= F.col("distance") * (1 + 1e-9)))
    better = search(rest.select("query", "v", "cell"))
    both = bound.unionByName(better).groupBy("query").agg(F.min(F.struct("distance", "id")).alias("b"))
    return both.select("query", F.col("b.id").alias("id"), F.col("b.distance").alias("distance"))
