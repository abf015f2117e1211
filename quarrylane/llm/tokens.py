"""Token counts: SentencePiece lengths from Arrow functions.

An Arrow batch is cut by the bytes of its texts into portions of about PORTION bytes, before they
become Python strings; each portion is encoded in one call, and only lengths leave the worker. A long
text is split where no piece of the vocabulary can reach across: before a run of spaces, as pieces
hold the space mark at their start only. The library puts a space mark before each part, in place
of the one that is cut off.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylane.llm.common import portions, text_of

PORTION = 1 << 20
LONG = 1 << 16
#: A space that follows other text and has something after it; the mark itself counts as a space.
CUT = re.compile("(?<=[^ ▁]) (?=.)", re.DOTALL)


@functools.lru_cache(maxsize=2)
def model(path: str) -> tuple[sentencepiece.SentencePieceProcessor, bool]:
    """The vocabulary, and whether texts may be split as above."""
    m = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = (m.id_to_piece(i) for i in range(m.get_piece_size()))
    return m, not any("▁" in p.lstrip("▁") for p in pieces)


def split(text: str, size: int = LONG) -> list[str]:
    """Parts of at least ``size`` characters, but the last, with equal tokens in sum."""
    parts, at = [], 0
    while len(text) - at > size and (cut := CUT.search(text, at + size)):
        parts.append(text[at : cut.start()])
        at = cut.start() + 1
    return [*parts, text[at:]]


def lengths(texts: list[str], m: sentencepiece.SentencePieceProcessor, can_split: bool) -> list[int]:
    """Token counts, encoding about PORTION bytes at a time."""
    counts = [0] * len(texts)
    owners: list[int] = []
    pending: list[str] = []
    size = 0

    def flush() -> None:
        for i, ids in zip(owners, m.encode(pending, num_threads=1), strict=True):
            counts[i] += len(ids)
        owners.clear()
        pending.clear()

    for i, text in enumerate(texts):
        for part in split(text) if can_split and len(text) > LONG else [text]:
            owners.append(i)
            pending.append(part)
            size += len(part) if part.isascii() else len(part.encode())
            if size >= PORTION:
                flush()
                size = 0
    if pending:
        flush()
    return counts


def _count(path: str):
    @F.arrow_udf("long")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        m, can_split = model(path)
        for texts in batches:
            counts: list[int] = []
            for part in portions([pa.RecordBatch.from_arrays([texts], names=["text"])], 0, PORTION):
                counts += lengths([t or "" for t in part.column(0).to_pylist()], m, can_split)
            yield pa.array(counts, pa.int64())

    return run


def count_tokens(docs: DataFrame, path: str, limit: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_bytes, n_tokens, over_limit.

    No token is added, and special strings are ordinary text, as is the library's default. A null
    or empty text has no bytes and no tokens. Repeated rows give repeated rows; an empty table none.
    """
    text = text_of(text_col)
    out = docs.select(F.col(id_col).alias("doc_id"), F.octet_length(text).cast("long").alias("n_bytes"), _count(path)(text).alias("n_tokens"))
    return out.withColumn("over_limit", F.col("n_tokens") > limit)
