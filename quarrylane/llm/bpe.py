"""BPE encoding and decoding with forced boundaries.

A merge joins two neighbouring parts into a vocabulary token. So if a pair of bytes stands next to
each other in no token, no merge ever crosses it: the text can be cut there, the fragments encoded
independently and their ids concatenated. For this vocabulary (BPE with word ends; white space is
in no token), the vocabulary's own splitting cuts a text into words, and pairs that occur inside no
token cut words into fragments. Only a word's last fragment carries the word end. Words recur, so a
worker keeps a bounded memory of them.

Texts of Latin letters and common signs are lower-cased and split here, by one pattern: such
characters are in composed form already. What has other characters goes through the library's
normalizer and splitter, one stretch without spaces at a time.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
import json
import operator
import re
import struct
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quarrylane.llm.common import give_back, text_of

#: Words of each of two generations that a worker remembers, and their greatest length.
REMEMBERED, LONGEST = 100_000, 100
#: Characters that are in composed form whatever stands beside them in this set, which has no marks.
PLAIN = re.compile("[\\x00-\u017f\u2010-\u2027\u2030-\u205e\u20a0-\u20bf]*")
LETTERS, NUMBERS, BLANKS = "A-Za-zªµºÀ-ÖØ-öø-ſ", "0-9²³¹¼½¾", "\\x09-\\x0d\\x20\\x85\\xa0"
#: The vocabulary's splitting, for lower-cased PLAIN text.
WORDS = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{LETTERS}]+|[{NUMBERS}]|[^{BLANKS}{LETTERS}{NUMBERS}]+")


def byte_symbols() -> list[str]:
    """The character that stands for each byte in this kind of vocabulary: itself, if visible in Latin-1."""
    symbols = [chr(b) if 33 <= b <= 126 or 161 <= b <= 255 and b != 173 else "" for b in range(256)]
    others = iter(range(256, 512))
    return [s or chr(next(others)) for s in symbols]


class ForcedBoundaries:
    """Encoder and decoder of one vocabulary file of this kind."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        whole = Tokenizer.from_str(json.dumps(spec))
        self.normalizer, self.splitter, self.final = whole.normalizer, whole.pre_tokenizer, whole.model
        self._whole = whole  # keeps its parts alive
        self.end = spec["model"]["end_of_word_suffix"]
        bare = spec | {"model": spec["model"] | {"end_of_word_suffix": None}}
        self._bare = Tokenizer.from_str(json.dumps(bare))
        self.inner = self._bare.model
        tokens = spec["model"]["vocab"]
        self.pairs = {t[i : i + 2] for t in (x.removesuffix(self.end) for x in tokens) for i in range(len(t) - 1)}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special_text = re.compile("|".join(re.escape(s) for s in sorted(self.special, key=len, reverse=True)))
        self.special_bytes = [s.encode() for s in self.special]
        self.token = {i: t for t, i in tokens.items()} | {i: t for t, i in self.special.items()}
        self.tokens = [self.token[i] for i in range(len(self.token))]
        self.symbols = dict(enumerate(byte_symbols()))
        self.bytes = {ord(s): b for b, s in self.symbols.items()}
        self.words: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def fragments(self, word: str) -> list[str]:
        """A word's byte symbols, cut at each pair that no token holds."""
        if self.pairs.issuperset(map(operator.add, word, word[1:])):
            return [word]
        cuts = [i for i in range(1, len(word)) if word[i - 1 : i + 1] not in self.pairs]
        return [word[a:b] for a, b in zip([0, *cuts], [*cuts, len(word)], strict=True)]

    def word(self, word: str) -> bytes:
        """Ids of a word as little-endian 32-bit integers; words in use outlive their generation."""
        packed = self.words.get(word) or self.older.get(word)
        if packed is None:
            *heads, last = self.fragments(word.encode().decode("latin-1").translate(self.symbols))
            ids = [t.id for f in heads for t in self.inner.tokenize(f)] + [t.id for t in self.final.tokenize(last)]
            packed = struct.pack(f"<{len(ids)}I", *ids)
        if len(self.words) >= REMEMBERED:
            self.older, self.words = self.words, {}
        if len(word) <= LONGEST:
            self.words[word] = packed
        return packed

    def forget(self) -> None:
        self.words, self.older = {}, {}

    def split(self, text: str) -> list[str]:
        """The normalized words of a text without special strings."""
        if PLAIN.fullmatch(text):
            return WORDS.findall(text.lower())
        words = []
        for raw in text.encode().split():
            part = raw.decode()
            if PLAIN.fullmatch(part):
                words += WORDS.findall(part.lower())
            else:
                symbols = self.splitter.pre_tokenize_str(self.normalizer.normalize_str(part))
                words += [w.translate(self.bytes).encode("latin-1").decode() for w, _ in symbols]
        return words

    def _plain(self, text: str) -> list[bytes]:
        known, word = self.words.get, self.word
        return [known(w) or word(w) for w in self.split(text)]

    def packed(self, text: str) -> bytes:
        """Ids of a text as little-endian 32-bit integers."""
        out, at = [], 0
        for m in self.special_text.finditer(text) if "<|" in text else ():
            out += self._plain(text[at : m.start()])
            out.append(struct.pack("<I", self.special[m[0]]))
            at = m.end()
        return b"".join(out + self._plain(text[at:] if at else text))

    def encode(self, text: str) -> list[int]:
        packed = self.packed(text)
        return list(struct.unpack(f"<{len(packed) // 4}I", packed))

    def decode(self, ids: Sequence[int]) -> str:
        """As the library without a decoder: the tokens, special ones too, with spaces between."""
        return " ".join([self.token[i] for i in ids if i in self.token])

    def digest(self, packed: bytes) -> tuple[str, str]:
        """SHA-256 of packed ids and of the text that they are decoded to."""
        ids = struct.unpack(f"<{len(packed) // 4}I", packed)
        decoded = " ".join(map(self.tokens.__getitem__, ids))
        return hashlib.sha256(packed).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> ForcedBoundaries:
    """One encoder for each worker and file."""
    return ForcedBoundaries(path)


def _round_trip(path: str, with_ids: bool = False):
    ids_type = "ids:array<int>," if with_ids else ""

    @F.arrow_udf(f"struct<{ids_type}n_tokens:bigint,ids_sha256:string,decoded_sha256:string>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        e = encoder(path)
        for texts in batches:
            packed = [e.packed(t.as_py() or "") for t in texts]
            found = [e.digest(p) for p in packed]
            columns = {
                "n_tokens": pa.array([len(p) // 4 for p in packed], pa.int64()),
                "ids_sha256": pa.array([f[0] for f in found], pa.string()),
                "decoded_sha256": pa.array([f[1] for f in found], pa.string()),
            }
            if with_ids:
                ends = pa.array(itertools.accumulate((len(p) // 4 for p in packed), initial=0), pa.int32())
                columns = {"ids": pa.ListArray.from_arrays(ends, pa.array(np.frombuffer(b"".join(packed), "<i4")))} | columns
            yield pa.StructArray.from_arrays(list(columns.values()), names=list(columns))
        # the worker lives on for other stages
        e.forget()
        give_back()

    return run


def _ids(path: str):
    @F.arrow_udf("array<int>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        e = encoder(path)
        for texts in batches:
            yield pa.array([e.encode(t.as_py() or "") for t in texts], pa.list_(pa.int32()))
        e.forget()
        give_back()

    return run


def _text(path: str):
    @F.arrow_udf("string")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        e = encoder(path)
        for rows in batches:
            yield pa.array([e.decode(r.as_py() or []) for r in rows], pa.string())

    return run


def encode(text: Column, path: str) -> Column:
    """Ids of each text (null: none), special strings as their ids."""
    return _ids(path)(F.coalesce(text, F.lit("")))


def decode(ids: Column, path: str) -> Column:
    """The tokens of each id list with spaces between; null and empty lists: empty."""
    return _text(path)(F.coalesce(ids, F.array().cast("array<int>")))


def digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_tokens, ids_sha256, decoded_sha256.

    Each text is encoded whole and decoded again. A null or empty text has no tokens and the
    digests of nothing. Repeated rows give repeated rows; an empty table gives none.
    """
    found = docs.select(F.col(id_col).alias("doc_id"), _round_trip(path)(text_of(text_col)).alias("r"))
    return found.select("doc_id", "r.*")


def encoded(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """What ``digests`` gives, and the ids themselves in ``ids``."""
    found = docs.select(F.col(id_col).alias("doc_id"), _round_trip(path, with_ids=True)(text_of(text_col)).alias("r"))
    return found.select("doc_id", "r.*")
