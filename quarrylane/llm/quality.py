"""Quality rules: word statistics, and how a public vocabulary's tokens fit a text.

Tokeniser fertility: two vocabularies, SentencePiece with byte fallback and byte-level BPE for many
languages, encode each whole text; the rule looks at characters per token and the entropy of the
token distribution in both, and at the share of tokens that are fallback bytes, against the band of
the text's language, or of its script if the language isn't known.
"""

from __future__ import annotations

import base64
import functools
import re
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrylane.llm import tokens
from quarrylane.llm.common import SPACES, give_back, portions, text_of


@dataclass(frozen=True)
class Least:
    """Lower limit of a measure over n tokens: level + slope / sqrt(n) - scatter / sqrt(min(n, STEADY))."""

    level: float
    slope: float = 0.0
    scatter: float = 0.0

    def of(self, n: int) -> float:
        return self.level + self.slope / n**0.5 - self.scatter / min(n, STEADY) ** 0.5


@dataclass(frozen=True)
class Band:
    """Limits for the texts of one language or script; a text outside of any of them is rejected.

    Characters per token and entropy, each in the first and in the second vocabulary.
    """

    chars_per_token: tuple[Least, Least]
    entropy: tuple[Least, Least]
    most_fallback_share: float
    most_chars_per_token: float = 8.0


def _fitted(chars: tuple[tuple[float, float], ...], entropy: tuple[tuple[float, float, float], ...]) -> Band:
    """A band from levels, slopes and standard deviations of clean texts, see BANDS."""
    (a, a_sd), (b, b_sd) = chars
    return Band((Least(a, 0.0, 1.6 * WIDTH * a_sd), Least(b, 0.0, WIDTH * b_sd)), tuple(Least(x, slope, WIDTH * sd) for x, slope, sd in entropy), 0.15)


#: Tokens from which on the scatter of a measure shrinks no more; standard deviations that a clean
#: text may lie below its language's line.
STEADY, WIDTH = 1000, 4.0
#: Languages: level (and slope over 1 / sqrt(n)), then standard deviation times sqrt(min(n, STEADY)),
#: of the documents of sf0.1 with labels.quality = 1 that pass the base rules (en 1,973, de 475, es
#: 307, fr 488). Characters per token have 1.6 times the width in the first vocabulary, which cuts
#: hexadecimal secrets and digits in clean texts to single characters. Only lower limits are narrow,
#: as ordinary prose has more characters per token than these invented words. Scripts: there are no
#: clean documents but in those languages, so these limits are wide. Fallback bytes are common in scripts
#: that the vocabulary hardly covers (a sentence in Amharic: 0.83; Khmer, Korean, Burmese: 0.26 to 0.42);
#: words of six letters of three bytes, none of which it holds, reach 18 / 19.
BANDS = {
    "en": _fitted(((2.633, 1.113), (2.646, 1.081)), ((7.238, -15.153, 1.795), (7.343, -16.209, 1.797))),
    "de": _fitted(((2.623, 1.066), (2.697, 1.109)), ((6.994, -12.871, 1.831), (7.132, -14.116, 1.903))),
    "es": _fitted(((2.296, 1.025), (2.437, 0.995)), ((7.073, -13.891, 2.623), (7.066, -14.127, 2.674))),
    "fr": _fitted(((2.350, 1.116), (2.416, 1.047)), ((6.914, -12.289, 2.147), (7.031, -13.213, 2.139))),
    "latin": Band((Least(1.5), Least(1.0)), (Least(3.5), Least(3.5)), 0.15),
    "cyrillic": Band((Least(1.2), Least(1.0)), (Least(3.5), Least(3.5)), 0.15),
    "other": Band((Least(0.25), Least(0.25)), (Least(3.0), Least(3.0)), 0.95),
}
#: Words that tell a language, and what is taken off words before they are looked up.
TELLING = {
    "en": "the of and to in is for as by are with was from this that it",
    "de": "der die und den das ist zu von nicht mit dem ein eine",
    "es": "el los las que por con y del se para una no",
    "fr": "le les des et une est pour dans pas du au que",
}
_TELLING = {k: frozenset(v.encode().split()) for k, v in TELLING.items()}
MARKS = b"#$%&*!?.,;:|<>\"()"
LATIN = re.compile("[A-Za-zÀ-ɏ]+")
CYRILLIC = re.compile("[Ѐ-ӿ]+")
SYMBOLS = "#*$%&|<>"
#: The second vocabulary.
MULTI = "byte_bpe_multi_50k.tiktoken"
#: A text longer than this is cut for the second vocabulary, where a space stands between letters:
#: its splitting always begins a new token there.
PART = 32_768
BETWEEN_LETTERS = re.compile(r"(?<=[^\W\d_]) (?=[^\W\d_])")
#: Stretches between spaces that a worker remembers in each of two generations, and their greatest length.
REMEMBERED, LONGEST = 100_000, 100
#: Bytes of text that are encoded together.
PORTION = 1 << 19

FIELDS = [("n_words", "long"), ("word_chars", "long"), ("n_symbols", "long"), ("n_dup_lines", "long"), ("n_repeat_words", "long"), ("base_failed", "boolean"), ("kept", "boolean"), ("chars_per_token", "double"), ("fallback_share", "double"), ("token_entropy", "double"), ("script", "string"), ("multi_chars_per_token", "double"), ("multi_token_entropy", "double"), ("band", "string")]


class Pieces:
    """Ids of whole texts in a SentencePiece vocabulary; stretches between spaces are remembered.

    No piece reaches across a space (tokens.CUT), so the ids of the stretches are those of the text.
    """

    def __init__(self, path: str):
        self.model, self.can_split = tokens.model(path)
        byte = [self.model.is_byte(i) for i in range(self.model.get_piece_size())]
        # line ends and tabs are fallback bytes in some vocabularies, and no sign of a foreign script
        self.foreign = np.array([b and self.model.id_to_piece(i) not in ("<0x09>", "<0x0A>", "<0x0D>") for i, b in enumerate(byte)])
        self.new: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def split(self, text: str) -> list[str]:
        if not self.can_split:
            return [text]
        if "  " in text or "▁" in text or text[:1] == " " or text[-1:] == " ":
            return tokens.CUT.split(text)
        return text.split(" ")

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text; what isn't remembered is encoded in one call."""
        split = [self.split(t) for t in texts]
        here: dict[str, bytes] = {}
        unknown = set().union(*split) - self.new.keys()
        for x in unknown & self.old.keys():
            here[x] = self.old[x]
        unknown = [x for x in unknown if x not in here]
        for x, ids in zip(unknown, self.model.encode(unknown, num_threads=1), strict=True):
            here[x] = array("i", ids).tobytes()
        if len(self.new) >= REMEMBERED:
            self.old, self.new = self.new, {x: self.new[x] for parts in split for x in parts if x in self.new}
        self.new |= here
        out = [np.frombuffer(b"".join(map(self.new.__getitem__, parts)), np.int32) for parts in split]
        for x in here:
            if len(x) > LONGEST:
                del self.new[x]
        return out

    def forget(self) -> None:
        self.new, self.old = {}, {}


@functools.lru_cache(maxsize=2)
def vocabulary(path: str) -> Pieces:
    return Pieces(path)


@functools.lru_cache(maxsize=2)
def ranks(path: str) -> tiktoken.Encoding:
    with open(path, "rb") as f:
        merges = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("quality", pat_str=public_tokenizers.PATTERN, mergeable_ranks=merges, special_tokens={})


def repeated_words(words: list[bytes]) -> int:
    """Words that lie in a window of three words which the text holds twice or more."""
    if len(words) < 4:
        return 0
    numbers = {x: i for i, x in enumerate(dict.fromkeys(words))}
    w = np.fromiter(map(numbers.__getitem__, words), np.int64, len(words))
    pairs = w[:-2] * len(numbers) + w[1:-1]
    if len(numbers) >= 1 << 20:
        # three numbers don't fit into 63 bits
        pairs = np.unique(pairs, return_inverse=True)[1]
    windows = pairs * len(numbers) + w[2:]
    in_order = np.sort(windows)
    if (in_order[1:] != in_order[:-1]).all():
        return 0
    _, window, count = np.unique(windows, return_inverse=True, return_counts=True)
    twice = count[window] > 1
    covered = np.zeros(len(w), bool)
    for i in range(3):
        covered[i : len(w) - 2 + i] |= twice
    return int(covered.sum())


def repeated_lines(text: str) -> int:
    """Lines with a word that equal an earlier line."""
    lines = [x for x in text.split("\n") if x.strip(SPACES)]
    return len(lines) - len(set(lines))


def script(text: str) -> str:
    """The script of most letters, if half of all letters are of one that has a band."""
    latin, cyrillic = len(text) - len(LATIN.sub("", text)), len(text) - len(CYRILLIC.sub("", text))
    if max(latin, cyrillic) * 2 < len(text) and max(latin, cyrillic) * 2 < sum(map(str.isalpha, text)):
        return "other"
    return "latin" if latin >= cyrillic else "cyrillic"


def language(text: str) -> str | None:
    """The language whose telling words are 2 % of all, three at least and twice any other's."""
    found = text.encode().lower().translate(None, MARKS).split()
    counts = {k: sum(map(telling.__contains__, found)) for k, telling in _TELLING.items()}
    *_, second, most = sorted(counts.values())
    return max(counts, key=counts.__getitem__) if most >= max(3, 2 * second, len(found) / 50) else None


def parts(text: str) -> list[str]:
    """Parts of at least PART characters, but the last, with equal tokens in sum."""
    out, at = [], 0
    while len(text) - at > PART and (cut := BETWEEN_LETTERS.search(text, at + PART)):
        out.append(text[at : cut.start()])
        at = cut.start()
    return [*out, text[at:]]


def spread(ids: np.ndarray) -> float:
    """The entropy of the tokens in bits."""
    in_order = np.sort(ids)
    ends = np.flatnonzero(in_order[1:] != in_order[:-1])
    counts = np.diff(ends, prepend=-1, append=len(ids) - 1) / len(ids)
    return float(-(counts * np.log2(counts)).sum())


def fertility(text: str, ids: np.ndarray, foreign: np.ndarray) -> tuple[float, float, float, int]:
    """Characters per token, share of fallback bytes, entropy in bits, tokens; of no tokens: zeros."""
    if not len(ids):
        return 0.0, 0.0, 0.0, 0
    fallback = 0 if text.isascii() else int(np.count_nonzero(foreign[ids]))
    return len(text) / len(ids), fallback / len(ids), spread(ids), len(ids)


def multi_fertility(text: str, encoding: tiktoken.Encoding) -> tuple[float, float, int]:
    """Characters per token, entropy in bits, tokens in the second vocabulary; of no text: zeros."""
    if not text:
        return 0.0, 0.0, 0
    ids = np.concatenate([encoding.encode_to_numpy(p, disallowed_special=()) for p in parts(text)])
    return len(text) / len(ids), spread(ids), len(ids)


def judge(text: str, lang: str | None, ids: np.ndarray, foreign: np.ndarray, encoding: tiktoken.Encoding) -> tuple:
    words = text.encode().split()
    n, repeat = len(words), repeated_words(words)
    base_failed = n < 50 or 100 * repeat > 50 * n
    per_token, share, entropy, n_tokens = fertility(text, ids, foreign)
    multi_per_token, multi_entropy, multi_tokens = multi_fertility(text, encoding)
    kind = "latin" if text.isascii() else script(text)
    name = kind
    if kind == "latin":
        # tables of words have few telling words
        name = language(text) or (lang if lang in TELLING else kind)
    kept = not base_failed and fits(BANDS[name], (per_token, multi_per_token), (entropy, multi_entropy), (n_tokens, multi_tokens), share)
    chars = len(text) - sum(text.count(c) for c in SPACES)
    return n, chars, sum(text.count(c) for c in SYMBOLS), repeated_lines(text), repeat, base_failed, kept, per_token, share, entropy, kind, multi_per_token, multi_entropy, name


def fits(band: Band, per_token: tuple[float, ...], entropy: tuple[float, ...], tokens: tuple[int, ...], share: float) -> bool:
    """Does a text of one token or more lie in the band?"""
    low = [least.of(n) <= x for least, x, n in zip((*band.chars_per_token, *band.entropy), (*per_token, *entropy), (*tokens, *tokens), strict=True)]
    return all(low) and max(per_token) <= band.most_chars_per_token and share <= band.most_fallback_share


def _judge(path: str, multi_path: str):
    types = {"long": pa.int64(), "boolean": pa.bool_(), "double": pa.float64(), "string": pa.string()}

    @F.arrow_udf(f"struct<{','.join(f'{n}:{t}' for n, t in FIELDS)}>")
    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        model, encoding = vocabulary(path), ranks(multi_path)
        for texts, langs in batches:
            rows = []
            for part in portions([pa.RecordBatch.from_arrays([texts, langs], names=["text", "lang"])], 0, PORTION):
                some = [t or "" for t in part.column(0).to_pylist()]
                rows += [judge(t, lang, ids, model.foreign, encoding) for t, lang, ids in zip(some, part.column(1).to_pylist(), model.encode(some), strict=True)]
            columns = list(zip(*rows, strict=True)) or [()] * len(FIELDS)
            yield pa.StructArray.from_arrays([pa.array(c, types[t]) for c, (_, t) in zip(columns, FIELDS, strict=True)], names=[n for n, _ in FIELDS])
        # the worker lives on for other stages
        model.forget()
        give_back()

    return run


def _judged(docs: DataFrame, path: str, text_col: str, lang_col: str) -> Column:
    lang = F.col(lang_col).cast("string") if lang_col in docs.columns else F.lit(None).cast("string")
    return _judge(path, public_tokenizers.path(MULTI))(text_of(text_col), lang)


def measure(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """One row per input row: doc_id and FIELDS.

    Words are separated by the six space characters only. A null text is empty: it has no words and
    fails the base rules. The language is told from the text; where that fails, ``lang_col`` (if
    there is one) tells it. Repeated rows give repeated rows; an empty table gives none.
    """
    return docs.select(F.col(id_col).alias("doc_id"), _judged(docs, path, text_col, lang_col).alias("r")).select("doc_id", "r.*")


def keep_good(docs: DataFrame, path: str, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows that the rules keep, with all their columns, whatever these are called.

    Null and empty texts go, repeated rows are all kept or all dropped, an empty table stays empty.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("packed")
    return docs.select(row, _judged(docs, path, text_col, lang_col).alias("judged")).filter("judged.kept").select("packed.*")
