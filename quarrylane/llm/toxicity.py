"""Toxicity: a Levenshtein automaton run along a lexicon trie, weighed by context.

The lexicon is learned from labelled rows: words, and stems that words begin with, which toxic
texts have more often than others. The automaton's states are sets of (trie node, errors); they are
made when first reached and remembered, so most words cost one look-up for each character until no
term is left in reach. Words near a term that clean labelled texts hold are words of their own, not
misspellings. A window around each match tells quotation from abuse.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrylane.llm.common import stash, text_of

#: The classifier and its lexicon are fitted on so many labelled rows at most, the first ones in
#: order of a hash of the id. All terms of these rows that pass the limits below are in the lexicon.
MOST_LABELLED = 20_000
#: Least log-likelihood ratio and log odds of a term, and lengths of stems.
LEAST_G2, LEAST_ODDS, STEMS = 18.0, 1.5, (4, 5, 6, 7)
#: Errors allowed in a term and in a stem, from a length on.
ERRORS = ((9, 2), (5, 1), (0, 0))
STEM_ERRORS = ((7, 1), (0, 0))
WINDOW = 80
WORD = re.compile(r"[^\W_](?:[\w@$*!]*[\w])?")
QUOTES = re.compile("[\"“”„«»]")
REPORTED = frozenset("said says wrote writes called quoted quote cited sagte sagt schrieb dit écrit dijo escribió".split())
ADDRESSED = frozenset("you your youre u ur du dich dir tu toi vous tú te usted".split())
REMEMBERED = 300_000


@dataclass(frozen=True)
class Term:
    text: str
    stem: bool
    weight: float


#: Weight and errors where no term is near.
NONE = (0.0, 0)


def closest(match: tuple[float, int]) -> tuple[bool, int, float]:
    """Order of matches: any before none, fewest errors, largest weight."""
    return match[0] > 0, -match[1], match[0]


class Lexicon:
    """Terms in a trie, with an automaton for words within a few errors of one; ``real`` words need to be terms."""

    def __init__(self, terms: list[Term], real: frozenset[str] = frozenset()):
        self.real = real
        self.children: list[dict[str, int]] = [{}]
        self.whole: dict[int, tuple[float, int]] = {}
        self.stem: dict[int, tuple[float, int]] = {}
        for t in terms:
            node = 0
            for c in t.text:
                if c not in self.children[node]:
                    self.children.append({})
                    self.children[node][c] = len(self.children) - 1
                node = self.children[node][c]
            kind, limits = (self.stem, STEM_ERRORS) if t.stem else (self.whole, ERRORS)
            weight = max(t.weight, kind.get(node, (0.0, 0))[0])
            kind[node] = (weight, next(k for n, k in limits if len(t.text) >= n))
        self.most = max((k for kind in (self.whole, self.stem) for _, k in kind.values()), default=0)
        self.states: list[dict[int, int]] = []
        self.ids: dict[frozenset, int] = {}
        self.steps: list[dict[str, int]] = []
        self.ends: list[tuple[float, int]] = []
        self.stems: list[tuple[float, int]] = []
        self.words: dict[str, tuple[float, int]] = {}
        self.dead = self._state({})
        self.start = self._state({0: 0})

    def _state(self, nodes: dict[int, int]) -> int:
        """The number of a state, {node: least errors}, closed under skipping a term's character."""
        todo = list(nodes.items())
        while todo:
            node, e = todo.pop()
            if e < self.most and nodes.get(node) == e:
                for child in self.children[node].values():
                    if nodes.get(child, self.most + 1) > e + 1:
                        nodes[child] = e + 1
                        todo.append((child, e + 1))
        key = frozenset(nodes.items())
        if key not in self.ids:
            self.ids[key] = len(self.states)
            self.states.append(nodes)
            self.steps.append({})
            for kind, found in ((self.whole, self.ends), (self.stem, self.stems)):
                met = [(kind[n][0], e) for n, e in nodes.items() if n in kind and e <= kind[n][1]]
                found.append(max(met, key=closest, default=NONE))
        return self.ids[key]

    def _step(self, state: int, c: str) -> int:
        after: dict[int, int] = {}

        def reach(node: int, e: int) -> None:
            if e <= self.most and after.get(node, self.most + 1) > e:
                after[node] = e

        for node, e in self.states[state].items():
            for d, child in self.children[node].items():
                reach(child, e + (c != d))
            reach(node, e + 1)
        self.steps[state][c] = to = self._state(after)
        return to

    def match(self, word: str) -> tuple[float, int]:
        """Weight and errors of the closest term, or stem that the word begins with; weight 0: no match."""
        if (known := self.words.get(word)) is not None:
            return known
        state, stem = self.start, NONE
        for c in word:
            to = self.steps[state].get(c)
            state = self._step(state, c) if to is None else to
            if state == self.dead:
                break
            stem = max(stem, self.stems[state], key=closest)
        found = max(stem, self.ends[state], key=closest)
        if found[1] and word in self.real:
            found = NONE
        if len(self.words) >= REMEMBERED:
            self.words.clear()
        self.words[word] = found
        return found

    def features(self, text: str) -> tuple[float, float, float]:
        """Sum and largest of the match scores, and their sum for each hundred words.

        A match counts less for each error and in quotation, more where someone is addressed.
        """
        total = most = 0.0
        words = 0
        for m in WORD.finditer(text):
            words += 1
            weight, errors = self.match(m[0].lower())
            if weight:
                score = weight * 0.7**errors * self._context(text, m.start(), m.end())
                total, most = total + score, max(most, score)
        return math.log1p(total), most, math.log1p(100 * total / max(1, words))

    def _context(self, text: str, start: int, end: int) -> float:
        left, right = text[max(0, start - WINDOW) : start], text[end : end + WINDOW]
        near = {w.lower() for w in WORD.findall(left) + WORD.findall(right)}
        inside = len(QUOTES.findall(left)) % 2 == 1 and QUOTES.search(right)
        return 0.25 if inside or near & REPORTED else 1.25 if near & ADDRESSED else 1.0


def held_out(doc_id: Column) -> Column:
    """Rows that nothing is learned from: crc32 of the id's text is divisible by 5 (null: as empty)."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def labelled(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(text, toxic) of up to MOST_LABELLED labelled ids that aren't held out: one row for each, with the least of its texts."""
    rows = labels.select(F.col("doc_id").alias("_id"), "toxic").filter(~held_out(F.col("_id")) & F.col("toxic").isNotNull())
    sample = stash(rows.groupBy("_id").agg(F.max("toxic").cast("int").alias("toxic")).orderBy(F.xxhash64("_id"), "_id").limit(MOST_LABELLED), "labelled")
    texts = docs.select(F.col(id_col).alias("_id"), text_of(text_col).alias("text")).join(F.broadcast(sample), "_id")
    return texts.groupBy("_id").agg(F.min("text").alias("text"), F.first("toxic").alias("toxic")).select("text", "toxic")


def classes(rows: DataFrame) -> tuple[int, int]:
    """Numbers of toxic and of clean rows."""
    n = rows.agg(F.count_if(F.col("toxic") == 1), F.count_if(F.col("toxic") == 0)).first()
    return n[0], n[1]


def log_odds(pos: int, neg: int) -> Column:
    """Smoothed log odds of what ``a`` of the toxic and ``b`` of the clean rows hold."""
    return F.log(((F.col("a") + 0.5) / (pos + 1)) / ((F.col("b") + 0.5) / (neg + 1)))


def learn_real_words(rows: DataFrame, terms: tuple[Term, ...]) -> frozenset[str]:
    """Words near a term that clean rows hold, unless toxic rows hold them as much more often as a term.

    They come from at most MOST_LABELLED rows.
    """
    pos, neg = classes(rows)
    words = rows.select(F.explode(_near(terms)("text")).alias("word"), "toxic")
    seen = words.groupBy("word").agg(F.count_if(F.col("toxic") == 1).alias("a"), F.count_if(F.col("toxic") == 0).alias("b"))
    return frozenset(r.word for r in seen.filter((F.col("b") > 0) & (log_odds(pos, neg) <= LEAST_ODDS)).select("word").collect())


def learn_lexicon(rows: DataFrame) -> list[Term]:
    """Terms that toxic texts have more often, by Dunning's log-likelihood ratio."""
    pos, neg = classes(rows)
    if not pos or not neg:
        return []
    words = F.array_distinct(F.filter(F.split(F.lower("text"), r"[^\p{L}]+"), lambda w: F.length(w) >= 3))

    def begins(k: int) -> Column:
        return F.transform(F.filter("words", lambda w: F.length(w) > k), lambda w: F.concat(F.substring(w, 1, k), F.lit("*")))

    stems = F.flatten(F.array(*[begins(k) for k in STEMS]))
    terms = rows.select(words.alias("words"), "toxic").select(F.explode(F.concat("words", F.array_distinct(stems))).alias("term"), "toxic")
    seen = terms.groupBy("term").agg(F.count_if(F.col("toxic") == 1).alias("a"), F.count_if(F.col("toxic") == 0).alias("b"))
    share = (F.col("a") + F.col("b")) / (pos + neg)
    part = lambda x, total: F.when(x > 0, x * F.log(x / (total * share))).otherwise(0.0)
    g2 = 2 * (part(F.col("a"), pos) + part(F.col("b"), neg) + part(pos - F.col("a"), pos * (1 - share) / share) + part(neg - F.col("b"), neg * (1 - share) / share))
    best = seen.filter("a >= 3").withColumn("g2", g2).withColumn("weight", log_odds(pos, neg)).filter((F.col("g2") >= LEAST_G2) & (F.col("weight") > LEAST_ODDS))
    best = best.orderBy(F.desc("g2"), "term").collect()
    return [Term(r.term.rstrip("*"), r.term.endswith("*"), r.weight) for r in best]


@dataclass(frozen=True)
class Model:
    terms: tuple[Term, ...]
    real: frozenset[str]
    weights: tuple[float, ...]

    def score(self, x: np.ndarray) -> np.ndarray:
        z = x @ np.array(self.weights[1:]) + self.weights[0]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> tuple[float, ...]:
    """Logistic regression by Newton's method; of one class only: that class's smoothed rate."""
    if not len(y) or y.min() == y.max():
        rate = (y.sum() + 0.5) / (len(y) + 1) if len(y) else 0.1
        return (math.log(rate / (1 - rate)), *[0.0] * 3)
    a = np.hstack([np.ones((len(x), 1)), x])
    w = np.zeros(a.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        grad = a.T @ (p - y) / len(y) + ridge * np.r_[0, w[1:]]
        hess = (a * (p * (1 - p))[:, None]).T @ a / len(y) + ridge * np.eye(len(w))
        move = np.linalg.solve(hess, grad)
        w -= move
        if np.abs(move).max() < 1e-9:
            break
    return tuple(float(v) for v in w)


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Model:
    rows = stash(labelled(docs, labels, id_col, text_col), "training")
    terms = tuple(learn_lexicon(rows))
    real = learn_real_words(rows, terms)
    # at most MOST_LABELLED rows of three numbers
    found = rows.select(_features(terms, real)("text").alias("x"), "toxic").collect()
    x = np.array([[*r.x] for r in found]).reshape(-1, 3)
    return Model(terms, real, fit(x, np.array([r.toxic for r in found], float)))


def _near(terms: tuple[Term, ...]):
    @F.arrow_udf("array<string>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        lexicon = Lexicon(list(terms))
        for texts in batches:
            words = [{w for m in WORD.finditer(t.as_py() or "") if lexicon.match(w := m[0].lower())[1]} for t in texts]
            yield pa.array([sorted(w) for w in words], pa.list_(pa.string()))

    return run


def _features(terms: tuple[Term, ...], real: frozenset[str]):
    @F.arrow_udf("array<double>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        lexicon = Lexicon(list(terms), real)
        for texts in batches:
            yield pa.array([lexicon.features(t.as_py() or "") for t in texts], pa.list_(pa.float64()))

    return run


def _score(model: Model):
    @F.arrow_udf("double")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        lexicon = Lexicon(list(model.terms), model.real)
        for texts in batches:
            x = np.array([lexicon.features(t.as_py() or "") for t in texts]).reshape(-1, 3)
            yield pa.array(model.score(x), pa.float64())

    return run


def judge(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, held_out, score, predicted.

    A null text is empty and scores as a text without matches. Repeated rows give repeated rows; an
    empty table gives none. Only the text counts.
    """
    scored = docs.select(F.col(id_col).alias("doc_id"), _score(model)(text_of(text_col)).alias("score"))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
