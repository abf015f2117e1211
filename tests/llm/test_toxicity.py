"""Scores of toxicity against a plain version: every term's edit distance to every word."""

import math
import random
import zlib

import pytest

from quarrylane.llm import toxicity

TERMS = [("idiot", False, 2.0), ("worthless", False, 3.0), ("moron", False, 2.5), ("patheti", True, 4.0), ("scu", True, 1.5), ("loser", True, 1.2)]
REAL = {"oron", "worthies", "athetic"}
ALLOWED = {False: lambda n: 2 if n >= 9 else 1 if n >= 5 else 0, True: lambda n: 1 if n >= 7 else 0}


def distances(term, word):
    """Edit distances of the term to each beginning of the word."""
    rows = [list(range(len(term) + 1))]
    for i, c in enumerate(word, 1):
        row = [i]
        for j, d in enumerate(term, 1):
            row.append(min(row[-1] + 1, rows[-1][j] + 1, rows[-1][j - 1] + (c != d)))
        rows.append(row)
    return [r[-1] for r in rows]


def plain_match(word):
    met = []
    for text, stem, weight in TERMS:
        found = distances(text, word)
        errors = min(found[1:]) if stem else found[-1]
        if errors <= ALLOWED[stem](len(text)):
            met.append((errors, -weight))
    if not met or (min(met)[0] and word in REAL):
        return 0.0, 0
    return -min(met)[1], min(met)[0]


def plain_features(text):
    total = most = 0.0
    found = list(toxicity.WORD.finditer(text))
    for m in found:
        weight, errors = plain_match(m[0].lower())
        left, right = text[max(0, m.start() - 80) : m.start()], text[m.end() : m.end() + 80]
        near = {w.lower() for w in toxicity.WORD.findall(left + " \n " + right)}
        marks = '"\u201c\u201d\u201e\u00ab\u00bb'
        quoted = sum(left.count(c) for c in marks) % 2 == 1 and any(c in right for c in marks)
        context = 0.25 if quoted or near & toxicity.REPORTED else 1.25 if near & toxicity.ADDRESSED else 1.0
        score = weight * 0.7**errors * context
        total, most = total + score, max(most, score)
    return math.log1p(total), most, math.log1p(100 * total / max(1, len(found)))


def altered(rng, word):
    word = list(word)
    for _ in range(rng.randrange(3)):
        i = rng.randrange(len(word) + 1)
        word[i : i + rng.randrange(2)] = rng.choice(["", "x", "i", "0", "ss"])
    return "".join(word)


def test_matches_equal_distances():
    rng = random.Random(5)
    lexicon = toxicity.Lexicon([toxicity.Term(*t) for t in TERMS], frozenset(REAL))
    words = [altered(rng, rng.choice([t for t, _, _ in TERMS]) + rng.choice(["", "", "c", "s", "ally"])) for _ in range(4000)]
    for w in [w for w in words if w] + sorted(REAL):
        assert lexicon.match(w) == pytest.approx(plain_match(w)), w
    assert lexicon.match("oron") == (0.0, 0) and lexicon.match("mor0n") == (2.5, 1) and lexicon.match("pathetik") == (4.0, 0) and lexicon.match("pathtically") == (4.0, 1)


def test_scores_equal_plain_version(spark):
    rng = random.Random(6)
    fillers = ["the", "river", "you", "said", '"', "\u201c", "\u201d", "\u00ab", "Oron", "worthies", "stone,", "bridge.", "\n", "Tu", "1200", "caf\u00e9"]
    rows = [(i, " ".join(altered(rng, rng.choice(TERMS)[0]) if rng.random() < 0.1 else rng.choice(fillers) for _ in range(rng.randrange(80)))) for i in range(200)]
    rows += [(None, "you idiot"), (7, None), (7, None), (8, ""), (9, "stone " * 20_000 + "scum")]
    model = toxicity.Model(tuple(toxicity.Term(*t) for t in TERMS), frozenset(REAL), (-2.0, 0.7, 0.3, 0.5))

    def expected(i, text):
        z = sum(a * b for a, b in zip((1, *plain_features(text or "")), model.weights, strict=True))
        score = 1 / (1 + math.exp(-z))
        return round(score, 9), zlib.crc32(str("" if i is None else i).encode()) % 5 == 0, int(score >= 0.5)

    got = toxicity.judge(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()
    place = lambda r: (str(r[0]), r[1:])
    assert sorted([(r.doc_id, round(r.score, 9), r.held_out, r.predicted) for r in got], key=place) == sorted([(i, *expected(i, t)) for i, t in rows], key=place)


def test_words_of_clean_texts_are_no_misspellings(spark):
    ids = [i for i in range(400) if zlib.crc32(str(i).encode()) % 5]
    rows = [(i, f"you moron of the oron {i}" if i % 4 == 0 else f"the oron of stone {i}" if i % 4 == 1 else f"the bridge of stone {i}") for i in ids]
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in ids], "doc_id long, toxic int")
    model = toxicity.train(spark.createDataFrame(rows, "doc_id long, text string"), labels)
    lexicon = toxicity.Lexicon(list(model.terms), model.real)
    assert "oron" in model.real and lexicon.match("oron") == (0.0, 0)
    assert lexicon.match("mor0n")[0] > 0 and lexicon.match("moron")[0] > 0
