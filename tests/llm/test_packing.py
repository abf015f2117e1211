import random
import struct
import zlib
from collections import defaultdict

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quarrylane.llm import packing, queries

FILE = public_tokenizers.path("byte_bpe_50k.json")
ODD = [None, "", " ", "  two\n\n three ", "<|endoftext|> a<|endoftext|>", "É日本語 テスト x", "word " * 3000, "same", "same", "x" * 40_000]


def best_fit(lengths, room):
    """Best fit over pieces one by one, longest first: room left in each sequence."""
    left = []
    for n in sorted(lengths, reverse=True):
        fits = [i for i, r in enumerate(left) if r >= n]
        if not fits:
            left.append(room)
            fits = [len(left) - 1]
        left[min(fits, key=left.__getitem__)] -= n
    return sorted(left)


@pytest.mark.parametrize("seed", range(8))
def test_plan_is_best_fit(seed):
    rng = random.Random(seed)
    room = rng.choice([16, 50, 128])
    lengths = [rng.randint(1, rng.choice([room, room // 3, 3])) for _ in range(rng.choice([1, 40, 700]))]
    histogram = {n: lengths.count(n) for n in set(lengths)}
    runs = packing.plan(histogram, room)
    placed, ranks = defaultdict(list), defaultdict(set)
    for r in runs:
        for i in range(r.n):
            placed[r.sequence + i].append((r.offset, r.length))
            ranks[r.length].add(r.rank + i)
    assert ranks == {n: set(range(k)) for n, k in histogram.items()}
    assert sorted(placed) == list(range(len(placed)))
    for own in placed.values():
        ends = [0]
        for offset, length in sorted(own):
            assert offset == ends[-1]
            ends.append(offset + length)
        assert ends[-1] <= room
    assert sorted(room - sum(n for _, n in own) for own in placed.values()) == best_fit(lengths, room)


def test_plan_does_not_grow_with_documents():
    few = {n: 1 + n * 7 % 13 for n in range(1, 1025)}
    many = {n: k * 1_000_003 for n, k in few.items()}
    assert len(packing.plan(many, 1024)) < 4 * len(packing.plan(few, 1024))
    assert packing.plan({}, 1024) == []


def test_encoder_equals_library():
    rng = random.Random(2)
    alphabet = ["a", "B", "the", " ", "  ", "\n", "\t", "'s", "'ll", "1", "23", "é", "ß", "日", "́", "‍", " ", "　", "👩", "<|endoftext|>", "<|", ".", "!?", "#", "\u0000", "﻿", "ǅ", "٣"]
    whole, own = Tokenizer.from_file(FILE), packing.encoder(FILE)
    texts = ["".join(rng.choices(alphabet, k=rng.randrange(1, 40))) for _ in range(3000)]
    assert [own.encode(t) for t in texts] == [e.ids for e in whole.encode_batch(texts, add_special_tokens=False)]


def test_encoder_cuts_long_texts_safely(monkeypatch):
    monkeypatch.setattr(packing, "LONG", 5)
    rng = random.Random(3)
    whole, own = Tokenizer.from_file(FILE), packing.encoder(FILE)
    for _ in range(300):
        text = "".join(rng.choices(["ab", " ", "\n", "c'd", "<|endoftext|>", "é", "  "], k=60))
        assert own.encode(text) == whole.encode(text, add_special_tokens=False).ids


def test_refuses_other_vocabularies():
    with pytest.raises(ValueError):
        packing.Encoder(public_tokenizers.path("word_bpe_49k.json"))


def check_pieces(rows, texts, room=1024):
    whole = Tokenizer.from_file(FILE)
    places, by_doc = defaultdict(list), defaultdict(list)
    for r in rows:
        places[r.sequence_id].append((r.offset, r.length))
        by_doc[r.doc_id].append(r)
    for i, text in enumerate(texts):
        ids = whole.encode(text or "", add_special_tokens=False).ids + [2]
        own, at = sorted(by_doc[i], key=lambda r: r.piece), 0
        assert [r.piece for r in own] == list(range(len(own)))
        for r in own:
            part = ids[r.start : r.start + r.length]
            assert r.start == at and r.ids_crc32 == zlib.crc32(struct.pack(f"<{len(part)}I", *part))
            at += r.length
        assert at == len(ids)
        assert all(r.length == room for r in own[1:]) and (len(own) == 1 or len(ids) > room)
    for own in places.values():
        assert all(a + n == b for (a, n), (b, _) in zip(sorted(own), [*sorted(own)[1:], (sum(n for _, n in own), 0)], strict=True))
        assert sum(n for _, n in own) <= room and min(own)[0] == 0
    assert len(places) == len(best_fit([r.length for r in rows], room))


def test_query_equals_brute_force(spark):
    rows = queries.QUERIES["op12_best_fit_packing"](spark, "/root/testdata/sf0.001").collect()
    docs = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    assert sorted(docs) == list(range(len(docs)))
    check_pieces(rows, [docs[i] for i in range(len(docs))])


def test_odd_rows(spark):
    df = spark.createDataFrame(list(enumerate(ODD)), "doc_id long, text string")
    clash = df.withColumns({c: F.lit("x") for c in ("length", "piece", "rank", "task", "start", "offset", "sequence_id", "p")})
    rows = packing.pack(clash.repartition(3), FILE).collect()
    check_pieces(rows, ODD)
    assert sorted(map(tuple, packing.pack(df, FILE).collect())) == sorted(map(tuple, rows))
    twice = packing.pack(df.unionByName(df).unionByName(df.selectExpr("cast(null as long) as doc_id", "text")), FILE).collect()
    assert len(twice) == 3 * len(rows) and len({(r.sequence_id, r.offset) for r in twice}) == len(twice)
    assert packing.pack(df.limit(0), FILE).count() == 0


def test_sequences_hold_the_ids(spark):
    df = spark.createDataFrame(list(enumerate(ODD)), "doc_id long, text string")
    packed = packing.pack(df, FILE, room=64, with_ids=True)
    whole, found = Tokenizer.from_file(FILE), defaultdict(dict)
    for r in packing.sequences(packed).collect():
        assert len(r.ids) == sum(p.length for p in r.parts) <= 64
        for p in r.parts:
            found[p.doc_id][p.piece] = r.ids[p.offset : p.offset + p.length]
    for i, text in enumerate(ODD):
        ids = [x for k in sorted(found[i]) for x in found[i][k]]
        assert ids == whole.encode(text or "", add_special_tokens=False).ids + [2]


def test_one_length_in_many_tasks(spark):
    df = spark.range(5000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "two words").otherwise("one").alias("text"))
    rows = packing.pack(df.repartition(7), FILE, room=8).collect()
    assert len({(r.sequence_id, r.offset) for r in rows}) == len(rows) == 5000
    assert len({r.sequence_id for r in rows}) == len(best_fit([r.length for r in rows], 8))
