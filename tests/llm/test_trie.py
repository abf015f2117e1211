import hashlib
import random
import zlib
from collections import defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from quarrylane.llm import queries, trie

DIR = "/root/testdata/sf0.001"
SCHEMA = "conv_id long, turn long, role string, text string"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def brute(rows):
    """The trie by walking it: each rebuilt conversation goes down from the root."""
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [(r, t) for _, _, r, t in sorted(v, key=lambda x: x[:3])] for c, v in own.items()}
    rebuilt = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        rebuilt[c] = own.get(c - c % 5, [])[:h] + turns[h:]
    members = defaultdict(list)
    for c in sorted(rebuilt):
        for d in range(len(rebuilt[c]) + 1):
            members[tuple(rebuilt[c][:d])].append(c)
    kids = defaultdict(list)
    for path in members:
        if path:
            kids[path[:-1]].append(path)
    leaves, saved, out = {}, {}, set()
    for path in sorted(members, key=len, reverse=True):
        leaves[path] = sum(leaves[k] for k in kids[path]) or 1
        size = len(path[-1][1].encode()) if path else 0
        saved[path] = (len(members[path]) - 1) * size + sum(saved[k] for k in kids[path])
        ends = [c for c in members[path] if len(rebuilt[c]) == len(path)]
        parent = members[path[:-1]][0] if path else None
        out.add((members[path][0], len(path), parent, len(members[path]), len(kids[path]), leaves[path], saved[path], sha(",".join(map(str, ends)))))
    return out


def check(spark, rows, **extra):
    got = trie.trie(spark.createDataFrame(rows, SCHEMA).withColumns(extra)).select(*COLUMNS).collect()
    assert len(got) == len(set(map(tuple, got)))
    assert set(map(tuple, got)) == brute(rows)


def conversations(rng, n, most, texts):
    return [(c, k, rng.choice(["user", "assistant"]), rng.choice(texts)) for c in range(n) for k in range(rng.randrange(1, most))]


def test_equals_brute_force(spark):
    rng = random.Random(7)
    rows = conversations(rng, 60, 14, ["a", "b", "é long one", ""])
    rows += [(c, k, "user", f"turn {k}") for c in range(100, 140) for k in range(5)]
    rows += [(c + 1000 * (c % 3), None if k == 3 else k, None if c % 2 else "user", None if k == 1 else "x") for c in range(200, 220) for k in range(4)]
    rows += [(None, 1, "user", "nobody's"), (301, 5, None, "x"), (301, 4, "user", None), (-7, 0, "user", "n"), (-5, 0, "user", "n"), (-3, 0, "user", "n")]
    rng.shuffle(rows)
    check(spark, rows, key=F.lit(1), pos=F.lit(2), len=F.lit(3), node=F.lit("x"), size=F.lit(4), task=F.lit(5), block=F.lit(6))


@pytest.mark.parametrize("widest", [256, 4])
def test_long_shared_beginnings(spark, widest, monkeypatch):
    """Copies of a long conversation, one that leaves it late, and one that ends inside it."""
    monkeypatch.setattr(trie, "WIDEST", widest)
    rng = random.Random(8)
    turns = 300 if widest == 256 else 40
    base = [rng.choice("abc") for _ in range(turns)]
    rows = [(c, k, "user", t) for c in (5, 10, 15, 20) for k, t in enumerate(base)]
    rows += [(25, k, "user", t) for k, t in enumerate(base[: turns - 10] + ["z"] * 12)] + [(30, k, "user", t) for k, t in enumerate(base[: turns // 2])]
    check(spark, rows)


def test_small_tables(spark):
    check(spark, [(4, 0, "user", "only")])
    check(spark, [(12, 0, "user", "only"), (12, 1, "user", "two")])
    check(spark, [(c, 0, "user", "same") for c in range(40)])
    check(spark, [(3, 1, "user", "twice"), (3, 1, "user", "twice"), (8, 1, "user", "long " * 200_000)])
    assert trie.trie(spark.createDataFrame([], SCHEMA)).count() == 0
    assert trie.trie(spark.createDataFrame([(None, 1, "user", "x")], SCHEMA)).count() == 0


def test_one_conversation_in_many_tasks(spark):
    """A conversation that holds most rows is dealt to several tasks and its turns stay in order."""
    rng = random.Random(9)
    rows = [(5, k, "user", str(k)) for k in range(3000)] + conversations(rng, 30, 5, ["a", "b"])[10:]
    check(spark, [r for r in rows if r[0] != 5 or r[3].isdigit()])


def test_blocks():
    at = 1
    for block in range(12):
        assert trie.block_start(block) == at
        at += min(1 << block, trie.WIDEST)


def test_query_equals_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{DIR}/conversations.parquet'")
    want = con.execute(queries.ORACLES["op11_conversation_trie"])
    names = [c[0] for c in want.description]
    got = queries.QUERIES["op11_conversation_trie"](spark, DIR).select(*names).collect()
    assert sorted(map(tuple, got), key=str) == sorted(want.fetchall(), key=str)
