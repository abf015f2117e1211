import itertools
import random
import re
from collections import Counter

import duckdb
from pyspark.sql import functions as F

from quarrylane.llm import audit, queries
from quarrylane.llm.common import attach

DIR = "/root/testdata/sf0.001"


def brute(docs, labels):
    """Counts by applying the filters of each order to each document."""
    labels = [row for row in labels if row[0] is not None]
    good, toxic = {i for i, q, _ in labels if q == 1}, {i for i, _, t in labels if t == 1}
    fails = []
    for i, text, lang in docs:
        t = text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        f = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 3 * len(t), "D": bool(re.search(r"[#$%&*|]", t))}
        f["E"] = any((u or "") == t and j is not None and i is not None and j < i for j, u, _ in docs)
        fails.append((lang or "", i, {k for k in f if f[k]}))
    out = {}
    for part in {p for p, _, _ in fails}:
        own = [(i, f) for p, i, f in fails if p == part]
        shapley = Counter()
        for order in map("".join, itertools.permutations("ABCDE")):
            left = own
            for step, letter in enumerate(order, 1):
                gone = [(i, f) for i, f in left if letter in f]
                left = [(i, f) for i, f in left if letter not in f]
                shapley[letter] += len(gone)
                out[part, order, step] = [
                    len(left), len(gone), sum(letter in f for _, f in own) - len(gone), sum(f == {letter} for _, f in own),
                    sum(i in good for i, _ in gone), sum(i in toxic for i, _ in gone),
                ]
        for (p, order, step), figures in out.items():
            if p == part:
                figures.append(shapley[order[step - 1]])
    return out


def found(df):
    return {(r.part, r.filter_order, r.step): [r[f] for f in audit.FIGURES] for r in df.collect()}


def odd_rows():
    rng = random.Random(5)
    words = ["a", "Be", "c#", "DOG", "eel", "fox"]
    texts = [None, "", " \n", "x", "# x", "ABC", "a b " * 150, "Aa " * 300, "日本 " * 500]
    texts += [" ".join(rng.choices(words, k=rng.randrange(1, 400))) for _ in range(20)] * 2
    texts += [" ".join(f"w{rng.randrange(9999)}" for _ in range(250)) for _ in range(10)]
    rows = [(i if i % 11 else None, t, rng.choice(["en", "de", None, ""])) for i, t in enumerate(texts)]
    rows += [rows[5], rows[5], (8, "own", "en"), (8, "own", "de"), (9, "own", "de")]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in range(40)] + [(3, 1, 1), (3, 0, 0), (None, 1, 1), (999, 1, 1)]
    return rows, labels


def test_equals_brute_force(spark):
    rows, labels = odd_rows()
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumns({c: F.lit("x") for c in ("mask", "good", "part", "digest", "first", "n", "quality")})
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").withColumn("mask", F.lit(1))
    assert found(audit.filter_audit(docs, marks)) == brute(rows, labels)
    assert audit.filter_audit(docs.limit(0), marks).count() == 0
    none = found(audit.filter_audit(docs, marks.limit(0)))
    assert none == brute(rows, [])


def test_first_failure_table():
    assert audit.FIRST.shape == (32, 120)
    for number, order in itertools.product(range(32), range(120)):
        steps = [k for k, f in enumerate(audit.ORDERS[order]) if number >> "ABCDE".index(f) & 1]
        assert audit.FIRST[number, order] == min(steps, default=5)


def test_many_parts(spark, monkeypatch):
    """Tasks that give what they hold more than once, as they meet many parts."""
    rows = spark.range(3000).select((F.col("id") % 97).cast("string").alias("part"), (F.col("id") % 32).cast("int").alias("mask"), (F.col("id") % 2 == 0).alias("good"), F.lit(False).alias("toxic"))
    monkeypatch.setattr(audit, "MANY_PARTS", 10)
    got = audit.audit(rows)
    assert got.count() == 97 * 600
    last = got.filter("step = 5").groupBy("filter_order").agg(F.sum("kept").alias("kept")).collect()
    assert {r.kept for r in last} == {len([i for i in range(3000) if i % 32 == 0])}


def test_very_long_text(spark):
    rows = [(1, "word# " * 400_000, "en"), (2, "Word", "en")]
    assert found(audit.filter_audit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), spark.createDataFrame([], "doc_id long, quality int, toxic int"))) == brute(rows, [])


def test_query_equals_sql(spark):
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    want = {tuple(r[:3]): list(r[3:]) for r in con.execute(queries.ORACLES["op13_filter_audit"]).fetchall()}
    assert found(queries.QUERIES["op13_filter_audit"](spark, DIR)) == want


def test_attach_keeps_rows_without_a_group(spark):
    """The left form, with a hot group, cold ones and rows of none."""
    rows = spark.range(4000).select("id", F.when(F.col("id") < 2500, "hot").when(F.col("id") < 2600, F.concat(F.lit("k"), F.col("id"))).otherwise(F.concat(F.lit("none"), F.col("id"))).alias("key"))
    groups = rows.filter("id < 2600").groupBy("key").agg(F.count("*").alias("n"), F.min("id").alias("least"))
    got = attach(rows, groups, "key", "n", 4000, "left")
    assert got.count() == 4000 and got.filter("least is null").count() == 1400 and got.filter("key = 'hot' and least = 0").count() == 2500
