import datetime
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarrylane.operators import graphs, history, nearest, portfolio, spans, terms


def walk(nodes, edges):
    """The greedy walk, one node after the other."""
    best = {}
    for k, s in nodes:
        if k is not None and (k not in best or best[k] is None or (s is not None and s > best[k])):
            best[k] = s
    near = {k: set() for k in best}
    for a, b in edges:
        if a in near and b in near and a != b:
            near[a].add(b)
            near[b].add(a)
    taken = set()
    for k in sorted(best, key=lambda k: (best[k] is None, -(best[k] or 0), k)):
        if not near[k] & taken:
            taken.add(k)
    return {(k, best[k]) for k in taken}


def chosen(spark, nodes, edges):
    n, e = spark.createDataFrame(nodes, "id string, score double"), spark.createDataFrame(edges, "a string, b string")
    return {tuple(r) for r in graphs.independent_set(n, e).collect()}


def test_independent_set(spark):
    assert chosen(spark, [("a", 3.0), ("b", 2.0), ("c", 1.0)], [("a", "b"), ("c", "b")]) == {("a", 3.0), ("c", 1.0)}
    assert chosen(spark, [("a", 3.0), ("b", 3.0)], [("b", "a")]) == {("a", 3.0)}
    assert chosen(spark, [("a", 1.0)], []) == {("a", 1.0)}
    assert chosen(spark, [], [("a", "b")]) == set()
    rng = random.Random(3)
    names = [f"n{i}" for i in range(60)]
    nodes = [(n, rng.choice([None, 1.0, 2.0, rng.random()])) for n in names] + [("n1", 9.0), (None, 3.0)]
    edges = [(rng.choice(names), rng.choice([*names, "none"])) for _ in range(120)] + [("hub", n) for n in names] + [("n0", None)]
    for own in (nodes, [*nodes, ("hub", 0.5)], [*nodes, ("hub", 99.0)]):
        assert chosen(spark, own, edges) == walk(own, edges)


def test_chain_of_worse_neighbours(spark):
    nodes = [(f"{i:02}", float(-i)) for i in range(9)]
    edges = [(f"{i:02}", f"{i + 1:02}") for i in range(8)]
    assert chosen(spark, nodes, edges) == {(f"{i:02}", float(-i)) for i in range(0, 9, 2)}


def followed(marks):
    to = {}
    for a, b in marks:
        if a is not None and b is not None:
            to[a] = min(b, to.get(a, b))
    out = {}
    for start in to:
        seen, at = [start], to[start]
        while at in to and at not in seen:
            seen.append(at)
            at = to[at]
        out[start] = (None, None, min(seen[seen.index(at) :]), at == start) if at in seen else (at, len(seen), None, False)
    return out


def test_last_successors(spark):
    chain = [(f"c{i}", f"c{i + 1}") for i in range(5)]
    cases = [
        chain, [*chain, ("c5", "c0")], [*chain, ("x", "c3"), ("y", "x"), ("c5", "c2")], [("a", "a"), ("b", "a"), (None, "a"), ("d", None)], [("a", "b"), ("b", "a"), ("e", "f"), ("e", "d")],
        [(f"m{i}", "root") for i in range(40)] + [("root", "top")], [],
    ]
    rng = random.Random(5)
    cases.append([(f"r{rng.randrange(80):02}", f"r{rng.randrange(80):02}") for _ in range(70)])
    for marks in cases:
        got = {r.id: (r["last"], r.hops, r.cycle, r.in_cycle) for r in graphs.last_successors(spark.createDataFrame(marks, "id string, of string")).collect()}
        assert got == followed(marks)


def day(n):
    return datetime.date(2026, 1, 1) + datetime.timedelta(n)


def test_versions(spark):
    """A change, a deletion, a return with the old content, and a page that comes late."""
    days = [0, 3, 4, 9, 20]
    held = {"a": "xxyyx", "b": "x-xx-", "c": "--zz-", "d": "qqqqq"}
    rows = [(k, day(d), None if c == "q" else c) for k, own in held.items() for d, c in zip(days, own, strict=True) if c != "-"]
    rows += [rows[0], (None, day(0), "n"), ("n", None, "n")]
    v = history.versions(spark.createDataFrame(rows, "page string, day date, html string"), "page", "day", "html").withColumn("from", F.col("valid_from"))
    got = {k: sorted((r.valid_from, r.valid_to) for r in v.collect() if r.page == k) for k in held}
    assert got == {"a": [(day(0), day(4)), (day(4), day(20)), (day(20), None)], "b": [(day(0), day(3)), (day(4), day(20))], "c": [(day(4), day(20))], "d": [(day(0), None)]}
    assert v.count() == 7
    for n, there in ((0, "abd"), (2, "abd"), (3, "ad"), (8, "abcd"), (20, "ad"), (99, "ad"), (-1, "")):
        assert "".join(sorted(r.page for r in history.as_of(v, day(n)).collect())) == there
    digests = {(r.valid_from, r.digest) for r in v.filter("page = 'a'").collect()}
    assert len({d for _, d in digests}) == 2


def test_at_rate(spark):
    rng = random.Random(6)
    rates = [(rng.choice("abc"), day(rng.randrange(900)), float(rng.randrange(99))) for _ in range(60)] + [("a", None, 1.0), (None, day(1), 1.0)]
    rows = [(i, rng.choice(["a", "b", "c", "d", None]), None if i % 17 == 0 else day(rng.randrange(-50, 1000))) for i in range(300)]
    r = spark.createDataFrame(rates, "ccy string, since date, rate double")
    df = spark.createDataFrame(rows, "id long, k string, day date").withColumn("since", F.lit("x"))
    for days in (7, 90, 5000):
        got = {x.id: x.rate for x in history.at_rate(df, r, "k", "day", "rate", days=days, rate_key="ccy").collect()}
        for i, k, d in rows:
            before = [(s, v) for c, s, v in rates if d and k and c == k and s and s <= d]
            assert got[i] == (max(before)[1] if before else None)
    assert history.at_rate(df.limit(0), r, "k", "day", "rate", rate_key="ccy").count() == 0
    assert {x.rate for x in history.at_rate(df, r.limit(0), "k", "day", "rate", rate_key="ccy").collect()} == {None}


def test_overlapping(spark):
    rng = random.Random(7)
    end = lambda: None if rng.random() < 0.1 else rng.randrange(400)
    make = lambda n: [(i, rng.choice("xy"), lo, (lo + rng.randrange(-2, 60)) if lo is not None and rng.random() < 0.8 else end()) for i in range(n) for lo in [end()]]
    a, b = make(60), make(50)
    frame = lambda rows: spark.createDataFrame([(i, k, None if lo is None else day(lo), None if hi is None else day(hi)) for i, k, lo, hi in rows], "i long, k string, lo date, hi date")
    far = 10**6
    ends = lambda r: (-far if r[2] is None else r[2], far if r[3] is None else r[3])
    for days in (1, 30, 1000):
        for on in ([], ["k"]):
            want = {(x[0], y[0]) for x in a for y in b if max(ends(x)[0], ends(y)[0]) <= min(ends(x)[1], ends(y)[1]) and ends(x)[0] <= ends(x)[1] and ends(y)[0] <= ends(y)[1] and (not on or x[1] == y[1])}
            got = [(r.i, r.b_i) for r in spans.overlapping(frame(a), frame(b), on, days).collect()]
            assert len(got) == len(set(got)) and set(got) == want
    assert spans.overlapping(frame(a), frame(b).limit(0)).count() == 0


def test_overlapping_takes_its_inputs_once(spark):
    """The look at the ends and the join share one pass over rows that may be dear to make."""
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    rows = spark.createDataFrame([(i, day(i), day(i + 9)) for i in range(40)], "i long, lo date, hi date").mapInArrow(count, "i long, lo date, hi date")
    assert spans.overlapping(rows, rows).count() == sum(abs(i - j) <= 9 for i in range(40) for j in range(40))
    assert seen.value == 80


def test_index(spark, tmp_path):
    rows = [(1, "Cookie cookies, the COOKIE_x cookie"), (2, "no cookie: the The"), (3, None), (None, "the"), (4, ""), (5, "the " * 3000), (6, "éthe the")]
    pages = spark.createDataFrame(rows, "id long, html string").withColumns({"term": F.lit("x"), "key": F.lit("y"), "n": F.lit(1)})
    path = str(tmp_path / "index")
    terms.write_index(pages, "id", "html", path, chunks=2)
    got = {(r.term, r.key): r.n for r in terms.look_up(spark, path, ["Cookie", "the", "absent"]).collect()}
    assert got == {("cookie", 1): 2, ("cookie", 2): 1, ("the", 1): 1, ("the", 2): 2, ("the", 5): 3000, ("the", 6): 2}
    read = terms.look_up(spark, path, ["cookie"])._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^]]*folder", read) and re.search(r"PushedFilters: \[.*EqualTo\(term,cookie\)", read)
    lists = spark.read.parquet(path).filter("term = 'the'")
    assert 1 <= lists.count() <= 2 and lists.agg(F.sum("n_hits")).first()[0] == 3005


@pytest.mark.parametrize("pivots", [1, 5, 200])
def test_nearest(spark, pivots, monkeypatch):
    monkeypatch.setattr(nearest, "BLOCK", 16)
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(6, 8)) * 10
    there = [(int(i), (centres[i % 6] + rng.normal(size=8)).tolist()) for i in range(150)]
    there += [(1000 + i, there[7][1]) for i in range(40)]  # copies: ties go to the smaller id
    asked = [(i, (centres[i % 6] + rng.normal(size=8)).tolist()) for i in range(40)] + [(99, there[7][1]), (98, [1e6] * 8)]
    kind = "id long, vector array<double>"
    q, a = spark.createDataFrame([*asked, (97, None), (None, [0.0] * 8)], kind).withColumns({"cell": F.lit("x"), "v": F.lit(1)}), spark.createDataFrame([*there, (None, [0.0] * 8), (5000, None)], kind)
    got = {r.query: (r.id, r.distance) for r in nearest.nearest(q, a, pivots=pivots).collect()}
    ids, m = np.array([i for i, _ in there]), np.array([v for _, v in there])
    for i, v in asked:
        away = np.sqrt(((m - np.array(v)) ** 2).sum(axis=1))
        assert got[i] == (int(ids[np.lexsort((ids, away))[0]]), pytest.approx(away.min()))
    assert len(got) == len(asked)
    assert nearest.nearest(q, a.limit(0)).count() == 0 and nearest.nearest(q.limit(0), a).count() == 0


@pytest.mark.parametrize("kind", ["random", "copies", "far", "huge", "nan"])
def test_nearest_by_products_equals_differences(kind, monkeypatch):
    """Ids and distances are those of differences bit for bit, and few pairs of a block are told apart by them."""
    monkeypatch.setattr(nearest, "REFINED", 50)
    rng = np.random.default_rng(3)
    a, b = rng.normal(size=(60, 64)), rng.normal(size=(80, 64))
    if kind == "copies":
        b[40:] = b[:40]
        a[:20] = b[:20]
    elif kind == "far":
        a, b = a + 1e7, b + 1e7
    elif kind == "huge":
        a, b = a * 1e160, b * 1e160
    elif kind == "nan":
        b[7, 3] = np.nan
    with np.errstate(over="ignore", invalid="ignore"):
        away = nearest._distances(a, b)
        differences = []
        monkeypatch.setattr(nearest, "_distances", lambda *x: differences.append(1) or away)
        best, least = nearest._closest(a, b)
    want = away.argmin(axis=1)
    assert best.tolist() == want.tolist() and np.array_equal(least, away[np.arange(60), want], equal_nan=True)
    assert bool(differences) == (kind in ("huge", "nan"))


def test_viable_and_ties(spark):
    candidates = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "id string")
    reviews = spark.createDataFrame([("a", "holds"), ("a", "refuted"), ("b", "holds"), ("d", None)], "id string, verdict string")
    assert {r.id for r in portfolio.viable(candidates, reviews).collect()} == {"b", "c", "d"}
    rates = spark.createDataFrame([("x", 1, None), ("y", 1, 0.0), ("z", 1, 2.0), ("x", 2, 3.0), ("y", 2, 1.0)], "id string, week int, per_hour double")
    order = spark.createDataFrame([("y", 2), ("x", 1), ("z", 0)], "id string, place int")
    assert {tuple(r) for r in portfolio.next_to_close(rates, order, "id").collect()} == {(1, "x"), (2, "y")}
    gaps = spark.createDataFrame([("k", day(0), 10.0, 1.0), ("k", day(21), 20.0, 1.0), ("k", day(28), 30.0, 1.0)], "k string, week date, usd double, hours double")
    dense = {r.week: r.per_hour for r in portfolio.hourly_rate(gaps, "k").collect()}
    assert dense == {day(0): 10.0, day(7): 10.0, day(14): 10.0, day(21): 15.0, day(28): 25.0}
