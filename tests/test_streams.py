import datetime
import os

import pytest
from pyspark.sql import functions as F

from quarrylane.operators import admission, portfolio
from quarrylane.streaming import monitors

EPOCH = datetime.datetime(2026, 1, 5)  # a Monday


def at(**by):
    return EPOCH + datetime.timedelta(**by)


class Feed:
    """A folder that a stream reads one batch after another, with a checkpoint that restarts go on from."""

    def __init__(self, spark, folder, schema):
        self.spark, self.schema, self.source, self.folder, self.n = spark, schema, folder / "in", folder, 0

    def add(self, rows):
        self.spark.createDataFrame(rows, self.schema).coalesce(1).write.mode("append").parquet(str(self.source))
        for f in self.source.glob("part-*"):
            if os.stat(f).st_mtime > 2e9 - 1 or os.stat(f).st_mtime < 1e9 or os.stat(f).st_mtime > 1.1e9:
                os.utime(f, (1e9 + self.n, 1e9 + self.n))  # the stream takes the files in this order
        self.n += 1

    def stream(self):
        return self.spark.readStream.schema(self.schema).option("maxFilesPerTrigger", 1).parquet(str(self.source))

    def run(self, transform):
        """Everything there is so far, then the stream ends; results gather in a folder."""
        out = transform(self.stream()).writeStream.format("parquet").option("path", str(self.folder / "out")).outputMode("append")
        out.option("checkpointLocation", str(self.folder / "c")).trigger(availableNow=True).start().awaitTermination()

    def results(self):
        return self.spark.read.parquet(str(self.folder / "out"))


def test_repeated_answers_leave_a_lead_closed(spark, tmp_path):
    feed = Feed(spark, tmp_path, "lead string, ts timestamp, answer string")
    far = at(days=40)
    for rows in ([("a", at(), None), ("b", at(), None)], [("a", at(minutes=5), "yes")], [("a", at(minutes=7), "yes"), ("a", at(minutes=8), None)], [("z", at(hours=3), None)], [("b", at(hours=4), "late")]):
        feed.add(rows)
    route = lambda s: monitors.route_leads(s, ["x", "y"])
    feed.run(route)
    feed.add([("a", far, None)])  # long after it closed: a new lead, also over a restart
    feed.add([("z", far + datetime.timedelta(minutes=2), None)])
    feed.run(route)
    got = {}
    for r in feed.results().collect():
        got.setdefault(r.lead, []).append((r.contractor or "", r.status))
    assert sorted(got["a"]) == [("x", "answered"), ("x", "offered"), ("x", "offered")]
    assert sorted(got["b"]) == [("", "expired"), ("x", "offered"), ("y", "offered")]


def test_week_runs_equal_streaks(spark, tmp_path):
    """A missing week, a false one, rows out of order and repeated, and a restart in the middle of a run."""
    weeks = {"p": {0: True, 1: True, 2: True, 4: True, 5: True, 6: False, 7: True, 8: True}, "q": {1: True, 3: True, 4: True}, "r": {8: True, 9: True}}
    day = lambda w: (EPOCH + datetime.timedelta(7 * w)).date()
    rows = [(k, day(w), v) for k, own in weeks.items() for w, v in own.items()]
    want = portfolio.streaks(spark.createDataFrame(rows, "k string, week date, over boolean"), "k", "week", "over").collect()
    feed = Feed(spark, tmp_path, "k string, week timestamp, over boolean")
    at_week = lambda w: at(days=7 * w)
    order = [1, 0, 2, 3, 4, 5]
    for w in order:
        feed.add([(k, at_week(w), own[w]) for k, own in weeks.items() if w in own] or [("other", at_week(w), None)])
    runs = lambda s: monitors.week_runs(s, "k", "week", "over")
    feed.run(runs)
    first = feed.results().count()
    for w in (6, 7, 8, 9):
        own = [(k, at_week(w), o[w]) for k, o in weeks.items() if w in o]
        feed.add(own + own)
    feed.add([("other", at_week(14), False)])
    feed.add([("other", at_week(18), False)])
    feed.run(runs)
    got = {(r.key, r.week.date(), r.held) for r in feed.results().collect()}
    assert 0 < first < len(got)
    assert got == {(r.k, r.week, r.held) for r in want}


def test_trailing_counts_equal_busy(spark, tmp_path):
    rows = [(i, at(hours=7 * i % 500), "ab"[i % 7 == 0]) for i in range(0, 90, 2)]
    df = spark.createDataFrame(rows, "key long, ts timestamp, place string")
    want = {(r.place, r.day, r.n) for r in portfolio.busy(df, "place", "ts", least=5).collect()}
    low = {(r.place, r.day, r.n) for r in portfolio.busy(df, "place", "ts", least=0, days=7).collect() if r.n < 10}
    ordered = sorted(rows, key=lambda r: r[1])
    late = [*ordered[:20:2], *ordered[1:20:2], *ordered[20:]]  # out of order, and all of it twice
    for name, transform, expected in (("busy", lambda s: monitors.busy_places(s, "place", "ts", "key", least=5, late="30 days"), want), ("low", lambda s: monitors.under_demand(s, "place", "ts", "key", late="30 days"), low)):
        feed = Feed(spark, tmp_path / name, "key long, ts timestamp, place string")
        for i in range(0, len(late), 15):
            feed.add(late[i : i + 15] + late[max(i - 5, 0) : i])
        feed.add([(1000, at(days=90), "end")])
        feed.add([(1001, at(days=150), "end")])
        feed.run(transform)
        got = {(r.place, r.day, r.n) for r in feed.results().collect() if r.place != "end"}
        assert got == expected and expected


def sequential(rows, least=0.72):
    """What is admitted, one row after the other."""
    sums, out = {}, {}
    for key, group, part, amount in rows:
        ours, others = sums.get(group, (0.0, 0.0))
        amount = amount or 0.0
        enters = bool(part) or (ours + others + amount > 0 and ours / (ours + others + amount) >= least)
        if part:
            ours += amount
        elif enters:
            others += amount
        sums[group] = ours, others
        out[key] = (enters, round(ours, 6), round(others, 6))
    return out


JOURNAL = [(k, "ab"[k % 3 == 0], [True, False, None, False, True][k * 7 % 5], None if k == 11 else float(k * 37 % 90)) for k in range(120)]
KIND = "key long, place string, part boolean, amount double"


@pytest.mark.parametrize("partitions", [1, 5])
def test_admission_equals_the_sequence(spark, partitions):
    df = spark.createDataFrame(JOURNAL, KIND).withColumns({"day": F.col("key"), "admitted_by": F.lit("x")}).repartition(partitions)
    got = {r.key: (r.admitted, round(r.part_sum, 6), round(r.other_sum, 6)) for r in admission.admit(df, ["place"], ["key"]).collect()}
    assert got == sequential(JOURNAL)
    assert {v[0] for v in got.values()} == {True, False}
    assert admission.admit(df.limit(0), ["place"], ["key"]).count() == 0


def test_gate_replays_batches(spark, tmp_path):
    """Batches decide as the whole would; a batch that is played again changes nothing and counts once."""
    path = str(tmp_path / "gate")
    decide = admission.gate(path, ["place"], ["key"], snapshot_every=3)
    batches = [JOURNAL[i : i + 15] for i in range(0, 120, 15)]
    for n, rows in enumerate(batches):
        frame = spark.createDataFrame([r for r in rows if n != 4 or r[1] == "b"], KIND)
        decide(frame, n)
        if n in (0, 3, 6):
            decide(frame, n)
    got = {r.key: (r.admitted, round(r.part_sum, 6), round(r.other_sum, 6)) for r in spark.read.parquet(f"{path}/decisions").collect()}
    assert got == sequential([r for r in JOURNAL if not (60 <= r[0] < 75 and r[1] == "a")])
    snapshots = spark.read.parquet(f"{path}/sums").filter("batch % 3 = 0 and batch > 0").groupBy("batch").count().collect()
    assert [r["count"] for r in snapshots] == [2, 2]


def test_gate_as_a_stream(spark, tmp_path):
    feed = Feed(spark, tmp_path, KIND)
    path = str(tmp_path / "gate")
    run = lambda: feed.stream().writeStream.foreachBatch(admission.gate(path, ["place"], ["key"])).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    for i in range(0, 120, 30):
        feed.add(JOURNAL[i : i + 30])
        if i == 30:
            run()  # and restarted for the rest
    run()
    got = {r.key: (r.admitted, round(r.part_sum, 6), round(r.other_sum, 6)) for r in spark.read.parquet(f"{path}/decisions").collect()}
    assert got == sequential(JOURNAL)
