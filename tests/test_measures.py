import datetime
import os

import pytest
from pyspark.sql import functions as F

from quarrylane.functions import cells, measures
from quarrylane.functions import measures as m
from quarrylane.operators import portfolio
from quarrylane.sources import candidates
from quarrylane.streaming import monitors


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def test_measures(spark):
    lit = F.lit
    assert value(spark, measures.score(lit(0.5), lit(100.0), lit(0.0))) is None
    assert [round(value(spark, measures.day_90_share(lit(d))), 3) for d in (25, 35, 45)] == [0.454, 0.348, 0.25]
    assert value(spark, measures.any_of(lit(0.02), 30)) == pytest.approx(0.4545, abs=1e-4)
    assert value(spark, measures.shrunk(lit(0.35), 7, 20, 30)) == pytest.approx(0.1978, abs=1e-4)
    assert value(spark, measures.fee_step(lit(500.0), 500, 15.0, 29.0, 0.02)) == 39
    assert value(spark, measures.tax_with_floor(lit(1000.0), 0.07, 5220.0)) == 5220
    assert value(spark, measures.headroom(lit(70.0))) == pytest.approx(30)
    assert value(spark, measures.penalised(lit(63.0), 0.8, 0.8)) == pytest.approx(40.32)


def test_cells(spark):
    lit = F.lit
    assert value(spark, cells.number(lit("≈$1 530 a month"))) == 1530
    assert value(spark, cells.money(lit("79 RON"))).ccy == "RON"
    assert tuple(value(spark, cells.before_after(lit("195 → —")))) == (195, None)
    assert tuple(value(spark, cells.interval(lit("~21–30")))) == (21, 30, True)
    assert value(spark, cells.id_list(lit("AB-01…03, CD-07"))) == ["AB-01", "AB-02", "AB-03", "CD-07"]
    assert value(spark, cells.prefix(lit("AB-01"))) == "AB" and value(spark, cells.labels(lit("x [Fact] [CALC]"))) == ["fact", "calc"]
    assert value(spark, cells.days(lit("13 d 21 h"))) == pytest.approx(13.875)
    assert value(spark, cells.dotted_date(lit("~08.10.2026"))).day == datetime.date(2026, 10, 8)


def test_reconcile_skips_nulls_and_streaks_need_each_week(spark):
    reviews = spark.createDataFrame([("a", 0.3, 100.0, 4.0, "holds"), ("a", None, 90.0, 6.0, "refuted")], "id string, p double, ceiling double, hours double, verdict string")
    assert tuple(portfolio.reconcile(reviews).first()) == ("a", 0.3, 90.0, 6.0, True)
    days = [datetime.date(2026, 1, 5) + datetime.timedelta(7 * i) for i in (0, 1, 3, 4, 5)]
    weeks = spark.createDataFrame([("x", d, True) for d in days], "k string, week date, over boolean")
    assert sorted(r.week for r in portfolio.streaks(weeks, "k", "week", "over").collect()) == [days[1], days[3], days[4]]


def test_candidate_files_unify(spark, tmp_path):
    from quarrylane.sources import candidates

    (tmp_path / "a.csv").write_text('id,p,ceiling,hours,score\nAA-01,0.5,100,2,25\n')
    (tmp_path / "b.csv").write_text('score,id,ceiling_m6_usd_estimate,p_first_usd_30d_estimate,days\n7,N1,50,0.1,"2-5 wk"\n')
    rows = {r.id: r for r in candidates.read_candidates(spark, str(tmp_path / "a.csv"), str(tmp_path / "b.csv"), required=("id", "p")).collect()}
    assert rows["AA-01"].hours_week == 2 and rows["N1"].days_to_first is None and rows["N1"].p == 0.1
    candidates.write_candidates(spark.createDataFrame([("AA-02", 0.5, 'a "b", c')], "id string, p double, crypto_payout string"), str(tmp_path / "out"))
    again = candidates.read_candidates(spark, str(tmp_path / "out"), required=("id", "p")).first()
    assert (again.id, again.p, again.crypto_payout) == ("AA-02", 0.5, 'a "b", c')
    (tmp_path / "t.md").write_text("| id | v |\n|---|---|\n  | AA-01 | 5 → 3 |\n")
    table = candidates.table_with(candidates.read_pipe_tables(spark, str(tmp_path / "t.md")), r"^[A-Z]+-\d+$", "id", "v")
    assert [tuple(r) for r in table.collect()] == [("AA-01", "5 → 3")]


def only(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_worked_numbers(spark):
    """Numbers that the studied material works out."""
    lit = F.lit
    r = only(
        spark,
        m.after_allowances(lit(6300.0)).alias("pay"), m.after_dividends(lit(26655.9), lit(0.12), lit(0.06)).alias("a"), m.after_dividends(lit(26655.9), lit(0.07), lit(0.06)).alias("c0"),
        m.floor_per_head(17400.0, lit(1)).alias("head"), m.gates(lit(1530.0)).alias("g"), m.net_of_compute(lit(100.0), lit(5.0)).alias("net"), m.users_ceiling(lit(1000.0), 0.5).alias("users"),
        m.application_cost(lit(10.0)).alias("apply"), m.margin(lit(100.0), lit(25.0)).alias("margin"), m.stars(lit(1000.0)).alias("stars"), m.cpm_share(lit(200.0)).alias("cpm"), m.sale_multiple(lit(3000.0), lit(100.0)).alias("multiple"),
        m.to_floor(lit(70000.0), 5220.0, 0.07).alias("missing"), m.mail_ceiling(lit(2000.0), lit(25.0), lit(4)).alias("mail"), m.views_ceiling(lit(10000.0), lit(2.0), 0.5, 0.8).alias("views"), m.monthly(lit(1200.0), lit("year")).alias("month"),
        m.pool_share(lit(1.0), lit(4.0), lit(100.0)).alias("pool"), m.enforcement(lit(2027), 2027).alias("stage"), m.rail_factor(lit("crypto")).alias("rail"), m.first_month_score(lit(0.5), lit(100.0), lit(300.0), lit(10.0)).alias("first"),
        m.per_hour(lit(433.0), lit(10.0)).alias("hour"), m.needed(lit(30.0)).alias("needed"), m.comparable(lit(None).cast("double"), lit(100.0), 0.4, lit(0.5)).alias("comparable"), m.share_ok(lit(72.0), lit(28.0)).alias("ok"), m.waterfall(lit(120.0), 1.0, 0.2, 0.1, 5.0, 0.5).alias("fall"), m.funnel(lit(1000.0), 0.1, 0.5).alias("funnel"), m.token_cost(lit(1e6), lit(2e6), lit(3.0), lit(15.0)).alias("tokens"),
    )
    close = lambda x, y, by=0.005: abs(x - y) <= by
    assert close(r.pay.net, 5342.04) and close(r.pay.tax, 390.96) and close(r.pay.load, 0.316, 0.0005)
    assert close(r.a, 4606.14) and close(r.c0, 3353.31) and close(r.head, 5220) and close(m.break_even(5220, 0.07), 74571, 0.5)
    assert (r.g.day_60, r.g.day_90, r.g.close) == (382.5, 765.0, 153.0) and close(r.missing, 4571.43)
    assert (r.net, r.users, r.apply, r.margin.usd, r.margin.share, r.stars, r.cpm, r.multiple) == (75.0, 320.0, 24.0, 75.0, 0.75, 13.0, 10.0, 30.0)
    assert (r.mail, r.views, r.month, r.pool, r.stage, r.rail, r["first"].value) == (200.0, 8.0, 100.0, 25.0, 0.1, 0.5, 10.0)
    assert close(r.hour, 10) and close(r.needed, 70) and r.comparable == 50.0 and r.ok and close(r.fall, 42.5) and close(r.funnel, 50) and close(r.tokens, 33)


def test_portfolio(spark):
    base = spark.createDataFrame([("a2", 0.33, 0.0, 0.6), ("a2", 0.3, 0.15, 0.6), *[(g, p, None, None) for g, p in (("pb", 0.2), ("a", 0.1), ("b", 0.1), ("c", 0.1), ("d", 0.1))]], "correlation_group string, p double, p_otherwise double, chance double")
    assert abs(portfolio.with_common_factor(base, 0.9).first().p_any - 0.60) < 0.01
    parts = spark.createDataFrame([("x", 0.18, 1.0), ("x", 0.12, 0.5)], "id string, w double, p double")
    assert abs(portfolio.total_probability(parts, "id").first().p - 0.24) < 1e-9
    items = spark.createDataFrame([("PB", 2.0, 400.0, 0.15, None), ("PB", 4.0, 250.0, 0.15, None)], "id string, qty double, price double, fee double, cost double")
    assert abs(portfolio.unit_ceiling(items, "id").first().ceiling - 1530) < 1e-9
    setups = spark.createDataFrame([("x", float(n)) for n in (3, 4, 5, 6, 6, 6)], "id string, n double")
    assert abs(portfolio.retained(setups, "id").first().customers - 24) < 1e-9
    ids = portfolio.renamed_ids(spark.createDataFrame([("N7",), ("N9",)], "id string"), spark.createDataFrame([("N7", "PB-01")], "old string, new string"))
    assert {r.id for r in ids.collect()} == {"PB-01", "N9"}
    assert portfolio.calibration(spark.createDataFrame([(10.0, 4.0), (20.0, 8.0)], "before double, after double")).first().ratio == 0.4
    weights, money = spark.createDataFrame([("s", "a", 0.5), ("s", "b", 1.0)], "scenario string, id string, weight double"), spark.createDataFrame([("a", 100.0), ("b", 10.0)], "id string, ceiling double")
    assert portfolio.scenario_money(money, weights).first().usd_month == 60.0


def test_reviews(spark, tmp_path):
    (tmp_path / "v.md").write_text("# t\n## AB-01 — x\n\n### AB-01 · lens one — holds_with_fixes\n\n- Lens: text\n- Fixed P(first ≤ 30): 0.2\n- Fixed ceiling of month 6-th, $: 2 040\n\n**Fixes**\n\n1. first\n2. second: 5\n\n### AB-01 · two — refuted\n\n- P(x): None\n\n1. only\n")
    got = {r.lens: r for r in candidates.read_reviews(spark, str(tmp_path / "v.md")).collect()}
    one, two = got["lens one"], got["two"]
    assert (one.id, one.verdict, one.p, one.ceiling_usd, one.evidence) == ("AB-01", "holds_with_fixes", 0.2, 2040.0, ["first", "second: 5"])
    assert (two.verdict, two.p, two.ceiling_usd, two.evidence) == ("refuted", None, None, ["only"])


def test_lead_routing(spark, tmp_path):
    """An answered lead, one that passes on, and one that expires, on event time."""
    at = lambda minute: datetime.datetime(2026, 1, 1, 12) + datetime.timedelta(minutes=minute)
    batches = [[("a", at(0), None), ("b", at(0), None)], [("b", at(10), "yes")], [("c", at(40), None)], [("a", at(45), None), ("z", at(100), None)], [("z", at(101), "yes")]]
    source, known = tmp_path / "in", set()
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, "lead string, ts timestamp, answer string").coalesce(1).write.mode("append").parquet(str(source))
        for f in set(source.glob("part-*")) - known:
            os.utime(f, (1e9 + k, 1e9 + k))  # the stream takes the files in this order
            known.add(f)
    stream = spark.readStream.schema("lead string, ts timestamp, answer string").option("maxFilesPerTrigger", 1).parquet(str(source))
    q = monitors.route_leads(stream, ["x", "y"]).writeStream.format("memory").queryName("routed").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = {}
    for r in spark.table("routed").collect():
        got.setdefault(r.lead, []).append((r.contractor, r.status))
    assert got["b"] == [("x", "offered"), ("x", "answered")] and got["z"] == [("x", "offered"), ("x", "answered")]
    assert got["a"] == [("x", "offered"), ("y", "offered"), (None, "expired")]
    assert got["c"][0] == ("x", "offered")



def test_weekly_share(spark, tmp_path):
    """Shares of closed weeks; a row later than the watermark allows no longer counts."""
    day = lambda n: datetime.datetime(2026, 1, 1) + datetime.timedelta(n)
    batches = [[(day(0), True, 30.0), (day(1), False, 10.0)], [(day(20), True, 5.0)], [(day(0), True, 99.0)], [(day(40), False, 1.0)], [(day(60), False, 1.0)]]
    source, sink = str(tmp_path / "in"), str(tmp_path / "out")
    for rows in batches:
        spark.createDataFrame(rows, "ts timestamp, flagged boolean, amount double").coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema("ts timestamp, flagged boolean, amount double").parquet(source)
        q = monitors.weekly_share(stream).writeStream.format("parquet").option("path", sink).outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        q.awaitTermination()
    got = spark.read.parquet(sink).orderBy("window").collect()
    assert [(r.share, r.amount) for r in got] == [(0.75, 40.0), (1.0, 5.0), (0.0, 1.0)]
