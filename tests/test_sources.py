import pytest
from pyspark.sql import functions as F

from quarrylane.functions import cells, measures
from quarrylane.operators import portfolio
from quarrylane.sources import candidates, pipe_tables

#: The layouts of the candidate files: fixed values.
HEADERS = [
    "id,niche,format,market,product,monetization,payout_rail,crypto_payout,demand_evidence,competition,fleet_feasible,test_14d,days_to_first_usd,p_first_usd_30d,month6_ceiling_usd,ceiling_formula,owner_hours_week,it_park",
    "id,niche,format,market,monetization,payout_rail,crypto_payout,days_to_first_usd,month6_ceiling_usd,ceiling_formula,p_first_usd_30d,owner_hours_week,score",
    "id,niche,format,market,monetization,payout_rail,crypto_payout,it_park,demand_evidence,test_14d,days_to_first_usd,p_first_usd_30d,month6_ceiling_usd,ceiling_formula,owner_hours_week,main_risk",
    "id,niche,buyer_market,channel,it_park,price_evidence,ceiling_m6_usd_estimate,ceiling_formula,p_first_usd_30d_estimate,owner_h_week_estimate,score,test_14d,time_to_first_usd",
    "id,niche,format,market,price,demand_evidence,competition,payout_rail,crypto_payout,it_park,days_to_first_usd,p_first_usd_30d,month6_ceiling_usd,ceiling_formula,owner_hours_week,score",
    "id,niche,format,market,price,demand_evidence,competition,payout_rail,crypto_payout,it_park,days_to_first_usd,p_first_usd_30d,month6_ceiling_usd,ceiling_formula,owner_hours_week,score",
    "id,niche,format,market,monetization,payout_rail,crypto_payout,days_to_first_usd,month6_ceiling_usd,ceiling_formula,p_first_usd_30d,owner_hours_week",
    "id,niche,format,market,monetization,payout_rail,crypto_payout,underrated_class,demand_evidence,competition,it_park,days_to_first_usd,p_first_usd_30d,month6_ceiling_usd,ceiling_formula,owner_hours_week,score",
]


def cell(name, k):
    """A cell of row ``k``: figures where the name has them, else text with a comma and quotes."""
    if name == "id":
        return f"AB-{k:02}"
    figures = {"days": 14 + k, "time": "2-5 wk", "p_first": 0.25, "ceiling_m6": 100 * k, "month6": 100 * k, "owner": 5 * (k - 1), "score": "" if k == 1 else round(0.25 * 100 * k / (5 * (k - 1)), 1)}
    return next((str(v) for start, v in figures.items() if name.startswith(start)), f'"{name}, ""{k}"""')


def test_all_layouts(spark, tmp_path):
    paths = []
    for i, header in enumerate(HEADERS):
        end = "\r\n" if i == 2 else "\n"
        rows = [",".join(cell(c, k) for c in header.split(",")) for k in (1, 2, 3)]
        (tmp_path / f"{i}.csv").write_bytes((end.join([header, *rows]) + end).encode())
        paths.append(str(tmp_path / f"{i}.csv"))
    got = candidates.read_candidates(spark, *paths).withColumn("again", measures.score(F.col("p"), F.col("ceiling_usd").cast("double"), F.col("hours_week"))).collect()
    assert len(got) == 24
    assert all(r.p == 0.25 and r.ceiling_usd == 100 * int(r.id[-1]) and r.hours_week == 5 * (int(r.id[-1]) - 1) for r in got)
    assert {r.source_note for r in got if r.score_stored is None and r.id == "AB-02"} == {"0.csv", "2.csv", "6.csv"}
    assert all(abs(r.again - r.score_stored) <= 0.5 for r in got if r.score_stored is not None)
    assert all((r.again is None) == (r.hours_week == 0) for r in got)
    assert all(r.time_to_first == "2-5 wk" and r.days_to_first is None for r in got if r.source_note == "3.csv")
    assert all(r.days_to_first == 14 + int(r.id[-1]) for r in got if r.source_note != "3.csv")
    assert all(r.it_park is None or "\r" not in r.it_park for r in got)


def test_unknown_layout_is_refused(spark, tmp_path):
    (tmp_path / "x.csv").write_text("id,p,best_month,hours\nAB-01,0.1,5,2\n")
    with pytest.raises(ValueError, match="ceiling_usd"):
        candidates.read_candidates(spark, str(tmp_path / "x.csv"))


REVIEWS = """# checks

| ID | P |
|---|---|
| EA-08 | None |

## EA-08 — assistants

### EA-08 · lens «payout» — holds_with_fixes

- Wording of the lens: PAYOUT & LEGAL: 6-month: 99
- Fixed P(first $ ≤ 30 days): None
- Fixed ceiling of month 6-, $: None

**Fixes**

1. The rail holds. See 2026-06-15T11:00
2. Second.

**Evidence** (address, date)

- [official, Filing] Report of 2026-06-15T11:00 — https://example.com/a/b : "quote"
- month 6- without a label: 15

### EA-08 · lens «demand» — holds_with_fixes

- Wording: DEMAND
- Fixed P(first $ ≤ 30 days): 0.2
- Fixed ceiling of month 6-, $: 800

**Fixes**

1. Only.

## Further checks

### No record of its own

- Fixed P(x): 0.9
"""


def test_reviews_without_figures(spark, tmp_path):
    (tmp_path / "v.md").write_text(REVIEWS)
    got = candidates.read_reviews(spark, str(tmp_path / "v.md"))
    payout, demand = sorted(got.collect(), key=lambda r: r.p or 0)
    assert (payout.p, payout.ceiling_usd, demand.p, demand.ceiling_usd) == (None, None, 0.2, 800.0)
    assert payout.evidence == ["The rail holds. See 2026-06-15T11:00", "Second."] and demand.evidence == ["Only."] and demand.sources == []
    first, second = payout.sources
    assert (first.labels, first.url) == (["official, filing"], "https://example.com/a/b") and (second.labels, second.url) == ([], None)
    cautious = portfolio.reconcile(got.select("id", "verdict", "p", F.col("ceiling_usd").alias("ceiling"), F.lit(3.0).alias("hours"))).first()
    assert (cautious.p, cautious.ceiling, cautious.refuted) == (0.2, 800.0, False)


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


@pytest.mark.parametrize(
    ("text", "ids"),
    [
        ("AB-98…101", ["AB-98", "AB-99", "AB-100", "AB-101"]), ("N1, N3…N5", ["N1", "N3", "N4", "N5"]), ("AB-01…03, CD-07", ["AB-01", "AB-02", "AB-03", "CD-07"]),
        ("AB-099…AB-101", ["AB-099", "AB-100", "AB-101"]), ("EA-08 (RO), by hand", ["EA-08"]), ("none", []), (None, None),
    ],
)
def test_id_lists(spark, text, ids):
    assert value(spark, cells.id_list(F.lit(text).cast("string"))) == ids


@pytest.mark.parametrize(
    ("text", "ranges"),
    [
        ("27.09.2026", ["2026-09-27 2026-09-27"]), ("~08.10.2026", ["2026-10-05 2026-10-11 ~"]), ("до ~20.10.2026", ["None 2026-10-23 ~"]), ("until 20.10.2026", ["None 2026-10-20"]),
        ("01.11 и 15.11.2026", ["2026-11-01 2026-11-01", "2026-11-15 2026-11-15"]), ("01.11 and 15.11.2026", ["2026-11-01 2026-11-01", "2026-11-15 2026-11-15"]), ("21–25.11.2026", ["2026-11-21 2026-11-25"]),
        ("28.09–02.10.2026", ["2026-09-28 2026-10-02"]), ("30.12.2026–02.01.2027", ["2026-12-30 2027-01-02"]), ("11.2026", ["2026-11-01 2026-11-30"]), ("2.2028", ["2028-02-01 2028-02-29"]),
        ("31.02.2026", []), ("soon", []), ("", []),
    ],
)
def test_date_ranges(spark, text, ranges):
    got = value(spark, cells.date_ranges(F.lit(text)))
    assert [f"{r.lo} {r.hi}{' ~' * r.approx}" for r in got] == ranges


PLAN = """text | with a pipe

| ID | Name | Name |
|---|:--:|---|
| AB-01 | one | x \\| y |
| AB-02 | two |

* a list
  | k | |
  |---|---|
  | 1 | 2 |

| no | header |
| at | all |
"""


def test_pipe_tables(spark, tmp_path):
    (tmp_path / "deep").mkdir()
    (tmp_path / "a.md").write_text(PLAN)
    (tmp_path / "deep" / "b.md").write_bytes(PLAN.replace("\n", "\r\n").encode())
    (tmp_path / "c.txt").write_text(PLAN)
    (tmp_path / "empty.md").write_text("")
    found = pipe_tables.read_tables(spark, str(tmp_path))
    assert found.rdd.getNumPartitions() == 3
    rows = sorted(map(tuple, found.drop("file").collect()))
    own = [(0, 5, ["ID", "Name", "Name"], ["AB-01", "one", "x | y"]), (0, 6, ["ID", "Name", "Name"], ["AB-02", "two"]), (1, 11, ["k", ""], ["1", "2"]), (2, 13, [], ["no", "header"]), (2, 14, [], ["at", "all"])]
    assert rows == sorted(own * 2)
    path = f"file://{tmp_path}/a.md"
    first = pipe_tables.read_tables(spark, path, lines="3-6")
    assert first.columns == ["line", "ID", "Name", "Name_"] and sorted(map(tuple, first.collect())) == [(5, "AB-01", "one", "x | y"), (6, "AB-02", "two", None)]
    assert pipe_tables.read_tables(spark, path, table=1).columns == ["line", "k", "column_2"]
    for wrong in ({"table": 2}, {"lines": "1-99"}, {"table": 7}):
        with pytest.raises(Exception, match="one with a header"):
            pipe_tables.read_tables(spark, path, **wrong)


def test_four_tables_joined_by_lines(spark, tmp_path):
    """Tables of one width and one form of ids are told apart by their lines, and split tables join one to one."""
    part = lambda name, ids: [f"### {name}", "", f"| ID | {name} |", "|---|---|", *[f"| AB-{i:02} | {name}{i} |" for i in ids], ""]
    lines = [*part("A", range(31)), *part("B", range(31)), *part("C", range(31)), *part("D", range(31, 104))]
    (tmp_path / "p.md").write_text("\n".join(lines))
    starts = [i + 3 for i, x in enumerate(lines) if x.startswith("###")]
    a, b, c, d = (pipe_tables.read_tables(spark, str(tmp_path / "p.md"), lines=f"{s}-{s + n}") for s, n in zip(starts, (32, 32, 32, 74), strict=True))
    assert [t.count() for t in (a, b, c, d)] == [31, 31, 31, 73]
    assert a.drop("line").join(b.drop("line"), "ID").join(c.drop("line"), "ID").count() == 31
    assert a.select("ID").union(d.select("ID")).distinct().count() == 104
