"""Queries over the supplied tables, each with the SQL it is held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarrylane.functions import cells
from quarrylane.functions import measures as m
from quarrylane.operators import admission, graphs, history, nearest, portfolio, spans, terms
from quarrylane.session import scratch
from quarrylane.sources import candidates

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str) -> Callable:
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__], ORACLES[f.__name__] = f, sql
        return f

    return add


def t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("""SELECT c_custkey, round(c_acctbal * n / (n + 1), 4) AS score FROM (
  SELECT c_custkey, any_value(c_acctbal) AS c_acctbal, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey)
ORDER BY score DESC, c_custkey LIMIT 10""")
def customer_score_top10(spark, d):
    n = t(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"))
    c = t(spark, d, "customer").join(n, F.col("c_custkey") == F.col("o_custkey"), "left").withColumn("n", F.coalesce("n", F.lit(0)))
    scored = c.select("c_custkey", F.round(m.score(F.col("c_acctbal"), F.col("n"), F.col("n") + 1), 4).alias("score"))
    return portfolio.top(scored, 10, "score", "c_custkey")


@query("""SELECT o_orderkey, min(l_discount) AS least_discount, min(l_extendedprice) AS least_price, max(l_quantity) AS most_quantity, bool_or(l_returnflag = 'R' AND l_discount > 0.08) AS refuted
FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey""")
def order_line_reconcile(spark, d):
    merged = portfolio.reconcile(_reviews(spark, d)).select(F.col("id").alias("o_orderkey"), F.col("p").alias("least_discount"), F.col("ceiling").alias("least_price"), F.col("hours").alias("most_quantity"), "refuted")
    return t(spark, d, "orders").select("o_orderkey").join(merged, "o_orderkey", "left")


def _reviews(spark, d):
    """An order's lines as its reviews."""
    verdict = F.when((F.col("l_returnflag") == "R") & (F.col("l_discount") > 0.08), "refuted").otherwise("holds")
    return t(spark, d, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_discount").alias("p"), F.col("l_extendedprice").alias("ceiling"), F.col("l_quantity").alias("hours"), verdict.alias("verdict"))


@query("""SELECT o_orderkey, o_totalprice FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R' AND l_discount > 0.08)""")
def viable_orders(spark, d):
    orders = t(spark, d, "orders").select(F.col("o_orderkey").alias("id"), "o_totalprice")
    return portfolio.viable(orders, _reviews(spark, d)).withColumnRenamed("id", "o_orderkey")


@query("""SELECT l_returnflag, round(quantile_cont(l_extendedprice, 0.25), 4) AS p25, round(quantile_cont(l_extendedprice, 0.5), 4) AS p50, round(quantile_cont(l_extendedprice, 0.75), 4) AS p75,
round(quantile_cont(l_extendedprice, 0.9), 4) AS p90, round(avg(l_extendedprice), 4) AS mean, max(l_extendedprice) AS most FROM lineitem GROUP BY l_returnflag""")
def price_quantiles(spark, d):
    lines = t(spark, d, "lineitem")
    q = portfolio.quantiles(lines, "l_returnflag", "l_extendedprice", {"p25": 0.25, "p50": 0.5, "p75": 0.75, "p90": 0.9}, 1000.0)
    rest = lines.groupBy("l_returnflag").agg(F.round(F.avg("l_extendedprice"), 4).alias("mean"), F.max("l_extendedprice").alias("most"))
    return rest.join(q.select("l_returnflag", *[F.round(c, 4).alias(c) for c in ("p25", "p50", "p75", "p90")]), "l_returnflag")


@query("SELECT l_orderkey, round(1 - product(1 - l_discount), 6) AS p_any FROM lineitem GROUP BY l_orderkey")
def order_any_discount(spark, d):
    rows = t(spark, d, "lineitem").withColumnRenamed("l_discount", "p")
    return portfolio.at_least_one(rows, "l_orderkey").withColumn("p_any", F.round("p_any", 6))


@query("""SELECT o_orderpriority, count(*) AS n, round(median(o_totalprice), 4) AS median_price, count(*) FILTER (o_totalprice >= 200000) AS n_large, count(*) FILTER (o_totalprice < 20000) AS n_small
FROM orders GROUP BY o_orderpriority HAVING count(*) >= 20""")
def priority_profile(spark, d):
    price, orders = F.col("o_totalprice"), t(spark, d, "orders")
    g = orders.groupBy("o_orderpriority").agg(F.count("*").alias("n"), F.count_if(price >= 200000).alias("n_large"), F.count_if(price < 20000).alias("n_small")).filter("n >= 20")
    q = portfolio.quantiles(orders, "o_orderpriority", "o_totalprice", {"median_price": 0.5}, 10_000.0)
    return g.join(q.withColumn("median_price", F.round("median_price", 4)), "o_orderpriority")


@query("""WITH mo AS (SELECT l_linestatus, date_trunc('year', l_shipdate)::DATE AS year, date_trunc('month', l_shipdate)::DATE AS month,
  sum(CASE WHEN l_returnflag = 'R' THEN l_quantity ELSE 0 END) AS part, sum(l_quantity) AS whole FROM lineitem GROUP BY ALL),
sh AS (SELECT *, sum(part) OVER w / sum(whole) OVER w AS share FROM mo WINDOW w AS (PARTITION BY l_linestatus, year ORDER BY month ROWS UNBOUNDED PRECEDING))
SELECT l_linestatus, year::VARCHAR AS year, count(*) FILTER (share < 0.3) AS months_below, round(arg_max(share, month), 6) AS final_share FROM sh GROUP BY ALL""")
def ytd_return_share(spark, d):
    part = F.when(F.col("l_returnflag") == "R", F.col("l_quantity")).otherwise(0.0)
    shares = portfolio.running_share(t(spark, d, "lineitem").withColumn("r", part), "l_linestatus", "l_shipdate", "r", "l_quantity")
    return shares.withColumn("year", F.col("year").cast("string")).groupBy("l_linestatus", "year").agg(F.count_if(F.col("share") < 0.3).alias("months_below"), F.round(F.max_by("share", "month"), 6).alias("final_share"))


@query("""WITH w AS (SELECT event_type, date_trunc('week', ts)::DATE AS week, sum(value) AS total, count(*) AS n FROM events GROUP BY ALL),
f AS (SELECT *, date_diff('day', DATE '1970-01-05', week) // 7 - row_number() OVER (PARTITION BY event_type ORDER BY week) AS run FROM w WHERE n >= 2)
SELECT event_type, week::VARCHAR AS week, held FROM (SELECT event_type, week, row_number() OVER (PARTITION BY event_type, run ORDER BY week) AS held FROM f) WHERE held >= 2""")
def two_week_streaks(spark, d):
    weeks = t(spark, d, "events").groupBy("event_type", F.date_trunc("week", "ts").cast("date").alias("week")).agg(F.sum("value").alias("total"), F.count("*").alias("n"))
    held = portfolio.streaks(weeks.withColumn("over", F.col("n") >= 2), "event_type", "week", "over")
    return held.select("event_type", F.col("week").cast("string").alias("week"), F.col("held").cast("long").alias("held"))


@query("""SELECT c_custkey, c_mktsegment FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F')""")
def customers_without_orders(spark, d):
    """Customers without a finished order."""
    c, o = t(spark, d, "customer"), t(spark, d, "orders").filter("o_orderstatus = 'F'")
    return c.join(o, c.c_custkey == o.o_custkey, "left_anti").select("c_custkey", "c_mktsegment")


@query("""SELECT c_mktsegment, count(*) AS n FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey) GROUP BY c_mktsegment""")
def segments_with_orders(spark, d):
    c, o = t(spark, d, "customer"), t(spark, d, "orders")
    return c.join(o, c.c_custkey == o.o_custkey, "left_semi").groupBy("c_mktsegment").agg(F.count("*").alias("n"))


@query("""SELECT year(o_orderdate) AS year, count(*) FILTER (o_orderstatus = 'F') AS F, count(*) FILTER (o_orderstatus = 'O') AS O, count(*) FILTER (o_orderstatus = 'P') AS P FROM orders GROUP BY 1""")
def status_by_year(spark, d):
    counts = t(spark, d, "orders").groupBy(F.year("o_orderdate").cast("long").alias("year")).pivot("o_orderstatus", ["F", "O", "P"]).agg(F.count("o_orderkey"))
    return counts.fillna(0)


@query("SELECT l_returnflag, l_linestatus, sum(l_quantity) AS quantity, count(*) AS n FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
def quantity_totals(spark, d):
    return t(spark, d, "lineitem").rollup("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").alias("quantity"), F.count("*").alias("n"))


@query("""SELECT o_orderkey, round(greatest(0.07 * o_totalprice, 5220), 6) AS floor_tax, round(0.15 * least(o_totalprice, 120000) + 0.35 * greatest(o_totalprice - 120000, 0), 6) AS bracket_tax,
round(0.039 * o_totalprice + 0.4, 6) AS card_fee, round(least(0.007 * o_totalprice, 40), 6) AS capped_fee, round(greatest(0.0025 * o_totalprice, 25) + 10, 6) AS wire_fee,
round(CASE WHEN o_totalprice < 100000 THEN 15 ELSE 29 END + 0.02 * o_totalprice, 6) AS step_fee FROM orders""")
def fee_schedule(spark, d):
    x, r = F.col("o_totalprice"), lambda c: F.round(c, 6)
    return t(spark, d, "orders").select("o_orderkey", r(m.tax_with_floor(x, 0.07, 5220.0)).alias("floor_tax"), r(m.two_brackets(x, 120000.0, 0.15, 0.35)).alias("bracket_tax"), r(m.fee_percent_fixed(x, 0.039, 0.4)).alias("card_fee"), r(m.fee_at_most(x, 0.007, 40.0)).alias("capped_fee"), r(m.fee_at_least(x, 0.0025, 25.0, 10.0)).alias("wire_fee"), r(m.fee_step(x, 100000.0, 15.0, 29.0, 0.02)).alias("step_fee"))


@query("""SELECT lang, sum(len(regexp_extract_all(coalesce(text, ''), '(license|public|version)')))::BIGINT AS hits, count(*) AS n FROM documents GROUP BY lang""")
def keyword_counts(spark, d):
    hits = F.regexp_count(F.coalesce("text", F.lit("")), F.lit("(license|public|version)"))
    return t(spark, d, "documents").groupBy("lang").agg(F.sum(hits).cast("long").alias("hits"), F.count("*").alias("n"))


@query("""SELECT kind, count(*) AS n, round(sum(balance), 2) AS balance FROM (
  SELECT 'customer' AS kind, c_acctbal AS balance, c_nationkey AS nation FROM customer UNION ALL SELECT 'supplier', s_acctbal, s_nationkey FROM supplier) GROUP BY kind""")
def union_streams(spark, d):
    c = t(spark, d, "customer").select(F.lit("customer").alias("kind"), F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment"))
    s = t(spark, d, "supplier").select(F.lit("supplier").alias("kind"), F.col("s_acctbal").alias("balance"))
    return c.unionByName(s, allowMissingColumns=True).groupBy("kind").agg(F.count("*").alias("n"), F.round(F.sum("balance"), 2).alias("balance"))


@query("SELECT c_nationkey AS nation FROM customer EXCEPT ALL SELECT s_nationkey FROM supplier")
def nations_left_over(spark, d):
    return t(spark, d, "customer").select(F.col("c_nationkey").alias("nation")).exceptAll(t(spark, d, "supplier").select("s_nationkey"))


@query("""SELECT c_mktsegment, c_custkey, c_acctbal, place FROM (SELECT *, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal DESC, c_custkey) AS place FROM customer) WHERE place <= 5""")
def top5_per_segment(spark, d):
    best = portfolio.top_per_group(t(spark, d, "customer"), "c_mktsegment", 5, "c_acctbal", "c_custkey")
    return best.select("c_mktsegment", "c_custkey", "c_acctbal", F.col("place").cast("long").alias("place"))


@query("SELECT c_mktsegment, round(sum(c_acctbal) / sum(sum(c_acctbal)) OVER (), 6) AS share FROM customer GROUP BY c_mktsegment")
def share_of_total(spark, d):
    total = F.sum(F.sum("c_acctbal")).over(Window.partitionBy())
    return t(spark, d, "customer").groupBy("c_mktsegment").agg(F.sum("c_acctbal").alias("s"), (F.sum("c_acctbal") / total).alias("share")).select("c_mktsegment", F.round("share", 6).alias("share"))


@query("""SELECT year, round(total / lag(total) OVER (ORDER BY year) - 1, 6) AS growth FROM (SELECT year(o_orderdate) AS year, sum(o_totalprice) AS total FROM orders GROUP BY 1)""")
def yearly_growth(spark, d):
    years = t(spark, d, "orders").groupBy(F.year("o_orderdate").cast("long").alias("year")).agg(F.sum("o_totalprice").alias("total"))
    return years.select("year", F.round(F.col("total") / F.lag("total").over(Window.orderBy("year")) - 1, 6).alias("growth"))


@query("""WITH f AS (SELECT c_custkey, min(o_orderdate)::DATE AS first FROM customer JOIN orders ON c_custkey = o_custkey GROUP BY 1)
SELECT c_custkey, k AS day, count(o_orderkey) AS n FROM f CROSS JOIN (VALUES (14), (30), (45), (60), (90)) v(k)
LEFT JOIN orders ON o_custkey = c_custkey AND o_orderdate::DATE <= first + k::INTEGER GROUP BY 1, 2""")
def milestones(spark, d):
    o = t(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"), F.col("o_orderdate").cast("date").alias("day"))
    first = o.groupBy("c_custkey").agg(F.min("day").alias("first"))
    since = o.join(first, "c_custkey").withColumn("since", F.datediff("day", "first"))
    marks = [14, 30, 45, 60, 90]
    counts = since.groupBy("c_custkey").agg(*[F.count_if(F.col("since") <= k).alias(str(k)) for k in marks])
    return counts.unpivot(["c_custkey"], [str(k) for k in marks], "day", "n").withColumn("day", F.col("day").cast("int"))


@query("""WITH dd AS (SELECT ts::DATE AS day, sum(value) AS v FROM events GROUP BY 1)
SELECT day::VARCHAR AS day, round(avg(v) OVER (ORDER BY day RANGE BETWEEN INTERVAL 27 DAYS PRECEDING AND CURRENT ROW), 6) AS average FROM dd""")
def moving_average_28d(spark, d):
    days = t(spark, d, "events").groupBy(F.col("ts").cast("date").alias("day")).agg(F.sum("value").alias("v"))
    w = Window.orderBy(F.datediff("day", F.lit("1970-01-01").cast("date"))).rangeBetween(-27, 0)
    return days.select(F.col("day").cast("string").alias("day"), F.round(F.avg("v").over(w), 6).alias("average"))


@query("""SELECT n_regionkey, arg_min(n_nationkey, bal) AS weakest FROM (SELECT n_regionkey, n_nationkey, sum(c_acctbal) AS bal FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL) GROUP BY n_regionkey""")
def weakest_nation(spark, d):
    sums = t(spark, d, "customer").join(t(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).groupBy("n_regionkey", "n_nationkey").agg(F.sum("c_acctbal").alias("bal"))
    return sums.groupBy("n_regionkey").agg(F.min_by("n_nationkey", "bal").alias("weakest"))


@query("""SELECT p_size, round(sum(p_retailprice * CASE WHEN p_size <= 90 THEN pow(90 - p_size, 2) / (60.0 * (180 - p_size)) ELSE 0 END), 4) AS usd FROM part GROUP BY p_size""")
def day_90_by_start(spark, d):
    rows = t(spark, d, "part").select("p_size", F.lit(1.0).alias("p"), F.col("p_retailprice").alias("ceiling"), F.col("p_size").alias("first_day"))
    return portfolio.day_90_cash(rows, "p_size").withColumn("usd", F.round("usd", 4))


@query("""SELECT o_orderkey, CASE WHEN day(h) <= 1 THEN date_trunc('month', h) WHEN day(h) <= 15 THEN date_trunc('month', h) + INTERVAL 14 DAYS ELSE date_trunc('month', h) + INTERVAL 1 MONTH END::DATE::VARCHAR AS payout
FROM (SELECT o_orderkey, o_totalprice, (o_orderdate::DATE + 21) AS h FROM orders) WHERE o_totalprice >= 50""")
def payout_dates(spark, d):
    held = F.date_add(F.col("o_orderdate").cast("date"), 21)
    month = F.trunc(held, "month")
    payout = F.when(F.dayofmonth(held) <= 1, month).when(F.dayofmonth(held) <= 15, F.date_add(month, 14)).otherwise(F.add_months(month, 1))
    return t(spark, d, "orders").filter("o_totalprice >= 50").select("o_orderkey", payout.cast("string").alias("payout"))


@query("""SELECT user_id, date_trunc('month', ts)::DATE::VARCHAR AS month, round(least(sum(value), 3000), 4) AS counted FROM events GROUP BY 1, 2""")
def monthly_cap(spark, d):
    g = t(spark, d, "events").groupBy("user_id", F.trunc("ts", "month").alias("month")).agg(F.sum("value").alias("v"))
    return g.select("user_id", F.col("month").cast("string").alias("month"), F.round(F.least("v", F.lit(3000.0)), 4).alias("counted"))


@query("""WITH r AS (SELECT event_type, ts, count(*) OVER (PARTITION BY event_type ORDER BY ts RANGE BETWEEN INTERVAL 7 DAYS PRECEDING AND CURRENT ROW) AS n7 FROM events)
SELECT event_type, min(n7) AS least, max(n7) AS most, count(*) FILTER (n7 < 10) AS below_floor FROM r GROUP BY event_type""")
def demand_floor(spark, d):
    """Whole days are counted once; only the days at both ends of a row's seven are ordered, each by itself."""
    week = 7 * 86_400_000_000
    events = t(spark, d, "events").select("event_type", "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    day = F.floor(F.col("us") / 86_400_000_000)
    both = events.withColumn("own", F.lit(1)).unionByName(events.withColumns({"us": F.col("us") - week, "own": F.lit(0)})).withColumn("day", day)
    order = Window.partitionBy("event_type", "day").orderBy("us")
    upto, before = F.sum("own").over(order.rangeBetween(Window.unboundedPreceding, 0)), F.sum("own").over(order.rangeBetween(Window.unboundedPreceding, -1))
    ends = both.select("event_type", "event_id", "day", "own", upto.alias("upto"), F.coalesce(before, F.lit(0)).alias("before"))
    ends = ends.groupBy("event_type", "event_id").agg(F.max(F.when(F.col("own") == 1, F.col("day"))).alias("day"), F.sum(F.when(F.col("own") == 1, F.col("upto")).otherwise(-F.col("before"))).alias("edge"))
    # the whole days between, and the first day, of which ``before`` is taken off
    daily = events.groupBy("event_type", day.alias("day")).agg(F.count("*").alias("n"))
    spread = daily.select("event_type", F.explode(F.sequence(F.col("day") + 1, F.col("day") + 7)).alias("day"), "n")
    spread = spread.groupBy("event_type", "day").agg(F.sum("n").alias("whole"))
    r = ends.join(spread, ["event_type", "day"], "left").withColumn("n7", F.col("edge") + F.coalesce("whole", F.lit(0)))
    return r.groupBy("event_type").agg(F.min("n7").alias("least"), F.max("n7").alias("most"), F.count_if(F.col("n7") < 10).alias("below_floor"))


@query("""SELECT coalesce(a.k, b.k) AS k, CASE WHEN a.k IS NULL THEN 'added' WHEN b.k IS NULL THEN 'removed' ELSE 'changed' END AS change
FROM (SELECT c_custkey AS k, c_nationkey AS v FROM customer) a FULL JOIN (SELECT s_suppkey AS k, s_nationkey AS v FROM supplier) b ON a.k = b.k
WHERE a.k IS NULL OR b.k IS NULL OR a.v IS DISTINCT FROM b.v""")
def snapshot_changes(spark, d):
    old = t(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.col("c_nationkey").alias("v"))
    new = t(spark, d, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_nationkey").alias("v"))
    return portfolio.snapshot_diff(old, new, "k", "v")


@query("""SELECT c_custkey, c_acctbal, c_nationkey FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS r FROM customer) WHERE r = 1 ORDER BY c_acctbal DESC, c_custkey LIMIT 10""")
def independent_top10(spark, d):
    return portfolio.independent_top(t(spark, d, "customer"), 10, "c_acctbal", "c_nationkey", "c_custkey").select("c_custkey", "c_acctbal", "c_nationkey")


@query("""SELECT count(*) AS n, round(sum(CASE WHEN l_returnflag = 'R' THEN l_extendedprice ELSE 0 END) / sum(l_extendedprice), 6) AS share,
sum(CASE WHEN l_quantity > 45 THEN 1 ELSE 0 END)::BIGINT AS alerts FROM lineitem WHERE l_discount >= 0.05""")
def alert_rules(spark, d):
    rows = t(spark, d, "lineitem").filter("l_discount >= 0.05")
    part = F.sum(F.when(F.col("l_returnflag") == "R", F.col("l_extendedprice")).otherwise(0.0))
    return rows.agg(F.count("*").alias("n"), F.round(part / F.sum("l_extendedprice"), 6).alias("share"), F.count_if(F.col("l_quantity") > 45).alias("alerts"))


@query("""SELECT o_orderkey, round(a + dd * 0.88 * r, 6) AS company, round(b + dd * 0.96 * r, 6) AS small_company, round(greatest(0.07 * r, 5220), 6) AS park_one, round(0.07 * r + dd * 0.93 * r, 6) AS park_none
FROM (SELECT o_orderkey, o_totalprice AS r, 0.12 * o_totalprice AS a, 0.04 * o_totalprice AS b, CASE WHEN o_orderdate >= DATE '1998-03-01' THEN 0.08 WHEN o_orderdate >= DATE '1996-01-01' THEN 0.06 END AS dd FROM orders)""")
def tax_regimes(spark, d):
    """Four regimes at the rate that held on the day; before the first rate there is none."""
    dividends = spark.createDataFrame([("dividend", "1996-01-01", 0.06), ("dividend", "1998-03-01", 0.08)], "tax string, since string, dividend double")
    o = history.at_rate(t(spark, d, "orders").withColumn("tax", F.lit("dividend")), dividends, "tax", "o_orderdate", "dividend")
    x, of = F.col("o_totalprice"), lambda rate: F.round(m.after_dividends(F.col("o_totalprice"), F.lit(rate), F.col("dividend")), 6)
    return o.select("o_orderkey", of(0.12).alias("company"), of(0.04).alias("small_company"), F.round(m.tax_with_floor(x, 0.07, 5220.0), 6).alias("park_one"), of(0.07).alias("park_none"))


@query("""SELECT c_custkey, round(0.25 * ceiling, 4) AS day_60, round(0.5 * ceiling, 4) AS day_90 FROM (
  SELECT c_custkey, any_value(c_acctbal) * 1000 AS ceiling, coalesce(sum(o_totalprice), 0) AS revenue, count(*) FILTER (o_orderstatus = 'P') AS n_open FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey)
WHERE revenue < 0.1 * ceiling AND n_open = 0""")
def day_60_closings(spark, d):
    paid = t(spark, d, "orders").groupBy("o_custkey").agg(F.sum("o_totalprice").alias("revenue"), F.count_if(F.col("o_orderstatus") == "P").alias("n_open"))
    c = t(spark, d, "customer").join(paid, F.col("c_custkey") == F.col("o_custkey"), "left").fillna(0, ["revenue", "n_open"]).withColumn("ceiling", F.col("c_acctbal") * 1000)
    g = m.gates(F.col("ceiling"))
    return portfolio.to_close(c, "revenue", "ceiling", "n_open").select("c_custkey", F.round(g["day_60"], 4).alias("day_60"), F.round(g["day_90"], 4).alias("day_90"))


@query("""WITH k AS (SELECT user_id, ts::DATE AS day, count(*) AS k FROM events GROUP BY 1, 2)
SELECT user_id, day::VARCHAR AS day, n FROM (SELECT user_id, day, sum(k) OVER (PARTITION BY user_id ORDER BY day RANGE BETWEEN INTERVAL 13 DAYS PRECEDING AND CURRENT ROW)::BIGINT AS n FROM k) WHERE n >= 3""")
def busy_places(spark, d):
    return portfolio.busy(t(spark, d, "events"), "user_id", "ts").withColumn("day", F.col("day").cast("string"))


_WEEKS = """w AS (SELECT event_type, date_trunc('week', ts)::DATE AS week, sum(value) AS usd, count(*) AS hours FROM events GROUP BY ALL),
dense AS (SELECT event_type, unnest(generate_series(min(week), max(week), INTERVAL 7 DAYS))::DATE AS week FROM w GROUP BY 1),
r AS (SELECT event_type, week, sum(usd) OVER o / sum(hours) OVER o AS per_hour FROM dense LEFT JOIN w USING (event_type, week) WINDOW o AS (PARTITION BY event_type ORDER BY week ROWS 3 PRECEDING))"""


def _rates(spark, d):
    weeks = t(spark, d, "events").groupBy("event_type", F.date_trunc("week", "ts").cast("date").alias("week")).agg(F.sum("value").alias("usd"), F.count("*").alias("hours"))
    return portfolio.hourly_rate(weeks, "event_type")


@query(f"WITH {_WEEKS} SELECT event_type, week::VARCHAR AS week, round(per_hour, 6) AS per_hour FROM r")
def trailing_hourly_rate(spark, d):
    return _rates(spark, d).select("event_type", F.col("week").cast("string").alias("week"), F.round("per_hour", 6).alias("per_hour"))


CLOSING_ORDER = ("signup", "view", "click", "error", "purchase")


@query(f"WITH {_WEEKS} SELECT week::VARCHAR AS week, arg_min(event_type, (coalesce(2 * round(round(per_hour, 6) / 2), 0), list_position({list(CLOSING_ORDER)}, event_type))) AS event_type FROM r GROUP BY week")
def next_closings(spark, d):
    """Rates that are equal to two dollars are ties, which a fixed order decides."""
    rates = _rates(spark, d).withColumn("per_hour", 2 * F.round(F.round("per_hour", 6) / 2))
    order = spark.createDataFrame([(name, i) for i, name in enumerate(CLOSING_ORDER)], "event_type string, place int")
    return portfolio.next_to_close(rates, order, "event_type").withColumn("week", F.col("week").cast("string"))


@query("""SELECT c_custkey, s_suppkey AS of, CASE WHEN s_suppkey IS NULL THEN 'own' ELSE 'duplicate' END AS status FROM customer LEFT JOIN supplier ON c_custkey = s_suppkey * 3""")
def duplicate_marks(spark, d):
    marks = t(spark, d, "supplier").select((F.col("s_suppkey") * 3).alias("c_custkey"), F.col("s_suppkey").alias("of"))
    return portfolio.mark_duplicates(t(spark, d, "customer").select("c_custkey"), marks, "c_custkey")


@query("""SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN round(o_totalprice * 17.7706, 6) WHEN 'O' THEN round(o_totalprice * 20.2078, 6) END AS converted FROM orders""")
def converted_prices(spark, d):
    rates = spark.createDataFrame([("F", 17.7706), ("O", 20.2078)], "ccy string, rate double")
    rows = portfolio.in_currency(t(spark, d, "orders"), rates, "o_totalprice", "o_orderstatus")
    return rows.select("o_orderkey", F.round("converted", 6).alias("converted"))


@query("""SELECT l_returnflag, round(sum((l_quantity * 1000 * i + l_extendedprice * o) / 1e6), 4) AS usd FROM lineitem JOIN (VALUES ('A', 3.0, 15.0), ('N', 1.0, 5.0), ('R', 0.25, 1.25)) v(f, i, o) ON l_returnflag = f GROUP BY 1""")
def model_costs(spark, d):
    prices = spark.createDataFrame([("A", 3.0, 15.0), ("N", 1.0, 5.0), ("R", 0.25, 1.25)], "l_returnflag string, price_in double, price_out double")
    rows = t(spark, d, "lineitem").join(F.broadcast(prices), "l_returnflag")
    cost = m.token_cost(F.col("l_quantity") * 1000, F.col("l_extendedprice"), F.col("price_in"), F.col("price_out"))
    return rows.groupBy("l_returnflag").agg(F.round(F.sum(cost), 4).alias("usd"))


@query("""SELECT p_partkey, CASE WHEN p_size <= 20 THEN 'L2' ELSE 'L3' END AS level, p_size <= 20 AS flag FROM part WHERE NOT (p_size <= 20 AND p_retailprice < 1200)""")
def original_parts(spark, d):
    rows = t(spark, d, "part").select("p_partkey", (F.col("p_size") <= 20).alias("model"), (F.col("p_retailprice") < 1200).alias("topic"))
    return portfolio.originality(rows, "model", "topic").select("p_partkey", "level", "flag")


@query("""SELECT o_orderkey, o_orderdate < TIMESTAMP '1998-01-01' AS old, o_totalprice FROM orders WHERE regexp_matches(lower(o_orderpriority), 'urgent|high')""")
def marked_evidence(spark, d):
    """Rows chosen by a keyword, with a mark on those from before a day."""
    o = t(spark, d, "orders").filter(F.lower("o_orderpriority").rlike("urgent|high"))
    return o.select("o_orderkey", (F.col("o_orderdate") < F.lit("1998-01-01").cast("timestamp")).alias("old"), "o_totalprice")


@query("SELECT c_custkey, c_name, c_acctbal, c_mktsegment FROM customer")
def split_tables(spark, d):
    """A wide table in three parts that share the key, joined again one to one."""
    c = t(spark, d, "customer")
    a, b, e = c.select("c_custkey", "c_name"), c.select("c_custkey", "c_acctbal"), c.select("c_custkey", "c_mktsegment")
    return a.join(b, "c_custkey").join(e, "c_custkey")


@query("""WITH o AS (SELECT o_orderkey, o_totalprice AS x, o_orderkey % 5 + 1 AS h, o_orderstatus AS s, year(o_orderdate) AS y FROM orders)
SELECT o_orderkey, round(x / (h * 4.33), 6) AS per_hour, round(x / 1.2, 6) AS without_vat, round((x * 2.0 / 1.2 - (0.04 * (x * 2.0 / 1.2) + 0.4)) * 0.99, 6) AS left_over,
round(0.8 * x - 100, 6) AS net, round(x - 1000, 6) AS margin, round((x - 1000) / x, 6) AS margin_share, round(greatest(5220 / 0.07 - x, 0), 6) AS to_floor,
round(x * (0.3 / 0.7), 6) AS headroom, round(x * (0.7 / 0.3), 6) AS needed, x / (x + 50000) >= 0.72 AS share_ok, round(x / CASE s WHEN 'F' THEN 12 WHEN 'O' THEN 3 ELSE 1 END, 6) AS monthly,
round(0.12 * greatest(x * 0.91 - 2475, 0), 6) AS pay_tax, round(x * 0.91 - 0.12 * greatest(x * 0.91 - 2475, 0), 6) AS pay_net, round(0.3::DOUBLE * 17400 * h, 6) AS head_floor,
round(x * CASE WHEN s = 'P' THEN 0.5 ELSE 1 END, 6) AS railed, round(CASE WHEN y < 1995 THEN 0 WHEN y = 1995 THEN 0.1 ELSE 0.4 END * x, 6) AS enforced FROM o""")
def order_money(spark, d):
    """Hourly rates, margins, taxes, shares and penalties of an amount."""
    o = t(spark, d, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus", (F.col("o_orderkey") % 5 + 1).alias("h"), F.year("o_orderdate").alias("year"))
    x, h, margin, pay = F.col("o_totalprice"), F.col("h"), m.margin(F.col("o_totalprice"), F.lit(1000.0)), m.after_allowances(F.col("o_totalprice"))
    period = F.when(F.col("o_orderstatus") == "F", "year").when(F.col("o_orderstatus") == "O", "quarter").otherwise("month")
    rail = F.when(F.col("o_orderstatus") == "P", "crypto").otherwise("card")
    found = {
        "per_hour": m.per_hour(x, h), "without_vat": m.without_vat(x), "left_over": m.waterfall(x, 2.0, 0.2, 0.04, 0.4, 0.01), "net": m.net_of_compute(x, F.lit(100.0)),
        "margin": margin["usd"], "margin_share": margin["share"], "to_floor": m.to_floor(x, 5220.0, 0.07), "headroom": m.headroom(x), "needed": m.needed(x), "monthly": m.monthly(x, period),
        "pay_tax": pay["tax"], "pay_net": pay["net"], "head_floor": m.floor_per_head(17400.0, h), "railed": m.penalised(x, m.rail_factor(rail)), "enforced": m.enforcement(F.col("year"), 1995) * x,
    }
    return o.select("o_orderkey", m.share_ok(x, F.lit(50000.0)).alias("share_ok"), *[F.round(c, 6).alias(n) for n, c in found.items()])


@query("""SELECT p_partkey, round(x * 0.5 * 0.64, 6) AS users, round(n * 2.4::DOUBLE, 6) AS applications, round(x * 0.013, 6) AS stars, round(x * 0.05, 6) AS cpm, round(x / n) AS multiple, round(x / 1000 * 25 * n, 6) AS mail,
round(x / 1000 * 2 * 0.4, 6) AS views, round(x / (x + 100000) * 5000, 6) AS pool, round(x * 0.1 * 0.5, 6) AS funnel, round(1 - pow(1 - 0.02, n), 6) AS any_of, round(n / 100.0 * 13 / 23, 6) AS shrunk,
round(n / 100.0 * ((x + 3 * x) / 2) / n, 6) AS first_month FROM (SELECT p_partkey, p_retailprice AS x, p_size AS n FROM part)""")
def part_ceilings(spark, d):
    """Ceilings and chances."""
    x, n, p = F.col("p_retailprice"), F.col("p_size"), F.col("p_size") / 100
    found = {
        "users": m.users_ceiling(x, 0.5), "applications": m.application_cost(n), "stars": m.stars(x), "cpm": m.cpm_share(x), "multiple": m.sale_multiple(x, n), "mail": m.mail_ceiling(x, F.lit(25.0), n),
        "views": m.views_ceiling(x, F.lit(2.0), 0.5, 0.8), "pool": m.pool_share(x, x + 100000, F.lit(5000.0)), "funnel": m.funnel(x, 0.1, 0.5), "any_of": m.any_of(F.lit(0.02), n),
        "shrunk": m.shrunk(p, 7, 20, 30), "first_month": m.first_month_score(p, x, 3 * x, n)["value"],
    }
    return t(spark, d, "part").select("p_partkey", *[F.round(c, 6).alias(k) for k, c in found.items()])


@query("""SELECT round(median(l_extendedprice), 6) AS median_before, round(median(l_extendedprice * (1 - l_discount)), 6) AS median_after,
round(median(l_extendedprice * (1 - l_discount)) / median(l_extendedprice), 6) AS ratio, count(*) AS n FROM lineitem""")
def price_calibration(spark, d):
    rows = t(spark, d, "lineitem").select(F.col("l_extendedprice").alias("before"), (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("after"))
    ratio = portfolio.calibration(rows).select(*[F.round(c, 6).alias(c) for c in ("median_before", "median_after", "ratio")])
    return ratio.crossJoin(F.broadcast(rows.agg(F.count("*").alias("n"))))


@query("""SELECT p_partkey, round(coalesce(CASE WHEN p_size > 25 THEN p_size * 10.0 END, p_retailprice * coalesce(f, 0.4)), 6) AS comparable
FROM part LEFT JOIN (VALUES (1, 0.5), (2, 0.25)) v(size, f) ON p_size = size""")
def comparable_scores(spark, d):
    """The verified score, else the raw one at the ratio, or at that of a verified analogue."""
    analogues = spark.createDataFrame([(1, 0.5), (2, 0.25)], "p_size int, factor double")
    rows = t(spark, d, "part").join(F.broadcast(analogues), "p_size", "left")
    verified = F.when(F.col("p_size") > 25, F.col("p_size") * 10.0)
    return rows.select("p_partkey", F.round(m.comparable(verified, F.col("p_retailprice"), 0.4, F.col("factor")), 6).alias("comparable"))


@query("""SELECT scenario, round(sum(w * c_acctbal), 4) AS usd_month FROM customer JOIN (VALUES ('low', 'BUILDING', 0.25), ('low', 'MACHINERY', 0.5), ('high', 'BUILDING', 0.5), ('high', 'MACHINERY', 1.0)) v(scenario, id, w) ON c_mktsegment = id GROUP BY scenario""")
def scenario_totals(spark, d):
    weights = spark.createDataFrame([("low", "BUILDING", 0.25), ("low", "MACHINERY", 0.5), ("high", "BUILDING", 0.5), ("high", "MACHINERY", 1.0)], "scenario string, id string, weight double")
    rows = t(spark, d, "customer").groupBy(F.col("c_mktsegment").alias("id")).agg(F.sum("c_acctbal").alias("ceiling"))
    return portfolio.scenario_money(rows, weights).withColumn("usd_month", F.round("usd_month", 4))


@query("""SELECT o_orderkey, round(CASE WHEN o_orderstatus = 'P' THEN 0.05 ELSE p END, 6) AS p_any
FROM orders JOIN (SELECT l_orderkey, 1 - product(1 - l_discount) AS p FROM lineitem GROUP BY 1) ON o_orderkey = l_orderkey""")
def judged_any_discount(spark, d):
    """P of at least one, but a judged value where there is one."""
    p = portfolio.at_least_one(t(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_discount").alias("p")), "o_orderkey")
    judged = t(spark, d, "orders").filter("o_orderstatus = 'P'").select("o_orderkey", F.lit(0.05).alias("judged"))
    return portfolio.overridden(p, judged, "o_orderkey", "p_any", "judged").withColumn("p_any", F.round("p_any", 6))


@query("""WITH g AS (SELECT n_regionkey, CASE WHEN n_regionkey % 2 = 0 THEN 0.6 * (1 - product(1 - n_nationkey / 100.0)) + 0.4 * (1 - product(1 - n_nationkey / 200.0)) ELSE 1 - product(1 - n_nationkey / 100.0) END AS p FROM nation GROUP BY n_regionkey)
SELECT round(0.9 * (1 - product(1 - p)), 6) AS p_any FROM g""")
def correlated_any(spark, d):
    n = t(spark, d, "nation").select(F.col("n_regionkey").alias("correlation_group"), (F.col("n_nationkey") / 100).alias("p"), (F.col("n_nationkey") / 200).alias("p_otherwise"), F.when(F.col("n_regionkey") % 2 == 0, 0.6).alias("chance"))
    return portfolio.with_common_factor(n, 0.9).select(F.round("p_any", 6).alias("p_any"))


@query("""SELECT l_orderkey, round(sum(l_quantity * l_extendedprice * (1 - l_discount) - CASE WHEN l_linenumber = 1 THEN 100 ELSE 0 END), 4) AS ceiling, round(sum(l_tax * l_discount), 6) AS p FROM lineitem GROUP BY l_orderkey""")
def order_ceilings(spark, d):
    rows = t(spark, d, "lineitem")
    items = rows.select("l_orderkey", F.col("l_quantity").alias("qty"), F.col("l_extendedprice").alias("price"), F.col("l_discount").alias("fee"), F.when(F.col("l_linenumber") == 1, 100.0).alias("cost"))
    p = portfolio.total_probability(rows, "l_orderkey", "l_tax", "l_discount")
    return portfolio.unit_ceiling(items, "l_orderkey").join(p, "l_orderkey").select("l_orderkey", F.round("ceiling", 4).alias("ceiling"), F.round("p", 6).alias("p"))


@query("""SELECT event_type, round(sum(n) * 0.8::DOUBLE, 6) AS customers FROM (SELECT event_type, date_trunc('month', ts) AS month, count(DISTINCT user_id) AS n FROM events GROUP BY ALL) GROUP BY event_type""")
def retained_users(spark, d):
    setups = t(spark, d, "events").groupBy("event_type", F.trunc("ts", "month").alias("month")).agg(F.countDistinct("user_id").alias("n"))
    return portfolio.retained(setups, "event_type").withColumn("customers", F.round("customers", 6))


@query("""SELECT CASE WHEN s_suppkey IS NULL THEN c_custkey ELSE s_suppkey + 1000000 END AS id, c_name FROM customer LEFT JOIN supplier ON c_custkey = s_suppkey""")
def crosswalk(spark, d):
    ids = t(spark, d, "supplier").select(F.col("s_suppkey").alias("old"), (F.col("s_suppkey") + 1000000).alias("new"))
    return portfolio.renamed_ids(t(spark, d, "customer").select(F.col("c_custkey").alias("id"), "c_name"), ids)


@query("""SELECT stem, n_name, count(*) AS n FROM (SELECT CASE WHEN p_size % 2 = 0 THEN 'N' ELSE 'AB' END AS stem, unnest(range(p_size + 70, p_size + 73)) AS k FROM part) JOIN nation ON n_nationkey + 90 = k GROUP BY ALL""")
def listed_rails(spark, d):
    """Id lists in cells, with and without a dash and over 99, spelled out and joined."""
    text = lambda c: c.cast("string")
    stem = F.when(F.col("p_size") % 2 == 0, "N").otherwise("AB-")
    listed = t(spark, d, "part").select(F.concat(stem, text(F.col("p_size") + 70), F.lit("…"), text(F.col("p_size") + 72)).alias("cell"))
    ids = listed.groupBy("cell").agg(F.count("*").alias("n")).select("n", F.explode(cells.id_list(F.col("cell"))).alias("id"))
    rails = t(spark, d, "nation").select(F.explode(F.array(F.lit("AB-"), F.lit("N"))).alias("stem"), "n_nationkey", "n_name")
    rails = rails.select(F.concat("stem", text(F.col("n_nationkey") + 90)).alias("id"), "n_name")
    return ids.join(rails, "id").groupBy(cells.prefix(F.col("id")).alias("stem"), "n_name").agg(F.sum("n").alias("n"))


@query("""SELECT kind, count(*) AS n FROM (SELECT unnest([o_orderpriority, o_orderstatus]) AS label FROM orders) JOIN (VALUES ('F', 'done'), ('O', 'open'), ('P', 'open'), ('1-URGENT', 'soon'), ('2-HIGH', 'soon')) v(l, kind) ON l = label GROUP BY kind""")
def label_kinds(spark, d):
    """Bracketed labels of a cell, by the kind that each stands for."""
    kinds = spark.createDataFrame([("f", "done"), ("o", "open"), ("p", "open"), ("1-urgent", "soon"), ("2-high", "soon")], "label string, kind string")
    cell = F.concat(F.lit("seen ["), F.col("o_orderpriority"), F.lit("], then ["), F.col("o_orderstatus"), F.lit("]"))
    return t(spark, d, "orders").select(F.explode(cells.labels(cell)).alias("label")).join(F.broadcast(kinds), "label").groupBy("kind").agg(F.count("*").alias("n"))


@query("""WITH dd AS (SELECT event_type, ts::DATE AS day, sum(value) AS v FROM events GROUP BY ALL)
SELECT event_type, day::VARCHAR AS day, round(avg(v) OVER (PARTITION BY event_type ORDER BY day RANGE BETWEEN INTERVAL 27 DAYS PRECEDING AND CURRENT ROW), 6) AS average FROM dd""")
def moving_average_by_origin(spark, d):
    averages = portfolio.moving_average(t(spark, d, "events"), "event_type", "ts", "value")
    return averages.select("event_type", F.col("day").cast("string").alias("day"), F.round("average", 6).alias("average"))


@query("""WITH RECURSIVE o AS (SELECT *, row_number() OVER (PARTITION BY o_custkey, y ORDER BY o_orderdate, o_orderkey) AS k
  FROM (SELECT o_custkey, year(o_orderdate) AS y, o_orderdate, o_orderkey, o_totalprice AS x, o_orderpriority < '4' AS part FROM orders)),
g AS (SELECT DISTINCT o_custkey, y, 0::BIGINT AS k, NULL::BIGINT AS o_orderkey, false AS admitted, 0::DOUBLE AS part_sum, 0::DOUBLE AS other_sum FROM o
  UNION ALL SELECT o_custkey, y, k, o_orderkey, enters, part_sum + CASE WHEN part THEN x ELSE 0 END, other_sum + CASE WHEN enters AND NOT part THEN x ELSE 0 END
  FROM (SELECT o.*, part_sum, other_sum, part OR part_sum / (part_sum + other_sum + x) >= 0.72 AS enters FROM g JOIN o ON o.o_custkey = g.o_custkey AND o.y = g.y AND o.k = g.k + 1))
SELECT o_orderkey, admitted, round(part_sum, 2) AS part_sum, round(other_sum, 2) AS other_sum FROM g WHERE k > 0""")
def invoice_gate(spark, d):
    """Orders of a customer and year in order: those that would press the part's share under the limit are refused, and don't count later."""
    journal = t(spark, d, "orders").select("o_custkey", F.year("o_orderdate").alias("y"), "o_orderdate", "o_orderkey", (F.col("o_orderpriority") < "4").alias("part"), F.col("o_totalprice").alias("amount"))
    gated = admission.admit(journal, ["o_custkey", "y"], ["o_orderdate", "o_orderkey"])
    return gated.select("o_orderkey", "admitted", F.round("part_sum", 2).alias("part_sum"), F.round("other_sum", 2).alias("other_sum"))


@query("""WITH RECURSIVE e AS (SELECT a.l_suppkey AS a, b.l_suppkey AS b FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1 WHERE a.l_discount >= 0.09 AND b.l_discount >= 0.09),
n AS (SELECT s_suppkey, row_number() OVER (ORDER BY s_acctbal DESC, s_suppkey) AS k, coalesce(list(o) FILTER (o IS NOT NULL), []) AS near
  FROM supplier LEFT JOIN (SELECT a AS x, b AS o FROM e WHERE a <> b UNION SELECT b, a FROM e WHERE a <> b) ON x = s_suppkey GROUP BY s_suppkey, s_acctbal),
g AS (SELECT 0::BIGINT AS k, []::BIGINT[] AS taken UNION ALL SELECT n.k, CASE WHEN list_has_any(taken, near) THEN taken ELSE list_append(taken, s_suppkey) END FROM g JOIN n ON n.k = g.k + 1)
SELECT s_suppkey, s_acctbal FROM supplier WHERE list_contains((SELECT arg_max(taken, k) FROM g), s_suppkey)""")
def independent_suppliers(spark, d):
    """The richest suppliers of which no two stand next to each other in an order, both at a high discount."""
    lines = t(spark, d, "lineitem").filter("l_discount >= 0.09").select("l_orderkey", "l_linenumber", "l_suppkey")
    after = lines.select("l_orderkey", (F.col("l_linenumber") - 1).alias("l_linenumber"), F.col("l_suppkey").alias("b"))
    edges = lines.join(after, ["l_orderkey", "l_linenumber"]).select(F.col("l_suppkey").alias("a"), "b")
    return graphs.independent_set(t(spark, d, "supplier").select("s_suppkey", "s_acctbal"), edges, "s_suppkey", "s_acctbal")


@query("""WITH RECURSIVE m AS (SELECT c_custkey AS id, (c_custkey * 31 + c_nationkey * 17) % (SELECT max(c_custkey) FROM customer) + 1 AS of FROM customer WHERE c_nationkey < 22),
w AS (SELECT id, of AS cur, [id] AS seen FROM m UNION ALL SELECT w.id, m.of, list_append(seen, cur) FROM w JOIN m ON m.id = cur WHERE NOT list_contains(seen, cur))
SELECT w.id, CASE WHEN m.id IS NULL THEN cur END AS last, CASE WHEN m.id IS NULL THEN len(seen) END AS hops,
  CASE WHEN m.id IS NOT NULL THEN list_min(seen[list_position(seen, cur):]) END AS cycle, m.id IS NOT NULL AND cur = w.id AS in_cycle
FROM w LEFT JOIN m ON m.id = cur WHERE m.id IS NULL OR list_contains(seen, cur)""")
def merged_ids(spark, d):
    """Merges of merges followed to their end; those that run in circles are told."""
    c = t(spark, d, "customer")
    most = c.agg(F.max("c_custkey")).first()[0] or 1
    marks = c.filter("c_nationkey < 22").select(F.col("c_custkey").alias("id"), ((F.col("c_custkey") * 31 + F.col("c_nationkey") * 17) % most + 1).alias("of"))
    return graphs.last_successors(marks)


_VERSIONS = """s AS (SELECT regexp_extract(url, '://([^/?#]*)', 1) AS host, DATE '2026-01-01' + (page_id % 12)::INT AS day, min(sha256(regexp_extract(url, '://[^/?#]*/([^/?#]*)', 1))) AS digest FROM pages GROUP BY 1, 2),
n AS (SELECT day, row_number() OVER (ORDER BY day) AS number, lead(day) OVER (ORDER BY day) AS following FROM (SELECT DISTINCT day FROM s)),
m AS (SELECT *, CASE WHEN lag(number) OVER w = number - 1 AND lag(digest) OVER w = digest THEN 0 ELSE 1 END AS starts FROM s JOIN n USING (day) WINDOW w AS (PARTITION BY host ORDER BY number)),
r AS (SELECT *, sum(starts) OVER (PARTITION BY host ORDER BY number) AS run FROM m),
v AS (SELECT host, digest, min(day) AS valid_from, max(number) AS last_number FROM r GROUP BY host, run, digest),
versions AS (SELECT host, digest, valid_from, (SELECT following FROM n WHERE number = last_number) AS valid_to FROM v)"""


def _page_versions(spark, d):
    pages = t(spark, d, "pages").select(
        F.regexp_extract("url", "://([^/?#]*)", 1).alias("host"), F.date_add(F.lit("2026-01-01").cast("date"), (F.col("page_id") % 12).cast("int")).alias("day"), F.regexp_extract("url", "://[^/?#]*/([^/?#]*)", 1).alias("section")
    )
    return history.versions(pages, "host", "day", "section")


@query(f"WITH {_VERSIONS} SELECT host, digest, valid_from::VARCHAR AS valid_from, valid_to::VARCHAR AS valid_to FROM versions")
def page_versions(spark, d):
    """A snapshot for each day: for how long each host had its first section."""
    v = _page_versions(spark, d)
    return v.select("host", "digest", F.col("valid_from").cast("string").alias("valid_from"), F.col("valid_to").cast("string").alias("valid_to"))


@query(f"WITH {_VERSIONS} SELECT host, digest FROM versions WHERE valid_from <= DATE '2026-01-06' AND (valid_to IS NULL OR valid_to > DATE '2026-01-06')")
def pages_as_of(spark, d):
    return history.as_of(_page_versions(spark, d), "2026-01-06").select("host", "digest")


@query("""WITH r AS (SELECT l_returnflag AS ccy, min(l_shipdate)::DATE AS since, 1 + (count(*) % 97) / 100.0::DOUBLE AS rate FROM lineitem WHERE l_shipdate >= DATE '1995-06-01' GROUP BY l_returnflag, date_trunc('quarter', l_shipdate)),
o AS (SELECT o_orderkey, o_totalprice, o_orderdate::DATE AS day, CASE o_orderstatus WHEN 'F' THEN 'R' WHEN 'O' THEN 'N' ELSE 'A' END AS ccy FROM orders)
SELECT o_orderkey, round(o_totalprice * rate, 4) AS converted FROM o ASOF LEFT JOIN r ON o.ccy = r.ccy AND o.day >= r.since""")
def dated_conversion(spark, d):
    """Amounts at the rate of their day, from a history of rates; before the first there is none."""
    lines = t(spark, d, "lineitem").filter("l_shipdate >= date'1995-06-01'")
    rates = lines.groupBy(F.col("l_returnflag").alias("ccy"), F.trunc("l_shipdate", "quarter").alias("q")).agg(F.min("l_shipdate").cast("date").alias("since"), (1 + (F.count("*") % 97) / 100).alias("rate"))
    ccy = F.when(F.col("o_orderstatus") == "F", "R").when(F.col("o_orderstatus") == "O", "N").otherwise("A")
    found = history.at_rate(t(spark, d, "orders").withColumn("ccy", ccy), rates.drop("q"), "ccy", "o_orderdate", "rate")
    return found.select("o_orderkey", F.round(F.col("o_totalprice") * F.col("rate"), 4).alias("converted"))


@query("""WITH s AS (SELECT o_custkey AS c, l_orderkey, min(l_shipdate)::DATE AS lo, max(l_shipdate)::DATE AS hi FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY ALL)
SELECT o_orderkey, count(*) AS n, max(l_orderkey) AS latest FROM orders JOIN s ON c = o_custkey AND lo <= o_orderdate::DATE + 14 AND hi >= o_orderdate::DATE GROUP BY o_orderkey""")
def shipping_windows(spark, d):
    """Spans of shipping that overlap a customer's order windows, which come as text cells."""
    o, dotted = t(spark, d, "orders"), lambda c: F.date_format(c, "dd.MM.yyyy")
    cell = F.concat(dotted(F.col("o_orderdate")), F.lit("–"), dotted(F.date_add(F.col("o_orderdate").cast("date"), 14)))
    windows = o.select(F.col("o_custkey").alias("c"), "o_orderkey", F.explode(cells.date_ranges(cell)).alias("w")).select("c", "o_orderkey", "w.lo", "w.hi")
    shipped = t(spark, d, "lineitem").groupBy("l_orderkey").agg(F.min("l_shipdate").cast("date").alias("lo"), F.max("l_shipdate").cast("date").alias("hi"))
    spans_of = shipped.join(o.select(F.col("o_custkey").alias("c"), F.col("o_orderkey").alias("l_orderkey")), "l_orderkey").groupBy("c", "l_orderkey").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    met = spans.overlapping(windows, spans_of, ["c"], days=60)
    return met.groupBy("o_orderkey").agg(F.count("*").alias("n"), F.max("b_l_orderkey").alias("latest"))


@query("""WITH e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings)
SELECT a.vec_id AS query, arg_min(b.vec_id, (list_sum(list_transform(range(1, len(a.v) + 1), lambda i: (a.v[i] - b.v[i]) ** 2)), b.vec_id)) AS id,
round(sqrt(min(list_sum(list_transform(range(1, len(a.v) + 1), lambda i: (a.v[i] - b.v[i]) ** 2)))), 6) AS distance FROM e a JOIN e b ON a.label % 2 = 0 AND b.label % 2 = 1 GROUP BY a.vec_id""")
def nearest_analogues(spark, d):
    """For each vector of an even label the nearest of the odd ones."""
    e = t(spark, d, "embeddings")
    found = nearest.nearest(e.filter("label % 2 = 0"), e.filter("label % 2 = 1"), "vec_id", "embedding")
    return found.withColumn("distance", F.round("distance", 6))


_TERMS = ("the", "track", "page", "href", "cookie")


@query(" UNION ALL ".join(f"SELECT '{x}' AS term, count(*) FILTER (k > 0) AS n_pages, sum(k)::BIGINT AS n_hits FROM (SELECT len(regexp_extract_all(html, '(?i)\\b{x}\\b')) AS k FROM pages) HAVING sum(k) > 0" for x in _TERMS))
def indexed_keywords(spark, d):
    """Keyword counts from an index that is written once and read by term."""
    path = scratch(spark, "index")
    terms.write_index(t(spark, d, "pages"), "page_id", "html", path)
    return terms.look_up(spark, path, list(_TERMS)).groupBy("term").agg(F.count("*").alias("n_pages"), F.sum("n").alias("n_hits"))


@query("""SELECT o_orderkey, round(o_totalprice)::DOUBLE AS amount, CASE o_orderstatus WHEN 'F' THEN 'USD' WHEN 'O' THEN 'EUR' ELSE 'MDL' END AS ccy, round(o_totalprice)::DOUBLE AS before,
CASE WHEN o_orderstatus <> 'F' THEN (o_custkey % 90)::DOUBLE END AS after, (o_custkey % 50)::DOUBLE AS lo, CASE WHEN o_orderkey % 2 = 0 THEN (o_custkey % 50 + 9)::DOUBLE ELSE (o_custkey % 50)::DOUBLE END AS hi,
o_orderstatus = 'P' AS approx, round(o_custkey % 20 + (o_orderkey % 24) / 24.0, 6) AS days, (o_orderkey % 101)::DOUBLE AS share FROM orders""")
def parsed_cells(spark, d):
    """Money, pairs, ranges, durations and numbers, written as the cells of free text and read from them."""
    text, o = lambda c: c.cast("string"), t(spark, d, "orders")
    status, spaced = F.col("o_orderstatus"), F.regexp_replace(F.format_number(F.round("o_totalprice"), 0), ",", " ")
    cell = o.select(
        "o_orderkey",
        F.when(status == "F", F.concat(F.lit("≈$"), spaced)).when(status == "O", F.concat(spaced, F.lit(" € a year"))).otherwise(F.concat(spaced, F.lit(" MDL"))).alias("money"),
        F.concat(spaced, F.lit(" → "), F.when(status == "F", "—").otherwise(text(F.col("o_custkey") % 90))).alias("pair"),
        F.concat(F.when(status == "P", "~").otherwise(""), text(F.col("o_custkey") % 50), F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("–"), text(F.col("o_custkey") % 50 + 9))).otherwise("")).alias("range"),
        F.concat(text(F.col("o_custkey") % 20), F.lit(" d "), text(F.col("o_orderkey") % 24), F.lit(" h")).alias("span"),
        F.concat(F.lit("about "), text(F.col("o_orderkey") % 101), F.lit("% of all")).alias("share"),
    )
    money, pair, between = cells.money(F.col("money")), cells.before_after(F.col("pair")), cells.interval(F.col("range"))
    return cell.select(
        "o_orderkey", money["amount"].cast("double").alias("amount"), money["ccy"].alias("ccy"), pair["before"].alias("before"), pair["after"].alias("after"),
        between["lo"].alias("lo"), between["hi"].alias("hi"), between["approx"].alias("approx"), F.round(cells.days(F.col("span")), 6).alias("days"), cells.number(F.col("share")).alias("share"),
    )


@query("""SELECT 'AB-' || c_custkey AS id, c_nationkey / 100.0 AS p, round(c_acctbal) AS ceiling, (c_custkey % 5)::DOUBLE AS hours,
CASE WHEN c_custkey % 5 > 0 THEN round(c_nationkey / 100.0 * round(c_acctbal) / (c_custkey % 5), 6) END AS score, c_name || ', "' || c_mktsegment || '"' AS payout FROM customer""")
def candidate_files(spark, d):
    """Candidates written as CSV files under other names, read under the unified ones, and scored."""
    path = scratch(spark, "candidates")
    rows = t(spark, d, "customer").select(
        F.concat(F.lit("AB-"), F.col("c_custkey").cast("string")).alias("id"), F.round("c_acctbal").alias("month6_ceiling_usd"), (F.col("c_custkey") % 5).alias("owner_hours_week"),
        F.concat("c_name", F.lit(', "'), "c_mktsegment", F.lit('"')).alias("crypto_payout"), (F.col("c_nationkey") / 100).alias("p_first_usd_30d"),
    )
    candidates.write_candidates(rows, path)
    read = candidates.read_candidates(spark, path).select("id", "p", F.col("ceiling_usd").cast("double").alias("ceiling"), F.col("hours_week").alias("hours"), F.col("crypto_payout").alias("payout"))
    return read.withColumn("score", F.round(m.score(F.col("p"), F.col("ceiling"), F.col("hours")), 6))
