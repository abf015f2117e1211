"""From candidates and their reviews to a ranking and to scenario money."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarrylane.functions.measures import day_90_share


def reconcile(reviews: DataFrame) -> DataFrame:
    """The cautious view of all reviews of an id: least P and ceiling, most hours; nulls don't count."""
    return reviews.groupBy("id").agg(F.min("p").alias("p"), F.min("ceiling").alias("ceiling"), F.max("hours").alias("hours"), F.bool_or(F.col("verdict") == "refuted").alias("refuted"))


def viable(candidates: DataFrame, reviews: DataFrame, key: str = "id") -> DataFrame:
    """Candidates that no review refutes; those without reviews stay, and so does a null verdict."""
    refuted = reviews.filter("verdict = 'refuted'").select(key).distinct()
    return candidates.join(refuted, key, "left_anti")


def calibration(scores: DataFrame, before: str = "before", after: str = "after", width: float | None = None) -> DataFrame:
    """Both medians and their ratio; ``width`` is that of the bins in which ranks are found."""
    sides = F.array(*[F.struct(F.lit(name).alias("side"), F.col(c).cast("double").alias("score")) for name, c in (("before", before), ("after", after))])
    medians = quantiles(scores.select(F.explode(sides).alias("s")).select("s.*"), "side", "score", {"median": 0.5}, width)
    of = lambda name: F.max(F.when(F.col("side") == name, F.col("median")))
    return medians.agg(of("before").alias("median_before"), of("after").alias("median_after"), F.try_divide(of("after"), of("before")).alias("ratio"))


def at_least_one(rows: DataFrame, *by: str, p: str = "p") -> DataFrame:
    return rows.groupBy(*by).agg((1 - F.product(1 - F.col(p))).alias("p_any"))


def overridden(rows: DataFrame, judged: DataFrame, key: str, value: str, by: str) -> DataFrame:
    """A computed value, but the judged one (column ``by`` of another table) where there is one."""
    return rows.join(judged.select(key, by), key, "left").withColumn(value, F.coalesce(by, value)).drop(by)


def with_common_factor(rows: DataFrame, factor: float, group: str = "correlation_group", p: str = "p", otherwise: str = "p_otherwise", chance: str = "chance") -> DataFrame:
    """P of at least one under a factor common to all groups.

    A group's members depend on one condition: with ``chance`` it holds and they have ``p``, else
    ``p_otherwise`` (null: 0). A group without a chance (null) has ``p`` for sure.
    """
    w, other = F.coalesce(F.first(chance, ignorenulls=True), F.lit(1.0)), F.coalesce(F.col(otherwise), F.lit(0.0))
    mixed = w * (1 - F.product(1 - F.col(p))) + (1 - w) * (1 - F.product(1 - other))
    return rows.groupBy(group).agg(mixed.alias("p")).agg((factor * (1 - F.product(1 - F.col("p")))).alias("p_any"))


#: Bins over the range of values where no width is given.
BINS = 1000


def quantiles(rows: DataFrame, by: str, value: str, points: dict[str, float], width: float | None = None) -> DataFrame:
    """Interpolated quantiles by name for each group, without holding a group's values in one place.

    Equal values are counted first; ranks are found in bins of ``width`` (none: a thousandth of the
    values' range), and only the bins that hold a wanted rank are ordered. Nulls don't count.
    """
    if width is None:
        low, high = rows.agg(F.min(value), F.max(value)).first()
        width = float(high - low) / BINS if low is not None and high > low else 1.0
    counts = rows.filter(F.col(value).isNotNull()).groupBy(by, F.col(value).alias("v")).agg(F.count("*").alias("n")).withColumn("bin", F.floor(F.col("v") / width))
    bins = counts.groupBy(by, "bin").agg(F.sum("n").alias("n"))
    upto = F.sum("n").over(Window.partitionBy(by).orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    bins = bins.withColumn("total", F.sum("n").over(Window.partitionBy(by))).withColumn("before", upto - F.col("n"))
    place = {name: q * (F.col("total") - 1) for name, q in points.items()}
    wanted = F.array(*[F.struct(F.lit(name).alias("name"), rank(x).cast("long").alias("rank"), (x - F.floor(x)).alias("rest"), F.lit(i).alias("end")) for name, x in place.items() for i, rank in enumerate((F.floor, F.ceil))])
    sought = bins.select(by, "bin", "n", "before", F.explode(wanted).alias("w")).filter("w.rank >= before and w.rank < before + n").select(by, "bin", "before", "w.*")
    inside = counts.select(F.col(by).alias("_by"), F.col("bin").alias("_bin"), "v", "n")
    met = sought.join(inside, F.col(by).eqNullSafe(F.col("_by")) & (F.col("bin") == F.col("_bin")))
    order = Window.partitionBy(by, "name", "end").orderBy("v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ends = met.withColumn("upto", F.col("before") + F.sum("n").over(order)).filter("upto > rank and upto - n <= rank")
    weighted = F.sum(F.when(F.col("end") == 0, (1 - F.col("rest")) * F.col("v")).otherwise(F.col("rest") * F.col("v")))
    return ends.groupBy(by).pivot("name", list(points)).agg(weighted)


def total_probability(rows: DataFrame, by: str, weight: str = "w", p: str = "p") -> DataFrame:
    return rows.groupBy(by).agg(F.sum(F.col(weight) * F.col(p)).alias("p"))


def unit_ceiling(items: DataFrame, by: str) -> DataFrame:
    """Sum of quantity times price less a fee, less costs; null fees and costs are nothing."""
    net = F.col("qty") * F.col("price") * (1 - F.coalesce("fee", F.lit(0.0))) - F.coalesce("cost", F.lit(0.0))
    return items.groupBy(by).agg(F.sum(net).alias("ceiling"))


def retained(setups: DataFrame, by: str, n: str = "n", rate: float = 0.8) -> DataFrame:
    """Customers left of all monthly cohorts."""
    return setups.groupBy(by).agg((F.sum(n) * rate).alias("customers"))


def in_currency(rows: DataFrame, rates: DataFrame, amount: str = "amount", ccy: str = "ccy") -> DataFrame:
    """Adds ``converted``: the amount at the stated rate of its currency; without a rate: null."""
    return rows.join(rates.select(F.col("ccy").alias("_ccy"), "rate"), F.col(ccy) == F.col("_ccy"), "left").withColumn("converted", F.col(amount) * F.col("rate")).drop("_ccy", "rate")


def originality(rows: DataFrame, same_model: str, same_topic: str) -> DataFrame:
    """Level of a candidate against a list: L1 (model and topic) is dropped, L2 (model only) flagged, L3 passes."""
    level = F.when(F.col(same_model) & F.col(same_topic), "L1").when(F.col(same_model), "L2").otherwise("L3")
    return rows.withColumn("level", level).filter("level <> 'L1'").withColumn("flag", F.col("level") == "L2")


def to_close(rows: DataFrame, revenue: str, ceiling: str, open_deals: str) -> DataFrame:
    """At day 60: less than a tenth of the ceiling and no open deals."""
    return rows.filter((F.col(revenue) < 0.1 * F.col(ceiling)) & (F.col(open_deals) == 0))


def busy(requests: DataFrame, by: str, ts: str, least: int = 3, days: int = 14) -> DataFrame:
    """by, day, n: days on which a place has had ``least`` requests in the trailing days."""
    daily = requests.groupBy(by, F.to_date(ts).alias("day")).agg(F.count("*").alias("k"))
    w = Window.partitionBy(by).orderBy(F.datediff("day", F.lit("1970-01-01").cast("date"))).rangeBetween(1 - days, 0)
    return daily.select(by, "day", F.sum("k").over(w).alias("n")).filter(F.col("n") >= least)


def moving_average(rows: DataFrame, by: str, day: str, value: str, span: int = 28) -> DataFrame:
    """by, day, average: over the days with rows among the trailing ``span``, of each origin; a day's rows are summed first."""
    daily = rows.groupBy(by, F.col(day).cast("date").alias("day")).agg(F.sum(value).alias("v"))
    w = Window.partitionBy(by).orderBy(F.datediff("day", F.lit("1970-01-01").cast("date"))).rangeBetween(1 - span, 0)
    return daily.select(by, "day", F.avg("v").over(w).alias("average"))


def hourly_rate(weeks: DataFrame, by: str, week: str = "week", usd: str = "usd", hours: str = "hours", span: int = 4) -> DataFrame:
    """Dollars per hour over the trailing weeks; weeks without a row between a group's first and last count as empty."""
    ends = weeks.groupBy(by).agg(F.min(week).alias("lo"), F.max(week).alias("hi"))
    dense = ends.select(by, F.explode(F.sequence("lo", "hi", F.expr("interval 7 days"))).alias(week)).join(weeks, [by, week], "left")
    w = Window.partitionBy(by).orderBy(week).rowsBetween(1 - span, Window.currentRow)
    return dense.select(by, week, F.try_divide(F.sum(usd).over(w), F.sum(hours).over(w)).alias("per_hour"))


def next_to_close(rates: DataFrame, order: DataFrame, key: str, per_hour: str = "per_hour", by: str = "week") -> DataFrame:
    """Whom to close: the least dollars per hour; on ties, as when nobody earns, the first in a fixed order."""
    placed = rates.join(order, key)
    return placed.groupBy(by).agg(F.min_by(key, F.struct(F.coalesce(per_hour, F.lit(0.0)), "place")).alias(key))


def mark_duplicates(rows: DataFrame, marks: DataFrame, key: str = "id") -> DataFrame:
    """Adds ``status`` and ``of`` from (key, of): duplicates are marked and stay."""
    marked = rows.join(marks.select(key, F.col("of")), key, "left")
    return marked.withColumn("status", F.when(F.col("of").isNotNull(), "duplicate").otherwise("own"))


def renamed_ids(rows: DataFrame, crosswalk: DataFrame, key: str = "id") -> DataFrame:
    """Ids through a crosswalk (old, new); ids that it lacks stay."""
    return rows.join(crosswalk, F.col(key) == F.col("old"), "left").withColumn(key, F.coalesce("new", key)).drop("old", "new")


def scenario_money(rows: DataFrame, weights: DataFrame) -> DataFrame:
    """Sum of weight times ceiling for each scenario: weights has scenario, id, weight."""
    return weights.join(rows, "id").groupBy("scenario").agg(F.sum(F.col("weight") * F.col("ceiling")).alias("usd_month"))


def day_90_cash(rows: DataFrame, *by: str) -> DataFrame:
    return rows.groupBy(*by).agg(F.sum(F.col("p") * F.col("ceiling") * day_90_share(F.col("first_day"))).alias("usd"))


def top(rows: DataFrame, n: int, by: str, key: str = "id") -> DataFrame:
    return rows.orderBy(F.col(by).desc_nulls_last(), key).limit(n)


def top_per_group(rows: DataFrame, group: str, n: int, by: str, key: str = "id") -> DataFrame:
    w = Window.partitionBy(group).orderBy(F.col(by).desc_nulls_last(), F.col(key))
    return rows.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= n)


def independent_top(rows: DataFrame, n: int, by: str, group: str = "correlation_group", key: str = "id") -> DataFrame:
    """The top n when only the best of each correlated group counts."""
    return top(top_per_group(rows, group, 1, by, key).drop("place"), n, by, key)


def running_share(journal: DataFrame, by: str, day: str, part: str, whole: str) -> DataFrame:
    """Share of a part in the year so far, month by month; January starts afresh."""
    months = journal.groupBy(by, F.trunc(day, "year").alias("year"), F.trunc(day, "month").alias("month")).agg(F.sum(part).alias("part"), F.sum(whole).alias("whole"))
    w = Window.partitionBy(by, "year").orderBy("month").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return months.withColumn("share", F.try_divide(F.sum("part").over(w), F.sum("whole").over(w)))


def streaks(weeks: DataFrame, by: str, week: str, flag: str, least: int = 2) -> DataFrame:
    """Weeks in which a flag has held for ``least`` weeks on end; a missing week breaks the run."""
    w = Window.partitionBy(by).orderBy(week)
    number = F.floor(F.datediff(F.col(week), F.lit("1970-01-05").cast("date")) / 7)
    runs = weeks.filter(flag).withColumn("run", number - F.row_number().over(w))
    held = Window.partitionBy(by, "run").orderBy(week)
    return runs.withColumn("held", F.row_number().over(held)).filter(F.col("held") >= least).drop("run")


def snapshot_diff(old: DataFrame, new: DataFrame, key: str, value: str) -> DataFrame:
    """key and change (added, removed, changed) between two snapshots."""
    a, b = old.select(key, F.col(value).alias("_old"), F.lit(True).alias("_in_old")), new.select(key, F.col(value).alias("_new"), F.lit(True).alias("_in_new"))
    change = F.when(F.col("_in_old").isNull(), "added").when(F.col("_in_new").isNull(), "removed").when(~F.col("_old").eqNullSafe(F.col("_new")), "changed")
    return a.join(b, key, "full").select(key, change.alias("change")).filter("change is not null")
