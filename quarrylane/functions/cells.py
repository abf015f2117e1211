"""Parsing of free-text cells: numbers, money, before/after pairs, id lists, durations, dates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CURRENCIES = (("$", "USD"), ("€", "EUR"), ("RON", "RON"), ("MDL", "MDL"))
NOTHING = ("", "—", "-", "None", "n/a")
#: Dotted dates, what joins several of them, and what leaves the start open, in two languages: fixed values.
DATES = r"(\d{1,2})(?:\.(\d{1,2}))?(?:\.(\d{4}))?(?:\s*[–-]\s*(\d{1,2})\.(\d{1,2})(?:\.(\d{4}))?)?"
NUMBERS = ("day_1", "month_1", "year_1", "day_2", "month_2", "year_2")
JOINED = r"\s*(?:[,;]|\sи\s|\sand\s)\s*"
UNTIL = r"(?:^|\s)(?:до|until|by)\s"


def number(cell: Column) -> Column:
    """The first number of a cell, spaces as thousands marks allowed; none: null."""
    text = F.regexp_replace(cell, r"(?<=\d)[\s ](?=\d{3})", "")
    return F.regexp_extract(text, r"(-?\d+(?:\.\d+)?)", 1).try_cast("double")


def money(cell: Column) -> Column:
    ccy = F.coalesce(*[F.when(F.contains(cell, F.lit(mark)), F.lit(name)) for mark, name in CURRENCIES])
    return F.when(number(cell).isNotNull(), F.struct(number(cell).cast("decimal(18,4)").alias("amount"), ccy.alias("ccy")))


def interval(cell: Column) -> Column:
    """lo, hi and whether the cell says about; one number is both ends."""
    low, high = number(F.split(cell, "[–]")[0]), number(F.try_element_at(F.split(cell, "[–]"), F.lit(2)))
    return F.struct(low.alias("lo"), F.coalesce(high, low).alias("hi"), cell.rlike("[≈~]").alias("approx"))


def before_after(cell: Column) -> Column:
    sides = F.split(cell, "→")
    clean = lambda c: F.when(F.trim(c).isin(*NOTHING), None).otherwise(number(c))
    return F.struct(clean(sides[0]).alias("before"), clean(F.try_element_at(sides, F.lit(2))).alias("after"))


def prefix(identifier: Column) -> Column:
    return F.regexp_extract(identifier, r"^([A-Z]+)", 1)


def id_list(cell: Column) -> Column:
    """Ids of a cell like ``AB-01…03, CD-07, N3``: ranges are spelled out, with at least the first number's digits."""

    def spell(part: Column) -> Column:
        piece = lambda i: F.regexp_extract(part, r"([A-Z]+-?)(\d+)(?:\s*…\s*(?:[A-Z]+-?)?(\d+))?", i)
        stem, first, last = piece(1), piece(2), piece(3)
        numbers = F.sequence(first.try_cast("int"), F.coalesce(last.try_cast("int"), first.try_cast("int")))
        padded = lambda n: F.lpad(n.cast("string"), F.greatest(F.length(n.cast("string")), F.length(first)), F.lit("0"))
        return F.when(stem != "", F.transform(numbers, lambda n: F.concat(stem, padded(n)))).otherwise(F.array().cast("array<string>"))

    return F.flatten(F.transform(F.split(cell, r"\s*,\s*"), spell))


def labels(cell: Column) -> Column:
    """Bracketed labels, lower-cased."""
    return F.transform(F.regexp_extract_all(cell, F.lit(r"\[([^\]]+)\]"), F.lit(1)), F.lower)


def days(cell: Column) -> Column:
    """Days of a duration like ``13 d 21 h``; none: null."""
    d, h = F.regexp_extract(cell, r"(\d+)\s*d", 1).try_cast("double"), F.regexp_extract(cell, r"(\d+)\s*h", 1).try_cast("double")
    return F.when(d.isNotNull() | h.isNotNull(), F.coalesce(d, F.lit(0.0)) + F.coalesce(h, F.lit(0.0)) / 24)


def dotted_date(cell: Column) -> Column:
    """dd.mm.yyyy with a flag that says whether the cell is just that."""
    text = F.regexp_extract(cell, r"(\d{2}\.\d{2}\.\d{4})", 1)
    return F.struct(F.try_to_timestamp(text, F.lit("dd.MM.yyyy")).cast("date").alias("day"), (F.trim(cell) == text).alias("exact"))


def date_ranges(cell: Column, slack: int = 3) -> Column:
    """Intervals (lo, hi, approx) of a cell with dotted dates, in their order.

    ``21.11.2026`` is a day, ``21–25.11.2026`` and ``28.09–02.10.2026`` are ranges, ``11.2026`` is a month, and dates
    joined by a comma or "and" are one interval each. A date without a year has the cell's last
    one. "~" or "≈" widens by ``slack`` days; "until" leaves the start open (null). Other text makes none.
    """
    year = F.regexp_extract(cell, r"(\d{4})(?!.*\d{4})", 1)

    # each step keeps what the next one uses more than once: inside a lambda nothing is shared
    def numbers(part: Column) -> Column:
        return F.struct(part.alias("part"), part.rlike("[≈~]").alias("approx"), *[F.nullif(F.regexp_extract(part, DATES, i + 1), F.lit("")).alias(n) for i, n in enumerate(NUMBERS)])

    def dated(x: Column) -> Column:
        day_1, month_1, year_1, day_2, month_2, year_2 = (x[n] for n in NUMBERS)
        own_year = F.coalesce(year_2, year_1, year)
        date = lambda d, m, y: F.try_to_date(F.concat_ws("-", y, F.lpad(m, 2, "0"), F.lpad(d, 2, "0")), "yyyy-MM-dd")
        lo = date(day_1, F.coalesce(month_1, month_2), F.coalesce(year_1, own_year))
        month = F.try_to_date(F.nullif(F.regexp_extract(x["part"], r"^\D*(\d{1,2}\.\d{4})\D*$", 1), F.lit("")), "M.yyyy")
        return F.struct(x["approx"].alias("approx"), x["part"].rlike(UNTIL).alias("open"), day_2.isNotNull().alias("two"), lo.alias("lo"), F.when(day_2.isNotNull(), date(day_2, month_2, own_year)).alias("hi"), month.alias("month"))

    def interval_of(x: Column) -> Column:
        lo, hi = F.coalesce(x["month"], x["lo"]), F.coalesce(F.last_day(x["month"]), F.when(x["two"], x["hi"]).otherwise(x["lo"]))
        near = lambda d, n: F.when(x["approx"], F.date_add(d, n)).otherwise(d)
        return F.struct(F.when(x["open"], F.lit(None).cast("date")).otherwise(near(lo, -slack)).alias("lo"), near(hi, slack).alias("hi"), x["approx"].alias("approx"))

    read = F.transform(F.transform(F.split(cell, JOINED), numbers), dated)
    return F.filter(F.transform(read, interval_of), lambda x: x["hi"].isNotNull())
