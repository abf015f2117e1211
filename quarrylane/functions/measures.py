"""Scores, fees, taxes and ceilings as pure Column functions: no UDFs, ANSI-safe."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

WEEKS_PER_MONTH = 4.33


def score(p: Column, ceiling: Column, hours: Column) -> Column:
    """P times ceiling for each hour; no hours: null."""
    return F.try_divide(p * ceiling, hours)


def penalised(value: Column, *factors: Column | float) -> Column:
    return reduce(lambda a, b: a * (F.lit(b) if isinstance(b, float) else b), factors, value)


def comparable(verified: Column, raw: Column, ratio: Column | float, override: Column | None = None) -> Column:
    """The verified score, else the raw one at the calibration ratio or the row's own factor."""
    factor = F.lit(ratio) if isinstance(ratio, float) else ratio
    return F.coalesce(verified, raw * (factor if override is None else F.coalesce(override, factor)))


def day_90_share(first_day: Column) -> Column:
    """Share of a ceiling that has come in by day 90 when income starts on a day and grows evenly."""
    return F.when(first_day <= 90, F.pow(90 - first_day, F.lit(2)) / (60 * (180 - first_day))).otherwise(0.0)


def per_hour(amount: Column, hours_week: Column) -> Column:
    return F.try_divide(amount, hours_week * WEEKS_PER_MONTH)


def tax_with_floor(revenue: Column, rate: float, floor: float) -> Column:
    return F.greatest(rate * revenue, F.lit(floor))


def two_brackets(x: Column, limit: float, low: float, high: float) -> Column:
    return low * F.least(x, F.lit(limit)) + high * F.greatest(x - limit, F.lit(0.0))


def share_ok(part: Column, rest: Column, least: float = 0.72) -> Column:
    return F.coalesce(F.try_divide(part, part + rest) >= least, F.lit(False))


def headroom(part: Column, share: float = 0.7) -> Column:
    """What may be added beside a part that has to stay at a share."""
    return part * ((1 - share) / share)


def needed(rest: Column, share: float = 0.7) -> Column:
    return rest * (share / (1 - share))


def fee_percent_fixed(x: Column, pct: float, fixed: float) -> Column:
    return pct * x + fixed


def fee_at_least(x: Column, pct: float, least: float, plus: float = 0.0) -> Column:
    return F.greatest(pct * x, F.lit(least)) + plus


def fee_at_most(x: Column, pct: float, most: float) -> Column:
    return F.least(pct * x, F.lit(most))


def fee_step(x: Column, limit: float, below: float, above: float, pct: float) -> Column:
    return F.when(x < limit, below).otherwise(above) + pct * x


def waterfall(x: Column, fx: float, vat: float, pct: float, fixed: float, last: float) -> Column:
    """Converted, without VAT, less a percentage with fixed parts, less a last percentage."""
    net = x * fx / (1 + vat)
    return (net - (pct * net + fixed)) * (1 - last)


def any_of(p: Column, n: Column | int) -> Column:
    return 1 - F.pow(1 - p, F.lit(n) if isinstance(n, int) else n)


def shrunk(p: Column, start: float, end: float, planned_end: float) -> Column:
    return p * (end - start) / (planned_end - start)


def without_vat(x: Column, vat: float = 0.2) -> Column:
    return x / (1 + vat)


def funnel(first: Column, *rates: float) -> Column:
    return reduce(lambda a, r: a * r, rates, first)


def token_cost(tokens_in: Column, tokens_out: Column, price_in: Column, price_out: Column) -> Column:
    """Prices are for a million tokens."""
    return (tokens_in * price_in + tokens_out * price_out) / 1e6


def first_month_score(p: Column, low: Column, high: Column, hours: Column) -> Column:
    """The variant with the hours of the first 30 days and the middle of a range; its unit is tagged."""
    return F.struct(score(p, (low + high) / 2, hours).alias("value"), F.lit("usd_per_first_month_hour").alias("unit"))


def rail_factor(rail: Column, crypto: float = 0.5) -> Column:
    return F.when(rail == "crypto", crypto).otherwise(1.0)


def after_dividends(revenue: Column, tax: Column, dividend_tax: Column) -> Column:
    """Tax on revenue and then on what is paid out of the rest."""
    return tax * revenue + dividend_tax * (1 - tax) * revenue


def break_even(floor: float, rate: float) -> float:
    """Revenue from which on a floor no longer binds."""
    return floor / rate


def to_floor(revenue: Column, floor: float, rate: float) -> Column:
    """Revenue that is missing until the floor no longer binds."""
    return F.greatest(F.lit(break_even(floor, rate)) - revenue, F.lit(0.0))


def floor_per_head(average: Column | float, workers: Column, months: Column | int = 1, share: float = 0.3) -> Column:
    return share * (F.lit(average) if isinstance(average, float) else average) * workers * months


def after_allowances(gross: Column, health: float = 0.09, rate: float = 0.12, allowance: float = 2475.0, employer: float = 0.24) -> Column:
    """Pay after health contribution and tax above an allowance: tax, net, and load on what the employer pays."""
    tax = rate * F.greatest(gross * (1 - health) - allowance, F.lit(0.0))
    net = gross * (1 - health) - tax
    return F.struct(tax.alias("tax"), net.alias("net"), (1 - net / (gross * (1 + employer))).alias("load"))


def net_of_compute(revenue: Column, compute: Column, share: float = 0.8) -> Column:
    return share * revenue - compute


def users_ceiling(users: Column, usd_each: Column | float, share: float = 0.64) -> Column:
    return users * usd_each * share


def application_cost(n: Column, tokens: float = 16.0, price: float = 0.15) -> Column:
    return n * (tokens * price)


def margin(revenue: Column, cost: Column) -> Column:
    return F.struct((revenue - cost).alias("usd"), F.try_divide(revenue - cost, revenue).alias("share"))


def stars(n: Column, usd: float = 0.013) -> Column:
    return n * usd


def cpm_share(price: Column, sold: float = 0.1, owner: float = 0.5) -> Column:
    return price * (sold * owner)


def sale_multiple(price: Column, monthly: Column) -> Column:
    return F.round(F.try_divide(price, monthly))


def gates(ceiling: Column) -> Column:
    """What has to be reached by day 60 and day 90, and the limit below which day 60 closes."""
    return F.struct((0.25 * ceiling).alias("day_60"), (0.5 * ceiling).alias("day_90"), (0.1 * ceiling).alias("close"))


def mail_ceiling(subscribers: Column, rate: Column, issues: Column) -> Column:
    return subscribers / 1000 * rate * issues


def views_ceiling(views: Column, cpm: Column, share: float, fill: float) -> Column:
    return views / 1000 * cpm * (share * fill)


def monthly(amount: Column, period: Column) -> Column:
    return amount / F.when(period == "year", 12).when(period == "quarter", 3).otherwise(1)


def pool_share(own: Column, everyone: Column, pool: Column) -> Column:
    return F.try_divide(own, everyone) * pool


def enforcement(year: Column, first: int) -> Column:
    """Staged enforcement: 10 % in the first year, then 40 %; nothing before."""
    return F.when(year < first, 0.0).when(year == first, 0.1).otherwise(0.4)
