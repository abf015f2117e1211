"""Monitors as streams: weekly shares, runs of weeks, trailing counts, and leads that pass on when nobody answers.

The stateful ones run on event time: timers follow the watermark, so a replay gives the same. They
keep their state in RocksDB, which Spark asks for; ``keyed_state`` sets it.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from quarrylane.session import ship

WEEK_MS, DAY_MS = 7 * 86_400_000, 86_400_000
#: The first Monday of the epoch, from which weeks are numbered.
MONDAY_MS = 4 * DAY_MS


def keyed_state(df: DataFrame) -> None:
    """What keyed state with timers needs of the session: its store, and this code on the executors."""
    df.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    ship(df.sparkSession)


def weekly_share(journal: DataFrame, late: str = "2 days") -> DataFrame:
    """Share of flagged amount in each week of a stream of (ts, flagged, amount)."""
    flagged = F.sum(F.when(F.col("flagged"), F.col("amount")).otherwise(0.0))
    weeks = journal.withWatermark("ts", late).groupBy(F.window("ts", "7 days"))
    return weeks.agg(F.try_divide(flagged, F.sum("amount")).alias("share"), F.sum("amount").alias("amount"))


def trailing_counts(requests: DataFrame, by: str, ts: str, key: str, days: int, late: str = "2 days") -> DataFrame:
    """by, day, n: requests in the trailing days, for each day that has any, once no more can come for it.

    A repeated key counts once, as long as it comes within the lateness; later rows are dropped.
    """
    once = requests.withWatermark(ts, late).dropDuplicatesWithinWatermark([key])
    slid = once.groupBy(by, F.window(ts, f"{days} days", "1 day").alias("w")).agg(F.count("*").alias("n"), F.max(ts).alias("newest"))
    own = slid.filter(F.col("newest") >= F.col("w.end") - F.expr("interval 1 day"))
    return own.select(by, F.date_sub(F.col("w.end").cast("date"), 1).alias("day"), "n")


def busy_places(requests: DataFrame, by: str, ts: str, key: str, least: int = 3, days: int = 14, late: str = "2 days") -> DataFrame:
    """Days on which a place has had ``least`` requests in the trailing days."""
    return trailing_counts(requests, by, ts, key, days, late).filter(F.col("n") >= least)


def under_demand(openings: DataFrame, by: str, ts: str, key: str, floor: int = 10, days: int = 7, late: str = "2 days") -> DataFrame:
    """Days on which an offer has had fewer than ``floor`` openings in the trailing days."""
    return trailing_counts(openings, by, ts, key, days, late).filter(F.col("n") < floor)


class WeekRuns(StatefulProcessor):
    """Counts weeks on end in which a flag holds; a week counts once the watermark has passed its start."""

    def __init__(self, least: int):
        self.least = least

    def init(self, handle) -> None:
        self.handle = handle
        self.run = handle.getValueState("run", "week long, held int")
        self.pending = handle.getMapState("pending", "week long", "over boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for frame in rows:
            for at, over in zip(frame["week"], frame["over"], strict=True):
                week = (int(at.timestamp() * 1000) - MONDAY_MS) // WEEK_MS
                before = self.pending.containsKey((week,)) and self.pending.getValue((week,))[0]
                self.pending.updateValue((week,), (bool(before or (over is not None and not pd.isna(over) and over)),))
                self.handle.registerTimer(MONDAY_MS + week * WEEK_MS + 1)
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = (timerValues.getCurrentWatermarkInMs() - MONDAY_MS - 1) // WEEK_MS
        last, held = self.run.get() if self.run.exists() else (None, 0)
        out = []
        for week in sorted(w for (w,) in self.pending.keys() if w <= passed):
            over = self.pending.getValue((week,))[0]
            self.pending.removeKey((week,))
            if last is None or week > last:
                held = (held if last == week - 1 else 0) + 1 if over else 0
                last = week
                if held >= self.least:
                    out.append((key[0], pd.Timestamp(MONDAY_MS + week * WEEK_MS, unit="ms"), held))
                self.handle.registerTimer(MONDAY_MS + (week + 2) * WEEK_MS + 1)
        if last is not None and last + 1 < passed:
            self.run.clear()  # a week has passed without a row, so the run is over
        elif last is not None:
            self.run.update((last, held))
        if out:
            yield pd.DataFrame(out, columns=["key", "week", "held"])

    def close(self) -> None:
        pass


def week_runs(weeks: DataFrame, by: str, week: str, flag: str, least: int = 2, late: str = "7 days") -> DataFrame:
    """key, week, held: what ``portfolio.streaks`` gives, online, from rows of (by, start of the week, flag).

    Weeks may come out of order within the lateness, and repeatedly: one true flag makes a week count. A
    week without a row ends a run, and a timer then drops the state. Weeks start on Mondays, UTC.
    """
    keyed_state(weeks)
    rows = weeks.select(F.col(by).cast("string").alias("key"), F.col(week).cast("timestamp").alias("week"), F.col(flag).alias("over")).withWatermark("week", late)
    return rows.groupBy("key").transformWithStateInPandas(WeekRuns(least), "key string, week timestamp, held int", "append", "eventTime")


class LeadRouter(StatefulProcessor):
    """State of a lead: whose turn it is and until when; a closed lead stays closed for some time."""

    def __init__(self, contractors: list[str], window_ms: int, closed_ms: int):
        self.contractors, self.window_ms, self.closed_ms = contractors, window_ms, closed_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.lead = handle.getValueState("lead", "turn int, until long, closed boolean")

    def _pass_on(self, turn: int, until: int, now: int, out: list) -> tuple[int, int, bool]:
        while until <= now:
            turn, until = turn + 1, until + self.window_ms
            if turn >= len(self.contractors):
                out.append((None, "expired"))
                return turn, until - self.window_ms + self.closed_ms, True
            out.append((self.contractors[turn], "offered"))
        return turn, until, False

    def _keep(self, key, turn: int, until: int, closed: bool, out: list) -> Iterator[pd.DataFrame]:
        for timer in self.handle.listTimers():
            self.handle.deleteTimer(timer)
        self.lead.update((turn, until, closed))
        self.handle.registerTimer(until)
        if out:
            yield pd.DataFrame({"lead": key[0], "contractor": [c for c, _ in out], "status": [s for _, s in out]})

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        seen = sorted((int(r.ts.timestamp() * 1000), isinstance(r.answer, str)) for f in rows for r in f.itertuples())
        out: list[tuple[str | None, str]] = []
        turn, until, closed = self.lead.get() if self.lead.exists() else (-1, 0, False)
        for at, answer in seen:
            if closed and at >= until:
                turn, closed = -1, False  # the mark has run out, so it is a new lead
            if closed:
                continue
            if turn < 0:
                turn, until = 0, at + self.window_ms
                out.append((self.contractors[0], "offered"))
            turn, until, closed = self._pass_on(turn, until, at, out)
            if answer and not closed:
                out.append((self.contractors[turn], "answered"))
                until, closed = at + self.closed_ms, True
        if not closed:
            turn, until, closed = self._pass_on(turn, until, timerValues.getCurrentWatermarkInMs(), out)
        yield from self._keep(key, turn, until, closed, out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if not self.lead.exists():
            return
        turn, until, closed = self.lead.get()
        now = timerValues.getCurrentWatermarkInMs()
        if closed:
            if until <= now:
                self.lead.clear()
            return
        out: list[tuple[str | None, str]] = []
        yield from self._keep(key, *self._pass_on(turn, until, now, out), out)

    def close(self) -> None:
        pass


def route_leads(events: DataFrame, contractors: list[str], minutes: int = 30, late: str = "1 minute", closed_days: int = 30) -> DataFrame:
    """A lead is one contractor's for some minutes of event time; if none answers, the next one's.

    Events: (lead, ts, answer); the first row of a lead opens it. An answer counts for the
    contractor whose window it falls in and closes the lead, as does the end of the last window. A
    closed lead takes no more answers for ``closed_days``; a row after that opens it anew.
    """
    keyed_state(events)
    router = LeadRouter(contractors, minutes * 60_000, closed_days * DAY_MS)
    rows = events.select(F.col("lead").cast("string").alias("lead"), "ts", "answer").withWatermark("ts", late)
    return rows.groupBy("lead").transformWithStateInPandas(router, "lead string, contractor string, status string", "append", "eventTime")
