"""Alerts and the statements that confirm them days later, in whatever order they come.

An alert is matched with a statement row that is alike and at most some days off. One that stays alone is told of when its
days are over, and put right when a late statement comes after all.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, TimerValues

DAYS = 3
#: Alerts and statements are remembered for so long.
KEEP_DAYS = 90
_DAY = 86_400_000


def matches(alerts: DataFrame, statements: DataFrame, on: list[str], *, days: int = DAYS) -> DataFrame:
    """alert_id, statement_id, status: a row for each pair at most ``days`` apart, both ends included, and one for each alert without.

    Both sides have id, ts and the columns ``on``; rows with a null among these match nothing. The join is on these
    and a stretch of days, so a busy key is many.
    """
    width = days * _DAY
    at = F.unix_millis(F.col("ts").cast("timestamp"))
    left = alerts.select(F.col("id").alias("alert_id"), at.alias("_a"), *on).withColumn("_slot", F.floor(F.col("_a") / width))
    right = statements.select(F.col("id").alias("statement_id"), at.alias("_s"), *on).withColumn("_own", F.floor(F.col("_s") / width))
    spread = right.withColumn("_slot", F.explode(F.array(F.col("_own") - 1, F.col("_own"), F.col("_own") + 1))).drop("_own").withColumnsRenamed({c: f"_{n}" for n, c in enumerate(on)})
    same = reduce(Column.__and__, (F.col(c) == F.col(f"_{n}") for n, c in enumerate(on)))
    near = F.abs(F.col("_a") - F.col("_s")) <= width
    met = left.join(spread.withColumnRenamed("_slot", "_to"), same & (F.col("_slot") == F.col("_to")) & near, "left")
    return met.select("alert_id", "statement_id", F.when(F.col("statement_id").isNull(), "unmatched").otherwise("matched").alias("status"))


class _Matches(StatefulProcessor):
    """State of a key: its alerts (time, whether matched, whether told of) and its statements (time)."""

    def __init__(self, days: int, keep_days: int):
        self.width, self.keep = days * _DAY, keep_days * _DAY

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.alerts = handle.getMapState("alerts", "id string", "at long, matched boolean, told boolean")
        self.statements = handle.getMapState("statements", "id string", "at long")

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: TimerValues) -> Iterator[Row]:
        watermark = timerValues.getCurrentWatermarkInMs()
        alerts = {k[0]: list(v) for k, v in self.alerts.iterator()}
        statements = {k[0]: v[0] for k, v in self.statements.iterator()}
        fresh: list[tuple[bool, str]] = []
        for r in rows:
            known = alerts if r.is_alert else statements
            if r.id in known or r.at + self.keep <= watermark:
                continue  # a replay, or older than what is remembered
            known[r.id] = [r.at, False, False] if r.is_alert else r.at
            fresh.append((r.is_alert, r.id))
        new = {True: {i for a, i in fresh if a}, False: {i for a, i in fresh if not a}}
        for a, state in alerts.items():
            for s, at in statements.items():
                if (a in new[True] or s in new[False]) and abs(state[0] - at) <= self.width:
                    yield Row(alert_id=a, statement_id=s, status="repaired" if state[2] else "matched")
                    state[1] = True
        for a, state in alerts.items():
            if a in new[True] and not state[1] and state[0] + self.width <= watermark:
                state[2] = True
                yield Row(alert_id=a, statement_id=None, status="unmatched")
        for is_alert, i in fresh:
            at = alerts[i][0] if is_alert else statements[i]
            if is_alert and at + self.width > watermark:
                self.handle.registerTimer(at + self.width)
            self.handle.registerTimer(at + self.keep)
            if not is_alert:
                self.statements.updateValue((i,), (at,))
        for a, state in alerts.items():
            self.alerts.updateValue((a,), tuple(state))

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[Row]:
        due = expiredTimerInfo.getExpiryTimeInMs()
        for (a,), (at, matched, told) in list(self.alerts.iterator()):
            if at + self.keep <= due:
                self.alerts.removeKey((a,))
            elif not matched and not told and at + self.width <= due:
                self.alerts.updateValue((a,), (at, matched, True))
                yield Row(alert_id=a, statement_id=None, status="unmatched")
        for (s,), (at,) in list(self.statements.iterator()):
            if at + self.keep <= due:
                self.statements.removeKey((s,))


def match_stream(rows: DataFrame, on: list[str], *, days: int = DAYS, delay: str = "1 hour", keep_days: int = KEEP_DAYS) -> DataFrame:
    """The stream form of ``matches``: ``rows`` has is_alert, id, ts and the columns ``on``.

    A pair comes as soon as both are there. An alert whose days are over, by the watermark, comes as unmatched, once; a pair
    that is found later comes as repaired. The pairs are those of the batch form for any order of the rows, as long as they
    aren't ``keep_days`` late; alerts without a pair are the unmatched ones that were not repaired. Rows with a null in id, ts or
    ``on`` are left out. Ids come back as strings.
    """
    good = reduce(Column.__and__, (F.col(c).isNotNull() for c in ("id", "ts", *on)))
    timed = rows.filter(good).withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay)
    # Without the column of the watermark: rows behind it are not to be left out.
    keyed = timed.select("is_alert", F.col("id").cast("string").alias("id"), F.unix_millis("ts").alias("at"), *on).groupBy(*on)
    return keyed.transformWithState(_Matches(days, keep_days), "alert_id string, statement_id string, status string", "append", "eventTime")


def settled(told: DataFrame) -> DataFrame:
    """What ``match_stream`` told, settled: its pairs, and the unmatched alerts that have none."""
    pairs = told.filter("statement_id IS NOT NULL").select("alert_id", "statement_id", F.lit("matched").alias("status")).distinct()
    alone = told.filter("statement_id IS NULL").select("alert_id").distinct().join(pairs, "alert_id", "left_anti")
    return pairs.unionByName(alone.select("alert_id", F.lit(None).cast("string").alias("statement_id"), F.lit("unmatched").alias("status")))
