"""Alerts that need memory from batch to batch: feeds that fall silent, and limits that are reached.

Each alert has a batch form over tables and a stream form with keyed state; both give the same alerts, however the rows
are dealt into batches. The stream forms need the RocksDB state store (``STATE_STORE``).
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, TimerValues

#: Session setting of the state store that keyed state with timers asks for.
STATE_STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}
#: So long may a feed be silent after a doubtful sighting.
QUIET_HOURS = 2
#: Levels in per cent of a limit that are told of, where none are set.
LEVELS = [80, 90, 100]
#: A month's fired levels are remembered for so long.
REMEMBER_DAYS = 62
_HOUR = 3_600_000


def _ms(column: str) -> F.Column:
    return F.unix_millis(F.col(column).cast("timestamp"))


def absences(sightings: DataFrame, syncs: DataFrame, *, hours: int = QUIET_HOURS, until: str | None = None) -> DataFrame:
    """feed, sighting_id, due: doubtful sightings (feed, sighting_id, ts) that no sync (feed, ts) of their feed followed in time.

    A sync counts from the sighting's own time up to ``hours`` later, both included; ``due`` is that end. With ``until``, only
    alerts due by then are given. Of a feed's syncs the first and last of each stretch of ``hours`` are kept; a sighting asks
    its own stretch and the next one, so a busy feed is many keys. Rows without a feed or a time count for nothing.
    """
    width = hours * _HOUR
    heard = syncs.filter("feed IS NOT NULL AND ts IS NOT NULL").select("feed", _ms("ts").alias("_at"))
    heard = heard.groupBy("feed", F.floor(F.col("_at") / width).alias("_slot")).agg(F.min("_at").alias("_first"), F.max("_at").alias("_last"))
    asked = sightings.filter("feed IS NOT NULL AND ts IS NOT NULL").select("feed", "sighting_id", "ts", _ms("ts").alias("_t")).withColumn("_own", F.floor(F.col("_t") / width))
    asked = asked.select("*", F.explode(F.array(F.lit(0), F.lit(1))).alias("_step")).withColumn("_slot", F.col("_own") + F.col("_step"))
    met = asked.join(heard, ["feed", "_slot"], "left")
    answered = F.when(F.col("_step") == 0, F.col("_last") >= F.col("_t")).otherwise(F.col("_first") <= F.col("_t") + width)
    silent = met.groupBy("feed", "sighting_id", "ts").agg(F.max(F.coalesce(answered, F.lit(False))).alias("_answered")).filter("NOT _answered")
    due = silent.select("feed", "sighting_id", F.timestamp_add("HOUR", F.lit(hours), F.col("ts")).alias("due"))
    return due.filter(F.col("due") <= F.lit(until).cast(due.schema["due"].dataType)) if until else due


class _Absence(StatefulProcessor):
    """State of a feed: by stretch the first and last sync; by time of alert the sightings that wait for it."""

    def __init__(self, hours: int):
        self.width = hours * _HOUR

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.heard = handle.getMapState("heard", "slot long", "first long, last long")
        self.waiting = handle.getMapState("waiting", "due long", "ids array<string>")

    def _forget(self, watermark: int) -> None:
        """Drop the stretches that neither a sighting to come nor one that waits can ask for."""
        first = min([watermark, *(due for (due,) in self.waiting.keys())]) - self.width
        for (slot,) in list(self.heard.keys()):
            if (slot + 1) * self.width <= first:
                self.heard.removeKey((slot,))

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: TimerValues) -> Iterator[Row]:
        watermark = timerValues.getCurrentWatermarkInMs()
        heard: dict[int, tuple[int, int]] = {}
        waiting: dict[int, set[str]] = {}
        for r in rows:
            if r.sighting_id is None:
                first, last = heard.get(r.at // self.width, (r.at, r.at))
                heard[r.at // self.width] = (min(first, r.at), max(last, r.at))
            elif r.at + self.width > watermark:  # else it was decided before, or came too late to be
                waiting.setdefault(r.at + self.width, set()).add(r.sighting_id)
        for slot, (first, last) in heard.items():
            if self.heard.containsKey((slot,)):
                before = self.heard.getValue((slot,))
                first, last = min(first, before[0]), max(last, before[1])
            self.heard.updateValue((slot,), (first, last))
        for due, ids in waiting.items():
            if self.waiting.containsKey((due,)):
                ids |= set(self.waiting.getValue((due,))[0])
            else:
                self.handle.registerTimer(due)
            self.waiting.updateValue((due,), (sorted(ids),))
        self._forget(watermark)
        return iter([])

    def _answered(self, at: int) -> bool:
        slot = at // self.width
        if self.heard.containsKey((slot,)) and self.heard.getValue((slot,))[1] >= at:
            return True
        return self.heard.containsKey((slot + 1,)) and self.heard.getValue((slot + 1,))[0] <= at + self.width

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[Row]:
        due = expiredTimerInfo.getExpiryTimeInMs()
        if self.waiting.containsKey((due,)):
            ids = self.waiting.getValue((due,))[0]
            self.waiting.removeKey((due,))
            if not self._answered(due - self.width):
                for x in ids:
                    yield Row(feed=key[0], sighting_id=x, due_ms=due)
        self._forget(timerValues.getCurrentWatermarkInMs())


def absence_stream(rows: DataFrame, *, hours: int = QUIET_HOURS, delay: str = "1 hour") -> DataFrame:
    """The stream form of ``absences``: ``rows`` has feed, ts and sighting_id, which is null for a sync.

    An alert comes when the watermark (``delay`` behind the latest row) passes its time, once, also when a query goes on from its
    checkpoint. Sightings that are replayed, or come later than that, raise none. Ids come back as strings.
    """
    clean = rows.filter("feed IS NOT NULL AND ts IS NOT NULL").withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay)
    keyed = clean.select(F.col("feed").cast("string").alias("feed"), "ts", F.col("sighting_id").cast("string").alias("sighting_id"), F.unix_millis("ts").alias("at")).groupBy("feed")
    out = keyed.transformWithState(_Absence(hours), "feed string, sighting_id string, due_ms long", "append", "eventTime")
    return out.select("feed", "sighting_id", F.timestamp_millis("due_ms").alias("due"))


def read_levels(text: F.Column) -> F.Column:
    """Levels from a JSON list of numbers, without fractions, in order and each once; the usual ones where it can't be read."""
    usual = F.array(*map(F.lit, LEVELS)).cast("array<bigint>")
    read = F.from_json(text, "array<double>")
    whole = F.transform(read, lambda x: x.cast("bigint"))
    return F.when(read.isNull() | F.exists(read, lambda x: x.isNull()), usual).otherwise(F.array_sort(F.array_distinct(whole)))


def _reached(spent: F.Column, limit: F.Column, level: F.Column) -> F.Column:
    return spent * 100 >= level * limit


def thresholds(spending: DataFrame, limits: DataFrame) -> DataFrame:
    """instrument_id, month, level: each level that a month's spending reached.

    ``spending`` has instrument_id, ts and amount_minor, ``limits`` instrument_id, limit_minor and levels, a JSON list
    (see ``read_levels``). An instrument without a limit, or with none over 0, has no alerts. Amounts without an instrument or a
    time count for nothing.
    """
    spent = spending.filter("ts IS NOT NULL").groupBy("instrument_id", F.date_format("ts", "yyyy-MM").alias("month")).agg(F.sum("amount_minor").alias("_spent"))
    known = limits.filter("limit_minor > 0").select("instrument_id", "limit_minor", F.explode(read_levels(F.col("levels"))).alias("level"))
    return spent.join(known, "instrument_id").filter(_reached(F.col("_spent"), F.col("limit_minor"), F.col("level"))).select("instrument_id", "month", "level")


class _Thresholds(StatefulProcessor):
    """State of an instrument's month: what is spent, and the levels that have fired; it goes some time after the month."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.spent = handle.getValueState("spent", "minor long")
        self.fired = handle.getMapState("fired", "level long", "spent long")

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: TimerValues) -> Iterator[Row]:
        known = self.spent.exists()
        spent, limit, levels, end = self.spent.get()[0] if known else 0, None, [], 0
        for r in rows:
            spent += r.amount_minor or 0
            limit, levels, end = r.limit_minor, r.levels, r.end_ms
        if end <= timerValues.getCurrentWatermarkInMs():
            return
        if not known:
            self.handle.registerTimer(end)
        self.spent.update((spent,))
        for level in levels if limit and limit > 0 else []:
            if spent * 100 >= level * limit and not self.fired.containsKey((level,)):
                self.fired.updateValue((level,), (spent,))
                yield Row(instrument_id=key[0], month=key[1], level=level, spent_minor=spent)

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[Row]:
        self.spent.clear()
        self.fired.clear()
        return iter([])


def threshold_stream(spending: DataFrame, limits: DataFrame, *, delay: str = "3 days") -> DataFrame:
    """The stream form of ``thresholds``, with spent_minor as it was when the level fired: a level fires once a month.

    ``spending`` is a stream of instrument_id, ts and amount_minor that has each payment once (see ``deduplicated``); ``limits`` is a
    table, read for each batch. A month is forgotten ``REMEMBER_DAYS`` after its end, by the watermark; what comes later counts
    for nothing.
    """
    known = limits.select("instrument_id", "limit_minor", read_levels(F.col("levels")).alias("levels"))
    rows = spending.filter("instrument_id IS NOT NULL AND ts IS NOT NULL").withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay).join(known, "instrument_id", "left")
    after = F.add_months(F.trunc("ts", "month"), 1).cast("timestamp") + F.expr(f"INTERVAL {REMEMBER_DAYS} DAYS")
    keyed = rows.select(
        "instrument_id", F.date_format("ts", "yyyy-MM").alias("month"), "ts", F.unix_millis(after).alias("end_ms"), F.col("amount_minor").cast("long").alias("amount_minor"),
        F.col("limit_minor").cast("long").alias("limit_minor"), F.coalesce("levels", F.array().cast("array<bigint>")).alias("levels"))
    kind = spending.schema["instrument_id"].dataType.simpleString()
    return keyed.groupBy("instrument_id", "month").transformWithState(_Thresholds(), f"instrument_id {kind}, month string, level long, spent_minor long", "append", "eventTime")
