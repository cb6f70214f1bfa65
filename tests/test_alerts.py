"""Alerts by keyed state: the stream forms give what the batch forms give, however the rows come."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from ledgerloom.streaming import alerts, pipeline as p

START = dt.datetime(2024, 1, 1)
ROW = "feed string, ts timestamp, sighting_id string"


@pytest.fixture
def store(spark):
    for k, v in alerts.STATE_STORE.items():
        spark.conf.set(k, v)
    yield
    for k in alerts.STATE_STORE:
        spark.conf.unset(k)


def at(hours: float) -> dt.datetime:
    return START + dt.timedelta(hours=hours)


def run(stream, out, checkpoint):
    """Appends what the stream gives to a table, as files that a batch that runs again replaces."""
    stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start().awaitTermination()


def split(rows):
    return [r for r in rows if r[2] is not None], [r[:2] for r in rows if r[2] is None]


def brute(rows, hours=2):
    sightings, syncs = split(rows)
    end = dt.timedelta(hours=hours)
    return sorted({(f, i, t + end) for f, t, i in sightings if f and t and not any(g == f and s and t <= s <= t + end for g, s in syncs)})


def batch(spark, rows, until=None):
    sightings, syncs = split(rows)
    return alerts.absences(spark.createDataFrame(sightings, ROW).select("feed", "sighting_id", "ts"), spark.createDataFrame(syncs, "feed string, ts timestamp"), until=until)


def test_a_bank_that_falls_silent(spark):
    rows = [("a", at(0), "1"), ("a", at(2), None), ("b", at(0), "2"), ("b", at(2.001), None), ("c", at(0), "3"), ("c", at(-1), None), ("d", at(1), "4"), ("d", at(1), None), (None, at(1), "5"), ("e", None, "6"), ("e", None, None)]
    rows += [("b", at(0), "2")]
    got = sorted(map(tuple, batch(spark, rows).collect()))
    assert got == brute(rows) and {r[1] for r in got} == {"2", "3"}
    assert batch(spark, rows, "2024-01-01 01:59:59").count() == 0


@pytest.mark.parametrize("seed", [1, 2])
def test_absence_stream_equals_batch_with_restarts(spark, store, tmp_path, seed):
    r = random.Random(seed)
    rows = [(f"f{r.randint(0, 3)}", START + dt.timedelta(minutes=r.randint(0, 60 * 48)), f"s{k}" if r.random() < 0.5 else None) for k in range(150)]
    rows.sort(key=lambda x: x[1] + dt.timedelta(minutes=r.randint(0, 50)))  # out of order, within the delay
    rows.append(("end", at(60), None))
    want = brute(rows)
    assert sorted(map(tuple, batch(spark, rows).collect())) == want and 10 < len(want) < 70
    for k in range(0, len(rows), 40):  # a restart for each part, a replay of some rows among them
        part = rows[k : k + 40] + [x for x in rows[max(0, k - 60) : max(0, k - 40)] if x[2]]
        spark.createDataFrame(part, ROW).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(ROW).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
        run(alerts.absence_stream(stream), f"{tmp_path}/out", f"{tmp_path}/ck")
    got = sorted((x.feed, x.sighting_id, x.due) for x in spark.read.parquet(f"{tmp_path}/out").collect())
    assert got == want


def test_levels(spark):
    cases = {"[100, 80.9, 90, 80]": [80, 90, 100], "[]": [], None: [80, 90, 100], "x": [80, 90, 100], "[50]": [50], '["a"]': [80, 90, 100]}
    rows = spark.createDataFrame([(k,) for k in cases], "t string").select("t", alerts.read_levels(F.col("t")).alias("l")).collect()
    assert {r.t: r.l for r in rows} == cases


SPENT = "instrument_id long, ts timestamp, amount_minor long"


def spending(spark, path, rows, step):
    for k in range(0, len(rows), step):
        spark.createDataFrame(rows[k : k + step], SPENT).coalesce(1).write.mode("append").parquet(path)


@pytest.mark.parametrize("step", [1200, 450])
def test_a_burst_fires_each_level_once(spark, store, tmp_path, step):
    june, july = dt.datetime(2026, 6, 10, 12), dt.datetime(2026, 7, 1)
    rows = [(1, june, 100)] * 1195 + [(1, july, 100), (2, june, 5), (3, june, 10**9), (None, june, 10**9), (1, None, 10**9)]
    limits = spark.createDataFrame([(1, 10_000, None), (2, 5, "[50, 100]"), (3, 0, None)], "instrument_id long, limit_minor long, levels string")
    spending(spark, f"{tmp_path}/in", rows, step)
    for _ in range(2):  # a second run from the checkpoint, with one more payment
        stream = spark.readStream.schema(SPENT).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
        run(alerts.threshold_stream(stream, limits), f"{tmp_path}/out", f"{tmp_path}/ck")
        spending(spark, f"{tmp_path}/in", [(1, june, 100)], 1)
    got = sorted((r.instrument_id, r.month, r.level) for r in spark.read.parquet(f"{tmp_path}/out").collect())
    assert got == [(1, "2026-06", 80), (1, "2026-06", 90), (1, "2026-06", 100), (2, "2026-06", 50), (2, "2026-06", 100)]
    assert sorted(map(tuple, alerts.thresholds(spark.createDataFrame(rows, SPENT), limits).collect())) == got
