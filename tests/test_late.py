"""Alerts and late statements: the stream gives what the batch gives, in any order; sinks that a repeated batch doesn't change."""

import datetime as dt
import random

import pytest

from ledgerloom.streaming import alerts, late, pipeline as p

ROW = "is_alert boolean, id string, ts timestamp, card long, amount long"
START = dt.datetime(2024, 1, 1)


@pytest.fixture
def store(spark):
    for k, v in alerts.STATE_STORE.items():
        spark.conf.set(k, v)
    yield
    for k in alerts.STATE_STORE:
        spark.conf.unset(k)


def batch(spark, rows):
    df = spark.createDataFrame(rows, ROW)
    return sorted(map(tuple, late.matches(df.filter("is_alert"), df.filter("NOT is_alert"), ["card", "amount"]).collect()), key=str)


def test_three_days_included_more_excluded(spark):
    day, second = dt.timedelta(days=1), dt.timedelta(seconds=1)
    rows = [(True, "a", START, 1, 5), (False, "on", START + 3 * day, 1, 5), (False, "off", START + 3 * day + second, 1, 5), (False, "before", START - 3 * day, 1, 5), (False, "other", START, 1, 6),
            (True, "alone", START, 2, 5), (True, "null", START, None, 5), (False, "null", START, None, 5)]
    assert batch(spark, rows) == [("a", "before", "matched"), ("a", "on", "matched"), ("alone", None, "unmatched"), ("null", None, "unmatched")]


@pytest.mark.parametrize("order", ["time", "statements first", "alerts first", "any"])
def test_stream_equals_batch_in_any_order(spark, store, tmp_path, order):
    r = random.Random(2)
    rows = [(r.random() < 0.5, f"r{k}", START + dt.timedelta(hours=r.randint(0, 24 * 20)), r.randint(0, 2), r.randint(0, 3)) for k in range(120)]
    want = batch(spark, rows)
    rows.sort(key={"time": lambda x: x[2], "statements first": lambda x: (x[0], x[2]), "alerts first": lambda x: (not x[0], x[2]), "any": lambda x: r.random()}[order])
    parts = [rows[:60], rows[60:] + rows[50:70], [(False, "end", START + dt.timedelta(days=40), 9, 9)]]  # with a replay
    for part in parts:
        spark.createDataFrame(part, ROW).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(ROW).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
        out = late.match_stream(stream, ["card", "amount"])
        out.writeStream.foreachBatch(p.replace_batch(f"{tmp_path}/out")).option("checkpointLocation", f"{tmp_path}/ck").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    told = p.read_batches(spark, f"{tmp_path}/out")
    assert sorted(map(tuple, late.settled(told).collect()), key=str) == want
    counts = {x["status"]: x["count"] for x in told.groupBy("status").count().collect()}
    assert counts["matched"] + counts.get("repaired", 0) == sum(x[1] is not None for x in want)
    assert order != "alerts first" or counts["repaired"] > 0


def test_a_repeated_batch_adds_nothing_and_reads_nothing(spark, tmp_path):
    path = str(tmp_path / "out")
    sink = p.replace_batch(path)
    rows = lambda a, b: spark.range(a, b).withColumnRenamed("id", "k")
    sink(rows(0, 10), 0)
    sink(rows(10, 20), 1)
    sink(rows(10, 20), 1)
    sink(rows(20, 20), 2)
    assert sorted(r.k for r in p.read_batches(spark, path).collect()) == list(range(20))
    # A batch doesn't look at the table: it isn't read where it can't be.
    (tmp_path / "out/batch_id=0/broken.parquet").write_bytes(b"none")
    sink(rows(30, 40), 3)
    assert spark.read.parquet(f"{path}/batch_id=3").count() == 10


def test_replays_are_dropped_over_all_history(spark, store, tmp_path):
    schema = "event_id long, ts timestamp"
    old, new = dt.datetime(2020, 1, 1), dt.datetime(2024, 1, 1)
    for k, part in enumerate([[(1, old), (2, old)], [(3, new)], [(1, old), (2, old), (4, new)]]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
        q = p.deduplicated(stream, delay=None).writeStream.foreachBatch(p.replace_batch(f"{tmp_path}/out")).option("checkpointLocation", f"{tmp_path}/ck")
        q.trigger(availableNow=True).start().awaitTermination()
    assert sorted(r.event_id for r in p.read_batches(spark, f"{tmp_path}/out").collect()) == [1, 2, 3, 4]


def test_counters_of_a_stream(spark, tmp_path):
    schema = "user_id long, event_type string, ts timestamp"
    rows = [(1, "view", START), (1, "error", START + dt.timedelta(hours=1)), (2, "view", START)]
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/in")
    q = p.running_counters(spark.readStream.schema(schema).parquet(f"{tmp_path}/in")).writeStream.format("memory").queryName("counters").outputMode("update").trigger(availableNow=True).start()
    q.awaitTermination()
    got = sorted(map(tuple, spark.table("counters").collect()))
    assert got == [(1, 2, 1, START, START + dt.timedelta(hours=1)), (2, 1, 1, START, START)]
