"""Streaming forms: deduplicated ingestion, routed sinks, windows, running counters."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ledgerloom.sources.files import EVENT


def event_stream(spark: SparkSession, folder: str, *, max_files: int = 16) -> DataFrame:
    """Events from a landing folder; event time becomes an instant (UTC), as watermarks ask for."""
    return spark.readStream.schema(EVENT).option("maxFilesPerTrigger", max_files).parquet(folder).withColumn("ts", F.col("ts").cast("timestamp"))


def deduplicated(events: DataFrame, key: str = "event_id", delay: str | None = "3 days") -> DataFrame:
    """Replays of a key within the delay are dropped; state is let go behind the watermark.

    Without a delay each key is known for all time: a batch looks up its own keys in the state, which grows with them (on
    disk, with the RocksDB store).
    """
    return events.withWatermark("ts", delay).dropDuplicatesWithinWatermark([key]) if delay else events.dropDuplicates([key])


def windowed(events: DataFrame, window: Column, delay: str | None = None) -> DataFrame:
    """Counts and sums for each window and type; works on streams (with a delay) and on tables."""
    rows = events.withWatermark("ts", delay) if delay else events
    counted = rows.groupBy(window.alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum(F.round(F.col("value") * 100).cast("long")).alias("value_minor"))
    return counted.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "event_type", "n", "value_minor")


def sessions(events: DataFrame, gap: str, delay: str | None = None) -> DataFrame:
    rows = events.withWatermark("ts", delay) if delay else events
    counted = rows.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n"))
    return counted.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def matched_within(left: DataFrame, right: DataFrame, on: list[str], days: int = 3) -> DataFrame:
    """Stream-stream interval join: both sides have ``ts``; late rows within the delay still meet."""
    a = left.withWatermark("ts", f"{days} days").alias("a")
    b = right.withWatermark("ts", f"{days} days").alias("b")
    near = F.expr(f"b.ts BETWEEN a.ts - INTERVAL {days} DAYS AND a.ts + INTERVAL {days} DAYS")
    return a.join(b, reduce(Column.__and__, (F.col(f"a.{c}") == F.col(f"b.{c}") for c in on)) & near)


def replace_batch(path: str) -> Callable[[DataFrame, int], None]:
    """A batch sink with a folder for each batch: one that runs again replaces its own, and nothing is read.

    With ``deduplicated`` before it, each key is in the table once, however large that is. Read it with ``read_batches``.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    return write


def read_batches(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("basePath", path).parquet(f"{path}/batch_id=*").drop("batch_id")


def append_once(path: str, key: list[str]) -> Callable[[DataFrame, int], None]:
    """A batch sink that leaves out keys the table has: a batch that runs again adds nothing.

    It reads the keys of the whole table for each batch; where the table is large, use ``deduplicated`` and ``replace_batch``.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        fresh = batch.dropDuplicates(key)
        try:
            known = spark.read.parquet(path).select(*key)
        except Exception as e:  # the table begins with the first batch
            if "PATH_NOT_FOUND" not in str(e):
                raise
            known = None
        (fresh.join(known, key, "left_anti") if known is not None else fresh).write.mode("append").parquet(path)

    return write


def routed(routes: dict[str, Column], folder: str, key: list[str]) -> Callable[[DataFrame, int], None]:
    """A batch sink that sends rows to a table for each route; a row goes to every route whose condition it meets."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        for name, condition in routes.items():
            append_once(f"{folder}/{name}", key)(batch.filter(condition), batch_id)
        batch.unpersist()

    return write


def backfill(events: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Work through all that is there and stop; a later run goes on from the checkpoint."""
    return events.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def poll(events: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, seconds: int = 60) -> StreamingQuery:
    return events.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(processingTime=f"{seconds} seconds").start()


def running_counters(events: DataFrame) -> DataFrame:
    """Counters of each user, for update mode."""
    return events.groupBy("user_id").agg(F.count("*").alias("messages"), F.count_if(F.col("event_type") != "error").alias("passes"), F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"))
