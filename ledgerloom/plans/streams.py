"""Windowed queries, and the stream that works through a folder."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerloom.plans.registry import query
from ledgerloom.session import shared_path
from ledgerloom.streaming import alerts, late, pipeline as p
from ledgerloom.views import EVENTS_NOW, Views

_VALUES = "count(*) AS n, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS value_minor"


@query("events_tumbling", f"SELECT date_trunc('day', ts) AS start, date_trunc('day', ts) + INTERVAL 1 DAY AS \"end\", event_type, {_VALUES} FROM events GROUP BY 1, 2, 3")
def events_tumbling(v: Views):
    return p.windowed(v.events, F.window("ts", "1 day"))


@query("events_sliding", f", s AS (SELECT *, date_trunc('hour', ts) - to_hours(CAST(h AS INT)) AS b FROM events, (SELECT unnest(range(0, 24)) AS h)), w AS (SELECT * FROM s WHERE hour(b) % 6 = 0) SELECT b AS start, b + INTERVAL 24 HOUR AS \"end\", event_type, {_VALUES} FROM w GROUP BY 1, 2, 3")
def events_sliding(v: Views):
    return p.windowed(v.events, F.window("ts", "24 hours", "6 hours"))


@query("events_session", """, g AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER w + INTERVAL 2 HOUR THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
n AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM g) SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 2 HOUR AS "end", count(*) AS n FROM n GROUP BY user_id, s""")
def events_session(v: Views):
    return p.sessions(v.events, "2 hours")


@query("backfill_available_now", "SELECT event_id, user_id, event_type FROM events WHERE event_type <> 'view'")
def backfill_available_now(v: Views):
    """All events through a stream with a checkpoint into a table, which is the result."""
    folder = shared_path(v.spark, "backfill")
    source = v.spark.readStream.schema(v.events.schema).option("pathGlobFilter", "events.parquet").parquet(v.sf_dir)
    kept = source.filter("event_type <> 'view'").select("event_id", "user_id", "event_type")
    p.backfill(kept, p.append_once(f"{folder}/table", ["event_id"]), f"{folder}/checkpoint").awaitTermination()
    return v.spark.read.parquet(f"{folder}/table")


def _feeds(v: Views):
    """Errors are doubtful sightings of a user's feed, all else its syncs."""
    named = v.events.withColumnRenamed("user_id", "feed")
    return named.filter("event_type = 'error'").select("feed", F.col("event_id").alias("sighting_id"), "ts"), named.filter("event_type <> 'error'").select("feed", "ts")


@query("absence_alerts", """SELECT user_id AS feed, event_id AS sighting_id, ts + INTERVAL 2 HOUR AS due FROM events e
WHERE event_type = 'error' AND ts + INTERVAL 2 HOUR <= TIMESTAMP '2024-01-20 00:00:00'
AND NOT EXISTS (SELECT 1 FROM events s WHERE s.user_id = e.user_id AND s.event_type <> 'error' AND s.ts >= e.ts AND s.ts <= e.ts + INTERVAL 2 HOUR)""")
def absence_alerts(v: Views):
    """Doubtful sightings whose feed stayed silent, as of a fixed time."""
    return alerts.absences(*_feeds(v), until=EVENTS_NOW)


@query("threshold_alerts", """, lim AS (SELECT c_custkey AS instrument_id, c_custkey % 5 * 2000000 AS limit_minor, CASE c_custkey % 3 WHEN 0 THEN [50, 100] WHEN 1 THEN [80, 90, 100] ELSE [25, 75] END AS levels FROM customer),
s AS (SELECT instrument_id, strftime(best_event_time, '%Y-%m') AS month, sum(amount_minor) AS spent FROM counted WHERE direction = 'debit' GROUP BY 1, 2),
l AS (SELECT instrument_id, limit_minor, unnest(levels) AS level FROM lim WHERE limit_minor > 0)
SELECT instrument_id, month, CAST(level AS BIGINT) AS level FROM s JOIN l USING (instrument_id) WHERE spent * 100 >= level * limit_minor""")
def threshold_alerts(v: Views):
    """Levels of its own limit that each instrument's spending reached in each month."""
    k = F.col("c_custkey")
    levels = F.when(k % 3 == 0, "[100, 50.5]").when(k % 3 == 1, "unreadable").otherwise("[75, 25, 25]")
    limits = v.table("customer").select(k.alias("instrument_id"), (k % 5 * 2_000_000).alias("limit_minor"), levels.alias("levels"))
    return alerts.thresholds(v.counted.filter("direction = 'debit'").select("instrument_id", F.col("best_event_time").alias("ts"), "amount_minor"), limits)


@query("late_matches", """, a AS (SELECT obs_id, instrument_id, amount_minor, direction, event_time FROM observations), b AS (SELECT cand_id, instrument_id, amount_minor, direction, event_time FROM canonical)
SELECT obs_id AS alert_id, cand_id AS statement_id, CASE WHEN cand_id IS NULL THEN 'unmatched' ELSE 'matched' END AS status FROM a LEFT JOIN b ON a.instrument_id = b.instrument_id AND a.amount_minor = b.amount_minor AND a.direction = b.direction
AND b.event_time BETWEEN a.event_time - INTERVAL 3 DAY AND a.event_time + INTERVAL 3 DAY""")
def late_matches(v: Views):
    """Sightings and the ledger rows that confirm them within three days, and sightings that stay alone."""
    on = ["instrument_id", "amount_minor", "direction"]
    return late.matches(v.observations.select(F.col("obs_id").alias("id"), F.col("event_time").alias("ts"), *on), v.canonical.select(F.col("cand_id").alias("id"), F.col("event_time").alias("ts"), *on), on)
