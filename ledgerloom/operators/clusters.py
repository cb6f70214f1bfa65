"""Open clusters that grow: observations that may be the same payment, batch by batch.

Two observations belong together if instrument, amount and direction are alike and their times are at most some days apart, or
if others between them tie them together so. A cluster keeps its id when later observations join it; one that ties two
clusters together makes them one, under the lesser id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

DAYS = 3
SPAN = 20
KEYS = ["instrument_id", "amount_minor", "direction"]
MEMBER = ["cluster_id", "obs_id", *KEYS, "event_time"]


def grow(members: DataFrame, fresh: DataFrame, *, days: int = DAYS, sparing: bool = True) -> DataFrame:
    """Members (``MEMBER``) of the open clusters after a batch: ``members`` as they were, and ``fresh`` observations (without cluster_id).

    Members and new observations meet in one shuffle, by key and span of ``SPAN`` times ``days``, and are chained within it. Only chains
    that come within ``days`` of a border of their span are held against each other, two at most a span, so a busy key is
    many spans in parallel and few rows in a row. ``sparing`` leaves clusters alone whose keys the batch hasn't: for batches
    that are small beside the members; with large ones it costs a shuffle of all members and spares few. An observation that is a member
    already stays one. Observations with a null key or time are clusters of their own. The id of a new cluster is a hash of its
    first member.
    """
    width = days * 86_400_000_000
    at = lambda c: F.unix_micros(c.cast("timestamp"))
    named = lambda head: F.sha2(F.concat_ws("|", F.lit("cluster"), head).cast("binary"), 256)
    first = F.row_number().over(Window.partitionBy("obs_id").orderBy("event_time", *KEYS))
    new = fresh.join(members.select("obs_id"), "obs_id", "left_anti").withColumn("_n", first).filter("_n = 1").select(F.lit(None).cast("string").alias("cluster_id"), *MEMBER[1:])
    bare = F.col("event_time").isNull()
    for k in KEYS:
        bare |= F.col(k).isNull()
    same, others = members.select(*MEMBER).filter(~bare), members.select(*MEMBER).filter(bare)
    if sparing:
        marked = same.join(new.filter(~bare).select(*KEYS).distinct().withColumn("_t", F.lit(True)), KEYS, "left")
        same, others = marked.filter(F.col("_t").isNotNull()).select(*MEMBER), others.unionByName(marked.filter(F.col("_t").isNull()).select(*MEMBER))
    start = at(F.col("event_time")) - F.pmod(at(F.col("event_time")), F.lit(SPAN * width))
    # Both branches below must ask the shuffle for the same rows and columns, or it is done twice: hence times as they are, and no nulls.
    rows = same.unionByName(new.filter(~bare)).withColumn("_span", start).filter(F.col("_span").isNotNull())
    order = Window.partitionBy(*KEYS, "_span").orderBy("event_time", "obs_id")
    apart = lambda last: F.coalesce(at(F.col("event_time")) - at(last) > width, F.lit(True)).cast("int")
    upto = (Window.unboundedPreceding, 0)
    chained = rows.withColumn("_begins", apart(F.lag("event_time").over(order))).withColumn("_chain", F.sum("_begins").over(order.rowsBetween(*upto)))
    chain = Window.partitionBy(*KEYS, "_span", "_chain")
    local = chained.withColumn("_old", F.min("cluster_id").over(chain)).withColumn("_head", F.min(F.struct("event_time", "obs_id")).over(chain)).withColumn("_last", F.max("event_time").over(chain))
    near = (at(F.col("event_time")) - F.col("_span") <= width) | (F.col("_span") + SPAN * width - at(F.col("_last")) <= width)
    ends = local.filter((F.col("_begins") == 1) & near).select(*KEYS, "_span", "_chain", "event_time", "obs_id", "_last", "_old")
    along = Window.partitionBy(*KEYS).orderBy("event_time")
    lined = ends.withColumn("_begins", apart(F.lag("_last").over(along))).withColumn("_line", F.sum("_begins").over(along.rowsBetween(*upto)))
    line = Window.partitionBy(*KEYS, "_line")
    tied = lined.withColumn("_n", F.count("*").over(line)).withColumn("_low", F.min("_old").over(line)).withColumn("_head", F.min(F.struct("event_time", "obs_id")).over(line)).filter("_n > 1")
    ties = tied.groupBy(*KEYS, "_span").agg(F.map_from_entries(F.collect_list(F.struct("_chain", F.coalesce("_low", named(F.col("_head.obs_id")))))).alias("_ties"))
    grown = local.join(ties, [*KEYS, "_span"], "left").withColumn("cluster_id", F.coalesce(F.try_element_at("_ties", F.col("_chain")), "_old", named(F.col("_head.obs_id")))).select(*MEMBER)
    alone = new.filter(bare).withColumn("cluster_id", named(F.col("obs_id"))).select(*MEMBER)
    return others.unionByName(grown).unionByName(alone)


def renamed(before: DataFrame, after: DataFrame) -> DataFrame:
    """(old_id, cluster_id) of the clusters that went up in others."""
    met = before.select("obs_id", F.col("cluster_id").alias("old_id")).join(after.select("obs_id", "cluster_id"), "obs_id")
    return met.filter("old_id <> cluster_id").select("old_id", "cluster_id").distinct()


def resolve_together(clusters: DataFrame, requests: DataFrame) -> DataFrame:
    """``clusters`` (cluster_id, status, ...) after ``requests`` (request_id, cluster_id, status), each done as a whole or not at all.

    A request holds only if all its clusters are there and open, and no request with a lesser id that holds for itself asks
    for one of them.
    """
    asked = requests.select("request_id", "cluster_id", F.col("status").alias("_new")).distinct()
    joined = asked.join(clusters.select("cluster_id", F.col("status").alias("_now")), "cluster_id", "left")
    whole = joined.withColumn("_ok", F.min(F.coalesce(F.col("_now") == "open", F.lit(False))).over(Window.partitionBy("request_id"))).filter("_ok")
    first = whole.withColumn("_first", F.min("request_id").over(Window.partitionBy("cluster_id")) == F.col("request_id"))
    held = first.withColumn("_all", F.min("_first").over(Window.partitionBy("request_id"))).filter("_all").groupBy("cluster_id").agg(F.min("_new").alias("_new"))
    return clusters.join(held, "cluster_id", "left").select(*(F.coalesce("_new", "status").alias("status") if c == "status" else F.col(c) for c in clusters.columns))
