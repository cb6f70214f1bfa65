"""Rules, corrections, audit chains and other mutating commands as rewrites of frames."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ledgerloom.operators import tables as t
from ledgerloom.plans.registry import query
from ledgerloom.views import Views


@query("rule_dedup", """SELECT event_id, user_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY CASE WHEN event_id % 3 = 0 THEN 0 WHEN event_id % 3 = 1 THEN 1 ELSE 2 END, value DESC, ts, event_id) = 1""")
def rule_dedup(v: Views):
    rank = F.when(F.col("event_id") % 3 == 0, 0).when(F.col("event_id") % 3 == 1, 1).otherwise(2)
    return t.keep_best(v.events, ["user_id", "event_type"], [rank, F.desc("value"), "ts", "event_id"]).select("event_id", "user_id", "event_type")


@query("rule_parents", "SELECT user_id % 10 AS bank, event_type AS field, min(event_id) AS parent, max(ts) AS updated_at FROM events GROUP BY 1, 2")
def rule_parents(v: Views):
    return v.events.groupBy((F.col("user_id") % 10).alias("bank"), F.col("event_type").alias("field")).agg(F.min("event_id").alias("parent"), F.max("ts").alias("updated_at"))


@query("rule_samples", """, s AS (SELECT o.obs_id, i.issuer_name, o.event_time, o.amount_minor FROM observations o JOIN instruments i USING (instrument_id) LEFT JOIN canonical_base c ON c.order_id = o.order_id WHERE o.source_pipeline = 'email')
SELECT obs_id, issuer_name, amount_minor FROM s QUALIFY row_number() OVER (PARTITION BY issuer_name ORDER BY event_time DESC, obs_id) <= 20""")
def rule_samples(v: Views):
    rows = v.observations.filter("source_pipeline = 'email'").join(v.instruments.select("instrument_id", "issuer_name"), "instrument_id")
    latest = F.row_number().over(Window.partitionBy("issuer_name").orderBy(F.desc("event_time"), "obs_id"))
    return rows.withColumn("_p", latest).filter("_p <= 20").select("obs_id", "issuer_name", "amount_minor")


@query("rule_lifecycle", """, o AS (SELECT user_id AS rule_id, list({'ok': event_type <> 'error'} ORDER BY ts, event_id) AS o FROM events GROUP BY 1),
f AS (SELECT rule_id, list_reduce(list_transform(o, lambda x: {'good': CASE WHEN x.ok THEN 1 ELSE 0 END, 'bad': CASE WHEN x.ok THEN 0 ELSE 1 END, 'state': 'pending'}), lambda a, x: {
  'good': a.good + x.good, 'bad': a.bad + x.bad, 'state': CASE WHEN a.state = 'inactive' OR a.bad + x.bad >= 3 OR (a.good + x.good + a.bad + x.bad >= 3 AND a.good + x.good < 0.7 * (a.good + x.good + a.bad + x.bad)) THEN 'inactive' WHEN a.good + x.good >= 10 THEN 'trusted' WHEN a.good + x.good >= 3 THEN 'active' ELSE a.state END}, {'good': 0, 'bad': 0, 'state': 'pending'}) AS s FROM o)
SELECT rule_id, s.good AS good, s.bad AS bad, s.state AS state FROM f""")
def rule_lifecycle(v: Views):
    numbered = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return t.rule_states(v.events.select(F.col("user_id").alias("rule_id"), numbered.alias("seq"), (F.col("event_type") != "error").alias("ok")))


@query("corrections_apply_revert", """, c AS (SELECT txn_id, merchant_id, CASE WHEN order_id % 4 = 0 THEN merchant_id + 1000 END AS corrected, order_id % 8 = 0 AS reverted FROM live)
SELECT txn_id, CASE WHEN corrected IS NOT NULL AND NOT reverted THEN corrected ELSE merchant_id END AS merchant_id, CASE WHEN corrected IS NOT NULL THEN CASE WHEN reverted THEN 'reverted' ELSE 'applied' END END AS state FROM c""")
def corrections_apply_revert(v: Views):
    corrections = v.live.filter("order_id % 4 = 0").select("txn_id", (F.col("merchant_id") + 1000).alias("corrected"), F.when(F.col("order_id") % 8 == 0, "reverted").otherwise("applied").alias("state"))
    joined = v.live.join(corrections, "txn_id", "left")
    return joined.select("txn_id", F.when(F.col("state") == "applied", F.col("corrected")).otherwise(F.col("merchant_id")).alias("merchant_id"), "state")


@query("audit_chain_verify", "SELECT event_id FROM (SELECT event_id, lag(event_id) OVER (PARTITION BY user_id ORDER BY event_id) AS b FROM events) WHERE event_id % 97 = 0 OR b % 97 = 0")
def audit_chain_verify(v: Views):
    # A chain for each user; rows that 97 divides have been changed after their hash was made.
    fields = ["event_id", "event_type"]
    chain = t.chained(v.events.select("user_id", *fields), "user_id", "event_id", fields)
    tampered = chain.withColumn("row_hash", F.when(F.col("event_id") % 97 == 0, F.lit("0")).otherwise(F.col("row_hash")))
    return t.bad_links(tampered, "user_id", "event_id", fields).select("event_id")


@query("trial_eligibility", """, prior AS (SELECT DISTINCT CAST(json_extract(props, '$.k') AS INT) AS k FROM events WHERE event_type = 'signup' AND ts < TIMESTAMP '2024-01-02'), u AS (SELECT user_id, min(CAST(json_extract(props, '$.k') AS INT)) AS k, max(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) AS paid, max(CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END) AS trial FROM events GROUP BY 1)
SELECT user_id, CASE WHEN paid = 1 AND user_id % 2 = 0 THEN 'already_paid' WHEN trial = 1 AND user_id % 3 = 0 THEN 'already_trialled' WHEN k IN (SELECT k FROM prior) THEN 'device_used' ELSE 'eligible' END AS verdict FROM u""")
def trial_eligibility(v: Views):
    from ledgerloom.views import ts

    device = F.get_json_object("props", "$.k").cast("int")
    prior = v.events.filter((F.col("event_type") == "signup") & (F.col("ts") < ts("2024-01-02 00:00:00"))).select(device.alias("k"), F.lit(True).alias("used")).distinct()
    flag = lambda e: F.max(F.when(F.col("event_type") == e, 1).otherwise(0))
    users = v.events.groupBy("user_id").agg(F.min(device).alias("k"), flag("purchase").alias("paid"), flag("signup").alias("trial"))
    verdict = F.when((F.col("paid") == 1) & (F.col("user_id") % 2 == 0), "already_paid").when((F.col("trial") == 1) & (F.col("user_id") % 3 == 0), "already_trialled").when(F.col("used"), "device_used").otherwise("eligible")
    return users.join(prior, "k", "left").select("user_id", verdict.alias("verdict"))


@query("unprocessed_by_status", "SELECT event_type AS status, count(*) AS n, max(CAST(json_extract(props, '$.k') AS INT)) AS largest, string_agg(DISTINCT 'user ' || (user_id % 5), ',' ORDER BY 'user ' || (user_id % 5)) AS names FROM events GROUP BY 1")
def unprocessed_by_status(v: Views):
    return v.events.groupBy(F.col("event_type").alias("status")).agg(
        F.count("*").alias("n"), F.max(F.from_json("props", "k INT")["k"]).alias("largest"),
        F.array_join(F.sort_array(F.collect_set(F.concat(F.lit("user "), (F.col("user_id") % 5).cast("string")))), ",").alias("names"))


@query("channel_infer", "SELECT page_id, coalesce(CASE WHEN page_id % 4 = 0 THEN 'stored' END, CASE WHEN contains(url, '.org') THEN 'org' WHEN contains(url, '.net') THEN 'net' ELSE 'other' END) AS channel, coalesce(length(html), 0) + coalesce(CASE WHEN page_id % 3 = 0 THEN length(url) END, 0) AS bytes FROM pages")
def channel_infer(v: Views):
    inferred = F.when(F.col("url").contains(".org"), "org").when(F.col("url").contains(".net"), "net").otherwise("other")
    n = lambda c: F.coalesce(c, F.lit(0))
    return v.table("pages").select("page_id", F.coalesce(F.when(F.col("page_id") % 4 == 0, "stored"), inferred).alias("channel"), (n(F.length("html")) + n(F.when(F.col("page_id") % 3 == 0, F.length("url")))).cast("long").alias("bytes"))
