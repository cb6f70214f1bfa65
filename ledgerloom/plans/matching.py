"""Reconciliation queries: candidates, scores, decisions, links and merges."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.operators import clusters, post
from ledgerloom.operators import matching as m
from ledgerloom.plans.registry import query
from ledgerloom.session import shared_path
from ledgerloom.views import Views

PAIRS = """, pairs AS (
  SELECT o.*, c.cand_id, c.event_time AS cand_time, c.reference_id AS cand_reference, c.merchant_name, c.source_mix FROM observations o JOIN canonical c USING (instrument_id, amount_minor, currency, direction)
  WHERE c.event_time BETWEEN o.event_time - INTERVAL 3 DAY AND o.event_time + INTERVAL 3 DAY)
"""
SCORES = PAIRS + """, timed AS (SELECT *, abs(date_diff('second', event_time, cand_time)) / 86400.0 AS d FROM pairs),
scores AS (SELECT obs_id, cand_id, round(greatest(0.0, least(1.0, coalesce(0.30 * jaro_winkler_similarity(lower(merchant_raw), lower(merchant_name)), 0.0)
  + CASE WHEN d <= 1 THEN 0.15 + 0.10 * (1 - d) WHEN d <= 3 THEN 0.10 * (1 - (d - 1) / 2.0) ELSE 0.0 END
  + CASE WHEN reference_id IS NULL OR cand_reference IS NULL THEN 0.0 WHEN reference_id = cand_reference THEN 0.25 WHEN contains(reference_id, cand_reference) OR contains(cand_reference, reference_id) THEN 0.10 ELSE -0.25 END
  + 0.15 + CASE WHEN (source_pipeline = 'statement' AND source_mix = 'email_only') OR (source_pipeline = 'email' AND source_mix = 'statement_only') THEN 0.05 ELSE 0.0 END)), 6) AS score FROM timed)
"""
DECISIONS = SCORES + """, ranked AS (SELECT *, row_number() OVER w AS place, lead(score) OVER w AS second FROM scores WHERE score >= 0.55 WINDOW w AS (PARTITION BY obs_id ORDER BY score DESC, cand_id)),
same AS (SELECT o.obs_id, c.cand_id AS exact_id, abs(date_diff('second', c.event_time, o.event_time)) AS off FROM observations o JOIN canonical c USING (instrument_id, amount_minor, currency, direction)
  WHERE date_trunc('minute', o.event_time) = date_trunc('minute', c.event_time) QUALIFY row_number() OVER (PARTITION BY o.obs_id ORDER BY c.event_time, c.cand_id) = 1),
exact AS (SELECT obs_id, exact_id FROM same WHERE off <= 120),
decisions AS (SELECT o.obs_id, CASE WHEN exact_id IS NOT NULL THEN 'exact' WHEN cand_id IS NULL THEN 'new' WHEN second IS NULL OR round(score - second, 6) > 0.15 THEN 'scored' ELSE 'ambiguous' END AS decision,
  coalesce(exact_id, CASE WHEN cand_id IS NOT NULL AND (second IS NULL OR round(score - second, 6) > 0.15) THEN cand_id END) AS cand_id, CASE WHEN exact_id IS NOT NULL THEN 1.0 ELSE score END AS score
  FROM observations o LEFT JOIN (SELECT * FROM ranked WHERE place = 1) r USING (obs_id) LEFT JOIN exact USING (obs_id))
"""


def scores(v: Views) -> DataFrame:
    return m.scored(m.candidates(v.observations, v.canonical))


def decisions(v: Views) -> DataFrame:
    return m.decided(v.observations, scores(v), m.exact_matches(v.observations, v.canonical))


@query("match_exact_key", "SELECT obs_id, min(cand_id) AS cand_id FROM observations o JOIN canonical c USING (instrument_id, amount_minor, currency, direction, reference_id) GROUP BY 1")
def match_exact_key(v: Views):
    return m.exact_key(v.observations, v.canonical)


@query("match_candidates", PAIRS + "SELECT obs_id, cand_id FROM pairs")
def match_candidates(v: Views):
    return m.candidates(v.observations, v.canonical).select("obs_id", "cand_id")


@query("match_scores", SCORES + "SELECT * FROM scores")
def match_scores(v: Views):
    return scores(v)


@query("reconcile_decisions", DECISIONS + "SELECT * FROM decisions")
def reconcile_decisions(v: Views):
    return decisions(v)


@query("ambiguity_clusters", DECISIONS + """SELECT obs_id, r.cand_id, r.score, CASE place WHEN 1 THEN 'candidate_a' WHEN 2 THEN 'candidate_b' ELSE 'other' END AS role,
CASE WHEN max(r.score) OVER (PARTITION BY obs_id) > 0.75 THEN 'close_scores' ELSE 'weak_evidence' END AS reason FROM ranked r JOIN (SELECT obs_id FROM decisions WHERE decision = 'ambiguous') USING (obs_id)""")
def ambiguity_clusters(v: Views):
    s = scores(v)
    return m.clusters(s, m.decided(v.observations, s, m.exact_matches(v.observations, v.canonical)))


@query("canonical_new", DECISIONS + """SELECT sha256(concat_ws('|', o.obs_id, 'canonical')) AS canonical_id, o.obs_id, instrument_id, amount_minor, coalesce(merchant_raw, 'Unknown') AS merchant, o.source_pipeline || '_only' AS source_mix
FROM observations o JOIN decisions d USING (obs_id) WHERE decision = 'new'""")
def canonical_new(v: Views):
    new = v.observations.join(decisions(v).filter("decision = 'new'").select("obs_id"), "obs_id", "left_semi")
    return new.select(m.fingerprint(F.col("obs_id"), F.lit("canonical")).alias("canonical_id"), "obs_id", "instrument_id", "amount_minor", F.coalesce("merchant_raw", F.lit("Unknown")).alias("merchant"), F.concat("source_pipeline", F.lit("_only")).alias("source_mix"))


@query("match_quality", DECISIONS + """SELECT count(*) AS observations, count(*) FILTER (decision IN ('exact', 'scored')) AS matched, count(*) FILTER (decision IN ('exact', 'scored') AND substr(cand_id, 2, length(obs_id) - 1) <> substr(obs_id, 2)) AS false_merges,
count(*) FILTER (decision = 'ambiguous') AS ambiguous, count(*) FILTER (decision = 'new') AS separate FROM decisions""")
def match_quality(v: Views):
    wrong = F.expr("substr(cand_id, 2, length(obs_id) - 1) <> substr(obs_id, 2)")
    return decisions(v).agg(F.count("*").alias("observations"), F.count_if(F.col("decision").isin("exact", "scored")).alias("matched"), F.count_if(F.col("decision").isin("exact", "scored") & wrong).alias("false_merges"),
                            F.count_if(F.col("decision") == "ambiguous").alias("ambiguous"), F.count_if(F.col("decision") == "new").alias("separate"))


@query("canonical_merge", """, r AS (SELECT o.*, o.merchant_raw AS merchant, c.cand_id, c.source_mix, c.reference_id AS old_reference, CASE WHEN c.order_id % 3 <> 0 THEN c.merchant_name END AS old_merchant, c.amount_minor - c.order_id % 2 AS old_amount
  FROM observations o JOIN canonical c USING (instrument_id, direction) WHERE c.event_time BETWEEN o.event_time - INTERVAL 30 DAY AND o.event_time + INTERVAL 30 DAY),
s AS (SELECT *, coalesce(bool_or(source_pipeline = 'statement') OVER b, false) AS stated, last_value(CASE WHEN source_pipeline = 'email' THEN confidence END IGNORE NULLS) OVER b AS before FROM r
  WINDOW b AS (PARTITION BY cand_id ORDER BY event_time, obs_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT *, source_pipeline = 'statement' OR (source_pipeline = 'email' AND source_mix = 'email_only' AND NOT stated AND coalesce(round(confidence - before, 6) > 0.15, false)) AS writes,
  source_pipeline = 'email' AND (source_mix <> 'email_only' OR stated) AS fills FROM s)
SELECT cand_id, coalesce(arg_max(reference_id, (event_time, obs_id)) FILTER (writes AND reference_id IS NOT NULL), any_value(old_reference), arg_min(reference_id, (event_time, obs_id)) FILTER (fills AND reference_id IS NOT NULL)) AS reference_id,
  coalesce(arg_max(merchant, (event_time, obs_id)) FILTER (writes AND merchant IS NOT NULL), any_value(old_merchant), arg_min(merchant, (event_time, obs_id)) FILTER (fills AND merchant IS NOT NULL)) AS merchant,
  coalesce(arg_max(amount_minor, (event_time, obs_id)) FILTER (source_pipeline = 'statement'), any_value(old_amount)) AS amount_minor, CAST(max(event_time) FILTER (source_pipeline = 'statement') AS DATE) AS posting_date,
  CASE WHEN any_value(source_mix) = 'email_only' AND bool_or(source_pipeline = 'statement') OR any_value(source_mix) = 'statement_only' AND bool_or(source_pipeline = 'email') THEN 'merged' ELSE any_value(source_mix) END AS source_mix FROM t GROUP BY 1""")
def canonical_merge(v: Views):
    # A wide net of thirty days, so that a ledger row has many observations.
    old = v.canonical.select("cand_id", "instrument_id", "direction", "source_mix", F.col("event_time").alias("cand_time"), F.col("reference_id").alias("old_reference_id"),
                             F.when(F.col("order_id") % 3 != 0, F.col("merchant_name")).alias("old_merchant"), (F.col("amount_minor") - F.col("order_id") % 2).alias("old_amount_minor"))
    rows = m.near_in_time(v.observations.withColumnRenamed("merchant_raw", "merchant"), old, ["instrument_id", "direction"], "event_time", "cand_time", 30)
    return m.merged(rows)


SIGHTINGS = """, s0 AS (SELECT obs_id, order_id % 2 = 0 AS linked, event_time, instrument_id, amount_minor, currency, direction FROM observations UNION ALL
  SELECT obs_id || 'd', false, event_time + to_seconds(order_id % 4 * 50), instrument_id, amount_minor, currency, direction FROM observations WHERE order_id % 6 = 0),
sightings AS (SELECT *, sha256(concat_ws('|', instrument_id, amount_minor, currency, direction, strftime(event_time, '%Y-%m-%d %H:%M'))) AS fingerprint FROM s0)
"""


def sightings(v: Views) -> DataFrame:
    base = v.observations.select("obs_id", (F.col("order_id") % 2 == 0).alias("linked"), "event_time", *m.KEYS, "order_id")
    again = base.filter(F.col("order_id") % 6 == 0).withColumns({"obs_id": F.concat("obs_id", F.lit("d")), "linked": F.lit(False), "event_time": F.timestamp_add("SECOND", (F.col("order_id") % 4 * 50).cast("int"), F.col("event_time"))})
    every = base.unionByName(again).drop("order_id")
    return every.withColumn("fingerprint", m.fingerprint(*map(F.col, m.KEYS), F.date_format("event_time", "yyyy-MM-dd HH:mm")))


@query("fingerprint_prefilter", SIGHTINGS + """, p AS (SELECT s.obs_id, o.obs_id AS other_id, s.event_time, o.event_time AS other_time FROM sightings s JOIN sightings o USING (fingerprint) WHERE o.linked AND o.obs_id <> s.obs_id)
SELECT obs_id, other_id, abs(date_diff('second', other_time, event_time)) <= 120 AS verified FROM p QUALIFY row_number() OVER (PARTITION BY obs_id ORDER BY other_time, other_id) = 1""")
def fingerprint_prefilter(v: Views):
    return m.fingerprint_matches(sightings(v))


@query("fingerprints", SIGHTINGS + "SELECT obs_id, fingerprint, sha256(trim(regexp_replace(regexp_replace(lower(obs_id || '  ' || amount_minor), '[0-9]+', '#', 'g'), '\\s+', ' ', 'g'))) AS template_hash FROM sightings")
def fingerprints(v: Views):
    template = F.trim(F.regexp_replace(F.regexp_replace(F.lower(F.concat("obs_id", F.lit("  "), F.col("amount_minor").cast("string"))), "[0-9]+", "#"), r"\s+", " "))
    return sightings(v).select("obs_id", "fingerprint", F.sha2(template.cast("binary"), 256).alias("template_hash"))


REFUNDS = """, debits AS (SELECT txn_id AS debit_id, instrument_id, amount_minor, best_event_time AS debit_time, order_id FROM live WHERE direction = 'debit'),
refunds AS (SELECT debit_id || '-r' AS refund_id, instrument_id, amount_minor, debit_time + to_days(CAST(order_id % 40 AS INT)) AS refund_time FROM debits WHERE order_id % 11 = 0)
"""


def debits(v: Views) -> DataFrame:
    return v.live.filter("direction = 'debit'").select(F.col("txn_id").alias("debit_id"), "instrument_id", "amount_minor", F.col("best_event_time").alias("debit_time"), "order_id")


def refunds(v: Views) -> DataFrame:
    return debits(v).filter(F.col("order_id") % 11 == 0).select(F.concat("debit_id", F.lit("-r")).alias("refund_id"), "instrument_id", "amount_minor", F.timestamp_add("DAY", (F.col("order_id") % 40).cast("int"), F.col("debit_time")).alias("refund_time"))


@query("refund_link", REFUNDS + """SELECT refund_id, debit_id FROM refunds r JOIN debits d USING (instrument_id, amount_minor) WHERE debit_time BETWEEN refund_time - INTERVAL 30 DAY AND refund_time
QUALIFY row_number() OVER (PARTITION BY refund_id ORDER BY debit_time DESC, debit_id) = 1""")
def refund_link(v: Views):
    return m.as_of(refunds(v), debits(v), ["instrument_id", "amount_minor"], "refund_id", "refund_time", "debit_id", "debit_time", 30).select("refund_id", "debit_id")


@query("refund_parent_partial", """, c AS (SELECT txn_id, instrument_id, amount_minor, best_event_time FROM live WHERE direction = 'credit'), d AS (SELECT txn_id AS debit_id, instrument_id, amount_minor AS debit_minor, best_event_time AS debit_time FROM live WHERE direction = 'debit')
SELECT txn_id, debit_id FROM c JOIN d USING (instrument_id) WHERE debit_minor >= amount_minor AND debit_time BETWEEN best_event_time - INTERVAL 30 DAY AND best_event_time QUALIFY row_number() OVER (PARTITION BY txn_id ORDER BY debit_time DESC, debit_id) = 1""")
def refund_parent_partial(v: Views):
    credits = v.live.filter("direction = 'credit'").select("txn_id", "instrument_id", "amount_minor", "best_event_time")
    right = debits(v).select("debit_id", "instrument_id", F.col("amount_minor").alias("debit_minor"), "debit_time")
    return m.as_of(credits, right, ["instrument_id"], "txn_id", "best_event_time", "debit_id", "debit_time", 30, F.col("debit_minor") >= F.col("amount_minor")).select("txn_id", "debit_id")


@query("crossref_unique", """, p AS (SELECT o.obs_id, c.cand_id FROM observations o JOIN canonical c USING (instrument_id) WHERE c.event_time BETWEEN o.event_time - INTERVAL 3 DAY AND o.event_time + INTERVAL 3 DAY
  AND (coalesce(contains(c.reference_id, o.reference_id), false) OR c.amount_minor = o.amount_minor))
SELECT obs_id, min(cand_id) AS cand_id FROM p GROUP BY 1 HAVING count(*) = 1""")
def crossref_unique(v: Views):
    right = v.canonical.select("cand_id", "instrument_id", F.col("event_time").alias("cand_time"), F.col("reference_id").alias("cand_ref"), F.col("amount_minor").alias("cand_minor"))
    agrees = F.coalesce(F.col("cand_ref").contains(F.col("reference_id")), F.lit(False)) | (F.col("cand_minor") == F.col("amount_minor"))
    pairs = m.near_in_time(v.observations, right, ["instrument_id"], "event_time", "cand_time", 3).filter(agrees)
    return pairs.groupBy("obs_id").agg(F.min("cand_id").alias("cand_id"), F.count("*").alias("n")).filter("n = 1").drop("n")


@query("cluster_overlap", """SELECT obs_id, min(cluster_id) AS cluster_id FROM observations o JOIN canonical c USING (instrument_id, amount_minor, direction) JOIN open_clusters k ON k.cluster_id = c.order_id
WHERE c.event_time BETWEEN o.event_time - INTERVAL 3 DAY AND o.event_time + INTERVAL 3 DAY GROUP BY 1""")
def cluster_overlap(v: Views):
    members = v.canonical.join(v.open_clusters.select(F.col("cluster_id").alias("order_id")), "order_id", "left_semi").select(F.col("order_id").alias("cluster_id"), "instrument_id", "amount_minor", "direction", F.col("event_time").alias("member_time"))
    pairs = v.observations.join(members, ["instrument_id", "amount_minor", "direction"]).filter(m.within("event_time", "member_time", 3))
    return pairs.groupBy("obs_id").agg(F.min("cluster_id").alias("cluster_id"))


MEMBERS = """, members AS (SELECT k.cluster_id, l.txn_id, CASE WHEN l.line_no % 3 = 0 THEN NULL ELSE l.instrument_id END AS txn_instrument, o.instrument_id AS obs_instrument, l.amount_minor, l.direction, l.best_event_time, l.category_id,
  (l.amount_minor % 100) / 100.0 AS score FROM clusters k JOIN ledger l ON l.order_id = k.cluster_id LEFT JOIN observations o ON o.order_id = k.cluster_id)
"""


def members(v: Views) -> DataFrame:
    rows = v.clusters.select("cluster_id").join(v.ledger, F.col("order_id") == F.col("cluster_id"))
    joined = rows.join(v.observations.select(F.col("order_id").alias("cluster_id"), F.col("instrument_id").alias("obs_instrument")), "cluster_id", "left")
    return joined.select("cluster_id", "txn_id", F.when(F.col("line_no") % 3 != 0, F.col("instrument_id")).alias("txn_instrument"), "obs_instrument", "amount_minor", "direction", "best_event_time", "category_id", (F.col("amount_minor") % 100 / 100.0).alias("score"))


@query("cluster_members", MEMBERS + "SELECT cluster_id, txn_id, i.name AS instrument_name FROM members m LEFT JOIN instruments i ON i.instrument_id = coalesce(txn_instrument, obs_instrument)")
def cluster_members(v: Views):
    keyed = members(v).withColumn("instrument_id", F.coalesce("txn_instrument", "obs_instrument"))
    return keyed.join(v.instruments.select("instrument_id", F.col("name").alias("instrument_name")), "instrument_id", "left").select("cluster_id", "txn_id", "instrument_name")


@query("cluster_explanations", MEMBERS + """, r AS (SELECT cluster_id, list(score ORDER BY score DESC) AS s FROM members GROUP BY 1)
SELECT cluster_id, CASE WHEN len(s) < 2 THEN 'single candidate' ELSE 'top scores ' || CAST(round(s[1] * 100) AS INT) || ' and ' || CAST(round(s[2] * 100) AS INT) || ' differ by ' || CAST(round((s[1] - s[2]) * 100) AS INT) END AS explanation FROM r""")
def cluster_explanations(v: Views):
    top = members(v).groupBy("cluster_id").agg(F.sort_array(F.collect_list("score"), False).alias("s"))  # a cluster has a few members
    whole = lambda c: F.round(c * 100).cast("int")
    text = F.format_string("top scores %d and %d differ by %d", whole(F.get("s", F.lit(0))), whole(F.get("s", F.lit(1))), whole(F.get("s", F.lit(0)) - F.get("s", F.lit(1))))
    return top.select("cluster_id", F.when(F.size("s") < 2, "single candidate").otherwise(text).alias("explanation"))


@query("cluster_diff", MEMBERS + """, f AS (SELECT *, first_value(amount_minor) OVER w AS a, first_value(direction) OVER w AS d, first_value(category_id) OVER w AS c, first_value(CAST(best_event_time AS DATE)) OVER w AS t FROM members WINDOW w AS (PARTITION BY cluster_id ORDER BY txn_id))
SELECT cluster_id, txn_id, array_to_string(list_filter([CASE WHEN amount_minor <> a THEN 'amount' END, CASE WHEN direction <> d THEN 'direction' END, CASE WHEN category_id <> c THEN 'category' END, CASE WHEN CAST(best_event_time AS DATE) <> t THEN 'date' END], lambda x: x IS NOT NULL), ',') AS differs FROM f""")
def cluster_diff(v: Views):
    w = Window.partitionBy("cluster_id").orderBy("txn_id")
    fields = {"amount": F.col("amount_minor"), "direction": F.col("direction"), "category": F.col("category_id"), "date": F.col("best_event_time").cast("date")}
    flagged = members(v).select("cluster_id", "txn_id", *(F.when(c != F.first(c).over(w), name).alias(name) for name, c in fields.items()))
    return flagged.select("cluster_id", "txn_id", F.array_join(F.array_compact(F.array(*fields)), ",").alias("differs"))


@query("cluster_resolution", """, acts AS (SELECT cluster_id, ['confirm', 'reject', 'keep_separate', 'mark_unresolved', 'reopen'][cluster_id % 5 + 1] AS action FROM clusters WHERE cluster_id % 3 = 0)
SELECT cluster_id, coalesce(CASE WHEN action = 'reopen' THEN 'open' WHEN k.status = 'open' OR k.status = 'deferred' THEN CASE action WHEN 'confirm' THEN 'confirmed' WHEN 'reject' THEN 'rejected' WHEN 'keep_separate' THEN 'separate' WHEN 'mark_unresolved' THEN 'deferred' END END, k.status) AS status,
CASE WHEN action IS NOT NULL AND (action = 'reopen' OR k.status IN ('open', 'deferred')) THEN action END AS decision FROM clusters k LEFT JOIN acts USING (cluster_id)""")
def cluster_resolution(v: Views):
    actions = v.clusters.filter(F.col("cluster_id") % 3 == 0).select("cluster_id", F.element_at(F.array(*map(F.lit, ("confirm", "reject", "keep_separate", "mark_unresolved", "reopen"))), (F.col("cluster_id") % 5 + 1).cast("int")).alias("action"))
    pending, action = F.col("status").isin("open", "deferred"), F.col("action")
    to = F.when(action == "confirm", "confirmed").when(action == "reject", "rejected").when(action == "keep_separate", "separate").when(action == "mark_unresolved", "deferred")
    joined = v.clusters.join(actions, "cluster_id", "left")
    return joined.select("cluster_id", F.coalesce(F.when(action == "reopen", "open").when(pending, to), "status").alias("status"), F.when((action == "reopen") | pending, action).alias("decision"))


@query("unresolved_clusters", "SELECT cluster_id, status FROM clusters WHERE status IN ('open', 'deferred')")
def unresolved_clusters(v: Views):
    return v.clusters.filter(F.col("status").isin("open", "deferred")).select("cluster_id", "status")


ALIASES = """, aliases AS (SELECT merchant_id, upper(replace(name, '#', ' ')) AS alias FROM merchants WHERE merchant_id % 2 = 0), raws AS (SELECT DISTINCT merchant_id AS true_id, CASE merchant_id % 3 WHEN 0 THEN 'Supplier ' || substr(name, 10) WHEN 1 THEN name ELSE name || 'x' END AS raw FROM merchants)
"""


def aliases(v: Views) -> DataFrame:
    return v.merchants.filter(F.col("merchant_id") % 2 == 0).select("merchant_id", F.upper(F.replace("name", F.lit("#"), F.lit(" "))).alias("alias"))


def raws(v: Views) -> DataFrame:
    k = F.col("merchant_id") % 3
    return v.merchants.select(F.col("merchant_id").alias("true_id"), F.when(k == 0, F.concat(F.lit("Supplier "), F.expr("substr(name, 10)"))).when(k == 1, F.col("name")).otherwise(F.concat("name", F.lit("x"))).alias("raw"))


@query("merchant_alias", ALIASES + "SELECT raw, a.merchant_id FROM raws r JOIN aliases a ON upper(raw) = alias")
def merchant_alias(v: Views):
    return raws(v).join(aliases(v), F.upper("raw") == F.col("alias")).select("raw", "merchant_id")


FUZZY = """, names AS (SELECT DISTINCT p_name AS name FROM part), noisy AS (SELECT DISTINCT CASE p_partkey % 4 WHEN 0 THEN upper(p_name) WHEN 1 THEN p_name || 's' WHEN 2 THEN replace(p_name, 'i', 'l') ELSE p_brand || p_name END AS raw FROM part),
fuzzy AS (SELECT raw, name, score FROM (SELECT raw, name, round(jaro_winkler_similarity(lower(raw), lower(name)), 6) AS score FROM noisy, names) WHERE score >= 0.92 QUALIFY row_number() OVER (PARTITION BY raw ORDER BY score DESC, name) = 1)
"""


def fuzzy(v: Views) -> DataFrame:
    part, k = v.table("part"), F.col("p_partkey") % 4
    noisy = part.select(F.when(k == 0, F.upper("p_name")).when(k == 1, F.concat("p_name", F.lit("s"))).when(k == 2, F.replace("p_name", F.lit("i"), F.lit("l"))).otherwise(F.concat("p_brand", "p_name")).alias("raw")).distinct()
    return m.fuzzy_merchants(noisy, part.select(F.col("p_name").alias("name")))


@query("merchant_fuzzy", FUZZY + "SELECT * FROM fuzzy")
def merchant_fuzzy(v: Views):
    return fuzzy(v)


@query("merchant_resolve", ALIASES + """, f AS (SELECT raw, name, score FROM (SELECT raw, name, round(jaro_winkler_similarity(lower(raw), lower(name)), 6) AS score FROM raws, merchants) WHERE score >= 0.985 QUALIFY row_number() OVER (PARTITION BY raw ORDER BY score DESC, name) = 1)
SELECT r.raw, CASE WHEN alias IS NOT NULL THEN 'alias' WHEN f.name IS NOT NULL THEN 'fuzzy' WHEN length(regexp_replace(r.raw, '[^A-Za-z0-9]', '', 'g')) >= 3 THEN 'create' ELSE 'none' END AS how, coalesce(CAST(a.merchant_id AS VARCHAR), f.name, sha256(upper(r.raw))) AS merchant
FROM raws r LEFT JOIN aliases a ON upper(r.raw) = alias LEFT JOIN f ON f.raw = r.raw""")
def merchant_resolve(v: Views):
    found = raws(v).select("raw").join(aliases(v), F.upper("raw") == F.col("alias"), "left")
    close = m.fuzzy_merchants(raws(v), v.merchants, 0.985).select("raw", "name")
    plausible = F.length(F.regexp_replace("raw", "[^A-Za-z0-9]", "")) >= 3
    return found.join(close, "raw", "left").select("raw", F.when(F.col("alias").isNotNull(), "alias").when(F.col("name").isNotNull(), "fuzzy").when(plausible, "create").otherwise("none").alias("how"),
                                                  F.coalesce(F.col("merchant_id").cast("string"), "name", F.sha2(F.upper("raw").cast("binary"), 256)).alias("merchant"))


@query("instrument_resolve", """, seen AS (SELECT DISTINCT lower(issuer_name) AS issuer, masked_identifier AS mask FROM instruments WHERE instrument_id % 2 = 0 UNION SELECT DISTINCT lower(issuer_name), lpad(CAST((instrument_id + 7) % 10000 AS VARCHAR), 4, '0') FROM instruments WHERE instrument_id % 5 = 0),
one AS (SELECT lower(issuer_name) AS issuer, masked_identifier AS mask, CASE WHEN count(*) = 1 THEN min(instrument_id) END AS instrument_id, count(*) AS n FROM instruments GROUP BY 1, 2)
SELECT issuer, mask, one.instrument_id, CASE WHEN n IS NULL THEN sha256(concat_ws('|', issuer, mask)) END AS new_id FROM seen LEFT JOIN one USING (issuer, mask)""")
def instrument_resolve(v: Views):
    issuer = F.lower("issuer_name").alias("issuer")
    seen = v.instruments.filter(F.col("instrument_id") % 2 == 0).select(issuer, F.col("masked_identifier").alias("mask")).union(
        v.instruments.filter(F.col("instrument_id") % 5 == 0).select(issuer, F.lpad(((F.col("instrument_id") + 7) % 10000).cast("string"), 4, "0"))).distinct()
    one = v.instruments.groupBy(issuer, F.col("masked_identifier").alias("mask")).agg(F.count("*").alias("n"), F.min("instrument_id").alias("i"))
    joined = seen.join(one, ["issuer", "mask"], "left")
    return joined.select("issuer", "mask", F.when(F.col("n") == 1, F.col("i")).alias("instrument_id"), F.when(F.col("n").isNull(), m.fingerprint(F.col("issuer"), F.col("mask"))).alias("new_id"))


@query("missing_data_alerts", """, wm AS (SELECT issuer_name, max(best_event_time) AS mark FROM live JOIN instruments USING (instrument_id) WHERE CAST(substr(issuer_name, 5) AS INT) % 3 <> 0 AND best_event_time < TIMESTAMP '2001-03-01' GROUP BY 1),
sent AS (SELECT cluster_id FROM clusters WHERE cluster_id % 4 = 0)
SELECT c.cluster_id, i.issuer_name FROM open_clusters c JOIN observations o ON o.order_id = c.cluster_id JOIN instruments i USING (instrument_id) LEFT JOIN wm USING (issuer_name)
WHERE (mark IS NULL OR mark < o.event_time) AND NOT EXISTS (SELECT 1 FROM sent s WHERE s.cluster_id = c.cluster_id)""")
def missing_data_alerts(v: Views):
    banks = v.instruments.select("instrument_id", "issuer_name")
    marks = v.live.filter(F.col("best_event_time") < F.lit("2001-03-01").cast("timestamp_ntz")).join(banks, "instrument_id").filter(F.expr("CAST(substr(issuer_name, 5) AS INT) % 3 <> 0")).groupBy("issuer_name").agg(F.max("best_event_time").alias("mark"))
    sent = v.clusters.filter(F.col("cluster_id") % 4 == 0).select("cluster_id")
    waiting = v.open_clusters.select("cluster_id").join(sent, "cluster_id", "left_anti").join(v.observations.select(F.col("order_id").alias("cluster_id"), "instrument_id", "event_time"), "cluster_id").join(banks, "instrument_id")
    return waiting.join(marks, "issuer_name", "left").filter(F.col("mark").isNull() | (F.col("mark") < F.col("event_time"))).select("cluster_id", "issuer_name")


@query("emi_groups", """, e AS (SELECT merchant_id * 1000 + instrument_id % 1000 AS group_id, txn_id, amount_minor, best_event_time, amount_minor * 6 AS original_minor FROM live),
g AS (SELECT *, first_value(txn_id) OVER w AS parent, first_value(txn_id) OVER (PARTITION BY group_id ORDER BY best_event_time DESC, txn_id DESC) AS last FROM e WINDOW w AS (PARTITION BY group_id ORDER BY best_event_time, txn_id))
SELECT group_id, count(*) AS installments, CAST(sum(amount_minor) AS BIGINT) AS paid_minor, max(original_minor) AS original_minor, min(parent) AS parent, min(last) AS latest FROM g GROUP BY 1 HAVING count(*) > 1""")
def emi_groups(v: Views):
    rows = v.live.select((F.col("merchant_id") * 1000 + F.col("instrument_id") % 1000).alias("group_id"), "txn_id", "amount_minor", "best_event_time")
    order = F.struct("best_event_time", "txn_id")
    grouped = rows.groupBy("group_id").agg(
        F.count("*").alias("installments"), F.sum("amount_minor").alias("paid_minor"), F.max(F.col("amount_minor") * 6).alias("original_minor"), F.min_by("txn_id", order).alias("parent"), F.max_by("txn_id", order).alias("latest"))
    return grouped.filter("installments > 1")


@query("keyword_category", """SELECT p_partkey, CASE WHEN contains(lower(p_name), 'ring') THEN 'jewellery' WHEN contains(lower(p_name), 'bolt') OR contains(lower(p_name), 'gear') THEN 'hardware' WHEN contains(lower(p_name), 'widget') THEN 'gadgets' ELSE 'others' END AS category FROM part""")
def keyword_category(v: Views):
    has = lambda w: F.lower("p_name").contains(w)
    return v.table("part").select("p_partkey", F.when(has("ring"), "jewellery").when(has("bolt") | has("gear"), "hardware").when(has("widget"), "gadgets").otherwise("others").alias("category"))


@query("observation_provenance", "SELECT c.cand_id, o.obs_id, o.source_pipeline, row_number() OVER (PARTITION BY c.cand_id ORDER BY o.event_time, o.obs_id) AS place FROM canonical c JOIN observations o USING (order_id)")
def observation_provenance(v: Views):
    joined = v.canonical.select("cand_id", "order_id").join(v.observations, "order_id")
    return joined.select("cand_id", "obs_id", "source_pipeline", F.row_number().over(Window.partitionBy("cand_id").orderBy("event_time", "obs_id")).alias("place"))


@query("observations_normalized", """SELECT obs_id, instrument_id, abs(amount_minor) AS amount_minor, CASE WHEN direction IN ('credit', 'debit') THEN direction ELSE 'debit' END AS direction, coalesce(event_time, $now) AS event_time, coalesce(upper(trim(merchant_raw)), 'UNKNOWN') AS merchant, least(1.0, greatest(0.0, confidence)) AS confidence FROM observations""")
def observations_normalized(v: Views):
    from ledgerloom.views import NOW, ts

    return v.observations.select("obs_id", "instrument_id", F.abs("amount_minor").alias("amount_minor"), F.when(F.col("direction").isin("credit", "debit"), F.col("direction")).otherwise("debit").alias("direction"),
                                 F.coalesce("event_time", ts(NOW)).alias("event_time"), F.coalesce(F.upper(F.trim("merchant_raw")), F.lit("UNKNOWN")).alias("merchant"), F.least(F.lit(1.0), F.greatest(F.lit(0.0), "confidence")).alias("confidence"))


@query("cluster_growth", """, s AS (SELECT obs_id, instrument_id, order_id % 3 AS amount_minor, direction, event_time FROM observations),
g AS (SELECT *, CASE WHEN event_time <= lag(event_time) OVER w + INTERVAL 3 DAY THEN 0 ELSE 1 END AS fresh FROM s WINDOW w AS (PARTITION BY instrument_id, amount_minor, direction ORDER BY event_time, obs_id)),
n AS (SELECT *, sum(fresh) OVER (PARTITION BY instrument_id, amount_minor, direction ORDER BY event_time, obs_id ROWS UNBOUNDED PRECEDING) AS c FROM g)
SELECT obs_id, min(obs_id) OVER (PARTITION BY instrument_id, amount_minor, direction, c) AS first_id, count(*) OVER (PARTITION BY instrument_id, amount_minor, direction, c) AS n_members FROM n""")
def cluster_growth(v: Views):
    """Clusters of all observations, grown in three batches."""
    rows = v.observations.select("obs_id", "instrument_id", (F.col("order_id") % 3).alias("amount_minor"), "direction", "event_time", "order_id")
    members = v.spark.createDataFrame([], rows.select(F.lit("").alias("cluster_id"), *clusters.MEMBER[1:]).schema)
    for batch in range(3):
        members = clusters.grow(members, rows.filter(F.col("order_id") * 5 % 7 % 3 == batch).drop("order_id"), sparing=False)
        if batch < 2:
            path = shared_path(v.spark, "clusters")
            members.write.option("compression", "zstd").parquet(path)
            members = v.spark.read.parquet(path)
    whole = Window.partitionBy(F.unhex("cluster_id"))
    return members.select("obs_id", F.min("obs_id").over(whole).alias("first_id"), F.count("*").over(whole).alias("n_members"))


@query("post_processed", REFUNDS + """, link AS (SELECT refund_id, debit_id FROM refunds r JOIN debits d USING (instrument_id, amount_minor) WHERE debit_time BETWEEN refund_time - INTERVAL 30 DAY AND refund_time QUALIFY row_number() OVER (PARTITION BY refund_id ORDER BY debit_time DESC, debit_id) = 1)
SELECT debit_id AS txn_id, NULL AS parent_id, NULL AS subtype, CASE WHEN debit_id IN (SELECT debit_id FROM link) THEN 'refunded' ELSE 'posted' END AS status, ['UBER INDIA', 'CORNER SHOP', 'SWIGGY LIMITED', NULL, NULL][order_id % 5 + 1] AS merchant, ['transport', 'own', 'food', 'own', 'own'][order_id % 5 + 1] AS category_id FROM debits
UNION ALL SELECT r.refund_id, l.debit_id, CASE WHEN l.debit_id IS NOT NULL THEN 'refund' END, 'posted', NULL, 'own' FROM refunds r LEFT JOIN link l USING (refund_id)""")
def post_processed(v: Views):
    """Debits and refunds through the whole chain."""
    names = F.array(*map(F.lit, ["Uber India 12345", "Corner Shop", "RAZ*SWIGGY LIMITED", "for your card", None]))
    raw = F.get(names, (F.col("order_id") % 5).cast("int"))
    own = debits(v).select(F.col("debit_id").alias("txn_id"), "instrument_id", F.lit("debit").alias("direction"), "amount_minor", F.col("debit_time").alias("best_event_time"), raw.alias("merchant_raw"))
    back = refunds(v).select(F.col("refund_id").alias("txn_id"), "instrument_id", F.lit("credit").alias("direction"), "amount_minor", F.col("refund_time").alias("best_event_time"), F.lit("Amazon").alias("merchant_raw"))
    rows = own.unionByName(back).select("*", F.lit("own").alias("category_id"), F.lit("posted").alias("status"), F.lit(None).cast("string").alias("parent_id"), F.lit(None).cast("int").alias("installments"), F.lit(None).cast("long").alias("original_minor"))
    return post.post_process(rows).drop("group_id")
