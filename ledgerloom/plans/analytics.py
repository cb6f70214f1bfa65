"""Dashboard and trend queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerloom.operators import dashboard as d
from ledgerloom.operators import tables as t
from ledgerloom.plans.registry import query
from ledgerloom.views import EVENTS_NOW, NOW, Views, ts

LIMIT = 30_000_000_00


def bills(v: Views):
    """A bill for each second order."""
    k = F.col("o_orderkey")
    return v.table("orders").filter(k % 2 == 0).select(
        k.alias("bill_id"), F.col("o_custkey").alias("instrument_id"), F.timestamp_add("DAY", (k % 20).cast("int"), F.col("o_orderdate")).alias("due_date"), F.round(F.col("o_totalprice") * 100).cast("long").alias("amount_minor"))


BILLS = """, bills AS (SELECT o_orderkey AS bill_id, o_custkey AS instrument_id, o_orderdate + to_days(CAST(o_orderkey % 20 AS INT)) AS due_date, CAST(round(o_totalprice * 100) AS BIGINT) AS amount_minor FROM orders WHERE o_orderkey % 2 = 0)
"""

_MTD = "best_event_time BETWEEN date_trunc('month', $now) AND $now"
_TOTAL = "SELECT CAST(coalesce(sum(amount_minor), 0) AS BIGINT) AS total_minor, coalesce(sum(amount_minor), 0) / 100.0 AS total FROM counted WHERE direction = '{}' AND " + _MTD


@query("mtd_spend", _TOTAL.format("debit"))
def mtd_spend(v: Views):
    return d.directed_total(v.counted, NOW, "debit")


@query("mtd_income", _TOTAL.format("credit"))
def mtd_income(v: Views):
    return d.directed_total(v.counted, NOW, "credit")


@query("mtd_count", f"SELECT count(*) AS txn_count FROM counted WHERE {_MTD}")
def mtd_count(v: Views):
    return v.counted.filter(d.month_to_date(NOW)).agg(F.count("*").alias("txn_count"))


@query("dashboard_summary", BILLS + f""", m AS (SELECT CAST(coalesce(sum(amount_minor) FILTER (direction = 'debit'), 0) AS BIGINT) AS spend_minor, CAST(coalesce(sum(amount_minor) FILTER (direction = 'credit'), 0) AS BIGINT) AS income_minor, count(*) AS txn_count FROM counted WHERE {_MTD})
SELECT *, CAST({LIMIT} AS BIGINT) AS limit_minor, spend_minor * 100.0 / {LIMIT} AS utilization_pct, (SELECT count(*) FROM bills WHERE due_date >= $now) AS upcoming_bills FROM m""")
def dashboard_summary(v: Views):
    return d.summary(v.counted, bills(v), NOW, LIMIT)


@query("category_spend_month", """, s AS (SELECT category_id, sum(amount_minor) AS s FROM counted WHERE direction = 'debit' AND best_event_time >= TIMESTAMP '2001-05-01' AND best_event_time < TIMESTAMP '2001-06-01' GROUP BY 1)
SELECT c.category_id, budget_minor, CAST(coalesce(s, 0) AS BIGINT) AS spend_minor, CASE WHEN budget_minor > 0 THEN coalesce(s, 0) * 100.0 / budget_minor ELSE 0.0 END AS utilization_pct FROM categories c LEFT JOIN s USING (category_id)""")
def category_spend_month(v: Views):
    return d.category_spend(v.categories, v.counted_by_category, "2001-05-01")


def _trend(period: str, days: int) -> str:
    return f"SELECT {period} AS period, CAST(sum(amount_minor) AS BIGINT) AS spend_minor, count(*) AS txn_count FROM counted WHERE direction = 'debit' AND best_event_time BETWEEN $now - INTERVAL {days} DAY AND $now GROUP BY 1"


@query("spend_trend_daily", _trend("strftime(best_event_time, '%Y-%m-%d')", 30))
def spend_trend_daily(v: Views):
    return d.spend_trend(v.counted, NOW, 30, F.date_format("best_event_time", "yyyy-MM-dd"))


@query("spend_trend_weekly", _trend("strftime(best_event_time, '%Y-%W')", 84))
def spend_trend_weekly(v: Views):
    return d.spend_trend(v.counted, NOW, 84, F.concat(F.date_format("best_event_time", "yyyy-"), d.week_of_year("best_event_time")))


@query("spend_trend_monthly", _trend("strftime(best_event_time, '%Y-%m')", 365))
def spend_trend_monthly(v: Views):
    return d.spend_trend(v.counted, NOW, 365, F.date_format("best_event_time", "yyyy-MM"))


@query("top_merchants", f"""SELECT merchant_id, spend_minor, txn_count, name FROM (SELECT merchant_id, CAST(sum(amount_minor) AS BIGINT) AS spend_minor, count(*) AS txn_count FROM counted WHERE direction = 'debit' AND {_MTD} GROUP BY 1)
JOIN merchants USING (merchant_id) ORDER BY spend_minor DESC, name LIMIT 10""")
def top_merchants(v: Views):
    return d.top_merchants(v.counted, v.merchants.select("merchant_id", "name"), NOW)


@query("pending_review", """, m AS (SELECT l.* FROM ledger l JOIN open_clusters c ON c.cluster_id = l.order_id), u AS (SELECT * FROM ledger WHERE extraction_method = 'llm' AND is_deleted)
SELECT (SELECT count(DISTINCT txn_id) FROM m) + (SELECT count(*) FROM u) AS pending, CAST((SELECT coalesce(sum(amount_minor), 0) FROM m) + (SELECT coalesce(sum(amount_minor), 0) FROM u) AS BIGINT) AS pending_minor""")
def pending_review(v: Views):
    return d.pending_review(v.open_clusters, v.payments, v.payments.filter((F.col("extraction_method") == "llm") & F.col("is_deleted")))


BALANCES = """, net AS (SELECT instrument_id, sum(CASE WHEN direction = 'debit' THEN -amount_minor ELSE amount_minor END) AS net FROM live GROUP BY 1),
bal AS (SELECT i.instrument_id, type, limit_minor, stored_balance_minor, CAST(CASE WHEN type = 'credit_card' THEN -coalesce(net, 0) ELSE coalesce(net, 0) END AS BIGINT) AS computed_minor FROM instruments i LEFT JOIN net USING (instrument_id)),
balances AS (SELECT instrument_id, type, limit_minor, computed_minor, coalesce(stored_balance_minor, CASE WHEN type = 'credit_card' OR computed_minor > 0 THEN computed_minor ELSE 0 END) AS balance_minor FROM bal)
"""


@query("instrument_balances", BALANCES + "SELECT instrument_id, type, computed_minor, balance_minor FROM balances")
def instrument_balances(v: Views):
    return d.balances(v.instruments, v.live)


@query("portfolio_totals", BALANCES + """SELECT CAST(coalesce(sum(balance_minor) FILTER (type <> 'credit_card'), 0) AS BIGINT) AS cash_minor, CAST(coalesce(sum(abs(balance_minor)) FILTER (type = 'credit_card'), 0) AS BIGINT) AS credit_used_minor,
CAST(coalesce(sum(limit_minor) FILTER (type = 'credit_card'), 0) AS BIGINT) AS credit_limit_minor FROM balances""")
def portfolio_totals(v: Views):
    return d.portfolio(d.balances(v.instruments, v.live), v.instruments)


@query("topk_other", """, s AS (SELECT category_id, sum(amount_minor) AS spend_minor FROM counted WHERE direction = 'debit' GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY spend_minor DESC, category_id) AS p FROM s)
SELECT CASE WHEN p <= 6 THEN category_id ELSE 'Other' END AS category_id, CAST(sum(spend_minor) AS BIGINT) AS spend_minor FROM r GROUP BY 1""")
def topk_other(v: Views):
    spent = v.counted_by_category.filter(F.col("direction") == "debit").groupBy("category_id").agg(F.sum("amount_minor").alias("spend_minor"))
    return d.top_k_and_other(spent, "category_id", "spend_minor", 6)


@query("instrument_flow", """, r AS (SELECT *, row_number() OVER (PARTITION BY instrument_id ORDER BY abs(amount_minor) DESC, txn_id) AS p FROM live)
SELECT instrument_id, CAST(coalesce(sum(amount_minor) FILTER (direction = 'credit'), 0) AS BIGINT) AS inflow_minor, CAST(coalesce(sum(amount_minor) FILTER (direction = 'debit'), 0) AS BIGINT) AS outflow_minor, avg(amount_minor) AS avg_minor,
string_agg(CAST(amount_minor AS VARCHAR), ',' ORDER BY p) FILTER (p <= 5) AS top_amounts FROM r GROUP BY 1""")
def instrument_flow(v: Views):
    return d.instrument_flow(v.live)


@query("mom_delta", """, m AS (SELECT strftime(best_event_time, '%Y-%m') AS period, CAST(sum(amount_minor) AS BIGINT) AS spend_minor FROM counted WHERE direction = 'debit' GROUP BY 1), l AS (SELECT *, lag(spend_minor) OVER (ORDER BY period) AS b FROM m)
SELECT period, spend_minor, CASE WHEN b > 0 THEN (spend_minor - b) * 100.0 / b END AS delta_pct FROM l ORDER BY period DESC LIMIT 1""")
def mom_delta(v: Views):
    return d.month_over_month(v.counted)


@query("extraction_distribution", "SELECT coalesce(extraction_method, 'unknown') AS extraction_method, count(*) AS n FROM live GROUP BY 1")
def extraction_distribution(v: Views):
    return d.group_counts(v.live, "extraction_method")


@query("decision_distribution", "SELECT coalesce(CASE WHEN reference_id IS NOT NULL THEN status END, 'unknown') AS decision, count(*) AS n FROM live GROUP BY 1")
def decision_distribution(v: Views):
    return d.group_counts(v.live.withColumn("decision", F.when(F.col("reference_id").isNotNull(), F.col("status"))), "decision")


@query("ratio_metrics", """SELECT avg(CASE WHEN extraction_method = 'llm' THEN 1.0 ELSE 0.0 END) AS llm_rate,
  count(*) FILTER (reference_id IS NULL AND best_event_time BETWEEN $now - INTERVAL 30 DAY AND $now) / nullif(count(*) FILTER (best_event_time BETWEEN $now - INTERVAL 30 DAY AND $now), 0) AS failure_rate_30d FROM live""")
def ratio_metrics(v: Views):
    recent = F.col("best_event_time").between(F.timestamp_add("DAY", F.lit(-30), ts(NOW)), ts(NOW))
    return v.live.agg(
        F.avg(F.when(F.col("extraction_method") == "llm", 1.0).otherwise(0.0)).alias("llm_rate"),
        F.try_divide(F.count_if(F.col("reference_id").isNull() & recent), F.count_if(recent)).alias("failure_rate_30d"))


@query("merchant_spike", """SELECT txn_id, merchant_id, amount_minor, round(a, 4) AS trailing_avg FROM (SELECT *, avg(amount_minor) OVER (PARTITION BY merchant_id ORDER BY best_event_time RANGE BETWEEN INTERVAL 30 DAY PRECEDING AND INTERVAL 1 MICROSECOND PRECEDING) AS a FROM counted WHERE direction = 'debit') WHERE amount_minor > 3.0 * a""")
def merchant_spike(v: Views):
    return d.merchant_spikes(v.counted)


@query("budget_alerts", """, r AS (SELECT instrument_id, strftime(best_event_time, '%Y-%m') AS month, txn_id, amount_minor, sum(amount_minor) OVER (PARTITION BY instrument_id, strftime(best_event_time, '%Y-%m') ORDER BY best_event_time, txn_id ROWS UNBOUNDED PRECEDING) AS a FROM counted WHERE direction = 'debit')
SELECT instrument_id, month, level, txn_id, CAST(a AS BIGINT) AS spend_minor FROM r, (SELECT unnest([80, 90, 100]) AS level) WHERE a * 100 >= level * 10000000 AND NOT (a - amount_minor) * 100 >= level * 10000000""")
def budget_alerts(v: Views):
    return d.budget_crossings(v.counted, 10_000_000, [80, 90, 100])


RECURRING = """, deb AS (SELECT * FROM counted WHERE direction = 'debit'), lat AS (SELECT merchant_id, category_id, arg_max(amount_minor, (best_event_time, txn_id)) AS anchor FROM deb GROUP BY 1, 2),
near AS (SELECT d.*, anchor, date_diff('day', lag(best_event_time) OVER w, best_event_time) AS gap FROM deb d JOIN lat USING (merchant_id, category_id) WHERE abs(amount_minor - anchor) <= 0.05 * anchor WINDOW w AS (PARTITION BY merchant_id, category_id ORDER BY best_event_time, txn_id)),
ser AS (SELECT merchant_id, category_id, anchor, count(*) AS occurrences, avg(gap) AS m, stddev_pop(gap) AS sd, max(best_event_time) AS last FROM near GROUP BY 1, 2, 3 HAVING count(*) >= 3 AND avg(gap) > 0),
recurring AS (SELECT merchant_id, category_id, anchor AS amount_minor, occurrences, round(m, 6) AS mean_days, round(greatest(0.0, least(1.0, 1 - sd / m)), 6) AS confidence,
CASE WHEN m BETWEEN 5 AND 9 THEN 'weekly' WHEN m BETWEEN 25 AND 35 THEN 'monthly' ELSE 'other' END AS cadence, CAST(last AS DATE) + CAST(round(m) AS INT) AS next_date FROM ser)
"""


@query("recurring_detect", RECURRING + "SELECT * FROM recurring")
def recurring_detect(v: Views):
    return d.recurring(v.counted_by_category, ["merchant_id", "category_id"])


@query("recurring_summary", RECURRING + "SELECT r.merchant_id, coalesce(m.name, 'Unknown merchant') AS merchant_name, amount_minor, cadence FROM recurring r LEFT JOIN (SELECT * FROM merchants WHERE merchant_id % 5 <> 0) m USING (merchant_id)")
def recurring_summary(v: Views):
    known = v.merchants.filter(F.col("merchant_id") % 5 != 0).select("merchant_id", "name")
    found = d.recurring(v.counted_by_category, ["merchant_id", "category_id"])
    return found.join(known, "merchant_id", "left").select("merchant_id", F.coalesce("name", F.lit("Unknown merchant")).alias("merchant_name"), "amount_minor", "cadence")


@query("upcoming_bills", BILLS + "SELECT bill_id, instrument_id, due_date, amount_minor FROM bills WHERE due_date >= $now")
def upcoming_bills(v: Views):
    return bills(v).filter(F.col("due_date") >= ts(NOW)).orderBy("due_date", "bill_id")


@query("bill_urgency", BILLS + """SELECT bill_id, date_diff('day', $now, due_date) AS days_left, CASE WHEN due_date < $now THEN 'overdue' WHEN date_diff('day', $now, due_date) <= 3 THEN 'urgent' WHEN date_diff('day', $now, due_date) <= 7 THEN 'soon' ELSE 'normal' END AS urgency FROM bills WHERE due_date >= $now - INTERVAL 30 DAY""")
def bill_urgency(v: Views):
    left = F.datediff(F.col("due_date"), ts(NOW))
    rows = bills(v).filter(F.col("due_date") >= F.timestamp_add("DAY", F.lit(-30), ts(NOW)))
    return rows.select("bill_id", left.cast("long").alias("days_left"), F.when(F.col("due_date") < ts(NOW), "overdue").when(left <= 3, "urgent").when(left <= 7, "soon").otherwise("normal").alias("urgency"))


@query("bill_classify", BILLS + """SELECT bill_id, date_trunc('month', due_date - INTERVAL 15 DAY) IN (date_trunc('month', $now), date_trunc('month', $now) - INTERVAL 1 MONTH) AND due_date > $now AS is_upcoming FROM bills""")
def bill_classify(v: Views):
    period = F.date_trunc("month", F.timestamp_add("DAY", F.lit(-15), F.col("due_date")))
    this = F.date_trunc("month", ts(NOW))
    before = F.date_trunc("month", F.add_months(ts(NOW).cast("date"), -1))
    return bills(v).select("bill_id", ((period.cast("timestamp_ntz") == this.cast("timestamp_ntz")) | (period.cast("timestamp_ntz") == before.cast("timestamp_ntz"))).__and__(F.col("due_date") > ts(NOW)).alias("is_upcoming"))


@query("upcoming_subscriptions", """, s AS (SELECT order_id, best_event_time AS a, authorization_time AS b, CASE WHEN line_no % 3 = 0 THEN NULL WHEN line_no % 3 = 1 THEN 'active' ELSE 'cancelled' END AS state, txn_id FROM live)
SELECT txn_id, state FROM s WHERE (CAST(a AS DATE) BETWEEN DATE '2001-06-15' AND DATE '2001-06-18' OR CAST(b AS DATE) BETWEEN DATE '2001-06-15' AND DATE '2001-06-18') AND state NOT IN ('cancelled', 'paused')""")
def upcoming_subscriptions(v: Views):
    state = F.when(F.col("line_no") % 3 == 1, "active").when(F.col("line_no") % 3 == 2, "cancelled")
    soon = lambda c: F.col(c).cast("date").between(ts(NOW).cast("date"), F.date_add(ts(NOW).cast("date"), 3))
    return v.live.withColumn("state", state).filter((soon("best_event_time") | soon("authorization_time")) & ~F.col("state").isin("cancelled", "paused")).select("txn_id", "state")


@query("large_debits", BILLS + "SELECT 'debit' AS kind, txn_id AS id, amount_minor FROM live WHERE direction = 'debit' AND amount_minor >= 9000000 UNION ALL SELECT 'due', CAST(bill_id AS VARCHAR), amount_minor FROM bills WHERE date_diff('day', $now, due_date) = 3")
def large_debits(v: Views):
    debits = v.live.filter((F.col("direction") == "debit") & (F.col("amount_minor") >= 9_000_000)).select(F.lit("debit").alias("kind"), F.col("txn_id").alias("id"), "amount_minor")
    due = bills(v).filter(F.datediff(F.col("due_date"), ts(NOW)) == 3).select(F.lit("due").alias("kind"), F.col("bill_id").cast("string").alias("id"), "amount_minor")
    return debits.unionByName(due)


@query("event_funnel", "SELECT " + ", ".join(f"count(*) FILTER (event_type = '{e}') AS {e}" for e in ("view", "click", "signup", "purchase", "error")) + f" FROM events WHERE ts >= TIMESTAMP '{EVENTS_NOW}' - INTERVAL 7 DAY AND ts < TIMESTAMP '{EVENTS_NOW}'")
def event_funnel(v: Views):
    rows = v.events.filter((F.col("ts") >= F.timestamp_add("DAY", F.lit(-7), ts(EVENTS_NOW))) & (F.col("ts") < ts(EVENTS_NOW)))
    return rows.agg(*(F.count_if(F.col("event_type") == e).alias(e) for e in ("view", "click", "signup", "purchase", "error")))


@query("latency_p95", "SELECT event_type, quantile_disc(value, 0.95) AS p95 FROM events GROUP BY 1")
def latency_p95(v: Views):
    return v.events.groupBy("event_type").agg(F.expr("percentile_disc(0.95) WITHIN GROUP (ORDER BY value)").alias("p95"))


@query("billing_metrics", f""", a AS (SELECT user_id, max(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) AS paid, max(CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END) AS trial, max(ts) AS last,
  max(CASE WHEN event_type = 'purchase' THEN user_id % 3 END) AS plan FROM events GROUP BY 1), p AS (SELECT unnest([0, 1, 2]) AS plan, unnest([500, 1000, 2000]) AS price)
SELECT count(*) FILTER (paid = 1) AS paid_active, coalesce(count(*) FILTER (paid = 1 AND trial = 1) / nullif(count(*) FILTER (trial = 1), 0), 0) AS conversion,
  coalesce(count(*) FILTER (paid = 1 AND last < TIMESTAMP '{EVENTS_NOW}') / nullif(count(*) FILTER (paid = 1), 0), 0) AS churn, CAST(coalesce(sum(price), 0) AS BIGINT) AS mrr_minor FROM a LEFT JOIN p USING (plan)""")
def billing_metrics(v: Views):
    flag = lambda e: F.max(F.when(F.col("event_type") == e, 1).otherwise(0))
    accounts = v.events.groupBy("user_id").agg(flag("purchase").alias("paid"), flag("signup").alias("trial"), F.max("ts").alias("last")).withColumn("plan", F.when(F.col("paid") == 1, F.col("user_id") % 3))
    plans = v.spark.createDataFrame([(0, 500), (1, 1000), (2, 2000)], "plan long, price long")
    paid, trial = F.col("paid") == 1, F.col("trial") == 1
    return accounts.join(F.broadcast(plans), "plan", "left").agg(  # three plans
        F.count_if(paid).alias("paid_active"), F.coalesce(F.try_divide(F.count_if(paid & trial), F.count_if(trial)), F.lit(0.0)).alias("conversion"),
        F.coalesce(F.try_divide(F.count_if(paid & (F.col("last") < ts(EVENTS_NOW))), F.count_if(paid)), F.lit(0.0)).alias("churn"), F.coalesce(F.sum("price"), F.lit(0)).alias("mrr_minor"))


@query("fraud_signals", f""", e AS (SELECT user_id, count(DISTINCT CAST(props->>'k' AS INT)) FILTER (ts > TIMESTAMP '{EVENTS_NOW}' - INTERVAL 24 HOUR) AS devices, count(*) FILTER (event_type IN ('click', 'view') AND ts > TIMESTAMP '{EVENTS_NOW}' - INTERVAL 1 HOUR) AS toggles,
  count(*) FILTER (event_type = 'error') AS tampers FROM events WHERE ts <= TIMESTAMP '{EVENTS_NOW}' GROUP BY 1)
SELECT user_id, devices >= 3 AS many_devices, toggles >= 4 AS toggling, tampers >= 1 AS tampered FROM e WHERE devices >= 3 OR toggles >= 4 OR tampers >= 1""")
def fraud_signals(v: Views):
    now = ts(EVENTS_NOW)
    since = lambda unit, n: F.col("ts") > F.timestamp_add(unit, F.lit(-n), now)
    seen = v.events.filter(F.col("ts") <= now).groupBy("user_id").agg(
        F.countDistinct(F.when(since("HOUR", 24), F.get_json_object("props", "$.k"))).alias("devices"),
        F.count_if(F.col("event_type").isin("click", "view") & since("HOUR", 1)).alias("toggles"), F.count_if(F.col("event_type") == "error").alias("tampers"))
    signals = seen.select("user_id", (F.col("devices") >= 3).alias("many_devices"), (F.col("toggles") >= 4).alias("toggling"), (F.col("tampers") >= 1).alias("tampered"))
    return signals.filter("many_devices OR toggling OR tampered")


@query("layer_accuracy", "SELECT extraction_method, count(*) AS total, count(*) FILTER (reference_id IS NOT NULL) AS correct FROM live GROUP BY 1")
def layer_accuracy(v: Views):
    return v.live.groupBy("extraction_method").agg(F.count("*").alias("total"), F.count_if(F.col("reference_id").isNotNull()).alias("correct"))


@query("metric_regressions", """, s AS (SELECT CAST(ts AS DATE) AS captured, event_type AS metric, sum(value) AS v FROM events GROUP BY 1, 2), l AS (SELECT *, lag(v) OVER (PARTITION BY metric ORDER BY captured) AS b FROM s)
SELECT metric, captured, round(b, 4) AS before, round(v, 4) AS after FROM l WHERE v > b""")
def metric_regressions(v: Views):
    from pyspark.sql import Window

    daily = v.events.groupBy(F.col("ts").cast("date").alias("captured"), F.col("event_type").alias("metric")).agg(F.sum("value").alias("v"))
    before = daily.withColumn("b", F.lag("v").over(Window.partitionBy("metric").orderBy("captured")))
    return before.filter("v > b").select("metric", "captured", F.round("b", 4).alias("before"), F.round("v", 4).alias("after"))


@query("staleness", f"SELECT CAST(date_diff('second', max(ts), TIMESTAMP '{EVENTS_NOW}') AS BIGINT) AS stale_seconds FROM events WHERE ts <= TIMESTAMP '{EVENTS_NOW}'")
def staleness(v: Views):
    return v.events.filter(F.col("ts") <= ts(EVENTS_NOW)).agg(F.timestamp_diff("SECOND", F.date_trunc("second", F.max("ts")).cast("timestamp_ntz"), ts(EVENTS_NOW)).alias("stale_seconds"))


@query("run_summaries", """SELECT order_id % 50 AS run_id, count(*) AS n, count(*) FILTER (direction = 'debit') AS applied, count(*) FILTER (direction = 'credit') AS reverted, min(best_event_time) AS started,
  array_to_string(list_sort(list_distinct(list(issuer_name))), ',') AS banks FROM live JOIN instruments USING (instrument_id) GROUP BY 1""")
def run_summaries(v: Views):
    rows = v.live.join(v.instruments.select("instrument_id", "issuer_name"), "instrument_id")
    return rows.groupBy((F.col("order_id") % 50).alias("run_id")).agg(
        F.count("*").alias("n"), F.count_if(F.col("direction") == "debit").alias("applied"), F.count_if(F.col("direction") == "credit").alias("reverted"), F.min("best_event_time").alias("started"),
        F.array_join(F.sort_array(F.collect_set("issuer_name")), ",").alias("banks"))


@query("ema", """SELECT user_id, round(list_reduce(list(value ORDER BY ts, event_id), lambda a, x: 0.3 * x + 0.7 * a), 6) AS ema FROM events GROUP BY 1""")
def ema(v: Views):
    return t.moving_average(v.events, "user_id", ["ts", "event_id"], "value", 0.3).select("user_id", F.round("ema", 6).alias("ema"))
