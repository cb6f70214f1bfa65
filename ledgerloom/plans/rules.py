"""Rules learned from corrections of the payments' messages, and tried on all others. The SQL has the ledger's own values."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.operators import extraction as e
from ledgerloom.operators import rules as r
from ledgerloom.plans.extraction import MESSAGES, messages
from ledgerloom.plans.registry import query
from ledgerloom.session import shared_path
from ledgerloom.views import Views

#: Users correct the messages of one order in seven.
_CORRECTED = "order_id % 7 = 3"
#: What a user would say of a message: its merchant, amount and day, as the ledger stores them.
_VALUES = """CASE WHEN order_id % 6 <= 2 THEN concat('SUPPLIER ', CAST(merchant_id AS STRING)) END AS merchant, CASE WHEN order_id % 6 <= 2 THEN CAST(true_minor AS STRING) END AS amount,
CASE WHEN order_id % 6 <= 1 THEN concat(CAST(CAST(best_event_time AS DATE) AS STRING), ' 00:00:00') END AS event_time"""


def _settled(v: Views) -> DataFrame:
    """msg_id, bank, field, source, value, at of each message and field."""
    rows = messages(v).selectExpr("msg_id", "bank", "body AS source", "order_id", "best_event_time AS at", *_split_values())
    fields = F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).alias("value")) for f in ("merchant", "amount", "event_time")))).alias("x")
    return rows.select("msg_id", "bank", "source", "order_id", "at", fields).select("msg_id", "bank", "x.field", "source", "x.value", "at", "order_id")


def _split_values() -> list[str]:
    return [x.strip() + f" AS {name}" for x, name in zip(_VALUES.replace("\n", " ").replace(" AS merchant,", "|").replace(" AS amount,", "|").replace(" AS event_time", "").split("|"), ("merchant", "amount", "event_time"))]


_AMOUNT = "concat(CAST(true_minor // 100 AS STRING), '.', lpad(CAST(true_minor % 100 AS STRING), 2, '0'))"


@query("rules_learned_apply", MESSAGES + f"""SELECT msg_id, 'merchant' AS field, concat('SUPPLIER ', CAST(merchant_id AS STRING)) AS value FROM messages WHERE order_id % 6 <= 2 AND NOT {_CORRECTED}
UNION ALL SELECT msg_id, 'amount', {_AMOUNT} FROM messages WHERE order_id % 6 <= 2 AND NOT {_CORRECTED}
UNION ALL SELECT msg_id, 'event_time', strftime(best_event_time, '%d-%m-%Y') FROM messages WHERE order_id % 6 <= 1 AND NOT {_CORRECTED}""")
def rules_learned_apply(v: Views):
    """Rules made from some orders' corrections read the messages of all others."""
    settled = _settled(v)
    path = shared_path(v.spark, "rules")
    r.learn_rules(settled.filter(_CORRECTED).filter("value IS NOT NULL"), settled).write.parquet(path)  # its size is known then, so the messages needn't be dealt out by bank
    learned = v.spark.read.parquet(path)
    return e.learned(messages(v).filter(f"NOT {_CORRECTED}").withColumn("template", F.lit("t")), learned).select("msg_id", "field", F.trim("value").alias("value"))


#: (field, pattern, override) that are offered to every bank.
OFFERED = [
    ("amount", r"Rs\.([\d.]+) ", None), ("amount", r"XX(\d+) ", None), ("merchant", r"(?:at|by) (.+?)(?: on|\.)", None), ("merchant", r"(?:Rs\.|INR )(\S+) ", None),
    ("event_time", r"on ([\d-]+)", None), ("event_time", r"spent (\S+)", None), ("direction", None, "debit"),
]


@query("rules_regression", MESSAGES + r""", f AS (SELECT msg_id, bank, body, best_event_time, order_id, true_minor, concat('SUPPLIER ', CAST(merchant_id AS STRING)) AS m, strftime(best_event_time, '%d-%m-%Y') AS d, lpad(CAST(instrument_id % 10000 AS STRING), 4, '0') AS mask,
  concat(CAST(true_minor // 100 AS STRING), '.', lpad(CAST(true_minor % 100 AS STRING), 2, '0')) AS a, order_id % 6 AS k FROM messages WHERE order_id % 6 <= 2),
s AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY bank ORDER BY best_event_time DESC, msg_id) <= 20),
t AS (SELECT * FROM f WHERE k <= 1 QUALIFY row_number() OVER (PARTITION BY bank ORDER BY best_event_time DESC, msg_id) <= 20),
read AS (SELECT bank, 1 AS n, true AS ok FROM s WHERE k = 0 UNION ALL SELECT bank, 2, mask = a FROM s WHERE k <= 1 UNION ALL SELECT bank, 3, true FROM s UNION ALL SELECT bank, 4, a = m FROM s WHERE k <= 1
  UNION ALL SELECT bank, 5, true FROM t UNION ALL SELECT bank, 6, false FROM t WHERE k = 2),
banks AS (SELECT DISTINCT bank FROM messages)
SELECT bank, CAST(n AS INTEGER) AS rule_no, coalesce(bool_and(ok), true) AS accepted, count(ok) AS n_samples FROM banks CROSS JOIN (SELECT unnest(range(1, 8)) AS n) LEFT JOIN read USING (bank, n) GROUP BY bank, n""")
def rules_regression(v: Views):
    """Offered rules against the latest settled messages of each bank."""
    offered = v.spark.createDataFrame([(k, *x) for k, x in enumerate(OFFERED, 1)], "rule_no int, field string, pattern string, override string")
    banks = messages(v).select("bank").distinct().withColumn("_all", F.explode(F.sequence(F.lit(1), F.lit(len(OFFERED)))))
    checked = r.regression_checked(banks.join(F.broadcast(offered), banks["_all"] == offered["rule_no"]).drop("_all"), _settled(v))  # a few declared rules
    return checked.select("bank", "rule_no", "accepted", "n_samples")
