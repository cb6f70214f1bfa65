"""Column functions over all payments. Each payment gets the inputs of a listed case; the checking SQL has its result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions import classify as c
from ledgerloom.functions import messages as g
from ledgerloom.functions import text as x
from ledgerloom.operators import tables as t
from ledgerloom.plans.classify import _CASE, _cased, _values
from ledgerloom.plans.registry import query
from ledgerloom.views import Views


def _case_query(name: str, cases: list[tuple], build: Callable[..., Column]) -> None:
    """Register ``build`` over the inputs (all texts but the last) of each case; the last is what it must give, as a text."""
    inputs = [f"i{k}" for k in range(len(cases[0]) - 1)]
    sql = f"SELECT txn_id, result FROM live JOIN (VALUES {_values(cases, len(inputs))}) c(k, result) ON {_CASE.format(n=len(cases))}"

    @query(name, sql)
    def run(v: Views) -> DataFrame:
        rows = _cased(v, cases, ", ".join(f"{i} string" for i in [*inputs, "expected"]))
        return rows.select("txn_id", build(*map(F.col, inputs)).cast("string").alias("result"))


_case_query("sender_address", [
    ("Bank <A@Bank.example>", "a@bank.example bank.example"), (" x@y ", "x@y y"), ("a@b@c", None), ("none", None), (None, None), ("<x@y.example> z", "x@y.example y.example"),
], lambda h: F.when(g.address(h).isNotNull(), F.concat_ws(" ", g.address(h), g.domain(h))))

_case_query("auth_verdicts", [
    ("mx; spf=fail; dkim=FAIL (y); dmarc=none", "fail fail none true"), ("spf=pass dkim=pass dmarc=pass spf=fail", "pass pass pass false"), ("spf=softfail; dkim=pass", "softfail pass - false"),
    ("dmarc=fail", "- - fail true"), ("", "- - - false"),
], lambda h: F.concat_ws(" ", *(F.coalesce(g.auth_verdict(h, m), F.lit("-")) for m in ("spf", "dkim", "dmarc")), F.coalesce(g.auth_failed(h), F.lit(False)).cast("string")))

_case_query("sender_risk", [
    ("spoof", "spf=fail dkim=fail", "20", "19", "1.0 auth_failed,good_history,lookalike"), ("verified", "spf=pass", "1", "1", "0.1 "), ("unknown", "dmarc=fail", "0", "0", "0.8 auth_failed"),
    ("verified_suffix", "dmarc=pass", "10", "9", "0.0 good_history"), ("typosquat", None, None, None, "0.9 lookalike"),
], lambda verdict, h, n, p: F.concat(F.format_number(g.sender_risk(verdict, h, n.cast("int"), p.cast("int"))["score"], 1), F.lit(" "), F.array_join(g.sender_risk(verdict, h, n.cast("int"), p.cast("int"))["signals"], ",")))

_case_query("body_text", [
    ("hi\n> quoted\n\n\nbye\n-- \nme", "hi\n\nbye|hi > quoted bye -- me"), ("one", "one|one"), (" a \n b ", "a\n b|a b"), ("x" * 300, "x" * 300 + "|" + "x" * 240 + "…"), ("", "|"),
], lambda b: F.concat(g.plain_body(b), F.lit("|"), g.snippet(b)))

_case_query("event_clock", [
    ("1704067200000", "2024-01-01 05:30:00"), ("1704067200", "2024-01-01 05:30:00"), ("5000000000000", None), ("-1", None), (None, None), ("946684800000", "2000-01-01 05:30:00"),
], lambda ms: F.date_format(g.event_clock(ms.cast("long")).cast("timestamp_ntz"), "yyyy-MM-dd HH:mm:ss"))

_case_query("emi_fields", [
    ("EMI no. 3 of 12", "3 of 12"), ("Your emi 1/6 is due", "1 of 6"), ("EMI 13 of 12", None), ("semi 3 of 4", None), ("none", None), (None, None),
], lambda b: F.concat(g.installment(b)["number"].cast("string"), F.lit(" of "), g.installment(b)["total"].cast("string")))

_case_query("fx_fields", [
    ("paid USD 10.00 abroad", "INR", "83000", "USD 1000 83.0"), ("USD 1", "USD", "1", None), ("EUR 1,000.50 and USD 5", "INR", "9004500", "EUR 100050 90.0"), ("no amount", "INR", "5", None), ("GBP 0", "INR", "5", "GBP 0 -"),
], lambda b, code, minor: F.when(g.foreign_amount(b, code, minor.cast("long")).isNotNull(), F.concat_ws(" ", *(F.coalesce(g.foreign_amount(b, code, minor.cast("long"))[f].cast("string"), F.lit("-")) for f in ("currency", "amount_minor", "rate")))))

_case_query("money_text", [
    ("123456789", "INR", "₹12,34,567.89"), ("-5", "INR", "-₹0.05"), ("123456789", "USD", "$1,234,567.89"), ("100", "EUR", "EUR 1.00"), (None, "INR", "—"), ("99900", "INR", "₹999.00"), ("100000", "INR", "₹1,000.00"),
], lambda minor, code: g.money(minor.cast("long"), code))

_case_query("amount_needles", [
    ("12345600", "123456.00;1,23,456.00;123456;1,23,456"), ("50", "0.50"), ("99900", "999.00;999"),
], lambda minor: F.array_join(g.needles(minor.cast("long")), ";"))

_case_query("instrument_signals", [
    ("your RuPay card, from Me@upi to shop@okbank", "me@upi", "RUPAY shop@okbank -"), ("Visa to own account XX1234", "a@b", "VISA  1234"), ("televisa", "a@b", "-  -"), (None, "a@b", "-  -"),
], lambda b, owner: F.concat(F.coalesce(g.networks(b), F.lit("-")), F.lit(" "), F.coalesce(F.array_join(g.payment_addresses(b, owner), ","), F.lit("")), F.lit(" "), F.coalesce(g.self_transfer(b), F.lit("-"))))

_case_query("reference_ids", [
    ("Ref 123456789012.", "123456789012"), ("1234567890123", None), ("a 111111111111 222222222222", "111111111111"), (None, None),
], lambda b: x.group(b, x.REFERENCE))

_case_query("direction_marks", [
    ("Dr", "debit debit"), ("+", "credit debit"), ("CREDIT", "credit credit"), (" c ", "credit debit"), ("?", "- debit"), (None, "- debit"),
], lambda m: F.concat(F.coalesce(x.strict_direction(m), F.lit("-")), F.lit(" "), x.tolerant_direction(F.coalesce(m, F.lit("")))))

_case_query("currency_code", [
    ("Rs", "INR"), ("₹", "INR"), (" rs. ", "INR"), ("$", "USD"), ("usd", "USD"), ("eur", "EUR"), ("", None), (None, None),
], x.currency_code)

_case_query("merchant_confidence", [
    ("learned_patterns", "ACME STORES", "true", "0.90"), ("learned_patterns", "ACME STORES", "false", "0.60"), ("bank_templates", "XKCD", "true", "0.65"), ("layer5_crossref", "TEA HOUSE", "true", "0.85"), ("llm_layer6", "PAY HOUSE", "false", "0.35"),
    ("generic_regex", "A PAY", "false", "0.00"), ("nlp", "BCDFG", "true", "0.25"), ("other", "COFFEE", "true", "0.50"), ("nlp", "", "true", "0.00"), (None, "COFFEE BAR", "false", "0.20"),
], lambda layer, name, known: F.format_number(c.merchant_confidence(layer, name, known.cast("boolean")), 2))

_case_query("statement_display_name", [
    ("HDFC Bank", "credit_card", "XXXX1234", "2024-02-29", "HDFC 1234 Feb 2024"), ("Some Other Bank Ltd", "bank_account", None, "2023-12-31", "SOME Dec 2023"), (None, "credit_card", "99", None, "Statement 99"), ("ICICI", "wallet", "XX7", "2024-01-31", "ICICI 7 Jan 2024"),
], lambda issuer, kind, mask, end: g.statement_name(issuer, mask, end.cast("date")))

_case_query("filename_period", [
    ("stmt_2024-02.pdf", "2024-02-29"), ("2024_12_card.PDF", "2024-12-31"), ("x-03-2023.pdf", "2023-03-31"), ("card 202401.pdf", "2024-01-31"), ("Stmt-Feb2023.pdf", "2023-02-28"), ("2022_nov.pdf", "2022-11-30"),
    ("card-13-2023.pdf", None), ("jan1999.pdf", None), ("x20240131.pdf", None), ("plain.pdf", None), (None, None), ("march_2024.pdf", None), ("mar_2024 jan-2020.pdf", "2020-01-31"),
], g.file_period_end)

_case_query("merchant_display", [
    ("ZOMATO LTD MUMBAI", "Zomato"), ("ACME PVTLTD", "ACME  Pvt  Ltd"), ("ACMETECHNOLOGIES", "ACME Tech"), ("iTea House", "iTea House"), ("TEA HOUSE", "Tea House"), ("", "Unknown Merchant"), (None, "Unknown Merchant"), ("  Make My Trip x", "MakeMyTrip"),
], g.display_name)

_case_query("redaction", [
    ("mail a.b@c.example now", "mail [EMAIL] now"), ("card 1234-5678 9012 3456", "card [CARD]"), ("paid ₹ 1,234.50", "paid [AMOUNT]"), ("Password = hunter2 x", "Password: [REDACTED] x"), ("id 1234567", "id [NUMBER]"), ("12345", "12345"), (None, None),
], x.redact)

_case_query("progress_eta", [
    ("2", "10", "4.0", "16.0"), ("0", "10", "4.0", None), ("10", "10", "5.0", "0.0"), (None, "3", "1.0", None),
], lambda done, total, elapsed: g.eta_seconds(done.cast("int"), total.cast("int"), elapsed.cast("double")))


@query("batch_eta", """, b AS (SELECT order_id % 50 AS batch, CASE WHEN line_no % 3 <> 0 THEN amount_minor % 97 END AS seconds, line_no % 4 <> 0 AS finished FROM live)
SELECT batch, round(avg(seconds) FILTER (finished) * count(*) FILTER (NOT finished), 3) AS eta_seconds FROM b GROUP BY batch""")
def batch_eta(v: Views):
    rows = v.live.select((F.col("order_id") % 50).alias("batch"), F.when(F.col("line_no") % 3 != 0, F.col("amount_minor") % 97).alias("seconds"), (F.col("line_no") % 4 != 0).alias("finished"))
    return t.batch_eta(rows, "batch")


@query("manual_entries", """SELECT 'm-' || txn_id AS obs_id, instrument_id, amount_minor, currency, direction, best_event_time AS event_time, CAST(1.0 AS DOUBLE) AS confidence, 'manual' AS source_pipeline FROM live WHERE extraction_method = 'token' AND amount_minor > 0""")
def manual_entries(v: Views):
    return t.manual_observations(v.live.filter("extraction_method = 'token'").withColumnRenamed("best_event_time", "event_time"))


@query("status_transitions", """SELECT cluster_id, CASE WHEN status = 'open' AND cluster_id % 2 = 0 THEN 'confirmed' WHEN status = 'deferred' AND cluster_id % 2 = 1 THEN 'open' ELSE status END AS status FROM clusters""")
def status_transitions(v: Views):
    rows = v.clusters.select("cluster_id", "status")
    asked = rows.select("cluster_id", F.when(F.col("cluster_id") % 2 == 0, "confirmed").otherwise("open").alias("to"))
    return t.transitioned(rows, asked, "cluster_id", [("open", "confirmed"), ("deferred", "open")])


@query("tag_edits", """, b AS (SELECT DISTINCT txn_id, order_id % 5 AS tag_id FROM live), a AS (SELECT txn_id, order_id % 3 AS tag_id FROM live WHERE line_no = 1), r AS (SELECT txn_id, 2 AS tag_id FROM live)
SELECT txn_id, tag_id FROM (SELECT * FROM b UNION SELECT * FROM a) ANTI JOIN r USING (txn_id, tag_id)""")
def tag_edits(v: Views):
    tag = lambda n: (F.col("order_id") % n).alias("tag_id")
    return t.retagged(v.live.select("txn_id", tag(5)), v.live.filter("line_no = 1").select("txn_id", tag(3)), v.live.select("txn_id", F.lit(2).cast("long").alias("tag_id")))


@query("pruned_backups", "SELECT instrument_id, txn_id FROM live QUALIFY row_number() OVER (PARTITION BY instrument_id ORDER BY best_event_time DESC, txn_id) <= 3")
def pruned_backups(v: Views):
    return t.newest(v.live, ["instrument_id"], [F.desc("best_event_time"), "txn_id"], 3).select("instrument_id", "txn_id")


@query("last_wins_rules", """, m AS (SELECT txn_id, 'SUPPLIER ' || merchant_id || CASE WHEN order_id % 3 = 0 THEN ' CASH' ELSE '' END AS description FROM live)
SELECT txn_id, CASE WHEN description LIKE '%CASH' THEN 'withdrawal' WHEN description LIKE 'SUPPLIER 1%' THEN 'ones' ELSE 'any' END AS category FROM m""")
def last_wins_rules(v: Views):
    rules = v.spark.createDataFrame([(b, *r) for b in range(5) for r in ((1, "SUPPLIER", "any"), (2, "SUPPLIER 1", "ones"), (3, "CASH$", "withdrawal"), (4, "NEVER", "x"))], "bank long, place long, pattern string, category string")
    description = F.concat(F.lit("SUPPLIER "), F.col("merchant_id").cast("string"), F.when(F.col("order_id") % 3 == 0, " CASH").otherwise(""))
    return t.last_rule(v.live.select("txn_id", (F.col("merchant_id") % 5).alias("bank"), description.alias("description")), rules)
