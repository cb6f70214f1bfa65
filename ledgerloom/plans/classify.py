"""Queries that classify texts. Each payment gets a text of a listed case; the checking SQL has what the case must give."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions import classify as c
from ledgerloom.operators import senders
from ledgerloom.plans.registry import query
from ledgerloom.views import Views

_LONG = "Dear customer, " * 45  # over 600 characters
#: (subject, body, class); {a} is the payment's amount.
CLASS_CASES = [
    ("Your OTP", "Rs {a} debited", "otp"), ("Verification code", "123456", "otp"), ("Update KYC today", "Rs {a} spent", "kyc"), ("Aadhaar linking", "", "kyc"),
    ("Your e-Statement", "Rs {a} debited", "statement"), ("Notice", "Your mandate has been cancelled for Rs {a}", "mandate_cancel"), ("Autopay stopped", "Rs {a}", "mandate_cancel"),
    ("Autopay activated", "Rs {a} will be debited", "mandate_register"), ("Info", "Standing instruction set for INR {a}", "mandate_register"), ("Personal loan for you", "Rs {a} credited", "marketing"),
    ("Alert", "Transaction declined: Rs {a} debited", "noise"), ("Alert", _LONG + "Rs {a} spent. Payment failed?", "transaction"), ("Exclusive offer", "Get Rs {a} now", "marketing"),
    ("Exclusive offer", "Rs {a} debited", "transaction"), ("Offer", "You spent a lot", "marketing"), ("Payment due", "Rs {a} will be debited", "reminder"), ("Overdue", "Rs {a} not paid", "reminder"),
    ("Overdue", "Rs {a} debited", "transaction"), ("Hello", "You've paid {a} INR", "transaction"), ("Hello", "Rs {a} will be charged", "unknown"), ("Balance", "Avl Bal Rs {a}", "balance"),
    ("Balance", "Avl Bal Rs {a}, Rs 5 credited", "transaction"), ("Terms of use", "Rs {a}", "noise"), ("Hello", "Rs {a}", "unknown"), (None, "refund of {a}", "transaction"), ("Hi", None, "unknown"),
]
#: (body, instrument type, instalments, channel)
CHANNEL_CASES = [
    ("Rs {a} credited to account no. XX1234 via UPI", None, None, "internal_transfer"), ("Rs {a} BNPL due", None, None, "bnpl"), ("Use Pay Later for {a}", None, 3, "bnpl"), ("Loan disbursed {a}", None, None, "loan"),
    ("NACH debit {a}", None, None, "ecs_nach"), ("nachos {a}", None, None, None), ("UPI_SHOP {a}", "credit_card", None, "upi_credit_card"), ("UPI_SHOP {a}", "bank_account", None, "upi"), ("IMPS/UPI {a}", None, None, "imps"),
    ("by NEFT, {a}", None, None, "neft"), ("rtgs:{a}", None, None, "rtgs"), ("at POS {a}", None, None, "pos"), ("position {a}", None, 6, "emi"), ("ATM {a}", None, None, "atm"), ("atmosphere {a}", None, None, None),
    ("your wallets {a}", None, None, "wallet"), ("Chq {a}", None, None, "cheque"), ("paid {a}", None, 12, "emi"), (None, None, None, None),
]
#: (raw name, cleaned, plausible); {n} is the merchant's number.
MERCHANT_CASES = [
    ("Razorpay*Acme {n}  Store", "ACME {n} STORE", True), ("PAY SQ *cafe*12345", "CAFE", True), ("Acme*Branch {n}", "ACME", True), ("gpay*", "GPAY", True), ("shop {n} 12345", "SHOP {n}", True),
    ("payment to your", "PAYMENT TO YOUR", False), ("the (bank) store", "THE (BANK) STORE", False), ("a b", "A B", False), ("Tea Visa House Co", "TEA VISA HOUSE CO", True), ("  12345 ", "", False), ("x1", "X1", False),
]
#: (Spark's pattern, DuckDB's pattern), the ways in which dates are written here.
DATE_CASES = [
    ("dd-MMM-yy", "%d-%b-%y"), ("d-MMM-yyyy", "%-d-%b-%Y"), ("dd/MM/yy", "%d/%m/%y"), ("dd/MM/yyyy", "%d/%m/%Y"), ("d-M-yy", "%-d-%-m-%y"), ("dd-MM-yyyy", "%d-%m-%Y"), ("d MMM yy", "%-d %b %y"), ("dd MMM yyyy", "%d %b %Y"),
    ("d MMM, yy", "%-d %b, %y"), ("dd MMM, yyyy", "%d %b, %Y"), ("MMM d, yyyy", "%b %-d, %Y"), ("EEE, MMM d, yyyy", "%a, %b %-d, %Y"), ("EEE, MMMM d, yyyy", "%a, %B %-d, %Y"), ("d MMMM yyyy", "%-d %B %Y"),
    ("dd MMMM, yyyy", "%d %B, %Y"), ("MMMM dd, yyyy", "%B %d, %Y"), ("yyyy-MM-dd", "%Y-%m-%d"), ("yyyy-MM-dd HH:mm:ss", "%Y-%m-%d %H:%M:%S"),
]
_DIGITS = (2, 3, 4, 5)


def _sql(value) -> str:
    return "NULL" if value is None else str(value).upper() if isinstance(value, bool) else "'" + value.replace("'", "''") + "'"


def _values(cases: list[tuple], *picked: int) -> str:
    return ", ".join("(" + ", ".join([str(k), *(_sql(case[p]) for p in picked)]) + ")" for k, case in enumerate(cases))


def _cased(v: Views, cases: list[tuple], schema: str) -> DataFrame:
    """Live payments with the columns of their case."""
    listed = v.spark.createDataFrame([(k, *case) for k, case in enumerate(cases)], f"k int, {schema}")
    k = ((F.col("order_id") * 7 + F.col("line_no")) % len(cases)).cast("int")
    return v.live.select("txn_id", "merchant_id", "amount_minor", k.alias("k")).join(F.broadcast(listed), "k")  # a row for each case


def _filled(column: str, mark: str, value: str) -> F.Column:
    return F.replace(F.col(column), F.lit(mark), F.col(value).cast("string"))


_CASE = "(order_id * 7 + line_no) % {n} = k"


@query("content_class", f"SELECT txn_id, class FROM live JOIN (VALUES {_values(CLASS_CASES, 2)}) c(k, class) ON {_CASE.format(n=len(CLASS_CASES))}")
def content_class(v: Views):
    rows = _cased(v, CLASS_CASES, "subject string, body string, expected string")
    return rows.select("txn_id", c.content_class(F.col("subject"), _filled("body", "{a}", "amount_minor")).alias("class"))


@query("channel_detect", f"SELECT txn_id, channel FROM live JOIN (VALUES {_values(CHANNEL_CASES, 3)}) c(k, channel) ON {_CASE.format(n=len(CHANNEL_CASES))}")
def channel_detect(v: Views):
    rows = _cased(v, CHANNEL_CASES, "body string, type string, installments int, expected string")
    return rows.select("txn_id", c.channel(_filled("body", "{a}", "amount_minor"), F.col("type"), F.col("installments")).alias("channel"))


@query("merchant_clean", f"""SELECT DISTINCT replace(raw, '{{n}}', CAST(merchant_id AS VARCHAR)) AS raw, replace(cleaned, '{{n}}', CAST(merchant_id AS VARCHAR)) AS cleaned, plausible
FROM live JOIN (VALUES {_values(MERCHANT_CASES, 0, 1, 2)}) c(k, raw, cleaned, plausible) ON {_CASE.format(n=len(MERCHANT_CASES))}""")
def merchant_clean(v: Views):
    rows = _cased(v, MERCHANT_CASES, "raw string, a string, b boolean").select(_filled("raw", "{n}", "merchant_id").alias("raw")).distinct()
    return rows.withColumn("cleaned", c.clean_merchant(F.col("raw"))).withColumn("plausible", c.plausible_merchant(F.col("cleaned")))


@query("date_parse", f""", d AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS d, o_orderkey % {len(DATE_CASES)} AS k FROM orders)
SELECT DISTINCT CASE k {' '.join(f"WHEN {k} THEN strftime(d, '{f}')" for k, (_, f) in enumerate(DATE_CASES))} END AS s, d AS parsed, k IN {_DIGITS} AND day(d) <= 12 AND day(d) <> month(d) AS ambiguous FROM d""")
def date_parse(v: Views):
    k, d = F.col("o_orderkey") % len(DATE_CASES), F.col("o_orderdate")
    s = None
    for n, (pattern, _) in enumerate(DATE_CASES):
        s = F.when(k == n, F.date_format(d, pattern)) if s is None else s.when(k == n, F.date_format(d, pattern))
    return v.table("orders").select(s.alias("s")).distinct().select("s", c.message_date(F.col("s")).alias("p")).select("s", "p.*")


@query("phrase_coverage", """, p AS (SELECT DISTINCT lower(p_name || ' ' || p_type) AS phrase FROM part), t AS (SELECT DISTINCT lower(split_part(p_name, ' ', 1) || ' ' || left(split_part(p_type, ' ', 1), 4)) AS term FROM part WHERE p_partkey % 97 = 0)
SELECT phrase FROM p WHERE NOT EXISTS (SELECT 1 FROM t WHERE len(list_filter(string_split(term, ' '), lambda w: NOT contains(phrase, w))) = 0)""")
def phrase_coverage(v: Views):
    """Descriptions of parts that no search term made from some of them reaches."""
    part = v.table("part")
    phrases = part.select(F.lower(F.concat_ws(" ", "p_name", "p_type")).alias("phrase"))
    word = lambda c: F.split_part(F.col(c), F.lit(" "), F.lit(1))
    terms = part.filter("p_partkey % 97 = 0").select(F.lower(F.concat_ws(" ", word("p_name"), F.left(word("p_type"), F.lit(4)))).alias("term"))
    return senders.unreachable_phrases(phrases, terms)


#: (domain, bank, classification)
REGISTRY = [("bankone.example", "ONE", "transaction_candidate"), ("alerts.bankone.example", "ONE ALERTS", "statement_candidate"), ("banktwo.example", "TWO", "statement_candidate"), ("promo.example", "PROMO", "noise")]
NAMES = ["bank one", "bank two"]
APPROVED = [(" Own.Example ", "OWN", "transaction_candidate"), ("papers.example", "PAPERS", "statement_candidate")]
OVERRIDES = [("banktwo.example", "OLD", 1), ("BankTwo.example", "TWO & CO", 2), ("unknown.example", "GRANTED?", 3), ("own.example", " ", 4)]
_PASS, _FAIL = "mx; spf=pass; dkim=pass; dmarc=pass", "mx; spf=fail; dkim=fail; dmarc=fail"
#: (From headers, authentication, verdict, bank); {n} is the merchant's number.
SENDER_CASES = [
    (["Bank One <a{n}@bankone.example>"], _PASS, "transaction", "ONE"), (["x@mail{n}.BankOne.example."], None, "transaction", "ONE"), (["x@eu.alerts.bankone.example"], _PASS, "statement", "ONE ALERTS"),
    (["x@banktwo.example"], _PASS, "statement", "TWO & CO"), (["x@promo.example"], _FAIL, "noise", None), (["x@bankone.example.evil{n}.test"], _PASS, "spoof_inside", None), (["x@mybankone.example"], _PASS, "spoof_inside", None),
    (["x@bаnkone.example"], _PASS, "spoof_lookalike", None), (["x@a.xn--bnkone-{n}.example"], _PASS, "spoof_punycode", None), (["x@bankoen.example"], _PASS, "spoof_spelling", None), (["The Bank Two Desk <x@mail{n}.test>"], _PASS, "spoof_name", None),
    (["x@unknown.example"], _PASS, "unknown", None), (["x@bankone.example"], _FAIL, "spoof_auth", None), (["x@own.example"], _PASS, "transaction", "OWN"), (["Bank One <x@papers.example>"], None, "statement", "PAPERS"), (["x@own.example"], _FAIL, "spoof_auth", None),
    (["x@bankone.example", "y@bankone.example"], _PASS, "spoof_headers", None), ([], _PASS, "invalid", None), (["  "], _PASS, "invalid", None), (["nobody"], _PASS, "invalid", None), (None, None, "invalid", None),
]


@query("sender_verify", f"SELECT txn_id AS msg_id, verdict, bank FROM live JOIN (VALUES {_values(SENDER_CASES, 2, 3)}) c(k, verdict, bank) ON {_CASE.format(n=len(SENDER_CASES))}")
def sender_verify(v: Views):
    rows = _cased(v, SENDER_CASES, "froms array<string>, auth string, expected string, expected_bank string")
    froms = F.transform("froms", lambda h: F.replace(h, F.lit("{n}"), F.col("merchant_id").cast("string")))
    messages = rows.select(F.col("txn_id").alias("msg_id"), froms.alias("froms"), "auth")
    table = lambda data, schema: v.spark.createDataFrame(data, schema)
    return senders.sender_gate(messages, table(REGISTRY, "domain string, bank string, classification string"), table([(n,) for n in NAMES], "name string"),
                               table(APPROVED, "domain string, bank string, classification string"), table(OVERRIDES, "domain string, bank string, set_at long"))


@query("wrong_bank_overrides", """, r AS (SELECT 'D' || (merchant_id % 40) || '.example' AS domain, CASE WHEN order_id % 5 = 0 THEN ' ' ELSE 'BANK' || (order_id % 7) END AS bank, txn_id AS feedback_id, best_event_time AS reported_at FROM live)
SELECT lower(domain) AS domain, bank, feedback_id FROM r WHERE trim(bank) <> '' QUALIFY row_number() OVER (PARTITION BY lower(domain) ORDER BY reported_at DESC, feedback_id DESC) = 1""")
def wrong_bank_overrides(v: Views):
    bank = F.when(F.col("order_id") % 5 == 0, " ").otherwise(F.concat(F.lit("BANK"), (F.col("order_id") % 7).cast("string")))
    return senders.latest_overrides(v.live.select(F.concat(F.lit("D"), (F.col("merchant_id") % 40).cast("string"), F.lit(".example")).alias("domain"), bank.alias("bank"), F.col("txn_id").alias("feedback_id"), F.col("best_event_time").alias("reported_at")))
