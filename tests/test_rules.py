"""Rules from corrections: patterns that hold for the next message, checks on their source and on history."""

import re

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import extraction, rules

CARD = "Dear customer, Rs.245.43 was spent on your card of First Bank ending 7603 at PAY*CORNER FOODS NORTHTOWN on 01/07/26. Not you? Call 1800 555."
NEXT = "Dear customer, Rs.1,020.00 was spent on your card of First Bank ending 4412 at PAY*CITY BIKES on 14/07/26. Not you? Call 1800 777."


def made(spark, field, source, value):
    df = spark.createDataFrame([(field, source, value)], "field string, source string, value string")
    return df.select(rules.synthesized(F.col("field"), F.col("source"), F.col("value")).alias("r")).first().r


def capture(spark, pattern, source):
    return spark.createDataFrame([(source, pattern)], "s string, p string").selectExpr("regexp_extract(s, p, 1) AS v").first().v.strip()


def test_relaxed_text(spark):
    df = spark.createDataFrame([("ending 7603 at",), ("a*b.c (x)  [1]\n$2",), ("größe-٣",)], "t string").select("t", rules.relaxed(F.col("t")).alias("p"))
    got = {r.t: r.p for r in df.collect()}
    assert got["ending 7603 at"] == r"ending\s+\d+\s+at"
    for text, pattern in got.items():
        assert re.fullmatch(pattern, text)
    assert not re.fullmatch(got["a*b.c (x)  [1]\n$2"], "axbxc (x)  [1]\n$2")


@pytest.mark.parametrize(("field", "value", "there", "following"), [
    ("merchant", "PAY*CORNER FOODS NORTHTOWN", "PAY*CORNER FOODS NORTHTOWN", "PAY*CITY BIKES"), ("amount", "24543", "245.43", "1,020.00"),
    ("event_time", "2026-07-01 00:00:00", "01/07/26", ""),  # the merchant stands before the date: it isn't the same next time
    ("merchant", "pay*corner foods northtown", "PAY*CORNER FOODS NORTHTOWN", "PAY*CITY BIKES"),
])
def test_a_rule_reads_the_next_message(spark, field, value, there, following):
    r = made(spark, field, CARD, value)
    assert r.override is None
    assert capture(spark, r.pattern, CARD) == there and capture(spark, r.pattern, NEXT) == following
    assert capture(spark, r.pattern, CARD.replace(" ", "\n\n  ")) != ""


@pytest.mark.parametrize(("field", "source", "value"), [
    ("merchant", CARD, "ELSEWHERE"), ("notes", CARD, "First"), ("direction", CARD, "sideways"), ("currency", CARD, "not-a-code"), ("merchant", "Amazon", "Amazon"),
    ("reference_id", "Ref 123456789012", "123456789012"),  # nothing behind it tells where it ends
    ("merchant", CARD, ""), ("merchant", CARD, None), ("merchant", None, "x"), (None, CARD, "x"), ("amount", CARD, "99999"),
])
def test_no_rule_is_better_than_a_wrong_one(spark, field, source, value):
    assert made(spark, field, source, value) is None


def test_overrides_and_references(spark):
    assert made(spark, "direction", CARD, " Credit ").asDict() == {"pattern": None, "override": "credit"}
    assert made(spark, "currency", CARD, "usd").asDict() == {"pattern": None, "override": "USD"}
    body = "UPI txn of Rs 500 to Elsewhere. Ref 123456789012 on 02/07/26."
    assert capture(spark, made(spark, "reference_id", body, "123456789012").pattern, body) == "123456789012"


def test_printed_forms(spark):
    df = spark.createDataFrame([("amount", "102000"), ("amount", "123456700"), ("balance", "-5"), ("event_time", "2026-07-01 13:45:00"), ("amount", "x"), ("merchant", " a ")], "f string, v string")
    got = {(r.f, r.v): r.n for r in df.select("f", "v", rules.printed_forms(F.col("f"), F.col("v")).alias("n")).collect()}
    assert got["amount", "102000"] == ["1,020.00", "1020.00", "1,020", "1020"]
    assert "12,34,567.00" in got["amount", "123456700"] and got["balance", "-5"] == ["0.05", "0"]
    assert {"01/07/2026", "01/07/26", "01-07-2026", "01-Jul-2026", "01 Jul 2026"} <= set(got["event_time", "2026-07-01 13:45:00"])
    assert got["amount", "x"] == ["x"] and got["merchant", " a "] == ["a"]


@pytest.mark.parametrize(("field", "pattern", "override", "samples", "ok"), [
    ("merchant", "at (.+) on", None, [], True),
    ("merchant", "at (.+?) on", None, [("Rs 100 at Amazon on 01/07/26", "Amazon"), ("Rs 200 at Swiggy on 02/07/26", "Swiggy")], True),
    ("merchant", r"Rs (\d+) at", None, [("Rs 100 at Amazon on 01/07/26", "Amazon")], False),
    ("merchant", "spent at (.+?) using", None, [("Rs 100 at Amazon on 01/07/26", "Amazon")], True),
    ("merchant", "at (.+?) on", None, [("Rs 100 at Amazon on 01/07/26", None)], True),
    ("amount", r"Rs\.([\d.]+) ", None, [("Rs.245.43 spent today", "24543")], True),
    ("amount", r"ending (\d+) ", None, [("Rs.245.43 spent ending 7603 today", "24543")], False),
    ("event_time", r"on (\d{2}/\d{2}/\d{2})", None, [("Spent on 01/07/26 today", "2026-07-01 00:00:00")], True),
    ("direction", None, "credit", [("any", "debit")], False), ("direction", None, "credit", [("any", "CREDIT")], True),
])
def test_history_is_not_rewritten(spark, field, pattern, override, samples, ok):
    rule = spark.createDataFrame([("b", field, pattern, override)], "bank string, field string, pattern string, override string")
    rows = [(f"m{k}", "b", field, s, v, k) for k, (s, v) in enumerate(samples)] + [("other", "c", field, "Rs 1 at X on 2", "Y", 9)]
    settled = spark.createDataFrame(rows, "msg_id string, bank string, field string, source string, value string, at long")
    got = rules.regression_checked(rule, settled).collect()
    assert len(got) == 1 and got[0].accepted == ok and (got[0].conflict is None) == ok
    if not ok:
        assert got[0].conflict.settled == samples[0][1]


def test_only_the_latest_messages_count(spark):
    rule = spark.createDataFrame([("b", "merchant", "at (.+?) on", None)], "bank string, field string, pattern string, override string")
    rows = [(f"m{k}", "b", "merchant", "at A on", "A" if k else "B", k) for k in range(21)]
    settled = spark.createDataFrame(rows, "msg_id string, bank string, field string, source string, value string, at long")
    assert rules.regression_checked(rule, settled).first().accepted
    assert not rules.regression_checked(rule, settled, 21).first().accepted


def test_learned_rules_are_applied(spark):
    corrections = spark.createDataFrame([("b", "merchant", CARD, "PAY*CORNER FOODS NORTHTOWN"), ("b", "merchant", NEXT, "PAY*CITY BIKES"), ("b", "amount", CARD, "24543"), ("c", "amount", CARD, "760300"), (None, "amount", CARD, "24543")], "bank string, field string, source string, value string")
    settled = spark.createDataFrame([("m", "c", "amount", CARD, "24543", 1)], "msg_id string, bank string, field string, source string, value string, at long")
    learned = rules.learn_rules(corrections, settled)
    assert sorted((r.bank, r.field, r.successes) for r in learned.collect()) == [("b", "amount", 1), ("b", "merchant", 2)]
    body = "Dear customer, Rs.9.00 was spent on your card of First Bank ending 1 at CAFE on 03/08/26. Not you? Call 1800 555."
    messages = spark.createDataFrame([("x", "b", body, None)], "msg_id string, bank string, body string, template string")
    assert sorted((r.field, r.value) for r in extraction.learned(messages, learned).collect()) == [("amount", "9.00"), ("merchant", "CAFE")]


def test_rules_are_tried_within_a_message(spark):
    """One row for each message and field, without a window over all that matched; words are only asked for, the pattern decides."""
    pattern = made(spark, "amount", "Rs.5.00 spent at Kiosk", "500").pattern
    bodies = ["Rs.7.25 spent at KIOSK", "Rs.7.25 ſpent at Kİoſk", "Rs.7.25 kiosk at spent", "Rs.7.25 paid"]
    messages = spark.createDataFrame([(k, "B", "t", body) for k, body in enumerate(bodies)], "msg_id long, bank string, template string, body string")
    offered = spark.createDataFrame([("r3", "B", "amount", pattern, None, 0.9, 5), ("r1", "B", "amount", r"Rs\.(7)", None, 0.9, 5), ("r2", "B", "amount", r"(\w+)$", "t", 0.1, 1), ("r0", "B", "amount", None, "t", 1.0, 9), ("r4", "C", "amount", "(.+)", "t", 1.0, 9)],
                                    "rule_id string, bank string, field string, pattern string, rule_template string, rule_confidence double, successes long")
    got = extraction.learned(messages, offered)
    assert sorted(map(tuple, got.collect())) == [(0, "amount", "KIOSK", "r2"), (1, "amount", "k", "r2"), (2, "amount", "spent", "r2"), (3, "amount", "paid", "r2")]
    lone = offered.filter("rule_id = 'r3'").withColumn("words", rules.pattern_words(F.col("pattern")))
    assert lone.first().words == ["spent", "kiosk", "rs", "at"]
    found = extraction.learned(messages, lone)
    assert sorted((r.msg_id, r.value) for r in found.collect()) == [(0, "7.25"), (1, "7.25")]
    assert "Window" not in found._jdf.queryExecution().toString()
