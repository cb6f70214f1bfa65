"""Message functions at their boundaries."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import messages as g


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


@pytest.mark.parametrize("raw, address, domain", [("Bank <A@Bank.example>", "a@bank.example", "bank.example"), ("a@b@c", None, None), ("none", None, None), (" x@y ", "x@y", "y")])
def test_addresses(spark, raw, address, domain):
    assert (value(spark, g.address(F.lit(raw))), value(spark, g.domain(F.lit(raw)))) == (address, domain)


def test_auth_and_risk(spark):
    bad, good = F.lit("x; spf=fail; dkim=FAIL (y); dmarc=none"), F.lit("spf=pass dkim=pass dmarc=pass spf=fail")
    assert value(spark, g.auth_failed(bad)) and not value(spark, g.auth_failed(good)) and value(spark, g.auth_verdict(good, "spf")) == "pass"
    r = value(spark, g.sender_risk(F.lit("spoof"), bad, F.lit(20), F.lit(19)))
    assert (r.score, r.signals) == (0.8 + 0.2, ["auth_failed", "good_history", "lookalike"])
    assert value(spark, g.sender_risk(F.lit("verified"), good, F.lit(1), F.lit(1))).score == 0.1


def test_bodies(spark):
    assert value(spark, g.snippet(F.lit(" a \n b "))) == "a b" and len(value(spark, g.snippet(F.lit("x" * 300)))) == 241
    assert value(spark, g.plain_body(F.lit("hi\n> quoted\n\n\nbye\n-- \nme"))) == "hi\n\nbye"


@pytest.mark.parametrize("ms, want", [(1704067200000, dt.datetime(2024, 1, 1, 5, 30)), (1704067200, dt.datetime(2024, 1, 1, 5, 30)), (5_000_000_000_000, None), (-1, None)])
def test_event_clock(spark, ms, want):
    got = value(spark, g.event_clock(F.lit(ms).cast("long")).cast("timestamp_ntz"))
    assert got == want


def test_installments_and_foreign_amounts(spark):
    assert tuple(value(spark, g.installment(F.lit("EMI no. 3 of 12")))) == (3, 12)
    assert value(spark, g.installment(F.lit("EMI 13 of 12"))) is None and value(spark, g.installment(F.lit("x"))) is None
    x = value(spark, g.foreign_amount(F.lit("paid USD 10.00 abroad"), F.lit("INR"), F.lit(83000)))
    assert tuple(x) == ("USD", 1000, 83.0) and value(spark, g.foreign_amount(F.lit("USD 1"), F.lit("USD"), F.lit(1))) is None


@pytest.mark.parametrize("minor, currency, text", [(123456789, "INR", "₹12,34,567.89"), (-5, "INR", "-₹0.05"), (123456789, "USD", "$1,234,567.89"), (100, "EUR", "EUR 1.00"), (None, "INR", "—"), (99900, "INR", "₹999.00"), (100000, "INR", "₹1,000.00")])
def test_money(spark, minor, currency, text):
    assert value(spark, g.money(F.lit(minor).cast("long"), F.lit(currency))) == text


def test_needles_and_signals(spark):
    assert value(spark, g.needles(F.lit(12345600))) == ["123456.00", "1,23,456.00", "123456", "1,23,456"]
    assert value(spark, g.payment_addresses(F.lit("from Me@upi to shop@okbank"), F.lit("me@upi"))) == ["shop@okbank"]
    assert value(spark, g.networks(F.lit("your RuPay card"))) == "RUPAY" and value(spark, g.self_transfer(F.lit("to own account XX1234"))) == "1234"
    assert value(spark, g.nfkc(F.lit("ｂａｎｋ"))) == "bank"
    assert value(spark, g.eta_seconds(F.lit(2), F.lit(10), F.lit(4.0))) == 16.0
