"""Headers of statements: values beside their labels and in the columns below."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import headers


def read(spark, text):
    return spark.createDataFrame([(text,)], "t string").select(headers.header(F.col("t")).alias("h")).first().h.asDict()


@pytest.mark.parametrize(("text", "mask"), [
    ("Credit Card No.       411122XXXXXX0364", "0364"), ("Card No:    511133******9740     Name  A B", "9740"), ("Credit Card No. 4222XXXXXXXX7480)", "7480"), ("Statement for YES BANK Card Number 3444XXXXXXXX2982", "2982"),
    ("Credit Card Number\nXXXX XXXX XXXX XX03", "03"), ("Card Number: XXXX 3620", "3620"), ("nothing", None), ("", None), (None, None),
])
def test_accounts(spark, text, mask):
    assert read(spark, text)["mask"] == mask


def test_values_beside_their_labels(spark):
    got = read(spark, "A B HDFC Bank          Credit Card No.        411122XXXXXX0364\nStatement Date                        13 May, 2026\nTOWN 100200       Billing Period      14 Apr, 2026 - 13 May, 2026\nVisa Signature\n")
    assert (got["issuer"], got["period_start"], got["period_end"], got["statement_date"], got["network"]) == ("HDFC", dt.date(2026, 4, 14), dt.date(2026, 5, 13), dt.date(2026, 5, 13), "VISA")
    got = read(spark, "for Statement Period: 10 Jun 26 to 09 Jul 26\n*Total Amount Due ( ` )\n4,321.00\n**Minimum Amount Due ( ` )\n200.00\n")
    assert (got["period_start"], got["period_end"], got["total_minor"], got["minimum_minor"]) == (dt.date(2026, 6, 10), dt.date(2026, 7, 9), 432_100, 20_000)
    got = read(spark, "Billing from: 01/02/2026 Billing to: 28/02/2026 Mastercard")
    assert (got["period_start"], got["period_end"], got["network"]) == (dt.date(2026, 2, 1), dt.date(2026, 2, 28), "MasterCard")


def test_values_in_the_column_below(spark):
    got = read(spark, "Total Payment Due      Minimum Payment Due      Payment Due Date\n27,199.83              14,501.00                01/08/2026\n")
    assert (got["total_minor"], got["minimum_minor"], got["due_date"]) == (2_719_983, 1_450_100, dt.date(2026, 8, 1))
    # A line between them, and a column that is too far off.
    got = read(spark, "Total Payment Due      Minimum Payment Due\n\n                        5.00\n")
    assert (got["total_minor"], got["minimum_minor"]) == (500, 500)
    got = read(spark, "Minimum Payment Due\n" + " " * 25 + "5.00\n")
    assert got["minimum_minor"] == 500  # beside it, but for blanks
    got = read(spark, "Minimum Payment Due x\n" + " " * 25 + "5.00\n")
    assert got["minimum_minor"] is None
    got = read(spark, "Minimum Payment Due x\n\n\n5.00\n")
    assert got["minimum_minor"] is None


def test_what_is_no_value(spark):
    assert read(spark, "STMT No.        : A11223344556\n**Minimum Amount Due ( ` )\nSTMT No.        : A11223344556\n")["minimum_minor"] is None
    assert read(spark, "Payment Due Date: 03/08/2026          PAY ONLINE\nStatement Date : 14/07/2026\n")["due_date"] == dt.date(2026, 8, 3)
    assert set(read(spark, None).values()) == {None}


def test_pages(spark):
    rows = [("a", 2, "Card No. XXXX 1111"), ("a", 1, "Statement of the month, Card No. XXXX 2222"), ("b", 1, "cover"), ("b", 2, "Card No. XXXX 3333"), ("c", 1, None)]
    got = {r.statement_id: r.mask for r in headers.statement_headers(spark.createDataFrame(rows, "statement_id string, page_no int, text string")).collect()}
    assert got == {"a": "2222", "b": "3333", "c": None}


def test_patterns_are_not_repeated(spark):
    plan = spark.createDataFrame([("",)], "t string").select(headers.header(F.col("t")))._jdf.queryExecution().optimizedPlan().toString()
    # The plan writes each pattern twice; accounts stood in it 51 times, since every use of the account had them again.
    assert plan.count(headers.MASKED) <= 2 * len(headers.ACCOUNT) and plan.count(headers.TOTAL + r"\s*") <= 2


def test_dates_of_all_shapes(spark):
    rows = ["1/2/2026", "01-02-26", "1.2.69", "1 Feb 2026", "01-FEB-26", "1 feb, 2026", "1/Feb/68", "2026-2-1", "01/02/0026", "31/02/2026", "1 Fob 2026", "1/2-2026", "", None]
    day = dt.date(2026, 2, 1)
    got = [r.d for r in spark.createDataFrame([(k, t) for k, t in enumerate(rows)], "k int, t string").select("k", headers.statement_date(F.col("t")).alias("d")).orderBy("k").collect()]
    assert got == [day, day, dt.date(1969, 2, 1), day, day, day, dt.date(2068, 2, 1), day, day, None, None, None, None, None]
