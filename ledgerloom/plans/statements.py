"""Statement queries. Lines are laid out from the ledger by issuer; the checking SQL takes the values from the ledger itself."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.messages import grouped_digits
from ledgerloom.operators import headers
from ledgerloom.operators import statements as s
from ledgerloom.plans.registry import query
from ledgerloom.views import Views

_AMOUNT = "concat(format_string('%d', amount_minor DIV 100), '.', lpad(amount_minor % 100, 2, '0'))"
_ISSUERS = "CASE order_id % 8 WHEN 0 THEN 'HDFC Bank' WHEN 1 THEN 'ICICI Bank' WHEN 2 THEN 'Axis Bank' WHEN 3 THEN 'AMEX' WHEN 4 THEN 'hdfc bank' WHEN 5 THEN 'icici bank' WHEN 6 THEN 'SBI Card' ELSE 'Co-op' END"
_NUMBERED = """
SELECT order_id AS statement_id, {issuer} AS issuer, CASE WHEN order_id % 8 IN (4, 5) THEN 'bank_account' ELSE 'credit_card' END AS kind, order_id % 8 AS p, order_id % 16 AS q,
  row_number() OVER (PARTITION BY order_id ORDER BY line_no, txn_id) AS n, concat('SUPPLIER ', merchant_id) AS who, {amount} AS a, direction = 'debit' AS out, best_event_time AS t, lpad(order_id, 12, '0') AS ref, order_id
FROM live"""
#: (offset, line) of each payment: a layout for each remainder of the order.
_LINES = """
SELECT statement_id, issuer, kind, n * 10 + l.at AS line_no, l.line FROM numbered LATERAL VIEW inline(CASE
  WHEN q = 8 THEN array(named_struct('at', 0, 'line', concat(date_format(t, 'dd/MM/yyyy'), ' ', who, '   GROCERY Rs ', a)))
  WHEN p = 0 AND n % 3 = 2 THEN array(named_struct('at', 0, 'line', date_format(t, 'dd/MM/yyyy')), named_struct('at', 1, 'line', concat(who, ' ', a, IF(out, ' DR', ' Cr'))))
  WHEN p = 0 THEN array(named_struct('at', 0, 'line', concat(date_format(t, 'dd/MM/yyyy'), ' ', who, ' ', ref, ' ', a, IF(out, ' Dr', ' CR'))), named_struct('at', 1, 'line', concat(date_format(t, 'dd/MM/yyyy'), ' Opening  Balance: ', a, ' DR')))
  WHEN p = 1 THEN array(named_struct('at', 0, 'line', concat(date_format(t, 'dd-MM-yyyy'), ' ', who, '  ', IF(out, concat(a, ' - '), concat('- ', a, ' ')), a)))
  WHEN p = 2 THEN array(named_struct('at', 0, 'line', concat('  ', date_format(t, 'dd/MM/yyyy'), ' ', who, IF(out, ' -', ' +'), a)))
  WHEN p = 3 THEN array(named_struct('at', 0, 'line', concat(date_format(t, 'MM/dd/yyyy'), ' ', who, IF(out, ' ', ' -'), a)))
  WHEN p = 4 THEN array(named_struct('at', 0, 'line', concat(date_format(t, 'dd/MM/yyyy'), ' ', who, ' REF', statement_id, ' ', date_format(t, 'dd/MM/yyyy'), IF(out, concat(' ', a, ' -'), concat(' - ', a)), ' 1.00')))
  WHEN p = 5 THEN array(named_struct('at', 0, 'line', concat(date_format(t, 'dd/MM/yyyy'), ' Brought forward x ', date_format(t, 'dd/MM/yyyy'), ' - - 1.00')), named_struct('at', 1, 'line', concat(date_format(t, 'dd/MM/yyyy'), ' ', who, ' ', ref, ' ', date_format(t, 'dd/MM/yyyy'), IF(out, concat(' ', a, ' -'), concat(' - ', a)), ' 1.00')))
  WHEN p = 6 THEN array(named_struct('at', 0, 'line', concat(n, ' ', upper(date_format(t, 'dd-MMM-yyyy')), ' ', who, ' ', a, IF(out, ' Dr', ' Cr'))))
  WHEN n % 2 = 0 THEN array(named_struct('at', 0, 'line', who), named_struct('at', 1, 'line', concat(date_format(t, 'd MMM yy'), ' ', a, IF(out, ' D', ' C'))), named_struct('at', 2, 'line', '--'))
  ELSE array(named_struct('at', 0, 'line', concat(date_format(t, 'd/M/yy'), ' | 10:20 ', who, IF(out, ' ', ' + '), 'C', a, ' *')), named_struct('at', 1, 'line', concat(date_format(t, 'd/M/yy'), ' Grand Total ', a))) END) l AS at, line"""


def statement_lines(v: Views) -> DataFrame:
    """statement_id, issuer, kind, line_no, line."""
    numbered = v.spark.sql(_NUMBERED.replace("FROM live", "FROM {live}").format(issuer=_ISSUERS, amount=_AMOUNT, live="{live}"), live=v.live).withColumn("statement_id", F.col("order_id"))  # the key by which the rows are already dealt out
    return v.spark.sql(_LINES.replace("FROM numbered", "FROM {numbered}"), numbered=numbered)


@query("statement_rows", """, n AS (SELECT order_id, order_id % 8 AS p, order_id % 16 AS q, row_number() OVER (PARTITION BY order_id ORDER BY line_no, txn_id) AS n, merchant_id, amount_minor, direction, best_event_time, lpad(CAST(order_id AS VARCHAR), 12, '0') AS ref FROM live)
SELECT order_id AS statement_id, n * 10 + CASE WHEN q <> 8 AND (p = 0 AND n % 3 = 2 OR p = 5 OR p = 7 AND n % 2 = 0) THEN 1 ELSE 0 END AS line_no, CAST(best_event_time AS DATE) AS entry_date,
  'SUPPLIER ' || merchant_id || CASE WHEN p = 0 AND q <> 8 AND n % 3 <> 2 THEN ' ' || ref ELSE '' END AS description, amount_minor, CASE WHEN q = 8 THEN 'debit' ELSE direction END AS direction,
  CASE WHEN p = 4 THEN 'REF' || order_id WHEN p = 5 OR p = 0 AND q <> 8 AND n % 3 <> 2 THEN ref END AS reference_id FROM n""")
def statement_rows(v: Views):
    return s.statement_rows(statement_lines(v))


_DAY = "CAST(o_orderdate AS DATE)"


@query("statement_headers", f""", o AS (SELECT *, {_DAY} AS d, CAST(round(o_totalprice * 100) AS BIGINT) AS m, o_orderkey % 3 AS k FROM orders)
SELECT o_orderkey AS statement_id, CASE k WHEN 0 THEN 'HDFC' WHEN 1 THEN 'SBI' ELSE 'Axis' END AS issuer, CASE WHEN k < 2 THEN d - 30 END AS period_start, CASE WHEN k < 2 THEN d - 1 END AS period_end, CASE WHEN k = 0 THEN d END AS statement_date,
CASE WHEN k <> 1 THEN d + 18 END AS due_date, CASE WHEN k > 0 THEN m // 20 END AS minimum_minor, m AS total_minor, lpad(CAST(o_custkey % 10000 AS VARCHAR), 4, '0') AS mask, CASE k WHEN 0 THEN 'VISA' WHEN 1 THEN 'RuPay' END AS network FROM o""")
def statement_headers(v: Views):
    """Headers in three layouts: beside the labels, on the line after them, in the columns below."""
    d, k = F.col("o_orderdate").cast("date"), F.col("o_orderkey") % 3
    minor = F.round(F.col("o_totalprice") * 100).cast("long")
    money = lambda m: F.concat(grouped_digits(F.floor(m / 100)), F.lit("."), F.lpad((m % 100).cast("string"), 2, "0"))
    total, least = money(minor), money(F.floor(minor / 20))
    day = lambda n, form: F.date_format(F.date_add(d, n), form)
    mask = F.lpad((F.col("o_custkey") % 10000).cast("string"), 4, "0")
    beside = F.concat(F.lit("HDFC Bank Credit Card No.      411122XXXXXX"), mask, F.lit("\nStatement Date        "), day(0, "dd MMM, yyyy"), F.lit("\nTOWN 100200    Billing Period    "), day(-30, "dd MMM, yyyy"), F.lit(" - "), day(-1, "dd MMM, yyyy"),
                      F.lit("\nPayment Due Date: "), day(18, "dd/MM/yyyy"), F.lit("   VISA\nTotal Amount Due Rs. "), total)
    after = F.concat(F.lit("SBI RuPay Card Number\nXXXX XXXX XXXX "), mask, F.lit("\nfor Statement Period: "), day(-30, "dd MMM yy"), F.lit(" to "), day(-1, "dd MMM yy"), F.lit("\n*Total Amount Due ( ` )\n"), total, F.lit("\n**Minimum Amount Due ( ` )\n"), least)
    below = F.concat(F.lit("Axis Bank  Card No: 511133******"), mask, F.lit("\nTotal Payment Due      Minimum Payment Due      Payment Due Date\n"), F.rpad(total, 23, " "), F.rpad(least, 25, " "), day(18, "dd/MM/yyyy"))
    text = F.when(k == 0, beside).when(k == 1, after).otherwise(below)
    # Split over two pages behind a cover for some.
    covered = F.col("statement_id") % 5 == 0
    whole = v.table("orders").select(F.col("o_orderkey").alias("statement_id"), text.alias("text"))
    pages = whole.select("statement_id", F.explode(F.array(F.struct(F.lit(1).alias("page_no"), F.when(covered, "cover").otherwise(F.col("text")).alias("text")), F.struct(F.lit(2).alias("page_no"), F.when(covered, F.col("text")).otherwise("Card No. XXXX 0000").alias("text")))).alias("p"))
    return headers.statement_headers(pages.select("statement_id", "p.*"))
