"""What becomes of transactions after reconciliation: refunds, or else merchant, category, series and instalments, in one chain."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.classify import clean_merchant, plausible_merchant
from ledgerloom.functions.messages import installment_group
from ledgerloom.operators.matching import as_of

REFUND_DAYS = 30
# Words in a merchant's name and the category that they tell, in order of trial.
CATEGORY_WORDS = [("transport", ["uber", "lyft", "transit"]), ("shopping", ["amazon", "flipkart"]), ("food", ["swiggy", "zomato", "restaurant"])]


def keyword_category(merchant: Column) -> Column:
    out, low = None, F.lower(merchant)
    for category, words in CATEGORY_WORDS:
        found = reduce(Column.__or__, (low.contains(w) for w in words))
        out = F.when(found, category) if out is None else out.when(found, category)
    return out


def post_process(transactions: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """txn_id, parent_id, subtype, status, merchant, category_id, group_id of each transaction, after all steps.

    ``transactions`` has txn_id, instrument_id, direction, amount_minor, best_event_time, merchant_raw, category_id, status,
    parent_id, installments and original_minor; ``aliases`` has alias (in upper case) and merchant. A credit is only looked at as a
    refund: of the latest debit without a parent of its instrument and amount in the 30 days before, which then counts as
    refunded. A debit gets its merchant's name (by alias, else cleaned if it is plausible), the category that the name tells, else
    its own, and with instalments the group of them. Deleted rows are left out by the caller.
    """
    credit = F.col("direction") == "credit"
    debits = transactions.filter(~credit & F.col("parent_id").isNull()).select("instrument_id", "amount_minor", F.col("txn_id").alias("_debit"), F.col("best_event_time").alias("_then"))
    refunds = transactions.filter(credit).select("instrument_id", "amount_minor", F.col("txn_id").alias("_credit"), F.col("best_event_time").alias("_now"))
    linked = as_of(refunds, debits, ["instrument_id", "amount_minor"], "_credit", "_now", "_debit", "_then", REFUND_DAYS).select("_credit", "_debit")
    rows = transactions.join(linked, transactions["txn_id"] == linked["_credit"], "left")
    gone = linked.select(F.col("_debit").alias("_back")).distinct()
    rows = rows.join(gone, transactions["txn_id"] == gone["_back"], "left")
    rows = rows.withColumn("_clean", F.when(~credit, clean_merchant(F.col("merchant_raw"))))
    if aliases is not None:
        named = aliases.groupBy(F.col("alias").alias("_alias")).agg(F.min("merchant").alias("_named"))
        rows = rows.join(named, F.when(~credit, F.upper("merchant_raw")) == F.col("_alias"), "left")
    else:
        rows = rows.withColumn("_named", F.lit(None).cast("string"))
    merchant = F.coalesce("_named", F.when(plausible_merchant(F.col("_clean")), F.col("_clean")))
    group = F.when(~credit & (F.col("installments") > 1), installment_group(F.col("instrument_id"), F.col("_merchant"), F.col("original_minor"), F.col("installments")))
    return rows.withColumn("_merchant", merchant).select(
        "txn_id", F.coalesce("_debit", "parent_id").alias("parent_id"), F.when(F.col("_debit").isNotNull(), "refund").alias("subtype"),
        F.when(F.col("_back").isNotNull(), "refunded").otherwise(F.col("status")).alias("status"), F.col("_merchant").alias("merchant"),
        F.coalesce(F.when(~credit, keyword_category(F.col("merchant_raw"))), F.col("category_id")).alias("category_id"), group.alias("group_id"))
