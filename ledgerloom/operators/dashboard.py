"""Dashboard aggregates over the ledger. Amounts are minor units; sums over nothing are 0."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.operators.matching import day_bucket
from ledgerloom.views import ts


def month_to_date(now: str, column: str = "best_event_time") -> Column:
    """From the first of the month to ``now``, both included."""
    return F.col(column).between(F.date_trunc("month", ts(now)).cast("timestamp_ntz"), ts(now))


def in_month(month: str, column: str = "best_event_time") -> Column:
    """Half-open calendar month; ``month`` is its first day."""
    return (F.col(column) >= ts(month)) & (F.col(column) < F.add_months(F.lit(month).cast("date"), 1).cast("timestamp_ntz"))


def total(amounts: Column) -> Column:
    return F.coalesce(F.sum(amounts), F.lit(0))


def major(minor: Column) -> Column:
    return minor / 100.0


def directed_total(counted: DataFrame, now: str, direction: str) -> DataFrame:
    rows = counted.filter(month_to_date(now) & (F.col("direction") == direction))
    return rows.agg(total(F.col("amount_minor")).alias("total_minor")).withColumn("total", major(F.col("total_minor")))


def summary(counted: DataFrame, bills: DataFrame, now: str, limit_minor: int) -> DataFrame:
    """Spend, income, count, use of the limit and bills to come, in one pass over the payments and one over the bills."""
    side = lambda d: total(F.when(F.col("direction") == d, F.col("amount_minor")))
    money = counted.filter(month_to_date(now)).agg(side("debit").alias("spend_minor"), side("credit").alias("income_minor"), F.count("*").alias("txn_count"))
    due = bills.filter(F.col("due_date") >= ts(now)).agg(F.count("*").alias("upcoming_bills"))
    return money.crossJoin(F.broadcast(due)).withColumn("limit_minor", F.lit(limit_minor).cast("long")).withColumn(  # one row each
        "utilization_pct", F.when(F.col("limit_minor") > 0, F.col("spend_minor") * 100.0 / F.col("limit_minor")).otherwise(0.0))


def category_spend(categories: DataFrame, counted: DataFrame, month: str) -> DataFrame:
    """All categories with their spend in the month and the share of their budget used (0 without a budget)."""
    spent = counted.filter(in_month(month) & (F.col("direction") == "debit")).groupBy("category_id").agg(F.sum("amount_minor").alias("s"))
    joined = categories.join(spent, "category_id", "left").withColumn("spend_minor", F.coalesce("s", F.lit(0)))
    return joined.select("category_id", "budget_minor", "spend_minor", F.when(F.col("budget_minor") > 0, F.col("spend_minor") * 100.0 / F.col("budget_minor")).otherwise(0.0).alias("utilization_pct"))


def week_of_year(column: str) -> Column:
    """Weeks begin on Monday; the days before the first Monday are week 00."""
    day = F.col(column)
    return F.lpad(F.floor((F.dayofyear(day) - 1 + 7 - F.weekday(day)) / 7).cast("string"), 2, "0")


def spend_trend(counted: DataFrame, now: str, days: int, period: Column) -> DataFrame:
    rows = counted.filter((F.col("direction") == "debit") & F.col("best_event_time").between(F.timestamp_add("DAY", F.lit(-days), ts(now)), ts(now)))
    return rows.groupBy(period.alias("period")).agg(F.sum("amount_minor").alias("spend_minor"), F.count("*").alias("txn_count"))


def top_merchants(counted: DataFrame, merchants: DataFrame, now: str, n: int = 10) -> DataFrame:
    """By spend, then by name: payments are summed before names are joined."""
    spent = counted.filter(month_to_date(now) & (F.col("direction") == "debit")).groupBy("merchant_id").agg(F.sum("amount_minor").alias("spend_minor"), F.count("*").alias("txn_count"))
    named = spent.join(merchants.select("merchant_id", "name"), "merchant_id")
    return named.orderBy(F.desc("spend_minor"), "name").limit(n)


def pending_review(clusters: DataFrame, ledger: DataFrame, unassigned: DataFrame) -> DataFrame:
    """Payments in open clusters and unassigned ones; the sum is over memberships, the count over payments."""
    members = ledger.join(clusters.select(F.col("cluster_id").alias("order_id")), "order_id")
    a = members.agg(F.countDistinct("txn_id").alias("clustered"), total(F.col("amount_minor")).alias("clustered_minor"))
    b = unassigned.agg(F.count("*").alias("unassigned"), total(F.col("amount_minor")).alias("unassigned_minor"))
    return a.crossJoin(b).select((F.col("clustered") + F.col("unassigned")).alias("pending"), (F.col("clustered_minor") + F.col("unassigned_minor")).alias("pending_minor"))  # one row each


def balances(instruments: DataFrame, live: DataFrame) -> DataFrame:
    """The stored balance, else the computed one where it is a credit card's or positive, else 0."""
    debit, card = F.col("direction") == "debit", F.col("type") == "credit_card"
    net = live.groupBy("instrument_id").agg(F.sum(F.when(debit, -F.col("amount_minor")).otherwise(F.col("amount_minor"))).alias("net"))
    joined = instruments.join(net, "instrument_id", "left")
    computed = F.when(card, -F.coalesce("net", F.lit(0))).otherwise(F.coalesce("net", F.lit(0)))
    return joined.select("instrument_id", "type", computed.alias("computed_minor"),
                         F.coalesce("stored_balance_minor", F.when(card | (computed > 0), computed).otherwise(0)).alias("balance_minor"))


def portfolio(balances: DataFrame, instruments: DataFrame) -> DataFrame:
    joined = balances.join(instruments.select("instrument_id", "limit_minor"), "instrument_id")
    card = F.col("type") == "credit_card"
    return joined.agg(
        total(F.when(~card, F.col("balance_minor"))).alias("cash_minor"), total(F.when(card, F.abs("balance_minor"))).alias("credit_used_minor"),
        total(F.when(card, F.col("limit_minor"))).alias("credit_limit_minor"))


def top_k_and_other(rows: DataFrame, name: str, value: str, k: int) -> DataFrame:
    """The ``k`` largest by value (ties by name), and the sum of the rest as Other. ``rows`` is small: one for each name."""
    place = F.row_number().over(Window.orderBy(F.desc(value), name))
    return rows.withColumn("_p", place).groupBy(F.when(F.col("_p") <= k, F.col(name)).otherwise("Other").alias(name)).agg(F.sum(value).alias(value))


def instrument_flow(live: DataFrame, k: int = 5) -> DataFrame:
    """Inflow, outflow, mean, and the k largest payments of each instrument, as text."""
    side = lambda d: total(F.when(F.col("direction") == d, F.col("amount_minor")))
    flow = live.groupBy("instrument_id").agg(side("credit").alias("inflow_minor"), side("debit").alias("outflow_minor"), F.avg("amount_minor").alias("avg_minor"))
    w = Window.partitionBy("instrument_id").orderBy(F.desc(F.abs("amount_minor")), "txn_id")
    best = live.withColumn("_p", F.row_number().over(w)).filter(F.col("_p") <= k).groupBy("instrument_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_p", "amount_minor"))), lambda x: x["amount_minor"].cast("string")), ",").alias("top_amounts"))
    return flow.join(best, "instrument_id")


def month_over_month(counted: DataFrame) -> DataFrame:
    """Change of the last month's spend against the one before, in per cent; null if that isn't positive or missing."""
    months = counted.filter(F.col("direction") == "debit").groupBy(F.date_format("best_event_time", "yyyy-MM").alias("period")).agg(F.sum("amount_minor").alias("spend_minor"))
    w = Window.orderBy("period")  # a row for each month
    changed = months.withColumn("before", F.lag("spend_minor").over(w))
    delta = F.when(F.col("before") > 0, (F.col("spend_minor") - F.col("before")) * 100.0 / F.col("before"))
    return changed.select("period", "spend_minor", delta.alias("delta_pct")).orderBy(F.desc("period")).limit(1)


def group_counts(rows: DataFrame, column: str, missing: str = "unknown") -> DataFrame:
    return rows.groupBy(F.coalesce(F.col(column), F.lit(missing)).alias(column)).agg(F.count("*").alias("n"))


def merchant_spikes(counted: DataFrame, factor: float = 3.0) -> DataFrame:
    """Debits over ``factor`` times the merchant's mean of the 30 days before, the payment's own moment excluded.

    A window holds 30 days of a merchant and, as guests, the 30 days before them, so a busy merchant is many windows.
    """
    debits = counted.filter(F.col("direction") == "debit")
    own = day_bucket(F.col("best_event_time"), 30)
    spread = debits.withColumn("_own", own).withColumn("_bucket", F.explode(F.array(own, own + 1)))
    w = "OVER (PARTITION BY merchant_id, _bucket ORDER BY best_event_time RANGE BETWEEN INTERVAL '30 00:00:00' DAY TO SECOND PRECEDING AND INTERVAL '0 00:00:00.000001' DAY TO SECOND PRECEDING)"
    rows = spread.withColumn("trailing_avg", F.expr(f"avg(amount_minor) {w}")).filter("_bucket = _own")
    return rows.filter(F.col("amount_minor") > factor * F.col("trailing_avg")).select("txn_id", "merchant_id", "amount_minor", F.round("trailing_avg", 4).alias("trailing_avg"))


def budget_crossings(counted: DataFrame, limit_minor: int, levels: list[int]) -> DataFrame:
    """The payment at which the month's spend of an instrument first reaches each level (per cent of the limit)."""
    w = Window.partitionBy("instrument_id", "month").orderBy("best_event_time", "txn_id").rowsBetween(Window.unboundedPreceding, 0)
    rows = counted.filter(F.col("direction") == "debit").withColumn("month", F.date_format("best_event_time", "yyyy-MM"))
    run = rows.withColumn("after", F.sum("amount_minor").over(w)).withColumn("before", F.col("after") - F.col("amount_minor"))
    level = F.explode(F.array(*map(F.lit, levels))).alias("level")
    reached = lambda c: F.col(c) * 100 >= F.col("level") * limit_minor
    return run.select("instrument_id", "month", "txn_id", "before", "after", level).filter(reached("after") & ~reached("before")).select("instrument_id", "month", "level", "txn_id", F.col("after").alias("spend_minor"))


def recurring(counted: DataFrame, keys: list[str], tolerance: float = 0.05) -> DataFrame:
    """Series of at least three debits of about the latest amount, with their cadence and the next date."""
    debits = counted.filter(F.col("direction") == "debit")
    latest = debits.groupBy(*keys).agg(F.max_by("amount_minor", F.struct("best_event_time", "txn_id")).alias("anchor"))
    near = debits.join(latest, keys).filter(F.abs(F.col("amount_minor") - F.col("anchor")) <= tolerance * F.col("anchor"))
    w = Window.partitionBy(*keys).orderBy("best_event_time", "txn_id")
    gaps = near.withColumn("gap", F.datediff("best_event_time", F.lag("best_event_time").over(w)))
    series = gaps.groupBy(*keys, "anchor").agg(F.count("*").alias("occurrences"), F.avg("gap").alias("mean_days"), F.stddev_pop("gap").alias("sd"), F.max("best_event_time").alias("last"))
    mean = F.col("mean_days")
    return series.filter((F.col("occurrences") >= 3) & (mean > 0)).select(
        *keys, F.col("anchor").alias("amount_minor"), "occurrences", F.round("mean_days", 6).alias("mean_days"),
        F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - F.col("sd") / mean)), 6).alias("confidence"),
        F.when(mean.between(5, 9), "weekly").when(mean.between(25, 35), "monthly").otherwise("other").alias("cadence"),
        F.date_add(F.col("last").cast("date"), F.round(mean).cast("int")).alias("next_date"))
