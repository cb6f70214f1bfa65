"""Ledger tables as views over the supplied tables, in Spark and, for checking, in DuckDB SQL.

The two definitions of a view stand side by side; each has explicit keys and no row order.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: "Now" of all time-dependent queries: the tables end in November 2001, the events in January 2024.
NOW = "2001-06-15 12:00:00"
EVENTS_NOW = "2024-01-20 00:00:00"


def ts(text: str) -> Column:
    return F.lit(text).cast("timestamp_ntz")


def minor(amount: str) -> Column:
    """Minor units of an amount in whole units."""
    return F.round(F.col(amount) * 100).cast("long")


def pick(key: str, *values: str) -> Column:
    """One of ``values`` by the remainder of ``key``."""
    return F.element_at(F.array(*map(F.lit, values)), (F.col(key) % len(values) + 1).cast("int"))


class Views:
    """Lazy views over one folder of tables."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def payments(self) -> DataFrame:
        """One row for each payment, without its category; deleted rows are among them."""
        rows = self.table("lineitem").join(self.table("orders"), F.col("l_orderkey") == F.col("o_orderkey"))
        amount = minor("l_extendedprice")
        return rows.select(
            F.concat_ws("-", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", amount).alias("txn_id"),
            F.col("l_orderkey").alias("order_id"), F.col("o_custkey").alias("instrument_id"), amount.alias("amount_minor"), F.lit("INR").alias("currency"),
            F.when(F.col("l_returnflag") == "R", "credit").otherwise("debit").alias("direction"),
            F.col("l_shipdate").alias("best_event_time"), F.col("o_orderdate").alias("authorization_time"),
            F.col("l_suppkey").alias("merchant_id"), F.col("l_linestatus").alias("status"),
            ((F.col("l_orderkey") * 7 + F.col("l_linenumber")) % 97 == 0).alias("is_deleted"),
            pick("l_orderkey", "template", "generic", "token", "crossref", "llm").alias("extraction_method"),
            F.when(F.col("l_orderkey") % 4 == 0, F.lit(None)).otherwise(F.lpad(F.col("l_orderkey").cast("string"), 12, "0")).alias("reference_id"),
            F.col("l_linenumber").alias("line_no"), F.col("l_partkey").alias("part_id"),
        )

    @cached_property
    def ledger(self) -> DataFrame:
        """Payments with their category: for queries that ask for it, since it costs a join."""
        return self.payments.join(self.table("part").select(F.col("p_partkey").alias("part_id"), F.col("p_type").alias("category_id")), "part_id").drop("part_id")

    @cached_property
    def live(self) -> DataFrame:
        return self.payments.filter(~F.col("is_deleted")).drop("part_id")

    @cached_property
    def live_by_category(self) -> DataFrame:
        return self.ledger.filter(~F.col("is_deleted"))

    @cached_property
    def clusters(self) -> DataFrame:
        """Clusters of ambiguous matches: one for each chosen order, members are its payments."""
        k = F.col("o_orderkey")
        status = F.when(k % 37 == 0, "open").when(k % 41 == 0, "deferred").when(k % 43 == 0, "confirmed")
        return self.table("orders").filter(status.isNotNull()).select(
            k.alias("cluster_id"), status.alias("status"), F.col("o_orderdate").alias("created_at"), (k % 100 / 100.0).alias("score"))

    @cached_property
    def open_clusters(self) -> DataFrame:
        return self.clusters.filter(F.col("status") == "open")

    def _counted(self, rows: DataFrame) -> DataFrame:
        return rows.join(self.open_clusters.select(F.col("cluster_id").alias("order_id")), "order_id", "left_anti")

    @cached_property
    def counted(self) -> DataFrame:
        """Live payments outside of open clusters, as the analytics count them."""
        return self._counted(self.live)

    @cached_property
    def counted_by_category(self) -> DataFrame:
        return self._counted(self.live_by_category)

    @cached_property
    def merchants(self) -> DataFrame:
        return self.table("supplier").select(F.col("s_suppkey").alias("merchant_id"), F.col("s_name").alias("name"), F.upper("s_name").alias("normalized_name"))

    @cached_property
    def instruments(self) -> DataFrame:
        return self.table("customer").select(
            F.col("c_custkey").alias("instrument_id"), F.col("c_name").alias("name"),
            F.when(F.col("c_mktsegment") == "BUILDING", "credit_card").when(F.col("c_mktsegment") == "MACHINERY", "wallet").otherwise("bank_account").alias("type"),
            F.concat(F.lit("BANK"), F.col("c_nationkey").cast("string")).alias("issuer_name"), F.lpad((F.col("c_custkey") % 10000).cast("string"), 4, "0").alias("masked_identifier"),
            F.when(F.col("c_custkey") % 3 == 0, minor("c_acctbal")).alias("stored_balance_minor"), (F.col("c_custkey") % 5 * 1000000).alias("limit_minor"))

    @cached_property
    def categories(self) -> DataFrame:
        return self.table("part").select(F.col("p_type").alias("category_id")).distinct().select(
            "category_id", F.substring_index("category_id", " ", 1).alias("parent_id"), (F.length("category_id") % 4 * 5000000).alias("budget_minor"))

    @cached_property
    def observations(self) -> DataFrame:
        """Statement-side sightings of the orders, some days off."""
        k = F.col("o_orderkey")
        return self.table("orders").select(
            F.concat(F.lit("o"), k.cast("string")).alias("obs_id"), k.alias("order_id"), F.col("o_custkey").alias("instrument_id"), minor("o_totalprice").alias("amount_minor"),
            F.lit("INR").alias("currency"), F.when(k % 7 == 0, "credit").otherwise("debit").alias("direction"),
            F.timestamp_add("DAY", (k % 9 - 4).cast("int"), F.col("o_orderdate")).alias("event_time"),
            F.when(k % 3 != 0, F.lpad(k.cast("string"), 12, "0")).alias("reference_id"),
            F.when(k % 5 == 0, F.lit(None)).otherwise(F.concat(F.lit("MERCHANT "), (k % 100).cast("string"))).alias("merchant_raw"),
            pick("o_orderkey", "email", "statement", "manual").alias("source_pipeline"), (k % 10 / 10.0).alias("confidence"))

    @cached_property
    def canonical(self) -> DataFrame:
        """Ledger-side candidates: the orders, and a copy a day later of every tenth."""
        k = F.col("o_orderkey")
        base = self.table("orders").select(
            F.concat(F.lit("c"), k.cast("string")).alias("cand_id"), k.alias("order_id"), F.col("o_custkey").alias("instrument_id"), minor("o_totalprice").alias("amount_minor"),
            F.lit("INR").alias("currency"), F.when(k % 7 == 0, "credit").otherwise("debit").alias("direction"), F.col("o_orderdate").alias("event_time"),
            F.when(k % 2 == 0, F.lpad(k.cast("string"), 12, "0")).alias("reference_id"), F.concat(F.lit("MERCHANT "), (k % 100).cast("string")).alias("merchant_name"),
            F.when(k % 4 == 0, "email_only").otherwise("statement_only").alias("source_mix"))
        copies = base.filter(F.col("order_id") % 10 == 0).withColumn("cand_id", F.concat("cand_id", F.lit("x"))).withColumn("event_time", F.timestamp_add("DAY", F.lit(1), F.col("event_time")))
        return base.unionByName(copies)

    @cached_property
    def events(self) -> DataFrame:
        return self.table("events")


_MINOR = "CAST(round({} * 100) AS BIGINT)".format

PRELUDE = f"""WITH ledger AS (
  SELECT concat_ws('-', l_orderkey, l_partkey, l_suppkey, l_linenumber, {_MINOR("l_extendedprice")}) AS txn_id, l_orderkey AS order_id, o_custkey AS instrument_id,
    {_MINOR("l_extendedprice")} AS amount_minor, 'INR' AS currency, CASE WHEN l_returnflag = 'R' THEN 'credit' ELSE 'debit' END AS direction,
    l_shipdate AS best_event_time, o_orderdate AS authorization_time, l_suppkey AS merchant_id, p_type AS category_id, l_linestatus AS status,
    (l_orderkey * 7 + l_linenumber) % 97 = 0 AS is_deleted, ['template', 'generic', 'token', 'crossref', 'llm'][l_orderkey % 5 + 1] AS extraction_method,
    CASE WHEN l_orderkey % 4 <> 0 THEN lpad(CAST(l_orderkey AS VARCHAR), 12, '0') END AS reference_id, l_linenumber AS line_no
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey),
live AS (SELECT * FROM ledger WHERE NOT is_deleted),
clusters AS (
  SELECT o_orderkey AS cluster_id, CASE WHEN o_orderkey % 37 = 0 THEN 'open' WHEN o_orderkey % 41 = 0 THEN 'deferred' ELSE 'confirmed' END AS status,
    o_orderdate AS created_at, o_orderkey % 100 / 100.0 AS score FROM orders WHERE o_orderkey % 37 = 0 OR o_orderkey % 41 = 0 OR o_orderkey % 43 = 0),
open_clusters AS (SELECT * FROM clusters WHERE status = 'open'),
counted AS (SELECT l.* FROM live l WHERE NOT EXISTS (SELECT 1 FROM open_clusters c WHERE c.cluster_id = l.order_id)),
merchants AS (SELECT s_suppkey AS merchant_id, s_name AS name, upper(s_name) AS normalized_name FROM supplier),
instruments AS (
  SELECT c_custkey AS instrument_id, c_name AS name, CASE c_mktsegment WHEN 'BUILDING' THEN 'credit_card' WHEN 'MACHINERY' THEN 'wallet' ELSE 'bank_account' END AS type,
    'BANK' || c_nationkey AS issuer_name, lpad(CAST(c_custkey % 10000 AS VARCHAR), 4, '0') AS masked_identifier,
    CASE WHEN c_custkey % 3 = 0 THEN {_MINOR("c_acctbal")} END AS stored_balance_minor, c_custkey % 5 * 1000000 AS limit_minor FROM customer),
categories AS (
  SELECT DISTINCT p_type AS category_id, split_part(p_type, ' ', 1) AS parent_id, length(p_type) % 4 * 5000000 AS budget_minor FROM part),
observations AS (
  SELECT 'o' || o_orderkey AS obs_id, o_orderkey AS order_id, o_custkey AS instrument_id, {_MINOR("o_totalprice")} AS amount_minor, 'INR' AS currency,
    CASE WHEN o_orderkey % 7 = 0 THEN 'credit' ELSE 'debit' END AS direction, o_orderdate + to_days(CAST(o_orderkey % 9 - 4 AS INT)) AS event_time,
    CASE WHEN o_orderkey % 3 <> 0 THEN lpad(CAST(o_orderkey AS VARCHAR), 12, '0') END AS reference_id,
    CASE WHEN o_orderkey % 5 <> 0 THEN 'MERCHANT ' || (o_orderkey % 100) END AS merchant_raw,
    ['email', 'statement', 'manual'][o_orderkey % 3 + 1] AS source_pipeline, o_orderkey % 10 / 10.0 AS confidence FROM orders),
canonical_base AS (
  SELECT 'c' || o_orderkey AS cand_id, o_orderkey AS order_id, o_custkey AS instrument_id, {_MINOR("o_totalprice")} AS amount_minor, 'INR' AS currency,
    CASE WHEN o_orderkey % 7 = 0 THEN 'credit' ELSE 'debit' END AS direction, o_orderdate AS event_time,
    CASE WHEN o_orderkey % 2 = 0 THEN lpad(CAST(o_orderkey AS VARCHAR), 12, '0') END AS reference_id, 'MERCHANT ' || (o_orderkey % 100) AS merchant_name,
    CASE WHEN o_orderkey % 4 = 0 THEN 'email_only' ELSE 'statement_only' END AS source_mix FROM orders),
canonical AS (
  SELECT * FROM canonical_base UNION ALL
  SELECT cand_id || 'x', order_id, instrument_id, amount_minor, currency, direction, event_time + INTERVAL 1 DAY, reference_id, merchant_name, source_mix FROM canonical_base WHERE order_id % 10 = 0)"""
