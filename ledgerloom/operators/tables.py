"""Filters, pages, search and table rewrites. Tables are never updated in place: a change gives a new frame."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def filtered(ledger: DataFrame, *, date_from: str | None = None, date_to: str | None = None, **equal: object) -> DataFrame:
    """Rows that meet all given conditions; days are whole days of the authorization time."""
    conditions = [F.col(c) == F.lit(x) for c, x in equal.items() if x is not None]
    if date_from:
        conditions.append(F.col("authorization_time") >= F.lit(f"{date_from} 00:00:00").cast("timestamp_ntz"))
    if date_to:
        conditions.append(F.col("authorization_time") <= F.lit(f"{date_to} 23:59:59").cast("timestamp_ntz"))
    return ledger.filter(reduce(Column.__and__, conditions)) if conditions else ledger


def page(rows: DataFrame, newest: str, key: str, limit: int, offset: int = 0) -> DataFrame:
    """Newest first; ties in the order of the key, so that pages neither overlap nor skip."""
    return rows.orderBy(F.desc(newest), key).offset(offset).limit(limit)


def search(rows: DataFrame, term: str, columns: list[str]) -> DataFrame:
    """Rows with the term in a column, whatever the case, or with it as their amount."""
    like = "%" + term.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_") + "%"
    conditions = [F.coalesce(F.col(c).ilike(like), F.lit(False)) for c in columns]
    try:
        number = float(term.replace(",", ""))
        conditions += [F.abs("amount_minor") == F.lit(round(number * 100)), F.abs("amount_minor") == F.lit(int(number))]
    except ValueError:
        pass
    return rows.filter(reduce(Column.__or__, conditions))


def spaced(text: Column) -> Column:
    """The tokens of a text, with one blank between them."""
    return F.trim(F.lower(F.regexp_replace(text, r"[^\p{L}\p{N}]+", " ")))


def tokens(text: Column) -> Column:
    return F.array_remove(F.split(spaced(text), " "), "")


def phrase_prefix(rows: DataFrame, phrase: str, columns: list[str]) -> DataFrame:
    """Rows where a column has the phrase's words in a row, the last as the beginning of a word."""
    words = [w for w in "".join(c if c.isalnum() else " " for c in phrase.lower()).split() if w]
    if not words:
        return rows.limit(0)
    *whole, last = words
    found = [F.concat(F.lit(" "), F.array_join(tokens(F.coalesce(F.col(c), F.lit(""))), " ")).contains(" " + " ".join([*whole, last])) for c in columns]
    return rows.filter(reduce(Column.__or__, found))


def insert_missing(table: DataFrame, rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The table with those rows whose key it doesn't have; of new rows with one key the first in ``order``."""
    first = rows.withColumn("_p", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).filter("_p = 1").drop("_p")
    return table.unionByName(first.join(table.select(*key), key, "left_anti"))


def upsert_counters(table: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """Counters of ``table`` (key, messages, passes, first_seen, last_seen) with the changes of a batch added."""
    change = changes.groupBy(key).agg(F.count("*").alias("m"), F.count_if("passed").alias("p"), F.min("seen").alias("f"), F.max("seen").alias("l"))
    joined = table.join(change, key, "full_outer")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return joined.select(key, (zero("messages") + zero("m")).alias("messages"), (zero("passes") + zero("p")).alias("passes"), F.least("first_seen", "f").alias("first_seen"), F.greatest("last_seen", "l").alias("last_seen"))


def patched(table: DataFrame, patches: DataFrame, key: str, columns: list[str]) -> tuple[DataFrame, DataFrame]:
    """(table with the patches' non-null values, one row for each changed field: key, field, before, after)."""
    new = patches.select(key, *(F.col(c).alias(f"_{c}") for c in columns))
    joined = table.join(new, key, "left")
    after = joined.select(*(F.coalesce(f"_{c}", c).alias(c) if c in columns else F.col(c) for c in table.columns))
    fields = F.explode(F.array(*(F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("before"), F.coalesce(f"_{c}", c).cast("string").alias("after")) for c in columns)))
    changed = joined.select(key, fields.alias("x")).select(key, "x.*").filter(~F.col("before").eqNullSafe(F.col("after")))
    return after, changed


def illegal_transitions(history: DataFrame, allowed: list[tuple[str, str]], key: str, order: list[str]) -> DataFrame:
    """Steps from one status to another that isn't allowed; staying is no step."""
    steps = history.withColumn("before", F.lag("status").over(Window.partitionBy(key).orderBy(*order)))
    pairs = reduce(Column.__or__, ((F.col("before") == a) & (F.col("status") == b) for a, b in allowed))
    return steps.filter(F.col("before").isNotNull() & (F.col("before") != F.col("status")) & ~pairs)


def keep_best(rows: DataFrame, key: list[str], order: list) -> DataFrame:
    return rows.withColumn("_p", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).filter("_p = 1").drop("_p")


def chained(rows: DataFrame, key: str, order: str, fields: list[str]) -> DataFrame:
    """The rows with prev_hash and row_hash: the SHA-256 of the hash before and the fields, along each key's order.

    A task carries one hash from row to row, so a long log takes time, not memory.
    """
    texts = F.concat_ws("|", *(F.coalesce(F.col(f).cast("string"), F.lit("")) for f in fields))
    dealt = rows.withColumn("_fields", texts).repartition(key).sortWithinPartitions(key, order)
    schema = T.StructType([*rows.schema.fields, T.StructField("prev_hash", T.StringType()), T.StructField("row_hash", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        owner, last = object(), ""
        for batch in batches:
            before, after = [], []
            for who, own in zip(batch.column(key).to_pylist(), batch.column("_fields").to_pylist()):
                if who != owner:
                    owner, last = who, ""
                before.append(last)
                last = hashlib.sha256(f"{last}|{own}".encode()).hexdigest()
                after.append(last)
            kept = [batch.column(f.name) for f in rows_schema]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(before, pa.string()), pa.array(after, pa.string())], schema.names)

    rows_schema = rows.schema.fields
    return dealt.mapInArrow(run, schema)


def moving_average(rows: DataFrame, key: str, order: list[str], value: str, weight: float) -> DataFrame:
    """key, ema: the exponential average along each key's order, the first value taken whole, nulls left out. A task carries one number on."""
    dealt = rows.filter(F.col(value).isNotNull()).select(key, F.col(value).cast("double").alias("_v"), *order).repartition(key).sortWithinPartitions(key, *order).select(key, "_v")
    schema = T.StructType([rows.schema[key], T.StructField("ema", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        owner = average = nothing = object()
        for batch in batches:
            done: list[tuple] = []
            for who, x in zip(batch.column(key).to_pylist(), batch.column("_v").to_pylist()):
                if who != owner:
                    done += [] if owner is nothing else [(owner, average)]
                    owner, average = who, x
                else:
                    average = weight * x + (1 - weight) * average
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in done], batch.column(key).type), pa.array([a for _, a in done], pa.float64())], schema.names)
            kind = batch.column(key).type
        if owner is not nothing:
            yield pa.RecordBatch.from_arrays([pa.array([owner], kind), pa.array([average], pa.float64())], schema.names)

    return dealt.mapInArrow(run, schema)


def bad_links(chain: DataFrame, key: str, order: str, fields: list[str]) -> DataFrame:
    """Rows of a hash chain whose hash isn't that of their fields and the hash before, or whose link is broken."""
    before = F.coalesce(F.lag("row_hash").over(Window.partitionBy(key).orderBy(order)), F.lit(""))
    right = F.sha2(F.concat_ws("|", "prev_hash", *(F.coalesce(F.col(f).cast("string"), F.lit("")) for f in fields)).cast("binary"), 256)
    return chain.withColumn("_before", before).filter((F.col("prev_hash") != F.col("_before")) | (F.col("row_hash") != right)).drop("_before")


def rule_states(outcomes: DataFrame) -> DataFrame:
    """State of each rule after its outcomes in turn (rule_id, seq, ok): pending, active from 3, trusted from 10
    successes; inactive from 3 failures or, after the third outcome, under 0.7 successes. Inactive is final."""
    ok = F.coalesce(F.col("ok"), F.lit(False)).cast("int")
    so_far = Window.partitionBy("rule_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    counted = outcomes.select("rule_id", F.sum(ok).over(so_far).alias("_good"), F.sum(1 - ok).over(so_far).alias("_bad"))
    n = F.col("_good") + F.col("_bad")
    worse = (F.col("_bad") >= 3) | ((n >= 3) & (F.col("_good") < 0.7 * n))
    # Counts only grow, so the last ones are the largest, and the state follows from them unless a limit was crossed.
    last = counted.groupBy("rule_id").agg(F.max("_good").cast("int").alias("good"), F.max("_bad").cast("int").alias("bad"), F.max(worse).alias("_worse"))
    state = F.when(F.col("_worse"), "inactive").when(F.col("good") >= 10, "trusted").when(F.col("good") >= 3, "active").otherwise("pending")
    return last.select("rule_id", "good", "bad", state.alias("state"))


def upsert(table: DataFrame, rows: DataFrame, key: list[str]) -> DataFrame:
    """The table with ``rows`` in place of those with their keys; rows have one row for a key."""
    return table.join(rows.select(*key), key, "left_anti").unionByName(rows.select(*table.columns))


def transitioned(table: DataFrame, changes: DataFrame, key: str, allowed: list[tuple[str, str]]) -> DataFrame:
    """The table with the asked statuses (key, to) where the step is allowed; others stay."""
    legal = reduce(Column.__or__, ((F.col("status") == a) & (F.col("to") == b) for a, b in allowed))
    joined = table.join(changes.select(key, "to"), key, "left")
    return joined.select(*(F.when(F.coalesce(legal, F.lit(False)), F.col("to")).otherwise(F.col(c)).alias(c) if c == "status" else F.col(c) for c in table.columns))


def retagged(bridge: DataFrame, add: DataFrame, remove: DataFrame) -> DataFrame:
    """Pairs of a payment and a tag, each once, with those to add and without those to remove."""
    key = ["txn_id", "tag_id"]
    return bridge.select(*key).unionByName(add.select(*key)).distinct().join(remove.select(*key), key, "left_anti")


def newest(listing: DataFrame, group: list[str], order: list, keep: int) -> DataFrame:
    """The ``keep`` newest entries of each group: what a pruning leaves."""
    return listing.withColumn("_p", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).filter(F.col("_p") <= keep).drop("_p")


def batch_eta(items: DataFrame, batch: str) -> DataFrame:
    """``batch``, eta_seconds: the mean of the finished items that were timed, for each that isn't finished; null without one."""
    return items.groupBy(batch).agg(F.round(F.avg(F.when(F.col("finished"), F.col("seconds"))) * F.count_if(~F.col("finished")), 3).alias("eta_seconds"))


def manual_observations(entries: DataFrame) -> DataFrame:
    """Entries made by hand as observations, which are sure; those without an amount are none."""
    return entries.filter("amount_minor > 0").select(F.concat(F.lit("m-"), "txn_id").alias("obs_id"), "instrument_id", "amount_minor", "currency", "direction", "event_time",
                                                     F.lit(1.0).alias("confidence"), F.lit("manual").alias("source_pipeline"))


def last_rule(lines: DataFrame, rules: DataFrame) -> DataFrame:
    """txn_id, category of the bank's last rule (by its place) whose pattern the description has; lines without one are left out."""
    hits = lines.join(rules, "bank").filter(F.expr("description RLIKE pattern"))
    return hits.groupBy("txn_id").agg(F.max_by("category", "place").alias("category"))
