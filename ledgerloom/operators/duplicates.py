"""Statements that were imported before: the same file, or the same billing cycle, as the file's name or its header tells it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.messages import file_period_end


def duplicate_statements(incoming: DataFrame, known: DataFrame, waiting: DataFrame) -> DataFrame:
    """statement_id and reason (file, name, cycle, or null for a new one) of each row of ``incoming``, the first that holds.

    ``incoming`` has statement_id, file_hash, instrument_id, filename, period_start and period_end; ``known`` the same but for
    the names, and is_duplicate; ``waiting`` the file_hash of statements that couldn't be processed. A file is the same by its
    hash, also where its first import was marked a duplicate; a cycle is that of an instrument's statement that was not. Where
    the name tells a month, the cycle is first looked up by that month. Nulls are alike to nothing.
    """
    hashes = known.select("file_hash").unionByName(waiting.select("file_hash")).filter("file_hash IS NOT NULL").distinct().withColumn("_file", F.lit(True))
    cycles = known.filter(~F.coalesce("is_duplicate", F.lit(False))).select("instrument_id", F.col("period_start").cast("date").alias("_from"), F.col("period_end").cast("date").alias("_to")).distinct()
    rows = incoming.withColumn("_month_end", file_period_end(F.col("filename"))).withColumn("_month", F.trunc("_month_end", "month"))
    named = cycles.select("instrument_id", F.col("_from").alias("_month"), F.col("_to").alias("_month_end"), F.lit(True).alias("_named"))
    told = cycles.select("instrument_id", F.col("_from").alias("_start"), F.col("_to").alias("_end"), F.lit(True).alias("_told"))
    rows = rows.withColumns({"_start": F.col("period_start").cast("date"), "_end": F.col("period_end").cast("date")})
    joined = rows.join(hashes, "file_hash", "left").join(named, ["instrument_id", "_month", "_month_end"], "left").join(told, ["instrument_id", "_start", "_end"], "left")
    return joined.select("statement_id", F.when(F.col("_file"), "file").when(F.col("_named"), "name").when(F.col("_told"), "cycle").alias("reason"))
