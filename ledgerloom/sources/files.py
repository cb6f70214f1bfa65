"""Readers and writers: declared schemas, landing folders, archives."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

EVENT = T.StructType([
    T.StructField("event_id", T.LongType()), T.StructField("ts", T.TimestampNTZType()), T.StructField("user_id", T.LongType()),
    T.StructField("event_type", T.StringType()), T.StructField("value", T.DoubleType()), T.StructField("props", T.StringType()),
])
MESSAGE = T.StructType([
    T.StructField("id", T.StringType()), T.StructField("thread_id", T.StringType()), T.StructField("internal_date", T.LongType()), T.StructField("snippet", T.StringType()),
    T.StructField("parts", T.ArrayType(T.StructType([T.StructField("mime", T.StringType()), T.StructField("body", T.StringType()), T.StructField("filename", T.StringType())]))),
])
PDF_LIMIT = 5 << 20


def read_table(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    return (spark.read.schema(schema) if schema else spark.read).parquet(path)


def read_messages(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines of messages from a landing folder; lines that don't parse are rows of nulls."""
    return spark.read.schema(MESSAGE).json(path)


def message_bodies(messages: DataFrame) -> DataFrame:
    """id, the first plain text, the first HTML, the names of the PDF parts."""
    first = lambda mime: F.try_element_at(F.filter("parts", lambda p: p["mime"] == mime), F.lit(1))["body"]
    return messages.select("id", first("text/plain").alias("plain"), first("text/html").alias("html"), F.transform(F.filter("parts", lambda p: p["mime"] == "application/pdf"), lambda p: p["filename"]).alias("pdfs"))


def read_pdfs(spark: SparkSession, path: str) -> DataFrame:
    """path, SHA-256 and validity (magic bytes, size) of PDF files; larger files aren't loaded."""
    files = spark.read.format("binaryFile").load(path)
    return files.select("path", "length", F.sha2("content", 256).alias("sha256"), ((F.col("length") <= PDF_LIMIT) & (F.substring(F.col("content"), 1, 4) == F.lit(b"%PDF"))).alias("valid"))


def archive_rows(ledger: DataFrame, archived: DataFrame, now: str, years: int) -> DataFrame:
    """Rows older than ``years`` that aren't archived yet, with their year."""
    old = ledger.filter(F.col("best_event_time") < F.timestamp_add("YEAR", F.lit(-years), F.lit(now).cast("timestamp_ntz")))
    return old.join(archived.select("txn_id"), "txn_id", "left_anti").withColumn("year", F.year("best_event_time"))


def write_archive(ledger: DataFrame, path: str, archived: DataFrame, now: str, years: int = 5, files: int = 16) -> None:
    """Append to a folder for each year, ``files`` files each at most, so that no year is one task."""
    archive_rows(ledger, archived, now, years).repartition("year", F.pmod(F.xxhash64("txn_id"), F.lit(files))).write.mode("append").partitionBy("year").parquet(path)


def export(tables: dict[str, DataFrame], folder: str) -> None:
    for name, rows in tables.items():
        rows.write.mode("overwrite").parquet(f"{folder}/{name}")


def empty_like(rows: DataFrame) -> DataFrame:
    return rows.sparkSession.createDataFrame([], rows.schema)


def query_chunks(domains: DataFrame, limit: int) -> DataFrame:
    """Search terms of at most ``limit`` characters that together name every domain: (chunk, terms, length).

    Domains are dealt into chunks by their running length, in order; a range of them is numbered apart from the others.
    """
    terms = domains.distinct().select("domain", (F.length("domain") + F.length(F.lit(" OR from:"))).alias("n"))
    # The sender registry is a small dimension: one running sum over it.
    run = terms.withColumn("chunk", F.floor((F.sum("n").over(Window.orderBy("domain")) - 1) / (limit - F.max("n").over(Window.partitionBy()))))
    return run.groupBy("chunk").agg(F.array_join(F.transform(F.array_sort(F.collect_list("domain")), lambda d: F.concat(F.lit("from:"), d)), " OR ").alias("terms")).withColumn("length", F.length("terms"))
