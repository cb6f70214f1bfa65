"""Corpus preparation, from raw documents to packed training sequences.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before kept. All but the last return the columns
of ``documents``; a stage that changes a text sets n_chars, where there is such a column, to its new length.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm import decontaminate, language, lines, near, packing
from ledgerloom.llm.common import durable, scratch, work_dir

#: Least share of a text's letter n-grams that its language must have.
LEAST_SCORE = 0.3
ORACLE_SQL = None  # n-gram filters, signatures and tokenizers aren't expressible; tests/llm compare with brute force


def _measured(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else docs


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, or in none of the labelled languages, go. Without any label nothing goes."""
    model = language.train(docs)
    if not model.languages:
        return docs
    found = language.predict(docs, model, lang_out="_lang_pred", score_out="_lang_score")
    return found.filter((F.col("_lang_pred") != language.UNKNOWN) & (F.col("_lang_score") >= LEAST_SCORE)).select(*docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated chunks of lines are cut; a document that has nothing else goes."""
    out = lines.drop_repeated_chunks(docs, result="_dedup")
    left = out.filter((F.col("_dedup.n_removed") == 0) | (F.length("text") > 0))
    return _measured(left).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near duplicates one text of the least id stays, once.

    An id that names several texts keeps each of them that stands first in its own class. Rows alike in id and text are
    one document: of these the row stays whose other columns come first as JSON. Without an id or a word each row
    is a class of its own, but for rows alike in id and text.
    """
    found = durable(near.near_duplicates(docs), "near")
    stay = found.filter("first").groupBy(F.col("doc_id").alias("_id"), F.col("text_id").alias("_text_id")).agg(F.count("*").alias("_rows"))
    # The row as one column, so that no name of its own clashes.
    rows = docs.select(F.struct(*docs.columns).alias("_row"), F.col("doc_id").alias("_doc"), near.text_id(F.col("text")).alias("_text"))
    joined = rows.join(stay, F.col("_doc").eqNullSafe(F.col("_id")) & F.col("_text").eqNullSafe(F.col("_text_id")))
    others = F.struct(F.lit(0), *(F.col("_row")[c] for c in docs.columns if c not in ("doc_id", "text")))
    one = joined.filter("_rows > 1").groupBy("_doc", "_text").agg(F.min_by("_row", F.to_json(others)).alias("_row"))
    return joined.filter("_rows = 1").select("_row.*").unionByName(one.select("_row.*"))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of the benchmark are cut out of the texts; the documents stay."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return _measured(decontaminate.find_contamination(docs, benchmark, result="_contamination", cut=True)).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, packing.tokenizer_file())


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packed pieces of ``documents``. A stage's working tables are removed when its output is written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = work_dir(spark, f"pipeline-{name}")
        with scratch(spark):
            docs = durable(stage(spark, docs, sf_dir), name, path)
    return STAGES[-1][1](spark, docs, sf_dir)
