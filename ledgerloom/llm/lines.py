"""Removal of line chunks that repeat across documents.

A rolling hash over the hashes of three lines decides after which lines a chunk ends, so an inserted line moves the
boundaries near it only. Chunks of two lines or more that occur elsewhere with the same bytes are removed, but for
their first occurrence in the order of (doc_id, chunk number). DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm.common import documents, durable

#: A chunk has so many lines on average.
MEAN_LINES = 4
#: Multiplier and modulus of the rolling hash over three line hashes.
ROLL_BASE, ROLL_MODULUS = 31, 1000003


def _line_hash(line: Column) -> Column:
    """The first seven hexadecimal digits of the line's MD5 as a number."""
    return F.conv(F.substring(F.md5(line.cast("binary")), 1, 7), 16, 10).cast("long")


def chunk_starts(lines: Column, mean_lines: int = MEAN_LINES, hashes: Column | None = None) -> Column:
    """Indexes, from 0, of the lines that begin a chunk; the line hashes stand in the column _h by default."""
    hashes = F.col("_h") if hashes is None else hashes

    def begins(i: Column) -> Column:
        # The rolling hash of the three lines that end before line i.
        h = [F.get(hashes, i - k) for k in (1, 2, 3)]
        roll = (F.coalesce(h[0], F.lit(0)) + F.coalesce(h[1], F.lit(0)) * ROLL_BASE + F.coalesce(h[2], F.lit(0)) * ROLL_BASE**2) % ROLL_MODULUS
        return (i == 0) | (roll % mean_lines == 0)

    return F.filter(F.sequence(F.lit(0), F.size(lines) - 1), begins)


def _chunk_texts(text: Column, mean_lines: int) -> Column:
    """The texts of the chunks, in turn."""
    # Each list is an argument of a lambda, so that Spark makes it once and not for each of its elements.
    lists = F.transform(F.array(F.split(text, "\n", -1)), lambda lines: F.struct(lines.alias("l"), F.transform(lines, _line_hash).alias("h")))
    cut = F.transform(lists, lambda x: F.struct(x["l"].alias("l"), chunk_starts(x["l"], mean_lines, x["h"]).alias("s")))
    size = lambda x, at, k: F.coalesce(F.get(x["s"], k + 1), F.size(x["l"])) - at
    return F.get(F.transform(cut, lambda x: F.transform(x["s"], lambda at, k: F.array_join(F.slice(x["l"], at + 1, size(x, at, k)), "\n"))), F.lit(0))


def _chunk_hash(chunk: Column) -> Column:
    return F.xxhash64(chunk)


def chunks(docs: DataFrame, *, key: str = "doc_id", text: str = "text", mean_lines: int = MEAN_LINES) -> DataFrame:
    """One row for each chunk: _key, _no, _chunk (its text), without chunks of null texts."""
    made = docs.filter(F.col(text).isNotNull()).select(F.col(key).alias("_key"), _chunk_texts(F.col(text), mean_lines).alias("_c"))
    # Outer, since Spark would otherwise infer a filter on the array and make it twice. No array is empty.
    return made.select("_key", F.posexplode_outer("_c").alias("_no", "_chunk"))


def repeated_chunks(docs: DataFrame, *, key: str = "doc_id", text: str = "text", mean_lines: int = MEAN_LINES) -> DataFrame:
    """(_key, _no) of each chunk of several lines that has an earlier occurrence.

    Hashes find the candidates; then the bytes of all chunks with one hash are compared, as the least and the greatest of
    them, which tasks work out for their own rows first: copies of a common chunk don't meet with their texts.
    """
    place = F.struct("_key", "_no")
    several = chunks(docs, key=key, text=text, mean_lines=mean_lines).filter(F.col("_chunk").contains("\n"))
    hashed = durable(several.select(_chunk_hash(F.col("_chunk")).alias("_hash"), "_key", "_no"), "chunk-hashes")
    # Rows that repeat a key are copies of one document: an occurrence is a (key, number). The table is written, since Spark
    # splits the rows of a hot hash only in a join that no aggregate stands before.
    twice = durable(hashed.groupBy("_hash").agg(F.min(place).alias("_first"), F.max(place).alias("_last")).filter("_first < _last").select("_hash", "_first"), "repeated-hashes")
    candidates = durable(hashed.join(twice, "_hash"), "chunk-candidates")
    asked = candidates.groupBy("_key").agg(F.collect_set("_no").alias("_asked")).withColumnRenamed("_key", "_k")  # the chunk numbers of one document
    named = docs.select(key, text).join(asked.hint("merge"), docs[key].eqNullSafe(asked["_k"])).filter(F.col(text).isNotNull())
    made = named.select(F.col(key).alias("_key"), "_asked", _chunk_texts(F.col(text), mean_lines).alias("_c"))
    spoken = made.select("_key", F.explode_outer(F.transform("_asked", lambda n: F.struct(n.alias("_no"), F.get("_c", n).alias("_chunk")))).alias("x")).select("_key", "x.*")
    compared = spoken.filter(F.col("_chunk").isNotNull()).withColumn("_hash", _chunk_hash(F.col("_chunk")))
    odd = durable(compared.groupBy("_hash").agg(F.min("_chunk").alias("_low"), F.max("_chunk").alias("_high")).filter("_low < _high").select("_hash"), "chunk-collisions")
    found = candidates.join(odd, "_hash", "left_anti").filter(place > F.col("_first")).select("_key", "_no")
    # Chunks that differ under one hash: few, if any. Their texts tell them apart.
    apart = compared.join(odd, "_hash", "left_semi")
    first = apart.groupBy("_chunk").agg(F.min(place).alias("_first"))
    return found.unionByName(apart.join(first, "_chunk").filter(place > F.col("_first")).select("_key", "_no"))


def drop_repeated_chunks(docs: DataFrame, *, key: str = "doc_id", text: str = "text", mean_lines: int = MEAN_LINES,
                         result: str = "dedup") -> DataFrame:
    """Rows of ``docs`` with the kept text and a struct ``result`` (n_lines, n_removed lines, n_chunks removed).

    Null texts stay null and empty texts empty, with nothing removed. Rows that repeat a key lose the same chunks; of
    places with one text the least (key, number) keeps it. A null key is a key like any other. No rows give none. A very
    long text takes time in proportion to its lines, in one task. Other columns are kept; one named like ``result`` is
    replaced. A document that loses all its chunks has an empty text.
    """
    columns = [c for c in docs.columns if c != result]
    gone = repeated_chunks(docs, key=key, text=text, mean_lines=mean_lines)
    lost = gone.groupBy("_key").agg(F.collect_set("_no").alias("_gone"))  # the chunk numbers of one document
    joined = docs.select(*columns).join(lost.hint("merge"), docs[key].eqNullSafe(lost["_key"]), "left")
    touched = joined.filter(F.col("_gone").isNotNull()).withColumn("_l", F.split(text, "\n", -1)).withColumn("_h", F.transform("_l", _line_hash))
    touched = touched.withColumn("_s", chunk_starts(F.col("_l"), mean_lines))
    kept = F.array_except(F.sequence(F.lit(0), F.size("_s") - 1), "_gone")
    spans = F.transform(kept, lambda k: F.struct(F.get("_s", k).alias("a"), (F.coalesce(F.get("_s", k + 1), F.size("_l")) - F.get("_s", k)).alias("n")))
    touched = touched.withColumn("_kept", spans)
    n_kept = F.aggregate("_kept", F.lit(0), lambda n, c: n + c["n"])
    new_text = F.array_join(F.flatten(F.transform("_kept", lambda c: F.slice(F.col("_l"), c["a"] + 1, c["n"]))), "\n")
    done = touched.withColumn(text, new_text).withColumn(
        result, F.struct(F.size("_l").cast("long").alias("n_lines"), (F.size("_l") - n_kept).cast("long").alias("n_removed"), (F.size("_s") - F.size("_kept")).cast("long").alias("n_chunks")))
    # A filter on the new text must not be pushed into it, where the lists above would be made anew for each line:
    # the optimizer moves no filter below a column that isn't deterministic.
    done = done.withColumn("_row", F.monotonically_increasing_id()).filter("_row >= 0")
    whole = joined.filter(F.col("_gone").isNull()).withColumn(
        result, F.struct(F.coalesce(F.size(F.split(text, "\n", -1)), F.lit(0)).cast("long").alias("n_lines"), F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_chunks")))
    return whole.select(*columns, result).unionByName(done.select(*columns, result))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = drop_repeated_chunks(documents(spark, sf_dir).select("doc_id", "text"))
    return out.select("doc_id", "dedup.*", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


OP5_SQL = """
WITH l AS (
  SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL),
h AS (
  SELECT doc_id, ls, list_transform(ls, lambda x: CAST('0x' || substr(md5(x), 1, 7) AS BIGINT)) AS hs FROM l),
line AS (
  SELECT doc_id, k, ls[k] AS line,
    k = 1 OR ((CASE WHEN k > 1 THEN hs[k - 1] ELSE 0 END + CASE WHEN k > 2 THEN hs[k - 2] ELSE 0 END * 31 + CASE WHEN k > 3 THEN hs[k - 3] ELSE 0 END * 961) % 1000003) % 4 = 0 AS begins
  FROM (SELECT doc_id, ls, hs, unnest(range(1, len(ls) + 1)) AS k FROM h)),
numbered AS (
  SELECT doc_id, k, line, sum(CASE WHEN begins THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY k) AS no FROM line),
chunk AS (
  SELECT doc_id, no, count(*) AS n, string_agg(line, chr(10) ORDER BY k) AS body FROM numbered GROUP BY doc_id, no),
gone AS (
  SELECT doc_id, no, n FROM (SELECT *, row_number() OVER (PARTITION BY body ORDER BY doc_id, no) AS place FROM chunk WHERE n >= 2) WHERE place > 1),
kept AS (
  SELECT c.doc_id, string_agg(c.body, chr(10) ORDER BY c.no) AS body FROM chunk c ANTI JOIN gone g ON c.doc_id = g.doc_id AND c.no = g.no GROUP BY c.doc_id),
lost AS (SELECT doc_id, sum(n) AS lines, count(*) AS chunks FROM gone GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(len(string_split(d.text, chr(10))), 0) AS BIGINT) AS n_lines, CAST(coalesce(lines, 0) AS BIGINT) AS n_removed,
  CAST(coalesce(chunks, 0) AS BIGINT) AS n_chunks, sha256(coalesce(body, '')) AS kept_sha256
FROM documents d LEFT JOIN kept USING (doc_id) LEFT JOIN lost USING (doc_id)
"""
