"""Importance resampling towards a target distribution, over a dictionary of distinct features.

One pass over the texts counts each document's n-grams and, for each shard (the documents that a task holds at a time),
each distinct n-gram once. Spark sums the shards' counts into a dictionary of distinct n-grams, hashes each of these
once, and adds up the buckets of the hash for the corpus and for the target. A bucket's gain is joined back to the
dictionary, the dictionary to the shards' n-grams, and each shard's gains to its documents' counts, which never leave
their arrays. Gumbel noise from the key makes the highest scores a weighted draw without replacement.
"""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.llm.common import alnum_words, documents, durable, give_back, sub_batches

WORDS = 1
BUCKETS = 10_000
SEED = 2024
PERCENT = 10
LEAST_WORDS = 20
#: Bytes of text whose documents are one shard; a longer text is a shard of its own.
SHARD_BYTES = 8 << 20
#: Distinct n-grams of a shard that one row carries.
PIECE = 4096

_INTS = T.ArrayType(T.IntegerType(), False)


def features(text: bytes | None, words: int = WORDS) -> Counter:
    """Counts of the runs of 1 to ``words`` consecutive words, joined by blanks."""
    found = alnum_words(text)
    counts = Counter(found)
    for n in range(2, words + 1):
        counts.update(b" ".join(found[k : k + n]) for k in range(len(found) - n + 1))
    return counts


def count_features(docs: DataFrame, key: str, text: str, words: int) -> DataFrame:
    """Rows of two kinds, by _shard: for a document _key, _n, _n_words, _ids and _counts; for some of the shard's n-grams _start, _grams, _totals."""
    schema = T.StructType([
        T.StructField("_shard", T.StringType()), T.StructField("_key", T.LongType()), T.StructField("_n", T.LongType()), T.StructField("_n_words", T.LongType()), T.StructField("_ids", _INTS), T.StructField("_counts", _INTS),
        T.StructField("_start", T.IntegerType()), T.StructField("_grams", T.ArrayType(T.BinaryType(), False)), T.StructField("_totals", T.ArrayType(T.LongType(), False)),
    ])
    arrow = pa.schema([("_shard", pa.string()), ("_key", pa.int64()), ("_n", pa.int64()), ("_n_words", pa.int64()), ("_ids", pa.list_(pa.int32())), ("_counts", pa.list_(pa.int32())),
                       ("_start", pa.int32()), ("_grams", pa.list_(pa.binary())), ("_totals", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # A name of its own for each attempt: where a task runs twice, its two outcomes don't mix.
        task = f"{TaskContext.get().partitionId()}-{uuid.uuid4().hex[:8]}"
        for no, batch in enumerate(sub_batches(batches, "_text", SHARD_BYTES)):
            numbers: dict[bytes, int] = {}
            ids, counts, ends, n, n_words = [], [], [0], [], []
            for text in batch.column("_text").cast(pa.binary()):
                raw = text.as_py()
                found = features(raw, words)
                ids.append(np.fromiter((numbers.setdefault(g, len(numbers)) for g in found), np.int32, len(found)))
                counts.append(np.fromiter(found.values(), np.int32, len(found)))
                ends.append(ends[-1] + len(found))
                n.append(found.total())
                n_words.append(n[-1] if words == 1 else len(alnum_words(raw)))
            ids, counts = np.concatenate(ids), np.concatenate(counts)
            size, none = batch.num_rows, lambda k, kind: pa.nulls(k, kind)
            list_of = lambda x: pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(x))
            shard = f"{task}-{no}"
            yield pa.RecordBatch.from_arrays([
                pa.array([shard] * size), batch.column("_key"), pa.array(n, pa.int64()), pa.array(n_words, pa.int64()), list_of(ids), list_of(counts),
                *(none(size, arrow.field(c).type) for c in ("_start", "_grams", "_totals"))], schema=arrow)
            totals = np.zeros(len(numbers), np.int64)
            np.add.at(totals, ids, counts)
            grams = list(numbers)
            for a in range(0, len(grams), PIECE):
                yield pa.RecordBatch.from_arrays([
                    pa.array([shard]), *(none(1, arrow.field(c).type) for c in ("_key", "_n", "_n_words", "_ids", "_counts")), pa.array([a], pa.int32()),
                    pa.array([grams[a : a + PIECE]], pa.list_(pa.binary())), pa.array([totals[a : a + PIECE]], pa.list_(pa.int64()))], schema=arrow)

    return docs.select(F.col(key).cast("long").alias("_key"), F.col(text).alias("_text")).mapInArrow(run, schema)


def _grams(counted: DataFrame) -> DataFrame:
    """_shard, _id, _gram, _total: each distinct n-gram of a shard once."""
    pieces = counted.filter(F.col("_grams").isNotNull()).select("_shard", "_start", F.posexplode(F.arrays_zip("_grams", "_totals")).alias("_at", "_x"))
    return pieces.select("_shard", (F.col("_start") + F.col("_at")).alias("_id"), F.col("_x._grams").alias("_gram"), F.col("_x._totals").alias("_total"))


def dictionary(counted: DataFrame, buckets: int) -> DataFrame:
    """_gram, _count, _bucket: each distinct n-gram of the corpus, hashed once."""
    total = _grams(counted).groupBy("_gram").agg(F.sum("_total").alias("_count"))
    return total.withColumn("_bucket", F.pmod(F.crc32("_gram"), F.lit(buckets)).cast("int"))


def bucket_gains(corpus: DataFrame, target: DataFrame, buckets: int) -> DataFrame:
    """_bucket, _gain for the buckets that the corpus has: at most ``buckets`` rows."""
    s = corpus.groupBy("_bucket").agg(F.sum("_count").alias("_s"))
    t = target.groupBy("_bucket").agg(F.sum("_count").alias("_t"))
    # Both totals are sums over at most ``buckets`` rows.
    all_s, all_t = (x.agg(F.coalesce(F.sum(c), F.lit(0))).first()[0] for x, c in ((s, "_s"), (t, "_t")))
    t_here = F.coalesce(F.col("_t"), F.lit(0)) + 1
    ratio = t_here.cast("double") * F.lit(float(all_s + buckets)) / ((F.col("_s") + 1).cast("double") * F.lit(float(all_t + buckets)))
    return s.join(t, "_bucket", "left").select("_bucket", F.floor(1000 * F.log(ratio)).alias("_gain"))


def _weighed(counted: DataFrame, gains: DataFrame) -> DataFrame:
    """_key, _n, _n_words, _weight of each document; ``gains`` has _shard, _id, _gain. A task holds a shard."""
    schema = T.StructType([T.StructField(c, T.LongType()) for c in ("_key", "_n", "_n_words", "_weight")])
    arrow = pa.schema([(c, pa.int64()) for c in schema.names])

    def weigh(docs: pa.Table, known: pa.Table) -> pa.Table:
        gain = np.zeros(known.num_rows, np.int64)
        gain[known.column("_id").to_numpy()] = known.column("_gain").to_numpy()
        lists = docs.column("_ids").combine_chunks()
        sizes = np.diff(lists.offsets.to_numpy())
        terms = gain[lists.flatten().to_numpy()] * docs.column("_counts").combine_chunks().flatten().to_numpy()
        sums = np.concatenate(([0], np.cumsum(terms)))[np.concatenate(([0], np.cumsum(sizes)))]
        total, n = np.diff(sums), docs.column("_n").to_numpy()
        weight = np.where(n > 0, total // np.maximum(n, 1), 0)
        out = pa.table([docs.column("_key"), docs.column("_n"), docs.column("_n_words"), pa.array(weight)], schema=arrow)
        del terms, sums, lists
        give_back()
        return out

    docs = counted.filter(F.col("_grams").isNull()).select("_shard", "_key", "_n", "_n_words", "_ids", "_counts")
    return docs.groupBy("_shard").cogroup(gains.groupBy("_shard")).applyInArrow(weigh, schema)


def noise(key: Column, seed: int) -> Column:
    """floor(-1000 ln(-ln(u))) with u from the first 32 bits of sha256("seed:key")."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))).cast("binary"), 256), 1, 8), 16, 10).cast("long")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296)))


def draw(scored: DataFrame, n: int, *, score: str = "score", key: str = "doc_id", rank: str = "rank") -> DataFrame:
    """``scored`` with ``rank``, 1 to ``n`` for the highest scores of rows with _may, ties to the smaller key; null for others.

    ``scored`` is a written table. Scores are whole numbers of a bounded range, so there are some 100,000 different ones at
    most: their counts give each score its first rank, and rows are numbered within a score only.
    """
    tally = scored.filter("_may").groupBy(F.col(score).alias("_s")).agg(F.count("*").alias("_c"))
    higher = Window.orderBy(F.desc("_s")).rowsBetween(Window.unboundedPreceding, -1)
    first = durable(tally.withColumn("_before", F.coalesce(F.sum("_c").over(higher), F.lit(0))).filter(F.col("_before") < n).select("_s", "_before"), "draw-scores")
    joined = scored.join(F.broadcast(first), F.col("_may") & (F.col(score) == F.col("_s")), "left")
    place = F.col("_before") + F.row_number().over(Window.partitionBy("_s").orderBy(F.asc_nulls_last(key)))
    drawn = joined.filter("_before IS NOT NULL").withColumn(rank, place).withColumn(rank, F.when(F.col(rank) <= n, F.col(rank)))
    rest = joined.filter("_before IS NULL").withColumn(rank, F.lit(None).cast("long"))
    return drawn.unionByName(rest).drop("_s", "_before", "_may")


def resample(docs: DataFrame, target: DataFrame, *, percent: int = PERCENT, least_words: int = LEAST_WORDS, words: int = WORDS, buckets: int = BUCKETS,
             seed: int = SEED, key: str = "doc_id", text: str = "text", target_text: str = "text") -> DataFrame:
    """``key``, n_features, weight, score, rank: ``percent`` of the documents of ``least_words`` words or more, drawn towards ``target``.

    A feature is a run of 1 to ``words`` words (ASCII letters, digits, code points over 127; A-Z lower-cased). The weight is
    the mean gain of a document's features, rounded down, and 0 without any; the score adds noise from seed and key. Null and empty
    texts have no features; a null key has the noise of an empty one and comes last among ties. Rows that repeat a key are
    documents of their own, with equal noise. Without documents there are no rows; an empty target draws away from common
    features. A very long text is a shard of its own. Other columns aren't read. ``key`` is a whole number.
    """
    counted = durable(count_features(docs, key, text, words), "features")
    grams = durable(dictionary(counted, buckets), "dictionary")
    wanted = durable(dictionary(count_features(target.withColumn("_none", F.lit(None).cast("long")), "_none", target_text, words), buckets), "target-dictionary")
    gains = durable(bucket_gains(grams, wanted, buckets), "gains")
    by_gram = grams.select("_gram", "_bucket").join(F.broadcast(gains), "_bucket").select("_gram", "_gain")  # ``buckets`` rows at most
    by_shard = durable(_grams(counted).select("_shard", "_id", "_gram").join(by_gram, "_gram").select("_shard", "_id", "_gain"), "shard-gains")
    scored = _weighed(counted, by_shard).select(F.col("_key").alias(key), F.col("_n").alias("n_features"), F.col("_weight").alias("weight"), (F.col("_weight") + noise(F.col("_key"), seed)).alias("score"), (F.col("_n_words") >= least_words).alias("_may"))
    scored = durable(scored, "scored")
    may = scored.filter("_may").count()
    return draw(scored, percent * may // 100, key=key)


def op12_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


# CRC-32 by its polynomial, a byte at a time, over the distinct words.
OP12_SQL = r"""
WITH low AS (
  SELECT 's' AS kind, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents
  UNION ALL
  SELECT 't', NULL, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') FROM benchmark),
tab AS (
  SELECT list(c ORDER BY i) AS tab
  FROM (SELECT i, list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM (SELECT CAST(unnest(range(256)) AS BIGINT) AS i))),
word AS (SELECT kind, w, count(*) AS n FROM (SELECT kind, unnest(ws) AS w FROM low) GROUP BY kind, w),
raw AS (SELECT w, hex(encode(w)) AS h FROM (SELECT DISTINCT w FROM word)),
bytes AS (SELECT w, list_transform(range(0, len(h) // 2), lambda k: CAST('0x' || substr(h, CAST(2 * k + 1 AS BIGINT), 2) AS BIGINT)) AS b FROM raw),
code AS (
  SELECT w, xor(list_reduce(list_concat([4294967295], b), lambda c, x: xor(c >> 8, tab[CAST((xor(c, x) & 255) + 1 AS BIGINT)])), 4294967295) % 10000 AS bucket FROM bytes, tab),
sums AS (SELECT bucket, CAST(sum(CASE WHEN kind = 's' THEN n ELSE 0 END) AS BIGINT) AS s, CAST(sum(CASE WHEN kind = 't' THEN n ELSE 0 END) AS BIGINT) AS t FROM word JOIN code USING (w) GROUP BY bucket),
total AS (SELECT CAST(sum(s) AS BIGINT) AS all_s, CAST(sum(t) AS BIGINT) AS all_t FROM sums),
gain AS (
  SELECT w, CAST(floor(1000 * ln(CAST(t + 1 AS DOUBLE) * (all_s + 10000) / (CAST(s + 1 AS DOUBLE) * (all_t + 10000)))) AS BIGINT) AS g FROM code JOIN sums USING (bucket), total),
doc AS (SELECT doc_id, CAST(coalesce(len(ws), 0) AS BIGINT) AS n FROM low WHERE kind = 's'),
summed AS (SELECT doc_id, CAST(sum(g) AS BIGINT) AS total_gain FROM (SELECT doc_id, unnest(ws) AS w FROM low WHERE kind = 's') JOIN gain USING (w) GROUP BY doc_id),
weighed AS (
  SELECT doc_id, n, CASE WHEN n = 0 THEN 0 ELSE (total_gain - ((total_gain % n) + n) % n) // n END AS weight, CAST('0x' || substr(sha256('2024:' || doc_id), 1, 8) AS BIGINT) AS h FROM doc LEFT JOIN summed USING (doc_id)),
scored AS (SELECT doc_id, n, weight, weight + CAST(floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS score FROM weighed),
may AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS place FROM scored WHERE n >= 20),
drawn AS (SELECT doc_id, place FROM may WHERE place <= 10 * (SELECT count(*) FROM may) // 100)
SELECT doc_id, n AS n_features, CAST(weight AS BIGINT) AS weight, CAST(score AS BIGINT) AS score, place AS rank FROM scored LEFT JOIN drawn USING (doc_id)
"""
