"""Ranked lexical search by MaxScore over shards of documents.

The queries come in blocks. For each block one pass over the texts writes a forward index of the block's terms; Spark
counts from it how many documents hold each term. Then each task inverts a shard of the index at a time and finds each
query's best documents: terms are ordered by the most that they can add to a score, the lists of those that can't lift
a document over the least of the best so far are not read but probed, from the largest bound down, and only while a
document can still qualify. A task carries its best documents from shard to shard, so its threshold rises.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.llm.common import alnum_words, documents, durable, sub_batches

BEST = 20
#: Share of a document's length in its damping, in hundredths.
SLOPE = 25
#: Different query terms that are searched in one pass; more queries take several passes.
QUERY_BLOCK = 200_000
#: Entries of the index that a task inverts at a time.
SHARD_POSTINGS = 2_000_000
#: A query's finds are first ranked in so many parts.
PARTS = 64


@dataclass
class Query:
    key: object
    terms: np.ndarray  # numbers of the terms
    weights: np.ndarray  # weight of each, times how often the query has it


class Shard:
    """The inverted lists of some documents."""

    def __init__(self, sizes: np.ndarray, terms: np.ndarray, impacts: np.ndarray):
        """``sizes`` has how many of ``terms`` (with their ``impacts``) each document has."""
        order = np.argsort(terms, kind="stable")
        self.docs = np.repeat(np.arange(len(sizes)), sizes)[order]
        self.impacts = impacts[order]
        self.terms, self.starts = np.unique(terms[order], return_index=True)
        self.ends = np.append(self.starts[1:], len(order))
        self.most = np.maximum.reduceat(self.impacts, self.starts) if len(order) else self.impacts
        self.scores = np.zeros(len(sizes), np.int64)

    def search(self, query: Query, least: int) -> tuple[np.ndarray, np.ndarray]:
        """(documents, scores) of all that score ``least`` or more; ``least`` is 1 at least."""
        at = np.searchsorted(self.terms, query.terms)
        held = at < len(self.terms)
        held[held] = self.terms[at[held]] == query.terms[held]
        at, weights = at[held], query.weights[held]
        bounds = weights * self.most[at]
        order = np.argsort(bounds, kind="stable")
        at, weights = at[order], weights[order]
        below = np.concatenate(([0], np.cumsum(bounds[order])))  # what the terms before each can add together
        essential = int(np.searchsorted(below[1:], least, "left"))  # no document qualifies by the terms before it alone
        for t, w in zip(at[essential:].tolist(), weights[essential:].tolist()):
            a, b = self.starts[t], self.ends[t]
            self.scores[self.docs[a:b]] += w * self.impacts[a:b]  # a document is in a list once
        found = np.flatnonzero(self.scores)
        scores = self.scores[found]
        self.scores[found] = 0
        for k in range(essential - 1, -1, -1):
            can = scores + below[k + 1] >= least
            found, scores = found[can], scores[can]
            if not len(found):
                break
            a, b = self.starts[at[k]], self.ends[at[k]]
            place = np.minimum(np.searchsorted(self.docs[a:b], found), b - a - 1) + a
            scores = scores + np.where(self.docs[place] == found, weights[k] * self.impacts[place], 0)
        can = scores >= least
        return found[can], scores[can]


class Best:
    """The best documents of a query so far: higher scores, then smaller keys, then rows without a key."""

    def __init__(self, size: int):
        self.size, self.scores, self.keys, self.bare = size, np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, bool)

    @property
    def least(self) -> int:
        """A document with a smaller score isn't among the best."""
        return max(1, int(self.scores[-1])) if len(self.scores) == self.size else 1

    def add(self, scores: np.ndarray, keys: np.ndarray, bare: np.ndarray) -> None:
        scores, keys, bare = np.append(self.scores, scores), np.append(self.keys, keys), np.append(self.bare, bare)
        first = np.lexsort((keys, bare, -scores))[: self.size]
        self.scores, self.keys, self.bare = scores[first], keys[first], bare[first]


def impact(tf: np.ndarray, length: np.ndarray, n_docs: int, n_terms: int, slope: int = SLOPE) -> np.ndarray:
    """What one occurrence count adds for each unit of a term's weight; whole numbers, divisions round down."""
    damping = 100 - slope + slope * length * n_docs // n_terms
    return 1_000_000_000 * tf // (1000 * tf + 12 * damping)


def _counted(docs: DataFrame, key: str, text: str, vocabulary) -> DataFrame:
    """_key, _n (terms of the text), _terms and _tf (numbers and counts of those in the vocabulary) for texts with a term."""
    schema = T.StructType([T.StructField("_key", T.LongType()), T.StructField("_n", T.LongType()), T.StructField("_terms", T.ArrayType(T.IntegerType(), False)), T.StructField("_tf", T.ArrayType(T.IntegerType(), False))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = vocabulary.value
        for batch in sub_batches(batches, "_text"):
            rows, sizes, ends, terms, tf = [], [], [0], [], []
            for k, text in enumerate(batch.column("_text").cast(pa.binary())):
                counts = Counter(alnum_words(text.as_py()))
                if counts:
                    held = [(known[w], c) for w, c in counts.items() if w in known]
                    rows.append(k)
                    sizes.append(counts.total())
                    terms += [t for t, _ in held]
                    tf += [c for _, c in held]
                    ends.append(len(terms))
            ends = pa.array(ends, pa.int32())
            lists = [pa.ListArray.from_arrays(ends, pa.array(x, pa.int32())) for x in (terms, tf)]
            yield pa.RecordBatch.from_arrays([batch.column("_key").take(pa.array(rows, pa.int64())), pa.array(sizes, pa.int64()), *lists], schema.names)

    return docs.select(F.col(key).cast("long").alias("_key"), F.col(text).alias("_text")).filter("_text IS NOT NULL").mapInArrow(run, schema)


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ends = np.cumsum(np.diff(batch.column("_terms").offsets.to_numpy()))
        part = ends // SHARD_POSTINGS
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            if b > a:
                yield batch.slice(a, b - a)


def _found(index: DataFrame, queries, n_docs: int, n_terms: int, query_type: T.DataType, query_id: str, best: int, slope: int) -> DataFrame:
    """The best documents of each query in each task: ``query_id``, _key, _score."""
    schema = T.StructType([T.StructField(query_id, query_type), T.StructField("_key", T.LongType()), T.StructField("_score", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked: list[Query] = queries.value
        finds = [Best(best) for _ in asked]
        for batch in _shards(batches):
            sizes = np.diff(batch.column("_terms").offsets.to_numpy())
            flat = lambda name: batch.column(name).flatten().to_numpy().astype(np.int64)
            length = np.repeat(batch.column("_n").to_numpy(), sizes)
            shard = Shard(sizes, flat("_terms"), impact(flat("_tf"), length, n_docs, n_terms, slope))
            bare = batch.column("_key").is_null().to_numpy(zero_copy_only=False)
            keys = batch.column("_key").fill_null(0).to_numpy()
            for query, find in zip(asked, finds):
                docs, scores = shard.search(query, find.least)
                if len(docs):
                    find.add(scores, keys[docs], bare[docs])
        ids = [q.key for q, f in zip(asked, finds) for _ in range(len(f.scores))]
        if ids:
            names = pa.array(ids, pa.int64() if query_type == T.LongType() else pa.string())
            yield pa.RecordBatch.from_arrays([names, pa.array(np.concatenate([f.keys for f in finds]), mask=np.concatenate([f.bare for f in finds])), pa.array(np.concatenate([f.scores for f in finds]))], schema.names)

    return index.filter(F.size("_terms") > 0).mapInArrow(run, schema)


def _blocks(rows: Iterator, size: int) -> Iterator[list[tuple[object, dict[bytes, int]]]]:
    block, terms = [], set()
    for r in rows:
        counts = Counter(alnum_words(b" ".join(r.texts)))
        if block and len(terms | counts.keys()) > size:
            yield block
            block, terms = [], set()
        if counts:
            block.append((r.id, counts))
            terms |= counts.keys()
    if block:
        yield block


def ranked_search(docs: DataFrame, queries: DataFrame, *, best: int = BEST, key: str = "doc_id", text: str = "text", query_id: str = "item_id",
                  query_text: str = "text", slope: int = SLOPE, query_block: int = QUERY_BLOCK) -> DataFrame:
    """``query_id``, rank, ``key``, score: the ``best`` documents of each query with a score over 0.

    Terms are runs of ASCII letters, digits and code points over 127, with A-Z lower-cased. A term's weight is
    floor(1000 ln((2N + 2) / (2df + 1))); a document adds weight * (10^9 tf div (1000 tf + 12 m)) for each occurrence in
    the query, where m is 100 - slope + (slope n N div L). Equal scores are ranked by the smaller key, rows without a key
    last. Null and empty texts have no terms and aren't counted. Rows that repeat a key are documents of their own. Rows
    of ``queries`` that repeat an id and a text count once, different texts of one id are one query; queries without a
    term, or with none that a document holds, have no rows. No documents or no queries give none. A very long text is
    counted whole, in one task. Other columns aren't read, whatever their names. ``key`` is a whole number; a query id
    that isn't one is returned as a string. The queries go through the driver, a block of terms at a time.
    """
    spark = docs.sparkSession
    whole = isinstance(queries.schema[query_id].dataType, (T.LongType, T.IntegerType, T.ShortType, T.ByteType))
    query_type = T.LongType() if whole else T.StringType()
    rows = queries.filter(F.col(query_text).isNotNull()).groupBy(F.col(query_id).cast(query_type).alias("id")).agg(F.array_sort(F.collect_set(F.col(query_text).cast("binary"))).alias("texts"))  # the texts of one query
    out, n_docs, n_terms = None, None, None
    for block in _blocks(rows.toLocalIterator(), query_block):
        numbers: dict[bytes, int] = {}
        for _, counts in block:
            for term in counts:
                numbers.setdefault(term, len(numbers))
        vocabulary = spark.sparkContext.broadcast(numbers)
        index = durable(_counted(docs, key, text, vocabulary), "search-index")
        vocabulary.unpersist()
        if n_docs is None:
            n_docs, n_terms = index.agg(F.count("*"), F.coalesce(F.sum("_n"), F.lit(0))).first()
        held = index.select(F.explode("_terms").alias("t")).groupBy("t").agg(F.count("*").alias("df"))
        # A row for each term of the block at most.
        weights = {r.t: r.w for r in held.select("t", F.floor(1000 * F.log((2.0 * n_docs + 2) / (2 * F.col("df") + 1))).alias("w")).toLocalIterator()}
        asked = []
        for name, counts in block:
            known = [(t, weights[t] * c) for w, c in counts.items() if (t := numbers[w]) in weights]
            if known:
                asked.append(Query(name, np.array([t for t, _ in known], np.int64), np.array([w for _, w in known], np.int64)))
        shared = spark.sparkContext.broadcast(asked)
        found = durable(_found(index, shared, n_docs, n_terms, query_type, query_id, best, slope), "search-found")
        shared.unpersist()
        out = found if out is None else out.unionByName(found)
    if out is None:
        out = spark.createDataFrame([], T.StructType([T.StructField(query_id, query_type), T.StructField("_key", T.LongType()), T.StructField("_score", T.LongType())]))
    first = (F.desc("_score"), F.asc_nulls_last("_key"))
    part = F.pmod(F.xxhash64("_key"), F.lit(PARTS))
    near = out.withColumn("_rank", F.row_number().over(Window.partitionBy(query_id, part).orderBy(*first))).filter(F.col("_rank") <= best)
    ranked = near.withColumn("_rank", F.row_number().over(Window.partitionBy(query_id).orderBy(*first))).filter(F.col("_rank") <= best)
    return ranked.select(query_id, F.col("_rank").alias("rank"), F.col("_key").alias(key), F.col("_score").alias("score"))


def op11_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


OP11_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ws FROM documents WHERE text IS NOT NULL),
q AS (
  SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t
  FROM (SELECT DISTINCT item_id, text FROM benchmark WHERE text IS NOT NULL)),
total AS (SELECT count(*) AS n_docs, CAST(sum(len(ws)) AS BIGINT) AS n_terms FROM d WHERE len(ws) > 0),
asked AS (SELECT item_id, t, count(*) AS times FROM q GROUP BY item_id, t),
tf AS (SELECT doc_id, n, t, count(*) AS tf FROM (SELECT doc_id, len(ws) AS n, unnest(ws) AS t FROM d) WHERE t IN (SELECT t FROM asked) GROUP BY doc_id, n, t),
w AS (SELECT t, CAST(floor(1000 * ln((2.0::DOUBLE * any_value(n_docs) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM tf, total GROUP BY t),
part AS (
  SELECT item_id, doc_id, times * w * ((1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + (25 * n * n_docs) // n_terms))) AS s
  FROM asked JOIN tf USING (t) JOIN w USING (t), total),
score AS (SELECT item_id, doc_id, CAST(sum(s) AS BIGINT) AS score FROM part GROUP BY item_id, doc_id HAVING sum(s) > 0)
SELECT item_id, CAST(place AS INTEGER) AS rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS place FROM score) WHERE place <= 20
"""
