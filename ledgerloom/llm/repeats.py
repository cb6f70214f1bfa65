"""Removal of long passages that repeat across documents, by compaction of a de Bruijn graph of word k-mers.

An edge is k words in a row. Shards tell each other which edges may lie in two documents, by short hashes; the rest of
the graph has one document only and is let go. Repeated edges that follow each other in a document are compacted into
paths, cut where an edge's own hash says so, hence at the same places in every document. A path's rows carry its words,
and Spark joins on the words themselves: all places of a path against its source coordinate (first document, first
word), so that every long span is verified byte by byte. Where texts part, an edge lies on several paths; it then occurs
more often than its path does. Of such paths hashes find the edges that meet, and their words are compared; the first
document of such an edge is the least of the paths'.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.llm.common import documents, durable, give_back, text_bytes
from ledgerloom.llm.shards import TOLD, Exchange, hash_words, shard_count, sharded, word_codes

K = 13
#: A path has so many edges on average before it is cut.
PATH_EDGES = 16
_ODD = np.uint64(0x9E3779B97F4A7C15)


def edge_hashes(words: list[str], index: np.ndarray, bounds: np.ndarray, k: int = K) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash of every edge, row of its text, first word in it)."""
    values = hash_words(words)[index] if len(words) else np.empty(0, np.uint64)
    n = len(values) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
    h = np.zeros(n, np.uint64)
    for j in range(k):
        h = h * _ODD + values[j : j + n]
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    row = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    inside = row[:n] == row[k - 1 :]
    at = np.flatnonzero(inside)
    return h[at], row[at], at - bounds[row[at]]


def _keys(table: pa.Table, key: str) -> np.ndarray:
    return table.column(key).to_numpy(zero_copy_only=False).astype(np.int64)


class _Graph:
    """The edges of one shard, in order of their hashes."""

    def __init__(self, table: pa.Table, key: str, k: int, bits: int):
        self.ids = _keys(table, key)
        self.rows = _keys(table, "_row")
        self.words, self.index, self.bounds = word_codes(table.column("_text"))
        self.hash, self.row, self.word = edge_hashes(self.words, self.index, self.bounds, k)
        order = np.argsort(self.hash, kind="stable")
        ordered, docs = self.hash[order], self.ids[self.row[order]]
        fresh = np.concatenate(([True], ordered[1:] != ordered[:-1])) if len(ordered) else np.empty(0, bool)
        starts = np.flatnonzero(fresh)
        group = np.cumsum(fresh) - 1
        twice = np.minimum.reduceat(docs, starts) != np.maximum.reduceat(docs, starts) if len(starts) else np.empty(0, bool)
        short = ordered >> np.uint64(64 - bits)
        new = np.concatenate(([True], short[1:] != short[:-1])) if len(short) else np.empty(0, bool)
        self.short = short[new]
        self.counts = np.diff(np.append(np.flatnonzero(new), len(short))).astype(np.uint64)
        self.order, self.local, self.slot = order, twice[group], np.cumsum(new) - 1

    def repeated(self, sums: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each edge in document order: whether two documents may have it, and how often it may occur at most."""
        out, often = np.zeros(len(self.hash), bool), np.zeros(len(self.hash), np.int64)
        out[self.order] = self.local | (sums > self.counts.astype(np.int64))[self.slot]
        often[self.order] = sums[self.slot]
        return out, often


def paths(docs: DataFrame, shards: int, bits: int, *, key: str, k: int = K) -> DataFrame:
    """Rows of the compacted graph: _shard, _key, _row, start (first word), n (edges), often, words (of the path, joined by blanks).

    ``often`` is no less than the number of places at which any of the path's edges occurs.
    """
    exchange = Exchange.of(shards, 2, bits)

    def tell(table: pa.Table) -> pa.Table:
        graph = _Graph(table, key, k, bits)
        return exchange.tell(table.column("_shard")[0].as_py(), graph.short, graph.counts)

    told = docs.groupBy("_shard").applyInArrow(tell, TOLD)
    answers = exchange.answers(told, exchange.meet(told))
    schema = T.StructType([
        T.StructField("_shard", T.IntegerType()), T.StructField("_key", T.LongType()), T.StructField("_row", T.LongType()),
        T.StructField("start", T.IntegerType()), T.StructField("n", T.IntegerType()), T.StructField("often", T.LongType()), T.StructField("words", T.StringType()),
    ])
    arrow = pa.schema([("_shard", pa.int32()), ("_key", pa.int64()), ("_row", pa.int64()), ("start", pa.int32()), ("n", pa.int32()), ("often", pa.int64()), ("words", pa.string())])

    def compact(table: pa.Table, answer: pa.Table) -> pa.Table:
        if not table.num_rows:
            return arrow.empty_table()
        graph = _Graph(table, key, k, bits)
        repeated, often = graph.repeated(exchange.sums(graph.short, answer))
        at = np.flatnonzero(repeated)
        if not len(at):
            return arrow.empty_table()
        h, row, word = graph.hash[at], graph.row[at], graph.word[at]
        joined = (row[1:] == row[:-1]) & (word[1:] == word[:-1] + 1) & (h[:-1] % np.uint64(PATH_EDGES) != 0)
        starts = np.concatenate(([0], np.flatnonzero(~joined) + 1))
        size = np.diff(np.append(starts, len(h)))
        first = graph.bounds[row[starts]] + word[starts]
        text = [" ".join([graph.words[i] for i in graph.index[a : a + n + k - 1].tolist()]) for a, n in zip(first.tolist(), size.tolist())]
        give_back()
        return pa.Table.from_arrays([
            pa.array(np.full(len(starts), table.column("_shard")[0].as_py(), np.int32)), pa.array(graph.ids[row[starts]]), pa.array(graph.rows[row[starts]]),
            pa.array(word[starts].astype(np.int32)), pa.array(size.astype(np.int32)), pa.array(np.maximum.reduceat(often[at], starts)), pa.array(text, pa.string()),
        ], schema=arrow)

    return docs.groupBy("_shard").cogroup(answers.groupBy("_shard")).applyInArrow(compact, schema)


def _edge_hash(words: F.Column) -> F.Column:
    return F.xxhash64(words)


def repeated_places(rows: DataFrame, k: int = K) -> DataFrame:
    """_shard, _key, _row, start, n, some: the places whose edges, all or some, an earlier document has.

    ``some`` has the numbers of those edges; null: the path's source is in an earlier document, so all are.
    """
    # Equal paths are one, with the least of their places as the source; partial minima come before the shuffle.
    distinct = rows.groupBy("words").agg(F.min(F.struct("_key", "_row", "start")).alias("source"), F.count("*").alias("places"), F.max("often").alias("often"))
    distinct = durable(distinct.withColumn("path", F.monotonically_increasing_id()), "distinct-paths")  # written, so numbers stay
    # An edge that another path has too occurs more often than this path. (So does one that the path has twice.)
    listed = distinct.filter("often > places").select("path", F.col("source._key").alias("first"), F.split("words", " ").alias("_w"))
    # The list is named twice, so that Spark makes it once and not for each edge.
    hashes = F.transform(F.sequence(F.lit(1), F.size("_w") - (k - 1)), lambda i: _edge_hash(F.slice("_w", i, k)))
    edges = listed.select("path", hashes.alias("e")).select("path", F.posexplode_outer("e").alias("at", "edge"))
    # Only distinct paths meet here, so copies of a passage don't crowd an edge.
    several = edges.groupBy("edge").agg(F.min("path").alias("a"), F.max("path").alias("b")).filter("a < b").select("edge")
    meeting = edges.join(several, "edge", "left_semi").groupBy("path").agg(F.collect_list("at").alias("ats"))  # of one path's edges at most
    spoken = F.transform("ats", lambda i: F.struct(i.alias("at"), F.array_join(F.slice("_w", i + 1, F.least(F.lit(k), F.size("_w"))), " ").alias("edge")))
    worded = durable(meeting, "meeting-edges").join(listed, "path").select("path", "first", spoken.alias("x")).select("path", "first", F.explode_outer("x").alias("x")).select("path", "first", "x.at", "x.edge")
    least = worded.groupBy("edge").agg(F.min("first").alias("least"), F.max("first").alias("most")).filter("least < most").select("edge", "least")
    parted = worded.join(least, "edge").filter("least < first")
    ahead = parted.groupBy("path").agg(F.map_from_entries(F.collect_list(F.struct("at", "least"))).alias("ahead"))  # one entry for each of a path's edges at most
    known = distinct.join(durable(ahead, "edges-ahead"), "path", "left").select("words", "source", "ahead")
    placed = rows.drop("often").join(known, "words")
    hits = F.filter(F.map_keys("ahead"), lambda at: F.element_at("ahead", at) < F.col("_key"))
    return placed.select(
        "_shard", "_key", "_row", "start", "n",
        F.when(F.col("source._key") < F.col("_key"), F.lit(None)).otherwise(F.coalesce(hits, F.array().cast("array<int>"))).alias("some"),
    ).filter("some IS NULL OR size(some) > 0")


def remove_repeats(docs: DataFrame, *, key: str = "doc_id", text: str = "text", k: int = K) -> DataFrame:
    """key, text (kept words joined by one blank), n_words, n_removed, spans (removed words [start, end)).

    A word goes if k words in a row that hold it also begin in a document with a smaller key; all is judged on the input.
    Null and empty texts have no words and get an empty text. Rows that repeat a key are no earlier documents for each
    other, each of them is judged by its own text, and equal rows get equal results. Rows without a key keep all words
    and are no one's earlier document. Of no rows come none. Other columns aren't read, whatever their names; the key is
    a whole number. A very long text is one row of a shard and is taken whole.
    """
    total = text_bytes(docs, text)
    shards = shard_count(total)
    bits = min(63, max(16, int(total // 4).bit_length() + 7))
    keyed = docs.filter(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("_key"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    keyed = keyed.withColumn("_row", F.xxhash64("_text"))  # tells rows that repeat a key apart
    cut = sharded(keyed, shards, ["_key", "_row"], ["_key", "_row", "_text"])
    rows = durable(paths(cut, shards, bits, key="_key", k=k), "paths")
    places = durable(repeated_places(rows, k), "places")
    schema = T.StructType([
        T.StructField(key, T.LongType()), T.StructField("text", T.StringType()), T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()),
        T.StructField("spans", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))),
    ])
    arrow = pa.schema([(key, pa.int64()), ("text", pa.string()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))])

    def remove(table: pa.Table, gone: pa.Table) -> Iterator[pa.RecordBatch]:
        spans: dict[tuple[int, int], list[tuple[int, int]]] = {}
        for doc, row, start, n, some in zip(*(gone.column(c).to_pylist() for c in ("_key", "_row", "start", "n", "some"))):
            own = spans.setdefault((doc, row), [])
            own += [(start, start + n + k - 1)] if some is None else [(start + x, start + x + k) for x in some]
        out = []
        for doc, row, body in zip(*(table.column(c).to_pylist() for c in ("_key", "_row", "_text"))):
            words = body.encode().split()
            merged: list[tuple[int, int]] = []
            for a, b in sorted(spans.get((doc, row), ())):
                if merged and a <= merged[-1][1]:
                    merged[-1] = (merged[-1][0], max(b, merged[-1][1]))
                else:
                    merged.append((a, b))
            kept, last = [], 0
            for a, b in merged:
                kept += words[last:a]
                last = b
            kept += words[last:]
            out.append((doc, b" ".join(kept).decode(), len(words), len(words) - len(kept), [{"start": a, "end": b} for a, b in merged]))
        return pa.table([pa.array(c, f.type) for c, f in zip(zip(*out), arrow)], schema=arrow) if out else arrow.empty_table()

    done = cut.groupBy("_shard").cogroup(places.groupBy("_shard")).applyInArrow(remove, schema)
    bare = docs.filter(F.col(key).isNull()).select(
        F.lit(None).cast("long").alias(key), F.array_join(F.filter(F.split(F.coalesce(F.col(text), F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != ""), " ").alias("text"))
    bare = bare.select(key, "text", F.when(F.col("text") == "", 0).otherwise(F.size(F.split("text", " "))).cast("long").alias("n_words"), F.lit(0).cast("long").alias("n_removed"), F.lit(None).cast(schema["spans"].dataType).alias("spans"))
    return done.unionByName(bare)


def op7_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeats(documents(spark, sf_dir))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


OP7_SQL = r"""
WITH w AS (SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS ws FROM documents),
win AS (SELECT doc_id, k, array_to_string(ws[k : k + 12], ' ') AS win FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS k FROM w WHERE len(ws) >= 13)),
first AS (SELECT win, min(doc_id) AS first FROM win GROUP BY win HAVING min(doc_id) < max(doc_id)),
gone AS (SELECT DISTINCT doc_id, unnest(range(k, k + 13)) AS k FROM win JOIN first USING (win) WHERE doc_id > first),
word AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS k FROM w),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY k) AS body FROM word ANTI JOIN gone USING (doc_id, k) GROUP BY doc_id),
lost AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(body, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id) LEFT JOIN lost USING (doc_id)
"""
