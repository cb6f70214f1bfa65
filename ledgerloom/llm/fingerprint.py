"""Document fingerprints from prefix polynomial hashes.

A prefix array of hash values modulo a prime gives the hash of any span in constant time; equal spans are told by
their hashes and the longest common extension of two positions is found by binary search. A document's fingerprint
holds its length, the hashes of its whole text modulo two primes, and the smallest span hashes of a fixed width: a
sample of its spans by value, which estimates the share of spans that two texts have in common.
"""

from __future__ import annotations

import base64
import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.llm.common import documents, text_bytes
from ledgerloom.llm.shards import shard_count

#: Below 2**31, so that products of two residues fit 64 bits.
PRIMES = (2147483647, 2147483629)
BASES = (911382323, 972663749)
WIDTH = 32
SKETCH = 64
#: Text bytes in a range of rows, on average.
PART_BYTES = 12 << 20
#: The ranges are no more than this, however much text there is.
MOST_PARTS = 20_000


class PrefixHash:
    """Prefix arrays over code points, for one prime."""

    _powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def __init__(self, points: np.ndarray, which: int = 0):
        self.prime = np.uint64(PRIMES[which])
        power, self.inverse = self.powers(len(points), which)
        terms = (points.astype(np.uint64) + np.uint64(1)) * power[: len(points)] % self.prime
        self.sums = np.zeros(len(points) + 1, np.uint64)
        np.cumsum(terms, out=self.sums[1:])  # 2**33 residues fit before it wraps

    @classmethod
    def powers(cls, n: int, which: int) -> tuple[np.ndarray, np.ndarray]:
        have = cls._powers.get(which)
        if have is None or len(have[0]) < n:
            p, size = PRIMES[which], 1 << max(16, int(n - 1).bit_length() if n else 0)
            have = tuple(_powers(b, size, p) for b in (BASES[which], pow(BASES[which], -1, p)))
            cls._powers[which] = have
        return have

    def span(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hashes of the spans [start, end): equal for equal spans, wherever they lie."""
        start = np.asarray(start, np.int64)
        diff = (self.sums[end] - self.sums[start]) % self.prime
        return diff * self.inverse[np.minimum(start, len(self.inverse) - 1)] % self.prime  # an empty span may begin at the end


def _powers(base: int, n: int, prime: int) -> np.ndarray:
    out = np.ones(n, np.uint64)
    step, value = 1, base % prime
    while step < n:  # the second half is the first times base**step
        out[step : 2 * step] = out[:step][: n - step] * np.uint64(value) % np.uint64(prime)
        value = value * value % prime
        step *= 2
    return out


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), np.uint32)


class SpanIndex:
    """Span equality and longest common extensions over a run of code points, modulo both primes; all arguments are arrays."""

    def __init__(self, points: np.ndarray):
        self.n = len(points)
        self.hashes = [PrefixHash(points, k) for k in range(2)]

    def equal(self, start: np.ndarray, other: SpanIndex, at: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Whether the spans of ``length`` at ``start`` here and ``at`` there, which must lie inside, are equal."""
        out = np.ones(len(start), bool)
        for a, b in zip(self.hashes, other.hashes):
            out &= a.span(start, start + length) == b.span(at, at + length)
        return out

    def common_extension(self, start: np.ndarray, other: SpanIndex, at: np.ndarray, limit: np.ndarray) -> np.ndarray:
        """Lengths, ``limit`` at most, of the longest common spans that begin at ``start`` here and ``at`` there."""
        low, high = np.zeros(len(start), np.int64), np.array(limit, np.int64)
        while (low < high).any():
            mid = (low + high + 1) // 2
            same = self.equal(start, other, at, mid)
            low, high = np.where(same, mid, low), np.where(same, high, mid - 1)
        return low


def indexed(texts: list[str]) -> tuple[SpanIndex, np.ndarray, np.ndarray]:
    """(span index of the texts in turn, where each begins, their lengths in code points)"""
    points = [code_points(t) for t in texts]
    lengths = np.array([len(p) for p in points], np.int64)
    return SpanIndex(np.concatenate([*points, np.empty(0, np.uint32)])), np.cumsum(lengths) - lengths, lengths


def sketches(index: SpanIndex, starts: np.ndarray, lengths: np.ndarray, width: int = WIDTH, size: int = SKETCH) -> list[tuple[int, int, int, np.ndarray]]:
    """(code points, both whole hashes, the smallest mixed span hashes in order) of each text of an index."""
    ends, n = starts + lengths, index.n
    first, second = index.hashes
    whole = [np.where(lengths > 0, h.span(np.minimum(starts, max(0, n - 1)), ends), 0).tolist() if n else [0] * len(starts) for h in (first, second)]
    spans = np.empty(0, np.uint32)
    if n >= width:
        start = np.arange(n - width + 1)
        x = first.span(start, start + width) * np.uint64(0x9E3779B97F4A7C15)
        spans = ((x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(32)).astype(np.uint32)
    out = []
    for k, (n, end) in enumerate(zip(lengths.tolist(), ends.tolist())):
        own = spans[end - n : end - width + 1] if n >= width else np.array([whole[0][k]] if n else [], np.uint32)
        low = own
        if len(own) > 64 * size:
            low = own[own < np.uint32(min(2**32 - 1, (2**32 // len(own)) * 4 * size))]
            if len(low := np.unique(low)) < size:
                low = own
        out.append((n, whole[0][k], whole[1][k], np.unique(low)[:size]))
    return out


def encode(sketch: tuple[int, int, int, np.ndarray]) -> str:
    n, a, b, low = sketch
    return f"{n:x}.{a:08x}{b:08x}." + base64.b64encode(low.astype("<u4").tobytes()).decode()


def likeness(x: tuple, y: tuple, size: int = SKETCH) -> float:
    """1 for equal fingerprints, else the share of common spans among the smallest of both."""
    if x[:3] == y[:3]:
        return 1.0
    both = np.union1d(x[3], y[3])[:size]
    if not len(both):
        return 0.0
    common = np.intersect1d(x[3], y[3], assume_unique=True)
    return float(np.isin(both, common, assume_unique=True).sum() / len(both))


def parse(fingerprint: str) -> tuple[int, int, int, np.ndarray]:
    n, whole, low = fingerprint.split(".")
    return int(n, 16), int(whole[:8], 16), int(whole[8:], 16), np.frombuffer(base64.b64decode(low), "<u4")


FINGERPRINTS = T.StructType([
    T.StructField("n_chars", T.LongType()), T.StructField("edited_sha256", T.StringType()), T.StructField("fingerprint", T.StringType()),
    T.StructField("edited_fingerprint", T.StringType()), T.StructField("near_edited", T.DoubleType()), T.StructField("near_next", T.DoubleType()),
    T.StructField("shared_edited", T.LongType()), T.StructField("shared_next", T.LongType()),
])


def _reached(heads: list[tuple], key: F.Column, text_hash: F.Column, key_type: T.DataType) -> F.Column:
    """How many of ``heads`` (sorted) a row has reached: a binary search in one constant, whatever their number."""
    if not heads:
        return F.lit(0)
    rows = json.dumps([{"k": str(k) if k is not None else None, "h": h} for k, h in heads])
    listed = F.from_json(F.lit(rows), T.ArrayType(T.StructType([T.StructField("k", T.StringType()), T.StructField("h", T.LongType())])))

    def step(at: F.Column, _: F.Column) -> F.Column:
        mid = F.floor((at["low"] + at["high"]) / 2).cast("int")
        head = F.get(listed, mid)
        k = head["k"].cast(key_type)
        # Keys descend and null ones come last; rows with one key stand in the order of their hashes.
        beyond = F.when(key.isNull(), k.isNotNull() | (text_hash >= head["h"])).when(k.isNull(), False).otherwise((key < k) | ((key == k) & (text_hash >= head["h"])))
        open_still = at["low"] < at["high"]
        return F.struct(F.when(open_still & beyond, mid + 1).otherwise(at["low"]).alias("low"), F.when(open_still & ~beyond, mid).otherwise(at["high"]).alias("high"))

    steps = F.sequence(F.lit(1), F.lit(len(heads).bit_length()))
    return F.aggregate(steps, F.struct(F.lit(0).alias("low"), F.lit(len(heads)).alias("high")), step)["low"]


def with_next(docs: DataFrame, key: str, text: str, part_bytes: int = PART_BYTES) -> DataFrame:
    """Rows dealt out by ranges of (descending ``key``, text hash), each with the first row of the following range:
    _range, _guest, key, text.

    A range's rows are sorted; the guest row comes last, the last range's guest is the first row of all. Ranges hold
    about ``part_bytes`` of text, whatever the keys are, and more where that would make over ``MOST_PARTS`` of them (a range
    is sorted and read in blocks, not held); the texts are shuffled once. A row for each range goes through the driver.
    """
    own = docs.select(key, F.coalesce(F.col(text), F.lit("")).alias(text)).withColumn("_hash", F.xxhash64(text))
    parts = min(MOST_PARTS, shard_count(text_bytes(own, text), part_bytes))
    order = [F.col(key).desc_nulls_last(), F.col("_hash").asc()]
    # The ranges that Spark makes of the bare keys; a row for each.
    first = own.select(key, "_hash").repartitionByRange(parts, *order).select(F.spark_partition_id().alias("p"), key, "_hash")
    least = F.max_by(F.struct(key, "_hash"), F.struct(F.col(key).isNotNull(), F.col(key), F.bitwise_not("_hash")))
    heads = [tuple(r.head) for r in first.groupBy("p").agg(least.alias("head")).orderBy("p").collect()]
    heads = list(dict.fromkeys(heads))  # rows that are all alike can be more than a range

    rows = own.withColumn("_range", _reached(heads[1:], F.col(key), F.col("_hash"), docs.schema[key].dataType))
    # A head is the guest of the range before; the first one is the last range's.
    known = docs.sparkSession.createDataFrame(
        [(k, h, (n - 1) % len(heads)) for n, (k, h) in enumerate(heads)], T.StructType([T.StructField("_k", docs.schema[key].dataType), T.StructField("_h", T.LongType()), T.StructField("_to", T.IntegerType())]))
    found = own.join(F.broadcast(known), F.col(key).eqNullSafe(F.col("_k")) & (F.col("_hash") == F.col("_h")))  # a row for each range
    guests = found.groupBy("_to", key).agg(F.min(text).alias(text)).select(F.col("_to").alias("_range"), F.lit(True).alias("_guest"), key, text, F.lit(0).cast("long").alias("_hash"))
    every = rows.select("_range", F.lit(False).alias("_guest"), key, text, "_hash").unionByName(guests)
    return every.repartitionById(max(1, len(heads)), "_range").sortWithinPartitions("_range", "_guest", *order, text).drop("_hash")


def fingerprints(docs: DataFrame, *, key: str = "doc_id", text: str = "text", batch_chars: int = 1 << 20, part_bytes: int = PART_BYTES) -> DataFrame:
    """Fingerprint of each text and of its edited text, which ends like the next document begins (descending key).

    near_*: likeness to the edited and to the next text, an estimate from the ``SKETCH`` smallest span hashes; it's exact
    where both texts have no more distinct spans together, else off by up to 0.06 (a standard error). shared_*: code points
    that the text begins with as the other does. A null text is empty; an empty text's fingerprint has no spans. Rows with
    one key stand in the order of a hash of their texts, rows without a key come last; repeated rows each have a row; no
    rows give none. Other columns aren't read, whatever their names. A very long text is taken whole.
    """
    rows = with_next(docs, key, text, part_bytes)
    schema = T.StructType([docs.schema[key], *FINGERPRINTS.fields])

    def finish(block: list[tuple], following: str) -> pa.RecordBatch:
        texts = [t for _, t in block]
        nexts = [*texts[1:], following]
        edited = []
        for t, x in zip(texts, nexts):
            cut = len(t) // 2
            edited.append(t[: len(t) - cut] + x[:cut])
        (a, at, sizes), (b, begins, ends) = indexed([*texts, following]), indexed(edited)
        own, other = sketches(a, at, sizes), sketches(b, begins, ends)
        shared = a.common_extension(at[:-1], b, begins, np.minimum(sizes[:-1], ends)).tolist()
        shared_next = a.common_extension(at[:-1], a, at[1:], np.minimum(sizes[:-1], sizes[1:])).tolist()
        out = [
            (k, s[0], hashlib.sha256(e.encode()).hexdigest(), encode(s), encode(o), likeness(s, o), likeness(s, n), x, y)
            for (k, _), e, s, o, n, x, y in zip(block, edited, own, other, own[1:], shared, shared_next)
        ]
        columns = list(zip(*out))
        kinds = [None, pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.int64(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(c, kind) if kind else pa.array(c, pa_key[0]) for c, kind in zip(columns, kinds)], schema.names)

    pa_key: list = [None]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block: list[tuple] = []
        size, current, closed = 0, None, False
        for batch in batches:
            pa_key[0] = batch.column(key).type
            for r, guest, k, t in zip(*(batch.column(c).to_pylist() for c in ("_range", "_guest", key, text))):
                if r != current:
                    current, closed = r, False
                if guest:
                    if block:
                        yield finish(block, t)
                    block, size, closed = [], 0, True  # further guests repeat the first one's key
                    continue
                if size >= batch_chars:
                    yield finish(block, t)
                    block, size = [], 0
                block.append((k, t))
                size += len(t)
        if block:  # no row has a key: the first row is the last one's next
            yield finish(block, block[0][1])

    return rows.mapInArrow(run, schema)


def op3_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(documents(spark, sf_dir))
