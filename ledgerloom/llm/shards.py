"""Documents in shards, and packed key columns that shards exchange through hash buckets.

A shard is a set of documents, drawn by a hash, that one task holds at a time (some MB of text). A shard sends each
distinct key once, so a key that a third of all rows have costs a bucket one entry for each group of shards.

Keys meet in two steps, so that neither the rows nor what a task holds grow with the square of the data: the shards of
a group are merged for each coarse range of keys, then the groups for each bucket of the range. With S shards there are
about 2 S sqrt(S) messages, and a task holds about a shard's or a bucket's worth of keys.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SHARD_BYTES = 12 << 20


def shard_count(total_bytes: int, size: int = SHARD_BYTES) -> int:
    return max(1, -(-total_bytes // size))


def sharded(docs: DataFrame, shards: int, by: list[str], columns: list[str]) -> DataFrame:
    """_shard and ``columns``: rows drawn by a hash of ``by``, a shard in each partition."""
    drawn = docs.select(F.pmod(F.xxhash64(*by), F.lit(shards)).cast("int").alias("_shard"), *columns)
    return drawn.repartition(max(1, min(shards, 20_000)), "_shard")


def word_codes(texts: pa.Array | pa.ChunkedArray, lower: bool = False) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(distinct words, number of each word of all texts in turn, where each text's words start and, last, the end)."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks() if texts.num_chunks != 1 else texts.chunk(0)
    if texts.offset:
        texts = texts.take(pa.array(np.arange(len(texts))))  # string kernels misread slices
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    parts = pc.ascii_split_whitespace(pc.ascii_lower(texts) if lower else texts)
    coded = pc.dictionary_encode(parts.flatten())
    if isinstance(coded, pa.ChunkedArray):
        coded = coded.combine_chunks()
    words = coded.dictionary.to_pylist()
    index = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.concatenate(([0], np.cumsum(pc.list_value_length(parts).to_numpy(zero_copy_only=False).astype(np.int64))))
    keep = index != words.index("") if "" in words else np.ones(len(index), bool)
    return words, index[keep], np.concatenate(([0], np.cumsum(keep)))[ends]


def hash_words(words: list[str]) -> np.ndarray:
    return np.fromiter((xxhash.xxh3_64_intdigest(w) for w in words), np.uint64, len(words))


def pack(values: np.ndarray) -> bytes:
    """An integer column as compressed byte planes."""
    planes = np.ascontiguousarray(values).view(np.uint8).reshape(len(values), values.itemsize).T.tobytes()
    return len(values).to_bytes(8, "little") + pa.compress(planes, "zstd", asbytes=True)


def unpack(raw: bytes, kind: type) -> np.ndarray:
    n, width = int.from_bytes(raw[:8], "little"), np.dtype(kind).itemsize
    planes = np.frombuffer(pa.decompress(raw[8:], n * width, "zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(planes.reshape(width, n).T).view(kind).ravel()


def pack_sorted(values: np.ndarray) -> bytes:
    return pack(np.diff(values, prepend=np.uint64(0)))


def unpack_sorted(raw: bytes) -> np.ndarray:
    return np.cumsum(unpack(raw, np.uint64), dtype=np.uint64)


def _struct(**kinds: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in kinds.items()])


_INT, _RAW = T.IntegerType(), T.BinaryType()
TOLD = _struct(_shard=_INT, _range=_INT, keys=_RAW, counts=_RAW)
_MERGED = _struct(_group=_INT, _range=_INT, _bucket=_INT, keys=_RAW, counts=_RAW)
_MET = _struct(_group=_INT, _range=_INT, _bucket=_INT, totals=_RAW, digest=_RAW)
ANSWER = _struct(_shard=_INT, _range=_INT, totals=_RAW)
_ARROW = {T.IntegerType: pa.int32(), T.BinaryType: pa.binary()}


def _table(rows: list[tuple], schema: T.StructType) -> pa.Table:
    fields = pa.schema([(f.name, _ARROW[type(f.dataType)]) for f in schema])
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), fields)], schema=fields) if rows else fields.empty_table()


def _summed(table: pa.Table) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """(keys of each row, all keys in order, their summed counts)."""
    own = [unpack_sorted(x) for x in table.column("keys").to_pylist()]
    counts = np.concatenate([unpack(x, np.uint64) for x in table.column("counts").to_pylist()])
    every, back = np.unique(np.concatenate(own), return_inverse=True)
    return own, every, np.bincount(back, weights=counts.astype(float), minlength=len(every)).astype(np.uint64)


@dataclass(frozen=True)
class Exchange:
    """Sums of the shards' key counts. Keys are whole numbers of ``bits`` bits, evenly spread."""

    #: Coarse ranges of keys; also buckets of a range and shards of a group.
    width: int
    bits: int = 64

    @classmethod
    def of(cls, shards: int, shards_per_bucket: int, bits: int = 64) -> Exchange:
        return cls(max(1, math.ceil(math.sqrt(shards / shards_per_bucket))), bits)

    def bounds(self, keys: np.ndarray) -> np.ndarray:
        """Where each bucket begins in the sorted keys, and the end."""
        n = self.width**2
        cuts = np.array([(k << self.bits) // n for k in range(1, n)], dtype=np.uint64)
        return np.concatenate(([0], np.searchsorted(keys, cuts), [len(keys)])).astype(np.int64)

    def tell(self, shard: int, keys: np.ndarray, counts: np.ndarray) -> pa.Table:
        """A shard's messages: its distinct keys, in order, and their counts."""
        cuts = self.bounds(keys)[:: self.width]
        return _table([(shard, r, pack_sorted(keys[a:b]), pack(counts[a:b].astype(np.uint64))) for r, (a, b) in enumerate(zip(cuts, cuts[1:])) if b > a], TOLD)

    def _grouped(self, told: DataFrame) -> DataFrame:
        return told.select("*", F.floor(F.col("_shard") / self.width).cast("int").alias("_group"))

    def meet(self, told: DataFrame, digest: Callable[[np.ndarray, np.ndarray], bytes] | None = None) -> DataFrame:
        """The sums of each group's keys; and one ``digest`` of the keys and sums of each bucket."""

        def merge(table: pa.Table) -> pa.Table:
            _, every, counts = _summed(table)
            group, part = table.column("_group")[0].as_py(), table.column("_range")[0].as_py()
            cuts = self.bounds(every)
            return _table([(group, part, b, pack_sorted(every[cuts[b] : cuts[b + 1]]), pack(counts[cuts[b] : cuts[b + 1]])) for b in np.flatnonzero(np.diff(cuts)).tolist()], _MERGED)

        def total(table: pa.Table) -> pa.Table:
            own, every, counts = _summed(table)
            at = zip(*(table.column(c).to_pylist() for c in ("_group", "_range", "_bucket")))
            return _table([(*names, pack(counts[np.searchsorted(every, keys)]), digest(every, counts) if digest and not k else None) for k, (names, keys) in enumerate(zip(at, own))], _MET)

        return self._grouped(told).groupBy("_group", "_range").applyInArrow(merge, _MERGED).groupBy("_bucket").applyInArrow(total, _MET)

    def answers(self, told: DataFrame, met: DataFrame) -> DataFrame:
        """For each shard, the sums of its keys by range; shard -1: the digests."""

        def answer(table: pa.Table, replies: pa.Table) -> pa.Table:
            if not table.num_rows:
                return _table([], ANSWER)
            own, every, _ = _summed(table)
            cuts, sums = self.bounds(every), np.zeros(len(every), np.uint64)
            for b, raw in zip(replies.column("_bucket").to_pylist(), replies.column("totals").to_pylist()):
                sums[cuts[b] : cuts[b + 1]] = unpack(raw, np.uint64)
            names = zip(table.column("_shard").to_pylist(), table.column("_range").to_pylist())
            digests = [(-1, b, raw) for b, raw in zip(replies.column("_bucket").to_pylist(), replies.column("digest").to_pylist()) if raw is not None]
            return _table([(*n, pack(sums[np.searchsorted(every, keys)])) for n, keys in zip(names, own)] + digests, ANSWER)

        return self._grouped(told).groupBy("_group", "_range").cogroup(met.groupBy("_group", "_range")).applyInArrow(answer, ANSWER)

    def sums(self, keys: np.ndarray, answer: pa.Table) -> np.ndarray:
        """The sum of each of a shard's keys."""
        cuts, out = self.bounds(keys)[:: self.width], np.zeros(len(keys), np.int64)
        for r, raw in zip(answer.column("_range").to_pylist(), answer.column("totals").to_pylist()):
            out[cuts[r] : cuts[r + 1]] = unpack(raw, np.uint64)
        return out
