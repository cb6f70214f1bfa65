"""Benchmark decontamination with an FM-index for each training shard.

A shard is a run of documents that one task holds at a time. Its words are numbered by the phrase vocabulary;
a word outside of it ends a run, since no phrase crosses one, and runs shorter than the shortest phrase hold no
occurrence. The runs are suffix-sorted, their Burrows-Wheeler transform goes into a wavelet matrix, all phrases are
found by backward search over its ranks, and occurrences are placed by walking to sampled suffix positions.
No shuffle is needed: a document never leaves its task.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.llm.common import alnum_words, documents, sub_batches

WINDOW = 10
#: Phrase words sent to the tasks at once; a larger benchmark is searched in several passes.
PHRASE_BLOCK = 4_000_000
SAMPLE = 16
#: Text bytes that are indexed at a time.
SHARD_BYTES = 4 << 20
_WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")


class _Vocabulary(dict):
    def __missing__(self, word: bytes) -> int:
        return 0


class WaveletMatrix:
    """Rank of any symbol before any position, over arrays of queries."""

    def __init__(self, symbols: np.ndarray, top: int):
        self.bits = max(1, int(top).bit_length())
        self.ones, self.zeros = [], []
        level = symbols
        for b in range(self.bits - 1, -1, -1):
            bit = (level >> b) & 1
            self.ones.append(np.concatenate(([0], np.cumsum(bit))).astype(np.int64))
            self.zeros.append(len(bit) - int(self.ones[-1][-1]))
            level = np.concatenate((level[bit == 0], level[bit == 1]))

    def rank(self, symbol: np.ndarray, end: np.ndarray) -> np.ndarray:
        start = np.zeros_like(end)
        for k, b in enumerate(range(self.bits - 1, -1, -1)):
            one = ((symbol >> b) & 1).astype(bool)
            r0, r1 = self.ones[k][start], self.ones[k][end]
            start = np.where(one, self.zeros[k] + r0, start - r0)
            end = np.where(one, self.zeros[k] + r1, end - r1)
        return end - start


def suffix_array(keys: np.ndarray) -> np.ndarray:
    """Suffixes of ``keys`` in order, by prefix doubling."""
    n = len(keys)
    rank = np.unique(keys, return_inverse=True)[1].astype(np.int64)
    width = 1
    while True:
        second = np.zeros(n, np.int64)
        second[: n - width] = rank[width:] + 1 if width < n else 0
        order = np.argsort(rank * (n + 1) + second, kind="stable")
        pair = (rank * (n + 1) + second)[order]
        fresh = np.concatenate(([0], np.cumsum(pair[1:] != pair[:-1])))
        rank = np.empty(n, np.int64)
        rank[order] = fresh
        if n == 0 or fresh[-1] == n - 1:
            return order
        width *= 2


class FMIndex:
    """Backward search and location over runs of symbols 1..top, each run closed by a 0."""

    def __init__(self, text: np.ndarray, top: int):
        stops = np.flatnonzero(text == 0)
        keys = text.astype(np.int64) + len(stops)
        keys[stops] = np.arange(len(stops))  # each end is a symbol of its own, so equal runs are told apart
        self.order = suffix_array(keys)
        before = text[self.order - 1]  # the first suffix wraps to the last end
        self.wavelet, self.before = WaveletMatrix(before, top), before
        self.starts = np.concatenate(([0], np.cumsum(np.bincount(text, minlength=top + 1))))
        first = np.zeros(len(text), bool)
        first[np.concatenate(([0], stops[:-1] + 1)).astype(np.int64)] = True
        self.sampled = first[self.order] | (self.order % SAMPLE == 0)
        self.position = np.where(self.sampled, self.order, -1)[self.sampled]
        self.slot = np.cumsum(self.sampled) - 1
        del self.order

    def _step(self, symbol: np.ndarray, row: np.ndarray) -> np.ndarray:
        return self.starts[symbol] + self.wavelet.rank(symbol, row)

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows [low, high) of each phrase; ``phrases`` has one phrase of equal length in each row."""
        low = self.starts[phrases[:, -1]]
        high = self.starts[phrases[:, -1] + 1]
        for j in range(phrases.shape[1] - 2, -1, -1):
            alive = np.flatnonzero(low < high)
            if not len(alive):
                break
            low[alive] = self._step(phrases[alive, j], low[alive])
            high[alive] = self._step(phrases[alive, j], high[alive])
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffix rows."""
        out, steps, todo = np.empty(len(rows), np.int64), 0, np.arange(len(rows))
        row = rows.copy()
        while len(todo):
            done = self.sampled[row]
            out[todo[done]] = self.position[self.slot[row[done]]] + steps
            todo, row = todo[~done], row[~done]
            row = self._step(self.before[row], row)
            steps += 1
        return out


class Phrases:
    """Distinct phrases by length, and the items that each belongs to."""

    def __init__(self, windows: dict[tuple[bytes, ...], set[str]]):
        self.vocabulary = _Vocabulary()
        for w in windows:
            for word in w:
                self.vocabulary.setdefault(word, len(self.vocabulary) + 1)
        by_length: dict[int, list[tuple[bytes, ...]]] = defaultdict(list)
        for w in windows:
            by_length[len(w)].append(w)
        self.groups = [
            (n, np.array([[self.vocabulary[x] for x in w] for w in ws], np.int64).reshape(len(ws), n), [sorted(windows[w]) for w in ws])
            for n, ws in sorted(by_length.items())
        ]
        self.shortest = min(by_length, default=0)


def item_windows(items: Iterator[tuple[str, bytes | None]], window: int) -> Iterator[dict[tuple[bytes, ...], set[str]]]:
    """Windows of the items with their ids, in blocks of bounded size."""
    block: dict[tuple[bytes, ...], set[str]] = defaultdict(set)
    words_in = 0
    for item, text in items:
        words = alnum_words(text)
        for k in range(max(1, len(words) - window + 1) if words else 0):
            block[tuple(words[k : k + window])].add(item)
            words_in += window
            if words_in >= PHRASE_BLOCK:
                yield block
                block, words_in = defaultdict(set), 0
    if block:
        yield block


def find_in_shard(texts: list[bytes | None], phrases: Phrases) -> list[tuple[int, list[tuple[int, int]], set[str]]]:
    """For each text: its number of words, the merged word spans [start, end) inside occurrences, the items found."""
    lookup = phrases.vocabulary.__getitem__
    ids = [np.fromiter(map(lookup, alnum_words(t)), np.int32) for t in texts]
    lengths = np.array([len(x) for x in ids], np.int64)
    base = np.concatenate(([0], np.cumsum(lengths + 1)))  # one closing word after each text
    stream = np.zeros(int(base[-1]), np.int32)
    for x, at in zip(ids, base):
        stream[at : at + len(x)] = x
    spans: list[list[tuple[int, int]]] = [[] for _ in texts]
    found: list[set[str]] = [set() for _ in texts]
    edges = np.flatnonzero(np.diff(np.concatenate(([False], stream > 0, [False])).astype(np.int8)))
    begin, end = edges[::2], edges[1::2]
    keep = (end - begin) >= max(1, phrases.shortest)
    begin, end = begin[keep], end[keep]
    if len(begin):
        size = end - begin + 1
        offset = np.cumsum(size) - size
        source = np.arange(int(size.sum())) + np.repeat(begin - offset, size)  # index position -> stream position
        index = FMIndex(stream[source], len(phrases.vocabulary))
        mark = np.zeros(len(stream) + 1, np.int32)
        for n, words, items in phrases.groups:
            low, high = index.search(words)
            count = np.maximum(high - low, 0)
            hit = np.flatnonzero(count)
            if not len(hit):
                continue
            count = count[hit]
            which = np.repeat(hit, count)
            rows = np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(low[hit], count)
            at = source[index.locate(rows)]
            np.add.at(mark, at, 1)
            np.add.at(mark, at + n, -1)
            doc = np.searchsorted(base, at, side="right") - 1
            for code in np.unique(doc * len(items) + which).tolist():
                found[code // len(items)].update(items[code % len(items)])
        covered = np.concatenate(([False], np.cumsum(mark)[:-1] > 0, [False]))
        turn = np.flatnonzero(np.diff(covered.astype(np.int8)))
        for a, b in zip(turn[::2].tolist(), turn[1::2].tolist()):
            d = int(np.searchsorted(base, a, side="right")) - 1
            spans[d].append((a - int(base[d]), b - int(base[d])))
    return list(zip(lengths.tolist(), spans, found))


def merge_spans(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


_FOUND = T.StructType([
    T.StructField("n_words", T.LongType()),
    T.StructField("spans", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))),
    T.StructField("items", T.ArrayType(T.StringType())),
])
_FOUND_ARROW = pa.struct([
    ("n_words", pa.int64()),
    ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
    ("items", pa.list_(pa.string())),
])


def find_contamination(docs: DataFrame, benchmark: DataFrame, *, window: int = WINDOW, text: str = "text", item_id: str = "item_id",
                       item_text: str = "text", carry: list[str] | None = None, result: str = "contamination",
                       shard_bytes: int = SHARD_BYTES, cut: bool = False) -> DataFrame:
    """Each row of ``docs`` (columns ``carry``, all by default) with a struct ``result``: words, hit spans, items.

    ``cut`` also takes the spans out of a carried ``text``, with the characters between their words; rows without spans
    keep their text as it is. Null and empty texts have no words and no hits. Items that are null or have no word are in
    no result; items with one id count once; an item without an id hits words but isn't named. Repeated rows get equal
    results; null ids are values like others. An empty benchmark hits nothing. A column of ``docs`` that is named like
    ``result`` is replaced. A very long text is a shard of its own. The benchmark goes through the driver in blocks and
    its blocks to all tasks: it is taken to be small beside the documents.
    """
    carry = [c for c in (carry or docs.columns) if c != result]
    own = text if text in carry else "_text"  # a text that is carried is sent once
    out_schema = T.StructType([docs.schema[c] for c in carry] + [T.StructField(result, _FOUND)])
    rows = benchmark.select(F.col(item_id).cast("string").alias("i"), F.col(item_text).cast("binary").alias("t"))
    items = ((r.i, bytes(r.t) if r.t is not None else None) for r in rows.toLocalIterator())
    out = docs.select(*carry, *([] if own == text else [F.col(text).alias(own)]), F.lit(None).cast(_FOUND).alias("_found"))
    block: dict = {}
    for following in item_windows(items, window):
        if block:
            out = _search_pass(out, block, own, shard_bytes, False)
        block = following
    out = _search_pass(out, block, own, shard_bytes, cut)
    return out.select(*carry, F.col("_found").alias(result)).to(out_schema)


def _search_pass(df: DataFrame, windows: dict, text: str, shard_bytes: int, cut: bool) -> DataFrame:
    shared = df.sparkSession.sparkContext.broadcast({k: sorted(v, key=str) for k, v in windows.items()})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        phrases = Phrases({k: {x for x in v if x is not None} for k, v in shared.value.items()})
        for batch in sub_batches(batches, text, shard_bytes):
            texts, before = batch.column(text).cast(pa.binary()).to_pylist(), batch.column("_found").to_pylist()
            rows, changed = [], False
            for k, ((n, spans, items), old) in enumerate(zip(find_in_shard(texts, phrases), before)):
                if old:
                    spans = merge_spans(spans + [(s["start"], s["end"]) for s in old["spans"]])
                    items = items | set(old["items"])
                rows.append({"n_words": n, "spans": [{"start": a, "end": b} for a, b in spans], "items": sorted(items)})
                if cut and spans:
                    texts[k], changed = without_spans(texts[k], spans), True
            batch = batch.set_column(batch.schema.get_field_index("_found"), "_found", pa.array(rows, _FOUND_ARROW))
            if changed:
                at = batch.schema.get_field_index(text)
                batch = batch.set_column(at, text, pa.array(texts, pa.binary()).cast(batch.schema.field(at).type))
            yield batch

    return df.mapInArrow(run, df.schema)


def without_spans(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    """``text`` without the words of the spans and what stands between them."""
    at = [m.span() for m in _WORD.finditer(text)]
    kept, last = [], 0
    for a, b in spans:
        kept.append(text[last : at[a][0]])
        last = at[b - 1][1]
    return b"".join([*kept, text[last:]])


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    found = find_contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), carry=["doc_id"])
    f = F.col("contamination")
    n_hit = F.aggregate(f["spans"], F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    return found.select(
        "doc_id", f["n_words"].alias("n_words"), n_hit.alias("n_hit"), F.size(f["items"]).cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort(f["items"]), ",").cast("binary"), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
    )


OP2_SQL = r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark WHERE text IS NOT NULL),
win AS (
  SELECT DISTINCT item_id, least(len(ws), 10) AS n, array_to_string(ws[k : k + 9], ' ') AS win
  FROM (SELECT item_id, ws, unnest(range(1, greatest(1, len(ws) - 9) + 1)) AS k FROM b WHERE len(ws) > 0)),
lens AS (SELECT DISTINCT n FROM win),
pos AS (
  SELECT doc_id, n, k, array_to_string(ws[k : k + n - 1], ' ') AS win
  FROM (SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS k FROM w, lens WHERE len(ws) >= n)),
hits AS (SELECT p.doc_id, p.n, p.k, i.item_id FROM pos p JOIN win i ON p.win = i.win AND p.n = i.n),
covered AS (SELECT doc_id, count(DISTINCT x) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + n)) AS x FROM (SELECT DISTINCT doc_id, n, k FROM hits)) GROUP BY doc_id),
named AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY doc_id)
SELECT w.doc_id, CAST(coalesce(len(ws), 0) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM w LEFT JOIN covered USING (doc_id) LEFT JOIN named USING (doc_id)
"""
