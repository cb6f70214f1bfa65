"""Packing of documents into fixed-length training sequences.

Texts are tokenized where they lie; only lengths and checksums of pieces are shuffled. A document is cut into whole
sequences and one rest. The rests of a randomised group of documents are packed by first-fit decreasing, with a
tournament tree over the free room of the bins to find the first that fits.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import batched

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.llm.common import documents, sub_batches

SEQUENCE = 2048
END_ID = 1
#: Documents in a packing group, on average: a task holds their lengths and checksums only.
GROUP_DOCS = 8192
#: Distinct words whose ids a Python worker remembers; others are encoded anew.
CACHE_WORDS = 500_000
#: Words that the tokenizer gets at once: its own records of a word take hundreds of bytes.
ENCODE_WORDS = 16_384


class CachedTokenizer:
    """Ids of whole texts, by the ids of their parts between blanks and line feeds.

    Right for tokenizers that lower-case, drop white space, never join across it, and keep a run of letters and the
    signs behind it apart, as word_bpe does: the ids of a text are then those of its parts in turn. Ids of up to
    ``CACHE_WORDS`` parts are remembered; others are made anew for each batch.
    """

    SIGNS = ".,;:!?*%$#&"

    def __init__(self, path: str):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        os.environ.setdefault("RAYON_NUM_THREADS", "1")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.lower = str.maketrans({chr(65 + k): chr(97 + k) for k in range(26)})
        self.closes = np.zeros(self.tokenizer.get_vocab_size(), bool)
        for token, k in self.tokenizer.get_vocab().items():
            self.closes[k] = token.endswith("</w>")
        self.known: dict[str, int] = {}
        self.flat, self.start, self.size = np.empty(0, np.uint32), np.empty(0, np.int64), np.empty(0, np.int64)

    def _ids(self, texts: list[str]) -> list[np.ndarray]:
        return [np.asarray(e.ids, np.int64) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, words: list[str]) -> None:
        """Append the ids of ``words``, whose places in ``known`` follow those there."""
        stems, tails, plain, other = [], [], {}, {}
        for w in words:
            stem = w.rstrip(self.SIGNS)
            if stem.isalpha() and stem.lower().isalpha():
                stem, tail = stem.translate(self.lower), w[len(stem) :]
                plain[stem] = 0
            else:
                stem, tail = w, ""
                other[stem] = 0
            other[tail] = 0
            stems.append(stem)
            tails.append(tail)
        # A run of letters ends with the only one of its ids that has the word's end.
        joined = np.concatenate([np.empty(0, np.int64), *(ids for block in batched(plain, ENCODE_WORDS) for ids in self._ids([" ".join(block)]))])
        ends = np.flatnonzero(self.closes[joined]) + 1
        rest = [ids for block in batched(other, ENCODE_WORDS) for ids in self._ids(list(block))]
        own = {w: k for k, w in enumerate([*plain, *other])}
        flat = np.concatenate((joined, *rest)).astype(np.uint32)
        size = np.concatenate((np.diff(ends, prepend=0), np.fromiter(map(len, rest), np.int64, len(rest))))
        start = np.cumsum(size) - size
        a, b = (np.fromiter((own[w] for w in ws), np.int64, len(ws)) for ws in (stems, tails))
        both = np.stack((a, b), axis=1).ravel()
        ids = _gather(flat, start[both], size[both])
        total = size[a] + size[b]
        self.start = np.concatenate((self.start, len(self.flat) + np.cumsum(total) - total))
        self.size = np.concatenate((self.size, total))
        self.flat = np.concatenate((self.flat, ids))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in turn, where each text's ids start and, last, the end)."""
        texts = pc.fill_null(texts, "")
        parts = pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")
        coded = parts.flatten().dictionary_encode()
        words = coded.dictionary.to_pylist()
        kept = len(self.known), len(self.flat)
        fresh = [w for w in words if w not in self.known]
        if fresh:
            for w in fresh:
                self.known[w] = len(self.known)
            self._learn(fresh)
        place = np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))[coded.indices.to_numpy(zero_copy_only=False)]
        size = self.size[place]
        ids = _gather(self.flat, self.start[place], size)
        ends = np.concatenate(([0], np.cumsum(size)))
        bounds = ends[np.concatenate(([0], np.cumsum(pc.list_value_length(parts).to_numpy(zero_copy_only=False))))]
        if len(self.known) > CACHE_WORDS:
            for w in fresh:
                del self.known[w]
            self.start, self.size, self.flat = self.start[: kept[0]], self.size[: kept[0]], self.flat[: kept[1]]
        return ids, bounds


def _gather(flat: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The stretches flat[start : start + size], one after another."""
    ends = np.cumsum(size)
    return flat[np.arange(ends[-1] if len(ends) else 0) + np.repeat(start - ends + size, size)]


_TOKENIZERS: dict[str, CachedTokenizer] = {}


def tokenizer_at(path: str) -> CachedTokenizer:
    """One tokenizer with its memory for all tasks of a Python worker."""
    if path not in _TOKENIZERS:
        _TOKENIZERS[path] = CachedTokenizer(path)
    return _TOKENIZERS[path]


class BinTree:
    """Tournament tree over bins: each inner node has the most free room below it."""

    def __init__(self, bins: int, room: int):
        self.leaves = 1 << max(0, (bins - 1).bit_length())
        self.room = [0] * (2 * self.leaves)
        for k in range(bins):
            self.room[self.leaves + k] = room
        for k in range(self.leaves - 1, 0, -1):
            self.room[k] = max(self.room[2 * k], self.room[2 * k + 1])

    def place(self, size: int) -> tuple[int, int]:
        """Put ``size`` into the first bin with room for it: (bin, room it had)."""
        k = 1
        while k < self.leaves:
            k = 2 * k if self.room[2 * k] >= size else 2 * k + 1
        had = self.room[k]
        self.room[k] -= size
        found = k - self.leaves
        while k > 1:
            k //= 2
            self.room[k] = max(self.room[2 * k], self.room[2 * k + 1])
        return found, had


def first_fit_decreasing(sizes: list[int], capacity: int) -> list[tuple[int, int]]:
    """(bin, offset) of each item, none larger than ``capacity``; equal sizes keep their order."""
    tree, out = BinTree(max(1, len(sizes)), capacity), [(0, 0)] * len(sizes)
    for k in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        b, had = tree.place(sizes[k])
        out[k] = (b, capacity - had)
    return out


PIECES = T.StructType([T.StructField(n, T.LongType()) for n in ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")])


def pack(docs: DataFrame, tokenizer_path: str, *, key: str = "doc_id", text: str = "text", sequence: int = SEQUENCE,
         end_id: int = END_ID, group_docs: int = GROUP_DOCS) -> DataFrame:
    """Pieces of all documents: key, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A null or empty text is the end id alone. Rows that repeat a key are documents of their own, each with its
    pieces; a null key is kept. Other columns of ``docs`` aren't read. No rows give no pieces.
    The group of a document is drawn from a hash of its key, length, checksums, its task and how many rows like it the task
    had before: a task that runs again draws alike, and rows that are all alike are spread over the groups. Equal sizes are
    placed in the order of their keys. A very long text is encoded whole and cut into pieces.
    """
    groups = max(1, -(-docs.count() // group_docs))
    measured = T.StructType([docs.schema[key], T.StructField("n", T.LongType()), T.StructField("crcs", T.ArrayType(T.LongType())), T.StructField("before", T.LongType())])

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer, end = tokenizer_at(tokenizer_path), np.array([end_id], "<u4")
        # Rows alike get the numbers 0, 1, 2 ... of their task in any order: what matters is how many there are.
        task, seen = TaskContext.get().partitionId() << 32, Counter()
        for batch in sub_batches(batches, text, 4 << 20):
            ids, bounds = tokenizer.encode(batch.column(text))
            ids, n, crcs = ids.astype("<u4"), (np.diff(bounds) + 1).tolist(), []
            for a, b in zip(bounds.tolist(), bounds[1:].tolist()):
                whole = np.concatenate((ids[a:b], end))
                crcs.append([zlib.crc32(whole[k : k + sequence].tobytes()) for k in range(0, len(whole), sequence)])
            before = []
            for like in zip(batch.column(key).to_pylist(), n, map(tuple, crcs)):
                like = hash(like)  # of numbers mostly; a chance meeting only leaves a number out
                before.append(task + seen[like])
                seen[like] += 1
            yield pa.RecordBatch.from_arrays([batch.column(key), pa.array(n, pa.int64()), pa.array(crcs, pa.list_(pa.int64())), pa.array(before, pa.int64())], [key, "n", "crcs", "before"])

    drawn = docs.select(key, text).mapInArrow(measure, measured).withColumn("g", F.pmod(F.xxhash64(key, "n", "crcs", "before"), F.lit(groups)))
    out_schema = T.StructType([docs.schema[key], *PIECES.fields])

    def fit(table: pa.Table) -> pa.Table:
        g = table.column("g")[0].as_py()
        rows = sorted(zip(table.column(key).to_pylist(), table.column("n").to_pylist(), table.column("crcs").to_pylist()), key=repr)
        rests = [n % sequence for _, n, _ in rows]
        small = [k for k, r in enumerate(rests) if r]
        placed = dict(zip(small, first_fit_decreasing([rests[k] for k in small], sequence)))
        base = g << 40
        following = base + 1 + max((b for b, _ in placed.values()), default=-1)
        out: list[tuple] = []
        for k, (doc, n, crcs) in enumerate(rows):
            for j, crc in enumerate(crcs):
                length = min(sequence, n - j * sequence)
                if length == sequence:
                    out.append((doc, j * sequence, length, crc, n, following, 0))
                    following += 1
                else:
                    b, offset = placed[k]
                    out.append((doc, j * sequence, length, crc, n, base + b, offset))
        columns = list(zip(*out))
        return pa.table([pa.array(columns[0], table.schema.field(key).type), *(pa.array(c, pa.int64()) for c in columns[1:])], names=out_schema.names)

    return drawn.groupBy("g").applyInArrow(fit, out_schema)


def tokenizer_file() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(documents(spark, sf_dir), tokenizer_file())
