"""Language-model scoring by a hidden Markov model over whole words.

Latent states emit symbols: each common word is a symbol of its own, other words share one symbol for each class of
word endings, and the text's end is a symbol. A word's probability is its symbol's in the state times its share of the
symbol's words, counted over all training texts with one added to each count, so the model is proper over all words.
Baum-Welch runs forward and backward over each whole training text; a shard's expected counts are summed in the tasks
as whole multiples of ``UNIT``, so that their order doesn't matter and the model doesn't depend on how rows are
partitioned. Scoring is the scaled forward recursion over each whole text: its exact likelihood under the model.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.llm.common import documents, durable, give_back, text_bytes
from ledgerloom.llm.language import held_out
from ledgerloom.llm.shards import TOLD, Exchange, hash_words, pack, pack_sorted, shard_count, sharded, unpack, unpack_sorted, word_codes

STATES = 8
ITERATIONS = 4
#: Words with at least this share of the training tokens are symbols of their own: at most 1 / COMMON_SHARE.
COMMON_SHARE = 1e-4
CLASSES = 251
#: Symbols that a task runs the recursions over at a time; a text with more is taken whole.
BATCH_SYMBOLS = 1 << 19
#: Expected counts are summed as whole multiples of this.
UNIT = 2.0**-16
SEED = 20240607
_END = CLASSES  # symbols: classes, the end, then the common words


def word_class(word: str) -> int:
    return xxhash.xxh32_intdigest(word.rstrip(".,;:!?*%$#&")[-3:]) % CLASSES


@dataclass
class Vocabulary:
    """Bounded: the common words' keys in order, and the other words' counts by class."""

    common: np.ndarray
    class_tokens: np.ndarray
    class_words: np.ndarray
    tokens: int
    words: int
    texts: int

    def symbols(self, keys: np.ndarray) -> np.ndarray:
        """The symbol of each word."""
        classes = (keys & np.uint64(255)).astype(np.int64)
        if not len(self.common):
            return classes
        at = np.minimum(np.searchsorted(self.common, keys), len(self.common) - 1)
        return np.where(self.common[at] == keys, _END + 1 + at, classes)

    @property
    def size(self) -> int:
        return _END + 1 + len(self.common)


@dataclass
class Model:
    start: np.ndarray
    move: np.ndarray
    emit: np.ndarray  # symbol, state

    @classmethod
    def initial(cls, symbols: int, states: int = STATES) -> Model:
        random = np.random.default_rng(SEED)
        emit = random.gamma(2.0, size=(symbols, states))
        move = np.full((states, states), 0.05 / max(1, states - 1))
        np.fill_diagonal(move, 0.95)
        return cls(np.full(states, 1 / states), move / move.sum(1, keepdims=True), emit / emit.sum(0))

    def expected(self, symbols: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Baum-Welch counts of stretches of symbols, longest first, none empty: starts, moves, emissions."""
        sizes = np.diff(bounds)
        k = len(self.start)
        live = np.searchsorted(-sizes, -np.arange(1, sizes[0] + 1), side="right")  # stretches with more than t symbols
        offsets = np.concatenate(([0], np.cumsum(live)))
        # By time, then stretch: the place of each symbol, so that a step is one slice.
        time = np.arange(len(symbols)) - np.repeat(bounds[:-1] - bounds[0], sizes)
        ordered = np.empty(len(symbols), np.int64)
        ordered[offsets[time] + np.repeat(np.arange(len(sizes)), sizes)] = symbols
        move, back = self.move.astype(np.float32), np.ascontiguousarray(self.move.T.astype(np.float32))
        emit = self.emit.astype(np.float32)[ordered]
        alpha, scale = np.empty_like(emit), np.empty((len(emit), 1), np.float32)
        spans = list(zip(offsets[:-1].tolist(), offsets[1:].tolist()))
        before = None
        for a, b in spans:
            now = alpha[a:b]
            np.multiply(self.start.astype(np.float32) if before is None else before[: b - a] @ move, emit[a:b], out=now)
            np.add.reduce(now, axis=1, keepdims=True, out=scale[a:b])
            now /= scale[a:b]
            before = now
        beta = np.ones_like(emit)
        for (a, _), (c, d) in zip(reversed(spans[:-1]), reversed(spans[1:])):
            after = emit[c:d]  # from here on: emission times beta by scale
            after *= beta[c:d]
            after /= scale[c:d]
            np.matmul(after, back, out=beta[a : a + d - c])
        beta *= alpha  # the states' probabilities
        later = offsets[1]
        earlier = np.arange(later, len(ordered)) - np.repeat(live[:-1], live[1:])
        moves = (alpha[earlier].T.astype(float) @ emit[later:].astype(float)) * self.move
        emissions = np.stack([np.bincount(ordered, weights=beta[:, s], minlength=len(self.emit)) for s in range(k)], axis=1)
        return beta[:later].sum(0, dtype=float), moves, emissions

    def log_likelihood(self, symbols: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Natural logarithm of the probability of each stretch of symbols; the forward recursion, scaled at each step."""
        length = np.diff(bounds)
        order = np.argsort(-length, kind="stable")
        first, sizes = bounds[:-1][order], length[order]
        live = np.searchsorted(-sizes, -np.arange(1, (sizes[0] if len(sizes) else 0) + 1), side="right")
        out = np.zeros(len(order))
        now = np.broadcast_to(self.start, (len(order), len(self.start))).copy()
        for t, n in enumerate(live.tolist()):
            part = now[:n] if t == 0 else now[:n] @ self.move
            part = part * self.emit[symbols[first[:n] + t]]
            total = part.sum(1)
            out[:n] += np.log(total)
            now = part / total[:, None]
        result = np.empty(len(order))
        result[order] = out
        return result


def _join(*parts: bytes) -> bytes:
    return b"".join(len(p).to_bytes(8, "little") + p for p in parts)


def _split(raw: bytes) -> list[bytes]:
    out, at = [], 0
    while at < len(raw):
        size = int.from_bytes(raw[at : at + 8], "little")
        out.append(raw[at + 8 : at + 8 + size])
        at += 8 + size
    return out


def _digest(keys: np.ndarray, totals: np.ndarray) -> bytes:
    """Of a bucket of words: those that may be common, and counts and words by class."""
    top, trained = int(1 / COMMON_SHARE), totals > 0
    most = np.flatnonzero(trained)
    if len(most) > top:
        most = np.sort(most[np.argpartition(-totals[most].astype(np.int64), top)[:top]])  # no more can have the share
    classes = (keys[trained] & np.uint64(255)).astype(np.int64)
    tokens = np.bincount(classes, weights=totals[trained].astype(float), minlength=CLASSES).astype(np.int64)
    return _join(pack_sorted(keys[most]), pack(totals[most]), pack(tokens), pack(np.bincount(classes, minlength=CLASSES).astype(np.int64)))


class _Words:
    """The words of one shard, its texts longest first: distinct keys in order, training counts, the place of each token.

    A word's key is its hash with the word's class in the low byte.
    """

    def __init__(self, table: pa.Table):
        words, index, bounds = word_codes(table.column("_text"), lower=True)
        sizes = np.diff(bounds)
        # An order that rows' order doesn't change; equal texts are the same whichever comes first.
        self.order = np.lexsort((table.column("_row").to_numpy(), -sizes))
        self.sizes = sizes[self.order]
        words = words or [""]
        classes = np.fromiter(map(word_class, words), np.uint64, len(words))
        keys = hash_words(words) & ~np.uint64(255) | classes
        self.keys, place = np.unique(keys, return_inverse=True)
        starts = bounds[:-1][self.order]
        ends = np.cumsum(self.sizes)
        self.tokens = place[index[np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - ends + self.sizes, self.sizes)]]
        self.train = table.column("_train").to_numpy(zero_copy_only=False).astype(bool)[self.order]
        self.counts = np.bincount(self.tokens, weights=np.repeat(self.train, self.sizes).astype(float), minlength=len(self.keys)).astype(np.uint64)


def prepare(docs: DataFrame, shards: int, key: T.StructField) -> DataFrame:
    """A row for each shard, its texts longest first: keys, train, sizes (words) and, packed, vocab (distinct words' keys),
    totals (their training counts over all shards), tokens (each word's place in vocab); and rows with a bucket's digest."""
    exchange = Exchange.of(shards, 4)

    def tell(table: pa.Table) -> pa.Table:
        words = _Words(table)
        return exchange.tell(table.column("_shard")[0].as_py(), words.keys, words.counts)

    told = docs.groupBy("_shard").applyInArrow(tell, TOLD)
    answers = exchange.answers(told, exchange.meet(told, digest=_digest))
    schema = T.StructType([
        T.StructField("keys", T.ArrayType(key.dataType)), T.StructField("train", T.ArrayType(T.BooleanType())), T.StructField("sizes", T.ArrayType(T.LongType())),
        *(T.StructField(n, T.BinaryType()) for n in ("vocab", "totals", "tokens", "digest")),
    ])

    def join(table: pa.Table, answer: pa.Table) -> pa.Table:
        if not table.num_rows:
            found = answer.column("totals")
            return pa.table([*(pa.nulls(len(found), pa.list_(t)) for t in (table.schema.field("_key").type, pa.bool_(), pa.int64())), *[pa.nulls(len(found), pa.binary())] * 3, found], names=schema.names)
        words = _Words(table)
        totals = exchange.sums(words.keys, answer)
        one = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)
        keys = table.column("_key").combine_chunks().take(pa.array(words.order))
        out = pa.table([
            one(keys.combine_chunks() if isinstance(keys, pa.ChunkedArray) else keys), one(pa.array(words.train)), one(pa.array(words.sizes)),
            *(pa.array([x], pa.binary()) for x in (pack_sorted(words.keys), pack(totals), pack(words.tokens.astype(np.uint32)), None)),
        ], names=schema.names)
        del words
        give_back()
        return out

    return durable(docs.groupBy("_shard").cogroup(answers.groupBy("_shard")).applyInArrow(join, schema), "prepared")


def vocabulary(prepared: DataFrame, texts: int) -> Vocabulary:
    """The bounded part: totals by class, and the words that have the common share."""
    digests = prepared.filter("digest IS NOT NULL").select("digest")
    longs = lambda *names: T.StructType([T.StructField(n, T.LongType()) for n in names])

    def by_class(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums = np.zeros((2, CLASSES), np.int64)
            for raw in batch.column(0).to_pylist():
                sums += [unpack(x, np.int64) for x in _split(raw)[2:]]
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(CLASSES)), *map(pa.array, sums)], ["c", "t", "w"])

    summed = digests.mapInArrow(by_class, longs("c", "t", "w")).groupBy("c").agg(F.sum("t").alias("t"), F.sum("w").alias("w"))
    sums = {r.c: (r.t, r.w) for r in summed.collect()}  # a row for each class
    class_tokens, class_words = (np.array([sums.get(c, (0, 0))[k] for c in range(CLASSES)], np.int64) for k in (0, 1))
    tokens = int(class_tokens.sum()) + texts
    least = max(1, int(np.ceil(COMMON_SHARE * tokens)))

    def common(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for raw in batch.column(0).to_pylist():
                keys, n = _split(raw)[:2]
                n = unpack(n, np.uint64).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(unpack_sorted(keys)[n >= least].view(np.int64)), pa.array(n[n >= least])], ["k", "n"])

    found = digests.mapInArrow(common, longs("k", "n")).collect()  # at most 1 / COMMON_SHARE rows
    keys = np.sort(np.array([r.k for r in found], np.int64).view(np.uint64))
    words = int(class_words.sum()) + (texts > 0)
    for r in found:  # a class shares its symbol among its other words only
        class_tokens[r.k & 255] -= r.n
        class_words[r.k & 255] -= 1
    return Vocabulary(keys, class_tokens, class_words, tokens, words, texts)


def _with_ends(symbols: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(symbols with an end after each text, where each text begins and the end)."""
    bounds = np.concatenate(([0], np.cumsum(sizes)))
    return np.insert(symbols, bounds[1:], _END), bounds + np.arange(len(bounds))


def _runs(bounds: np.ndarray) -> Iterator[np.ndarray]:
    """The bounds of some texts at a time."""
    part = bounds[:-1] // BATCH_SYMBOLS
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(part)]
    for a, b in zip(cuts, cuts[1:]):
        if b > a:
            yield bounds[a : b + 1]


def train(prepared: DataFrame, vocab: Vocabulary, iterations: int = ITERATIONS) -> Model:
    """Baum-Welch over all training texts."""
    model = Model.initial(vocab.size)
    k = len(model.start)
    columns = [f"s{j}" for j in range(k)]
    schema = T.StructType([T.StructField("symbol", T.IntegerType()), *(T.StructField(c, T.LongType()) for c in columns)])
    rows = prepared.filter("digest IS NULL").select("train", "sizes", "vocab", "tokens")
    for _ in range(iterations):
        shared = prepared.sparkSession.sparkContext.broadcast((vocab, model))

        def expect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known, now = shared.value
            # A row for each symbol, then the starts, then the moves from each state.
            summed = np.zeros((known.size + 1 + k, k), np.int64)
            for batch in batches:
                for learns, sizes, words, tokens in zip(*(batch.column(c) for c in ("train", "sizes", "vocab", "tokens"))):
                    learns, sizes = (x.values.to_numpy(zero_copy_only=False) for x in (learns, sizes))
                    symbols = known.symbols(unpack_sorted(words.as_py()))[unpack(tokens.as_py(), np.uint32)[np.repeat(learns, sizes)]]
                    symbols, bounds = _with_ends(symbols, sizes[learns])
                    of_shard = np.zeros(summed.shape)
                    for run in _runs(bounds):
                        starts, moves, emissions = now.expected(symbols[run[0] : run[-1]], run)
                        of_shard += np.concatenate((emissions, starts[None], moves))
                    summed += np.rint(of_shard / UNIT).astype(np.int64)
                give_back()
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(summed), dtype=np.int32)), *(pa.array(summed[:, j]) for j in range(k))], ["symbol", *columns])

        sums = rows.mapInArrow(expect, schema).groupBy("symbol").agg(*(F.sum(c).alias(c) for c in columns)).toPandas().set_index("symbol")
        if sums.empty:
            return model
        counts = sums.reindex(range(vocab.size + 1 + k), fill_value=0)[columns].to_numpy(float) * UNIT
        emit, start, move = counts[: vocab.size] + 0.05, counts[vocab.size] + 1.0, counts[vocab.size + 1 :] + 1.0
        model = Model(start / start.sum(), move / move.sum(1, keepdims=True), emit / emit.sum(0))
    return model


def score(docs: DataFrame, *, key: str = "doc_id", text: str = "text", train_on: F.Column) -> DataFrame:
    """key, in_training, n_tokens, n_known, train_tokens, base_score and score for each row of ``docs``.

    Scores are log10 probabilities: ``base_score`` of a unigram model with one added, ``score`` of the hidden Markov
    model. A null or empty text is its end alone. Rows that repeat a key, or have none, are texts of their own, and
    equal texts get equal scores. With no training rows all words are unknown; no rows give none. Other columns aren't
    read, whatever their names. A very long text is taken whole: its symbols and their states stand in one task.
    """
    marked = docs.select(F.col(key).alias("_key"), F.coalesce(F.col(text), F.lit("")).alias("_text"), F.coalesce(train_on, F.lit(True)).alias("_train"))
    marked = marked.withColumn("_row", F.xxhash64("_text"))
    shards = shard_count(text_bytes(marked, "_text"))
    cut = sharded(marked, shards, ["_key", "_row"], ["_key", "_row", "_text", "_train"])
    prepared = prepare(cut, shards, docs.schema[key])
    vocab = vocabulary(prepared, marked.filter("_train").count())
    model = train(prepared, vocab)
    shared = docs.sparkSession.sparkContext.broadcast((vocab, model))
    names = ["in_training", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    kinds = [T.BooleanType(), T.LongType(), T.LongType(), T.LongType(), T.DoubleType(), T.DoubleType()]
    schema = T.StructType([docs.schema[key], *(T.StructField(n, t) for n, t in zip(names, kinds))])

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, now = shared.value
        for batch in batches:
            for ids, learns, sizes, *packed in zip(*(batch.column(c) for c in ("keys", "train", "sizes", "vocab", "totals", "tokens"))):
                n = sizes.values.to_numpy()
                words, total, tokens = (f(x.as_py()) for f, x in zip((unpack_sorted, lambda x: unpack(x, np.int64), lambda x: unpack(x, np.uint32)), packed))
                symbol, classes = known.symbols(words), (words & np.uint64(255)).astype(np.int64)
                share = np.log((total + 1) / (known.class_tokens[classes] + known.class_words[classes] + 1.0))
                share = np.where(symbol > _END, 0.0, share)
                base = np.log10((total + 1) / (known.tokens + known.words + 1.0))
                end_base = np.log10((known.texts + 1) / (known.tokens + known.words + 1.0))
                row = np.repeat(np.arange(len(n)), n)
                per_text = lambda x: np.bincount(row, weights=x[tokens], minlength=len(n))
                stream, bounds = _with_ends(symbol[tokens], n)
                latent = np.concatenate([now.log_likelihood(stream, run) for run in _runs(bounds)])
                yield pa.RecordBatch.from_arrays([
                    ids.values, learns.values, pa.array(n + 1), pa.array((per_text((total > 0).astype(float)) + (known.texts > 0)).astype(np.int64)),
                    pa.array(np.full(len(n), known.tokens, np.int64)), pa.array(per_text(base) + end_base), pa.array((latent + per_text(share)) / np.log(10)),
                ], schema.names)
            give_back()

    return prepared.filter("digest IS NULL").select("keys", "train", "sizes", "vocab", "totals", "tokens").mapInArrow(apply, schema)


def op9_hmm(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = score(documents(spark, sf_dir), train_on=~held_out(2, 7))
    return out.select("doc_id", (~F.col("in_training")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
