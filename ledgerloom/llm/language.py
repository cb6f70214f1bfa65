"""Language identification by language-bitmask n-gram filters.

The character n-grams of each language go into one bit-sliced Bloom filter: a slot holds a bit for each language, in as
many words as they need, and the AND over an n-gram's slots is the set of all languages that contain it. A text is
decided by the set bits of its n-grams for each language, less the false positives that the filter's filling lets
expect. A language contains the n-grams with at least ``least_share`` of all its n-grams in training; hits are taken
against the share that these have there, so that a score doesn't move with how many rare ones a large corpus has.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.llm.common import documents, durable, sub_batches

GRAM = 4
#: A language contains an n-gram with at least this share of its n-grams: at most 1 / LEAST_SHARE of them.
LEAST_SHARE = 1e-5
#: Slots of a filter, or more if a language has many n-grams.
SLOTS = 1 << 20
SLOTS_PER_GRAM = 8
HASHES = 3
#: Languages in one word of a slot.
WORD = 64
UNKNOWN = "und"
#: Bytes of text that a task takes at a time; a longer text is taken whole.
BATCH_BYTES = 1 << 20
#: Distinct n-grams that a training task holds before it hands some on.
HELD_GRAMS = 1 << 20

_BLANK = 0x20


def gram_codes(texts: list[str | None], n: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """(n-gram hashes of all texts, text number of each). Letters in lower case; others, and both ends, are one blank."""
    lowered = [f" {t.lower() if t else ''} " for t in texts]
    sizes = np.array([len(t) for t in lowered], np.int64)
    owner = np.repeat(np.arange(len(texts), dtype=np.int32), sizes)
    points = np.frombuffer("".join(lowered).encode("utf-32-le"), np.uint32)
    letter = _letters(points)
    keep = letter.copy()
    keep[1:] |= letter[:-1]  # of blanks in a row the first only
    keep[np.cumsum(sizes) - sizes] = True
    points, owner = np.where(letter, points, _BLANK)[keep], owner[keep]
    del letter, keep
    size = len(points) - n + 1
    if size <= 0:
        return np.empty(0, np.int64), np.empty(0, np.int32)
    inside = owner[:size] == owner[n - 1 :]
    code = np.zeros(size, np.uint64)
    for k in range(n):
        code += points[k : size + k]
        code *= np.uint64(0x9E3779B97F4A7C15)
        code ^= code >> np.uint64(29)
    return code[inside].view(np.int64), owner[:size][inside]


_LETTER = np.zeros(0, bool)


def _letters(points: np.ndarray) -> np.ndarray:
    global _LETTER
    if not len(_LETTER):
        _LETTER = np.fromiter((chr(k).isalpha() if not 0xD800 <= k < 0xE000 else False for k in range(0x110000)), bool, 0x110000)
    return _LETTER[points]


def _mix(code: np.ndarray, seed: int) -> np.ndarray:
    x = code.astype(np.uint64)
    x *= np.uint64(0x9E3779B97F4A7C15)
    x += np.uint64((seed * 0xD1B54A32D192ED03) & (2**64 - 1))
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(32)
    return x


@dataclass
class LanguageFilter:
    languages: list[str]
    #: A row for each WORD languages.
    slots: np.ndarray
    #: For each language, the share of its n-grams in training that the filter contains.
    cover: np.ndarray

    @classmethod
    def empty(cls, languages: list[str], cover: list[float], size: int = SLOTS) -> LanguageFilter:
        return cls(languages, np.zeros((-(-len(languages) // WORD), size), np.uint64), np.array(cover, float))

    @classmethod
    def build(cls, languages: list[str], grams: dict[str, np.ndarray], size: int = SLOTS) -> LanguageFilter:
        out = cls.empty(languages, [1.0] * len(languages), size)
        for k, language in enumerate(languages):
            out.add(k, grams[language])
        return out

    def add(self, k: int, grams: np.ndarray) -> None:
        """Learn n-grams of language number k."""
        slots = self.slots[k // WORD]
        for seed in range(HASHES):
            at = np.unique(_mix(grams, seed) % np.uint64(len(slots))).astype(np.int64)
            slots[at] |= np.uint64(1 << (k % WORD))

    def masks(self, code: np.ndarray, word: int = 0) -> np.ndarray:
        """The languages of a word, as bits, that contain each n-gram."""
        out = np.full(len(code), 2**64 - 1, np.uint64)
        for seed in range(HASHES):
            out &= self.slots[word][(_mix(code, seed) % np.uint64(self.slots.shape[1])).astype(np.int64)]
        return out

    def scores(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """(language, share of n-grams that it contains, less false positives, by its cover); UNKNOWN if a text has no letter."""
        code, owner = gram_codes(texts)
        has_letter = [bool(t) and any(map(str.isalpha, t)) for t in texts]
        if not self.languages:
            return [(UNKNOWN, 0.0)] * len(texts)
        total = np.bincount(owner, minlength=len(texts)).astype(float)
        part = np.zeros((len(self.languages), len(texts)))
        for k in range(len(self.languages)):
            word, bit = k // WORD, np.uint64(k % WORD)
            if k % WORD == 0:
                mask = self.masks(code, word)
            hits = np.bincount(owner, weights=((mask >> bit) & np.uint64(1)).astype(float), minlength=len(texts))
            false = float(np.mean((self.slots[word] >> bit) & np.uint64(1))) ** HASHES
            part[k] = (hits - false * total) / np.maximum(total * (1 - false), 1e-9) / self.cover[k]
        best = np.argmax(part, axis=0)  # ties: the first in the order of the languages
        value = np.clip(part[best, np.arange(len(texts))], 0, 1)
        return [(self.languages[b], float(v)) if ok else (UNKNOWN, 0.0) for b, v, ok in zip(best.tolist(), value, has_letter)]


def train(labelled: DataFrame, *, text: str = "text", lang: str = "lang", least_share: float = LEAST_SHARE) -> LanguageFilter:
    """Learn from all rows with a language: n-grams are counted in the tasks and summed by Spark.

    ``least_share`` bounds what the driver gets: 1 / least_share n-grams of a language. With 0 every n-gram that occurs is
    learned, whatever their number. Null texts and null languages teach nothing; a repeated row counts each time; of no
    rows, or of texts without a letter, no language is learned. Other columns aren't read. A very long text is counted
    whole.
    """
    schema = T.StructType([T.StructField("lang", T.StringType()), T.StructField("gram", T.LongType()), T.StructField("n", T.LongType())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, tuple[np.ndarray, np.ndarray]] = {}

        def told(language: str) -> pa.RecordBatch:
            grams, n = known.pop(language)
            return pa.RecordBatch.from_arrays([pa.array([language] * len(grams), pa.string()), pa.array(grams), pa.array(n)], ["lang", "gram", "n"])

        for batch in sub_batches(batches, "t", BATCH_BYTES):
            langs, texts = np.array(batch.column("l").to_pylist(), object), batch.column("t").to_pylist()
            for language in sorted(set(langs)):
                code, _ = gram_codes([texts[k] for k in np.flatnonzero(langs == language)])
                grams, n = np.unique(code, return_counts=True)
                if language in known:
                    grams, back = np.unique(np.concatenate((known[language][0], grams)), return_inverse=True)
                    n = np.bincount(back, weights=np.concatenate((known[language][1], n))).astype(np.int64)
                known[language] = grams, n.astype(np.int64)
            while sum(len(g) for g, _ in known.values()) > HELD_GRAMS:
                yield told(max(known, key=lambda k: len(known[k][0])))
        for language in list(known):
            yield told(language)

    rows = labelled.filter(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(lang).alias("l"), F.col(text).alias("t"))
    counts = durable(rows.mapInArrow(count, schema).groupBy("lang", "gram").agg(F.sum("n").alias("n")), "language-counts")
    totals = counts.groupBy("lang").agg(F.sum("n").alias("total"))
    learned = durable(counts.join(F.broadcast(totals), "lang").filter(F.col("n") >= least_share * F.col("total")).select("lang", "gram", (F.col("n") / F.col("total")).alias("share")), "language-grams")
    found = sorted((r.lang, r.cover, r.n) for r in learned.groupBy("lang").agg(F.sum("share").alias("cover"), F.count("*").alias("n")).collect())  # a row for each language
    size = max(SLOTS, 1 << (SLOTS_PER_GRAM * max((n for _, _, n in found), default=1)).bit_length() - 1)
    model = LanguageFilter.empty([x for x, _, _ in found], [c for _, c, _ in found], size)
    for a in range(0, len(found), WORD):
        names = model.languages[a : a + WORD]
        part = learned.filter(F.col("lang").isin(names)).select("lang", "gram").toPandas()  # at most WORD / least_share rows, whatever the corpus
        for language, grams in part.groupby("lang")["gram"]:
            model.add(a + names.index(language), grams.to_numpy(np.int64))
    return model


def predict(docs: DataFrame, model: LanguageFilter, *, text: str = "text", lang_out: str = "lang_pred", score_out: str = "score",
            carry: list[str] | None = None) -> DataFrame:
    """Rows of ``docs`` with the predicted language and its score; ``text`` alone is looked at.

    A null text or one without a letter, and any text under a model of no language, gets ``und`` and 0. Of languages
    with one score the first in order is taken. Repeated rows get the same result, null keys are rows like others, a very
    long text is read whole. Columns named like the results are replaced.
    """
    columns = [c for c in (carry or docs.columns) if c not in (lang_out, score_out)]
    schema = T.StructType([*(docs.schema[c] for c in columns), T.StructField(lang_out, T.StringType()), T.StructField(score_out, T.DoubleType())])
    shared = docs.sparkSession.sparkContext.broadcast((model.languages, model.slots, model.cover))

    sent = text if text in columns else "_text"  # a text that is carried is sent once

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        learned = LanguageFilter(*shared.value)
        for batch in sub_batches(batches, sent, BATCH_BYTES):
            found = learned.scores(batch.column(sent).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in columns), pa.array([x for x, _ in found], pa.string()), pa.array([s for _, s in found], pa.float64())],
                [*columns, lang_out, score_out],
            )

    return docs.select(*columns, *([] if sent == text else [F.col(text).alias(sent)])).mapInArrow(run, schema)


def held_out(part: int, of: int, key: str = "doc_id") -> F.Column:
    return F.pmod(F.crc32(F.col(key).cast("string").cast("binary")), F.lit(of)) == part


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    apart = F.coalesce(held_out(2, 4), F.lit(False))  # a row without an id is none of those held out
    model = train(docs.filter(~apart))
    out = predict(docs.select("doc_id", "text"), model, carry=["doc_id"])
    return out.select("doc_id", apart.alias("held_out"), "lang_pred", "score")
