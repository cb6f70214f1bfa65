"""A text index: tokens with their positions and the token after them, sorted by token, for phrases whose last word may be a beginning.

The postings are a table in ranges of tokens, so a search for a token or a beginning reads the row groups that can have it.
A phrase is looked up by its pairs of neighbours: far fewer places have a pair than have one of its words.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.operators.tables import spaced, tokens
from ledgerloom.session import shared_path

#: Postings of a file, on average.
FILE_POSTINGS = 2_000_000
#: Postings that a task sorts and packs together, unless one batch of texts has more.
BLOCK_POSTINGS = 1_500_000
#: Places of a row at most: a pair that is everywhere has many rows.
ROW_PLACES = 1024
#: Bounds of files are told to this share of a file, from this share of the texts or more.
MARKS = 64
#: Texts that bounds are told from, if there are so many.
MARKED_TEXTS = 4000


def _spaced_texts(rows: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """_key, _column (its number), _text: the tokens of each text, with blanks between them. Null texts and those without a token have none."""
    texts = F.explode(F.array(*(F.struct(F.lit(n).alias("_column"), F.col(c).alias("_text")) for n, c in enumerate(columns))))
    each = rows.select(F.col(key).alias("_key"), texts.alias("x")).select("_key", "x._column", spaced(F.col("x._text")).alias("_text"))
    return each.filter("_text <> ''")


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows in tables of about ``BLOCK_POSTINGS`` tokens, with _ts, the tokens, for _text."""
    held, size = [], 0
    for batch in batches:
        batch = batch.set_column(2, "_ts", pc.split_pattern(batch.column("_text"), " "))
        ends = np.cumsum(np.diff(batch.column("_ts").offsets.to_numpy()))
        begin = 0
        while begin < batch.num_rows:
            before = ends[begin - 1] if begin else 0
            end = min(batch.num_rows, int(np.searchsorted(ends, before + BLOCK_POSTINGS - size)) + 1)
            held.append(batch.slice(begin, end - begin))
            size += int(ends[end - 1] - before)
            begin = end
            if size >= BLOCK_POSTINGS:
                yield pa.Table.from_batches(held)
                held, size = [], 0
    if held:
        yield pa.Table.from_batches(held)


def _one(column: pa.ChunkedArray) -> pa.Array:
    return column.chunk(0) if column.num_chunks == 1 else column.combine_chunks()


def _ranked(words: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """(the words in order, the place of each there)"""
    order = pc.sort_indices(words)
    place = np.empty(len(words), np.int32)
    place[order.to_numpy()] = np.arange(len(words), dtype=np.int32)
    return words.take(order), place


def _in_order(*codes: np.ndarray) -> np.ndarray:
    """What puts rows in the order of their codes, rows alike as they are."""
    most, key = 1, 0
    for c in codes:
        size = int(c.max(initial=0)) + 1
        most, key = most * size, key * size + c.astype(np.int64)
    bits = len(key).bit_length()
    if most.bit_length() + bits < 64:  # a number that has its place in it is sorted faster than places by a number
        return np.sort(key << bits | np.arange(len(key))) & ((1 << bits) - 1)
    return np.lexsort(codes[::-1])


def _sorted(texts: pa.Table) -> pa.Table:
    """The texts' postings, by token, the token after it (empty after the last) and column."""
    lists = _one(texts.column("_ts"))
    sizes = pc.list_value_length(lists).to_numpy()
    coded = lists.flatten().dictionary_encode()
    words, place = _ranked(pa.concat_arrays([coded.dictionary, pa.array([""], coded.dictionary.type)]))
    token = place[coded.indices.to_numpy()]
    follows = np.append(token[1:], np.int32(0))
    ends = np.cumsum(sizes, dtype=np.int64)
    follows[ends - 1] = 0  # the empty one is first in order
    row = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
    order = _in_order(token, follows, _one(texts.column("_column")).to_numpy()[row])
    row = row[order]
    at = (order - (ends - sizes)[row]).astype(np.int32)
    pair = [pa.DictionaryArray.from_arrays(codes[order], words) for codes in (token, follows)]
    return pa.table([*pair, *(_one(texts.column(c)).take(pa.array(row)) for c in ("_column", "_key")), pa.array(at)], ["_token", "_next", "_column", "_key", "_at"])


def _codes(table: pa.Table, column: str) -> tuple[np.ndarray, pa.Array]:
    held = _one(table.column(column))
    return held.indices.to_numpy(), held.dictionary


def _packed(postings: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, postings.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_table(postings)
    return sink.getvalue().to_pybytes()


def _unpacked(raw: pa.Scalar) -> pa.Table:
    return pa.ipc.open_stream(raw.as_buffer()).read_all()


_MARK = T.StructType([T.StructField("_token", T.StringType())])
_PARTS = T.StructType([T.StructField("_range", T.IntegerType()), T.StructField("_postings", T.BinaryType())])


def _marks(texts: DataFrame, apart: int) -> DataFrame:
    """The token at each ``apart``-th place of the texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() * 7919 % apart  # small tasks have a mark in turn
        for part in _gathered(batches):
            words = _one(part.column("_ts")).flatten()
            yield pa.RecordBatch.from_arrays([words.take(pa.array(np.arange(first, len(words), apart)))], _MARK.names)
            first = (first - len(words)) % apart

    return texts.mapInArrow(run, _MARK)


def _in_ranges(texts: DataFrame, bounds: list[str]) -> DataFrame:
    """_range, _postings: the texts' postings, sorted some millions at a time, cut where the files begin and packed.

    A token that is the bound of several files is dealt over them.
    """
    files = Counter(bounds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in _gathered(batches):
            block = _sorted(some)
            (token, words), (follows, _) = _codes(block, "_token"), _codes(block, "_next")
            begins = np.concatenate(([0], np.cumsum(np.bincount(token, minlength=len(words)))))
            known, cuts = words.to_pylist(), [0]
            for bound, n in files.items():
                begin, end = (int(begins[f(known, bound)]) for f in (bisect_left, bisect_right))
                cuts += [begin + (end - begin) * k // n for k in range(n)]
            cuts.append(block.num_rows)
            for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
                if b > a:
                    used, place = np.unique(follows[a:b], return_inverse=True)
                    after = pa.DictionaryArray.from_arrays(place.astype(np.int32), words.take(pa.array(used)))
                    own = pa.DictionaryArray.from_arrays(token[a:b] - token[a], words.slice(token[a], token[b - 1] - token[a] + 1))
                    part = block.slice(a, b - a).set_column(0, "_token", own).set_column(1, "_next", after)
                    yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([_packed(part)], pa.binary())], _PARTS.names)

    return texts.mapInArrow(run, _PARTS)


def _merged(ranges: DataFrame, schema: T.StructType) -> DataFrame:
    """_token, _next, _column, _places: a row or more for each pair of neighbours in a column, in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [_unpacked(raw) for batch in batches for raw in batch.column("_postings")]
        if not parts:
            return
        table = pa.concat_tables(parts).unify_dictionaries().combine_chunks()
        parts.clear()
        (token, words), (follows, others) = _codes(table, "_token"), _codes(table, "_next")
        place, after = _ranked(words)[1], _ranked(others)[1]
        codes = [place[token], after[follows], _one(table.column("_column")).to_numpy()]
        order = _in_order(*codes)
        new = np.zeros(len(order), bool)
        for c in codes:
            new[1:] |= np.diff(c[order]) != 0
        new[::ROW_PLACES] = True
        begins = np.flatnonzero(new)
        for a in range(0, len(order), 64 * ROW_PLACES):
            rows = order[a : a + 64 * ROW_PLACES]
            own = begins[slice(*np.searchsorted(begins, (a, a + len(rows))))] - a
            first = rows[own]
            places = pa.StructArray.from_arrays([_one(table.column(c)).take(pa.array(rows)) for c in ("_key", "_at")], ["_key", "_at"])
            lists = pa.ListArray.from_arrays(pa.array(np.append(own, len(rows)), pa.int32()), places)
            yield pa.RecordBatch.from_arrays([words.take(pa.array(token[first])), others.take(pa.array(follows[first])), pa.array(codes[2][first]), lists], schema.names)

    return ranges.mapInArrow(run, schema)


def write_index(rows: DataFrame, path: str, *, key: str, columns: list[str]) -> None:
    """Write the index of the texts in ``columns`` to ``path``.

    A common token can fill several files. Rows that repeat a key are one row to a search; rows without a key are left out.
    Postings are shuffled sorted and packed: as rows of their own they'd be several times as many bytes. Where the files
    begin is told by the tokens of some of the texts, so all texts are cut once; it changes the files' sizes only.
    """
    keyed = rows.filter(F.col(key).isNotNull())
    texts = _spaced_texts(keyed, key, columns)
    share = max(1, min(MARKS, keyed.count() // MARKED_TEXTS))
    apart = max(1, FILE_POSTINGS // MARKS // share)
    some = _spaced_texts(keyed.filter(F.pmod(F.xxhash64(key), F.lit(share)) == 0), key, columns)
    marks = sorted(r[0] for r in _marks(some, apart).collect())
    step = max(1, FILE_POSTINGS // (apart * share))
    bounds = marks[step::step]
    place = T.StructType([T.StructField("_key", texts.schema["_key"].dataType), T.StructField("_at", T.IntegerType())])
    schema = T.StructType([T.StructField("_token", T.StringType()), T.StructField("_next", T.StringType()), T.StructField("_column", T.IntegerType()), T.StructField("_places", T.ArrayType(place))])
    placed = _in_ranges(texts, bounds).repartitionById(len(bounds) + 1, "_range")
    _merged(placed, schema).write.option("compression", "zstd").parquet(f"{path}/postings")


def _words(phrase: str) -> list[str]:
    return "".join(c if c.isalnum() else " " for c in phrase.lower()).split()


def phrase_keys(spark: SparkSession, path: str, phrase: str) -> DataFrame:
    """_key of the rows where a column has the phrase's words in a row, the last as the beginning of a word; none for no words."""
    found = spark.read.parquet(f"{path}/postings")
    words = _words(phrase)
    if not words:
        return found.select(F.inline("_places")).select("_key").limit(0)
    *whole, last = words
    begins = lambda rows, k: rows.select("_column", F.inline("_places")).select("_key", "_column", (F.col("_at") - k).alias("_begin"))
    parts = [begins(found.filter(F.col("_token") == w), k) for k, w in enumerate(whole)]
    parts.append(begins(found.filter(F.col("_token").startswith(last)), len(whole)))
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    # A place holds one token, so each word counts once for a beginning.
    return every.groupBy("_key", "_column", "_begin").agg(F.count("*").alias("_n")).filter(F.col("_n") == len(words)).select("_key").distinct()


def _written(rows: DataFrame, name: str) -> DataFrame:
    """The rows, written so that they're made once and their size is known to the joins."""
    path = shared_path(rows.sparkSession, name)
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def search_phrases(spark: SparkSession, path: str, phrases: DataFrame, *, phrase_id: str = "phrase_id", phrase: str = "phrase") -> DataFrame:
    """(``phrase_id``, _key) for a table of phrases; phrases without a word have no rows. Ids that repeat are one phrase each time.

    Only the places of the phrases' pairs of neighbours leave the index. A phrase begins only where its rarest pair stands:
    the other pairs are looked up at the places that this leaves, and a place that many phrases ask for goes to them once.
    """
    found = spark.read.parquet(f"{path}/postings")
    listed = phrases.select(F.col(phrase_id).alias("_id"), tokens(F.col(phrase)).alias("_ws")).filter(F.size("_ws") > 0).distinct()
    listed = _written(listed.select("_id", "_ws", F.xxhash64("_id", "_ws").alias("_p"), (F.size("_ws") - 1).alias("_k")), "listed")
    pair = lambda w, i: F.struct(i.alias("_i"), w.alias("_word"), F.get("_ws", i + 1).alias("_ahead"), (i == F.col("_k") - 1).alias("_open"))
    pairs = listed.filter("_k > 0").select("_id", "_p", "_k", F.explode(F.transform(F.slice("_ws", F.lit(1), F.greatest("_k", F.lit(1))), pair)).alias("w")).select("_id", "_p", "_k", "w.*")
    asked = _written(pairs.select("_word", "_ahead", "_open").distinct().withColumn("_pair", F.monotonically_increasing_id()), "asked")
    singles = listed.filter("_k = 0").select("_id", F.get("_ws", F.lit(0)).alias("_ahead"))
    # A place answers to the token after it, and to its beginnings of the lengths that are asked for: equality joins.
    sizes, single_sizes = ([r[0] for r in x.select(F.length("_ahead")).distinct().collect()] for x in (asked.filter("_open"), singles))
    begun = lambda c, ns: [F.struct(F.when(F.length(c) >= n, F.left(F.col(c), F.lit(n))).alias("_ahead"), F.lit(True).alias("_open")) for n in ns]
    near = found.withColumnRenamed("_token", "_word").join(asked.select("_word").distinct(), "_word", "left_semi")
    answers = near.select("_word", F.explode(F.array(F.struct(F.col("_next").alias("_ahead"), F.lit(False).alias("_open")), *begun("_next", sizes))).alias("a"), "_column", "_places")
    places = answers.select("_word", "a.*", "_column", "_places").join(asked, ["_word", "_ahead", "_open"]).select("_pair", "_column", F.inline("_places"))
    places = _written(places, "places")
    often = places.groupBy("_pair").agg(F.count("*").alias("_often"))
    ordered = pairs.join(asked, ["_word", "_ahead", "_open"]).join(often, "_pair", "left").groupBy("_id", "_p", "_k").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("_often", F.lit(0)).alias("n"), "_i", "_pair"))).alias("_ws"))
    ordered = _written(ordered, "phrases")
    rarest = ordered.select("_id", "_p", "_k", F.get("_ws", F.lit(0)).alias("w")).select("_id", "_p", "_k", "w._i", "w._pair")
    others = ordered.select(F.col("_id").alias("_id2"), F.col("_p").alias("_p2"), F.explode(F.slice("_ws", F.lit(2), F.greatest(F.col("_k") - 1, F.lit(1)))).alias("w")).select("_id2", "_p2", "w._i", "w._pair")
    starts = places.join(rarest, "_pair").select("_id", "_p", "_k", "_key", "_column", (F.col("_at") - F.col("_i")).alias("_begin"))
    needed = starts.join(others, (F.col("_p") == F.col("_p2")) & F.col("_id").eqNullSafe(F.col("_id2"))).withColumn("_at", F.col("_begin") + F.col("_i"))
    met = needed.join(places, ["_pair", "_key", "_column", "_at"], "left_semi").groupBy("_id", "_p", "_k", "_key", "_column", "_begin").agg(F.size(F.collect_set("_i")).alias("_n")).filter("_n = _k - 1")
    every = starts.filter("_k = 1").select("_id", "_key").unionByName(met.select("_id", "_key"))
    if single_sizes:
        alone = found.select(F.explode(F.array(*begun("_token", single_sizes))).alias("a"), "_places").select("a._ahead", "_places").join(singles, "_ahead")
        every = every.unionByName(alone.select("_id", F.explode("_places._key").alias("_key")))
    return every.select(F.col("_id").alias(phrase_id), "_key").distinct()
