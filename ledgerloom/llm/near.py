"""Near-duplicate documents: a Jaccard join on sets of word 5-grams by MinHash banding.

Equal texts are one class from the start. Distinct texts get MinHash signatures; they are shuffled on the hashes of
their bands, and texts that share a bucket are verified on their full sets. The least text of a bucket leads it; the
buckets of one leader are verified together, so that a text is sent once to them all, and a pair only with the leader
of its first common bucket. Large groups are verified in pairs of blocks. A block returns a row for each text (its
links, the least text it is tied to), never its pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.llm.common import documents, durable, give_back, sub_batches
from ledgerloom.llm.components import components
from ledgerloom.llm.shards import hash_words, word_codes

WORDS = 5
THRESHOLD = 0.8
RECALL = 0.9999
ROWS = 5
#: Texts and n-grams of a block, at most on average; a task holds two blocks.
BLOCK_TEXTS, BLOCK_GRAMS = 1536, 1_500_000
_ODD = np.uint64(0x9E3779B97F4A7C15)
#: Stands for no leader.
_NONE = -(2**63)


def bands_for(threshold: float, recall: float = RECALL, rows: int = ROWS) -> int:
    """Bands of ``rows`` that find a pair at the threshold with probability ``recall`` or more."""
    return math.ceil(math.log(1 - recall) / math.log(1 - threshold**rows))


def shingles(texts: pa.Array, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every n-gram of all texts in turn, where each text's begin and, last, the end).

    A text with fewer words has one n-gram of all of them; one without words has none. A-Z are lower-cased.
    """
    known, index, bounds = word_codes(texts, lower=True)
    value = hash_words(known)[index] if known else np.empty(0, np.uint64)
    size = np.diff(bounds)
    count = np.where(size >= words, size - words + 1, np.minimum(size, 1))
    ends = np.concatenate(([0], np.cumsum(count)))
    at = np.arange(ends[-1]) + np.repeat(bounds[:-1] - ends[:-1], count)
    left = np.repeat(size, count)
    out = np.zeros(len(at), np.uint64)
    for j in range(words):
        inside = j < left
        out = np.where(inside, out * _ODD + value[np.where(inside, at + j, 0)], out) if len(value) else out
    out ^= out >> np.uint64(31)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    return out ^ (out >> np.uint64(29)), ends


def band_hashes(grams: np.ndarray, ends: np.ndarray, bands: int, rows: int = ROWS) -> np.ndarray:
    """Band hashes of each text that has n-grams (row), in the order of the texts."""
    random = np.random.default_rng(8)
    starts = ends[:-1][np.diff(ends) > 0]
    out = np.zeros((len(starts), bands), np.uint64)
    if not len(starts):
        return out.view(np.int64)
    for b in range(bands):
        for _ in range(rows):
            factor, shift = random.integers(0, 2**63, 2, dtype=np.uint64)
            least = np.minimum.reduceat(grams * (factor | np.uint64(1)) + shift, starts)
            out[:, b] = (out[:, b] ^ least) * _ODD
            out[:, b] ^= out[:, b] >> np.uint64(30)
    return out.view(np.int64)


def text_id(text: Column) -> Column:
    """Equal for equal texts; null for null."""
    return F.unhex(F.sha2(text.cast("binary"), 256))


def sign(docs: DataFrame, key: str, text: str, bands: int, words: int) -> DataFrame:
    """_key, _text_id (hash of the text), _bands, _grams for each row that has a key and a word."""
    schema = T.StructType([T.StructField("_key", T.LongType()), T.StructField("_text_id", T.BinaryType()), T.StructField("_grams", T.LongType()), T.StructField("_bands", T.ArrayType(T.LongType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sub_batches(batches, "_text", 2 << 20):
            grams, ends = shingles(batch.column("_text"), words)
            has = np.diff(ends) > 0
            values = band_hashes(grams, ends, bands)
            keep = pa.array(has)
            yield pa.RecordBatch.from_arrays([
                batch.column("_key").filter(keep), batch.column("_text_id").filter(keep), pa.array(np.diff(ends)[has]),
                pa.ListArray.from_arrays(pa.array(np.arange(len(values) + 1, dtype=np.int32) * bands), pa.array(values.ravel())),
            ], schema.names)

    rows = docs.filter(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("_key"), text_id(F.col(text)).alias("_text_id"), F.col(text).alias("_text"))
    return rows.filter("_text IS NOT NULL").mapInArrow(run, schema)


def link_block(sets: list[np.ndarray], side: np.ndarray, leads: np.ndarray, leader: int, threshold: float, across: bool) -> np.ndarray:
    """Which texts (rows) are linked with which (columns), of pairs whose first common bucket ``leader`` leads.

    ``leads`` has the leader of each text's bucket in each band; a text is in one bucket of a band, so two with the same
    leader in a band share the bucket.

    ``side`` is 0 or 1 for the two blocks; pairs lie across them only, if ``across``.
    """
    n = len(sets)
    wanted, met = np.zeros((n, n), bool), np.zeros((n, n), bool)
    for b in range(leads.shape[1]):
        own = leads[:, b]
        same = (own[:, None] == own[None, :]) & (own != _NONE)[:, None] & ~met
        met |= same
        wanted |= same & (own == leader)[:, None]
    wanted = np.triu(wanted, 1)
    if across:
        wanted &= side[:, None] != side[None, :]
    links = np.zeros((n, n), bool)
    size = np.array([len(s) for s in sets], np.int64)
    pairs = np.argwhere(wanted)
    if len(pairs) <= 64:
        for i, j in pairs.tolist():
            both = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
            links[i, j] = both >= threshold * (size[i] + size[j] - both) - 1e-9
        return links | links.T
    rows = np.unique(pairs)
    every, column = np.unique(np.concatenate([sets[k] for k in rows]), return_inverse=True)
    owner = np.repeat(np.arange(len(rows)), size[rows])
    order = np.argsort(column, kind="stable")
    column, owner = column[order], owner[order]
    shared = np.bincount(column, minlength=len(every)) > 1  # an n-gram of one text counts in no pair
    keep = shared[column]
    column, owner = (np.cumsum(shared) - 1)[column[keep]], owner[keep]
    both = np.zeros((len(rows), len(rows)), np.float32)
    step = 1024
    for a in range(0, int(shared.sum()), step):
        x, y = np.searchsorted(column, [a, a + step])
        part = np.zeros((len(rows), step), np.float32)
        part[owner[x:y], column[x:y] - a] = 1
        both += part @ part.T
    for a in range(0, len(rows), 256):
        own, strip = rows[a : a + 256], both[a : a + 256]
        union = size[own][:, None] + size[rows][None, :] - strip
        links[np.ix_(own, rows)] = (strip >= threshold * union - 1e-6) & wanted[np.ix_(own, rows)]
    return links | links.T


def verified(members: DataFrame, words: int, threshold: float) -> DataFrame:
    """_rep, _root, _links: for each text of a block that has links there."""
    schema = T.StructType([T.StructField(n, T.LongType()) for n in ("_rep", "_root", "_links")])
    arrow = pa.schema([("_rep", pa.int64()), ("_root", pa.int64()), ("_links", pa.int64())])

    def verify(table: pa.Table) -> pa.Table:
        reps, at = np.unique(table.column("_rep").to_numpy(), return_index=True)  # repeated rows of the key count once
        table = table.take(pa.array(at))
        side, across = table.column("_side").to_numpy(), table.column("_i")[0].as_py() != table.column("_j")[0].as_py()
        # Where one of two different blocks has no text, the pairs of the other belong to its group with itself.
        if len(reps) < 2 or across and side.min() == side.max():
            return arrow.empty_table()
        grams, ends = shingles(table.column("_text"), words)
        sets = [np.unique(grams[a:b]) for a, b in zip(ends, ends[1:])]
        leads = np.array(table.column("_leads").to_pylist(), np.int64)
        copies = table.column("_copies").to_numpy()
        links = link_block(sets, side, leads, table.column("_leader")[0].as_py(), threshold, across)
        label = np.arange(len(reps))
        while True:
            least = np.minimum(label, np.where(links, label[None, :], len(reps)).min(1))
            least = least[least]
            if (least == label).all():
                break
            label = least
        linked = links.any(1)
        del grams, sets, leads
        give_back()
        return pa.table([pa.array(reps[linked]), pa.array(reps[label[linked]]), pa.array((links @ copies)[linked].astype(np.int64))], schema=arrow)

    return members.groupBy("_leader", "_i", "_j").applyInArrow(verify, schema)


def near_duplicates(docs: DataFrame, *, key: str = "doc_id", text: str = "text", words: int = WORDS, threshold: float = THRESHOLD,
                    recall: float = RECALL) -> DataFrame:
    """key, class_id, n_links, text_id, first: a class is tied together by links; its id is its least key.

    A link is another row, with a Jaccard similarity of ``threshold`` or more on distinct n-grams; equal texts are linked.
    Texts that are null or have no word, and rows without a key, have no links and are classes of their own (with the
    key as id). A key that names several texts has a row for each of them. Rows that repeat a key and text count as one
    row each time they are joined; no rows give none. ``text_id`` tells texts apart (SHA-256); ``first`` holds for the
    rows of one text of each class, that of the least key (of several such texts, the one with the least id). Other
    columns aren't read, whatever their names. A very long text is taken whole. The key is a whole number.
    """
    bands = bands_for(threshold, recall)
    signed = durable(sign(docs, key, text, bands, words), "signatures")
    reps = signed.groupBy("_text_id").agg(F.min("_key").alias("_least"), F.count("*").alias("_copies"), F.first("_bands").alias("_bands"), F.first("_grams").alias("_grams"))
    # Numbers of the distinct texts, fixed by the write: two texts can share a key.
    reps = durable(reps.withColumn("_rep", F.monotonically_increasing_id()), "texts")
    banded = reps.select("_rep", "_grams", F.posexplode("_bands").alias("_band", "_hash"))
    buckets = banded.groupBy("_band", "_hash").agg(F.count("*").alias("_n"), F.min("_rep").alias("_lead")).filter("_n > 1").drop("_n")
    held = banded.join(buckets, ["_band", "_hash"]).groupBy("_rep", "_grams").agg(F.map_from_entries(F.collect_list(F.struct("_band", "_lead"))).alias("_of"))  # one entry for each band at most
    leads = F.transform(F.sequence(F.lit(0), F.lit(bands - 1)), lambda b: F.coalesce(F.try_element_at(F.col("_of"), b), F.lit(_NONE)))
    held = durable(held.select("_rep", "_grams", leads.alias("_leads"), F.array_distinct(F.map_values("_of")).alias("_leaders")), "candidates")
    sizes = held.select("_grams", F.explode("_leaders").alias("_leader")).groupBy("_leader").agg(F.count("*").alias("_n"), F.sum("_grams").alias("_sum"))
    # Written, since Spark splits a hot leader's rows only in a join that no aggregate stands before.
    sizes = durable(sizes.select("_leader", F.greatest(F.ceil(F.col("_n") / BLOCK_TEXTS), F.ceil(F.col("_sum") / BLOCK_GRAMS)).cast("int").alias("_blocks")), "leaders")
    texts = docs.select(F.col(key).cast("long").alias("_least"), text_id(F.col(text)).alias("_text_id"), F.col(text).alias("_text"))
    wanted = held.select("_rep", "_leads", F.explode("_leaders").alias("_leader")).join(sizes, "_leader").groupBy("_rep", "_leads").agg(F.collect_list(F.struct("_leader", "_blocks")).alias("_in"))
    wanted = wanted.join(reps.select("_rep", "_least", "_text_id", "_copies"), "_rep")
    found = texts.join(wanted, ["_least", "_text_id"])
    one = found.select("_rep", "_copies", "_text", "_leads", F.explode("_in").alias("_b")).select("_rep", "_copies", "_text", "_leads", "_b._leader", "_b._blocks")
    one = one.withColumn("_own", F.pmod(F.xxhash64("_rep"), "_blocks").cast("int"))
    pairs = one.select("*", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)).alias("_other"))
    members = pairs.select("_leader", F.least("_own", "_other").alias("_i"), F.greatest("_own", "_other").alias("_j"), (F.col("_own") > F.col("_other")).cast("int").alias("_side"), "_rep", "_copies", "_text", "_leads")
    links = durable(verified(members, words, threshold), "links")
    joined = components(links.select(F.col("_rep").alias("a"), F.col("_root").alias("b")))
    total = links.groupBy("_rep").agg(F.sum("_links").alias("_links"))
    classes = reps.select("_text_id", "_rep", "_least", "_copies").join(total, "_rep", "left").join(joined, F.col("_rep") == joined["a"], "left")
    # Only classes of several texts need their least key worked out.
    classes = classes.select("_text_id", "_least", F.when(F.col("_links") > 0, F.coalesce("b", "_rep")).alias("_class"), (F.coalesce(F.col("_links"), F.lit(0)) + F.col("_copies") - 1).alias("n_links"))
    classes = durable(classes, "classes")
    heads = durable(classes.filter("_class IS NOT NULL").groupBy("_class").agg(F.min(F.struct("_least", "_text_id")).alias("_head")), "heads")
    classes = classes.join(heads, "_class", "left").select("_text_id", F.coalesce("_head._least", "_least").alias("class_id"), "n_links", (F.coalesce(F.col("_head._text_id"), F.col("_text_id")) == F.col("_text_id")).alias("_leads"))
    keyed = signed.select("_key", "_text_id").join(classes, "_text_id").select(F.col("_key").alias(key), "class_id", "n_links", F.col("_text_id").alias("text_id"), (F.col("_leads") & (F.col("_key") == F.col("class_id"))).alias("first"))
    has_word = F.col(text).isNotNull() & F.col(text).rlike(r"[^\x20\x09-\x0D]")
    bare = docs.filter(F.col(key).isNull() | ~F.coalesce(has_word, F.lit(False)))
    bare = bare.select(F.col(key).cast("long").alias(key), F.col(key).cast("long").alias("class_id"), F.lit(0).cast("long").alias("n_links"), text_id(F.col(text)).alias("text_id"), F.lit(True).alias("first"))
    return keyed.unionByName(bare)


def op8_near(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir)).select("doc_id", "class_id", "n_links")


OP8_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, text, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
rep AS (SELECT min(doc_id) AS rep, count(*) AS copies, any_value(ws) AS ws, text FROM w WHERE len(ws) > 0 GROUP BY text),
g AS (SELECT DISTINCT rep, array_to_string(ws[k : k + 4], ' ') AS gram FROM (SELECT rep, ws, unnest(range(1, greatest(1, len(ws) - 4) + 1)) AS k FROM rep)),
size AS (SELECT rep, count(*) AS n FROM g GROUP BY rep),
shared AS (SELECT a.rep AS a, b.rep AS b, count(*) AS n FROM g a JOIN g b ON a.gram = b.gram AND a.rep <> b.rep GROUP BY a.rep, b.rep),
link AS (SELECT a, b FROM shared JOIN size x ON x.rep = a JOIN size y ON y.rep = b WHERE 5 * shared.n >= 4 * (x.n + y.n - shared.n)),
reach AS (SELECT rep AS a, rep AS b FROM rep UNION SELECT r.a, l.b FROM reach r JOIN link l ON r.b = l.a),
class AS (SELECT a AS rep, min(b) AS class_id FROM reach GROUP BY a),
linked AS (SELECT link.a AS rep, sum(r.copies) AS n FROM link JOIN rep r ON r.rep = link.b GROUP BY link.a)
SELECT w.doc_id, coalesce(c.class_id, w.doc_id) AS class_id, CAST(coalesce(l.n, 0) + coalesce(rep.copies - 1, 0) AS BIGINT) AS n_links
FROM w LEFT JOIN rep ON w.text = rep.text LEFT JOIN class c ON c.rep = rep.rep LEFT JOIN linked l ON l.rep = rep.rep
"""
