"""Ranked search and importance resampling against brute force."""

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F

from ledgerloom.llm import resample, search
from ledgerloom.llm.common import alnum_words


def terms(text):
    return alnum_words(text.encode()) if text is not None else []


def ranked(docs, queries, best=20):
    """{query: [(key, score)]} of (key, text) and (query, text) rows."""
    counted = [(k, Counter(terms(t))) for k, t in docs if terms(t)]
    n_docs, n_terms = len(counted), sum(c.total() for _, c in counted)
    df = Counter(w for _, c in counted for w in c)
    asked = defaultdict(Counter)
    for q, t in {(q, t) for q, t in queries}:
        asked[q].update(terms(t))
    out = {}
    for q, counts in asked.items():
        scores = []
        for k, c in counted:
            m = 75 + 25 * c.total() * n_docs // n_terms
            s = sum(times * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1))) * (10**9 * c[w] // (1000 * c[w] + 12 * m)) for w, times in counts.items() if w in c)
            scores.append((-s, k is None, k or 0))
        found = sorted(x for x in scores if x[0] < 0)[:best]
        if found:
            out[q] = [(None if bare else k, -s) for s, bare, k in found]
    return out


def got(df, query="item_id", key="doc_id"):
    out = defaultdict(list)
    for r in sorted(df.collect(), key=lambda r: (str(r[query]), r["rank"])):
        assert r["rank"] == len(out[r[query]]) + 1
        out[r[query]].append((r[key], r["score"]))
    return dict(out)


def corpus(n, seed=1):
    """Texts of words with very unequal frequencies, with ties, copies, empty, null and long ones."""
    r = random.Random(seed)
    pick = lambda: f"w{int(r.paretovariate(0.6)) % 300}"
    rows = [(k, " ".join(pick() for _ in range(r.randint(1, 60)))) for k in range(n)]
    rows += [(n + k, rows[k % 3][1]) for k in range(30)] + [(7, rows[7][1]), (7, "w1 w2"), (None, rows[4][1]), (n + 40, ""), (n + 41, None), (n + 42, " .,! "), (n + 43, "Ünï W1 _w1\x7fw2 0")]
    rows.append((n + 44, " ".join(pick() for _ in range(60_000))))
    queries = [(q, " ".join(pick() for _ in range(r.randint(1, 12)))) for q in range(25)]
    queries += [(3, queries[3][1]), (3, "w250 w251"), (50, None), (51, ""), (52, "nowhere"), (53, "Ünï ünï"), (54, "w1 w1 w1 W2"), (None, "w1 w5")]
    return rows, queries


def test_search_is_brute_force(spark, monkeypatch):
    rows, queries = corpus(400)
    docs = spark.createDataFrame([(k, t, "x", 1) for k, t in rows], "doc_id long, text string, rank string, _key int").repartition(5)
    asked = spark.createDataFrame(queries, "item_id long, text string")
    want = ranked(rows, queries)
    assert got(search.ranked_search(docs, asked)) == want and 52 not in want
    # In shards of a few documents, and with a few queries at a time.
    monkeypatch.setattr(search, "SHARD_POSTINGS", 40)
    assert got(search.ranked_search(docs, asked, query_block=30)) == want
    assert got(search.ranked_search(docs, asked, best=3)) == ranked(rows, queries, 3)


def test_search_of_odd_tables(spark, none):
    rows, queries = corpus(20)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    asked = spark.createDataFrame(queries, "item_id long, text string")
    assert search.ranked_search(none, asked).count() == 0
    assert search.ranked_search(docs, asked.limit(0)).count() == 0
    named = spark.createDataFrame([("a", "w1"), ("b", None)], "name string, q string")
    assert set(got(search.ranked_search(docs, named, query_id="name", query_text="q"), "name")) == {"a"}


def test_maxscore_reads_only_what_can_qualify():
    r = np.random.default_rng(3)
    sizes = r.integers(0, 30, 3000)
    t = np.concatenate([r.choice(200, s, replace=False) for s in sizes])
    shard = search.Shard(sizes, t, r.integers(1, 1000, len(t)))
    for _ in range(50):
        asked = r.choice(260, 15, replace=False)
        query = search.Query(0, asked, r.integers(0, 50, 15))
        full = np.zeros(len(sizes), np.int64)
        for term, weight in zip(query.terms, query.weights):
            a, b = np.searchsorted(shard.terms, [term, term + 1])
            if b > a:
                full[shard.docs[shard.starts[a] : shard.ends[a]]] += weight * shard.impacts[shard.starts[a] : shard.ends[a]]
        for least in (1, int(np.sort(full)[-20]), int(full.max()), int(full.max()) + 1):
            docs, scores = shard.search(query, max(1, least))
            assert dict(zip(docs.tolist(), scores.tolist())) == {k: s for k, s in enumerate(full.tolist()) if s >= max(1, least)}
    # The scores array is clean again, and lists under the threshold aren't read.
    assert not shard.scores.any()
    frequent = search.Shard(np.array([2] * 1000), np.tile([0, 1], 1000), np.tile([1, 500], 1000))
    frequent.docs = np.where(np.arange(2000) < 1000, -10**9, frequent.docs)  # reading term 0 would fail
    assert len(frequent.search(search.Query(0, np.array([0, 1]), np.array([1, 1])), 502)[0]) == 0


def drawn(docs, target, percent=10, least=20, words=1, buckets=10_000, seed=2024):
    grams = lambda t: [b" ".join(ws[k : k + n]) for ws in [terms(t)] for n in range(1, words + 1) for k in range(len(ws) - n + 1)]
    bucket = lambda g: zlib.crc32(g) % buckets
    s, t = Counter(bucket(g) for _, x in docs for g in grams(x)), Counter(bucket(g) for x in target for g in grams(x))
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (s.total() + buckets) / ((s[b] + 1) * (t.total() + buckets)))) for b in s}
    out = []
    for k, x in docs:
        g = grams(x)
        weight = sum(gain[bucket(y)] for y in g) // len(g) if g else 0
        h = int(hashlib.sha256(f"{seed}:{'' if k is None else k}".encode()).hexdigest()[:8], 16)
        out.append([k, len(g), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(terms(x)) >= least])
    may = sorted((x for x in out if x[5]), key=lambda x: (-x[3], x[0] is None, x[0] or 0))
    for place, x in enumerate(may[: percent * len(may) // 100], 1):
        x[4] = place
    return out


def same(found, want):
    """Rows alike but for their rank, and the same ranks; ties of one key can share them out in any way."""
    assert sorted(map(str, ([*r][:4] for r in found))) == sorted(map(str, (x[:4] for x in want)))
    key = lambda r: (r[4], str(r[0]), r[3])
    assert sorted(key(r) for r in found if r[4]) == sorted(key(x) for x in want if x[4])


def test_resample_is_brute_force(spark, monkeypatch):
    monkeypatch.setattr(resample, "SHARD_BYTES", 3000)
    monkeypatch.setattr(resample, "PIECE", 7)
    rows, queries = corpus(500)
    docs = spark.createDataFrame([(k, t, "x", 1) for k, t in rows], "doc_id long, text string, rank string, _may int").repartition(4)
    target = spark.createDataFrame(queries, "item_id long, text string")
    out = resample.resample(docs, target)
    assert out.columns == ["doc_id", "n_features", "weight", "score", "rank"] and {t for _, t in out.dtypes} == {"bigint"}
    want = drawn(rows, [t for _, t in queries])
    same(out.collect(), want)
    assert sum(x[4] is not None for x in want) > 20
    # Pairs of words, few buckets, half of the documents.
    same(resample.resample(docs, target, words=2, buckets=50, percent=50, least_words=5, seed=7).collect(), drawn(rows, [t for _, t in queries], 50, 5, 2, 50, 7))


def test_resample_of_ties_and_odd_tables(spark, none):
    rows = [(5, "a b")] * 10 + [(k, "a b") for k in range(20)] + [(None, "a b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    empty = spark.createDataFrame([], "text string")
    same(resample.resample(docs, empty, least_words=1, percent=60).collect(), drawn(rows, [], 60, 1))
    assert resample.resample(none, docs).count() == 0
    assert resample.resample(docs, empty, percent=0).filter("rank IS NOT NULL").count() == 0
    silent = spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")
    assert [(r.n_features, r.weight) for r in resample.resample(silent, docs).collect()] == [(0, 0), (0, 0)]


def test_noise_is_that_of_the_key(spark):
    r = spark.range(3).select(resample.noise(F.col("id"), 2024).alias("x")).collect()
    h = [int(hashlib.sha256(f"2024:{k}".encode()).hexdigest()[:8], 16) for k in range(3)]
    assert [x.x for x in r] == [math.floor(-1000 * math.log(-math.log((x + 0.5) / 4294967296))) for x in h]
