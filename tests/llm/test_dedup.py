"""Line chunks, repeated passages and near duplicates against brute force."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import lines, near, repeats
from ledgerloom.llm.components import components


def remove_brute(rows, k=13):
    """rows: (id, text). Kept words of each."""
    first = {}
    for i, t in rows:
        ws = (t or "").split()
        for a in range(len(ws) - k + 1):
            key = tuple(ws[a : a + k])
            first[key] = min(first.get(key, i), i)
    out = []
    for i, t in rows:
        ws = (t or "").split()
        gone = {x for a in range(len(ws) - k + 1) if first[tuple(ws[a : a + k])] < i for x in range(a, a + k)}
        out.append((i, " ".join(w for x, w in enumerate(ws) if x not in gone), len(ws), len(gone)))
    return sorted(out)


def test_repeats_are_brute_force(spark, docs, texts):
    got = sorted((r.doc_id, r.text, r.n_words, r.n_removed) for r in repeats.remove_repeats(docs).collect())
    assert got == remove_brute(list(texts.items()))


@pytest.mark.parametrize("seed", [1, 2])
def test_repeats_of_many_pasted_passages(spark, seed, monkeypatch):
    r = random.Random(seed)
    passages = [[f"w{r.randint(0, 30)}" for _ in range(r.randint(10, 60))] for _ in range(6)]
    rows = []
    for i in range(40):
        ws = []
        for _ in range(r.randint(0, 5)):
            p = r.choice(passages)
            a = r.randint(0, len(p) - 1)
            ws += p[a : a + r.randint(1, 60)] + [f"u{r.randint(0, 2)}" for _ in range(r.randint(0, 3))]
        rows.append((i, " ".join(ws)))
    rows += [(7, rows[7][1]), (7, "other text " + rows[3][1])]  # rows that repeat an id
    monkeypatch.setattr(repeats, "shard_count", lambda total: 19)
    if seed == 2:  # edge hashes that often meet by chance: words decide
        monkeypatch.setattr(repeats, "_edge_hash", lambda words: F.pmod(F.xxhash64(words), F.lit(50)))
    df = spark.createDataFrame([(*x, 0, 1) for x in rows], "doc_id long, text string, n_words int, _row int")
    got = sorted((x.doc_id, x.text, x.n_words, x.n_removed) for x in repeats.remove_repeats(df).collect())
    assert got == remove_brute(rows)


def test_repeats_of_rows_that_share_a_key(spark):
    p, tail, q = ([f"{c}{k}" for k in range(40)] for c in "ptq")
    rows = [(1, " ".join(p)), (2, " ".join(p + tail)), (2, " ".join(q)), (2, " ".join(q)), (3, " ".join(q))]
    got = sorted((x.doc_id, x.text, x.n_words, x.n_removed) for x in repeats.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == remove_brute(rows)


def test_repeats_without_keys(spark, none):
    assert repeats.remove_repeats(none).count() == 0
    t = " ".join(f"x{k}" for k in range(20))
    rows = spark.createDataFrame([(None, t), (1, t), (None, None)], "doc_id long, text string")
    assert sorted((r.doc_id or 0, r.n_words, r.n_removed) for r in repeats.remove_repeats(rows).collect()) == [(0, 0, 0), (0, 20, 0), (1, 20, 0)]


def near_brute(rows):
    def grams(t):
        ws = t.lower().split()
        return {tuple(ws[a : a + 5]) for a in range(max(1, len(ws) - 4))} if ws else set()

    sets = [(i, grams(t or "")) for i, t in rows]
    n = len(rows)
    link = [[a != b and bool(sets[a][1]) and bool(sets[b][1]) and len(sets[a][1] & sets[b][1]) >= 0.8 * len(sets[a][1] | sets[b][1]) for b in range(n)] for a in range(n)]
    label = [i for i, _ in rows]
    for _ in range(n):
        for a in range(n):
            for b in range(n):
                if link[a][b]:
                    label[a] = label[b] = min(label[a], label[b])
    return sorted((rows[a][0], label[a], sum(link[a])) for a in range(n))


def test_near_duplicates_are_brute_force(spark, docs, texts):
    got = sorted((r.doc_id, r.class_id, r.n_links) for r in near.near_duplicates(docs).collect())
    assert got == near_brute(list(texts.items()))


def test_near_duplicates_in_blocks(spark, monkeypatch):
    r = random.Random(5)
    base = [f"w{k}" for k in range(120)]
    rows = []
    for i in range(90):  # one large group of different near copies
        ws = base.copy()
        for _ in range(r.randint(0, 2)):
            ws[r.randrange(120)] = f"c{r.randint(0, 9)}"
        rows.append((i, " ".join(ws)))
    monkeypatch.setattr(near, "BLOCK_TEXTS", 16)
    got = sorted((x.doc_id, x.class_id, x.n_links) for x in near.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == near_brute(rows)


def test_near_duplicates_of_a_block_without_texts(spark, monkeypatch):
    monkeypatch.setattr(near, "BLOCK_GRAMS", 40)  # two texts of 36 n-grams: two blocks, of which one is often empty
    rows = [(2 * g + k, " ".join([f"g{g}w{j}" for j in range(39)] + [f"own{k}"])) for g in range(12) for k in range(2)]
    got = sorted((x.doc_id, x.class_id, x.n_links) for x in near.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == near_brute(rows)


def test_near_duplicates_of_odd_tables(spark, none):
    assert near.near_duplicates(none).count() == 0
    rows = spark.createDataFrame([(1, "a b c", 9), (2, "A b  c", 9), (3, None, 9), (None, "a b c", 9), (4, " ", 9)], "doc_id long, text string, class_id int")
    assert sorted((r.doc_id or 0, r.class_id or 0, r.n_links) for r in near.near_duplicates(rows).collect()) == [(0, 0, 0), (1, 1, 1), (2, 1, 1), (3, 3, 0), (4, 4, 0)]


def test_bands_meet_the_recall():
    b = near.bands_for(0.8, 0.9999)
    assert 1 - (1 - 0.8**near.ROWS) ** b >= 0.9999


def test_components(spark):
    edges = [(1, 2), (2, 3), (3, 9), (20, 21), (21, 22), (30, 30), (5, 4)] + [(100, k) for k in range(101, 140)] + [(k, k + 1) for k in range(200, 240)]
    got = {(r.a, r.b) for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = {(2, 1), (3, 1), (9, 1), (21, 20), (22, 20), (5, 4)} | {(k, 100) for k in range(101, 140)} | {(k, 200) for k in range(201, 241)}
    assert got == want


def line_brute(rows):
    def number(s):
        return int(hashlib.md5(s.encode()).hexdigest()[:7], 16)

    cut = []
    for i, t in rows:
        if t is None:
            continue
        ls = t.split("\n")
        h = [number(x) for x in ls]
        chunk = []
        for k, x in enumerate(ls):
            roll = sum((h[k - j] if k >= j else 0) * 31 ** (j - 1) for j in (1, 2, 3)) % 1000003
            if k == 0 or roll % 4 == 0:
                chunk.append([])
            chunk[-1].append(x)
        cut.append((i, chunk))
    first = {}
    for i, chunk in cut:
        for no, c in enumerate(chunk):
            if len(c) > 1:
                first[tuple(c)] = min(first.get(tuple(c), (i, no)), (i, no))
    out = {}
    for i, chunk in cut:
        out[i] = "\n".join(x for no, c in enumerate(chunk) if len(c) == 1 or first[tuple(c)] == (i, no) for x in c)
    return out


@pytest.mark.parametrize("meeting", [False, True])
def test_line_chunks_are_brute_force(spark, monkeypatch, meeting):
    r = random.Random(4)
    if meeting:  # hashes that often meet by chance: bytes decide
        monkeypatch.setattr(lines, "_chunk_hash", lambda chunk: F.pmod(F.xxhash64(chunk), F.lit(9)))
    block = [f"common line {k}" for k in range(40)]
    rows = []
    for i in range(30):
        a = r.randint(0, 20)
        ls = [f"own {i} {k}" for k in range(r.randint(0, 9))] + block[a : a + r.randint(0, 20)] + ["", "tail", ""][: r.randint(0, 3)]
        rows.append((i, "\n".join(ls)))
    rows += [(40, None), (41, ""), (42, "\n\n\n"), (43, "\n\n\n"), (44, "one\r\ntwo")]
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, dedup string")
    got = {x.doc_id: (x.text, x.dedup.n_lines, x.dedup.n_removed) for x in lines.drop_repeated_chunks(df).collect()}
    want = line_brute(rows)
    assert len(got) == len(rows) and got[40] == (None, 0, 0)
    for i, t in rows:
        if t is not None:
            assert got[i][0] == want[i], i
            assert got[i][1] == len(t.split("\n")) and (got[i][2] > 0) == (want[i] != t)


def test_line_chunks_of_a_very_long_text(spark):
    text = "\n".join(f"line {k % 9000}" for k in range(60_000))
    rows = [(1, text), (2, text), (3, "line 1\nline 2")]
    got = {x.doc_id: x.text for x in lines.drop_repeated_chunks(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == line_brute(rows)


def test_line_chunks_of_odd_tables(spark, none):
    assert lines.drop_repeated_chunks(none).count() == 0
    t = "\n".join(f"l{k}" for k in range(30))
    rows = spark.createDataFrame([(1, t), (1, t), (None, t)], "doc_id long, text string")
    out = [(r.doc_id, r.text == t) for r in lines.drop_repeated_chunks(rows).collect()]
    # A null key is the least; rows that repeat a key lose alike.
    assert sorted(out, key=str) == [(1, False), (1, False), (None, True)]


def test_line_dedup_plan_is_native(spark, docs):
    plan = lines.drop_repeated_chunks(docs)._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))


def test_near_duplicates_of_a_key_with_several_texts(spark):
    rows = spark.createDataFrame([(1, "a b c d e f"), (5, "A b c d e f"), (5, "u v w x y z"), (7, "a b c d e f"), (7, "u v w x y z")], "doc_id long, text string")
    got = sorted((r.doc_id, r.class_id, r.n_links, r.first) for r in near.near_duplicates(rows).collect())
    assert got == [(1, 1, 2, True), (5, 1, 2, False), (5, 5, 1, True), (7, 1, 2, False), (7, 5, 1, False)]
    # One key may name two texts of one class: one of them stands first.
    rows = spark.createDataFrame([(3, "a b c d e f"), (3, "A b c d e f")], "doc_id long, text string")
    assert sorted((r.class_id, r.n_links, r.first) for r in near.near_duplicates(rows).collect()) == [(3, 1, False), (3, 1, True)]
