"""Decontamination, fingerprints and licences against brute force."""

import hashlib
import random
import re
import textwrap

import numpy as np

from ledgerloom.llm import decontaminate as d
from ledgerloom.llm import fingerprint as f
from ledgerloom.llm import licenses

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def tokens(text):
    return WORD.findall((text or "").translate(LOW))


def brute(text, items, window=10):
    ws, hit, found = tokens(text), set(), set()
    for item, body in items:
        its = tokens(body)
        for k in range(max(1, len(its) - window + 1) if its else 0):
            part = its[k : k + window]
            for a in range(len(ws) - len(part) + 1):
                if ws[a : a + len(part)] == part:
                    hit |= set(range(a, a + len(part)))
                    found.add(str(item))
    return len(ws), hit, found


def test_fm_index_finds_all_occurrences():
    r = random.Random(1)
    for trial in range(20):
        runs = [[r.randint(1, 4) for _ in range(r.randint(1, 30))] for _ in range(r.randint(1, 6))]
        text = np.array([x for run in runs for x in [*run, 0]], np.int32)
        index = d.FMIndex(text, 4)
        for n in (1, 2, 3, 5):
            phrase = [r.randint(1, 4) for _ in range(n)]
            low, high = index.search(np.array([phrase]))
            got = sorted(index.locate(np.arange(low[0], max(low[0], high[0]))).tolist())
            assert got == [a for a in range(len(text) - n + 1) if text[a : a + n].tolist() == phrase]


def test_decontamination_is_brute_force(spark, docs, texts):
    r = random.Random(2)
    whole = [t for t in texts.values() if t and len(t.split()) > 40]
    items = [(k, " ".join(r.choice(whole).split()[r.randint(0, 20) :][: r.randint(1, 25)])) for k in range(12)]
    items += [(50, None), (51, ""), (52, "..."), (None, items[0][1]), (3, items[3][1]), (53, "SHORT")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    twice = docs.unionByName(docs.filter("doc_id = 1"))
    rows = d.find_contamination(twice, bench, shard_bytes=3000).collect()
    assert len(rows) == len(texts) + 1
    for row in rows:
        n, hit, found = brute(texts[row.doc_id], [i for i in items if i[0] is not None] + [(items[0][0], items[0][1])])
        got = {k for s in row.contamination.spans for k in range(s.start, s.end)}
        assert (row.contamination.n_words, got, set(row.contamination["items"])) == (n, hit, found)
        assert row.text == texts[row.doc_id]


def test_phrase_blocks_add_up(spark, docs, texts, monkeypatch):
    items = [(k, texts[k]) for k in range(4)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    one = {r.doc_id: r.contamination for r in d.find_contamination(docs, bench).collect()}
    monkeypatch.setattr(d, "PHRASE_BLOCK", 200)
    assert {r.doc_id: r.contamination for r in d.find_contamination(docs, bench).collect()} == one


def test_removal_keeps_the_rest(spark):
    docs = spark.createDataFrame([(1, "Keep this, one two three four. And -- this!"), (2, "clean"), (3, None)], "doc_id long, text string")
    bench = spark.createDataFrame([(1, "One TWO three, four")], "item_id long, text string")
    out = {r.doc_id: r.text for r in d.find_contamination(docs, bench, cut=True).collect()}
    assert out == {1: "Keep this, . And -- this!", 2: "clean", 3: None}


def test_empty_tables_and_clashing_names(spark, none, docs):
    bench = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert d.find_contamination(none, bench).count() == 0
    clash = docs.withColumnRenamed("source", "contamination").withColumnRenamed("lang", "spans")
    out = d.find_contamination(clash, bench.limit(0))
    assert set(out.columns) == {"doc_id", "text", "spans", "n_chars", "contamination"}
    assert all(not r.contamination.spans and not r.contamination["items"] for r in out.collect())


def test_fingerprints_are_brute_force(spark, docs, texts):
    repeated = docs.unionByName(docs.filter("doc_id = 3"))
    rows = f.fingerprints(repeated).collect()
    assert len(rows) == len(texts) + 1
    order = sorted([*texts, 3], reverse=True)
    expected = []
    for a, b in zip(order, order[1:] + order[:1]):
        x, y = texts[a] or "", texts[b] or ""
        cut = len(x) // 2
        expected.append((a, len(x), hashlib.sha256((x[: len(x) - cut] + y[:cut]).encode()).hexdigest()))
    assert sorted((r.doc_id, r.n_chars, r.edited_sha256) for r in rows) == sorted(expected)
    by = {r.doc_id: r for r in rows}
    assert by[0].fingerprint == by[10].fingerprint and by[1].fingerprint != by[2].fingerprint
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in rows)
    assert by[17].near_edited > 0.15 > by[17].near_next
    assert f.likeness(f.parse(by[1].fingerprint), f.parse(by[11].fingerprint)) > 0.5


def test_fingerprints_of_odd_tables(spark, none):
    assert f.fingerprints(none).count() == 0
    one = spark.createDataFrame([(5, "abc", "x")], "doc_id long, text string, fingerprint string")
    r = f.fingerprints(one).first()
    assert r.edited_sha256 == hashlib.sha256(b"aba").hexdigest() and r.near_next == 1.0
    nulls = spark.createDataFrame([(None, "x"), (None, None), (2, "y")], "doc_id long, text string")
    assert sorted((r.doc_id is None, r.n_chars) for r in f.fingerprints(nulls).collect()) == [(False, 1), (True, 0), (True, 1)]


def test_spans_and_extensions():
    a, b = f.SpanIndex(f.code_points("xxhello world, hello")), f.SpanIndex(f.code_points("hello worms"))
    assert a.common_extension(np.array([2, 0, 20]), b, np.zeros(3, int), np.array([11, 11, 0])).tolist() == [9, 0, 0]
    assert a.equal(np.array([15, 2]), b, np.array([0, 0]), np.array([5, 11])).tolist() == [True, False]


def test_likeness_and_extensions_are_brute_force(spark):
    """In many ranges, with repeated, null and empty texts: shares of spans and common beginnings, counted plainly."""
    r = random.Random(3)
    base = "".join(r.choice("ab ü😀") for _ in range(400))
    texts = {k: base[: r.randint(0, 400)] + "".join(r.choice("abc") for _ in range(r.randint(0, 300))) for k in range(60)}
    texts |= {100: "", 101: None, 102: base, 103: base, 104: "ab" * 400, 105: "x"}
    df = spark.createDataFrame([(k, t, "c") for k, t in texts.items()], "doc_id long, text string, near_next string").repartition(5)
    rows = {x.doc_id: x for x in f.fingerprints(df, part_bytes=900).collect()}
    assert len(rows) == len(texts)
    spans = lambda t: {t[a : a + f.WIDTH] for a in range(len(t) - f.WIDTH + 1)} or ({t} if t else set())
    begin = lambda x, y: next((k for k, (a, b) in enumerate(zip(x, y)) if a != b), min(len(x), len(y)))
    order = sorted(texts, reverse=True)
    off = []
    for k, after in zip(order, order[1:] + order[:1]):
        t, n = texts[k] or "", texts[after] or ""
        cut = len(t) // 2
        e = t[: len(t) - cut] + n[:cut]
        for other, near, shared in ((e, rows[k].near_edited, rows[k].shared_edited), (n, rows[k].near_next, rows[k].shared_next)):
            x, y = spans(t), spans(other)
            share = 1.0 if t == other else len(x & y) / len(x | y) if x | y else 0.0
            assert shared == begin(t, other) and abs(near - share) <= (1e-9 if len(x | y) <= f.SKETCH else 0.25)
            off.append(abs(near - share))
    assert np.mean(off) < 0.05
    assert rows[102].fingerprint == rows[103].fingerprint


def test_fingerprints_of_a_hot_key(spark):
    rows = [(7, f"text {k}") for k in range(200)] + [(None, f"none {k}") for k in range(50)] + [(8, "same")] * 40 + [(9, "first")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    few, many = (sorted(map(repr, f.fingerprints(df, part_bytes=n).collect())) for n in (1 << 20, 100))
    assert few == many and len(few) == len(rows)


def test_licences(spark):
    mit = licenses.TEMPLATES[3][1]
    rows = [(1, "Text.\nReleased under the MIT License.\nMore text of it."), (2, mit), (3, mit.replace("Software", "Program")), (4, "MIT"), (5, None), (6, ""),
            (7, "nothing to see " * 5000), (8, "licensed UNDER the apache license version 2.0"), (8, "licensed UNDER the apache license version 2.0")]
    out = [(r.doc_id, r.licence, r.line) for r in licenses.scan_licences(spark.createDataFrame(rows, "doc_id long, text string")).orderBy("doc_id").collect()]
    assert out == [(1, "MIT", 2), (2, "MIT", 1), (3, "MIT", 1), (4, None, None), (5, None, None), (6, None, None), (7, None, None), (8, "Apache-2.0", 1), (8, "Apache-2.0", 1)]


def test_licence_scan_is_brute_force():
    r = random.Random(3)
    scan = licenses.TemplateSet(licenses.TEMPLATES, 0.8)
    grams = lambda t: set(zip(tokens(t), tokens(t)[1:]))
    for _ in range(300):
        name, body = r.choice(licenses.TEMPLATES)
        ws = body.split()
        for _ in range(r.randint(0, 4)):
            ws[r.randrange(len(ws))] = r.choice(["other", "words", ""])
        line = " ".join(ws)
        own = grams(line)
        best = max(((2 * len(own & grams(b)) / (len(own) + len(grams(b))), -k) for k, (_, b) in enumerate(licenses.TEMPLATES)), default=(0, 0)) if own else (0, 0)
        got = scan.best(tokens_bytes(line))
        assert (got is None) == (best[0] < 0.8) and (got is None or (abs(got[0] - best[0]) < 1e-9 and got[1] == -best[1]))


def test_licence_scan_at_the_bound():
    assert licenses.TemplateSet(licenses.TEMPLATES, 0.8).best(tokens_bytes("Released under the MIT License. See COPYING")) == (0.8, 0)
    shorter = licenses.TemplateSet([("X", "a b c d e f g")], 0.8)
    assert shorter.best(tokens_bytes("a b c d e")) == (0.8, 0)


def test_licence_scan_slides_windows():
    scan = licenses.TemplateSet(licenses.TEMPLATES + licenses.BODIES, 0.8)
    gpl, bsd = licenses.TEMPLATES[7][1], next(t for n, t in licenses.TEMPLATES if n == "BSD-3-Clause")
    wrapped = lambda t: "\n".join(f" * {x}" for x in textwrap.wrap(t, 72))
    prose = " ".join(f"w{k % 700}" for k in range(3000))
    assert scan.scan(f"/*\n{wrapped(gpl)}\n */\n{prose}".encode())[0] == ("GPL-3.0", 1.0, 2)
    assert scan.scan(f"x\ny z\n{wrapped(bsd)}\n{prose}".encode()) == [("BSD-3-Clause", 1.0, 3)]
    assert scan.scan(b"A note on old tables. This work is licensed under the GNU General Public License, version 3. And more of it.") == [("GPL-3.0", 1.0, 1)]
    for name, body in licenses.BODIES:
        assert (name, 1.0, 2) in scan.scan(f"{prose}\n{body.strip()}\n{prose}".encode())


def test_licence_windows_are_brute_force():
    r = random.Random(9)
    names = [("A", "a b c a b d"), ("B", "b c d e"), ("C", "a a b")]
    scan = licenses.TemplateSet(names, 0.8)
    texts = [" ".join(r.choice("abcdexy") for _ in range(r.randint(0, 60))) for _ in range(400)]
    grams = lambda w: set(zip(w, w[1:]))
    for text, got in zip(texts, scan.scan_all([t.encode() for t in texts])):
        ws, want = text.split(), []
        for name, body in names:
            b = body.split()
            for s in [range(k, k + len(b)) for k in range(len(ws) - len(b) + 1)] + [range(len(ws))]:
                x, y = grams([ws[k] for k in s]), grams(b)
                want += [(name, 2 * len(x & y) / (len(x) + len(y)))] * (5 * len(x & y) * 2 >= 4 * (len(x) + len(y)))
        assert {(n, s) for n, s, _ in got} <= set(want) and max((s for _, s, _ in got), default=0) == max((s for _, s in want), default=0)


def tokens_bytes(text):
    return [w.encode() for w in tokens(text)]


def test_the_plan_of_ranges_does_not_grow_with_them(spark):
    df = spark.createDataFrame([(k, f"text {k}") for k in range(3000)], "doc_id long, text string").repartition(4)
    sizes = [len(f.with_next(df, "doc_id", "text", n)._jdf.queryExecution().analyzed().toString().split("named_struct")) for n in (20_000, 200)]
    assert sizes[0] == sizes[1]
    assert f.with_next(df, "doc_id", "text", 200).select("_range").distinct().count() > 100
