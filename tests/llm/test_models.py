"""WARC archives, language ID, scoring, packing, and the pipeline."""

import base64
import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from ledgerloom.llm import hmm, language, packing, warc
from ledgerloom.llm.common import work_dir


def archive(spark, pages):
    folder = work_dir(spark, "warc-test")
    captures = warc.write_archives(warc.with_revisits(pages), f"{folder}/a")
    return captures, f"{folder}/a", f"{folder}/i", warc.write_index(captures, f"{folder}/i", block_lines=3)


def test_warc_round_trip(spark):
    hosts = ["a.example.com", "www.example.com", "b.example.org"]
    pages = [(k, f"https://{hosts[k % 3]}/p/{k % 7}?q={k % 2}", f"<p>größe {k % 5}</p>" if k % 6 else None) for k in range(60)]
    pages += [(60, None, "x"), (61, "not a url", ""), (62, "http://[bad", "\r\n\r\nWARC/1.1\r\n"), (5, pages[5][1], pages[5][2])]
    df = spark.createDataFrame([(*p, "x") for p in pages], "page_id long, url string, html string, payload string").repartition(3)
    captures, a, i, parts = archive(spark, df)
    got = warc.lookup(df, a, i, parts).collect()
    assert len(got) == len(pages)
    last = {}
    for p, _, h in pages:
        last[h or ""] = max(last.get(h or "", p), p)
    for r in got:
        url, html = next((u, h or "") for p, u, h in pages if p == r.page_id)
        raw = html.encode()
        assert (r.url, r.payload_bytes, r.payload_digest) == (url, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode())
        is_last = last[html] == r.page_id
        assert (r.record_type, r.refers_to) == (("response", None) if is_last else ("revisit", last[html]))
        assert not is_last or r.payload == raw
    some = spark.createDataFrame([("https://a.example.com/p/0?q=0",), ("https://nowhere.example/",)], "url string")
    assert {r.page_id for r in warc.lookup(some, a, i, parts).collect()} == {p for p, u, _ in pages if u == "https://a.example.com/p/0?q=0"}
    assert warc.lookup(some.limit(0), a, i, parts).count() == 0


def test_warc_of_no_pages(spark):
    none = spark.createDataFrame([], "page_id long, url string, html string")
    _, a, i, parts = archive(spark, none)
    assert parts == [] and warc.lookup(none, a, i, parts).count() == 0


def test_url_keys_sort_by_domain():
    assert warc.url_key("https://WWW.Example.com:443/A?B=1#x") == "com,example)/a?b=1"
    assert warc.url_key(None) == "" and warc.url_key("//h.example:8080") == "example,h:8080)/"


SYLLABLES = {"en": ["the", "tion", "ing", "and"], "de": ["sch", "ung", "keit", "und"], "fr": ["eau", "oux", "ment", "que"]}


def speech(lang, seed, n=60):
    r = random.Random(seed)
    return " ".join("".join(r.choice(SYLLABLES[lang]) for _ in range(r.randint(1, 3))) for _ in range(n))


def test_language_is_learned_and_held_out(spark):
    rows = [(k, speech(lang, k), lang) for k, lang in zip(range(150), itertools.cycle(SYLLABLES))]
    rows += [(200, None, "en"), (201, "123 !!", "de"), (202, "", None), (203, speech("de", 7, 20_000), None), (1, rows[1][1], "de")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("score", F.lit("clash"))
    train, test = df.filter("doc_id % 4 <> 2"), df
    model = language.train(train)
    out = {r.doc_id: r for r in language.predict(test, model).collect()}
    held = [r for r in rows if r[0] % 4 == 2 and r[0] < 150]
    assert np.mean([out[i].lang_pred == lang for i, _, lang in held]) == 1.0
    assert [out[k].lang_pred for k in (200, 201, 202, 203)] == ["und", "und", "und", "de"]
    assert all(0 <= r.score <= 1 for r in out.values())


def test_language_learns_more_than_a_word_of_languages(spark):
    r = random.Random(8)
    rows = [(k, " ".join("".join(chr(0x4E00 + 20 * (k % 70) + r.randrange(6)) for _ in range(4)) for _ in range(40)), f"l{k % 70:02}") for k in range(140)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.train(df)
    assert len(model.languages) == 70
    assert all(x.lang_pred == x.lang and x.score > 0.9 for x in language.predict(df, model).collect())


def test_language_score_is_free_of_the_cut(spark):
    # Half of the n-grams are rarer than the cut, as with many n-grams of a large corpus.
    r = random.Random(9)
    text = " ".join(r.choice(["aba", "bab"]) if k % 2 else "".join(r.choice("cdefghijklmnop") for _ in range(3)) for k in range(2000))
    df = spark.createDataFrame([(1, text, "x"), (2, "qrs tuv " * 100, "y")], "doc_id long, text string, lang string")
    model = language.train(df, least_share=2e-3)
    assert model.cover[0] < 0.8
    assert [(x.lang_pred, round(x.score, 2)) for x in language.predict(df, model).orderBy("doc_id").collect()] == [("x", 1.0), ("y", 1.0)]


def test_language_is_brute_force(spark):
    """Sets of n-grams in place of the filter, over odd rows too."""
    rows = [(k, speech(lang or "en", k, 12) + (" Zoë, und 1 'l'été" if k % 5 == 0 else ""), lang) for k, lang in zip(range(24), itertools.cycle([*SYLLABLES, None]))]
    rows += [(90, None, "en"), (91, "", "de"), (92, "12 !", "fr"), (93, "a", "en"), (None, speech("de", 93, 9), "de"), (3, rows[3][1], rows[3][2]), (94, speech("fr", 1, 3000), None)]
    df = spark.createDataFrame([(*r, "x", 0.5) for r in rows], "doc_id long, text string, lang string, lang_pred string, score double")

    def grams(t):
        t = "".join(c if c.isalpha() else " " for c in (t or "").lower())
        t = re.sub(" +", " ", f" {t} ")
        return [t[a : a + language.GRAM] for a in range(len(t) - language.GRAM + 1)]

    counts = {}
    for _, t, lang in rows:
        if lang and t is not None:
            counts.setdefault(lang, Counter()).update(grams(t))
    for least in (0.0, 0.01):
        kept = {x: {g for g, n in c.items() if n >= least * sum(c.values())} for x, c in counts.items()}
        cover = {x: sum(counts[x][g] for g in kept[x]) / sum(counts[x].values()) for x in kept}
        got = language.predict(df, language.train(df, least_share=least)).collect()
        assert len(got) == len(rows)
        for (_, t, _), r in zip(sorted(rows, key=str), sorted(got, key=lambda r: str((r.doc_id, r.text, r.lang)))):
            own = grams(t)
            part = {x: min(1, sum(g in kept[x] for g in own) / len(own) / cover[x]) if own else 0.0 for x in sorted(kept)}
            if not any(map(str.isalpha, t or "")):
                assert (r.lang_pred, r.score) == ("und", 0.0)
            else:
                assert abs(r.score - max(part.values())) < 1e-3 and part[r.lang_pred] >= max(part.values()) - 1e-3


def test_language_without_labels(spark, docs, none):
    model = language.train(docs.filter("lang IS NULL"))
    assert model.languages == [] and {r.lang_pred for r in language.predict(docs, model).collect()} == {"und"}
    assert language.predict(none, language.train(none)).count() == 0


def test_filter_masks_have_no_false_negatives():
    grams = {"a": np.arange(1000), "b": np.arange(500, 3000)}
    f = language.LanguageFilter.build(["a", "b"], grams, 1 << 14)
    masks = f.masks(np.arange(3000))
    assert (masks[:1000] & np.uint64(1) != 0).all() and (masks[500:] & np.uint64(2) != 0).all()
    assert np.mean(masks[1000:] & np.uint64(1) != 0) < 0.2


def test_scores_are_brute_force(spark, docs, texts):
    rows = {r.doc_id: r for r in hmm.score(docs, train_on=F.col("doc_id") % 3 != 0).collect()}
    low = {k: re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")) for k, t in texts.items()}
    c, n = Counter(), 0
    for k, w in low.items():
        if k % 3:
            c.update(w)
            n += 1
    total, distinct = sum(c.values()) + n, len(c) + 1
    for k, w in low.items():
        base = sum(math.log10((c[x] + 1) / (total + distinct + 1)) for x in w) + math.log10((n + 1) / (total + distinct + 1))
        r = rows[k]
        assert abs(r.base_score - base) < 1e-6 * max(1, abs(base)) and r.n_tokens == len(w) + 1 and r.n_known == sum(c[x] > 0 for x in w) + 1
        assert r.train_tokens == total and r.score < 0


def test_forward_is_the_sum_over_paths():
    r = np.random.default_rng(1)
    k, m = 3, 4
    norm = lambda x, axis: x / x.sum(axis, keepdims=True)
    model = hmm.Model(norm(r.random(k), 0), norm(r.random((k, k)), 1), norm(r.random((m, k)), 0))
    texts = [[0, 1, 2, 3], [2], [3, 3]]
    bounds = np.cumsum([0, *map(len, texts)])
    got = model.log_likelihood(np.array(sum(texts, [])), bounds)
    for t, g in zip(texts, got):
        p = 0.0
        for path in itertools.product(range(k), repeat=len(t)):
            q = model.start[path[0]] * model.emit[t[0], path[0]]
            for a, b, x in zip(path, path[1:], t[1:]):
                q *= model.move[a, b] * model.emit[x, b]
            p += q
        assert abs(g - math.log(p)) < 1e-9


def brute_expected(model, texts):
    """Baum-Welch counts by the plain recursions, text by text."""
    k = len(model.start)
    starts, moves, emissions = np.zeros(k), np.zeros((k, k)), np.zeros(model.emit.shape)
    for t in texts:
        alpha = [model.start * model.emit[t[0]]]
        for x in t[1:]:
            alpha.append((alpha[-1] @ model.move) * model.emit[x])
        beta = [np.ones(k)]
        for x in reversed(t[1:]):
            beta.insert(0, model.move @ (model.emit[x] * beta[0]))
        p = alpha[-1].sum()
        starts += alpha[0] * beta[0] / p
        for j, x in enumerate(t):
            emissions[x] += alpha[j] * beta[j] / p
            if j:
                moves += np.outer(alpha[j - 1], model.emit[x] * beta[j]) * model.move / p
    return starts, moves, emissions


def test_expected_counts_are_brute_force():
    r = np.random.default_rng(3)
    texts = sorted((r.integers(0, 7, n).tolist() for n in (1, 1, 2, 5, 5, 9, 30)), key=len, reverse=True)
    model = hmm.Model.initial(7, 3)
    got = model.expected(np.array(sum(texts, [])), np.cumsum([0, *map(len, texts)]))
    for g, w in zip(got, brute_expected(model, texts)):
        assert np.allclose(g, w, rtol=1e-4, atol=1e-5)


def test_baum_welch_raises_the_likelihood():
    r = np.random.default_rng(2)
    symbols = np.concatenate([r.integers(0, 3, 16 * 40), r.integers(3, 6, 16 * 40)])
    bounds = np.arange(0, len(symbols) + 1, 16)
    model, last = hmm.Model.initial(6, 2), -np.inf
    for _ in range(6):
        total = model.log_likelihood(symbols, bounds).sum()
        assert total >= last - 1e-3
        last = total
        s, m, e = model.expected(symbols, bounds)
        model = hmm.Model(s / s.sum(), m / m.sum(1, keepdims=True), e / e.sum(0))


def test_trained_scores_are_brute_force(spark, monkeypatch):
    """The whole query: training from the words of training texts, then the likelihood of each text."""
    monkeypatch.setattr(hmm, "BATCH_SYMBOLS", 40)
    monkeypatch.setattr(hmm, "COMMON_SHARE", 0.03)
    monkeypatch.setattr(hmm, "shard_count", lambda total: 7)
    r = random.Random(4)
    texts = {k: " ".join(r.choice(["The", "cat", "sat", "on", "mats", "hats", "bats", f"x{r.randint(0, 30)}"]) for _ in range(r.randint(0, 30))) for k in range(40)}
    rows = [(k, t) for k, t in texts.items()]
    low = {k: t.lower().split() for k, t in texts.items()}
    learns = {k for k in texts if k % 7 != 2}
    c = Counter(w for k in learns for w in low[k])
    total = sum(c.values()) + len(learns)
    key = lambda w: (xxhash.xxh3_64_intdigest(w) & ~255) | hmm.word_class(w)
    common = sorted((w for w in c if c[w] >= math.ceil(0.03 * total)), key=key)
    symbol = lambda w: hmm._END + 1 + common.index(w) if w in common else hmm.word_class(w)
    coded = {k: [*map(symbol, w), hmm._END] for k, w in low.items()}
    model = hmm.Model.initial(hmm._END + 1 + len(common))
    for _ in range(hmm.ITERATIONS):
        s, m, e = brute_expected(model, [coded[k] for k in learns])
        s, m, e = s + 1, m + 1, e + 0.05
        model = hmm.Model(s / s.sum(), m / m.sum(1, keepdims=True), e / e.sum(0))
    rest = Counter()
    for w in c:
        if w not in common:
            rest[hmm.word_class(w)] += c[w]
            rest[hmm.word_class(w), "words"] += 1

    def share(w):
        return 1.0 if w in common else (c[w] + 1) / (rest[hmm.word_class(w)] + rest[hmm.word_class(w), "words"] + 1)

    want = {}
    for k, t in coded.items():
        now, out = model.start * model.emit[t[0]], 0.0
        for x in t[1:]:
            out += math.log10(now.sum())
            now = (now / now.sum()) @ model.move * model.emit[x]
        want[k] = out + math.log10(now.sum()) + sum(math.log10(share(w)) for w in low[k])
    df = spark.createDataFrame([(*x, "clash", True) for x in rows], "doc_id long, text string, score string, _train boolean")
    one, many = ({r.doc_id: r.score for r in hmm.score(df.repartition(n), train_on=F.col("doc_id") % 7 != 2).collect()} for n in (1, 7))
    for k in texts:
        assert abs(one[k] - want[k]) < 1e-3 * max(1, abs(want[k]))
        assert abs(one[k] - many[k]) < 1e-9 * max(1, abs(one[k]))


def test_model_is_proper_over_words():
    """Shares of a class's known words and of one unknown add up to one."""
    v = hmm.Vocabulary(np.array([5], np.uint64), np.zeros(hmm.CLASSES, np.int64), np.zeros(hmm.CLASSES, np.int64), 10, 4, 1)
    v.class_tokens[3], v.class_words[3] = 7, 3
    counts = np.array([4, 2, 1, 0])
    assert abs(((counts + 1) / (v.class_tokens[3] + v.class_words[3] + 1)).sum() - 1) < 1e-12


def test_scores_of_odd_tables(spark, none):
    assert hmm.score(none, train_on=F.lit(True)).count() == 0
    rows = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, None)], "doc_id long, text string")
    out = hmm.score(rows, train_on=F.lit(False)).collect()
    assert [(r.n_known, r.train_tokens) for r in out] == [(0, 0)] * 3


def test_packing_is_exact(spark, docs, texts):
    path = packing.tokenizer_file()
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    twice = docs.unionByName(docs.filter("doc_id = 2"))
    rows = packing.pack(twice, path, group_docs=8).collect()
    want = Counter()
    for k in [*texts, 2]:
        ids = np.array(tokenizer.encode(texts[k] or "", add_special_tokens=False).ids + [1], "<u4")
        want.update((k, a, len(ids[a : a + 2048]), zlib.crc32(ids[a : a + 2048].tobytes()), len(ids)) for a in range(0, len(ids), 2048))
    assert Counter((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in rows) == want
    sequences = {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for s in sequences.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= 2048


def test_tokenizer_memory_is_exact(monkeypatch):
    import pyarrow as pa
    from tokenizers import Tokenizer

    path = packing.tokenizer_file()
    plain, fresh = Tokenizer.from_file(path), packing.CachedTokenizer(path)
    monkeypatch.setattr(packing, "CACHE_WORDS", 5)
    for texts in (["Hello, wörld!! it's <|endoftext|> ok", None, "İstanbul ΣΑΣ.  x\ty", "a" * 300 + "..."], ["don't STOP.,; 'll ﬁ é.", "", "中文。 12345"]):
        ids, bounds = fresh.encode(pa.array(texts, pa.string()))
        for t, a, b in zip(texts, bounds, bounds[1:]):
            assert ids[a:b].tolist() == plain.encode(t or "", add_special_tokens=False).ids


def test_first_fit_decreasing_is_brute_force():
    r = random.Random(6)
    for _ in range(30):
        sizes = [r.randint(1, 20) for _ in range(r.randint(0, 40))]
        bins, want = [], [None] * len(sizes)
        for k in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
            b = next((j for j, used in enumerate(bins) if used + sizes[k] <= 20), len(bins))
            if b == len(bins):
                bins.append(0)
            want[k] = (b, bins[b])
            bins[b] += sizes[k]
        assert packing.first_fit_decreasing(sizes, 20) == want


def test_packing_no_rows(none):
    assert packing.pack(none, packing.tokenizer_file()).count() == 0


def test_pipeline_stages(spark, docs, tmp_path):
    bench = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda"
    extra = [(50, f"{speech('en', 1)} {bench} {speech('en', 2)}", "en", "s", 0), (51, "12345", "en", "s", 5), (52, speech("de", 3), "de", "s", 0), (53, speech("de", 3), "de", "s", 0), (54, speech("de", 5), "de", "s", 0)]
    spark.createDataFrame([(1, bench)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = docs.unionByName(spark.createDataFrame(extra, docs.schema))
    rows.write.parquet(f"{tmp_path}/documents.parquet")
    now, kept = rows, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, now, str(tmp_path))
        assert now.columns == rows.columns and now.dtypes == rows.dtypes
        now = spark.createDataFrame(now.collect(), rows.schema)
        kept[name] = {r.doc_id: r for r in now.collect()}
    assert 51 not in kept["language_id"] and {50, 52, 54} <= set(kept["language_id"])
    assert 52 in kept["near_dedup"] and 53 not in kept["near_dedup"] and 54 in kept["near_dedup"]
    assert bench not in kept["decontamination"][50].text and kept["decontamination"][50].n_chars == len(kept["decontamination"][50].text)
    assert kept["decontamination"][54].text == speech("de", 5)
    packed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in packed} == set(kept["decontamination"])


def test_pipeline_of_no_documents(spark, none, tmp_path):
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    none.write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_pipeline_near_dedup_keeps_each_text_once(spark):
    schema = "doc_id long, text string, lang string, source string, _rows long, first string"
    t, u = "one two three four five six", "seven eight nine ten eleven twelve"
    rows = [(1, t, "en", "b", 1, "f"), (1, t, "en", "a", 2, None), (5, t, "en", "s", 1, "f"), (5, u, "en", "s", 1, "f"), (6, None, None, None, None, None),
            (6, None, None, "x", None, None), (None, t, "en", "s", 1, "f"), (None, None, None, None, None, None), (8, "", None, None, None, None), (9, "", None, None, None, None)]
    out = corpus_pipeline.near_dedup(spark, spark.createDataFrame(rows, schema), "")
    assert out.columns == ["doc_id", "text", "lang", "source", "_rows", "first"]
    got = sorted(((r.doc_id, r.text, r.source) for r in out.collect()), key=str)
    assert got == sorted([(1, t, "a"), (5, u, "s"), (6, None, "x"), (None, t, "s"), (None, None, None), (8, "", None), (9, "", None)], key=str)


def test_packing_spreads_rows_alike(spark):
    df = spark.createDataFrame([(7, "a b c")] * 4000, "doc_id long, text string").repartition(4)
    out = packing.pack(df, packing.tokenizer_file(), group_docs=500)
    groups = Counter(r.sequence_id >> 40 for r in out.collect())
    assert sum(groups.values()) == 4000 and len(groups) == 8 and max(groups.values()) < 1000
    # A task that runs again, with its rows in another order, draws alike.
    again = packing.pack(df.sortWithinPartitions("text"), packing.tokenizer_file(), group_docs=500)
    assert Counter(r.sequence_id >> 40 for r in again.collect()) == groups


def test_warc_of_a_page_without_id_and_a_hot_payload(spark):
    rows = [(k, "u", "same") for k in range(300)] + [(None, "u", "same"), (None, None, None), (400, "u", "x" * 300_000)]
    out = warc.with_revisits(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert sum(r.is_revisit for r in out) == 299 and {r.refers_to for r in out if r.is_revisit} == {299}
    assert [r.is_revisit for r in out if r.page_id is None] == [False, False] and len(out) == 303
