"""Phrases by the index are those by a scan, and read postings of their range only."""

import random

from pyspark.sql import functions as F

from ledgerloom.operators import tables, textindex


def rows_of(spark):
    r = random.Random(4)
    words = ["mit", "license", "licence", "lic", "blue", "bottle", "the", "größe", "a", "x1"]
    text = lambda: r.choice([" ", "-", ", ", "!\n"]).join(r.choice(words) for _ in range(r.randint(0, 12)))
    rows = [(f"k{n}", text(), text() if n % 3 else None) for n in range(300)] + [("z", None, None), ("e", "", " .. "), ("k1", "The MIT; Lic. again", "x"), (None, "mit lic", "x")]
    return spark.createDataFrame(rows, "id string, name string, note string")


def test_phrases_equal_the_scan(spark, tmp_path):
    rows, path = rows_of(spark), str(tmp_path / "index")
    textindex.write_index(rows, path, key="id", columns=["name", "note"])
    keyed = rows.filter("id IS NOT NULL")
    phrases = ["MIT lic", "mit", "the mit: lic", "blue bottle the", "--", "", "GRÖSSE g", "größe", "lic", "x1 a b", "nowhere", "a a a"]
    for phrase in phrases:
        want = {r.id for r in tables.phrase_prefix(keyed, phrase, ["name", "note"]).collect()}
        got = [r._key for r in textindex.phrase_keys(spark, path, phrase).collect()]
        assert sorted(got) == sorted(want), phrase
    table = spark.createDataFrame(list(enumerate(phrases)) + [(0, phrases[0]), (99, None)], "phrase_id long, phrase string")
    got = sorted((r.phrase_id, r._key) for r in textindex.search_phrases(spark, path, table).collect())
    assert got == sorted((n, r.id) for n, p in enumerate(phrases) for r in tables.phrase_prefix(keyed, p, ["name", "note"]).select("id").distinct().collect())
    assert textindex.search_phrases(spark, path, table.limit(0)).count() == 0


def test_a_search_reads_its_range_only(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(textindex, "FILE_POSTINGS", 100)
    path = str(tmp_path / "index")
    textindex.write_index(rows_of(spark), path, key="id", columns=["name", "note"])
    files = spark.read.parquet(f"{path}/postings").select(F.input_file_name().alias("f"), "_token").groupBy("f").agg(F.min("_token").alias("a"), F.max("_token").alias("b")).orderBy("a").collect()
    assert len(files) > 10 and all(x.b <= y.a for x, y in zip(files, files[1:]))
    plan = textindex.phrase_keys(spark, path, "mit lic")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(_token,mit)" in plan and "StringStartsWith(_token,lic)" in plan


def test_an_index_of_no_rows(spark, tmp_path):
    textindex.write_index(rows_of(spark).limit(0), str(tmp_path / "i"), key="id", columns=["name"])
    assert textindex.phrase_keys(spark, str(tmp_path / "i"), "a").count() == 0


def test_a_common_last_word_is_no_row_for_each_phrase(spark, tmp_path):
    path = str(tmp_path / "index")
    texts = spark.range(400).select("id", F.concat(F.lit("word" + " common" * 50 + " rare"), "id", F.lit(" common")).alias("text"))
    textindex.write_index(texts, path, key="id", columns=["text"])
    asked = spark.range(40).select(F.col("id").alias("phrase_id"), F.concat(F.lit("rare"), "id", F.lit(" co")).alias("phrase"))
    found = textindex.search_phrases(spark, path, asked)
    assert sorted((r.phrase_id, r._key) for r in found.collect()) == [(n, n) for n in range(40)]
    rows, nodes = 0, [found._jdf.queryExecution().executedPlan()]
    while nodes:  # of all joins of the plan, the most rows that one made
        node = nodes.pop()
        children = [node.executedPlan()] if node.nodeName().startswith("AdaptiveSparkPlan") else [node.plan()] if "QueryStage" in node.nodeName() else [node.children().apply(k) for k in range(node.children().size())]
        nodes += children
        if "Join" in node.nodeName():
            rows = max(rows, node.metrics().apply("numOutputRows").value())
    assert rows <= 2 * 400 * 52  # the places themselves, not those of each phrase


def test_two_common_words_are_no_row_for_each_place(spark, tmp_path):
    path = str(tmp_path / "index")
    text = F.concat(F.repeat(F.lit("blue the red of "), 30), F.when(F.col("id") % 100 == 0, "blue offer").otherwise("red"))
    textindex.write_index(spark.range(400).select("id", text.alias("text")), path, key="id", columns=["text"])
    found = textindex.search_phrases(spark, path, spark.createDataFrame([(1, "of blue of"), (2, "red offe")], "phrase_id long, phrase string"))
    assert sorted((r.phrase_id, r._key) for r in found.collect()) == [(1, k) for k in range(0, 400, 100)]
    rows, nodes = 0, [found._jdf.queryExecution().executedPlan()]
    while nodes:  # of all joins of the plan, the most rows that one made
        node = nodes.pop()
        children = [node.executedPlan()] if node.nodeName().startswith("AdaptiveSparkPlan") else [node.plan()] if "QueryStage" in node.nodeName() else [node.children().apply(k) for k in range(node.children().size())]
        nodes += children
        if "Join" in node.nodeName():
            rows = max(rows, node.metrics().apply("numOutputRows").value())
    assert rows <= 16  # not 400 * 30, the places of "blue" and "of"


def test_an_index_takes_few_bytes_for_each_token(spark, tmp_path):
    path = tmp_path / "index"
    word = lambda n: F.conv(F.hash("id", F.lit(n)) % 5000, 10, 26)
    texts = spark.range(0, 2000, 1, 4).select("id", F.concat_ws(" ", *(word(n) for n in range(100))).alias("text"))
    shuffled = lambda: spark._jsc.sc().statusStore().executorList(True).apply(0).totalShuffleWrite()
    before = shuffled()
    textindex.write_index(texts, str(path), key="id", columns=["text"])
    spark._jsc.sc().listenerBus().waitUntilEmpty()
    written = sum(f.stat().st_size for f in path.rglob("*.parquet"))
    assert shuffled() - before + written < 20 * 2000 * 100


def test_a_pair_that_is_everywhere_fills_rows_and_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(textindex, "FILE_POSTINGS", 1000)
    path = str(tmp_path / "index")
    texts = spark.range(500).select("id", F.lit("same " * 20 + "end").alias("text"))
    textindex.write_index(texts, path, key="id", columns=["text"])
    rows = spark.read.parquet(f"{path}/postings").select("_token", F.size("_places").alias("n"), F.input_file_name().alias("f")).collect()
    assert sum(r.n for r in rows) == 500 * 21 and max(r.n for r in rows) <= 1024 and len({r.f for r in rows if r._token == "same"}) >= 8
    found = textindex.search_phrases(spark, path, spark.createDataFrame([(1, "same same en"), (2, "end same")], "phrase_id long, phrase string"))
    assert sorted((r.phrase_id, r._key) for r in found.collect()) == [(1, k) for k in range(500)]
