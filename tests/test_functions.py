"""Scalar functions and operators on hand-made rows, with their boundaries."""

import datetime as dt
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import classify as c
from ledgerloom.functions import similarity as s
from ledgerloom.functions import text as x
from ledgerloom.operators import dashboard as d
from ledgerloom.operators import extraction as e
from ledgerloom.operators import statements
from ledgerloom.operators import matching as m
from ledgerloom.operators import tables as t


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values)).select(column.alias("r")).first().r


@pytest.mark.parametrize("raw, minor", [("Rs.2500.00", 250000), ("706.00.", 70600), (".50", 50), ("1e99", 19900), ("99999999999999999", None), ("none", None), ("", None), ("1,234.5", 123450), ("1.2.3", None), (None, None)])
def test_amounts(spark, raw, minor):
    assert one(spark, x.parse_amount(F.col("a")), a=raw) == minor


def test_similarities_equal_duckdb(spark):
    r = random.Random(1)
    pairs = [("".join(r.choice("abcd ") for _ in range(r.randint(1, 9))), "".join(r.choice("abcd ") for _ in range(r.randint(1, 9)))) for _ in range(300)] + [("netflixx", "netflix"), ("netflix cinemas", "netflix")]
    con = duckdb.connect()
    for a, b in pairs:
        jw, dl = con.execute("SELECT jaro_winkler_similarity(?, ?), damerau_levenshtein(?, ?)", [a, b, a, b]).fetchone()
        assert s.jaro_winkler_pair(a, b) == pytest.approx(jw, abs=1e-9)
        assert round((1 - s.damerau_pair(a, b)) * max(len(a), len(b))) >= dl  # optimal string alignment is no less
    df = spark.createDataFrame([("ab", "ab"), (None, "a")], "a string, b string")
    assert [r.r for r in df.select(s.jaro_winkler("a", "b").alias("r")).collect()] == [1.0, None]


@pytest.mark.parametrize("raw, mask", [("XXXX1234", "1234"), ("123456789", "6789"), ("me@upi", "me@upi"), ("**12-3", "123"), ("", ""), (None, None)])
def test_masks(spark, raw, mask):
    assert one(spark, x.mask_digits(F.col("a")), a=raw) == mask


@pytest.mark.parametrize("raw, cleaned", [("payu*Shop  one", "SHOP ONE"), ("cafe 12345", "CAFE"), ("  x ", "X"), ("A*B", "A"), ("to SQ * tea*x", "TEA"), (None, None)])
def test_merchants(spark, raw, cleaned):
    assert one(spark, c.clean_merchant(F.col("a")), a=raw) == cleaned


@pytest.mark.parametrize("body, side", [("debited then credited", "debit"), ("credited, not debited", "credit"), ("none", None)])
def test_earliest_verb_decides(spark, body, side):
    assert one(spark, x.direction(F.col("a")), a=body) == side


def test_html(spark):
    assert one(spark, x.html_text(F.col("a")), a="<style>p{}</style><p>a&amp;lt;</p><p>b &nbsp; c</p><script>x</script>") == "a&lt;\nb c\n"


def observation(i, when, amount=100, reference="r", merchant="shop"):
    return (i, 1, amount, "INR", "debit", when, reference, merchant, "statement")


OBS = "obs_id string, instrument_id long, amount_minor long, currency string, direction string, event_time timestamp_ntz, reference_id string, merchant_raw string, source_pipeline string"
CAND = "cand_id string, order_id long, instrument_id long, amount_minor long, currency string, direction string, event_time timestamp_ntz, reference_id string, merchant_name string, source_mix string"
DAY = dt.datetime(2024, 1, 10)


def test_three_days_are_in_and_more_is_out(spark):
    obs = spark.createDataFrame([observation("o", DAY)], OBS)
    cand = spark.createDataFrame([(f"c{h}", h, 1, 100, cur, "debit", DAY + dt.timedelta(hours=h), None, None, None) for h, cur in ((72, "INR"), (73, "INR"), (-72, "INR"), (-73, "INR"), (0, "USD"))], CAND)
    assert {r.cand_id for r in m.candidates(obs, cand).collect()} == {"c72", "c-72"}


def test_margin_and_viability_are_strict_where_they_should_be(spark):
    obs = spark.createDataFrame([(k,) for k in "abcde"], "obs_id string")
    scores = spark.createDataFrame([("a", "x", 0.55), ("b", "x", 0.549999), ("c", "x", 0.85), ("c", "y", 0.70), ("d", "x", 0.850001), ("d", "y", 0.70), ("e", "x", 0.9), ("e", "y", 0.5)], "obs_id string, cand_id string, score double")
    got = {r.obs_id: r.decision for r in m.decided(obs, scores).collect()}
    assert got == {"a": "scored", "b": "new", "c": "ambiguous", "d": "scored", "e": "scored"}


def test_two_minutes_verify(spark):
    rows = [("a", True, DAY, "f"), ("b", False, DAY + dt.timedelta(seconds=120), "f"), ("c", False, DAY + dt.timedelta(seconds=121), "f"), ("d", False, DAY, None)]
    df = spark.createDataFrame(rows, "obs_id string, linked boolean, event_time timestamp_ntz, fingerprint string")
    assert {r.obs_id: r.verified for r in m.fingerprint_matches(df).collect()} == {"b": True, "c": False}


def test_null_parts_of_a_fingerprint_keep_their_places(spark):
    df = spark.createDataFrame([("a", None), (None, "a")], "x string, y string")
    assert len({r.f for r in df.select(m.fingerprint(F.col("x"), F.col("y")).alias("f")).collect()}) == 2


def test_budget_levels_fire_once_and_at_equality(spark):
    rows = [(1, dt.datetime(2024, 1, k), f"t{k}", a, "debit") for k, a in ((1, 80), (2, 5), (3, 15), (4, 50))]
    df = spark.createDataFrame(rows, "instrument_id long, best_event_time timestamp_ntz, txn_id string, amount_minor long, direction string")
    assert sorted((r.level, r.txn_id) for r in d.budget_crossings(df, 100, [80, 90, 100]).collect()) == [(80, "t1"), (90, "t3"), (100, "t3")]


def test_recurrence_tolerance(spark):
    rows = [(1, dt.datetime(2024, k, 1), f"t{k}", a, "debit") for k, a in ((1, 1040), (2, 1000), (3, 960), (4, 1000))] + [(2, dt.datetime(2024, k, 1), f"u{k}", a, "debit") for k, a in ((1, 1100), (2, 1000), (3, 1000))]
    df = spark.createDataFrame(rows, "merchant_id long, best_event_time timestamp_ntz, txn_id string, amount_minor long, direction string")
    (got,) = d.recurring(df, ["merchant_id"]).collect()
    assert (got.merchant_id, got.occurrences, got.cadence, got.next_date) == (1, 4, "monthly", dt.date(2024, 5, 1))


def test_empty_ledger_sums_to_zero(spark):
    df = spark.createDataFrame([], "direction string, best_event_time timestamp_ntz, amount_minor long")
    assert tuple(d.directed_total(df, "2024-01-05 00:00:00", "debit").first()) == (0, 0.0)


def test_rule_states(spark):
    rows = [("p", k, True) for k in range(2)] + [("a", k, True) for k in range(3)] + [("t", k, True) for k in range(10)] + [("i", k, k > 0) for k in range(3)] + [("f", k, k % 4 != 3) for k in range(12)]
    got = {r.rule_id: r.state for r in t.rule_states(spark.createDataFrame(rows, "rule_id string, seq int, ok boolean")).collect()}
    assert got == {"p": "pending", "a": "active", "t": "trusted", "i": "inactive", "f": "inactive"}


def test_search_takes_wildcards_literally(spark):
    df = spark.createDataFrame([("50% off", 1), ("500 off", 2), (None, 5000)], "name string, amount_minor long")
    assert [r.amount_minor for r in t.search(df, "50%", ["name"]).collect()] == [1]
    assert [r.amount_minor for r in t.search(df, "50", ["name"]).orderBy("amount_minor").collect()] == [1, 2, 5000]


def test_phrase_prefix_crosses_punctuation(spark):
    df = spark.createDataFrame([("a", "Blue-bottle, coffee"), ("b", "bottles blue")], "id string, name string")
    assert [r.id for r in t.phrase_prefix(df, "blue bott", ["name"]).collect()] == ["a"]
    assert t.phrase_prefix(df, "--", ["name"]).count() == 0


STATEMENT_LINES = [
    # (statement, issuer, kind, line) and what it gives: (date, description, minor units, direction, reference)
    (1, "HDFC Bank", "credit_card", "01/02/2024", None),
    (1, "HDFC Bank", "credit_card", "SHOP 1,000.50 CR", ("2024-02-01", "SHOP", 100050, "credit", None)),
    (1, "HDFC Bank", "credit_card", "02/02/2024 UPI 123456789012 CAFE 5.00 Dr", ("2024-02-02", "UPI 123456789012 CAFE", 500, "debit", "123456789012")),
    (1, "HDFC Bank", "credit_card", "02/02/2024 PAYMENT - THANK YOU 5.00 CR", None),
    (1, "HDFC Bank", "credit_card", "03/02/2024 BAR -7.25", None),
    (1, "HDFC Bank", "credit_card", "99/02/2024 BAD DATE 7.25 DR", None),
    (2, "ICICI", "credit_card", "03-02-2024 INN  1.00 - 1.00", ("2024-02-03", "INN", 100, "debit", None)),
    (2, "ICICI", "credit_card", "03/02/2024 REFUND  - 2.00 2.00", ("2024-02-03", "REFUND", 200, "credit", None)),
    (2, "ICICI", "credit_card", "03/02/2024 NOTHING  - - -", None),
    (3, "Axis", "x", "04/02/2024 IN +3.00", ("2024-02-04", "IN", 300, "credit", None)),
    (4, "American (Amex)", "x", "12/31/2023 TAXI -4.00", ("2023-12-31", "TAXI", 400, "credit", None)),
    (4, "American (Amex)", "x", "31/12/2023 TAXI 4.00", None),
    (5, "ICICI", "bank_account", "05/02/2024 RENT CHQ77 05/02/2024 900.00 - 1.00", ("2024-02-05", "RENT", 90000, "debit", "CHQ77")),
    (6, "State (SBI)", "credit_card", "4 05-FEB-2024 INN 1.00 Dr", ("2024-02-05", "INN", 100, "debit", None)),
    (7, "Other", "x", "5.2.24 | 00:00 SHOES   MISC + C1,234.00 x", ("2024-02-05", "SHOES", 123400, "credit", None)),
    (7, "Other", "x", "BOOKS AND", None),
    (7, "Other", "x", "12 Jun 98 55.00 D", ("1998-06-12", "BOOKS AND PAPER", 5500, "debit", None)),
    (7, "Other", "x", "PAPER", None),
    (7, "Other", "x", "1/1/24 Grand Total 99.00", None),
    (7, "Other", "x", "1/1/24 X9 99.00", None),
    (8, "HDFC Bank", "credit_card", "01/02/2024 ONLY UNIVERSAL Rs. 8.00", ("2024-02-01", "ONLY UNIVERSAL", 800, "debit", None)),
    (8, "HDFC Bank", "credit_card", None, None),
]


def test_statement_grammars(spark):
    rows = [(*r[:3], k, r[3]) for k, r in enumerate(STATEMENT_LINES)]
    lines = spark.createDataFrame(rows, "statement_id long, issuer string, kind string, line_no int, line string")
    got = {r.line_no: (str(r.entry_date), r.description, r.amount_minor, r.direction, r.reference_id) for r in statements.statement_rows(lines).collect()}
    assert got == {k: r[4] for k, r in enumerate(STATEMENT_LINES) if r[4]}
    assert statements.statement_rows(lines.limit(0)).count() == 0


def test_ladder(spark):
    patterns = spark.createDataFrame([("A", 0, "took Rs ([0-9]+) for ([A-Z]+)", "debit", False), ("A", 1, "([0-9][0-9.]*) debited .* at ([A-Z]+)", "debit", False)], "bank string, place long, pattern string, direction string, is_mandate boolean")
    day = dt.date(2024, 3, 4)
    rows = [
        ("1", "A", "Rs.5.00 debited from A/c XX1234 at SHOP on 01-02-2024. ", day),  # the second pattern
        ("2", "B", "Rs.5.00 debited from A/c XX1234 at SHOP on 01-02-2024. ", day),  # another bank
        ("3", "A", "INR 7.00 spent; took Rs 9 for TEA", day),  # amounts disagree
        ("4", "B", "hello", day), ("5", "B", None, day),
        ("6", "B", "received inr 12 by Ann's", day),  # only the words' scan reads the name
    ]
    got = {r.msg_id: tuple(r)[1:] for r in e.ladder(spark.createDataFrame(rows, "msg_id string, bank string, body string, delivered date"), patterns).collect()}
    first = dt.date(2024, 2, 1)
    assert got["1"] == ("template", 500, "debit", "SHOP", first, 0.95) and got["2"] == ("generic", 500, "debit", "SHOP", first, 0.7)
    assert got["3"] == ("template", 900, "debit", "TEA", day, 0.4) and got["4"][1:4] == got["5"][1:4] == (None, None, None)
    assert got["6"] == ("token", 1200, "credit", "Ann's", day, 0.4)


def test_rewrites(spark):
    table = spark.createDataFrame([(1, "new"), (2, "done"), (3, "new")], "id long, status string")
    asked = spark.createDataFrame([(1, "done"), (2, "new"), (9, "done")], "id long, to string")
    assert sorted(map(tuple, t.transitioned(table, asked, "id", [("new", "done")]).collect())) == [(1, "done"), (2, "done"), (3, "new")]
    rows = spark.createDataFrame([(3, "x"), (4, "y")], "id long, status string")
    assert sorted(map(tuple, t.upsert(table, rows, ["id"]).collect())) == [(1, "new"), (2, "done"), (3, "x"), (4, "y")]
    tags = lambda *p: spark.createDataFrame(list(p), "txn_id string, tag_id long")
    assert sorted(map(tuple, t.retagged(tags(("a", 1)), tags(("a", 1), ("b", 2), ("c", 3)), tags(("c", 3))).collect())) == [("a", 1), ("b", 2)]
    assert sorted(r.id for r in t.newest(table.withColumn("g", F.lit(1)), ["g"], [F.desc("id")], 2).collect()) == [2, 3]


def test_dates_against_the_delivery(spark):
    from ledgerloom.operators import extraction

    day = dt.date
    cases = {  # date, delivery, confidence: date, check, confidence
        "close": (day(2024, 3, 5), day(2024, 3, 6), 0.7, day(2024, 3, 5), "ok", 0.7), "swapped": (day(2024, 5, 3), day(2024, 3, 6), 0.7, day(2024, 3, 5), "swapped", 0.7),
        "far": (day(2024, 5, 3), day(2024, 9, 6), 0.7, day(2024, 5, 3), "far", 0.4), "far, unsure": (day(2024, 5, 3), day(2024, 9, 6), None, day(2024, 5, 3), "far", 0.4),
        "low": (day(2024, 5, 3), day(2024, 9, 6), 0.3, day(2024, 5, 3), "far", 0.3), "no month": (day(2024, 5, 23), day(2024, 9, 6), 0.7, day(2024, 5, 23), "ok", 0.7),
        "same": (day(2024, 5, 5), day(2024, 9, 6), 0.7, day(2024, 5, 5), "ok", 0.7), "null": (None, day(2024, 9, 6), 0.7, None, "ok", 0.7),
    }
    rows = spark.createDataFrame([(k, *c[:3], k != "not") for k, c in cases.items()], "msg_id string, event_date date, delivered date, confidence double, ambiguous boolean")
    got = {r.msg_id: (r.event_date, r.check, r.confidence) for r in extraction.date_check(rows).collect()}
    assert got == {k: c[3:] for k, c in cases.items()}


def test_each_text_is_matched_once(spark):
    """Amount and direction ask their pattern once a row, whatever is made of the match; words stand before the pattern."""
    df = spark.createDataFrame([("Rs 1,200.50. was Paid",), ("rs 7 repaİd, PAID",), ("no amount",), (None,)], "a string")
    read = df.select(x.amount_minor(x.group(F.col("a"), x.AMOUNT_BEFORE)).alias("amount"), x.direction(F.col("a")).alias("side"), x.merchant(F.col("a")).alias("who"))
    plan = read._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace(") == 1 and plan.count(x.VERB) == 1
    assert [tuple(r) for r in read.collect()] == [(120050, "debit", None), (700, "debit", None), (None, None, None), (None, None, None)]


def test_phrases_are_looked_for_behind_a_shared_word(spark):
    """Any of the phrases, as if each were looked for; most texts are asked for a few words only."""
    r = random.Random(3)
    for phrases in (c.TRANSACTION_VERBS, c.CANCELLED_PHRASES, c.REGISTERED_PHRASES, c.FAILURE_PHRASES, ["a b", "b", "c"]):
        groups = c._by_word(phrases)
        assert sorted(p for _, ps in groups for p in ps) == sorted(set(phrases)) and all(w in p for w, ps in groups for p in ps) and len(groups) < len(phrases)
        words = [w for p in phrases for w in p.split()]
        texts = [*phrases, *(" ".join(r.choices(words, k=4)) for _ in range(60)), ""]
        got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", c._any(F.col("t"), phrases).alias("has")).collect()
        assert all(x.has == any(p in x.t for p in phrases) for x in got)


def test_senders_are_judged_once_a_header(spark):
    """Messages meet what is known of their header in one join, and no Python runs over them."""
    from ledgerloom.operators import senders

    of = lambda rows, schema: spark.createDataFrame(rows, schema)
    heads = [["A <x@bank.example>"], ["x@ｂank.example"], ["x@other.example"], ["Bank One <x@other.example>"], ["x@bank.example", "y"], [""], [], None, ["none"], [None]]
    messages = of([(k, h, None) for k, h in enumerate(heads * 3)], "msg_id long, froms array<string>, auth string")
    registry, listed = of([("bank.example", "B", "transaction_candidate")], "domain string, bank string, classification string"), "domain string, bank string, classification string"
    out = senders.sender_gate(messages, registry, of([("bank one",)], "name string"), of([], listed), of([("bank.example", "BB", 1)], "domain string, bank string, set_at long"))
    told = ["transaction", "transaction", "unknown", "spoof_name", "spoof_headers", "invalid", "invalid", "invalid", "invalid", "invalid"]
    assert sorted((x.msg_id, x.verdict, x.bank) for x in out.collect()) == [(k, v, "BB" if v == "transaction" else None) for k, v in enumerate(told * 3)]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") == 1 and "EvalPython" not in plan
