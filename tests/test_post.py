"""The chain after reconciliation: a credit is a refund or nothing, a debit goes through all steps."""

import datetime as dt

from ledgerloom.operators import post

START = dt.datetime(2024, 3, 1)
SCHEMA = "txn_id string, instrument_id long, direction string, amount_minor long, best_event_time timestamp, merchant_raw string, category_id string, status string, parent_id string, installments int, original_minor long"


def row(name, direction, amount=100, day=0.0, merchant=None, instrument=1, category=None, parent=None, parts=None):
    return (name, instrument, direction, amount, START + dt.timedelta(days=day), merchant, category, "posted", parent, parts, amount * (parts or 1))


def run(spark, rows, aliases=None):
    df = spark.createDataFrame(rows, SCHEMA)
    named = spark.createDataFrame(aliases, "alias string, merchant string") if aliases else None
    return {r.txn_id: r for r in post.post_process(df, named).collect()}


def test_refunds(spark):
    got = run(spark, [
        row("d1", "debit", day=0), row("d2", "debit", day=5), row("old", "debit", 200, -31), row("edge", "debit", 300, -30), row("part", "debit", 400, parent="x"),
        row("c", "credit", day=6, merchant="Amazon"), row("c200", "credit", 200), row("c300", "credit", 300), row("c400", "credit", 400), row("other", "credit", day=6, instrument=2), row("again", "credit", day=7)])
    assert {k: (r.parent_id, r.subtype) for k, r in got.items() if r.subtype} == {"c": ("d2", "refund"), "c300": ("edge", "refund"), "again": ("d2", "refund")}
    assert {k for k, r in got.items() if r.status == "refunded"} == {"d2", "edge"} and got["part"].parent_id == "x"
    # A credit goes no further: neither merchant nor category.
    assert (got["c"].merchant, got["c"].category_id) == (None, None) and len(got) == 11


def test_debits_go_through_all_steps(spark):
    got = run(spark, [
        row("uber", "debit", merchant="Uber India 12345"), row("own", "debit", merchant="Corner Shop", category="groceries"), row("star", "debit", merchant="RAZ*SWIGGY LIMITED", category="x"), row("none", "debit"),
        row("stop", "debit", merchant="for your card"), row("e1", "debit", merchant="Fridge World", parts=6), row("e2", "debit", day=30, merchant="FRIDGE WORLD", parts=6), row("one", "debit", merchant="Fridge World", parts=1),
        row("alias", "debit", merchant="Amzn Mktp"), row("credit", "credit", 5, merchant="Uber", category="kept")], [("AMZN MKTP", "Amazon"), ("UBER", "Uber")])
    assert {k: (r.merchant, r.category_id) for k, r in got.items()} == {
        "uber": ("UBER INDIA", "transport"), "own": ("CORNER SHOP", "groceries"), "star": ("SWIGGY LIMITED", "food"), "none": (None, None), "stop": (None, None), "e1": ("FRIDGE WORLD", None),
        "e2": ("FRIDGE WORLD", None), "one": ("FRIDGE WORLD", None), "alias": ("Amazon", None), "credit": (None, "kept")}
    assert got["e1"].group_id == got["e2"].group_id is not None and got["one"].group_id is None


def test_no_transactions(spark):
    assert post.post_process(spark.createDataFrame([], SCHEMA)).count() == 0
