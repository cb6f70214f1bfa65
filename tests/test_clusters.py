"""Clusters that grow: the same members for any split into batches."""

import datetime as dt
import random

import pytest

from ledgerloom.catalog import QUERIES
from ledgerloom.operators import clusters as c

START = dt.datetime(2024, 1, 1)
SEEN = "obs_id string, instrument_id long, amount_minor long, direction string, event_time timestamp"


def brute(rows):
    """Sets of members: tied together by pairs that are alike and at most three days apart."""
    left, out = list(rows), []
    while left:
        group = [left.pop()]
        for a in group:
            near = [b for b in left if None not in a[1:] and a[1:4] == b[1:4] and b[4] is not None and abs(a[4] - b[4]) <= dt.timedelta(days=3)]
            group += near
            left = [b for b in left if b not in near]
        out.append(frozenset(x[0] for x in group))
    return set(out)


def grown(spark, parts):
    members, history = spark.createDataFrame([], "cluster_id string, " + SEEN), []
    for part in parts:
        after = c.grow(members, spark.createDataFrame(part, SEEN))
        members = spark.createDataFrame(after.collect(), after.schema)  # as a written table would be
        history.append(members)
    return history


def sets(members):
    out = {}
    for r in members.collect():
        out.setdefault(r.cluster_id, set()).add(r.obs_id)
    return {frozenset(x) for x in out.values()}


@pytest.mark.parametrize("split", [1, 3, 8])
def test_any_split_gives_the_same_members(spark, split):
    r = random.Random(7)
    rows = [(f"o{k}", r.randint(0, 2), r.choice([100, 200]), r.choice(["debit", "credit"]), START + dt.timedelta(hours=r.randint(0, 24 * 60))) for k in range(90)]
    rows += [("n1", None, 100, "debit", START), ("n2", 1, 100, "debit", None)]
    r.shuffle(rows)
    size = -(-len(rows) // split)
    history = grown(spark, [rows[k : k + size] for k in range(0, len(rows), size)])
    assert sets(history[-1]) == brute(rows) and history[-1].count() == len(rows)
    for before, after in zip(history, history[1:]):  # an id that goes is one that went up in a lesser one
        gone = {x.cluster_id for x in before.collect()} - {x.cluster_id for x in after.collect()}
        went = c.renamed(before, after).collect()
        assert gone == {x.old_id for x in went} and all(x.cluster_id < x.old_id for x in went)


def test_a_bridge_and_a_repeated_batch(spark):
    day = lambda n: START + dt.timedelta(days=n)
    a, b, bridge = ("a", 1, 5, "debit", day(0)), ("b", 1, 5, "debit", day(6)), ("m", 1, 5, "debit", day(3))
    first, second, third, again = grown(spark, [[a, b], [bridge, bridge], [("far", 1, 5, "debit", day(9.1)), ("other", 2, 5, "debit", day(0))], [a, bridge]])
    assert sets(first) == {frozenset("a"), frozenset("b")} and sets(second) == {frozenset("abm")}
    assert {r.cluster_id for r in second.collect()} <= {r.cluster_id for r in first.collect()}
    assert sets(third) == sets(again) == {frozenset("abm"), frozenset(["far"]), frozenset(["other"])}


@pytest.mark.parametrize("sparing", [True, False])
def test_chains_over_borders_of_spans(spark, sparing):
    day = lambda n: START + dt.timedelta(days=n)
    chain = [(f"k{n}", 1, 5, "debit", day(3 * n)) for n in range(80)]
    border = dt.datetime(1970, 1, 1) + dt.timedelta(days=c.SPAN * c.DAYS * 330)  # the one before lies just in the span before
    tight = [(f"t{n}", 2, 5, "debit", border + dt.timedelta(days=3 * n, microseconds=-1)) for n in range(2)]
    loose = [("l0", 3, 5, "debit", border), ("l1", 3, 5, "debit", border + dt.timedelta(days=3, microseconds=400))]
    odd = [("n0", None, 5, "debit", border), ("n1", 1, None, "debit", border), ("n2", 1, 5, None, border), ("n3", 1, 5, "debit", None), ("n4", 1, 5, "debit", None)]
    schema = "cluster_id string, " + SEEN
    members = spark.createDataFrame([], schema)
    history = []
    for part in (chain[::2] + odd[:3] + tight[:1], odd + loose + chain[:6:2], chain[1:41:2] * 2 + tight, chain[41::2]):
        members = spark.createDataFrame(c.grow(members, spark.createDataFrame(part, SEEN), sparing=sparing).collect(), schema)
        history.append(members)
    rows = chain + odd + tight + loose
    assert sets(history[0]) == {frozenset([r[0]]) for r in chain[::2] + odd[:3] + tight[:1]}
    assert sets(history[2]) == brute([*chain[:41], *chain[42::2], *odd, *tight, *loose])
    assert sets(members) == brute(rows) and members.count() == len(rows)
    assert {r.cluster_id for r in members.filter("obs_id = 'k79'").collect()} == {min(r.cluster_id for r in history[0].filter("obs_id like 'k%'").collect())}


def test_growth_shuffles_a_row_twice_a_batch(spark):
    """By observation, then by key; where nothing is small enough to be sent to all tasks, as at size."""
    context, kept = spark.sparkContext._jsc.sc(), spark.conf.get("spark.sql.autoBroadcastJoinThreshold")

    def stages():
        context.listenerBus().waitUntilEmpty()
        found = context.statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None)
        return {x.stageId(): x.shuffleWriteBytes() for x in map(found.apply, range(found.size()))}

    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        last = max(stages(), default=-1)
        n = len(QUERIES["cluster_growth"](spark, "/root/testdata/sf0.01").collect())
        assert n == 15000 and 0 < sum(size for k, size in stages().items() if k > last) / n < 330
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)


def test_bulk_resolution_is_whole_or_not_at_all(spark):
    rows = spark.createDataFrame([(k, "open" if k != 3 else "confirmed", "x") for k in range(7)], "cluster_id long, status string, note string")
    asked = spark.createDataFrame([(1, 0, "confirmed"), (1, 1, "rejected"), (2, 2, "confirmed"), (2, 3, "confirmed"), (3, 1, "confirmed"), (3, 4, "confirmed"), (4, 5, "rejected"), (5, 6, "rejected"), (5, 99, "rejected")], "request_id long, cluster_id long, status string")
    got = {r.cluster_id: r.status for r in c.resolve_together(rows, asked).collect()}
    assert got == {0: "confirmed", 1: "rejected", 2: "open", 3: "confirmed", 4: "open", 5: "rejected", 6: "open"}
    assert c.resolve_together(rows, asked.limit(0)).count() == 7
