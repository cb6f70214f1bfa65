"""Fuzzy merchants are those of all pairs, and few pairs are compared."""

import random

import pytest
from pyspark.sql import functions as F

from ledgerloom.functions.similarity import jaro_winkler_pair
from ledgerloom.operators import matching


def brute(raws, names, threshold):
    out = {}
    for raw in set(filter(None, raws)):
        scored = [(-round(jaro_winkler_pair(raw.lower(), n.lower()), 6), n) for n in set(names)]
        best = min((x for x in scored if -x[0] >= threshold), default=None)
        if best:
            out[raw] = (best[1], -best[0])
    return out


@pytest.mark.parametrize("threshold", [0.7, 0.92, 0.985])
def test_fuzzy_merchants_are_those_of_all_pairs(spark, threshold):
    r = random.Random(7)
    word = lambda: "".join(r.choice("abcdefg1 é") for _ in range(r.randint(1, 14)))
    names = [word() for _ in range(60)] + ["Shop#0012", "shop#0021", "SHOP#0012", "A" * 30, ""]

    def bent(text):
        chars = list(text)
        for _ in range(r.randint(0, 3)):
            at = r.randrange(len(chars) + 1)
            chars[at:at + r.randint(0, 2)] = r.choice(["", "z", "".join(reversed(chars[at:at + 2]))])
        return "".join(chars)

    raws = [bent(r.choice(names)) for _ in range(120)] + [n.upper() for n in names[:20]] + ["shop#0012", "Shop#0012x", "", None]
    got = matching.fuzzy_merchants(spark.createDataFrame([(x,) for x in raws], "raw string"), spark.createDataFrame([(n,) for n in names] + [(None,)], "name string"), threshold).collect()
    assert len({x.raw for x in got}) == len(got)
    assert {x.raw: (x["name"], x.score) for x in got} == brute(raws, names, threshold)


def test_numbered_names_meet_few_others(spark):
    names = spark.range(2000).select(F.format_string("supplier#%09d", "id").alias("_low"))
    texts = spark.range(2000).select(F.concat(F.format_string("supplier#%09d", "id"), F.lit("x")).alias("_low"))
    assert matching.close_pairs(texts, names, 0.985).count() == 2000
    assert matching.close_pairs(names, names, 0.985).count() < 2000 * 10
