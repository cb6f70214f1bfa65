"""Matching of observations with ledger candidates: candidate joins, scores, decisions, merges."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions.similarity import jaro_winkler

#: What must agree exactly between an observation and a candidate.
KEYS = ["instrument_id", "amount_minor", "currency", "direction"]
VIABLE, MARGIN = 0.55, 0.15


def within(a: str, b: str, days: int) -> Column:
    """|a - b| <= days, both ends included."""
    return F.col(a).between(F.timestamp_add("DAY", F.lit(-days), F.col(b)), F.timestamp_add("DAY", F.lit(days), F.col(b)))


def seconds_between(a: str, b: str) -> Column:
    return F.abs(F.timestamp_diff("SECOND", F.col(a), F.col(b)))


def candidates(observations: DataFrame, canonical: DataFrame, days: int = 3) -> DataFrame:
    """Interval join on the four keys; the keys spread the rows, the interval is a residual condition."""
    right = canonical.withColumnsRenamed({"event_time": "cand_time", "reference_id": "cand_reference", "order_id": "cand_order"})
    return observations.join(right, KEYS).filter(within("event_time", "cand_time", days))


def exact_key(observations: DataFrame, canonical: DataFrame) -> DataFrame:
    """The least candidate that also has the reference."""
    joined = observations.join(canonical.select(*KEYS, "reference_id", "cand_id"), [*KEYS, "reference_id"])
    return joined.groupBy("obs_id").agg(F.min("cand_id").alias("cand_id"))


def time_proximity(a: str, b: str) -> Column:
    days = seconds_between(a, b) / 86400.0
    return F.when(days <= 1, 0.15 + 0.10 * (1 - days)).when(days <= 3, 0.10 * (1 - (days - 1) / 2.0)).otherwise(0.0)


def scored(pairs: DataFrame) -> DataFrame:
    """obs_id, cand_id, score in [0, 1], to six places."""
    ref, other = F.col("reference_id"), F.col("cand_reference")
    reference = F.when(ref.isNull() | other.isNull(), 0.0).when(ref == other, 0.25).when(ref.contains(other) | other.contains(ref), 0.10).otherwise(-0.25)
    across = ((F.col("source_pipeline") == "statement") & (F.col("source_mix") == "email_only")) | ((F.col("source_pipeline") == "email") & (F.col("source_mix") == "statement_only"))
    total = (
        F.coalesce(0.30 * jaro_winkler(F.lower("merchant_raw"), F.lower("merchant_name")), F.lit(0.0)) + time_proximity("event_time", "cand_time") + reference
        + F.lit(0.10) + F.lit(0.05)  # amount and direction are join keys
        + F.when(across, 0.05).otherwise(0.0))
    return pairs.select("obs_id", "cand_id", F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), total)), 6).alias("score"))


def exact_matches(observations: DataFrame, canonical: DataFrame, tolerance_seconds: int = 120) -> DataFrame:
    """The earliest candidate with the observation's fingerprint (the keys and the minute), if the times agree to the second's tolerance."""
    minute = lambda c: F.date_trunc("minute", F.col(c)).alias("_minute")
    left = observations.select("obs_id", *KEYS, "event_time", minute("event_time"))
    right = canonical.select("cand_id", *KEYS, F.col("event_time").alias("cand_time"), minute("event_time"))
    first = left.join(right, [*KEYS, "_minute"]).groupBy("obs_id").agg(F.min_by(F.struct("cand_id", "cand_time", "event_time"), F.struct("cand_time", "cand_id")).alias("m"))
    return first.filter(seconds_between("m.cand_time", "m.event_time") <= tolerance_seconds).select("obs_id", F.col("m.cand_id").alias("exact_id"))


def decided(observations: DataFrame, scores: DataFrame, exact: DataFrame | None = None) -> DataFrame:
    """exact with a verified fingerprint (obs_id, exact_id), score 1; new without a viable candidate; scored with one, or with
    a lead over the second beyond the margin; else ambiguous."""
    w = Window.partitionBy("obs_id").orderBy(F.desc("score"), "cand_id")
    ranked = scores.filter(F.col("score") >= VIABLE).withColumns({"place": F.row_number().over(w), "second": F.lead("score").over(w)}).filter("place = 1")
    joined = observations.select("obs_id").join(ranked.select("obs_id", "cand_id", "score", "second"), "obs_id", "left")
    joined = joined.join(exact, "obs_id", "left") if exact is not None else joined.withColumn("exact_id", F.lit(None).cast("string"))
    clear = F.col("second").isNull() | (F.round(F.col("score") - F.col("second"), 6) > MARGIN)
    decision = F.when(F.col("exact_id").isNotNull(), "exact").when(F.col("cand_id").isNull(), "new").when(clear, "scored").otherwise("ambiguous")
    return joined.select("obs_id", decision.alias("decision"), F.coalesce("exact_id", F.when(decision == "scored", F.col("cand_id"))).alias("cand_id"),
                         F.when(F.col("exact_id").isNotNull(), 1.0).otherwise(F.col("score")).alias("score"))


def clusters(scores: DataFrame, decisions: DataFrame) -> DataFrame:
    """Members of the clusters that ambiguous observations open, with their roles."""
    w = Window.partitionBy("obs_id").orderBy(F.desc("score"), "cand_id")
    viable = scores.filter(F.col("score") >= VIABLE).join(decisions.filter("decision = 'ambiguous'").select("obs_id"), "obs_id", "left_semi")
    ranked = viable.withColumn("place", F.row_number().over(w)).withColumn("best", F.max("score").over(Window.partitionBy("obs_id")))
    return ranked.select("obs_id", "cand_id", "score", F.when(F.col("place") == 1, "candidate_a").when(F.col("place") == 2, "candidate_b").otherwise("other").alias("role"),
                         F.when(F.col("best") > 0.75, "close_scores").otherwise("weak_evidence").alias("reason"))


def fingerprint(*parts: Column) -> Column:
    """SHA-256 of the parts joined by bars; a null part is empty, so parts keep their places."""
    return F.sha2(F.concat_ws("|", *(F.coalesce(p.cast("string"), F.lit("")) for p in parts)).cast("binary"), 256)


def fingerprint_matches(sightings: DataFrame, tolerance_seconds: int = 120) -> DataFrame:
    """Each sighting's earliest linked other sighting with its fingerprint, if the times agree."""
    linked = sightings.filter("linked").select("fingerprint", F.col("obs_id").alias("other_id"), F.col("event_time").alias("other_time"))
    pairs = sightings.join(linked, "fingerprint").filter(F.col("obs_id") != F.col("other_id"))
    first = pairs.groupBy("obs_id").agg(F.min_by(F.struct("other_id", "other_time", "event_time"), F.struct("other_time", "other_id")).alias("m"))
    return first.select("obs_id", F.col("m.other_id").alias("other_id"), (F.abs(F.timestamp_diff("SECOND", F.col("m.other_time"), F.col("m.event_time"))) <= tolerance_seconds).alias("verified"))


def day_bucket(time: Column, days: int) -> Column:
    """Times no more than ``days`` apart are in one bucket or in neighbours."""
    return F.floor(F.datediff(time.cast("date"), F.lit("1970-01-01").cast("date")) / days)


def near_in_time(left: DataFrame, right: DataFrame, on: list[str], left_time: str, right_time: str, days: int, back_only: bool = False) -> DataFrame:
    """Pairs that agree on ``on`` and are ``days`` apart at most; the keys are joined with time buckets, so that a busy key is many."""
    around = F.sequence(F.lit(-1), F.lit(0 if back_only else 1))
    b = day_bucket(F.col(left_time), days)
    spread = left.withColumn("_bucket", F.explode(F.transform(around, lambda k: b + k)))
    pairs = spread.join(right.withColumn("_bucket", day_bucket(F.col(right_time), days)), [*on, "_bucket"]).drop("_bucket")
    back = F.col(right_time).between(F.timestamp_add("DAY", F.lit(-days), F.col(left_time)), F.col(left_time))
    return pairs.filter(back if back_only else within(right_time, left_time, days))


def as_of(left: DataFrame, right: DataFrame, on: list[str], left_id: str, left_time: str, right_id: str, right_time: str, days: int, condition: Column | None = None) -> DataFrame:
    """For each left row the latest right row at or before it, ``days`` back at most; ties: the least right id."""
    joined = near_in_time(left, right, on, left_time, right_time, days, back_only=True)
    w = Window.partitionBy(left_id).orderBy(F.desc(right_time), right_id)
    return (joined if condition is None else joined.filter(condition)).withColumn("_p", F.row_number().over(w)).filter("_p = 1").drop("_p")


def merged(rows: DataFrame, gain: float = 0.15) -> DataFrame:
    """Ledger rows after their observations, in the order of time and id.

    ``rows`` has cand_id, source_mix and the ledger's reference_id, merchant, amount_minor as old_*, and the observation's
    own. A statement overwrites with what it has. A message fills what is missing once there is a statement; before, it
    overwrites if its confidence is more than ``gain`` over that of the message before it. Manual rows change nothing.
    """
    order = F.struct("event_time", "obs_id")
    before = Window.partitionBy("cand_id").orderBy("event_time", "obs_id").rowsBetween(Window.unboundedPreceding, -1)
    email, statement = F.col("source_pipeline") == "email", F.col("source_pipeline") == "statement"
    seen = rows.withColumns({"_stated": F.coalesce(F.max(statement).over(before), F.lit(False)), "_last": F.last(F.when(email, F.col("confidence")), ignorenulls=True).over(before)})
    alone = (F.col("source_mix") == "email_only") & ~F.col("_stated")
    better = F.coalesce(F.round(F.col("confidence") - F.col("_last"), 6) > gain, F.lit(False))
    marked = seen.withColumns({"_writes": statement | email & alone & better, "_fills": email & ~alone})

    def final(field: str, writes: Column, fills: Column | None) -> Column:
        has = F.col(field).isNotNull()
        ways = [F.max_by(field, F.when(writes & has, order)), F.first(f"old_{field}")]
        return F.coalesce(*ways, *([] if fills is None else [F.min_by(field, F.when(fills & has, order))])).alias(field)

    mix = F.first("source_mix")
    return marked.groupBy("cand_id").agg(
        final("reference_id", F.col("_writes"), F.col("_fills")), final("merchant", F.col("_writes"), F.col("_fills")), final("amount_minor", statement, None),
        F.max_by("event_time", F.when(statement, order)).cast("date").alias("posting_date"),
        F.when((mix == "email_only") & F.max(statement), "merged").when((mix == "statement_only") & F.max(email), "merged").otherwise(mix).alias("source_mix"))


#: Letters from the rarest to the most frequent; other characters count as rarer.
_OFTEN = "zqxjkvbpygfwmucldrhsnioate "
#: A text meets others under so many keys of a length at most.
KEYS_OF_A_LENGTH = 64


def _letters(text: Column) -> Column:
    """The characters of a text, each with its number among its like: sets of them share what the texts share. Rare ones come first, in one order for all texts."""
    chars = F.split(text, "")
    numbered = F.transform(chars, lambda c, i: F.struct((-F.size(F.filter(F.slice(chars, 1, i), lambda x: x == c))).alias("n"), F.position(c, F.lit(_OFTEN)).alias("often"), c.alias("c")))
    return F.transform(F.array_sort(numbered), lambda t: F.concat(t["c"], t["n"].cast("string")))


def _taken(left_out: int) -> int:
    """The most characters of a key, for ``left_out`` that can be missing, with no more than ``KEYS_OF_A_LENGTH`` keys."""
    k = 1
    while math.comb(left_out + k + 1, k + 1) <= KEYS_OF_A_LENGTH and k < 10_000:
        k += 1
    return k


def _keyed(texts: DataFrame, sizes: DataFrame, jaro: float) -> DataFrame:
    """``texts`` (_low, _letters, _own) once for each key under which they meet texts of the length ``_other``.

    Texts of lengths a and b need m = (3 jaro - 1) a b / (a + b) characters in common. Then of the a - m + k rarest ones of
    the first and the b - m + k rarest ones of the second at least k are the same: the keys are all choices of k of them.
    """
    least = max(0.0, 3 * jaro - 2)
    a, b = F.col("_own"), F.col("_other")
    near = F.sequence(F.greatest(F.ceil(a * least - 1e-4), F.lit(1)).cast("int"), F.floor(a / max(least, 0.1) + 1e-4).cast("int"))
    spread = texts.select("*", F.explode(near).alias("_other")).join(sizes.withColumnRenamed("_own", "_other"), "_other", "left_semi")
    need = F.greatest(F.ceil((3 * jaro - 1 - 1e-4) * a * b / (a + b)), F.lit(1)).cast("int")
    most = F.greatest(a, b) - F.col("_need")
    few = [_taken(n) for n in range(KEYS_OF_A_LENGTH)]  # one character, if more are missing
    take = F.least(F.col("_need"), F.coalesce(F.get(F.array(*map(F.lit, few)), most), F.lit(1)))
    rows = spread.withColumn("_need", need).filter(F.col("_need") <= F.least(a, b)).withColumn("_skip", a - F.col("_need")).withColumn("_take", take)
    begun = F.array(F.struct(F.lit(0).alias("taken"), F.lit(0).alias("skipped"), F.lit("").alias("key")))

    def longer(keys: Column, letter: Column) -> Column:
        with_it = F.transform(F.filter(keys, lambda k: k["taken"] < F.col("_take")), lambda k: F.struct((k["taken"] + 1).alias("taken"), k["skipped"].alias("skipped"), F.concat(k["key"], letter).alias("key")))
        return F.concat(with_it, F.transform(F.filter(keys, lambda k: k["skipped"] < F.col("_skip")), lambda k: F.struct(k["taken"].alias("taken"), (k["skipped"] + 1).alias("skipped"), k["key"].alias("key"))))

    made = F.aggregate(F.slice("_letters", 1, F.col("_skip") + F.col("_take")), begun, longer)  # all have taken and skipped as many
    return rows.select("_low", "_own", "_other", F.explode(F.array_distinct(F.transform(made, lambda k: F.xxhash64(k["key"])))).alias("_key"))


def close_pairs(texts: DataFrame, names: DataFrame, threshold: float) -> DataFrame:
    """(_low, _name): at least the pairs of distinct ``_low`` of both sides with a Jaro-Winkler similarity at or over the threshold.

    With m common characters and t transpositions Jaro is (m/a + m/b + (m - t)/m) / 3, and the first four characters add at
    most 0.4 of what is missing to 1. Pairs meet by keys of their common characters, and stay if their edits leave the threshold possible: t transpositions, if any, are 2 t + 1 substitutions at most.
    """
    jaro = (threshold - 0.4) / 0.6
    sized = lambda rows: rows.select("_low").distinct().filter(F.length("_low") > 0).withColumn("_letters", _letters(F.col("_low"))).withColumn("_own", F.length("_low"))
    left, right = sized(texts), sized(names)
    met = _keyed(left, right.select("_own").distinct(), jaro).join(
        _keyed(right, left.select("_own").distinct(), jaro).select(F.col("_low").alias("_name"), F.col("_own").alias("_other"), F.col("_other").alias("_own"), "_key"), ["_own", "_other", "_key"])
    a, b = F.col("_own"), F.col("_other")
    m, need = F.least(a, b), F.greatest(F.ceil((3 * jaro - 1 - 1e-4) * a * b / (a + b)), F.lit(1))
    swaps = F.floor(m * (m / a + m / b + 1 - 3 * jaro + 1e-4))
    edits = a + b - 2 * need + F.when(swaps > 0, 2 * swaps + 1).otherwise(0)
    return met.filter(F.levenshtein("_low", "_name") <= edits).select("_low", "_name").distinct()


def fuzzy_merchants(raw: DataFrame, merchants: DataFrame, threshold: float = 0.92) -> DataFrame:
    """raw, the best merchant by Jaro-Winkler at or over the threshold (ties: the least name), and the score.

    A text that is a name but for its case is settled by that: no other name has its score. The others are compared with
    the names that ``close_pairs`` leaves possible, each pair of lower-case texts once.
    """
    texts = raw.select("raw").distinct().filter(F.length("raw") > 0).withColumn("_low", F.lower("raw"))
    names = merchants.filter("name IS NOT NULL").groupBy(F.lower("name").alias("_low")).agg(F.min("name").alias("name"))
    short = F.length("_low") < 100_000  # of longer texts, one swap is less than a score's last digit
    same = texts.filter(short).join(names, "_low").select("raw", "name", F.lit(1.0).alias("score"))
    rest = texts.join(names.filter(short).select("_low"), "_low", "left_anti")
    pairs = close_pairs(rest, names, threshold).withColumn("score", F.round(jaro_winkler("_low", "_name"), 6)).filter(F.col("score") >= threshold)
    named = pairs.join(names.withColumnRenamed("_low", "_name"), "_name").groupBy("_low").agg(F.min_by(F.struct("name", "score"), F.struct(-F.col("score"), F.col("name"))).alias("m"))
    return rest.join(named, "_low").select("raw", "m.name", "m.score").unionByName(same)
