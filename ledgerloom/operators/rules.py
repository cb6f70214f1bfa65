"""Extraction rules made from users' corrections, tried on their own source and on settled history.

Corrections are (bank, field, source, value). A rule is a pattern whose first group captures the field, or for fields of few
values the value itself. All of it is column expressions: patterns are data, and the join with settled samples is by bank
and field.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions.messages import grouped_digits
from ledgerloom.functions.text import bound

#: Characters of the source on each side of the value that a pattern holds on to.
ANCHOR = 24
#: A pattern captures so many characters at most.
CAPTURE = 80
#: So many settled messages of a bank are looked at, the latest.
SAMPLES = 20
#: Confidence of rules that were learned.
LEARNED = 0.95
#: Fields that are found in the text, and fields that have a few known values.
SPANS, AMOUNTS, DATES = ["amount", "merchant", "event_time", "reference_id", "balance", "last4"], ["amount", "balance"], ["event_time"]
OVERRIDES = {"direction": r"(?i)debit|credit", "currency": r"[A-Za-z]{3}"}
# The ways in which banks print a date.
DATE_FORMS = ["dd/MM/yyyy", "dd-MM-yyyy", "dd.MM.yyyy", "dd/MM/yy", "dd-MM-yy", "dd.MM.yy", "dd-MMM-yyyy", "dd-MMM-yy", "dd MMM yyyy", "dd MMM yy", "dd MMM, yyyy", "dd/MMM/yyyy", "yyyy-MM-dd"]


def relaxed(text: Column) -> Column:
    """A pattern for ``text`` that leaves its blanks and numbers open."""
    escaped = F.regexp_replace(text, r"([^\p{L}\p{N}\s])", r"\\$1")
    return F.regexp_replace(F.regexp_replace(escaped, "[0-9]+", r"\\d+"), r"\s+", r"\\s+")


def printed_forms(field: Column, value: Column) -> Column:
    """The ways in which a text may show a stored value: amounts are in minor units, times in ISO form."""
    v = F.trim(value)
    minor = F.abs(v.try_cast("long"))
    whole = F.floor(minor / 100)
    both = lambda number: F.concat(number, F.lit("."), F.lpad((minor % 100).cast("string"), 2, "0"))
    amounts = F.array_distinct(F.array(both(grouped_digits(whole)), both(whole.cast("string")), grouped_digits(whole), whole.cast("string")))
    dates = bound(F.try_to_timestamp(F.substring_index(v, " ", 1), F.lit("yyyy-MM-dd")), lambda day: F.when(day.isNotNull(), F.array(*(F.date_format(day, f) for f in DATE_FORMS))))
    known = F.when(field.isin(AMOUNTS) & minor.isNotNull(), amounts).when(field.isin(DATES), F.coalesce(dates, F.array(v))).otherwise(F.array(v))
    return F.when(v == "", F.array().cast("array<string>")).otherwise(known)


def _captured(source: Column, pattern: Column) -> Column:
    return F.trim(F.call_function("regexp_extract", source, pattern, F.lit(1)))


def _alike(a: Column, b: Column) -> Column:
    return F.lower(F.trim(a)) == F.lower(F.trim(b))


def span_pattern(source: Column, form: Column) -> Column:
    """A pattern from what stands around the first ``form`` in ``source``; null if it isn't there, or stands alone."""
    at = F.position(F.lower(form), F.lower(source))
    before = F.right(F.left(source, at - 1), F.lit(ANCHOR))
    after = F.substring(source, at + F.length(form), F.lit(ANCHOR))
    alone = (F.length(before) == 0) & (F.length(after) == 0)
    return F.when((at > 0) & (F.length(form) > 0) & ~alone, F.concat(F.lit("(?isu)"), F.when(at > 1, relaxed(before)).otherwise(""), F.lit(f"(.{{1,{CAPTURE}}}?)"), relaxed(after)))


def pattern_words(pattern: Column) -> Column:
    """The runs of two or more letters a to z that a text with a match of ``span_pattern`` has, in lower case, longest first."""
    fixed = F.regexp_replace(pattern, rf"^\(\?isu\)|\\d\+|\\s\+|\(\.\{{1,{CAPTURE}\}}\?\)", " ")
    words = F.array_distinct(F.regexp_extract_all(F.lower(fixed), F.lit("[a-z]{2,}"), F.lit(0)))
    return F.array_sort(words, lambda a, b: F.length(b) - F.length(a))


def synthesized(field: Column, source: Column, value: Column) -> Column:
    """struct(pattern, override) of the first printed form whose pattern finds that form in its own source; null without one."""
    own = lambda form: bound(span_pattern(source, form), lambda p: F.when(p.isNotNull() & _alike(_captured(source, p), form), p))
    good = F.aggregate(printed_forms(field, value), F.lit(None).cast("string"), lambda found, form: F.when(found.isNotNull(), found).otherwise(own(form)))
    override = None
    for name, allowed in OVERRIDES.items():
        fits = (field == name) & F.trim(value).rlike(f"^(?:{allowed})$")
        normal = F.upper(F.trim(value)) if name == "currency" else F.lower(F.trim(value))
        override = F.when(fits, normal) if override is None else override.when(fits, normal)
    found = F.struct(F.when(field.isin(SPANS), good).alias("pattern"), override.alias("override"))
    return bound(found, lambda r: F.when(r["pattern"].isNotNull() | r["override"].isNotNull(), r))


def agrees(field: Column, captured: Column, settled: Column) -> Column:
    """The captured text is the settled value, or one of the ways to print it."""
    return _alike(captured, settled) | F.exists(printed_forms(field, settled), lambda n: _alike(captured, n))


def synthesize_rules(corrections: DataFrame) -> DataFrame:
    """bank, field, pattern, override, corrections (how many gave the rule), without corrections that give none.

    ``corrections`` has bank, field, source and value; nulls in any of them give no rule.
    """
    rule = synthesized(F.col("field"), F.col("source"), F.col("value"))
    made = corrections.filter("bank IS NOT NULL").select("bank", "field", F.inline(F.array_compact(F.array(rule))))  # a generator: a filter would have the rule made again
    return made.groupBy("bank", "field", "pattern", "override").agg(F.count("*").alias("corrections"))


def latest_samples(settled: DataFrame, samples: int = SAMPLES) -> DataFrame:
    """The latest ``samples`` settled messages of each bank and field; ``settled`` has msg_id, bank, field, source, value, at."""
    latest = Window.partitionBy("bank", "field").orderBy(F.desc("at"), "msg_id")
    return settled.filter("value IS NOT NULL").withColumn("_p", F.row_number().over(latest)).filter(F.col("_p") <= samples).drop("_p")


def regression_checked(rules: DataFrame, settled: DataFrame, samples: int = SAMPLES) -> DataFrame:
    """``rules`` (bank, field, pattern, override) with accepted, n_samples (messages that a rule reads) and conflict.

    A rule is refused if it reads another value than the settled one from any of the latest messages; ``conflict`` has the
    settled value and what was captured, of the first message id. Messages that it doesn't read say nothing; without
    any, it is accepted.
    """
    keys = ["bank", "field", "pattern", "override"]
    tried = rules.select(*keys).distinct().join(latest_samples(settled, samples), ["bank", "field"])
    read = tried.withColumn("captured", F.coalesce("override", F.nullif(_captured(F.col("source"), F.col("pattern")), F.lit("")))).filter("captured IS NOT NULL")
    judged = read.withColumn("agrees", agrees(F.col("field"), F.col("captured"), F.col("value")))
    found = judged.groupBy(*(F.col(k).alias(f"_{k}") for k in keys)).agg(
        F.bool_and("agrees").alias("_ok"), F.count("*").alias("_n"), F.min_by(F.struct(F.col("value").alias("settled"), "captured"), F.when(~F.col("agrees"), F.col("msg_id"))).alias("_conflict"))
    joined = rules.join(found, reduce(Column.__and__, (F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys)), "left")
    return joined.select(*rules.columns, F.coalesce("_ok", F.lit(True)).alias("accepted"), F.coalesce("_n", F.lit(0)).alias("n_samples"), F.when(~F.col("_ok"), F.col("_conflict")).alias("conflict"))


def learn_rules(corrections: DataFrame, settled: DataFrame) -> DataFrame:
    """Rules that passed both checks, as ``extraction.learned`` takes them: rule_id, bank, field, pattern, rule_template, rule_confidence, successes, words."""
    good = regression_checked(synthesize_rules(corrections), settled).filter("accepted AND pattern IS NOT NULL")
    return good.select(F.sha2(F.concat_ws("|", "bank", "field", "pattern"), 256).alias("rule_id"), "bank", "field", "pattern", F.lit(None).cast("string").alias("rule_template"), F.lit(LEARNED).alias("rule_confidence"), F.col("corrections").alias("successes"), pattern_words(F.col("pattern")).alias("words"))
