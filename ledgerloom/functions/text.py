"""Column functions on message and statement text. Absent is null, never zero or empty."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns that both a Java and an RE2 engine read alike.
AMOUNT_BEFORE = r"(?i)(?:Rs\.?|INR|USD|\$)\s*([0-9][0-9,]*(?:\.[0-9]+)?)"
AMOUNT_BEHIND = r"(?i)([0-9][0-9,]*(?:\.[0-9]+)?)\s*(?:INR|USD)"
REFERENCE = r"(?:^|[^0-9])([0-9]{12})(?:[^0-9]|$)"
MASKED = r"(?i)(?:a/c|card|account)\s*(?:no\.?|ending)?\s*[Xx*]*([0-9]{4})"
MERCHANT = r"(?i) (?:at|towards) ([A-Z][A-Z0-9 #&]+?)(?: on | via |\.|$)"
MERCHANT_LOOSE = r"(?i) (?:by|to|from) ([A-Z][A-Z0-9 #&]+?)(?: on | via |\.|$)"
PAYMENT_ADDRESS = r"([a-z0-9][a-z0-9._-]*@[a-z]{2,})(?:[^a-z0-9.]|$)"
DATE_TEXT = r"([0-9]{2}[-/][0-9]{2}[-/][0-9]{4})"
DEBIT_VERBS = ["debited", "spent", "paid", "withdrawn"]
CREDIT_VERBS = ["credited", "received", "refunded", "deposited"]
VERB = f"(?i)({'|'.join([*DEBIT_VERBS, *CREDIT_VERBS])})"


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is worked out once, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def group(text: Column, pattern: str, index: int = 1) -> Column:
    """A group of the first match, null without a match; the match is made once."""
    return F.get(F.filter(F.array(F.regexp_extract(text, pattern, index)), lambda s: s != ""), F.lit(0))


def group_with(text: Column, low: Column, words: list[str], pattern: str) -> Column:
    """As ``group``, asked only where the text in lower case (``low``) has one of ``words``: without them the pattern can't match."""
    return F.when(reduce(Column.__or__, (low.contains(w) for w in words)), group(text, pattern))


def amount_minor(text: Column) -> Column:
    """Digits and points of an amount as minor units, half away from zero; null over 1e15 or if it is none."""
    digits = F.rtrim(F.regexp_replace(text, "[^0-9.]", ""), F.lit("."))
    return bound(F.round(digits.try_cast("double") * 100), lambda value: F.when(value <= 1e15, value.cast("long")))


def parse_amount(text: Column) -> Column:
    """As ``amount_minor``, but points behind a letter (as in Rs.) don't count."""
    return amount_minor(F.regexp_replace(text, r"([A-Za-z])\.", "$1"))


def parse_date(text: Column, formats: list[str]) -> Column:
    return F.coalesce(*(F.try_to_timestamp(text, F.lit(f)).cast("date") for f in formats))


def calendar_date(year: Column, month: Column, day: Column) -> Column:
    """A date of whole numbers, null for none; years of two digits are 1969 to 2068."""
    whole = F.when(year < 69, year + 2000).when(year < 100, year + 1900).otherwise(year)
    return F.try_make_timestamp(whole, month, day, F.lit(0), F.lit(0), F.lit(0)).cast("date")


_MONTHS = "january february march april may june july august september october november december".split()


def month_number(name: Column, long: bool = False) -> Column:
    """The month of an English name, of three letters or (``long``) whole; null for another text."""
    named = {n: k for k, month in enumerate(_MONTHS, 1) for n in ({month, month[:3]} if long else {month[:3]})}
    return F.try_element_at(F.create_map(*(F.lit(v) for pair in named.items() for v in pair)), F.lower(name))


def parts(text: Column, pattern: str, count: int) -> Column:
    """The groups of a pattern that is anchored on both sides, in one match; null without a match."""
    joined = F.regexp_replace(text, pattern, "\x01".join(["", *(f"${k}" for k in range(1, count + 1))]))
    return F.get(F.transform(F.filter(F.array(joined), lambda s: s.startswith("\x01")), lambda s: F.slice(F.split(s, "\x01"), 2, count)), F.lit(0))


def direction(text: Column, low: Column | None = None) -> Column:
    """The earliest verb decides; null without a verb. ``low`` is the text in lower case, if it is at hand."""
    verb = F.lower(group_with(text, F.lower(text) if low is None else low, [*DEBIT_VERBS, *CREDIT_VERBS], VERB))
    return bound(verb, lambda v: F.when(v.isin(*DEBIT_VERBS), "debit").when(v.isin(*CREDIT_VERBS), "credit"))


def merchant(text: Column, low: Column | None = None) -> Column:
    """Behind a sure label, else behind one that may name a person, else a payment address."""
    low = F.lower(text) if low is None else low
    return F.trim(F.coalesce(group_with(text, low, [" at ", " towards "], MERCHANT), group_with(text, low, [" by ", " to ", " from "], MERCHANT_LOOSE), group_with(text, low, ["@"], PAYMENT_ADDRESS)))


def strict_direction(marker: Column) -> Column:
    m = F.lower(F.trim(marker))
    return F.when(m.isin("dr", "d", "debit", "-"), "debit").when(m.isin("cr", "c", "credit", "+"), "credit")


def tolerant_direction(marker: Column) -> Column:
    return F.when(F.lower(marker).contains("cr"), "credit").otherwise("debit")


def currency_code(mark: Column) -> Column:
    """INR for rupee marks, USD for the dollar sign, else the mark in capitals; null for none."""
    m = F.upper(F.rtrim(F.trim(mark), F.lit(".")))
    return F.when(m.isin("RS", "₹", "INR"), "INR").when(m.isin("$", "USD"), "USD").otherwise(F.nullif(m, F.lit("")))


def mask_digits(text: Column) -> Column:
    """Digits behind the last mask character, else the last four digits; addresses with an @ stay."""
    behind = F.regexp_extract(text, r"[Xx*]([^Xx*]*)$", 1)
    digits = F.regexp_replace(text, "[^0-9]", "")
    return F.when(text.contains("@"), text).when(text.rlike("[Xx*]"), F.regexp_replace(behind, "[^0-9]", "")).otherwise(F.right(digits, F.lit(4)))


def html_text(html: Column) -> Column:
    """Text of HTML: scripts and styles dropped, block ends as line feeds, tags dropped, six entities decoded."""
    out = F.regexp_replace(html, r"(?is)<(?:script|style)[^>]*>.*?</(?:script|style)>", " ")
    out = F.regexp_replace(out, r"(?i)<(?:br|/p|/div|/tr|/li|/h[1-6])[^>]*>", "\n")
    out = F.regexp_replace(out, r"(?s)<[^>]*>", "")
    for entity, sign in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        out = F.replace(out, F.lit(entity), F.lit(sign))
    return F.trim(F.regexp_replace(F.regexp_replace(out, r"[ \t]+", " "), r" *\n\s*", "\n"))


def redact(text: Column) -> Column:
    """E-mail addresses, card numbers, amounts and long numbers replaced by their kinds, and what stands behind the name of a secret."""
    for pattern, kind in PII:
        text = F.regexp_replace(text, pattern, kind)
    return F.regexp_replace(text, SECRET, "$1: [REDACTED]")


# What counts as personal, in the order in which it is replaced.
PII = [
    (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", "[EMAIL]"),
    (r"[0-9]{4}[ -]?[0-9]{4}[ -]?[0-9]{4}[ -]?[0-9]{4}", "[CARD]"),
    (r"(?i)(?:Rs\.?|INR|₹)\s*[0-9][0-9,.]*", "[AMOUNT]"),
    (r"[0-9]{6,}", "[NUMBER]"),
]
SECRET = r"(?i)(bearer|token|password|secret)\s*[:=]\s*\S+"
