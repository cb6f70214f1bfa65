"""Column functions on senders, headers, times, instalments, foreign amounts and display forms."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ledgerloom.functions.text import amount_minor, group

#: Offset of the event clock: event times are wall clock times of this zone.
EVENT_ZONE = "Asia/Kolkata"


def _nfkc(values: pd.Series) -> pd.Series:
    return values.map(lambda v: unicodedata.normalize("NFKC", v) if v is not None else None)


_nfkc.__annotations__ = {"values": pd.Series, "return": pd.Series}
#: Unicode NFKC, which Spark has no function for.
nfkc = F.pandas_udf(_nfkc, StringType())


def address(header: Column) -> Column:
    """The address of a From header: between angle brackets, else the whole; null unless it has exactly one @."""
    raw = F.lower(F.trim(F.coalesce(group(header, "<([^<>]+)>"), header)))
    return F.when(F.length(raw) - F.length(F.replace(raw, F.lit("@"), F.lit(""))) == 1, raw)


def domain(header: Column) -> Column:
    return F.nullif(F.substring_index(address(header), "@", -1), F.lit(""))


def auth_verdict(header: Column, method: str) -> Column:
    """The first verdict of spf, dkim or dmarc in an authentication header."""
    return F.lower(group(header, rf"(?i)\b{method}\s*=\s*([a-z]+)"))


def auth_failed(header: Column) -> Column:
    bad = [F.coalesce(auth_verdict(header, m).isin("fail", "softfail", "permerror"), F.lit(False)) for m in ("spf", "dkim", "dmarc")]
    return bad[2] | (bad[0] & bad[1])


def sender_risk(verdict: Column, header: Column, messages: Column, passes: Column) -> Column:
    """struct(score in [0, 1], signals): a base by verdict, more for failed authentication, less for a good history."""
    base = F.when(verdict.isin("verified", "verified_suffix"), 0.1).when(verdict.isin("spoof", "typosquat", "punycode"), 0.9).otherwise(0.5)
    failed, proven = auth_failed(header), F.coalesce((messages >= 10) & (passes >= 0.9 * messages), F.lit(False))
    score = F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), base + F.when(failed, 0.3).otherwise(0.0) - F.when(proven, 0.2).otherwise(0.0))), 2)
    signals = F.array_compact(F.array(F.when(failed, "auth_failed"), F.when(proven, "good_history"), F.when(base >= 0.9, "lookalike")))
    return F.struct(score.alias("score"), signals.alias("signals"))


def snippet(body: Column, length: int = 240) -> Column:
    flat = F.trim(F.regexp_replace(body, r"\s+", " "))
    return F.when(F.length(flat) > length, F.concat(F.left(flat, F.lit(length)), F.lit("…"))).otherwise(flat)


def plain_body(text: Column) -> Column:
    """Without quoted lines and what follows a line of two dashes; at most one blank line in a row."""
    # A list as the argument of a lambda is made once.
    lines = F.transform(F.array(F.split(text, "\r?\n")), lambda ls: F.struct(ls.alias("l"), F.array_position(F.transform(ls, lambda s: F.trim(s)), "--").alias("end")))
    above = F.get(F.transform(lines, lambda x: F.when(x["end"] > 0, F.slice(x["l"], F.lit(1), (x["end"] - 1).cast("int"))).otherwise(x["l"])), F.lit(0))
    kept = F.transform(F.filter(above, lambda s: ~F.ltrim(s).startswith(">")), lambda s: F.regexp_replace(s, r"\s+$", ""))
    return F.regexp_replace(F.regexp_replace(F.array_join(kept, "\n"), r"\n{3,}", "\n\n"), r"^\s+|\s+$", "")


def event_clock(epoch_ms: Column) -> Column:
    """Epoch milliseconds (or seconds, where that alone is plausible) as wall clock time; null outside of 2000 to 2100."""
    ms = F.when(F.abs(epoch_ms) < 10_000_000_000, epoch_ms * 1000).otherwise(epoch_ms)
    moment = F.from_utc_timestamp(F.timestamp_millis(ms), EVENT_ZONE)
    return F.when(ms.between(946684800000, 4102444800000), moment)


def installment(text: Column) -> Column:
    """struct(number, total) of 'EMI 3 of 12' and the like, null without one."""
    number, total = (group(text, r"(?i)\bemi\b[^0-9]*([0-9]{1,2})\s*(?:of|/)\s*([0-9]{1,2})", k).try_cast("int") for k in (1, 2))
    return F.when(number.isNotNull() & (number <= total), F.struct(number.alias("number"), total.alias("total")))


def installment_group(instrument: Column, merchant: Column, original_minor: Column, total: Column) -> Column:
    parts = (F.coalesce(c.cast("string"), F.lit("")) for c in (instrument, merchant, original_minor, total))
    return F.sha2(F.concat_ws("|", *parts).cast("binary"), 256)


def foreign_amount(text: Column, settled_currency: Column, settled_minor: Column) -> Column:
    """struct(currency, amount_minor, rate) of the first foreign code with an amount; null if it is the settled currency."""
    pattern = r"\b(USD|EUR|GBP|AED|SGD|JPY)\s*([0-9][0-9,]*(?:\.[0-9]+)?)"
    code, minor = group(text, pattern, 1), amount_minor(group(text, pattern, 2))
    rate = F.round(F.try_divide(settled_minor, minor), 6)
    return F.when(code.isNotNull() & (code != settled_currency), F.struct(code.alias("currency"), minor.alias("amount_minor"), rate.alias("rate")))


def grouped_digits(number: Column) -> Column:
    """A whole number with a comma before the last three digits and before each two above."""
    text = number.cast("string")
    tail = F.right(text, F.lit(3))
    head = F.when(F.length(text) > 3, F.left(text, F.length(text) - 3))
    return F.when(head.isNull(), text).otherwise(F.concat(F.regexp_replace(head, r"([0-9])(?=(?:[0-9]{2})+$)", "$1,"), F.lit(","), tail))


def money(minor: Column, currency: Column) -> Column:
    """An amount for people; a dash for null."""
    sign = F.when(currency == "INR", "₹").when(currency == "USD", "$").otherwise(F.concat(currency, F.lit(" ")))
    whole, rest = F.floor(F.abs(minor) / 100), F.lpad((F.abs(minor) % 100).cast("string"), 2, "0")
    digits = F.when(currency == "INR", grouped_digits(whole)).otherwise(F.format_number(whole, 0))
    return F.coalesce(F.concat(F.when(minor < 0, "-").otherwise(""), sign, digits, F.lit("."), rest), F.lit("—"))


def needles(minor: Column) -> Column:
    """The ways in which an amount may stand in a text."""
    whole, rest = F.floor(minor / 100), F.lpad((minor % 100).cast("string"), 2, "0")
    plain, comma = whole.cast("string"), grouped_digits(whole)
    both = F.array(F.concat(plain, F.lit("."), rest), F.concat(comma, F.lit("."), rest), F.when(minor % 100 == 0, plain), F.when(minor % 100 == 0, comma))
    return F.array_distinct(F.array_compact(both))


def self_transfer(text: Column) -> Column:
    """The own account that money was moved to, null if it was not."""
    return group(text, r"(?i)(?:own account|self)[^0-9]*[Xx*]*([0-9]{4})")


def networks(text: Column) -> Column:
    out = F.when(text.rlike(r"(?i)\bvisa\b"), "VISA")
    for name in ("MASTERCARD", "RUPAY", "AMEX"):
        out = out.when(text.rlike(rf"(?i)\b{name}\b"), name)
    return out


def payment_addresses(text: Column, owner: Column) -> Column:
    """Payment addresses in a text without the owner's."""
    return F.array_except(F.regexp_extract_all(F.lower(text), F.lit(r"[a-z0-9._-]+@[a-z]+\b"), F.lit(0)), F.array(F.lower(owner)))


def eta_seconds(done: Column, total: Column, elapsed: Column) -> Column:
    """Time that the rest will take at the pace so far; null before anything is done."""
    return F.when(done > 0, F.round(elapsed * (total - done) / done, 3))


# Words in a message's body and the bank that they tell, in order of trial; names that tell nothing.
BANK_WORDS = [("hdfc", "HDFC Bank"), ("indusind", "IndusInd Bank"), ("icici", "ICICI Bank"), ("axis", "Axis Bank"), ("sbi", "SBI Bank"), ("kotak", "Kotak Bank")]
NO_BANK, NO_NAMES = "Bank Alert", ["", "Bank Alert", "Bank / Service Alert"]


def bank_name(sender: Column, body: Column) -> Column:
    """The sender's name without its address and quotes; for a name that tells nothing the bank that the body names, else a general one."""
    shown = F.when(sender.contains("<"), F.regexp_replace(F.trim(F.substring_index(sender, "<", 1)), "^[\"']|[\"']$", "")).otherwise(sender)
    low, told = F.lower(body), None
    for word, bank in BANK_WORDS:
        told = F.when(low.contains(word), bank) if told is None else told.when(low.contains(word), bank)
    return F.when(F.coalesce(shown, F.lit("")).isin(*NO_NAMES), F.coalesce(told, F.lit(NO_BANK))).otherwise(shown)


def statement_name(issuer: Column, mask: Column, period_end: Column) -> Column:
    """The issuer's first word in capitals, the digits of the instrument's mask and the month; parts that are missing are left out."""
    bank = F.coalesce(F.nullif(F.upper(F.substring_index(F.trim(issuer), " ", 1)), F.lit("")), F.lit("Statement"))
    digits = F.nullif(F.right(F.regexp_replace(mask, "[^0-9]", ""), F.lit(4)), F.lit(""))
    return F.concat_ws(" ", bank, digits, F.date_format(period_end, "MMM yyyy"))


# Month names in file names, in order; patterns of year and month in digits, with the groups' order.
MONTHS = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]
FILE_PERIODS = [(r"(?:^|[-_])([0-9]{4})[-_]([0-9]{2})(?:[-_]|$)", 1, 2), (r"(?:^|[-_])([0-9]{2})[-_]([0-9]{4})(?:[-_]|$)", 2, 1), (r"(?:^|[-_ ])([0-9]{4})([0-9]{2})(?:[-_ ]|$)", 1, 2)]


def file_period_end(name: Column) -> Column:
    """The last day of the month that a file's name tells, in digits or by name; null before 2000 and without one."""
    stem = F.regexp_replace(F.lower(name), r"\.[^.]*$", "")
    tried = []
    for pattern, year, month in FILE_PERIODS:
        y, m = (group(stem, pattern, k).try_cast("int") for k in (year, month))
        tried.append(F.when(m.between(1, 12) & (y >= 2000), F.try_make_timestamp(y, m, F.lit(1), F.lit(0), F.lit(0), F.lit(0.0)).cast("date")))
    for k, month in enumerate(MONTHS):
        for pattern in (rf"{month}[-_]?([0-9]{{4}})", rf"([0-9]{{4}})[-_]?{month}"):
            y = group(stem, pattern, 1).try_cast("int")
            tried.append(F.when(y >= 2000, F.try_make_timestamp(y, F.lit(k + 1), F.lit(1), F.lit(0), F.lit(0), F.lit(0.0)).cast("date")))
    return F.last_day(F.coalesce(*tried))


# Names of brands and what stands for them in lower case; company endings and their forms, in order.
BRANDS = [
    ("Zomato", ["zomato"]), ("Swiggy", ["swiggy"]), ("Blinkit", ["blinkit", "blinkmerc"]), ("Flipkart", ["flipkart"]), ("Amazon", ["amazon"]), ("Airtel", ["airtel", "bhartiairtel"]),
    ("Reliance Jio", ["jio"]), ("CRED", ["dreamplug", "cred"]), ("Uber", ["uber"]), ("Ola", ["ola"]), ("Netflix", ["netflix"]), ("Spotify", ["spotify"]),
    ("MakeMyTrip", ["make my trip", "makemytrip"]), ("BookMyShow", ["bookmyshow"]), ("Zepto", ["zepto"]),
]
ENDINGS = [("PVTLTD", " Pvt Ltd"), ("LTD", " Ltd"), ("TECHNOLOGIES", " Tech"), ("TECHNOLOGI", " Tech"), ("SERVICES", " Services"), ("PAYMENTS", " Payments"), ("SOLUTIONS", " Solutions")]


def display_name(raw: Column) -> Column:
    """A merchant's name for people: a brand's, else the name with its endings spelt out, in title case if it is all in capitals."""
    low = F.lower(F.trim(raw))
    brand = None
    for name, parts in BRANDS:
        found = F.exists(F.array(*map(F.lit, parts)), lambda p: low.contains(p))
        brand = F.when(found, name) if brand is None else brand.when(found, name)
    spelt = F.trim(raw)
    for ending, form in ENDINGS:
        spelt = F.regexp_replace(spelt, f"(?i){ending}", form)
    own = F.when(spelt == F.upper(spelt), F.initcap(spelt)).otherwise(spelt)
    return F.when(F.coalesce(raw, F.lit("")) == "", "Unknown Merchant").otherwise(F.coalesce(brand, own))
