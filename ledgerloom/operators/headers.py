"""What a statement's header says: issuer, account, period, dates, amounts, network.

A value stands beside its label, on the same line or the next, or in the column below it: then of the values on the next
two lines the one counts that begins nearest to where the label begins. Characters are counted, so the pages keep the
layout of their text. All is column expressions.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions import text as x
from ledgerloom.operators.statements import statement_date

#: A value begins at most so many characters beside its label's beginning, on one of so many lines below.
REACH, LINES_BELOW = 24, 2
#: A first page with no more characters than this is a cover: then all pages are read.
COVER = 20

# Names in a statement's header and the issuers that they are of, in order of trial.
ISSUERS = [
    ("american express", "AMEX"), ("amex", "AMEX"), ("hdfc", "HDFC"), ("icici", "ICICI"), ("axis bank", "Axis"), ("state bank of india", "SBI"), ("sbi", "SBI"), ("kotak", "Kotak"), ("indusind", "IndusInd"),
    ("yes bank", "Yes Bank"), ("idfc", "IDFC"),
]
# Labels of headers.
PERIOD = r"(?:billing|statement)\s+period"
PRINTED = r"statement\s+(?:generation\s+)?date"
DUE = r"(?:payment\s+due\s+date|amount\s+due\s+date|due\s+date|pay\s+by)"
LEAST = r"\*{0,2}min(?:imum)?\s+(?:amount\s+|payment\s+)?due"
TOTAL = r"\*{0,2}(?:total\s+(?:amount|payment)\s+due|outstanding\s+balance|current\s+balance|closing\s+balance|amount\s+payable)"
ACCOUNT = [r"card\s+(?:ending|number|no\.?)", r"a/c\s+(?:no\.?|number|ending)", r"account\s+(?:no\.?|number|ending)"]
NETWORKS = [("VISA", r"\bvisa\b"), ("MasterCard", r"\bmaster\s?card\b"), ("RuPay", r"\brupay\b"), ("AMEX", r"\b(?:amex|american express)\b")]
# Of each label the words, in lower case, that stand wherever it does; any of the lists will do.
PERIOD_WORDS, PRINTED_WORDS, LEAST_WORDS = [["period"]], [["statement", "date"]], [["min", "due"]]
DUE_WORDS, TOTAL_WORDS, ACCOUNT_WORDS = [["due", "date"], ["pay", "by"]], [["total", "due"], ["balance"], ["payable"]], [[["card"]], [["a/c"]], [["account"]]]

_DAY, _SHORT_YEAR = r"[0-9]{1,2}", r"[0-9]{2,4}"
DATE = rf"(?:{_DAY}[-/.]{_DAY}[-/.]{_SHORT_YEAR}|{_DAY}[\s/-][A-Za-z]{{3}}[\s/-]?,?\s?{_SHORT_YEAR})"
NUMBERS = rf"(?:{_DAY}[-/]{_DAY}[-/]{_SHORT_YEAR})"
AMOUNT = r"[0-9][0-9,]*\.[0-9]{2}"
CURRENCY = r"(?:\(\s*[`₹]?\s*\)|INR|Rs\.?|[`₹])?"
MASKED = r"([0-9Xx*][0-9Xx*\s-]{3,24}[0-9])"


def _has(low: Column, words: list[list[str]]) -> Column:
    """Whether the words of one of the lists are all in a text of lower case; a search for them is far cheaper than for a pattern."""
    return reduce(Column.__or__, (reduce(Column.__and__, (low.contains(w) for w in ws)) for ws in words))


def _first(text: Column, low: Column, patterns: list[tuple[str, list[list[str]]]]) -> Column:
    """The first group of the first pattern that is found; each comes with the words without which it can't be."""
    return F.coalesce(*(F.when(_has(low, words), x.group(text, f"(?i){p}")) for p, words in patterns))


def _nearest(line: Column, value: str, column: Column) -> Column:
    """The value on a line that begins nearest to a column, the left of two as near; null if none is within reach."""

    def closer(best: Column, piece: Column) -> Column:
        at = best["end"] + F.length(piece["gap"])
        off = F.abs(at - column)
        taken = piece["v"].isNotNull() & (off < best["off"])
        return F.struct((at + F.coalesce(F.length(piece["v"]), F.lit(0))).alias("end"), F.when(taken, off).otherwise(best["off"]).alias("off"), F.when(taken, piece["v"]).otherwise(best["text"]).alias("text"))

    pieces = F.zip_with(F.split(line, f"(?i){value}"), F.regexp_extract_all(line, F.lit(f"(?i)({value})"), 1), lambda gap, v: F.struct(gap.alias("gap"), v.alias("v")))
    none = F.struct(F.lit(0).alias("end"), F.lit(REACH + 1).alias("off"), F.lit(None).cast("string").alias("text"))
    return F.aggregate(pieces, none, closer, lambda best: best["text"])


def below_label(lines: Column, label: str, value: str) -> Column:
    """The value below the first label that has none beside it and one below; ``lines`` is an array of lines."""

    def under(line: Column, k: Column) -> Column:
        def beneath(start: Column) -> Column:
            rest = F.substring(line, start + F.length(F.regexp_extract(line, f"(?i){label}", 0)), F.length(line))

            nexts = (F.get(lines, k + n) for n in range(1, LINES_BELOW + 1))
            return F.when((start > 0) & ~rest.rlike(f"(?i){value}"), F.coalesce(*(F.when(n.isNotNull(), _nearest(n, value, start - 1)) for n in nexts)))

        return x.bound(F.regexp_instr(line, F.lit(f"(?i){label}")), beneath)

    return F.get(F.filter(F.transform(lines, under), lambda v: v.isNotNull()), F.lit(0))


def header(text: Column) -> Column:
    """struct of issuer, period_start, period_end, statement_date, due_date, minimum_minor, total_minor, mask, network; null where not said."""

    def read(t: Column) -> Column:
        whole, low, lines = t["text"], t["low"], t["lines"]
        below = lambda label, words, value: F.when(_has(low, words), below_label(lines, label, value))
        beside = lambda label, words: (rf"{label}\s*:?\s+({DATE})", words)
        date = lambda label, words, *more: statement_date(F.coalesce(_first(whole, low, [beside(label, words), *more]), below(label, words, DATE)))
        amount = lambda label, words: x.bound(F.coalesce(_first(whole, low, [(rf"{label}\s*{CURRENCY}\s*:?\s*{CURRENCY}\s*({AMOUNT})", words)]), below(label, words, AMOUNT)), x.amount_minor)
        plain = lambda word: [(rf"billing\s+{word}[:\s]+({NUMBERS})", [["billing", word]]), (rf"{word}\s+date[:\s]+({NUMBERS})", [[word, "date"]]), (rf"period\s+{word}[:\s]+([0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}})", [["period", word]])]
        issuer = network = None
        for name, of in ISSUERS:
            issuer = F.when(low.contains(name), of) if issuer is None else issuer.when(low.contains(name), of)
        for name, pattern in NETWORKS:
            network = F.when(low.rlike(pattern), name) if network is None else network.when(low.rlike(pattern), name)
        account = F.coalesce(_first(whole, low, [(rf"{label}\s*:?\s*{MASKED}", words) for label, words in zip(ACCOUNT, ACCOUNT_WORDS)]), x.group(whole, r"(?i)([Xx*]{2,}[0-9Xx*\s-]*[0-9]{2,4})\b"))
        ends = (rf"{PERIOD}\s*:?\s+{DATE}\s*(?:-|–|—|to)\s*({DATE})", PERIOD_WORDS)
        return F.struct(
            issuer.alias("issuer"), date(PERIOD, PERIOD_WORDS, *plain("from")).alias("period_start"), statement_date(_first(whole, low, [ends, *plain("to")])).alias("period_end"),
            date(PRINTED, PRINTED_WORDS).alias("statement_date"), date(DUE, DUE_WORDS).alias("due_date"), amount(LEAST, LEAST_WORDS).alias("minimum_minor"), amount(TOTAL, TOTAL_WORDS).alias("total_minor"),
            x.bound(account, lambda a: F.nullif(x.mask_digits(a), F.lit(""))).alias("mask"), network.alias("network"))

    return x.bound(F.struct(text.alias("text"), F.lower(text).alias("low"), F.split(text, r"\r?\n").alias("lines")), read)


def statement_headers(pages: DataFrame) -> DataFrame:
    """statement_id and the fields of ``header`` for pages (statement_id, page_no, text).

    The first page is read, or all of them where that has next to nothing. Null texts are blank; a statement without text
    has a row of nulls. Pages that share a number stand in the order of their texts.
    """
    listed = pages.select("statement_id", F.struct("page_no", F.coalesce("text", F.lit("")).alias("text")).alias("p"))
    sorted_pages = listed.groupBy("statement_id").agg(F.array_sort(F.collect_list("p")).alias("ps"))  # the pages of one statement
    first = F.get("ps", F.lit(0))["text"]
    text = F.when(F.length(F.trim(first)) > COVER, first).otherwise(F.array_join(F.transform("ps", lambda p: p["text"]), "\n"))
    return sorted_pages.select("statement_id", text.alias("_t")).select("statement_id", header(F.col("_t")).alias("h")).select("statement_id", "h.*")
