"""Transactions from the lines of account and card statements.

Each issuer and kind of instrument has a line grammar; a statement whose grammar reads no line is read by the universal
one. All is column expressions: a line sees its neighbours through one window over its statement.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions import text as x

# A word in the issuer's name, the kind of instrument (null: any), the grammar; the first that fits counts.
ISSUERS = [
    ("hdfc", "credit_card", "marked"), ("icici", "credit_card", "columns"), ("axis", None, "signed"), ("amex", None, "month_first"),
    ("hdfc", None, "account"), ("icici", None, "account"), ("sbi", None, "serial"),
]

_SLASHED, _AMOUNT, _CELL, _TEXT = r"[0-9]{2}/[0-9]{2}/[0-9]{4}", r"[0-9,]+\.[0-9]{2}", r"(?:[0-9,]+\.[0-9]{2}|-)", r".+?"
#: A line of each grammar from left to right: name of a cell ("" if it isn't read), what stands in it, what stands before it.
GRAMMARS: dict[str, list[tuple[str, str, str]]] = {
    "marked": [("day", _SLASHED, ""), ("text", _TEXT, r"\s+"), ("amount", _AMOUNT, r"\s+"), ("mark", "DR|CR|Dr|Cr", r"\s+")],
    "columns": [("day", "[0-9]{2}[/-][0-9]{2}[/-][0-9]{4}", ""), ("text", _TEXT, r"\s+"), ("out", _CELL, r"\s{2,}"), ("in", _CELL, r"\s+"), ("", _CELL, r"\s+")],
    "signed": [("day", _SLASHED, ""), ("text", _TEXT, r"\s+"), ("mark", "[+-]", r"\s+"), ("amount", _AMOUNT, "")],
    "month_first": [("day", _SLASHED, ""), ("text", _TEXT, r"\s+"), ("minus", "-?", r"\s+"), ("amount", _AMOUNT, "")],
    "account": [("day", _SLASHED, ""), ("text", _TEXT, r"\s+"), ("reference", r"\S*", r"\s+"), ("", _SLASHED, r"\s+"), ("out", _CELL, r"\s+"), ("in", _CELL, r"\s+"), ("", _AMOUNT, r"\s+")],
    "serial": [("", "[0-9]+", ""), ("day", "[0-9]{2}-[A-Za-z]{3}-[0-9]{4}", r"\s+"), ("text", _TEXT, r"\s+"), ("amount", _AMOUNT, r"\s+"), ("mark", "[Dd][Rr]|[Cc][Rr]", r"\s+")],
}
#: The universal line is read token by token. From the left: a date, perhaps a time behind a bar, the rest.
_NUMBERED, _NAMED = r"[0-9]{1,2}[/.-][0-9]{1,2}[/.-][0-9]{2,4}", r"[0-9]{1,2}[ /-][A-Za-z]{3}[ /-]?,? ?[0-9]{2,4}"
DATED = rf"^({_NUMBERED}|{_NAMED})(?:\s*\|\s*[0-9]{{1,2}}:[0-9]{{2}}(?::[0-9]{{2}})?)?\s+(.*)$"
#: Of the rest, from the right: a glyph of one or two signs, a marker, the amount.
PRICED = r"^(.*?)([0-9][0-9,]*\.[0-9]{2})(?:\s+([Dd]r|[Cc]r|DR|CR|D|C))?(?:\s+\S{1,2})?\s*$"
#: Before the amount: a mark of the currency (a misread sign among them), before that a sign; what is left describes it.
CURRENCY, SIGN = r"\s*(?:[C`₹]|Rs\.?|INR)?\s*$", r"\s*([+-]?)" 
# Texts of lines that are no transaction, on words in lower case with one blank between.
EXCLUDED = [
    "opening balance", "closing balance", "previous balance", "brought forward", "carried forward", "total transactions", "grand total", "sub total", "subtotal",
    "total amount", "reward point", "loyalty point", "payment received", "payment thank", "cr limit", "credit limit",
]
EXCLUDED_WHOLE = ["", "date", "description", "amount", "dr", "cr"]
#: Dates of statements: numbers with one separator twice; a day, a month's name and a year; year, month and day.
_DATE_NUMBERS = r"^([0-9]{1,2})([/.-])([0-9]{1,2})\2([0-9]{2}|[0-9]{4})$"
_DATE_NAMED = r"^([0-9]{1,2})(?:([ /-])([A-Za-z]{3})\2|\s([A-Za-z]{3}),\s)([0-9]{4}|[0-9]{2})$"
_DATE_ISO = r"^([0-9]{4})-([0-9]{1,2})-([0-9]{1,2})$"
#: The same shapes, but for years of four digits that begin with a zero.
_YEAR = "([1-9][0-9]{3}|[0-9]{2})$"
_NUMBERS_PLAIN, _NAMED_PLAIN = r"^([0-9]{1,2})([/.-])([0-9]{1,2})\2" + _YEAR, r"^([0-9]{1,2})(?:([ /-])([A-Za-z]{3})\2|\s([A-Za-z]{3}),\s)" + _YEAR
_ALONE = r"^\s*(?:[0-9]{2}[/-][0-9]{2}[/-][0-9]{4}|[0-9]{2}-[A-Za-z]{3}-[0-9]{4})"


def statement_date(text: Column) -> Column:
    """A date of any of the shapes; months in any case; years of two digits are 1969 to 2068."""
    return x.bound(F.trim(text), _read_date)


def _read_date(t: Column) -> Column:
    whole = lambda p, k: F.get(p, F.lit(k)).try_cast("int")
    name = lambda p: x.month_number(F.concat(F.get(p, F.lit(2)), F.get(p, F.lit(3))))
    # Nearly all dates are of these shapes, which a cast reads from year, month and day.
    short = F.right(t, F.lit(2))
    year = F.when(t.rlike("[0-9]{4}$"), F.right(t, F.lit(4))).otherwise(F.concat(F.when(short < "69", "20").otherwise("19"), short))
    plain = lambda month: F.concat(year, F.lit("-"), month.cast("string"), F.lit("-"), F.regexp_extract(t, "^[0-9]{1,2}", 0)).try_cast("date")
    return (F.when(t.rlike(_NUMBERS_PLAIN), plain(F.regexp_replace(t, _NUMBERS_PLAIN, "$3"))).when(t.rlike(_NAMED_PLAIN), plain(x.month_number(F.regexp_replace(t, _NAMED_PLAIN, "$3$4"))))
            .when(t.rlike(_DATE_NUMBERS), x.bound(x.parts(t, _DATE_NUMBERS, 4), lambda p: x.calendar_date(whole(p, 3), whole(p, 2), whole(p, 0))))
            .when(t.rlike(_DATE_NAMED), x.bound(x.parts(t, _DATE_NAMED, 5), lambda p: x.calendar_date(whole(p, 4), name(p), whole(p, 0))))
            .when(t.rlike(_DATE_ISO), x.bound(x.parts(t, _DATE_ISO, 3), lambda p: x.calendar_date(whole(p, 0), whole(p, 1), whole(p, 2)))))


def _month_first(day: Column) -> Column:
    at = lambda a, n: F.substring(day, a, n).try_cast("int")
    return x.calendar_date(at(7, 4), at(1, 2), at(4, 2))


def excluded(description: Column) -> Column:
    """Balances, totals, limits, points and headings."""
    words = F.trim(F.regexp_replace(F.lower(description), r"[^\p{L}\p{N}]+", " "))
    return x.bound(words, lambda w: reduce(Column.__or__, (w.contains(text) for text in EXCLUDED), w.isin(*EXCLUDED_WHOLE)))


def reference(text: Column) -> Column:
    """The first number of exactly twelve digits."""
    return x.group(text, x.REFERENCE)


def grammar_of(issuer: Column, kind: Column) -> Column:
    """The grammar of an issuer's statements, null for an unknown issuer."""
    out = None
    for word, only, grammar in ISSUERS:
        fits = F.lower(issuer).contains(word) if only is None else F.lower(issuer).contains(word) & (kind == only)
        out = F.when(fits, grammar) if out is None else out.when(fits, grammar)
    return out


def _letters(text: Column) -> Column:
    return F.length(F.regexp_replace(text, r"[^\p{L}]", ""))


def _merge_broken(lines: DataFrame) -> DataFrame:
    """A date alone on its line is put before the next one, if that isn't blank and doesn't begin with a date."""
    w = Window.partitionBy("statement_id").orderBy("line_no")
    rows = lines.withColumn("_alone", F.col("line").rlike(_ALONE + r"\s*$")).withColumn("_free", (F.trim("line") != "") & ~F.col("line").rlike(_ALONE))
    rows = rows.withColumns({"_before": F.lag(F.when(F.col("_alone"), F.trim("line"))).over(w), "_joins": F.coalesce(F.lead("_free").over(w), F.lit(False))})
    whole = F.when(F.col("_free") & F.col("_before").isNotNull(), F.concat_ws(" ", "_before", F.trim("line"))).otherwise(F.trim("line"))
    return rows.filter(~(F.col("_alone") & F.col("_joins"))).withColumn("line", whole).drop("_alone", "_free", "_before", "_joins")


_CELLS = ("day", "text", "amount", "mark", "minus", "out", "in", "reference")


def _cells(at: dict[str, int]) -> Callable[[Column], Column]:
    """All cells from the groups of a match, those without a group empty."""
    return lambda g: F.when(g.isNotNull(), F.struct(*((F.get(g, F.lit(at[c])) if c in at else F.lit("")).alias(c) for c in _CELLS)))


def _by_grammar(line: Column) -> Column:
    """struct of the cells that the line's own grammar reads, null if it reads none; a line is matched once."""
    out = None
    for name, cells in GRAMMARS.items():
        pattern = "^" + "".join(f"{gap}({what})" if cell else f"{gap}(?:{what})" for cell, what, gap in cells) + r"\s*$"
        read = [cell for cell, _, _ in cells if cell]
        found = x.bound(x.parts(line, pattern, len(read)), _cells({c: k for k, c in enumerate(read)}))
        out = F.when(F.col("grammar") == name, found) if out is None else out.when(F.col("grammar") == name, found)
    return out


def statement_rows(lines: DataFrame) -> DataFrame:
    """statement_id, line_no, entry_date, description, amount_minor, direction, reference_id of the transactions.

    ``lines`` has statement_id, line_no, line, issuer and kind. A row has the number of the line with its amount. Lines
    that aren't read, are excluded, or have no valid date or amount give nothing; a null line is blank.
    """
    rows = _merge_broken(lines.withColumn("line", F.coalesce("line", F.lit("")))).withColumn("grammar", grammar_of(F.col("issuer"), F.col("kind")))
    p = F.col("p")
    cell = lambda c: F.when(~p[c].isin("", "-"), p[c])
    own = F.struct(
        F.when(F.col("grammar") == "month_first", _month_first(p["day"])).otherwise(statement_date(p["day"])).alias("entry_date"), F.trim(p["text"]).alias("description"),
        x.amount_minor(F.coalesce(F.nullif(p["amount"], F.lit("")), cell("out"), cell("in"))).alias("amount_minor"),
        F.when(F.col("grammar") == "month_first", F.when(p["minus"] == "-", "credit").otherwise("debit")).when(cell("out").isNotNull(), "debit").when(cell("in").isNotNull(), "credit")
        .otherwise(x.strict_direction(p["mark"])).alias("direction"),
        F.coalesce(F.nullif(p["reference"], F.lit("")), reference(p["text"])).alias("reference_id"))
    read = rows.withColumn("p", _by_grammar(F.col("line"))).withColumn("own", F.when(p.isNotNull(), own)).drop("p")
    good = F.col("own").isNotNull() & ~excluded(F.col("own.description")) & F.col("own.entry_date").isNotNull() & F.col("own.amount_minor").isNotNull()
    statement = Window.partitionBy("statement_id")
    read = read.withColumn("own", F.when(good, F.col("own"))).withColumn("_known", F.count("own").over(statement) > 0)
    return _universal(read).filter("own IS NOT NULL").select("statement_id", "line_no", "own.*")


def _universal_cells(line: Column) -> Column:
    """struct(day, text, sign, amount, mark) of a line that the universal grammar reads, else null."""

    def priced(head: Column) -> Column:
        def described(tail: Column) -> Column:
            before = F.get(tail, F.lit(0))
            fields = {"day": F.get(head, F.lit(0)), "text": F.regexp_replace(before, SIGN + CURRENCY, ""), "sign": F.regexp_extract(before, SIGN + CURRENCY, 1), "amount": F.get(tail, F.lit(1)), "mark": F.get(tail, F.lit(2))}
            return F.when(tail.isNotNull(), F.struct(*(c.alias(n) for n, c in fields.items())))

        return x.bound(x.parts(F.get(head, F.lit(1)), PRICED, 3), described)

    return x.bound(x.parts(line, DATED, 2), priced)


def _universal(rows: DataFrame) -> DataFrame:
    """Rows whose ``own`` is filled by the universal grammar where ``_known`` doesn't hold."""
    near = Window.partitionBy("statement_id").orderBy("line_no")
    line = F.col("line")
    read = rows.withColumn("_u", F.when(~F.col("_known"), _universal_cells(line)))
    usable = F.when(~F.col("_known") & F.col("_u").isNull() & ~line.rlike(r"[0-9][0-9,]*\.[0-9]{2}") & (_letters(line) >= 2), line)
    seen = read.withColumn("_usable", usable).withColumn("_beside", F.concat_ws(" ", F.lag("_usable").over(near), F.lead("_usable").over(near)))
    found = seen.filter("_known OR _u IS NOT NULL").select("statement_id", "line_no", "own", "_known", "_beside", "_u.*").withColumn("text", F.when(F.col("text") == "", F.col("_beside")).otherwise(F.trim("text")))
    first = F.trim(F.get(F.filter(F.split("text", "   "), lambda s: F.trim(s) != ""), F.lit(0)))  # the first column of the description
    direction = F.when(F.upper("mark").isin("CR", "C"), "credit").when(F.upper("mark").isin("DR", "D"), "debit").when(F.col("sign") == "+", "credit").otherwise("debit")
    by_token = F.struct(
        statement_date(F.col("day")).alias("entry_date"), F.when(_letters(first) >= 3, first).otherwise(F.trim("text")).alias("description"),
        x.amount_minor(F.col("amount")).alias("amount_minor"), direction.alias("direction"), reference(F.col("text")).alias("reference_id"))
    asked = found.withColumn("_t", F.when(~F.col("_known") & ~excluded(F.col("text")) & (_letters(F.col("text")) >= 3), by_token))
    whole = F.col("_t.entry_date").isNotNull() & F.col("_t.amount_minor").isNotNull()
    return asked.withColumn("own", F.when(F.col("_known"), F.col("own")).when(whole, F.col("_t")))
