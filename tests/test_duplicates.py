"""Statements that were imported before, by file, by the month in the name, by the cycle in the header."""

from ledgerloom.operators.duplicates import duplicate_statements

SCHEMA = "statement_id string, file_hash string, instrument_id long, filename string, period_start string, period_end string"


def test_reasons(spark):
    known = spark.createDataFrame([
        ("h1", 1, "2024-01-01", "2024-01-31", False), ("h2", 1, "2024-02-10", "2024-03-09", None), ("h3", 2, "2024-01-01", "2024-01-31", True), (None, 3, None, None, False)],
        "file_hash string, instrument_id long, period_start string, period_end string, is_duplicate boolean")
    waiting = spark.createDataFrame([("w1",), (None,)], "file_hash string")
    rows = [
        ("same file", "h1", 9, "x.pdf", None, None), ("waiting", "w1", 9, None, None, None), ("marked file", "h3", 9, None, None, None), ("name", "n", 1, "ICICI_Credit_2024-01.pdf", None, None),
        ("name of another card", "n", 4, "ICICI_Credit_2024-01.pdf", None, None), ("marked cycle", "n", 2, "axis_jan2024.pdf", "2024-01-01", "2024-01-31"), ("cycle", "n", 1, "statement.pdf", "2024-02-10", "2024-03-09"),
        ("half a cycle", "n", 1, "statement.pdf", "2024-02-10", "2024-03-08"), ("file before name", "h2", 1, "SBI_2024_01.pdf", None, None), ("nulls", None, None, None, None, None), ("nulls of three", None, 3, None, None, None)]
    got = {r.statement_id: r.reason for r in duplicate_statements(spark.createDataFrame(rows, SCHEMA), known, waiting).collect()}
    assert got == {
        "same file": "file", "waiting": "file", "marked file": "file", "name": "name", "name of another card": None, "marked cycle": None, "cycle": "cycle", "half a cycle": None,
        "file before name": "file", "nulls": None, "nulls of three": None}
    assert duplicate_statements(spark.createDataFrame([], SCHEMA), known, waiting).count() == 0
