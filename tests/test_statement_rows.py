"""Rows of statements: one pass over the lines."""

from ledgerloom.catalog import QUERIES


def test_lines_are_read_in_one_pass(spark):
    plan = QUERIES["statement_rows"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "Union" not in plan
