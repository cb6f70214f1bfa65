"""Pages that come with their glyphs are read without a shuffle, as those of single glyphs are."""

from pyspark.sql import functions as F

import __spark_entry__ as contract
from ledgerloom.operators import extraction


def test_lines_of_documents_need_no_shuffle(spark):
    found = contract.queries()["layout_lines"](spark, "/root/testdata/sf0.001")
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()


def test_single_glyphs_and_whole_pages_give_the_same(spark):
    boxes = [(1, "b", 30.0, 40.0, 0.5, 8.0), (1, "a", 0.0, 10.0, 0.0, 8.0), (1, "c", 0.0, 10.0, 20.0, 28.0), (1, "d", 11.0, 20.0, 21.0, 28.0), (2, "é", 5.0, 6.0, 0.0, 1.0)]
    rows = spark.createDataFrame(boxes, "page long, text string, x0 double, x1 double, y0 double, y1 double")
    got = sorted(tuple(r) for r in extraction.layout_lines(rows).collect())
    assert got == [(1, 0, "a  b"), (1, 1, "cd"), (2, 0, "é")]
    whole = rows.groupBy("page").agg(F.collect_list(F.struct(*extraction.GLYPH)).alias("glyphs"))
    assert sorted(tuple(r) for r in extraction.page_lines(whole).collect()) == got
