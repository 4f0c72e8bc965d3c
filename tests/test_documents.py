"""Whole-paper operators on small literals."""

import time

from pyspark.sql import functions as F

from inkstone.operators import documents as D


def test_captions_go_on(spark):
    rows = [
        (1, 1, "Table 1: Effects of the", 0.0, 10.0, 1), (1, 2, "programme on wages", 12.0, 20.0, 1), (1, 3, "Notes: none", 22.0, 30.0, 2),
        (1, 4, "more text", 31.0, 40.0, 2), (1, 5, "Figure 2: Sums (in", 50.0, 60.0, 3), (1, 6, "Dollars)", 62.0, 70.0, 3), (1, 7, "Far below", 200.0, 210.0, 4),
    ]
    frame = spark.createDataFrame(rows, "page int, line int, content string, y0 double, y1 double, block int")
    got = {r["start"]: r["title"] for r in D.continued_captions(frame, ["page"]).collect()}
    assert got == {1: "Table 1: Effects of the programme on wages", 5: "Figure 2: Sums (in Dollars)"}


def test_hanging_references(spark):
    line = lambda page, n, text, x, y: ("p", page, n, text, float(x), float(y), 600.0, 800.0)
    rows = [
        line(1, 1, "Running Head", 50, 20), line(1, 2, "References", 50, 200), line(1, 3, "Becker, G. (1973). A long-", 50, 220), line(1, 4, "winded title.", 70, 230),
        line(1, 5, ", and (1974). Again.", 70, 240), line(2, 1, "Running Head", 50, 20), line(2, 2, "Clark, A. (2001).", 51, 60), line(2, 3, "17", 300, 70),
        line(2, 4, "Figures", 50, 300), line(2, 5, "Davis, B. (1999).", 50, 320),
    ]
    frame = spark.createDataFrame(rows, "paper_id string, page int, line int, content string, x0 double, y0 double, width double, height double")
    got = [(r["start_page"], r["content"]) for r in D.hanging_references(frame).orderBy("entry").collect()]
    assert got == [(1, "Becker, G. (1973). A long-winded title."), (1, ", and (1974). Again."), (2, "Clark, A. (2001).")]


def test_headers_of_long_tables(spark):
    """A table's width is found once, not once a row, so the time of a long table grows with its rows."""
    rows = spark.range(8000).select(F.lit(1).alias("t"), F.col("id").alias("line"), F.when(F.col("id") == 0, F.array(F.lit("a"), F.lit("b"), F.lit("c"))).when(F.col("id") % 2 == 0, F.array(F.lit("1"))).otherwise(F.array(F.lit("1"), F.lit("2"))).alias("cells"))
    begun = time.monotonic()
    row = D.promoted_header(rows, ["t"]).first()
    assert row["header"] == ["a", "b", "c"] and row["body"] == [["1", "2"] if k % 2 else ["1", ""] for k in range(1, 8000)]
    assert time.monotonic() - begun < 30


def test_headers_pairs_and_pages(spark):
    rows = spark.createDataFrame([(1, 1, ["Group", "Mean", "SD"]), (1, 2, ["1.0", "2.0"]), (1, 3, ["3.0"]), (2, 1, ["1", "2"]), (2, 2, ["3", "4"])], "t int, line int, cells array<string>")
    got = {r["t"]: (r["header"], r["body"]) for r in D.promoted_header(rows, ["t"]).collect()}
    assert got == {1: (["Group", "Mean", "SD"], [["1.0", "2.0"], ["3.0", ""]]), 2: (None, [["1", "2"], ["3", "4"]])}
    left, right = spark.createDataFrame([(1, "a"), (2, "b")], "i int, x string"), spark.createDataFrame([(1, "p")], "i int, y string")
    assert {r["i"]: r["error"] for r in D.zipped(left, right, [], "i").collect()} == {1: None, 2: "unpaired"}
    pages = [("p", 1, "x", "x", "coordinate_sorted", True, False, 0.3), ("p", 2, "x", "xx", "native_content_order_two_column", True, False, 0.3)]
    frame = spark.createDataFrame(pages, "k string, page int, raw_text string, normalized_text string, strategy string, two_column boolean, landscape boolean, similarity double")
    row = D.quality_pages(frame, ["k"]).first()
    assert (row["reading_order_review_pages"], row["suspicious_order_pages"], row["ratio_median"]) == ("1", "", 1.5)
    text = spark.createDataFrame([("p", 2, None, " b "), ("p", 1, "i", "a")], "k string, page int, label string, text string")
    assert D.full_text(text, ["k"]).first()["full_text"] == "# Page 1 (label: i)\n\na\n\n# Page 2\n\nb"
    assert D.numbered(text, ["k"], ["page"], "t").orderBy("page").select(F.collect_list("id")).first()[0] == ["t_001", "t_002"]
