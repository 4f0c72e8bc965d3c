"""Library operators against small literals and plain loops."""

import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from inkstone.functions import text as T
from inkstone.operators import benchmark as B
from inkstone.operators import checks as C
from inkstone.operators import coverage as V
from inkstone.operators import documents as D
from inkstone.operators import editorial as E
from inkstone.operators import extract as X
from inkstone.operators import layout as L
from inkstone.operators import lifecycle as Y
from inkstone.operators import numeric as N
from inkstone.operators import pairs as P
from inkstone.operators import ranking as R
from inkstone.operators import resolve as S


def one(spark, column, **values):
    kinds = {str: "string", int: "int", type(None): "string", list: "array<string>"}
    frame = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {kinds[type(v)]}" for k, v in values.items()))
    return frame.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("f", "value", "want"),
    [
        (T.slug, "  A Paper: 2nd (v3)! ", "a-paper-2nd-v3"),
        (T.slug, "???", "paper"),
        (T.slug, None, "paper"),
        (T.page_text, "a­b c\r\n\r\n\r\n\r\nd \t e\r", "ab c\n\nd e\n"),
        (T.squash, "  a b\x1c\x85c ", "a b c"),
        (T.comparable, "It's 3.5% (up)!", "it s 3.5% up"),
        (T.signature, "Page 12 of 40", "page # of #"),
        (T.plausible_label, " 300 ", "300"),
        (T.plausible_label, "301", None),
        (T.plausible_label, "0", None),
        (T.plausible_label, "xiv", "xiv"),
        (T.label_value, "XIV", 14),
        (T.label_value, "mcmxc", 1990),
        (T.label_value, "07", 7),
        (T.label_value, "A1", None),
        (T.evidence_text, "un­\nlike  a-\nb", "unlike a- b"),
        (T.crossref_kind, "Figs.", "figure"),
        (T.control_codes, "a\x01b\x00\x01\t\n", ["U+0000", "U+0001"]),
        (T.tokens, "The studies increasing wanted classes of a b2 1.5", ["study", "increas", "want", "classe", "b2", "1.5"]),
    ],
)
def test_text_columns(spark, f, value, want):
    assert one(spark, f(F.col("c")), c=value) == want


def test_text_helpers(spark):
    assert one(spark, T.join_hyphens(F.col("c")), c=["co-", " operate ", "", "x"]) == "co-operate x"
    assert one(spark, T.line_number(F.col("c"), F.lit(4)), c="ab\nc\nd") == 2
    assert one(spark, T.context(F.col("c"), F.lit(5), F.lit(6), 2), c="01  4x6  9") == "4x6"
    assert one(spark, T.shorten(F.col("c"), 8), c="abcde fghij") == "abcde..."
    assert one(spark, T.magnitude(F.col("c"), F.lit(" percent ")), c="01,234.500") == "1234.5%"
    assert one(spark, T.first_filled(F.col("a"), F.col("b")), a=" ", b=" x  y ") == "x y"
    for kind, label, want in (("Table", "A.1", True), ("Table", "A", False), ("Appendix", "B", True), ("Eqs.", "3a", True), ("Box", "1", False)):
        assert one(spark, T.valid_crossref_label(F.col("k"), F.col("l")), k=kind, l=label) is want


@pytest.mark.parametrize(
    ("quote", "text", "want"),
    [
        ("rose 3.2", "it rose 3.2 points", True), ("3.2", "it rose -3.2", False), ("3.2", "it rose 3.21", False), ("3", "3% of", False),
        ("rise", "sunrise", False), ("rise", "sunrise or rise", True), ("un like", "un­\nlike", False), ("unlike", "un­\nlike", True), ("", "x", False), ("a (b", "a (b) c", True),
    ],
)
def test_quotes(spark, quote, text, want):
    assert one(spark, T.quote_stands(F.col("q"), F.col("t")), q=quote, t=text) is want


@pytest.mark.parametrize(
    ("quote", "text", "want"), [("a\\Eb", "so a\\Eb c", True), ("\\Q\\E(", "x \\Q\\E( y", True), ("a\\Eb", "ab", False), ("a b a", "1a b a b a", True)]
)
def test_quotes_of_any_signs(spark, quote, text, want):
    """Marks of a regular expression's quotes are letters like others; a place that overlaps one that doesn't stand counts."""
    assert one(spark, T.quote_stands(F.col("q"), F.col("t")), q=quote, t=text) is want


PAGES = [
    ("p", 1, "1 Data and Methods\nBecker (1973, 1974) and (Becker, 1973, 1974); see Figures 2 and 3 and Table A.1.\nBrown (2022) found 1,234.50 or -3.5% of x2 in 2SLS."),
    ("p", 2, "THE RESULTS\nSee equa-"),
    ("p", 3, "noise\ntions 4 and more\nReferences\nBecker, G. (1973). A title,\n  went on.\n, and (1974). Another one."),
    ("p", 4, "Clark, A. (2001). The last. Brown (2022)\nAppendix A\nDavis (1999) stands.\nTable 2: Sums\nTABLE 3 LARGE SUMS"),
]


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame(PAGES, "paper_id string, page int, text string")


def test_citations(pages):
    got = {(r["page"], r["match"]) for r in X.citations(pages).collect()}
    assert got == {(1, "Becker (1973, 1974)"), (1, "(Becker, 1973, 1974)"), (1, "Brown (2022)"), (4, "Davis (1999)")}


def test_numbers_like_the_pattern(spark, pages):
    got = [(r["page"], r["match_start"], r["match_end"], r["number"]) for r in X.numbers(pages).collect()]
    want = [(p, m.start(), m.end(), m[0].strip()) for _, p, t in PAGES for m in re.finditer(X.NUMBER, t, re.IGNORECASE)]
    assert sorted(got) == sorted(want) and (1, "1,234.50") in {(p, n) for p, _, _, n in got} and not any(n == "2" and p == 1 and s > 100 for p, s, _, n in got)


def test_crossrefs_and_split_words(pages):
    got = {(r["page"], r["kind"], r["label"]) for r in X.crossrefs(pages).collect()}
    assert {(1, "figure", "2"), (1, "figure", "3"), (1, "table", "A.1")} <= got
    assert [(r["page"], r["line"], r["kind"], r["label"]) for r in X.split_words(pages).collect()] == [(2, 2, "equation", "4")]


def test_sections_lists_and_captions(pages):
    got = [(r["heading"], r["start_page"], r["start_line"], r["end_page"], r["end_line"]) for r in X.sections(pages).orderBy("start_page", "start_line").collect()]
    assert got[:3] == [("1 Data and Methods", 1, 1, 2, None), ("THE RESULTS", 2, 1, 3, 2), ("References", 3, 3, 4, 1)] and got[-1][3:] == (4, None)
    ranges = {(r["page"], r["range_start"], r["range_end"]) for r in X.list_ranges(pages).collect()}
    assert ranges == {(3, PAGES[2][2].index("References"), len(PAGES[2][2])), (4, 0, PAGES[3][2].index("Appendix"))}
    entries = [r["content"] for r in X.reference_entries(pages).orderBy("entry").collect()]
    assert entries == ["Becker, G. (1973). A title, went on.", ", and (1974). Another one.", "Clark, A. (2001). The last. Brown (2022)"]
    captions = {(r["kind"], r["label"], r["title"]) for r in X.captions(pages).collect()}
    assert captions == {("table", "2", "Sums"), ("table", "3", "LARGE SUMS")}


HEADINGS = {
    True: [
        "2.1 Data", "References", "ONLINE APPENDIX", "THE MAIN RESULT", "Introduction", "Abstract", "conclusion", "I. Introduction", "IV. Results", "A Data", "B.1 Proofs", "9 Data and Methods",
        "B Online Appendix", "Appendix A", "Main Figures", "For Online Publication Only", "A.2.1 More proofs", "APPENDIXES", "II. METHODS",
    ],
    False: [
        "A B C D E", "x = 3", "Table 2: Sums", "10 Data", "N 100 200 300", "N 100 200", "A sentence.", "THE END OF THE STORY", "", "iv. results", "Figure 3", "A Panel B Panel", "12 men 13 Men",
        "0.5 Share 0.6 Share 0.7 Share", "Appendix A, continued", "REVIEWED BY", "J. K. Rowling", "10 DATA SOURCES", "2 USD prices", "3 A title. With more", "words of prose go on here", "Introduction:",
        "1 2 3 4", "a data", "X" * 141, "Mean 0.1 0.2 0.3 of all",
    ],
}


def test_headings(spark):
    rows = [(line, want) for want, some in HEADINGS.items() for line in some]
    got = spark.createDataFrame(rows, "c string, want boolean").select("c", "want", X.is_heading(F.col("c")).alias("x")).collect()
    assert [(r["c"], r["x"]) for r in got if r["x"] != r["want"]] == []


def test_headings_go_on_and_numbers_apart(spark):
    text = "2 Data for:\n2 Data\n\nof the sample\n3.1\n\nThe Title Here\nwords\n4\nOther"
    pages = spark.createDataFrame([("p", 1, text)], "paper_id string, page int, text string")
    lines = [("p", 1, 1, "3.1", 50.0, 100.0, 70.0, 110.0, True), ("p", 1, 2, "The Title Here", 80.0, 100.5, 200.0, 110.0, True), ("p", 1, 3, "Farther Away", 90.0, 100.0, 200.0, 110.0, True),
             ("p", 1, 4, "4", 50.0, 300.0, 60.0, 310.0, False), ("p", 1, 5, "Other", 70.0, 300.0, 90.0, 310.0, True)]
    found = X.numbered_headings(spark.createDataFrame(lines, "paper_id string, page int, line int, content string, x0 double, y0 double, x1 double, y1 double, bold boolean"))
    assert [(r["number"], r["title"]) for r in found.collect()] == [("3.1", "The Title Here")]
    got = [(r["heading"], r["start_line"]) for r in X.sections(pages, found).orderBy("start_line").collect()]
    assert got == [("2 Data of the sample", 2), ("3.1 The Title Here", 5)]
    assert one(spark, X.continues_heading(F.lit("2 Data:"), F.col("c")), c="And more") and not one(spark, X.continues_heading(F.lit("2 Data"), F.col("c")), c="And more")


def test_supported_captions(spark):
    text = "Table 3\nFigure 2\nwords\nNote: drawn\nFigure 4\nTable 5: Sums\nNotes: none\nTABLE 6 LARGE SUMS\nFig. 7: Shares\nTable 8:"
    pages = spark.createDataFrame([("p", 1, text)], "paper_id string, page int, text string")
    assert sorted((r["kind"], r["label"], r["title"], r["line"]) for r in X.captions(pages).collect()) == [
        ("figure", "2", "", 2), ("figure", "7", "Shares", 9), ("table", "5", "Sums", 6), ("table", "6", "LARGE SUMS", 8),
    ]
    found = {(r["kind"], r["label"]): (r["source"], r["reference_text"], r["at"]) for r in X.crossrefs(pages).collect()}
    assert found[("figure", "7")][:2] == (1, "Fig. 7") and found[("table", "5")] == (1, "Table 5", text.index("Table 5"))
    bare = spark.createDataFrame([("p", 1, "Tab. x", "Table 9: Raw")], "paper_id string, page int, text string, raw string")
    assert [(r["kind"], r["label"], r["source"], r["reference_text"]) for r in X.crossrefs(bare, "raw").collect()] == [("table", "9", 2, "Table 9")]
    rows = [(1, 1, "Table 1", 50.0, 10.0, 90.0, 20.0, 9.0, True, 1), (1, 2, "Effects on wages", 51.0, 25.0, 200.0, 35.0, 9.0, False, 1), (1, 3, "Table 2", 50.0, 50.0, 90.0, 60.0, 9.0, False, 2),
            (1, 4, "Beside it", 100.0, 50.5, 200.0, 60.0, 9.0, False, 2), (1, 5, "Table 3", 50.0, 90.0, 90.0, 99.0, 9.0, False, 3), (1, 6, "Under, not bold", 50.0, 105.0, 200.0, 115.0, 9.0, False, 3)]
    frame = spark.createDataFrame(rows, "page int, line int, content string, x0 double, y0 double, x1 double, y1 double, size double, bold boolean, block int")
    assert {(r["line"], r["title"], r["same_row"]) for r in X.titles_below(frame, ["page"]).collect()} == {(1, "Effects on wages", False), (3, "Beside it", True)}
    assert [one(spark, X.panel_label(F.col("c")), c=c) for c in ("Panel B: x", "panel 2", "Panels", "x")] == ["b", "2", None, None]


def test_positioned_items(spark):
    """Titles beside and below labels, lines that go on with them, crops within the page; the page without margins for the rest."""
    line = lambda n, text, x0, y0, bold=True, block=1, size=9.0: ("p", 1, n, text, x0, y0, x0 + 100.0, y0 + 10.0, size, bold, block)
    rows = [
        line(10, "Some words", 50.0, 5.0), line(20, "Table 1", 50.0, 20.0), line(30, "Effects on wages", 50.0, 32.0), line(40, "of all firms", 50.0, 43.0), line(50, "1 2 3", 200.0, 60.0, False, 2),
        line(60, "Figure 2: Shares of", 10.0, 100.0, block=3), line(70, "the market", 10.0, 112.0, block=4), line(80, "Words below", 10.0, 140.0, block=5),
        line(90, "Figure 3", 10.0, 160.0, False), line(95, "Table 4", 10.0, 190.0, False, 7), line(97, "Too far away", 10.0, 230.0, False, 7),
    ]
    lines = spark.createDataFrame(rows, "paper_id string, page int, line int, content string, x0 double, y0 double, x1 double, y1 double, size double, bold boolean, block int")
    items = D.positioned_items(lines, ["paper_id", "page"], 310, 240)
    got = {r["label"]: (r["caption"], r["n_caption"], r["n_lines"], [r[c] for c in ("cx0", "cy0", "cx1", "cy1")], [r[c] for c in ("x0", "y0", "x1", "y1")]) for r in items.collect()}
    assert got == {
        "1": ("Table 1: Effects on wages of all firms", 3, 4, [50.0, 20.0, 150.0, 53.0], [26.0, 10.0, 310.0, 80.0]),
        "2": ("Figure 2: Shares of the market", 2, 3, [10.0, 100.0, 110.0, 122.0], [0.0, 90.0, 134.0, 160.0]),
    }
    text = "Table 1: Told again\nFigure 9: Only in the text"
    raw = D.captioned_items(spark.createDataFrame([("p", 1, text)], "paper_id string, page int, text string"))
    every = {r["label"]: (r["source"], r["x0"], r["y0"], r["x1"], r["y1"]) for r in D.all_items(items, raw, 310, 240).collect()}
    assert {k: v[0] for k, v in every.items()} == {"1": "positioned_lines", "2": "positioned_lines", "9": "raw_text"} and every["9"][1:] == (48.0, 64.0, 262.0, 198.0)


def test_quality_summary(spark):
    columns = "paper string, page int, raw_text string, normalized_text string, strategy string, similarity double, scanned boolean, label_source string, ocr_recommended boolean, two_column boolean, landscape boolean"
    counted = sorted(D.COUNTED.values())
    long = "word " * 300
    rows = [
        ("p", 2, long, long, "native_content_order_two_column", 0.1, False, "native", True, True, None), ("p", 1, long, long, None, 0.4, None, None, None, None, None),
        ("p", 3, long, long.replace(" ", "\r\n"), "native_content_order_font_fidelity", 0.8, False, "geometric_candidate_rejected", False, False, False),
        ("p", 4, "Short one. " * 30 + "x" * 300, None, "coordinate_sorted", 0.1, False, None, False, True, False), ("p", 5, "  Table 2: x ", "y", "coordinate_sorted", None, False, None, False, False, True),
        ("p", 6, "", "", "coordinate_sorted", 1.0, True, None, False, False, False), ("q", 1, None, None, None, None, None, None, None, None, None),
    ]
    frame = spark.createDataFrame(rows, columns).select("*", *((F.when(F.col("page") == k + 1, 2) if k else F.lit(None).cast("int")).alias(n) for k, n in enumerate(counted)))
    got = {r["paper"]: r.asDict() for r in D.quality_summary(frame, ["paper"]).collect()}
    p = got["p"]
    lists = {k: v for k, v in p.items() if k.endswith("_pages") and k not in D.COUNTED}
    assert lists == {
        "ocr_recommended_pages": [2], "two_column_pages": [2, 4], "landscape_pages": [5], "rejected_geometric_page_label_pages": [3], "font_fidelity_order_fallback_pages": [3],
        "reading_order_review_pages": [1, 3, 4], "low_text_pages": [], "sparse_plausible_pages": [5], "suspicious_order_pages": [3],
    }
    assert {k: p[k] for k in D.COUNTED} == {k: ([counted.index(v) + 1] if 0 < counted.index(v) < 6 else []) for k, v in D.COUNTED.items()}
    assert p["strategies"] == {"coordinate_sorted": 4, "native_content_order_font_fidelity": 1, "native_content_order_two_column": 1}
    assert p["ratio_median"] == 1.0 and got["q"]["ratio_median"] is None and got["q"]["sparse_plausible_pages"] == [1]


def test_rows_of_captioned_tables(spark):
    lines = {
        1: ["Table 1: Wages by sex in 2010", "Panel A", "Men 10 20", "Women  30 (0.5)", "Notes: based on 120 rows 30 40", "Men 1 2"],
        2: ["Table 4: Sizes", "Base 993 1,023", "3.2 Design and Sample", "The work was done in three studies 5 6."],
        3: ["Figure 2: Other 5", "Figure 3: Other sums", "a b 1", "Figure 4: The end", "c 2"],
        4: ["one two three four five six seven eight nine ten eleven", "short label", "one two three four five six seven eight nine ten eleven", "* p<0.1 3 4"],
        5: ["Model Ex. 1 Ex. 2 Ex. 3", "Base 0.24 -0.68 0.32", "Other 0.46 - YES"],
        6: ["Table 2", "", "  "],
        7: ["a 1", "b 2 3", "one two three four five six seven eight nine ten eleven twelve thirteen"],
        8: ["alone", "words"],
        9: ["Note: nothing here 1 2"],
    }
    frame = spark.createDataFrame([(t, i, x) for t, xs in lines.items() for i, x in enumerate(xs, 1)], "table_id int, line int, content string")
    rows = {}
    for r in X.captioned_rows(frame, ["table_id"]).orderBy("table_id", "line").collect():
        rows.setdefault(r["table_id"], []).append((r["line"], r["label"], r["cells"]))
    assert rows == {
        1: [(2, "Panel A", []), (3, "Men", ["10", "20"]), (4, "Women", ["30", "(0.5)"])],
        2: [(2, "Base", ["993", "1,023"])],
        3: [(1, "Figure 2: Other", ["5"])],
        4: [(2, "short label", []), (3, lines[4][2], [])],
        5: [(1, "Model Ex. 1 Ex. 2 Ex.", ["3"]), (2, "Base", ["0.24", "-0.68", "0.32"]), (3, "Other", ["0.46", "-", "YES"])],
        7: [(1, "a", ["1"]), (2, "b", ["2", "3"]), (3, lines[7][2], [])],
        8: [(1, "alone", []), (2, "words", [])],
    }
    tables = {r["table_id"]: r for r in X.structured_tables(frame, ["table_id"]).collect()}
    assert (tables[5]["promoted"], tables[5]["columns"]) == (True, ["Model", "Ex. 1", "Ex. 2", "Ex. 3"])
    assert tables[5]["rows"] == [["Base", "0.24", "-0.68", "0.32"], ["Other", "0.46", "-", "YES"]]
    assert tables[1]["rows"] == [["Panel A", "", ""], ["Men", "10", "20"], ["Women", "30", "(0.5)"]] and tables[1]["columns"] == ["row_label", "value_1", "value_2"]
    review, prose = "caption_text_needs_visual_verification", "possible_prose_contamination"
    assert {t: (r["status"], r["flags"]) for t, r in tables.items()} == {
        1: (review, ["ragged_rows"]), 2: (review, []), 3: (review, []), 4: ("caption_text_unstructured", ["no_value_columns"]), 5: (review, []),
        6: ("caption_text_only", ["no_structured_cells"]), 7: ("caption_text_contaminated", ["ragged_rows", prose]),
        8: ("caption_text_unstructured", ["no_value_columns"]), 9: ("caption_text_only", ["no_structured_cells"]),
    }
    flags = {(r["table_id"], r["line"]): (r["width"], r["ragged"], r["sparse"]) for r in X.table_rows(frame, ["table_id"]).collect()}
    assert flags[1, 2] == (2, True, False) and flags[2, 2] == (2, False, False) and flags[8, 1] == (0, False, False)


def test_cells_addresses_tables(spark):
    cells = one(spark, X.trailing_cells(F.col("c")), c="Log of income 0.12*** (0.03) -1,234.5 12% Yes")
    assert (cells["label"], cells["cells"]) == ("Log of income", ["0.12***", "(0.03)", "-1,234.5", "12%", "Yes"])
    found = one(spark, X.urls(F.col("c")), c="(see https://a.org/x_(1)). https://b.org/y), https://a.org/x_(1)")
    assert found == ["https://a.org/x_(1)", "https://b.org/y"]
    report = "# R\n## One\nfirst\n\n## Two\n| a | b\\|c |\n| - | - |"
    assert one(spark, X.report_section(F.col("c"), "One"), c=report).strip() == "first"
    assert one(spark, X.report_section(F.col("c"), "None"), c=report) is None
    assert one(spark, X.pipe_table(F.col("c")), c=report)[0] == ["a", "b|c"]
    plausible = lambda t: F.length(t) > 8
    assert one(spark, X.last_plausible(F.col("c"), "# Report", plausible), c="# Report\nlong enough # Report") == "# Report\nlong enough # Report"


def test_label_runs(spark):
    rows = [("p", i, x) for i, x in enumerate(["01", "02", "03", "183", "8", "i", "ii", "iii", None, "4"], 1)]
    frame = spark.createDataFrame(rows, "paper string, page int, label string")
    got = [r["accepted"] for r in L.label_runs(frame, "paper", "page", "label").orderBy("page").collect()]
    assert got == [True] * 3 + [False] * 2 + [True] * 3 + [False] * 2


def test_box_joins(spark):
    box = "page int, box long, x0 double, y0 double, x1 double, y1 double"
    tables = spark.createDataFrame([(1, 1, 0.0, 0.0, 10.0, 10.0), (1, 2, 50.0, 0.0, 60.0, 10.0), (2, 3, None, None, None, None)], box)
    others = spark.createDataFrame([(1, 7, 5.0, 5.0, 20.0, 20.0), (1, 8, 0.0, 0.0, 10.0, 6.0), (2, 9, 0.0, 0.0, 5.0, 5.0), (1, 6, 10.0, 0.0, 20.0, 10.0)], box)
    assert [(r["box"], r["caption"]) for r in L.nearest_caption(tables, others).collect()] == [(1, 8)]
    assert {r["box"] for r in L.excluded(tables, others).collect()} == {2}
    assert {(r["box"], r["n_images"], r["status"]) for r in L.images_in_crops(tables.where("box < 3"), others).collect()} == {(1, 2, "embedded_image"), (2, 0, "page_crop")}
    assert L.merge_rectangles([(0, 0, 10, 10), (25, 0, 40, 10), (60, 60, 70, 70), (41, 25, 50, 50)]) == [(0, 0, 70, 70)]


def test_line_groups_and_ranges_like_loops(spark):
    rnd = random.Random(1)
    words = [(p, rnd.uniform(0, 500), float(rnd.randint(0, 60)), 0.0, 0.0, f"w{i}") for i, p in enumerate([1, 2] * 60)]
    words = [(p, x, y, x + 9, y + 5, w) for p, x, y, _, _, w in words]
    got = {}
    for r in L.line_groups(spark.createDataFrame(words, "page int, x0 double, y0 double, x1 double, y1 double, label string"), ["page"]).collect():
        got.setdefault(r["page"], []).append((r["line_no"], r["content"]))
    for page in (1, 2):
        rows = []
        for _, x, y, _, _, w in sorted((w for w in words if w[0] == page), key=lambda w: (w[2], w[1])):
            if rows and abs(sum(v[0] for v in rows[-1]) / len(rows[-1]) - y) <= 3.0:
                rows[-1].append((y, x, w))
            else:
                rows.append([(y, x, w)])
        assert sorted(got[page]) == [(i, " ".join(w for _, _, w in sorted(r, key=lambda v: v[1]))) for i, r in enumerate(rows, 1)]
    lines = [(1, i, "x" * rnd.randint(0, 90)) for i in range(1, 200)]
    got = [(r["first"], r["last"], r["bytes"]) for r in C.greedy_ranges(spark.createDataFrame(lines, "d int, line int, content string"), ["d"], 300, 7).orderBy("range").collect()]
    want = []
    for _, i, c in lines:
        n = len(c) + 1
        if want and want[-1][2] + n <= 300 and i - want[-1][0] < 7:
            want[-1] = (want[-1][0], i, want[-1][2] + n)
        else:
            want.append((i, i, n))
    assert got == want


def quantity(value, half="0", unit="usd", sample="s", scale="number"):
    return {"value": value, "source_id": "q", "unit": unit, "sample": sample, "denominator": "d", "context": "c", "scale": scale, "rounding_half_width": half}


def check(operation, inputs, reported, computed, tolerance="0"):
    return {"kind": "arithmetic", "operation": operation, "quantities": inputs, "reported": reported, "computed_value": computed, "tolerance": tolerance}


@pytest.mark.parametrize(
    ("c", "want"),
    [
        (check("sum", [quantity("2"), quantity("3")], quantity("6"), "5"), "arithmetic_discrepancy"),
        (check("sum", [quantity("2", "0.5"), quantity("3", "0.5")], quantity("6", "0.5"), "5"), "rounding_compatible"),
        (check("sum", [quantity("2"), quantity("3", sample="t")], quantity("5"), "5"), "unresolved"),
        (check("sum", [quantity("2"), quantity("3")], quantity("5"), "4"), "unresolved"),
        (check("percentage_points", [quantity("15", scale="percent"), quantity(".10", scale="proportion")], quantity("5", scale="percent"), "5"), "rounding_compatible"),
        (check("percent_change", [quantity("15", scale="percent"), quantity(".10", scale="proportion")], quantity("50", scale="percent"), "50"), "rounding_compatible"),
        (check("ratio", [quantity("1"), quantity("0", "0.5")], quantity("1"), "1"), "unresolved"),
        (check("product", [quantity("2", "0.5"), quantity("-3", "0.5")], quantity("-8"), "-6"), "rounding_compatible"),
        (check("mean", [quantity("1"), quantity("x")], quantity("1"), "1"), "unresolved"),
        ({"kind": "cross_source"}, "unresolved"),
    ],
)
def test_verdicts(spark, c, want):
    frame = spark.createDataFrame([(c,)], f"c {N.CHECK}")
    assert frame.select(N.verdicts(F.col("c"))["status"]).first()[0] == want


def test_bounds_over_all_values():
    """Bounds against the extremes over a grid of the inputs' intervals."""
    inputs = [N.bounds("3", "0.5", "number"), N.bounds("-2", "0.25", "number")]
    for name in ("sum", "mean", "product", "difference", "percentage_points", "ratio", "percent_change"):
        grid = [N.result(name, [(x, x, x), (y, y, y)])[0] for x in (inputs[0][1], inputs[0][0], inputs[0][2]) for y in (inputs[1][1], inputs[1][0], inputs[1][2])]
        assert N.result(name, inputs)[1:] == (min(grid), max(grid))
    assert N.spelled(N.Fraction(1, 3)) == "0." + "3" * 40 and N.spelled(N.Fraction(5)) == "5"


def test_reasons(spark):
    cases = {
        "unknown scale": check("sum", [quantity("1", scale="score")], quantity("1"), "1"),
        "not a decimal number": check("sum", [quantity("nan")], quantity("1"), "1"),
        "number out of range": check("sum", [quantity("1e101")], quantity("1"), "1"),
        "negative rounding half-width": check("sum", [quantity("1", "-0.5")], quantity("1"), "1"),
        "negative tolerance": check("sum", [quantity("1")], quantity("1"), "1", "-1"),
        "operation not supported": check("median", [quantity("1")], quantity("1"), "1"),
        "wrong number of inputs": check("ratio", [quantity("1")], quantity("1"), "1"),
        "quantities missing": check("sum", [], quantity("1"), "1"),
        "reported unit differs": check("sum", [quantity("1")], quantity("1", unit="eur"), "1"),
        "numbers and shares are mixed": check("sum", [quantity("1"), quantity("1", scale="percent")], quantity("1"), "1"),
        "the divisor's interval holds zero": check("ratio", [quantity("1"), quantity("0", "1")], quantity("1"), "1"),
        "source, unit, sample, denominator or context missing": check("sum", [quantity("1", unit=" ")], quantity("1"), "1"),
    }
    frame = spark.createDataFrame([(k, c) for k, c in cases.items()], f"k string, c {N.CHECK}")
    assert {r["k"]: r["reason"] for r in frame.select("k", N.verdicts(F.col("c"))["reason"].alias("reason")).collect()} == {k: k for k in cases}


def test_resolution(spark):
    texts = ["The 2SLS and 3D checks report -1.11.", "A share of 32%.", "Eq. (3a) and Table 2; 1,200.50 percentage points, 3 + x", ""]
    frame = S.with_said(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string"), "t", "s").orderBy("i")
    said = [r["s"].asDict(True) for r in frame.collect()]
    pairs = lambda i, k: [(x["key"], x["item"]) for x in said[i][k]]
    assert pairs(0, "numbers") == [("1.11", "-")] and pairs(1, "numbers") == [("32%", None)]
    assert pairs(2, "places") == [("equation", "3a"), ("table", "2")] and pairs(2, "numbers") == [("1200.5pp", None)] and pairs(3, "numbers") == []
    for a, b, want in (
        ("Table 2 differs", "Table 3 differs", True), ("rose by 3.5", "rose by 4", True), ("the effect is positive", "the effect is negative", True),
        ("correct 5 to 7", "correct 7 to 5", True), ("Table 2: 32%", "Table 2: 32 percent", False), ("nothing here", "nothing there", False),
        ("+3 and 5", "-3 and 5", True), ("3 of 5", "5", False), ("Table 2, Figure 1", "Table 2, Figure 9", True),
    ):
        both = S.with_said(spark.createDataFrame([(0, a), (1, b)], "i int, t string"), "t", "s").orderBy("i").collect()
        assert S.Claims([r["s"].asDict(True) for r in both]).contradicts(1).tolist() == [want], (a, b)
    assert S.ratio("abcd", "bcde") == 0.75 and S.ratio("", "") == 0.0 and S.ratio("ab", "abababab", 0.72) == 0.0
    f = lambda i, who, text, page=1: ("p", i, "m", who, page, text, text)
    rows = [f(1, "a", "The sample size in the main table is wrong"), f(2, "b", "The sample size in the main table is wrong here"),
            f(3, "a", "The sample size in the main table is wrong too"), f(4, "c", "Standard errors lack clustering"), f(5, "b", "Standard errors lack clustering", 9)]
    schema = "paper_id string, id long, issue_class string, rater string, page int, summary string, claim string"
    for some in (rows, rows[::-1]):
        got = {r["id"]: r["cluster"] for r in S.clusters(spark.createDataFrame(some, schema)).collect()}
        assert got[2] in (got[1], got[3]) and got[1] != got[3] and len({got[1], got[4], got[5]}) == 3


def near_findings(seed, n):
    """Findings whose likenesses lie about every floor: few stems, words replaced, letters changed, numbers, places, raters."""
    rng = random.Random(seed)
    stems = [a + b for a in ("grad", "mark", "sampl", "weight", "panel", "cluster") for b in ("or", "ent", "al", "ix", "um")]
    rows, texts = [], ["", "tabel eror", "table error", "tables errors"]
    for i in range(n):
        if texts and rng.random() < 0.75:
            words = rng.choice(texts).split()
            for _ in range(rng.randint(0, 3)):
                if words:
                    k = rng.randrange(len(words))
                    words[k] = rng.choice([rng.choice(stems), words[k][:-1] + "x", "", words[k] + "s"])
        else:
            words = [rng.choice([*stems, "the", "of"]) for _ in range(rng.choice([2, 4, 7, 12]))]
        text = " ".join(w for w in words if w)
        if rng.random() < 0.1:
            text += rng.choice([" in Table 2", " in Table 3", " of 5", " increase", " decrease"])
        texts.append(text)
        claim = rng.choice([text, "", rng.choice(texts), " ".join(rng.choices(stems, k=9))])
        rows.append(("p1" if rng.random() < 0.9 else "p2", i, "m" if rng.random() < 0.8 else "r", rng.choice("abcd"), rng.choice([None, None, 1, 1, 1, 2]), rng.choice([text, text, None]), claim))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_clusters_like_whole_folds(spark, monkeypatch, seed):
    """Folds over linked findings give what folds over all of a paper's findings of a class give."""
    schema = "paper_id string, id long, issue_class string, rater string, page int, summary string, claim string"
    findings = spark.createDataFrame(near_findings(seed, 160), schema)
    got = {(r["paper_id"], r["id"]): r["cluster"] for r in S.clusters(findings).collect()}
    pairs = P.linked(findings, S.STRONG)
    assert 40 < pairs.count() <= 160 and pairs.select("paper_id", "issue_class", "component").distinct().count() > 1
    monkeypatch.setattr(S, "linked", lambda rows, least: rows.select("paper_id", "issue_class", "id", F.lit(0).cast("long").alias("component")))
    whole = {(r["paper_id"], r["id"]): r["cluster"] for r in S.clusters(findings).collect()}
    assert got == whole and len(set(whole.values())) < 150


def test_clusters_of_few_search_no_pairs(spark, monkeypatch):
    """A class of few findings is one fold, with the clusters that folds over what pairs link give; only others search for pairs."""
    schema = "paper_id string, id long, issue_class string, rater string, page int, summary string, claim string"
    rows = near_findings(3, 120)
    findings = spark.createDataFrame([*rows, *((p, i + 1000, *rest) for p, i, *rest in rows[:40])], schema)
    with monkeypatch.context() as m:
        m.setattr(S, "linked", None)
        whole = {(r["paper_id"], r["id"]): r["cluster"] for r in S.clusters(findings).collect()}
    for few in (0, 30):
        with monkeypatch.context() as m:
            m.setattr(S, "FEW", few)
            assert {(r["paper_id"], r["id"]): r["cluster"] for r in S.clusters(findings).collect()} == whole
    assert len(whole) == 160 and len(set(whole.values())) < 150


def test_pairs_like_all_pairs(spark):
    schema = "paper_id string, id long, issue_class string, rater string, page int, summary string, claim string"
    rows = near_findings(5, 120)
    texts = P.distinct_texts(spark.createDataFrame(rows, schema)).cache()
    said = texts.collect()
    want, close = {}, set()
    for a in said:
        for b in said:
            if a["id"] < b["id"] and (a["paper_id"], a["issue_class"]) == (b["paper_id"], b["issue_class"]):
                cosines = []
                for k in ("short", "long"):
                    x, y = Counter(a[k]), Counter(b[k])
                    dot = sum(x[t] * y[t] for t in x)
                    cosines += [round(dot / (sum(v * v for v in x.values()) * sum(v * v for v in y.values())) ** 0.5, 9) if dot else 0.0, len(x.keys() & y.keys())]
                if cosines[1] >= 4 or cosines[3] >= 8:
                    want[a["id"], b["id"]] = cosines
                if max(S.ratio(a["summary"], b["summary"]), S.ratio(b["summary"], a["summary"])) >= S.STRONG:
                    close.add((a["id"], b["id"]))
    got = {(r["a"], r["b"]): [round(r["short_cosine"], 9), r["short_shared"], round(r["long_cosine"], 9), r["long_shared"]] for r in P.stem_pairs(texts).collect()}
    assert got == want and want
    blocks = P.BLOCK
    try:
        for P.BLOCK in (blocks, 17):
            letters = [(r["a"], r["b"]) for r in P.letter_pairs(texts, S.STRONG).collect()]
            assert len(letters) == len(set(letters)) and close <= set(letters) and close
    finally:
        P.BLOCK = blocks


def test_benchmark_cell(spark):
    samples = spark.createDataFrame([("s1", "c", "r", "p", 1, "complete"), ("s2", "c", "r", "q", 1, "failed")], "sample_id string, `case` string, role string, profile string, repeat int, status string")
    ratings = [("s1", 1, "k1", "confirmed", "true", 2, 0), ("s1", 2, "k1", "confirmed", "false", 1, 1), ("s1", 3, "k2", "false_positive", "unknown", 0, 2), ("s1", 4, "k3", "unresolved", "true", 1, 3)]
    ratings = spark.createDataFrame(ratings, "sample_id string, finding_id long, issue_key string, verdict string, evidence_correct string, actionability int, row int")
    truth = spark.createDataFrame([("c", "k1", ["r"], 3.0, "confirmed"), ("c", "k9", ["r"], 1.0, "confirmed"), ("c", "k8", ["x"], 1.0, "confirmed")], "`case` string, issue_key string, roles array<string>, weight double, status string")
    cells = B.cell_metrics(samples, ratings, truth)
    r = cells.collect()[0]
    assert (r["confirmed_unique"], r["duplicate_rows"], r["precision_resolved"], r["precision_lower"], r["recall"], r["weighted_recall"]) == (1, 1, 0.5, 1 / 3, 0.5, 0.75)
    assert (r["precision_upper"], r["evidence_accuracy"], r["mean_actionability"]) == (2 / 3, 2 / 3, 1.0)
    macro = {m["profile"]: (m["planned"], m["complete"], m["matched_cells"], m["recall_macro"]) for m in B.macro_metrics(samples, cells).collect()}
    assert macro == {"p": (1, 1, 0, None), "q": (1, 0, 0, None)}


def test_schedule_and_packet(spark):
    cases = spark.createDataFrame([("c", ["a", "b"])], "`case` string, roles array<string>")
    profiles = spark.createDataFrame([("p",), ("q",)], "profile string")
    jobs = B.schedule(cases, profiles, 2, 7)
    assert jobs.count() == 8 and jobs.select("job").distinct().count() == 8
    first = {r["job"]: r["sample_id"] for r in B.blind_packet(jobs, 1, 3).collect()}
    assert sorted(first.values()) == [f"s{i:06d}" for i in range(1, 9)] and first == {r["job"]: r["sample_id"] for r in B.blind_packet(jobs, 1, 3).collect()}


def test_usage(spark):
    turn = '{"type":"turn.completed","usage":{"input_tokens":100,"cached_input_tokens":80,"output_tokens":30}}'
    rows = [("a", turn), ("a", '{"type":"other"}'), ("b", turn), ("b", turn), ("c", "truncated {"), ("c", turn), ("d", "{}")]
    got = {r["job"]: (r["status"], r["input_uncached"]) for r in B.usage(spark.createDataFrame(rows, "job string, line string")).collect()}
    assert got == {"a": ("reported", 20), "b": ("ambiguous-or-incomplete", None), "c": ("unavailable", None), "d": ("ambiguous-or-incomplete", None)}


def test_routes(spark):
    c = F.col
    rows = [(i, "high", "high", "manuscript_issue", "no") for i in range(10)] + [(20, "low", "high", "copyedit_issue", "no"), (21, "high", "high", "manuscript_issue", "cannot_verify")]
    frame = spark.createDataFrame(rows, "id int, severity string, confidence string, issue_class string, assessment string").withColumn("paper", F.lit("p"))
    frame = frame.withColumn("score", R.priority(c("severity"), c("confidence"), c("issue_class")))
    frame = frame.withColumn("section", R.route(c("issue_class"), c("assessment"), c("confidence"), c("score"), F.lit(False)))
    got = {r["id"]: (r["score"], r["section"]) for r in R.cap_top(frame, "paper", "id").collect()}
    assert got[7] == (90, "highest_priority") and got[8] == (90, "additional") and got[20] == (-20, "grammar_appendix") and got[21][1] == "cannot_verify"


def test_state_and_checks(spark):
    attempts = [("a", 1, 1, "start"), ("a", 2, 2, "fail"), ("b", 1, 1, "accept"), ("b", 2, 2, "fail"), ("c", 1, 1, "fail"), ("c", 2, 2, "fail"), ("c", 3, 3, "fail"), ("d", 1, 1, "start")]
    got = {r["task"]: r["status"] for r in C.task_state(spark.createDataFrame(attempts, "task string, ts int, attempt int, kind string")).collect()}
    assert got == {"a": "retry", "b": "accepted", "c": "exhausted", "d": "inflight"}
    decisions = [(1, "merged", 2), (2, "merged", 3), (3, "included", None), (4, "merged", 5), (5, "merged", 4), (6, "merged", 99), (7, "merged", 8), (8, "rejected", None)]
    got = {r["id"]: (r["terminal"], r["error"]) for r in C.terminals(spark.createDataFrame(decisions, "id long, disposition string, destination long")).collect()}
    assert got == {1: (3, None), 2: (3, None), 4: (None, "cycle"), 5: (None, "cycle"), 6: (None, "unknown destination"), 7: (None, "rejected")}
    names = {"STORE_API_KEY": True, "KEYBOARD": False, "DB_PASSWORD": True, "API_NAME": False}
    assert {n: one(spark, C.sensitive(F.col("c")), c=n) for n in names} == names
    listing = spark.createDataFrame([("x/table_1.csv",), ("x/table_2.csv",), ("x/table.csv",)], "path string")
    assert [r["path"] for r in C.stale(listing, spark.createDataFrame([("x/table_1.csv",)], "path string"), "table").collect()] == ["x/table_2.csv"]
    filled = one(spark, C.render_template(F.col("c"), {"a": F.lit("{b}")}), c="x {a}")
    assert filled == "x {b}" and one(spark, C.render_template(F.col("c"), {"a": F.lit("1")}), c="{a} {left}") is None
    assert one(spark, L.remove_artifacts(F.col("c"), F.array(F.lit("HEAD"), F.lit("x"))), c="HEAD text HEAD") == " text HEAD"


def test_long_chains_and_rings(spark):
    chain = [(i, "merged", i + 1) for i in range(200)] + [(200, "included", None)] + [(1000 + i, "merged", 1000 + (i + 1) % 7) for i in range(7)]
    got = {r["id"]: (r["terminal"], r["steps"], r["error"]) for r in C.terminals(spark.createDataFrame(chain, "id long, disposition string, destination long")).collect()}
    assert all(got[i] == (200, 200 - i, None) for i in range(200)) and all(got[1000 + i] == (None, None, "cycle") for i in range(7))


def test_prose(spark):
    cases = {
        "plain\nwords": [], "# Head": ["boundary in prose"], "a\n---": ["boundary in prose"], "### deeper": [], "| a |\n| --- |\n| b |": [], "| a | b |\n| --- |": ["table without delimiters"],
        "| a |": ["table without delimiters"], "x\n| a\\|b | c |\n| :-: | --- |": ["table without delimiters"], "| a\\|b | c |\n| :---: | --- |": [],
    }
    frame = spark.createDataFrame([(t,) for t in cases], "t string").select("t", E.prose_errors(F.col("t")).alias("e"))
    assert {r["t"]: r["e"] for r in frame.collect()} == cases


def test_traceability_rows(spark):
    text = "## Appendix: Traceability Map\nwords\n| Canonical ID | x | Source finding IDs |\n| --- | --- | --- |\n| CANON-001 | CANON-009 | a:NA-001; b:AB-002 |\n| none | | |\n\nend | CANON-003 |\n| CANON-004 | | |"
    rows = one(spark, E.map_rows(F.col("c")), c=text)
    assert [(r["ids"], r["sources"]) for r in rows] == [(["CANON-001"], ["a:NA-001", "b:AB-002"]), ([], [])] and one(spark, E.map_rows(F.col("c")), c="nothing") == []


def test_coverage_rules(spark):
    key = "paper_id string, rater string, item_id string"
    records = [
        ("p", "r", "claim:1", "checked", "c", ["O1"], None, True, "did", "central", [], "full"), ("p", "r", "claim:2", "not_applicable", None, [], None, True, "did", "x", [], "full"),
        ("p", "r", "odd", "linked_finding", None, ["O9"], "r", True, "did", "x", ["F9"], "sampled"), ("p", "r", "must", "not_checked", None, [], "why", None, None, "x", ["F1"], "sampled"),
    ]
    frame = spark.createDataFrame(records, f"{key}, status string, claim string, source_object_ids array<string>, reason string, attempted boolean, check_performed string, importance string, finding_ids array<string>, scope string")
    required = spark.createDataFrame([("p", "r", "must", ["O1"]), ("p", "r", "left", [])], f"{key}, object_ids array<string>")
    objects, findings = spark.createDataFrame([("p", "O1")], "paper_id string, id string"), spark.createDataFrame([("p", "r", "F1")], "paper_id string, rater string, id string")
    done = spark.createDataFrame([("p", "r", "complete"), ("p", "s", "complete")], "paper_id string, rater string, state string")
    got = sorted((r["item_id"] or "", r["error"]) for r in V.coverage_errors(frame, required, objects, findings, done).collect())
    assert got == sorted([
        ("claim:2", "claim without evidence"), ("claim:2", "exclusion without reason"), ("odd", "unknown item"), ("odd", "unknown object"), ("odd", "unknown finding"), ("must", "assigned objects omitted"),
        ("must", "contradicts completion"), ("must", "finding link"), ("left", "unaddressed"), ("", "no ledger"),
    ])


def test_repairs_and_leases(spark):
    rows = [("r", k, s, 2) for k, s in enumerate(["a", "a", "Bad", "b", "c", "b"])] + [("s", 0, "a", 0), ("s", 1, "a", -1)]
    got = {(r["run"], r["place"]): (r["number"], r["refused"]) for r in Y.repair_grants(spark.createDataFrame(rows, "run string, place int, stage string, cap int")).collect()}
    assert [got["r", k] for k in range(6)] == [(1, None), (None, "stage repaired before"), (None, "invalid"), (2, None), (None, "cap reached"), (None, "stage repaired before")]
    assert got["s", 0] == (None, "cap reached") and got["s", 1] == (None, "invalid")
    frame = spark.createDataFrame([(None, None, None), ("a", None, "b"), (None, "b", "a"), ("a", "b", None), ("z", None, None)], "e string, s string, p string")
    r = frame.select(Y.resolved_choice(F.col("e"), F.col("s"), F.col("p"), ("a", "b"), "a").alias("r")).collect()
    assert [(x["r"]["choice"], x["r"]["error"]) for x in r] == [("a", None), ("a", None), ("b", None), (None, "differs from saved run"), (None, "unknown explicit choice")]
    assert [one(spark, Y.portable(F.col("c"), F.lit("/a/b/")), c=c) for c in ("/a/b/c/d", "/a/bc", "/a/b")] == ["c/d", "/a/bc", "."]


def test_unlike_texts_are_not_matched(monkeypatch):
    """Texts whose common letters are too few, and equal texts, are told without block matching; others as before."""
    import random

    from inkstone.operators import glyphs

    rng = random.Random(5)
    real = glyphs.SequenceMatcher
    for _ in range(200):
        a = "".join(rng.choice("abcd ") for _ in range(rng.randrange(1, 60)))
        b = "".join(c for c in a if rng.random() > 0.08) + rng.choice(["", "x", "ab"])
        repairs = [(i, "é") for i, c in enumerate(a) if c == "a"]
        matcher, put = real(None, a, b, autojunk=False), {}
        if repairs and matcher.ratio() >= 0.9:
            for m in matcher.get_matching_blocks():
                put |= {m.b + i - m.a: x for i, x in repairs if m.a <= i < m.a + m.size}
        assert glyphs.align(a, b, repairs) == ("".join(put.get(i, c) for i, c in enumerate(b)), len(put))
    monkeypatch.setattr(glyphs, "SequenceMatcher", None)
    text = "".join(rng.choice("etaoin shrdlu") for _ in range(2000))
    assert glyphs.align(text, text[::-1], [(0, "é")]) == (text[::-1], 0)
    assert glyphs.align(text, text, [(3, "é")]) == (text[:3] + "é" + text[4:], 1)


def test_repeated_texts_are_matched_once(monkeypatch):
    """A fold over findings that say the same few things matches each pair of texts once, in each order."""
    import pandas as pd

    from inkstone.operators import resolve

    made, real = [], resolve.SequenceMatcher
    monkeypatch.setattr(resolve, "SequenceMatcher", lambda *a, **k: made.append(a[1:3]) or real(*a, **k))
    said = {"places": [], "numbers": [], "directions": []}
    texts = ["standard errors of the main table are missing", "standard errors of the main tables are missing"]
    rows = [(f"r{i}", 1.0, texts[i % 2], "a claim", texts[i % 2].split(), texts[i % 2].split(), said, said) for i in range(40)]
    frame = pd.DataFrame(rows, columns=["rater", "page", "summary", "claim", "short", "long", "summary_says", "claim_says"])
    assert resolve.grouped(frame).tolist() == [0] * 40
    assert 0 < len(made) <= 6


def test_findings_are_compared_by_their_texts(monkeypatch):
    """What forbids a merge is asked once a text and not once a finding, however many raters and pages tell it."""
    import pandas as pd

    from inkstone.operators import resolve

    asked, real = [], resolve.Claims.contradicts
    monkeypatch.setattr(resolve.Claims, "contradicts", lambda self, *a: asked.append(a) or real(self, *a))
    said = [{"places": [], "numbers": [], "directions": [way]} for way in ("up", "down")]
    rows = [(f"r{i // 2 % 3}", float(i // 60), "standard errors are missing here", "a claim", ["standard", "error"], ["standard", "error"], said[i % 2], said[i % 2]) for i in range(120)]
    frame = pd.DataFrame(rows, columns=["rater", "page", "summary", "claim", "short", "long", "summary_says", "claim_says"])
    got = resolve.grouped(frame).tolist()
    assert max(got) == 39 and all(rows[i][1] == rows[j][1] and i % 2 == j % 2 for i in range(120) for j in range(120) if got[i] == got[j])
    assert 0 < len(asked) <= 4


def test_dear_rows_are_dealt_out(spark):
    from inkstone.session import spread

    dealt = spread(spark.range(1000).coalesce(1), "id")
    assert len([n for n in dealt.rdd.glom().map(len).collect() if n]) >= 12
