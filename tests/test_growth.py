"""Plans whose work grows with the rows alone."""

import random

from pyspark.sql import functions as F

from inkstone.operators import checks as C
from inkstone.operators import layout as L
from inkstone.operators import schema as J
from inkstone.plans import registry
from inkstone.session import cut
from inkstone.sources import files, records

DATA = "/root/testdata/sf0.001"


def plan(frame) -> str:
    return frame._jdf.queryExecution().optimizedPlan().toString()


def test_checks_are_built_once(spark):
    assert plan(registry.queries()["interval_verdicts"](spark, DATA)).count("format_string") == 1


def test_lines_are_squashed_once(spark):
    assert plan(registry.queries()["line_kinds"](spark, DATA)).count("regexp_replace") <= 4


def test_pages_are_merged_in_batches(spark):
    """No data frame a page, and the same regions as page by page."""
    rows = [(p, float(x % 300), float(x * 7 % 400), float(x % 300 + 5 + x % 30), float(x * 7 % 400 + 5 + x % 25)) for p in range(40) for x in range(p, p * 37 + 1, 36 + p)]
    boxes = spark.createDataFrame(rows, "page int, x0 double, y0 double, x1 double, y1 double")
    got = L.merged_regions(boxes)
    assert "FlatMapGroupsInPandas" not in plan(got)
    want = []
    for p in range(40):
        some = sorted((r[1:] for r in rows if r[0] == p and r[3] - r[1] >= 12 and r[4] - r[2] >= 12), key=lambda b: (b[1], b[0], b[3], b[2]))
        want += [(p, k, *r) for k, r in enumerate(L.merge_rectangles(some), 1)]
    assert want and sorted(map(tuple, got.collect())) == sorted(want)


def test_whole_texts_come_in_small_batches(spark):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    for query in ("citation_mentions", "order_similarity"):
        spark.conf.unset(name)
        registry.queries()[query](spark, DATA)
        assert int(spark.conf.get(name)) <= 1000


def test_crossrefs_search_texts_once(spark):
    got = plan(registry.queries()["crossref_mentions"](spark, DATA))
    assert got.count("ArrowEvalPython") == 2 and got.count("Join") == 0


def test_split_words_search_texts_once(spark):
    assert plan(registry.queries()["split_crossrefs"](spark, DATA)).count("ArrowEvalPython") == 2


def test_texts_of_sources_are_cleaned_once(spark):
    assert plan(registry.queries()["source_errors"](spark, DATA)).count("(?<=[A-Za-z])") == 2


def test_records_search_no_pairs(spark, monkeypatch):
    """Findings of orders are few in a class, so their records' clusters need no search for pairs and no rounds."""
    from inkstone.operators import resolve

    monkeypatch.setattr(resolve, "linked", None)
    assert registry.queries()["canonical_records"](spark, DATA).count() > 100


def test_forms_are_made_once(spark):
    assert plan(registry.queries()["page_text_forms"](spark, DATA)).count("regexp_replace") == 4


def test_captions_of_lines_meet_once(spark):
    """What follows a caption is looked up on its page; no table of lines is joined with itself."""
    for query in ("positioned_captions", "positioned_items"):
        assert plan(registry.queries()[query](spark, DATA)).count("Join") == 0


def test_lines_of_sections_are_squashed_once(spark):
    """Once for lines, and for numbers and titles and what follows a heading before they are tested."""
    assert plan(registry.queries()["numbered_sections"](spark, DATA)).count("regexp_replace") <= 6


def test_rows_and_captions_of_a_page_meet_once(spark):
    """Rows aren't copied for each caption and side, and their kinds are told from text that is squashed once."""
    got = plan(registry.queries()["table_regions"](spark, DATA))
    assert got.count("Join") == 0 and got.count("regexp_replace") <= 2


def test_items_of_a_page_stay_in_its_row(spark):
    got = plan(registry.queries()["captioned_items"](spark, DATA))
    assert got.count("Join") == 0 and got.count("Window") == 0 and got.count("Aggregate") == 0


def test_pairs_meet_texts_and_not_stems(spark):
    """Joins find pairs, and two bring their texts' stems as one row each."""
    assert plan(registry.queries()["candidate_pairs"](spark, DATA)).count("Join") <= 5


def test_rings_take_no_more_rounds(spark, monkeypatch):
    """Merge chains are followed as often as the longest needs, however many rows end in rings."""
    rounds = []
    monkeypatch.setattr(C, "cut", lambda df: rounds.append(1) or cut(df))
    rows = [(i, "merged", i ^ 1) for i in range(2000)] + [(5000, "merged", 5001), (5001, "merged", 5002), (5002, "included", None)]
    got = C.terminals(spark.createDataFrame(rows, "id long, disposition string, destination long")).groupBy("error", "terminal").count().collect()
    assert sorted(map(tuple, got), key=str) == [("cycle", None, 2000), (None, 5002, 2)] and len(rounds) <= 5


def test_words_and_blocks_stay_in_their_page(spark):
    """Edge blocks meet, labels and what recurs meet their pages; no word or body block is a row."""
    got = plan(registry.queries()["page_records"](spark, DATA))
    assert got.count("Join") == 3 and "posexplode" not in got


def test_a_page_that_is_told_twice_keeps_its_text(spark):
    words = [(10.0, 100.0, 40.0, 110.0, "first", 0, 1, 0), (50.0, 100.0, 80.0, 110.0, "half", 0, 1, 1)]
    schema = f"paper string, page int, width double, height double, raw_text string, words array<{files.WORD}>, blocks array<{files.BLOCK}>, images array<{files.IMAGE}>"
    pages = spark.createDataFrame([("p", 1, 600.0, 800.0, "half first", words, [], [])] * 2, schema)
    assert [r["normalized_text"] for r in records.page_records(pages).collect()] == ["first half\n"] * 2


def test_arrays_of_a_page_like_its_rows(spark):
    """Labels and columns of pages whose words and blocks are arrays are those of words and blocks as rows."""
    rng = random.Random(5)
    label = lambda: rng.choice(["7", "iv", "301", "word", None, " 12 ", "x" * 200])
    box = lambda: (float(rng.randrange(0, 500, 50)), float(rng.randrange(0, 800, 20)), float(rng.randrange(100, 600, 50)), float(rng.randrange(20, 800, 20)), label(), rng.random() < 0.9)
    part = "struct<x0:double,y0:double,x1:double,y1:double,label:string,is_text:boolean>"
    pages = spark.createDataFrame([(p, [box() for _ in range(rng.randrange(12))]) for p in range(300)], f"page int, a array<{part}>")
    rows = pages.select("page", F.posexplode("a").alias("box", "b")).select("page", "box", "b.*")
    width, height = F.lit(600.0), F.lit(800.0)
    want = {r["page"]: r["label"] for r in L.label_by_place(rows, ["page"], 600.0, 800.0).collect()}
    got = {r["page"]: r["m"]["label"] for r in pages.select("page", L.label_in_words(F.col("a"), width, height).alias("m")).collect() if r["m"]}
    assert got == want and len(want) > 30
    two, major = L.column_flags(L.block_sides(F.col("a"), width))
    want = {r["page"]: (r["two_columns"], r["column_major"]) for r in L.two_columns(rows.where("is_text"), ["page"], 600.0).collect()}
    got = {r["page"]: (r["two"], r["major"]) for r in pages.select("page", two.alias("two"), major.alias("major")).collect()}
    assert {p: got[p] for p in want} == want and {got[p] for p in got.keys() - want.keys()} <= {(False, False)} and len(set(want.values())) == 3


def test_rosters_are_held_in_their_row(spark):
    """A document is put together once and read once: by the schema, then as raters. Nothing of it meets other rosters'."""
    got = plan(registry.queries()["roster_documents"](spark, DATA))
    assert got.count("Aggregate") == 1 and got.count("Join") == 0 and got.count("from_json") + got.count("jsontostructs") == 1 and got.count("parseJson") == 2


def test_members_tell_objects_and_arrays(spark):
    """Their types are told without writing them as text; a value of another kind, a null or a missing one is as before."""
    schema = {"type": "object", "required": ["a"], "properties": {"a": {"type": "array", "items": {"type": "string", "minLength": 1}}}}
    documents = ['{"a": ["x", "", 3]}', '{"a": {}}', '{"a": null}', '{"a": "[]"}', "{}", "[]", "null", '"{}"', '{"a": []}', '{"a": [1]} ', "1], [2"]
    frame = spark.createDataFrame(list(enumerate(documents)), "i int, d string")
    errors = J.schema_errors(F.col("d"), schema)
    got = {r["i"]: [tuple(e) for e in r["e"]] for r in frame.select("i", errors.alias("e")).collect()}
    no_array, no_object = [("a", "type", None)], [("", "type", None)]
    assert got == {
        0: [("a.1", "minLength", None), ("a.2", "type", None)], 1: no_array, 2: no_array, 3: no_array, 4: [("", "required", "a")], 5: no_object, 6: no_object, 7: no_object, 8: [],
        9: [("a.0", "type", None)], 10: [("", "json", None)],
    }
