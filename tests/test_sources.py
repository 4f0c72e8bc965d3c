"""Readers, writers, streams and contract checks on small files and rows."""

import datetime as dt
import random
import re

import pytest
from pyspark.sql import functions as F

from inkstone.functions import predicates as P
from inkstone.operators import benchmark as B
from inkstone.operators import checks as C
from inkstone.operators import documents as D
from inkstone.operators import glyphs as G
from inkstone.sources import files, records, reports
from inkstone.streaming import runs, tasks


def test_strict_json(spark, tmp_path):
    texts = {"a": '{"x": [1, {"y": null}]}', "b": '{"x": 1, "x": 2}', "c": '{"x": NaN}', "d": '{"x": "\\ud800"}', "e": '{"x": "\\ud83d\\ude00"}', "f": "{"}
    for name, text in texts.items():
        (tmp_path / f"{name}.json").write_text(text)
    got = {r["path"][-6]: r["error"] for r in files.json_documents(spark, str(tmp_path)).collect()}
    assert {k for k, v in got.items() if v is None} == {"a", "e"}


def test_ratings_logs_and_cells(spark, tmp_path):
    (tmp_path / "r.csv").write_bytes("﻿sample_id,issue_key,verdict\ns1,001,confirmed\ns1,\"a, b\",x\n".encode())
    rows = files.ratings(spark, str(tmp_path / "r.csv")).orderBy("row").collect()
    assert [(r["sample_id"], r["issue_key"]) for r in rows] == [("s1", "001"), ("s1", "a, b")]
    turn = '{"type":"turn.completed","usage":{"input_tokens":10,"cached_input_tokens":4,"output_tokens":3}}'
    (tmp_path / "logs").mkdir()
    (tmp_path / "logs" / "j1.jsonl").write_text(f"{turn}\n\n")
    (tmp_path / "logs" / "j2.jsonl").write_text("{}\n")
    got = {r["job"]: (r["status"], r["input_uncached"]) for r in B.usage(files.log_lines(spark, str(tmp_path / "logs"))).collect()}
    assert got == {"j1": ("reported", 6), "j2": ("ambiguous-or-incomplete", None)}
    cells = {(r["row"], r["col"]): r["value"] for r in files.csv_cells(spark, str(tmp_path / "r.csv")).collect()}
    assert cells[(3, 2)] == "a, b" and cells[(2, 3)] == "confirmed" and len(cells) == 9


def test_pages_by_an_extractor(spark, tmp_path):
    (tmp_path / "x.bin").write_bytes(b"one\x0ctwo")
    pages = files.page_texts(spark, str(tmp_path / "x.bin"), lambda data: [(i, 600.0, 800.0, t) for i, t in enumerate(data.decode().split("\x0c"), 1)])
    assert [(r["page"], r["raw_text"]) for r in pages.orderBy("page").collect()] == [(1, "one"), (2, "two")]


def test_seal(spark, tmp_path):
    path = str(tmp_path / "sealed")
    files.seal(spark.range(5), path)
    assert files.unseal(spark, path).count() == 5
    with pytest.raises(Exception, match="(?i)exist"):
        files.write_new(spark.range(1), f"{path}/data")
    spark.range(9, 10).write.mode("append").parquet(f"{path}/data")
    with pytest.raises(ValueError, match="manifest"):
        files.unseal(spark, path)


def test_roster(spark):
    rows = spark.createDataFrame([("a", "o1", "p1", "X", None), ("b", "o1", "p2", "Y", False)], "name string, output string, prompt string, id_prefix string, enabled boolean")
    got = files.roster(rows)
    assert {(r["name"], r["enabled"], r["stage"], r["search"]) for r in got.collect()} == {("a", True, "review", False), ("b", False, "review", False)}
    assert [(r["column"], r["value"]) for r in files.roster_errors(got).collect()] == [("output", "o1")]


def test_stream_of_attempts(spark, tmp_path):
    at = dt.datetime(2026, 1, 1)
    rows = [("a", at, 1, "start"), ("a", at + dt.timedelta(minutes=1), 2, "fail"), ("b", at, 1, "accept"), ("c", at, 1, "fail"), ("c", at, 2, "fail"), ("c", at, 3, "fail")]
    schema = "task string, ts timestamp, attempt int, kind string"
    frame = spark.createDataFrame(rows, schema)
    frame.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
    query = tasks.task_counts(stream).writeStream.outputMode("complete").format("memory").queryName("attempt_counts").start()
    query.processAllAvailable()
    query.stop()
    got = {r["task"]: r["status"] for r in tasks.statuses(spark.table("attempt_counts")).collect()}
    assert got == {r["task"]: r["status"] for r in C.task_state(frame).collect()} == {"a": "retry", "b": "accepted", "c": "exhausted"}
    query = tasks.rates(stream).writeStream.outputMode("complete").format("memory").queryName("attempt_rates").start()
    query.processAllAvailable()
    query.stop()
    assert {(r["kind"], r["attempts"]) for r in spark.table("attempt_rates").collect()} == {("start", 1), ("fail", 4), ("accept", 1)}


def test_page_records(spark):
    """Recurring heads go, labels stand in runs, sorted words give the text; scans, images and control characters are counted."""
    word = lambda label, x, y, line: (x, y, x + 30.0, y + 10.0, label, line, line, 0)
    head = lambda n: (10.0, 5.0, 200.0, 20.0, f"Journal {n}", 0, True)
    pages = []
    for n in (1, 2, 3):
        words = [word("second", 300.0, 200.0, 2), word("first", 10.0, 100.0, 1), word("half", 50.0, 100.0, 1), word(f"Journal {n}", 10.0, 5.0, 0), word(str(n + 4), 290.0, 780.0, 9)]
        pages.append(("p", n, 600.0, 800.0, f"Journal {n}\nfirst ha\u00adlf\x01\nsecond\n{n + 4}", words, [head(n), (10.0, 100.0, 400.0, 300.0, "text", 1, True)], [(1, 9, 9, [[0.0, 0.0, 600.0, 400.0]])] if n == 2 else None))
    pages += [("p", 4, 600.0, 800.0, "", None, None, None), ("p", 5, 800.0, 600.0, None, [], [], []), ("p", 6, 600.0, 800.0, "only raw", None, [], []), ("q", 1, 600.0, 800.0, "Journal 1", [word("9", 290.0, 780.0, 0)], [head(1)], [])]
    schema = f"paper string, page int, width double, height double, raw_text string, words array<{files.WORD}>, blocks array<{files.BLOCK}>, images array<{files.IMAGE}>"
    got = {(r["paper"], r["page"]): r for r in records.page_records(spark.createDataFrame(pages, schema)).collect()}
    assert len(got) == 7
    one = got["p", 1]
    assert (one["normalized_text"], one["strategy"], one["page_label"], one["label_source"]) == ("first half\nsecond\n5\n", "coordinate_sorted", "5", "geometric")
    assert (one["layout_artifacts"], one["artifact_reasons"], one["control_characters"], one["soft_hyphens"]) == (1, ["repeated_header"], 1, 0)
    assert got["p", 2]["ocr_reason"] == "large_embedded_images_with_limited_native_text" and got["p", 2]["coverage"] == 0.5
    assert (got["p", 4]["ocr_reason"], got["p", 4]["scanned"], got["p", 5]["landscape"], got["p", 5]["ocr_recommended"]) == ("no_native_text", True, True, True)
    assert got["p", 6]["normalized_text"] == "only raw\n" and got["q", 1]["layout_artifacts"] == 0 and got["q", 1]["label_source"] == "geometric_candidate_rejected"
    assert D.quality_summary(spark.createDataFrame(list(got.values())), ["paper"]).count() == 2


def told(profile, *events):
    """Errors, pauses, jobs and states after each event (kind, task, value), a minute apart unless a time is given."""
    run, out = runs.Run(profile), []
    for k, (kind, task, value, *at) in enumerate(events):
        error, jobs = run.take(at[0] if at else k * 60_000, kind, task, value)
        out.append((error, run.paused, jobs, {n: (t.status, t.attempts) for n, t in run.tasks.items()}))
    return out


def test_run_gives_out_and_retries():
    add = [("add", x, None) for x in "abcde"]
    out = told(runs.Profile(), *add, ("ask", None, "2"), ("ask", None, "9"), ("ask", None, "9"), ("accept", "a", None), ("fail", "b", "invalid"), ("ask", None, "2"), ("accept", "a", None))
    assert [o[2] for o in out[5:8]] == [["a#1", "b#1"], ["c#1"], []]
    assert out[10][2] == ["b#2", "d#1"] and out[10][3]["c"] == ("inflight", 1) and out[11][0] == "task_not_inflight"


def test_run_out_of_allowance_keeps_accepted_work():
    add = [("add", x, None) for x in "abcd"]
    out = told(runs.Profile(), *add, ("ask", None, "3"), ("fail", "a", "quota"), ("accept", "b", None), ("ask", None, "3"), ("resume", None, None), ("ask", None, "3"))
    assert out[6][0] is None and out[6][1] == "quota" and out[6][3]["b"] == ("accepted", 1)
    assert out[7][2] == [] and out[8][1] is None and out[9][2] == ["a#2", "d#1"] and out[9][3]["c"] == ("inflight", 1)


def test_run_caps_attempts():
    round_ = [("ask", None, "1"), ("fail", "a", "invalid")]
    out = told(runs.Profile(), ("add", "a", None), *round_ * 3, ("resume", None, None), ("resume", "b", None), ("resume", "a", None), ("ask", None, "1"), ("resume", "a", None))
    assert out[6][1] == "retries_exhausted" and out[6][3]["a"] == ("exhausted", 3)
    assert [o[0] for o in out[7:]] == ["retries_exhausted", "retry_not_exhausted", None, None, "retry_not_exhausted"] and out[10][2] == ["a#4"]


def test_run_interrupts_what_takes_too_long():
    late = 46 * 60_000
    out = told(runs.Profile(), ("add", "a", None, 0), ("ask", None, "1", 0), ("accept", "a", None, late), ("resume", None, None, late), ("ask", None, "1", late))
    assert out[2][0] == "task_not_inflight" and out[2][1] == "interrupted" and out[4][2] == ["a#2"]


def test_stream_of_runs(spark, tmp_path):
    """Rows of a stream are those of the batch, though events come in another order, some late, and over several batches;
    an event beyond the watermark is dropped, one after the watermark waits."""
    rng, start = random.Random(4), dt.datetime(2026, 1, 1)
    events = []
    for run in ("r1", "r2", "r3"):
        for k in range(60):
            kind = rng.choice(["add", "ask", "ask", "accept", "accept", "fail", "resume"])
            task = None if kind == "ask" or kind == "resume" and rng.random() < 0.7 else rng.choice("abcd")
            value = str(rng.randint(1, 3)) if kind == "ask" else rng.choice(["invalid", "invalid", "transient", "quota"]) if kind == "fail" else None
            events.append((run, k, start + dt.timedelta(minutes=10 * k, seconds=rng.randint(0, 9)), kind, task, value))
    events += [(r, 1000, start + dt.timedelta(days=3), "ask", None, "1") for r in ("r1", "r2", "r3")]
    parts = [[] for _ in range(12)]
    for e in events:  # up to half an hour out of order
        parts[min(11, int((e[2] - start).total_seconds() // 3600) + (rng.random() < 0.3 and e[2].minute >= 30))].append(e)
    beyond = ("r1", 2000, start, "add", "zz", None)
    parts[11].append(beyond)
    names = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", names)
    try:
        (tmp_path / "in").mkdir()
        stream = spark.readStream.schema(runs.EVENT).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
        for part in parts:
            rng.shuffle(part)
            spark.createDataFrame(part, runs.EVENT).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
            if part is parts[0]:
                query = runs.run_stream(stream).writeStream.outputMode("append").option("checkpointLocation", f"{tmp_path}/c").format("memory").queryName("run_rows").start()
            query.processAllAvailable()
        query.processAllAvailable()
        query.stop()
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    got = sorted(tuple(r) for r in spark.table("run_rows").collect())
    want = sorted(tuple(r) for r in runs.run_log(spark.createDataFrame(events, runs.EVENT)).where("seq < 1000").collect())
    assert [r[:2] for r in got] == [r[:2] for r in want] and got == want
    assert any(r[2] for r in want) and any(r[3] for r in want)


def test_repairs(spark):
    frame = spark.createDataFrame([("ffi f", [("f", "F"), ("ffi", "ﬃ")])], "t string, r array<struct<find:string,put:string>>")
    assert frame.select(G.replace_all(F.col("t"), F.col("r")).alias("x")).first()["x"] == "ﬃ F"
    glyphs = spark.createDataFrame([("ABCDEF+CMEX10", 104), ("CMEX10", 5), ("Times", 0)], "font string, code int")
    assert [r["x"] for r in glyphs.select(G.extension_glyph(F.col("font"), F.col("code")).alias("x")).collect()] == ["[", None, None]


def test_contract(spark):
    columns = "paper_id string, rater string, id string, issue_type string, category string, severity string, confidence string, assessment string, finding_summary string, page int, page_label string, section string, text_quote string, precision string, cannot_verify_reason string, numeric_check string, page_count int"
    fine = ("p", "numerical_auditor", "N-001", "other", "c", "high", "low", "no", "s", 1, None, None, None, "exact", None, '{"kind": "arithmetic"}', 9)
    odd = ("p", "numerical_auditor", "N-01", None, "c", "dire", "", "cannot_verify", " ", 10, None, None, None, "missing", None, '{"a": null, "b": []}', 9)
    frame = spark.createDataFrame([fine, odd], columns)
    sources = spark.createDataFrame([("p", "numerical_auditor", "N-001", "s1", None, "pages/1.txt", 1)], "paper_id string, rater string, id string, source_id string, url string, path string, page int")
    links = spark.createDataFrame([("p", "numerical_auditor", "N-001", 0, "s1"), ("p", "numerical_auditor", "N-01", 0, "s9")], "paper_id string, rater string, id string, link int, source_id string")
    got = C.finding_errors(frame, spark.createDataFrame([("numerical_auditor", "N")], "rater string, id_prefix string"), sources, links).collect()
    assert {r["error"] for r in got if r["id"] == "N-001"} == set()
    assert {r["error"] for r in got} == {"id", "issue type", "severity", "confidence", "summary", "placed but missing", "page", "no reason", "empty numeric check", "link to unknown source"}
    gate = spark.createDataFrame([("parser_artifact", "high", "high"), ("parser_artifact", "medium", "low"), ("copyedit_issue", "high", "high")], "i string, s string, c string")
    assert [r["g"] for r in gate.select(P.parser_gate(F.col("i"), F.col("s"), F.col("c")).alias("g")).collect()] == ["blocker", "warning", None]


def test_reports_as_html(spark):
    report = "# A title\n\nHello **bold** and *thin* `a|b` [here](https://a.org/x_(1)) [bad](javascript:x) \\*star\\*\n- item\n\n| h1 | h2 |\n| --- | :---: |\n| 1 | `a|b` |\n| odd |\n\n```\ncode <x>\n```\n***\n" + "x" * 60
    page = reports.to_html(report)
    for part in ("<h1>A title</h1>", "<b>bold</b>", "<i>thin</i>", "<code>a|b</code>", '<a href="https://a.org/x_(1)">here</a> (https://a.org/x_(1))', "[bad](javascript:x)", "*star*", '<p class="item">- item</p>',
                 '<p class="cell row-start"><b>h1:</b> 1</p>', '<p class="cell"><b>h2:</b> <code>a|b</code></p>', "<p>| odd |</p>", '<p class="literal">code &lt;x&gt;</p>', "<hr>"):
        assert part in page
    assert reports.visible(page).endswith("x" * 60) and "javascript" not in re.findall('href="([^"]*)"', page)
    rows = reports.rendered(spark.createDataFrame([(1, report), (2, None), (3, "x" * 5_000_001)], "id int, report string")).collect()
    assert {r["id"]: (r["html"] is None, r["error"]) for r in rows} == {1: (False, None), 2: (True, None), 3: (True, "too large")}
    assert reports.cells("| a | b\\|c |") == ["a", "b\\|c"] and reports.cells("") == [""]


def test_pages_of_a_reader(spark, tmp_path):
    (tmp_path / "a.bin").write_bytes(b"x")
    word = lambda x, y, t, line, k: dict(x0=x, y0=y, x1=x + 5, y1=y + 9, label=t, block=0, line=line, word=k)
    pages = [{"page": 1, "width": 600.0, "height": 800.0, "raw_text": "b a\nc", "words": [word(0.0, 30.0, "c", 1, 0), word(9.0, 10.0, "a", 0, 1), word(0.0, 10.0, "b", 0, 0)], "blocks": None, "images": [dict(xref=7, width=2, height=3, boxes=None)]}, {"page": 2, "raw_text": "only raw"}]
    found = files.page_parts(spark, str(tmp_path), lambda data: pages)
    assert [r["sorted_text"] for r in files.sorted_text(found).orderBy("page").collect()] == ["b a\nc", "only raw"]
    assert [(r["image_id"], r["xref"], r["boxes"]) for r in files.image_inventory(found).collect()] == [("page_001_image_01", 7, [])]


def test_trailing_text_is_no_json(spark):
    texts = ['{"a": 1}', '{"a": 1} x', "1, 2", "1] , [2", "1}", '1, "b": 2', "[1]", "null", "", "NaN", '"s"']
    frame = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r["t"] for r in frame.where(files.strict_json(F.col("t")).isNotNull()).collect()] == ['{"a": 1}', "[1]", "null", '"s"']


def test_sorted_text_of_a_long_page(spark):
    """A page of 4,000 lines of three words: each line is found once, not by going through the page again."""
    import time

    from pyspark.sql import functions as F

    word = lambda i: F.struct((i % 3).cast("double").alias("x0"), (-F.floor(i / 3)).cast("double").alias("y0"), i.cast("string").alias("label"), F.lit(0).alias("block"), F.floor(i / 3).cast("int").alias("line"))
    page = spark.range(1).select(F.transform(F.sequence(F.lit(0), F.lit(11_999)), word).alias("words"), F.lit("raw").alias("raw_text"))
    began = time.perf_counter()
    got = files.sorted_text(page).collect()[0]["sorted_text"]
    assert got == "\n".join(f"{3 * k} {3 * k + 1} {3 * k + 2}" for k in reversed(range(4000)))
    assert time.perf_counter() - began < 30
