"""Queries on readers and writers: documents, tables, pages, archives and reports, with their SQL.

Files are made from the tables under spark.checkpoint.dir, read again, and compared with what went in.
"""

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_folder
from ..sources import files, records, reports
from ..sources.views import PAGES, Relations, oracle
from .registry import query


def _folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/inkstone-files-{uuid.uuid4().hex}"


@query("""SELECT event_id, event_id % 6 IN (0, 5) AS sound FROM events""")
def strict_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which texts are strict JSON: repeated keys, NaN, a lone surrogate and trailing text are not."""
    k = F.col("event_id")
    texts = ('{"k": 1, "k": 2}', '{"k": NaN}', '{"k": "\\ud800"}', '{"k": 1} x')
    text = F.when(k % 6 == 0, F.col("props")).when(k % 6 == 5, F.lit('{"k": "\\ud83d\\ude00"}'))
    for i, odd in enumerate(texts, 1):
        text = text.when(k % 6 == i, F.lit(odd))
    return Relations(spark, sf_dir).table("events").select("event_id", files.strict_json(text).isNotNull().alias("sound"))


@query("""WITH c AS (SELECT p_partkey AS k, [['id', 'name, "full"', 'size'], [p_partkey::VARCHAR, p_name || chr(10) || '"' || p_brand || '"', p_size::VARCHAR], ['', ',', 'x']] AS rows FROM part)
SELECT k, CAST(r AS INT) AS row, CAST(n AS INT) AS col, rows[r][n] AS value FROM c, range(1, 4) a(r), range(1, 4) b(n)""")
def csv_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells of a CSV text for each part, with quotes, commas and line ends in them."""
    c = F.col
    text = F.concat(
        F.lit('﻿id,"name, ""full""",size\r\n'), c("p_partkey").cast("string"), F.lit(',"'), "p_name", F.lit("\n"), F.lit('""'), "p_brand", F.lit('"""'), F.lit(","), c("p_size").cast("string"), F.lit('\r\n,",",x\n\n')
    )
    rows = Relations(spark, sf_dir).table("part").select(c("p_partkey").alias("k"), F.posexplode(files.cells_of(text)).alias("row", "cells"))
    return rows.select("k", (c("row") + 1).alias("row"), F.posexplode("cells").alias("col", "value")).withColumn("col", c("col") + 1)


@query("""SELECT 's' || (doc_id % 50) AS sample_id, 'i' || doc_id AS issue_key, CASE quality WHEN 1 THEN 'confirmed' ELSE 'false_positive' END AS verdict, 'say "' || doc_id || '", then' || chr(10) || 'go' AS notes FROM labels""")
def rating_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ratings written as CSV and read again, all text."""
    c = F.col
    rows = Relations(spark, sf_dir).table("labels").select(
        F.concat(F.lit("s"), c("doc_id") % 50).alias("sample_id"), F.concat(F.lit("i"), "doc_id").alias("issue_key"), F.when(c("quality") == 1, "confirmed").otherwise("false_positive").alias("verdict"),
        F.concat(F.lit('say "'), "doc_id", F.lit('", then\ngo')).alias("notes"),
    )
    path = _folder(spark)
    rows.write.csv(path, header=True, escape='"')
    return files.ratings(spark, path, escape='"').drop("row")


@query("SELECT o_orderstatus AS status, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1")
def sealed_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders written once, sealed, and read again against their seal."""
    path = _folder(spark)
    files.seal(Relations(spark, sf_dir).table("orders"), path)
    return files.unseal(spark, path).groupBy(F.col("o_orderstatus").alias("status")).agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("SELECT event_id % 100 AS job, count(*) AS n_lines, max(length(props)) AS longest FROM events GROUP BY 1")
def log_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of JSON logs, a file a job, blank lines left out."""
    path = _folder(spark)
    rows = Relations(spark, sf_dir).table("events").select((F.col("event_id") % 100).alias("job"), F.explode(F.array(F.col("props"), F.lit("  "))).alias("value"))
    rows.repartition("job").write.partitionBy("job").text(path)
    found = files.log_lines(spark, path).select(F.regexp_extract(F.col("path"), r"job=([0-9]+)", 1).cast("long").alias("job"), "line")
    return found.groupBy("job").agg(F.count("*").alias("n_lines"), F.max(F.length("line")).alias("longest"))


@query(r"""SELECT p_size AS table_id, 'key,"a ""b"", c"' || chr(10) || string_agg(p_partkey || ',' || CASE WHEN p_partkey % 3 = 0 THEN '"x,y"' ELSE 'p|q' END, chr(10) ORDER BY p_partkey) || chr(10) AS csv,
'| key | a "b", c |' || chr(10) || '| --- | --- |' || chr(10) || string_agg('| ' || p_partkey || ' | ' || CASE WHEN p_partkey % 3 = 0 THEN 'x,y' ELSE 'p\|q' END || ' |', chr(10) ORDER BY p_partkey) AS markdown,
'[' || string_agg('{"key":"' || p_partkey || '","a \"b\", c":"' || CASE WHEN p_partkey % 3 = 0 THEN 'x,y' ELSE 'p|q' END || '"}', ',' ORDER BY p_partkey) || ']' AS json FROM part GROUP BY 1""")
def table_sinks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables as CSV, Markdown and JSON."""
    k = F.col("p_partkey")
    row = F.struct(k.alias("k"), F.array(k.cast("string"), F.when(k % 3 == 0, "x,y").otherwise("p|q")).alias("cells"))
    rows = Relations(spark, sf_dir).table("part").groupBy(F.col("p_size").alias("table_id")).agg(F.transform(F.array_sort(F.collect_list(row)), lambda r: r["cells"]).alias("rows"))
    return files.table_sinks(rows.withColumn("header", F.array(F.lit("key"), F.lit('a "b", c')))).select("table_id", "csv", "markdown", "json")


@query(oracle("""WITH t AS (SELECT page, y0, box, CASE WHEN box % 5 < 2 THEN label END AS label FROM boxes WHERE kind = 'table'), c AS (SELECT page, y0, box, label FROM boxes WHERE kind = 'caption'),
e AS (SELECT page, y0, box, label, CASE WHEN label IS NULL THEN 'unlabeled_candidate' ELSE 'caption_matched_table' END AS role, 0 AS k FROM t UNION ALL SELECT page, y0, box, label, 'caption_anchored_table', 1 FROM c WHERE (page, label) NOT IN (SELECT (page, label) FROM t WHERE label IS NOT NULL))
SELECT page, format('table_{:03d}', row_number() OVER (PARTITION BY page ORDER BY k, y0, box, label)) AS id, role, label FROM e""", "boxes"))
def table_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids and roles of a page's tables: found ones first, then those that a caption alone anchors."""
    boxes = Relations(spark, sf_dir).view("boxes").select("page", "y0", "box", "label", "kind")
    found = boxes.where("kind = 'table'").withColumn("label", F.when(F.col("box") % 5 < 2, F.col("label"))).drop("kind")
    return files.table_roles(found, boxes.where("kind = 'caption'").drop("kind"))


ARCHIVES = "SELECT DISTINCT o_custkey AS archive, o_custkey % 9 = 0 AS target_exists FROM orders"
MEMBERS = """SELECT o_custkey AS archive, CASE WHEN o_orderkey % 37 = 0 THEN concat('../f', CAST(o_orderkey AS VARCHAR(20))) WHEN o_orderkey % 41 = 0 THEN 'Same.txt' ELSE concat('f', CAST(o_orderkey AS VARCHAR(20))) END AS path, CAST(10 AS BIGINT) AS bytes,
 CAST(o_orderkey % 91 AS VARCHAR(9)) AS sha256, o_orderkey % 53 <> 0 AS is_file FROM orders WHERE o_orderkey % 10 <> 3 UNION ALL SELECT o_custkey, 'same.TXT', 5, 'x', TRUE FROM orders WHERE o_orderkey % 41 = 0"""
SEALED = "SELECT o_custkey AS archive, concat('f', CAST(o_orderkey AS VARCHAR(20))) AS path, CAST(o_orderkey % 91 + CASE WHEN o_orderkey % 17 = 0 THEN 1 ELSE 0 END AS VARCHAR(9)) AS sha256 FROM orders WHERE o_orderkey % 37 <> 0 AND o_orderkey % 41 <> 0"


@query(f"""WITH a AS ({ARCHIVES}), m AS ({MEMBERS}), s AS ({SEALED}), l AS (SELECT archive, lower(path) AS p, count(*) AS n, bool_or(path LIKE '../%') AS o FROM m GROUP BY 1, 2),
e AS (SELECT archive, NULL AS path, 'target exists' AS error FROM a WHERE target_exists UNION ALL SELECT archive, NULL, 'case' FROM l WHERE n > 1 UNION ALL SELECT archive, NULL, 'outside' FROM l WHERE o UNION ALL SELECT archive, path, 'unsupported entry' FROM m WHERE NOT is_file
 UNION ALL SELECT s.archive, s.path, CASE WHEN m.sha256 IS NULL THEN 'sealed file lacking' ELSE 'sealed file differs' END FROM s LEFT JOIN m ON s.archive = m.archive AND s.path = m.path WHERE m.sha256 IS NULL OR m.sha256 <> s.sha256) SELECT DISTINCT * FROM e""")
def restore_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why archives may not be restored."""
    data = Relations(spark, sf_dir)
    return files.restore_errors(data.sql(ARCHIVES), data.sql(MEMBERS), data.sql(SEALED))


#: Pages as a reader gives them: words of names, images.
WORDS = "SELECT CAST(p_size AS INT) AS page, p_partkey AS k, p_name AS label FROM part"


@query("""WITH w AS (SELECT p_size AS page, p_partkey AS k, unnest(string_split(p_name, ' ')) AS t, unnest(range(len(string_split(p_name, ' ')))) AS i FROM part)
SELECT CAST(page AS INT) AS page, string_agg(line, chr(10) ORDER BY k DESC) AS sorted_text FROM (SELECT page, k, string_agg(t, ' ' ORDER BY i DESC) AS line FROM w GROUP BY 1, 2) GROUP BY 1""")
def sorted_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words read line by line: lines from top to bottom, here by falling keys, words from left to right, here last first."""
    c = F.col
    rows = Relations(spark, sf_dir).sql(WORDS).select("page", "k", F.posexplode(F.split("label", " ")).alias("i", "t"))
    word = F.struct((-c("i")).cast("double").alias("x0"), (-c("k")).cast("double").alias("y0"), (1.0 - c("i")).alias("x1"), (1.0 - c("k")).alias("y1"), c("t").alias("label"), F.lit(0).alias("block"), c("k").cast("int").alias("line"), c("i").alias("word"))
    pages = rows.groupBy("page").agg(F.collect_list(word).alias("words")).withColumn("raw_text", F.lit("raw"))
    return files.sorted_text(pages).select("page", "sorted_text")


@query("""SELECT 'p' || p_size AS path, format('page_{:03d}_image_{:02d}', p_size, k) AS image_id, CAST(p_size AS INT) AS page, p_partkey AS xref, CAST(p_size + 1 AS INT) AS width, 5 AS height, CASE WHEN p_partkey % 3 = 0 THEN 0 ELSE 1 END AS n_boxes
FROM (SELECT *, row_number() OVER (PARTITION BY p_size ORDER BY p_partkey) AS k FROM part)""")
def image_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images of pages, numbered, with their boxes; none where they could not be told."""
    c = F.col
    box = F.when(c("p_partkey") % 3 == 0, F.lit(None)).otherwise(F.array(F.array(F.lit(0.0), F.lit(0.0), F.lit(1.0), F.lit(1.0))))
    image = F.struct(c("p_partkey").alias("xref"), (c("p_size") + 1).alias("width"), F.lit(5).alias("height"), box.alias("boxes"))
    pages = Relations(spark, sf_dir).table("part").groupBy(c("p_size").alias("page")).agg(F.array_sort(F.collect_list(F.struct("p_partkey", image.alias("i")))).alias("l"))
    pages = pages.select(F.concat(F.lit("p"), "page").alias("path"), "page", F.transform("l", lambda x: x["i"]).alias("images"))
    return files.image_inventory(pages).withColumn("n_boxes", F.size("boxes")).drop("boxes")


@query(oracle(r"""WITH cut AS (SELECT paper_id, page, unnest(range(1, len(parts) + 1)) AS line, unnest(parts) AS x FROM (SELECT paper_id, page, string_split(text, chr(10)) AS parts FROM marked_pages)),
g AS (SELECT *, regexp_replace(lower(trim(regexp_replace(x, '\s+', ' ', 'g'))), '[0-9]+', '#', 'g') AS sig FROM cut), o AS (SELECT paper_id, sig FROM g WHERE regexp_matches(sig, '[a-z]') GROUP BY 1, 2 HAVING count(DISTINCT page) >= 3)
SELECT g.paper_id, page, CAST(count(o.sig) AS INT) AS n_removed, sha256(regexp_replace(regexp_replace(regexp_replace(replace(replace(coalesce(string_agg(x, chr(10) ORDER BY line) FILTER (o.sig IS NULL), ''), chr(173), ''), chr(160), ' '), '[ \t]+', ' ', 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g') || chr(10)) AS sha
FROM g LEFT JOIN o ON g.paper_id = o.paper_id AND g.sig = o.sig GROUP BY 1, 2""", "marked_pages"))
def corpus_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Normal texts of papers' pages in two passes: the lines that recur on three pages are found, then taken out."""
    pages = Relations(spark, sf_dir).view("marked_pages").select(F.col("paper_id").alias("paper"), "page", F.col("text").alias("raw_text"))
    return files.corpus(pages).select(F.col("paper").alias("paper_id"), "page", "n_removed", F.sha2("text", 256).alias("sha"))


#: Pages of papers with the parts that a reader of PDF files gives: a head that recurs, a number at the foot, body blocks in one
#: or two columns, and images. The text is the head, the body's lines and the number.
_SHEET = """SELECT paper_id AS paper, page, doc_id, CASE WHEN doc_id % 4 = 1 THEN 800.0 ELSE 600.0 END AS width, CASE WHEN doc_id % 4 = 1 THEN 600.0 ELSE 800.0 END AS height, CASE WHEN doc_id % 3 = 0 THEN '' ELSE concat('Journal of Sums ', CAST(page AS VARCHAR(9))) END AS head,
 CASE WHEN doc_id % 9 = 5 THEN '' WHEN doc_id % 17 = 3 THEN '7' ELSE CAST(page + 10 AS VARCHAR(9)) END AS foot, replace(text, chr(10), ' ') AS body FROM ({pages}) p WHERE text IS NOT NULL""".format(pages=PAGES)


@query(rf"""WITH s AS ({_SHEET}), h AS (SELECT paper FROM s WHERE head <> '' GROUP BY 1 HAVING count(DISTINCT page) >= 3),
l AS (SELECT *, TRY_CAST(foot AS INT) AS v, lag(TRY_CAST(foot AS INT)) OVER o AS before, lag(page) OVER o AS behind FROM s WINDOW o AS (PARTITION BY paper ORDER BY page)),
r AS (SELECT *, sum(CASE WHEN v = before + 1 AND page = behind + 1 THEN 0 ELSE 1 END) OVER (PARTITION BY paper ORDER BY page) AS run FROM l),
k AS (SELECT *, count(v) OVER (PARTITION BY paper, run) >= 3 AND v IS NOT NULL AS accepted FROM r),
x AS (SELECT k.*, head <> '' AND h.paper IS NOT NULL AS gone, length(trim(concat_ws(chr(10), nullif(head, ''), nullif(body, ''), nullif(foot, '')))) AS n, length(body) >= 180 AND doc_id % 2 = 0 AS two FROM k LEFT JOIN h ON k.paper = h.paper)
SELECT paper, page, CASE WHEN two THEN 'native_content_order_two_column' ELSE 'coordinate_sorted' END AS strategy, CASE WHEN accepted THEN foot END AS page_label, CASE WHEN accepted THEN 'geometric' WHEN v IS NOT NULL THEN 'geometric_candidate_rejected' END AS label_source,
 CAST(CASE WHEN gone THEN 1 ELSE 0 END AS INT) AS layout_artifacts, CASE WHEN doc_id % 5 = 0 AND n < 1500 THEN 'large_embedded_images_with_limited_native_text' END AS ocr_reason, two AS two_column, width > height AS landscape,
 sha256(trim(regexp_replace(regexp_replace(replace(replace(concat(CASE WHEN gone THEN '' ELSE head || chr(10) END, body, chr(10), foot), chr(173), ''), chr(160), ' '), '[ 	]+', ' ', 'g'), '\s+$', ''), ' ' || chr(10)) || chr(10)) AS sha FROM x""")
def page_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of papers' pages: heads that recur taken out, labels by their runs, columns, images, the order of the text."""
    c = F.col
    sheets = Relations(spark, sf_dir).sql(_SHEET)
    word = lambda x0, y0, x1, y1, label, line: F.struct(x0.alias("x0"), y0.alias("y0"), x1.alias("x1"), y1.alias("y1"), label.alias("label"), line.alias("block"), line.alias("line"), F.lit(0).alias("word"))
    block = lambda x0, y0, x1, y1, label: F.struct(x0.alias("x0"), y0.alias("y0"), x1.alias("x1"), y1.alias("y1"), label.alias("label"), F.lit(0).alias("block"), F.lit(True).alias("is_text"))
    f, w, h = F.lit, c("width"), c("height")
    three = [("head", w * 0.3, f(5.0), w * 0.5, f(20.0), 0), ("body", w * 0.2, f(300.0), w * 0.8, f(320.0), 1), ("foot", w * 0.45, h - 20, w * 0.55, h - 8, 2)]
    words = F.filter(F.array(*(word(a, b, d, e, c(n), f(k)) for n, a, b, d, e, k in three)), lambda x: x["label"] != "")
    wide = F.array(block(w * 0.2, f(200.0), w * 0.8, f(500.0), c("body")))
    sides = F.array(*(block(w * a, f(y), w * b, f(y + 90.0), c("body")) for a, b, y in ((0.1, 0.45, 100.0), (0.1, 0.45, 300.0), (0.55, 0.9, 100.0), (0.55, 0.9, 300.0))))
    body = F.when((c("doc_id") % 2 == 0) & (F.length("body") >= 180), sides).otherwise(wide)
    head = F.when(c("head") != "", F.array(block(w * 0.3, f(5.0), w * 0.5, f(20.0), c("head")))).otherwise(F.slice(wide, 1, 0))
    image = F.struct(f(1).cast("long").alias("xref"), f(9).alias("width"), f(9).alias("height"), F.array(F.array(w * 0.1, h * 0.1, w * 0.6, h * 0.6)).alias("boxes"))
    text = F.concat_ws("\n", *(F.when(c(n) != "", c(n)) for n in ("head", "body", "foot")))
    pages = sheets.select("paper", "page", "width", "height", text.alias("raw_text"), words.alias("words"), F.concat(head, body).alias("blocks"), F.when(c("doc_id") % 5 == 0, F.array(image)).alias("images"))
    out = records.page_records(pages)
    return out.select("paper", "page", "strategy", "page_label", "label_source", "layout_artifacts", "ocr_reason", "two_column", "landscape", F.sha2("normalized_text", 256).alias("sha"))


@query(r"""SELECT p_partkey, '<html><body><h1>' || p_name || '</h1>' || chr(10) || '<p>Size <b>' || p_size || '</b> &amp; <i>' || p_type || '</i> of <code>a|b</code> &lt;' || p_brand || '&gt;</p>' || chr(10) || '<p class="item">- first item</p>' || chr(10)
 || '<p class="cell row-start"><b>Key:</b> ' || p_partkey || '</p>' || chr(10) || '<p class="cell"><b>Link:</b> <a href="https://a.org/' || p_partkey || '">here</a> (https://a.org/' || p_partkey || ')</p>' || chr(10) || '<hr></body></html>' AS html,
regexp_replace(p_name || 'Size' || p_size || '&' || p_type || 'ofa|b<' || p_brand || '>-firstitemKey:' || p_partkey || 'Link:here(https://a.org/' || p_partkey || ')', '\s', '', 'g') AS visible_text, CASE WHEN p_partkey % 4 = 0 THEN 'text differs' WHEN p_partkey % 4 = 1 THEN 'too many pages' END AS error FROM part""")
def html_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reports as HTML, and what a layout that shows their text would be told."""
    k = F.col("p_partkey").cast("string")
    text = F.concat(
        F.lit("# "), "p_name", F.lit("\n\nSize **"), F.col("p_size").cast("string"), F.lit("** & *"), "p_type", F.lit("* of `a|b`\n<"), "p_brand", F.lit(">\n- first item\n\n| Key | Link |\n| --- | :---: |\n| "), k,
        F.lit(" | [here](https://a.org/"), k, F.lit(") |\n\n---\n"),
    )
    rows = reports.rendered(Relations(spark, sf_dir).table("part").select("p_partkey", text.alias("report")))
    shown = F.concat(F.when(F.col("p_partkey") % 4 == 0, "x").otherwise(" \n"), "visible_text")
    pages = F.when(F.col("p_partkey") % 4 == 1, 251).otherwise(3)
    return rows.select("p_partkey", "html", "visible_text", F.coalesce("error", reports.same_text(shown, F.col("visible_text"), pages)).alias("error"))
