"""Queries on whole papers, with their SQL."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import documents as D
from ..operators import ranking as R
from ..sources.views import Relations, oracle
from .extract_queries import _SHOWN, LINES, POSITIONED, _is_caption
from .registry import query


@query(oracle("""SELECT paper_id, sha256(string_agg('# Page ' || page || ' (label: ' || (page + 2) || ')' || chr(10) || chr(10) || trim(text), chr(10) || chr(10) ORDER BY page)) AS sha
FROM page_records WHERE text IS NOT NULL GROUP BY 1""", "page_records"))
def full_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = Relations(spark, sf_dir).view("page_records").where("text is not null").withColumn("label", (F.col("page") + 2).cast("string"))
    return D.full_text(pages, ["paper_id"]).select("paper_id", F.sha2("full_text", 256).alias("sha"))


@query(oracle("SELECT page, box, format('table_{:03d}', row_number() OVER (PARTITION BY page ORDER BY y0, box)) AS id FROM boxes WHERE kind = 'table'", "boxes"))
def table_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    boxes = Relations(spark, sf_dir).view("boxes").where("kind = 'table'")
    return D.numbered(boxes, ["page"], ["y0", "box"], "table").select("page", "box", "id")


@query(oracle("""SELECT * FROM (SELECT page, box // 10 AS line, trim(regexp_replace(string_agg(label, '' ORDER BY box, label), '\\s+', ' ', 'g')) AS content, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1,
max(y1 - y0) AS size, bool_or(box % 3 = 0) AS bold, FALSE AS footer FROM boxes GROUP BY page, box // 10)""", "boxes"))
def positioned_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    boxes = Relations(spark, sf_dir).view("boxes")
    spans = boxes.select("page", F.expr("box div 10").alias("line"), F.col("box").alias("span"), "label", "x0", "y0", "x1", "y1", (F.col("y1") - F.col("y0")).alias("size"), (F.col("box") % 3 == 0).alias("bold"))
    return D.positioned_lines(spans, ["page"], 800.0)


@query(oracle("""WITH n AS (SELECT c.page, c.box AS caption, c.y1 AS edge, r.y0, r.y1, r.box FROM boxes c JOIN boxes r ON c.page = r.page AND r.y0 >= c.y1 - 1 WHERE c.kind = 'caption' AND r.kind = 'table'),
b AS (SELECT *, max(y1) OVER (PARTITION BY page, caption ORDER BY y0, box, y1, edge ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM n),
e AS (SELECT *, max(CASE WHEN y0 - coalesce(b, edge) > CASE WHEN b IS NULL THEN 60 ELSE 30 END THEN 1 ELSE 0 END) OVER (PARTITION BY page, caption ORDER BY y0, box, y1, edge ROWS UNBOUNDED PRECEDING) AS e FROM b)
SELECT page, caption, count(*) AS n_rows, max(y1) AS y1 FROM e WHERE e = 0 GROUP BY 1, 2""", "boxes"))
def rows_below_captions(spark: SparkSession, sf_dir: str) -> DataFrame:
    boxes = Relations(spark, sf_dir).view("boxes")
    return D.rows_below(boxes.where("kind = 'table'"), boxes.where("kind = 'caption'"))


@query("""WITH w AS (SELECT conv_id, turn, unnest(string_split(text, ' ')) AS label, unnest(range(len(string_split(text, ' ')))) AS word FROM conversations WHERE text IS NOT NULL),
n AS (SELECT *, lag(label) OVER k AS before, lead(label) OVER k AS after FROM w WINDOW k AS (PARTITION BY conv_id, turn ORDER BY word))
SELECT conv_id, turn, CAST(word AS INT) AS word, before, after FROM n WHERE label = 'the'""")
def word_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = Relations(spark, sf_dir).table("conversations").select("conv_id", F.col("turn").alias("block"), F.lit(0).alias("line"), F.posexplode(F.split("text", " ", -1)).alias("word", "label"))
    out = D.word_neighbours(rows, ["conv_id"], F.lit("the"))
    return out.select("conv_id", F.col("block").alias("turn"), "word", "before", "after")


@query(oracle("SELECT page, count(*) AS n_items, count(*) FILTER (kind = 'caption') AS n_caption, count(*) FILTER (kind = 'table') AS n_table, count(*) FILTER (kind = 'figure') AS n_figure FROM boxes GROUP BY 1", "boxes"))
def manifest_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.manifest_counts(Relations(spark, sf_dir).view("boxes"), ["page"])


@query(oracle("""SELECT paper_id, string_agg(rater || ':' || items, ';' ORDER BY rater) AS ledger FROM (SELECT paper_id, rater, string_agg(DISTINCT page::VARCHAR, ',' ORDER BY page::VARCHAR) AS items
FROM findings WHERE page IS NOT NULL GROUP BY 1, 2) GROUP BY 1""", "findings"))
def coverage_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = Relations(spark, sf_dir).view("findings").where("page is not null").withColumn("item_id", F.col("page").cast("string"))
    line = F.transform("raters", lambda r: F.concat(r["rater"], F.lit(":"), F.array_join(r["items"], ",")))
    return D.ledger(found).select("paper_id", F.array_join(line, ";").alias("ledger"))


@query("""SELECT o_orderkey AS check_id, o_custkey AS source_id, CASE WHEN o_custkey % 4 = 0 THEN 'undeclared source' WHEN o_orderkey % 3 = 1 THEN 'not in quote' ELSE 'percent scale' END AS error
FROM orders WHERE o_custkey % 4 = 0 OR o_orderkey % 3 = 1 OR o_custkey % 4 = 1""")
def quantity_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quantities that copy their customer's number, some off by a tenth; a quarter of the quotes are per cents."""
    data = Relations(spark, sf_dir)
    k = F.col("c_custkey")
    quote = F.concat(F.lit("it rose by "), k.cast("string"), F.when(k % 4 == 1, "%").otherwise(""), F.lit(" in 2SLS, not -7.5"))
    sources = data.table("customer").where(k % 4 != 0).select(k.alias("source_id"), quote.alias("quote"))
    off = F.when(F.col("o_orderkey") % 3 == 1, F.lit(".1")).otherwise(F.lit(""))
    rows = data.table("orders").select(F.col("o_orderkey").alias("check_id"), F.col("o_custkey").alias("source_id"), F.concat(F.col("o_custkey").cast("string"), off).alias("value"), F.lit("number").alias("scale"))
    return D.quantity_errors(rows, sources)


RUNS = """SELECT p_partkey AS run, CAST(p_size % 5 AS INT) AS raw_captions, CAST(p_size % 9 AS INT) AS captions, CAST(p_size % 3 AS INT) AS parsed_tables, CAST(p_size % 4 AS INT) AS tables, CAST(p_size % 8 AS INT) AS source_findings,
CAST(p_size % 7 AS INT) AS canonical, CAST(p_size % 2 AS INT) AS cross_agent, CAST(p_size % 6 AS INT) AS failures, CAST(p_size % 2 AS INT) AS external, p_size % 3 = 0 AS has_appendix, CAST(p_size % 18 AS INT) AS selected,
CAST(p_size % 7 AS INT) AS pilots, CAST(p_size % 3 AS INT) AS idle, CAST(p_size % 4 AS INT) AS missing, CAST(p_size % 2 AS INT) AS reviews FROM part"""


@query(f"""WITH r AS ({RUNS}), s AS (SELECT run,
 greatest(0, least(100, 100 - 35.0::DOUBLE * coalesce(raw_captions / nullif(captions, 0), 0) - 25 * (1 - coalesce(parsed_tables / nullif(tables, 0), 1)))) AS caption_score,
 100.0::DOUBLE - CASE WHEN source_findings > 0 AND canonical / source_findings > 0.95 THEN 20 ELSE 0 END - CASE WHEN source_findings > 0 AND coalesce(cross_agent / nullif(canonical, 0), 0) < 0.05 THEN 10 ELSE 0 END AS merge_score,
 greatest(0, 100.0::DOUBLE - 15 * failures - CASE WHEN external > 0 AND NOT has_appendix THEN 15 ELSE 0 END) AS report_score,
 greatest(0, 100.0::DOUBLE - 4 * greatest(0, selected - 13) - 2 * greatest(0, pilots - 4) - 8 * idle) AS selector_score,
 greatest(0, 100.0::DOUBLE - 18 * missing - CASE WHEN reviews = 0 THEN 20 ELSE 0 END) AS resume_score FROM r)
SELECT run, caption_score, merge_score, report_score, selector_score, resume_score, (caption_score + merge_score + report_score + selector_score + resume_score) / 5 AS overall FROM s""")
def run_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = ("caption_score", "merge_score", "report_score", "selector_score", "resume_score", "overall")
    out = D.run_metrics(Relations(spark, sf_dir).sql(RUNS)).select("run", *scores)
    return out


#: Lines of captions and what follows them, on a page of a part each.
CAPTIONED = """SELECT p_partkey AS page, CAST(n_nationkey AS INT) AS line, CASE n_nationkey WHEN 0 THEN 'words before' WHEN 1 THEN concat('Table ', CAST(p_size AS VARCHAR(9)), ': Effects', CASE WHEN p_partkey % 4 = 0 THEN ' of the' WHEN p_partkey % 4 = 1 THEN ' (in' ELSE '' END)
 WHEN 2 THEN CASE WHEN p_partkey % 3 = 0 THEN 'programme' WHEN p_partkey % 3 = 1 THEN 'Dollars)' ELSE '12 wages' END ELSE 'Notes: none' END AS content, n_nationkey * 12.0 + CASE WHEN n_nationkey = 2 AND p_partkey % 7 = 0 THEN 30 ELSE 0 END AS y0,
 n_nationkey * 12.0 + 10 + CASE WHEN n_nationkey = 2 AND p_partkey % 7 = 0 THEN 30 ELSE 0 END AS y1, CAST(n_nationkey AS INT) AS block FROM part JOIN nation ON n_nationkey < 4"""


@query("""SELECT p_partkey AS page, 1 AS start, t || CASE WHEN p_partkey % 7 <> 0 AND (p_partkey % 4 < 2 OR p_partkey % 3 = 0) THEN ' ' || n ELSE '' END AS title FROM (SELECT p_partkey, 'Table ' || p_size || ': Effects' || CASE WHEN p_partkey % 4 = 0 THEN ' of the' WHEN p_partkey % 4 = 1 THEN ' (in' ELSE '' END AS t,
 ['programme', 'Dollars)', '12 wages'][p_partkey % 3 + 1] AS n FROM part)""")
def continued_captions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Captions with the line that goes on with them: a dangling or open title takes any, others a lower-case one."""
    rows = Relations(spark, sf_dir).sql(CAPTIONED)
    double = [F.col(c).cast("double").alias(c) for c in ("y0", "y1")]
    return D.continued_captions(rows.select("page", "line", "content", *double, "block"), ["page"])


@query(_SHOWN.replace("WITH ", "WITH RECURSIVE ", 1) + r""", r AS (SELECT t.*, sum(CASE WHEN caption THEN 1 ELSE 0 END) OVER (PARTITION BY paper_id, page ORDER BY line) AS run FROM t WHERE content <> ''),
g AS (SELECT s.paper_id, s.page, s.kind, s.label, s.title, s.joined AS apart, r.run FROM shown s JOIN r USING (paper_id, page, line)),
n AS (SELECT r.paper_id, r.page, r.run, r.line, r.content AS s, r.x0, r.y0, r.x1, r.y1, r.size, r.block, g.kind, g.label, g.title, g.apart, row_number() OVER (PARTITION BY r.paper_id, r.page, r.run ORDER BY r.line) AS i FROM r JOIN g ON g.paper_id = r.paper_id AND g.page = r.page AND g.run = r.run),
w AS (SELECT paper_id, page, run, i, title, x0, y0, y1, size, block, 1 AS n, TRUE AS open FROM n WHERE i = 1 UNION ALL
 SELECT paper_id, page, run, i, CASE WHEN goes AND NOT (apart AND k = 1) THEN t || ' ' || s ELSE t END, CASE WHEN goes THEN x0 ELSE wx END, CASE WHEN goes THEN y0 ELSE wy END, CASE WHEN goes THEN y1 ELSE wz END, CASE WHEN goes THEN size ELSE ws END, CASE WHEN goes THEN block ELSE wb END, k + CASE WHEN goes THEN 1 ELSE 0 END, goes FROM (
 SELECT *, o AND CASE WHEN apart THEN k = 1 OR (alike AND y0 - wz BETWEEN -1 AND 12) ELSE t <> '' AND y0 - wy BETWEEN -0.5 AND 18 AND NOT regexp_matches(s, '^(Notes:|Panel)') AND NOT (regexp_matches(s, '^[0-9]') AND NOT alike)
  AND (regexp_matches(s, '^[a-z]') OR (alike AND length(t) >= 24 AND length(s) <= 120 AND NOT regexp_matches(t, '[.?!:;]$'))) END AS goes FROM (
  SELECT n.paper_id, n.page, n.run, n.i, n.s, n.x0, n.y0, n.y1, n.size, n.block, n.apart, w.title AS t, w.x0 AS wx, w.y0 AS wy, w.y1 AS wz, w.size AS ws, w.block AS wb, w.n AS k, w.open AS o,
   n.block = w.block AND abs(n.size - w.size) <= 0.5 AND abs(n.x0 - w.x0) <= 4 AS alike FROM w JOIN n ON n.paper_id = w.paper_id AND n.page = w.page AND n.run = w.run AND n.i = w.i + 1))),
e AS (SELECT paper_id, page, run, arg_max(title, i) AS title, max(n) AS taken FROM w GROUP BY 1, 2, 3),
q AS (SELECT paper_id, page, n.run, kind, label, CASE kind WHEN 'table' THEN 'Table ' ELSE 'Figure ' END || label || CASE WHEN e.title <> '' THEN ': ' || e.title ELSE '' END AS caption, CAST(taken AS INT) AS n_caption, CAST(count(*) AS INT) AS n_lines,
 min(line) AS line, min(x0) FILTER (i <= taken) AS cx0, min(y0) FILTER (i <= taken) AS cy0, max(x1) FILTER (i <= taken) AS cx1, max(y1) FILTER (i <= taken) AS cy1,
 greatest(0, min(x0) - 24) AS x0, greatest(0, arg_min(y0, i) - 10) AS y0, least(120, max(x1) + 24) AS x1, least(700, max(y1) + 10) AS y1 FROM n JOIN e USING (paper_id, page, run) GROUP BY paper_id, page, n.run, kind, label, e.title, taken)
SELECT * EXCLUDE (run) FROM q""")
def positioned_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Captioned items of positioned lines with the boxes of caption and crop, on pages of 120 x 700."""
    return D.positioned_items(Relations(spark, sf_dir).sql(POSITIONED), ["paper_id", "page"], 120, 700)


@query(oracle(f"""WITH {LINES}, r AS (SELECT *, sum(CASE WHEN {_is_caption("c")} THEN 1 ELSE 0 END) OVER (PARTITION BY paper_id, page ORDER BY line) AS run FROM lines WHERE s <> ''),
h AS (SELECT paper_id, page, kind, label, title, line FROM captioned QUALIFY row_number() OVER (PARTITION BY paper_id, page, kind, label ORDER BY line) = 1),
k AS (SELECT h.*, r.run FROM h JOIN r USING (paper_id, page, line)), n AS (SELECT r.*, k.title, k.kind, k.label, row_number() OVER (PARTITION BY r.paper_id, r.page, r.run ORDER BY r.line) AS i FROM r JOIN k ON k.paper_id = r.paper_id AND k.page = r.page AND k.run = r.run),
w AS (SELECT paper_id, page, run, i, title, title <> '' AS open, 1 AS n FROM n WHERE i = 1 UNION ALL
 SELECT n.paper_id, n.page, n.run, n.i, CASE WHEN g THEN w.title || ' ' || s ELSE w.title END, w.open AND g, w.n + CASE WHEN w.open AND g THEN 1 ELSE 0 END FROM w JOIN n ON n.paper_id = w.paper_id AND n.page = w.page AND n.run = w.run AND n.i = w.i + 1,
 LATERAL (SELECT w.open AND length(s) <= 180 AND NOT regexp_matches(s, '^(?i)(notes? ?:|panel\\b|\\([a-z0-9]+\\)|n\\b|controls\\b)') AND (NOT regexp_matches(s, '^[-−]?[0-9]') OR d) AND
  (length(w.title) - length(replace(w.title, '(', '')) > length(w.title) - length(replace(w.title, ')', '')) OR d OR (NOT regexp_matches(w.title, '[.?!)]$') AND regexp_matches(s, '^\\p{{Ll}}'))) AS g
  FROM (SELECT right(w.title, 1) = ':' OR regexp_matches(w.title, '(?i)\\b(a|across|an|and|between|by|for|from|in|of|on|or|the|to|versus|vs\\.?|when|with|without)$') AS d))),
e AS (SELECT paper_id, page, run, arg_max(title, i) AS title, max(n) AS n FROM w GROUP BY 1, 2, 3),
b AS (SELECT n.*, e.title AS whole, e.n AS taken, regexp_matches(s, '^([0-9]{{1,4}}|[ivxlcdmIVXLCDM]{{1,12}})$') AND coalesce(TRY_CAST(s AS INT) BETWEEN 1 AND 300, TRUE) AS labelled FROM n JOIN e USING (paper_id, page, run)),
l AS (SELECT paper_id, page, run, max(i) AS last FROM b WHERE i > taken AND NOT labelled GROUP BY 1, 2, 3)
SELECT b.paper_id, b.page, any_value(b.kind) AS kind, any_value(b.label) AS label, CASE any_value(b.kind) WHEN 'table' THEN 'Table ' ELSE 'Figure ' END || any_value(b.label) || CASE WHEN any_value(whole) <> '' THEN ': ' || any_value(whole) ELSE '' END AS caption,
 CAST(count(*) FILTER (i > taken AND i <= last) AS INT) AS n_body FROM b LEFT JOIN l USING (paper_id, page, run) GROUP BY b.paper_id, b.page, b.run""", "marked_pages"))
def captioned_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Captions of pages with the lines that belong to them."""
    items = D.captioned_items(Relations(spark, sf_dir).view("marked_pages"))
    return items.withColumn("n_body", F.size("body")).drop("body")


@query(oracle("""SELECT paper_id, 'Prompt' || chr(10) || chr(10) || '# Editor Input Metadata' || chr(10) || chr(10) || '- paper_id: `' || paper_id || '`' || chr(10) || '- normalized_bundle: `b.json`' || chr(10) || '- outputs: `out`' || chr(10) || chr(10) || chr(10) || '# Brief' || chr(10) || chr(10)
 || '# Normalized Editor Bundle' || chr(10) || chr(10) || CASE WHEN n % 2 = 0 THEN 'read it in parts' ELSE '```json' || chr(10) || '{"n": ' || n || '}' || chr(10) || '```' || chr(10) END || chr(10) || chr(10) || '# Validated Output Provenance' || chr(10) || chr(10)
 || '| Rater | Validated JSON path | Status | Findings |' || chr(10) || '| --- | --- | --- | --- |' || chr(10) || rows || chr(10) AS document FROM (SELECT paper_id, sum(n)::INT AS n, string_agg('| ' || rater || ' | ' || rater || '.json | ' || CASE WHEN n % 3 = 0 THEN 'unknown' ELSE 'ok' END || ' | ' || n || ' |', chr(10) ORDER BY rater) AS rows
FROM (SELECT paper_id, rater, count(*) AS n FROM findings GROUP BY 1, 2) GROUP BY 1)""", "findings"))
def input_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What an editor of each paper is given, with the bundle or the plan to read it, and the raters' outputs."""
    c = F.col
    outputs = Relations(spark, sf_dir).view("findings").groupBy("paper_id", "rater").agg(F.count("*").alias("findings"))
    outputs = outputs.select("paper_id", c("rater").alias("place"), "rater", F.concat("rater", F.lit(".json")).alias("path"), F.when(c("findings") % 3 != 0, "ok").alias("run_status"), "findings")
    n = outputs.groupBy("paper_id").agg(F.sum("findings").alias("n"))
    parts = n.join(R.provenance(outputs), "paper_id").select(
        "paper_id", F.lit("Prompt").alias("prompt"), F.lit("b.json").alias("bundle_path"), F.lit("out").alias("outputs_path"), F.lit("# Brief").alias("brief"), F.format_string('{"n": %d}', "n").alias("bundle"),
        F.when(c("n") % 2 == 0, "read it in parts").alias("plan"), "provenance",
    )
    return R.input_documents(parts)
