"""Queries on text columns and layout, with their SQL."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import documents as D
from ..operators import layout as L
from ..sources.views import Relations, oracle
from .registry import query

W = r"[\x09-\x0d\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
SQUASH = rf"trim(regexp_replace(%s, '{W}+', ' ', 'g'))"


@query(oracle(f"""WITH
cut AS (SELECT paper_id, page, unnest(range(1, len(parts) + 1)) AS line, unnest(parts) AS content
        FROM (SELECT source AS paper_id, doc_id AS page, string_split(text, chr(10)) AS parts FROM documents WHERE text IS NOT NULL AND source IS NOT NULL)),
signed AS (SELECT *, regexp_replace(lower({SQUASH % 'content'}), '[0-9]+', '#', 'g') AS sig FROM cut),
often AS (SELECT paper_id, sig FROM signed WHERE regexp_matches(sig, '[a-z]') GROUP BY 1, 2 HAVING count(DISTINCT page) >= 3)
SELECT paper_id, page, line::INT AS line, sig FROM signed JOIN often USING (paper_id, sig)"""))
def recurring_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of a source that stand in three of its documents or more, digits apart."""
    pages = Relations(spark, sf_dir).table("documents").where("source is not null")
    rows = L.lines(pages.select(F.col("source").alias("paper_id"), F.col("doc_id").alias("page"), "text"), ["paper_id", "page"])
    signed = rows.where(F.lower("content").rlike("[a-z]")).withColumn("sig", T.signature(F.col("content")))
    return L.recurring(signed, ["paper_id", "sig"], "page", 3).select("paper_id", "page", "line", "sig")


@query(r"""SELECT page_id, CASE WHEN s = '' THEN 'paper' ELSE s END AS slug FROM (
SELECT page_id, regexp_replace(regexp_replace(lower(trim(url)), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS s FROM pages)""")
def slug_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Relations(spark, sf_dir).table("pages").select("page_id", T.slug(F.col("url")).alias("slug"))


@query(rf"""WITH p AS (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(replace(replace(text, chr(173), ''), chr(160), ' '),
  '\r\n|\r', chr(10), 'g'), '[ \t]+', ' ', 'g'), '\n{{3,}}', chr(10) || chr(10), 'g') AS t FROM documents WHERE text IS NOT NULL)
SELECT doc_id, sha256(regexp_replace(t, '^{W}+|{W}+$', '', 'g') || chr(10)) AS page_sha, sha256({SQUASH % 't'}) AS inline_sha,
 sha256(trim(regexp_replace(lower(t), '[^a-z0-9.%]+', ' ', 'g'))) AS comparable,
 CASE WHEN length({SQUASH % 't'}) > 60 THEN rtrim(left({SQUASH % 't'}, 57)) || '...' ELSE {SQUASH % 't'} END AS short FROM p""")
def page_text_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Normal, inline, comparable and shortened forms of each text."""
    docs = Relations(spark, sf_dir).table("documents").where("text is not null")
    page, inline = F.col("page"), F.col("inline")
    forms = docs.select("doc_id", T.page_text(F.col("text")).alias("page")).select("doc_id", "page", T.squash(page).alias("inline"))  # each form once a text
    return forms.select(
        "doc_id",
        F.sha2(page, 256).alias("page_sha"),
        F.sha2(inline, 256).alias("inline_sha"),
        F.sha2(T.comparable(page), 256).alias("comparable"),
        T.shorten(inline, 60).alias("short"),
    )


#: Texts of which every fifth has three control characters and every third a form feed, which is allowed.
CONTROLLED = "SELECT doc_id, concat(text, CASE WHEN doc_id % 5 = 0 THEN concat(chr(7), 'x', chr(1), chr(7)) ELSE '' END, CASE WHEN doc_id % 3 = 0 THEN chr(12) ELSE '' END) AS text FROM documents WHERE text IS NOT NULL"


@query(rf"""SELECT doc_id, (SELECT string_agg('U+' || lpad(upper(to_hex(ord(c))), 4, '0'), ',' ORDER BY ord(c))
  FROM (SELECT DISTINCT unnest(regexp_extract_all(text, '[\x00-\x08\x0b\x0e-\x1f]')) AS c)) AS codes FROM ({CONTROLLED})
WHERE regexp_matches(text, '[\x00-\x08\x0b\x0e-\x1f]')""")
def control_characters(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = Relations(spark, sf_dir).sql(CONTROLLED).select("doc_id", F.array_join(T.control_codes(F.col("text")), ",").alias("codes"))
    return docs.where("codes <> ''")


@query(rf"""WITH w AS (SELECT conv_id, turn, regexp_extract_all(lower(text), '[a-z0-9]+(?:\.[0-9]+)?') AS ws FROM conversations),
t AS (SELECT conv_id, turn, list_transform(list_filter(ws, lambda x: length(x) >= 2 AND x NOT IN ({', '.join(repr(x) for x in T.STOP_WORDS)})),
 lambda x: CASE WHEN length(x) > 6 AND x LIKE '%ies' THEN left(x, length(x) - 3) || 'y' WHEN length(x) > 6 AND x LIKE '%ing' THEN left(x, length(x) - 3)
 WHEN length(x) > 5 AND x LIKE '%ed' THEN left(x, length(x) - 2)
 WHEN length(x) > 4 AND x LIKE '%s' AND NOT regexp_matches(x, '(ss|is|us)$') THEN left(x, length(x) - 1) ELSE x END) AS ts FROM w)
SELECT conv_id, turn, coalesce(array_to_string(ts, ' '), '') AS tokens, len(ts)::INT AS n_tokens FROM t WHERE ts IS NOT NULL""")
def stemmed_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = Relations(spark, sf_dir).table("conversations").where("text is not null")
    return rows.select("conv_id", "turn", T.tokens(F.col("text")).alias("t")).select(
        "conv_id", "turn", F.array_join("t", " ").alias("tokens"), F.size("t").alias("n_tokens")
    )


@query(r"""WITH m AS (SELECT l_orderkey, l_linenumber, format('{:.2f}', l_extendedprice) AS v, CASE l_linenumber % 3 WHEN 0 THEN '%' WHEN 1 THEN 'pp' ELSE '' END AS u FROM lineitem)
SELECT l_orderkey, l_linenumber, regexp_replace(regexp_replace(v, '0+$', ''), '\.$', '') || u AS magnitude FROM m""")
def magnitudes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prices with two decimals, thousands commas and a unit, in the plain form that findings are compared by."""
    unit = F.element_at(F.array(F.lit("percent"), F.lit("percentage points"), F.lit("")), F.col("l_linenumber") % 3 + 1)
    rows = Relations(spark, sf_dir).table("lineitem")
    return rows.select("l_orderkey", "l_linenumber", T.magnitude(F.format_number("l_extendedprice", 2), unit).alias("magnitude"))


@query(oracle(r"""WITH l AS (SELECT paper_id, page, CAST(CASE WHEN doc_id % 13 = 0 THEN 999 ELSE page + 2 END AS VARCHAR) AS label FROM page_records),
v AS (SELECT *, CASE WHEN label::INT BETWEEN 1 AND 300 THEN label::INT END AS value FROM l),
f AS (SELECT *, CASE WHEN lag(page) OVER w = page - 1 AND lag(value) OVER w = value - 1 THEN 0 ELSE 1 END AS b FROM v WINDOW w AS (PARTITION BY paper_id ORDER BY page)),
r AS (SELECT *, sum(b) OVER (PARTITION BY paper_id ORDER BY page) AS run FROM f)
SELECT paper_id, page, CASE WHEN value IS NOT NULL THEN label END AS label,
 value IS NOT NULL AND count(CASE WHEN value IS NOT NULL THEN 1 END) OVER (PARTITION BY paper_id, run) >= 3 AS accepted FROM r""", "page_records"))
def label_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page labels that rise by one over three pages or more; every thirteenth document's is out of range."""
    pages = Relations(spark, sf_dir).view("page_records")
    label = F.when(F.col("doc_id") % 13 == 0, F.lit("999")).otherwise((F.col("page") + 2).cast("string"))
    marked = pages.select("paper_id", "page", T.plausible_label(label).alias("label"))
    return L.label_runs(marked, "paper_id", "page", "label")


INTERSECT = "a.x0 < b.x1 AND b.x0 < a.x1 AND a.y0 < b.y1 AND b.y0 < a.y1"


def _boxes(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    return Relations(spark, sf_dir).view("boxes").where(F.col("kind") == kind)


@query(oracle(f"""SELECT page, box, caption, distance FROM (
SELECT a.page, a.box, b.box AS caption, abs(a.y0 - b.y0) AS distance, row_number() OVER (PARTITION BY a.page, a.box ORDER BY abs(a.y0 - b.y0), b.box) AS k
FROM boxes a JOIN boxes b ON a.page = b.page AND {INTERSECT} WHERE a.kind = 'table' AND b.kind = 'caption') WHERE k = 1""", "boxes"))
def nearest_captions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.nearest_caption(_boxes(spark, sf_dir, "table"), _boxes(spark, sf_dir, "caption"))


@query(oracle("""SELECT page, box FROM boxes a WHERE kind = 'table' AND NOT EXISTS (SELECT 1 FROM boxes b WHERE b.kind = 'figure' AND a.page = b.page
 AND greatest(0, least(a.x1, b.x1) - greatest(a.x0, b.x0)) * greatest(0, least(a.y1, b.y1) - greatest(a.y0, b.y0)) >= 0.5 * (a.x1 - a.x0) * (a.y1 - a.y0))""", "boxes"))
def excluded_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.excluded(_boxes(spark, sf_dir, "table"), _boxes(spark, sf_dir, "figure")).select("page", "box")


@query(oracle(f"""SELECT a.page, a.box, count(b.box) AS n_images, CASE WHEN count(b.box) > 0 THEN 'embedded_image' ELSE 'page_crop' END AS status
FROM boxes a LEFT JOIN boxes b ON a.page = b.page AND b.kind = 'caption' AND {INTERSECT} WHERE a.kind = 'figure' GROUP BY 1, 2""", "boxes"))
def images_in_crops(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.images_in_crops(_boxes(spark, sf_dir, "figure"), _boxes(spark, sf_dir, "caption"))


REASON = """CASE WHEN (x1 <= 600 * 0.14 OR x0 >= 600 * 0.86) AND x1 - x0 <= 600 * 0.06 AND y1 - y0 >= 800 * 0.30 THEN 'repeated_vertical_margin'
WHEN y1 <= 800 * 0.07 AND y1 - y0 <= 800 * 0.035 THEN 'repeated_header' WHEN y0 >= 800 * 0.94 AND y1 - y0 <= 800 * 0.035 THEN 'repeated_footer' END"""


@query(oracle(f"""WITH c AS (SELECT page, box, {REASON} AS reason, regexp_replace(lower(label), '[0-9]+', '#', 'g') AS signature FROM boxes),
k AS (SELECT reason, signature FROM c WHERE reason IS NOT NULL GROUP BY 1, 2
      HAVING count(DISTINCT page) >= CASE WHEN reason = 'repeated_vertical_margin' THEN 2 ELSE 3 END)
SELECT page, box, reason, signature FROM c JOIN k USING (reason, signature)""", "boxes"))
def layout_artifacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks at a page's edges whose text, digits apart, recurs on three pages (two in a margin)."""
    boxes = Relations(spark, sf_dir).view("boxes")
    edges = [F.col(c) for c in ("x0", "y0", "x1", "y1")]
    marked = boxes.withColumn("reason", L.layout_reason(*edges, F.lit(600.0), F.lit(800.0))).withColumn("signature", T.signature(F.col("label")))
    some = marked.where(F.col("reason").isNotNull() & F.col("signature").rlike(r"\p{L}"))
    least = F.when(F.col("reason") == "repeated_vertical_margin", 2).otherwise(3)
    return L.recurring(some, ["reason", "signature"], "page", least).select("page", "box", "reason", "signature")


@query(oracle("""SELECT page, label FROM (SELECT page, CAST(box % 400 AS VARCHAR) AS label, row_number() OVER (PARTITION BY page ORDER BY
 CASE WHEN y0 >= 800 * 0.88 THEN 800 - y1 ELSE y0 + 800 * 0.05 END + abs((x0 + x1) / 2 - 600 / 2) / 600.0, box) AS k FROM boxes
 WHERE box % 400 BETWEEN 1 AND 300 AND (y0 >= 800 * 0.88 OR y1 <= 800 * 0.08)) WHERE k = 1""", "boxes"))
def labels_by_place(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = Relations(spark, sf_dir).view("boxes").withColumn("label", (F.col("box") % 400).cast("string"))
    return L.label_by_place(words, ["page"], 600.0, 800.0)


@query(oracle("""WITH s AS (SELECT page, box, length(label) AS n, x1 <= 600 * 0.55 AS l, x0 >= 600 * 0.45 AND NOT x1 <= 600 * 0.55 AS r FROM boxes),
c AS (SELECT page, count(*) FILTER (l) >= 2 AND coalesce(sum(n) FILTER (l), 0) >= 180 AND count(*) FILTER (r) >= 2 AND coalesce(sum(n) FILTER (r), 0) >= 180 AS two_columns,
 max(box) FILTER (l) < min(box) FILTER (r) AS b FROM s GROUP BY page)
SELECT page, two_columns, coalesce(b AND two_columns, FALSE) AS column_major FROM c""", "boxes"))
def column_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.two_columns(Relations(spark, sf_dir).view("boxes"), ["page"], 600.0)


@query(oracle("SELECT page, round(least(1.0, sum((x1 - x0) * (y1 - y0)) / 480000.0), 3) AS coverage FROM boxes WHERE kind = 'figure' GROUP BY page", "boxes"))
def image_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.coverage(_boxes(spark, sf_dir, "figure"), ["page"], 480000.0)


@query(oracle("""WITH RECURSIVE w AS (SELECT *, row_number() OVER (PARTITION BY page ORDER BY y0, x0, x1, y1, label) AS k FROM boxes),
g AS (SELECT page, k, y0 AS mean, 1 AS n, 1 AS row FROM w WHERE k = 1 UNION ALL SELECT w.page, w.k, CASE WHEN abs(w.y0 - g.mean) <= 3 THEN (g.mean * g.n + w.y0) / (g.n + 1) ELSE w.y0 END, CASE WHEN abs(w.y0 - g.mean) <= 3 THEN g.n + 1 ELSE 1 END,
 CASE WHEN abs(w.y0 - g.mean) <= 3 THEN g.row ELSE g.row + 1 END FROM g JOIN w ON w.page = g.page AND w.k = g.k + 1)
SELECT page, CAST(row AS INT) AS line_no, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1, string_agg(label, ' ' ORDER BY x0, label) AS content FROM w JOIN g USING (page, k) GROUP BY page, row""", "boxes"))
def line_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that words form by a running mean height."""
    return L.line_groups(Relations(spark, sf_dir).view("boxes"), ["page"])


#: Boxes that all hold their cell's middle, on pages of six cells far apart.
NEAR = """SELECT CAST(floor(l_orderkey / 16) AS INT) AS page, l_partkey % 3 * 180.0 + 10 + l_suppkey % 10 * 4 AS x0, floor(l_partkey % 6 / 3) * 300.0 + 10 + l_linenumber % 5 * 4 AS y0,
 l_partkey % 3 * 180.0 + 70 + l_quantity / 2 AS x1, floor(l_partkey % 6 / 3) * 300.0 + 60 + l_quantity AS y1, l_partkey % 6 AS cell FROM lineitem"""


@query(f"""SELECT page, CAST(row_number() OVER (PARTITION BY page ORDER BY x0, y0, x1, y1) AS INT) AS region, x0, y0, x1, y1 FROM (SELECT page, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1 FROM ({NEAR}) GROUP BY page, cell)""")
def merged_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes merged by nearness until none are near: here one of each cell of a page."""
    double = [F.col(c).cast("double").alias(c) for c in ("x0", "y0", "x1", "y1")]
    return L.merged_regions(Relations(spark, sf_dir).sql(NEAR).select("page", *double))


@query(oracle("""SELECT page, caption, region FROM (SELECT c.page, c.box AS caption, r.box AS region, row_number() OVER (PARTITION BY c.page, c.box ORDER BY greatest(c.y0 - r.y1, 0), -(r.x1 - r.x0) * (r.y1 - r.y0), r.box) AS k
FROM boxes c JOIN boxes r ON c.page = r.page AND r.kind = 'figure' AND c.y0 - r.y1 BETWEEN -6 AND 48 AND (least(r.x1, c.x1) > greatest(r.x0, c.x0) OR c.x1 - c.x0 >= 330) WHERE c.kind = 'caption') WHERE k = 1""", "boxes"))
def figure_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The figure that a caption stands under."""
    return D.figure_regions(_boxes(spark, sf_dir, "figure"), _boxes(spark, sf_dir, "caption"), 600.0)
