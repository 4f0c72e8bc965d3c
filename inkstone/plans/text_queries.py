"""Queries on text columns, predicates and page parts that other queries hold only in part, with their SQL."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import checks as C
from ..operators import documents as D
from ..operators import extract as X
from ..operators import glyphs as G
from ..operators import layout as L
from ..session import small_batches
from ..sources.views import Relations, oracle
from .extract_queries import LINE_OF, _context, _heading, _is_caption, _PARTS, _table_line
from .layout_queries import SQUASH
from .registry import query


@query(f"""SELECT doc_id, CAST(p - 1 AS INT) AS start, {LINE_OF % ("p - 1", "p - 1")} AS line, {_context("p - 1", "p + 2", 100)} AS context, {_context("p - 1", "p + 2", 5)} AS near FROM (SELECT doc_id, text, strpos(text, 'the') AS p FROM documents) WHERE p > 0""")
def offsets_in_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first `the` of each document: its line and what stands around it."""
    text, start = F.col("text"), F.instr("text", "the") - 1
    rows = Relations(spark, sf_dir).table("documents").where(F.instr("text", "the") > 0)
    return rows.select("doc_id", start.alias("start"), T.line_number(text, start).alias("line"), T.context(text, start, start + 3).alias("context"), T.context(text, start, start + 3, 5).alias("near"))


@query(r"""SELECT doc_id, sha256(regexp_replace(array_to_string(list_filter(list_transform(p, lambda x: trim(x)), lambda x: x <> ''), ' '), '([A-Za-zÀ-ÖØ-öø-ÿ])-\s+([A-Za-zÀ-ÖØ-öø-ÿ])', '\1-\2', 'g')) AS joined
FROM (SELECT doc_id, list_transform(string_split(text, chr(10)), lambda x: ' ' || x || '- ') AS p FROM documents WHERE text IS NOT NULL)""")
def joined_hyphens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that all end in a hyphen, joined: it is closed up between letters alone."""
    parts = F.transform(F.split("text", "\n", -1), lambda x: F.concat(F.lit(" "), x, F.lit("- ")))
    return Relations(spark, sf_dir).table("documents").where("text is not null").select("doc_id", F.sha2(T.join_hyphens(parts), 256).alias("joined"))


@query(rf"""SELECT doc_id, sha256({SQUASH % "regexp_replace(regexp_replace(t, '([A-Za-z])' || chr(173) || chr(13) || '?' || chr(10) || '([A-Za-z])', chr(92) || '1' || chr(92) || '2', 'g'), '([A-Za-z])' || chr(173) || chr(13) || '?' || chr(10) || '([A-Za-z])', chr(92) || '1' || chr(92) || '2', 'g')"}) AS canonical
FROM (SELECT doc_id, replace(text, 'e ', 'e' || chr(173) || chr(10)) AS t FROM documents WHERE text IS NOT NULL)""")
def evidence_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts with soft hyphens at line ends after each word in e: closed up between letters, spaces elsewhere."""
    text = F.replace("text", F.lit("e "), F.lit("e­\n"))
    return Relations(spark, sf_dir).table("documents").where("text is not null").select("doc_id", F.sha2(T.evidence_text(text), 256).alias("canonical"))


_KINDS = ("Tables", "Figs.", "Eq.", "Appendices", "Sections", "Box")
_LABELS = ("1", "A.2", "B", "3a", "12.4b", "x", "AB", "C.1")


@query(f"""SELECT p_partkey, kind, label, canonical, CASE canonical WHEN 'table' THEN label IN ('1', 'A.2', '3a', '12.4b', 'C.1') WHEN 'figure' THEN label IN ('1', 'A.2', '3a', '12.4b', 'C.1') WHEN 'section' THEN label IN ('1', 'A.2', 'B', '3a', '12.4b', 'C.1')
 WHEN 'appendix' THEN label IN ('A.2', 'B', 'C.1') WHEN 'equation' THEN label IN ('1', 'A.2', '3a', '12.4b', 'C.1') ELSE FALSE END AS valid FROM (SELECT p_partkey, {list(_KINDS)}[p_partkey % 6 + 1] AS kind, {list(_LABELS)}[p_size % 8 + 1] AS label,
 ['table', 'figure', 'equation', 'appendix', 'section', 'box'][p_partkey % 6 + 1] AS canonical FROM part)""")
def crossref_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kinds in their plain form, and which labels they may have."""
    pick = lambda some, k: F.element_at(F.array(*map(F.lit, some)), (k + 1).cast("int"))
    kind, label = pick(_KINDS, F.col("p_partkey") % 6), pick(_LABELS, F.col("p_size") % 8)
    return Relations(spark, sf_dir).table("part").select("p_partkey", kind.alias("kind"), label.alias("label"), T.crossref_kind(kind).alias("canonical"), T.valid_crossref_label(kind, label).alias("valid"))


@query(oracle(rf"""WITH l AS (SELECT paper_id, page, unnest(range(1, len(parts) + 1)) AS line, unnest(parts) AS x FROM (SELECT paper_id, page, string_split(text, chr(10)) AS parts FROM marked_pages)),
s AS (SELECT paper_id, page, line, {SQUASH % "x"} AS s FROM l), w AS (SELECT *, string_split(s, ' ') AS w, {_PARTS % "s"} AS c FROM s)
SELECT paper_id, page, CAST(line AS INT) AS line, {_table_line("s", "w", "c")} AS table_line, {_is_caption("c")} AS caption, {_heading("s", "w", "c")} AS heading,
 CASE WHEN regexp_matches(s, '^(?i)panel [a-z0-9]') THEN lower(regexp_extract(s, '^[A-Za-z]+ ([A-Za-z0-9]+)', 1)) END AS panel FROM w WHERE {_table_line("s", "w", "c")} OR {_is_caption("c")} OR {_heading("s", "w", "c")} OR regexp_matches(s, '^(?i)panel [a-z0-9]')""", "marked_pages"))
def line_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What pages' lines are, of those that are a table's, a caption, a heading or a panel's."""
    rows, s = X.squashed_lines(Relations(spark, sf_dir).view("marked_pages")), F.col("s")
    marked = rows.select("paper_id", "page", "line", X.table_or_axis_line(s, True).alias("table_line"), X.is_caption(s).alias("caption"), X.is_heading(s, True).alias("heading"), X.panel_label(s).alias("panel"))
    return marked.where("table_line or caption or heading or panel is not null")


@query(r"""SELECT p_partkey, h || ' ' || n AS heading, length(n) <= 80 AND (h LIKE '%:' OR regexp_matches(n, '^\p{Ll}')) AND n NOT IN ('3 More', '12', 'Panel') AS goes_on, CASE WHEN p_partkey % 4 = 1 THEN ['a', 'b2', 'iv'][p_partkey % 3 + 1] END AS panel FROM
(SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN '2 Data' WHEN 1 THEN '2 Data for:' ELSE '2 Data and' END AS h, CASE p_partkey % 4 WHEN 0 THEN 'of ' || p_name WHEN 1 THEN 'More ' || p_name WHEN 2 THEN '12' ELSE '3 More' END AS n FROM part)""")
def heading_continuations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether lines go on with headings; labels of panels."""
    c = F.col
    size, key = c("p_size"), c("p_partkey")
    h = F.when(size % 3 == 0, "2 Data").when(size % 3 == 1, "2 Data for:").otherwise("2 Data and")
    n = F.when(key % 4 == 0, F.concat(F.lit("of "), "p_name")).when(key % 4 == 1, F.concat(F.lit("More "), "p_name")).when(key % 4 == 2, "12").otherwise("3 More")
    panel = F.concat(F.lit(" Panel "), F.element_at(F.array(F.lit("A"), F.lit("B2"), F.lit("iv")), (key % 3 + 1).cast("int")), F.lit(": rest"))
    return Relations(spark, sf_dir).table("part").select(
        "p_partkey", F.concat_ws(" ", h, n).alias("heading"), X.continues_heading(h, n).alias("goes_on"), X.panel_label(F.when(key % 4 == 1, panel).otherwise("Panels of")).alias("panel")
    )


@query("""SELECT s_suppkey, CASE WHEN len(names) > 0 THEN array_to_string(names, ',') END AS secrets, CASE WHEN s_suppkey % 7 = 0 THEN 'name' WHEN len(names) > 0 THEN 'assignment' END AS why, s_suppkey % 3 = 0 AS private
FROM (SELECT s_suppkey, list_filter([CASE WHEN s_suppkey % 4 = 0 THEN 'DB_PASSWORD' END, CASE WHEN s_suppkey % 5 = 0 THEN 'OPEN_API_KEY' END, CASE WHEN s_suppkey % 6 = 0 THEN 'MY_TOKEN' END], lambda x: x IS NOT NULL) AS names FROM supplier) WHERE len(names) > 0 OR s_suppkey % 7 = 0 OR s_suppkey % 3 = 0""")
def private_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files whose names or lines tell of secrets, and those in private places."""
    k = F.col("s_suppkey")
    line = lambda n, yes, no: F.when(k % n == 0, yes).otherwise(no)
    content = F.concat_ws("\n", line(4, "export DB_PASSWORD=x", "db_password=x"), line(5, " OPEN_API_KEY: y", "KEYBOARD_API=1"), line(6, "MY_TOKEN = 1", "TOKEN_RE = 2"), F.col("s_name"))
    path = F.concat(F.when(k % 3 == 0, "work/a/").otherwise("docs/"), F.when(k % 7 == 0, "api-key.txt").otherwise(F.concat(k.cast("string"), F.lit(".txt"))))
    rows = Relations(spark, sf_dir).table("supplier").select("s_suppkey", path.alias("path"), content.alias("content"))
    marked = rows.select("s_suppkey", "path", F.array_join(C.secret_lines(F.col("content")), ",").alias("secrets"), C.private_path(F.col("path")).alias("private"))
    odd = C.suspicious_files(rows.select(F.concat("path", F.lit("#"), "s_suppkey").alias("path"), "content"))
    odd = odd.select(F.element_at(F.split("path", "#"), -1).cast("long").alias("s_suppkey"), "why")
    out = marked.join(odd, "s_suppkey", "left").select("s_suppkey", F.when(F.col("secrets") != "", F.col("secrets")).alias("secrets"), "why", "private")
    return out.where("secrets is not null or why is not null or private")


@query("""SELECT page_id, page_id % 3 <> 0 AND page_id % 4 <> 0 AND page_id % 5 <> 0 AND (page_id % 2 = 0 OR empty) AS plausible, empty FROM (SELECT page_id, page_id % 7 <> 1 AND page_id % 11 <> 2 AS empty FROM pages)""")
def plausible_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether texts can be a run's report; short ones only where the run found nothing."""
    k = F.col("page_id")
    pages = Relations(spark, sf_dir).table("pages").select("page_id")
    outputs = pages.select(k.alias("run"), F.lit("a").alias("name"), F.when(k % 7 == 1, "failed").otherwise("ok").alias("run_status"), F.lit(0).alias("finding_count"))
    empty = C.empty_runs(outputs, pages.where(k % 11 == 2).select(k.alias("run")))
    text = F.concat(F.when(k % 3 == 0, "Note: ").otherwise(" "), F.lit("# Report\n## One\n"), F.when(k % 4 == 0, "").otherwise("## Two\n"), F.when(k % 5 == 0, "## Other").otherwise("## Scope"), F.when(k % 2 == 0, F.repeat(F.lit("x"), 2500)).otherwise(""))
    rows = pages.join(empty.withColumnRenamed("run", "page_id"), "page_id")
    return rows.select("page_id", C.plausible_report(text, F.col("empty"), "# Report", ("## One", "## Two"), ("## Scope", "## Old scope")).alias("plausible"), "empty")


@query("""SELECT page_id, CASE WHEN page_id % 3 = 0 THEN NULL WHEN page_id % 3 = 1 THEN '# Report: ' || url ELSE '# Report: ' || url || ' # Report: x' END AS report FROM pages""")
def recovered_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text of transcripts from the last mark from which it is long enough."""
    k = F.col("page_id")
    said = F.concat(F.lit("log # Report: short"), F.when(k % 3 == 0, "").otherwise(F.concat(F.lit("log # Report: "), "url", F.when(k % 3 == 2, " # Report: x").otherwise(""))))
    said = F.when(k % 3 == 0, F.lit("log # Report: s")).otherwise(said)
    return Relations(spark, sf_dir).table("pages").select("page_id", X.last_plausible(said, "# Report: ", lambda t: F.length(t) >= 20).alias("report"))


@query("""SELECT doc_id, CAST(n AS INT) AS n_lines, CASE WHEN n + n // 2 = 0 THEN 1.0 ELSE round(2.0 * (n // 2) / (n + n // 2), 6) END AS similarity FROM (SELECT doc_id, len(list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '')) AS n FROM documents WHERE text IS NOT NULL)""")
def order_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How alike a text's lines are to the first half of them."""
    small_batches(spark)
    full = F.filter(F.split("text", "\n", -1), lambda x: F.trim(x) != "")
    rows = Relations(spark, sf_dir).table("documents").where("text is not null").select("doc_id", full.alias("l"))
    half = F.array_join(F.slice("l", 1, F.floor(F.size("l") / 2).cast("int")), "\n")
    rows = rows.select("doc_id", F.size("l").alias("n_lines"), F.array_join("l", "\n").alias("a"), half.alias("b"))
    return rows.select("doc_id", "n_lines", F.round(L.line_similarity(F.col("a"), F.col("b")), 6).alias("similarity"))


@query("""SELECT conv_id, turn, regexp_replace(regexp_replace(text, 'e', 'é', 'g'), '^', '') AS text, length(text) - length(replace(text, 'e', '')) AS applied FROM conversations WHERE text IS NOT NULL AND turn % 2 = 0
UNION ALL SELECT conv_id, turn, reverse(text), 0 FROM conversations WHERE text IS NOT NULL AND turn % 2 = 1 AND length(text) > 60""")
def aligned_glyphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repairs of every e, put where the same text has them; a reversed text is too unlike to take any."""
    rows = Relations(spark, sf_dir).table("conversations").where("text is not null and (turn % 2 = 0 or length(text) > 60)")
    letters = F.transform(F.split("text", ""), lambda x, i: F.struct(i.alias("place"), x.alias("letter")))
    repairs = F.transform(F.filter(letters, lambda x: x["letter"] == "e"), lambda x: F.struct(x["place"].alias("place"), F.lit("é").alias("put")))
    rows = rows.repartition(4 * spark.sparkContext.defaultParallelism, "conv_id", "turn")  # few bytes, much work
    rows = rows.select("conv_id", "turn", F.col("text").alias("source"), F.when(F.col("turn") % 2 == 0, F.col("text")).otherwise(F.reverse("text")).alias("target"), repairs.alias("r"))
    return rows.select("conv_id", "turn", G.aligned_repairs(F.col("source"), F.col("target"), F.col("r")).alias("a")).select("conv_id", "turn", "a.text", "a.applied")


@query("""SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN '[]' WHEN s_suppkey % 3 = 1 THEN 'hi' ELSE 'h]' END AS label, CASE WHEN s_suppkey % 3 = 0 THEN 2 ELSE 0 END AS repaired FROM supplier""")
def repaired_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words whose glyphs all have a repair in their box; those that others spell stay."""
    k = F.col("s_suppkey")
    x = (k % 40).cast("double") * 14
    words = Relations(spark, sf_dir).table("supplier").select(
        "s_suppkey", F.lit(0).alias("word"), x.alias("x0"), F.lit(0.0).alias("y0"), (x + 10).alias("x1"), F.lit(10.0).alias("y1"), F.when(k % 3 == 0, "hi").when(k % 3 == 1, "hi").otherwise("h]").alias("label")
    )
    glyph = lambda n, find, put: words.where(k % 3 != 1).select("s_suppkey", (F.col("x0") + n * 5).alias("x0"), "y0", (F.col("x0") + n * 5 + 4).alias("x1"), "y1", F.lit(find).alias("find"), F.lit(put).alias("put"))
    return G.repaired_words(words, glyph(0, "h", "[").union(glyph(1, "i", "]")), ["s_suppkey"]).select("s_suppkey", "label", "repaired")


@query("""SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'A ' || url || ' and HEAD' WHEN page_id % 3 = 1 THEN ' ' || url ELSE url || ' x' END AS text FROM pages WHERE url NOT LIKE '%HEAD%'""")
def removed_artifacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts without artifacts: of each its first place; those of fewer than three letters stay."""
    k = F.col("page_id")
    text = F.when(k % 3 == 0, F.concat(F.lit("A HEAD"), "url", F.lit(" and HEAD"))).when(k % 3 == 1, F.concat(F.lit("HEAD "), "url")).otherwise(F.concat("url", F.lit(" x")))
    text = F.when(k % 3 == 0, F.concat(F.lit("A "), F.lit("HEAD"), "url", F.lit(" and HEAD"))).otherwise(text)
    return Relations(spark, sf_dir).table("pages").where("url not like '%HEAD%'").select("page_id", L.remove_artifacts(text, F.array(F.lit("HEAD"), F.lit("x"))).alias("text"))


#: Positioned lines of reference lists: a running head, a heading, entries of two lines, the second of them indented.
HANGING = """SELECT concat('paper-', CAST(s_nationkey AS VARCHAR(9))) AS paper_id, CAST(p.k AS INT) AS page, CAST(CASE WHEN l.k = 0 THEN 0 ELSE 10 + s_suppkey * 2 + l.k END AS INT) AS line,
 CASE l.k WHEN 0 THEN 'Running Head' WHEN 1 THEN concat('Author, A. (', CAST(1950 + s_suppkey % 60 AS VARCHAR(9)), '). Work ', CAST(s_suppkey AS VARCHAR(9)), ' on long-') ELSE concat('winded things ', CAST(s_suppkey AS VARCHAR(9)), '.') END AS content,
 CASE l.k WHEN 2 THEN 70.0 ELSE 50.0 + s_suppkey % 3 END AS x0, CASE l.k WHEN 0 THEN 20.0 ELSE 150.0 + l.k END AS y0, 600.0 AS width, 800.0 AS height
FROM supplier JOIN (SELECT n_nationkey AS k FROM nation WHERE n_nationkey BETWEEN 1 AND 2) p ON TRUE JOIN (SELECT n_nationkey AS k FROM nation WHERE n_nationkey < 3) l ON TRUE"""


@query("""WITH s AS (SELECT s_suppkey, s_nationkey, p FROM supplier, range(1, 3) p(p))
SELECT 'paper-' || s_nationkey AS paper_id, CAST(row_number() OVER (PARTITION BY s_nationkey ORDER BY p, s_suppkey) AS INT) AS entry, CAST(p AS INT) AS start_page, 'Author, A. (' || (1950 + s_suppkey % 60) || '). Work ' || s_suppkey || ' on long-winded things ' || s_suppkey || '.' AS content FROM s""")
def hanging_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries of positioned reference lists of two pages, of a nation's suppliers each."""
    rows = Relations(spark, sf_dir).sql(HANGING)
    heads = rows.where("page = 1").select("paper_id").distinct().selectExpr("paper_id", "1 AS page", "1 AS line", "'References' AS content", "50.0 AS x0", "120.0 AS y0", "600.0 AS width", "800.0 AS height")
    double = [F.col(k).cast("double").alias(k) for k in ("x0", "y0", "width", "height")]
    every = rows.distinct().unionByName(heads).select("paper_id", "page", "line", "content", *double)
    return D.hanging_references(every)


@query("""SELECT p_size AS table_id, CASE WHEN promoted THEN 'Group|Mean|SD' END AS header, string_agg(p_partkey || '.5|' || CASE WHEN p_partkey % 4 = 0 THEN '' ELSE '7' END || CASE WHEN promoted THEN '' ELSE '' END, ';' ORDER BY p_partkey) AS body
FROM (SELECT *, bool_or(p_partkey % 4 <> 0) OVER (PARTITION BY p_size) AS promoted FROM part) WHERE promoted GROUP BY p_size, promoted""")
def promoted_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables whose first row names one column more than the data have cells."""
    c = F.col
    part = Relations(spark, sf_dir).table("part")
    some = part.where(c("p_partkey") % 4 != 0).select("p_size").distinct()
    rows = part.join(some, "p_size").select("p_size", c("p_partkey").alias("line"), F.when(c("p_partkey") % 4 == 0, F.array(F.concat(c("p_partkey").cast("string"), F.lit(".5")))).otherwise(F.array(F.concat(c("p_partkey").cast("string"), F.lit(".5")), F.lit("7"))).alias("cells"))
    heads = some.select("p_size", F.lit(-1).cast("long").alias("line"), F.array(F.lit("Group"), F.lit("Mean"), F.lit("SD")).alias("cells"))
    out = D.promoted_header(rows.union(heads), ["p_size"])
    return out.select(c("p_size").alias("table_id"), F.array_join("header", "|").alias("header"), F.array_join(F.transform("body", lambda r: F.array_join(r, "|")), ";").alias("body"))


@query("""SELECT coalesce(a.k, b.k) AS place, a.x, b.y, CASE WHEN a.k IS NULL OR b.k IS NULL THEN 'unpaired' END AS error FROM (SELECT p_partkey AS k, p_name AS x FROM part WHERE p_partkey % 5 <> 0) a FULL JOIN (SELECT p_partkey AS k, p_brand AS y FROM part WHERE p_partkey % 7 <> 0) b ON a.k = b.k""")
def paired_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows paired by place, with those that have no other."""
    part = Relations(spark, sf_dir).table("part").withColumnRenamed("p_partkey", "place")
    return D.zipped(part.where("place % 5 <> 0").select("place", F.col("p_name").alias("x")), part.where("place % 7 <> 0").select("place", F.col("p_brand").alias("y")), [], "place")


#: Rows on pages of 600 x 800 in two columns, by kind: cells, a panel, a caption, a heading, a note, words.
ROWS = """SELECT CAST(floor(l_orderkey / 16) AS INT) AS page, l_orderkey * 10 + l_linenumber AS box, l_partkey % 2 * 300.0 + 40.0 AS x0, l_suppkey * 7 % 70 * 10.0 + l_linenumber AS y0, l_partkey % 2 * 300.0 + 240.0 AS x1, l_suppkey * 7 % 70 * 10.0 + l_linenumber + 8.0 AS y1, CAST(l_partkey % 9 AS INT) AS kind,
 CASE l_partkey % 9 WHEN 0 THEN 'Panel A: Men' WHEN 1 THEN 'Table 3: Sums' WHEN 2 THEN 'THE MAIN RESULT' WHEN 3 THEN 'Notes: none' WHEN 4 THEN 'plain words here' ELSE 'Income 1.5 (0.2)' END AS content
FROM (SELECT l_orderkey, l_linenumber, min(l_partkey) AS l_partkey, min(l_suppkey) AS l_suppkey FROM lineitem GROUP BY l_orderkey, l_linenumber) l"""
CAPS = f"SELECT page, box, x0, y0, x1, y1, 600.0 AS width, 800.0 AS height FROM ({ROWS}) r WHERE kind = 1 AND box % 3 = 0"


def _walk(side: str) -> str:
    """The recursive walk of one side, row by row."""
    below = side == "below"
    gap = "r.y0 - w.at" if below else "w.at - r.y1"
    numeric, panel, words = "r.kind > 4", "r.kind = 0", "r.kind IN (0, 1, 2, 3, 4)"
    wide = f"{gap} > CASE WHEN w.n = 0 OR {panel} THEN 60 ELSE 30 END" if below else f"{gap} > CASE WHEN w.n > 0 THEN 22 ELSE 30 END"
    ends = f"{wide} OR r.kind IN (1, 3) OR (w.n > 0 AND w.numeric >= 2 AND {words} AND ({gap} > 18 OR r.kind = 2) AND NOT {panel})" if below else f"{wide} OR w.edge - r.y0 > 380 OR (w.n > 0 AND r.kind IN (1, 2))"
    skip, edge, place = f"NOT w.open OR {gap} < -8", "bottom" if below else "top", "y0" if below else "-y0"
    keep = lambda new, old: f"CASE WHEN {skip} OR ({ends}) THEN w.{old} ELSE {new} END"
    return f"""{side}_k AS (SELECT *, row_number() OVER (PARTITION BY page, cap ORDER BY {place}, box) AS k FROM both_sides WHERE {"y0 >= bottom - 1" if below else "y1 <= top + 1"}),
{side}_w AS (SELECT DISTINCT page, cap, 0 AS k, {edge} AS at_, {edge} AS edge, 0 AS n, 0 AS numeric, CAST(NULL AS DOUBLE) AS t, CAST(NULL AS DOUBLE) AS b, TRUE AS open FROM {side}_k
 UNION ALL SELECT r.page, r.cap, r.k, {keep("r.y1" if below else "r.y0", "at_")}, w.edge, {keep("w.n + 1", "n")}, {keep(f"w.numeric + CASE WHEN {numeric} THEN 1 ELSE 0 END", "numeric")}, {keep("coalesce(least(w.t, r.y0), r.y0)", "t")}, {keep("coalesce(greatest(w.b, r.y1), r.y1)", "b")},
  CASE WHEN {skip} THEN w.open ELSE NOT ({ends}) END FROM {side}_w w JOIN {side}_k r ON r.page = w.page AND r.cap = w.cap AND r.k = w.k + 1),
{side}_e AS (SELECT page, cap AS caption, '{side}' AS side, CAST(n AS INT) AS n_rows, t AS y0, b AS y1 FROM {side}_w WHERE numeric >= 2 QUALIFY row_number() OVER (PARTITION BY page, cap ORDER BY k DESC) = 1)""".replace("w.at ", "w.at_ ").replace("w.at)", "w.at_)").replace("w.at -", "w.at_ -")


@query(f"""WITH RECURSIVE rows AS ({ROWS}), caps AS ({CAPS}), both_sides AS (SELECT r.*, c.box AS cap, c.y0 AS top, c.y1 AS bottom FROM rows r JOIN caps c ON r.page = c.page AND r.box <> c.box AND r.x0 = c.x0), {_walk("below")}, {_walk("above")}
SELECT * FROM below_e UNION ALL SELECT * FROM above_e a WHERE NOT EXISTS (SELECT 1 FROM below_e b WHERE b.page = a.page AND b.caption = a.caption)""")
def table_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that belong to captions, below them or else above."""
    data = Relations(spark, sf_dir)
    double = lambda df: df.select(*[F.col(c).cast("double").alias(c) if c in ("x0", "y0", "x1", "y1", "width", "height") else F.col(c) for c in df.columns])
    return D.table_regions(double(data.sql(ROWS)).drop("kind"), double(data.sql(CAPS)))
