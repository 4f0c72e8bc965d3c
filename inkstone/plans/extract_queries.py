"""Queries on extractors, with their SQL. What the SQL's regular expressions lack (look-around, back-references, offsets)
is put as words of a line, marks at borders, and lengths of what stands before a match."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import extract as X
from ..operators import layout as L
from ..sources.views import Relations, oracle
from .layout_queries import SQUASH
from .registry import query


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Relations(spark, sf_dir).view("marked_pages")


def _located(name: str, source: str, text: str, pattern: str, clean: str = "%s") -> str:
    """A common table expression (paper_id, page, text, start, match) of a pattern's matches in a column of a source; `clean`
    takes border marks away from what is measured."""
    measured = clean % "array_to_string(parts[1:i - 1], '')"
    return rf"""{name}_p AS (SELECT paper_id, page, text, string_split(regexp_replace({text}, '{pattern}', chr(3) || '\1' || chr(4), 'g'), chr(3)) AS parts FROM {source}),
{name}_i AS (SELECT *, unnest(range(2, len(parts) + 1)) AS i FROM {name}_p WHERE len(parts) > 1),
{name} AS (SELECT paper_id, page, text, length({measured}) - (i - 2) AS start, {clean % "split_part(parts[i], chr(4), 1)"} AS match FROM {name}_i)"""


LINE_OF = "CAST(length(left(text, %s)) - length(replace(left(text, %s), chr(10), '')) + 1 AS INT)"


def _context(start: str, end: str, window: int) -> str:
    low = f"greatest(0, {start} - {window})"
    return SQUASH % f"substring(text, {low} + 1, {end} + {window} - {low})"


RANGES = r"""WITH cut AS (SELECT paper_id, page, length(text) AS size, unnest(range(1, len(parts) + 1)) AS line, unnest(parts) AS content
  FROM (SELECT *, string_split(text, chr(10)) AS parts FROM marked_pages)),
c AS (SELECT *, sum(length(content) + 1) OVER (PARTITION BY paper_id, page ORDER BY line) AS nxt, trim(regexp_replace(content, '\s+', ' ', 'g')) AS s FROM cut),
m AS (SELECT *, CASE WHEN regexp_matches(s, '(?i)^(references|bibliography)$') THEN 'start' WHEN regexp_matches(s, '(?i)^(?:(?:[A-Z] )?(?:appendix|online appendix)\b|(?:appendix|online appendix) [A-Z]\b)')
  OR regexp_matches(s, '(?i)^(?:for online publication only:?|(?:[A-Z] )?(?:(?:main|additional) )?(?:figures(?: and tables)?|tables(?: and figures)?))$') THEN 'end' END AS mark FROM c),
w AS (SELECT *, last_value(mark IGNORE NULLS) OVER (PARTITION BY paper_id ORDER BY page, line) AS state FROM m),
b AS (SELECT *, lag(state) OVER (PARTITION BY paper_id ORDER BY page, line) AS before FROM w),
r AS (SELECT *, sum(CASE WHEN state = 'start' AND coalesce(before, 'end') <> 'start' THEN 1 ELSE 0 END) OVER (PARTITION BY paper_id ORDER BY page, line) AS run FROM b)
SELECT paper_id, page, min(nxt - length(content) - 1) AS range_start, max(least(nxt, size)) AS range_end FROM r WHERE state = 'start' GROUP BY paper_id, page, run"""


@query(oracle(RANGES, "marked_pages"))
def reference_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.list_ranges(_pages(spark, sf_dir))


NAME, AUTHORS, AGAIN = r"[A-Z][A-Za-z''`\-]+", r"(?:\s+(?:and|&)\s+[A-Z][A-Za-z''`\-]+)?(?:\s+et al\.)?", r"(?:\s*,\s*(?:19|20)\d\d[a-z]?)+"
YEAR = r"(?:19|20)\d\d[a-z]?"
CITED = (
    rf"(\({NAME}{AUTHORS},\s*{YEAR}{AGAIN}(?:;\s*[^)]*)?\))", rf"(\b{NAME}(?:\s+et al\.)?\s*\({YEAR}{AGAIN}\))",
    rf"(\({NAME}{AUTHORS},\s*{YEAR}(?:;\s*[^)]*)?\))", rf"(\b{NAME}(?:\s+et al\.)?\s*\({YEAR}\))", r"(\[[0-9,\-\s]+\])",
)
_OVERLAP = "o.paper_id = f.paper_id AND o.page = f.page AND o.start < f.stop AND f.start < o.stop"
_KEPT = ", ".join(
    f"k{k} AS (SELECT * FROM k{k - 1} UNION ALL SELECT * FROM free f WHERE rank = {k} AND NOT EXISTS (SELECT 1 FROM k{k - 1} o WHERE {_OVERLAP}))" for k in range(1, 5)
)


@query(oracle(f"""WITH {", ".join(_located(f"c{k}", "marked_pages", "text", p) for k, p in enumerate(CITED))},
ranges AS ({RANGES}), found AS ({" UNION ALL ".join(f"SELECT *, {k} AS rank, start + length(match) AS stop FROM c{k}" for k in range(5))}),
free AS (SELECT * FROM found f WHERE NOT EXISTS (SELECT 1 FROM ranges r WHERE r.paper_id = f.paper_id AND r.page = f.page AND f.start >= range_start AND f.start < range_end)),
k0 AS (SELECT * FROM free WHERE rank = 0), {_KEPT}
SELECT paper_id, page, match, CAST(start AS INT) AS match_start, CAST(stop AS INT) AS match_end, CAST(rank AS INT) AS rank, {LINE_OF % ("start", "start")} AS line_number,
 {_context("start", "stop", 100)} AS context FROM k4""", "marked_pages"))
def citation_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.citations(_pages(spark, sf_dir))


#: Borders of words and dots: \x01 after every other character, \x02 before it.
_BORDERED = r"chr(1) || regexp_replace(text, '([^\p{L}\p{N}_.])', chr(2) || '\1' || chr(1), 'g') || chr(2)"
_AMOUNT = (
    r"(?i)\x01((?:\x02[$€£]\x01(?:\x02\s\x01)*)?(?:\x02[-−]\x01)?(?:\d{1,3}(?:\x02,\x01\d{3})+(?:\.\d+)?|\d+\.\d+|\.\d+|\d+)"
    r"(?:(?:\x02\s\x01)?(?:\x02%\x01|pp|bps|bp|percent|percentage\x02 \x01points|million|billion|trillion|k|m|bn))?)\x02"
)
_UNBORDERED = r"regexp_replace(%s, '[\x01\x02]', '', 'g')"


@query(oracle(f"""WITH b AS (SELECT paper_id, page, text, {_BORDERED} AS marked FROM marked_pages), {_located("n", "b", "marked", _AMOUNT, _UNBORDERED)}
SELECT paper_id, page, CAST(start AS INT) AS match_start, CAST(start + length(match) AS INT) AS match_end, {LINE_OF % ("start", "start")} AS line_number,
 {_context("start", "start + length(match)", 80)} AS context, trim(match) AS number FROM n""", "marked_pages"))
def number_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.numbers(_pages(spark, sf_dir))


_KINDS = r"Tables?|Figures?|Figs?\.|Sections?|Appendices|Appendixes|Appendix|Eqs?\.|Equations?"
_LABEL = r"(?:[A-Z]\.?)?\d+(?:\.\d+)*[A-Za-z]?|[A-Z](?:\.\d+)*"
#: The same with \x02 before every character that is no letter.
_MARKED_KINDS = _KINDS.replace(r"\.", r"\x02\.")
_MARKED_LABEL = r"(?:[A-Z](?:\x02\.)?)?(?:\x02\d)+(?:\x02\.(?:\x02\d)+)*[A-Za-z]?|[A-Z](?:\x02\.(?:\x02\d)+)*"
_SERIES = rf"(?i)(\b(?:{_KINDS})\s+\(?(?:{_LABEL})\)?(?:\s*(?:,|and|or|to|through|[-–—])\s*\(?(?:{_LABEL})\)?)+)"
_SINGLE = rf"(?i)(\b(?:{_MARKED_KINDS})(?:\x02\s)+(?:\x02\((?:{_MARKED_LABEL})\x02\)|(?:{_MARKED_LABEL})))\x02"
_KIND_OF = """CASE WHEN k LIKE 'table%' THEN 'table' WHEN k LIKE 'fig%' THEN 'figure' WHEN k LIKE 'sect%' THEN 'section' WHEN k LIKE 'app%' THEN 'appendix' ELSE 'equation' END"""
_SOUND = r"""CASE kind WHEN 'appendix' THEN regexp_matches(label, '^[A-Z](\.?[0-9]+(\.[0-9]+)*)?$') WHEN 'section' THEN regexp_matches(label, '^([A-Z]\.?)?[0-9]+(\.[0-9]+)*[A-Za-z]?$|^[A-Z]$')
 WHEN 'equation' THEN regexp_matches(label, '^[0-9]+(\.[0-9]+)*[A-Za-z]?$|^[A-Z]\.?[0-9]+(\.[0-9]+)*$') ELSE regexp_matches(label, '^([A-Z]\.?)?[0-9]+(\.[0-9]+)*[A-Za-z]?$') END"""
#: A line's kind word, label and rest if it begins like a caption.
_PARTS = r"regexp_extract(%s, '^((?i)table|figure|fig\.) ([a-zA-Z]?\.?[0-9]+(?:\.[0-9]+)?[A-Za-z]?)(.*)$', ['k', 'l', 'r'])"


def _is_plain_caption(c: str) -> str:
    return rf"({c}.l <> '' AND NOT starts_with({c}.l, '.') AND ({c}.r = '' OR regexp_matches({c}.r, '^ ?: ?[^ ]')))"


def _is_caption(c: str) -> str:
    return rf"({_is_plain_caption(c)} OR ({c}.l <> '' AND NOT starts_with({c}.l, '.') AND {c}.k = upper({c}.k) AND regexp_matches({c}.r, '^ [A-Z]..') AND NOT regexp_matches({c}.l, '^[a-z]')))"


LINES = f"""lines AS (SELECT paper_id, page, line, s, {_PARTS % "s"} AS c, length(array_to_string(parts[1:line - 1], chr(10))) + least(line - 1, 1) AS pos
 FROM (SELECT paper_id, page, parts, line, {SQUASH % "parts[line]"} AS s FROM (SELECT *, unnest(range(1, len(parts) + 1)) AS line FROM (SELECT paper_id, page, string_split(text, chr(10)) AS parts FROM marked_pages)))),
noted AS (SELECT *, min(CASE WHEN {_is_caption("c")} THEN line END) OVER later AS next_caption, min(CASE WHEN regexp_matches(s, '(?i)^notes? ?:') THEN line END) OVER later AS next_note
 FROM lines WINDOW later AS (PARTITION BY paper_id, page ORDER BY line ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)),
captioned AS (SELECT paper_id, page, CASE WHEN lower(c.k) = 'table' THEN 'table' ELSE 'figure' END AS kind, c.l AS label, trim(regexp_replace(c.r, '^ ?:', '')) AS title, line, pos, {_is_plain_caption("c")} AS plain
 FROM noted WHERE {_is_caption("c")} AND (c.r <> '' OR (lower(c.k) <> 'table' AND next_note < coalesce(next_caption, next_note + 1))))"""
CROSSREFS = rf"""{LINES}, {_located("series", "marked_pages", "text", _SERIES)}, b AS (SELECT paper_id, page, text, regexp_replace(text, '([^A-Za-z])', chr(2) || '\1', 'g') || chr(2) AS marked FROM marked_pages),
{_located("single", "b", "marked", _SINGLE, r"replace(%s, chr(2), '')")},
tail AS (SELECT paper_id, page, start AS base, match AS whole, lower(regexp_extract(match, '^[A-Za-z]+')) AS k, regexp_replace(match, '^\S+\s+', '') AS text FROM series),
{_located("member", "(SELECT paper_id, page, text, text AS t FROM (SELECT DISTINCT paper_id, page, text FROM tail))", "t", rf"(\(?(?:{_LABEL})\)?)")},
told AS (SELECT t.paper_id, t.page, {_KIND_OF} AS kind, trim(m.match, '()') AS label, 0 AS source, base + length(whole) - length(t.text) + m.start + CASE WHEN starts_with(m.match, '(') THEN 1 ELSE 0 END AS pos, whole AS reference_text
 FROM tail t JOIN member m ON t.paper_id = m.paper_id AND t.page = m.page AND t.text = m.text
 UNION ALL SELECT paper_id, page, {_KIND_OF}, label, 1, start, match FROM (SELECT *, lower(regexp_extract(match, '^[A-Za-z]+')) AS k, regexp_extract(match, '\(?([A-Za-z0-9.]+)\)?$', 1) AS label FROM single)),
every AS (SELECT * FROM told WHERE {_SOUND} UNION ALL SELECT paper_id, page, kind, label, 2, pos, CASE kind WHEN 'table' THEN 'Table ' ELSE 'Figure ' END || label FROM captioned WHERE plain),
crossed AS (SELECT paper_id, page, kind, label, CAST(source AS INT) AS source, CAST(pos AS INT) AS "at", reference_text FROM every QUALIFY row_number() OVER (PARTITION BY paper_id, page, kind, label ORDER BY source, pos) = 1)"""


@query(oracle(f"WITH {CROSSREFS} SELECT * FROM crossed", "marked_pages"))
def crossref_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.crossrefs(_pages(spark, sf_dir))


@query(oracle(rf"""WITH {CROSSREFS}, ends AS (SELECT paper_id, page, line, regexp_extract(s, '(?:^|[^A-Za-z0-9_])([A-Za-z]+)-$', 1) AS l FROM lines),
starts AS (SELECT paper_id, page - 1 AS page, k, regexp_extract(s, '^([a-z][a-z]+)\s+((?:[A-Z]\.?)?[0-9]+(?:\.[0-9]+)*[A-Za-z]?|[A-Z](?:\.[0-9]+)*)(?:[^A-Za-z]|$)', ['r', 'label']) AS x
 FROM (SELECT *, row_number() OVER (PARTITION BY paper_id, page ORDER BY line) AS k FROM lines WHERE s <> '') WHERE k <= 20),
words AS (SELECT e.paper_id, e.page, e.line, k, x.label, CASE lower(l || x.r) WHEN 'tables' THEN 'table' WHEN 'table' THEN 'table' WHEN 'figure' THEN 'figure' WHEN 'figures' THEN 'figure' WHEN 'section' THEN 'section'
 WHEN 'sections' THEN 'section' WHEN 'appendix' THEN 'appendix' WHEN 'appendices' THEN 'appendix' WHEN 'equation' THEN 'equation' WHEN 'equations' THEN 'equation' END AS kind
 FROM ends e JOIN starts s ON e.paper_id = s.paper_id AND e.page = s.page WHERE length(l) >= 2 AND x.r <> ''),
best AS (SELECT * FROM words WHERE kind IS NOT NULL AND {_SOUND} QUALIFY row_number() OVER (PARTITION BY paper_id, page, line ORDER BY k) = 1)
SELECT paper_id, page, CAST(min(line) AS INT) AS line, kind, label FROM best b WHERE NOT EXISTS (SELECT 1 FROM crossed c WHERE c.paper_id = b.paper_id AND c.page = b.page AND c.kind = b.kind AND c.label = b.label)
GROUP BY paper_id, page, kind, label""", "marked_pages"))
def split_crossrefs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.split_words(_pages(spark, sf_dir))


@query(oracle(f"""WITH {LINES} SELECT paper_id, page, kind, label, title, CAST(line AS INT) AS line FROM captioned QUALIFY row_number() OVER (PARTITION BY paper_id, page, kind, label ORDER BY line) = 1""", "marked_pages"))
def caption_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.captions(_pages(spark, sf_dir))


_NUMERAL = r"[-−]?(?:[0-9]{1,3}(?:,[0-9]{3})+|[0-9]+)(?:\.[0-9]+)?"


def _table_line(s: str, w: str, c: str) -> str:
    """Whether the squashed line s of words w with caption parts c is a table's or an axis's."""
    pairs = f"list_transform(range(1, len({w}) // 2 + 1), lambda i: lower({w}[2 * i]))"
    return rf"""(regexp_matches({s}, '^(?i)n( {_NUMERAL}){{2,}}$') OR {_is_caption(c)}
 OR len(list_filter(range(1, len({w})), lambda i: regexp_matches({w}[i], '^[A-Z]$') AND regexp_matches({w}[i + 1], '^[A-Z][A-Za-z]'))) >= 2
 OR (len({w}) >= 4 AND len({w}) % 2 = 0 AND len(list_distinct({pairs})) = 1 AND regexp_matches({w}[2], '^[A-Za-z][A-Za-z-]*$')
  AND len(list_filter(range(1, len({w}) // 2 + 1), lambda i: NOT regexp_matches({w}[2 * i - 1], '^[0-9]+(\.[0-9]+)?$'))) = 0)
 OR (len(regexp_extract_all({s}, '{_NUMERAL}')) >= 3 AND len(regexp_extract_all({s}, '[A-Za-z]+')) <= 8))"""


def _heading(s: str, w: str, c: str) -> str:
    """Whether the squashed line s of words w with caption parts c heads a section."""
    letters = lambda n: f"len(list_filter({w}{n}, lambda x: NOT regexp_matches(x, '^[A-Z]$'))) = 0"
    appendix = f"regexp_matches({s}, '^(?i)([a-z] )?(online )?appendix\\b')"
    title = f"regexp_extract({s}, '^[0-9]+(?:\\.[0-9]+)* ([A-Z].*)$', 1)"
    return rf"""(length({s}) BETWEEN 1 AND 140 AND right({s}, 1) NOT IN ('.', ',', ';', ':') AND NOT (len({w}) >= 2 AND {letters("")}) AND NOT (len({w}) >= 4 AND {letters("[1:4]")})
 AND NOT regexp_matches({s}, '^[A-Z]\. ?[A-Z]\.') AND lower({s}) NOT IN ('edited by', 'reviewed by', 'approved by') AND NOT regexp_matches({s}, '[=<>≤≥≈≠‰]')
 AND NOT ({appendix} AND (contains({s}, ',') OR len({w}) > 12)) AND NOT {_table_line(s, w, c)}
 AND CASE WHEN {appendix} OR lower({s}) IN ('references', 'bibliography')
   OR regexp_matches({s}, '^(?i)(for online publication only:?|([a-z] )?((main|additional) )?(figures( and tables)?|tables( and figures)?))$') THEN TRUE
  WHEN regexp_matches({s}, '^(?i)[ivxlc]+\. ') AND NOT regexp_matches({s}, '^[IVXLC]+\. ') THEN FALSE
  WHEN lower({s}) IN ('abstract', 'introduction', 'conclusion', 'appendixes') OR regexp_matches({s}, '^(?i)[ivxlc]+\. [a-z].{{0,120}}$') OR regexp_matches({s}, '^[A-Z](\.[0-9]+)+ [A-Z].{{0,120}}$')
   OR regexp_matches({s}, '^[A-Z] [A-Z].{{0,120}}$') THEN TRUE
  WHEN {title} <> '' THEN TRY_CAST(regexp_extract({s}, '^[0-9]+') AS INT) BETWEEN 1 AND 9 AND len(string_split({title}, ' ')) <= 12 AND NOT regexp_matches({title}, '\. +[^ ]')
   AND NOT regexp_matches({title}, '^(NOK|USD|EUR|GBP)\b')
  ELSE {s} = upper({s}) AND regexp_matches({s}, '\p{{Lu}}') AND len({w}) BETWEEN 2 AND 12
   AND len(list_distinct(regexp_extract_all({s}, '[A-Z]+'))) = len(regexp_extract_all({s}, '[A-Z]+')) END)"""


@query(oracle(rf"""WITH {LINES}, f AS (SELECT paper_id, page, line, s, string_split(s, ' ') AS w, c, CASE WHEN n1 = '' THEN coalesce(n2, '') ELSE n1 END AS n
  FROM (SELECT *, coalesce(lead(s) OVER o, '') AS n1, lead(s, 2) OVER o AS n2 FROM lines WINDOW o AS (PARTITION BY paper_id, page ORDER BY line))),
g AS (SELECT *, string_split(n, ' ') AS nw, {_PARTS % "n"} AS nc FROM f),
h AS (SELECT paper_id, page, line, s || CASE WHEN length(n) BETWEEN 1 AND 80 AND regexp_matches(n, '^\p{{Ll}}') AND NOT {_heading("n", "nw", "nc")} AND NOT {_table_line("n", "nw", "nc")} THEN ' ' || n ELSE '' END AS heading
 FROM g WHERE {_heading("s", "w", "c")}), l AS (SELECT paper_id, max(page) AS last FROM marked_pages GROUP BY 1)
SELECT h.paper_id, heading, page AS start_page, CAST(line AS INT) AS start_line, coalesce(lead(page) OVER o, last) AS end_page,
 CAST(CASE WHEN lead(line) OVER o > 1 THEN lead(line) OVER o - 1 END AS INT) AS end_line FROM h JOIN l ON h.paper_id = l.paper_id WINDOW o AS (PARTITION BY h.paper_id ORDER BY page, line)""", "marked_pages"))
def section_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.sections(_pages(spark, sf_dir))


_AUTHOR = r"^(\[[0-9]+\]\s*)?([A-ZÀ-ÖØ-Þ][A-Za-zÀ-ÖØ-öø-ÿ''`.\-]+|([Vv]an|[Vv]on|[Dd]e|[Dd]el|[Dd]a|[Dd]i|[Ll]e|[Ll]a)\s+[A-Za-zÀ-ÖØ-öø-ÿ''`.\-]+)(,|\s+and\s+)..+"
#: Positioned lines of pages, two beside each other on a height: numbers, titles, labels, captions, notes and words.
POSITIONED = """SELECT concat('paper-', CAST(CAST(floor(l_orderkey / 160) AS BIGINT) AS VARCHAR(20))) AS paper_id, CAST(floor(l_orderkey / 16) AS INT) AS page, l_orderkey * 10 + l_linenumber AS line,
 CASE (l_orderkey * 5 + l_linenumber * 3) % 17 WHEN 0 THEN '3' WHEN 1 THEN '3.1' WHEN 2 THEN 'The  Sample' WHEN 3 THEN 'Main Results' WHEN 4 THEN concat('Table ', CAST(l_partkey % 5 AS VARCHAR(9))) WHEN 5 THEN concat('Figure ', CAST(l_partkey % 5 AS VARCHAR(9)))
  WHEN 6 THEN 'Notes: drawn by hand' WHEN 7 THEN concat('Table ', CAST(l_partkey % 7 AS VARCHAR(9)), ': Sums') WHEN 8 THEN 'A Data' WHEN 9 THEN 'of the sample' WHEN 10 THEN 'Effects on wages,' WHEN 11 THEN 'Effects on wages' WHEN 12 THEN '4' WHEN 13 THEN 'FIGURE 9 LARGE SUMS'
  WHEN 14 THEN 'Panel A' WHEN 15 THEN '1.5 2.5 3.5' ELSE 'words of text' END AS content,
 50.0 + CAST((l_linenumber + 1) % 2 AS DOUBLE) * CAST(30 + l_partkey % 40 AS DOUBLE) AS x0, CAST(l_orderkey % 16 AS DOUBLE) * 45.0 + CAST(floor((l_linenumber - 1) / 2) AS DOUBLE) * 12.0 + CAST(l_suppkey % 4 AS DOUBLE) * 0.6 AS y0,
 50.0 + CAST((l_linenumber + 1) % 2 AS DOUBLE) * CAST(30 + l_partkey % 40 AS DOUBLE) + 25.0 AS x1, CAST(l_orderkey % 16 AS DOUBLE) * 45.0 + CAST(floor((l_linenumber - 1) / 2) AS DOUBLE) * 12.0 + CAST(l_suppkey % 4 AS DOUBLE) * 0.6 + 9.0 AS y1,
 l_suppkey % 5 > 0 AS bold, CASE WHEN l_partkey % 11 = 0 THEN 12.0 ELSE 9.0 END AS size, CAST(l_orderkey AS INT) AS block FROM (SELECT l_orderkey, l_linenumber, min(l_partkey) AS l_partkey, min(l_suppkey) AS l_suppkey FROM lineitem GROUP BY l_orderkey, l_linenumber) u"""
_SET = f"WITH pl AS (SELECT * REPLACE (trim(regexp_replace(content, ' +', ' ', 'g')) AS content) FROM ({POSITIONED}))"


def _positioned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Relations(spark, sf_dir).sql(POSITIONED)


@query(rf"""{_SET}, n AS (SELECT a.paper_id, a.page, a.line, a.content AS number, arg_min(b.content, (b.x0 - a.x1, b.line)) AS title FROM pl a JOIN pl b ON a.paper_id = b.paper_id AND a.page = b.page AND a.bold AND b.bold
  WHERE regexp_matches(a.content, '^[1-9](\.[0-9]+)*$') AND b.x0 - a.x1 BETWEEN 0 AND 42 AND abs(a.y0 - b.y0) <= 1.5 AND regexp_matches(b.content, '^\p{{Lu}}') AND NOT regexp_matches(b.content, '([.,;:]$|^(Table|Figure|FIGURE) [0-9])') GROUP BY ALL),
x AS (SELECT DISTINCT paper_id, page, number, title FROM n), l AS (SELECT paper_id, page, row_number() OVER (PARTITION BY paper_id, page ORDER BY line) AS line, content AS s FROM pl),
f AS (SELECT *, string_split(s, ' ') AS w, {_PARTS % "s"} AS c, coalesce(lead(s) OVER o, '') AS n, coalesce(lag(s) OVER o, '') AS b FROM l WINDOW o AS (PARTITION BY paper_id, page ORDER BY line)),
h AS (SELECT f.paper_id, f.page, line, CASE WHEN o.number IS NOT NULL THEN s || ' ' || n WHEN n IN ('of the sample', 'words of text') THEN s || ' ' || n ELSE s END AS heading
 FROM f LEFT JOIN x o ON o.paper_id = f.paper_id AND o.page = f.page AND o.number = s AND o.title = n LEFT JOIN x t ON t.paper_id = f.paper_id AND t.page = f.page AND t.title = s AND t.number = b
 WHERE o.number IS NOT NULL OR (t.title IS NULL AND {_heading("s", "w", "c")})), z AS (SELECT paper_id, max(page) AS last FROM pl GROUP BY 1)
SELECT h.paper_id, heading, page AS start_page, CAST(line AS INT) AS start_line, coalesce(lead(page) OVER o, last) AS end_page, CAST(CASE WHEN lead(line) OVER o > 1 THEN lead(line) OVER o - 1 END AS INT) AS end_line
FROM h JOIN z USING (paper_id) WINDOW o AS (PARTITION BY h.paper_id ORDER BY page, line)""")
def numbered_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections of pages whose headings have numbers apart from their titles, told by positioned lines."""
    lines = _positioned(spark, sf_dir)
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "content"))), lambda x: x["content"]), "\n")
    return X.sections(lines.groupBy("paper_id", "page").agg(text.alias("text")), X.numbered_headings(lines))


_SHOWN = rf"""{_SET}, f AS (SELECT *, lead(content) OVER o AS nc, lead(x0) OVER o AS nx0, lead(y0) OVER o AS ny0, lead(x1) OVER o AS nx1, lead(y1) OVER o AS ny1, lead(size) OVER o AS ns, lead(block) OVER o AS nb FROM pl WINDOW o AS (PARTITION BY paper_id, page ORDER BY line)),
t AS (SELECT *, content LIKE 'Notes:%' AS note, regexp_matches(content, '^(Table|Figure) [0-9]+(: .+)?$') OR content = 'FIGURE 9 LARGE SUMS' AS caption,
 CASE WHEN content = 'FIGURE 9 LARGE SUMS' THEN 'LARGE SUMS' ELSE regexp_extract(content, '^Table [0-9]+: (.+)$', 1) END AS own, block = nb AND abs(size - ns) <= 0.5 AND NOT regexp_matches(nc, '(^Notes:|^Panel|^(Table|Figure|FIGURE) [0-9]|^[0-9.]+( [0-9.]+)*$)')
 AND ((abs(y0 - ny0) <= 1.5 AND nx0 - x1 BETWEEN 0 AND 30) OR (bold AND abs(x0 - nx0) <= 4 AND ny0 - y1 BETWEEN -1 AND 12)) AS apart FROM f),
u AS (SELECT *, lead(note) OVER (PARTITION BY paper_id, page ORDER BY line) AS noted FROM t WHERE note OR caption),
v AS (SELECT *, CASE WHEN own = '' AND apart THEN nc ELSE own END AS title, CASE WHEN content LIKE 'T%' THEN 'table' ELSE 'figure' END AS kind, split_part(replace(content, ':', ''), ' ', 2) AS label, own = '' AND apart AS joined FROM u WHERE caption),
shown AS (SELECT * FROM v WHERE title <> '' OR (kind = 'figure' AND coalesce(noted, FALSE)) QUALIFY row_number() OVER (PARTITION BY paper_id, page, kind, label ORDER BY line) = 1)"""


@query(_SHOWN + """
SELECT paper_id, page, line, kind, label, title, CASE WHEN joined THEN least(x0, nx0) ELSE x0 END AS x0, CASE WHEN joined THEN least(y0, ny0) ELSE y0 END AS y0, CASE WHEN joined THEN greatest(x1, nx1) ELSE x1 END AS x1, CASE WHEN joined THEN greatest(y1, ny1) ELSE y1 END AS y1 FROM shown""")
def positioned_captions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Supported captions of positioned lines, titles below or beside their label included."""
    return X.positioned_captions(_positioned(spark, sf_dir), ["paper_id", "page"])


_TRIMMED = "trim(x, ' ' || chr(9) || chr(13) || chr(12) || chr(11))"


@query(oracle(rf"""WITH cut AS (SELECT paper_id, page, unnest(range(1, len(parts) + 1)) AS line, unnest(parts) AS x FROM (SELECT paper_id, page, string_split(text, chr(10)) AS parts FROM marked_pages)),
t AS (SELECT *, {_TRIMMED} AS s, {SQUASH % "x"} AS q FROM cut), b AS (SELECT paper_id, min((page, line)) AS begins FROM t WHERE lower(s) IN ('references', 'bibliography') GROUP BY 1),
a AS (SELECT t.*, {_PARTS % "q"} AS c FROM t JOIN b ON t.paper_id = b.paper_id AND (t.page, t.line) > begins),
z AS (SELECT paper_id, min((page, line)) AS ends FROM a WHERE regexp_matches(s, '^(?i)([a-z]\s+)?(online )?appendix\b') OR {_is_caption("c")}
 OR regexp_matches(s, '^(?i)(for online publication only:?|([a-z]\s+)?((main|additional)\s+)?(figures(\s+and\s+tables)?|tables(\s+and\s+figures)?))$') GROUP BY 1),
r AS (SELECT a.paper_id, page, line, s, row_number() OVER (PARTITION BY a.paper_id ORDER BY page, line) AS k, NOT regexp_matches(x, '^[ \t]') AND regexp_matches(s, '{_AUTHOR}') AS opens,
 regexp_matches(s, '^(?i)(and\s*,|(,\s*)+(and\s+)?)..+') AS again, regexp_matches(s, '\b(19|20)[0-9][0-9][A-Za-z]?\b') AS dated
 FROM a LEFT JOIN z ON a.paper_id = z.paper_id WHERE s <> '' AND NOT regexp_matches(s, '^[0-9]+$') AND (ends IS NULL OR (page, line) < ends)),
w AS (SELECT paper_id, k, 1 AS entry, dated FROM r WHERE k = 1 UNION ALL
 SELECT r.paper_id, r.k, w.entry + CASE WHEN r.opens OR (r.again AND w.dated) THEN 1 ELSE 0 END, CASE WHEN r.opens OR (r.again AND w.dated) THEN r.dated ELSE r.dated OR w.dated END
 FROM w JOIN r ON r.paper_id = w.paper_id AND r.k = w.k + 1)
SELECT r.paper_id, CAST(entry AS INT) AS entry, CAST(arg_min(page, r.k) AS INT) AS start_page, CAST(arg_min(line, r.k) AS INT) AS start_line,
 regexp_replace(string_agg(s, ' ' ORDER BY r.k), '([A-Za-zÀ-ÖØ-öø-ÿ])-\s+([A-Za-zÀ-ÖØ-öø-ÿ])', '\1-\2', 'g') AS content FROM r JOIN w ON r.paper_id = w.paper_id AND r.k = w.k GROUP BY r.paper_id, entry""", "marked_pages"))
def reference_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.reference_entries(_pages(spark, sf_dir))


def _table_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    money = "CONCAT(o_orderpriority, ' ', CAST(o_orderkey % 97 AS STRING), '.5 (', CAST(o_custkey % 13 AS STRING), ')', IF(o_orderkey % 5 = 0, ' 12%', ''))"
    return Relations(spark, sf_dir).table("orders").selectExpr("o_custkey AS table_id", "o_orderkey AS line", f"{money} AS content")


@query("""WITH t AS (SELECT o_custkey AS table_id, o_orderkey AS line, o_orderpriority AS label, list_concat([CAST(o_orderkey % 97 AS VARCHAR) || '.5', '(' || CAST(o_custkey % 13 AS VARCHAR) || ')'],
 CASE WHEN o_orderkey % 5 = 0 THEN ['12%'] ELSE [] END) AS c FROM orders),
w AS (SELECT table_id, max(len(c))::INT AS width, min(len(c)) < max(len(c)) AS ragged, sum(len(c)) < 0.4 * count(*) * max(len(c)) AS sparse FROM t GROUP BY 1)
SELECT table_id, line, label, array_to_string(list_concat(c, CASE WHEN len(c) < width THEN [''] ELSE [] END), '|') AS cells, width, ragged, sparse FROM t JOIN w USING (table_id)""")
def table_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.table_rows(_table_lines(spark, sf_dir), ["table_id"]).withColumn("cells", F.array_join("cells", "|"))


# Lines of captioned tables, by order of a customer: rows of two or three cells, captions, panels, notes, figures, headings,
# names of columns, prose and blank lines.
_LINES = """CASE WHEN o_orderkey % 23 = 0 THEN 'Table 1: Wages by sex in 2010' WHEN o_orderkey % 46 = 3 THEN 'Notes: based on 120 rows 30 40' WHEN o_orderkey % 69 = 5 THEN '* p<0.1 ** 5'
  WHEN o_orderkey % 46 = 7 THEN 'Figure 2: Other 5' WHEN o_orderkey % 46 = 9 THEN 'Figure 3: Other sums' WHEN o_orderkey % 46 = 11 THEN 'IV. Results' WHEN o_orderkey % 23 = 13 THEN concat('Panel ', substring(o_orderpriority, 3, 1))
  WHEN o_orderkey % 23 = 15 THEN 'Model Ex. 1 Ex. 2' WHEN o_orderkey % 46 = 17 THEN '  ' WHEN o_orderkey % 46 = 19 THEN 'the sums here are those that all of the firms in this town had once, as said'
  WHEN o_orderkey % 46 = 21 THEN 'all of the firms' WHEN o_orderkey % 46 = 22 THEN 'the sums here are those that all of the firms had'
  ELSE concat(substring(o_orderpriority, 3, 20), '  ', CAST(o_orderkey % 97 AS VARCHAR(9)), '.5 (', CAST(o_custkey % 13 AS VARCHAR(9)), ')', CASE WHEN o_orderkey % 29 = 0 THEN ' 12%**' ELSE '' END) END"""
_CAPTIONED = f"SELECT o_custkey % 400 AS table_id, o_orderkey AS line, {_LINES} AS content FROM orders WHERE o_orderkey % 3 = o_custkey % 3"
# By where the first row, the first note and the first end below a row stand, not by running states.
_KEPT = rf"""WITH lines AS ({_CAPTIONED}), s AS (SELECT table_id, line, trim(regexp_replace(content, ' +', ' ', 'g')) AS s FROM lines),
t AS (SELECT *, regexp_extract(s, '((^| )(\(?-?[0-9][0-9,.]*\)?%?\**|[Yy]es|[Nn]o|-))+$') AS tail FROM s WHERE s <> ''),
k AS (SELECT *, CASE WHEN trim(tail) = '' THEN [] ELSE string_split(trim(tail), ' ') END AS cells, trim(left(s, length(s) - length(tail))) AS label, len(string_split(s, ' ')) AS words,
 regexp_matches(s, '^Table [0-9]+(: .*)?$') AS caption, regexp_matches(s, '^(Notes?:|\* p[ <])') AS note, regexp_matches(s, '^(Figure [0-9]+: |[IVX]+\. [A-Z])') AS ends FROM t),
n AS (SELECT k.*, coalesce(noted, 1e18) AS noted FROM k LEFT JOIN (SELECT table_id, min(line) AS noted FROM k WHERE note GROUP BY 1) USING (table_id)),
f AS (SELECT n.*, coalesce(first, 1e18) AS first FROM n LEFT JOIN (SELECT table_id, min(line) AS first FROM n WHERE line < noted AND NOT caption AND (len(cells) > 0 OR starts_with(s, 'Panel ') OR words <= 10) GROUP BY 1) USING (table_id)),
e AS (SELECT f.*, coalesce(stop, 1e18) AS stop FROM f LEFT JOIN (SELECT table_id, min(line) AS stop FROM f WHERE ends AND len(cells) = 0 AND line > first GROUP BY 1) USING (table_id)),
kept AS (SELECT * FROM e WHERE NOT caption AND line < noted AND line < stop AND line >= first)"""


def _captioned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Relations(spark, sf_dir).sql(_CAPTIONED)


@query(_KEPT + """
SELECT table_id, line, label, array_to_string(cells, '|') AS cells FROM kept""")
def captioned_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of tables whose lines hold captions, panels, notes, figures and headings too."""
    return X.captioned_rows(_captioned(spark, sf_dir), ["table_id"]).select("table_id", "line", "label", F.array_join("cells", "|").alias("cells"))


@query(_KEPT + r""", o AS (SELECT *, row_number() OVER (PARTITION BY table_id ORDER BY line) AS nr, string_split(replace(s, '. ', '.~'), ' ') AS names FROM kept),
w AS (SELECT table_id, count(*) AS n, coalesce(max(len(cells)) FILTER (WHERE nr > 1), 0) AS width, min_by(names, nr) AS names FROM o GROUP BY 1),
h AS (SELECT table_id, names, n > 1 AND width > 0 AND len(names) = width + 1 AND len(list_filter(names, lambda x: regexp_matches(x, '[A-Za-z]'))) >= 2 AS promoted FROM w),
b AS (SELECT o.*, promoted, h.names AS header, max(len(cells)) OVER (PARTITION BY o.table_id) AS most FROM o JOIN h USING (table_id) WHERE NOT promoted OR nr > 1),
g AS (SELECT table_id, any_value(promoted) AS promoted, any_value(most) AS most, any_value(header) AS header, bool_or(len(cells) <> most) AS ragged, bool_or(len(cells) = 0 AND words > 12) AS prose,
 string_agg(label || '|' || array_to_string(list_concat(cells, list_resize(CAST([] AS VARCHAR[]), most - len(cells), '')), '|'), chr(10) ORDER BY line) AS rows FROM b GROUP BY 1)
SELECT table_id, coalesce(CASE WHEN promoted THEN replace(array_to_string(header, '|'), '~', ' ') ELSE array_to_string(list_concat(['row_label'], list_transform(range(1, most + 1), lambda i: 'value_' || i)), '|') END, 'row_label') AS columns,
 coalesce(rtrim(rows, chr(0)), '') AS rows, coalesce(promoted, false) AS promoted,
 CASE WHEN rows IS NULL THEN 'caption_text_only' WHEN most = 0 THEN 'caption_text_unstructured' WHEN prose THEN 'caption_text_contaminated' ELSE 'caption_text_needs_visual_verification' END AS status,
 CASE WHEN rows IS NULL THEN 'no_structured_cells' ELSE concat_ws(' ', CASE WHEN most = 0 THEN 'no_value_columns' END, CASE WHEN ragged THEN 'ragged_rows' END, CASE WHEN prose THEN 'possible_prose_contamination' END) END AS flags
FROM (SELECT DISTINCT table_id FROM lines) LEFT JOIN g USING (table_id)""")
def structured_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tables of those lines with columns, padded rows, status and flags."""
    found = X.structured_tables(_captioned(spark, sf_dir), ["table_id"])
    rows = F.array_join(F.transform("rows", lambda r: F.when(F.size(r) == 1, F.concat(r[0], F.lit("|"))).otherwise(F.array_join(r, "|"))), "\n")
    return found.select("table_id", F.array_join("columns", "|").alias("columns"), rows.alias("rows"), "promoted", "status", F.array_join("flags", " ").alias("flags"))


@query(r"""SELECT page_id, regexp_replace(regexp_extract(url, 'https?://[^\s<>"\]]+'), '[.,;:]+$', '') AS urls, 'see ' || url AS section FROM pages WHERE regexp_matches(url, '^https?://[^\s<>"\]()]')""")
def report_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses of a report that names each page twice, once in brackets, and its section of sources."""
    pages = Relations(spark, sf_dir).table("pages").where(F.col("url").rlike(r'^https?://[^\s<>"\]()]'))
    report = F.concat(F.lit("# Report\n## Sources\nsee "), "url", F.lit("\n## Rest\n("), "url", F.lit(").\n"))
    return pages.select("page_id", F.array_join(X.urls(report), ",").alias("urls"), X.report_section(report, "Sources").alias("section"))


@query("""SELECT page_id, u.i AS row, u.c AS cell FROM (SELECT page_id, unnest([{'i': 0, 'c': page_id::VARCHAR}, {'i': 1, 'c': 'a|' || (page_id % 7)}]) AS u FROM pages)""")
def pipe_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells of Markdown tables with an escaped pipe."""
    report = F.concat(F.lit("| id | note |\n| "), F.col("page_id").cast("string"), F.lit(" | a\\|"), (F.col("page_id") % 7).cast("string"), F.lit(" |"))
    rows = Relations(spark, sf_dir).table("pages").select("page_id", F.element_at(X.pipe_table(report), 2).alias("c"))
    return rows.select("page_id", F.posexplode("c").alias("row", "cell"))


@query("""SELECT source, count(*) AS n_lines FROM (SELECT source, unnest(string_split(text, chr(10))) AS x FROM documents WHERE text IS NOT NULL AND source IS NOT NULL) GROUP BY 1""")
def source_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = Relations(spark, sf_dir).table("documents").where("source is not null")
    return L.lines(docs, ["source"]).groupBy("source").agg(F.count("*").alias("n_lines"))
