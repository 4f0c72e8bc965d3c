"""Extractors: citations, numbers, cross-references, sections, reference lists, captions, table rows, addresses."""

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.matching import of_rank, spans
from ..session import once, small_batches

# Patterns of citations in order of precedence, numbers, cross-references and marks of lists' borders.
CITATIONS = (
    r"\([A-Z][A-Za-z\x27`\-]+(?:\s+(?:and|&)\s+[A-Z][A-Za-z\x27`\-]+)?(?:\s+et al\.)?,\s*(?:19|20)\d{2}[a-z]?(?:\s*,\s*(?:19|20)\d{2}[a-z]?)+(?:;\s*[^)]*)?\)",
    r"\b[A-Z][A-Za-z\x27`\-]+(?:\s+et al\.)?\s*\((?:19|20)\d{2}[a-z]?(?:\s*,\s*(?:19|20)\d{2}[a-z]?)+\)",
    r"\([A-Z][A-Za-z'`\-]+(?:\s+(?:and|&)\s+[A-Z][A-Za-z'`\-]+)?(?:\s+et al\.)?,\s*(?:19|20)\d{2}[a-z]?(?:;\s*[^)]*)?\)",
    r"\b[A-Z][A-Za-z'`\-]+(?:\s+et al\.)?\s*\((?:19|20)\d{2}[a-z]?\)",
    r"\[[0-9,\-\s]+\]",
)
#: Every citation holds a year after a bracket or comma, or a bracket of digits.
CITATION_CUE = r"(?:19|20)\d{2}|\[[0-9,\-\s]+\]"
NUMBER = (
    r"(?<![\w.])(?:[$€£]\s*)?[-−]?(?:\d{1,3}(?:,\d{3})+(?:\.\d+)?|\d+\.\d+|\.\d+|\d+)"
    r"(?:\s?(?:%|pp|bps|bp|percent|percentage points|million|billion|trillion|k|m|bn))?(?![\w.])"
)
LABEL = r"(?:[A-Z]\.?)?\d+(?:\.\d+)*[A-Za-z]?|[A-Z](?:\.\d+)*"
KIND = r"Tables?|Figures?|Figs?\.|Sections?|Appendices|Appendixes|Appendix|Eqs?\.|Equations?"
CROSSREF = rf"\b(?P<kind>{KIND})\s+(?:\((?P<inside>{LABEL})\)(?![A-Za-z])|(?P<label>{LABEL})(?![A-Za-z]))"
SERIES = rf"\b(?P<kind>{KIND})\s+(?P<labels>\(?(?:{LABEL})\)?(?:\s*(?:,|and|or|to|through|[-–—])\s*\(?(?:{LABEL})\)?)+)"
LIST_START = r"(?i)^\s*(references|bibliography)\s*$"
APPENDIX_START = r"(?i)^\s*(?:(?:[A-Z]\s+)?(?:appendix|online appendix)\b|(?:appendix|online appendix)\s+[A-Z]\b)"
LIST_END = (
    r"(?i)^\s*(?:for online publication only:?|(?:[A-Z]\s+)?(?:(?:main|additional)\s+)?"
    r"(?:figures(?:\s+and\s+tables)?|tables(?:\s+and\s+figures)?))\s*$"
)
CAPTION = r"(?i)^\s*(Table|Figure|Fig\.)\s+((?:[A-Z]\.?)?\d+(?:\.\d+)?[A-Za-z]?)(?:\s*:\s*(.+?))?\s*$"
CAPTION_CAPITALS = r"^\s*(TABLE|FIGURE|FIG\.)\s+((?:[A-Z]\.?)?\d+(?:\.\d+)?[A-Za-z]?)\s+([A-Z][^\n]{2,}?)\s*$"
#: What a caption's line begins with, whatever white space it holds.
CAPTION_CUE = rf"(?i)^{T.SPACE}*(?:table|figure|fig\.)"
HEADING_WORDS = r"(?i)^(?:(?:abstract|introduction|conclusion|references|bibliography|appendix(?:es)?|online appendix)|[IVXLC]+\.\s+[A-Z].{0,120})$"
HEADING_LETTERED = r"^(?:[A-Z]\s+[A-Z].{0,120}|[A-Z]\.\d+(?:\.\d+)*\s+[A-Z].{0,120})$"
HEADING_NUMBER = r"^[1-9](?:\.\d+){0,4}$"
LINE_NUMBER = r"[-−]?(?:\d{1,3}(?:,\d{3})+|\d+)(?:\.\d+)?"
NOTE_START = r"(?i)^Notes?\s*:"
SPLIT_WORDS = {
    "table": "table", "tables": "table", "figure": "figure", "figures": "figure", "section": "section", "sections": "section",
    "appendix": "appendix", "appendices": "appendix", "equation": "equation", "equations": "equation",
}
#: A line that begins in lower case can head a section only with one of these.
LOWER_START = (
    r"^(?!(?i:abstract|introduction|conclusion|references|bibliography|appendix|online|for online|main|additional|figures|tables|[a-z]\s))\p{Ll}"
)
ENTRY_START = (
    r"^\s*(?:\[\d+\]\s*)?(?:[A-ZÀ-ÖØ-Þ][A-Za-zÀ-ÖØ-öø-ÿ'`.\-]+|(?:[Vv]an|[Vv]on|[Dd]e|[Dd]el|[Dd]a|[Dd]i|[Ll]e|[Ll]a)"
    r"\s+[A-ZÀ-ÖØ-Þ]?[A-Za-zÀ-ÖØ-öø-ÿ'`.\-]+)(?:,|\s+and\s+).{2,}"
)
REPEATED_AUTHOR = r"(?i)^(?:and\s*,|(?:,\s*)+(?:and\s+)?).{2,}"
YEAR = r"(?i)\b(?:19|20)\d{2}[a-z]?\b"
TABLE_NUMBER = r"[-−]?(?:(?:\d{1,3}(?:,\d{3})+|\d+)(?:\.\d+)?|\.\d+)"
CELL = rf"(?:\(\s*{TABLE_NUMBER}\s*,\s*{TABLE_NUMBER}\s*\)\**|\(\s*{TABLE_NUMBER}\s?(?:%|pp|bps|bp)?\s*\)\**|{TABLE_NUMBER}\s?(?:%|pp|bps|bp)?\**|(?i:yes|no)|[-–—]|✓)"
URL = r"https?://[^\s<>\"\]]+"


def list_ranges(pages: DataFrame, paper: str = "paper_id", page: str = "page", text: str = "text") -> DataFrame:
    """(paper, page, range_start, range_end): offsets of a page that lie in a reference list, which runs on over pages
    until an appendix or a closing section. The state is the last mark so far; a paper bounds a window."""
    rows = pages.select(paper, page, F.col(text).alias("_t"), F.posexplode(F.split(text, "\n", -1)).alias("line", "content"))
    inside = Window.partitionBy(paper, page).orderBy("line")
    ends = F.sum(F.length("content") + 1).over(inside)
    clean = T.squash(F.col("content"))
    mark = F.when(clean.rlike(LIST_START), "start").when(clean.rlike(APPENDIX_START) | clean.rlike(LIST_END), "end")
    rows = rows.select(paper, page, "line", (ends - F.length("content") - 1).alias("at"), ends.alias("next"), F.length("_t").alias("size"), mark.alias("mark"))
    so_far = Window.partitionBy(paper).orderBy(page, "line")
    state = F.last("mark", True).over(so_far)
    rows = rows.withColumn("state", state).withColumn("before", F.lag("state").over(so_far))
    opens = (F.col("state") == "start") & (F.coalesce(F.col("before"), F.lit("end")) != "start")
    rows = rows.withColumn("run", F.sum(F.when(opens, 1).otherwise(0)).over(so_far))
    return (
        rows.where("state = 'start'")
        .groupBy(paper, page, "run")
        .agg(F.min("at").alias("range_start"), F.max(F.least("next", "size")).alias("range_end"))
        .drop("run")
    )


def citations(pages: DataFrame) -> DataFrame:
    """Citations of each page: a pattern's match stands unless it starts in a reference list or overlaps one of an earlier
    pattern. The precedence is fixed, so the plan is: one pass of all patterns over pages that a built-in test lets through,
    one join with the lists, and for each pattern those of its matches that no kept one overlaps (a pattern's own do not)."""
    small_batches(pages.sparkSession)
    ranges = list_ranges(pages).groupBy("paper_id", "page").agg(F.collect_list(F.struct("range_start", "range_end")).alias("ranges"))
    some = pages.where(F.col("text").rlike(CITATION_CUE)).withColumn("found", spans(F.col("text"), *CITATIONS)).where(F.size("found") > 0)
    every = some.join(ranges, ["paper_id", "page"], "left")
    listed = lambda m: F.exists("ranges", lambda r: (m["start"] >= r["range_start"]) & (m["start"] < r["range_end"]))
    every = every.withColumn("found", F.filter("found", lambda m: ~F.coalesce(listed(m), F.lit(False)))).withColumn("kept", of_rank(F.col("found"), 0))
    for k in range(1, len(CITATIONS)):
        free = lambda m: ~F.exists("kept", lambda o: (o["start"] < m["end"]) & (m["start"] < o["end"]))
        every = every.withColumn("kept", F.concat("kept", F.filter(of_rank(F.col("found"), k), free)))
    rows = every.select("paper_id", "page", "text", F.explode("kept").alias("m"))
    start, end = F.col("m.start"), F.col("m.end")
    return rows.select(
        "paper_id", "page", "m.match", start.alias("match_start"), end.alias("match_end"), "m.rank",
        T.line_number(F.col("text"), start).alias("line_number"), T.context(F.col("text"), start, end).alias("context"),
    )


#: The pattern of numbers as Java's expressions need it: letters, digits and white space are those of Unicode. Most characters
#: fail the first look at what a number can begin with.
_HEAD, _UNIT = NUMBER.replace(r"\w", r"\p{L}\p{N}_").replace(r"\d", r"\p{Nd}").replace(r"\s", T.SPACE).split("(?:" + T.SPACE + "?(?:%", 1)
NUMBER_BUILT_IN = r"(?=[0-9.$€£\-−\p{Nd}])" + _HEAD + "(?:" + T.SPACE + "?(?iu:(?:%" + _UNIT.replace("))?(?!", ")))?(?!")
#: Private characters: one marks the ends of matches, the other stands for it where a text holds it.
MARK, STAND_IN = "\ue000", "\ue001"


def located(text: Column, pattern: str) -> Column:
    """array of (match, start, end), offsets in characters from 0, of a pattern of built-in expressions. The text's matches
    are marked in one pass, so that its parts are what stands between matches and matches by turns; the lengths of the
    parts before a match are its offset."""
    parts = F.split(F.regexp_replace(F.translate(text, MARK, STAND_IN), pattern, f"{MARK}$0{MARK}"), MARK, -1)
    kind = "struct<at:int,found:array<struct<match:string,start:int,end:int>>>"
    start = F.struct(F.lit(0).alias("at"), F.array().alias("found")).cast(kind)

    def step(s: Column, x: Column) -> Column:
        ends = s["at"] + F.length(x["part"])
        one = F.struct(x["part"].alias("match"), s["at"].alias("start"), ends.alias("end"))
        return F.struct(ends.alias("at"), F.when(x["i"] % 2 == 1, F.array_append(s["found"], one)).otherwise(s["found"]).alias("found")).cast(kind)

    return F.aggregate(F.transform(parts, lambda x, i: F.struct(x.alias("part"), i.alias("i"))), start, step, lambda s: s["found"])


def numbers(pages: DataFrame) -> DataFrame:
    """(paper_id, page, match_start, match_end, line_number, context, number) of the numbers of each page, with their units."""
    rows = pages.where(F.col("text").rlike(r"\p{Nd}")).select("paper_id", "page", "text", F.explode(located(F.col("text"), NUMBER_BUILT_IN)).alias("m"))
    start, end = F.col("m.start"), F.col("m.end")
    return rows.select(
        "paper_id", "page", start.alias("match_start"), end.alias("match_end"), T.line_number(F.col("text"), start).alias("line_number"),
        T.context(F.col("text"), start, end, 80).alias("context"), F.trim("m.match").alias("number"),
    )


def crossrefs(pages: DataFrame, raw: str = "text") -> DataFrame:
    """Cross-references once for each page, kind and label: those of series first, then single ones, then supported caption
    lines of the column `raw` (the page's text before it is normalised)."""
    small_batches(pages.sparkSession)
    found = pages.select("paper_id", "page", F.explode(spans(F.col("text"), SERIES, CROSSREF, flags=re.IGNORECASE)).alias("m"))
    groups = F.col("m.groups")
    # A series has the labels of its list, a single one its own: texts are searched once for both.
    listed = F.transform(
        spans(groups["labels"], rf"\(?(?P<label>{LABEL})\)?"),
        lambda x: F.struct((F.col("m.end") - F.length(groups["labels"]) + x["start"] + x["match"].startswith("(").cast("int")).alias("at"), x["groups"]["label"].alias("label")),
    )
    own = F.array(F.struct(F.col("m.start").alias("at"), F.coalesce(groups["label"], groups["inside"]).alias("label")))
    told = found.select(
        "paper_id", "page", groups["kind"].alias("kind"), F.col("m.match").alias("reference_text"), F.col("m.rank").alias("source"), F.inline(F.when(F.col("m.rank") == 0, listed).otherwise(own))
    )
    told = told.where(T.valid_crossref_label(F.col("kind"), F.col("label"))).withColumn("kind", T.crossref_kind(F.col("kind")))
    told = told.select("paper_id", "page", "kind", "reference_text", "at", "label", "source")
    shown = pages.select("paper_id", "page", F.col(raw).alias("text"))
    below = _caption_lines(shown, capitals=False, placed=True).select(
        "paper_id", "page", "kind", F.concat_ws(" ", F.initcap("kind"), "label").alias("reference_text"), "at", "label", F.lit(2).alias("source")
    )
    first = told.unionByName(below).groupBy("paper_id", "page", "kind", "label").agg(F.min(F.struct("source", "at", "reference_text")).alias("m"))
    return first.select("paper_id", "page", "kind", "label", "m.source", "m.at", "m.reference_text")


def split_words(pages: DataFrame) -> DataFrame:
    """Cross-references whose word is split over a page's end: a line that ends in letters and a hyphen, and one of the
    next page's first twenty lines that goes on with the rest and a label. The first that makes a known word decides; a
    reference that the page has otherwise, or on an earlier such line, is none."""
    cut = pages.select("paper_id", "page", F.posexplode(F.split("text", "\n", -1)).alias("line", "content"))
    cut = cut.withColumn("content", F.trim("content")).withColumn("line", F.col("line") + 1)
    left = cut.select("paper_id", "page", "line", F.regexp_extract("content", r"\b([A-Za-z]{2,})-$", 1).alias("left")).where("left <> ''")
    full = cut.where("content <> ''")
    order = Window.partitionBy("paper_id", "page").orderBy("line")
    heads = full.withColumn("k", F.row_number().over(order)).where("k <= 20")
    pattern = rf"^([a-z]{{2,}})\s+({LABEL})(?![A-Za-z])"
    right = heads.select("paper_id", (F.col("page") - 1).alias("page"), "k", F.regexp_extract("content", pattern, 1).alias("right"), F.regexp_extract("content", pattern, 2).alias("label"))
    known = F.create_map(*[F.lit(v) for pair in SPLIT_WORDS.items() for v in pair])
    both = left.join(right.where("right <> ''"), ["paper_id", "page"]).withColumn("kind", F.try_element_at(known, F.lower(F.concat("left", "right"))))
    sound = both.where(F.col("kind").isNotNull() & T.valid_crossref_label(F.col("kind"), F.col("label")))
    best = sound.groupBy("paper_id", "page", "line").agg(F.min(F.struct("k", "kind", "label")).alias("m")).select("paper_id", "page", "line", "m.kind", "m.label")
    fresh = best.join(crossrefs(pages).select("paper_id", "page", "kind", "label"), ["paper_id", "page", "kind", "label"], "left_anti")
    return fresh.groupBy("paper_id", "page", "kind", "label").agg(F.min("line").alias("line")).select("paper_id", "page", "line", "kind", "label")


def is_caption(line: Column) -> Column:
    """Whether a line has a caption's form: a label with a colon or alone, or capitals without a colon."""
    return line.rlike(CAPTION) | line.rlike(CAPTION_CAPITALS)


def panel_label(line: Column, squashed: bool = False) -> Column:
    """The label, in lower case, of a line that begins a table's panel; null for others."""
    label = F.lower(F.regexp_extract(line if squashed else T.squash(line), r"(?i)^\s*Panel\s+([A-Za-z0-9]+)\s*(?::|\b)", 1))
    return F.when(label != "", label)


def table_or_axis_line(line: Column, squashed: bool = False) -> Column:
    """Whether a line is a table's or an axis's: a row of sample sizes, several panels' letters, a category repeated after
    numbers, a caption, or three numbers among eight words at most. A squashed line is not squashed once more a test."""
    s = line if squashed else T.squash(line)
    return F.coalesce(
        s.rlike(rf"(?i)^N(?:\s+{LINE_NUMBER}){{2,}}$")
        | (F.regexp_count(s, F.lit(r"(?:^|\s)[A-Z]\s+(?=[A-Z][A-Za-z])")) >= 2)
        | s.rlike(r"(?i)^\d+(?:\.\d+)?\s+(?<label>[A-Za-z][A-Za-z-]*)(?:\s+\d+(?:\.\d+)?\s+\k<label>)+$")
        | is_caption(s)
        | ((F.regexp_count(s, F.lit(LINE_NUMBER)) >= 3) & (F.regexp_count(s, F.lit("[A-Za-z]+")) <= 8)),
        F.lit(False),
    )


def is_heading(line: Column, squashed: bool = False) -> Column:
    """Whether a line can head a section: a list's start or end, an appendix, a bare name such as Introduction, a roman or
    lettered number, a number from 1 to 9 with a title of twelve words at most, or two to twelve different capital words.

    Most lines of prose fail the quick tests, so that the dear ones are left out. A squashed line is taken as it is: nothing
    shares what the tests of a filter have in common."""
    s = line if squashed else T.squash(line)
    words = F.size(F.split(s, " "))
    title = F.regexp_extract(s, r"^[0-9]+(?:\.[0-9]+)*\s+([A-Z].*)$", 1)
    capitals = F.regexp_extract_all(s, F.lit("([A-Z]+)"), 1)
    spaced = s.rlike(r"^(?:[A-Z]\s+){3,}[A-Z](?:\s|$)") | s.rlike(r"^(?:[A-Z]\s+)+[A-Z]$") | s.rlike(r"^(?:[A-Z]\.\s*){2,}")
    refused = (
        spaced | s.rlike(r"(?i)^(?:EDITED|REVIEWED|APPROVED)\s+BY$") | s.rlike(r"[=<>≤≥≈≠‰]")
        | (s.rlike(APPENDIX_START) & (s.contains(",") | (words > 12))) | table_or_axis_line(s, True)
    )
    numbered = s.rlike(r"^0*[1-9](?:\.[0-9]+)*\s") & (F.size(F.split(title, " ")) <= 12) & ~title.rlike(r"\.\s+\S") & ~title.rlike(r"^(?:NOK|USD|EUR|GBP)\b")
    shout = (s == F.upper(s)) & s.rlike(r"\p{Lu}") & words.between(2, 12) & (F.size(F.array_distinct(capitals)) == F.size(capitals))
    small_roman = s.rlike(r"(?i)^[IVXLC]+\.\s+") & ~s.rlike(r"^[IVXLC]+\.\s+")
    accepted = (
        F.when(s.rlike(LIST_END) | s.rlike(LIST_START) | s.rlike(APPENDIX_START), True)
        .when(small_roman, False)
        .when(s.rlike(HEADING_WORDS) | s.rlike(HEADING_LETTERED), True)
        .when(title != "", numbered)
        .otherwise(shout)
    )
    plausible = F.length(s).between(1, 140) & ~s.rlike(r"[.,;:]$") & ~s.rlike(LOWER_START)
    return F.coalesce(F.when(plausible, ~refused & accepted), F.lit(False))


def continues_heading(heading: Column, line: Column, squashed: bool = False) -> Column:
    """Whether a line goes on with a heading: short, no heading or table line itself, after a colon or in lower case."""
    s = line if squashed else T.squash(line)
    good = F.length(s).between(1, 80) & (F.rtrim(heading).endswith(":") | s.rlike(r"^\p{Ll}"))
    return F.coalesce(F.when(good, ~is_heading(s, True) & ~table_or_axis_line(s, True) & ~s.rlike("^[0-9]+$")), F.lit(False))


#: Points that a heading's number and title may differ in height, and lie apart.
SAME_HEIGHT, APART = 1.5, 42


def numbered_headings(lines: DataFrame) -> DataFrame:
    """(paper_id, page, number, title): bold numbers with the nearest bold title to their right on the same height, from
    positioned lines (paper_id, page, line, content, x0, y0, x1, y1, bold).

    Heights are bands of the join's key, and a number asks in its own band and in both beside it, so a page's lines meet
    those of their height alone and not each other."""
    c = F.col
    bold = once(lines.where("bold"), content=T.squash(c("content"))).withColumn("band", F.floor(c("y0") / SAME_HEIGHT))
    near = F.explode(F.array(c("band") - 1, c("band"), c("band") + 1))
    numbers = bold.where(c("content").rlike(HEADING_NUMBER)).withColumn("band", near).alias("n")
    good = F.length("content").between(1, 120) & c("content").rlike(r"^\p{Lu}") & ~c("content").rlike(r"[.,;:]$") & ~is_caption(c("content"))
    titles = bold.where(good).alias("t")
    gap = c("t.x0") - c("n.x1")
    same = [c(f"n.{k}") == c(f"t.{k}") for k in ("paper_id", "page", "band")]
    both = numbers.join(titles, [*same, (F.abs(c("t.y0") - c("n.y0")) <= SAME_HEIGHT) & gap.between(0, APART)])
    key = [c(f"n.{k}").alias(k) for k in ("paper_id", "page", "line")]
    best = both.groupBy(*key, c("n.content").alias("number")).agg(F.min(F.struct(gap.alias("gap"), c("t.line").alias("at"), c("t.content").alias("title"))).alias("m"))
    return best.select("paper_id", "page", "number", "m.title")


def squashed_lines(pages: DataFrame, placed: bool = False) -> DataFrame:
    """(paper_id, page, line, s, a, b) of the pages' lines: squashed once, with the two lines after each as they are; where they
    are placed, also at, the offset in the text of a line that begins like a caption. What is
    tested of a line is a plain column then, so the tests run in generated code and stop at the first that fails."""
    lines = F.split("text", "\n", -1).alias("lines")
    pages = pages.select("paper_id", "page", lines, "text") if placed else pages.select("paper_id", "page", lines)
    start = lambda i: F.length(F.call_function("substring_index", F.col("text"), F.lit("\n"), i)) + F.least(i, F.lit(1))
    at = lambda x, i: [F.when(x.rlike(CAPTION_CUE), start(i)).alias("at")] if placed else []
    row = lambda x, i: F.struct((i + 1).alias("line"), T.squash(x).alias("s"), F.get("lines", i + 1).alias("a"), F.get("lines", i + 2).alias("b"), *at(x, i))
    return pages.select("paper_id", "page", F.inline(F.transform("lines", row)))


def sections(pages: DataFrame, numbered: DataFrame | None = None) -> DataFrame:
    """(paper_id, heading, start_page, start_line, end_page, end_line): a heading's section ends where the next begins,
    a line before it (unknown on a first line); the last ends on the paper's last page. A heading takes in the next line,
    or the one after a blank line, if that goes on with it. numbered (paper_id, page, number, title) tells of numbers
    that stand on a line of their own before their title. Headings alone are sorted."""
    c, rows = F.col, squashed_lines(pages)
    after = F.when(T.squash(F.coalesce("a", F.lit(""))) == "", F.coalesce("b", F.lit(""))).otherwise(c("a"))
    if numbered is None:
        found = rows.where(is_heading(c("s"), True)).withColumn("after", after)
    else:
        some = numbered.groupBy("paper_id", "page").agg(F.collect_set(F.struct("number", "title")).alias("numbered"))
        order = Window.partitionBy("paper_id", "page").orderBy("line")
        full = rows.withColumn("after", after).where("s <> ''").withColumn("_next", F.lead("s", 1, "").over(order)).withColumn("_before", F.lag("s", 1, "").over(order))
        told = full.join(some, ["paper_id", "page"], "left")
        own = c("s").rlike(HEADING_NUMBER) & F.exists("numbered", lambda n: (n["number"] == c("s")) & (n["title"] == c("_next")))
        taken = F.exists("numbered", lambda n: (n["title"] == c("s")) & (n["number"] == c("_before")))
        told = told.withColumn("own", F.coalesce(own, F.lit(False))).where(c("own") | ~F.coalesce(taken, F.lit(False)) & is_heading(c("s"), True))
        found = told.withColumn("s", F.when(c("own"), F.concat_ws(" ", "s", "_next")).otherwise(c("s"))).withColumn("after", F.when(~c("own"), c("after")))
    found = once(found, after=T.squash(F.coalesce("after", F.lit(""))))
    longer = F.when(continues_heading(c("s"), c("after"), True), F.concat(F.lit(" "), "after")).otherwise("")
    heads = found.select("paper_id", "page", "line", F.concat("s", longer).alias("heading"))
    last = pages.groupBy("paper_id").agg(F.max("page").alias("_last"))
    order = Window.partitionBy("paper_id").orderBy("page", "line")
    out = heads.withColumn("_p", F.lead("page").over(order)).withColumn("_l", F.lead("line").over(order)).join(last, "paper_id")
    return out.select(
        "paper_id", "heading", c("page").alias("start_page"), c("line").alias("start_line"),
        F.coalesce("_p", "_last").alias("end_page"), F.when(c("_l") > 1, c("_l") - 1).alias("end_line"),
    )


def reference_entries(pages: DataFrame) -> DataFrame:
    """(paper_id, entry, start_page, start_line, content): lines after a paper's first list start, up to an appendix, a
    closing section or a caption, folded into entries; page numbers are left out. A line opens an entry if it begins like
    an author and isn't indented, or repeats the author of an entry that has its year. The test needs the entry so far,
    so it is a fold over a paper, which bounds a group."""
    start, appendix, end, caption, capitals = (re.compile(p) for p in (LIST_START, APPENDIX_START, LIST_END, CAPTION, CAPTION_CAPITALS))
    author, repeated, year = re.compile(ENTRY_START), re.compile(REPEATED_AUTHOR), re.compile(YEAR)
    closes = (appendix, end, caption, capitals)

    def fold(group: pd.DataFrame) -> pd.DataFrame:
        some = group.sort_values("page")
        lines = [(page, k, line) for page, text in zip(some["page"], some["text"], strict=True) for k, line in enumerate((text or "").split("\n"), 1)]
        begin = next((i for i, x in enumerate(lines) if start.match(x[2].strip())), len(lines))
        entries: list[tuple[int, int, list[str]]] = []
        for page, k, line in lines[begin + 1 :]:
            clean = line.strip()
            if any(p.match(clean) for p in closes):
                break
            if not clean or clean.isdigit():
                continue
            opens = not line.startswith((" ", "\t")) and author.match(clean)
            if not entries or opens or (repeated.match(clean) and year.search(" ".join(entries[-1][2]))):
                entries.append((page, k, []))
            entries[-1][2].append(clean)
        rows = [(group["paper_id"].iloc[0], i, p, k, " ".join(parts)) for i, (p, k, parts) in enumerate(entries, 1)]
        return pd.DataFrame(rows, columns=["paper_id", "entry", "start_page", "start_line", "content"])

    found = pages.where(F.col("text").rlike(r"(?im)^\s*(references|bibliography)\s*$")).select("paper_id").distinct()
    some = pages.join(found, "paper_id", "left_semi").select("paper_id", "page", "text")
    out = some.groupBy("paper_id").applyInPandas(fold, "paper_id string, entry int, start_page int, start_line int, content string")
    return out.withColumn("content", T.join_hyphens(F.array("content")))


def supported_captions(lines: DataFrame, keys: list[str], capitals: bool = True) -> DataFrame:
    """keys, line, kind, label and title of supported captions among lines (line, s squashed, and maybe below, a title that
    stands apart): those with a title, and a figure's bare label that a note follows before the next caption."""
    c = F.col
    part = lambda p, k: F.regexp_extract("s", p, k)
    marks = lines.withColumn("_note", c("s").rlike(NOTE_START)).withColumn("_caption", is_caption(c("s"))).where("_note OR _caption")
    marks = marks.withColumn("_noted", F.lead("_note", 1, False).over(Window.partitionBy(*keys).orderBy("line")))
    plain = part(CAPTION, 2) != ""
    below = F.coalesce("below", F.lit("")) if "below" in lines.columns else F.lit("")
    own = F.trim(F.when(c("_plain"), part(CAPTION, 3)).otherwise(part(CAPTION_CAPITALS, 3)))
    rows = marks.where("_caption").withColumn("_plain", plain).withColumn("title", F.when(own == "", below).otherwise(own))
    kind = F.when(F.lower(F.when(c("_plain"), part(CAPTION, 1)).otherwise(part(CAPTION_CAPITALS, 1))) != "table", "figure").otherwise("table")
    label = F.when(c("_plain"), part(CAPTION, 2)).otherwise(part(CAPTION_CAPITALS, 2))
    rows = rows.withColumn("kind", kind).where((c("title") != "") | ((c("kind") == "figure") & c("_noted")))
    place = ["at"] if "at" in lines.columns else []
    return (rows if capitals else rows.where("_plain")).select(*keys, "line", "kind", label.alias("label"), "title", *place)


def caption_cue(text: Column) -> Column:
    """Whether a text can hold a caption's line."""
    return text.rlike(r"(?im)^\s*(?:table|figure|fig\.)\s+(?:[a-z]\.?)?\d")


def caption_parts(line: Column) -> Column:
    """struct(kind, label, title) of a squashed line in a caption's form."""
    part = lambda p, k: F.regexp_extract(line, p, k)
    pick = lambda k: F.when(part(CAPTION, 2) != "", part(CAPTION, k)).otherwise(part(CAPTION_CAPITALS, k))
    return F.struct(F.when(F.lower(pick(1)) != "table", "figure").otherwise("table").alias("kind"), pick(2).alias("label"), F.trim(pick(3)).alias("title"))


def _caption_lines(pages: DataFrame, capitals: bool, placed: bool = False) -> DataFrame:
    """(paper_id, page, line, kind, label, title, and where they are placed at) of the pages' supported captions; pages without a
    line like one are left out."""
    return supported_captions(squashed_lines(pages.where(caption_cue(F.col("text"))), placed).drop("a", "b"), ["paper_id", "page"], capitals)


def captions(pages: DataFrame) -> DataFrame:
    """(paper_id, page, kind, label, title, line) of supported captions, the first for each kind and label of a page."""
    some = _caption_lines(pages, capitals=True)
    first = some.groupBy("paper_id", "page", "kind", "label").agg(F.min(F.struct("line", "title")).alias("m"))
    return first.select("paper_id", "page", "kind", "label", "m.title", "m.line")


def _goes_below(label, title) -> tuple[Column, Column]:
    """Whether the line whose columns title(name) gives is the title of the bare label of label(name): of the same block and size,
    on the same row, or under a bold label at the same left edge; and whether it is on the same row."""
    alike = (label("block") == title("block")) & (F.abs(label("size") - title("size")) <= 0.5)
    beside = alike & (F.abs(label("y0") - title("y0")) <= 1.5) & (title("x0") - label("x1")).between(0, 30)
    under = label("bold") & (F.abs(label("x0") - title("x0")) <= 4) & (title("y0") - label("y1")).between(-1, 12)
    s = title("content")
    fits = F.length(s).between(1, 220) & s.rlike("[A-Za-z]") & ~is_caption(s) & ~s.rlike(r"(?i)^(?:Notes?\s*:|Panel\b)") & ~table_or_axis_line(s, True)
    return F.coalesce(alike & (beside | under) & fits, F.lit(False)), F.coalesce(beside, F.lit(False))


def titles_below(lines: DataFrame, keys: list[str]) -> DataFrame:
    """keys, line, title, same_row and the title's box (tx0, ty0, tx1, ty1): captions of a bare label whose title is the next line:
    of the same block and size, on the same row, or under a bold label at the same left edge. lines are (line, content, x0, y0,
    x1, y1, size, bold, block)."""
    c, order = F.col, Window.partitionBy(*keys).orderBy("line")
    parts = ("content", "x0", "y0", "x1", "y1", "size", "block")
    rows = lines.withColumn("content", T.squash(c("content"))).withColumns({f"_{p}": F.lead(p).over(order) for p in parts})
    bare = c("content").rlike(CAPTION) & (F.trim(F.regexp_extract("content", CAPTION, 3)) == "")
    fits, beside = _goes_below(c, lambda p: c(f"_{p}"))
    return rows.where(bare & fits).select(*keys, "line", c("_content").alias("title"), beside.alias("same_row"), *(c(f"_{x}").alias(f"t{x}") for x in parts[1:5]))


def caption_runs(lines: DataFrame, keys: list[str]) -> DataFrame:
    """keys, line, kind, label, title, apart, lines and next of the supported captions of positioned lines (line, content, x0, y0,
    x1, y1, size, bold, block), the first of a kind and label on a page. lines are the caption's and all up to the next caption
    that aren't blank; apart says that the title is the line after a bare label, next: of the same block and size, on the same
    row, or under a bold label at the same left edge.

    Lines are squashed once and a page's meet once: what follows a caption is looked up in a window, its run is a group of the
    same page, and nothing is joined."""
    c, parts = F.col, ("line", "content", "x0", "y0", "x1", "y1", "size", "block")
    order = Window.partitionBy(*keys).orderBy("line")
    rows = lines.select(*keys, "line", T.squash(c("content")).alias("content"), *parts[2:], "bold").withColumn("_next", F.lead(F.struct(*parts)).over(order))
    rows = once(rows, _caption=F.coalesce(is_caption(c("content")), F.lit(False)))
    rows = rows.withColumn("_run", F.sum(c("_caption").cast("int")).over(order)).where("_run > 0 AND content <> ''")
    some = rows.groupBy(*keys, "_run").agg(
        F.array_sort(F.collect_list(F.struct(*parts))).alias("lines"), F.max(F.when(c("_caption"), F.struct("line", "content", *parts[2:], "bold"))).alias("h"),
        F.max(F.when(c("_caption"), F.struct("line", "_next")))["_next"].alias("next"), F.max(~c("_caption") & c("content").rlike(NOTE_START)).alias("noted"),
    )
    below, _ = _goes_below(lambda p: c(f"h.{p}"), lambda p: c(f"next.{p}"))
    part = lambda p, k: F.regexp_extract("h.content", p, k)
    some = once(some, plain=part(CAPTION, 2) != "")
    kind = F.when(F.lower(F.when(c("plain"), part(CAPTION, 1)).otherwise(part(CAPTION_CAPITALS, 1))) != "table", "figure").otherwise("table")
    pick = lambda k: F.when(c("plain"), part(CAPTION, k)).otherwise(part(CAPTION_CAPITALS, k))
    some = once(some, kind=kind, label=pick(2), title=F.trim(pick(3)))
    some = once(some, apart=F.coalesce(c("plain") & (c("title") == "") & below, F.lit(False)))
    some = some.withColumn("title", F.when(c("apart"), c("next.content")).otherwise(c("title"))).where((c("title") != "") | ((c("kind") == "figure") & c("noted")))
    first = F.row_number().over(Window.partitionBy(*keys, "kind", "label").orderBy("h.line"))
    return some.withColumn("_first", first).where("_first = 1").select(*keys, "h.line", "kind", "label", "title", "apart", "lines", "h", "next")


def positioned_captions(lines: DataFrame, keys: list[str]) -> DataFrame:
    """keys, line, kind, label, title and box (x0, y0, x1, y1) of supported captions among positioned lines, a title below or
    beside its label included, whose box then holds both; the first of a kind and label of a page."""
    with_next = lambda f, x: F.when(F.col("apart"), f(f"h.{x}", f"next.{x}")).otherwise(F.col(f"h.{x}"))
    box = [with_next(F.least if x in ("x0", "y0") else F.greatest, x).alias(x) for x in ("x0", "y0", "x1", "y1")]
    return caption_runs(lines, keys).select(*keys, "line", "kind", "label", "title", *box)


def trailing_cells(c: Column) -> Column:
    """struct(label, cells): the cells that a table line ends with, and what stands before them."""
    tail = F.regexp_extract(c, rf"((?:(?:^|\s+){CELL}(?=\s|$))+)\s*$", 1)
    label = F.trim(F.substring(F.rtrim(c), F.lit(1), F.length(F.rtrim(c)) - F.length(tail)))
    return F.struct(label.alias("label"), F.regexp_extract_all(tail, F.lit(rf"({CELL})(?=\s|$)"), 1).alias("cells"))


def captioned_rows(lines: DataFrame, keys: list[str], content: str = "content", line: str = "line") -> DataFrame:
    """keys, line, label, cells and source of the lines below a table's caption that are its rows.

    A line with cells is a row, so is one without that begins with Panel or has ten words at most, and any once there is a
    row. Blank lines and table captions are none; a note (`Note:`, `Notes:`, stars of significance) ends the table, and so
    does, below a row, a line without cells that is a heading or a figure's caption. Kinds of lines are one projection, what
    stands above is running maxima of one window over a table's lines."""
    s, c = T.squash(F.col(content)), F.col
    words = F.size(F.split("_s", " "))
    note = c("_s").rlike(NOTE_START) | c("_s").startswith("* p ") | c("_s").startswith("* p<")
    figure = c("_s").rlike(CAPTION) & ~c("_s").rlike(r"(?i)^table\b")
    rows = lines.select(*keys, line, s.alias("_s")).where("_s <> ''").withColumn("_note", note)
    rows = rows.withColumn("_t", trailing_cells(c("_s"))).withColumn("_caption", c("_s").rlike(CAPTION) & c("_s").rlike(r"(?i)^table\b"))
    rows = rows.withColumn("_own", ~c("_caption") & ((F.size("_t.cells") > 0) | c("_s").startswith("Panel ") | (words <= 10)))
    rows = rows.withColumn("_end", F.when(~c("_caption") & (F.size("_t.cells") == 0), figure | is_heading(c("_s"), True)).otherwise(False))
    order = Window.partitionBy(*keys).orderBy(line)
    here, above = order.rowsBetween(Window.unboundedPreceding, 0), order.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_noted", F.max("_note").over(here))
    rows = rows.withColumn("_begun", F.coalesce(F.max(c("_own") & ~c("_noted")).over(above), F.lit(False)))
    rows = rows.withColumn("_ended", F.max(c("_noted") | (c("_begun") & c("_end"))).over(here))
    kept = rows.where(~c("_ended") & ~c("_caption") & (c("_own") | c("_begun")))
    return kept.select(*keys, line, "_t.label", "_t.cells", c("_s").alias("source"))


def table_rows(lines: DataFrame, keys: list[str], content: str = "content", line: str = "line") -> DataFrame:
    """keys, line, label, cells, width and flags of a table's rows: cells padded to the table's width; ragged says that
    rows differ, sparse that under two fifths of the cells are filled."""
    rows = captioned_rows(lines, keys, content, line).drop("source")
    sizes = rows.groupBy(*keys).agg(
        F.max(F.size("cells")).alias("width"), (F.min(F.size("cells")) < F.max(F.size("cells"))).alias("ragged"),
        (F.sum(F.size("cells")) < F.lit(0.4) * F.count("*") * F.max(F.size("cells"))).alias("sparse"),
    )
    padded = F.concat("cells", F.array_repeat(F.lit(""), F.col("width") - F.size("cells")))
    return rows.join(sizes, keys).select(*keys, line, "label", padded.alias("cells"), "width", "ragged", "sparse")


def header_names(source: Column) -> Column:
    """The names of a header line: its words, one that ends with a stop together with a number after it."""
    return F.regexp_extract_all(source, F.lit(r"(\S*\. \d+[A-Za-z]?(?!\S)|\S+)"), 1)


def structured_tables(lines: DataFrame, keys: list[str], content: str = "content", line: str = "line") -> DataFrame:
    """keys, columns, rows, promoted, status and flags, one row a table of lines below a caption.

    The first row names the columns if it has a name for the label and each value of the other rows, two of them with
    letters. Rows are label and cells, padded. flags: no_structured_cells (no row), no_value_columns, ragged_rows,
    possible_prose_contamination (a row without cells of more than twelve words); status says what they amount to."""
    rows = captioned_rows(lines, keys, content, line)
    listed = F.array_sort(F.collect_list(F.struct(line, "label", "cells", "source")))
    every = lines.select(*keys).distinct()
    one = every.join(rows.groupBy(*keys).agg(listed.alias("r")), keys, "left").withColumn("r", F.coalesce("r", F.array().cast(f"array<struct<{line}:{lines.schema[line].dataType.simpleString()},label:string,cells:array<string>,source:string>>")))
    widest = lambda x: F.coalesce(F.array_max(F.transform(x, lambda y: F.size(y["cells"]))), F.lit(0))
    rest = F.slice("r", 2, F.greatest(F.size("r"), F.lit(1)))
    one = one.withColumn("_names", header_names(F.coalesce(F.get("r", F.lit(0))["source"], F.lit("")))).withColumn("_width", widest(rest))
    letters = F.size(F.filter("_names", lambda n: n.rlike(r"\p{L}")))
    one = one.withColumn("promoted", (F.size("r") > 1) & (F.col("_width") > 0) & (F.size("_names") == F.col("_width") + 1) & (letters >= 2))
    one = one.withColumn("b", F.when(F.col("promoted"), rest).otherwise(F.col("r"))).withColumn("_most", widest(F.col("b")))
    values = F.when(F.col("_most") > 0, F.transform(F.sequence(F.lit(1), F.greatest("_most", F.lit(1))), lambda i: F.concat(F.lit("value_"), i.cast("string")))).otherwise(F.array().cast("array<string>"))
    columns = F.when(F.col("promoted"), F.col("_names")).otherwise(F.concat(F.array(F.lit("row_label")), values))
    padded = F.transform("b", lambda x: F.concat(F.array(x["label"]), x["cells"], F.array_repeat(F.lit(""), F.col("_most") - F.size(x["cells"]))))
    prose = F.exists("b", lambda x: (F.size(x["cells"]) == 0) & (F.size(F.split(x["source"], " ")) > 12))
    named = {"no_value_columns": F.col("_most") == 0, "ragged_rows": F.exists("b", lambda x: F.size(x["cells"]) != F.col("_most")), "possible_prose_contamination": prose}
    flags = F.array_compact(F.array(*(F.when(v, F.lit(k)) for k, v in named.items())))
    none = F.size("b") == 0
    status = (
        F.when(none, "caption_text_only").when(F.col("_most") == 0, "caption_text_unstructured").when(prose, "caption_text_contaminated")
        .otherwise("caption_text_needs_visual_verification")
    )
    return one.select(
        *keys, columns.alias("columns"), padded.alias("rows"), "promoted", status.alias("status"),
        F.when(none, F.array(F.lit("no_structured_cells"))).otherwise(flags).alias("flags"),
    )


def urls(c: Column) -> Column:
    """Distinct addresses, without closing punctuation and without closing brackets that nothing opens."""
    found = F.regexp_extract_all(c, F.lit(f"({URL})"), 1)

    def balanced(u: Column) -> Column:
        plain = F.regexp_replace(u, "[.,;:]+$", "")
        opened = F.length(plain) - F.length(F.replace(plain, F.lit("("), F.lit("")))
        closed = F.length(plain) - F.length(F.replace(plain, F.lit(")"), F.lit("")))
        tail = F.length(plain) - F.length(F.regexp_replace(plain, r"\)+$", ""))
        extra = F.greatest(F.lit(0), F.least(tail, closed - opened))
        return F.regexp_replace(F.substring(plain, F.lit(1), F.length(plain) - extra), "[.,;:]+$", "")

    return F.array_distinct(F.transform(found, balanced))


def report_section(report: Column, heading: str) -> Column:
    """What stands under a `## ` heading, up to the next; null without it."""
    body = F.regexp_extract(F.concat(F.lit("\n"), report, F.lit("\n## ")), rf"(?s)\n## {re.escape(heading)}[ \t]*\n(.*?)\n(?=## )", 1)
    return F.when(F.concat(F.lit("\n"), report).rlike(rf"\n## {re.escape(heading)}[ \t]*(\n|$)"), body)


def pipe_table(report: Column) -> Column:
    """Cells of each Markdown table line; an escaped pipe doesn't part cells."""
    lines = F.filter(F.split(report, "\n"), lambda x: F.trim(x).rlike(r"^\|.*\|$"))
    inner = lambda x: F.regexp_replace(F.trim(x), r"^\||\|$", "")
    return F.transform(lines, lambda x: F.transform(F.split(inner(x), r"(?<!\\)\|"), lambda c: F.trim(F.replace(c, F.lit("\\|"), F.lit("|")))))


def last_plausible(transcript: Column, start: str, plausible) -> Column:
    """The text from the last start mark from which it is plausible; null if there is none."""
    parts = F.split(transcript, re.escape(start), -1)
    places = F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1)))
    tails = F.transform(places, lambda i: F.concat(F.lit(start), F.array_join(F.slice(parts, i + 1, F.size(parts)), start)))
    good = F.filter(tails, plausible)
    return F.when((F.size(parts) > 1) & (F.size(good) > 0), F.element_at(good, -1))
