"""Whole papers: assembled text, positioned lines and rows, continued captions, hanging reference lists, summaries."""

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import predicates as P
from ..functions import text as T
from ..session import once
from . import extract as X

# Words that a caption's line can't end with, beginnings that continue none, and a footnote's beginning.
DANGLING = r"(?i)\b(?:a|across|an|and|between|by|for|from|in|of|on|or|the|to|versus|vs\.?|when|with|without)$"
NO_CONTINUATION = r"(?i)^(?:Notes?\s*:|Panel\b|\([a-z0-9]+\)|N\b|Controls\b|Control mean\b)"
FOOTNOTE = r"(?i)^\s*\d{1,3}\s+(?:See(?:\s+e\.?g\.?)?|For\b|This\b|We\b)"


def full_text(pages: DataFrame, keys: list[str]) -> DataFrame:
    """keys and full_text: the pages in order, each under a heading with its number and label."""
    label = F.coalesce(F.concat(F.lit(" (label: "), "label", F.lit(")")), F.lit(""))
    part = F.concat(F.lit("# Page "), F.col("page").cast("string"), label, F.lit("\n\n"), F.trim("text"))
    ordered = F.array_sort(F.collect_list(F.struct("page", part.alias("part"))))
    return pages.groupBy(*keys).agg(F.array_join(F.transform(ordered, lambda p: p["part"]), "\n\n").alias("full_text"))


def numbered(found: DataFrame, keys: list[str], order: list[str], prefix: str) -> DataFrame:
    """found with id: the prefix and a number of three digits or more in order within the keys."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return found.withColumn("id", F.format_string(prefix + "_%03d", place))


def positioned_lines(spans: DataFrame, keys: list[str], height: float) -> DataFrame:
    """keys, line, content, box, size, bold and footer of lines from their spans (line, span, label, box columns, size,
    bold): spans joined in order; a footer is a line of digits in the lowest part."""
    ordered = F.array_sort(F.collect_list(F.struct("span", "label")))
    content = T.squash(F.array_join(F.transform(ordered, lambda s: s["label"]), ""))
    out = spans.groupBy(*keys, "line").agg(
        content.alias("content"), F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"),
        F.max("size").alias("size"), F.bool_or("bold").alias("bold"),
    )
    return out.where("content <> ''").withColumn("footer", F.col("content").rlike("^[0-9]+$") & (F.col("y0") > height * 0.82))


def continues_caption(title: Column, line: Column, gap: Column, wrapped: Column) -> Column:
    """Whether a line goes on with a caption's title: near below, and the title is open, dangling, wrapped, or the line
    starts in lower case."""
    text = T.squash(line)
    expected = F.rtrim(title).endswith(":") | title.rlike(DANGLING)
    count = lambda c, x: F.length(c) - F.length(F.replace(c, F.lit(x), F.lit("")))
    never = ~gap.between(-0.5, 18) | (text == "") | text.rlike(X.CAPTION) | text.rlike(X.CAPTION_CAPITALS) | text.rlike(NO_CONTINUATION)
    never = never | (text.rlike(r"^[-−]?[0-9]") & ~expected & ~wrapped)
    full = wrapped & (F.length(title) >= 24) & (F.length(text) <= 120) & ~F.rtrim(title).rlike(r"[.?!:;]$")
    return F.coalesce(~never & ((count(title, "(") > count(title, ")")) | full | expected | text.rlike(r"^\p{Ll}")), F.lit(False))


def continued_captions(lines: DataFrame, keys: list[str]) -> DataFrame:
    """keys, start and title: captions with the lines that go on with them, of lines (line, content, y0, y1, block). A line's
    test needs the title so far, so the lines from a caption to the next are folded, each such stretch on its own."""
    order = Window.partitionBy(*keys).orderBy("line")
    begins = X.is_caption(F.col("content")).cast("int")
    rows = lines.withColumn("_run", F.sum(begins).over(order)).where("_run > 0")
    some = F.array_sort(F.collect_list(F.struct("line", "content", "y0", "y1", "block")))
    state = "struct<title:string,y1:double,block:int,open:boolean>"
    first = F.get("r", F.lit(0))
    start = F.struct(T.squash(first["content"]).alias("title"), first["y1"].alias("y1"), first["block"].alias("block"), F.lit(True).alias("open")).cast(state)

    def step(s: Column, x: Column) -> Column:
        goes = s["open"] & continues_caption(s["title"], x["content"], x["y0"] - s["y1"], x["block"] == s["block"])
        longer = F.struct(F.concat_ws(" ", s["title"], T.squash(x["content"])).alias("title"), x["y1"].alias("y1"), x["block"].alias("block"), F.lit(True).alias("open"))
        closed = F.struct(s["title"].alias("title"), s["y1"].alias("y1"), s["block"].alias("block"), F.lit(False).alias("open"))
        return F.when(goes, longer.cast(state)).otherwise(closed.cast(state))

    one = rows.groupBy(*keys, "_run").agg(some.alias("r"))
    title = F.aggregate(F.slice("r", 2, F.size("r")), start, step, lambda s: s["title"])
    return one.select(*keys, first["line"].alias("start"), title.alias("title"))


def continues_raw_caption(title: Column, line: Column, squashed: bool = False) -> Column:
    """Whether a line of unpositioned text goes on with a caption's title: the title is open or dangling, or does not end and
    the line starts in lower case."""
    text = line if squashed else T.squash(line)
    expected = F.rtrim(title).endswith(":") | title.rlike(DANGLING)
    count = lambda c, x: F.length(c) - F.length(F.replace(c, F.lit(x), F.lit("")))
    never = (text == "") | X.is_caption(text) | text.rlike(NO_CONTINUATION) | (text.rlike(r"^[-−]?[0-9]") & ~expected) | (F.length(text) > 180)
    goes = (count(title, "(") > count(title, ")")) | expected | (~F.rtrim(title).rlike(r"[.?!)]$") & text.rlike(r"^\p{Ll}"))
    return F.coalesce(~never & goes, F.lit(False))


def captioned_items(pages: DataFrame) -> DataFrame:
    """(paper_id, page, kind, label, caption, body) of pages' supported captions: the title with the lines that go on with it,
    and the lines after it up to the next caption, without page labels at the end; the first of a kind and label on a page.
    The lines from a caption to the next are folded, each such stretch on its own. A page has all that its items need, so its
    lines stay in its row and nothing is shuffled."""
    c = F.col
    lines = F.transform(F.split("text", "\n", -1), lambda x, i: F.struct((i + 1).alias("line"), T.squash(x).alias("content")))
    rows = once(pages.where(X.caption_cue(c("text"))).select("paper_id", "page", "text"), lines=F.filter(lines, lambda x: x["content"] != "")).drop("text")
    begins = F.transform("lines", lambda x, i: F.when(x["content"].rlike(X.CAPTION_CUE) & X.is_caption(x["content"]), i + 1))
    rows = once(rows, at=F.array_compact(F.concat(begins, F.array(F.size("lines") + 1))))
    runs = F.transform(F.slice("at", F.lit(1), F.size("at") - 1), lambda k, i: F.slice("lines", k, F.get("at", i + 1) - k))
    rows = once(rows, runs=F.transform(runs, lambda r: F.struct(X.caption_parts(r[0]["content"]).alias("h"), r.alias("r"))))
    noted = lambda r: F.exists(r, lambda x: x["content"].rlike(X.NOTE_START))
    rows = once(rows.drop("at", "lines"), runs=F.filter("runs", lambda x: (x["h"]["title"] != "") | ((x["h"]["kind"] == "figure") & noted(x["r"]))))
    name = lambda x: F.concat_ws(" ", x["h"]["kind"], x["h"]["label"])
    both = rows.select("paper_id", "page", F.inline(F.filter("runs", lambda x, i: F.array_position(F.transform("runs", name), name(x)) == i + 1))).select("paper_id", "page", "h.*", "r")
    state = "struct<title:string,n:int,open:boolean>"
    start = F.struct(c("title").alias("title"), F.lit(1).alias("n"), (c("title") != "").alias("open")).cast(state)

    def step(s: Column, x: Column) -> Column:
        goes = s["open"] & continues_raw_caption(s["title"], x["content"], True)
        longer = F.struct(F.concat_ws(" ", s["title"], x["content"]).alias("title"), (s["n"] + 1).alias("n"), F.lit(True).alias("open"))
        return F.when(goes, longer.cast(state)).otherwise(F.struct(s["title"].alias("title"), s["n"].alias("n"), F.lit(False).alias("open")).cast(state))

    done = once(both, s=F.aggregate(F.slice("r", 2, F.size("r")), start, step))
    done = once(done, body=F.transform(F.slice("r", c("s.n") + 1, F.size("r")), lambda x: x["content"])).drop("r")
    body = c("body")
    # A label has twelve characters at most.
    last = F.coalesce(F.array_max(F.transform(body, lambda x, i: F.when((F.length(x) > 12) | T.plausible_label(x).isNull(), i + 1))), F.lit(0))
    title = T.join_hyphens(F.array("s.title"))
    caption = F.concat(F.initcap("kind"), F.lit(" "), "label", F.when(title != "", F.concat(F.lit(": "), title)).otherwise(""))
    return done.select("paper_id", "page", "kind", "label", caption.alias("caption"), F.slice(body, F.lit(1), last).alias("body"))


def fallback_crop(width: float, height: float) -> tuple[float, float, float, float]:
    """The part of a page that is cut out for an item without a place: the page without its margins."""
    return (max(0.0, 48.0), max(0.0, 64.0), width - 48, height - 42)


def positioned_items(lines: DataFrame, keys: list[str], width: float, height: float) -> DataFrame:
    """keys, line, kind, label, caption, n_caption, n_lines, caption box (cx0 to cy1) and crop (x0 to y1) of the supported captions
    of positioned lines (line, content, x0, y0, x1, y1, size, bold, block), the first of a kind and label on a page.

    An item takes the lines up to the next caption; its crop holds them with 24 points beside and 10 above and below, within
    the page. Its title goes on while lines continue it or, below a bare label, while they stand close under each other in one
    block and size. The lines from a caption to the next are folded, each such stretch on its own."""
    c = F.col
    both = X.caption_runs(lines, keys).withColumnsRenamed({"lines": "r", "h": "first"})
    state = "struct<title:string,x0:double,y0:double,y1:double,size:double,block:int,n:int,open:boolean>"

    def at(x: Column, title: Column, n: Column, goes: Column) -> Column:
        return F.struct(title.alias("title"), x["x0"], x["y0"], x["y1"], x["size"], x["block"], n.alias("n"), goes.alias("open")).cast(state)

    def step(s: Column, x: Column) -> Column:
        alike = (x["block"] == s["block"]) & (F.abs(x["size"] - s["size"]) <= 0.5) & (F.abs(x["x0"] - s["x0"]) <= 4)
        under = (s["n"] == 1) | (alike & (x["y0"] - s["y1"]).between(-1, 12))
        goes = s["open"] & F.when(c("apart"), under).otherwise((s["title"] != "") & continues_caption(s["title"], x["content"], x["y0"] - s["y0"], alike))
        title = F.when(c("apart") & (s["n"] == 1), s["title"]).otherwise(F.concat_ws(" ", s["title"], x["content"]))
        return F.when(F.coalesce(goes, F.lit(False)), at(x, title, s["n"] + 1, F.lit(True))).otherwise(at(s, s["title"], s["n"], F.lit(False)))

    done = both.withColumn("s", F.aggregate(F.slice("r", 2, F.size("r")), at(c("first"), c("title"), F.lit(1), F.lit(True)), step))
    title = T.join_hyphens(F.array("s.title"))
    caption = F.concat(F.initcap("kind"), F.lit(" "), "label", F.when(title != "", F.concat(F.lit(": "), title)).otherwise(""))
    head = F.slice("r", F.lit(1), c("s.n"))
    low, high = (lambda some, k: F.array_min(F.transform(some, lambda x: x[k]))), (lambda some, k: F.array_max(F.transform(some, lambda x: x[k])))
    return done.select(
        *keys, "line", "kind", "label", caption.alias("caption"), c("s.n").alias("n_caption"), F.size("r").alias("n_lines"),
        low(head, "x0").alias("cx0"), low(head, "y0").alias("cy0"), high(head, "x1").alias("cx1"), high(head, "y1").alias("cy1"),
        F.greatest(F.lit(0.0), low(c("r"), "x0") - 24).alias("x0"), F.greatest(F.lit(0.0), c("first.y0") - 10).alias("y0"),
        F.least(F.lit(float(width)), high(c("r"), "x1") + 24).alias("x1"), F.least(F.lit(float(height)), high(c("r"), "y1") + 10).alias("y1"),
    )


def all_items(positioned: DataFrame, raw: DataFrame, width: float, height: float) -> DataFrame:
    """(paper_id, page, kind, label, caption, x0, y0, x1, y1, source) of positioned_items() and, for what they lack on a page, of
    captioned_items() of its text, whose crop is the page without its margins."""
    found = positioned.select("paper_id", "page", "kind", "label", "caption", "x0", "y0", "x1", "y1", F.lit("positioned_lines").alias("source"))
    crop = [F.lit(x).alias(n) for n, x in zip(("x0", "y0", "x1", "y1"), fallback_crop(width, height), strict=True)]
    other = raw.join(found, ["paper_id", "page", "kind", "label"], "left_anti")
    return found.unionByName(other.select("paper_id", "page", "kind", "label", "caption", *crop, F.lit("raw_text").alias("source")))


def figure_regions(regions: DataFrame, captions: DataFrame, width: float) -> DataFrame:
    """(page, caption, region): for each figure's caption the region of its page that ends nearest above it, up to 48 points or 6
    below its top, in its column unless the caption is wide; of equals the largest, then the first."""
    c = F.col
    gap = c("c.y0") - c("r.y1")
    beside = F.least(c("r.x1"), c("c.x1")) - F.greatest(c("r.x0"), c("c.x0"))
    near = gap.between(-6, 48) & ((beside > 0) | (c("c.x1") - c("c.x0") >= width * 0.55))
    both = captions.alias("c").join(regions.alias("r"), (c("c.page") == c("r.page")) & near)
    area = (c("r.x1") - c("r.x0")) * (c("r.y1") - c("r.y0"))
    best = F.min(F.struct(F.greatest(gap, F.lit(0.0)).alias("gap"), (-area).alias("area"), c("r.box").alias("region")))
    return both.groupBy(c("c.page").alias("page"), c("c.box").alias("caption")).agg(best.alias("m")).select("page", "caption", "m.region")


def column_bounds(x0: Column, x1: Column, width: Column, height: Column) -> Column:
    """struct(low, high): the column of a page that a caption's lines stand in: all of it on landscape pages and for captions
    over the middle or of 55 per cent of the width, else the caption's half."""
    whole = (width > height) | ((x0 < width / 2) & (width / 2 < x1)) | (x1 - x0 >= width * 0.55)
    left = (x0 + x1) / 2 < width / 2
    low = F.when(whole | left, F.lit(24.0)).otherwise(width / 2 + 4)
    high = F.when(whole | ~left, width - 24).otherwise(width / 2 - 4)
    return F.struct(low.alias("low"), high.alias("high"))


def table_regions(rows: DataFrame, captions: DataFrame) -> DataFrame:
    """(page, caption, side, n_rows, y0, y1) of the table that a caption (page, box, x0, y0, x1, y1, width, height) belongs to:
    the rows (page, box, x0, y0, x1, y1, content) of its column below it, or if there is none there, above it.

    Below, rows follow as far as gaps allow: sixty points to the first and to a panel's, thirty to others, eighteen after
    two rows with cells to one that has fewer than two; a caption, a note, and such a row that is a heading, end it. Above,
    gaps are of thirty points to the first and twenty-two to others, within 380 points, up to a caption or heading. Either
    side needs two rows with cells. A page bounds the walk, which is a fold over rows' measures: rows and captions of a page come
    together in one shuffle, each row as its place and marks, and once however many captions there are.
    """
    c = F.col
    marked = once(rows.select("page", "box", "x0", "y0", "x1", "y1", "content"), s=T.squash(c("content")))
    tests = (X.panel_label(c("s"), True).isNotNull(), X.is_caption(c("content")), X.is_heading(c("s"), True), c("s").rlike(X.NOTE_START))
    marks = sum((F.when(t, 1 << k).otherwise(0) for k, t in enumerate(tests)), F.lit(0))
    row = F.struct("box", "y0", "y1", ((c("x0") + c("x1")) / 2).alias("middle"), F.size(X.trailing_cells(c("content"))["cells"]).alias("cells"), marks.alias("marks"))
    edges = captions.withColumn("b", column_bounds(c("x0"), c("x1"), c("width"), c("height")))
    edge = F.struct(c("box").alias("cap"), c("y0").alias("top"), c("y1").alias("bottom"), c("b.low").alias("low"), c("b.high").alias("high"))
    together = marked.select("page", row.alias("row")).unionByName(edges.select("page", edge.alias("edge")), True)
    pages = together.groupBy("page").agg(F.collect_list("row").alias("rows"), F.collect_list("edge").alias("edges"))
    beside = F.filter("rows", lambda r: r["middle"].between(c("low"), c("high")) & (r["box"] != c("cap")))
    both = once(pages.select("page", "rows", F.inline("edges")), rows=beside)
    state = "struct<at:double,n:int,numeric:int,top:double,bottom:double,open:boolean>"

    def walk(side: str) -> Column:
        below = side == "below"
        some = F.filter("rows", lambda r: r["y0"] >= c("bottom") - 1 if below else r["y1"] <= c("top") + 1)
        listed = F.array_sort(F.transform(some, lambda r: F.struct((r["y0"] if below else -r["y0"]).alias("place"), *(r[k].alias(k) for k in ("box", "y0", "y1", "cells", "marks")))))
        start = F.struct(c("bottom" if below else "top").alias("at"), F.lit(0).alias("n"), F.lit(0).alias("numeric"), F.lit(None).alias("top"), F.lit(None).alias("bottom"), F.lit(True).alias("open")).cast(state)

        def step(s: Column, r: Column) -> Column:
            gap = r["y0"] - s["at"] if below else s["at"] - r["y1"]
            some_yet = s["n"] > 0
            panel, caption, heading, note = (r["marks"].bitwiseAND(1 << k) > 0 for k in range(4))
            if below:
                wide = gap > F.when(~some_yet | panel, 60.0).otherwise(30.0)
                loose = some_yet & (s["numeric"] >= 2) & (r["cells"] < 2) & ((gap > 18) | heading) & ~panel
                ends = wide | caption | note | loose
            else:
                far = c("top") - r["y0"] > 380
                ends = (gap > F.when(some_yet, 22.0).otherwise(30.0)) | far | (some_yet & (caption | (heading & (r["cells"] == 0) & ~panel)))
            taken = F.struct(
                (r["y1"] if below else r["y0"]).alias("at"), (s["n"] + 1).alias("n"), (s["numeric"] + (r["cells"] > 0).cast("int")).alias("numeric"),
                F.least(s["top"], r["y0"]).alias("top"), F.greatest(s["bottom"], r["y1"]).alias("bottom"), F.lit(True).alias("open"),
            )
            closed = F.struct(*[s[k].alias(k) for k in ("at", "n", "numeric", "top", "bottom")], F.lit(False).alias("open"))
            return F.when(~s["open"] | (gap < -8), s).when(ends, closed.cast(state)).otherwise(taken.cast(state))

        return F.aggregate(listed, start, step)

    told = lambda side, w: F.struct(F.lit(side).alias("side"), w["n"].alias("n_rows"), w["top"].alias("y0"), w["bottom"].alias("y1"), w["numeric"].alias("numeric"))
    walked = once(both.select("page", "rows", "cap", "top", "bottom"), w=told("below", walk("below")))
    walked = once(walked, w=F.when(c("w.numeric") >= 2, c("w")).otherwise(told("above", walk("above")))).where("w.numeric >= 2")
    return walked.select("page", c("cap").alias("caption"), "w.side", "w.n_rows", "w.y0", "w.y1")


def rows_below(rows: DataFrame, captions: DataFrame, first_gap: float = 60.0, gap: float = 30.0) -> DataFrame:
    """(page, caption, n_rows, y1): rows under a caption as far as gaps allow: sixty points to the first, thirty between
    others; the walk ends at the first wider gap. A running minimum marks the end, so nothing is folded."""
    c = F.col
    near = captions.alias("c").join(rows.alias("r"), (c("c.page") == c("r.page")) & (c("r.y0") >= c("c.y1") - 1))
    near = near.select(c("c.page").alias("page"), c("c.box").alias("caption"), c("c.y1").alias("edge"), c("r.y0").alias("y0"), c("r.y1").alias("y1"), c("r.box").alias("box"))
    order = Window.partitionBy("page", "caption").orderBy("y0", "box", "y1", "edge")
    before = F.max("y1").over(order.rowsBetween(Window.unboundedPreceding, -1))
    space = c("y0") - F.coalesce(before, c("edge"))
    ends = F.max(F.when(space > F.when(before.isNull(), first_gap).otherwise(gap), 1).otherwise(0)).over(order.rowsBetween(Window.unboundedPreceding, 0))
    kept = near.withColumn("_ends", ends).where("_ends = 0")
    return kept.groupBy("page", "caption").agg(F.count("*").alias("n_rows"), F.max("y1").alias("y1"))


def hanging_references(lines: DataFrame) -> DataFrame:
    """(paper_id, entry, start_page, content): entries of positioned lists (page, line, content, x0, y0, width, height).
    Headings that recur on two pages' tops go; an entry opens at its column's margin, four points either way, or where it
    repeats an author. Margins and recurrence are aggregates; the entries are a fold over a paper."""
    c = F.col
    column = F.when(c("x0") < c("width") * 0.48, "left").otherwise("right")
    rows = lines.withColumn("column", column).withColumn("content", T.squash(c("content")))
    tops = rows.where(c("y0") <= c("height") * 0.12).groupBy("paper_id", F.lower("content").alias("_top")).agg(F.count_distinct("page").alias("_n"))
    headers = tops.where("_n >= 2").select("paper_id", "_top", F.lit(True).alias("_header"))
    rows = rows.withColumn("_top", F.when(c("y0") <= c("height") * 0.12, F.lower("content"))).join(headers, ["paper_id", "_top"], "left").where("_header is null")
    start, appendix, end, foot = (re.compile(p) for p in (X.LIST_START, X.APPENDIX_START, X.LIST_END, FOOTNOTE))
    caption, capitals, again, year = (re.compile(p) for p in (X.CAPTION, X.CAPTION_CAPITALS, X.REPEATED_AUTHOR, X.YEAR))

    def fold(group: pd.DataFrame) -> pd.DataFrame:
        inside, entries, current = False, [], None
        for page, some in group.sort_values(["page", "line"]).groupby("page", sort=True):
            found = list(some[["content", "column", "x0"]].itertuples(index=False))
            if not inside:
                at = next((i for i, r in enumerate(found) if start.match(r.content)), None)
                if at is None:
                    continue
                inside, found = True, found[at + 1 :]
            margin: dict[str, float] = {}
            for r in found:
                margin[r.column] = min(margin.get(r.column, float("inf")), r.x0)
            for i, r in enumerate(found):
                after = found[i + 1].content if i + 1 < len(found) else ""
                lone = re.fullmatch("[A-Z]", r.content) and end.match(after)
                if appendix.match(r.content) or end.match(r.content) or caption.match(r.content) or capitals.match(r.content) or lone:
                    inside = False
                    break
                if foot.match(r.content):
                    current = None
                    break
                if not r.content or r.content.isdigit():
                    continue
                repeats = current and year.search(" ".join(current[1])) and again.match(r.content)
                if current is None or abs(r.x0 - margin[r.column]) <= 4 or repeats:
                    current = (page, [])
                    entries.append(current)
                current[1].append(r.content)
            if not inside:
                break
        joined = [re.sub(r"(?<=[A-Za-zÀ-ÖØ-öø-ÿ])-\s+(?=[A-Za-zÀ-ÖØ-öø-ÿ])", "-", " ".join(parts)) for _, parts in entries]
        rows = [(group["paper_id"].iloc[0], i, int(p), text) for i, ((p, _), text) in enumerate(zip(entries, joined, strict=True), 1)]
        return pd.DataFrame(rows, columns=["paper_id", "entry", "start_page", "content"])

    some = rows.select("paper_id", "page", "line", "content", "column", "x0")
    return some.groupBy("paper_id").applyInPandas(fold, "paper_id string, entry int, start_page int, content string")


def promoted_header(rows: DataFrame, keys: list[str]) -> DataFrame:
    """keys, header and body: a table's first row (line, cells) as header if it has one cell more than the data's width
    and two words at least; body rows padded to the width."""
    ordered = F.array_sort(F.collect_list(F.struct("line", "cells")))
    one = rows.groupBy(*keys).agg(ordered.alias("r"))
    width = F.array_max(F.transform(F.slice("r", 2, F.size("r")), lambda x: F.size(x["cells"])))
    first = F.get("r", F.lit(0))["cells"]
    words = F.size(F.filter(first, lambda x: x.rlike(r"^\p{L}")))
    takes = F.coalesce((F.size(first) == width + 1) & (words >= 2), F.lit(False))
    wide = F.coalesce(F.when(takes, width).otherwise(F.greatest(width, F.size(first))), F.size(first))
    body = F.transform(F.when(takes, F.slice("r", 2, F.size("r"))).otherwise(F.col("r")), lambda x: x["cells"])
    # The width is a variable of an outer function: as an expression it would be found anew for each row, from all rows.
    pad = lambda w: F.transform(body, lambda x: F.concat(x, F.array_repeat(F.lit(""), F.greatest(w - F.size(x), F.lit(0)))))
    return one.select(*keys, F.when(takes, first).alias("header"), F.get(F.transform(F.array(wide), pad), F.lit(0)).alias("body"))


def word_neighbours(words: DataFrame, keys: list[str], token: Column) -> DataFrame:
    """Words equal to the token with the words before and after them on their line."""
    order = Window.partitionBy(*keys, "block", "line").orderBy("word")
    near = words.withColumn("before", F.lag("label").over(order)).withColumn("after", F.lead("label").over(order))
    return near.where(F.col("label") == token)


def manifest_counts(items: DataFrame, keys: list[str], kind: str = "kind") -> DataFrame:
    """keys and counts of a paper's items, all and by kind."""
    n = lambda k: F.count_if(F.col(kind) == k).alias(f"n_{k}")
    return items.groupBy(*keys).agg(F.count("*").alias("n_items"), n("caption"), n("table"), n("figure"))


def ledger(covered: DataFrame) -> DataFrame:
    """(paper_id, raters): each paper's raters with their items, nested and sorted."""
    items = covered.groupBy("paper_id", "rater").agg(F.array_sort(F.collect_set("item_id")).alias("items"))
    return items.groupBy("paper_id").agg(F.array_sort(F.collect_list(F.struct("rater", "items"))).alias("raters"))


def zipped(left: DataFrame, right: DataFrame, keys: list[str], place: str) -> DataFrame:
    """Rows paired by place; an error column where one side has none."""
    both = left.withColumn("_l", F.lit(1)).join(right.withColumn("_r", F.lit(1)), [*keys, place], "full_outer")
    return both.withColumn("error", F.when(F.col("_l").isNull() | F.col("_r").isNull(), "unpaired")).drop("_l", "_r")


def quantity_errors(quantities: DataFrame, sources: DataFrame) -> DataFrame:
    """(check_id, source_id, error) of quantities whose source is undeclared, whose value isn't in its quote as a number of
    its own, or that drop the quote's per cent."""
    token = r"(?<![\w.+,\-−])([-+−]?(?:(?:\d{1,3}(?:,\d{3})+|\d+)(?:\.\d+)?|\.\d+)(?!\w|[.,]\d)(?:\s*(?:%|percent\b))?)"
    both = quantities.join(sources.select("source_id", "quote", F.lit(True).alias("_known")), "source_id", "left")
    number = lambda x: F.regexp_replace(F.replace(F.regexp_replace(x, r"\s*(?:%|percent)$", ""), F.lit(","), F.lit("")), "−", "-").try_cast("double")
    found = F.filter(F.regexp_extract_all("quote", F.lit(token), 1), lambda x: number(x) == F.col("value").try_cast("double"))
    error = (
        F.when(F.col("_known").isNull(), "undeclared source")
        .when(F.coalesce(F.size(found), F.lit(0)) <= 0, "not in quote")
        .when(F.forall(found, lambda x: x.rlike("(?:%|percent)$")) & (F.col("scale") != "percent"), "percent scale")
    )
    return both.select("check_id", "source_id", error.alias("error")).where("error is not null")


def run_metrics(runs: DataFrame) -> DataFrame:
    """runs with scores of captions, normalising, report, selection and resuming, each from 0 to 100, and their mean."""
    c = F.col
    clamp = lambda x: F.greatest(F.lit(0.0), F.least(F.lit(100.0), 100.0 - x))
    share = lambda a, b, other: F.coalesce(F.try_divide(c(a).cast("double"), c(b).cast("double")), F.lit(other))
    some = c("source_findings") > 0
    parts = {
        "caption_score": clamp(35.0 * share("raw_captions", "captions", 0.0) + 25.0 * (1.0 - share("parsed_tables", "tables", 1.0))),
        "merge_score": clamp(
            F.when(some & (share("canonical", "source_findings", 1.0) > 0.95), 20.0).otherwise(0.0)
            + F.when(some & (share("cross_agent", "canonical", 0.0) < 0.05), 10.0).otherwise(0.0)
        ),
        "report_score": clamp(15.0 * c("failures") + F.when((c("external") > 0) & ~c("has_appendix"), 15.0).otherwise(0.0)),
        "selector_score": clamp(4.0 * F.greatest(F.lit(0), c("selected") - 13) + 2.0 * F.greatest(F.lit(0), c("pilots") - 4) + 8.0 * c("idle")),
        "resume_score": clamp(18.0 * c("missing") + F.when(c("reviews") == 0, 20.0).otherwise(0.0)),
    }
    out = runs.withColumns(parts)
    return out.withColumn("overall", sum(F.col(p) for p in parts) / len(parts))


#: Lists of a quality summary that tell the pages where a count of the record is above zero, or a flag of it holds.
COUNTED = {
    "unresolved_control_glyph_pages": "unresolved_control_glyphs", "soft_hyphen_pages": "soft_hyphens", "layout_artifact_pages": "layout_artifacts",
    "known_font_glyph_repair_pages": "font_glyph_repairs", "positioned_accent_composition_pages": "accent_compositions",
    "unresolved_math_glyph_pages": "unresolved_math_glyphs", "residual_control_character_pages": "control_characters",
}
FLAGGED = {"ocr_recommended_pages": "ocr_recommended", "two_column_pages": "two_column", "landscape_pages": "landscape"}
_LINE_ENDS = r"[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"


def quality_summary(pages: DataFrame, keys: list[str]) -> DataFrame:
    """keys, the page lists of a paper's quality summary, strategies (how many pages each has) and ratio_median (of normalised
    to raw lengths), in one grouping.

    pages: page, raw_text, normalized_text, strategy, similarity (of raw and sorted text), scanned, label_source, and the columns
    of COUNTED and FLAGGED. Counts and flags that are null count as none, a null strategy as coordinate_sorted, a null
    similarity as 1. A page with under 250 characters is sparse where that is plausible, else low in text, unless it is scanned."""
    c = F.col
    text = lambda x: F.coalesce(x, F.lit(""))
    bare = F.length(F.regexp_replace(text("raw_text"), f"^{T.SPACE}+|{T.SPACE}+$", ""))
    full = lambda x: F.greatest(F.lit(1), F.size(F.filter(F.split(x, _LINE_ENDS, -1), lambda y: y.rlike("[^" + T.SPACE[1:]))))
    rows = pages.withColumn("strategy", F.coalesce("strategy", F.lit("coordinate_sorted"))).withColumn("_alike", F.coalesce("similarity", F.lit(1.0)))
    rows = rows.withColumn("_bare", bare).withColumn("_both", (text("raw_text") != "") & (text("normalized_text") != ""))
    flag = lambda x: F.coalesce(c(x), F.lit(False))
    fallback = c("strategy") == "native_content_order_font_fidelity"
    unsure = (flag("two_column") & (c("strategy") != "native_content_order_two_column")) | fallback | flag("landscape")
    first = (c("page") == 1) & (c("strategy") == "coordinate_sorted") & (c("_bare") >= 1000) & (c("_alike") < 0.5)
    thin = (c("_bare") < 250) & ~flag("scanned")
    sparse = P.sparse_page(text("raw_text"))
    lists = {name: F.coalesce(c(x), F.lit(0)) > 0 for name, x in COUNTED.items()} | {name: flag(x) for name, x in FLAGGED.items()}
    lists |= {
        "rejected_geometric_page_label_pages": c("label_source") == "geometric_candidate_rejected", "font_fidelity_order_fallback_pages": fallback,
        "reading_order_review_pages": (unsure & (c("_alike") < 0.9)) | first, "low_text_pages": thin & ~sparse, "sparse_plausible_pages": thin & sparse,
        "suspicious_order_pages": c("_both") & (full("normalized_text") > full("raw_text") * 2.25) & (F.length("normalized_text") > 1000),
    }
    listed = [F.array_sort(F.collect_list(F.when(F.coalesce(v, F.lit(False)), c("page")))).alias(k) for k, v in lists.items()]
    ratio = F.when(c("_both"), F.length("normalized_text") / F.length("raw_text"))
    out = rows.groupBy(*keys).agg(*listed, F.collect_list("strategy").alias("_s"), F.round(F.percentile(ratio, F.lit(0.5)), 3).alias("ratio_median"))
    counts = F.transform(F.array_sort(F.array_distinct("_s")), lambda s: F.struct(s, F.size(F.filter("_s", lambda x: x == s))))
    return out.withColumn("strategies", F.map_from_entries(counts)).drop("_s")


def quality_pages(pages: DataFrame, keys: list[str]) -> DataFrame:
    """keys and page lists: those whose reading order needs review, and those of suspicious line counts; the median ratio
    of lengths. pages has raw_text, normalized_text, strategy, two_column, landscape, similarity."""
    c = F.col
    full = lambda x: F.size(F.filter(F.split(x, "\n"), lambda y: F.trim(y) != ""))
    unsure = (c("two_column") & (c("strategy") != "native_content_order_two_column")) | (c("strategy") == "native_content_order_font_fidelity") | c("landscape")
    review = (unsure & (c("similarity") < 0.9)) | ((c("page") == 1) & (c("strategy") == "coordinate_sorted") & (F.length(F.trim("raw_text")) >= 1000) & (c("similarity") < 0.5))
    odd = (full("normalized_text") > F.greatest(F.lit(1), full("raw_text")) * 2.25) & (F.length("normalized_text") > 1000)
    listed = lambda x: F.array_join(F.array_sort(F.collect_list(F.when(x, c("page")))), ",")
    ratio = F.when((F.length("raw_text") > 0) & (F.length("normalized_text") > 0), F.length("normalized_text") / F.length("raw_text"))
    return pages.groupBy(*keys).agg(
        listed(review).alias("reading_order_review_pages"), listed(odd).alias("suspicious_order_pages"), F.round(F.percentile(ratio, F.lit(0.5)), 3).alias("ratio_median")
    )
