"""Records of a corpus' pages in two passes. The first makes narrow relations over whole papers (recurring edge blocks, runs of
page labels, columns, images, words in reading order); the second joins them to the pages once and derives each page's record."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import predicates as P
from ..functions import text as T
from ..operators import layout as L
from ..session import once, small_batches

KEYS = ["paper", "page"]
#: Share of a page that images cover, and characters of its text under which they make it one to be read by eye.
COVERED, FEW = 0.18, 1500


def edge_artifacts(pages: DataFrame) -> DataFrame:
    """(paper, page, box, label, reason) of pages' text blocks at their edges whose text, digits apart, recurs on three pages of
    the paper, two in a margin. Blocks that are at no edge, most of the text, don't leave their page."""
    reason = lambda b: L.layout_reason(b["x0"], b["y0"], b["x1"], b["y1"], F.col("width"), F.col("height"))
    edges = F.transform("blocks", lambda b, i: F.struct(i.alias("box"), b["label"].alias("label"), F.when(b["is_text"], reason(b)).alias("reason")))
    marked = once(pages.select(*KEYS, F.inline(F.filter(edges, lambda e: e["reason"].isNotNull()))), signature=T.signature(F.col("label")))
    least = F.when(F.col("reason") == "repeated_vertical_margin", 2).otherwise(3)
    return L.recurring(marked.where(F.col("signature").rlike(r"\p{L}")), ["paper", "reason", "signature"], "page", least).select(*KEYS, "box", "label", "reason")


def reading_order(words: Column) -> Column:
    """A page's words as text: lines from top to bottom, words from left to right; null for a page without words. Words are
    sorted by line and place once, and a line is a stretch of them."""
    let = lambda value, use: F.element_at(F.transform(F.array(value), use), 1)
    parts = ("block", "line", "x0", "word", "label", "y0")
    rows = F.array_sort(F.transform(words, lambda w: F.struct(*(w[n].alias(n) for n in parts))))
    same = lambda r, i: F.get(r, i)["block"].eqNullSafe(F.get(r, i - 1)["block"]) & F.get(r, i)["line"].eqNullSafe(F.get(r, i - 1)["line"])
    starts = lambda r: F.filter(F.sequence(F.lit(0), F.size(r) - 1), lambda i: (i == 0) | ~same(r, i))
    part = lambda r, s, k: F.slice(r, F.get(s, k) + 1, F.coalesce(F.get(s, k + 1), F.size(r)) - F.get(s, k))
    each = lambda a, name: F.transform(a, lambda x: x[name])
    line = lambda own: F.struct(F.array_min(each(own, "y0")).alias("y"), F.array_min(each(own, "x0")).alias("x"), F.get(own, F.lit(0))["block"].alias("block"), F.get(own, F.lit(0))["line"].alias("line"), F.array_join(each(own, "label"), " ").alias("t"))
    told = let(rows, lambda r: let(starts(r), lambda s: F.array_sort(F.transform(s, lambda _, k: let(part(r, s, k), line)))))
    return F.when(F.size(words) > 0, F.array_join(each(told, "t"), "\n"))


def page_records(pages: DataFrame) -> DataFrame:
    """One record a page of pages (paper, page, width, height, raw_text, words, blocks, images as in PAGE_PARTS): texts without
    recurring edge blocks, in native or sorted order and in normal form, the page's label where it stands in a run, and what
    documents.quality_summary() counts. Null texts count as empty, pages without words keep their raw text; a page that is
    told twice has two records.

    A page's words and blocks are read in its row. Only edge blocks and one label a page meet those of other pages; with them
    comes a page's text, once if its sorted text is the same."""
    c = F.col
    small_batches(pages.sparkSession)
    size = (c("width"), c("height"))
    removed = edge_artifacts(pages).groupBy(*KEYS).agg(F.array_sort(F.collect_set(F.struct("box", "label", "reason"))).alias("_gone"))
    found = pages.select(*KEYS, L.label_in_words(c("words"), *size).alias("_m")).groupBy(*KEYS).agg(F.min("_m")["label"].alias("label"))
    told = L.label_runs(found, "paper", "page", "label").join(removed, KEYS, "left")
    area = lambda b: F.greatest(F.lit(0.0), (b[2] - b[0]) * (b[3] - b[1]))
    shown = F.flatten(F.transform("images", lambda i: F.coalesce(i["boxes"], F.array().cast("array<array<double>>"))))
    total = F.aggregate(F.transform(F.coalesce(shown, F.array().cast("array<array<double>>")), area), F.lit(0.0), lambda a, x: a + x)

    raw = F.coalesce("raw_text", F.lit(""))
    another = F.element_at(F.transform(F.array(reading_order(c("words"))), lambda t: F.when(t != raw, t)), 1)
    own = pages.select(
        *KEYS, raw.alias("raw_text"), another.alias("_order"), L.block_sides(c("blocks"), c("width")).alias("_sides"), (c("width") > c("height")).alias("landscape"),
        F.round(F.least(F.lit(1.0), total / (c("width") * c("height"))), 3).alias("coverage"), (F.coalesce(F.size("words"), F.lit(0)) <= 0).alias("_wordless"),
    )
    rows = own.join(told, KEYS, "left").withColumn("_gone", F.coalesce("_gone", F.array().cast("array<struct<box:int,label:string,reason:string>>")))
    gone = F.transform("_gone", lambda g: g["label"])
    rows = rows.withColumn("_raw", L.remove_artifacts(c("raw_text"), gone))
    rows = rows.withColumn("_sorted", F.when(c("_order").isNull(), c("_raw")).otherwise(L.remove_artifacts(c("_order"), gone)))
    two, major = L.column_flags(F.filter("_sides", lambda s: ~F.exists("_gone", lambda g: g["box"] == s["box"])))
    rows = rows.withColumn("similarity", L.line_similarity(c("_raw"), c("_sorted"))).withColumn("two_column", two)
    rows = rows.withColumn("strategy", P.text_strategy(major, F.lit(False), c("landscape"), c("similarity")))
    rows = rows.withColumn("_source", F.when(c("strategy") == "coordinate_sorted", c("_sorted")).otherwise(c("_raw")))
    count = lambda x, char: F.length(x) - F.length(F.replace(x, F.lit(char), F.lit("")))
    controls = lambda x: F.length(x) - F.length(F.regexp_replace(x, r"[\x00-\x08\x0b\x0e-\x1f]", ""))
    bare = F.length(F.trim("raw_text"))
    scanned = (bare == 0) & c("_wordless")
    reason = F.when(scanned, "no_native_text").when((c("coverage") >= COVERED) & (bare < FEW), "large_embedded_images_with_limited_native_text")
    none = F.lit(0)
    return rows.select(
        *KEYS, "raw_text", T.page_text(c("_source")).alias("normalized_text"), "strategy", "similarity", scanned.alias("scanned"), "coverage",
        F.when(c("accepted"), c("label")).alias("page_label"),
        F.when(c("accepted"), "geometric").when(c("label").isNotNull(), "geometric_candidate_rejected").alias("label_source"),
        F.size("_gone").alias("layout_artifacts"), F.array_sort(F.array_distinct(F.transform("_gone", lambda g: g["reason"]))).alias("artifact_reasons"),
        count(c("_source"), "­").alias("soft_hyphens"), F.greatest(controls(c("raw_text")), controls(c("_source"))).alias("control_characters"),
        reason.alias("ocr_reason"), reason.isNotNull().alias("ocr_recommended"), "two_column", "landscape",
        *(none.alias(n) for n in ("unresolved_control_glyphs", "font_glyph_repairs", "accent_compositions", "unresolved_math_glyphs")),
    )
