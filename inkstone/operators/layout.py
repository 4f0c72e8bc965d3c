"""Layout: recurring artifacts, page-label runs, caption and region joins, line groups, merged rectangles."""

from difflib import SequenceMatcher
from functools import reduce
from operator import and_

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T


def lines(pages: DataFrame, keys: list[str], text_col: str = "text") -> DataFrame:
    """keys, line (from 1) and content."""
    return pages.select(*keys, F.posexplode(F.split(text_col, "\n", -1)).alias("line", "content")).withColumn("line", F.col("line") + 1)


def recurring(candidates: DataFrame, key: list[str], page: str, least: int | Column) -> DataFrame:
    """Candidates whose key stands on at least so many different pages. Only keys' digests (two hashes of 64 bits) and pages
    are shuffled to count; distinct pages come first, so a key that most rows share is reduced before it meets. A semi join
    brings the candidates back."""
    marked = candidates.withColumn("_a", F.xxhash64(*key)).withColumn("_b", F.xxhash64(F.lit("b"), *key))
    parts = ["_a", "_b"] if isinstance(least, int) else ["_a", "_b", *key]
    counted = marked.select(*parts, page).distinct().groupBy(*parts).agg(F.count(page).alias("_pages"))
    wanted = counted.where(F.col("_pages") >= least).select("_a", "_b")
    return marked.join(wanted, ["_a", "_b"], "left_semi").drop("_a", "_b")


def layout_reason(x0: Column, y0: Column, x1: Column, y1: Column, width: Column, height: Column) -> Column:
    """Where an edge block stands: vertical margin, header or footer; else null."""
    w, h = F.greatest(F.lit(0.0), x1 - x0), F.greatest(F.lit(0.0), y1 - y0)
    side = (x1 <= width * 0.14) | (x0 >= width * 0.86)
    low = h <= height * 0.035
    return (
        F.when(side & (w <= width * 0.06) & (h >= height * 0.30), "repeated_vertical_margin")
        .when((y1 <= height * 0.07) & low, "repeated_header")
        .when((y0 >= height * 0.94) & low, "repeated_footer")
    )


def label_runs(pages: DataFrame, paper: str, page: str, label: str, least: int = 3) -> DataFrame:
    """pages with `accepted`: labels in a run of `least` pages or more whose numerals, of one kind, rise by one."""
    by_page = Window.partitionBy(paper).orderBy(page)
    marked = pages.withColumn("_kind", T.label_kind(F.col(label))).withColumn("_value", T.label_value(F.col(label)))
    follows = (
        (F.lag(page).over(by_page) == F.col(page) - 1)
        & (F.lag("_kind").over(by_page) == F.col("_kind"))
        & (F.lag("_value").over(by_page) == F.col("_value") - 1)
    )
    runs = marked.withColumn("_breaks", F.when(F.coalesce(follows, F.lit(False)), 0).otherwise(1))
    runs = runs.withColumn("_run", F.sum("_breaks").over(by_page))
    size = F.count(label).over(Window.partitionBy(paper, "_run"))
    return runs.withColumn("accepted", F.col("_value").isNotNull() & (size >= least)).drop("_kind", "_value", "_breaks", "_run")


def overlap(a: str, b: str) -> Column:
    """Whether two boxes (columns x0, y0, x1, y1 under the two names) share more than an edge."""
    c = F.col
    return (c(f"{a}.x0") < c(f"{b}.x1")) & (c(f"{b}.x0") < c(f"{a}.x1")) & (c(f"{a}.y0") < c(f"{b}.y1")) & (c(f"{b}.y0") < c(f"{a}.y1"))


def nearest_caption(tables: DataFrame, captions: DataFrame) -> DataFrame:
    """(page, box, caption): for each table the caption of its page that intersects it, nearest by top edges, the first
    of equals. An equi join on pages with the boxes' condition; the least is pre-aggregated, not sorted."""
    near = tables.alias("t").join(captions.alias("c"), (F.col("t.page") == F.col("c.page")) & overlap("t", "c"))
    distance = F.abs(F.col("t.y0") - F.col("c.y0"))
    best = F.min(F.struct(distance.alias("distance"), F.col("c.box").alias("caption")))
    return near.groupBy(F.col("t.page").alias("page"), F.col("t.box").alias("box")).agg(best.alias("m")).select("page", "box", "m.caption", "m.distance")


def excluded(candidates: DataFrame, regions: DataFrame, share: float = 0.5) -> DataFrame:
    """Candidates of which no region of the page covers `share` or more; one without a box goes if its page has regions."""
    c = F.col
    width = F.greatest(F.lit(0.0), F.least(c("t.x1"), c("r.x1")) - F.greatest(c("t.x0"), c("r.x0")))
    height = F.greatest(F.lit(0.0), F.least(c("t.y1"), c("r.y1")) - F.greatest(c("t.y0"), c("r.y0")))
    area = F.greatest(F.lit(0.0), (c("t.x1") - c("t.x0")) * (c("t.y1") - c("t.y0")))
    covered = (area > 0) & (width * height >= share * area)
    return candidates.alias("t").join(
        regions.alias("r"), (c("t.page") == c("r.page")) & (covered | c("t.x0").isNull()), "left_anti"
    )


def images_in_crops(crops: DataFrame, images: DataFrame) -> DataFrame:
    """(page, box, n_images, status) of each crop: images of its page that intersect it, or that have no box."""
    c = F.col
    some = crops.alias("f").join(images.alias("i"), (c("f.page") == c("i.page")) & (c("i.x0").isNull() | overlap("f", "i")), "left")
    counts = some.groupBy(c("f.page").alias("page"), c("f.box").alias("box")).agg(F.count("i.box").alias("n_images"))
    return counts.withColumn("status", F.when(c("n_images") > 0, "embedded_image").otherwise("page_crop"))


def _label_place(w: str | Column, width: float | Column, height: float | Column) -> tuple[Column, Column]:
    """Whether a word (its column, or "" for columns of that name) stands in the footer or header band, and how far it is from
    an edge and from the middle; a header's counts as farther."""
    x0, y0, x1, y1 = (F.col(n) if isinstance(w, str) else w[n] for n in ("x0", "y0", "x1", "y1"))
    foot, head = y0 >= height * 0.88, y1 <= height * 0.08
    middle = F.abs((x0 + x1) / 2 - width / 2) / F.greatest(F.lit(width), F.lit(1.0))
    return foot | head, F.when(foot, height - y1).otherwise(y0 + height * 0.05) + middle


def label_by_place(words: DataFrame, keys: list[str], width: float | Column, height: float | Column) -> DataFrame:
    """keys and label: the word in the footer or header band that could be a page label and is nearest to an edge and,
    after that, to the middle; a header's counts as farther."""
    near, score = _label_place("", width, height)
    some = words.withColumn("_label", T.plausible_label(F.col("label"))).where(F.col("_label").isNotNull() & near).withColumn("_score", score)
    return some.groupBy(*keys).agg(F.min(F.struct("_score", "box", "_label")).alias("m")).select(*keys, F.col("m._label").alias("label"))


def label_in_words(words: Column, width: Column, height: Column) -> Column:
    """What label_by_place() tells of a page whose words are one array: a struct (score, box, label), its least the label. Only
    words in the bands are read as labels."""
    placed = F.filter(F.transform(words, lambda w, i: F.struct(w.alias("w"), i.alias("box"))), lambda p: _label_place(p["w"], width, height)[0])
    told = F.transform(placed, lambda p: F.struct(_label_place(p["w"], width, height)[1].alias("score"), p["box"].alias("box"), T.plausible_label(p["w"]["label"]).alias("label")))
    return F.array_min(F.filter(told, lambda t: t["label"].isNotNull()))


def two_columns(blocks: DataFrame, keys: list[str], width: float | Column, least: int = 2, characters: int = 180) -> DataFrame:
    """keys, two_columns and column_major: enough blocks and text on both sides; then whether the left side's blocks all
    come before the right side's (its last before the other's first)."""
    left = F.col("x1") <= width * 0.55
    right = F.col("x0") >= width * 0.45
    side = lambda s: (F.count_if(s) >= least) & (F.coalesce(F.sum(F.when(s, F.length("label"))), F.lit(0)) >= characters)
    out = blocks.groupBy(*keys).agg(
        (side(left) & side(right & ~left)).alias("two_columns"),
        (F.max(F.when(left, F.col("box"))) < F.min(F.when(right & ~left, F.col("box")))).alias("column_major"),
    )
    return out.withColumn("column_major", F.coalesce(F.col("column_major") & F.col("two_columns"), F.lit(False)))


def block_sides(blocks: Column, width: Column) -> Column:
    """array of (box, left, n) of a page's text blocks that stand on one side: what column_flags() needs, without texts."""
    left = lambda b: b["x1"] <= width * 0.55
    side = lambda b: F.when(left(b), True).when((b["x0"] >= width * 0.45) & ~left(b), False)
    told = F.transform(blocks, lambda b, i: F.struct(i.alias("box"), F.when(b["is_text"], side(b)).alias("left"), F.length(b["label"]).alias("n")))
    return F.filter(told, lambda s: s["left"].isNotNull())


def column_flags(sides: Column, least: int = 2, characters: int = 180) -> tuple[Column, Column]:
    """two_columns and column_major as two_columns() has them, of a page's blocks as block_sides() gives them."""
    own = {k: F.filter(sides, (lambda s: s["left"]) if k else (lambda s: ~s["left"])) for k in (True, False)}
    letters = lambda a: F.aggregate(a, F.lit(0).cast("long"), lambda n, s: n + F.coalesce(s["n"], F.lit(0)))
    two = F.coalesce(reduce(and_, ((F.size(a) >= least) & (letters(a) >= characters) for a in own.values())), F.lit(False))
    box = lambda a: F.transform(a, lambda s: s["box"])
    return two, two & F.coalesce(F.array_max(box(own[True])) < F.array_min(box(own[False])), F.lit(False))


def coverage(images: DataFrame, keys: list[str], page_area: float) -> DataFrame:
    """keys and coverage: the images' summed share of the page, one at most, to three places."""
    area = F.greatest(F.lit(0.0), (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0")))
    return images.groupBy(*keys).agg(F.round(F.least(F.lit(1.0), F.sum(area) / page_area), 3).alias("coverage"))


def line_groups(words: DataFrame, keys: list[str], gap: float = 3.0) -> DataFrame:
    """keys, line_no, x0, y0, x1, y1 and content: words by height, one joins the row if it is within `gap` of the mean
    height of the row so far. A word farther than that below the one before it opens a row whatever the mean is, so only
    the words between two such places, few, are folded."""
    order = Window.partitionBy(*keys).orderBy("y0", "x0", "x1", "y1", "label")
    rows = words.withColumn("_new", F.coalesce(F.col("y0") - F.lag("y0").over(order) > gap, F.lit(True)).cast("int"))
    rows = rows.withColumn("_run", F.sum("_new").over(order))
    sorted_words = F.sort_array(F.collect_list(F.struct("y0", "x0", "x1", "y1", F.col("label").alias("word"))))
    word = "struct<y0:double,x0:double,x1:double,y1:double,word:string>"
    start = F.from_json(F.lit("[]"), f"array<struct<mean:double,n:int,words:array<{word}>>>")

    def step(done: Column, w: Column) -> Column:
        last = F.get(done, F.size(done) - 1)
        joined = F.struct(((last["mean"] * last["n"] + w["y0"]) / (last["n"] + 1)).alias("mean"), (last["n"] + 1).alias("n"), F.concat(last["words"], F.array(w)).alias("words"))
        fresh = F.struct(w["y0"].alias("mean"), F.lit(1).alias("n"), F.array(w).alias("words"))
        near = F.coalesce(F.abs(w["y0"] - last["mean"]) <= gap, F.lit(False))
        grown = F.concat(F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))), F.array(joined))
        kind = f"array<struct<mean:double,n:int,words:array<{word}>>>"
        return F.when(near, grown.cast(kind)).otherwise(F.concat(done, F.array(fresh)).cast(kind))

    folded = rows.groupBy(*keys, "_run").agg(F.aggregate(sorted_words, start, step).alias("rows"))
    each = folded.select(*keys, "_run", F.posexplode("rows").alias("_k", "r"))
    by_x = F.array_sort(F.transform("r.words", lambda w: F.struct(w["x0"].alias("x0"), w["word"].alias("word"))))
    return each.select(
        *keys,
        F.row_number().over(Window.partitionBy(*keys).orderBy("_run", "_k")).alias("line_no"),
        F.array_min("r.words.x0").alias("x0"),
        F.array_min("r.words.y0").alias("y0"),
        F.array_max("r.words.x1").alias("x1"),
        F.array_max("r.words.y1").alias("y1"),
        F.array_join(F.transform(by_x, lambda w: w["word"]), " ").alias("content"),
    )


def merge_rectangles(rows: list[tuple[float, float, float, float]], gap: float = 18.0) -> list[tuple[float, float, float, float]]:
    """Rectangles that are within `gap` of each other become their hull, until none are."""
    rects = list(rows)
    merged = True
    while merged:
        merged, out = False, []
        for r in rects:
            for i, o in enumerate(out):
                if r[0] - gap <= o[2] and o[0] - gap <= r[2] and r[1] - gap <= o[3] and o[1] - gap <= r[3]:
                    out[i] = (min(r[0], o[0]), min(r[1], o[1]), max(r[2], o[2]), max(r[3], o[3]))
                    merged = True
                    break
            else:
                out.append(r)
        rects = out
    return sorted(rects)


def merged_regions(boxes: DataFrame, page: str = "page", least: float = 12.0, gap: float = 18.0) -> DataFrame:
    """(page, region, x0, y0, x1, y1): a page's boxes of `least` points a side, merged by nearness; the closure depends on
    grown boxes, so it is a fold over a page. Pages are small, so a batch holds many, each as one list of corners."""
    big = boxes.where((F.col("x1") - F.col("x0") >= least) & (F.col("y1") - F.col("y0") >= least))
    ordered = F.sort_array(F.collect_list(F.struct("y0", "x0", "y1", "x1")))
    corners = F.flatten(F.transform(ordered, lambda b: F.array(b["x0"], b["y0"], b["x1"], b["y1"])))

    @F.pandas_udf("array<double>")
    def merged(pages: pd.Series) -> pd.Series:
        some = (x.tolist() for x in pages)
        return pd.Series([[v for r in merge_rectangles(list(zip(*[iter(x)] * 4, strict=True)), gap) for v in r] for x in some])

    done = big.groupBy(page).agg(corners.alias("c")).select(F.col(page).alias("page"), merged("c").alias("c"))
    at = lambda k, i: F.get("c", 4 * k + i)
    rows = F.transform(F.sequence(F.lit(0), F.expr("size(c) div 4 - 1").cast("int")), lambda k: F.struct((k + 1).alias("region"), *(at(k, i).alias(n) for i, n in enumerate(("x0", "y0", "x1", "y1")))))
    return done.select("page", F.inline(rows))


def line_similarity(raw: Column, sorted_text: Column) -> Column:
    """Ratcliff-Obershelp similarity of two texts' lines that are not blank, in order; 1 where both have none. Texts that are
    equal don't go to a Python worker."""

    @F.pandas_udf("double")
    def ratio(a: pd.Series, b: pd.Series) -> pd.Series:
        lines = lambda x: [" ".join(y.split()) for y in (x or "").split("\n") if y.strip()]
        some = ((x, y) for x, y in zip(a, b, strict=True))
        return pd.Series([1.0 if x is None and y is None else SequenceMatcher(None, lines(x), lines(y), autojunk=False).ratio() for x, y in some])

    differ = ~raw.eqNullSafe(sorted_text)
    return ratio(F.when(differ, raw), F.when(differ, sorted_text))


def remove_artifacts(text: Column, artifacts: Column) -> Column:
    """The text without each artifact text: its first whole occurrence, one after the other."""

    def step(now: Column, artifact: Column) -> Column:
        at = F.locate(artifact, now) if isinstance(artifact, str) else F.instr(now, artifact)
        cut = F.concat(F.substring(now, F.lit(1), at - 1), F.substring(now, at + F.length(artifact), F.length(now)))
        return F.when((F.length(artifact) >= 3) & (at > 0), cut).otherwise(now)

    return F.aggregate(artifacts, text, step)

