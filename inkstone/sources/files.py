"""Readers and writers: strict JSON, ratings, event logs, table cells, page text, snapshots, sealed results.

Readers parse with Spark's own sources; a page extractor for PDF files is plugged in by the caller, since page text is an
input here. Writers go through Spark's commit protocol, so a failed job leaves no half-written result.
"""

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import checks as C
from ..operators.ranking import markdown_cell

PAGE = "path string, page int, width double, height double, raw_text string"
#: A page with its words, blocks and images, as a caller's reader gives them.
WORD = "struct<x0:double,y0:double,x1:double,y1:double,label:string,block:int,line:int,word:int>"
BLOCK = "struct<x0:double,y0:double,x1:double,y1:double,label:string,block:int,is_text:boolean>"
IMAGE = "struct<xref:long,width:int,height:int,boxes:array<array<double>>>"
PAGE_PARTS = f"{PAGE}, words array<{WORD}>, blocks array<{BLOCK}>, images array<{IMAGE}>"


def strict_json(text: Column) -> Column:
    """The JSON text as a variant; null for duplicate keys, NaN, infinities, trailing text and lone surrogates. The parser
    stops after the first value, so trailing text is found by what it breaks as an array's and as an object's only value."""
    lone = text.rlike(r"(?i)\\ud[89ab][0-9a-f]{2}(?!\\ud[c-f][0-9a-f]{2})|(?<!\\ud[89ab][0-9a-f]{2})\\ud[c-f][0-9a-f]{2}")
    listed = F.try_parse_json(F.concat(F.lit("["), text, F.lit("]")))
    keyed = F.try_parse_json(F.concat(F.lit('{"a":'), text, F.lit("}")))
    only = lambda v: F.when(F.try_variant_get(v, "$[1]", "variant").isNull(), F.try_variant_get(v, "$[0]", "variant"))
    return F.when(~lone & keyed.isNotNull(), F.element_at(F.transform(F.array(listed), only), 1))


def json_documents(spark: SparkSession, path: str) -> DataFrame:
    """(path, document, error): whole files, each one JSON document; unsound ones have an error and no document."""
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    out = files.select("path", strict_json(F.col("value")).alias("document"))
    return out.withColumn("error", F.when(F.col("document").isNull(), "not strict JSON"))


def ratings(spark: SparkSession, path: str, escape: str = '"') -> DataFrame:
    """Ratings of a CSV file with a header, all text, `row` in file order; a byte-order mark is dropped."""
    rows = spark.read.csv(path, header=True, inferSchema=False, multiLine=True, encoding="UTF-8", escape=escape)
    first = rows.columns[0]
    rows = rows.withColumnRenamed(first, first.lstrip("﻿"))
    return rows.withColumn("row", F.monotonically_increasing_id())


def log_lines(spark: SparkSession, path: str) -> DataFrame:
    """(job, line, path): lines of logs that aren't blank; the job is the file's name."""
    lines = spark.read.text(path)
    name = F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+?)(?:\.[^./]*)?$", 1)
    return lines.select(name.alias("job"), F.col("value").alias("line"), F.col("_metadata.file_path").alias("path")).where(F.trim("line") != "")


def cells_of(text: Column) -> Column:
    """Rows of cells of a CSV text: quoted cells unquoted, also over line ends; a byte-order mark and empty last lines go."""
    clean = F.regexp_replace(F.regexp_replace(text, "\r\n?", "\n"), "^\ufeff|\n+$", "")
    cell = r'(?:"(?:[^"]|"")*"|[^",\n]*)'
    lines = F.regexp_extract_all(F.concat(clean, F.lit("\n")), F.lit(rf"({cell}(?:,{cell})*)\n"), 1)

    def bare(raw: Column) -> Column:
        inner = F.substring(raw, F.lit(2), F.length(raw) - 2)
        return F.when(raw.startswith('"'), F.replace(inner, F.lit('""'), F.lit('"'))).otherwise(raw)

    pieces = lambda line: F.regexp_extract_all(F.concat(F.lit(","), line), F.lit(rf",({cell})"), 1)
    return F.transform(lines, lambda line: F.transform(pieces(line), bare))


def csv_cells(spark: SparkSession, path: str) -> DataFrame:
    """(path, row, col, value): every cell of CSV tables, rows and columns from 1. A file is one partition's text, as its rows
    have no numbers of their own."""
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), cells_of(F.col("value")).alias("rows"))
    rows = files.select("path", F.posexplode("rows").alias("row", "cells"))
    return rows.select("path", (F.col("row") + 1).alias("row"), F.posexplode("cells").alias("col", "value")).withColumn("col", F.col("col") + 1)


def page_texts(spark: SparkSession, path: str, extract: Callable[[bytes], list[tuple[int, float, float, str]]]) -> DataFrame:
    """Pages (path, page, width, height, raw_text) of binary files by a caller's extractor, a file at a time."""

    def pages(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, content in zip(batch["path"], batch["content"], strict=True):
                rows = [(name, *page) for page in extract(bytes(content))]
                yield pd.DataFrame(rows, columns=["path", "page", "width", "height", "raw_text"])

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(pages, PAGE)


def page_parts(spark: SparkSession, path: str, read: Callable[[bytes], list[dict]]) -> DataFrame:
    """Pages (PAGE_PARTS) of binary files by a caller's reader, which gives a dictionary a page; a file that it can't read has
    no pages. A file is one call, so a lost executor costs its files again."""

    def pages(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ("page", "width", "height", "raw_text", "words", "blocks", "images")
        for batch in batches:
            for name, content in zip(batch["path"], batch["content"], strict=True):
                rows = [(name, *[page.get(k) for k in names]) for page in read(bytes(content))]
                yield pd.DataFrame(rows, columns=["path", *names])

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(pages, PAGE_PARTS)


def sorted_text(pages: DataFrame) -> DataFrame:
    """pages with sorted_text: words line by line from top to bottom and left to right; the raw text where there are none. Words
    are sorted by line and place once, and a line is a stretch of them, so a page costs what sorting its words does."""
    let = lambda value, use: F.element_at(F.transform(F.array(value), use), 1)
    rows = F.sort_array(F.transform("words", lambda w: F.struct(w["block"].alias("b"), w["line"].alias("l"), w["x0"].alias("x"), w["label"].alias("t"), w["y0"].alias("y"))))
    opens = lambda r, i: (i == 0) | ~F.struct(F.get(r, i)["b"], F.get(r, i)["l"]).eqNullSafe(F.struct(F.get(r, i - 1)["b"], F.get(r, i - 1)["l"]))
    starts = lambda r: F.filter(F.sequence(F.lit(0), F.size(r) - 1), lambda i: opens(r, i))
    part = lambda r, s, k: F.slice(r, F.get(s, k) + 1, F.coalesce(F.get(s, k + 1), F.size(r)) - F.get(s, k))
    line = lambda own: F.struct(F.array_min(F.transform(own, lambda w: w["y"])).alias("y"), F.get(own, F.lit(0))["x"].alias("x"), F.array_join(F.transform(own, lambda w: w["t"]), " ").alias("t"))
    told = let(rows, lambda r: let(starts(r), lambda s: F.sort_array(F.transform(s, lambda _, k: let(part(r, s, k), line)))))
    text = F.array_join(F.transform(told, lambda r: r["t"]), "\n")
    return pages.withColumn("sorted_text", F.when(F.coalesce(F.size("words"), F.lit(0)) > 0, text).otherwise(F.col("raw_text")))


def image_inventory(pages: DataFrame) -> DataFrame:
    """(path, image_id, page, xref, width, height, boxes) of the images of pages (PAGE_PARTS), numbered on each page."""
    rows = pages.select("path", "page", F.posexplode("images").alias("k", "i"))
    return rows.select("path", F.format_string("page_%03d_image_%02d", "page", F.col("k") + 1).alias("image_id"), "page", "i.xref", "i.width", "i.height", F.coalesce("i.boxes", F.array().cast("array<array<double>>")).alias("boxes"))


def corpus(pages: DataFrame, least: int = 3) -> DataFrame:
    """pages (paper, page, raw_text) with text, its normal form without recurring lines, and n_removed: one pass finds the lines
    that recur on `least` pages of a paper, digits apart, a second one takes them out. Only signatures meet in the first."""
    lines = pages.select("paper", "page", F.posexplode(F.split("raw_text", "\n", -1)).alias("line", "content")).withColumn("sig", T.signature(F.col("content")))
    some = lines.where(F.lower("content").rlike("[a-z]")).select("paper", "page", "sig").distinct()
    often = some.groupBy("paper", "sig").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    gone = often.groupBy("paper").agg(F.collect_set("sig").alias("_often"))  # the recurring lines of a paper
    kept = pages.join(gone, "paper", "left").withColumn("_lines", F.split("raw_text", "\n", -1))
    stays = F.filter("_lines", lambda x: ~F.coalesce(F.array_contains("_often", T.signature(x)), F.lit(False)))
    out = kept.withColumn("text", T.page_text(F.array_join(stays, "\n"))).withColumn("n_removed", F.size("_lines") - F.size(stays))
    return out.drop("_often", "_lines")


def table_scan(primary: DataFrame, fallback: DataFrame, page: list[str]) -> DataFrame:
    """Tables of the first finder, and of the second on pages where the first has none."""
    rest = fallback.join(primary.select(*page).distinct(), page, "left_anti")
    return primary.withColumn("finder", F.lit("primary")).unionByName(rest.withColumn("finder", F.lit("fallback")), allowMissingColumns=True)


def roster(rows: DataFrame) -> DataFrame:
    """Raters with defaults for what is left out: stage, policy, search, enabled."""
    defaults = {"stage": "review", "selection_policy": "mandatory", "search": False, "enabled": True}
    for name, value in defaults.items():
        rows = rows.withColumn(name, F.coalesce(F.col(name), F.lit(value)) if name in rows.columns else F.lit(value))
    return rows


def roster_errors(rows: DataFrame, unique: tuple[str, ...] = ("name", "output", "prompt", "id_prefix")) -> DataFrame:
    """(column, value): values that must be unique and aren't."""
    parts = [rows.groupBy(F.col(c).alias("value")).agg(F.count("*").alias("n")).where("n > 1").select(F.lit(c).alias("column"), "value") for c in unique]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


def write_new(df: DataFrame, path: str) -> None:
    """Writes a result that must not exist yet."""
    df.write.mode("errorifexists").parquet(path)


def seal(df: DataFrame, path: str) -> None:
    """Writes a result and beside it a manifest of its rows' number and digest."""
    write_new(df, f"{path}/data")
    stored = df.sparkSession.read.parquet(f"{path}/data")
    write_new(_manifest(stored), f"{path}/manifest")


def _manifest(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("rows"), F.sum(F.xxhash64(*df.columns).cast("decimal(38,0)")).alias("digest"))


def unseal(spark: SparkSession, path: str) -> DataFrame:
    """A sealed result; an error if its rows aren't those of its manifest."""
    data = spark.read.parquet(f"{path}/data")
    if spark.read.parquet(f"{path}/manifest").first() != _manifest(data).first():
        raise ValueError(f"{path} differs from its manifest")
    return data


def restore_errors(archives: DataFrame, members: DataFrame, sealed: DataFrame) -> DataFrame:
    """(archive, path, error), each once, of archives (archive, target_exists) that may not be restored: a target that is there
    already, members (archive, path, bytes, sha256, is_file) that break the limits or names, and sealed files (archive,
    path, sha256) that are lacking or differ."""
    c = F.col
    none = F.lit(None).cast("string")
    there = archives.where("target_exists").select("archive", none.alias("path"), F.lit("target exists").alias("error"))
    limits = C.archive_errors(members.select("archive", "path", "bytes"))
    whole = limits.select("archive", none.alias("path"), F.explode(F.split("errors", ",")).alias("error"))
    odd = members.where(~c("is_file")).select("archive", "path", F.lit("unsupported entry").alias("error"))
    have = members.select("archive", "path", c("sha256").alias("_now"))
    both = sealed.join(have, ["archive", "path"], "left").where(~c("sha256").eqNullSafe(c("_now")))
    differs = both.select("archive", "path", F.when(c("_now").isNull(), "sealed file lacking").otherwise("sealed file differs").alias("error"))
    return there.union(whole).union(odd).union(differs).distinct()


def table_sinks(tables: DataFrame) -> DataFrame:
    """tables (keys, header, rows of cells) with csv, markdown and json: cells quoted where they need it, pipes escaped, rows as
    objects by the header's names."""
    quoted = lambda x: F.when(x.rlike('[",\n]'), F.concat(F.lit('"'), F.replace(x, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(x)
    csv_line = lambda r: F.array_join(F.transform(r, quoted), ",")
    md_line = lambda r: F.concat(F.lit("| "), F.array_join(F.transform(r, markdown_cell), " | "), F.lit(" |"))
    every = F.concat(F.array("header"), "rows")
    rule = F.concat(F.lit("| "), F.array_join(F.transform("header", lambda _: F.lit("---")), " | "), F.lit(" |"))
    markdown = F.when(F.size("rows") > 0, F.concat_ws("\n", md_line(F.col("header")), rule, F.array_join(F.transform("rows", md_line), "\n"))).otherwise("_None._")
    objects = F.to_json(F.transform("rows", lambda r: F.map_from_arrays("header", r)))
    return tables.withColumn("csv", F.concat(F.array_join(F.transform(every, csv_line), "\n"), F.lit("\n"))).withColumn("markdown", markdown).withColumn("json", objects)


def table_roles(found: DataFrame, captioned: DataFrame) -> DataFrame:
    """(page, id, role, label) of a paper's tables: found ones (page, y0, box, label or null) numbered first, with the caption
    that matched them; then captioned ones (page, y0, box, label) that no found one has, as the caption anchors them."""
    rest = captioned.join(found.where("label is not null").select("page", "label"), ["page", "label"], "left_anti")
    role = F.when(F.col("label").isNotNull(), "caption_matched_table").otherwise("unlabeled_candidate")
    every = found.select("page", "y0", "box", "label", role.alias("role"), F.lit(0).alias("_k")).unionByName(rest.select("page", "y0", "box", "label", F.lit("caption_anchored_table").alias("role"), F.lit(1).alias("_k")))
    place = F.row_number().over(Window.partitionBy("page").orderBy("_k", "y0", "box", "label"))
    return every.select("page", F.format_string("table_%03d", place).alias("id"), "role", "label")
