"""Repairs of extracted text: known font glyphs, and accents that stand apart from their letters."""

import unicodedata
from bisect import bisect_right
from difflib import Match, SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Spacing accents and their combining forms; slots of a mathematical extension font.
ACCENTS = {"`": "̀", "´": "́", "^": "̂", "~": "̃", "˜": "̃", "¨": "̈", "ˇ": "̌", "˚": "̊"}
EXTENSION_SLOTS = {0: "(", 1: ")", 16: "(", 17: ")", 40: "{", 104: "[", 105: "]"}


def replace_all(text: Column, replacements: Column) -> Column:
    """The text with each (find, put) applied, longest first; a fold over a page's few repairs."""
    longest = F.array_sort(replacements, lambda a, b: F.length(b["find"]) - F.length(a["find"]))
    return F.aggregate(longest, text, lambda t, r: F.replace(t, r["find"], r["put"]))


def extension_glyph(font: Column, code: Column) -> Column:
    """What a slot of the extension font shows; null for other fonts and slots."""
    family = F.upper(F.regexp_replace(font, "^[A-Z]{6}\\+", ""))
    out = F.lit(None).cast("string")
    for slot, shown in EXTENSION_SLOTS.items():
        out = F.when(code == slot, shown).otherwise(out)
    return F.when(family.rlike("^CMEX[0-9]+$"), out)


def accent_fits(accent: str, base: str) -> Column:
    """Whether an accent's box (struct columns x0, x1, y, size, font) sits over a letter's."""
    a, b = F.col(accent), F.col(base)
    wide, narrow = a["x1"] - a["x0"], b["x1"] - b["x0"]
    shared = F.least(a["x1"], b["x1"]) - F.greatest(a["x0"], b["x0"])
    size = F.greatest(a["size"], b["size"], F.lit(1.0))
    return F.coalesce(
        (a["font"] == b["font"]) & (wide > 0) & (narrow > 0) & (shared >= 0.45 * F.least(wide, narrow))
        & (F.abs(a["y"] - b["y"]) <= F.greatest(F.lit(0.8), size * 0.12)) & (F.abs(a["size"] - b["size"]) <= size * 0.08),
        F.lit(False),
    )


def accent_repairs(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """keys, find and put: accent and letter pairs (columns accent, letter, a, b) that fit everywhere they stand; one
    misfit forbids the pair. Composed in Python, as no built-in function normalises Unicode."""

    @F.pandas_udf("string")
    def composed(accents: pd.Series, letters: pd.Series) -> pd.Series:
        return pd.Series([unicodedata.normalize("NFC", x + ACCENTS[a]) if a in ACCENTS else None for a, x in zip(accents, letters, strict=True)])

    sure = pairs.groupBy(*keys, "accent", "letter").agg(F.bool_and(accent_fits("a", "b")).alias("ok")).where("ok")
    out = sure.select(*keys, F.concat("accent", "letter").alias("find"), composed("accent", "letter").alias("put"))
    return out.where((F.col("put").isNotNull()) & (F.length("put") == 1))


def common_letters(a: str, b: str) -> int:
    """Length of the longest common subsequence, a row of its table as the bits of one number."""
    places: dict[str, int] = {}
    for i, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << i
    every = left = (1 << len(a)) - 1
    for c in b:
        met = left & places.get(c, 0)
        left = (left + met | left - met) & every
    return len(a) - left.bit_count()


def align(source: str, target: str, repairs: list[tuple[int, str]], least: float = 0.9) -> tuple[str, int]:
    """The target with the source's repairs (place, put) at the characters that correspond to their places, and how many
    there are; the target as it is where the two are less alike than `least`.

    Matched characters are a common subsequence, so texts whose longest one is too short are not matched at all; equal texts
    are one block."""
    if not repairs:
        return target, 0
    if source == target:
        blocks = [Match(0, 0, len(source))]
    else:
        size = len(source) + len(target)
        if 2.0 * min(len(source), len(target)) / size < least or 2.0 * common_letters(source, target) / size < least:
            return target, 0
        matcher = SequenceMatcher(None, source, target, autojunk=False)
        if matcher.ratio() < least:
            return target, 0
        blocks = [b for b in matcher.get_matching_blocks() if b.size]
    starts, put = [b.a for b in blocks], {}
    for place, new in repairs:
        k = bisect_right(starts, place) - 1
        if k >= 0 and place < blocks[k].a + blocks[k].size:
            put[blocks[k].b + place - blocks[k].a] = new
    return "".join(put.get(i, c) for i, c in enumerate(target)), len(put)


def aligned_repairs(source: Column, target: Column, repairs: Column) -> Column:
    """struct(text, applied) of align() for each row; repairs are structs of place and put."""

    @F.pandas_udf("text string, applied int")
    def aligned(sources: pd.Series, targets: pd.Series, some: pd.Series) -> pd.DataFrame:
        rows = [align(a or "", b or "", [(r["place"], r["put"]) for r in (x if x is not None else ())]) for a, b, x in zip(sources, targets, some, strict=True)]
        return pd.DataFrame(rows, columns=["text", "applied"])

    return aligned(source, target, repairs)


def repaired_words(words: DataFrame, repairs: DataFrame, keys: list[str], slack: float = 0.75) -> DataFrame:
    """words (keys, word, x0, y0, x1, y1, label) with `label` repaired and `repaired`: repairs (keys, x0, y0, x1, y1, find, put)
    whose middle lies in a word's box take the place of its text if they spell all of it, from left to right."""
    c = F.col
    x, y = (c("r.x0") + c("r.x1")) / 2, (c("r.y0") + c("r.y1")) / 2
    inside = x.between(c("w.x0") - slack, c("w.x1") + slack) & y.between(c("w.y0") - slack, c("w.y1") + slack)
    same = [c(f"w.{k}") == c(f"r.{k}") for k in keys]
    near = words.alias("w").join(repairs.alias("r"), [*same, inside])
    listed = F.array_sort(F.collect_list(F.struct(c("r.x0").alias("x0"), c("r.y0").alias("y0"), c("r.find").alias("find"), c("r.put").alias("put"))))
    found = near.groupBy(*[c(f"w.{k}").alias(k) for k in keys], c("w.word").alias("word")).agg(listed.alias("_r"))
    spelled = lambda part: F.array_join(F.transform("_r", lambda r: r[part]), "")
    out = words.join(found, [*keys, "word"], "left")
    fits = F.coalesce(spelled("find") == c("label"), F.lit(False))
    return out.withColumn("repaired", F.when(fits, F.size("_r")).otherwise(0)).withColumn("label", F.when(fits, spelled("put")).otherwise(c("label"))).drop("_r")
