"""Pairs of findings that can be alike, as relations. Within a paper's class of issues pairs are found by rare stems that
both have, by an index that holds so few stems of each text that no pair is missed; likeness of letters, which no stem bounds,
is found block by block. Findings that no pair links cannot come together, so later folds see linked findings only."""

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..session import cut, once, release, spread

KEYS = ["paper_id", "issue_class"]
#: Least shared stems of summaries, and of summaries with claims: a pair under both reaches no floor on stems.
SHORT, LONG = 4, 8
#: Texts that are compared at a time for likeness of letters.
BLOCK = 192


def distinct_texts(findings: DataFrame) -> DataFrame:
    """(paper_id, issue_class, id, summary, short, long) of what findings say: findings of one class with the same summary and
    claim are one, by the smallest id; short are stems of the summary, long those of both."""
    text = lambda c: F.coalesce(c, F.lit(""))
    digest = F.sha2(F.concat_ws(":", F.length(text("summary")).cast("string"), text("summary"), text("claim")), 256)
    one = findings.groupBy(*KEYS, digest.alias("_d")).agg(F.min(F.struct("id", text("summary").alias("summary"), text("claim").alias("claim"))).alias("m"))
    return one.select(
        *KEYS, "m.id", T.comparable(F.col("m.summary")).alias("summary"), T.tokens(F.col("m.summary")).alias("short"),
        T.tokens(F.concat_ws(" ", "m.summary", "m.claim")).alias("long"),
    )


def counted(texts: DataFrame) -> DataFrame:
    """(paper_id, issue_class, kind, id, token, n): how often each text has each stem, of its kinds short and long."""
    kinds = F.inline(F.array(*(F.struct(F.lit(k).alias("kind"), F.col(k).alias("tokens")) for k in ("short", "long"))))
    each = once(texts, short=F.col("short"), long=F.col("long")).select(*KEYS, "id", kinds)
    return each.select(*KEYS, "kind", "id", F.explode("tokens").alias("token")).groupBy(*KEYS, "kind", "id", "token").agg(F.count("*").alias("n"))


def sharing(counts: DataFrame, keys: list[str], least: Column) -> DataFrame:
    """(keys, a, b), a before b, of rows of the same keys that may share `least` different tokens; no such pair is missed.

    Two rows that share so many have one in common among the rarest of each, all but the last least - 1; only those are
    indexed, so frequent tokens meet nothing unless a row has nothing else."""
    often = counts.groupBy(*keys, "token").agg(F.count("*").alias("rows"))
    ranked = counts.join(often, [*keys, "token"])
    row = Window.partitionBy(*keys, "id")
    place, size = F.row_number().over(row.orderBy("rows", "token")), F.count("*").over(row)
    index = ranked.withColumn("place", place).withColumn("size", size).where(F.col("place") <= F.col("size") - least + 1).where("rows > 1")
    left, right = (index.select(*keys, "token", F.col("id").alias(side)) for side in ("a", "b"))
    return left.join(right, [*keys, "token"]).where("a < b").select(*keys, "a", "b").distinct()


def vectors(counts: DataFrame) -> DataFrame:
    """(paper_id, issue_class, id, and of short and long: tokens, more, norm) of counted() stems, a row a text; more is a map of
    the stems that a text has more than once."""
    out = []
    for k in ("short", "long"):
        own = F.col("kind") == k
        more = F.map_from_entries(F.collect_list(F.when(own & (F.col("n") > 1), F.struct("token", "n"))))
        norm = F.sqrt(F.sum(F.when(own, F.col("n") * F.col("n"))))
        out.append(F.struct(F.collect_list(F.when(own, F.col("token"))).alias("tokens"), more.alias("more"), norm.alias("norm")).alias(k))
    return counts.groupBy(*KEYS, "id").agg(*out)


def stem_pairs(texts: DataFrame) -> DataFrame:
    """(paper_id, issue_class, a, b, short_cosine, short_shared, long_cosine, long_shared) of all pairs of distinct_texts()
    that share four stems of their summaries or eight of summaries and claims. A pair meets its two texts' stems as one row
    each, so what is joined grows with pairs and not with their stems."""
    c = F.col
    counts = cut(counted(texts))
    pairs = sharing(counts, [*KEYS, "kind"], F.when(c("kind") == "short", SHORT).otherwise(LONG)).select(*KEYS, "a", "b").distinct()
    told = vectors(counts)
    side = lambda x: told.select(*KEYS, c("id").alias(x), F.struct("short", "long").alias(f"_{x}"))
    rows = pairs.join(side("a"), [*KEYS, "a"]).join(side("b"), [*KEYS, "b"])
    both = {k: F.array_intersect(f"_a.{k}.tokens", f"_b.{k}.tokens") for k in ("short", "long")}
    rows = once(rows, **{f"_{k}": v for k, v in both.items()}).where((F.size("_short") >= SHORT) | (F.size("_long") >= LONG))
    times = lambda x, k, t: F.coalesce(F.try_element_at(c(f"_{x}.{k}.more"), t), F.lit(1).cast("long"))
    dots = lambda k: F.aggregate(f"_{k}", F.lit(0).cast("long"), lambda s, t: s + times("a", k, t) * times("b", k, t))
    out = []
    for k in ("short", "long"):
        cosine = F.coalesce(dots(k) / (c(f"_a.{k}.norm") * c(f"_b.{k}.norm")), F.lit(0.0))
        out += [cosine.alias(f"{k}_cosine"), F.size(f"_{k}").cast("long").alias(f"{k}_shared")]
    return rows.select(*KEYS, "a", "b", *out)


def letter_pairs(texts: DataFrame, least: float) -> DataFrame:
    """(paper_id, issue_class, a, b) of pairs whose summaries can reach a text similarity of `least`, a superset of those that do.

    Matched letters are at most what both have of each letter; they stand in one run more at most than there are unmatched
    letters, so of their neighbours so many are shared too. A class's texts are dealt to blocks, and two blocks meet in one
    task, which holds no more than that; only pairs within the bounds leave it."""
    some = texts.where("summary <> ''").select(*KEYS, "id", "summary")
    blocks = some.groupBy(*KEYS).agg(F.ceil(F.count("*") / BLOCK).alias("blocks"))
    dealt = some.join(blocks, KEYS).withColumn("at", F.pmod(F.xxhash64("id"), F.col("blocks")))
    meets = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))
    dealt = dealt.withColumn("other", meets).select(*KEYS, F.least("at", "other").alias("i"), F.greatest("at", "other").alias("j"), "at", "id", "summary")

    def bounded(group: pd.DataFrame) -> pd.DataFrame:
        rows = group.sort_values("id").reset_index(drop=True)
        letters, neighbours = _counts(rows["summary"], 1), _counts(rows["summary"], 2)
        size, at, ids = letters.sum(axis=1), rows["at"].to_numpy(), rows["id"].to_numpy()
        crosses = group["i"].iat[0] != group["j"].iat[0]
        left, right = [], []
        for k in range(1, len(rows)):
            both = size[:k] + size[k]
            here = 2 * np.minimum(letters[:k], letters[k]).sum(axis=1) >= least * both - 1e-6
            if crosses:
                here &= at[:k] != at[k]
            near = np.flatnonzero(here)
            runs = least * both[near] / 2 - (1 - least) * both[near] - 1 - 1e-6
            near = near[np.minimum(neighbours[near], neighbours[k]).sum(axis=1) >= runs]
            left += ids[near].tolist()
            right += [ids[k]] * len(near)
        return pd.DataFrame({"paper_id": group["paper_id"].iat[0], "issue_class": group["issue_class"].iat[0], "a": np.array(left, np.int64), "b": np.array(right, np.int64)})

    return spread(dealt, *KEYS, "i", "j").groupBy(*KEYS, "i", "j").applyInPandas(bounded, "paper_id string, issue_class string, a long, b long")


def _counts(texts: pd.Series, n: int) -> np.ndarray:
    """How often each text has each run of n letters."""
    runs = [[x[i : i + n] for i in range(len(x) - n + 1)] for x in texts]
    place = {v: k for k, v in enumerate(dict.fromkeys(v for row in runs for v in row))}
    out = np.zeros((len(runs), max(1, len(place))), np.int32)
    for i, row in enumerate(runs):
        np.add.at(out[i], [place[v] for v in row], 1)
    return out


def components(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, id, component) of what pairs (keys, a, b) link; component is the smallest id that links reach. Each round takes
    the smallest label of the neighbours and then that label's own, so rounds grow with the logarithm of a path."""
    both = cut(pairs.select(*keys, "a", "b").union(pairs.select(*keys, F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    now = cut(both.groupBy(*keys, F.col("a").alias("id")).agg(F.least("id", F.min("b")).alias("component")))
    while True:
        near = both.join(now.withColumnRenamed("id", "b"), [*keys, "b"]).groupBy(*keys, F.col("a").alias("id")).agg(F.min("component").alias("near"))
        own = now.select(*keys, F.col("id").alias("component"), F.col("component").alias("far"))
        step = now.join(own, [*keys, "component"], "left").join(near, [*keys, "id"], "left")
        after = cut(step.select(*keys, "id", F.least("component", "far", "near").alias("component"), F.col("component").alias("before")))
        release(now)
        now = after
        if now.where("component <> before").isEmpty():
            release(both)
            return now.select(*keys, "id", "component")


def linked(findings: DataFrame, least: float) -> DataFrame:
    """(paper_id, issue_class, id, component) of the findings that another may be alike to; all findings of one text are one
    point, so a group of copies is linked by its text and not by its pairs."""
    digest = F.sha2(F.concat_ws(":", F.length(F.coalesce("summary", F.lit(""))).cast("string"), F.coalesce("summary", F.lit("")), F.coalesce("claim", F.lit(""))), 256)
    texts = cut(distinct_texts(findings))
    pairs = stem_pairs(texts).select(*KEYS, "a", "b").union(letter_pairs(texts, least))
    found = components(pairs, KEYS)
    members = findings.select(*KEYS, "id", digest.alias("_d"))
    first = members.groupBy(*KEYS, "_d").agg(F.min("id").alias("first"), F.count("*").alias("times"))
    points = first.join(found.withColumnRenamed("id", "first"), [*KEYS, "first"], "left").where("component IS NOT NULL OR times > 1")
    points = points.select(*KEYS, "_d", F.coalesce("component", "first").alias("component"))
    return members.join(points, [*KEYS, "_d"]).select(*KEYS, "id", "component")
