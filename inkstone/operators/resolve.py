"""Which findings are one. What a text says is made once, as array columns; findings are then folded in order, by their texts:
what forbids a merge, how alike two texts are, which group fits. A class of few findings is one fold, of others what pairs link."""

import re
from collections import Counter, OrderedDict, defaultdict
from heapq import heappop, heappush
from difflib import SequenceMatcher
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.matching import of_rank, spans
from ..session import cut, small_batches, spread
from .pairs import KEYS, linked

# Patterns of locators and numbers, words of direction, floors of a merge.
LOCATOR = (
    r"\b(?P<kind>tables?|figures?|equations?|eqs?\.?|columns?|cols?\.?|panels?|appendix|appendices|sections?|pages?|experiments?)\s*"
    r"(?:\(\s*)?(?P<label>(?:[a-z]\.?)?\d+(?:\.\d+)*(?:[a-z])?)(?:\s*\))?(?:\s*[-–—]\s*(?:[a-z]\.?)?\d+(?:\.\d+)*(?:[a-z])?)?"
)
QUESTION = r"\bq(?:uestion)?\s*(?P<label>\d+(?:\.\d+)*)\b"
NUMBER = (
    r"(?<![\w.])(?:\()?\s*(?P<sign>[+\-−])?\s*(?P<number>(?:\d{1,3}(?:,\d{3})+|\d+)(?:\.\d+)?)"
    r"(?P<unit>\s*%|\s+percentage\s+points?|\s+percent(?:age)?)?\s*(?:\))?(?![A-Za-z0-9_])"
)
FORMULA_AFTER = r"^\s*[+*/^]\s*[a-zA-Z]"
KIND_STARTS = {"tab": "table", "fig": "figure", "eq": "equation", "col": "column", "panel": "panel", "append": "appendix", "section": "section", "page": "page"}
UP = (
    "above", "greater", "higher", "increase", "increased", "increases", "increasing", "larger", "overstate", "overstated",
    "overstatement", "overstates", "positive", "positively", "rise", "rises", "rising", "upward",
)
DOWN = (
    "below", "decline", "declines", "declining", "decrease", "decreased", "decreases", "decreasing", "downward", "less", "lower",
    "negative", "negatively", "smaller", "understate", "understated", "understatement", "understates",
)
#: Two findings are alike if they reach every floor of a row: cosine and shared stems of their summaries, the same of
#: summaries and claims together, text similarity of the summaries, and of the claims.
FLOORS = np.array(
    [
        (0.00, 0, 0.00, 0, 0.72, 0.00),
        (0.38, 4, 0.00, 0, 0.32, 0.00),
        (0.38, 6, 0.00, 0, 0.00, 0.00),
        (0.38, 4, 0.75, 0, 0.00, 0.00),
        (0.00, 0, 0.55, 8, 0.00, 0.00),
        (0.25, 3, 0.45, 8, 0.00, 0.85),
    ]
)
STRONG = 0.72
CLAIM_WEIGHT = 0.95
LAST_PAGE = 1_000_000
#: Findings, and characters of their texts, up to which a class is one fold without a search for pairs.
FEW, CHARACTERS = 1000, 1 << 16
#: Likenesses that a fold keeps, rather than finds again; texts up to which a worker keeps them for folds of the same texts.
KEPT, SAME = 1 << 22, 32


def with_said(rows: DataFrame, text: str, into: str) -> DataFrame:
    """rows with a column struct(places, numbers, directions) of a text: places as (key, item) of kinds and labels, numbers
    that are neither places nor factors of a formula as (key, item) of magnitudes and signs, in order, and up or down."""
    found = rows.withColumn("_found", spans(F.col(text), LOCATOR, QUESTION, flags=re.IGNORECASE)).withColumn("_digits", spans(F.col(text), NUMBER))
    return found.withColumn(into, _said(F.col(text), F.col("_found"), F.col("_digits"))).drop("_found", "_digits")


def _said(text: Column, found: Column, digits: Column) -> Column:
    pair = lambda key, item: F.struct(key.alias("key"), item.alias("item"))
    places = F.concat(
        F.transform(of_rank(found, 0), lambda m: pair(_kind(m["groups"]["kind"]), F.lower(m["groups"]["label"]))),
        F.transform(of_rank(found, 1), lambda m: pair(F.lit("question"), m["groups"]["label"])),
    )
    inside = lambda m: F.exists(found, lambda o: (m["start"] < o["end"]) & (m["end"] > o["start"]))
    factor = lambda m: F.substring(text, m["end"] + 1, F.length(text)).rlike(FORMULA_AFTER)
    unit = lambda m: F.when(F.lower(m["groups"]["unit"]).contains("point"), "pp").when(m["groups"]["unit"].isNotNull(), "%").otherwise("")
    sign = lambda m: F.replace(m["groups"]["sign"], F.lit("−"), F.lit("-"))
    numbers = F.transform(F.filter(digits, lambda m: ~inside(m) & ~factor(m)), lambda m: pair(T.magnitude(m["groups"]["number"], unit(m)), sign(m)))
    words = F.regexp_extract_all(F.lower(text), F.lit("([a-z]+)"), 1)
    ways = [F.when(F.arrays_overlap(words, F.array(*map(F.lit, some))), F.lit(way)) for way, some in (("up", UP), ("down", DOWN))]
    return F.struct(places.alias("places"), numbers.alias("numbers"), F.array_compact(F.array(*ways)).alias("directions"))


def _kind(word: Column) -> Column:
    out = F.lit("experiment")
    for start, name in KIND_STARTS.items():
        out = F.when(F.lower(word).startswith(start), name).otherwise(out)
    return out


class Sets:
    """Rows of sets as a 0/1 matrix; a column for each value that any row has."""

    def __init__(self, rows: list):
        values = {v: k for k, v in enumerate(dict.fromkeys(v for row in rows for v in row))}
        self.values = list(values)
        self.matrix = np.zeros((len(rows), len(values)), np.float32)
        for i, row in enumerate(rows):
            self.matrix[i, [values[v] for v in row]] = 1
        self.size = self.matrix.sum(axis=1)

    def shared(self, j: int) -> np.ndarray:
        """How many values each row shares with j."""
        return self.matrix @ self.matrix[j]


class Pairs:
    """Rows of sets of (key, item)."""

    def __init__(self, rows: list):
        self.items, self.keys = Sets(rows), Sets([{k for k, _ in row} for row in rows])
        place = {k: i for i, k in enumerate(self.keys.values)}
        self.key_of = np.zeros((len(self.items.values), len(place)), np.float32)
        for i, (k, _) in enumerate(self.items.values):
            self.key_of[i, place[k]] = 1

    def clash(self, j: int) -> np.ndarray:
        """Whether a row and j have a key in common for which they share no item."""
        common = (self.items.matrix * self.items.matrix[j]) @ self.key_of > 0
        both = (self.keys.matrix * self.keys.matrix[j]) > 0
        return (both & ~common).any(axis=1)


class Claims:
    """What one text of each finding says, and whether it contradicts that of another."""

    def __init__(self, texts: list[dict]):
        listed = lambda k: [[(x["key"], x["item"]) for x in t[k]] for t in texts]
        numbers = listed("numbers")
        signed = [[x for x in row if x[1] is not None] for row in numbers]
        self.places, self.signs = Pairs([set(r) for r in listed("places")]), Pairs([set(r) for r in signed])
        self.values, self.ways = Sets([{v for v, _ in row} for row in numbers]), Sets([set(t["directions"]) for t in texts])
        code = lambda rows: pd.factorize(pd.Series([repr(r) for r in rows], dtype=object))[0]
        self.sequence, self.length = code([[v for v, _ in r] for r in numbers]), np.array([len(r) for r in numbers])
        self.of_signed, self.signed_sequence = code([[v for v, _ in r] for r in signed]), code(signed)
        self.n_signed = np.array([len(r) for r in signed])

    def contradicts(self, j: int, upto: int | None = None) -> np.ndarray:
        """Other places or signs, numbers that neither text's cover, the same numbers in another order, opposite directions: of
        rows before j, or of those before `upto`."""
        shared, size = self.values.shared(j), self.values.size
        uncovered = (shared < size) & (shared < size[j])
        turned = (shared == size) & (shared == size[j]) & (self.length == self.length[j]) & (self.length[j] >= 2) & (self.sequence != self.sequence[j])
        resigned = (self.of_signed == self.of_signed[j]) & (self.n_signed[j] >= 2) & (self.signed_sequence != self.signed_sequence[j])
        opposed = (self.ways.size > 0) & (self.ways.size[j] > 0) & (self.ways.shared(j) == 0)
        return (self.places.clash(j) | self.signs.clash(j) | uncovered | turned | resigned | opposed)[: j if upto is None else upto]


class Postings:
    """An inverted index of counted words of all rows."""

    def __init__(self, rows: list):
        self.counts, entries = [Counter(words) for words in rows], defaultdict(list)
        for i, counts in enumerate(self.counts):
            for word, m in counts.items():
                entries[word].append((i, m))
        self.entries = {word: np.array(own).T for word, own in entries.items()}
        self.norms = np.array([np.sqrt(sum(m * m for m in c.values())) for c in self.counts])

    def compare(self, j: int) -> tuple[np.ndarray, np.ndarray]:
        """Cosine of each row with j, and how many words are shared."""
        dot, shared = np.zeros(len(self.counts)), np.zeros(len(self.counts))
        for word, m in self.counts[j].items():
            at, times = self.entries[word]
            dot[at] += m * times
            shared[at] += 1
        return np.divide(dot, self.norms * self.norms[j], out=np.zeros(len(dot)), where=dot > 0), shared


@lru_cache(1 << 14)
def ratio(a: str, b: str, least: float = 0.0) -> float:
    """Ratcliff-Obershelp similarity of two comparable texts, the first argument first; 0 if one is empty, or if quick upper
    bounds show that it is below `least`. Findings say the same again and again, so a worker keeps some."""
    if not a or not b or 2 * min(len(a), len(b)) < least * (len(a) + len(b)):
        return 0.0
    matcher = SequenceMatcher(None, a, b)
    return matcher.ratio() if not least or matcher.quick_ratio() >= least else 0.0


class Alike:
    """How alike texts are, and what forbids that they merge: found for a text when it is first asked for, and for a pair when
    one of its groups is open to the other."""

    def __init__(self, texts: list[dict]):
        self.summary, self.claim = [t["summary"] for t in texts], [t["claim"] for t in texts]
        self.sides = [Claims([t[k] for t in texts]) for k in ("summary_says", "claim_says")]
        self.words = [Postings([t[k] for t in texts]) for k in ("short", "long")]
        self.length = np.array([len(x) for x in self.summary])
        self.rows: dict[int, list] = {}
        self.kept = 0

    def row(self, u: int) -> list:
        """Of a text: which texts it may not merge with, a dict of those before it that can be alike, with what is known of
        them, and the scores of those that are."""
        if u not in self.rows:
            veto = self.sides[0].contradicts(u, len(self.summary)) | self.sides[1].contradicts(u, len(self.summary))
            reached = np.stack([x for words in self.words for x in words.compare(u)], axis=1)
            plausible = (reached[:, None] >= FLOORS[None, 1:, :4]).all(axis=2).any(axis=1)
            near = 2 * np.minimum(self.length, self.length[u]) >= STRONG * (self.length + self.length[u])
            some = np.flatnonzero(~veto & (plausible | near))
            if self.kept > KEPT:
                self.rows, self.kept = {}, 0
            self.kept += len(some) + len(veto) // 32
            self.rows[u] = [veto, dict(zip(some.tolist(), zip(reached[some].tolist(), plausible[some].tolist(), strict=True), strict=True)), {}]
        return self.rows[u]

    def score(self, row: list, t: int, u: int) -> float:
        """Likeness of u to the earlier t, -1 if they aren't alike."""
        veto, open_, scores = row
        if t in open_:
            reached, plausible = open_.pop(t)
            s = ratio(self.summary[t], self.summary[u], 0.0 if plausible else STRONG)
            if plausible or s >= STRONG:
                c = ratio(self.claim[t], self.claim[u])
                if (np.array([*reached, s, c]) >= FLOORS).all(axis=1).any():
                    scores[t] = max(s, reached[0], reached[2], CLAIM_WEIGHT * c)
        return scores.get(t, -1.0)


class State:
    """Groups that have the same raters' texts and page, so that they are alike to a finding and open to it in the same way."""

    def __init__(self, members: frozenset, page: float | None):
        self.members, self.page = members, page
        self.raters, self.texts = {r for r, _ in members}, Counter(t for _, t in members)
        self.groups: list[int] = []


def placed(alike: Alike, texts: list[int], raters: list, pages: list) -> list[int]:
    """Group numbers, from 0, of findings in order, each a text, a rater and a page or none: it joins the group that it is most
    alike to, the first of equals, or opens one. A group is closed to a finding that may not merge with one of its members,
    and one weak likeness alone does not join a finding to several. A rater is in a group once."""
    states: dict[tuple, State] = {}
    of_text: dict[int, dict] = defaultdict(lambda: defaultdict(dict))  # text, page: states by their key
    out, opened = [], 0
    for u, rater, page in zip(texts, raters, pages, strict=True):
        row = alike.row(u)
        veto, open_, scores = row
        best, chosen, seen = -1.0, None, set()
        for t in (*scores, *open_):
            for at in () if t not in of_text else list(of_text[t]) if page is None else (page, None):
                for key, state in of_text[t].get(at, {}).items():
                    if key in seen:
                        continue
                    seen.add(key)
                    if rater in state.raters or any(veto[x] for x in state.texts):
                        continue
                    found = [(s, n) for x, n in state.texts.items() if (s := alike.score(row, x, u)) >= 0]
                    if not found:
                        continue
                    s = max(found)[0]
                    if len(state.members) >= 2 and sum(n for _, n in found) == 1 and s < STRONG:
                        continue
                    if s > best or (s == best and state.groups[0] < chosen.groups[0]):
                        best, chosen = s, state
        if chosen is None:
            members, at, group, opened = frozenset([(rater, u)]), page, opened, opened + 1
        else:
            members, at, group = chosen.members | {(rater, u)}, page if chosen.page is None else chosen.page, heappop(chosen.groups)
            if not chosen.groups:
                del states[chosen.members, chosen.page]
                for x in chosen.texts:
                    del of_text[x][chosen.page][chosen.members, chosen.page]
        key = (members, at)
        if key not in states:
            states[key] = State(members, at)
            for x in states[key].texts:
                of_text[x][at][key] = states[key]
        heappush(states[key].groups, group)
        out.append(group)
    return out


def grouped(rows: pd.DataFrame) -> np.ndarray:
    """Group numbers, from 0, of findings in order (see placed). Findings of the same text, by `text` if there is such a column,
    are compared by it once."""
    parts = ["summary", "claim", "short", "long", "summary_says", "claim_says"]
    text = rows["text"] if "text" in rows else pd.Series([repr([x if isinstance(x, (str, dict)) else list(x) for x in r]) for r in rows[parts].itertuples(index=False, name=None)], index=rows.index)
    codes, _ = pd.factorize(text)
    first = np.unique(codes, return_index=True)[1]
    none = lambda xs: [None if x != x else x for x in xs]
    return np.array(placed(Alike(rows[parts].iloc[first].to_dict("records")), codes.tolist(), none(rows["rater"].tolist()), none(rows["page"].astype(float).tolist())), np.int64)


_known: OrderedDict[tuple, Alike] = OrderedDict()


def _alike(digests: tuple, texts: pa.ListScalar) -> Alike:
    """What is alike of a fold's texts; papers say the same few things, so a worker keeps some."""
    if digests in _known:
        _known.move_to_end(digests)
        return _known[digests]
    made = Alike(texts.as_py())
    if len(digests) <= SAME:
        _known[digests] = made
        if len(_known) > 64:
            _known.popitem(last=False)
    return made


def _placed(digests: pa.Array, texts: pa.Array, which: pa.Array, raters: pa.Array, pages: pa.Array) -> pa.Array:
    rows = zip(digests.to_pylist(), texts, which.to_pylist(), raters.to_pylist(), pages.to_pylist(), strict=True)
    return pa.array([placed(_alike(tuple(d), t), w, r, [None if p != p else p for p in g]) for d, t, w, r, g in rows], pa.list_(pa.int32()))


def _texts(rows: DataFrame) -> DataFrame:
    """(text, summary, claim, short, long, summary_says, claim_says): what each different text of findings says, by its digest."""
    said = rows.groupBy("text").agg(F.first("summary").alias("summary"), F.first("claim").alias("claim"))
    for c in ("summary", "claim"):
        said = with_said(said, c, f"{c}_says")
    return said.select(
        "text", T.comparable(F.col("summary")).alias("summary"), T.comparable(F.col("claim")).alias("claim"),
        T.tokens(F.col("summary")).alias("short"), T.tokens(F.concat_ws(" ", "summary", "claim")).alias("long"), "summary_says", "claim_says",
    )


def _whole(rows: DataFrame, said: DataFrame) -> DataFrame:
    """(paper_id, issue_class, id, k) of classes that are one fold each, so that groups are numbered as they are opened. A class's
    findings meet in one shuffle, as numbers of its texts."""
    c = F.col
    member = F.struct("at", c("rater").isNull().alias("none"), "rater", "id", "page")
    each = spread(rows.select(*KEYS, "text", "at", "rater", "id", "page"), *KEYS).groupBy(*KEYS, "text").agg(F.collect_list(member).alias("members"))
    parts = [x for x in said.columns if x != "text"]
    one = each.join(said, "text").groupBy(*KEYS).agg(F.array_sort(F.collect_list(F.struct("text", "members", F.struct(*parts).alias("said")))).alias("t"))
    members = F.transform("t", lambda t, i: F.transform(t["members"], lambda m: F.struct(*(m[k].alias(k) for k in ("at", "none", "rater", "id")), i.alias("which"), m["page"].alias("page"))))
    one = one.select(*KEYS, F.transform("t", lambda t: t["text"]).alias("digests"), F.transform("t", lambda t: t["said"]).alias("said"), F.array_sort(F.flatten(members)).alias("m"))
    numbers = F.arrow_udf(_placed, "array<int>")("digests", "said", F.transform("m", lambda m: m["which"]), F.transform("m", lambda m: m["rater"]), F.transform("m", lambda m: m["page"]))
    out = one.select(*KEYS, F.transform("m", lambda m: m["id"]).alias("id"), numbers.alias("k"))
    return out.select(*KEYS, F.inline(F.arrays_zip("id", "k"))).withColumn("k", c("k") + 1)


def _of_pairs(rows: DataFrame, said: DataFrame) -> DataFrame:
    """(paper_id, issue_class, id, k) of classes of many findings: what pairs link (pairs.linked) is one fold; findings that no
    pair links to others, most of them, need none. Groups of a class are numbered as they are opened."""

    def fold(group: pd.DataFrame) -> pd.DataFrame:
        some = group.sort_values(["at", "rater", "id"], kind="stable").reset_index(drop=True)
        opener = some.groupby(grouped(some))[["at", "rater", "id"]].transform("first")
        return pd.DataFrame({"paper_id": some["paper_id"], "issue_class": some["issue_class"], "id": some["id"], "at": opener["at"], "by": opener["rater"], "first": opener["id"]})

    some = cut(linked(rows, STRONG))
    keys = [*KEYS, "id"]
    alone = rows.join(some, keys, "left_anti").select(*keys, "at", F.col("rater").alias("by"), F.col("id").alias("first"))
    told = rows.drop("summary", "claim").join(some, keys).join(said, "text")
    folds = [*KEYS, "component"]
    folded = spread(told, *folds).groupBy(*folds).applyInPandas(fold, "paper_id string, issue_class string, id long, at double, by string, first long")
    every = cut(folded.union(alone))
    opened = every.select(*KEYS, "at", "by", "first").distinct()
    number = F.row_number().over(Window.partitionBy(*KEYS).orderBy("at", F.col("by").asc_nulls_last(), "first"))
    return every.join(opened.withColumn("k", number).select(*KEYS, "first", "k"), [*KEYS, "first"]).select(*keys, "k")


def clusters(findings: DataFrame) -> DataFrame:
    """(paper_id, id, cluster) of findings (paper_id, id, issue_class, rater, page, summary, claim), taken by page, rater and
    id; those without a page come last. The outcome depends on the order. Clusters of a class are numbered as they are opened."""
    text = lambda c: F.coalesce(c, F.lit("")).alias(c)
    rows = findings.select("paper_id", "id", "issue_class", "rater", F.col("page").cast("double").alias("page"), text("summary"), text("claim"))
    rows = rows.withColumn("at", F.coalesce("page", F.lit(LAST_PAGE)).cast("double"))
    rows = rows.withColumn("text", F.sha2(F.concat_ws(":", F.length("summary").cast("string"), "summary", "claim"), 256))
    small_batches(findings.sparkSession)
    said = cut(_texts(rows))
    size = rows.groupBy(*KEYS).agg(F.count("*").alias("n"), F.sum(F.length("summary") + F.length("claim")).alias("characters"))
    many = cut(size.where((F.col("n") > FEW) | (F.col("characters") > CHARACTERS)).select(*KEYS))
    if many.isEmpty():
        out = _whole(rows, said)
    else:
        out = _whole(rows.join(many, KEYS, "left_anti"), said).union(_of_pairs(rows.join(many, KEYS, "left_semi"), said))
    return out.select("paper_id", "id", F.concat_ws("-", "issue_class", F.col("k").cast("string")).alias("cluster"))


def tf_cosine(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """keys, cosine and shared of paired rows (same keys) with arrays `tokens`: term frequencies joined, all built in."""
    counts = [d.select(*keys, F.explode("tokens").alias("t")).groupBy(*keys, "t").agg(F.count("*").alias(n)) for d, n in ((left, "a"), (right, "b"))]
    both = counts[0].join(counts[1], [*keys, "t"], "full_outer").fillna(0, ["a", "b"])
    sums = both.groupBy(*keys).agg(
        F.sum(F.col("a") * F.col("b")).alias("dot"), F.sum(F.col("a") * F.col("a")).alias("aa"),
        F.sum(F.col("b") * F.col("b")).alias("bb"), F.count_if((F.col("a") > 0) & (F.col("b") > 0)).alias("shared"),
    )
    return sums.select(*keys, F.coalesce(F.try_divide("dot", F.sqrt("aa") * F.sqrt("bb")), F.lit(0.0)).alias("cosine"), "shared")
