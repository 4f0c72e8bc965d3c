"""Near duplicates by SimHash: Golay-code fuzzy keys find fingerprints at a few differing bits, exact distances verify.

A 64-bit fingerprint is cut into segments. Two fingerprints at four or fewer differing bits agree wholly in all but four of
them, and of the two halves of the other bits one holds two errors at most. A 23-bit word of each half is decoded by the
perfect binary Golay code, as are the words that differ from it in one bit; that gives one or six codeword indices, and
words at two or fewer differing bits always share one. (agreeing segments, half, their bits, index) is a join key, so no
link is lost and every found pair is checked. Five segments do for some hundred million fingerprints; more, which make
longer keys, keep the rows of a key few beyond that, and give the same links.

near_duplicates() links fingerprints of word shingles. similar() takes fingerprints of a text's different words as a
proposal only: texts are near duplicates where their shingles' exact similarity says so.
"""

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache
from itertools import combinations, pairwise

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, runs, small_batches
from .components import connected_components

#: Generator polynomial of the binary Golay code [23, 12, 7]: x^11 + x^9 + x^7 + x^6 + x^5 + x + 1.
GOLAY = 0b101011100011
#: Bits that may differ.
ERRORS = 4
#: Rows of a key that the number of segments is chosen for, on average.
KEY_ROWS = 32
#: Rows of one key that a task compares at once; larger keys are compared in pairs of blocks.
BLOCK = 200_000
_SLICE = 1 << 16


def fingerprint(text: str | None, shingle: int = 4) -> int:
    """The SimHash of a text's word shingles as a signed 64-bit integer; zero for null and for texts without words."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        hashes = [xxhash.xxh64_intdigest(joined, 42)]
    else:
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(sizes + 1) - 1
        starts = (ends - sizes)[: len(words) - shingle + 1].tolist()
        digest = xxhash.xxh64_intdigest
        hashes = [digest(joined[a:b], 42) for a, b in zip(starts, ends[shingle - 1 :].tolist(), strict=True)]
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), _SLICE):
        part = np.array(hashes[i : i + _SLICE], "<u8")
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view("<i8")[0])


@cache
def _golay() -> tuple[np.ndarray, np.ndarray]:
    """Syndrome of each bit of a 23-bit word, and for each syndrome the only error of weight three or less."""
    column = []
    for bit in range(23):
        value = 1 << bit
        for high in range(22, 10, -1):
            if value >> high & 1:
                value ^= GOLAY << (high - 11)
        column.append(value)
    error = np.zeros(1 << 11, np.int64)
    for a in range(23):
        error[column[a]] = 1 << a
        for b in range(a):
            error[column[a] ^ column[b]] = 1 << a | 1 << b
            for c in range(b):
                error[column[a] ^ column[b] ^ column[c]] = 1 << a | 1 << b | 1 << c
    return np.array(column, np.int64), error


def golay_indices(words: np.ndarray) -> np.ndarray:
    """For each 23-bit word the codeword indices of itself and of its 23 neighbours: n x 24, equal ones repeated."""
    column, error = _golay()
    syndrome = np.zeros(len(words), np.int64)
    for bit in range(23):
        syndrome ^= np.where(words >> bit & 1, column[bit], 0)
    flips = np.r_[0, 1 << np.arange(23)]
    near = syndrome[:, None] ^ np.r_[0, column][None, :]
    return (words[:, None] ^ flips[None, :] ^ error[near]) >> 11


def segments_for(fingerprints: int) -> int:
    """The least number of segments, five at least, whose keys hold KEY_ROWS rows at most on average."""
    parts = ERRORS + 1
    while parts < 12 and fingerprints * 6 > KEY_ROWS << (64 * (parts - ERRORS) // parts + 12):
        parts += 1
    return parts


def fuzzy_keys(fingerprints: np.ndarray, parts: int = ERRORS + 1) -> tuple[np.ndarray, np.ndarray]:
    """(position of the fingerprint, key) pairs, each once."""
    bits = fingerprints.astype(np.int64).view(np.uint64)
    edges = [64 * k // parts for k in range(parts + 1)]
    cut = [(b - a, bits >> np.uint64(a) & np.uint64((1 << (b - a)) - 1)) for a, b in pairwise(edges)]

    def together(some: list[int]) -> tuple[int, np.ndarray]:
        width, out = 0, np.zeros(len(bits), np.uint64)
        for k in some:
            out |= cut[k][1] << np.uint64(width)
            width += cut[k][0]
        return width, out

    at, keys = [], []
    for n, agreeing in enumerate(combinations(range(parts), parts - ERRORS)):
        wide, exact = together(list(agreeing))
        left, rest = together([k for k in range(parts) if k not in agreeing])
        middle = (left + 1) // 2
        for half, (low, size) in enumerate(((0, middle), (middle, left - middle))):
            words = (rest >> np.uint64(low) & np.uint64((1 << min(size, 23)) - 1)).astype(np.int64)
            found = np.sort(golay_indices(words), axis=1)
            first = np.c_[np.ones(len(found), bool), found[:, 1:] != found[:, :-1]]
            row, _ = np.nonzero(first)
            at.append(row)
            keys.append((np.int64(2 * n + half) << (wide + 12)) | exact.astype(np.int64)[row] << 12 | found[first])
    return np.concatenate(at), np.concatenate(keys)


def forest(values: np.ndarray, errors: int = ERRORS) -> list[tuple[int, int]]:
    """Edges that join every two of the distinct values which links of `errors` or fewer bits connect; none is extra."""
    rest, edges = values.view(np.uint64), []
    while len(rest) > 1:
        todo, rest = [rest[0]], rest[1:]
        while todo and len(rest):
            one = todo.pop()
            near = np.bitwise_count(rest ^ one) <= errors
            if near.any():
                found = rest[near]
                edges += [(int(one.view(np.int64)), int(x)) for x in found.view(np.int64)]
                todo += list(found)
                rest = rest[~near]
    return edges


def _links(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Edges (a, b) within each key; the rows of a key over BLOCK pass through, as (key, fp), with part set."""
    out: list[tuple] = []
    for key, rows, split in _key_runs(batches):
        if split:
            yield pd.DataFrame({"a": key, "b": rows, "part": True})
        elif len(rows) == 2:
            out.append((int(rows[0]), int(rows[1])))
        else:
            out += forest(rows)
        if len(out) > 50_000:
            yield pd.DataFrame(out, columns=["a", "b"]).assign(part=False)
            out = []
    yield pd.DataFrame(out, columns=["a", "b"], dtype="int64").assign(part=False)


def _key_runs(batches: Iterator[pd.DataFrame]):
    """Runs of two or more rows of a key; pairs that aren't near are left out by whole arrays."""
    held: np.ndarray | None = None
    split = False
    for batch in _arrays(batches):
        held = batch if held is None else np.concatenate([held, batch], axis=1)
        last = held[0, -1]
        n = int(np.searchsorted(held[0], last))
        if n:
            yield from _pieces(held[:, :n], split)
            held, split = held[:, n:], False
        while held.shape[1] > BLOCK:
            yield last, held[1, :BLOCK], True
            held, split = held[:, BLOCK:], True
    if held is not None:
        yield from _pieces(held, split)


def _arrays(batches: Iterator[pd.DataFrame]) -> Iterator[np.ndarray]:
    for batch in batches:
        if len(batch):
            yield np.stack([batch["key"].to_numpy(np.int64), batch["fp"].to_numpy(np.int64)])


def _pieces(held: np.ndarray, split: bool):
    keys, values = held
    edges = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1], True])
    starts, sizes = edges[:-1], np.diff(edges)
    twos = starts[(sizes == 2) & ~(split & (starts == 0))]
    near = np.bitwise_count(values[twos].view(np.uint64) ^ values[twos + 1].view(np.uint64)) <= ERRORS
    for i in twos[near].tolist():
        yield keys[i], values[i : i + 2], False
    for i, n in zip(starts.tolist(), sizes.tolist(), strict=True):
        if split and i == 0 or n > BLOCK:
            yield keys[i], values[i : i + n], True
        elif n > 2:
            yield keys[i], values[i : i + n], False


def _block_links(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for _, rows, _ in runs(batches, "cell", 1 << 62):
        yield pd.DataFrame(forest(np.unique(rows["fp"].to_numpy(np.int64))), columns=["a", "b"], dtype="int64")


def fingerprint_links(distinct: DataFrame, scratch: Scratch, parts: int | None = None) -> DataFrame:
    """Edges (a, b) whose components are those of all pairs of the distinct fingerprints fp at ERRORS or fewer bits."""
    parts = parts or segments_for(distinct.count())

    def key_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for i in range(0, len(batch), 20_000):
                values = batch["fp"].to_numpy()[i : i + 20_000]
                at, keys = fuzzy_keys(values, parts)
                yield pd.DataFrame({"key": keys, "fp": values[at]})

    keys = distinct.mapInPandas(key_rows, "key long, fp long").repartition("key").sortWithinPartitions("key")
    found = scratch.write(keys.mapInPandas(_links, "a long, b long, part boolean"))
    parts = found.where("part").select(F.col("a").alias("key"), F.col("b").alias("fp"))
    blocks = parts.groupBy("key").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("n"))
    one = parts.join(blocks, "key").withColumn("i", F.pmod(F.xxhash64("fp"), "n").cast("int"))
    grid = one.select(
        F.explode(F.expr("transform(sequence(0, n - 1), j -> struct(key, least(i, j) AS i, greatest(i, j) AS j))")).alias("at"),
        "fp",
    ).select(F.xxhash64("at.key", "at.i", "at.j").alias("cell"), "fp")
    crossed = grid.repartition("cell").sortWithinPartitions("cell").mapInPandas(_block_links, "a long, b long")
    return found.where("not part").select("a", "b").union(crossed).distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4) -> DataFrame:
    """(doc_id, fingerprint, component_id), a row for each row of docs.

    component_id is the smallest id among the rows whose fingerprints links connect. Null texts count as empty; an
    empty table gives no rows; repeated rows are in one component; a null id gets its component's smallest id.
    Rows with one fingerprint are reduced to it before any comparison, however many they are.
    """
    spark = docs.sparkSession
    small_batches(spark)
    scratch = Scratch(spark)

    @F.pandas_udf("long")
    def simhash(texts: pd.Series) -> pd.Series:
        return pd.Series([fingerprint(x, shingle) for x in texts], dtype="int64")

    marked = scratch.write(docs.select(F.col(id_col).alias("doc_id"), simhash(F.col(text_col)).alias("fp")))
    distinct = scratch.write(marked.groupBy("fp").agg(F.min("doc_id").alias("least")))
    parts = connected_components(fingerprint_links(distinct.select("fp"), scratch), scratch)
    in_part = distinct.join(parts.withColumnRenamed("node", "fp"), "fp", "left").withColumn(
        "component", F.coalesce("component", "fp")
    )
    lowest = in_part.groupBy("component").agg(F.min("least").alias("component_id"))
    ids = scratch.write(in_part.select("fp", "component").join(lowest, "component").select("fp", "component_id"))
    return marked.join(ids, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


@dataclass(frozen=True)
class Rule:
    """Texts are near duplicates if the sets of their word shingles have this similarity (Jaccard) or more. `prints`
    fingerprints of their different words, under as many hashes, propose the pairs that are compared."""

    shingle: int = 5
    similarity: float = 0.8
    prints: int = 3
    #: Texts and characters of a component that one task compares; larger ones go in blocks of so many texts.
    texts: int = 1000
    characters: int = 8_000_000


_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def word_prints(words: list[bytes], prints: int) -> list[int]:
    """SimHashes of the different words, each under another hash, as signed 64-bit integers."""
    raw = np.array([xxhash.xxh64_intdigest(w, 42) for w in set(words)], "<u8")
    out = []
    for k in range(prints):
        h = raw + np.uint64(k * 0x9E3779B97F4A7C15 % (1 << 64))
        if k:
            h = (h ^ (h >> np.uint64(30))) * _MIX[0]
            h = (h ^ (h >> np.uint64(27))) * _MIX[1]
            h ^= h >> np.uint64(31)
        ones = np.zeros(64, np.int64)
        for i in range(0, len(h), _SLICE):
            part = h[i : i + _SLICE].view(np.uint8).reshape(-1, 8)
            ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        out.append(int(np.packbits(ones * 2 > len(h), bitorder="little").view("<i8")[0]))
    return out


def shingle_set(text: str | None, size: int) -> np.ndarray:
    """Sorted hashes of a text's different shingles of so many words; of all words together if they are fewer."""
    words = words_of(text)
    if not words:
        return np.zeros(0, np.uint64)
    grams = (b" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1)))
    return np.unique(np.fromiter(map(xxhash.xxh64_intdigest, grams), np.uint64))


def jaccard(a: np.ndarray, b: np.ndarray, least: float) -> float:
    """Similarity of two sorted sets, 1 of empty ones; 0 where their sizes alone keep it below `least`."""
    small, large = sorted((len(a), len(b)))
    if not large:
        return 1.0
    if small < least * large:
        return 0.0
    shared = len(np.intersect1d(a, b, assume_unique=True))
    return shared / (small + large - shared)


def leaders(sets: list[np.ndarray], least: float, before: list[np.ndarray] = ()) -> tuple[np.ndarray, list[int]]:
    """For each set, in order, the place of the first leader that it is similar to, and the leaders' places: those that are
    similar to no earlier one. Leaders of `before` come first, at the places -1, -2, and so on."""
    to, own = np.zeros(len(sets), np.int64), []
    for i, x in enumerate(sets):
        near = next((-1 - k for k, y in enumerate(before) if jaccard(x, y, least) >= least), None)
        if near is None:
            near = next((k for k in own if jaccard(x, sets[k], least) >= least), i)
        to[i] = near
        if near == i:
            own.append(i)
    return to, own


def similar(docs: DataFrame, key: str, text_col: str = "text", rule: Rule = Rule()) -> DataFrame:  # noqa: B008
    """(key, leader), a row for each row of docs: the key of the row that stands for it, its own where it stands itself.

    Keys are of an ordered type and not null. Texts of the same words are copies; the one of the smallest key stands for
    them. Texts whose word fingerprints are within ERRORS bits, or are so by way of others, are taken in the order of their
    keys: each stands for itself unless it is similar to an earlier one that stands, whose key it gets, the first of
    several. So whatever goes is similar to what stays, and no two proposed ones that stay are similar. Null texts count
    as empty, and texts without words are copies; repeated rows get a row each; an empty table gives no rows. Copies are
    reduced before anything is compared, and a component of any size is compared in tasks of bounded size.
    """
    spark = docs.sparkSession
    small_batches(spark)
    scratch = Scratch(spark)
    number = rule.prints

    @F.pandas_udf("same binary, prints array<long>")
    def mark(texts: pd.Series) -> pd.DataFrame:
        rows = [(xxhash.xxh3_128_digest(b" ".join(w)), word_prints(w, number)) for w in map(words_of, texts)]
        return pd.DataFrame(rows, columns=["same", "prints"])

    rows = docs.select(F.col(key).alias("key"), F.col(text_col).alias("text"))
    marked = scratch.write(rows.select("key", mark("text").alias("m")).select("key", "m.same", "m.prints"))
    reps = scratch.write(marked.groupBy("same").agg(F.min("key").alias("key"), F.first("prints").alias("prints")).withColumn("node", F.xxhash64("same")))
    edges = None
    for k in range(number):
        own = reps.select("node", F.get("prints", F.lit(k)).alias("fp"))
        least = scratch.write(own.groupBy("fp").agg(F.min("node").alias("least")))
        links = fingerprint_links(least.select("fp"), scratch)
        ends = links.join(least.select(F.col("fp").alias("a"), F.col("least").alias("x")), "a").join(least.select(F.col("fp").alias("b"), F.col("least").alias("y")), "b")
        some = own.join(least, "fp").where("node <> least").select(F.col("node").alias("a"), F.col("least").alias("b")).union(ends.select("x", "y"))
        edges = some if edges is None else edges.union(some)
    parts = connected_components(edges, scratch).select(F.col("node"), "component")
    members = scratch.write(reps.join(parts, "node").select("same", "key", "component"))
    texts = members.join(rows, "key").dropDuplicates(["same"])
    led = _led(scratch.write(texts), rule, scratch)
    stands = reps.select("same", F.col("key").alias("own")).join(led, "same", "left").select("same", F.coalesce("leader", "own").alias("leader"))
    return marked.select("key", "same").join(stands, "same").select("key", "leader")


def _led(texts: DataFrame, rule: Rule, scratch: Scratch) -> DataFrame:
    """(same, leader) of the texts (same, key, component, text) that an earlier one of their component stands for."""
    kind = texts.schema["key"].dataType.simpleString()
    schema = f"same binary, leader {kind}"

    def together(group: pd.DataFrame) -> pd.DataFrame:
        rows = _in_order(group)
        to, _ = leaders([shingle_set(x, rule.shingle) for x in rows["text"]], rule.similarity)
        gone = np.flatnonzero(to != np.arange(len(to)))
        return pd.DataFrame({"same": rows["same"].iloc[gone].to_numpy(), "leader": rows["key"].iloc[to[gone]].to_numpy()})

    out, rest = None, texts
    while True:
        sizes = scratch.write(rest.groupBy("component").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars")))
        fits = (F.col("n") <= rule.texts) & (F.coalesce("chars", F.lit(0)) <= rule.characters)
        small = rest.join(sizes.where(fits).select("component"), "component", "left_semi")
        found = small.groupBy("component").applyInPandas(together, schema)
        out = found if out is None else out.union(found)
        large = sizes.where(~fits)
        if large.isEmpty():
            return out
        linked, rest = _block(rest, large, rule, scratch, schema)
        out = out.union(linked)


def _block(rest: DataFrame, large: DataFrame, rule: Rule, scratch: Scratch, schema: str) -> tuple[DataFrame, DataFrame]:
    """Takes the first texts of each large component by key, finds those among them that stand, and compares all others of
    the component with these, dealt to tasks: (links found, texts left for the next round)."""
    order = Window.partitionBy("component").orderBy("key")
    own = rest.join(large, "component")
    width = F.greatest(F.lit(1), F.least(F.lit(rule.texts), F.floor(F.lit(float(rule.texts * rule.characters)) / F.greatest("chars", F.lit(1)))))
    first = own.withColumn("k", F.row_number().over(order)).where((F.col("k") <= rule.texts) & (F.col("k") <= width))
    first = scratch.write(first.select("same", "key", "component", "text"))

    def lead(group: pd.DataFrame) -> pd.DataFrame:
        rows = _in_order(group)
        to, _ = leaders([shingle_set(x, rule.shingle) for x in rows["text"]], rule.similarity)
        return rows.assign(leader=rows["key"].iloc[to].to_numpy(), leads=to == np.arange(len(to)))

    kind = rest.schema["key"].dataType.simpleString()
    led = scratch.write(first.groupBy("component").applyInPandas(lead, f"same binary, key {kind}, component long, text string, leader {kind}, leads boolean"))
    salts = F.greatest(F.ceil(F.col("n") / rule.texts), F.ceil(F.col("chars") / rule.characters)).cast("int")
    salted = large.select("component", F.greatest(salts, F.lit(1)).alias("salts"))
    others = rest.join(first.select("same"), "same", "left_anti").join(salted, "component")
    others = others.withColumn("salt", F.pmod(F.xxhash64("same"), F.col("salts").cast("bigint")).cast("int"))
    heads = led.where("leads").join(salted, "component").withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))

    def compare(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        heads = _in_order(right)
        before = [shingle_set(x, rule.shingle) for x in heads["text"]]
        to = [leaders([shingle_set(x, rule.shingle)], rule.similarity, before)[0][0] for x in left["text"]]
        keys = [heads["key"].iat[-1 - t] if t < 0 else None for t in to]
        return pd.DataFrame({"same": left["same"].to_numpy(), "leader": pd.Series(keys, dtype=object)})

    some = ["same", "key", "component", "text", "salt"]
    met = others.select(*some).groupBy("component", "salt").cogroup(heads.select(*some).groupBy("component", "salt")).applyInPandas(compare, schema)
    met = scratch.write(met)
    linked = led.where("not leads").select("same", "leader").union(met.where("leader is not null"))
    left = rest.join(met.where("leader is null").select("same"), "same", "left_semi")
    return linked, scratch.write(left)


def _in_order(group: pd.DataFrame) -> pd.DataFrame:
    """Rows by key; a key that is a struct comes as a dictionary or a row."""
    keys = [tuple(k.values()) if isinstance(k, dict) else tuple(k) if isinstance(k, tuple) else (k,) for k in group["key"]]
    return group.iloc[sorted(range(len(keys)), key=keys.__getitem__)].reset_index(drop=True)
