"""Near duplicates of embeddings: robust-pruned graphs of overlapping cluster shards, their adjacency lists united, and a
greedy search from medoids that spreads through all vectors in range; recall is audited against all vectors, links verified.

Equal vectors are reduced to one before anything is compared. A vector belongs to the shards of its `overlap` nearest
centres, or of more: sampled queries are compared with all vectors, which tells how many centres a vector needs for their
links to share a shard, and the number is raised again until what was found of those links is enough. A shard over `most` rows is dealt to blocks, and every two of its blocks make a cell, so a task holds 2 x most
rows at most and no pair of a shard is left out. A pair belongs to the first shard that both its vectors belong to, and to
its one cell; what the search finds there, and nothing else, is counted and joined. A task sends on a count and a tree
edge for a row, never its pairs. A cell is small, so its lists are pruned from its whole similarity matrix.
"""

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, small_batches
from .components import connected_components
from .vectors import distinct, fit_centres, lengths, matrix, usable


@dataclass(frozen=True)
class Settings:
    threshold: float = 0.9
    #: Vectors that the centres are fitted on (the smallest hashes of ids); rows of a shard; centres fitted in one level,
    #: and in two; rows of a cell's half.
    sample: int = 16_384
    shard: int = 1500
    flat: int = 4096
    centres: int = 65_536
    most: int = 3000
    overlap: int = 3
    #: Of the graph: edges of a row, candidates for them, how much closer a neighbour must be to hide another.
    degree: int = 24
    candidates: int = 48
    alpha: float = 1.2
    #: Of the search: rows in the beam, rows expanded at once, medoids it starts from, queries at a time.
    beam: int = 32
    wide: int = 4
    medoids: int = 8
    queries: int = 256
    #: Rows of a cell whose links are counted by brute force; a cell below this share of them is compared wholly.
    audited: int = 16
    recall: float = 0.98
    #: Queries compared with all vectors; the share of their links that must have a shard in common, as of `recall` that
    #: found must be, over all links and in the mean of queries; links of a batch whose shards are looked at.
    asked: int = 2048
    shared: float = 0.995
    looked: int = 4000


def build(x: np.ndarray, s: Settings) -> list[np.ndarray]:
    """Adjacency of unit rows: nearest and a few random candidates, robustly pruned, and edges back."""
    n = len(x)
    if n < 2:
        return [np.zeros(0, np.int64)] * n
    rng = np.random.default_rng(n)
    near = x @ x.T
    np.fill_diagonal(near, -np.inf)
    most = min(s.candidates, n - 1)
    pool = np.argpartition(-near, most - 1, axis=1)[:, :most]
    pool = np.c_[pool, rng.integers(0, n, (n, 8))]
    rows = np.arange(n)[:, None]
    gap = np.where(pool == rows, np.inf, 2 - 2 * near[rows, pool])
    order = np.argsort(gap, axis=1, kind="stable")
    pool, gap = np.take_along_axis(pool, order, 1), np.take_along_axis(gap, order, 1)
    np.fill_diagonal(near, 1.0)
    alive, chosen, kept = np.isfinite(gap), [], []
    line = np.arange(n)
    for _ in range(s.degree):
        first = alive.argmax(axis=1)
        there = alive[line, first]
        if not there.any():
            break
        best = pool[line, first]
        chosen.append(best)
        kept.append(there)
        hidden = s.alpha * (2 - 2 * near[best[:, None], pool]) <= gap
        alive &= ~(hidden & there[:, None])
        alive[line, first] = False
    chosen, kept = np.stack(chosen, 1), np.stack(kept, 1)
    edges: list[list[int]] = [c[k].tolist() for c, k in zip(chosen, kept, strict=True)]
    back: list[list[int]] = [[] for _ in range(n)]
    for i, own in enumerate(edges):
        for j in own:
            if len(back[j]) < s.degree:
                back[j].append(i)
    return [np.unique(np.array(a + b, np.int64)) for a, b in zip(edges, back, strict=True)]


def medoids(x: np.ndarray, number: int) -> np.ndarray:
    """The row nearest to the mean, then each time the row farthest from those."""
    out = [int((x @ x.mean(axis=0)).argmax())]
    nearest = x @ x[out[0]]
    while len(out) < min(number, len(x)):
        out.append(int(nearest.argmin()))
        nearest = np.maximum(nearest, x @ x[out[-1]])
    return np.unique(out)


def in_range(x: np.ndarray, adjacency: np.ndarray, asked: np.ndarray, s: Settings) -> tuple[np.ndarray, np.ndarray]:
    """(place in asked, row) pairs at the threshold or over: greedy from the medoids, then on through all in range.

    adjacency: n x r rows, -1 where there is none.
    """
    n, limit = len(x), s.threshold - 1e-6
    q = x[asked]
    seen, spread = np.zeros((len(asked), n), bool), np.zeros((len(asked), n), bool)
    found: list[tuple[np.ndarray, np.ndarray]] = []
    start = medoids(x, s.medoids)
    ids = np.tile(start, (len(asked), 1))
    sims = q @ x[start].T
    line = np.arange(len(asked))[:, None]
    seen[line, ids] = True
    hit = sims >= limit
    found.append((np.nonzero(hit)[0], ids[hit]))
    done = np.zeros(ids.shape, bool)
    while True:
        order = np.argsort(np.where(done, np.inf, -sims), axis=1, kind="stable")[:, : s.wide]
        go = ~np.take_along_axis(done, order, 1) & np.isfinite(np.take_along_axis(sims, order, 1))
        if not go.any():
            break
        np.put_along_axis(done, order, True, 1)
        at = np.take_along_axis(ids, order, 1)
        spread[np.nonzero(go)[0], at[go]] = True
        new = np.where(go[:, :, None], adjacency[at], -1).reshape(len(asked), -1)
        fresh = (new >= 0) & ~seen[line, new]
        who, where = np.nonzero(fresh)
        code = np.unique(who * n + new[who, where])
        who, new = code // n, code % n
        if not len(who):
            continue
        seen[who, new] = True
        sim = np.einsum("pd,pd->p", q[who], x[new])
        hit = sim >= limit
        found.append((who[hit], new[hit]))
        width = np.bincount(who, minlength=len(asked))
        place = np.arange(len(who)) - np.repeat(np.cumsum(width) - width, width)
        more_ids = np.zeros((len(asked), int(width.max())), ids.dtype)
        more = np.full(more_ids.shape, -np.inf)
        more_ids[who, place], more[who, place] = new, sim
        ids, sims = np.c_[ids, more_ids], np.c_[sims, more]
        done = np.c_[done, ~np.isfinite(more)]
        if ids.shape[1] > s.beam:
            top = np.argpartition(-sims, s.beam - 1, axis=1)[:, : s.beam]
            ids, sims, done = (np.take_along_axis(v, top, 1) for v in (ids, sims, done))
    who, at = (np.concatenate(v) for v in zip(*found, strict=True))
    all_who, all_at = [who], [at]
    while len(who):
        todo = ~spread[who, at]
        who, at = who[todo], at[todo]
        spread[who, at] = True
        next_who, next_at = [], []
        for i in range(0, len(who), 20_000):
            w, new = np.repeat(who[i : i + 20_000], adjacency.shape[1]), adjacency[at[i : i + 20_000]].ravel()
            fresh = (new >= 0) & ~seen[w, new]
            code = np.unique(w[fresh] * n + new[fresh])
            w, new = code // n, code % n
            seen[w, new] = True
            hit = np.einsum("pd,pd->p", q[w], x[new]) >= limit
            next_who.append(w[hit])
            next_at.append(new[hit])
        who = np.concatenate(next_who) if next_who else np.zeros(0, int)
        at = np.concatenate(next_at) if next_at else np.zeros(0, int)
        all_who.append(who)
        all_at.append(at)
    return np.concatenate(all_who), np.concatenate(all_at)


def links(raw: np.ndarray, adjacency: np.ndarray, s: Settings) -> np.ndarray:
    """Boolean matrix of the pairs of rows at the threshold or over that the search finds from either side.

    If the search misses links of the audited rows, beyond what `recall` allows, all pairs are compared.
    """
    size = np.linalg.norm(raw, axis=1)
    x = raw / size[:, None]
    n = len(raw)
    out = np.zeros((n, n), bool)
    for i in range(0, n, s.queries):
        asked = np.arange(i, min(i + s.queries, n))
        who, at = in_range(x, adjacency, asked, s)
        for a in range(0, len(who), 100_000):
            w, v = asked[who[a : a + 100_000]], at[a : a + 100_000]
            out[w, v] = np.einsum("pd,pd->p", raw[w], raw[v]) / (size[w] * size[v]) >= s.threshold
    out |= out.T
    some = np.random.default_rng(n).choice(n, min(s.audited, n), replace=False)
    true = (raw[some] @ raw.T) / (size[some][:, None] * size) >= s.threshold
    if (out[some] & true).sum() < s.recall * true.sum():
        for i in range(0, n, 512):
            out[i : i + 512] = (raw[i : i + 512] @ raw.T) / (size[i : i + 512, None] * size) >= s.threshold
        out |= out.T
    np.fill_diagonal(out, False)
    return out


def tree(linked: np.ndarray) -> np.ndarray:
    """For each row the row that a walk over the links came from; -1 where a walk begins."""
    n = len(linked)
    parent, left = np.full(n, -1), np.ones(n, bool)
    for i in range(n):
        if not left[i]:
            continue
        left[i] = False
        todo = [i]
        while todo:
            k = todo.pop()
            new = np.flatnonzero(linked[k] & left)
            left[new] = False
            parent[new] = k
            todo += new.tolist()
    return parent


def cell_links(rows: pd.DataFrame, s: Settings) -> pd.DataFrame:
    """(vec_id, n, parent) of a cell's rows: a pair counts in the first shard that both belong to, in its one cell."""
    ids = rows["vec_id"].to_numpy()
    order = np.argsort(ids, kind="stable")
    rows, ids = rows.iloc[order], ids[order]
    lists = []
    for own in rows["near"]:
        own = np.asarray(own, np.int64)
        at = np.minimum(np.searchsorted(ids, own), len(ids) - 1)
        lists.append(at[ids[at] == own])
    adjacency = np.full((len(ids), max(1, *map(len, lists))), -1)
    for i, own in enumerate(lists):
        adjacency[i, : len(own)] = own
    linked = links(matrix(rows["embedding"]), adjacency, s)
    here = int(rows["shard"].iloc[0])
    member: dict[int, list[int]] = {}
    for i, shards in enumerate(rows["shards"]):
        for k in shards:
            if k < here:
                member.setdefault(int(k), []).append(i)
    for both in member.values():
        linked[np.ix_(both, both)] = False
    if rows["low"].iloc[0] != rows["high"].iloc[0]:
        block = rows["block"].to_numpy()
        linked &= block[:, None] != block[None]
    counts, parent = linked @ rows["copies"].to_numpy(np.int64), tree(linked)
    up = pd.array(np.where(parent >= 0, ids[parent], 0), dtype="Int64")
    up[parent < 0] = None
    return pd.DataFrame({"vec_id": ids, "n": counts, "parent": up})


def places(x: np.ndarray, centre: np.ndarray) -> np.ndarray:
    """For each row the place of every centre among the nearest, from 0."""
    near = np.argsort(-(x @ centre.T), axis=1, kind="stable")
    out = np.empty(near.shape, np.int32)
    np.put_along_axis(out, near, np.arange(len(centre), dtype=np.int32)[None], 1)
    return out


def audit(reps: DataFrame, queries: pd.DataFrame, centre: np.ndarray, s: Settings) -> pd.DataFrame:
    """(query, need, n, w) of the queries' links with all vectors of reps: n links by brute force whose two lists of nearest
    centres first meet at `need` centres, w of them by copies. need is -1 where a batch had more links than are looked at."""
    raw = matrix(queries["embedding"])
    ids = queries["vec_id"].to_numpy()
    size = np.linalg.norm(raw, axis=1)
    shipped = reps.sparkSession.sparkContext.broadcast((raw, size, ids, centre))
    step = max(1, 2_000_000 // len(centre))

    def compared(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        raw, size, ids, centre = shipped.value
        for batch in batches:
            x, own = matrix(batch["embedding"]), batch["vec_id"].to_numpy()
            q, v = np.nonzero((raw @ x.T) / (size[:, None] * np.linalg.norm(x, axis=1)) >= s.threshold)
            q, v = (a[ids[q] != own[v]] for a in (q, v))
            need = np.full(len(q), -1)
            some = np.sort(np.random.default_rng(len(q)).choice(len(q), min(s.looked, len(q)), replace=False))
            for i in range(0, len(some), step):
                at = some[i : i + step]
                need[at] = np.maximum(places(raw[q[at]], centre), places(x[v[at]], centre)).min(axis=1) + 1
            found = pd.DataFrame({"query": ids[q], "need": need, "n": 1, "w": batch["copies"].to_numpy(np.int64)[v]})
            yield found.groupby(["query", "need"], as_index=False).sum()

    rows = reps.select("vec_id", "embedding", "copies").mapInPandas(compared, "query long, need int, n long, w long")
    return rows.groupBy("query", "need").agg(F.sum("n").alias("n"), F.sum("w").alias("w")).toPandas()


def overlap_for(links: pd.DataFrame, centres: int, s: Settings) -> int:
    """Centres of a vector, `overlap` at least, at which enough of the audited links share a shard."""
    known = links[links["need"] > 0]
    if not len(known):
        return min(s.overlap, centres)
    met = np.zeros((known["query"].nunique(), centres + 1))
    np.add.at(met, (pd.factorize(known["query"])[0], known["need"].to_numpy()), known["n"].to_numpy())
    met = met.cumsum(axis=1)
    over_all, mean = met.sum(axis=0) / met[:, -1].sum(), (met / met[:, -1:]).mean(axis=0)
    return min(centres, max(s.overlap, int((np.minimum(over_all, mean) >= s.shared).argmax())))


def enough(links: pd.DataFrame, counts: DataFrame, s: Settings) -> bool:
    """Whether the found counts (vec_id, n) hold `recall` of the audited links, over all and in the mean of queries."""
    true = links.groupby("query")["w"].sum()
    if not len(true):
        return True
    asked = counts.sparkSession.createDataFrame([(int(i),) for i in true.index], "vec_id long")
    found = counts.join(F.broadcast(asked), "vec_id").toPandas().set_index("vec_id")["n"].reindex(true.index).fillna(0)
    return found.sum() >= s.recall * true.sum() and (found / true).mean() >= s.recall


def near_duplicates(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", settings: Settings = Settings()) -> DataFrame:  # noqa: B008
    """(vec_id, n_links, component_id, kept), a row for each row of the table.

    A vector that is null, zero, or holds null or non-finite components links with nothing: 0 links, a component of its
    own, kept. Vectors of different lengths do not link. A null id has 0 links and neither component nor verdict. Rows
    that repeat an id and a vector count as one vector; an id with several vectors gets a row for each, judged by it. An
    empty table gives no rows.
    """
    spark = rows.sparkSession
    small_batches(spark)
    scratch = Scratch(spark)
    some = scratch.write(usable(rows, id_col, vector_col))
    every = rows.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("embedding"))
    found = None
    for n in lengths(some):
        one = _linked(some.where(F.size("embedding") == n), settings, scratch)
        found = one if found is None else found.union(one)
    if found is not None:
        every = every.join(found, "embedding", "left")
    else:
        every = every.withColumns({c: F.lit(None).cast("long") for c in ("n_links", "component_id")})
    known = F.col("vec_id").isNotNull()
    out = every.select(
        "vec_id", F.when(known, F.coalesce("n_links", F.lit(0))).otherwise(0).cast("long").alias("n_links"),
        F.when(known, F.coalesce("component_id", "vec_id")).alias("component_id"),
    )
    return out.withColumn("kept", F.col("vec_id") == F.col("component_id"))


def _linked(some: DataFrame, s: Settings, scratch: Scratch) -> DataFrame:
    """(embedding, n_links, component_id) of the different vectors, all of one length."""
    # A vector has a number of its own here, as several may have one id.
    reps = distinct(some, 1).select(F.monotonically_increasing_id().alias("vec_id"), F.col("vec_id").alias("least"), "embedding", "copies")
    reps = scratch.write(reps)
    centre = fit_centres(reps, reps.count(), s.shard, s.sample, s.flat, s.centres)
    queries = reps.select("vec_id", "embedding").orderBy(F.xxhash64("vec_id", F.lit("audit")), "vec_id").limit(s.asked).toPandas()
    true = audit(reps, queries, centre, s)
    overlap = overlap_for(true, len(centre), s)
    while True:
        found = scratch.write(_found(reps, centre, overlap, s, scratch))
        counts = found.groupBy("vec_id").agg(F.sum("n").alias("n"))
        if overlap == len(centre) or enough(true, counts, s):
            break
        overlap = min(2 * overlap, len(centre))
        scratch.drop(found)
    parts = connected_components(found.where("parent is not null").select(F.col("vec_id").alias("a"), F.col("parent").alias("b")), scratch)
    joined = reps.join(counts, "vec_id").join(parts.withColumnRenamed("node", "vec_id"), "vec_id", "left")
    joined = scratch.write(joined.withColumn("component", F.coalesce("component", "vec_id")).drop("vec_id"))
    smallest = joined.groupBy("component").agg(F.min("least").alias("component_id"))
    return joined.join(smallest, "component").select("embedding", (F.col("n") + F.col("copies") - 1).alias("n_links"), "component_id")


def _found(reps: DataFrame, centre: np.ndarray, overlap: int, s: Settings, scratch: Scratch) -> DataFrame:
    """(vec_id, n, parent) of the cells of shards, a vector in those of its `overlap` nearest centres."""
    shipped = reps.sparkSession.sparkContext.broadcast(centre)

    @F.pandas_udf("array<int>")
    def nearest(vectors: pd.Series) -> pd.Series:
        near = -(matrix(vectors) @ shipped.value.T)
        near = np.argpartition(near, overlap - 1, axis=1)[:, :overlap] if overlap < near.shape[1] else np.argsort(near, axis=1)
        return pd.Series(list(np.sort(near, axis=1).astype(np.int32)))

    dealt = scratch.write(reps.withColumn("shards", nearest("embedding")))
    in_shard = dealt.withColumn("shard", F.explode("shards"))
    sizes = in_shard.groupBy("shard").agg(F.ceil(F.count("*") / s.most).cast("int").alias("blocks"))  # a row a centre

    def cells(frame: DataFrame) -> DataFrame:
        one = frame.withColumn("shard", F.explode("shards")).join(F.broadcast(sizes), "shard")
        one = one.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.col("blocks").cast("bigint")).cast("int"))
        pairs = "transform(sequence(0, blocks - 1), j -> struct(least(block, j) AS low, greatest(block, j) AS high))"
        return one.withColumn("cell", F.explode(F.expr(pairs))).select("*", "cell.low", "cell.high").drop("cell", "blocks")

    def graph(group: pd.DataFrame) -> pd.DataFrame:
        x = matrix(group["embedding"])
        ids = group["vec_id"].to_numpy()
        lists = build((x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32), s)
        return pd.DataFrame({"vec_id": ids, "near": [ids[a] for a in lists]})

    key = ["shard", "low", "high"]
    lists = cells(dealt).groupBy(*key).applyInPandas(graph, "vec_id long, near array<long>")
    united = lists.groupBy("vec_id").agg(F.array_distinct(F.flatten(F.collect_list("near"))).alias("near"))
    full = scratch.write(dealt.join(united, "vec_id"))
    return cells(full).groupBy(*key).applyInPandas(lambda g: cell_links(g, s), "vec_id long, n long, parent long")
