"""Vector operators against brute force, with copies, ties, and rows that take no part."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from inkstone.llm import ann, embedding_dedup
from inkstone.llm import vectors as vectors_module


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(700, 12))
    x[100:160] = x[100] + rng.normal(0, 0.02, (60, 12))
    x[200:240] = x[200]
    x[300] = -x[301]
    rows = [(i, [float(v) for v in r.astype(np.float32)], 7, "c") for i, r in enumerate(x)]
    odd = [None, [], [0.0] * 12, [1.0, None] + [0.0] * 10, [math.nan] * 12, [math.inf] + [0.0] * 11, [1.0, 2.0]]
    rows += [(1000 + i, v, 7, "c") for i, v in enumerate(odd)] + [rows[5]]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, n_links long, shard string")


def usable(frame):
    rows = {r["vec_id"]: r["embedding"] for r in frame.collect()}
    good = {i: v for i, v in rows.items() if i < 1000}
    return np.array(list(good)), np.array(list(good.values()), float)


def test_near_duplicates(spark, vectors):
    ids, x = usable(vectors)
    cos = (x @ x.T) / np.outer(np.linalg.norm(x, axis=1), np.linalg.norm(x, axis=1)) >= 0.9
    np.fill_diagonal(cos, False)
    component = np.arange(len(x))
    for _ in range(20):
        component = np.array([min(component[i], component[cos[i]].min(initial=len(x))) for i in range(len(x))])
    for settings in (embedding_dedup.Settings(), embedding_dedup.Settings(shard=150, most=60)):
        rows = embedding_dedup.near_duplicates(vectors, settings=settings).collect()
        assert len(rows) == vectors.count()
        got = {r["vec_id"]: r for r in rows}
        links = np.array([got[i]["n_links"] for i in ids])
        assert links.sum() >= 0.97 * cos.sum() and (links <= cos.sum(1)).all()
        if settings.most > 100:
            assert (links == cos.sum(1)).all() and [got[i]["component_id"] for i in ids] == ids[component].tolist()
        for i in range(1000, 1007):
            assert (got[i]["n_links"], got[i]["component_id"], got[i]["kept"]) == (0, i, True)
        assert all((r["n_links"] == 0) == (sum(o["component_id"] == r["component_id"] for o in rows) == 1 + (r["vec_id"] == 5)) for r in rows)
    assert embedding_dedup.near_duplicates(spark.createDataFrame([], vectors.schema)).count() == 0


def test_ids_with_several_vectors_and_lengths(spark):
    rows = [(1, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [0.99, 0.01]), (3, [0.0, 2.0]), (3, [0.0, 2.0]), (None, [1.0, 0.0]), (4, [1.0, 0.0, 0.0]), (5, [1.0, 0.01, 0.0]), (6, [1.0])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted((r["vec_id"] or 0, r["n_links"], r["component_id"], r["kept"]) for r in embedding_dedup.near_duplicates(frame).collect())
    assert got == [(0, 0, None, None), (1, 1, 1, True), (1, 1, 1, True), (2, 1, 1, False), (3, 1, 1, False), (3, 1, 1, False), (4, 1, 4, True), (5, 1, 4, False), (6, 0, 6, True)]
    found = [(r["query_id"], r["vec_id"], r["score"]) for r in ann.nearest(frame, F.col("vec_id").isin(2, 4, 6)).orderBy("query_id", "rank").collect()]
    assert found == [(2, 1, 0.99), (2, 3, 0.02), (2, 1, 0.01), (4, 5, 1.0)]


def test_centres_in_two_levels(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(3000, 16))
    frame = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "vec_id long, embedding array<double>")
    centre = vectors_module.fit_centres(frame, 3000, 20, 400, flat=10)
    assert 100 <= len(centre) <= 170 and np.allclose(np.linalg.norm(centre, axis=1), 1)
    one = vectors_module.fit_centres(frame, 3000, 20, 400)
    assert len(one) == 150
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    assert (unit @ centre.T).max(1).mean() > 0.9 * (unit @ one.T).max(1).mean()


def test_neighbours_over_many_blocks_and_cells(spark):
    """50,000 vectors of different norms in cells and blocks of some hundred: found again as brute force finds them."""
    rng = np.random.default_rng(9)
    x = (rng.normal(size=(60, 24))[rng.integers(0, 60, 50_000)] + rng.normal(0, 0.6, (50_000, 24))) * rng.uniform(0.5, 2, (50_000, 1))
    frame = spark.createDataFrame([(i, r) for i, r in enumerate(x.tolist())], "vec_id long, embedding array<double>")
    s = ann.Settings(cell=1000, block=700, asked=100, query_block=300)
    got = ann.nearest(frame, F.col("vec_id") % 100 == 0, settings=s).toPandas()
    hits = 0
    for q, own in got.groupby("query_id"):
        score = x @ x[q]
        score[q] = -np.inf
        edge = np.partition(score, -20)[-20]
        hits += int((own.score >= edge - 1e-9).sum())
        assert np.allclose(score[own.vec_id], own.score) and own["rank"].tolist() == list(range(1, 21))
    assert got.query_id.nunique() == 500 and hits >= 0.93 * 20 * 500


def test_search_finds_ranges():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(600, 8))
    x[50:250] = x[50] + rng.normal(0, 0.05, (200, 8))
    s = embedding_dedup.Settings(recall=0.0)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    lists = embedding_dedup.build(unit.astype(np.float32), s)
    adjacency = np.full((600, max(map(len, lists))), -1)
    for i, own in enumerate(lists):
        adjacency[i, : len(own)] = own
    found = embedding_dedup.links(x, adjacency, s)
    true = unit @ unit.T >= 0.9
    np.fill_diagonal(true, False)
    assert not (found & ~true).any() and found.sum() >= 0.9 * true.sum()


def test_nearest(spark, vectors):
    ids, x = usable(vectors)
    rows = ann.nearest(vectors, F.col("vec_id") % 20 == 0).collect()
    got = {}
    for r in sorted(rows, key=lambda r: (r["query_id"], r["rank"])):
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    asked = [i for i in ids if i % 20 == 0]
    assert sorted(got) == asked
    hits = 0
    for q in asked:
        score = x @ x[q]
        best = [i for i in np.lexsort((ids, -score)) if i != q][:20]
        hits += len(set(ids[best]) & {i for i, _ in got[q]})
        assert len(got[q]) == 20 and got[q] == sorted(got[q], key=lambda p: (-p[1], p[0]))
        assert all(s == pytest.approx(score[i], abs=1e-12) for i, s in got[q])
    assert hits >= 0.9 * 20 * len(asked)
    few = vectors.where("vec_id in (0, 20, 21)")
    assert ann.nearest(few, F.col("vec_id") % 20 == 0).count() == 4
    assert ann.nearest(spark.createDataFrame([], vectors.schema), F.lit(True)).count() == 0


def test_anisotropic_codes_prefer_small_parallel_error():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(3000, 16))
    plain, aware = ann.fit(x, 0.0), ann.fit(x, 0.5)

    def parallel(book):
        codes = ann.quantise(book, x)
        back = book.centres[np.arange(codes.shape[1]), codes].reshape(len(x), -1)
        return (((x - back) * x).sum(1) ** 2 / (x * x).sum(1)).mean()

    assert parallel(aware) < parallel(plain)
    codes = ann.quantise(aware, x[:50]).astype(np.uint8)
    approximate = ann.scan(aware, x[:5], codes[:, ::2] << 4 | codes[:, 1::2])
    back = aware.centres[np.arange(codes.shape[1]), codes].reshape(50, -1)
    assert np.allclose(approximate, x[:5] @ back.T, atol=1e-4)


def test_links_across_many_shards(spark):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(600, 48))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    side = rng.normal(size=x.shape)
    side -= (side * x).sum(1, keepdims=True) * x
    side /= np.linalg.norm(side, axis=1, keepdims=True)
    both = np.r_[x, 0.905 * x + math.sqrt(1 - 0.905**2) * side]
    both = both[rng.permutation(len(both))]
    frame = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(both)], "vec_id long, embedding array<double>")
    true = (both @ both.T >= 0.9).sum(1) - 1
    for settings in (embedding_dedup.Settings(shard=10, sample=150), embedding_dedup.Settings(shard=10, sample=150, flat=20)):
        rows = embedding_dedup.near_duplicates(frame, settings=settings).collect()
        links = np.array([r["n_links"] for r in sorted(rows, key=lambda r: r["vec_id"])])
        assert (links <= true).all() and links.sum() >= 0.98 * true.sum()


@pytest.mark.parametrize("scale", [1e-6, 1e25])
def test_neighbours_of_any_scale(spark, scale):
    """Three thousand vectors whose products lie under any fixed tolerance or beyond single precision."""
    x = np.random.default_rng(3).normal(size=(3000, 64)) * scale
    frame = spark.createDataFrame([(i, r) for i, r in enumerate(x.tolist())], "vec_id long, embedding array<double>")
    got = ann.nearest(frame, F.col("vec_id") % 50 == 0, settings=ann.Settings(rerank=24)).toPandas()
    hits = 0
    for q, own in got.groupby("query_id"):
        score = x @ x[q]
        score[q] = -np.inf
        hits += len(set(np.argsort(-score)[:20]) & set(own.vec_id))
    assert hits >= 0.93 * 20 * 60


def test_audit_counts_ties_by_the_smaller_id(spark):
    """Vectors of zeros and ones: the twentieth score is that of hundreds, of which the smallest ids are due."""
    x = (np.random.default_rng(6).random((4000, 16)) < 0.3).astype(float)
    x[:, 15] = 1
    rows = [(i, [*r, i * 1e-300]) for i, r in enumerate(x.tolist())]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = ann.nearest(frame, F.col("vec_id") % 50 == 0, settings=ann.Settings(rerank=24)).toPandas()
    hits = 0
    for q, own in got.groupby("query_id"):
        score = x @ x[q]
        score[q] = -np.inf
        hits += len(set(np.lexsort((np.arange(len(x)), -score))[:20]) & set(own.vec_id))
    assert hits >= 0.93 * 20 * 80
