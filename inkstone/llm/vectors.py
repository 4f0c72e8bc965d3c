"""Vectors that take part, each once: rows of arrays without null, infinite or only zero components."""

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

_GOOD = (
    "size(embedding) > 0 and forall(embedding, x -> x is not null and not isnan(x) and abs(x) < double('infinity'))"
    " and exists(embedding, x -> x <> 0)"
)


def usable(rows: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, embedding) of rows with an id and a proper vector, of any length."""
    some = rows.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("embedding"))
    return some.where("vec_id is not null and embedding is not null").where(_GOOD)


def lengths(some: DataFrame) -> list[int]:
    """Lengths of the vectors; a table has a few. Vectors of different lengths have no measure in common."""
    return sorted(r["n"] for r in some.select(F.size("embedding").alias("n")).distinct().collect())


def distinct(some: DataFrame, keep: int) -> DataFrame:
    """(vec_id, embedding, members, copies): a row for each vector, with its smallest id, its `keep` smallest ids and
    the number of its ids. Copies are cut down within salts first, so one vector may be that of most rows."""
    ids = some.distinct()
    salted = ids.withColumn("salt", F.pmod(F.xxhash64("vec_id"), F.lit(256)))
    own = Window.partitionBy("embedding", "salt").orderBy("vec_id")
    few = salted.withColumn("k", F.row_number().over(own)).where(F.col("k") <= keep)
    part = few.groupBy("embedding", "salt").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    sizes = ids.groupBy("embedding").agg(F.count("*").alias("copies"))
    together = part.groupBy("embedding").agg(F.flatten(F.collect_list("ids")).alias("ids"))  # 256 x keep at most
    return together.join(sizes, "embedding").select(
        F.array_min("ids").alias("vec_id"), "embedding", F.slice(F.sort_array("ids"), 1, keep).alias("members"), "copies"
    )


def matrix(column: pd.Series, kind: type = np.float64) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(kind) if len(column) else np.zeros((0, 0), kind)


def sample(reps: DataFrame, size: int) -> np.ndarray:
    """`size` vectors at most, those of the smallest hashes of ids, on the driver."""
    rows = reps.select("vec_id", "embedding").orderBy(F.xxhash64("vec_id"), "vec_id").limit(size).collect()
    return np.array([r["embedding"] for r in rows], np.float64)


def centroids(data: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Spherical k-means centres of unit rows; fewer than k if there are fewer rows. Deterministic."""
    k = min(k, len(data))
    centre = data[np.random.default_rng(5).choice(len(data), k, replace=False)]
    for _ in range(rounds):
        nearest = (data @ centre.T).argmax(axis=1)
        total = np.zeros_like(centre)
        np.add.at(total, nearest, data)
        size = np.linalg.norm(total, axis=1, keepdims=True)
        centre = np.where(size > 0, total / np.where(size > 0, size, 1), centre)
    return centre


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def fit_centres(reps: DataFrame, number: int, per: int, size: int, flat: int = 4096, most: int = 65_536) -> np.ndarray:
    """Unit centres, one for each `per` of the `number` vectors, `most` at most, on the driver.

    Up to `flat` centres are fitted there on a sample of `size` vectors. More are fitted in two levels: of the square root
    of their number on that sample, and, for each of these, on executors, on a sample of the vectors nearest to it.
    """
    want = max(1, min(round(number / per), most))
    data = unit(sample(reps, size))
    if want <= flat:
        return centroids(data, want)
    top = centroids(data, round(want**0.5))
    each = -(-want // len(top))
    shipped = reps.sparkSession.sparkContext.broadcast(top)

    @F.pandas_udf("int")
    def nearest(vectors: pd.Series) -> pd.Series:
        return pd.Series((unit(matrix(vectors)) @ shipped.value.T).argmax(axis=1).astype(np.int32))

    share = min(1.0, 64.0 * want / number)
    mark = F.pmod(F.xxhash64("vec_id", F.lit("centres")), F.lit(1 << 30))
    some = reps.where(mark < int(share * (1 << 30))).select("vec_id", "embedding").withColumn("cell", nearest("embedding"))
    order = Window.partitionBy("cell").orderBy(F.xxhash64("vec_id"), "vec_id")
    some = some.withColumn("k", F.row_number().over(order)).where(F.col("k") <= size)

    def local(group: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"centre": list(centroids(unit(matrix(group.sort_values("vec_id")["embedding"])), each))})

    found = some.groupBy("cell").applyInPandas(local, "centre array<double>").toPandas()
    return np.stack(sorted(found["centre"], key=tuple))
