"""Reading tables, tables that cut lineage, and Arrow batches of bounded size."""

import atexit
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes of an Arrow batch that goes to Python; a batch holds one row at least, however long its text is.
BATCH_ROWS, BATCH_BYTES = 1000, 32 << 20


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """The named columns of a table; others, whatever their names, are not read."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*columns)


def small_batches(spark: SparkSession) -> None:
    """Bounds Arrow batches in rows and bytes, so that many long texts don't fill a worker. The setting stays in the session:
    plans that are run after the call that made them need it too."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def bucket_of(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; -1 where the id is null (never the tested remainder)."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % n, F.lit(-1)).cast("int")


def whole_sample(docs: DataFrame, groups: DataFrame, sizes: dict, group: str, texts: int, size: int) -> DataFrame:
    """(group, doc_id, text) of at most `texts` documents of each group, those of the smallest hashes of ids, and of `size`
    characters together: whole texts only, and one that no longer fits is passed over.

    docs are (doc_id, text) with ids and texts, groups (group, doc_id) what each id belongs to, and sizes tells how many ids
    a group has. Ids are picked before texts are met, and more of them in groups where too few have a text. Of an id's several texts
    the smallest holds. The driver gets ids and sizes of some thousand rows a group.
    """
    spark = docs.sparkSession
    mark, share = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)), dict.fromkeys(sizes, 2.0)
    while True:
        limits = [(g, int(min(1.0, share[g] * texts / max(n, 1)) * (1 << 30))) for g, n in sizes.items()]
        bound = spark.createDataFrame(limits, f"{group} {groups.schema[group].dataType.simpleString()}, below long")
        picked = groups.withColumn("mark", mark).join(F.broadcast(bound), group).where("mark < below").select(group, "doc_id", "mark").distinct()
        few = sum(min(n, 2 * share[g] * texts) for g, n in sizes.items()) <= 200_000
        some = docs.join(F.broadcast(picked) if few else picked, "doc_id").groupBy(group, "doc_id", "mark").agg(F.min("text").alias("text"))
        found = some.select(group, "mark", "doc_id", F.length("text").alias("n")).collect()
        count = dict.fromkeys(sizes, 0)
        for r in found:
            count[r[group]] += 1
        short = [g for g, below in limits if count[g] < texts and below < 1 << 30]
        if not short:
            break
        share |= {g: 4 * share[g] for g in short}
    kept, room, left = [], dict.fromkeys(sizes, size), dict.fromkeys(sizes, texts)
    for r in sorted(found, key=lambda r: (r["mark"], r["doc_id"])):
        if left[r[group]] and r["n"] <= room[r[group]]:
            left[r[group]] -= 1
            room[r[group]] -= r["n"]
            kept.append((r[group], r["doc_id"]))
    chosen = spark.createDataFrame(kept, some.select(group, "doc_id").schema)
    wanted = docs.join(F.broadcast(chosen), "doc_id")
    return wanted.groupBy(group, "doc_id").agg(F.min("text").alias("text"))


class Scratch:
    """Tables written under spark.checkpoint.dir, which all executors share.

    Writing a table cuts lineage: a lost executor costs a re-read, not a recomputation. Where the session names no folder a
    temporary one is set in local mode alone; on a cluster that is an error, as executors share no local disk. drop()
    removes a table that nothing reads any more, and the rest goes when Python ends.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
        if not base:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
            base = "file://" + tempfile.mkdtemp(prefix="inkstone-")
            spark.conf.set("spark.checkpoint.dir", base)
        self.root = f"{base.rstrip('/')}/inkstone-{uuid.uuid4().hex}"
        atexit.register(self._delete, self.root)

    def write(self, df: DataFrame) -> DataFrame:
        path = f"{self.root}/{uuid.uuid4().hex}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out.scratch_path = path
        return out

    def drop(self, df: DataFrame) -> None:
        self._delete(df.scratch_path)

    def _delete(self, path: str) -> None:
        jvm = self.spark.sparkContext._jvm
        if jvm is None or self.spark.sparkContext._jsc is None:
            return
        try:
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
        except Exception as error:  # at exit the JVM may be gone already
            print(f"scratch table not removed: {path}: {type(error).__name__}")


def runs(batches: Iterator, key: str, most: int):
    """Of batches sorted by key: (key, array of the rest's rows as a frame, whether it's part of a longer run).

    A run of equal keys is gathered over batch borders; one of more than `most` rows comes in parts, each marked.
    """
    import pandas as pd

    held, split = None, False
    for batch in batches:
        if not len(batch):
            continue
        held = batch if held is None else pd.concat([held, batch], ignore_index=True)
        last = held[key].iloc[-1]
        n = int((held[key].to_numpy() != last).sum())
        if n:
            yield from _whole(held.iloc[:n], key, most, split)
            held, split = held.iloc[n:], False
        while len(held) > most:
            yield last, held.iloc[:most], True
            held, split = held.iloc[most:], True
    if held is not None and len(held):
        yield from _whole(held, key, most, split)


def _whole(frame, key: str, most: int, split: bool):
    import numpy as np

    keys = frame[key].to_numpy()
    edges = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1], True])
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        for start in range(a, b, most):
            yield keys[a], frame.iloc[start : min(b, start + most)], (split and a == 0) or b - a > most


