"""Session settings for local runs; on a cluster the submitter's settings stay in force."""

import atexit
import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def local_session(app: str = "inkstone", cpus: int | None = None) -> SparkSession:
    """A local session: UTC, adaptive execution, as many shuffle partitions as cores."""
    cpus = cpus or int(os.environ.get("BENCH_CPUS", "8"))
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "6g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_folder(spark: SparkSession) -> str:
    """The folder that the session names in spark.checkpoint.dir, which all executors share. Where it names none, a temporary
    one serves in local mode; on a cluster, whose executors share no local disk, that is an error."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="inkstone-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """The rows dealt out by their keys for work that is dear for their bytes: a small file is one task, and adaptive execution
    joins small partitions to a few, but not those of a number that is given."""
    spark = df.sparkSession
    number = max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return df.repartition(number, *keys)


def once(df: DataFrame, **columns: Column) -> DataFrame:
    """df with these columns, each computed once a row: a generator parts them from what tests them, where the optimiser would
    copy their expressions into every test of a filter or a projection."""
    rest = [c for c in df.columns if c not in columns]
    return df.select(*(F.col(f"`{c}`") for c in rest), F.inline(F.array(F.struct(*(v.alias(k) for k, v in columns.items())))))


def small_batches(spark: SparkSession, rows: int = 500) -> None:
    """Bounds the rows of an Arrow batch, unless a smaller bound is set, so that many whole texts and their matches don't fill a
    worker. The setting stays in the session: plans that are run after the call that made them need it too."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= rows:
        spark.conf.set(name, str(rows))


def cut(df: DataFrame) -> DataFrame:
    """The rows written as a table in the shared folder and read again, so that a loop's plan doesn't grow and each step is
    computed once."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/inkstone-{uuid.uuid4().hex}"
    df.write.parquet(path)
    atexit.register(_remove, spark, path)
    out = spark.read.schema(df.schema).parquet(path)
    out.cut_path = path
    return out


def release(df: DataFrame) -> None:
    """Removes a table that cut() wrote and nothing reads any more; the others go when Python ends."""
    _remove(df.sparkSession, df.cut_path)


def _remove(spark: SparkSession, path: str) -> None:
    context = spark.sparkContext
    if context._jsc is not None:
        where = context._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(context._jsc.hadoopConfiguration()).delete(where, True)
