"""Tasks' states from a stream of attempts: the batch rule, kept as running aggregates, and sessions with late data."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def task_counts(attempts: DataFrame) -> DataFrame:
    """Running (task, accepted, fails, last, attempts) of a stream of attempts (task, ts, attempt, kind)."""
    last = F.max(F.struct("ts", "attempt", "kind"))["kind"]
    return attempts.groupBy("task").agg(
        F.max((F.col("kind") == "accept").cast("int")).alias("accepted"),
        F.sum((F.col("kind") == "fail").cast("int")).alias("fails"),
        last.alias("last"),
        F.count("*").alias("attempts"),
    )


def statuses(counts: DataFrame, most: int = 3) -> DataFrame:
    status = F.when(F.col("accepted") == 1, "accepted").when(F.col("fails") >= most, "exhausted").when(F.col("last") == "fail", "retry")
    return counts.select("task", status.otherwise("inflight").alias("status"), "attempts")


def sessions(attempts: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """(task, start, end, attempts) of runs of attempts without a longer gap; later rows than the watermark are dropped."""
    marked = attempts.withWatermark("ts", late) if attempts.isStreaming else attempts
    spans = marked.groupBy(F.session_window("ts", gap).alias("w"), "task").agg(F.count("*").alias("attempts"))
    return spans.select("task", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "attempts")


def rates(attempts: DataFrame, size: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """(start, kind, attempts) by tumbling windows."""
    marked = attempts.withWatermark("ts", late) if attempts.isStreaming else attempts
    counts = marked.groupBy(F.window("ts", size).alias("w"), "kind").agg(F.count("*").alias("attempts"))
    return counts.select(F.col("w.start").alias("start"), "kind", "attempts")
