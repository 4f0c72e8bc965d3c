"""Runs of tasks as a fold over their events, in batch and as a stream with state and timers.

An event is (run, seq, ts, kind, task, value): `add` a task; `ask` for work in `value` places; `accept` or `fail` the running
attempt of a task, `value` says why it failed; `resume` a run, with a task to allow it one attempt more. A run gives out so
many attempts at a time, never one twice, and so many of a task. Want of allowance, an interruption and a task whose attempts
are used up pause it: nothing is given out, but what is running may still be accepted. An attempt that no event ends in time
is interrupted. What an event may not do is told as its error and changes nothing.
"""

from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import IntegerType, LongType, StringType, StructField, StructType

EVENT = "run string, seq long, ts timestamp, kind string, task string, value string"
RESULT = "run string, seq long, error string, paused string, jobs string, tasks string"
#: Failures that pause a run.
PAUSES = ("quota", "capability", "interrupted")


@dataclass(frozen=True)
class Profile:
    """Attempts that run at a time, attempts of a task, and milliseconds that one may take."""

    parallel: int = 3
    attempts: int = 3
    patience: int = 45 * 60_000


@dataclass
class Task:
    status: str
    attempts: int
    most: int
    started: int


@dataclass
class Run:
    """The state of a run; tasks are in the order in which they were added."""

    profile: Profile
    tasks: dict[str, Task] = field(default_factory=dict)
    paused: str | None = None

    def take(self, at: int, kind: str, name: str | None, value: str | None) -> tuple[str | None, list[str]]:
        """Applies an event at a time in milliseconds: its error, and the jobs that it gives out as task#attempt."""
        self.interrupt(at)
        task = self.tasks.get(name)
        if kind == "add":
            if task is None:
                self.tasks[name] = Task("pending", 0, self.profile.attempts, 0)
            return None, []
        if kind == "ask":
            return None, self._give(at, int(value or 1))
        if kind == "resume":
            return self._resume(name, task), []
        if task is None or task.status != "inflight":
            return "task_not_inflight", []
        if kind == "accept":
            task.status = "accepted"
        else:
            self._fail(task, value or "transient")
        return None, []

    def interrupt(self, at: int) -> None:
        """Fails running attempts whose time is over, the longest over first."""
        over = [t for t in self.tasks.values() if t.status == "inflight" and t.started + self.profile.patience <= at]
        for task in sorted(over, key=lambda t: t.started):
            self._fail(task, "interrupted")

    def _fail(self, task: Task, why: str) -> None:
        task.status = "exhausted" if task.attempts >= task.most else "retry"
        if task.status == "exhausted" or why in PAUSES:
            self.paused = "retries_exhausted" if task.status == "exhausted" else why

    def _give(self, at: int, places: int) -> list[str]:
        running = sum(t.status == "inflight" for t in self.tasks.values())
        free = 0 if self.paused else max(0, min(places, self.profile.parallel - running))
        jobs = []
        for name, task in self.tasks.items():
            if len(jobs) < free and task.status in ("pending", "retry"):
                task.status, task.attempts, task.started = "inflight", task.attempts + 1, at
                jobs.append(f"{name}#{task.attempts}")
        return jobs

    def _resume(self, name: str | None, task: Task | None) -> str | None:
        if name:
            if task is None or task.status != "exhausted":
                return "retry_not_exhausted"
            task.most, task.status = task.most + 1, "retry"
        if any(t.status == "exhausted" for t in self.tasks.values()):
            return "retries_exhausted"
        self.paused = None
        return None

    def row(self, key: str, seq: int, error: str | None, jobs: list[str]) -> tuple:
        told = ",".join(f"{n}={t.status}/{t.attempts}" for n, t in self.tasks.items())
        return key, seq, error, self.paused, ",".join(jobs), told


def _millis(ts: pd.Series) -> list[int]:
    return (ts.astype("datetime64[us]").astype("int64") // 1000).tolist()


def run_log(events: DataFrame, profile: Profile = Profile()) -> DataFrame:  # noqa: B008
    """What each event does, in the order of time and number: (run, seq, error, paused, jobs, tasks after it). A run is a
    fold, as each event depends on all before; runs are dealt over tasks."""

    def fold(group: pd.DataFrame) -> pd.DataFrame:
        rows, run = group.sort_values(["ts", "seq"], kind="stable"), Run(profile)
        names = [x if isinstance(x, str) else None for x in rows["task"]]
        values = [x if isinstance(x, str) else None for x in rows["value"]]
        out = []
        for seq, at, kind, name, value in zip(rows["seq"], _millis(rows["ts"]), rows["kind"], names, values, strict=True):
            error, jobs = run.take(at, kind, name, value)
            out.append(run.row(group["run"].iat[0], seq, error, jobs))
        return pd.DataFrame(out, columns=["run", "seq", "error", "paused", "jobs", "tasks"])

    return events.select("run", "seq", "ts", "kind", "task", "value").groupBy("run").applyInPandas(fold, RESULT)


class Runs(StatefulProcessor):
    """Holds a run's events until the watermark has passed them, so that events that come late, but not beyond the
    watermark, take their place; a timer stands at each event's time and at the end of each attempt's patience."""

    def __init__(self, profile: Profile):
        self.profile = profile

    def init(self, handle: StatefulProcessorHandle) -> None:
        text = lambda *names: [StructField(n, StringType(), True) for n in names]
        number = lambda *names: [StructField(n, LongType(), True) for n in names]
        self.handle = handle
        self.paused = handle.getValueState("paused", StructType(text("code")))
        self.tasks = handle.getMapState(
            "tasks", StructType(text("task")), StructType([*text("status"), StructField("place", IntegerType(), True), *number("attempts", "most", "started")])
        )
        self.waiting = handle.getMapState("waiting", StructType(number("at", "seq")), StructType(text("kind", "task", "value")))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        for batch in rows:
            for seq, at, kind, task, value in zip(batch["seq"], _millis(batch["ts"]), batch["kind"], batch["task"], batch["value"], strict=True):
                self.waiting.updateValue((at, int(seq)), (kind, *(x if isinstance(x, str) else None for x in (task, value))))
                self.handle.registerTimer(at)
        yield pd.DataFrame({c.split()[0]: pd.Series(dtype=object) for c in RESULT.split(", ")})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        until = expiredTimerInfo.getExpiryTimeInMs()
        due = sorted((at, seq, *event) for (at, seq), event in self.waiting.iterator() if at <= until)
        run, out = self._load(), []
        for at, seq, kind, task, value in due:
            error, jobs = run.take(at, kind, task, value)
            out.append(run.row(key[0], seq, error, jobs))
            if jobs:
                self.handle.registerTimer(at + self.profile.patience)
            self.waiting.removeKey((at, seq))
        run.interrupt(until)
        self._save(run)
        yield pd.DataFrame(out, columns=["run", "seq", "error", "paused", "jobs", "tasks"])

    def _load(self) -> Run:
        found = sorted(self.tasks.iterator(), key=lambda x: x[1][1])
        tasks = {name: Task(status, attempts, most, started) for (name,), (status, _, attempts, most, started) in found}
        return Run(self.profile, tasks, self.paused.get()[0] if self.paused.exists() else None)

    def _save(self, run: Run) -> None:
        for place, (name, t) in enumerate(run.tasks.items()):
            self.tasks.updateValue((name,), (t.status, place, t.attempts, t.most, t.started))
        self.paused.update((run.paused,))

    def close(self) -> None:
        pass


def run_stream(events: DataFrame, late: str = "1 hour", profile: Profile = Profile()) -> DataFrame:  # noqa: B008
    """run_log() of a stream of events, row by row as the watermark passes them; events later than the watermark are dropped.
    State needs the RocksDB provider of state stores."""
    marked = events.select("run", "seq", "ts", "kind", "task", "value").withWatermark("ts", late)
    return marked.groupBy("run").transformWithStateInPandas(Runs(profile), RESULT, "append", "EventTime")
