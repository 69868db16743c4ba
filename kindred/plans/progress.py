"""Progress of a long run: tasks done of tasks known while it runs, and counts of the rows that went by, without
another pass over the data."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from typing import TypeVar

from pyspark import InheritableThread
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

R = TypeVar("R")


def watched(df: DataFrame, name: str, **metrics: Column) -> tuple[DataFrame, Observation]:
    """The table, and an observation that holds ``rows`` and the given aggregates once an action over it has ended. An
    action that reads only a part of the rows counts that part."""
    seen = Observation(name)
    return df.observe(seen, F.count(F.lit(1)).alias("rows"), *[c.alias(n) for n, c in metrics.items()]), seen


def with_progress(spark: SparkSession, action: Callable[[], R], told: Callable[[int, int], None], every: float = 0.5) -> R:
    """Run an action and tell (tasks done, tasks known) when they change. Stages become known as they begin, so the
    second number may grow; neither falls. An error of the action or of ``told`` is raised here, and the latter
    cancels the action's jobs."""
    context = spark.sparkContext
    tag, result, error = f"progress-{uuid.uuid4().hex}", [], []

    def run() -> None:
        context.addJobTag(tag)
        try:
            result.append(action())
        except BaseException as e:  # raised again below, in the caller's thread
            error.append(e)
        finally:
            context.removeJobTag(tag)

    tracker = context.statusTracker()
    stages: dict[int, tuple[int, int]] = {}
    last = (0, 0)

    def tell() -> None:
        nonlocal last
        for job in context._jsc.sc().statusTracker().getJobIdsForTag(tag):
            info = tracker.getJobInfo(job)
            for stage in info.stageIds if info else ():
                if s := tracker.getStageInfo(stage):
                    known = stages.get(stage, (0, 0))
                    stages[stage] = max(known[0], s.numCompletedTasks), max(known[1], s.numTasks)
        now = sum(d for d, _ in stages.values()), sum(n for _, n in stages.values())
        if now != last:
            last = now
            told(*now)

    worker = InheritableThread(target=run)
    worker.start()
    try:
        while worker.is_alive():
            worker.join(every)
            tell()
    except BaseException:
        context.cancelJobsWithTag(tag)
        worker.join()
        raise
    if error:
        raise error[0]
    return result[0]


class StreamProgress(StreamingQueryListener):
    """Tells (name of the query, batch, input rows, observed metrics) after each micro-batch; add it by
    ``spark.streams.addListener``."""

    def __init__(self, told: Callable[[str | None, int, int, dict[str, dict]], None]):
        self.told = told

    def onQueryStarted(self, event) -> None: ...

    def onQueryProgress(self, event) -> None:
        p = event.progress
        self.told(p.name, p.batchId, p.numInputRows, {n: r.asDict() for n, r in p.observedMetrics.items()})

    def onQueryIdle(self, event) -> None: ...

    def onQueryTerminated(self, event) -> None: ...
