"""Bounded queues with staleness control, as streams and as replays.

A queue holds at most ``capacity`` items of a key; when it is full the oldest goes. In a
stream that needs state: a list of at most capacity items for each key. Versions of
parameters, not event time, make items stale."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from brindle.sources.order import with_place

STATE = "items array<long>, produced long, dropped long"
REPORT = "key long, produced long, dropped long, size long, oldest long, newest long"


def queue_reports(stream: DataFrame, key: str, item: str, capacity: int) -> DataFrame:
    """After each micro-batch a report for each key that it touched. Items of a batch
    enter in order of ``item``."""

    def update(group: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        items, produced, dropped = state.get if state.exists else ([], 0, 0)
        fresh = sorted(int(x) for f in frames for x in f[item])
        items = [*items, *fresh]
        dropped += max(0, len(items) - capacity)
        items = items[-capacity:]
        state.update((items, produced + len(fresh), dropped))
        yield pd.DataFrame({"key": [group[0]], "produced": [produced + len(fresh)], "dropped": [dropped], "size": [len(items)], "oldest": [items[0]], "newest": [items[-1]]})

    return stream.groupBy(key).applyInPandasWithState(update, REPORT, STATE, "append", GroupStateTimeout.NoTimeout)


def replay_queue(operations: list[tuple[str, int | None]], capacity: int) -> tuple[list[int], list[int], list[int]]:
    """(got, dropped, left) of puts and gets in order, as the stream would have it."""
    items: list[int] = []
    got, dropped = [], []
    for what, x in operations:
        if what == "put":
            if len(items) == capacity:
                dropped.append(items.pop(0))
            items.append(x)
        elif items:
            got.append(items.pop(0))
    return got, dropped, items


def last_reports(reports: DataFrame) -> DataFrame:
    cols = [c for c in reports.columns if c not in ("key", "produced")]
    return reports.groupBy("key").agg(F.max("produced").alias("produced"), *[F.max_by(c, "produced").alias(c) for c in cols])


def most_required(required: int, staleness_threshold: float, sync_step: int) -> int:
    """Samples that may be produced for one version of the parameters."""
    return int(required * (staleness_threshold + 1) * sync_step)


def staleness(df: DataFrame, version: str, order: str, required: int, threshold: float, sync_step: int) -> DataFrame:
    """Adds produced (samples of the version so far) and paused (production should have
    stopped). Rows of all versions are numbered over range partitions, whatever the size
    of a version."""
    rows = with_place(df, [version], order, name="_place").withColumn("produced", (F.col("_place") + 1).cast("long")).drop("_place")
    return rows.withColumn("paused", F.col("produced") > most_required(required, threshold, sync_step))


def stale(version: Column, current: Column) -> Column:
    return current - version >= 1


def collect_batches(df: DataFrame, group: str, order: str, size: int) -> DataFrame:
    """Adds batch for full batches of ``size`` samples in order; what is over waits."""
    rows = with_place(df, [group], order, name="_place", size="_n")
    return rows.where(F.col("_place") < F.col("_n") - F.col("_n") % size).withColumn("batch", (F.col("_place") / size).cast("long")).drop("_place", "_n")


def replay_buffer(tags: DataFrame, key: list[str], step: str, status: str, order: str) -> DataFrame:
    """The last status of each key; rows of success of steps in which nothing runs."""
    last = tags.groupBy(step, *key).agg(F.max_by(status, order).alias(status))
    ready = last.groupBy(step).agg(F.max(F.when(F.col(status) == "running", 1).otherwise(0)).alias("_runs")).where("_runs = 0")
    return last.where(F.col(status) == "success").join(ready.select(step), step)


def adaptive_coefficient(steps: DataFrame, group: str, order: str, kl: str, start: float, target: float, horizon: int, n: str) -> DataFrame:
    """The coefficient after each step: times 1 + clip(kl/target - 1, +-0.2) n/horizon."""
    factor = 1 + F.least(F.greatest(F.col(kl) / target - 1, F.lit(-0.2)), F.lit(0.2)) * F.col(n) / horizon
    w = Window.partitionBy(group).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return steps.withColumn("coefficient", start * F.exp(F.sum(F.log(factor)).over(w)))
