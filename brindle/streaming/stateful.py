"""Queue, replay buffer and coefficient as streams with state; batches written once.

State lives in Spark's state store by key (``transformWithStateInPandas``), so a restart
from the checkpoint goes on where the last finished micro-batch ended. Rows of a key must
arrive in order of ``seq`` over micro-batches (as from an ordered log); inside a micro-batch
they are sorted. Then results don't depend on how the stream is cut. ``seq`` that a key has
passed already is a repeat and is ignored, so a source may deliver more than once.

The functions set the RocksDB state store for the session, which this kind of state needs.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

PROVIDER = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def _session(spark: SparkSession) -> None:
    if spark.conf.get(PROVIDER[0], None) != PROVIDER[1]:
        spark.conf.set(*PROVIDER)


def _ordered(frames: Iterator[pd.DataFrame], after: int | None) -> list[dict]:
    """The rows of a key in order of seq, without those at or before ``after``."""
    rows = [r for f in frames for r in f.to_dict("records")]
    rows.sort(key=lambda r: r["seq"])
    out, last = [], after
    for r in rows:
        if last is None or r["seq"] > last:
            out.append(r)
            last = r["seq"]
    return out


# The queue.

QUEUE_SCHEMA = "key {key}, seq long, event string, item long, size long, waiting long, produced long, consumed long, dropped long, paused boolean"


class _Queue(StatefulProcessor):
    """A queue of at most ``capacity`` items. put: to the first waiting get, else to the end;
    when full the oldest goes. get: the oldest, else it waits. clear: all go, uncounted.
    close: waiting gets end empty, and so do later ones that find nothing."""

    def __init__(self, capacity: int | None, most_produced: int | None):
        self.capacity, self.most_produced = capacity, most_produced

    def _full(self, items: list) -> bool:
        return self.capacity is not None and len(items) >= self.capacity

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.items = handle.getListState("items", "item long")
        self.figures = handle.getValueState("figures", "last long, waiting long, produced long, consumed long, dropped long, fresh long, closed boolean")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        items = [int(r[0]) for r in self.items.get()] if self.items.exists() else []
        last, waiting, produced, consumed, dropped, fresh, closed = self.figures.get() if self.figures.exists() else (None, 0, 0, 0, 0, 0, False)
        out = []
        for r in _ordered(rows, last):
            last, op, event, item = r["seq"], r["op"], r["op"], None
            if op == "put":
                produced, fresh = produced + 1, fresh + 1
                if waiting:
                    waiting, consumed, event, item = waiting - 1, consumed + 1, "got", int(r["item"])
                else:
                    if self._full(items):
                        dropped, event, item = dropped + 1, "dropped", items.pop(0)
                    items.append(int(r["item"]))
            elif op == "get":
                if items:
                    consumed, event, item = consumed + 1, "got", items.pop(0)
                elif closed:
                    event = "ended"
                else:
                    waiting, event = waiting + 1, "waits"
            elif op == "clear":
                items = []
            elif op == "close":
                closed, waiting = True, 0
            elif op == "version":
                fresh = 0  # a new version of the parameters: what was made before isn't counted
            else:
                raise ValueError(f"operation {op}")
            paused = self._full(items) or self.most_produced is not None and fresh >= self.most_produced
            out.append((key[0], last, event, item, len(items), waiting, produced, consumed, dropped, paused))
        if items:
            self.items.put([(x,) for x in items])
        else:
            self.items.clear()
        self.figures.update((last, waiting, produced, consumed, dropped, fresh, closed))
        if out:
            names = ["key", "seq", "event", "item", "size", "waiting", "produced", "consumed", "dropped", "paused"]
            columns = dict(zip(names, map(list, zip(*out))))
            yield pd.DataFrame(columns | {"item": pd.array(columns["item"], dtype="Int64")})  # not through doubles

    def close(self) -> None:
        pass


def queue_events(stream: DataFrame, key: str, seq: Column, op: Column, item: Column, capacity: int | None, most_produced: int | None = None) -> DataFrame:
    """A row for each operation on the queue of a key: what happened (put, got, dropped,
    waits, ended, clear, close, version), the item that left, and the queue after it.

    ``paused`` asks producers to stop: the queue is full, or since the last "version"
    as many items as ``most_produced`` came. A queue is at most ``capacity`` items and six
    numbers of state; without a capacity (a queue of validation results) it holds all that
    wasn't got yet."""
    _session(stream.sparkSession)
    rows = stream.select(F.col(key).alias("key"), seq.cast("long").alias("seq"), op.alias("op"), F.coalesce(item.cast("long"), F.lit(0)).alias("item"))
    schema = QUEUE_SCHEMA.format(key=rows.schema["key"].dataType.simpleString())
    return rows.groupBy("key").transformWithStateInPandas(_Queue(capacity, most_produced), schema, "append", "none")


# The replay buffer.


class _Buffer(StatefulProcessor):
    """Tags of the samples of a step. When the step is asked for (a row without sample) and
    nothing in it runs, its successful samples go out, once; then the step is closed."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.tags = handle.getMapState("tags", "sample string", "status string, seq long")
        self.step = handle.getValueState("step", "asked boolean, closed boolean, running long, last long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        asked, closed, running, last = self.step.get() if self.step.exists() else (False, False, 0, None)
        late, ready = [], None
        for r in _ordered(rows, last):
            last = r["seq"]
            asks = r["sample"] is None
            if closed:
                late += [] if asks else [(key[0], r["sample"], "late", last)]
                continue
            if asks:
                asked = True
            else:
                name = (str(r["sample"]),)
                old = self.tags.getValue(name)[0] if self.tags.containsKey(name) else None
                running += (r["status"] == "running") - (old == "running")
                self.tags.updateValue(name, (r["status"], last))
            if asked and not running:
                ready = [(key[0], n[0], "ready", last) for n, (status, _) in self.tags.iterator() if status == "success"]
                closed = True
                self.tags.clear()
        self.step.update((asked, closed, running, last))
        out = [*(ready or []), *late]
        if out:
            yield pd.DataFrame(out, columns=["step", "sample", "event", "seq"])

    def close(self) -> None:
        pass


def replay_ready(stream: DataFrame, step: str, seq: Column, sample: Column, status: Column) -> DataFrame:
    """step, sample, event, seq: the samples of each step that ended in success ("ready"), as
    soon as the step was asked for (a row whose sample is null) and nothing in it runs, at
    the seq of that moment; tags that come after that are "late" and reopen nothing. A
    step's tags are state by sample until it closes, then only its number is."""
    _session(stream.sparkSession)
    rows = stream.select(F.col(step).alias("step"), seq.cast("long").alias("seq"), sample.cast("string").alias("sample"), status.alias("status"))
    schema = f"step {rows.schema['step'].dataType.simpleString()}, sample string, event string, seq long"
    return rows.groupBy("step").transformWithStateInPandas(_Buffer(), schema, "append", "none")


# The coefficient.


class _Coefficient(StatefulProcessor):
    def __init__(self, start: float, target: float, horizon: int):
        self.start, self.target, self.horizon = start, target, horizon

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.now = handle.getValueState("now", "last long, value double")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        last, value = self.now.get() if self.now.exists() else (None, self.start)
        out = []
        for r in _ordered(rows, last):
            error = min(max(r["kl"] / self.target - 1, -0.2), 0.2)
            last, value = r["seq"], value * (1 + error * r["n"] / self.horizon)
            out.append((key[0], last, value))
        self.now.update((last, value))
        if out:
            yield pd.DataFrame(out, columns=["key", "seq", "coefficient"])

    def close(self) -> None:
        pass


def coefficients(stream: DataFrame, key: str, seq: Column, kl: Column, n: Column, start: float, target: float, horizon: int) -> DataFrame:
    """key, seq, coefficient: after each step the coefficient of its key, which each step
    multiplies by 1 + clip(kl / target - 1, -0.2, 0.2) * n / horizon."""
    _session(stream.sparkSession)
    rows = stream.select(F.col(key).alias("key"), seq.cast("long").alias("seq"), kl.cast("double").alias("kl"), n.cast("double").alias("n"))
    schema = f"key {rows.schema['key'].dataType.simpleString()}, seq long, coefficient double"
    return rows.groupBy("key").transformWithStateInPandas(_Coefficient(start, target, horizon), schema, "append", "none")


# Batches written once.


class BatchWriter:
    """A ``foreachBatch`` function that cuts a stream into batches of exactly ``size`` rows in
    order, and writes each once.

    A micro-batch takes what the one before left over, numbers all rows in order of
    ``order`` (a column that tells rows apart) over range partitions, writes the full
    batches under batches/epoch=E and what is over under rest/epoch=E, both with
    overwriting, so that a micro-batch that is repeated after a failure replaces its own
    files. ``counts/epoch=E`` is written last and has the number of batches so far; a
    micro-batch begins from the counts of the one before. ``read`` takes only epochs with
    counts: what a failed attempt has written is not seen."""

    def __init__(self, path: str, size: int, order: str):
        if size < 1:
            raise ValueError("a batch has at least one row")
        self.path, self.size, self.order = path, size, order

    def _folder(self, kind: str, epoch: int) -> str:
        return f"{self.path}/{kind}/epoch={epoch}"

    def _before(self, spark: SparkSession, epoch: int) -> tuple[int, int | None]:
        """(batches so far, the epoch that has the rest) before an epoch."""
        known = self._counts(spark)
        rows = known.where(F.col("epoch") < epoch).orderBy(F.desc("epoch")).limit(1).collect() if known is not None else []
        return (rows[0]["batches"], rows[0]["epoch"]) if rows else (0, None)

    def _counts(self, spark: SparkSession) -> DataFrame | None:
        folder = spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/counts")
        if not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
            return None
        return spark.read.schema("batches long, rows long, epoch long").parquet(f"{self.path}/counts")

    def __call__(self, rows: DataFrame, epoch: int) -> None:
        from brindle.sources.order import with_row_id

        spark = rows.sparkSession
        begin, last = self._before(spark, epoch)
        names = rows.columns
        if last is not None:
            rows = spark.read.schema(rows.schema).parquet(self._folder("rest", last)).unionByName(rows)
        # Checkpointed in order, so that both writes see the same numbers.
        placed = with_row_id(rows, F.col(self.order), name="_at")
        total = placed.count()
        full = total // self.size
        numbered = placed.where(F.col("_at") < full * self.size).select(*names, (F.floor(F.col("_at") / self.size) + begin).cast("long").alias("batch"), (F.col("_at") % self.size).cast("long").alias("place"))
        numbered.write.mode("overwrite").parquet(self._folder("batches", epoch))
        placed.where(F.col("_at") >= full * self.size).select(*names).write.mode("overwrite").parquet(self._folder("rest", epoch))
        spark.range(1).select(F.lit(begin + full).cast("long").alias("batches"), F.lit(full * self.size).cast("long").alias("rows")).write.mode("overwrite").parquet(self._folder("counts", epoch))

    def read(self, spark: SparkSession, schema: str) -> DataFrame:
        """The batches of all finished epochs: the columns of ``schema``, batch, place."""
        known = self._counts(spark)
        columns = f"{schema}, batch long, place long, epoch long"
        if known is None:
            return spark.createDataFrame([], columns).drop("epoch")
        done = known.where("rows > 0").select("epoch")
        return spark.read.schema(columns).option("basePath", f"{self.path}/batches").parquet(f"{self.path}/batches").join(F.broadcast(done), "epoch", "left_semi").drop("epoch")


def assembled(batches: DataFrame, version: str, current: Column, score: str) -> DataFrame:
    """A row for each batch: its rows, the versions of the parameters it was made with, how
    many rows are of an older version than ``current`` and by how much, and its mean score."""
    age = F.greatest(current - F.col(version), F.lit(0))
    return batches.groupBy("batch").agg(
        F.count("*").alias("rows"), F.min(version).alias("oldest"), F.max(version).alias("newest"), F.countDistinct(version).alias("versions"),
        F.sum(F.when(age > 0, 1).otherwise(0)).alias("stale"), F.max(age).alias("most_stale"), F.avg(score).alias("score"),
    )
