"""Streams with state against plain replays, for several cuts of the stream, and restarts."""

from __future__ import annotations

import random
from collections import deque

import pytest
from pyspark.sql import functions as F

from brindle.streaming import stateful as ST

OPS = "key string, seq long, op string, item long"


def replay(ops, capacity, most):
    """The events of one key's operations in order."""
    items, waiting, produced, consumed, dropped, fresh, closed, out = deque(), 0, 0, 0, 0, 0, False, []
    for seq, op, item in ops:
        event, left = op, None
        if op == "put":
            produced, fresh = produced + 1, fresh + 1
            if waiting:
                waiting, consumed, event, left = waiting - 1, consumed + 1, "got", item
            else:
                if len(items) == capacity:
                    dropped, event, left = dropped + 1, "dropped", items.popleft()
                items.append(item)
        elif op == "get" and items:
            consumed, event, left = consumed + 1, "got", items.popleft()
        elif op == "get":
            event = "ended" if closed else "waits"
            waiting += not closed
        elif op == "clear":
            items.clear()
        elif op == "close":
            closed, waiting = True, 0
        elif op == "version":
            fresh = 0
        out.append((seq, event, left, len(items), waiting, produced, consumed, dropped, len(items) >= capacity or most is not None and fresh >= most))
    return out


def run(spark, base, schema, batches, rows, then=None):
    """Run a stream with a micro-batch for each of ``batches``, each from the checkpoint."""
    for part in batches:
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{base}/in")
        source = spark.readStream.schema(schema).parquet(f"{base}/in")
        out = rows(source)
        writer = out.writeStream.format("parquet").option("path", f"{base}/out").outputMode("append")
        writer.option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{base}/out").collect()


def operations():
    rng = random.Random(6)
    kinds = ["put"] * 6 + ["get"] * 4 + ["clear", "version"]
    ops = {k: [(s, rng.choice(kinds), (1 << 60) + s) for s in range(1, 70)] for k in ("a", "b", None)}
    ops["a"][60] = (61, "close", None)
    return ops


@pytest.mark.parametrize("cuts", [[70], [1, 2, 35, 70], [20, 40, 60, 70]])
def test_queue_for_any_cut(spark, tmp_path, cuts):
    ops = operations()
    parts, at = [], 0
    for cut in cuts:
        part = [(k, *o) for k, own in ops.items() for o in own[at:cut]]
        random.Random(cut).shuffle(part)
        parts.append(part)
        at = cut
    # What has been delivered already comes again.
    parts[-1] = parts[-1] + [(k, *o) for k, own in ops.items() for o in own[:5]] * (len(cuts) > 1)
    got = run(spark, str(tmp_path), OPS, parts, lambda s: ST.queue_events(s, "key", F.col("seq"), F.col("op"), F.col("item"), 3, 8))
    want = {(k, *e) for k, own in ops.items() for e in replay(own, 3, 8)}
    assert {tuple(r) for r in got} == want and len(got) == len(want)


def test_replay_buffer_reopens_no_step(spark, tmp_path):
    schema = "step int, seq long, sample string, status string"
    first = [(1, 1, "x", "running"), (1, 2, "y", "success"), (1, 3, None, None), (2, 1, "p", "success"), (3, 1, None, None)]
    second = [(1, 4, "x", "success"), (1, 5, "z", "running"), (2, 2, "q", "failed"), (2, 3, None, None), (3, 2, "late", "success")]
    third = [(1, 6, "z", "success"), (2, 4, "p", "running"), (2, 5, None, None)]
    got = run(spark, str(tmp_path), schema, [first, second, third], lambda s: ST.replay_ready(s, "step", F.col("seq"), F.col("sample"), F.col("status")))
    # Step 3 is asked for before anything is in it, so it closes empty.
    assert sorted(map(tuple, got)) == [(1, "x", "ready", 4), (1, "y", "ready", 4), (1, "z", "late", 5), (1, "z", "late", 6), (2, "p", "late", 4), (2, "p", "ready", 3), (3, "late", "late", 2)]


def test_coefficient_over_restarts(spark, tmp_path):
    rng = random.Random(1)
    rows = [(k, s, rng.random() * 0.2, 32.0) for k in "ab" for s in range(30)]
    got = run(spark, str(tmp_path), "key string, seq long, kl double, n double", [[r for r in rows if r[1] % 3 == 0 and r[1] < 9], [r for r in rows if r[1] >= 9]], lambda s: ST.coefficients(s, "key", F.col("seq"), F.col("kl"), F.col("n"), 0.2, 0.1, 1000))
    value, want = {"a": 0.2, "b": 0.2}, {}
    for k, s, kl, n in rows:
        if s >= 9 or s % 3 == 0:
            value[k] *= 1 + min(max(kl / 0.1 - 1, -0.2), 0.2) * n / 1000
            want[k, s] = value[k]
    assert {(r["key"], r["seq"]): r["coefficient"] for r in got} == pytest.approx(want)


class Fails:
    """Fails once in an epoch, after the batches are written and before they count."""

    def __init__(self, writer, epoch):
        self.writer, self.epoch, self.failed = writer, epoch, False

    def __call__(self, rows, epoch):
        if epoch == self.epoch and not self.failed:
            self.failed = True
            plain, self.writer._folder = self.writer._folder, self.refuse
            self.plain = plain
            try:
                self.writer(rows, epoch)
            finally:
                self.writer._folder = plain
        else:
            self.writer(rows, epoch)

    def refuse(self, kind, epoch):
        if kind == "counts":
            raise OSError("lost")
        return self.plain(kind, epoch)


def test_batches_are_written_once(spark, tmp_path):
    parts = [list(range(0, 25)), list(range(25, 30)), list(range(30, 73)), list(range(73, 75))]
    base = str(tmp_path)
    writer = ST.BatchWriter(f"{base}/out", 10, "i")
    fails = Fails(writer, 2)
    for part in parts:
        spark.createDataFrame([(i, f"row {i}") for i in part], "i long, s string").repartition(3).write.mode("append").parquet(f"{base}/in")
        for _ in range(2):
            source = spark.readStream.schema("i long, s string").parquet(f"{base}/in")
            query = source.writeStream.foreachBatch(fails).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
            try:
                query.awaitTermination()
                break
            except Exception as e:  # the failed micro-batch comes again
                assert "lost" in str(e)
                assert writer.read(spark, "i long, s string").count() == 30
    assert fails.failed
    got = sorted((r["batch"], r["place"], r["i"]) for r in writer.read(spark, "i long, s string").collect())
    assert got == [(i // 10, i % 10, i) for i in range(70)]
    # A micro-batch that comes again after all replaces its own files.
    writer(spark.createDataFrame([(i, "") for i in parts[3]], "i long, s string"), 3)
    assert writer.read(spark, "i long, s string").count() == 70
    assert ST.BatchWriter(f"{base}/none", 3, "i").read(spark, "i long").count() == 0
    with pytest.raises(ValueError):
        ST.BatchWriter(base, 0, "i")
