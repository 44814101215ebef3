"""Streams with state over the driver's events, cut in several micro-batches.

The events come in PARTS runs of the same stream, each from the checkpoint of the one
before; what comes out is compared with one replay of all events."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from brindle.plans.base import query, r, rr, table
from brindle.sources import files as IO
from brindle.streaming import stateful as ST

PARTS = 3


def in_parts(spark: SparkSession, sf: str, run: Callable[[DataFrame], DataStreamWriter], base: str) -> None:
    """Run a stream over the events, which arrive in PARTS ranges of event_id."""
    events = table(spark, sf, "events")
    top = events.agg(F.max("event_id")).first()[0] or 0
    for k in range(PARTS):
        part = F.floor(F.col("event_id") * PARTS / (top + 1)).cast("int") == k
        events.where(part).write.mode("append").parquet(f"{base}/in")
        source = spark.readStream.schema(events.schema).parquet(f"{base}/in")
        run(source).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start().awaitTermination()


def _appended(spark: SparkSession, sf: str, rows: Callable[[DataFrame], DataFrame], name: str) -> DataFrame:
    base, schema = IO.scratch(spark, name), []

    def run(source: DataFrame) -> DataStreamWriter:
        out = rows(source)
        schema[:] = [out.schema]
        return out.writeStream.format("parquet").option("path", f"{base}/out").outputMode("append")

    in_parts(spark, sf, run, base)
    return spark.read.schema(schema[0]).parquet(f"{base}/out")


OP = "CASE WHEN event_id % 29 = 0 THEN 'version' WHEN event_id % 5 IN (0, 2) THEN 'get' ELSE 'put' END"
LEFT = "(consumed + dropped)"


def _queue_sql(capacity: int, most: int) -> str:
    """A replay of all operations. Items leave in the order they came in, so the k-th that
    leaves is the k-th put."""
    return f"""WITH RECURSIVE ops AS (SELECT user_id AS key, event_id AS seq, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i, {OP} AS op FROM events),
  puts AS (SELECT key, seq AS item, row_number() OVER (PARTITION BY key ORDER BY seq) AS k FROM ops WHERE op = 'put'),
  q AS (SELECT DISTINCT key, 0::BIGINT AS i, 0::BIGINT AS size, 0::BIGINT AS waiting, 0::BIGINT AS produced, 0::BIGINT AS consumed, 0::BIGINT AS dropped, 0::BIGINT AS fresh, 0::BIGINT AS before FROM ops
    UNION ALL SELECT q.key, ops.i, CASE WHEN op = 'put' AND waiting = 0 THEN least(size + 1, {capacity}) WHEN op = 'get' AND size > 0 THEN size - 1 ELSE size END,
      CASE WHEN op = 'put' AND waiting > 0 THEN waiting - 1 WHEN op = 'get' AND size = 0 THEN waiting + 1 ELSE waiting END, produced + (op = 'put')::INT,
      consumed + (op = 'put' AND waiting > 0 OR op = 'get' AND size > 0)::INT, dropped + (op = 'put' AND waiting = 0 AND size = {capacity})::INT,
      CASE op WHEN 'put' THEN fresh + 1 WHEN 'version' THEN 0 ELSE fresh END, {LEFT} FROM q JOIN ops ON ops.key = q.key AND ops.i = q.i + 1)
  SELECT q.key, ops.seq, CASE WHEN op = 'put' AND {LEFT} > before THEN CASE WHEN size = {capacity} THEN 'dropped' ELSE 'got' END WHEN op = 'get' THEN CASE WHEN {LEFT} > before THEN 'got' ELSE 'waits' END ELSE op END AS event,
    coalesce(puts.item, -1) AS item, size, waiting, produced, consumed, dropped, size >= {capacity} OR fresh >= {most} AS paused
  FROM q JOIN ops ON ops.key = q.key AND ops.i = q.i LEFT JOIN puts ON puts.key = q.key AND puts.k = {LEFT} AND {LEFT} > before"""


@query("stream_queue", _queue_sql(4, 6))
def stream_queue(spark, sf):
    """Puts, gets and new versions on a queue of each user: what happens at each."""
    rows = lambda s: ST.queue_events(s, "user_id", F.col("event_id"), F.expr(OP), F.col("event_id"), 4, 6)
    return _appended(spark, sf, rows, "queue").na.fill(-1, ["item"])


@query("stream_validation_queue", _queue_sql(10**9, 10**9))
def stream_validation_queue(spark, sf):
    """The same on a queue without a bound, where nothing is dropped and nothing pauses."""
    rows = lambda s: ST.queue_events(s, "user_id", F.col("event_id"), F.expr(OP), F.col("event_id"), None)
    return _appended(spark, sf, rows, "queue").na.fill(-1, ["item"])


SAMPLE = "CASE WHEN event_id % 7 = 0 THEN NULL ELSE event_type || event_id % 2 END"
STATUS = "CASE WHEN event_id % 3 = 0 THEN 'running' WHEN event_id % 4 = 1 THEN 'failed' ELSE 'success' END"


@query("stream_replay_ready", f"""WITH t AS (SELECT user_id AS step, event_id AS seq, {SAMPLE} AS sample, {STATUS} AS status FROM events),
  d AS (SELECT *, CASE WHEN sample IS NULL THEN 0 ELSE (status = 'running')::INT - coalesce(lag(status) OVER (PARTITION BY step, sample ORDER BY seq) = 'running', false)::INT END AS delta FROM t),
  c AS (SELECT *, sum(delta) OVER w AS running, max((sample IS NULL)::INT) OVER w AS asked FROM d WINDOW w AS (PARTITION BY step ORDER BY seq)),
  closed AS (SELECT step, min(seq) AS seq FROM c WHERE asked = 1 AND running = 0 GROUP BY step)
  SELECT t.step, t.sample, 'ready' AS event, closed.seq FROM t JOIN closed ON t.step = closed.step AND t.seq <= closed.seq WHERE sample IS NOT NULL GROUP BY t.step, t.sample, closed.seq HAVING max_by(status, t.seq) = 'success'
  UNION ALL SELECT t.step, t.sample, 'late', t.seq FROM t JOIN closed ON t.step = closed.step AND t.seq > closed.seq WHERE sample IS NOT NULL""")
def stream_replay_ready(spark, sf):
    """The samples of each step, once, when it is asked for and nothing in it runs."""
    rows = lambda s: ST.replay_ready(s, "user_id", F.col("event_id"), F.expr(SAMPLE), F.expr(STATUS))
    return _appended(spark, sf, rows, "replay")


@query("stream_coefficients", f"SELECT user_id AS key, event_id AS seq, {rr('0.1e0 * product(1 + least(greatest(value / 50 - 1, -0.2e0), 0.2e0) * 64 / 10000) OVER (PARTITION BY user_id ORDER BY event_id)', 8)} AS coefficient FROM events")
def stream_coefficients(spark, sf):
    rows = lambda s: ST.coefficients(s, "user_id", F.col("event_id"), F.col("value"), F.lit(64), 0.1, 50.0, 10000)
    return _appended(spark, sf, rows, "coefficient").withColumn("coefficient", r("coefficient", 8))


COLUMNS = "event_id long, user_id long, value double"


def _batches(spark: SparkSession, sf: str, size: int) -> DataFrame:
    base = IO.scratch(spark, "batches")
    writer = ST.BatchWriter(f"{base}/out", size, "event_id")
    in_parts(spark, sf, lambda s: s.select("event_id", "user_id", "value").writeStream.foreachBatch(writer), base)
    return writer.read(spark, COLUMNS)


@query("stream_batches_once", "SELECT event_id, (k - 1) // 48 AS batch, (k - 1) % 48 AS place FROM (SELECT event_id, row_number() OVER (ORDER BY event_id) AS k FROM events) WHERE k <= (SELECT count(*) // 48 * 48 FROM events)")
def stream_batches_once(spark, sf):
    """Batches of 48 events, none of which spans what isn't full yet."""
    return _batches(spark, sf, 48).select("event_id", "batch", "place")


@query("stream_assembled", f"""WITH b AS (SELECT *, (row_number() OVER (ORDER BY event_id) - 1) // 64 AS batch FROM events)
  SELECT batch, count(*) AS rows, min(user_id % 9) AS oldest, max(user_id % 9) AS newest, count(DISTINCT user_id % 9) AS versions, sum((user_id % 9 < 6)::INT)::BIGINT AS stale, max(greatest(6 - user_id % 9, 0)) AS most_stale, {rr("avg(value)", 9)} AS score
  FROM b WHERE batch < (SELECT count(*) // 64 FROM events) GROUP BY batch""")
def stream_assembled(spark, sf):
    """Figures of each batch: the versions its rows were made with, and its mean score."""
    rows = _batches(spark, sf, 64).withColumn("version", F.col("user_id") % 9)
    return ST.assembled(rows, "version", F.lit(6), "value").withColumn("score", r("score", 9))
