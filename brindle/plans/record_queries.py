"""Differing dicts, draws by splitting and datasets of the user's own over the tables."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow.dataset as DS
import pyarrow.parquet as pq
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType

from brindle.operators import draws as DR
from brindle.operators import records as RC
from brindle.plans.base import query, table
from brindle.sources import custom

#: Dicts of events, whose keys differ: all have k; some have a name, a list or a nested dict.
RECORD = """CASE event_id % 4 WHEN 0 THEN props WHEN 1 THEN '{"k": ' || user_id || '.5, "name": "' || event_type || '"}' WHEN 2 THEN '{"k": null, "list": [' || user_id || ', 1]}' ELSE '{"in": {"u": ' || user_id || '}, "name": "n"}' END"""


def _records(spark, sf):
    return table(spark, sf, "events").select("event_id", "user_id", F.expr(RECORD).alias("record"))


@query("records_props", "SELECT event_id, CAST(props->>'k' AS BIGINT) AS k FROM events")
def records_props(spark, sf):
    """The keys of events.props as columns."""
    return RC.opened(table(spark, sf, "events").select("event_id", "props"), "props")


@query("records_opened", f"""WITH r AS (SELECT event_id, ({RECORD})::JSON AS j FROM events)
  SELECT event_id, CAST(j->>'k' AS DOUBLE) AS k, j->>'name' AS name, coalesce(CAST(j->'list'->>0 AS BIGINT), -1) AS first, coalesce(CAST(j->'in'->>'u' AS BIGINT), -1) AS u FROM r""")
def records_opened(spark, sf):
    rows = RC.opened(_records(spark, sf), "record", keep=["event_id"])
    or_none = lambda c: F.coalesce(c, F.lit(-1)).cast("long")
    return rows.select("event_id", F.col("k").cast("double").alias("k"), "name", or_none(F.get("list", F.lit(0))).alias("first"), or_none(F.col("in.u")).alias("u"))


@query("records_pivot", f"""WITH r AS (SELECT user_id, event_id, ({RECORD})::JSON AS j FROM events)
  SELECT user_id, count(*) AS n, string_agg(coalesce(j->>'name', '-'), ',' ORDER BY event_id) AS names, count(j->>'k') AS with_k FROM r GROUP BY user_id""")
def records_pivot(spark, sf):
    lists = RC.dict_of_lists(_records(spark, sf), ["user_id"], "event_id", "record")
    return lists.select("user_id", F.size("name").cast("long").alias("n"), F.array_join(F.transform("name", lambda x: F.coalesce(x, F.lit("-"))), ",").alias("names"), F.size(F.filter("k", lambda x: x.isNotNull())).cast("long").alias("with_k"))


@query("records_appended", f"""WITH r AS (SELECT event_id, ({RECORD})::JSON AS j FROM events), k AS (SELECT event_id, unnest(json_keys(j)) AS key, j FROM r)
  SELECT 'log/' || key AS key, sum(CASE WHEN key = 'list' THEN json_array_length(j->'list') ELSE 1 END)::BIGINT AS n FROM k GROUP BY key""")
def records_appended(spark, sf):
    return RC.appended(_records(spark, sf), "event_id", "record", "log/").select("key", "n")


@query("records_assigned", f"""WITH r AS (SELECT event_id, ({RECORD})::JSON AS j FROM events WHERE event_id % 3 = 0) SELECT e.event_id, e.user_id, r.j->>'name' AS name, CAST(r.j->>'k' AS DOUBLE) AS k FROM events e LEFT JOIN r USING (event_id)""")
def records_assigned(spark, sf):
    """Dicts of some rows given to all rows of a batch."""
    rows = _records(spark, sf)
    some = rows.where("event_id % 3 = 0").select("event_id", "record")
    return RC.assigned(rows.select("event_id", "user_id"), "event_id", some, "record").select("event_id", "user_id", "name", F.col("k").cast("double").alias("k"))


@query("draws_multinomial")
def draws_multinomial(spark, sf):
    """How often each order is drawn, by its price. Draws have no SQL form; a test holds
    their total and shares against the weights."""
    rows = table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    return DR.multinomial(rows, "o_totalprice", ["o_orderkey"], seed=7, range_rows=512).select("o_orderkey", "draws")


@query("draws_total", "SELECT count(*) AS n, 3 * count(*) AS thrice FROM orders")
def draws_total(spark, sf):
    """The totals of two multinomial draws are exact."""
    rows = table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    once = DR.resampled(DR.multinomial(rows, "o_totalprice", ["o_orderkey"], seed=1, range_rows=512)).agg(F.count("*").alias("n"))
    thrice = DR.multinomial(rows, "o_totalprice", ["o_orderkey"], 3 * rows.count(), 2, 512).agg(F.sum("draws").alias("thrice"))
    return once.join(F.broadcast(thrice))  # a row each


class RowGroups:
    """A dataset of the row groups of a Parquet file, read by Arrow in the tasks."""

    def __init__(self, options: dict):
        self.path = options["path"]

    def schema(self) -> StructType:
        kinds = {"int64": LongType(), "double": DoubleType(), "string": StringType()}
        return StructType([StructField(f.name, kinds[str(f.type)]) for f in DS.dataset(self.path, format="parquet").schema if str(f.type) in kinds])

    def partitions(self) -> list:
        # A row group is read once, from its start, so work follows the rows however many there are.
        return [(f.path, g.id) for f in DS.dataset(self.path, format="parquet").get_fragments() for g in f.row_groups]

    def read(self, partition, columns, filters) -> Iterator:
        path, group = partition
        for batch in pq.ParquetFile(path).iter_batches(row_groups=[group], columns=columns):
            yield batch.select(columns)


@query("custom_dataset", "SELECT event_id, user_id, value FROM events WHERE value > 100")
def custom_dataset(spark, sf):
    """A user's dataset class as a source, some of its columns, in parallel."""
    custom.register(spark, "rowgroups", RowGroups)
    return spark.read.format("rowgroups").option("columns", "event_id, user_id, value").load(f"{sf}/events.parquet").where("value > 100")
