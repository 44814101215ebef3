"""Batch algebra over lineitem, in the order of a full key."""

from __future__ import annotations

from pyspark.sql import functions as F

from brindle.operators import frame as B
from brindle.plans.base import query, table
from brindle.sources.order import with_row_id

KEY = ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_shipdate", "l_extendedprice")
ROWS = f"b AS (SELECT row_number() OVER (ORDER BY {', '.join(KEY)}) - 1 AS row_id, l_orderkey AS k, l_quantity AS q, l_comment FROM (SELECT *, l_returnflag AS l_comment FROM lineitem)), n AS (SELECT count(*) AS n FROM lineitem)"


def _rows(spark, sf):
    """(rows, how many): row_id, k, q, l_comment."""
    li = table(spark, sf, "lineitem").select(*KEY, "l_quantity", "l_returnflag")
    rows = with_row_id(li, *KEY).select("row_id", F.col("l_orderkey").alias("k"), F.col("l_quantity").alias("q"), F.col("l_returnflag").alias("l_comment"))
    return rows, li.count()


def _sql(body: str) -> str:
    return f"WITH {ROWS} {body}"


@query("batch_row_id", _sql("SELECT row_id, k, q FROM b"))
def batch_row_id(spark, sf):
    return _rows(spark, sf)[0].select("row_id", "k", "q")


@query("batch_slice", _sql("SELECT ((row_id - 10) / 3)::BIGINT AS row_id, k FROM b WHERE row_id >= 10 AND row_id < 5000 AND (row_id - 10) % 3 = 0"))
def batch_slice(spark, sf):
    return B.slice_rows(_rows(spark, sf)[0], 10, 5000, 3).select("row_id", "k")


@query("batch_gather", _sql("SELECT i.row_id AS row_id, b.k FROM b i JOIN b ON b.row_id = (i.row_id * 7) % 100"))
def batch_gather(spark, sf):
    rows, _ = _rows(spark, sf)
    idx = rows.select(F.col("row_id").alias("pos"), ((F.col("row_id") * 7) % 100).alias("row_id"))
    return B.gather(rows.select("row_id", "k"), idx).select("row_id", "k")


@query("batch_mask", _sql("SELECT row_id, k FROM b WHERE q > 25"))
def batch_mask(spark, sf):
    return _rows(spark, sf)[0].where("q > 25").select("row_id", "k")


@query("batch_reorder", _sql("SELECT n - 1 - row_id AS row_id, k FROM b, n"))
def batch_reorder(spark, sf):
    rows, n = _rows(spark, sf)
    return B.reorder(rows, F.lit(n - 1) - F.col("row_id")).select("row_id", "k")


@query("batch_pop_rename", _sql("SELECT row_id, k AS order_key, q * 2 AS twice FROM b"))
def batch_pop_rename(spark, sf):
    left, popped = B.pop(_rows(spark, sf)[0], "q")
    rows = B.rename(left.drop("l_comment"), ["k"], ["order_key"])
    return B.union_columns(rows, popped.withColumn("twice", F.col("q") * 2).drop("q"))


@query("batch_union", _sql("SELECT row_id, k, q, q + 1 AS q1 FROM b"))
def batch_union(spark, sf):
    rows, _ = _rows(spark, sf)
    return B.union_columns(rows.select("row_id", "k", "q"), rows.select("row_id", "k", (F.col("q") + 1).alias("q1")))


@query("batch_concat", _sql("SELECT row_id, k FROM b UNION ALL SELECT row_id + n, k FROM b, n"))
def batch_concat(spark, sf):
    rows, n = _rows(spark, sf)
    part = rows.select("row_id", "k")
    return B.concat([part, part], [n, n])


for _name, _inter in (("interleaved", True), ("tiled", False)):

    @query(f"batch_repeat_{_name}", _sql(f"SELECT {'row_id * 3 + x' if _inter else 'x * n + row_id'} AS row_id, k FROM b, n, range(3) r(x)"))
    def batch_repeat(spark, sf, inter=_inter):
        rows, n = _rows(spark, sf)
        return B.repeat(rows.select("row_id", "k"), 3, n, inter)


@query("batch_sample_repeat", _sql("SELECT row_id, k, x::INT AS copy FROM b, range(3) r(x) WHERE x < k % 4"))
def batch_sample_repeat(spark, sf):
    return B.sample_level_repeat(_rows(spark, sf)[0].select("row_id", "k"), F.col("k") % 4)


@query("batch_fold", _sql("SELECT row_id // 4 AS row_id, array_to_string(list(k ORDER BY row_id), ',') AS keys, count(*) AS n FROM b GROUP BY 1"))
def batch_fold(spark, sf):
    rows = B.fold(_rows(spark, sf)[0], 4, ["k"])
    return rows.select("row_id", F.array_join("k", ",").alias("keys"), F.size("k").cast("long").alias("n"))


@query("batch_unfold", _sql("SELECT row_id, k FROM b"))
def batch_unfold(spark, sf):
    return B.unfold(B.fold(_rows(spark, sf)[0], 8, ["k", "q"]), 8, ["k", "q"]).select("row_id", "k")


@query("batch_unfold_chunks", "SELECT vec_id * 4 + x AS row_id, vec_id, round(embedding[x * 16 + 1], 6)::DOUBLE AS first, 16::BIGINT AS n FROM embeddings, range(4) r(x)")
def batch_unfold_chunks(spark, sf):
    rows = table(spark, sf, "embeddings").select(F.col("vec_id").alias("row_id"), "vec_id", "embedding")
    rows = B.unfold_column_chunks(rows, 4, ["embedding"])
    return rows.select("row_id", "vec_id", F.round(F.element_at("embedding", 1), 6).cast("double").alias("first"), F.size("embedding").cast("long").alias("n"))


@query("batch_chunk", _sql("SELECT row_id // ceil(n / 7)::BIGINT AS part, count(*) AS n, min(row_id) AS first FROM b, n GROUP BY 1"))
def batch_chunk(spark, sf):
    rows, n = _rows(spark, sf)
    return B.chunk(rows, 7, n, padding=True).groupBy("part").agg(F.count("*").alias("n"), F.min("row_id").alias("first"))


@query("batch_split", _sql("SELECT row_id // 1000 AS part, count(*) AS n FROM b GROUP BY 1"))
def batch_split(spark, sf):
    return B.split(_rows(spark, sf)[0], 1000).groupBy("part").agg(F.count("*").alias("n"))


PAD = "CASE WHEN n % 1021 = 0 THEN 0 ELSE 1021 - n % 1021 END"


@query("batch_pad", _sql(f"SELECT row_id, k FROM b UNION ALL SELECT n + row_id, k FROM b, n WHERE row_id < {PAD}"))
def batch_pad(spark, sf):
    rows, n = _rows(spark, sf)
    return B.pad_to_divisor(rows.select("row_id", "k"), 1021, n)[0]


@query("batch_unpad", _sql("SELECT row_id, k FROM b"))
def batch_unpad(spark, sf):
    rows, n = _rows(spark, sf)
    return B.unpad(B.pad_to_divisor(rows.select("row_id", "k"), 1021, n)[0], n)


@query("batch_padding_last", _sql("SELECT row_id, k FROM b UNION ALL SELECT n + x, k FROM b, n, range(5) r(x) WHERE row_id = n - 1"))
def batch_padding_last(spark, sf):
    rows, n = _rows(spark, sf)
    return B.padding(rows.select("row_id", "k"), 5, n)


@query("batch_upsample", _sql("SELECT count(*) + CASE WHEN n % 64 = 0 THEN 0 ELSE 64 - n % 64 END AS n, sum(q)::DOUBLE AS q FROM b, n GROUP BY n"))
def batch_upsample(spark, sf):
    rows, n = _rows(spark, sf)
    out = B.upsample(rows.select("row_id", F.array("q").alias("q")), 64, n, ["q"])
    return out.agg(F.count("*").alias("n"), F.sum(F.element_at("q", 1)).alias("q"))


@query("batch_minibatches", _sql("SELECT e.x::INT AS epoch, row_id // 500 AS batch, count(*) AS n FROM b, n, range(2) e(x) GROUP BY 1, 2"))
def batch_minibatches(spark, sf):
    rows, n = _rows(spark, sf)
    rows = rows.where(F.col("row_id") < n - n % 500) if n % 500 else rows
    return B.minibatches(rows, 500, n - n % 500, 2, 1).groupBy("epoch", "batch").agg(F.count("*").alias("n"))


@query("batch_dataset_split", _sql("SELECT row_id // (n // 7) AS part, count(*) AS n FROM b, n WHERE row_id < (n // 7) * 7 GROUP BY 1"))
def batch_dataset_split(spark, sf):
    rows, n = _rows(spark, sf)
    return B.dataset_split(rows, 7, n).groupBy("part").agg(F.count("*").alias("n"))


@query("batch_max_samples", _sql("SELECT row_id, k FROM b WHERE row_id < 250"))
def batch_max_samples(spark, sf):
    return B.max_samples(_rows(spark, sf)[0], 250).select("row_id", "k")


@query("batch_train", _sql("SELECT row_id // 999 AS part, count(*) AS n FROM b, n WHERE row_id // 999 < n // 999 GROUP BY 1"))
def batch_train(spark, sf):
    rows, n = _rows(spark, sf)
    return B.train_batches(rows, 999, n).groupBy("part").agg(F.count("*").alias("n"))


@query("batch_range_split", _sql("SELECT CASE WHEN row_id < floor(n * 0.75e0) THEN 'train' ELSE 'test' END AS split, count(*) AS n FROM b, n GROUP BY 1"))
def batch_range_split(spark, sf):
    rows, n = _rows(spark, sf)
    head = B.slice_rows(rows, 0, int(n * 0.75)).withColumn("split", F.lit("train"))
    return head.unionByName(B.slice_rows(rows, int(n * 0.75)).withColumn("split", F.lit("test"))).groupBy("split").agg(F.count("*").alias("n"))


@query("filter_overlong", "SELECT doc_id FROM documents WHERE text IS NOT NULL AND len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) <= 200")
def filter_overlong(spark, sf):
    d = table(spark, sf, "documents")
    return B.overlong_filter(d, F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]++")), 200).select("doc_id")


@query("filter_label", "SELECT event_id FROM events WHERE length(event_type) > 4")
def filter_label(spark, sf):
    return table(spark, sf, "events").where(F.length("event_type") > 4).select("event_id")


@query("filter_varied_groups", "SELECT event_id FROM events QUALIFY max(value) OVER (PARTITION BY user_id) > min(value) OVER (PARTITION BY user_id)")
def filter_varied_groups(spark, sf):
    return B.keep_varied_groups(table(spark, sf, "events"), "user_id", "value").select("event_id")


@query("view_search", "SELECT conv_id, turn, role FROM conversations WHERE contains(text, 'the') OR contains(role, 'the')")
def view_search(spark, sf):
    return B.search(table(spark, sf, "conversations"), "the", ["text", "role"], [F.col("conv_id"), F.col("turn")]).select("conv_id", "turn", "role")


@query("batch_row_at", _sql("SELECT 0::BIGINT AS row_id, k, q FROM b WHERE row_id = (SELECT n - 3 FROM n)"))
def batch_row_at(spark, sf):
    rows, n = _rows(spark, sf)
    return B.row_at(rows, -3, n).select("row_id", "k", "q")


@query("batch_python_slice", _sql("SELECT ((n - 10 - row_id) // 3)::BIGINT AS row_id, k FROM b, n WHERE row_id <= n - 10 AND row_id > n - 500 AND (n - 10 - row_id) % 3 = 0"))
def batch_python_slice(spark, sf):
    rows, n = _rows(spark, sf)
    return B.python_slice(rows, slice(-10, -500, -3), n).select("row_id", "k")


@query("batch_fetch", "SELECT l_orderkey, l_linenumber, o_totalprice FROM lineitem JOIN orders ON o_orderkey = l_orderkey")
def batch_fetch(spark, sf):
    """The payload of each line's order."""
    store = table(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_totalprice")
    return B.fetch(table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber"), store, "l_orderkey")


@query("batch_data_info", """SELECT unnest(['event_id', 'event_type', 'value']) AS "column", unnest(['bigint', 'string', 'double']) AS kind, unnest([count(*), count(*), count(*)]) AS rows, unnest([count(*) - count(event_id), count(*) - count(event_type), count(*) - count(value)]) AS nulls,
  unnest([1, max(length(event_type)), 1])::BIGINT AS longest FROM (SELECT event_id, CASE WHEN event_id % 7 = 0 THEN NULL ELSE event_type END AS event_type, CASE WHEN user_id % 3 = 0 THEN NULL ELSE value END AS value FROM events)""")
def batch_data_info(spark, sf):
    e = table(spark, sf, "events")
    return B.data_info(e.select("event_id", F.when(F.col("event_id") % 7 != 0, F.col("event_type")).alias("event_type"), F.when(F.col("user_id") % 3 != 0, F.col("value")).alias("value")))
