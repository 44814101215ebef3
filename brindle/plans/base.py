"""How queries see the driver's tables: samples, trajectories and tokens.

lineitem rows are samples (uid = order); orders are trajectories whose tokens are their
lineitems, four neighbouring orders a group. The SQL twins are built from the same text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

#: A total order of lineitem rows within an order.
ORDER = ("l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice")
TOKEN = {
    "r": "l_extendedprice * (1 - l_discount) / 9973",
    "v": "l_quantity / 10",
    "m": "CASE WHEN l_returnflag = 'R' THEN 0e0 ELSE 1e0 END",
    "lp": "-(l_discount * 5 + 0.1e0)",
    "olp": "-(l_tax * 5 + 0.1e0)",
    "ref": "-((l_discount + l_tax) * 2.5e0 + 0.1e0)",
    "spi": "0.5e0 + l_tax",
    "a": "(l_extendedprice - 30000) / 20000",
    "w": "0.5e0 + l_discount * 10",
}
NUMBERED = f"row_number() OVER (PARTITION BY l_orderkey ORDER BY {', '.join(ORDER)})"
#: Token rows, for SQL: row_id, uid, t (from 1) and the columns of TOKEN.
TOK = f"tok AS (SELECT l_orderkey AS row_id, l_orderkey // 4 AS uid, {NUMBERED} AS t, {', '.join(f'{e} AS {k}' for k, e in TOKEN.items())} FROM lineitem)"
#: Samples, for SQL: uid, row_id (a hash-free total order inside a group), score, length.
SAMPLE = f"sample AS (SELECT l_orderkey AS uid, {NUMBERED} AS row_id, {TOKEN['r']} AS score, l_quantity AS length, l_tax * 100 AS fmt FROM lineitem)"
#: Trajectories, for SQL, from TOK.
TRAJ = "traj AS (SELECT row_id, any_value(uid) AS uid, sum(r) AS score, sum(m) AS length FROM tok GROUP BY row_id)"


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def r(col: Column | str, digits: int = 6) -> Column:
    """Rounded, and never minus zero."""
    return F.round(F.col(col) if isinstance(col, str) else col, digits) + F.lit(0.0)


def rr(expr: str, digits: int = 6) -> str:
    return f"(round({expr}, {digits}) + 0e0)"


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    return li.selectExpr("l_orderkey AS uid", f"CAST({NUMBERED} AS BIGINT) AS row_id", f"{TOKEN['r']} AS score", "l_quantity AS length", "l_tax * 100 AS fmt")


def long_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    return li.selectExpr("l_orderkey AS row_id", "l_orderkey div 4 AS uid", f"CAST({NUMBERED} AS BIGINT) AS t", *[f"{e} AS {k}" for k, e in TOKEN.items()])


def trajectories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The wide form: a row for each order, an array for each column of TOKEN."""
    li = table(spark, sf_dir, "lineitem")
    each = F.struct(*ORDER, *[F.expr(e).alias(k) for k, e in TOKEN.items()])
    rows = li.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(each)).alias("tok"))
    return rows.select(F.col("l_orderkey").alias("row_id"), F.expr("l_orderkey div 4").alias("uid"), *[F.col(f"tok.{k}").alias(k) for k in TOKEN])


def spread(df: DataFrame, *cols: str) -> DataFrame:
    """row_id, t and token columns, a row for each token, rounded."""
    each = F.posexplode(F.arrays_zip(*[F.col(c) for c in cols])).alias("p", "x")
    rows = df.select("row_id", each)
    return rows.select("row_id", (F.col("p") + 1).cast("long").alias("t"), *[r(F.col(f"x.{c}")).alias(c) for c in cols])
