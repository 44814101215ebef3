"""Scores of answers with large numbers, and of pairs that repeat."""

from __future__ import annotations

import time

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from brindle.functions import formula as FM
from brindle.functions import grading as G
from brindle.operators import rewards as R
from brindle.plans import reward_queries
from brindle.plans.catalog import ORACLES


def test_each_pair_once_and_spread(spark):
    """Repeated pairs are scored once, in several tasks though the rows are in one."""
    calls = spark.sparkContext.accumulator(0)

    @F.pandas_udf(DoubleType())
    def score(solution: pd.Series, truth: pd.Series) -> pd.Series:
        calls.add(len(solution))
        return pd.Series([G.verified(s, t) for s, t in zip(solution, truth)], dtype=float)

    rows = [(i, None if i % 7 == 0 else f"\\boxed{{{i % 7}}}", "3") for i in range(700)]
    df = spark.createDataFrame(rows, "id long, said string, truth string").coalesce(1)
    got = R.scored_once(df, "said", "truth", v=score).toPandas()
    assert calls.value == 7
    assert dict(zip(got["id"], got["v"])) == {i: float(i % 7 == 3) for i in range(700)}


def test_large_roots():
    """Roots of squares of large primes, and of products of two, have their exact values."""
    for p in (100_003, 999_983, 1_000_003):
        assert FM._factors(p * p) == {p: 2} and FM._factors(p) == {p: 1}
        assert G.verified(f"\\boxed{{\\sqrt{{{p * p}}}}}", str(p)) == 1
    assert FM._factors(2**5 * 999_983 * 1_000_003) == {2: 5, 999_983: 1, 1_000_003: 1}
    assert FM._factors(1009**3) == {1009: 3} and FM._factors(561 * 1105) == {3: 1, 11: 1, 17: 2, 5: 1, 13: 1}


def test_formulas_are_quick():
    """A thousand products of roots in a second or so, where each took 7 ms."""
    start = time.process_time()
    for n in range(2, 1002):
        assert G.verified(f"\\boxed{{\\sqrt{{{n}}}\\cdot\\sqrt{{7}}}}", f"\\sqrt{{{7 * n}}}") == 1
        assert G.olympiad(f"\\boxed{{\\sqrt{{{n}}}+\\sqrt{{7}}}}", f"\\sqrt{{{7 * n}}}") == 0
    assert time.process_time() - start < 5


def test_olympiad_query_with_large_numbers(spark, tmp_path):
    """Numbers beyond 10,000, where a neighbour is within the tolerance, and beyond 100,000."""
    rows = [(i, user) for i, user in enumerate(u + j for u in (9_990, 89_999, 100_000, 1_000_000, 40_000_000) for j in range(40))]
    spark.createDataFrame(rows, "event_id long, user_id long").write.parquet(f"{tmp_path}/events.parquet")
    got = reward_queries.score_olympiad(spark, str(tmp_path)).toPandas()
    assert dict(zip(got["event_id"], got["score"])) == {i: float(i % 8 < 5) for i, _ in rows}


def test_olympiad_query_with_any_key(spark, tmp_path):
    """Squares beyond a long, products of two large primes, and odd keys, against the SQL."""
    import duckdb

    users = [3_037_000_493, 600_000_000_000, 2_147_483_647 * 2_147_483_629 - 7, 2**63 - 1, -(2**63), -8, -7, 0, None]
    rows = [(i, user) for i, user in enumerate(u for u in users for _ in range(8))] + [(-i, i) for i in range(1, 17)] + [(None, 5)]
    spark.createDataFrame(rows, "event_id long, user_id long").write.parquet(f"{tmp_path}/events.parquet")
    got = reward_queries.score_olympiad(spark, str(tmp_path)).collect()
    con = duckdb.connect()
    con.sql(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    want = con.sql(ORACLES["score_olympiad"]).fetchall()
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
