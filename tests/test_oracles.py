"""Every query with an SQL twin gives the same rows in DuckDB, on two sizes of the tables."""

from __future__ import annotations

import functools
import os

import duckdb
import pandas as pd
import pytest

from brindle.plans import catalog

SIZES = ["/root/testdata/sf0.001", "/root/testdata/sf0.01"]
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@functools.cache
def duck(sf: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    return con


def rows(df: pd.DataFrame) -> list[str]:
    df = df[sorted(df.columns)].astype(object)
    return sorted(map(repr, df.where(df.notna(), None).itertuples(index=False, name=None)))


@pytest.mark.skipif(not os.path.isdir(SIZES[0]), reason="needs the driver's tables")
@pytest.mark.parametrize("sf", SIZES)
@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_oracle(spark, name, sf):
    ours = catalog.QUERIES[name](spark, sf).toPandas()
    theirs = duck(sf).execute(catalog.ORACLES[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert rows(ours) == rows(theirs)


def test_entry_and_names(spark):
    import __spark_entry__

    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert __spark_entry__.entry(spark).limit(1).count() == 1
