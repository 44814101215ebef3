"""Differencing of tables that don't meet on the driver."""

from __future__ import annotations

import pytest

from brindle.operators import balance as K


@pytest.mark.parametrize("equal_size", [False, True])
def test_blocks(spark, monkeypatch, equal_size):
    """Whole, even parts without the pairs on the driver; the same again in a second run."""

    def never(*_):
        raise AssertionError("pairs met on the driver")

    monkeypatch.setattr(K, "collect_loads", never)
    monkeypatch.setattr(K, "BLOCK", 500)
    n = 4004 if equal_size else 4003
    df = spark.range(n).selectExpr("id", "CAST(pow(id * 7919 % 1009, 2) AS LONG) + 1 AS load").repartition(5)
    found = [K.assign(df, "id", "load", 4, equal_size).toPandas().sort_values("id") for _ in range(2)]
    assert found[0]["id"].tolist() == list(range(n))
    assert found[0]["part"].tolist() == found[1]["part"].tolist()
    g = found[0].groupby("part")["load"].agg(["sum", "count"])
    assert len(g) == 4 and g["sum"].max() < 1.001 * g["sum"].min()
    assert not equal_size or set(g["count"]) == {n // 4}


def test_large_items_and_few(spark):
    """A block's spread is at most its largest item; too few or uneven items raise."""
    df = spark.range(3000).selectExpr("id", "CASE WHEN id % 500 = 0 THEN 100000 ELSE id % 7 END AS load")
    g = df.join(K.in_blocks(df, "id", "load", 3, 3000, block=300), "id").groupBy("part").agg({"load": "sum"}).toPandas()
    assert g["sum(load)"].max() - g["sum(load)"].min() <= 100000
    with pytest.raises(ValueError):
        K.in_blocks(df, "id", "load", 7, 3000, equal_size=True)
