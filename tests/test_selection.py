"""Exact places, quantiles and first rows against sorted lists, with ties and small bins."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from brindle.operators import selection as SE


def values(rng, n):
    kinds = [lambda: rng.choice([0.0, 1.0, 1.0, 2.5]), lambda: rng.lognormvariate(0, 30), lambda: float(rng.randrange(40)), lambda: -rng.random()]
    return [rng.choice(kinds)() for _ in range(n)]


@pytest.mark.parametrize("bin_rows", [7, 100, 1 << 16])
def test_places_of_groups(spark, bin_rows):
    rng = random.Random(4)
    rows = [(k, v) for k, n in (("a", 900), ("b", 3), (None, 400), ("hot", 1200)) for v in values(rng, n)]
    rows += [("flat", 5.0)] * 500 + [("a", None)] * 5 + [("none", None)] + [("nan", float("nan"))] * 20 + [("nan", 1.0)] * 30
    df = spark.createDataFrame(rows, "k string, v double").repartition(6)
    groups = {}
    for k, v in rows:
        if v is not None:
            groups.setdefault(k, []).append(v)
    asked = [(k, p) for k in {k for k, _ in rows} for p in (0, 1, 2, 49, 250, 399, 899, 1199, 5000)]
    got = SE.at_places(df, "v", spark.createDataFrame(asked, "k string, place long"), ["k"], bin_rows).collect()
    order = lambda v: (math.isnan(v), v)
    want = {(k, p): sorted(groups[k], key=order)[p] for k, p in asked if p < len(groups.get(k, []))}
    assert {(r["k"], r["place"]) for r in got} == set(want) and len(got) == len(want)
    assert all(r["value"] == want[r["k"], r["place"]] or math.isnan(r["value"]) and math.isnan(want[r["k"], r["place"]]) for r in got)


@pytest.mark.parametrize("bin_rows", [20, 1 << 16])
def test_quantiles_of_one_column(spark, bin_rows):
    x = values(random.Random(8), 3001)
    df = spark.createDataFrame([(v,) for v in x] + [(None,)], "v double").repartition(5)
    shares = [0.0, 0.5, 0.9, 0.95, 0.99, 1.0]
    got = {r["share"]: r["value"] for r in SE.quantiles(df, "v", shares, bin_rows=bin_rows).collect()}
    assert got == {q: pytest.approx(np.quantile(x, q), rel=1e-12) for q in shares}
    assert SE.quantiles(df.where("false"), "v", shares).count() == 0


@pytest.mark.parametrize("bin_rows", [5, 1 << 16])
def test_first_rows_with_ties(spark, bin_rows):
    rng = random.Random(3)
    rows = [(float(rng.randrange(6)), rng.randrange(20), i, "x") for i in range(700)] + [(None, 1, 1000, "y")]
    df = spark.createDataFrame(rows, "s double, a int, i long, text string").repartition(4)
    ranked = sorted((r for r in rows if r[0] is not None), key=lambda r: (-r[0], r[1], r[2]))
    for k in (0, 1, 2, 117, 350, 699, 700, 5000):
        got = SE.first_rows(df, [-F.col("s"), F.col("a"), F.col("i")], k, bin_rows)
        assert got.columns == df.columns and sorted(r["i"] for r in got.collect()) == sorted(r[2] for r in ranked[:k])


def test_first_rows_of_hashes_and_large_numbers(spark):
    df = spark.range(3000).withColumn("h", F.xxhash64("id")).withColumn("near", F.lit((1 << 62) + 5) + F.col("id") % 3)
    rows = df.collect()
    for order, key in (([F.col("h")], lambda r: r["h"]), ([F.col("near"), F.col("id")], lambda r: (r["near"], r["id"]))):
        got = {r["id"] for r in SE.first_rows(df, order, 1234, bin_rows=11).collect()}
        assert got == {r["id"] for r in sorted(rows, key=key)[:1234]}


def test_bootstrap_of_groups(spark):
    from brindle.operators import metrics as M

    rng = random.Random(2)
    rows = [(k, i, rng.random()) for k, n in (("a", 300), ("b", 5), (None, 40)) for i in range(n)]
    df = spark.createDataFrame(rows, "k string, i int, v double").repartition(4)
    for how, fn in (("max", np.max), ("min", np.min), ("avg", np.mean)):
        got = {r["k"]: (r["mean"], r["std"]) for r in M.bootstrap_by(df, ["k"], "i", "v", 6, how, 50).collect()}
        for key in ("a", "b", None):
            x = np.array([v for k, _, v in rows if k == key])
            assert got[key] == pytest.approx(M.bootstrap(x, 6, lambda a, fn=fn: fn(a, axis=1), 50))
