"""Repeated rows, many sources and the order of shards in the mix."""

from __future__ import annotations

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from brindle.llm import mixing as MX
from tests.llm.test_llm_operators import SCHEMA, fill


def test_equal_rows_are_taken_one_by_one(spark):
    rows = [(None, "four words in it", "en", "a", 1)] * 2000 + [(i, "two words", "en", "b", 1) for i in range(2000)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(7)
    plan = MX.plan(docs, weights={"a": 1.0, "b": 1.0}).select("source", "size", "target", F.size("draws").alias("n")).collect()
    assert len(plan) == 4000
    taken, target = defaultdict(int), {}
    for r in plan:
        taken[r["source"]] += r["size"] * r["n"]
        target[r["source"]] = r["target"]
        assert r["n"] <= 3
    assert target == {"a": 6000.0, "b": 6000.0}
    assert abs(taken["a"] - 6000) <= 4 and abs(taken["b"] - 6000) <= 4
    mixed = MX.mix(docs, weights={"a": 1.0, "b": 1.0}).groupBy("source").count().collect()
    assert {r["source"]: r["count"] for r in mixed} == {"a": taken["a"] // 4, "b": taken["b"] // 2}


def test_told_apart_keeps_first_keys(spark):
    rows = spark.range(900).select((F.col("id") % 7).alias("u"), F.lit(3).alias("size"), F.col("id").alias("x")).repartition(5)
    got = MX.told_apart(rows).collect()
    assert sorted(r["x"] for r in got) == list(range(900)) and len({r["u"] for r in got}) == 900
    assert {r["u"] for r in got} >= set(range(7))


@pytest.mark.parametrize("seed", range(4))
def test_levels_of_many_sources(spark, seed):
    rng = random.Random(seed)
    sizes = {f"s{i:03}": int(rng.paretovariate(0.6) * 10) for i in range(400)} | {None: 10**6 if seed % 2 else 5, "s": 0}
    want = fill(sizes)
    got = MX.targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long").repartition(6)).collect()
    assert {r["source"]: r["target"] for r in got} == pytest.approx(want)


def test_shards_in_order(spark):
    rows = [(i, f"word{i} and more", "en", "ab"[i % 2], 1) for i in range(800)]
    mixed = MX.in_shard_order(MX.mix(spark.createDataFrame(rows, SCHEMA).repartition(3)))
    got = mixed.select(F.spark_partition_id().alias("p"), "mix_shard", "mix_order.block", "mix_order.place").collect()
    where = defaultdict(set)
    for r in got:
        where[r["mix_shard"], r["block"], (r["place"] >> 32) % MX.SLICES].add(r["p"])
    assert all(len(x) == 1 for x in where.values()) and len({r["mix_shard"] for r in got}) > 4
    last = {}
    for r in got:
        key = (r["mix_shard"], r["block"], (r["place"] >> 32) % MX.SLICES, r["place"])
        assert last.get(r["p"], key) <= key
        last[r["p"]] = key
