"""Ranges of doc_id and Merkle roots over runs of documents."""

from __future__ import annotations

import bisect
import hashlib
import random

import pytest
from pyspark.sql import functions as F

from brindle.llm import tokens as TK
from brindle.llm.common import stage_path
from tests.llm.test_llm_operators import SCHEMA, prose


@pytest.mark.parametrize("n", [0, 1, 2, 3, 9, 10, 100, 1000])
def test_places_among_bounds(spark, n):
    rng = random.Random(n)
    bounds = sorted(rng.sample(range(-(10**12), 10**12), n))
    values = [rng.randrange(-(10**12), 10**12) for _ in range(50)] + bounds[:20] + [b + 1 for b in bounds[-20:]]
    df = spark.createDataFrame([(v,) for v in values], "v long")
    got = [r[0] for r in df.select(TK.place_of(F.col("v"), bounds)).collect()]
    assert got == [bisect.bisect_left(bounds, v) for v in values]


def test_roots_over_runs(spark, monkeypatch):
    monkeypatch.setattr(TK, "RUN_DOCS", 3)
    rows = [(p, i if i % 4 else None, i * 7, 7, hashlib.blake2b(f"{p}-{i}".encode(), digest_size=16).digest(), i) for p, n in ((0, 10), (1, 1), (2, 3)) for i in range(n)]
    recipes = spark.createDataFrame(rows, "part int, doc_id long, start long, n_tokens long, root binary, place long").repartition(4)
    got = {r["part"]: r for r in TK.manifest(recipes).collect()}
    for p in range(3):
        roots = [r[4] for r in rows if r[0] == p]
        runs = [TK.merkle(roots[a : a + 3]) for a in range(0, len(roots), 3)]
        assert bytes(got[p]["root"]) == TK.merkle(runs) and got[p]["n_docs"] == len(roots) and got[p]["n_tokens"] == 7 * len(roots)
    assert (got[0]["first_doc"], got[0]["last_doc"], got[1]["first_doc"]) == (1, 9, None)


def test_store_of_several_ranges(spark, monkeypatch):
    rng = random.Random(6)
    rows = [(None if i % 9 == 0 else i * 3, prose(rng, rng.randint(0, 20)), "en", "s", 0) for i in range(200)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    plain = TK.id_ranges
    monkeypatch.setattr(TK, "id_ranges", lambda rows: plain(rows, per_range=20))
    path = TK.write_store(docs, stage_path(spark, "store"))
    manifest = spark.read.parquet(f"{path}/manifest").collect()
    assert len(manifest) > 5 and sum(r["n_docs"] for r in manifest) == 200
    digests = TK.read_digests(spark, path).collect()
    assert len(digests) == 200 and all(r["verified"] for r in digests)
    ordered = sorted(digests, key=lambda r: r["start"])
    assert [r["doc_id"] for r in ordered if r["doc_id"] is not None] == sorted(r[0] for r in rows if r[0] is not None)
    at = 0
    for r in ordered:
        assert r["start"] == at
        at += r["n_tokens"]
    assert all(r["doc_id"] is None for r in ordered[-23:])
