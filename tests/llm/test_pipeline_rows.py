"""near_duplicates keeps rows that differ, whatever their hashes."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as CP
from tests.llm.test_llm_operators import SCHEMA, prose

M = (1 << 64) - 1
P1, P2 = 0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F


def rotl(x, k):
    return ((x << k) | (x >> (64 - k))) & M


def colliding(seed):
    """Two texts of 64 ASCII characters that a hash of 64 bits in four lanes, with this
    seed, can't tell apart: the second word of a lane undoes what the first changes."""
    rng = random.Random(1)
    ascii8 = lambda: int.from_bytes(bytes(rng.randrange(97, 123) for _ in range(8)), "little")
    lane = lambda w: (rotl(((seed + P1 + P2) + w * P2) & M, 31) * P1) & M
    back = pow(P2, -1, 1 << 64)
    while True:
        w, v, second = ascii8(), ascii8(), ascii8()
        other = (second + (lane(w) - lane(v)) * back) & M
        raw = other.to_bytes(8, "little")
        if w != v and all(33 <= b < 127 for b in raw):
            rest = b"one two three four five six "[:24]
            text = lambda a, b: a.to_bytes(8, "little") + rest + b.to_bytes(8, "little") + rest
            return text(w, second).decode(), text(v, other).decode()


def test_rows_of_one_plain_hash_both_stay(spark):
    seed = spark.range(1).select(F.xxhash64(F.lit(None).cast("long"), F.lit(True)).alias("h")).first()["h"] & M
    a, b = colliding(seed)
    docs = spark.createDataFrame([(None, a, "en", "s", 64), (None, b, "en", "s", 64)], SCHEMA)
    plain = docs.select(F.xxhash64(*[x for c in docs.columns for x in (F.col(c), F.col(c).isNull())]).alias("h"))
    assert a != b and plain.distinct().count() == 1
    assert sorted(r["text"] for r in CP.near_duplicates(spark, docs, "").collect()) == sorted([a, b])


@pytest.mark.parametrize("bits", [0, 2])
def test_rows_are_compared_by_value_where_hashes_agree(spark, monkeypatch, bits):
    rng = random.Random(5)
    rows = [(i if i % 3 else None, prose(rng, 30), "en", "s", i) for i in range(40)]
    rows += rows[:10] * 3 + [(None, " ", "en", "s", 1)] * 4 + [(None, None, "en", "s", 1)] * 2
    docs = spark.createDataFrame(rows, SCHEMA).repartition(4)
    plain = CP.row_key
    monkeypatch.setattr(CP, "row_key", lambda docs, secret: F.pmod(plain(docs, secret), F.lit(1 << bits)))
    got = CP.near_duplicates(spark, docs, "").collect()
    assert sorted(r["n_chars"] for r in got if (r["text"] or "").strip()) == list(range(40))
