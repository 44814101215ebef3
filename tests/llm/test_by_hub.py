"""Buckets of a hub that hold much the same classes meet as one."""

from __future__ import annotations

import random

from brindle.llm import jaccard as J

SCHEMA = "bucket long, key long, hub long, lanes long, salted boolean"


def _pairs(rows) -> tuple[set[tuple[int, int]], int]:
    """Pairs of keys that share a bucket, and how often."""
    by: dict[int, list[int]] = {}
    for bucket, key in rows:
        by.setdefault(bucket, []).append(key)
    found = [(a, b) for keys in by.values() for a in keys for b in keys if a < b]
    return set(found), len(found)


def test_near_copies_meet_once(spark):
    """Forty lanes, each of all but a few of the same thirty classes."""
    draw = random.Random(3)
    rows = [(b, k, 0, 1, False) for b in range(40) for k in [0, *sorted(draw.sample(range(1, 30), 26))]]
    got = [(r["bucket"], r["key"]) for r in J.by_hub(spark.createDataFrame(rows, SCHEMA)).collect()]
    before, often = _pairs([r[:2] for r in rows])
    after, now = _pairs(got)
    assert before <= after and often > 13_000 and now == len(after)


def test_buckets_that_differ_and_salted_ones_stay(spark):
    """A hub's lanes of other classes each, and a salted lane, whose hub has more of them."""
    rows = [(b, k, 0, 1, False) for b in range(40) for k in [0, *range(1 + 10 * b, 11 + 10 * b)]]
    rows += [(100 + b, k, 7_000, 1, True) for b in range(2) for k in range(7_000, 7_010)]
    got = [(r["bucket"], r["key"]) for r in J.by_hub(spark.createDataFrame(rows, SCHEMA)).collect()]
    assert sorted(got) == sorted(r[:2] for r in rows)
