"""Stages on rows whose doc_id is repeated or null."""

from __future__ import annotations

import random
from collections import Counter

import corpus_pipeline as CP
from brindle.llm import mixing as MX
from tests.llm.test_llm_operators import SCHEMA, WORD, prose


def test_near_duplicates_by_row(spark):
    rng = random.Random(21)
    a, b, c, d, e, f, g = (prose(rng, 40) for _ in range(7))
    rows = [
        (1, a, "en", "s", 1), (1, a, "en", "s", 1), (1, a, "en", "t", 1),
        (None, b, "en", "s", 1), (None, b, "en", "s", 1), (None, b + " end", "en", "s", 1),
        (2, c, "en", "s", 1), (3, c, "en", "s", 1), (3, d, "en", "s", 1),
        (None, e, None, "x", 1), (9, e, "x", None, 1),
        (None, f, "en", "s", 1), (None, g, "en", "s", 1),
        (7, "", "en", "s", 0), (7, "", "en", "s", 0), (None, None, "en", "s", 0), (None, None, "en", "s", 0),
    ]
    out = CP.near_duplicates(spark, spark.createDataFrame(rows, SCHEMA).repartition(3), "")
    assert out.columns == [x.split()[0] for x in SCHEMA.split(", ")]
    got = Counter((r["doc_id"], r["text"]) for r in out.collect())
    b_kept = [t for (i, t) in got if i is None and (t or "").startswith(b)]
    assert len(b_kept) == 1
    assert got == Counter({(1, a): 1, (None, b_kept[0]): 1, (2, c): 1, (3, d): 1, (9, e): 1, (None, f): 1, (None, g): 1, (7, ""): 2, (None, None): 2})


def test_mix_gives_each_row_its_own_draws(spark):
    rng = random.Random(22)
    ids = [None, 5, 6]
    rows = [(ids[i % 3] if i % 4 else i, prose(rng, 1 + i % 17), None, f"s{i % 5}" if i % 5 else None, 0) for i in range(300)]
    rows += rows[:40]
    docs = spark.createDataFrame(rows, SCHEMA)
    words = lambda t: len(WORD.findall(t or ""))
    want, got = Counter(), Counter()
    for r in MX.plan(docs).collect():
        want[r["doc_id"], r["source"], r["size"]] += len(r["draws"])
    for r in MX.mix(docs).collect():
        got[r["doc_id"], r["source"], words(r["text"])] += 1
    assert got == +want
