"""The training sample of language ID on null and repeated doc_ids."""

from __future__ import annotations

from brindle.llm import language as LG
from tests.llm.test_llm_operators import SCHEMA


def test_sample_of_null_and_repeated_ids(spark):
    rows = [(None if i % 2 else i, f"text number {i}", "ab"[i % 3 == 0], "s", 1) for i in range(400)]
    rows += [(8, "the same text", "a", "s", 1)] * 3000 + [(None, f"null {i}", "b", "s", 1) for i in range(300)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    texts, labels = LG.sample(df, 200)
    assert len(texts) == len(labels) == len(set(texts)) == 200
    assert (texts, labels) == LG.sample(df.repartition(3), 200)
    every, _ = LG.sample(df, 5000)
    assert len(every) == len(set(every)) <= 701 and {f"null {i}".encode() for i in range(300)} <= set(every)
    assert LG.identify(df, LG.train(texts, labels)).count() == len(rows)
