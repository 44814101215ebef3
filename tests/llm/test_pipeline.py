"""The pipeline's stages against brute force on a small corpus."""

from __future__ import annotations

import pytest

import corpus_pipeline as CP
from tests.llm.test_llm_operators import SCHEMA, WORD, brute_components, brute_spans, corpus


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tables"))
    rows = [(i, t, "en" if t else None, s, n) for i, t, _, s, n in corpus()] + [(500, "reach me at a.b@example.com please, any time you like", "en", "a", 1)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{path}/documents.parquet")
    return path, rows


def test_stages(spark, folder):
    path, rows = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    names = [n for n, _ in CP.STAGES]
    assert names == ["language", "near_duplicates", "personal_data", "mixing", "token_ids"] and CP.ORACLE_SQL is None
    stages = dict(CP.STAGES)
    kept = stages["language"](spark, docs, path)
    left = {r["doc_id"]: r["text"] for r in kept.collect()}
    assert kept.columns == docs.columns and set(left) == {i for i, t, *_ in rows if any(c.isalpha() for c in t or "")}
    single = stages["near_duplicates"](spark, docs, path)
    assert single.columns == docs.columns and {r["doc_id"] for r in single.collect()} == {i for i, (_, c) in brute_components(rows).items() if i == c}
    clean = {r["doc_id"]: r["text"] for r in stages["personal_data"](spark, docs, path).collect()}
    assert len(clean) == len(rows) and "[EMAIL]" in clean[500] and not any(brute_spans(t or "") for t in clean.values())
    assert all(clean[i] == t for i, t, *_ in rows if not brute_spans(t or ""))
    mixed = stages["mixing"](spark, docs, path)
    assert mixed.columns == docs.columns
    words, total = (sum(len(WORD.findall(t or "")) for t in x) for x in ([r["text"] for r in mixed.collect()], [r[1] for r in rows]))
    assert 0.9 * total <= words <= 1.05 * total
    assert stages["token_ids"](spark, docs, path).count() == len(rows)


def test_run(spark, folder):
    path, _ = folder
    out = CP.run(spark, path)
    assert out.columns == ["doc_id", "n_tokens", "ids", "decoded_sha256"] and out.count() > 0
    assert out.where("size(ids) != n_tokens").count() == 0
