"""Clashing names, empty tables, null and repeated ids, ties, hot lanes and long texts."""

from __future__ import annotations

import random
import time
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as CP
from brindle.llm import fingerprint as FP
from brindle.llm import jaccard as J
from brindle.llm import language as LG
from brindle.llm import license as LI
from brindle.llm import mixing as MX
from brindle.llm import pii as P
from brindle.llm import quality as QL
from brindle.llm import repetition as RP
from brindle.llm import tokens as TK
from brindle.llm.bpe import encode_documents
from brindle.llm.common import stage_path
from tests.llm.test_llm_operators import SCHEMA, WORDS, brute_components, corpus, prose

CLASHES = "row key size u n lane bucket hub salt stats label part guest _text _c0 base more spans _spans _base _more _reach _open _stop _draw draws block target score sketch class grams hashes fresh root component _id text_ Text2".split()


@pytest.fixture(scope="module")
def odd(spark):
    """Null and repeated doc_ids, repeated rows, ties, and columns of the operators' names."""
    rows = [(i if i % 4 else None, t, lang, s, n) for i, t, lang, s, n in corpus()[:40]]
    rows += rows[10:20]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    return docs.withColumns({c: F.lit(f"own {c}") for c in CLASHES}), rows


def test_rows_stay_with_clashing_names(spark, odd):
    docs, rows = odd
    ids = Counter(r[0] for r in rows)
    model = LG.train([b"the of and", b"der und ich"] * 10, ["aa", "bb"] * 10)
    stats = QL.document_statistics(docs)
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, label int")
    for out in (
        MX.plan(docs), TK.read_digests(spark, TK.write_store(docs, stage_path(spark, "store"))), J.join_documents(docs), QL.score(stats, QL.fit(stats, labels)), FP.edited_fingerprints(docs),
        FP.fingerprints(docs), P.find(docs), RP.repetition_rules(docs), LG.identify(docs, model), encode_documents(docs), LI.scan(docs),
    ):
        assert Counter(r["doc_id"] for r in out.select("doc_id").collect()) == ids
    for out in (P.redact(docs), LG.keep_identified(docs, model), MX.mix(docs).drop("mix_shard", "mix_order", "mix_pass"), CP.near_duplicates(spark, docs, "")):
        assert out.columns == docs.columns
        got = out.collect()
        assert got and all(r[c] == f"own {c}" for r in got for c in CLASHES)


def test_equal_texts_have_equal_results(spark):
    rng = random.Random(51)
    text = prose(rng, 60)
    rows = [(i, text if i % 2 else prose(rng, rng.randint(0, 40)), "aa", "s", 0) for i in range(200)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(7)
    stats = QL.document_statistics(docs)
    model = LG.train(*LG.sample(docs))
    mine = F.col("doc_id") % 2 == 1
    for out, column in ((stats, "stats"), (FP.fingerprints(docs), "fingerprint"), (LG.identify(docs, model), "score"), (RP.repetition_rules(docs), "covered_words"), (encode_documents(docs), "ids")):
        assert out.where(mine).select(column).distinct().count() == 1


def test_empty_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    untaught = LG.train([], [])
    stats = QL.document_statistics(none)
    assert QL.score(stats, None).collect() == FP.edited_fingerprints(none).collect() == FP.fingerprints(none).collect() == P.find(none).collect() == []
    assert MX.plan(none).collect() == MX.mix(none).collect() == J.join_documents(none).collect() == encode_documents(none).collect() == LI.scan(none).collect() == LG.keep_identified(none, untaught).collect() == []


@pytest.mark.parametrize("rows", [[], [(1, "An English text without any label to learn from.", None, "a", 1), (2, None, None, None, 0), (3, "12", None, "a", 2)]])
def test_pipeline_without_labels(spark, tmp_path, rows):
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    assert [r["doc_id"] for r in CP.run(spark, str(tmp_path)).collect()] == [i for i, t, *_ in rows if any(c.isalpha() for c in t or "")]


def near_copies(rng, groups, copies, words=60):
    rows = []
    for _ in range(groups):
        base = prose(rng, words).split()
        for _ in range(copies):
            w = list(base)
            w[rng.randrange(len(w))] = "edit" + str(rng.random())
            rows.append((len(rows), " ".join(w), "en", "s", 0))
    return rows


def test_join_by_small_blocks_and_hot_lanes(spark):
    """Buckets of many blocks, lanes over several tasks, and texts that share a passage."""
    rng = random.Random(52)
    rows = near_copies(rng, 3, 40)
    passage = prose(rng, 60)
    rows += [(1000 + i, passage + " " + prose(rng, 14 + i % 9), "en", "s", 0) for i in range(60)]
    rows += [(2000 + i, " ".join(rng.choices(WORDS, k=rng.randint(1, 9))), "en", "s", 0) for i in range(60)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(5)
    want = brute_components(rows)
    for block, hot in ((4, 3), (512, 5)):
        assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in J.join_documents(docs, block, hot).collect()} == want


def test_join_of_a_large_group_of_near_copies(spark):
    """More near copies than members of a block."""
    rng = random.Random(53)
    rows = near_copies(rng, 1, 600, 40)
    docs = spark.createDataFrame(rows, SCHEMA).repartition(4)
    assert {r["doc_id"]: r["component_id"] for r in J.join_documents(docs).collect()} == {i: c for i, (_, c) in brute_components(rows).items()}


def test_lanes_of_sets_that_fall_into_the_same_parts():
    """N-grams whose upper halves agree leave few lanes; the n-grams themselves are shown."""
    rng = np.random.default_rng(54)
    for n in (40, 100, 300):
        a = np.unique(rng.integers(1, 1 << 31, n).astype(np.uint64))
        assert any(show > 0 and len(own) == len(a) for own, show in J.all_lanes(a)[-1:])
        b = np.unique(np.concatenate((a[: len(a) - len(a) // 9], rng.integers(1, 1 << 31, len(a) // 9).astype(np.uint64))))
        shown = [{x for own, show in J.all_lanes(s) for x in np.sort(own)[:show].tolist()} for s in (a, b)]
        assert shown[0] & shown[1]


def test_counters_meet_in_rounds(spark, monkeypatch):
    rows = near_copies(random.Random(55), 20, 2, 20)
    docs = spark.createDataFrame(rows, SCHEMA).repartition(9)
    whole = J.summaries(docs, 3).where("slot IS NOT NULL").select("part", "slot", "counts").cache()
    want = J.lane_counts(whole)
    monkeypatch.setattr(J, "FAN_IN", 2)
    assert want.sum() > 0 and (J.lane_counts(whole) == want).all()


def test_personal_data_in_proportion_to_spans(spark):
    took = {}
    for n in (100, 4000, 40000):  # the first compiles
        text = "x " + ", ".join(f"user{i}@example{i % 7}.com" for i in range(n))
        docs = spark.createDataFrame([(1, text, "en", "s", 0)], SCHEMA)
        begun = time.time()
        assert P.find(docs).select(F.size("spans")).first()[0] == n
        assert P.redact(docs).first()["text"] == "x " + ", ".join(["[EMAIL]"] * n)
        took[n] = time.time() - begun
    assert took[40000] < 12 * took[4000]


def test_redaction_of_overlaps_and_wide_characters(spark):
    text = "漢😀" * 600 + " a.b@example.com " + "é" * 1030 + "+4539148803436467 tail 1.2.3.4" + "😀"
    docs = spark.createDataFrame([(1, text, "en", "s", 0)], SCHEMA)
    out = P.redact(docs).first()["text"]
    assert out.startswith("漢😀" * 600 + " [EMAIL] " + "é" * 1030 + "+[CARD] tail [IP]") and out.endswith("[IP]😀") and "4539" not in out


def test_quality_of_short_texts_alone_and_together():
    one = QL.statistics([b"word"])
    both = QL.statistics([b"word", b"some more words in another text " * 5, b""])
    assert (one[0] == both[0]).all() and (QL.statistics([b""])[0] == both[2]).all()


def test_mixing_of_a_hot_row_and_many_sources(spark):
    """A third of the rows under one id, and more sources than blocks."""
    rng = random.Random(56)
    rows = [(7, "a b c d", "en", "hot", 0)] * 300 + [(i, prose(rng, 1 + i % 9), "en", f"s{i % 300}", 0) for i in range(600)]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = MX.plan(docs, n_shards=2).collect()
    assert len(got) == len(rows) and all(len(r["draws"]) <= 3 for r in got)
    cut = MX.plan(docs.where("source = 'hot'").withColumn("doc_id", F.monotonically_increasing_id()), weights={"hot": 1.0}).collect()
    assert sum(len(r["draws"]) for r in cut) == 300


def test_cut_ranges_narrow(spark, monkeypatch):
    """The place where a target is met, found by histograms, in blocks of many documents."""
    monkeypatch.setattr(MX, "CUT_DOCS", 8)
    rng = random.Random(57)
    rows = [(i, prose(rng, 1 + i % 5), "en", "ab"[i % 2], 0) for i in range(3000)]
    got = MX.plan(spark.createDataFrame(rows, SCHEMA), weights={"a": 1.0, "b": 2.0}, n_shards=1).collect()
    for source in "ab":
        taken = sum(r["size"] * len(r["draws"]) for r in got if r["source"] == source)
        target = next(r["target"] for r in got if r["source"] == source)
        assert abs(taken - target) <= 5
