"""Min-max near duplicates against all pairs of sets."""

from __future__ import annotations

import random
import re

import numpy as np
import pytest

from brindle.llm import jaccard as J
from brindle.llm import minmax as MM
from brindle.llm.jaccard import gram_sets
from tests.llm.test_llm_operators import SCHEMA, corpus, prose

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text, words=2):
    w = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if len(w) < words:
        return {tuple(w)} if w else set()
    return {tuple(w[i : i + words]) for i in range(len(w) - words + 1)}


def brute(rows):
    """(doc_id, n, component, kept) of each row, by all pairs that share a shingle."""
    sets = [shingles(r[1]) for r in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    holders = {}
    for i, s in enumerate(sets):
        for x in s:
            holders.setdefault(x, []).append(i)
    for i, s in enumerate(sets):
        for j in {j for x in s for j in holders[x] if j < i}:
            common = len(s & sets[j])
            if 100 * common >= 80 * (len(s) + len(sets[j]) - common):
                parent[max(root(i), root(j))] = min(root(i), root(j))
    out = []
    for i, r in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if root(j) == root(i) and rows[j][0] is not None]
        least = min(ids) if sets[i] and ids else r[0]
        out.append((r[0], len(sets[i]), least, r[0] == least))
    return sorted(out, key=repr)


def got(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_shingles", "component_id", "kept").collect()), key=repr)


def near(rng, words, k, tag):
    w = list(words)
    for _ in range(k):
        w[rng.randrange(len(w))] = f"{tag}{rng.randrange(10**6)}"
    return " ".join(w)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(9)
    made = [r[1] for r in corpus()]
    # Groups of near copies on both sides of the threshold, and a chain.
    for n in (3, 5, 9, 40, 200):
        base = prose(rng, n).split()
        made += [near(rng, base, k, "e") for k in range(max(2, n // 6)) for _ in range(3)]
    chain = prose(rng, 60).split()
    for k in range(12):
        chain[rng.randrange(60)] = f"c{k}"
        made.append(" ".join(chain))
    ids = list(range(len(made)))
    rng.shuffle(ids)
    out = [(i, t, "en", "s", 0) for i, t in zip(ids, made)]
    return out + [out[12], out[12], (None, "only without id", None, None, None), (None, "only without id", None, None, None), (None, out[20][1], None, None, None)]


def test_groups_by_all_pairs(spark, rows):
    docs = spark.createDataFrame(rows, SCHEMA).repartition(5)
    want = brute(rows)
    assert sum(r[0] != r[2] for r in want) > 50
    assert got(MM.near_duplicates(docs)) == want
    # Small blocks meet in many tasks.
    assert got(MM.near_duplicates(docs, block=3)) == want


def test_given_documents_by_all_pairs(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()]
    assert got(MM.op13_minmax(spark, "/root/testdata/sf0.01")) == brute(rows)


def test_every_link_of_many_pairs_is_found():
    """Of 4000 pairs at the threshold, none misses all bands; six permutations a band."""
    rng = np.random.default_rng(4)
    sets = []
    for _ in range(4000):
        n = int(rng.integers(1, 12))
        both = rng.integers(0, 1 << 63, 10 * n).astype(np.uint64)
        sets += [np.unique(both[: 9 * n]), np.unique(np.concatenate([both[: 8 * n], both[9 * n :]]))]
    for part in range(0, len(sets), 2000):
        some = sets[part : part + 2000]
        lanes = MM.bands(*MM.signatures(some, MM.ROWS * MM.GROUPS, key=5))
        assert (lanes[0::2] == lanes[1::2]).any(axis=1).all()


def test_estimates_are_unbiased_and_vary_less_than_minima_alone():
    rng = np.random.default_rng(6)
    common, left, right = rng.integers(0, 1 << 63, 16), rng.integers(0, 1 << 63, 4), rng.integers(0, 1 << 63, 4)
    one, other = (np.unique(np.concatenate([common, x])).astype(np.uint64) for x in (left, right))
    both, minima = [], []
    for key in range(300):
        low, high = MM.signatures([one, other], 32, key=key)
        both.append(float(MM.estimated((low[:1], high[:1]), (low[1:], high[1:]))[0]))
        low, _ = MM.signatures([one, other], 64, key=1000 + key)
        minima.append(float((low[0] == low[1]).mean()))
    assert abs(np.mean(both) - 16 / 24) < 0.015
    assert np.var(both) < np.var(minima)


def test_no_rows_clashing_columns_and_hot_groups(spark):
    assert MM.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0
    rng = random.Random(1)
    base = prose(rng, 80).split()
    rows = [(i, near(rng, base, i % 4, "h"), i, "x", 1, 2) for i in range(400)] + [(1000 + i, "the same text again", 1, "y", 3, 4) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, key long, hub string, n long, lanes long").repartition(9)
    assert got(MM.near_duplicates(docs)) == brute(rows)


def test_distance_of_sketches():
    rng = np.random.default_rng(3)
    rows = rng.integers(-(1 << 63), (1 << 63) - 1, (40, 8))
    want = [sum(bin((int(a) ^ int(b)) & (1 << 64) - 1).count("1") for a, b in zip(r, rows[0])) for r in rows]
    assert J._apart(rows[0], rows).tolist() == want and any(int(a) ^ int(rows[0][0]) < 0 for a in rows[:, 0])


def test_sets_are_those_of_the_contract():
    texts = ["A b A B", "One", "", " \t", "x  y\nz", "É é"]
    assert [len(s) for s in gram_sets([t.encode() for t in texts], 2)] == [len(shingles(t)) for t in texts] == [2, 1, 0, 0, 2, 1]
