"""Periodic runs against a plain search of every start and period."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest

from brindle.llm import runs as RN

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def brute_runs(w, least=24, times=3):
    """Every maximal stretch, its smallest period by trial."""
    n, out = len(w), set()
    for q in range(1, n // times + 1):
        i = 0
        while i + q < n:
            if w[i] != w[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            length = j - i + q
            if length >= max(least, times * q):
                part = w[i : i + length]
                if not any(all(part[k] == part[k + d] for k in range(length - d)) for d in range(1, q)):
                    out.add((i, length, q))
            i = j
    return sorted(out, key=lambda r: (r[0], r[2]))


def altered(doc_id, text):
    w = WORD.findall(text or "")
    h = zlib.crc32(str(doc_id).encode())
    if doc_id is None or h % 10 or not w:
        return w
    g, n = h // 10, len(w)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]


def brute(doc_id, text):
    w = altered(doc_id, text)
    found = brute_runs(w)
    gone = {i for s, length, q in found for i in range(s + q, s + length)}
    best = min(found, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])) if found else (None, None, None)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return {
        "doc_id": doc_id, "n_words": len(w), "n_runs": len(found), "start": best[0], "length": best[1], "period": best[2],
        "exponent_milli": 1000 * best[1] // best[2] if found else None,
        "runs_sha256": sha("".join(f"{s},{length},{q}\n" for s, length, q in found)), "collapsed_sha256": sha(" ".join(w[i] for i in range(len(w)) if i not in gone)),
    }


def texts():
    rng = random.Random(7)
    words = ["ein", "Über", "x", "the", "Ω", "longer-word-than-sixteen-bytes"]
    out = [None, "", " \t\n", "one", "a " * 23, "a " * 24, "a " * 25, "a b " * 12 + "a", "\x0ba\x0c" * 40, "a b c d e f g h " * 3 + "a b"]
    out += ["x y z " * 10 + "q " + "x y z " * 10, ("a a a b " * 9 + "c ") * 4, "ab ab cd " * 30]
    for _ in range(120):
        unit = [rng.choice(words) for _ in range(rng.choice([1, 2, 3, 5, 8, 13, 30]))]
        parts = [rng.choice(words) for _ in range(rng.randint(0, 30))] + unit * rng.randint(1, 9) + unit[: rng.randint(0, len(unit))] + [rng.choice(words) for _ in range(rng.randint(0, 30))]
        out.append(rng.choice([" ", "\n", "  "]).join(parts))
    out += [" ".join(rng.choice("ab") for _ in range(rng.randint(20, 300))) for _ in range(60)]
    return out


@pytest.fixture(scope="module")
def rows():
    made = [(i, t, None, "s", 0) for i, t in enumerate(texts())]
    return made + [made[11], made[11], (None, "a b " * 30, "en", None, None), (None, None, None, None, None)]


def key(r):
    return tuple((v is None, v or 0) if not isinstance(v, str) else v for v in r.values())


def test_runs_of_all_texts_by_brute_force(spark, rows):
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    want = sorted((brute(r[0], r[1]) for r in rows), key=key)
    assert sum(r["n_runs"] > 0 for r in want) > 60
    got = [r.asDict() for r in RN.periodic_runs(RN.planted(docs)).collect()]
    assert sorted(got, key=key) == want
    # Small ranges of lags, so that almost all texts are dealt: the same rows.
    for lags, most in ((2, 64), (1, 5)):
        got = [r.asDict() for r in RN.periodic_runs(RN.planted(docs), lags=lags, ranges=most).collect()]
        assert sorted(got, key=key) == want


def test_runs_of_the_given_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    want = sorted((brute(r.doc_id, r.text) for r in docs.where("length(text) < 4000").collect()), key=key)
    got = {r.doc_id: r.asDict() for r in RN.op12_runs(spark, "/root/testdata/sf0.001").collect()}
    assert len(got) == docs.count() and [got[r["doc_id"]] for r in want] == want


def test_slices_of_a_larger_table(spark):
    """Several slices of a batch, with and without long texts."""
    sf = "/root/testdata/sf0.01"
    got = {r.doc_id: r.asDict() for r in RN.op12_runs(spark, sf).collect()}
    docs = RN.planted(spark.read.parquet(f"{sf}/documents.parquet"))
    dealt = {r.doc_id: r.asDict() for r in RN.periodic_runs(docs, lags=100).collect()}
    assert len(got) == 1000 and got == dealt
    some = spark.read.parquet(f"{sf}/documents.parquet").where("doc_id % 20 = 0 AND length(text) < 3000").collect()
    assert all(got[r.doc_id] == brute(r.doc_id, r.text) for r in some)


def test_long_texts_are_dealt_and_counted_alike(spark):
    rng = random.Random(3)
    unit = [f"w{rng.randrange(10**6)}" for _ in range(5003)]
    w = ["p"] * 31 + unit * 4 + unit[:17] + ["end"] + ["a"] * 60000 + [f"z{i}" for i in range(30)] * 900
    docs = spark.createDataFrame([(1, " ".join(w), 5)], "doc_id long, text string, row long")
    r = RN.periodic_runs(docs).first()
    want = [(0, 31, 1), (31, 4 * 5003 + 17, 5003), (32 + 4 * 5003 + 17, 60000, 1), (60032 + 4 * 5003 + 17, 27000, 30)]
    assert (r.n_runs, r.start, r.length, r.period) == (4, want[2][0], 60000, 1)
    assert r.runs_sha256 == hashlib.sha256("".join(f"{a},{b},{c}\n" for a, b, c in want).encode()).hexdigest()


def test_empty_table_and_bounds(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert RN.periodic_runs(RN.planted(empty)).count() == 0
    with pytest.raises(ValueError):
        RN.periodic_runs(empty, min_exp=2)


def test_exact_comparison_of_exponents():
    assert RN._greatest([(5, 3_000_000_001, 1_000_000_000), (0, 3, 1), (9, 3_000_000_001, 1_000_000_000)]) == (5, 3_000_000_001, 1_000_000_000)
    assert RN._greatest([]) is None
    assert RN._root(np.array([1, 2] * 18), 0, 12) == 2
