"""The divergence audit against exact counts in Python, and against its SQL."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

from brindle.llm import divergence as DV

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def brute(rows, least=30, top=50):
    """rows: (text, lang, source)."""
    groups, docs, counts = defaultdict(set), defaultdict(Counter), defaultdict(Counter)
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        terms = TERM.findall((text or "").translate(LOWER))
        groups[lang].add(source)
        docs[lang].update(set(terms))
        counts[lang, source].update(terms)
    out = []
    for lang, sources in groups.items():
        kept = [t for t, n in docs[lang].items() if n >= least]
        v = len(kept)

        def share(count, kept=kept, v=v):
            total = sum(count[t] for t in kept) + 5 * v
            return {t: 1 + 10**9 * (count[t] + 5) // total for t in kept}

        p = {s: share(counts[lang, s]) for s in sources}
        q = share(sum((counts[lang, s] for s in sources), Counter()))
        for s in sources:
            pairs = [(-sum(abs(p[s][t] - p[o][t]) for t in kept), o) for o in sources if o != s]
            terms = [(q[t] - p[s][t], t) for t in kept if counts[lang, s][t] and p[s][t] > q[t]]
            for part, found, most in (("pair", pairs, len(pairs)), ("term", terms, top)):
                found.sort(key=lambda x: (x[0], x[1].encode()))
                out += [(lang, s, part, item, -value, k) for k, (value, item) in enumerate(found[:most], 1)]
    return sorted(out)


def corpus():
    rng = random.Random(5)
    words = [f"{a}{b}" for a in ["the", "The", "straße", "Ünder", "x", "éa", "日本", "ab", "abc", "ABCD"] for b in ["", "n", "ne", "ß", "zz", "q"]]
    rows = []
    for i in range(900):
        lang = rng.choice(["en", "en", "de", None, "rare", ""])
        source = rng.choice(["a", "b", None, "ä", "Z"]) if lang != "rare" else rng.choice(["a", "b"])
        some = rng.choices(words, weights=[1 + (k % 7) * (1 + (k + len(source or "")) % 5) for k in range(len(words))], k=rng.randint(0, 40 if lang != "rare" else 0))
        rows.append((i, rng.choice([" ", "-", "1", "\n", "_"]).join(some), lang, source, 0))
    rows += [(1, None, "en", "none", None), (1, "!!! 123", "empty", "only", 0), (None, "the the", "one", "x", 0), rows[3], rows[3]]
    # A text of several slices, and many sources of one language.
    rows += [(5000, "The longword " * 120_000, "de", "Z", 0)]
    rows += [(6000 + i, " ".join(rng.choices(words[:20], k=30)), "many", f"s{i % 37}", 0) for i in range(300)]
    return rows


@pytest.fixture(scope="module")
def rows():
    return corpus()


def test_audit_by_exact_counts(spark, rows):
    docs = spark.createDataFrame(rows, SCHEMA).repartition(5)
    want = brute([r[1:4] for r in rows])
    assert {r[2] for r in want} == {"pair", "term"} and any(r[:2] == ("en", "none") for r in want)
    got = sorted(tuple(r) for r in DV.audit(docs).select("lang", "source", "part", "item", "value", "rank").collect())
    assert got == want
    # Small bounds of what tasks hold: the same rows.
    got = sorted(tuple(r) for r in DV.audit(docs, held=50, block=8).select("lang", "source", "part", "item", "value", "rank").collect())
    assert got == want


def test_audit_by_sql(spark, rows):
    con = duckdb.connect()
    con.sql("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, lang VARCHAR, source VARCHAR, n_chars BIGINT)")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?, ?, ?)", rows)
    assert sorted(con.sql(DV.divergence_sql()).fetchall()) == brute([r[1:4] for r in rows])


def test_audit_of_no_rows_and_clashing_columns(spark, rows):
    assert DV.audit(spark.createDataFrame([], SCHEMA)).count() == 0
    names = "doc_id long, text string, lang string, source string, term string, docs long, part int, i int, total long"
    some = [(r[0], r[1], r[2], r[3], "t", 1, 2, 3, 4) for r in rows[:300]]
    got = sorted(tuple(r) for r in DV.audit(spark.createDataFrame(some, names), least=5, top=3).collect())
    assert got == brute([r[1:4] for r in rows[:300]], least=5, top=3)


def test_tries_merge_and_walk_in_byte_order():
    rng = random.Random(2)
    words = ["a", "ab", "abc", "ä", "äb", "日本", "Ab", "zz"] + ["".join(rng.choices("abäß日", k=rng.randint(1, 6))) for _ in range(200)]
    one, two, rows = DV.Tries(), DV.Tries(), []
    for k in range(60):
        some = [(" ".join(rng.choices(words, k=rng.randint(0, 30))), rng.choice(["x", "y", ""]), rng.choice("pqr")) for _ in range(3)]
        rows += some
        (one if k % 2 else two).add([t.encode() for t, _, _ in some], [x for _, x, _ in some], [s for _, _, s in some])
    one.merge(two)
    found = [r for batch in one.leaves() for r in batch.to_pylist()]
    docs, counts = defaultdict(int), defaultdict(Counter)
    for text, lang, source in rows:
        terms = TERM.findall(text.translate(LOWER))
        for t in set(terms):
            docs[lang, t] += 1
        for t in terms:
            counts[lang, t][source] += 1
    assert {(r["lang"], r["term"]): r["docs"] for r in found} == docs
    assert {(r["lang"], r["term"]): dict(zip(r["sources"], r["counts"])) for r in found} == counts
    for lang in "xy":
        terms = [r["term"].encode() for r in found if r["lang"] == lang]
        assert terms == sorted(terms)


def test_shares_are_exact():
    rng = random.Random(1)
    for most in (10, 10**6, 1 << 52, 1 << 53, 1 << 61):
        totals = [rng.randint(5, most) for _ in range(40)] + [most]
        counts = [rng.randint(0, t - 5) for t in totals[:-1]] + [most - 5]
        got = DV.shares(np.array(counts), np.array(totals))
        assert got.tolist() == [1 + 10**9 * (c + 5) // t for c, t in zip(counts, totals)]
