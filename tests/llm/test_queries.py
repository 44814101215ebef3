"""Every registered query on a small folder of tables, against brute force on all its rows."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from brindle.llm import fingerprint as FP
from brindle.llm import language as LG
from brindle.llm import license as LI
from brindle.llm import quality as QL
from brindle.llm import repetition as RP
from brindle.llm.common import vocabulary_path
from brindle.llm.queries import QUERIES
from tests.llm.test_llm_operators import PII_TEXTS, SCHEMA, WORD, brute_components, brute_figures, brute_spans, corpus, fill, prose


def table_rows():
    rng = random.Random(41)
    rows = corpus()
    n = len(rows)
    rows += [(n + i, t, "en", "d", 0) for i, t in enumerate(PII_TEXTS)]
    # A text of a megabyte, an exact copy under another id, and languages to learn.
    long = prose(rng, 90000) + " a.b@example.org"
    rows += [(1000, long, "en", "a", 0), (1001, rows[11][1], "de", "b", 0)]
    kinds = {"aa": "the of and ing tion her".split(), "bb": "der und ich sch ver ung".split()}
    rows += [(2000 + i, " ".join("".join(rng.choices(kinds[k], k=2)) for _ in range(rng.randint(3, 40))), k, "b", 0) for i in range(300) for k in [("aa", "bb")[i % 2]]]
    return rows


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path, rows = str(tmp_path_factory.mktemp("all")), table_rows()
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    docs.write.parquet(f"{path}/documents.parquet")
    labels = [(i, int("***" not in (t or "") and len(t or "") > 60), 0) for i, t, *_ in rows if i % 3]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path, rows, labels


def run(spark, folder, name):
    out = [r.asDict() for r in QUERIES[name](spark, folder[0]).collect()]
    assert len(out) == len(folder[1])
    return {r["doc_id"]: r for r in out}


def held_out(i):
    return zlib.crc32(str(i).encode()) % 4 == 2


def test_op1(spark, folder):
    got = run(spark, folder, "op1_mixing")
    sizes, taken = defaultdict(int), defaultdict(int)
    for i, text, _, source, _ in folder[1]:
        r = got[i]
        assert r["size"] == len(WORD.findall(text or "")) and r["taken"] <= 3 * r["size"] and r["taken"] == r["size"] * len(r["shards"])
        sizes[source] += r["size"]
        taken[source] += r["taken"]
    want = fill(dict(sizes))
    assert all(r["source_size"] == sizes[s] and r["target"] == pytest.approx(want[s]) for i, _, _, s, _ in folder[1] for r in [got[i]])
    # The tree splits: copies go to many shards.
    assert len({x for r in got.values() for x in r["shards"]}) > 4
    again = run(spark, folder, "op1_mixing")
    assert again == got


def test_op2(spark, folder):
    lib, got, start = Tokenizer.from_file(vocabulary_path("byte_bpe_50k.json")), run(spark, folder, "op2_tokens"), 0
    for i, text, *_ in folder[1]:
        ids = [*lib.encode(text or "", add_special_tokens=False).ids, 2]
        r = got[i]
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def test_op3(spark, folder):
    got = run(spark, folder, "op3_jaccard")
    assert {i: (r["n_shingles"], r["component_id"]) for i, r in got.items()} == brute_components(folder[1])


def test_op4(spark, folder):
    """The whole fit again in one process, with isotonic regression by its min-max formula."""
    _, rows, labels = folder
    got = run(spark, folder, "op4_quality")
    stats = {i: QL.statistics([(t or "").encode()])[0] for i, t, *_ in rows}
    x = np.array([stats[i] for i, *_ in labels if not held_out(i)])
    y = np.array([q for i, q, _ in labels if not held_out(i)], dtype=float)
    rng, k = np.random.default_rng(4), len(QL.STATISTICS)
    scale = x.std(axis=0)
    model = QL.Model(x.mean(axis=0), np.where(scale > 1e-9, scale, 1.0), rng.normal(0, 1 / QL.WIDTH, (k, QL.FEATURES)), rng.uniform(0, 2 * np.pi, QL.FEATURES))
    z = model.features(x)
    model.weights = np.linalg.solve(z.T @ z + QL.RIDGE * np.sqrt(len(x)) * np.eye(z.shape[1]), z.T @ y)
    edges = np.linspace(-0.5, 1.5, QL.BINS + 1)
    at = np.clip(np.digitize(model.raw(x), edges) - 1, 0, QL.BINS - 1)
    used = np.unique(at)
    w = np.array([np.sum(at == b) for b in used], dtype=float)
    m = np.array([y[at == b].mean() for b in used])
    mean = lambda i, j: (m[i : j + 1] * w[i : j + 1]).sum() / w[i : j + 1].sum()
    values = [max(min(mean(i, j) for j in range(b, len(m))) for i in range(b + 1)) for b in range(len(m))]
    for i, r in got.items():
        raw = model.raw(stats[i][None, :])[0]
        assert r["held_out"] == held_out(i) and r["predicted"] == int(r["score"] >= 0.7)
        assert r["score"] == pytest.approx(np.clip(np.interp(raw, ((edges[:-1] + edges[1:]) / 2)[used], values), 0, 1), abs=2e-3)


def brute_fingerprint(text):
    """Rarity, selection and filters written out window by window."""
    data, w = text.encode(), FP.WINDOW
    h = []
    if len(data) >= w:
        rank = FP.rarity(FP.entropies(np.frombuffer(data, np.uint8))).tolist()
        size = min(FP.RUN, len(rank))
        wins = [0] * len(rank)
        for i in range(len(rank) - size + 1):
            best = min(range(i, i + size), key=lambda j: (rank[j], j))
            if rank[best] < 2000:
                wins[best] += 1
        for i, n in enumerate(wins):
            if n >= min(FP.POINTS, len(rank) - size + 1):
                v = int(FP.window_hashes(np.frombuffer(data, np.uint8), np.array([i]))[0])
                h += [v] if v not in h else []
    if not h and data:
        h = [int.from_bytes(hashlib.blake2b(data, digest_size=8).digest(), "little")]
    filters = [set() for _ in range(max(1, -(-len(h) // FP.FULL)))]
    for i, v in enumerate(h):
        filters[i // FP.FULL] |= {(v >> 11 * k) % FP.BITS for k in range(FP.HASHES)}
    return filters


def brute_likeness(a, b):
    if a == b:
        return 1.0
    if len(a) > len(b):
        a, b = b, a
    if min(sum(map(len, a)), sum(map(len, b))) <= FP.HASHES:
        return 0.0
    score = 0.0
    for x in a:
        best = 0.0
        for y in b:
            chance, most = len(x) * len(y) / FP.BITS, min(len(x), len(y))
            best = max(best, (len(x & y) - chance) / max(most - chance, 1e-9) if most > chance else 0.0)
        score += best * len(x)
    return min(1.0, score / sum(map(len, a)))


def test_op5(spark, folder):
    got = run(spark, folder, "op5_fingerprint")
    rows = sorted(folder[1], key=lambda r: -r[0])
    bits = lambda f: [set(np.flatnonzero(np.unpackbits(x.view(np.uint8))).tolist()) for x in FP.parse(f)]
    for x, (i, text, *_) in enumerate(rows):
        text, follow, r = text or "", rows[(x + 1) % len(rows)][1] or "", got[i]
        half = len(text) // 2
        changed = text[: len(text) - half] + follow[:half]
        assert (r["n_chars"], r["edited_sha256"]) == (len(text), hashlib.sha256(changed.encode()).hexdigest())
        if len(text) + len(follow) > 20000:
            continue
        a, b, c = brute_fingerprint(text), brute_fingerprint(changed), brute_fingerprint(follow)
        assert bits(r["fingerprint"]) == a and bits(r["edited_fingerprint"]) == b
        assert r["near_edited"] == pytest.approx(brute_likeness(a, b)) and r["near_next"] == pytest.approx(brute_likeness(a, c))


def test_op6(spark, folder):
    got = run(spark, folder, "op6_pii")
    for i, text, *_ in folder[1]:
        want, r = brute_spans(text or ""), got[i]
        joined = ",".join(f"{k}:{a}:{e}" for a, _, e, k in want)
        assert [r[f"n_{k}"] for k in ("email", "ip", "card", "phone")] == [sum(x[3] == k for x in want) for k in ("email", "ip", "card", "phone")]
        assert r["base_sha256"] == hashlib.sha256(joined.encode()).hexdigest()
        spans = [x.split(":") for x in r["spans"].split(",")] if r["spans"] else []
        assert {tuple(x.split(":")) for x in joined.split(",") if x} <= set(map(tuple, spans))
        assert spans == sorted(spans, key=lambda s: int(s[1])) or len({s[1] for s in spans}) < len(spans)


def test_op7(spark, folder):
    got = run(spark, folder, "op7_repetition")
    for i, text, *_ in folder[1]:
        if len(text or "") > 20000:
            assert got[i]["n_words"] == len(WORD.findall(text)) and got[i]["word_chars"] == sum(map(len, WORD.findall(text)))
            continue
        want, r = brute_figures(text or "", RP.LEAST_REPEAT), got[i]
        assert {k: r[k] for k in want} == want
        failed = want["n_words"] < 20 or 100 * want["n_repeat_words"] > 30 * want["n_words"]
        good = want["covered_words"] <= RP.MOST_COVERED * want["n_words"] and want["longest_repeat"] <= max(RP.LONGEST_FREE, RP.MOST_LONGEST * want["n_words"]) and want["n_symbols"] <= RP.MOST_SYMBOLS * want["n_words"]
        assert (r["base_failed"], r["kept"]) == (failed, not failed and good)


def test_op8(spark, folder):
    """Each text's share of every piece times the trained table, written out."""
    got = run(spark, folder, "op8_language")
    docs = spark.read.parquet(f"{folder[0]}/documents.parquet")
    model = LG.train(*LG.sample(docs))
    for i, text, *_ in folder[1]:
        r = got[i]
        assert r["held_out"] == held_out(i)
        if not any(c.isalpha() for c in text or ""):
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)
            continue
        ids, share = LG.bag(text.encode())
        z = (sum((s * model.logits[k] for k, s in zip(ids, share)), np.zeros(len(model.languages))) + model.bias) / model.temperature
        p = np.exp(z - z.max()) / np.exp(z - z.max()).sum()
        assert r["lang_pred"] == model.languages[int(np.argmax(p))] and r["score"] == pytest.approx(p.max(), abs=1e-9)


def test_op9(spark, folder):
    lib, got = Tokenizer.from_file(vocabulary_path("word_bpe_49k.json")), run(spark, folder, "op9_bpe")
    for i, text, *_ in folder[1]:
        e = lib.encode(text or "", add_special_tokens=False)
        decoded = lib.decode(e.ids, skip_special_tokens=False)
        assert (got[i]["n_tokens"], got[i]["ids_sha256"], got[i]["decoded_sha256"]) == (len(e.ids), hashlib.sha256(np.array(e.ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest())


def test_op10(spark, folder):
    got = run(spark, folder, "op10_license")
    assert all(not r["licenses"] for r in got.values()) and re.search("select", LI.license_sql(), re.IGNORECASE)
