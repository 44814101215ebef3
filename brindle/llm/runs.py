"""Operator 12: periodic runs of words, by a scan over all lags.

A run is a stretch of consecutive words with smallest period q that no neighbouring word
extends, of at least ``least`` words and ``min_exp`` periods. The array of word numbers is
compared with itself shifted by each lag q up to n / min_exp; true stretches of the
comparison that are long enough are the runs of that lag. A stretch that counts has
m = max(least - q, (min_exp - 1) * q) words, so it covers PROBES neighbouring places of
every (m // PROBES)-th one: the comparison is made at those places first, for the texts of
a slice together, and of a text in which PROBES neighbours agree the whole comparison is
made and run-length coded. A stretch whose period is a proper part of the lag is the same
run at a smaller lag, and is left to it.

Work: all lags of n words take about n log n probes; a text whose probes all agree by
chance costs the n^2 / (2 min_exp) comparisons of the plain scan. A text of more than
min_exp * LAGS words is dealt over the machines by ranges of lags, each a row of its own,
at most RANGES of them; its runs meet again in one row. All other texts are done where
they are read: nothing of them shuffles.

Nulls and texts without words have no words and no runs. Rows of equal or null doc_id are
rows of their own. Other columns are not looked at. No rows give no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.llm.common import byte_list, hash_words, map_batches, slices, stage, table, word_count, word_ids

#: Words of a run at least, and times its period at least.
LEAST, MIN_EXP = 24, 3
#: Lags of a range, and ranges of a text at most (then of more lags).
LAGS, RANGES = 4096, 64
#: Neighbouring places that must agree before a text is compared with a lag in full.
PROBES = 4

SCHEMA = "doc_id long, n_words long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"


def _primes(q: int) -> list[int]:
    out, p = [], 2
    while p * p <= q:
        if q % p == 0:
            out.append(p)
            while q % p == 0:
                q //= p
        p += 1
    return [*out, q] if q > 1 else out


def _root(x: np.ndarray, start: int, q: int) -> int:
    """The smallest period of a stretch from ``start`` that has period q three times."""
    for p in _primes(q):
        while q % p == 0:
            d = q // p
            if not np.array_equal(x[start : start + q], x[start + d : start + q + d]):
                break
            q = d
    return q


def _stretches(x: np.ndarray, q: int, least: int) -> list[tuple[int, int]]:
    """(start, length) of the true stretches of x against x shifted by q."""
    same = np.zeros(len(x) - q + 2, dtype=np.int8)
    same[1:-1] = x[q:] == x[: len(x) - q]
    edge = np.flatnonzero(same[1:] != same[:-1])
    starts, ends = edge[0::2], edge[1::2]
    long = np.flatnonzero(ends - starts >= least)
    return list(zip(starts[long].tolist(), (ends - starts)[long].tolist()))


def find_runs(words: np.ndarray, firsts: np.ndarray, lo: np.ndarray, hi: np.ndarray, least: int = LEAST, min_exp: int = MIN_EXP) -> list[list[tuple[int, int, int]]]:
    """(start, length, period) of the runs of each text with lo <= period < hi. words: a
    number for each word; firsts: the first word of each text, and the end."""
    sizes = np.diff(firsts)
    most = np.minimum(hi - 1, sizes // min_exp)
    out: list[list[tuple[int, int, int]]] = [[] for _ in sizes]
    texts = np.flatnonzero((most >= lo) & (sizes >= least))
    if not len(texts):
        return out
    # Words of other texts never agree; texts of more lags come last, so that a lag
    # is compared in the end of the array only.
    texts = texts[np.argsort(most[texts], kind="stable")]
    n_texts = len(texts)
    rows = [words[firsts[t] : firsts[t + 1]].astype(np.int64) * n_texts + k for k, t in enumerate(texts.tolist())]
    x = np.concatenate(rows)
    begin = np.concatenate(([0], np.cumsum(sizes[texts])))
    tops = most[texts]
    known: list[dict[tuple[int, int, int], None]] = [{} for _ in rows]
    for q in range(int(lo[texts].min()), int(tops[-1]) + 1):
        m = max(least - q, (min_exp - 1) * q)
        step = max(1, m // PROBES)
        part = x[begin[np.searchsorted(tops, q)] :]
        if len(part) <= q:
            continue
        same = part[q::step] == part[: len(part) - q : step]
        count = len(same) - PROBES + 1
        if count <= 0 or m < PROBES:
            hits = np.flatnonzero(same) * step
        else:
            all_same = same[:count].copy()
            for k in range(1, PROBES):
                all_same &= same[k : k + count]
            hits = np.flatnonzero(all_same) * step
        if not len(hits):
            continue
        hits += len(x) - len(part)
        owner = np.searchsorted(begin, hits, side="right") - 1
        edge = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1], [True])))
        for a, b in zip(edge[:-1].tolist(), edge[1:].tolist()):
            k = int(owner[a])
            if not lo[texts[k]] <= q <= tops[k]:
                continue
            at = hits[a:b] - begin[k]
            for s, e, d in known[k]:
                # Places whose agreement a run of a part of the lag explains.
                if q % d == 0 and len(at):
                    at = at[(at < s) | (at >= e - q)]
            if not len(at):
                continue
            row = rows[k]
            for s, length in _stretches(row, q, m):
                root = _root(row, s, q)
                run = (s, s + length + q, root)
                if root == q:
                    out[texts[k]].append((s, length + q, q))
                known[k][run] = None
    return out


def _greatest(runs: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """The run of greatest length / period, compared exactly; ties: smallest start, period."""
    if not runs:
        return None
    all_runs = np.array(runs, dtype=np.int64)
    about = all_runs[:, 1] / all_runs[:, 2]
    near = [runs[i] for i in np.flatnonzero(about >= about.max() * (1 - 1e-9)).tolist()]
    return min(near, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]))


def collapsed(runs: list[tuple[int, int, int]], n: int) -> np.ndarray:
    """Which of n words stay: those in no run, or in the first period of all their runs."""
    edge = np.zeros(n + 1, dtype=np.int64)
    for s, length, q in runs:
        edge[s + q] += 1
        edge[s + length] -= 1
    return np.cumsum(edge[:-1]) == 0


def _figures(ids: pa.Array, found: list[list[tuple[int, int, int]]], firsts: np.ndarray, starts: np.ndarray, ends: np.ndarray, data: np.ndarray) -> pa.RecordBatch:
    raw = data.tobytes()
    cols: list[list] = [[] for _ in range(8)]
    for k, runs in enumerate(found):
        a, n = int(firsts[k]), int(firsts[k + 1] - firsts[k])
        runs = sorted(runs, key=lambda r: (r[0], r[2]))
        best = _greatest(runs)
        places = np.flatnonzero(collapsed(runs, n)) + a
        text = b" ".join([raw[i:j] for i, j in zip(starts[places].tolist(), ends[places].tolist())])
        listed = "".join(f"{s},{length},{q}\n" for s, length, q in runs).encode()
        s, length, q = best or (None, None, None)
        values = [n, len(runs), s, length, q, 1000 * length // q if best else None, hashlib.sha256(listed).hexdigest(), hashlib.sha256(text).hexdigest()]
        for col, v in zip(cols, values):
            col.append(v)
    kinds = [pa.int64()] * 6 + [pa.string()] * 2
    return pa.RecordBatch.from_arrays([ids, *[pa.array(c, k) for c, k in zip(cols, kinds)]], [x.split()[0] for x in SCHEMA.split(", ")])


def _numbered(part: pa.RecordBatch) -> tuple[np.ndarray, ...]:
    h, firsts, starts, ends, data = hash_words(byte_list(part))
    return word_ids(h, starts, ends, data), firsts, starts, ends, data


def _scan_whole(docs: DataFrame, least: int, min_exp: int, most: int) -> DataFrame:
    """The rows of SCHEMA; of texts of more than ``most`` words only doc_id and text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for part in slices(whole):
                ids, firsts, *where = _numbered(part)
                n = np.diff(firsts)
                long = n > most
                made = _figures(part.column(0), find_runs(ids, firsts, np.ones_like(n), np.where(long, 0, n + 1), least, min_exp), firsts, *where)
                places = pa.array(np.where(long, -1, np.arange(len(n))), mask=long)
                columns = [c.take(places) for c in made.columns[1:]]
                text = part.column(1).take(pa.array(np.arange(len(n)), mask=~long))
                yield pa.RecordBatch.from_arrays([made.column(0), *columns, text], [*made.schema.names, "text"])

    return map_batches(docs, run, SCHEMA + ", text string")


def _scan_ranges(long: DataFrame, least: int, min_exp: int, lags: int, ranges: int) -> DataFrame:
    """The same for long texts (row, doc_id, text, n): each range of lags is a row, and
    goes to any task."""
    top = F.floor(F.col("n") / min_exp)
    step = F.greatest(F.lit(lags), F.ceil(top / ranges))
    each = long.withColumn("step", step).withColumn("lo", F.explode(F.sequence(F.lit(1).cast("long"), F.greatest(top, F.lit(1)), F.col("step"))))
    each = each.select("row", "lo", (F.col("lo") + F.col("step")).alias("hi"), "text").repartition("row", "lo")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for part in slices(whole):
                ids, firsts, *_ = _numbered(part)
                found = find_runs(ids, firsts, part.column("lo").to_numpy(), part.column("hi").to_numpy(), least, min_exp)
                flat = [(r, *x) for r, runs in zip(part.column("row").to_pylist(), found) for x in runs]
                if flat:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*flat)], ["row", "s", "length", "q"])

    runs = map_batches(each, scan, "row long, s long, length long, q long")
    runs = runs.groupBy("row").agg(F.collect_list(F.struct("s", "length", "q")).alias("runs"))  # of one text
    both = long.join(stage(runs, "runs"), "row", "left").select("doc_id", "text", "runs")

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for part in slices(whole):
                _, firsts, *where = hash_words(byte_list(part))
                found = [[(x["s"], x["length"], x["q"]) for x in runs or []] for runs in part.column("runs").to_pylist()]
                yield _figures(part.column(0), found, firsts, *where)

    return map_batches(both, finish, SCHEMA)


def periodic_runs(docs: DataFrame, least: int = LEAST, min_exp: int = MIN_EXP, lags: int = LAGS, ranges: int = RANGES) -> DataFrame:
    """doc_id, n_words, n_runs, the run of the greatest exponent (start, length, period,
    exponent_milli; nulls if none), digests of all runs and of the text without the words
    after the first period of a run. ``lags`` and ``ranges`` don't change the result."""
    if least < 1 or min_exp < 3:
        raise ValueError("runs have at least one word and three periods")
    texts = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"])
    # Texts are read once; the long ones are written with what is found in the others.
    scanned = stage(_scan_whole(texts, least, min_exp, min_exp * lags), "scanned")
    long = scanned.where("text IS NOT NULL").select("doc_id", "text", word_count("text").alias("n"))
    long = stage(long.withColumn("row", F.monotonically_increasing_id()), "long")
    return scanned.where("text IS NULL").drop("text").unionByName(_scan_ranges(long, least, min_exp, lags, ranges))


def planted(docs: DataFrame) -> DataFrame:
    """doc_id and text; one document in ten, by h = crc32 of its decimal doc_id, goes on
    from word a by repeating p words: g = h // 10, a = g mod n,
    p = 1 + (n - a) // (3 + g mod 8). Without doc_id or words a text stays as it is."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.floor(h / 10).cast("long")
    words: Column = F.array_remove(F.split("text", r"[\x20\x09-\x0D]+"), "")
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"])
    # Lists of one text; slices of them, no expression for each word.
    rows = rows.select("doc_id", "text", F.when(h % 10 == 0, words).alias("words"), g.alias("g"))
    n = F.size("words").cast("long")
    rows = rows.withColumn("a", F.when(n > 0, F.col("g") % n))
    rows = rows.withColumn("p", F.when(n > 0, F.lit(1) + F.floor((n - F.col("a")) / (3 + F.col("g") % 8))))
    i32 = lambda c: c.cast("int")
    unit = F.slice("words", i32(F.col("a")) + 1, i32(F.col("p")))
    tail = F.slice(F.flatten(F.array_repeat(unit, i32(F.ceil((n - F.col("a")) / F.col("p"))))), F.lit(1), i32(n - F.col("a")))
    text = F.array_join(F.concat(F.slice("words", F.lit(1), i32(F.col("a"))), tail), " ")
    return rows.select("doc_id", F.when(n > 0, text).otherwise(F.col("text")).alias("text"))


def op12_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The runs of every whole text of documents, one in ten of them made periodic."""
    return periodic_runs(planted(table(spark, sf_dir, "documents")))
