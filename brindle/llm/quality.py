"""Operator 4: quality scores from random Fourier features of document statistics.

Each text gives a vector of statistics. Standardised, they pass through random Fourier
features (cosines that approximate a Gaussian kernel); ridge weights come from normal
equations that every partition sums for itself, and the scores are calibrated by
isotonic regression on a histogram that partitions sum likewise. So the fit covers all
labelled rows that may be learned from, and only sums of fixed size (GROUPS rows of
one matrix) reach the driver.

Null and empty texts have zero statistics and are scored like any text. Rows with a
null label don't teach; repeated labels of a document each count. Without labels every
score is 0.5. Equal texts have equal scores. Other columns of the tables are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.llm.common import _SPACE, byte_list, hash_words, held_out, map_batches, mix, slices, stage, table

FEATURES, WIDTH, RIDGE, BINS = 256, 3.0, 1e-2, 512
PARTIALS, GROUPS = 256, 16
ACCEPT = 0.7
STATISTICS = [
    "log_words", "log_chars", "word_length", "word_length_sd", "short_words", "long_words", "upper", "digit", "symbol", "bang", "bar", "stop", "comma",
    "other_punct", "wide", "space", "lines", "dup_lines", "distinct_words", "top_word", "repeat_pairs", "repeat_fours", "upper_words", "symbol_words",
]

_CLASS = {
    "upper": range(65, 91), "digit": range(48, 58), "symbol": b"#*$%&<>=_~^", "bang": b"!?", "bar": b"|", "stop": b".", "comma": b",",
    "other_punct": b"\"'()-/:;@[]{}\\`+", "wide": range(128, 256),
}
_IN = {k: np.isin(np.arange(256), list(v)) for k, v in _CLASS.items()}


def _per_text(values: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    total = np.concatenate(([0.0], np.cumsum(values, dtype=np.float64)))
    return total[firsts[1:]] - total[firsts[:-1]]


def statistics(texts: list[bytes]) -> np.ndarray:
    """text x statistic, all finite."""
    h, firsts, starts, ends, data = hash_words(texts)
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    bounds = np.concatenate(([0], np.cumsum(sizes + 1)))
    words, chars = np.diff(firsts), np.maximum(sizes, 1)
    some, n = np.maximum(words, 1), len(h)
    out = {"log_words": np.log1p(words), "log_chars": np.log1p(sizes)}
    length = ends - starts
    mean = _per_text(length, firsts) / some
    out["word_length"] = mean
    out["word_length_sd"] = np.sqrt(np.maximum(_per_text(length**2, firsts) / some - mean**2, 0))
    out["short_words"] = _per_text(length <= 2, firsts) / some
    out["long_words"] = _per_text(length >= 12, firsts) / some
    for k, table_of in _IN.items():
        out[k] = _per_text(table_of[data], bounds) / chars
    out["space"] = _per_text(_SPACE[data], bounds) / chars
    lines = [[x for x in t.split(b"\n") if x.strip()] for t in texts]
    count = np.array([len(x) for x in lines])
    out["lines"] = np.log1p(count)
    out["dup_lines"] = np.array([len(x) - len(set(x)) for x in lines]) / np.maximum(count, 1)
    text = np.repeat(np.arange(len(texts)), words)
    own = mix(h ^ mix(text.astype(np.uint64) + np.uint64(3)))

    def distinct(keys: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        _, at, times = np.unique(keys, return_index=True, return_counts=True)
        number = np.bincount(of[at], minlength=len(texts))
        most = np.zeros(len(texts))
        np.maximum.at(most, of[at], times)
        return number, most

    number, most = distinct(own, text) if n else (np.zeros(len(texts)), np.zeros(len(texts)))
    out["distinct_words"], out["top_word"] = number / some, most / some
    for name, k in (("repeat_pairs", 2), ("repeat_fours", 4)):
        out[name] = np.zeros(len(texts))
        if n >= k:
            at = np.flatnonzero(text[: n - k + 1] == text[k - 1 :])
            key = own[at]
            for i in range(1, k):
                key = mix(key * np.uint64(3) + own[at + i])
            if len(at):
                number, _ = distinct(key, text[at])
                all_of = np.bincount(text[at], minlength=len(texts))
                out[name] = np.where(all_of > 0, 1 - number / np.maximum(all_of, 1), 0.0)
    if n:
        # Of each word: whether its first two letters are capitals; whether it ends in a symbol.
        second = np.minimum(starts + 1, ends - 1)
        upper = _IN["upper"][data[starts]] & _IN["upper"][data[second]] & (length > 1)
        tail = _IN["symbol"][data[ends - 1]]
        out["upper_words"], out["symbol_words"] = _per_text(upper, firsts) / some, _per_text(tail, firsts) / some
    else:
        out["upper_words"] = out["symbol_words"] = np.zeros(len(texts))
    return np.stack([np.asarray(out[k], dtype=np.float64) for k in STATISTICS], axis=1)


def document_statistics(docs: DataFrame) -> DataFrame:
    """doc_id, stats array<double> for each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for part in slices(whole):
                x = statistics(byte_list(part))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(list(x), pa.list_(pa.float64()))], ["doc_id", "stats"])

    return map_batches(docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"]), run, "doc_id long, stats array<double>")


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    directions: np.ndarray
    phases: np.ndarray
    weights: np.ndarray | None = None
    edges: np.ndarray | None = None
    values: np.ndarray | None = None

    def features(self, stats: np.ndarray) -> np.ndarray:
        """Fourier features, the standardised statistics themselves, and a one."""
        x = np.clip((stats - self.mean) / self.scale, -8, 8)
        waves = np.cos(x @ self.directions + self.phases) * np.sqrt(2 / len(self.phases))
        return np.concatenate((waves, x, np.ones((len(x), 1))), axis=1)

    def raw(self, stats: np.ndarray) -> np.ndarray:
        # A score is a sum over a row alone, so that it doesn't depend on its batch.
        return np.clip((self.features(stats) * self.weights).sum(axis=1), -0.5, 1.5)

    def score(self, stats: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(self.raw(stats), self.edges, self.values), 0.0, 1.0)


def _matrix(batch: pa.RecordBatch, name: str = "stats") -> np.ndarray:
    col = batch.column(batch.schema.get_field_index(name))
    return np.asarray(col.flatten().to_numpy(zero_copy_only=False)).reshape(batch.num_rows, -1)


def _summed(rows: DataFrame, partial, size: int) -> np.ndarray:
    """The sum over all rows of ``partial(stats, labels)``, an array of ``size``: summed
    in PARTIALS tasks, then in GROUPS, and only then on the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for b in batches:
            if b.num_rows:
                total += partial(_matrix(b), np.asarray(b.column(1).to_numpy(zero_copy_only=False), dtype=np.float64))
        yield pa.RecordBatch.from_arrays([pa.array([total], pa.list_(pa.float64()))], ["total"])

    def join(t: pa.Table) -> pa.Table:
        return pa.table({"total": pa.array([sum((np.asarray(x) for x in t.column("total").to_pylist()), np.zeros(size))], pa.list_(pa.float64()))})

    parts = map_batches(rows.select("stats", "label").coalesce(PARTIALS), run, "total array<double>")
    grouped = parts.groupBy((F.spark_partition_id() % GROUPS).alias("g")).applyInArrow(join, "total array<double>")
    return sum((np.asarray(r["total"]) for r in grouped.collect()), np.zeros(size))  # at most GROUPS rows


def isotonic(labels: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """The non-decreasing means nearest to given means (pool adjacent violators)."""
    blocks: list[list[float]] = []
    for y, w in zip(labels.tolist(), weights.tolist()):
        blocks.append([y, w, 1])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            y2, w2, n2 = blocks.pop()
            y1, w1, n1 = blocks.pop()
            w = w1 + w2
            blocks.append([(y1 * w1 + y2 * w2) / w if w else (y1 + y2) / 2, w, n1 + n2])
    return np.concatenate([np.full(int(n), y) for y, _, n in blocks])


def fit(stats: DataFrame, labels: DataFrame, seed: int = 4) -> Model | None:
    """stats: doc_id, stats. labels: doc_id, label (0 or 1). None without a label."""
    rows = stats.join(labels.where("label IS NOT NULL"), "doc_id").where(~held_out("doc_id")).select("stats", F.col("label").cast("double").alias("label"))
    rows = stage(rows, "labelled")
    k = len(STATISTICS)
    sums = _summed(rows, lambda x, y: np.concatenate((x.sum(axis=0), (x**2).sum(axis=0), [len(x)])), 2 * k + 1)
    n = sums[-1]
    if not n:
        return None
    mean = sums[:k] / n
    scale = np.sqrt(np.maximum(sums[k : 2 * k] / n - mean**2, 0))
    rng = np.random.default_rng(seed)
    model = Model(mean, np.where(scale > 1e-9, scale, 1.0), rng.normal(0, 1 / WIDTH, (k, FEATURES)), rng.uniform(0, 2 * np.pi, FEATURES))
    d = FEATURES + k + 1

    def normal(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        z = model.features(x)
        return np.concatenate(((z.T @ z).ravel(), z.T @ y))

    sums = _summed(rows, normal, d * d + d)
    model.weights = np.linalg.solve(sums[: d * d].reshape(d, d) + RIDGE * np.sqrt(n) * np.eye(d), sums[d * d :])
    edges = np.linspace(-0.5, 1.5, BINS + 1)

    def histogram(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        at = np.clip(np.digitize(model.raw(x), edges) - 1, 0, BINS - 1)
        return np.concatenate((np.bincount(at, minlength=BINS), np.bincount(at, weights=y, minlength=BINS)))

    sums = _summed(rows, histogram, 2 * BINS)
    count, ones = sums[:BINS], sums[BINS:]
    used = count > 0
    model.edges = ((edges[:-1] + edges[1:]) / 2)[used]
    model.values = isotonic(ones[used] / count[used], count[used])
    return model


def score(stats: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    shared = stats.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                s = shared.value.score(_matrix(b)) if shared.value is not None else np.full(b.num_rows, 0.5)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s), pa.array((s >= ACCEPT).astype(np.int32))], ["doc_id", "score", "predicted"])

    out = map_batches(stats.select("doc_id", "stats"), run, "doc_id long, score double, predicted int")
    return out.select("doc_id", held_out("doc_id").alias("held_out"), "score", "predicted")


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fit on all labelled rows that may be learned from; score every document."""
    stats = stage(document_statistics(table(spark, sf_dir, "documents")), "statistics")
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").alias("label"))
    return score(stats, fit(stats, labels))
