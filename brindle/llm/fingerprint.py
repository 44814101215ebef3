"""Operator 5: fingerprints from statistically improbable features.

Every window of WINDOW bytes of a text has a Shannon entropy; its rarity follows from
how far that entropy lies from what is usual in text (a fixed rule, so fingerprints of
different runs compare). In each run of RUN windows the rarest one, the leftmost of
equals, gains a point; windows of at least POINTS points are the features. They are
hashed into Bloom filters of BITS bits, chained whenever one is full. Two fingerprints
are as alike as the bit overlap of their filters, normalised by what chance would give.

Null and empty texts, and texts too short for a feature, have one filter with a hash of
the whole text (none for the empty text); they are alike (1) only if equal. Equal texts
have equal fingerprints. Features come from whole texts; a very long text only makes a
longer chain.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.llm.common import byte_list, map_batches, mix, table
from brindle.llm.tokens import id_ranges

WINDOW, RUN, POINTS = 32, 32, 8
BITS, HASHES, FULL = 2048, 5, 160
#: Entropy (of WINDOW bytes, in thousandths of its most) that is usual in prose, and
#: the range outside of which windows say nothing (runs of one byte, random bytes).
USUAL, LEAST, MOST = 740, 100, 990
#: Documents in a range that a task handles at once.
RANGE_DOCS = 4096

_COUNT = np.arange(WINDOW + 1, dtype=np.float64)
_PART = np.where(_COUNT > 0, _COUNT * np.log2(np.maximum(_COUNT, 1)), 0.0)
_STEP = np.rint(np.diff(_PART) * 4096).astype(np.int64)  # of one more equal byte
_BASE = np.uint64(0xD1342543DE82EF95)
_POPULAR = np.array([bin(i).count("1") for i in range(1 << 16)], dtype=np.uint8)


def entropies(data: np.ndarray) -> np.ndarray:
    """Entropy of every window, in thousandths of the most possible."""
    n = len(data)
    if n < WINDOW:
        return np.zeros(0, dtype=np.int64)
    # Equal bytes among the WINDOW - 1 before each byte, and after it: places of a byte
    # are sorted together, and a window is a range of them.
    order = np.argsort(data, kind="stable")
    key = data[order].astype(np.int64) * (n + WINDOW) + order
    rank = np.arange(n)
    first = np.searchsorted(key, np.maximum(key - (WINDOW - 1), data[order].astype(np.int64) * (n + WINDOW)))
    before = np.empty(n, dtype=np.int64)
    before[order] = rank - first
    # A byte's followers within reach: those whose own range begins at or before it.
    after = np.empty(n, dtype=np.int64)
    after[order] = np.searchsorted(first, rank, side="right") - 1 - rank
    total = np.cumsum(_STEP[before])
    out = total[WINDOW - 1 :].copy()
    if n > WINDOW:
        out[1:] -= np.cumsum(_STEP[after[: n - WINDOW]])
    # sum c log c -> entropy = log2 W - (sum c log c) / W
    return np.clip(np.rint(1000 * (1 - out / (4096.0 * WINDOW * np.log2(WINDOW)))), 0, 1000).astype(np.int64)


def rarity(entropy: np.ndarray) -> np.ndarray:
    """Lower is rarer; -1 takes no part."""
    usual = 1000 - np.abs(entropy - USUAL)
    return np.where((entropy < LEAST) | (entropy > MOST), 2000, usual)


def select(rank: np.ndarray) -> np.ndarray:
    """Windows that are the rarest, leftmost, in at least POINTS runs of RUN windows."""
    n = len(rank)
    if not n:
        return np.zeros(0, dtype=np.int64)
    spot = rank * (1 << 40) + np.arange(n)
    low, span = spot, 1
    run = min(RUN, n)
    while 2 * span <= run:
        low = np.minimum(low[:-span], low[span:])
        span *= 2
    if span < run:
        low = np.minimum(low[: n - run + 1], low[run - span : run - span + n - run + 1])
    best = low[low < 2000 << 40] & ((1 << 40) - 1)
    points = np.bincount(best, minlength=n)
    return np.flatnonzero(points >= min(POINTS, len(low)))


def window_hashes(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    h = np.zeros(len(at), dtype=np.uint64)
    if len(at):
        windows = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(data, WINDOW)[at]).view("<u8")
        with np.errstate(over="ignore"):
            for k in range(WINDOW // 8):
                h = mix(h * _BASE + windows[:, k])
    return h


def digest(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Chained filters, filter x 64-bit word, of the features at some places."""
    h = window_hashes(data, at)
    _, first = np.unique(h, return_index=True)
    h = h[np.sort(first)]
    if not len(h):
        raw = data.tobytes()
        h = np.frombuffer(hashlib.blake2b(raw, digest_size=8).digest(), dtype="<u8").astype(np.uint64)[: 1 if raw else 0]
    n = max(1, -(-len(h) // FULL))
    bits = np.zeros(n * BITS, dtype=np.uint8)
    chain = np.arange(len(h)) // FULL * BITS
    for k in range(HASHES):
        bits[chain + ((h >> np.uint64(11 * k)) % np.uint64(BITS)).astype(np.int64)] = 1
    return np.packbits(bits).view(np.uint64).reshape(n, BITS // 64)


def bit_count(words: np.ndarray) -> np.ndarray:
    return _POPULAR[np.ascontiguousarray(words).view(np.uint16)].reshape(*words.shape[:-1], -1).sum(axis=-1, dtype=np.int64)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """0 to 1: for each filter of the shorter chain the best normalised overlap with a
    filter of the longer one, weighed by its bits."""
    if a.shape == b.shape and (a == b).all():
        return 1.0
    if len(a) > len(b):
        a, b = b, a
    na, nb = bit_count(a), bit_count(b)
    if min(na.sum(), nb.sum()) <= HASHES:  # one feature: shared whole or not at all
        return 0.0
    score = np.empty(len(a))
    for i, row in enumerate(a):
        both = bit_count(row & b)
        chance = na[i] * nb / BITS
        most = np.minimum(na[i], nb)
        score[i] = max(0.0, float(np.max(np.where(most > chance, (both - chance) / np.maximum(most - chance, 1e-9), 0.0))))
    return float(min(1.0, (score * na).sum() / na.sum()))


def text_of(filters: np.ndarray) -> str:
    return f"{len(filters)}:" + base64.b64encode(filters.astype("<u8").tobytes()).decode()


def parse(fingerprint: str) -> np.ndarray:
    n, _, body = fingerprint.partition(":")
    return np.frombuffer(base64.b64decode(body), dtype="<u8").reshape(int(n), BITS // 64)


def compare(a: str, b: str) -> float:
    return likeness(parse(a), parse(b))


def fingerprint(text: bytes) -> np.ndarray:
    data = np.frombuffer(text, dtype=np.uint8)
    return digest(data, select(rarity(entropies(data))))


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint of each row; nothing shuffles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([text_of(fingerprint(t)) for t in byte_list(b)])], ["doc_id", "fingerprint"])

    return map_batches(docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"]), run, "doc_id long, fingerprint string")


def edit(text: str, other: str) -> str:
    """The last half of a text (rounded down) replaced by as many characters of another."""
    half = len(text) // 2
    return text[: len(text) - half] + other[:half]


class _Text:
    """A text with the rarities of its windows, which an edited text may reuse."""

    def __init__(self, doc_id: int | None, text: str):
        self.doc_id, self.text = doc_id, text
        self.data = np.frombuffer(text.encode(), dtype=np.uint8)
        self.rank = rarity(entropies(self.data))
        self.filters = digest(self.data, select(self.rank))

    def edited(self, other: "_Text") -> tuple[str, np.ndarray]:
        out = edit(self.text, other.text)
        data = np.frombuffer(out.encode(), dtype=np.uint8)
        kept = len(self.text[: len(self.text) - len(self.text) // 2].encode())
        if len(data) < 4 * WINDOW:
            return out, digest(data, select(rarity(entropies(data))))
        # Windows inside either part are known; only those across the joint are new.
        left = self.rank[: max(0, kept - WINDOW + 1)]
        right = other.rank[: max(0, len(data) - kept - WINDOW + 1)]
        begin, end = len(left), min(len(data) - WINDOW + 1, kept) if len(right) else len(data) - WINDOW + 1
        middle = rarity(entropies(data[begin : end + WINDOW - 1]))
        return out, digest(data, select(np.concatenate((left, middle, right))))


def edited_fingerprints(docs: DataFrame) -> DataFrame:
    """Each document against its edited text and the next document, descending doc_id
    (a null doc_id comes last; equal ones by text): the columns of op5.

    Rows go to ranges of doc_id, sorted; the first row of a range also goes to the end
    of the range before, so that no text meets more than its neighbour. Of those rows
    only the ids (one for each range) reach the driver."""
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.coalesce(docs["text"], F.lit("")).alias("text"))
    part, n = id_ranges(rows.select("doc_id"), RANGE_DOCS)
    rows = rows.withColumn("part", F.lit(n - 1) - F.when(F.col("doc_id").isNull(), F.lit(0)).otherwise(part))
    # Null ids share the last range; they sort after its other rows.
    firsts = rows.select("part", "doc_id").groupBy("part").agg(F.max("doc_id").alias("doc_id")).collect()  # a row for each range
    firsts = sorted((r["part"], r["doc_id"]) for r in firsts if r["doc_id"] is not None)
    before = {firsts[i][1]: firsts[i - 1][0] for i in range(1, len(firsts))} | ({firsts[0][1]: firsts[-1][0]} if len(firsts) > 1 else {})
    if before:
        guests = docs.sparkSession.createDataFrame(list(before.items()), "doc_id long, before int")
        rows = rows.join(F.broadcast(guests), "doc_id", "left")  # a row for each range, MOST_RANGES at most
        home = F.struct(F.col("part").alias("part"), F.lit(0).alias("guest"))
        away = F.struct(F.col("before").alias("part"), F.lit(1).alias("guest"))
        rows = rows.withColumn("to", F.explode(F.when(F.col("before").isNotNull(), F.array(home, away)).otherwise(F.array(home))))
        rows = rows.select("doc_id", "text", "to.part", "to.guest")
    else:
        rows = rows.withColumn("guest", F.lit(0))
    sorted_rows = rows.repartitionByRange(max(n, 1), "part").sortWithinPartitions("part", "guest", F.col("doc_id").desc_nulls_last(), "text")
    single = len(firsts) <= 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
        out: list[list] = [[] for _ in names]

        def pair(a: _Text, b: _Text) -> None:
            text, filters = a.edited(b)
            row = (a.doc_id, len(a.text), hashlib.sha256(text.encode()).hexdigest(), text_of(a.filters), text_of(filters), likeness(a.filters, filters), likeness(a.filters, b.filters))
            for c, v in zip(out, row):
                c.append(v)

        def flush() -> pa.RecordBatch:
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
            batch = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], names)
            for c in out:
                c.clear()
            return batch

        last, here, first, first_here, was_guest = None, None, None, None, False
        for b in batches:
            for start in range(0, b.num_rows, 64):
                piece = b.slice(start, 64)
                for doc_id, text, p, guest in zip(*(piece.column(i).to_pylist() for i in range(4))):
                    now = _Text(doc_id, text)
                    if last is not None and p == here and not was_guest:
                        pair(last, now)
                    if guest and single:
                        continue
                    if last is None or p != here:
                        first = now
                    last, here, was_guest = now, p, bool(guest)
                if len(out[0]) >= 256:
                    yield flush()
        if single and last is not None:
            pair(last, first)
        if out[0]:
            yield flush()

    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return map_batches(sorted_rows.select("doc_id", "text", "part", "guest"), run, schema)


def op5_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, their edited texts and their neighbours."""
    return edited_fingerprints(table(spark, sf_dir, "documents"))
