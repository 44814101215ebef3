"""Operator 8: language ID by averaged hashed subword embeddings.

A text is the bag of its hashed character pieces (2 to 4 bytes of a word between
marks, ASCII lower-cased). Their embeddings are averaged and a linear softmax gives a
probability for each language; both are trained by stochastic gradient descent in
numpy. As prediction is linear before the softmax, the trained model is a table of one
logit for each hashed piece and language, and a worker sums it once for each distinct word.

Training takes a bounded sample of labelled rows: the TRAIN_ROWS with the lowest hash
of doc_id, text and language (documented bound of a model fit; Spark takes them, so no
more reach the driver); only rows outside held_out and with a language are eligible.
Rows equal in all three count once; null doc_ids are eligible and told apart by text.

Calibration and rejection. One part of the sample is kept back. It fits the temperature of
the softmax; but a softmax is sure of texts of no language at all, so what is rejected is
told by familiarity: the mean log-probability of a text's pieces under the piece counts of
the language that fits best (words with digits don't count). Its bound lies midway between
what REJECT_SHARE of the kept-back texts, and of short windows of them, fall under, and what
all but NOISE_SHARE of the same texts with shuffled letters reach; if these overlap, at the
former. A score under the one that REJECT_SHARE of right predictions fall under, halved,
is rejected too. With less than LEAST_KEPT texts kept back such shares mean nothing, and no
text with a letter is rejected.

A null text or one without a letter is ``und`` with score 0, and is rejected. Ties go
to the first language in code-point order. An empty training set gives ``und`` for all.
Nothing shuffles but the sample's own sort; memory is bounded by a slice of text.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.llm.common import _LOWER, byte_list, hash_words, held_out, map_batches, mix, seeded, slices, table

TRAIN_ROWS, KEPT_BACK = 3000, 5
BUCKETS, DIMENSIONS, EPOCHS, RATE = 1 << 16, 16, 4, 0.5
PIECES = (2, 3, 4)
REJECT_SHARE, NOISE_SHARE, LEAST_KEPT = 0.002, 0.01, 100
#: Words of the short windows on which the rejection is calibrated too.
WINDOW_WORDS = 8
#: Distinct words that a worker remembers (16 bytes and a logit for each language).
CACHE_WORDS = 1 << 17
UNKNOWN = "und"

_LETTER = re.compile(rb"[A-Za-z]")
_PIECE = seeded(256, 31)
_DIGIT = np.zeros(256, dtype=bool)
_DIGIT[48:58] = True
_IS_LETTER = np.zeros(256, dtype=bool)
_IS_LETTER[list(range(65, 91)) + list(range(97, 123)) + list(range(128, 256))] = True


def has_letter(text: bytes) -> bool:
    return _LETTER.search(text) is not None or (not text.isascii() and any(map(str.isalpha, text.decode("utf-8", "replace"))))


def word_pieces(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashed pieces of words given by spans, and how many each word has."""
    sizes = ends - starts + 2
    stop = np.cumsum(sizes)
    begin = stop - sizes
    text = np.zeros(int(stop[-1]) if len(stop) else 0, dtype=np.uint8)
    inner = np.ones(len(text), bool)
    inner[begin] = inner[stop - 1] = False
    text[begin], text[stop - 1] = 60, 62
    text[inner] = _LOWER[data[np.repeat(starts - (begin + 1), sizes - 2) + np.flatnonzero(inner)]]
    end = np.repeat(stop, sizes)
    place = np.arange(len(text))
    code = _PIECE[text]
    out, owner = [], []
    word = np.repeat(np.arange(len(sizes)), sizes)
    with np.errstate(over="ignore"):
        for n in PIECES:
            at = place[place + n <= end]
            h = np.full(len(at), n, dtype=np.uint64)
            for k in range(n):
                h = h * np.uint64(0x100000001B3) + code[at + k]
            out.append((mix(h) % np.uint64(buckets)).astype(np.int64))
            owner.append(word[at])
    pieces, words = np.concatenate(out), np.concatenate(owner)
    order = np.argsort(words, kind="stable")
    return pieces[order], np.bincount(words, minlength=len(sizes))


def words_of_letters(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Which words have letters and no digits."""
    digits, letters = (np.concatenate(([0], np.cumsum(x[data]))) for x in (_DIGIT, _IS_LETTER))
    return (digits[ends] == digits[starts]) & (letters[ends] > letters[starts])


@dataclass
class Model:
    languages: list[str]
    logits: np.ndarray  # bucket x language
    bias: np.ndarray
    known: np.ndarray  # bucket x language: log-probability of a piece in a language
    temperature: float = 1.0
    threshold: float = 0.0
    familiar: float = -np.inf

    def __post_init__(self) -> None:
        self.clear()

    def clear(self) -> None:
        self.keys = np.zeros(0, np.uint64)
        self.table = np.zeros((0, 2 * len(self.languages) + 2))

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k not in ("keys", "table")}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self.clear()

    def _words(self, key: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.full(len(key), -1)
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, at, -1)

    def probabilities(self, texts: list[bytes]) -> np.ndarray:
        """text x language."""
        return self.scores(texts)[0]

    def rejects(self, p: np.ndarray, familiarity: np.ndarray) -> np.ndarray:
        return (p.max(axis=1) < self.threshold) | (familiarity < self.familiar)

    def scores(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(probabilities, text x language; familiarity of each text, infinite without a
        word of letters)."""
        h, firsts, starts, ends, data = hash_words(texts, lower=True)
        width = len(self.languages)
        total = np.zeros((len(texts), 2 * width + 2))
        if len(h):
            key, example, inverse = np.unique(h, return_index=True, return_inverse=True)
            slot = self._words(key)
            new = np.flatnonzero(slot < 0)
            if len(new):
                if len(self.keys) + len(new) > CACHE_WORDS:
                    self.clear()
                    new = np.arange(len(key))
                pieces, counts = word_pieces(data, starts[example[new]], ends[example[new]], len(self.logits))
                begin = np.cumsum(counts) - counts
                lettered = words_of_letters(data, starts[example[new]], ends[example[new]])[:, None]
                sums = [np.add.reduceat(x[pieces], begin) for x in (self.logits, self.known)]
                rows = np.concatenate((sums[0], counts[:, None], sums[1] * lettered, counts[:, None] * lettered), axis=1)
                keys = np.concatenate((self.keys, key[new]))
                order = np.argsort(keys, kind="stable")
                self.keys, self.table = keys[order], np.concatenate((self.table, rows))[order]
                slot = self._words(key)
            # Each text is summed on its own, so equal texts get equal figures to the last bit.
            some = np.flatnonzero(np.diff(firsts) > 0)
            total[some] = np.add.reduceat(self.table[slot][inverse], firsts[some], axis=0)
        z = (total[:, :width] / np.maximum(total[:, width : width + 1], 1) + self.bias) / self.temperature
        z = np.exp(z - z.max(axis=1, keepdims=True))
        n = total[:, -1]
        familiarity = np.where(n > 0, total[:, width + 1 : -1].max(axis=1) / np.maximum(n, 1), np.inf)
        return z / z.sum(axis=1, keepdims=True), familiarity


def piece_counts(text: bytes, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """The distinct pieces of a text and their counts."""
    _, _, starts, ends, data = hash_words([text], lower=True)
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    pieces, _ = word_pieces(data, starts, ends, buckets)
    return np.unique(pieces, return_counts=True)


def bag(text: bytes, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """The distinct pieces of a text and their shares."""
    ids, counts = piece_counts(text, buckets)
    return ids, counts / max(1, counts.sum())


def train(texts: list[bytes], labels: list[str], buckets: int = BUCKETS, seed: int = 5) -> Model:
    """Fit embeddings and softmax by gradient descent, one text at a time; every
    KEPT_BACK-th text is kept back for the temperature and the threshold."""
    languages = sorted(set(labels), key=lambda x: x.encode())
    if not languages:
        return Model([], np.zeros((buckets, 0)), np.zeros(0), np.zeros((buckets, 0)))
    rng = np.random.default_rng(seed)
    # Pieces and counts of all texts in two arrays: thousands of small ones would stay with
    # the process.
    sizes, ids_of, counts_of = [], [], []
    for at in range(0, len(texts), 64):
        some = [piece_counts(t, buckets) for t in texts[at : at + 64]]
        sizes += [len(ids) for ids, _ in some]
        ids_of.append(np.concatenate([ids for ids, _ in some]).astype(np.int32))
        counts_of.append(np.concatenate([c for _, c in some]).astype(np.int32))
    ends = np.cumsum(sizes)
    ids_of, counts_of = np.concatenate(ids_of), np.concatenate(counts_of)

    def pieces_of(i: int) -> tuple[np.ndarray, np.ndarray]:
        part = slice(ends[i] - sizes[i], ends[i])
        return ids_of[part], counts_of[part]

    target = np.array([languages.index(x) for x in labels])
    usable = [i for i, n in enumerate(sizes) if n]
    fit = [i for k, i in enumerate(usable) if k % KEPT_BACK or len(usable) < 2 * KEPT_BACK]
    embed = rng.uniform(-1 / DIMENSIONS, 1 / DIMENSIONS, (buckets, DIMENSIONS))
    weight, bias = np.zeros((DIMENSIONS, len(languages))), np.zeros(len(languages))
    steps, done = EPOCHS * len(fit), 0
    for _ in range(EPOCHS):
        for i in rng.permutation(fit):
            rate = RATE * (1 - done / steps)
            done += 1
            ids, share = pieces_of(i)
            share = share / share.sum()
            mean = share @ embed[ids]
            z = mean @ weight + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[target[i]] -= 1
            back = weight @ p
            weight -= rate * np.outer(mean, p)
            bias -= rate * 0.1 * p
            # The average spreads a gradient thinly; embeddings of a text move together.
            embed[ids] -= rate * 20 * np.outer(share, back)
    counts = np.full((buckets, len(languages)), 0.5)
    for i in fit:
        ids, times = pieces_of(i)
        counts[ids, target[i]] += times
    model = Model(languages, embed @ weight, bias, np.log(counts / counts.sum(axis=0)))
    fitted = set(fit)
    rest = [i for i in usable if i not in fitted] or fit
    calibrate(model, [texts[i] for i in rest], target[rest])
    return model


def _by_parts(model: Model, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """``scores`` of a few texts at a time, so that little memory is held at once."""
    found = []
    for at in range(0, len(texts), 16):
        model.clear()
        found.append(model.scores(texts[at : at + 16]))
    model.clear()
    return np.concatenate([p for p, _ in found]), np.concatenate([f for _, f in found])


def shuffled(text: str, rng: random.Random) -> bytes:
    """A text with its letters in another order: noise of the same letters and lengths."""
    letters = [c for c in text if c.isalpha()]
    rng.shuffle(letters)
    rest = iter(letters)
    return "".join(next(rest) if c.isalpha() else c for c in text).encode()


def calibrate(model: Model, texts: list[bytes], target: np.ndarray) -> None:
    """Choose the temperature of the least log loss, then the bounds of rejection."""
    if not texts:
        return
    z = np.log(np.maximum(_by_parts(model, texts)[0], 1e-300))
    best = (np.inf, 1.0)
    for t in np.geomspace(0.05, 4, 40):
        s = z / t
        s -= s.max(axis=1, keepdims=True)
        loss = -(s[np.arange(len(target)), target] - np.log(np.exp(s).sum(axis=1))).mean()
        best = min(best, (loss, float(t)))
    model.temperature = best[1]
    model.clear()
    if len(texts) < LEAST_KEPT:
        return
    p, own = _by_parts(model, texts)
    right = p.max(axis=1)[p.argmax(axis=1) == target]
    model.threshold = float(np.quantile(right, REJECT_SHARE)) / 2 if len(right) else 0.0
    rng = random.Random(17)
    windows, noise = [], []
    for t in texts:
        words = t.split()
        if len(words) > WINDOW_WORDS:
            at = rng.randrange(len(words) - WINDOW_WORDS)
            windows.append(b" ".join(words[at : at + WINDOW_WORDS]))
        noise.append(shuffled(t.decode("utf-8", "replace")[:2000], rng))
    low = lambda x: float(np.quantile(x, REJECT_SHARE, method="lower"))
    clean = min(low(own), low(_by_parts(model, windows)[1]) if windows else np.inf)
    other = float(np.quantile(_by_parts(model, noise)[1], 1 - NOISE_SHARE, method="lower"))
    if np.isfinite(clean):
        model.familiar = (clean + other) / 2 if other < clean else clean
    model.clear()


def sample(docs: DataFrame, rows: int = TRAIN_ROWS) -> tuple[list[bytes], list[str]]:
    """At most ``rows`` distinct labelled rows that may be learned from, by hash of doc_id,
    text and language."""
    able = docs.where("lang IS NOT NULL AND text IS NOT NULL").where(~held_out("doc_id")).select("doc_id", "text", "lang")
    able = able.withColumn("_hash", F.xxhash64("doc_id", "text", "lang", F.lit(8)))
    total = able.count()
    if not total:
        return [], []
    # The lowest hashes are looked for in a share of their range that holds them if rows
    # don't repeat much, and else in all of it.
    lowest = []
    for share in dict.fromkeys((min(1.0, (1.2 * rows + 20) / total), 1.0)):
        cut = min((1 << 63) - 1, int(share * (1 << 64)) - (1 << 63))
        lowest = able.select("_hash").where(F.col("_hash") <= cut).distinct().orderBy("_hash").limit(rows).collect()
        if len(lowest) == rows:
            break
    got = able.where(F.col("_hash") <= lowest[-1][0]).dropDuplicates(["_hash"]).select("_hash", "text", "lang").toArrow().sort_by("_hash")  # ``rows`` at most
    return got.column("text").cast(pa.binary()).to_pylist(), got.column("lang").to_pylist()


def keep_identified(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs``, whole, that the model doesn't reject. A model without any
    language (no labels to learn from) can't reject a text: all with a letter stay."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for whole in batches:
            for part in slices(whole):
                texts = byte_list(part)
                kept = np.array([has_letter(t) for t in texts], dtype=bool)
                if m.languages:
                    kept &= ~m.rejects(*m.scores(texts))
                yield part.filter(pa.array(kept))

    return map_batches(docs, run, docs.schema)


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, lang_pred, score, rejected for each row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for whole in batches:
            for part in slices(whole):
                texts = byte_list(part)
                lettered = np.array([has_letter(t) for t in texts], dtype=bool) & bool(m.languages)
                if m.languages:
                    p, familiarity = m.scores(texts)
                    best, score, gone = p.argmax(axis=1), np.where(lettered, p.max(axis=1), 0.0), m.rejects(p, familiarity)
                else:
                    best, score, gone = np.zeros(len(texts), int), np.zeros(len(texts)), np.zeros(len(texts), bool)
                names = [m.languages[b] if ok else UNKNOWN for b, ok in zip(best, lettered)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(names), pa.array(score), pa.array(~lettered | gone)], ["doc_id", "held_out", "lang_pred", "score", "rejected"])

    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), held_out(docs["doc_id"]).alias("held_out"), docs["text"])
    return map_batches(rows, run, "doc_id long, held_out boolean, lang_pred string, score double, rejected boolean")


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Train on a sample of documents, then predict every text of documents."""
    docs = table(spark, sf_dir, "documents")
    return identify(docs, train(*sample(docs)))
