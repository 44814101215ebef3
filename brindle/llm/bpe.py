"""Operator 9: byte-pair encoding and decoding in batched numpy merge rounds.

``encode_documents`` gives each text the ids that the tokenizers library gives it
for a vocabulary file with an end-of-word suffix; ``decode`` gives its text for ids.
White space cuts a text into pieces which can't influence each other, so a worker
encodes each distinct piece once: the words of all new pieces go into one flat
array of symbols, and in every round each word merges its leftmost pair of the
lowest rank, found by binary search over sorted pair keys.

Null and empty texts have no ids. Ties of rank are taken from the left. Very long
words take a heap instead of rounds (the same merges, n log n). Nothing shuffles;
memory is bounded by a slice of text and a cache of pieces that is emptied when full.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import unicodedata
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from brindle.llm.common import byte_list, map_batches, ragged, remembered, slices, table, vocabulary_path

VOCABULARY = "word_bpe_49k.json"
#: Distinct pieces that a worker remembers, and their bytes.
CACHE_PIECES, CACHE_WORDS = 250_000, 250_000
CACHE_BYTES = 32 << 20
#: Symbols of a word from which the heap takes over.
LONG_WORD = 96
#: White space of Unicode, as the vocabulary file's patterns understand it.
WHITE = r"\u0009-\u000D \u0085   -     　"


def byte_symbols() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies."""
    kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, spare = [], 256
    for b in range(256):
        if b in kept:
            out.append(chr(b))
        else:
            out.append(chr(spare))
            spare += 1
    return out


class WordBpe:
    """Encoder and decoder for one vocabulary file."""

    def __init__(self, path: str):
        import regex

        spec = json.loads(open(path, encoding="utf-8").read())
        model = spec["model"]
        vocab: dict[str, int] = model["vocab"]
        self.suffix = model["end_of_word_suffix"] or ""
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.names = [""] * (1 + max([*vocab.values(), *self.special.values()]))
        for k, v in [*vocab.items(), *self.special.items()]:
            self.names[v] = k
        stand_in = byte_symbols()
        self.inner = np.array([vocab[c] for c in stand_in], dtype=np.int64)
        self.last = np.array([vocab[c + self.suffix] for c in stand_in], dtype=np.int64)
        self.base = len(self.names)
        pairs = model["merges"]
        keys = np.array([vocab[a] * self.base + vocab[b] for a, b in pairs], dtype=np.int64)
        made = np.array([vocab[a + b] for a, b in pairs], dtype=np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.rank, self.made = keys[order], order.astype(np.int64), made[order]
        self.none = len(keys)
        self.words = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^" + WHITE + r"\p{L}\p{N}]+")
        self.specials = regex.compile("|".join(map(regex.escape, self.special))) if self.special else None
        self.clear()

    def clear(self) -> None:
        self.pieces: dict[bytes, tuple[bytes, bytes]] = {}
        self.known: dict[str, tuple[bytes, bytes]] = {}
        self.held = 0

    def normalise(self, text: str) -> str:
        if text.isascii():
            return text.lower()
        return "".join([c.lower() for c in unicodedata.normalize("NFC", text)])

    def _look_up(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        key = left * self.base + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.rank[at], self.none), at

    def merge_words(self, words: list[bytes]) -> list[bytes]:
        """Ids of each word (its UTF-8 bytes), as little-endian 32-bit integers."""
        done: list[tuple[np.ndarray, np.ndarray]] = []
        for i, w in enumerate(words):
            if len(w) > LONG_WORD:
                ids = self._merge_long(w)
                done.append((ids, np.full(len(ids), i)))
        sizes = np.array([len(w) if len(w) <= LONG_WORD else 0 for w in words], dtype=np.int64)
        data = np.frombuffer(b"".join([w for w in words if len(w) <= LONG_WORD]), dtype=np.uint8)
        symbols = self.inner[data]
        ends = np.cumsum(sizes)[sizes > 0]
        symbols[ends - 1] = self.last[data[ends - 1]]
        owner = np.repeat(np.arange(len(words)), sizes)
        while len(symbols):
            # Pairs of neighbours in a word; the last symbol of a word has no pair.
            rank = np.full(len(symbols), self.none, dtype=np.int64)
            made = np.zeros(len(symbols), dtype=np.int64)
            same = np.flatnonzero(owner[:-1] == owner[1:])
            found, at = self._look_up(symbols[same], symbols[same + 1])
            rank[same], made[same] = found, self.made[at]
            first = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
            best = np.minimum.reduceat(rank * len(symbols) + np.arange(len(symbols)), first)
            pos, live = best % len(symbols), best // len(symbols) < self.none
            keep = np.repeat(live, np.diff(np.concatenate((first, [len(symbols)]))))
            if not live.all():
                done.append((symbols[~keep], owner[~keep]))
            pos = pos[live]
            symbols[pos] = made[pos]
            keep[pos + 1] = False
            symbols, owner = symbols[keep], owner[keep]
        if not done:
            return [b""] * len(words)
        symbols, owner = (np.concatenate(x) for x in zip(*done))
        raw = symbols[np.argsort(owner, kind="stable")].astype("<u4").tobytes()
        ends = 4 * np.cumsum(np.bincount(owner, minlength=len(words)))
        return [raw[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist())]

    def _merge_long(self, word: bytes) -> np.ndarray:
        data = np.frombuffer(word, dtype=np.uint8)
        symbols = self.inner[data]
        symbols[-1] = self.last[data[-1]]
        n = len(symbols)
        sym, nxt, prv = symbols.tolist(), list(range(1, n + 1)), list(range(-1, n - 1))
        rank, at = self._look_up(symbols[:-1], symbols[1:])
        heap = [(r, i, sym[i], sym[i + 1], a) for i, (r, a) in enumerate(zip(rank.tolist(), at.tolist())) if r < self.none]
        heapq.heapify(heap)
        gone = [False] * n

        def push(i: int) -> None:
            j = nxt[i]
            if i >= 0 and j < n:
                key = sym[i] * self.base + sym[j]
                a = int(np.searchsorted(self.keys, key))
                if a < len(self.keys) and self.keys[a] == key:
                    heapq.heappush(heap, (int(self.rank[a]), i, sym[i], sym[j], a))

        while heap:
            _, i, left, right, a = heapq.heappop(heap)
            j = nxt[i]
            if gone[i] or j >= n or sym[i] != left or sym[j] != right:
                continue
            sym[i], gone[j], nxt[i] = int(self.made[a]), True, nxt[j]
            if nxt[j] < n:
                prv[nxt[j]] = i
            push(i)
            if prv[i] >= 0:
                push(prv[i])
        return np.array([s for s, g in zip(sym, gone) if not g], dtype=np.int64)

    def learn(self, pieces: list[bytes]) -> None:
        """Encode new pieces together and remember them."""
        find, normal = self.words.findall, self.normalise
        cut = [find(normal(p.decode("utf-8", "replace"))) for p in pieces]
        known = self.known
        new = {w for ws in cut for w in ws} - known.keys()
        if len(known) + len(new) > CACHE_WORDS:
            known.clear()
            new = {w for ws in cut for w in ws}
        words = list(new)
        for w, raw in zip(words, self.merge_words([w.encode() for w in words])):
            known[w] = (raw, self.decode(memoryview(raw).cast("I")).encode())
        remember, held = self.pieces, 0
        for p, ws in zip(pieces, cut):
            if len(ws) == 1:
                x = known[ws[0]]
            else:
                both = [known[w] for w in ws]
                x = (b"".join([a for a, _ in both]), b" ".join([b for _, b in both]))
            remember[p] = x
            held += len(p) + len(x[0]) + len(x[1])
        self.held += held

    def decode(self, ids: Iterable[int]) -> str:
        """The text of ids: without a decoder in the file, symbols joined by spaces."""
        return " ".join([self.names[i] for i in ids])

    def encode_batch(self, texts: list[bytes]) -> list[tuple[bytes, bytes]]:
        """For each text its ids as little-endian unsigned 32-bit integers, and the
        decoded text of those ids in UTF-8."""
        cut = [self._pieces(t) for t in texts]
        needed = {p for ps in cut for p in ps if p.__class__ is bytes}
        new = needed - self.pieces.keys()
        if len(self.pieces) + len(new) > CACHE_PIECES or self.held > CACHE_BYTES:
            self.pieces.clear()
            self.held, new = 0, needed
        if new:
            self.learn(list(new))
        seen = self.pieces
        out = []
        for ps in cut:
            found = [seen[p] if p.__class__ is bytes else p for p in ps]
            out.append((b"".join([x[0] for x in found]), b" ".join([x[1] for x in found if x[1]])))
        return out

    def _pieces(self, text: bytes) -> list:
        if self.specials is None or b"<|" not in text:
            return text.split()
        out: list = []
        at = 0
        whole = text.decode("utf-8", "replace")
        for m in self.specials.finditer(whole):
            out += whole[at : m.start()].encode().split()
            out.append((np.array([self.special[m[0]]], "<u4").tobytes(), m[0].encode()))
            at = m.end()
        return out + whole[at:].encode().split()


_codecs: dict[str, WordBpe] = remembered(__name__)


def codec(name: str) -> WordBpe:
    """One codec for each worker process and vocabulary."""
    if name not in _codecs:
        _codecs[name] = WordBpe(vocabulary_path(name))
    return _codecs[name]


def encode_documents(docs: DataFrame, vocabulary: str = VOCABULARY, emit: str = "ids") -> DataFrame:
    """Encode and decode ``text`` of each row.

    emit="ids": doc_id, ids array<int>, decoded string.
    emit="training": doc_id, n_tokens, ids, decoded_sha256.
    emit="digest": doc_id, n_tokens, ids_sha256, decoded_sha256 of the same values.
    Other columns, whatever their names, don't pass through."""
    kinds = {"ids": "doc_id long, ids array<int>, decoded string", "training": "doc_id long, n_tokens long, ids array<int>, decoded_sha256 string", "digest": "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"}
    schema = kinds[emit]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = codec(vocabulary)
        for whole in batches:
            for part in slices(whole):
                both = bpe.encode_batch(byte_list(part))
                if emit == "digest":
                    cols = [pa.array([len(a) // 4 for a, _ in both], pa.int64()), pa.array([hashlib.sha256(a).hexdigest() for a, _ in both]), pa.array([hashlib.sha256(b).hexdigest() for _, b in both])]
                    names = ["n_tokens", "ids_sha256", "decoded_sha256"]
                elif emit == "training":
                    sizes = np.array([len(a) // 4 for a, _ in both], dtype=np.int64)
                    ids = ragged(np.frombuffer(b"".join([a for a, _ in both]), "<u4").astype(np.int32), sizes, pa.int32())
                    cols = [pa.array(sizes), ids, pa.array([hashlib.sha256(b).hexdigest() for _, b in both])]
                    names = ["n_tokens", "ids", "decoded_sha256"]
                else:
                    cols = [pa.array([np.frombuffer(a, "<u4").astype(np.int32) for a, _ in both], pa.list_(pa.int32())), pa.array([b.decode() for _, b in both], pa.string())]
                    names = ["ids", "decoded"]
                yield pa.RecordBatch.from_arrays([part.column(0), *cols], ["doc_id", *names])
        bpe.clear()  # the pieces of a task's texts are learned soon; idle workers needn't hold them

    return map_batches(docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"]), run, schema)


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text of documents through the codec; digests of ids and decoded text."""
    return encode_documents(table(spark, sf_dir, "documents"), emit="digest")
