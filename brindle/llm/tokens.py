"""Operator 2: token ids in a content-addressed store.

``write_store`` encodes each text with the tokenizers library, appends an end id,
and cuts the ids into chunks where a rolling hash over a few ids meets a mask, so
that equal passages give equal chunks. The store has three Parquet tables:

* ``chunks``: hash (BLAKE2b of the bytes), n, ids (little-endian unsigned integers,
  16 bits where the vocabulary allows it). Each distinct chunk is stored once.
* ``recipes``: doc_id, start (ids of all documents before it), n_tokens, the hashes
  of its chunks in order, root (Merkle root over them); files in ascending doc_id.
* ``manifest``: for each run of documents its first and last doc_id, counts, and the
  Merkle root over the roots of its documents.

``read_store`` rebuilds ids from the files; ``read_digests`` checks every chunk
against its hash and every recipe against its root and gives per-document digests,
combining the CRCs of chunks, so that chunk bytes don't move twice.

Null and empty texts are one end id. A null doc_id comes last. Repeated rows are
documents of their own. Encoding doesn't shuffle; chunks shuffle once, by hash,
after repeats in a task are dropped; ids and offsets go by doc_id ranges.
"""

from __future__ import annotations

import hashlib
import math
import os
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from brindle.llm.common import byte_list, equal_words, hash_words, map_batches, remembered, seeded, slices, stage, stage_path, table, vocabulary_path

VOCABULARY = "byte_bpe_50k.json"
END_ID = 2
#: Chunk lengths in ids: least, mean beyond that, most; ids under the rolling hash.
LEAST, MEAN, MOST, REACH = 64, 512, 4096, 8
#: Distinct pieces that a worker remembers (about 40 bytes each).
CACHE_PIECES = 1_500_000
#: Pieces that go to the library as one text.
JOINED = 64
#: Documents in a range of doc_id (a manifest row), and ranges at most.
RANGE_DOCS, MOST_RANGES = 50_000, 4096
#: Documents whose roots meet in one row.
RUN_DOCS = 4096

_GEAR = seeded(1 << 16, 23)


class ByteBpe:
    """The tokenizers library behind a table of distinct pieces.

    The pre-tokenizer of a byte-level file never joins characters across a single
    space or line end before a visible character, so a text may be cut there; a piece
    is a word and the one separator before it. Pieces are looked up by 64-bit hashes in
    a sorted table, all of a slice at once, and their bytes are compared; only new ones go
    to the library. Texts with other white space, with special tokens or with a piece that
    has another's hash go to it whole."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # the task has one core
        import tokenizers

        self.library = tokenizers.Tokenizer.from_file(path)
        self.special = [t.content.encode() for t in self.library.get_added_tokens_decoder().values()]
        names = self.library.get_vocab()
        self.wide = self.library.get_vocab_size() > 1 << 16
        # By separator: which ids begin with it, as byte-level files write it.
        self.begins = np.zeros((len(LEADS), 1 + max(names.values())), dtype=bool)
        for name, i in names.items():
            self.begins[1, i], self.begins[2, i] = name.startswith("Ġ"), name.startswith("Ċ")
        self.clear()

    def clear(self) -> None:
        self.keys = np.zeros(0, np.uint64)
        self.at = np.zeros(0, np.int64)
        self.size = np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.uint32)
        self.word = np.zeros(0, np.int64)  # where the bytes of a piece's word are
        self.word_end = np.zeros(0, np.int64)
        self.lead = np.zeros(0, np.int64)
        self.raw = np.zeros(16, np.uint8)  # bytes of words, and 16 more

    def whole(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _pieces(self, words: list[bytes], lead: int) -> tuple[np.ndarray, np.ndarray]:
        """How many ids each of some pieces with one separator has, and the ids joined.

        JOINED pieces go to the library as one text, at the cost of the merges alone; an id
        that begins with the separator begins a piece. Where a text has not as many of these
        as pieces (white space beyond ASCII beside a separator), each piece goes alone."""
        texts = [(LEADS[lead] + w).decode("utf-8", "replace") for w in words]
        runs = [texts[i : i + JOINED] for i in range(0, len(texts), JOINED)]
        if lead:
            ids, ends = _flat(self.whole(["".join(r) for r in runs]))
            at = np.flatnonzero(self.begins[lead][ids])
            if np.array_equal(np.searchsorted(at, ends), np.cumsum([len(r) for r in runs])):
                return np.diff(at, append=len(ids)), ids
        ids, ends = _flat(self.whole(texts))
        return np.diff(ends, prepend=0), ids

    def _learn(self, keys: np.ndarray, words: list[bytes], leads: np.ndarray) -> None:
        order = np.argsort(leads, kind="stable")
        keys, leads, words = keys[order], leads[order], [words[i] for i in order.tolist()]
        ends = np.searchsorted(leads, np.arange(len(LEADS) + 1))
        found = [self._pieces(words[ends[k] : ends[k + 1]], k) for k in range(len(LEADS))]
        size, ids = (np.concatenate(x) for x in zip(*found))
        length = np.fromiter((len(w) for w in words), dtype=np.int64, count=len(words))
        word = len(self.raw) - 16 + np.cumsum(length) - length
        self.raw = np.frombuffer(self.raw[:-16].tobytes() + b"".join(words) + bytes(16), dtype=np.uint8)
        at = len(self.ids) + np.cumsum(size) - size
        keys = np.concatenate((self.keys, keys))
        order = np.argsort(keys, kind="stable")
        self.keys = keys[order]
        self.at, self.size = np.concatenate((self.at, at))[order], np.concatenate((self.size, size))[order]
        self.word, self.word_end = np.concatenate((self.word, word))[order], np.concatenate((self.word_end, word + length))[order]
        self.lead = np.concatenate((self.lead, leads))[order]
        self.ids = np.concatenate((self.ids, ids))

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of some texts joined (unsigned 32-bit), and how many each text has."""
        h, firsts, starts, ends, data = hash_words(texts)
        sizes = np.fromiter((len(t) for t in texts), dtype=np.int64, count=len(texts))
        begins = np.cumsum(sizes + 1) - sizes - 1
        odd = np.array([any(s in t for s in self.special) for t in texts], dtype=bool)
        kind = np.zeros(len(h), np.int64)  # 0: starts a text, 1: after a space, 2: after a line end
        if len(h):
            text_of = np.repeat(np.arange(len(texts)), np.diff(firsts))
            before = data[starts - 1]  # of the first word: any byte
            kind = np.where(before == 32, 1, 2)
            lead = np.zeros(len(h), bool)
            lead[firsts[:-1][np.diff(firsts) > 0]] = True
            kind[lead] = 0
            gap = np.concatenate(([1], starts[1:] - ends[:-1]))
            wrong = ~lead & ((gap != 1) | ((before != 32) & (before != 10))) | _ODD_START[data[starts]] | lead & (starts != begins[text_of])
            last = firsts[1:][np.diff(firsts) > 0] - 1
            wrong[last] |= ends[last] != (begins + sizes)[text_of[last]]
            odd[text_of[wrong]] = True
        odd |= (np.diff(firsts) == 0) & (sizes > 0)
        key, example, inverse = np.unique(h ^ _KIND[kind], return_index=True, return_inverse=True)
        slot = self._slots(key)
        new = np.flatnonzero(slot < 0)
        if len(new):
            if len(self.keys) + len(new) > CACHE_PIECES:
                self.clear()
                new = np.arange(len(key))
            raw, w = data.tobytes(), example[new]
            self._learn(key[new], [raw[a:b] for a, b in zip(starts[w].tolist(), ends[w].tolist())], kind[w])
            slot = self._slots(key)
        # A piece must be the one that its hash has found, first among those of the slice.
        same = equal_words(data, starts, ends, data, starts[example][inverse], ends[example][inverse]) & (kind == kind[example][inverse])
        held = equal_words(data, starts[example], ends[example], self.raw, self.word[slot], self.word_end[slot]) & (kind[example] == self.lead[slot])
        if len(h):
            odd[text_of[~(same & held[inverse])]] = True
        slot = slot[inverse]
        size, at = self.size[slot], self.at[slot]
        total = np.concatenate(([0], np.cumsum(size)))
        ids = self.ids[np.repeat(at - total[:-1], size) + np.arange(total[-1])]
        counts = np.diff(total[firsts])
        if odd.any():
            cut = total[firsts].tolist()
            parts = [ids[a:b] for a, b in zip(cut, cut[1:])]
            which = np.flatnonzero(odd).tolist()
            for i, x in zip(which, self.whole([texts[i].decode("utf-8", "replace") for i in which])):
                parts[i] = np.array(x, dtype=np.uint32)
                counts[i] = len(x)
            ids = np.concatenate(parts)
        return ids, counts

    def _slots(self, key: np.ndarray) -> np.ndarray:
        """Where keys are in the table, -1 if nowhere."""
        if not len(self.keys):
            return np.full(len(key), -1)
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, at, -1)


#: First bytes of a word that may belong to white space beyond ASCII, or to controls
#: that a pattern may take for it.
_ODD_START = np.zeros(256, dtype=bool)
_ODD_START[[*range(0x20), 0x7F, 0xC2, 0xE1, 0xE2, 0xE3]] = True
_KIND = seeded(3, 29)
#: What stands before a word: nothing, a space, a line end.
LEADS = (b"", b" ", b"\n")


def _flat(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """Lists of ids joined, and where each ends."""
    ends = np.cumsum([len(x) for x in lists], dtype=np.int64)
    return np.fromiter(chain.from_iterable(lists), dtype=np.uint32, count=int(ends[-1]) if len(ends) else 0), ends


_encoders: dict[str, ByteBpe] = remembered(__name__)


def encoder(name: str) -> ByteBpe:
    if name not in _encoders:
        _encoders[name] = ByteBpe(vocabulary_path(name))
    return _encoders[name]


def cut_points(ids: np.ndarray, sizes: np.ndarray) -> list[np.ndarray]:
    """Ends of the chunks of each document in joined ids; documents of no ids have none.

    Marks within LEAST ids of a chunk's start are skipped, so the hash never reaches
    back over a document's start and equal documents are cut alike."""
    gear = _GEAR[ids & 0xFFFF]
    rolled = gear.copy()
    with np.errstate(over="ignore"):
        for k in range(1, REACH):
            rolled[k:] += gear[:-k] << np.uint64(5 * k)
    marks = np.flatnonzero((rolled >> np.uint64(40)) % np.uint64(MEAN) == 0) + 1
    out, begin = [], 0
    for n in sizes.tolist():
        end, at, ends = begin + n, begin, []
        for m in marks[np.searchsorted(marks, begin, "right") : np.searchsorted(marks, end, "left")].tolist():
            while m - at > MOST:
                at += MOST
                ends.append(at)
            if m - at >= LEAST:
                at = m
                ends.append(at)
        while end - at > MOST:
            at += MOST
            ends.append(at)
        if end > at:
            ends.append(end)
        out.append(np.array(ends, dtype=np.int64))
        begin = end
    return out


def merkle(leaves: list[bytes]) -> bytes:
    """Merkle root: pairs hashed level by level, an odd one moves up; no leaf: zeros."""
    level = leaves or [bytes(16)]
    while len(level) > 1:
        level = [hashlib.blake2b(b"".join(level[i : i + 2]), digest_size=16).digest() if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
    return level[0]


def encode_chunks(docs: DataFrame, vocabulary: str = VOCABULARY, end_id: int = END_ID) -> DataFrame:
    """doc_id, n_tokens, root, hashes, sizes and fresh: the bytes of those chunks that
    this task hasn't put out before (null otherwise)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(vocabulary)
        kind = "<u4" if bpe.wide else "<u2"
        given: set[bytes] = set()
        for whole in batches:
            for part in slices(whole, limit=2 << 20):
                plain, counts = bpe.encode(byte_list(part))
                sizes = counts + 1
                ids = np.full(int(sizes.sum()), end_id, dtype=np.uint32)
                inside = np.ones(len(ids), bool)
                inside[np.cumsum(sizes) - 1] = False
                ids[inside] = plain
                packed = memoryview(ids.astype(kind).tobytes())
                width = 4 if bpe.wide else 2
                cols: list[list] = [[], [], [], []]
                begin = 0
                for n, ends in zip(sizes.tolist(), cut_points(ids, sizes)):
                    edges = [begin, *ends.tolist()]
                    parts = [bytes(packed[a * width : b * width]) for a, b in zip(edges, edges[1:])]
                    hashes = [hashlib.blake2b(x, digest_size=16).digest() for x in parts]
                    fresh = []
                    for h, x in zip(hashes, parts):
                        fresh.append(None if h in given else x)
                        if len(given) < 1 << 18:  # bounded; a chunk given twice is dropped later
                            given.add(h)
                    for c, v in zip(cols, (merkle(hashes), hashes, np.diff(edges).astype(np.int32), fresh)):
                        c.append(v)
                    begin += n
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(sizes), pa.array(cols[0], pa.binary()), pa.array(cols[1], pa.list_(pa.binary())), pa.array(cols[2], pa.list_(pa.int32())), pa.array(cols[3], pa.list_(pa.binary()))],
                    ["doc_id", "n_tokens", "root", "hashes", "sizes", "fresh"],
                )

    schema = "doc_id long, n_tokens long, root binary, hashes array<binary>, sizes array<int>, fresh array<binary>"
    return map_batches(docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"]), run, schema)


def id_ranges(rows: DataFrame, per_range: int = RANGE_DOCS, most: int = MOST_RANGES) -> tuple[Column, int]:
    """The number of the doc_id range that a row is in, ascending, null last; how many.

    Bounds come from quantiles of doc_id; only those (at most ``most``) reach the driver."""
    n = max(1, min(most, -(-rows.count() // per_range)))
    bounds = sorted(set(rows.where("doc_id IS NOT NULL").stat.approxQuantile("doc_id", [i / n for i in range(1, n)], 0.1 / n))) if n > 1 else []
    return F.when(F.col("doc_id").isNull(), F.lit(len(bounds))).otherwise(place_of(F.col("doc_id"), [int(b) for b in bounds])).cast("int"), len(bounds) + 1


def place_of(value: Column, bounds: list[int]) -> Column:
    """How many of the sorted bounds are under a value, looked up in two steps: in every
    so many-th bound, then in the run that follows it."""
    if not bounds:
        return F.lit(0)
    step = max(1, math.isqrt(len(bounds)))
    longs = lambda xs: F.array(*[F.lit(x).cast("long") for x in xs]) if xs else F.array().cast("array<bigint>")
    under = lambda some: F.size(F.filter(some, lambda b: b < value))
    coarse = under(longs(bounds[step - 1 :: step]))
    runs = F.array(*[longs(bounds[a : a + step]) for a in range(0, len(bounds) + step, step)])
    return coarse * step + under(F.get(runs, coarse))


def write_store(docs: DataFrame, path: str, vocabulary: str = VOCABULARY, end_id: int = END_ID) -> str:
    """Write documents to a store under ``path`` (any file system of Spark)."""
    spark = docs.sparkSession
    coded = stage(encode_chunks(docs, vocabulary, end_id), "ids")
    chunks = coded.select(F.explode(F.arrays_zip("hashes", "sizes", "fresh")).alias("c")).where("c.fresh IS NOT NULL")
    chunks = chunks.select(F.col("c.hashes").alias("hash"), F.col("c.sizes").alias("n"), F.col("c.fresh").alias("ids"))
    # Tasks have dropped their own repeats; dealt out first, rows aren't sorted before the shuffle.
    chunks.repartition("hash").dropDuplicates(["hash"]).write.option("compression", "zstd").parquet(f"{path}/chunks")
    part, n_parts = id_ranges(coded.select("doc_id"))
    rows = coded.select("doc_id", "n_tokens", "hashes", "root", part.alias("part"))
    totals = {r["part"]: r["n"] for r in rows.groupBy("part").agg(F.sum("n_tokens").alias("n")).collect()}  # at most MOST_RANGES rows
    before, at = [], 0
    for p in range(n_parts):
        before.append(at)
        at += totals.get(p, 0)
    rows = rows.repartitionByRange(n_parts, "part")
    order = Window.partitionBy("part").orderBy(F.col("doc_id").asc_nulls_last(), "root")
    start = F.coalesce(F.sum("n_tokens").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) + F.get(F.array(*[F.lit(b).cast("long") for b in before]), F.col("part"))
    place = (F.row_number().over(order) - 1).cast("long")
    rows.select("doc_id", start.cast("long").alias("start"), "n_tokens", "hashes", "root", "part", place.alias("place")).write.option("compression", "zstd").parquet(f"{path}/recipes")
    manifest(spark.read.parquet(f"{path}/recipes")).write.option("compression", "zstd").parquet(f"{path}/manifest")
    return path


def manifest(recipes: DataFrame) -> DataFrame:
    """part, first and last doc_id, documents, tokens, Merkle root of each part.

    The tree of a part is cut: its documents in order, RUN_DOCS at a time, have a root
    each, and the part's is over those. So RUN_DOCS roots meet in a row, and of a part of any
    size one for RUN_DOCS documents."""
    run = F.floor(F.col("place") / RUN_DOCS).cast("long")
    figures = lambda docs: [F.min("first_doc").alias("first_doc"), F.max("last_doc").alias("last_doc"), F.sum(docs).alias("n_docs"), F.sum("n_tokens").alias("n_tokens"), F.array_sort(F.collect_list(F.struct("place", "root"))).alias("rows")]
    one = recipes.select("part", run.alias("run"), "place", "root", "n_tokens", F.col("doc_id").alias("first_doc"), F.col("doc_id").alias("last_doc"), F.lit(1).cast("long").alias("n_docs"))
    runs = _roots(one.groupBy("part", "run").agg(*figures("n_docs")), "part int, run long")
    return _roots(runs.withColumnRenamed("run", "place").groupBy("part").agg(*figures("n_docs")), "part int")


def _roots(rows: DataFrame, keys: str) -> DataFrame:
    """``rows`` with the Merkle root of their lists ``rows`` (place, root)."""
    names = [k.split()[0] for k in keys.split(", ")] + ["first_doc", "last_doc", "n_docs", "n_tokens", "root"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            roots = [merkle([x["root"] for x in xs]) for xs in b.column(len(names) - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(names) - 1], pa.array(roots, pa.binary())], names)

    return map_batches(rows, run, f"{keys}, first_doc long, last_doc long, n_docs long, n_tokens long, root binary")


def _numbers(raw: bytes, n: int) -> np.ndarray:
    return np.frombuffer(raw, "<u2" if len(raw) == 2 * n else "<u4").astype("<u4")


def read_store(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, ids: every document rebuilt from its recipe and the chunks."""
    recipes = spark.read.parquet(f"{path}/recipes").select("doc_id", "start", F.posexplode("hashes").alias("seq", "hash"))
    parts = recipes.join(spark.read.parquet(f"{path}/chunks"), "hash")
    rows = parts.groupBy("doc_id", "start").agg(F.array_sort(F.collect_list(F.struct("seq", "n", "ids"))).alias("parts"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = [np.concatenate([_numbers(x["ids"], x["n"]) for x in xs]).astype(np.int64) for xs in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(ids, pa.list_(pa.int64()))], ["doc_id", "start", "ids"])

    return map_batches(rows, run, "doc_id long, start long, ids array<long>")


# CRC-32 of joined strings: crc(a + b) = crc(a) * x^(8 len(b)) + crc(b) over GF(2).
_POLY = 0xEDB88320


def _times(a: int, b: int) -> int:
    out = 0
    for i in range(31, -1, -1):
        if b >> i & 1:
            out ^= a
        a = (a >> 1) ^ (_POLY if a & 1 else 0)
    return out


_shift: dict[int, int] = {0: 1 << 31}


def _shift_by(n_bytes: int) -> int:
    """x^(8 n) modulo the polynomial (bits reflected)."""
    if n_bytes not in _shift:
        out, power, n = 1 << 31, 1 << 23, n_bytes
        while n:
            if n & 1:
                out = _times(out, power)
            power, n = _times(power, power), n >> 1
        if len(_shift) < 1 << 16:
            _shift[n_bytes] = out
        return out
    return _shift[n_bytes]


def crc_joined(parts: list[tuple[int, int]]) -> int:
    """CRC-32 of strings with given (CRC, length), joined."""
    out = 0
    for crc, n in parts:
        out = _times(out, _shift_by(n)) ^ crc if out else crc
    return out


def read_digests(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 and verified, from the files of a store.

    verified: every chunk has the bytes its hash names, and the root and the number of
    ids of the recipe follow from its chunks."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in slices(b, "ids", 8 << 20):
                hashes, ns, raws = (part.column(i).to_pylist() for i in range(3))
                crc = [zlib.crc32(_numbers(r, n).tobytes()) for r, n in zip(raws, ns)]
                right = [hashlib.blake2b(r, digest_size=16).digest() == h for h, r in zip(hashes, raws)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(crc, pa.int64()), pa.array(right)], ["hash", "n", "crc", "right"])

    chunks = map_batches(spark.read.parquet(f"{path}/chunks"), check, "hash binary, n int, crc long, right boolean")
    recipes = spark.read.parquet(f"{path}/recipes")
    parts = recipes.select("doc_id", "start", "n_tokens", "root", F.posexplode("hashes").alias("seq", "hash")).join(chunks, "hash", "left")
    rows = parts.groupBy("doc_id", "start").agg(F.first("n_tokens").alias("n_tokens"), F.first("root").alias("root"), F.array_sort(F.collect_list(F.struct("seq", "n", "crc", "right", "hash"))).alias("parts"))

    def combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            crcs, right = [], []
            parts = b.column(4)
            ends = np.cumsum(pc.list_value_length(parts).to_numpy()).tolist()
            ns, crc, sound, hashes = (x.to_pylist() for x in parts.flatten().flatten()[1:])  # after seq
            for n, root, i, j in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), [0, *ends], ends):
                whole = all(sound[i:j])
                crcs.append(crc_joined([(c, 4 * k) for c, k in zip(crc[i:j], ns[i:j])]) if whole else None)
                right.append(whole and sum(ns[i:j]) == n and merkle(hashes[i:j]) == root)
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(crcs, pa.int64()), pa.array(right, pa.bool_())], ["doc_id", "start", "n_tokens", "ids_crc32", "verified"])

    return map_batches(rows, combine, "doc_id long, start long, n_tokens long, ids_crc32 long, verified boolean")


def op2_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents written to a store and read back: one row for each document."""
    path = write_store(table(spark, sf_dir, "documents"), stage_path(spark, "store"))
    return read_digests(spark, path)
