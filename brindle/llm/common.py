"""Shared parts of the training-data operators: staging, bounded batches, hashing.

Nothing here swallows errors or keeps state on a machine-local disk of a cluster.
"""

from __future__ import annotations

import ctypes
import gc
import hashlib
import threading
import uuid
from collections.abc import Callable, Iterator
from functools import wraps

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.sources.order import checkpoint_dir

#: Characters that separate words in every contract of this subpackage.
SPACES = b" \t\n\x0b\x0c\r"
#: Text bytes that a Python worker turns into arrays at one time.
SLICE_BYTES = 1 << 20
#: Bytes of a batch that goes to a Python worker (a longer text is a batch of its own).
BATCH_SETTING, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 2 << 20
#: A side of a join is broadcast only after its measured size is under this.
BROADCAST_BYTES = 16 << 20

_U = np.uint64


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``.

    Only where it is unset and all tasks run in this process (tests on one machine) a
    temporary folder is made; on a cluster each machine would write to its own disk."""
    return checkpoint_dir(spark)


_LOCAL = threading.local()


def staged() -> list[str]:
    """Folders that ``stage`` has written in this thread, in order."""
    if not hasattr(_LOCAL, "folders"):
        _LOCAL.folders = []
    return _LOCAL.folders


#: What a Python worker remembers from task to task, by module.
_REMEMBERED: dict[str, dict] = {}


def remembered(module: str) -> dict:
    """A table that a worker keeps for the tasks of a module's operators."""
    return _REMEMBERED.setdefault(module, {})


def forget(but: str) -> None:
    """Drop what is remembered for other modules than ``but``: a worker stays for the tasks of
    later stages, whose memory it would take."""
    others = [kept for module, kept in _REMEMBERED.items() if module != but and kept]
    for kept in others:
        kept.clear()
    if others:
        gc.collect()
        trim()


def trim() -> None:
    """Freed memory goes back to the system, where the C library can do that."""
    if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
        libc.malloc_trim(0)


def map_batches(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """mapInArrow with batches of bounded bytes. Where the session leaves the bound to
    the number of rows, 10,000 long texts would be gigabytes, so it is set for it."""
    if df.sparkSession.conf.get(BATCH_SETTING, None) is None:
        df.sparkSession.conf.set(BATCH_SETTING, str(BATCH_BYTES))

    @wraps(run)
    def freed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget(run.__module__)
        yield from run(batches)
        pa.default_memory_pool().release_unused()  # a worker stays for the next tasks
        trim()

    return df.mapInArrow(freed, schema)


def stage(df: DataFrame, name: str, few: bool = False) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: the lineage ends here,
    and a lost executor costs at most the tasks it was running. ``release`` deletes.
    ``few``: rows without texts, so that two tasks for each core, which take the
    partitions before them one after another, are enough, and files don't get tiny."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    if few:
        df = df.coalesce(2 * df.sparkSession.sparkContext.defaultParallelism)
    df.write.option("compression", "zstd").parquet(path)
    staged().append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(spark: SparkSession, since: int, keep: int = 0) -> None:
    """Delete what ``stage`` has written after the first ``since`` folders, but for the
    last ``keep``. Only for a caller that has written all that is made from them."""
    folders = staged()
    gone = folders[since : len(folders) - keep]
    del folders[since : len(folders) - keep]
    for path in gone:
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def stage_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def maybe_broadcast(small: DataFrame, row_bytes: int = 64) -> DataFrame:
    """A broadcast hint if the (staged) rows, counted now, are under
    BROADCAST_BYTES; else the frame as it is, for a shuffled join."""
    return F.broadcast(small) if small.count() * row_bytes <= BROADCAST_BYTES else small


def held_out(doc_id: Column | str) -> Column:
    """Rows that no model may learn from: crc32(doc_id as text) mod 4 = 2."""
    col = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(col.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def word_count(text: Column | str) -> Column:
    """Words of a text: runs of other characters than space and U+0009-U+000D."""
    col = F.col(text) if isinstance(text, str) else text
    return F.coalesce(F.regexp_count(col, F.lit(r"[^\x20\x09-\x0D]++")), F.lit(0)).cast("long")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def slices(batch: pa.RecordBatch, text: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that a piece holds one row or at most ``limit`` bytes of text."""
    n = batch.num_rows
    if n == 0:
        return
    col = batch.column(batch.schema.get_field_index(text))
    sizes = np.asarray(pc.fill_null(pc.binary_length(col), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    total = np.cumsum(sizes)
    start = 0
    while start < n:
        base = total[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(total, base + limit, side="right")))
        yield batch.slice(start, end - start)
        start = end


def byte_list(batch: pa.RecordBatch, name: str = "text") -> list[bytes]:
    """A string column as UTF-8 bytes, null as empty."""
    col = batch.column(batch.schema.get_field_index(name)).cast(pa.binary())
    return [b"" if x is None else x for x in col.to_pylist()]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (public splitmix64 constants)."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def seeded(n: int, seed: int) -> np.ndarray:
    """n fixed pseudo-random 64-bit words."""
    with np.errstate(over="ignore"):
        return mix((np.arange(1, n + 1, dtype=_U) + _U(seed) * _U(0x10001)) * _U(0x9E3779B97F4A7C15))


_SPACE = np.zeros(256, dtype=bool)
_SPACE[list(SPACES)] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_LOWER_TABLE = _LOWER.tobytes()
#: The first 0 to 8 bytes of a little-endian 64-bit word.
_HEAD = np.array([(1 << (8 * k)) - 1 for k in range(9)], dtype=_U)
_STEP = seeded(3, 17) | _U(1)
#: Words of more bytes are hashed by BLAKE2b.
SHORT_WORD = 16


def chunks_of(raw: bytes) -> np.ndarray:
    """The 8 bytes from each place of ``raw``, as little-endian 64-bit words."""
    return np.ndarray((max(0, len(raw) - 7),), dtype="<u8", buffer=raw, strides=(1,))


def hash_words(texts: list[bytes], lower: bool = False, key: int = 0, separators: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All words of some texts, at once: (64-bit hashes, first word of each text
    plus the end, starts, ends, the joined bytes and 16 more).

    Each 8 bytes go through a finaliser that is a bijection, so words of up to 8 bytes
    and equal length never collide; longer ones do by chance. ``separators``: which bytes
    stand between words (the end of a line must be one). A ``key`` that the writer
    of a text can't know keeps collisions from being made on purpose."""
    sizes = np.fromiter((len(t) for t in texts), dtype=np.int64, count=len(texts))
    raw = b"\n".join(texts) + b"\n" + bytes(16)
    if lower:
        raw = raw.translate(_LOWER_TABLE)
    data = np.frombuffer(raw, dtype=np.uint8)
    begins = np.zeros(len(texts) + 1, dtype=np.int64)
    np.cumsum(sizes + 1, out=begins[1:])
    space = separators[data[: len(raw) - 16]]
    edge = np.flatnonzero(space[1:] != space[:-1]) + 1
    if not space[0]:
        edge = np.concatenate(([0], edge))
    starts, ends = edge[0::2], edge[1::2]
    if not len(starts):
        return np.zeros(0, _U), np.zeros(len(texts) + 1, np.int64), starts, ends, data
    length, at = ends - starts, chunks_of(raw)
    with np.errstate(over="ignore"):
        seed = mix(np.array([key & 0xFFFFFFFFFFFFFFFF], dtype=_U) + _STEP[0])
        h = mix((length.astype(_U) * _STEP[1]) ^ seed)
        h = mix(h ^ (at[starts] & _HEAD[np.minimum(length, 8)]))
        more = np.flatnonzero((length > 8) & (length <= SHORT_WORD))
        tail = at[starts[more] + 8] & _HEAD[length[more] - 8]
        h[more] = mix(h[more] * _STEP[2] + mix(tail ^ seed))
    long = np.flatnonzero(length > SHORT_WORD)
    if len(long):
        secret = seed.tobytes()
        h[long] = np.frombuffer(b"".join([hashlib.blake2b(raw[a:b], digest_size=8, key=secret).digest() for a, b in zip(starts[long].tolist(), ends[long].tolist())]), dtype="<u8")
    return h, np.searchsorted(starts, begins), starts, ends, data


def equal_words(one: np.ndarray, a: np.ndarray, a_end: np.ndarray, other: np.ndarray, b: np.ndarray, b_end: np.ndarray) -> np.ndarray:
    """Whether the bytes a..a_end of ``one`` are the bytes b..b_end of ``other``, pair by
    pair. Both arrays have at least 16 bytes beyond the last word."""
    length = a_end - a
    same = length == b_end - b
    raw, raw_other = one.tobytes(), other.tobytes()
    left, right = chunks_of(raw), chunks_of(raw_other)
    same &= ((left[a] ^ right[b]) & _HEAD[np.minimum(length, 8)]) == 0
    more = np.flatnonzero(same & (length > 8) & (length <= SHORT_WORD))
    same[more] = ((left[a[more] + 8] ^ right[b[more] + 8]) & _HEAD[length[more] - 8]) == 0
    for i in np.flatnonzero(same & (length > SHORT_WORD)).tolist():
        same[i] = raw[a[i] : a_end[i]] == raw_other[b[i] : b_end[i]]
    return same


def word_ids(h: np.ndarray, starts: np.ndarray, ends: np.ndarray, data: np.ndarray) -> np.ndarray:
    """A number for each word, equal exactly where the bytes of words are equal."""
    if not len(h):
        return np.zeros(0, np.int64)
    _, example, ids = np.unique(h, return_index=True, return_inverse=True)
    if not equal_words(data, starts, ends, data, starts[example][ids], ends[example][ids]).all():
        raw, known = data.tobytes(), {}
        ids = np.array([known.setdefault(raw[a:b], len(known)) for a, b in zip(starts.tolist(), ends.tolist())])
    return ids.astype(np.int64)


def ragged(values: np.ndarray, lengths: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    offsets = np.zeros(len(lengths) + 1, dtype=np.int32)
    np.cumsum(lengths, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, kind))


def vocabulary_path(name: str) -> str:
    """Where a vocabulary of the public tokenizer files lies on this machine; each
    executor asks its own installation, so no driver path is shipped."""
    import public_tokenizers

    return public_tokenizers.path(name)
