"""Operator 13: near duplicates by min-max hashing of two-word shingles.

A document is the set of its distinct shingles (64-bit hashes under a key drawn for each
run, so that no text can be written to collide). Each of ROWS * GROUPS permutations, a
keyed bijection of 64-bit words, is evaluated once for each shingle, and both its minimum
and its maximum over the set are kept. Either agrees for two sets with the probability of
their similarity s, so the agreeing part of a signature estimates s without bias; minimum
and maximum are never the same shingle of a set of two or more, so they agree together with
less than s * s and the estimate varies less than that of as many minima. For the same
number of values, half as many hashes are computed.

Bands: the minima of a group of ROWS permutations are one band, their maxima another. Two
sets share a given band with s^ROWS, and miss both of a group with at most (1 - s^ROWS)^2.
At s = 0.8 all 2 * GROUPS bands are missed with at most (1 - 0.8^6)^70 = 6e-10, and less
above: that is the chance that a link is lost that no other member of its group carries.

Equal sets are one class from the start. A band value that several classes have makes a
bucket, found by an aggregation and a join (both split where a value is hot), and bands of
the same classes are one bucket. The hub of a bucket is the member that stands in the
most and largest buckets: in a group of edited copies that is the text they were made of,
or one near it, which all may link with. A class is first tried against the hub that it
shares most bands with; buckets that still span several components are then compared
across them in blocks, as in operator 3. Parity sketches of whole sets reject what can't link, and
every link is confirmed on the whole sets.

Nulls and texts without words have the empty set and are linked with nothing; fewer than
two words are one shingle, the whole sequence. Rows of equal or null doc_id are rows of
their own; the smallest of a group without any doc_id is null. No rows give no rows.
"""

from __future__ import annotations

import secrets
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.llm.common import byte_list, map_batches, maybe_broadcast, mix, seeded, slices, stage, table
from brindle.llm.jaccard import BLOCK, Rule, _texts, bit_sketch, gram_sets, labelled, set_key, settle

#: Link from 100 * intersection >= 80 * union on; permutations of a band, pairs of bands.
RULE = Rule(words=2, numerator=4, denominator=5)
ROWS, GROUPS = 6, 35
#: Bits of a sketch at least, and for each shingle: almost only what links passes them.
SKETCH_BITS, SKETCH_SPREAD = 512, 4

_U = np.uint64
_ODD = _U(0x9E3779B97F4A7C15)


def permuted(x: np.ndarray, seeds: np.ndarray, out: np.ndarray, part: np.ndarray) -> np.ndarray:
    """``x`` under the bijection of two seeds, in ``out``."""
    np.bitwise_xor(x, seeds[0], out=out)
    np.multiply(out, seeds[1] | _U(1), out=out)
    np.right_shift(out, _U(32), out=part)
    np.bitwise_xor(out, part, out=out)
    return np.multiply(out, _ODD, out=out)


def signatures(sets: list[np.ndarray], permutations: int, key: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Minima and maxima, a row for each set that isn't empty, a column for each permutation."""
    flat, starts = np.concatenate(sets), np.concatenate(([0], np.cumsum([len(s) for s in sets])[:-1]))
    seeds = seeded(2 * permutations, 73 + (key & 0xFFFFFFFF)).reshape(-1, 2)
    low, high = (np.empty((len(sets), permutations), dtype=_U) for _ in range(2))
    out, part = np.empty_like(flat), np.empty_like(flat)
    with np.errstate(over="ignore"):
        for j in range(permutations):
            h = permuted(flat, seeds[j], out, part)
            low[:, j] = np.minimum.reduceat(h, starts)
            high[:, j] = np.maximum.reduceat(h, starts)
    return low, high


def bands(low: np.ndarray, high: np.ndarray, rows: int = ROWS) -> np.ndarray:
    """A 64-bit value for each band: of the minima of each group, then of the maxima."""
    n, groups = len(low), low.shape[1] // rows
    out = np.empty((n, 2 * groups), dtype=_U)
    with np.errstate(over="ignore"):
        for side, values in enumerate((low, high)):
            grouped = values[:, : groups * rows].reshape(n, groups, rows)
            band = np.broadcast_to(seeded(2 * groups, 71)[side * groups : (side + 1) * groups], (n, groups)).copy()
            for r in range(rows):
                band = mix(band * _ODD + grouped[:, :, r])
            out[:, side * groups : (side + 1) * groups] = band
    return out


def estimated(one: tuple[np.ndarray, np.ndarray], other: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The similarity of the sets of two signatures, row by row, without bias."""
    return ((one[0] == other[0]).mean(axis=1) + (one[1] == other[1]).mean(axis=1)) / 2


def summaries(docs: DataFrame, key: int = 0, rule: Rule = RULE, rows: int = ROWS, groups: int = GROUPS) -> DataFrame:
    """doc_id, n, key of each row; sketch and bands once for each class in a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()  # of a task, which reads one split of the input
        for whole in batches:
            for part in slices(whole):
                sets = gram_sets(byte_list(part), rule.words, key)
                keys = [set_key(s) for s in sets]
                fresh = []
                for i, (k, s) in enumerate(zip(keys, sets)):
                    if len(s) and k not in seen:
                        seen.add(k)
                        fresh.append(i)
                sketch: list = [None] * len(sets)
                lanes: list = [None] * len(sets)
                if fresh:
                    for i, own in zip(fresh, bands(*signatures([sets[i] for i in fresh], rows * groups, key), rows).view(np.int64)):
                        sketch[i], lanes[i] = bit_sketch(sets[i], SKETCH_BITS, SKETCH_SPREAD), own
                longs = pa.list_(pa.int64())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(keys, pa.int64()), pa.array(sketch, longs), pa.array(lanes, longs)], ["doc_id", "n", "key", "sketch", "bands"])

    return map_batches(_texts(docs), run, "doc_id long, n long, key long, sketch array<long>, bands array<long>")


def buckets(rows: DataFrame) -> DataFrame:
    """bucket, key, lanes, many: of the bands (lane, key) that several classes have, those of
    the same classes as one bucket, with how many bands it stands for and how many classes."""
    mark = F.pmod(F.xxhash64("key"), F.lit(1 << 31))
    hot = rows.groupBy("lane").agg(F.min("key").alias("least"), F.count("*").alias("many"), F.sum(mark).alias("marks"), F.expr("bit_xor(xxhash64(key, 7L))").alias("others"))
    hot = hot.where("many > 1").select("lane", "many", F.xxhash64("least", "many", "marks", "others").alias("bucket"))
    # Written first: a join of two shuffles is one that Spark splits where a lane is hot.
    hot = stage(hot, "shared", few=True)
    return rows.join(maybe_broadcast(hot, 32), "lane").groupBy("bucket", "key", "many").agg(F.count("*").alias("lanes"))


def partners(members: DataFrame) -> DataFrame:
    """a, b: of each class b the hub, of all its buckets, that it shares most bands with."""
    weights = members.groupBy("key").agg(F.sum(F.col("lanes") * F.col("many")).alias("weight"))
    weighed = members.join(maybe_broadcast(stage(weights, "weights", few=True), 32), "key")
    hubs = stage(weighed.groupBy("bucket").agg(F.max_by("key", F.struct("weight", "key")).alias("hub")), "hubs", few=True)
    ties = members.join(maybe_broadcast(hubs, 32), "bucket").where("key != hub").groupBy("key", "hub").agg(F.sum("lanes").alias("lanes"))
    best = ties.groupBy("key").agg(F.max_by("hub", F.struct("lanes", "hub")).alias("hub"))
    return best.select(F.col("hub").alias("a"), F.col("key").alias("b"))


def link(docs: DataFrame, rule: Rule = RULE, rows: int = ROWS, groups: int = GROUPS, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """(rows, found): doc_id, n, key of each document, and node, component of classes
    that are linked with another."""
    key = secrets.randbits(63)
    both = stage(summaries(docs, key, rule, rows, groups), "summaries")
    each = both.where("n > 0").groupBy("key").agg(F.min("doc_id").alias("doc_id"), F.first("n").alias("n"), F.first("sketch", ignorenulls=True).alias("sketch"), F.first("bands", ignorenulls=True).alias("bands"))
    classes = stage(each, "classes")
    members = stage(buckets(classes.select(F.explode("bands").alias("lane"), "key")), "members", few=True)
    return both.select("doc_id", "n", "key"), settle(partners(members), members, docs, classes.drop("bands"), key, block, rule)


def near_duplicates(docs: DataFrame, rule: Rule = RULE, rows: int = ROWS, groups: int = GROUPS, block: int = BLOCK) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id of its group) and kept (whether it
    is that one) of each row. ``rows`` and ``groups`` set the chance of a lost link."""
    found = labelled(*link(docs, rule, rows, groups, block))
    return found.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def op13_minmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of near duplicates of all documents."""
    return near_duplicates(table(spark, sf_dir, "documents"))
