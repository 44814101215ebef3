"""Operator 3: documents joined by the Jaccard similarity of their word n-grams.

Parity sketches. A document is the set of its distinct n-grams (64-bit hashes). For a
band of set sizes the hash space is cut into parts; the XOR of the hashes that a set has
in a part is that part's lane of its sketch. Every n-gram in which two sets differ
disturbs one lane, so the number of lanes in which they differ is at most the size of
their symmetric difference. Sets of similarity t differ in at most (1-t)/(1+t) of their
joint size, say D, so of the lanes that a set has, all but D are found in its partner
too (pigeonhole). Hence, with lanes in any order that is the same for all documents, two
partners share a lane among the first D + 1 of each. The order is by rarity: lanes are
counted over all documents in a table of fixed size, so that what many documents share
(lines, passages) comes last and seldom joins anything.

Documents that share a lane are candidates. Equal sets are one class from the start, and
lanes of the same classes are one bucket, as are lanes of much the same classes with the
same first one (the hub), so that two near copies meet once and not in each lane they
share. A member of a bucket is first checked against
the one partner it shares most with, and links make components. A bucket that still spans
several components is compared across them: its members meet in blocks of bounded size and
of sizes that may link, where parity sketches of whole sets (their Hamming distance bounds
the symmetric difference too) reject almost all pairs; the rest are verified on the whole
sets; first a forest of pairs in each meeting, which joins large groups of near copies,
then all pairs that still cross. Pairs inside a component are never made: they can't
change it. No partner is dropped and no bucket is capped. Lanes that the counts show to be
frequent are dealt over several tasks by class.

Sets are compared as 64-bit hashes of n-grams under a key drawn for each run, so that no
text can be written to collide.

Bands: sizes below SMALL use n-grams themselves as lanes; a band spans a factor of 4,
and a set near the lower edge of its band also takes part in the one below.

Null and empty texts and texts without words have no n-grams and are linked with
nothing. With fewer words than n the whole sequence is the only n-gram. Repeated doc_ids
are documents of their own for the classes. Null doc_ids keep their rows and get the
component of their class, null if nothing else is in it.
"""

from __future__ import annotations

import secrets
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from brindle.llm.common import byte_list, hash_words, map_batches, maybe_broadcast, mix, seeded, slices, stage, table

WORDS, NUMERATOR, DENOMINATOR = 5, 3, 4
SMALL, SPREAD = 32, 4
#: Lanes of a band for each n-gram of its largest set.
LANES = 0.6
#: Counters of the table of lane frequencies, and the rows it travels in.
COUNTERS, COUNTER_ROWS = 1 << 20, 16
#: Bits of a sketch at least, and for each n-gram (up to a power of two).
SKETCH_BITS, SKETCH_SPREAD = 256, 1
#: Members of a bucket that meet in one task at once.
BLOCK = 2048
#: Rows of a lane that a task takes at most, by the counts; more go to several tasks.
HOT = 1 << 16
#: One bucket in so many takes part in the forest round.
FOREST_SHARE = 8
#: Buckets of a hub are one where that makes at most so many times the pairs they make apart.
TOGETHER = 4
#: The low bits of a lane: 0, or for a lane of more tasks their number and 1.
SALT = 0xFFFF
#: Tables of counters that meet in a task at once.
FAN_IN = 32
FALLBACK = 99



@dataclass(frozen=True)
class Rule:
    """Sets of n-grams of so many words link from numerator / denominator on."""

    words: int = WORDS
    numerator: int = NUMERATOR
    denominator: int = DENOMINATOR

    def sizes(self, one, other, least, greatest):
        """Whether the sizes of two sets allow a link."""
        return self.denominator * least(one, other) >= self.numerator * greatest(one, other)

    def near(self, apart, total):
        """Whether sets of ``total`` n-grams together, that differ in so many, may link."""
        return apart * (self.denominator + self.numerator) <= total * (self.denominator - self.numerator)


RULE = Rule()

_U = np.uint64
_GRAM = seeded(16, 53) | _U(1)


def gram_sets(texts: list[bytes], words: int = WORDS, key: int = 0) -> list[np.ndarray]:
    """Sorted distinct n-grams of each text, as 64-bit hashes. ASCII letters in lower case."""
    h, firsts, *_ = hash_words(texts, lower=True, key=key)
    out = []
    with np.errstate(over="ignore"):
        n = max(0, len(h) - words + 1)
        grams = np.zeros(n, dtype=_U)
        for k in range(words):
            grams += mix(h[k : k + n] + _GRAM[k]) * _GRAM[k]
        grams = mix(grams)
        for a, b in zip(firsts[:-1].tolist(), firsts[1:].tolist()):
            if b - a >= words:
                out.append(np.unique(grams[a : b - words + 1]))
            elif b > a:
                whole = _U(b - a)
                for k in range(a, b):
                    whole = mix(whole * _GRAM[8] + h[k])
                out.append(np.array([whole], dtype=_U))
            else:
                out.append(grams[:0])
    return out


def set_key(grams: np.ndarray) -> int:
    """A 64-bit key of a whole set; sets are of one class if it and the size agree."""
    with np.errstate(over="ignore"):
        return int(mix(np.array([mix(grams * _GRAM[9]).sum() ^ (_U(len(grams)) * _GRAM[10])], dtype=_U)).view(np.int64)[0])


def bit_sketch(grams: np.ndarray, least: int = SKETCH_BITS, spread: int = SKETCH_SPREAD) -> np.ndarray:
    """Parity of the n-grams that fall on each bit, as 64-bit words: a power of two of at
    least ``spread`` (a power of two) bits for an n-gram: the more, the fewer n-grams of a
    difference meet on a bit, and the more shuffles. A sketch XORed half on half is the
    sketch of half its bits."""
    bits = max(least, spread << int(max(1, len(grams)) - 1).bit_length())
    at = (mix(grams ^ _GRAM[11]) & _U(bits - 1)).astype(np.int64)
    return np.packbits((np.bincount(at, minlength=bits) & 1).astype(np.uint8)).view(np.int64)


def _low(band: int) -> int:
    return SMALL * SPREAD ** (band - 1) if band else 1


def _band(n: int) -> int:
    band = 0
    while n >= _low(band + 1):
        band += 1
    return band


def bands(n: int) -> list[tuple[int, int]]:
    """Bands in which a set of n n-grams takes part, and the most lanes (or n-grams)
    by which it and a partner in that band can differ."""
    own = _band(n)
    larger = n * DENOMINATOR // NUMERATOR
    away = lambda b: (n + b) * (DENOMINATOR - NUMERATOR) // (DENOMINATOR + NUMERATOR)
    out = [(own, away(larger))]
    least = -(-n * NUMERATOR // DENOMINATOR)
    if own and least < _low(own):
        out.append((own - 1, away(_low(own) - 1)))
    return out


def lanes(grams: np.ndarray, band: int) -> np.ndarray:
    """The lanes of a set in a band: non-zero parts of its parity sketch, hashed."""
    with np.errstate(over="ignore"):
        salt = mix(np.array([band + 1], dtype=_U))[0]
        if band == 0 or band == FALLBACK:
            return mix(grams ^ salt)
        count = int(LANES * _low(band + 1)) + 1
        part = ((grams >> _U(32)) * _U(count)) >> _U(32)
        first = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1])))
        return mix(np.bitwise_xor.reduceat(grams, first) ^ mix(part[first] + salt))


def all_lanes(grams: np.ndarray) -> list[tuple[np.ndarray, int]]:
    """For each band the lanes of a set and how many of them it must show."""
    out = []
    short = False
    for band, away in bands(len(grams)):
        own = lanes(grams, band)
        if band == 0:
            away = len(grams) - -(-len(grams) * NUMERATOR // DENOMINATOR)
        short |= len(own) <= away
        out.append((own, away + 1))
    if short:
        # Too many n-grams fell into the same parts; n-grams themselves always suffice.
        out.append((lanes(grams, FALLBACK), len(grams) - -(-len(grams) * NUMERATOR // DENOMINATOR) + 1))
    return out


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"])


def summaries(docs: DataFrame, key: int = 0) -> DataFrame:
    """doc_id, n, key, sketch of each row (the sketch once for each class in a task), and
    tables of lane counts: part (the task), slot and counts, null in rows of documents.
    A task counts the lanes of a class once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "n", "key", "sketch", "part", "slot", "counts"]
        total = np.zeros(COUNTERS, dtype=np.uint32)
        seen: set[int] = set()
        for whole in batches:
            for part in slices(whole):
                sets = gram_sets(byte_list(part), key=key)
                keys = [set_key(s) for s in sets]
                sketches: list[np.ndarray | None] = []
                for k, s in zip(keys, sets):
                    fresh = len(s) > 0 and k not in seen
                    sketches.append(bit_sketch(s) if fresh else None)
                    if fresh:
                        seen.add(k)
                        for own, _ in all_lanes(s):
                            np.add.at(total, (own % _U(COUNTERS)).astype(np.int64), 1)
                n = len(sets)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(keys, pa.int64()), pa.array(sketches, pa.list_(pa.int64())), pa.nulls(n, pa.int32()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())], names
                )
        if total.any():
            from pyspark import TaskContext

            n, mine = COUNTER_ROWS, TaskContext.get().partitionId()
            yield pa.RecordBatch.from_arrays(
                [pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.list_(pa.int64())), pa.array([mine] * n, pa.int32()), pa.array(range(n), pa.int32()), pa.array([r.astype("<u4").tobytes() for r in total.reshape(n, -1)], pa.binary())], names
            )

    return map_batches(_texts(docs), run, "doc_id long, n long, key long, sketch array<long>, part int, slot int, counts binary")


def lane_counts(tables: DataFrame) -> np.ndarray:
    """The sum of all tables of counters (part, slot, counts). FAN_IN tables of a slot
    meet in a task, as often as it takes; COUNTER_ROWS rows come back."""

    def add(group: pa.Table) -> pa.Table:
        total = np.zeros(COUNTERS // COUNTER_ROWS, dtype=np.int64)
        for x in group.column("counts"):
            total += np.frombuffer(x.as_py(), "<u4")
        counts = np.minimum(total, 0xFFFFFFFF).astype("<u4").tobytes()
        return pa.table({"part": group.column("part")[:1], "slot": group.column("slot")[:1], "counts": pa.array([counts], pa.binary())})

    schema = "part int, slot int, counts binary"
    parts = (tables.agg(F.max("part")).first()[0] or 0) + 1
    while True:
        parts = -(-parts // FAN_IN)
        tables = tables.withColumn("part", F.floor(F.col("part") / FAN_IN).cast("int")).groupBy("part", "slot").applyInArrow(add, schema)
        if parts == 1:
            break
        tables = stage(tables, "counts", few=True)
    out = np.zeros((COUNTER_ROWS, COUNTERS // COUNTER_ROWS), dtype=np.uint32)
    for r in tables.collect():  # COUNTER_ROWS rows at most
        out[r["slot"]] = np.frombuffer(r["counts"], "<u4")
    return out.ravel()


def shown_lanes(docs: DataFrame, counts: np.ndarray, key: int = 0, hot: int = HOT) -> DataFrame:
    """lane, key: the lanes that each class shows, the rarest first. A task shows the lanes
    of a class once, so copies collapse before the shuffle. A lane that more than ``hot``
    classes may have is dealt over several numbers by class: its low bits (SALT) are odd
    and differ, where those of any other lane are even. What a counter has above the
    median of all is the lane's own count: below lie the lanes that share it by chance,
    which grow with the table and are no reason to deal a lane."""
    background = int(np.median(counts))
    shared = docs.sparkSession.sparkContext.broadcast(counts)  # COUNTERS * 4 bytes, always

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often = shared.value
        seen: set[int] = set()
        for whole in batches:
            for part in slices(whole):
                out, keys, times = [], [], []
                for s in gram_sets(byte_list(part), key=key):
                    mine = set_key(s)
                    if not len(s) or mine in seen:
                        continue
                    seen.add(mine)
                    for own, show in all_lanes(s):
                        count = often[(own % _U(COUNTERS)).astype(np.int64)]
                        if show < len(own):
                            first = np.lexsort((own, count))[:show]
                            own, count = own[first], count[first]
                        out.append(own)
                        times.append(count)
                        keys.append((mine, len(own)))
                if out:
                    flat = np.concatenate(out).view(np.int64)
                    owner = np.repeat(np.array([k for k, _ in keys], dtype=np.int64), [c for _, c in keys])
                    parts = np.clip(-(-(np.concatenate(times).astype(np.int64) - background) // hot), 1, SALT >> 1)
                    salted = flat & ~SALT | (((owner & 0x7FFFFFFF) % parts) << 1) | 1
                    yield pa.RecordBatch.from_arrays([pa.array(np.where(parts > 1, salted, flat & ~1)), pa.array(owner)], ["lane", "key"])

    return map_batches(_texts(docs), run, "lane long, key long")


def shared_lanes(rows: DataFrame) -> DataFrame:
    """bucket, key, hub, lanes: the buckets of lanes that at least two classes show, how
    many lanes are in each, and the first key of the lane (of its salt). Lanes of the same
    classes are one bucket; a lane that is salted is one of its own, and all hubs of its
    salts have its first hub."""
    of = Window.partitionBy("lane")
    order = of.orderBy("key")
    salted = F.col("lane").bitwiseAND(F.lit(1)) == 1
    mark = F.when(F.lag("key").over(order).eqNullSafe(F.col("key")), F.lit(0).cast("long")).otherwise(F.pmod(F.xxhash64("key"), F.lit(1 << 31)))
    near = rows.withColumns({"before": F.lag("key").over(order), "after": F.lead("key").over(order), "hub": F.first("key").over(order), "mark": mark, "other": F.xxhash64("key", F.lit(7))})
    near = near.where(salted | (F.col("before") != F.col("key")) | (F.col("after") != F.col("key")))
    alike = F.xxhash64(F.sum("mark").over(of), F.expr("bit_xor(other)").over(of), "hub")
    near = near.withColumn("bucket", F.when(salted, F.xxhash64(F.col("lane").bitwiseAND(F.lit(~SALT)), F.lit(3))).otherwise(alike))
    return near.groupBy("bucket", "key", "hub").agg(F.count("*").alias("lanes"), F.bool_or(salted).alias("salted"))


def by_hub(members: DataFrame, together: float = TOGETHER) -> DataFrame:
    """bucket, key: the buckets of a hub as one, of all their classes, if that makes at most
    ``together`` times the pairs that they make apart; all others and salted ones as they are.
    What shares a bucket still does."""
    plain = members.where("NOT salted")
    apart = plain.groupBy("hub", "bucket").agg(F.count("*").alias("c")).groupBy("hub").agg(F.sum(F.col("c") * (F.col("c") - 1)).alias("apart"), F.count("*").alias("buckets"))
    whole = plain.select("hub", "key").distinct().groupBy("hub").agg(F.count("*").alias("c"))
    hubs = apart.where("buckets > 1").join(whole, "hub").where(F.col("c") * (F.col("c") - 1) <= together * F.col("apart")).select("hub", F.xxhash64("hub", F.lit(5)).alias("whole"))
    rows = members.join(maybe_broadcast(stage(hubs, "hubs", few=True)), "hub", "left")
    return rows.select(F.when(F.col("salted"), F.col("bucket")).otherwise(F.coalesce("whole", "bucket")).alias("bucket"), "key").distinct()


def able(pairs: DataFrame, classes: DataFrame, rule: Rule = RULE) -> DataFrame:
    """Those pairs (a, b) whose sizes and bit sketches allow a link."""
    left = classes.select(F.col("key").alias("a"), F.col("n").alias("na"), F.col("sketch").alias("sa"))
    right = classes.select(F.col("key").alias("b"), F.col("n").alias("nb"), F.col("sketch").alias("sb"))
    both = pairs.join(left, "a").join(right, "b")
    half = lambda x: F.zip_with(F.slice(x, 1, (F.size(x) / 2).cast("int")), F.slice(x, (F.size(x) / 2).cast("int") + 1, (F.size(x) / 2).cast("int")), lambda p, q: p.bitwiseXOR(q))
    # Sizes that allow a link differ by less than two, and so do their sketches.
    both = both.where((F.size("sa") <= 2 * F.size("sb")) & (F.size("sb") <= 2 * F.size("sa")))
    both = both.withColumns({"sa": F.when(F.size("sa") > F.size("sb"), half("sa")).otherwise(F.col("sa")), "sb": F.when(F.size("sb") > F.size("sa"), half("sb")).otherwise(F.col("sb"))})
    apart = F.aggregate(F.zip_with("sa", "sb", lambda x, y: F.bit_count(x.bitwiseXOR(y)).cast("long")), F.lit(0).cast("long"), lambda t, x: t + x)
    return both.where(rule.sizes(F.col("na"), F.col("nb"), F.least, F.greatest) & rule.near(apart, F.col("na") + F.col("nb"))).select("a", "b")


def sets_of(docs: DataFrame, wanted: DataFrame, key: int = 0, words: int = WORDS) -> DataFrame:
    """class and grams, once for each wanted class. wanted: class, doc_id. Small lists of
    documents are broadcast, so texts stay."""
    rows = _texts(docs).withColumnRenamed("doc_id", "_id")
    rows = rows.join(maybe_broadcast(wanted), F.col("_id").eqNullSafe(F.col("doc_id"))).select("class", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for part in slices(whole):
                sets = gram_sets(byte_list(part), words, key)
                # Texts of a repeated doc_id may be of another class; only the class's own set counts.
                mine = [i for i, (k, s) in enumerate(zip(part.column(0).to_pylist(), sets)) if set_key(s) == k]
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(mine, pa.int64())), pa.array([sets[i].view(np.int64) for i in mine], pa.list_(pa.int64()))], ["class", "grams"])

    return map_batches(rows, run, "class long, grams array<long>").dropDuplicates(["class"])


def verify(pairs: DataFrame, docs: DataFrame, classes: DataFrame, key: int = 0, rule: Rule = RULE) -> DataFrame:
    """Those pairs of classes (a, b) whose sets meet the threshold. Each class's set is
    made and sent once, and then goes with its pairs."""
    pairs = stage(able(pairs, classes, rule), "able", few=True)
    wanted = pairs.select(F.col("a").alias("class")).unionByName(pairs.select(F.col("b").alias("class"))).distinct()
    wanted = stage(wanted.join(classes.select(F.col("key").alias("class"), "doc_id"), "class"), "wanted", few=True)
    sets = stage(sets_of(docs, wanted, key, rule.words), "sets")
    both = pairs.join(sets.select(F.col("class").alias("b"), F.col("grams").alias("gb")), "b").join(sets.select(F.col("class").alias("a"), F.col("grams").alias("ga")), "a")
    common = F.size(F.array_intersect("ga", "gb")).cast("long")
    union = F.size("ga") + F.size("gb") - common
    return both.where(common * rule.denominator >= union * rule.numerator).select("a", "b")


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """node, component (its smallest node) of the graph of links (a, b): large-star and
    small-star steps until edges stay, each written to the shared folder."""
    edges = stage(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct(), "edges", few=True)
    before = None
    for _ in range(most_rounds):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e"))
        edges = stage(small.select("e.u", "e.v").where("u != v").distinct(), "edges", few=True)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % 1_000_000_007)).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components did not settle")
    return edges.groupBy("u").agg(F.min("v").alias("component")).withColumnRenamed("u", "node")


def _with_component(rows: DataFrame, found: DataFrame) -> DataFrame:
    rows = rows.join(found.withColumnRenamed("node", "key"), "key", "left")
    return rows.withColumn("component", F.coalesce("component", "key"))


def _apart(x: np.ndarray, rows: np.ndarray) -> np.ndarray:
    # Of unsigned words: numpy counts the bits of a signed number's absolute value.
    return np.bitwise_count((rows ^ x).view(np.uint64)).sum(axis=1, dtype=np.int64)


def _halved(rows: np.ndarray) -> np.ndarray:
    half = rows.shape[-1] // 2
    return np.ascontiguousarray(rows[..., :half] ^ rows[..., half:])


class _Meeting:
    """The members of a bucket that meet in a task."""

    def __init__(self, key: np.ndarray, component: np.ndarray, n: np.ndarray, mine: np.ndarray | None, sketches: list[np.ndarray], rule: Rule = RULE):
        self.rule = rule
        self.key, self.component, self.n, self.mine = key, component, n, mine
        self.words = np.array([len(s) for s in sketches])
        self.rows = {w: np.stack([sketches[i] for i in np.flatnonzero(self.words == w)]) for w in np.unique(self.words).tolist()}
        self.where = np.zeros(len(key), dtype=np.int64)
        for w in self.rows:
            at = np.flatnonzero(self.words == w)
            self.where[at] = np.arange(len(at))
        self.halves: dict[int, np.ndarray] = {}

    def near(self, x: int, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Those of y whose sizes and sketches allow a link with x, in order, and the share of
        both sizes by which the sketches are apart."""
        n = self.n
        y = y[self.rule.sizes(n[y], n[x], np.minimum, np.maximum)]
        out, shares = [], []
        w = int(self.words[x])
        mine = self.rows[w][self.where[x]]
        for v in (w // 2, w, 2 * w):
            part = y[self.words[y] == v]
            if len(part):
                if v == 2 * w and v not in self.halves:
                    self.halves[v] = _halved(self.rows[v])
                rows = (self.halves[v] if v == 2 * w else self.rows[v])[self.where[part]]
                far = _apart(_halved(mine) if v < w else mine, rows)
                ok = self.rule.near(far, n[part] + n[x])
                out.append(part[ok])
                shares.append(far[ok] / (n[part[ok]] + n[x]))
        if not out:
            return y[:0], np.zeros(0)
        found, share = np.concatenate(out), np.concatenate(shares)
        order = np.argsort(found)
        return found[order], share[order]

    def tree(self) -> list[tuple[int, int]]:
        """A spanning forest of the pairs that sketches allow, the nearest first (Prim's), so
        that copies of one text meet that text before each other. Members of a component
        are joined already."""
        n = len(self.key)
        best, partner = np.full(n, np.inf), np.full(n, -1)
        left = np.ones(n, dtype=bool)
        out = []
        for _ in range(n):
            x = int(np.argmin(np.where(left, best, np.inf)))
            if not left[x] or best[x] == np.inf:
                x = int(np.argmax(left))
            elif partner[x] >= 0:
                out.append((int(partner[x]), x))
            left[x] = False
            rest = np.flatnonzero(left)
            same = rest[self.component[rest] == self.component[x]]
            best[same], partner[same] = -1.0, -1
            rest = rest[self.component[rest] != self.component[x]]
            if self.mine is not None:
                rest = rest[self.mine[rest] != self.mine[x]]
            if len(rest):
                y, share = self.near(x, rest)
                closer = share < best[y]
                best[y[closer]], partner[y[closer]] = share[closer], x
        return out

    def pairs(self, forest: bool) -> list[tuple[int, int]]:
        """Pairs across components; of a forest only such as join what no other pair of
        the meeting has joined."""
        out = self.tree() if forest else []
        for x in range(0 if forest else len(self.key) - 1):
            y = np.arange(x + 1, len(self.key))
            if self.mine is not None:
                y = y[self.mine[y] != self.mine[x]]
            y = y[self.component[y] != self.component[x]]
            if len(y):
                out += [(x, i) for i in self.near(x, y)[0].tolist()]
        return [(min(self.key[a], self.key[b]), max(self.key[a], self.key[b])) for a, b in out]


def across(members: DataFrame, classes: DataFrame, found: DataFrame, forest: bool, block: int = BLOCK, rule: Rule = RULE, share: int = FOREST_SHARE) -> DataFrame:
    """Pairs (a, b) of classes in different components that share a bucket and whose
    sizes and bit sketches allow a link. members: bucket, key. With ``forest`` a share of
    the buckets meets, and a meeting gives no more pairs than it has components, enough to join all that sketches take
    for linked; without, all pairs. ``share``: one bucket in so many.

    Members of a bucket are dealt by size class (of a factor of the threshold) and hash into blocks;
    a block meets those of its own size class and of the next."""
    rows = members.select("bucket", "key")
    if forest and share > 1:
        # A fixed share of the buckets, the same for all, joins what is alike already.
        rows = rows.where(F.pmod(F.xxhash64("bucket"), F.lit(share)) == 0)
    rows = _with_component(rows, found)
    spans = rows.groupBy("bucket").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("bucket")
    rows = rows.join(maybe_broadcast(stage(spans, "spans", few=True)), "bucket").join(classes.select("key", "n", "sketch"), "key")
    # One too many classes would only split what may meet; sizes of one class are within the factor.
    rows = rows.withColumn("level", F.floor(F.log(F.col("n")) / F.log(F.lit(rule.denominator / rule.numerator)) + 1e-9).cast("int"))
    counts = rows.groupBy("bucket", "level").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    levels = counts.groupBy("bucket").agg(F.map_from_entries(F.collect_list(F.struct("level", "blocks"))).alias("blocks"))  # a few dozen levels
    rows = rows.join(maybe_broadcast(stage(levels, "levels", few=True), 512), "bucket")
    of = lambda level: F.coalesce(F.try_element_at("blocks", level), F.lit(0))
    numbers = lambda n: F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    rows = rows.withColumn("mine", F.pmod(F.xxhash64("key"), of(F.col("level"))).cast("int"))
    meet = lambda low, high, i, j: F.struct(low.alias("low"), high.alias("high"), i.alias("i"), j.alias("j"))
    level, mine = F.col("level"), F.col("mine")
    own = F.transform(numbers(of(level)), lambda j: meet(level, level, F.least(mine, j), F.greatest(mine, j)))
    above = F.transform(numbers(of(level + 1)), lambda j: meet(level, level + 1, mine, j))
    below = F.transform(numbers(of(level - 1)), lambda j: meet(level - 1, level, j, mine))
    rows = rows.withColumn("meet", F.explode(F.concat(own, above, below)))
    two = (F.col("meet.low") != F.col("meet.high")) | (F.col("meet.i") != F.col("meet.j"))
    side = F.when((level == F.col("meet.low")) & (mine == F.col("meet.i")), 0).otherwise(1)
    rows = rows.select("bucket", F.xxhash64("meet").alias("meeting"), side.alias("mine"), "key", "component", "n", "sketch", two.alias("two"))
    rows = rows.repartition("bucket", "meeting").sortWithinPartitions("bucket", "meeting")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def flush(whole: pa.Table) -> Iterator[pa.RecordBatch]:
            ids = [whole.column(c).to_numpy() for c in ("bucket", "meeting")]
            edge = np.flatnonzero(np.any([c[1:] != c[:-1] for c in ids], axis=0)) + 1 if len(whole) > 1 else np.zeros(0, int)
            mine, own, component, n = (whole.column(c).to_numpy() for c in ("mine", "key", "component", "n"))
            two = whole.column("two").to_numpy(zero_copy_only=False)
            lists = whole.column("sketch").combine_chunks()
            widths = lists.value_lengths().to_numpy()
            flat, ends = lists.flatten().to_numpy(), np.cumsum(widths)
            found = []
            for a, b in zip([0, *edge.tolist()], [*edge.tolist(), len(whole)]):
                if b - a > 1:
                    sketches = [flat[e - w : e] for e, w in zip(ends[a:b].tolist(), widths[a:b].tolist())]
                    found += _Meeting(own[a:b], component[a:b], n[a:b], mine[a:b] if two[a] else None, sketches, rule).pairs(forest)
            if found:
                both = np.unique(np.array(found, dtype=np.int64), axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], ["a", "b"])

        for batch in batches:
            for start in range(0, batch.num_rows, 4096):
                # Rows of the last meeting wait for the next batch, which may hold more of it.
                part = pa.Table.from_batches([*held, batch.slice(start, 4096)])
                last = [part.column(c)[len(part) - 1].as_py() for c in ("bucket", "meeting")]
                same = np.all([part.column(c).to_numpy() == v for c, v in zip(("bucket", "meeting"), last)], axis=0)
                cut = int(np.argmax(same))
                yield from flush(part.slice(0, cut))
                held = part.slice(cut).combine_chunks().to_batches()
        if held:
            yield from flush(pa.Table.from_batches(held))

    return map_batches(rows, run, "a long, b long").distinct()


def link(docs: DataFrame, block: int = BLOCK, hot: int = HOT) -> tuple[DataFrame, DataFrame]:
    """(rows, found): doc_id, n, key of each document, and node, component of classes
    that are linked with another."""
    key = secrets.randbits(63)
    both = stage(summaries(docs, key), "summaries")
    rows = both.where("slot IS NULL").select("doc_id", "n", "key", "sketch")
    classes = stage(rows.where("n > 0").groupBy("key").agg(F.min("doc_id").alias("doc_id"), F.first("n").alias("n"), F.first("sketch", ignorenulls=True).alias("sketch")), "classes", few=True)
    counts = lane_counts(both.where("slot IS NOT NULL").select("part", "slot", "counts"))
    members = stage(shared_lanes(shown_lanes(docs, counts, key, hot)), "members", few=True)
    # The partner that a class shares most lanes with, among the first of its buckets.
    ties = members.where("key != hub").groupBy("key", "hub").agg(F.sum("lanes").alias("lanes"))
    best = ties.groupBy("key").agg(F.max_by("hub", F.struct("lanes", "hub")).alias("hub"))
    tops = members.where("salted").select("bucket", "hub").distinct()
    tops = tops.join(tops.groupBy("bucket").agg(F.min("hub").alias("top")), "bucket").where("hub != top").select(F.col("top").alias("hub"), F.col("hub").alias("key"))
    first = best.select(F.col("hub").alias("a"), F.col("key").alias("b")).unionByName(tops.select(F.col("hub").alias("a"), F.col("key").alias("b"))).distinct()
    return rows.select("doc_id", "n", "key"), settle(first, stage(by_hub(members), "buckets", few=True), docs, classes, key, block, share=1)


def settle(first: DataFrame, members: DataFrame, docs: DataFrame, classes: DataFrame, key: int, block: int = BLOCK, rule: Rule = RULE, share: int = FOREST_SHARE) -> DataFrame:
    """node, component of the classes (key, n, sketch, doc_id) that are linked with another,
    from pairs to try first (a, b) and all buckets (members: bucket, key)."""
    links = stage(verify(first, docs, classes, key, rule), "links", few=True)
    found = components(links)
    for forest in (True, False):
        more = stage(across(members, classes, found, forest, block, rule, share), "pairs", few=True)
        fresh = stage(verify(more, docs, classes, key, rule), "links", few=True)
        if not fresh.isEmpty():
            links = stage(links.unionByName(fresh), "links", few=True)
            found = components(links)
    return stage(found, "components", few=True)


def join_documents(docs: DataFrame, block: int = BLOCK, hot: int = HOT) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id of its component) of each row.
    ``block`` and ``hot`` (members of a block, rows of a lane in a task) don't change it."""
    return labelled(*link(docs, block, hot))


def labelled(rows: DataFrame, found: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id of rows (doc_id, n, key) by the components of keys."""
    classes = rows.where("n > 0").groupBy("key").agg(F.min("doc_id").alias("first"), F.count("*").alias("copies"))
    # The smallest node of a component stands in no link as the larger one.
    found = found.unionByName(found.select(F.col("component").alias("node"), "component").distinct())
    linked = stage(found.join(classes.withColumnRenamed("key", "node"), "node"), "linked", few=True)
    least = linked.join(linked.groupBy("component").agg(F.min("first").alias("least")), "component").select(F.col("node").alias("key"), "least")
    # A class of one row that no other is linked with is its own component.
    copies = classes.where("copies > 1").join(least.select("key"), "key", "left_anti").select("key", F.col("first").alias("least"))
    known = stage(least.unionByName(copies), "known", few=True)
    rows = rows.join(maybe_broadcast(known, 32), "key", "left")
    # The least of a class without any doc_id is null, like that of its rows.
    return rows.select("doc_id", F.col("n").alias("n_shingles"), F.when((F.col("n") > 0) & F.col("least").isNotNull(), F.col("least")).otherwise(F.col("doc_id")).alias("component_id"))


def op3_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of all documents."""
    return join_documents(table(spark, sf_dir, "documents"))
