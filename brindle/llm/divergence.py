r"""Operator 11: how the term distributions of the sources of a language diverge.

Mergeable radix tries. A task counts the terms of its documents in one byte trie for each
language, whose leaf holds the number of documents and a counter for each source. Tries
are held linearised: the leaves in byte order, which is UTF-8 order, so that two merge as
sorted arrays and a traversal is a stream. Slices of text are counted by arrays (terms are
compared by their bytes), then merged. The streams of all tasks are merged by prefix range:
the leaves are range-partitioned by (language, term) and sorted, so that neighbours of equal
term are one leaf, and leaves of enough documents are kept. The kept leaves, again in prefix ranges, are
traversed once more against the totals of their language: each range sums the differences
of all pairs of sources, and holds the first TOP terms of each group; as terms come in
UTF-8 order, a stable choice by value breaks ties as asked. Sums of ranges are added.

All arithmetic is on integers: floor(SCALE * (count + PRIOR) / total) by long division in
64 bits, or on Python's integers where totals are too large for that.

Bounds: a task holds HELD counters, then writes its tries and starts anew (a single text is
a slice of its own); a merging task holds one term's counters; a traversing task one block
of BLOCK x BLOCK pairs of sources (a language of more sources sends its terms to each pair
of blocks) and TOP terms a group.
What travels for each language are its sources and totals, once for each range. The result
itself has all pairs of sources, so it grows with their square.

Null text, lang and source are ''. doc_id is not looked at, so repeated rows count as often
as they stand there. A group without terms has count 0 everywhere. A language that keeps no
term has value 0 for all pairs, ranked by name. No documents give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from brindle.llm.common import byte_list, hash_words, map_batches, slices, stage, table, word_ids

#: Documents of a language that have a kept term, and terms listed for each group.
LEAST_DOCS, TOP = 30, 50
SCALE, PRIOR = 10**9, 5
#: Counters that a task holds before it writes its tries.
HELD = 1 << 21
#: Sources of a block in the second traversal.
BLOCK = 1024

#: Bytes that separate terms: all ASCII characters that are no letters.
_BETWEEN = np.zeros(256, dtype=bool)
_BETWEEN[[b for b in range(128) if not chr(b).isalpha()]] = True
_LEAVES = "lang string, term string, docs long, sources array<string>, counts array<long>"


class Tries:
    """One radix trie for each language, linearised: leaves are held in byte order, each with
    its term, its documents and a counter for each source. What is added stays apart until
    ``leaves``, which merges it: equal terms are one leaf, whose counters are added."""

    def __init__(self) -> None:
        self.groups: dict[tuple[str, str], int] = {}
        self.langs: dict[str, int] = {}
        self.clear()

    def clear(self) -> None:
        self.terms: list[pa.Array] = []
        self.docs: list[np.ndarray] = []  # place of the term, language, documents
        self.counts: list[np.ndarray] = []  # place of the term, group, count
        self.n_terms = self.held = 0

    def add(self, texts: list[bytes], langs: list[str], sources: list[str]) -> None:
        """Count the terms of some texts."""
        h, firsts, starts, ends, data = hash_words(texts, lower=True, separators=_BETWEEN)
        if not len(h):
            return
        word = word_ids(h, starts, ends, data)
        _, example, word = np.unique(word, return_index=True, return_inverse=True)
        n = len(example)
        doc = np.repeat(np.arange(len(texts)), np.diff(firsts))
        group = np.array([self.groups.setdefault(x, len(self.groups)) for x in zip(langs, sources)])
        lang = np.array([self.langs.setdefault(x, len(self.langs)) for x in langs])
        once = np.unique(doc * n + word)
        self._count(self.docs, lang[once // n], once % n, n)
        self._count(self.counts, group[doc], word, n)
        raw = data.tobytes()
        self.terms.append(pa.array([raw[i:j] for i, j in zip(starts[example].tolist(), ends[example].tolist())], pa.binary()))
        self.n_terms += n

    def _count(self, into: list[np.ndarray], owner: np.ndarray, word: np.ndarray, n: int) -> None:
        pair, count = np.unique(owner * n + word, return_counts=True)
        into.append(np.stack([self.n_terms + pair % n, pair // n, count]))
        self.held += len(pair)

    def merge(self, other: Tries) -> None:
        """Add all counters of another set of tries."""
        group = np.array([self.groups.setdefault(x, len(self.groups)) for x in other.groups], dtype=np.int64)
        lang = np.array([self.langs.setdefault(x, len(self.langs)) for x in other.langs], dtype=np.int64)
        self.docs += [np.stack([p + self.n_terms, lang[o], c]) for p, o, c in other.docs]
        self.counts += [np.stack([p + self.n_terms, group[o], c]) for p, o, c in other.counts]
        self.terms += other.terms
        self.n_terms += other.n_terms
        self.held += other.held

    def leaves(self) -> Iterator[pa.RecordBatch]:
        """The leaves of all tries, by language in byte order (_LEAVES), in batches."""
        if not self.n_terms:
            return
        coded = pa.concat_arrays(self.terms).dictionary_encode()
        order = pc.sort_indices(coded.dictionary).to_numpy()
        rank = np.empty(len(order), dtype=np.int64)
        rank[order] = np.arange(len(order))
        place, width = rank[coded.indices.to_numpy()], len(order)
        lang_of = np.array([self.langs[lang] for lang, _ in self.groups])
        # Leaves are numbered by language and place; a counter has a group besides.
        word, lang, n = np.concatenate(self.docs, axis=1)
        leaf, docs = _summed(lang * width + place[word], n)
        word, group, n = np.concatenate(self.counts, axis=1)
        counter, counts = _summed((lang_of[group] * width + place[word]) * len(lang_of) + group, n)
        lengths = np.bincount(np.searchsorted(leaf, counter // len(lang_of)), minlength=len(leaf))
        names = pa.array([lang for lang, _ in sorted(self.langs.items(), key=lambda x: x[1])], pa.string())
        sources = pa.array([source for _, source in self.groups], pa.string())
        ends = np.concatenate(([0], np.cumsum(lengths)))
        for a in range(0, len(leaf), 1 << 16):
            some = leaf[a : a + (1 << 16)]
            b = slice(ends[a], ends[a + len(some)])
            offsets = pa.array(ends[a : a + len(some) + 1] - ends[a], pa.int32())
            yield pa.RecordBatch.from_arrays(
                [names.take(pa.array(some // width)), coded.dictionary.take(pa.array(order[some % width])).cast(pa.string()), pa.array(docs[a : a + len(some)]),
                 pa.ListArray.from_arrays(offsets, sources.take(pa.array(counter[b] % len(lang_of)))), pa.ListArray.from_arrays(offsets, pa.array(counts[b]))],
                ["lang", "term", "docs", "sources", "counts"],
            )


def _summed(key: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and the sums of n by them."""
    order = np.argsort(key, kind="stable")
    key, n = key[order], n[order]
    first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    return key[first], np.add.reduceat(n, first)


def leaves(docs: DataFrame, held: int = HELD) -> DataFrame:
    """The leaves of each task's tries: lang, term, docs, sources, counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tries = Tries()
        for whole in batches:
            for part in slices(whole):
                tries.add(byte_list(part), part.column("lang").to_pylist(), part.column("source").to_pylist())
                if tries.held >= held:
                    yield from tries.leaves()
                    tries = Tries()
        yield from tries.leaves()

    return map_batches(docs, run, _LEAVES)


def _leaf_rows(lang: str, found: list[tuple[str, int, dict[str, int]]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([lang] * len(found), pa.string()), pa.array([t for t, _, _ in found], pa.string()), pa.array([n for _, n, _ in found], pa.int64()), pa.array([list(c) for _, _, c in found], pa.list_(pa.string())), pa.array([list(c.values()) for _, _, c in found], pa.list_(pa.int64()))],
        ["lang", "term", "docs", "sources", "counts"],
    )


def _sum_counters(sources: pa.Array, counts: pa.Array, into: dict[str, int]) -> None:
    for s, n in zip(sources.to_pylist(), counts.to_pylist()):
        into[s] = into.get(s, 0) + n


def kept_leaves(rows: DataFrame, least: int = LEAST_DOCS) -> DataFrame:
    """The leaves of all tasks merged by prefix range; those of enough documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, docs, counters = None, 0, {}
        for batch in batches:
            if not batch.num_rows:
                continue
            langs, terms = batch.column("lang"), batch.column("term")
            n, size = batch.column("docs").to_numpy(), batch.num_rows
            other = pc.or_(pc.not_equal(terms.slice(1), terms.slice(0, size - 1)), pc.not_equal(langs.slice(1), langs.slice(0, size - 1)))
            starts = np.concatenate(([0], np.flatnonzero(other.to_numpy(zero_copy_only=False)) + 1))
            ends, total = np.append(starts[1:], size), np.add.reduceat(n, starts)
            # Terms in the middle of a batch are whole; the first may go on, the last may go on.
            wanted = np.flatnonzero(total >= least)
            wanted = np.unique(np.concatenate(([0], wanted, [len(starts) - 1])))
            out: dict[str, list] = {}
            for k in wanted.tolist():
                a, b = int(starts[k]), int(ends[k])
                this = (langs[a].as_py(), terms[a].as_py())
                if this != name:
                    if name is not None and docs >= least:
                        out.setdefault(name[0], []).append((name[1], docs, counters))
                    name, docs, counters = this, 0, {}
                docs += int(total[k])
                _sum_counters(batch.column("sources").slice(a, b - a).flatten(), batch.column("counts").slice(a, b - a).flatten(), counters)
            for lang, found in out.items():
                yield _leaf_rows(lang, found)
        if name is not None and docs >= least:
            yield _leaf_rows(name[0], [(name[1], docs, counters)])

    # The ranges are of prefixes: leaves of a common prefix lie in one, or in neighbours.
    return map_batches(rows.repartitionByRange("lang", "term").sortWithinPartitions("lang", "term"), run, _LEAVES)


def shares(counts: np.ndarray, totals: np.ndarray) -> np.ndarray:
    """1 + floor(SCALE * (count + PRIOR) / total), exactly."""
    if totals.size and int(totals.max()) >= 1 << 53:
        rest = counts.astype(object) + PRIOR
        return (1 + rest * SCALE // totals.astype(object)).astype(np.int64)
    rest = counts.astype(np.int64) + PRIOR
    out = np.zeros(np.broadcast_shapes(rest.shape, totals.shape), dtype=np.int64)
    for _ in range(3):  # SCALE is 1000 ** 3
        rest = rest * 1000
        out = out * 1000 + rest // totals
        rest = rest % totals
    return out + 1


class _Range:
    """The sums of a prefix range of a language over two blocks of its sources."""

    def __init__(self, lang: str, i: int, j: int, names: list[str], totals: list[int], block: int, top: int):
        self.lang, self.i, self.j, self.top = lang, i, j, top
        self.names, self.block, self.all = pa.array(names, pa.string()), block, int(sum(totals))
        self.totals = np.array(totals, dtype=np.int64)
        self.places = [np.arange(k * block, min((k + 1) * block, len(names))) for k in (i, j)]
        self.sums = np.zeros((len(self.places[0]), len(self.places[1])), dtype=np.int64)
        self.terms = pa.array([], pa.string())
        self.best = np.zeros((3, 0), dtype=np.int64)  # source, value, place in terms

    def add(self, terms: pa.Array, sources: pa.ListArray, counts: pa.ListArray, n_terms: int) -> None:
        lengths = sources.value_lengths().to_numpy()
        at = pc.index_in(sources.flatten(), value_set=self.names).to_numpy()
        n, row = counts.flatten().to_numpy(), np.repeat(np.arange(len(terms)), lengths)
        whole = np.zeros(len(terms), dtype=np.int64)
        np.add.at(whole, row, n)
        totals = self.totals + PRIOR * n_terms
        found, tables = [], []
        for places in self.places if self.i != self.j else self.places[:1]:
            mine = (at >= places[0]) & (at <= places[-1])
            table = np.zeros((len(terms), len(places)), dtype=np.int64)
            table[row[mine], at[mine] - places[0]] = n[mine]
            tables.append(table)
            found.append(shares(table, totals[places][None, :]))
        p, other = found[0], found[-1]
        for a in range(p.shape[1]):
            self.sums[a] += np.abs(other - p[:, a : a + 1]).sum(axis=0)
        if self.i == self.j:
            q = shares(whole, np.array([self.all + PRIOR * n_terms], dtype=np.int64))
            over = p - q[:, None]
            t, s = np.nonzero((tables[0] > 0) & (over > 0))
            new = np.stack([s, over[t, s], t + len(self.terms)]) if len(t) else np.zeros((3, 0), np.int64)
            self._choose(np.concatenate([self.best, new], axis=1), pa.concat_arrays([self.terms, terms]))

    def _choose(self, rows: np.ndarray, terms: pa.Array) -> None:
        # Places are in UTF-8 order, so they break ties.
        rows = rows[:, np.lexsort((rows[2], -rows[1], rows[0]))]
        edge = np.flatnonzero(np.concatenate(([True], rows[0, 1:] != rows[0, :-1]))) if rows.shape[1] else np.zeros(0, int)
        first = np.repeat(edge, np.diff(np.append(edge, rows.shape[1])))
        rows = rows[:, np.arange(rows.shape[1]) - first < self.top]
        used, place = np.unique(rows[2], return_inverse=True)
        self.terms, self.best = terms.take(pa.array(used)), np.stack([rows[0], rows[1], place]) if rows.shape[1] else rows

    def rows(self) -> Iterator[pa.RecordBatch]:
        """lang, source, part, item, value of the pairs, both ways, and of the terms."""

        def batch(part: str, source: pa.Array, item: pa.Array, value: np.ndarray) -> pa.RecordBatch:
            n = len(value)
            return pa.RecordBatch.from_arrays([pa.array([self.lang] * n, pa.string()), source, pa.array([part] * n, pa.string()), item, pa.array(value, pa.int64())], ["lang", "source", "part", "item", "value"])

        left, right = self.places
        for a in range(len(left)):
            here, there = self.names.take(pa.array(np.full(len(right), left[a]))), self.names.take(pa.array(right))
            keep = right != left[a]
            yield batch("pair", here.filter(pa.array(keep)), there.filter(pa.array(keep)), self.sums[a][keep])
            if self.i != self.j:
                yield batch("pair", there, here, self.sums[a])
        if self.best.shape[1]:
            s, v, t = self.best
            yield batch("term", self.names.take(pa.array(s + left[0])), self.terms.take(pa.array(t)), v)


def _traverse(kept: DataFrame, langs: DataFrame, top: int, block: int) -> DataFrame:
    """lang, source, part, item, value: of each prefix range and pair of blocks the sums of
    the pairs and the first terms. kept: rows of kept_leaves with part, the task that wrote
    them; langs: lang, names, totals, n_terms."""
    blocks = F.ceil(F.size("names") / block).cast("int")
    pairs = F.flatten(F.transform(F.sequence(F.lit(0), blocks - 1), lambda i: F.transform(F.sequence(i, blocks - 1), lambda j: F.struct(i.alias("i"), j.alias("j")))))
    meets = langs.select("lang", F.explode(pairs).alias("x")).select("lang", "x.i", "x.j")
    rows = kept.join(meets, "lang").select("part", "lang", "i", "j", F.lit(1).alias("kind"), "term", "sources", "counts", F.lit(0).cast("long").alias("n_terms"))
    heads = kept.select("part", "lang").distinct().join(meets, "lang").join(langs, "lang")
    heads = heads.select("part", "lang", "i", "j", F.lit(0).alias("kind"), F.lit("").alias("term"), F.col("names").alias("sources"), F.col("totals").alias("counts"), "n_terms")
    order = ["part", "lang", "i", "j", "kind", "term"]
    rows = rows.unionByName(heads).repartition("part", "lang", "i", "j").sortWithinPartitions(*order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: _Range | None = None
        n_terms = 0
        for batch in batches:
            heads = np.flatnonzero(batch.column("kind").to_numpy() == 0).tolist()
            a = 0
            for edge in [*heads, batch.num_rows]:
                if edge > a and now is not None:
                    step = max(1, (1 << 20) // max(1, len(now.names)))
                    for b in range(a, edge, step):
                        some = batch.slice(b, min(step, edge - b))
                        now.add(some.column("term"), some.column("sources"), some.column("counts"), n_terms)
                if edge < batch.num_rows:
                    if now is not None:
                        yield from now.rows()
                    head = batch.slice(edge, 1).to_pylist()[0]
                    now, n_terms = _Range(head["lang"], head["i"], head["j"], head["sources"], head["counts"], block, top), head["n_terms"]
                    a = edge + 1
        if now is not None:
            yield from now.rows()

    return map_batches(rows, run, "lang string, source string, part string, item string, value long")


def audit(docs: DataFrame, least: int = LEAST_DOCS, top: int = TOP, held: int = HELD, block: int = BLOCK) -> DataFrame:
    """lang, source, part, item, value, rank. ``held`` and ``block`` (what tasks hold)
    don't change the result."""
    rows = docs.select(*[F.coalesce(docs[c].cast("string"), F.lit("")).alias(c) for c in ("text", "lang", "source")])
    groups = stage(rows.select("lang", "source").distinct(), "groups", few=True)
    # The number of the task that writes it, which has prefix ranges, stays with a leaf.
    kept = kept_leaves(stage(leaves(rows, held), "leaves"), least).coalesce(2 * docs.sparkSession.sparkContext.defaultParallelism)
    kept = stage(kept.withColumn("part", F.spark_partition_id()), "kept")
    each = kept.select("lang", F.explode(F.arrays_zip("sources", "counts")).alias("x"))
    counted = each.groupBy("lang", F.col("x.sources").alias("source")).agg(F.sum("x.counts").alias("total"))
    counted = groups.join(counted, ["lang", "source"], "left").na.fill(0, ["total"])
    # The sources of a language, as its result has a row for each two of them.
    named = counted.groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("source", "total"))).alias("x"))
    named = named.select("lang", F.col("x.source").alias("names"), F.col("x.total").alias("totals"))
    langs = stage(named.join(kept.groupBy("lang").agg(F.count("*").alias("n_terms")), "lang"), "langs", few=True)
    found = stage(_traverse(kept, langs, top, block), "sums", few=True)
    # Languages without kept terms.
    bare = groups.join(langs.select("lang"), "lang", "left_anti")
    zero = bare.join(bare.withColumnRenamed("source", "item"), "lang").where("source != item")
    zero = zero.select("lang", "source", F.lit("pair").alias("part"), "item", F.lit(0).cast("long").alias("value"))
    # A pair has a sum from each range; a term is in one range only.
    key = ["lang", "source", "part", "item"]
    pairs = found.where("part = 'pair'").unionByName(zero).groupBy(*key).agg(F.sum("value").alias("value"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = lambda rows: rows.withColumn("rank", F.row_number().over(order))
    # By rank alone, so that ranges send TOP terms of a group at most.
    terms = ranked(found.where("part = 'term'").select(*key, "value")).where(F.col("rank") <= top)
    return ranked(pairs).unionByName(terms)


def op11_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The audit of all documents."""
    return audit(table(spark, sf_dir, "documents"))


def divergence_sql(least: int = LEAST_DOCS, top: int = TOP) -> str:
    """The same in SQL: every term of every document a row."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    share = f"1 + ({SCALE}::HUGEINT * ({{c}} + {PRIOR})) // ({{n}} + {PRIOR} * v.n_terms)"
    return rf"""
    WITH d AS (SELECT row_number() OVER () AS rid, coalesce(lang, '') AS lang, coalesce(source, '') AS source, translate(coalesce(text, ''), '{upper}', '{upper.lower()}') AS t FROM documents),
    tok AS (SELECT rid, lang, source, unnest(regexp_extract_all(t, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
    grp AS (SELECT DISTINCT lang, source FROM d),
    kept AS (SELECT lang, term FROM tok GROUP BY lang, term HAVING count(DISTINCT rid) >= {least}),
    v AS (SELECT lang, count(*) AS n_terms FROM kept GROUP BY lang),
    cnt AS (SELECT lang, source, term, count(*) AS c FROM tok JOIN kept USING (lang, term) GROUP BY lang, source, term),
    n AS (SELECT lang, source, sum(c) AS n FROM cnt GROUP BY lang, source),
    nl AS (SELECT lang, sum(n) AS n FROM n GROUP BY lang),
    p AS (SELECT g.lang, g.source, k.term, coalesce(cnt.c, 0) AS c, {share.format(c="coalesce(cnt.c, 0)", n="coalesce(n.n, 0)")} AS p
      FROM grp g JOIN kept k ON k.lang = g.lang JOIN v ON v.lang = g.lang LEFT JOIN n ON n.lang = g.lang AND n.source = g.source
      LEFT JOIN cnt ON cnt.lang = g.lang AND cnt.source = g.source AND cnt.term = k.term),
    q AS (SELECT c.lang, c.term, {share.format(c="c.c", n="nl.n")} AS q FROM (SELECT lang, term, sum(c) AS c FROM cnt GROUP BY lang, term) c JOIN v USING (lang) JOIN nl USING (lang)),
    pairs AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source != b.source GROUP BY a.lang, a.source, b.source),
    allpairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(x.value, 0) AS value FROM grp a JOIN grp b ON a.lang = b.lang AND a.source != b.source
      LEFT JOIN pairs x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source),
    terms AS (SELECT p.lang, p.source, 'term' AS part, p.term AS item, p.p - q.q AS value FROM p JOIN q ON p.lang = q.lang AND p.term = q.term WHERE p.c > 0 AND p.p > q.q),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rk FROM (SELECT * FROM allpairs UNION ALL SELECT * FROM terms))
    SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rk AS INTEGER) AS rank FROM ranked WHERE part = 'pair' OR rk <= {top}"""
