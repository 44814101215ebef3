"""Operator 1: mixing sources to target weights by a splitting tree. DataFrame code only.

1. Each source gets a target in words: its weight's share of all words, at most REPEATS
   times its own words; what is above is shared again by weight until none is above.
   The common level is found exactly, over sorted range partitions of the sources.
2. A source's documents are dealt by hash into blocks, BLOCKS_A_SHARD for each shard over
   all sources. Whole passes over a source come first; of the last, partial pass blocks
   are drawn in a permuted order until the target is met. That gives each source an exact
   quota of blocks.
3. The quotas of all sources stand at the root of a tree over the output shards. At each
   node a fixed part of its blocks goes left, and what that part holds of each source is
   one draw from the multivariate hypergeometric distribution over the node's quotas (an
   urn with a token for each block, drawn without return). At the leaves each shard has
   its quota of each source.
4. A source's blocks, permuted, are dealt to the shards by those quotas: disjoint draws.
   In a shard blocks lie in permuted order, and documents are shuffled inside a block.
5. Of the one block of a source where its target is met, documents are taken in permuted
   order while they fit. The place is found by histograms over ever finer ranges of the
   documents' hashes, until a range has at most CUT_DOCS documents; of that range several
   permutations are filled, and the one that comes nearest is taken.

All keys are hashes of a seed, so reruns agree. A row is told from others by a hash of
doc_id, source and text; rows that are equal in these are numbered, and each is dealt on
its own. Null text
counts 0 words; a document of no words is never taken. A null source is a source of its
own, the last. Without words, or without rows, nothing is taken. Columns of other names
don't matter to the plan; ``mix`` replaces columns named mix_shard, mix_order and mix_pass.

What grows: the blocks, tokens and quotas are bounded by the shards and the number of
sources; histograms have 2^CUT_BITS rows a source. Nothing else but sizes is written.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from brindle.llm.common import maybe_broadcast, stage, table, word_count
from brindle.sources.order import with_row_id

REPEATS, SEED, SHARDS = 3, 11, 16
#: Blocks over all sources for each shard; documents of a block at least, on average.
BLOCKS_A_SHARD, BLOCK_DOCS = 64, 16
#: Slices of a block that go to tasks of their own when shards are written.
SLICES = 4
#: Documents of a range inside which places are given one by one, bits of a histogram,
#: levels of histograms at most (all bits of a hash), rounds that fill the rest, and
#: permutations of which the nearest is taken.
CUT_DOCS, CUT_BITS, CUT_LEVELS, FILLS, TRIES = 512, 10, 7, 4, 16


def _hash(*parts: Column | str | int) -> Column:
    return F.xxhash64(*[F.lit(p) if isinstance(p, int) else p for p in parts])


def cycle_weight(rank: Column) -> Column:
    """1, 2, 3, repeating, by the place (from 0) of a source in code-point order."""
    return (F.pmod(rank, F.lit(3)) + 1).cast("double")


def targets(sources: DataFrame, repeats: int = REPEATS, weights: dict[str, float] | None = None) -> DataFrame:
    """source, source_size -> also weight, target. ``weights`` by name, else 1, 2, 3,
    repeating. A source without weight gets 0."""
    if weights is None:
        rows = with_row_id(sources, F.col("source").asc_nulls_last(), name="_place").withColumn("weight", cycle_weight(F.col("_place"))).drop("_place")
    else:
        named = F.create_map(*[F.lit(x) for kv in weights.items() for x in kv])[F.col("source")] if weights else F.lit(None).cast("double")
        rows = sources.withColumn("weight", F.coalesce(named, F.lit(0.0)))
    rows = stage(rows.select(*sources.columns, "weight"), "weights", few=True)
    most = (F.col("source_size") * repeats).cast("double")
    total = float(rows.where("weight > 0").agg(F.sum("source_size")).first()[0] or 0)
    level = fill_level(rows.where("weight > 0").select(most.alias("most"), "weight"), total)
    return rows.withColumn("target", F.when(F.col("weight") <= 0, 0.0).otherwise(F.least(most, F.lit(level) * F.col("weight"))))


def fill_level(limits: DataFrame, total: float) -> float:
    """The level at which the sum of min(most, level * weight) is ``total``; infinite if
    all limits together are less. limits: most, weight.

    Sources are full one after the other in order of most / weight. They are sorted by it
    over range partitions, a row for each of which comes back with its sums; only the
    partition in which the total is met is looked at row by row."""
    rows = limits.withColumn("full_at", F.col("most") / F.col("weight")).orderBy("full_at").withColumn("part", F.spark_partition_id())
    rows = stage(rows, "limits", few=True)
    parts = rows.groupBy("part").agg(F.sum("most").alias("most"), F.sum("weight").alias("weight"), F.max("full_at").alias("top")).orderBy("part").collect()
    before, after = 0.0, math.fsum(p["weight"] for p in parts)
    for p in parts:
        rest = after - p["weight"]
        if before + p["most"] + p["top"] * rest >= total:
            break
        before, after = before + p["most"], rest
    else:
        return math.inf
    upto = Window.orderBy("full_at", "most", "weight")  # of one range partition
    inside = rows.where(F.col("part") == p["part"]).withColumns({"m": F.sum("most").over(upto), "w": F.sum("weight").over(upto)})
    met = inside.where(F.lit(before) + F.col("m") + F.col("full_at") * (F.lit(after) - F.col("w")) >= total * (1 - 1e-15)).orderBy("full_at", "most", "weight").first()
    if met is None:
        return float(p["top"])
    # Those before the one where the total is met are full; it and all others get the level.
    left = after - met["w"] + met["weight"]
    return (total - before - met["m"] + met["most"]) / left if left > 0 else float(p["top"])


def split_tree(quotas: DataFrame, n_shards: int, seed: int = SEED) -> list[DataFrame]:
    """The levels of the tree, root first: node, leaves, source_id, quota. quotas:
    source_id, quota. A node's children have numbers node and node + leaves going left,
    so the nodes of the last level are the shards 0 to n_shards - 1."""
    levels = [quotas.select(F.lit(0).alias("node"), F.lit(n_shards).alias("leaves"), "source_id", "quota")]
    for level in range(max(0, math.ceil(math.log2(n_shards)))):
        urn = levels[-1].withColumn("token", F.explode(F.sequence(F.lit(1).cast("long"), F.col("quota"))))
        drawn = F.row_number().over(Window.partitionBy("node").orderBy(_hash(seed, level, "node", "source_id", "token"), "source_id", "token"))
        left = F.ceil(F.col("leaves") / 2).cast("int")
        part = F.floor(F.count("*").over(Window.partitionBy("node")) * left / F.col("leaves"))
        urn = urn.withColumn("goes_left", (drawn <= part) | (F.col("leaves") == 1))
        child = F.when(F.col("goes_left"), F.col("node")).otherwise(F.col("node") + left)
        below = F.when(F.col("leaves") == 1, F.lit(1)).when(F.col("goes_left"), left).otherwise(F.col("leaves") - left)
        levels.append(urn.groupBy(child.alias("node"), below.alias("leaves"), "source_id").agg(F.count("*").alias("quota")))
    return levels


def keyed(docs: DataFrame, *columns: Column) -> DataFrame:
    """``columns`` and what the plan needs of a row: key (its source), size, u (its hash)."""
    source = F.col("source").cast("string")
    return docs.select(*columns, F.struct(source.alias("source")).alias("key"), word_count("text").alias("size"), _hash(F.col("doc_id").cast("string"), source, F.col("text").cast("string")).alias("u"))


def told_apart(rows: DataFrame) -> DataFrame:
    """``rows`` (of ``keyed``) with another u for each further row of the same u, so that
    rows that are equal in all that counts go in or out one by one. Which of them has
    which number doesn't matter. They are numbered inside the tasks that have them, after
    the counts of the tasks before."""
    twice = rows.where("size > 0").groupBy("u").count().where("count > 1").select("u")
    twice = stage(twice, "twice", few=True)
    if twice.isEmpty():
        return rows
    some = maybe_broadcast(twice)
    again = stage(rows.join(some, "u", "left_semi").withColumn("_m", F.monotonically_increasing_id()), "repeated")
    again = again.withColumn("_p", F.shiftright("_m", 33))
    counts = again.groupBy("u", "_p").agg(F.count("*").alias("_n"))
    earlier = Window.partitionBy("u").orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)  # a row for each task
    counts = stage(counts.select("u", "_p", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_s")), "before", few=True)
    again = again.join(maybe_broadcast(counts), ["u", "_p"])
    number = F.col("_s") + F.row_number().over(Window.partitionBy("u", "_p").orderBy("_m")) - 1
    again = again.withColumn("_k", number).withColumn("u", F.when(F.col("_k") > 0, _hash("u", "_k")).otherwise(F.col("u")))
    return rows.join(some, "u", "left_anti").unionByName(again.select(*rows.columns))


def _cut_range(cut: DataFrame, state: DataFrame) -> DataFrame:
    """Narrows state (key, lo, span: the places lo to lo + span; gap: words that still fit) to the
    ranges where documents, in order, stop fitting, with their number of documents.
    cut: key, size, at (place of 63 bits)."""
    for _ in range(CUT_LEVELS):
        if not (state.agg(F.max("n_docs")).first()[0] or 0) > CUT_DOCS:
            break
        wide = state.where(F.col("n_docs") > CUT_DOCS).withColumn("step", F.shiftright("span", CUT_BITS) + 1)
        inside = cut.join(maybe_broadcast(wide.drop("n_docs")), "key").where("at >= lo AND at - lo <= span")
        bins = inside.groupBy("key", F.expr("(at - lo) div step").alias("bin")).agg(
            F.sum("size").alias("words"), F.count("*").alias("n_docs"), F.first("lo").alias("lo"), F.first("step").alias("step"), F.first("gap").alias("gap")
        )
        upto = F.sum("words").over(Window.partitionBy("key").orderBy("bin"))  # at most 2^CUT_BITS rows of a source
        met = bins.withColumn("upto", upto).where("upto > gap").groupBy("key").agg(F.min_by(F.struct("bin", "lo", "step", "gap", "upto", "words", "n_docs"), "bin").alias("b"))
        met = met.select("key", (F.col("b.lo") + F.col("b.bin") * F.col("b.step")).alias("lo"), (F.col("b.step") - 1).alias("span"), (F.col("b.gap") - F.col("b.upto") + F.col("b.words")).alias("gap"), F.col("b.n_docs").alias("n_docs"))
        state = stage(state.where(F.col("n_docs") <= CUT_DOCS).unionByName(met), "cut", few=True)
    return state


def deal(rows: DataFrame, sized: DataFrame, repeats: int = REPEATS, weights: dict[str, float] | None = None, n_shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """``rows`` (of ``keyed``) with source_size, target and draws, an array of
    struct(shard, position, place, pass): where each copy goes (empty: nowhere). sized:
    key, size, u of the same rows, written before."""
    sources = sized.groupBy("key").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    sources = stage(targets(sources.select(F.col("key.source").alias("source"), "source_size", "n_docs"), repeats, weights), "sources", few=True)
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    n_blocks = BLOCKS_A_SHARD * n_shards
    count = F.greatest(F.lit(1), F.least(F.ceil(F.col("source_size") * n_blocks / F.lit(max(total, 1))), F.floor(F.col("n_docs") / BLOCK_DOCS))).cast("long")
    whole = F.least(F.floor(F.col("target") / F.greatest("source_size", F.lit(1))), F.lit(repeats)).cast("int")
    sources = sources.select(F.struct("source").alias("key"), F.xxhash64(F.lit(seed), "source").alias("source_id"), "source_size", "target", count.alias("n_blocks"), whole.alias("whole"), F.greatest(F.col("target") - whole * F.col("source_size"), F.lit(0.0)).alias("rest"))
    with_source = lambda x: x.join(maybe_broadcast(sources), "key").withColumn("block", F.pmod(F.col("u"), F.col("n_blocks")))

    # Words of each block, and of those before it in the permuted order of its source.
    blocks = with_source(sized).groupBy("key", "source_id", "block").agg(F.sum("size").alias("words"), F.count("*").alias("n_docs"), F.first("whole").alias("whole"), F.first("rest").alias("rest")).where("words > 0")
    order = Window.partitionBy("source_id").orderBy(_hash(seed + 1, "source_id", "block"), "block")
    blocks = blocks.withColumn("left", F.col("rest") - F.coalesce(F.sum("words").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    # more: in the partial pass whole; cut: words of the block where the target is met.
    blocks = stage(blocks.withColumns({"more": F.col("left") >= F.col("words"), "cut": F.when((F.col("left") > 0) & (F.col("left") < F.col("words")), F.col("left"))}), "blocks", few=True)
    extra = F.col("more") | F.col("cut").isNotNull()
    passes = F.col("whole") + F.when(extra, 1).otherwise(0)
    tokens = blocks.where(passes > 0).select("key", "source_id", "block", F.explode(F.sequence(F.lit(0), passes - 1)).alias("pass"), "whole", "cut")

    # Quotas down the tree, then each source's permuted tokens to the shards by them.
    leaves = split_tree(tokens.groupBy("source_id").agg(F.count("*").alias("quota")), n_shards, seed)[-1]
    leaves = stage(leaves.select(F.col("node").alias("shard"), "source_id", "quota"), "leaves", few=True)
    shards = Window.partitionBy("source_id").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    slots = leaves.withColumn("before", F.coalesce(F.sum("quota").over(shards), F.lit(0)))
    slots = slots.select("source_id", "shard", F.explode(F.sequence(F.col("before") + 1, F.col("before") + F.col("quota"))).alias("slot"))
    permuted = Window.partitionBy("source_id").orderBy(_hash(seed + 2, "source_id", "block", "pass"), "block", "pass")
    drawn = tokens.withColumn("slot", F.row_number().over(permuted).cast("long")).join(slots, ["source_id", "slot"])
    drawn = drawn.withColumn("position", F.row_number().over(Window.partitionBy("shard").orderBy(_hash(seed + 3, "source_id", "block", "pass"), "source_id", "block", "pass")))
    partial = F.col("cut").isNotNull() & (F.col("pass") == F.col("whole"))
    runs = drawn.groupBy("key", "block").agg(F.collect_list(F.struct("pass", "shard", "position", partial.alias("partial"))).alias("runs"))  # at most ``repeats`` + 1 each
    runs = stage(runs, "runs", few=True)

    # The documents of the blocks where targets are met, in permuted order.
    at = F.shiftrightunsigned(_hash(seed + 4, "u"), 1)
    met = stage(blocks.where("cut IS NOT NULL").select("key", "block", F.col("cut").alias("gap"), F.lit(0).cast("long").alias("lo"), F.lit((1 << 63) - 1).alias("span"), "n_docs"), "met", few=True)
    cut = with_source(sized.where("size > 0")).select("key", "block", "size", "u", at.alias("at")).join(maybe_broadcast(met.select("key", "block")), ["key", "block"])
    cut = stage(cut.drop("block"), "partial")
    state = _cut_range(cut, met.drop("block"))
    last = cut.join(maybe_broadcast(state), "key").where("at >= lo AND at - lo <= span")
    # Several permutations are filled, each round with what still fits; the nearest is taken.
    last = last.withColumn("trial", F.explode(F.sequence(F.lit(0), F.lit(TRIES - 1)))).withColumn("at", _hash(seed + 5, "u", "trial"))
    every = Window.partitionBy("key", "trial")
    # Every other permutation begins with its first document even if that is too much.
    begins = (F.rank().over(every.orderBy("at")) == 1) & (F.col("trial") % 2 == 1) & (F.col("size") < 2 * F.col("gap"))
    last = last.withColumn("taken", begins).withColumn("gap", F.col("gap") - F.sum(F.when(F.col("taken"), F.col("size")).otherwise(0)).over(every))
    # Rows of a hash are in or out together. The first permutation is by size, for sources
    # that a few long documents make up.
    order = every.orderBy(F.when(F.col("trial") == 0, -F.col("size")).otherwise(0), "at").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    for _ in range(FILLS):
        fits = ~F.col("taken") & (F.col("size") <= F.col("gap"))
        last = last.withColumn("upto", F.sum(F.when(fits, F.col("size")).otherwise(0)).over(order))
        last = last.withColumn("new", fits & (F.col("upto") <= F.col("gap")))
        last = last.withColumn("gap", F.col("gap") - F.sum(F.when(F.col("new"), F.col("size")).otherwise(0)).over(every))
        last = last.withColumn("taken", F.col("taken") | F.col("new"))
    # One more that leaves at most half of the difference.
    off = F.when(~F.col("taken") & (2 * F.abs(F.col("size") - F.col("gap")) <= F.col("gap")), F.abs(F.col("size") - F.col("gap")))
    last = last.withColumn("off", off).withColumn("best", F.min(F.struct(F.col("off").isNull().alias("none"), "off", "at")).over(every))
    last = last.withColumn("taken", F.col("taken") | (F.col("off").isNotNull() & (F.col("at") == F.col("best.at"))))
    last = last.withColumn("nearest", F.min(F.struct(F.coalesce("best.off", F.abs("gap")).alias("left"), "trial")).over(Window.partitionBy("key")))
    last = stage(last.where("taken AND trial = nearest.trial").select("key", "u").distinct().withColumn("filled", F.lit(True)), "filled", few=True)

    dealt = with_source(rows).join(maybe_broadcast(runs, 160), ["key", "block"], "left")
    dealt = dealt.join(maybe_broadcast(state.select("key", "lo")), "key", "left").join(maybe_broadcast(last), ["key", "u"], "left")
    inside = (at < F.col("lo")) | F.coalesce(F.col("filled"), F.lit(False))
    place = lambda r: F.struct(r["shard"].alias("shard"), r["position"].alias("position"), _hash(seed + 6, "u", r["pass"]).alias("place"), r["pass"].alias("pass"))
    none = F.array().cast("array<struct<shard:int,position:int,place:bigint,pass:int>>")
    draws = F.when(F.col("size") > 0, F.coalesce(F.transform(F.filter("runs", lambda r: ~r["partial"] | inside), place), none)).otherwise(none)
    return dealt.select(*rows.columns, "source_size", "target", draws.alias("draws"))


def plan(docs: DataFrame, **options) -> DataFrame:
    """A row for each document: doc_id, source, size, source_size, target and draws."""
    rows = told_apart(stage(keyed(docs, F.col("doc_id").cast("long").alias("doc_id")), "sizes"))
    return deal(rows, rows.drop("doc_id"), **options).select("doc_id", F.col("key.source").alias("source"), "size", "source_size", "target", "draws")


def mix(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that the plan takes, as often as it does, with mix_shard,
    mix_order (blocks in permuted order, shuffled inside) and mix_pass. Texts are read
    twice and never shuffled here; ``in_shard_order`` brings shards together."""
    dealt = deal(told_apart(keyed(docs, F.struct("*").alias("row"))), told_apart(stage(keyed(docs), "sizes")), **options)
    drawn = dealt.select("row", F.explode("draws").alias("draw"))
    order = F.struct(F.col("draw.position").alias("block"), F.col("draw.place").alias("place"))
    own = [F.col("row").getField(c).alias(c) for c in docs.columns if c not in ("mix_shard", "mix_order", "mix_pass")]
    return drawn.select(*own, F.col("draw.shard").alias("mix_shard"), order.alias("mix_order"), F.col("draw.pass").alias("mix_pass"))


def in_shard_order(mixed: DataFrame, slices: int = SLICES) -> DataFrame:
    """Rows of ``mix`` with each block of a shard in order. A block is cut in ``slices``
    by place, and a slice goes to one task, which sorts what it has: places are hashes, so
    slices of a block are alike, and no sampling of the rows is needed to find ranges."""
    slice_of = F.pmod(F.shiftrightunsigned("mix_order.place", 32), F.lit(slices))
    return mixed.repartition("mix_shard", "mix_order.block", slice_of).sortWithinPartitions("mix_shard", "mix_order.block", slice_of, "mix_order.place")


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix of all documents, by document; shards: where its copies go."""
    rows = plan(table(spark, sf_dir, "documents"))
    shards = F.array_sort(F.transform("draws", lambda d: d["shard"]))
    return rows.select("doc_id", "size", "source_size", "target", (F.col("size") * F.size("draws")).cast("long").alias("taken"), shards.alias("shards"))
