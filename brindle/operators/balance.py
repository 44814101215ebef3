"""Balanced partitions of samples by workload.

A table of more than BLOCK items is balanced by differencing in two steps: blocks of it in
tasks, then the blocks' sums, a row for each part of a block, on the driver. Greedy and
grouped partitions are global, sequential methods: their (id, workload) pairs meet on the
driver, and more than MOST_ITEMS raise. Results go back as a column. Reports and permutations
stay DataFrame operations."""

from __future__ import annotations

import heapq

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.sources.order import with_row_id, written

MOST_ITEMS = 5_000_000
#: Items that are balanced in one task.
BLOCK = 1 << 15


def workload(length: Column) -> Column:
    """Cost of a sequence: linear layers and attention."""
    return 24576 * length + length * length


class _Split:
    """A partial solution: k subsets with their sums, largest first."""

    __slots__ = ("subsets",)

    def __init__(self, subsets: list[tuple[int, list[int]]]):
        self.subsets = sorted(subsets, key=lambda s: (s[0], len(s[1]), s[1]), reverse=True)

    @property
    def spread(self) -> int:
        return self.subsets[0][0] - self.subsets[-1][0]

    def joined(self, other: _Split) -> _Split:
        """Largest with smallest."""
        return _Split([(a[0] + b[0], a[1] + b[1]) for a, b in zip(self.subsets, reversed(other.subsets))])


def largest_differencing(loads: list[int], k: int, equal_size: bool = False) -> list[list[int]]:
    """k subsets of indexes by the differencing method: the two partial solutions of
    the widest spread are joined until one is left. equal_size starts from runs of k
    sorted items, so that all subsets have as many."""
    if len(loads) < k or equal_size and len(loads) % k:
        raise ValueError(f"{len(loads)} items can't make {k} {'equal ' if equal_size else ''}parts")
    order = sorted(range(len(loads)), key=lambda i: (loads[i], i))
    if equal_size:
        states = [_Split([(loads[i], [i]) for i in order[at : at + k]]) for at in range(0, len(order), k)]
    else:
        states = [_Split([(loads[i], [i]), *[(0, []) for _ in range(k - 1)]]) for i in order]
    return _merged(states)


def _merged(states: list[_Split]) -> list[list[int]]:
    """The subsets left when the two partial solutions of the widest spread are joined until
    one is left."""
    heap = [(-s.spread, n, s) for n, s in enumerate(states)]
    heapq.heapify(heap)
    n = len(heap)
    while len(heap) > 1:
        a, b = heapq.heappop(heap)[2], heapq.heappop(heap)[2]
        s = a.joined(b)
        heapq.heappush(heap, (-s.spread, n, s))
        n += 1
    return [sorted(items) for _, items in heap[0][2].subsets]


def greedy(loads: list[int], k: int, equal_size: bool = False) -> list[list[int]]:
    """Items in input order to the part of the least sum (of those with room)."""
    if equal_size and len(loads) % k:
        raise ValueError(f"{len(loads)} items can't make {k} equal parts")
    heap = [(0, p) for p in range(k)]
    parts: list[list[int]] = [[] for _ in range(k)]
    room = len(loads) // k if equal_size else len(loads)
    for i, load in enumerate(loads):
        total, p = heapq.heappop(heap)
        parts[p].append(i)
        if len(parts[p]) < room or not equal_size:
            heapq.heappush(heap, (total + load, p))
    return parts


def checked(parts: list[list[int]], n: int, equal_size: bool = False) -> list[list[int]]:
    """Every index once; no part empty; equal sizes where asked for."""
    if sorted(i for p in parts for i in p) != list(range(n)) or any(not p for p in parts) or equal_size and len({len(p) for p in parts}) > 1:
        raise AssertionError("not a partition")
    return parts


def zigzag(parts: list[list[int]], loads: list[int]) -> list[list[int]]:
    """Parts by load: every other one of the sorted ones, then the rest backwards, so
    that small ones are at both ends."""
    order = sorted(parts, key=lambda p: (sum(loads[i] for i in p), p[0] if p else 0))
    return order[::2] + order[1::2][::-1]


def collect_loads(df: DataFrame, key: str, load: str) -> tuple[list, list[int]]:
    rows = df.select(key, load).orderBy(key).limit(MOST_ITEMS + 1).collect()
    if len(rows) > MOST_ITEMS:
        raise ValueError(f"a batch of more than {MOST_ITEMS} items: split it first")
    return [r[0] for r in rows], [int(r[1]) for r in rows]


def in_blocks(df: DataFrame, key: str, load: str, k: int, n: int, equal_size: bool = False, block: int = BLOCK) -> DataFrame:
    """key, part of n rows by differencing in blocks of about ``block`` items. Items are dealt
    to blocks by a hash of the key, k at a time, so blocks are alike and only the last may
    not be a multiple of k. A block's parts are joined to those of others as partial
    solutions, largest with smallest: the spread of the whole is at most that of one block."""
    if n < k or equal_size and n % k:
        raise ValueError(f"{n} items can't make {k} {'equal ' if equal_size else ''}parts")
    blocks = max(1, n // max(block, k))
    rows = with_row_id(df.select(F.col(key).alias("_key"), F.col(load).cast("long").alias("_load")), F.xxhash64("_key"), "_key", name="_at")
    rows = rows.select("_key", "_load", (F.floor(F.col("_at") / k) % blocks).alias("_block"))
    kind = rows.schema["_key"].dataType.simpleString()

    def split(group: pa.Table) -> pa.Table:
        group = group.sort_by("_key")
        loads = group.column("_load").to_pylist()
        subset = [0] * len(loads)
        for p, items in enumerate(checked(largest_differencing(loads, k, equal_size), len(loads), equal_size)):
            for i in items:
                subset[i] = p
        return group.append_column("_subset", pa.array(subset, pa.int32()))

    rows = written(rows.groupBy("_block").applyInArrow(split, f"_key {kind}, _load long, _block long, _subset int"), "blocks")
    sums = rows.groupBy("_block", "_subset").agg(F.sum("_load").alias("load")).orderBy("_block", "_subset").collect()  # k rows a block
    states: dict[int, list] = {}
    for i, r in enumerate(sums):
        states.setdefault(r["_block"], []).append((r["load"], [i]))
    parts = _merged([_Split(s) for s in states.values()])
    places = [(sums[i]["_block"], sums[i]["_subset"], p) for p, items in enumerate(parts) for i in items]
    places = df.sparkSession.createDataFrame(places, "_block long, _subset int, part int")
    return rows.join(F.broadcast(places), ["_block", "_subset"]).select(F.col("_key").alias(key), "part")


def assign(df: DataFrame, key: str, load: str, k: int, equal_size: bool = False, method=largest_differencing) -> DataFrame:
    """Adds part, 0..k-1, for rows of distinct keys."""
    if method is largest_differencing:
        n = df.count()
        if n > BLOCK:
            return df.join(in_blocks(df, key, load, k, n, equal_size), key)
    keys, loads = collect_loads(df, key, load)
    parts = checked(method(loads, k, equal_size), len(loads), equal_size)
    pairs = [(keys[i], p) for p, items in enumerate(parts) for i in items]
    return df.join(df.sparkSession.createDataFrame(pairs, f"{key} {df.schema[key].dataType.simpleString()}, part int"), key)


def assign_groups(df: DataFrame, key: str, group: str, load: str, k: int) -> DataFrame:
    """Adds part; neighbouring rows (by key) of one group, a run, stay together. The batch
    is balanced on the driver, like ``assign``'s."""
    rows = df.select(key, group, load).orderBy(key).limit(MOST_ITEMS + 1).collect()
    if len(rows) > MOST_ITEMS:
        raise ValueError(f"a batch of more than {MOST_ITEMS} items: split it first")
    runs: list[list] = []
    for i, r in enumerate(rows):
        if i and r[1] == rows[i - 1][1]:
            runs[-1].append(r)
        else:
            runs.append([r])
    parts = checked(largest_differencing([sum(int(r[2]) for r in run) for run in runs], k), len(runs))
    pairs = [(r[0], p) for p, items in enumerate(parts) for i in items for r in runs[i]]
    return df.join(df.sparkSession.createDataFrame(pairs, f"{key} {df.schema[key].dataType.simpleString()}, part int"), key)


def micro_batches(loads: list[int], lengths: list[int], most_tokens: int, multiple: int = 1, group: int = 1) -> list[list[int]]:
    """Balanced bins of at most about most_tokens, as many as needed, rounded up to a
    multiple; ``group`` neighbouring items stay together."""
    n = len(lengths) // group
    sums = [sum(loads[i * group : (i + 1) * group]) for i in range(n)]
    bins = min(n, -(-sum(lengths) // most_tokens))
    bins = min(n, -(-bins // multiple) * multiple)
    parts = largest_differencing(sums, max(bins, 1))
    return [[i * group + j for i in p for j in range(group)] for p in parts]


def imbalance(df: DataFrame, part: str, load: str) -> DataFrame:
    """Least, largest and mean load of the parts, and the largest over the mean."""
    g = df.groupBy(part).agg(F.sum(load).alias("load"))
    return g.agg(F.min("load").alias("min"), F.max("load").alias("max"), F.avg("load").alias("mean"), F.try_divide(F.max("load"), F.avg("load")).alias("ratio"))


def inverse(df: DataFrame, pos: str = "pos", row: str = "row_id") -> DataFrame:
    """The permutation that undoes one."""
    return df.select(F.col(row).alias(pos), F.col(pos).alias(row))
