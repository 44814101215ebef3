"""Balance inside batches: every batch of a table on its own, as grouped functions.

A batch is a run of ``size`` neighbouring rows (by a dense row_id), so a group is never more
than that; any number of batches are balanced in parallel and nothing meets on the driver.
The methods are those of ``balance`` on the batch's own rows in order of row_id; ties go as
there. Results carry where each row goes."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.operators import balance as K

METHODS: dict[str, Callable[..., list[list[int]]]] = {"differencing": K.largest_differencing, "greedy": K.greedy}


def ends_small(part: list[int], loads: list[int]) -> list[int]:
    """Items by load (ties: place), every other one forward and the rest backward: small ones
    at both ends."""
    ranked = sorted(part, key=lambda i: (loads[i], i))
    return ranked[::2] + ranked[1::2][::-1]


def micro_order(parts: list[list[int]], loads: list[int]) -> list[list[int]]:
    """Micro-batches with small ones at both ends: by load, largest first (ties: the larger
    first item), every other one backward, then the rest."""
    ranked = sorted(parts, key=lambda p: (sum(loads[i] for i in p), p[0] if p else 0), reverse=True)
    return ranked[::2][::-1] + ranked[1::2]


def _by_batch(df: DataFrame, size: int, columns: list[str], run: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    rows = df.select("row_id", *dict.fromkeys(columns)).withColumn("batch", F.floor(F.col("row_id") / size).cast("long"))
    return rows.groupBy("batch").applyInPandas(lambda pdf: run(pdf.sort_values("row_id", ignore_index=True)), schema)


def _placed(pdf: pd.DataFrame, parts: list[list[int]], size: int) -> pd.DataFrame:
    order = np.array([i for p in parts for i in p], dtype=np.int64)
    part = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
    place = np.concatenate([np.arange(len(p)) for p in parts]) if parts else np.zeros(0, np.int64)
    rows = pdf["row_id"].to_numpy()[order]
    first = pdf["batch"].to_numpy()[:1].repeat(len(order)) * size
    return pd.DataFrame({"row_id": rows, "batch": pdf["batch"].to_numpy()[order], "part": part, "place": place, "new_row_id": first + np.arange(len(order))})


PLACED = "row_id long, batch long, part int, place int, new_row_id long"


def balance_batches(df: DataFrame, size: int, parts: int, load: str = "load", method: str = "differencing", equal_size: bool = True, minibatch: int | None = None, arrange: bool = True) -> DataFrame:
    """row_id, batch, part, place, new_row_id: each batch dealt to ``parts`` ranks of like
    load, whose rows follow each other; ``minibatch`` balances runs of so many rows on their
    own (what is over after the last is dropped), and a rank has its share of each in turn.
    ``arrange`` puts small rows at both ends of a rank."""
    if method not in METHODS:
        raise ValueError(f"method {method!r}: {sorted(METHODS)}")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        loads = [int(x) for x in pdf["load"]]
        step = minibatch or len(loads)
        found: list[list[int]] = [[] for _ in range(parts)]
        for at in range(0, len(loads) // step * step if minibatch else 1, step):
            some = loads[at : at + step]
            for p, items in enumerate(K.checked(METHODS[method](some, parts, equal_size), len(some), equal_size)):
                found[p] += [at + i for i in items]
        return _placed(pdf, [ends_small(p, loads) if arrange else p for p in found], size)

    return _by_batch(df.withColumn("load", F.col(load).cast("long")), size, ["load"], run, PLACED)


def balance_groups(df: DataFrame, size: int, parts: int, group: str, load: str = "load") -> DataFrame:
    """As ``balance_batches``, with all rows of a group (of a batch) on one rank: groups in
    order of their first row, as many on each rank, their rows in order. A number of groups
    that the ranks don't divide raises."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        members: dict[object, list[int]] = {}
        for i, g in enumerate(pdf["group"]):
            members.setdefault(g, []).append(i)
        runs = list(members.values())
        if len(runs) % parts:
            raise ValueError(f"{len(runs)} groups don't make {parts} equal parts")
        loads = [int(x) for x in pdf["load"]]
        found = K.checked(K.largest_differencing([sum(loads[i] for i in r) for r in runs], parts, True), len(runs), True)
        return _placed(pdf, [[i for g in p for i in runs[g]] for p in found], size)

    return _by_batch(df.withColumns({"load": F.col(load).cast("long"), "group": F.col(group)}), size, ["load", "group"], run, PLACED)


def micro_batches(df: DataFrame, size: int, most_tokens: int, length: str, load: str = "load", multiple: int = 1, least: int = 1, group: int = 1) -> DataFrame:
    """row_id, batch, part, place, new_row_id: each batch cut in as few micro-batches as
    ``most_tokens`` tokens each allow on average (at least ``least``, a multiple of
    ``multiple``), of like load, small ones at both ends; ``group`` neighbours stay together.
    A row of more tokens, or a batch with fewer groups than micro-batches, raises."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        lengths, loads = ([int(x) for x in pdf[c]] for c in ("length", "load"))
        if max(lengths) > most_tokens:
            raise ValueError(f"a row of {max(lengths)} tokens, at most {most_tokens}")
        if len(lengths) % group:
            raise ValueError(f"{len(lengths)} rows aren't groups of {group}")
        n = len(lengths) // group
        bins = max(least, min(n, -(-sum(lengths) // most_tokens)))
        bins = -(-bins // multiple) * multiple
        if bins > n:
            raise ValueError(f"{n} groups can't make {bins} micro-batches")
        sums = [sum(loads[i * group : (i + 1) * group]) for i in range(n)]
        ordered = micro_order(K.checked(K.largest_differencing(sums, bins), n), sums)
        return _placed(pdf, [[g * group + j for g in p for j in range(group)] for p in ordered], size)

    return _by_batch(df.withColumns({"load": F.col(load).cast("long"), "length": F.col(length).cast("long")}), size, ["load", "length"], run, PLACED)
