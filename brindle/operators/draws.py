"""Multinomial draws over distributed rows, by splitting.

n draws over all rows are n draws over ranges of rows by the ranges' weights, and then, given
how many a range got, so many over its rows: the joint distribution is the same. Ranges are
split the same way, so a task never has more than ``range_rows`` rows or ranges, and only
one row, the sum of all weights, is known to all. Each node draws with a generator of its own
(seed, level, number), so that a repeated task draws the same."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.operators.selection import small
from brindle.sources.order import with_row_id, written


def _split(rows: DataFrame, seed: int, level: int, range_rows: int, draws: int) -> DataFrame:
    """_at, draws of rows (_at dense from 0, _w)."""
    rows = rows.select("_at", "_w").withColumn("_range", F.floor(F.col("_at") / range_rows).cast("long"))
    if rows.agg(F.max("_range")).first()[0]:
        ranges = written(rows.groupBy("_range").agg(F.sum("_w").alias("_w")), "ranges")
        given = _split(ranges.withColumnRenamed("_range", "_at"), seed, level + 1, range_rows, draws)
        rows = rows.join(small(written(given.select(F.col("_at").alias("_range"), F.col("draws").alias("_n")), "given")), "_range")
    else:
        rows = rows.withColumn("_n", F.lit(draws).cast("long"))

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_at")
        weights, n = pdf["_w"].to_numpy(dtype=float), int(pdf["_n"].iloc[0])
        rng = np.random.default_rng([seed, level, int(pdf["_range"].iloc[0])])
        got = rng.multinomial(n, weights / weights.sum()) if n else np.zeros(len(weights), dtype=np.int64)
        return pd.DataFrame({"_at": pdf["_at"].to_numpy()[got > 0], "draws": got[got > 0]})

    return rows.where("_n > 0").groupBy("_range").applyInPandas(one, "_at long, draws long")


def multinomial(df: DataFrame, weight: str, key: list[str], draws: int | None = None, seed: int = 0, range_rows: int = 1 << 16) -> DataFrame:
    """The rows that are drawn, with ``draws``: how often, of ``draws`` (as many as there are
    rows) with replacement by ``weight``. ``key`` gives the order that a seed refers to, and
    should tell rows apart. A negative, null or infinite weight raises; without any positive
    weight nothing can be drawn, which raises too. No rows give no rows."""
    bad = F.col(weight).isNull() | ~(F.col(weight) >= 0) | (F.col(weight) == float("inf"))
    checked = F.when(bad, F.raise_error(F.lit("a weight is negative or no number")).cast("double")).otherwise(F.col(weight).cast("double"))
    placed = written(with_row_id(df.withColumn("_w", checked), *key, name="_at"), "weighed")
    total = placed.agg(F.sum("_w").alias("w"), F.count("*").alias("n")).first()
    if not total["n"]:
        return placed.drop("_at", "_w").withColumn("draws", F.lit(0).cast("long"))
    if not total["w"]:
        raise ValueError("no row has a weight")
    got = _split(placed.where("_w > 0 OR _at >= 0"), seed, 0, range_rows, total["n"] if draws is None else draws)
    return placed.join(got, "_at").drop("_at", "_w")


def resampled(drawn: DataFrame) -> DataFrame:
    """A row for each draw, with copy, from 1."""
    return drawn.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("draws")))).drop("draws")
