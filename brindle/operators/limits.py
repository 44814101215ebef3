"""Rate limits as scans: when each request of a log would have been let through.

A bucket holds at most ``most`` tokens, begins full and gains ``rate`` a second. Requests are
served in order of arrival, each as soon as its tokens are there. Let v be the time at which
the bucket would be full if nothing more came. A request of c tokens that arrives at a
finds v' = max(v, a), is let through at max(a, v' - (most - c) / rate), and leaves
v' + c / rate: what is over ``most`` it waits for, and is then owed. So a request is the map
v -> max(v + b, d) with b = c / rate and d = a + c / rate, a (max, +) affine map; such maps compose
to such maps, and a range of requests is one pair (b, d), found without knowing where it
begins. Pairs of ranges are composed over ranges of ranges until one range is left; then
the starts go down the same way, and each range is scanned on its own. No task has more
than ``range_rows`` requests or pairs, and nothing is collected.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.operators.selection import small
from brindle.sources.order import with_row_id, written


def _composed(pdf: pd.DataFrame) -> pd.DataFrame:
    """The map of a range of maps (_b, _d), in order of _at."""
    pdf = pdf.sort_values("_at")
    b, d = 0.0, -np.inf
    for p, q in zip(pdf["_b"], pdf["_d"]):
        b, d = b + p, max(d + p, q)
    return pd.DataFrame({"_range": pdf["_range"].iloc[:1], "_b": [b], "_d": [d]})


def _before(pdf: pd.DataFrame) -> pd.DataFrame:
    """_at and v before each map of a range that begins at _v."""
    pdf = pdf.sort_values("_at")
    v, out = float(pdf["_v"].iloc[0]), np.empty(len(pdf))
    for i, (p, q) in enumerate(zip(pdf["_b"], pdf["_d"])):
        out[i] = v
        v = max(v + p, q)
    return pd.DataFrame({"_at": pdf["_at"].to_numpy(), "_v": out})


def states_before(maps: DataFrame, range_rows: int) -> DataFrame:
    """_at, _v: the state before each map, from minus infinity. maps: _at (dense, from 0),
    _b, _d."""
    maps = maps.select("_at", "_b", "_d").withColumn("_range", F.floor(F.col("_at") / range_rows).cast("long"))
    if maps.agg(F.max("_range")).first()[0]:
        ranges = written(maps.groupBy("_range").applyInPandas(_composed, "_range long, _b double, _d double"), "maps")
        begin = written(states_before(ranges.withColumnRenamed("_range", "_at"), range_rows), "starts")
        maps = maps.join(small(begin.withColumnRenamed("_at", "_range")), "_range")
    else:
        maps = maps.withColumn("_v", F.lit(float("-inf")))
    return maps.groupBy("_range").applyInPandas(_before, "_at long, _v double")


def token_bucket(df: DataFrame, arrival: str, tokens: str, rate: float, most: float | None = None, order: list[str] | None = None, range_rows: int = 1 << 16) -> DataFrame:
    """Adds started (when a request's tokens are there) and waited, in seconds, for requests
    in order of ``arrival`` (seconds, not null; ties: ``order``, which should tell rows apart).
    ``most`` is ``rate`` if not given. Null tokens are 0. No requests give no rows."""
    most = rate if most is None else most
    if rate <= 0 or most <= 0 or range_rows < 2:
        raise ValueError("a bucket has a positive rate and size, a range two rows at least")
    seconds, cost = F.col("_a"), F.col("_c") / rate
    rows = with_row_id(df.withColumns({"_a": F.col(arrival).cast("double"), "_c": F.coalesce(F.col(tokens).cast("double"), F.lit(0.0))}), "_a", *(order or []), name="_at")
    rows = written(rows.withColumns({"_b": cost, "_d": seconds + cost}), "requests")
    found = rows.join(states_before(rows, range_rows), "_at")
    full = F.greatest(F.col("_v"), seconds)
    started = F.greatest(seconds, full - (F.lit(most) - F.col("_c")) / rate)
    return found.withColumn("started", started).withColumn("waited", F.col("started") - seconds).drop("_at", "_a", "_c", "_b", "_d", "_v")
