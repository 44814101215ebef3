"""Exact order statistics of distributed columns: k-th values, quantiles, first k rows.

A place is found by refinement. Each round takes a mergeable sketch of the values of an
open interval, picks the two of its grid points between which the place must lie, and
counts exactly what is below and at them; the interval shrinks by about GRID / 4. When an
interval holds at most ``bin_rows`` rows, those alone are sorted. So no task ever holds
more than a sketch or a bin, only counts travel before the last round, and a value that
half of all rows have is met as a grid point, or as the least or largest of its interval.

Nulls have no place. NaN is larger than any number, as in Spark's order. Places are from 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brindle.sources.order import written

#: Grid points of a sketch, its accuracy, and rows that are sorted at most.
GRID, ACCURACY, BIN_ROWS = 64, 1000, 1 << 16
MOST_ROUNDS = 200
#: A side of a join of so many rows is broadcast.
BROADCAST_ROWS = 1 << 17


def small(df: DataFrame) -> DataFrame:
    """A broadcast hint if the (written) rows are few, counted now."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def at_places(df: DataFrame, value: str, places: DataFrame, by: list[str] | None = None, bin_rows: int = BIN_ROWS) -> DataFrame:
    """by.., place, value: the values at some places of each group. places: by.., place.
    A place that a group doesn't have gives no row. Groups are compared null-safe."""
    by = by or []
    keys = [f"_k{i}" for i in range(len(by))]
    rows = df.select(*[F.col(c).alias(k) for c, k in zip(by, keys)], F.col(value).alias("_v")).where("_v IS NOT NULL")
    kind = rows.schema["_v"].dataType
    none = F.lit(None).cast(kind)
    asked = places.select(*[F.col(c).alias(k) for c, k in zip(by, keys)], F.col("place").cast("long").alias("_id"), F.col("place").cast("long").alias("_r")).distinct()
    state = _intervals(asked.withColumns({"_lo": none, "_hi": none}), keys)
    done = asked.select(*keys, "_id", none.alias("_v")).where("false")
    for _ in range(MOST_ROUNDS):
        if state.isEmpty():
            break
        found, state = _round(rows, state, keys, bin_rows)
        done = done.unionByName(found)
    else:
        raise RuntimeError("the places did not settle")
    return done.select(*[F.col(k).alias(c) for c, k in zip(by, keys)], F.col("_id").alias("place"), F.col("_v").alias("value"))


def _intervals(rows: DataFrame, keys: list[str]) -> DataFrame:
    """An open interval (_lo, _hi; null: no bound) a row, with the places looked for in it:
    _id as asked for, _r inside the interval. They are as many as were asked for."""
    return written(rows.groupBy(*keys, "_lo", "_hi").agg(F.collect_list(F.struct("_id", "_r")).alias("_places")), "places")


def _inside(rows: DataFrame, state: DataFrame, keys: list[str]) -> DataFrame:
    """The rows in the intervals of their groups. Intervals of a group don't overlap."""
    right = small(state.withColumnsRenamed({k: f"_s{k}" for k in keys}))
    on = (F.col("_lo").isNull() | (F.col("_v") > F.col("_lo"))) & (F.col("_hi").isNull() | (F.col("_v") < F.col("_hi")))
    for k in keys:
        on = F.col(k).eqNullSafe(F.col(f"_s{k}")) & on
    return rows.join(right, on).drop(*[f"_s{k}" for k in keys])


def _round(rows: DataFrame, state: DataFrame, keys: list[str], bin_rows: int) -> tuple[DataFrame, DataFrame]:
    """(found: keys, _id, _v; intervals that are still open) after one refinement."""
    own = [*keys, "_lo", "_hi"]
    grid = F.percentile_approx("_v", [i / GRID for i in range(1, GRID)], ACCURACY)
    seen = _inside(rows, state, keys).groupBy(*own).agg(F.first("_places").alias("_places"), F.count("*").alias("_m"), F.min("_v").alias("_min"), F.max("_v").alias("_max"), grid.alias("_grid"))
    seen = written(seen.withColumn("_places", F.filter("_places", lambda p: p["_r"] < F.col("_m"))), "grid")
    # Points: the least, the largest, and for each place the grid points below and above it
    # by more than the sketch may be off.
    share = lambda p: p["_r"] / F.col("_m") * GRID
    index = lambda p: F.array(F.floor(share(p) - 0.5).cast("int"), F.ceil(share(p) + 1.5).cast("int"))
    inner = F.filter(F.flatten(F.transform("_places", index)), lambda i: (i >= 1) & (i < GRID))
    points = F.concat(F.array("_min", "_max"), F.transform(inner, lambda i: F.element_at("_grid", i)))
    seen = seen.withColumn("_points", F.array_sort(F.array_distinct(points))).drop("_grid", "_min", "_max")
    # Few rows are sorted.
    small = seen.where(F.col("_m") <= bin_rows).select(*own, "_places")
    sorted_ = _inside(rows, small, keys).withColumn("_at", (F.row_number().over(Window.partitionBy(*own).orderBy("_v")) - 1).cast("long"))
    found = sorted_.select(*keys, "_v", F.explode(F.filter("_places", lambda p: p["_r"] == F.col("_at"))).alias("_p")).select(*keys, "_p._id", "_v")
    # Many are counted by cell: a point, or what lies between two.
    wide = seen.where(F.col("_m") > bin_rows).select(*own, "_places", "_points")
    cell = F.size(F.filter("_points", lambda p: p < F.col("_v")))
    rows_in = _inside(rows, wide, keys).withColumn("_cell", cell).withColumn("_hit", F.coalesce(F.try_element_at("_points", F.col("_cell") + 1) == F.col("_v"), F.lit(False)))
    cells = rows_in.groupBy(*own, "_cell", "_hit").agg(F.count("*").alias("_n"), F.first("_places").alias("_places"), F.first("_points").alias("_points"))
    before = Window.partitionBy(*own).orderBy("_cell", "_hit").rowsBetween(Window.unboundedPreceding, -1)  # a few cells
    cells = cells.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    mine = F.filter("_places", lambda p: (p["_r"] >= F.col("_before")) & (p["_r"] < F.col("_before") + F.col("_n")))
    met = cells.select(*own, "_cell", "_hit", "_before", "_points", F.explode(mine).alias("_p"))
    met = written(met.select(*own, "_hit", "_p._id", (F.col("_p._r") - F.col("_before")).alias("_r"), F.when(F.col("_cell") > 0, F.try_element_at("_points", F.greatest("_cell", F.lit(1)))).otherwise(F.col("_lo")).alias("_below"), F.coalesce(F.try_element_at("_points", F.col("_cell") + 1), F.col("_hi")).alias("_above")), "met")
    found = written(found.unionByName(met.where("_hit").select(*keys, "_id", F.col("_above").alias("_v"))), "found")
    rest = met.where("NOT _hit").select(*keys, "_id", "_r", F.col("_below").alias("_lo"), F.col("_above").alias("_hi"))
    return found, _intervals(rest, keys)


def quantiles(df: DataFrame, value: str, shares: list[float], by: list[str] | None = None, bin_rows: int = BIN_ROWS) -> DataFrame:
    """by.., share, value: exact quantiles of each group, linear between neighbours. Groups
    without a value have no row."""
    by = by or []
    kept = df.where(F.col(value).isNotNull())
    counts = kept.groupBy(*by).agg(F.count("*").alias("_n")).where("_n > 0")
    each = counts.select("*", F.explode(F.array(*[F.lit(float(q)) for q in shares])).alias("share"))
    at = F.col("share") * (F.col("_n") - 1)
    each = written(each.withColumns({"_low": F.floor(at).cast("long"), "_part": at - F.floor(at)}), "shares")
    each = each.withColumn("_high", F.when(F.col("_part") > 0, F.col("_low") + 1).otherwise(F.col("_low")))
    places = each.select(*by, F.explode(F.array("_low", "_high")).alias("place")).distinct()
    found = at_places(df, value, places, by, bin_rows).withColumn("value", F.col("value").cast("double"))

    def joined(left: DataFrame, place: str, name: str) -> DataFrame:
        right = found.select(*[F.col(c).alias(f"_r_{c}") for c in by], F.col("place").alias("_r_place"), F.col("value").alias(name))
        on = F.col(place) == F.col("_r_place")
        for c in by:
            on = on & F.col(c).eqNullSafe(F.col(f"_r_{c}"))
        return left.join(right, on).drop("_r_place", *[f"_r_{c}" for c in by])

    both = joined(joined(each, "_low", "_a"), "_high", "_b")
    value_of = F.when(F.col("_a") == F.col("_b"), F.col("_a")).otherwise(F.col("_a") + F.col("_part") * (F.col("_b") - F.col("_a")))
    return both.select(*by, "share", value_of.alias("value"))


def first_rows(df: DataFrame, order: list[Column], k: int, bin_rows: int = BIN_ROWS) -> DataFrame:
    """The first k rows in a total order of numbers (for a descending one give the
    negative), unsorted, whatever k is: the k-th place is found column by column, and what
    comes before it is a filter. Rows with a null in ``order`` have no place. Rows equal in
    all of ``order`` stay or go together, so then there may be more than k."""
    if k <= 0:
        return df.where("false")
    names = [f"_o{i}" for i in range(len(order))]
    keyed = df.withColumns(dict(zip(names, order)))
    rows = written(keyed.select(*names).dropna(), "order")
    if rows.count() <= k:
        return keyed.dropna(subset=names).drop(*names)
    place, equal, before = k - 1, F.lit(True), F.lit(False)
    for name in names:
        these = rows.where(equal)
        spark = df.sparkSession
        got = at_places(these, name, spark.range(1).select(F.lit(place).cast("long").alias("place")), bin_rows=bin_rows).first()["value"]
        bound = F.lit(got).cast(rows.schema[name].dataType)
        less, same = these.agg(F.count(F.when(F.col(name) < bound, 1)), F.count(F.when(F.col(name) == bound, 1))).first()
        before, equal, place = before | (equal & (F.col(name) < bound)), equal & (F.col(name) == bound), place - less
        if place == same - 1:
            break  # all rows that are equal so far belong to the first k
    return keyed.where(before | equal).drop(*names)
