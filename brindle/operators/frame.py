"""Batch algebra: columns and rows of frames that carry a dense ``row_id`` from 0.

Positional operators are arithmetic on row_id and equi-joins on it; row_id is renumbered
by formula wherever one exists, so that nothing is sorted again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brindle.operators.selection import first_rows
from brindle.sources.order import with_row_id


class MetaConflict(ValueError):
    """Two batches disagree on a value of their meta information."""


def merge_meta(*metas: dict, lists: tuple[str, ...] = ("metrics",)) -> dict:
    """Union of batch-wide values; differing ones raise, but for ``lists``, which join."""
    out: dict = {}
    for meta in metas:
        for k, v in meta.items():
            if k in lists:
                out.setdefault(k, []).extend(v if isinstance(v, list) else [v])
            elif k in out and out[k] != v:
                raise MetaConflict(f"{k}: {out[k]!r} and {v!r}")
            else:
                out[k] = v
    return out


def select(df: DataFrame, *names: str) -> DataFrame:
    return df.select("row_id", *[n for n in names if n != "row_id"])


def pop(df: DataFrame, *names: str) -> tuple[DataFrame, DataFrame]:
    """(what is left, the popped columns); a missing name raises."""
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise KeyError(f"no columns {missing}")
    return df.drop(*names), select(df, *names)


def rename(df: DataFrame, old: list[str], new: list[str]) -> DataFrame:
    if len(old) != len(new):
        raise ValueError("as many new names as old ones are needed")
    return df.withColumnsRenamed(dict(zip(old, new)))


def gather(df: DataFrame, idx: DataFrame) -> DataFrame:
    """Rows in the order of idx (pos, row_id); repeats allowed, pos becomes row_id."""
    return idx.join(df, "row_id").drop("row_id").withColumnRenamed("pos", "row_id")


def fetch(keys: DataFrame, store: DataFrame, key: str) -> DataFrame:
    """The payload of each key, in the rows of ``keys``; a key that the store lacks raises,
    and one that it has twice comes twice."""
    here = store.withColumn("_there", F.lit(True))
    missing = F.raise_error(F.concat(F.lit("no payload for key "), F.coalesce(F.col(key).cast("string"), F.lit("null")))).cast("boolean")
    rows = keys.join(here, key, "left").withColumn("_there", F.coalesce("_there", missing))
    return rows.where("_there").drop("_there")


def data_info(df: DataFrame) -> DataFrame:
    """column, kind, rows, nulls and the longest value (elements of an array, characters of
    a string, else 1; null without values): a row for each column, of one aggregation."""
    longest = lambda c, kind: F.max(F.size(c)) if kind.startswith("array") else F.max(F.length(c)) if kind == "string" else F.max(F.when(F.col(c).isNotNull(), 1))
    each = [F.struct(F.lit(c).alias("column"), F.lit(kind).alias("kind"), F.count("*").alias("rows"), F.sum(F.when(F.col(c).isNull(), 1).otherwise(0)).cast("long").alias("nulls"), longest(c, kind).cast("long").alias("longest")) for c, kind in df.dtypes]
    return df.agg(F.array(*each).alias("x")).select(F.inline("x"))


def row_at(df: DataFrame, index: int, n_rows: int) -> DataFrame:
    """The row of one index; a negative one counts from the end, one outside raises."""
    if not -n_rows <= index < n_rows:
        raise IndexError(f"row {index} of {n_rows}")
    return df.where(F.col("row_id") == index % n_rows).withColumn("row_id", F.lit(0).cast("long"))


def python_slice(df: DataFrame, part: slice, n_rows: int) -> DataFrame:
    """Rows of a slice as of a list: negative bounds count from the end, and a negative step
    goes backwards."""
    at = range(*part.indices(n_rows))
    if not at:
        return df.where("false")
    low, high = min(at[0], at[-1]), max(at[0], at[-1])
    inside = (F.col("row_id") >= low) & (F.col("row_id") <= high) & (F.pmod(F.col("row_id") - at.start, F.lit(abs(at.step))) == 0)
    return df.where(inside).withColumn("row_id", ((F.col("row_id") - at.start) / at.step).cast("long"))


def slice_rows(df: DataFrame, start: int = 0, end: int | None = None, step: int = 1) -> DataFrame:
    where = F.col("row_id") >= start
    if end is not None:
        where = where & (F.col("row_id") < end)
    rows = df.where(where & ((F.col("row_id") - start) % step == 0))
    return rows.withColumn("row_id", ((F.col("row_id") - start) / step).cast("long"))


def reorder(df: DataFrame, place: Column) -> DataFrame:
    """``place``: the new position of each row, a permutation."""
    return df.withColumn("row_id", place.cast("long"))


def union_columns(a: DataFrame, b: DataFrame) -> DataFrame:
    """Columns of both, by row_id. Shared columns must agree in every row (null and NaN
    equal themselves), which is checked as rows pass."""
    shared = [c for c in b.columns if c in a.columns and c != "row_id"]
    right = b.withColumnsRenamed({c: f"_r_{c}" for c in shared})
    rows = a.join(right, "row_id", "full_outer" if shared else "inner")
    for c in shared:
        wrong = F.raise_error(F.concat(F.lit(f"column {c} differs in row "), F.col("row_id").cast("string"))).cast(a.schema[c].dataType)
        rows = rows.withColumn(c, F.when(F.col(c).eqNullSafe(F.col(f"_r_{c}")), F.col(c)).otherwise(wrong)).drop(f"_r_{c}")
    return rows


def concat(frames: list[DataFrame], sizes: list[int]) -> DataFrame:
    """Rows of all, one after the other; row_id goes on counting."""
    out, at = None, 0
    for f, n in zip(frames, sizes):
        part = f.withColumn("row_id", F.col("row_id") + at)
        out = part if out is None else out.unionByName(part)
        at += n
    return out


def repeat(df: DataFrame, times: int, n_rows: int, interleave: bool = True) -> DataFrame:
    """Each row ``times`` times: aabb, or abab if not interleaved."""
    k = F.explode(F.sequence(F.lit(0), F.lit(times - 1))).alias("_k")
    rows = df.select("*", k)
    new = F.col("row_id") * times + F.col("_k") if interleave else F.col("_k") * n_rows + F.col("row_id")
    return rows.withColumn("row_id", new).drop("_k")


def sample_level_repeat(df: DataFrame, times: Column) -> DataFrame:
    """Each row as often as it says (0: never). row_id and copy order the result."""
    return df.withColumn("copy", F.explode(F.when(times > 0, F.sequence(F.lit(0), times.cast("int") - 1))))


def unfold_column_chunks(df: DataFrame, n_split: int, keys: list[str]) -> DataFrame:
    """Array columns ``keys`` cut in n equal parts, a row each; other columns repeat. A
    length that n does not divide raises."""
    rows = df.select("*", F.explode(F.sequence(F.lit(0), F.lit(n_split - 1))).alias("_k"))
    for k in keys:
        size = (F.size(k) / n_split).cast("int")
        uneven = F.raise_error(F.concat(F.lit(f"{k}: {n_split} parts of length "), F.size(k).cast("string")))
        rows = rows.withColumn(k, F.when(F.size(k) % n_split == 0, F.slice(k, F.col("_k") * size + 1, size)).otherwise(uneven))
    return rows.withColumn("row_id", F.col("row_id") * n_split + F.col("_k")).drop("_k")


def fold(df: DataFrame, size: int, columns: list[str]) -> DataFrame:
    """Every ``size`` neighbouring rows become one, their values arrays in order."""
    each = F.array_sort(F.collect_list(F.struct("row_id", *columns)))
    rows = df.groupBy((F.col("row_id") / size).cast("long").alias("_g")).agg(each.alias("_x"))
    return rows.select(F.col("_g").alias("row_id"), *[F.col(f"_x.{c}").alias(c) for c in columns])


def unfold(df: DataFrame, size: int, columns: list[str]) -> DataFrame:
    rows = df.select("row_id", F.posexplode(F.arrays_zip(*columns)).alias("_p", "_x"))
    return rows.select((F.col("row_id") * size + F.col("_p")).alias("row_id"), *[F.col(f"_x.{c}").alias(c) for c in columns])


def chunk(df: DataFrame, chunks: int, n_rows: int, padding: bool = False) -> DataFrame:
    """Adds part: n equal runs. Without padding the rows must divide."""
    if n_rows % chunks and not padding:
        raise ValueError(f"{n_rows} rows don't make {chunks} equal chunks")
    return df.withColumn("part", (F.col("row_id") / F.lit(-(-n_rows // chunks))).cast("long"))


def split(df: DataFrame, size: int) -> DataFrame:
    """Adds part: runs of ``size`` rows, the last may be short."""
    return df.withColumn("part", (F.col("row_id") / size).cast("long"))


def pad_to_divisor(df: DataFrame, divisor: int, n_rows: int) -> tuple[DataFrame, int]:
    """Rows from the head, again and again, until the count divides; (rows, padding)."""
    pad = -n_rows % divisor
    if not pad or not n_rows:
        return df, 0
    head = df.where(F.col("row_id") < min(pad, n_rows))
    turns = -(-pad // n_rows)
    extra = head.select("*", F.explode(F.sequence(F.lit(0), F.lit(turns - 1))).alias("_k")).where(F.col("_k") * n_rows + F.col("row_id") < pad)
    return df.unionByName(extra.withColumn("row_id", F.lit(n_rows) + F.col("_k") * n_rows + F.col("row_id")).drop("_k")), pad


def unpad(df: DataFrame, n_rows: int) -> DataFrame:
    return df.where(F.col("row_id") < n_rows)


def padding(df: DataFrame, k: int, n_rows: int, which: str = "last") -> DataFrame:
    """k copies of the first or last row at the end."""
    row = df.where(F.col("row_id") == (0 if which == "first" else n_rows - 1))
    extra = row.select("*", F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias("_k")) if k else row.where("false").withColumn("_k", F.lit(0))
    return df.unionByName(extra.withColumn("row_id", F.lit(n_rows) + F.col("_k")).drop("_k"))


def upsample(df: DataFrame, multiple: int, n_rows: int, zero: list[str]) -> DataFrame:
    """Rows up to a multiple; the added ones copy the last with arrays ``zero`` all 0."""
    extra = padding(df, -n_rows % multiple, n_rows).where(F.col("row_id") >= n_rows)
    for c in zero:
        extra = extra.withColumn(c, F.transform(c, lambda x: x * 0))
    return df.unionByName(extra)


def minibatches(df: DataFrame, size: int, n_rows: int, epochs: int = 1, seed: int = 0, shuffle: bool = True) -> DataFrame:
    """epoch, batch and place of every row in a seeded order of each epoch. ``size``
    must divide the rows. Rows are numbered over range partitions of all epochs, and each
    epoch has ``n_rows`` of the numbers."""
    if n_rows % size:
        raise ValueError(f"batches of {size} don't divide {n_rows} rows")
    rows = df.select("*", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1))).alias("epoch"))
    key = F.xxhash64(F.lit(seed), "epoch", "row_id") if shuffle else F.col("row_id")
    rows = with_row_id(rows, F.col("epoch"), key, F.col("row_id"), name="_at").withColumn("_at", F.col("_at") - F.col("epoch") * n_rows)
    return rows.withColumns({"batch": (F.col("_at") / size).cast("long"), "place": (F.col("_at") % size).cast("int")}).drop("_at")


def dataset_split(df: DataFrame, parts: int, n_rows: int) -> DataFrame:
    """Adds part for n equal ranges; what is over is dropped."""
    size = n_rows // parts
    return df.where(F.col("row_id") < size * parts).withColumn("part", (F.col("row_id") / size).cast("long"))


def max_samples(df: DataFrame, n: int, shuffle: bool = False, seed: int = 0) -> DataFrame:
    """The first n rows, or a seeded n of them, if n is positive and smaller, in any order.
    The n-th place is found by counts, so that a large n doesn't pass through one task."""
    if n <= 0:
        return df
    key = [F.xxhash64(F.lit(seed), "row_id")] if shuffle else []
    return first_rows(df, [*key, F.col("row_id")], n)


def overlong_filter(df: DataFrame, length: Column, most: int) -> DataFrame:
    """Rows of at most ``most`` tokens; an unknown length counts as too long."""
    return df.where(F.coalesce(length, F.lit(most + 1)) <= most)


def train_batches(df: DataFrame, size: int, n_rows: int, drop_last: bool = True) -> DataFrame:
    rows = split(df, size)
    return rows.where(F.col("part") < n_rows // size) if drop_last else rows


def keep_varied_groups(df: DataFrame, group: str, value: str) -> DataFrame:
    """Groups whose values aren't all equal."""
    w = Window.partitionBy(group)
    return df.withColumn("_s", F.max(value).over(w) > F.min(value).over(w)).where("_s").drop("_s")


def search(df: DataFrame, words: str, columns: list[str], sort: list[Column]) -> DataFrame:
    """Rows of which a column has the text, sorted, for viewing."""
    hit = F.lit(False)
    for c in columns:
        hit = hit | F.coalesce(F.col(c).contains(words), F.lit(False))
    return df.where(hit).orderBy(*sort)
