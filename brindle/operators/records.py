"""Rows of differing dicts: JSON or variant columns whose keys and types differ by row.

The schema is found by one aggregation over the variants (types of a key merge to a common
one, and to variant where there is none), so nothing is guessed from a sample and no dict
meets another on the driver. A key that a row lacks is null there, like a JSON null. Text
that is no JSON object has no keys. Nested dicts stay structs; ``metrics.flatten`` opens them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType, VariantType


def as_variant(df: DataFrame, column: str) -> Column:
    """The column as variant: JSON text is parsed (null where it isn't JSON)."""
    return F.col(column) if isinstance(df.schema[column].dataType, VariantType) else F.try_parse_json(F.col(column).cast("string"))


def schema_of(df: DataFrame, column: str) -> StructType:
    """The fields of all dicts of a column, in order of name."""
    found = df.agg(F.schema_of_variant_agg(as_variant(df, column)).alias("s")).first()["s"] or "VOID"
    if not found.startswith("OBJECT<"):
        # No dicts, or dicts and other values: only the dicts have keys.
        only = df.select(as_variant(df, column).alias("v")).where(F.schema_of_variant("v").startswith("OBJECT"))
        found = only.agg(F.schema_of_variant_agg("v").alias("s")).first()["s"] or "VOID"
    if not found.startswith("OBJECT<"):
        return StructType()
    text = found.replace("OBJECT<", "STRUCT<").replace("VOID", "STRING").replace("STRUCT<>", "STRING")
    kind = df.sparkSession.sql(f"SELECT CAST(NULL AS {text}) AS x").schema["x"].dataType
    return StructType(sorted(kind.fields, key=lambda f: f.name))


def opened(df: DataFrame, column: str, prefix: str = "", keep: list[str] | None = None, schema: StructType | None = None) -> DataFrame:
    """``keep`` (all other columns if not given) and a column for each key, named with
    ``prefix`` unless it begins with it. A key named like a kept column raises."""
    schema = schema_of(df, column) if schema is None else schema
    keep = [c for c in df.columns if c != column] if keep is None else keep
    names = {f.name: f.name if prefix and f.name.startswith(prefix) else prefix + f.name for f in schema}
    clash = sorted(set(names.values()) & set(keep))
    if clash:
        raise ValueError(f"keys named like columns: {clash}")
    rows = df.withColumn("_v", as_variant(df, column))
    both = [f.name for f in schema if "'" in f.name and '"' in f.name]
    if both:
        raise ValueError(f"keys with both kinds of quotes: {both}")
    path = lambda name: f"$['{name}']" if "'" not in name else f'$["{name}"]'
    return rows.select(*keep, *[F.try_variant_get("_v", path(f.name), f.dataType.simpleString()).alias(names[f.name]) for f in schema])


def dict_of_lists(df: DataFrame, by: list[str], order: str, column: str, prefix: str = "") -> DataFrame:
    """by.. and, for each key of any row, the list of its values in ``order``, null where a
    row lacks it: a list of dicts turned into a dict of lists. A group is one list."""
    rows = opened(df, column, prefix, [*by, order])
    keys = [c for c in rows.columns if c not in (*by, order)]
    lists = rows.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("_o"), F.struct(*keys).alias("_x")))).alias("_l")) if keys else rows.select(*by).distinct()
    of = lambda k: F.transform("_l", lambda e: e["_x"][k])
    return lists.select(*by, *[of(k).alias(k) for k in keys])


def appended(df: DataFrame, order: str, column: str, prefix: str = "") -> DataFrame:
    """key, n, values: of every key, as JSON texts, the values of all rows that have it in
    ``order``; a value that is a list adds its elements. Keys get ``prefix`` unless they
    begin with it, and such that then are the same are one."""
    rows = df.select(F.col(order).alias("_o"), F.monotonically_increasing_id().alias("_i"), as_variant(df, column).alias("_v"))
    spark = df.sparkSession
    each = rows.lateralJoin(spark.tvf.variant_explode(F.col("_v").outer())).where("key IS NOT NULL")
    named = F.when(F.col("key").startswith(prefix), F.col("key")).otherwise(F.concat(F.lit(prefix), "key")) if prefix else F.col("key")
    listed = F.schema_of_variant("value").startswith("ARRAY")
    values = F.when(listed, F.try_variant_get("value", "$", "array<variant>")).otherwise(F.array("value"))
    each = each.select("_o", "_i", F.col("key").alias("_k"), named.alias("key"), F.transform(values, lambda v: F.to_json(v)).alias("_l"))
    lists = each.groupBy("key").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("_o", "_i", "_k", "_l"))), lambda e: e["_l"])).alias("values"))
    return lists.select("key", F.size("values").cast("long").alias("n"), "values")


def assigned(df: DataFrame, key: str, records: DataFrame, column: str) -> DataFrame:
    """``df`` with a column for each key of the dicts of ``records`` (key, column), null for
    rows without a dict or without the key. Columns of these names are replaced. Two dicts
    of one row raise, as which counts would be chance."""
    schema = schema_of(records, column)
    once = records.groupBy(key).agg(F.count("*").alias("_n"), F.first(column).alias(column))
    checked = F.when(F.col("_n") == 1, F.col(column).cast("string")).otherwise(F.raise_error(F.concat(F.lit("several dicts for row "), F.col(key).cast("string"))))
    new = opened(once.select(key, checked.alias(column)), column, "", [key], schema)
    return df.drop(*[f.name for f in schema if f.name != key]).join(new, key, "left")
