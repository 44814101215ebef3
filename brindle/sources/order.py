"""Row order. Frames are unordered; positional operators use a dense row_id from 0."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Where it is unset and all tasks run in this
    process a temporary one; on a cluster that raises, as machines don't share it."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        master = spark.conf.get("spark.master", "")
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        path = "file://" + tempfile.mkdtemp(prefix="brindle-")
        spark.conf.set("spark.checkpoint.dir", path)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(path)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back: its lineage ends there, and what
    is read several times is computed once."""
    path = f"{checkpoint_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def with_place(df: DataFrame, by: list[str], *keys: Column | str, name: str = "place", size: str | None = None) -> DataFrame:
    """Adds the place, from 0, of each row in its group ``by`` in order of ``keys`` (and, as
    ``size``, the rows of its group). All groups are numbered together over range partitions
    and a group's first number is taken off, so a group of any size is spread over tasks.
    Null is a group like others."""
    rows = with_row_id(df, *by, *keys, name="_at")
    # The numbers are of sorted rows that are written, so both sides see the same.
    groups = rows.groupBy(*[F.col(c).alias(f"_g_{c}") for c in by]).agg(F.min("_at").alias("_first"), F.count("*").alias("_size"))
    on = F.lit(True)
    for c in by:
        on = F.col(c).eqNullSafe(F.col(f"_g_{c}")) & on
    out = rows.join(groups, on).withColumn(name, F.col("_at") - F.col("_first"))
    return (out.withColumn(size, F.col("_size")) if size else out).drop("_at", "_first", "_size", *[f"_g_{c}" for c in by])


def with_row_id(df: DataFrame, *keys: Column | str, name: str = "row_id") -> DataFrame:
    """Adds the place of each row in the total order of ``keys``.

    Rows are range-partitioned and numbered inside their partition; only the partitions'
    counts, a row each, are summed on their own. No window spans the table. The sorted
    rows are checkpointed, so that counts and numbers see the same partitions."""
    checkpoint_dir(df.sparkSession)
    rows = df.orderBy(*keys).withColumn("_m", F.monotonically_increasing_id()).checkpoint()
    rows = rows.withColumns({"_p": F.shiftright("_m", 33), "_i": F.col("_m").bitwiseAND(F.lit((1 << 33) - 1))}).drop("_m")
    counts = rows.groupBy("_p").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("_p", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_s"))
    return rows.join(F.broadcast(starts), "_p").withColumn(name, F.col("_s") + F.col("_i")).drop("_p", "_i", "_s")  # starts: a row a partition
