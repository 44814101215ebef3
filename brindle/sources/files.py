"""Dataset readers, sinks and step-keyed caches, on any file system Spark can reach."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.operators.selection import first_rows
from brindle.sources.order import checkpoint_dir, with_row_id, written

RL_ROW = (
    "data_source string, prompt array<struct<role: string, content: string>>, ability string, reward_model struct<style: string, ground_truth: string>, "
    "extra_info struct<split: string, index: long, answer: string, question: string>"
)


CHAT = "messages array<struct<role: string, content: string>>, tools string, enable_thinking boolean"
PREFERENCE = "prompt string, chosen string, rejected string"


def scratch(spark: SparkSession, name: str) -> str:
    return f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def read_any(spark: SparkSession, paths: list[str], schema: str | None = None) -> DataFrame:
    """Parquet and JSON-lines files by suffix, all rows together; columns that some lack
    are null there."""
    return _union([df for _, df in _scans(spark, paths, schema)])


def _scans(spark: SparkSession, paths: list[str], schema: str | None) -> list[tuple[int, DataFrame]]:
    out = []
    for i, p in enumerate(paths):
        suffix = p.rstrip("/").rsplit(".", 1)[-1]
        if suffix not in ("parquet", "json", "jsonl"):
            raise ValueError(f"unsupported file {p}: parquet, json or jsonl")
        reader = spark.read.schema(schema) if schema else spark.read
        out.append((i, reader.parquet(p) if suffix == "parquet" else reader.json(p)))
    if not out:
        raise ValueError("no files")
    return out


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for df in frames[1:]:
        out = out.unionByName(df, allowMissingColumns=True)
    return out


def _sampled(spark: SparkSession, paths: list[str], schema: str | None, most: int, shuffle: bool, seed: int) -> DataFrame:
    """At most ``most`` rows (all if not positive) of some files: the first in order of
    ``paths``, file name and place, or a seeded draw by hash. Rows keep no order."""
    if most <= 0:
        return read_any(spark, paths, schema)
    place = [F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_start"), F.monotonically_increasing_id().alias("_i")]
    scans = _scans(spark, paths, schema)
    placed = written(_union([df.select("*", F.lit(i).alias("_path"), *place) for i, df in scans]), "placed")
    names = [c for c in placed.columns if c not in ("_path", "_file", "_start", "_i")]
    if shuffle:
        order = [F.xxhash64(F.lit(seed), F.to_json(F.struct(*names)), "_file", "_start"), F.col("_path"), F.xxhash64("_file"), F.col("_start"), F.col("_i")]
    else:
        # A file's number stands for its name: a row for each file.
        files = written(with_row_id(placed.select("_path", "_file").distinct(), "_path", "_file", name="_f"), "files")
        placed = placed.join(files, ["_path", "_file"])
        order = [F.col("_f"), F.col("_start"), F.col("_i")]
    return first_rows(placed, order, most).select(*names)


def read_chats(spark: SparkSession, paths: list[str], max_samples: int = -1, shuffle: bool = False, seed: int = 0, default_thinking: bool | None = None) -> DataFrame:
    """Multi-turn rows: messages, tools (JSON, null without) and enable_thinking. Rows
    without messages raise when they are read."""
    rows = _sampled(spark, paths, CHAT, max_samples, shuffle, seed)
    checked = F.when(F.size("messages") > 0, F.col("messages")).otherwise(F.raise_error(F.lit("a row without messages")))
    return rows.select(checked.alias("messages"), "tools", F.coalesce("enable_thinking", F.lit(default_thinking).cast("boolean")).alias("enable_thinking"))


def read_preferences(spark: SparkSession, paths: list[str], names: tuple[str, str, str] = ("prompt", "chosen", "rejected"), max_samples: int = -1, shuffle: bool = False, seed: int = 0) -> DataFrame:
    """prompt, chosen and rejected from columns of any names."""
    rows = _sampled(spark, paths, None, max_samples, shuffle, seed)
    return rows.select(*[F.col(n).cast("string").alias(a) for n, a in zip(names, ("prompt", "chosen", "rejected"))])


def dump_steps(df: DataFrame, path: str, step: str = "step") -> str:
    """JSON lines in a folder for each step. The step stays in the rows. Array columns are
    lists for a whole step (``whole_lists`` drops those of another length)."""
    df.withColumn("_step", F.col(step)).write.mode("append").partitionBy("_step").json(path)
    return path


def whole_lists(df: DataFrame, base: str, extra: list[str], key: str = "step") -> DataFrame:
    """Rows of lists (one a step) exploded to a row for each element of ``base``; of the
    lists ``extra`` those of another length than ``base`` are left out: null in that step."""
    same = lambda c: F.filter(c, lambda _: F.size(c) == F.size(base))  # noqa: E731  an empty list is padded with nulls
    kept = [F.coalesce(same(c), F.array()).alias(c) for c in extra]
    zipped = df.select(key, base, *kept).select(key, F.posexplode(F.arrays_zip(base, *extra)).alias("place", "_x"))
    return zipped.select(key, F.col("place").cast("long").alias("place"), *[F.col(f"_x.{c}").alias(c) for c in (base, *extra)])


def load_steps(spark: SparkSession, path: str, schema: str, mask: str | None = None, columns: list[str] | None = None, index: str | None = None) -> DataFrame:
    """All dumped rows; in string ``columns`` what matches ``mask`` becomes *. ``index``: a
    column with the place of a row in its step, from 0, by file name and line."""
    df = spark.read.schema(schema).json(path)
    for c in columns or []:
        df = df.withColumn(c, F.regexp_replace(c, mask, "*"))
    if index is None:
        return df.drop("_step")
    names = [c for c in df.columns if c != "_step"]
    file = F.regexp_extract(F.col("_metadata.file_path"), r"[^/]+$", 0)
    placed = df.select("*", file.alias("_file"), F.col("_metadata.file_block_start").alias("_start"), F.monotonically_increasing_id().alias("_line"))
    # Numbered over range partitions of all steps; a step's first number is taken off.
    numbered = with_row_id(placed, "_step", "_file", "_start", "_line", name="_at")
    first = numbered.groupBy("_step").agg(F.min("_at").alias("_first"))
    return numbered.join(first, "_step").withColumn(index, F.col("_at") - F.col("_first")).select(*names, index)


def load_files(spark: SparkSession, path: str, schema: str, index: str = "index") -> DataFrame:
    """Rows of the files N.jsonl of a folder, with step (N) and their line's place in the
    file, from 0. Files of other names raise; the order of steps is that of numbers."""
    df = spark.read.schema(schema).option("pathGlobFilter", "*.jsonl").json(path)
    stem = F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)\.jsonl$", 1)
    number = F.when(stem.rlike("^[0-9]+$"), stem.cast("long")).otherwise(F.raise_error(F.concat(F.lit("no step in "), stem)).cast("long"))
    placed = df.select("*", number.alias("step"), F.col("_metadata.file_block_start").alias("_start"), F.monotonically_increasing_id().alias("_line"))
    numbered = with_row_id(placed, "step", "_start", "_line", name="_at")
    first = numbered.groupBy("step").agg(F.min("_at").alias("_first"))
    return numbered.join(first, "step").withColumn(index, F.col("_at") - F.col("_first")).drop("_at", "_first", "_start", "_line")


def sink_generations(df: DataFrame, responses: DataFrame, path: str, key: str = "row_id") -> str:
    """Appends responses (key, n, response) as an array in order of n, and writes Parquet."""
    lists = responses.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "response"))), lambda s: s["response"]).alias("responses"))
    df.join(lists, key, "left").write.parquet(path)
    return path


def log_metrics(df: DataFrame, path: str) -> str:
    """step, key, value rows, appended."""
    df.select("step", "key", "value").write.mode("append").json(path)
    return path


class StepCache:
    """Batches by step: record, and play back: the step itself, the last before it, or the
    recorded steps again and again."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def record(self, df: DataFrame, step: int) -> None:
        df.write.mode("overwrite").parquet(f"{self.path}/step={step}")

    def steps(self) -> list[int]:
        """What is recorded, a number for each folder."""
        rows = self.spark.read.option("basePath", self.path).parquet(self.path)
        return sorted(r["step"] for r in rows.select("step").distinct().collect())

    def replay(self, step: int, repeat_last: bool = False, repeat: bool = False) -> DataFrame:
        """Rows of a step. ``repeat``: steps count from 1, and after the last recorded one the
        first comes again."""
        rows = self.spark.read.option("basePath", self.path).parquet(self.path)
        if repeat:
            known = self.steps()
            step = known[(step - 1) % len(known)]
        elif repeat_last:
            step = rows.where(F.col("step") <= step).agg(F.max("step")).first()[0]
        return rows.where(F.col("step") == step)


def sized(df: DataFrame) -> Column:
    """Bytes of the values of a row, as JSON text."""
    return F.octet_length(F.to_json(F.struct(*df.columns)))
