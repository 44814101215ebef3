"""Token rewards from scores, user-supplied score functions, and resampling by score.

A manager turns a score of each row into an array of token rewards: the score stands on
the last valid token, all others are 0. Rows without a valid token get zeros."""

from __future__ import annotations

import importlib.util
import json
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, MapType, StringType, StructField, StructType

from brindle.functions import tokens as T
from brindle.operators.limits import token_bucket
from brindle.sources.order import with_row_id

#: (source, solution, truth, extra as JSON) -> number, or dict with "score".
ScoreFunction = Callable[[str, str, str, "str | None"], "float | dict"]


def scored_once(df: DataFrame, solution: str, truth: str, **scores: Callable[[Column, Column], Column]) -> DataFrame:
    """Adds a column for each score of (solution, truth). Each distinct pair is scored once,
    and the pairs are dealt evenly over tasks, however few partitions the rows are read in."""
    sc = df.sparkSession.sparkContext
    tasks = max(4 * sc.defaultParallelism, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    pairs = df.select(F.col(solution).alias("_s"), F.col(truth).alias("_t")).distinct().repartition(tasks)
    pairs = pairs.select("_s", "_t", *[fn(F.col("_s"), F.col("_t")).alias(name) for name, fn in scores.items()])
    return df.join(pairs, F.col(solution).eqNullSafe(F.col("_s")) & F.col(truth).eqNullSafe(F.col("_t")), "left").drop("_s", "_t")


def load_function(path: str, name: str = "compute_score", **fixed) -> Callable:
    """A function of a user's file, with some arguments fixed. The file is run, as the user
    asks; it must be on every executor, as it is loaded there."""

    def call(*args, **kwargs):
        if name not in found:
            spec = importlib.util.spec_from_file_location("user_rewards", path)
            if spec is None or spec.loader is None:
                raise FileNotFoundError(path)
            module = importlib.util.module_from_spec(spec)
            spec.loader.exec_module(module)
            found[name] = getattr(module, name)
        return found[name](*args, **kwargs | fixed)

    found: dict[str, Callable] = {}
    return call


def scored(function: ScoreFunction) -> Callable[[Column, Column, Column, Column], Column]:
    """A column function of (source, solution, truth, extra): struct(score, info), info
    being the rest of a dict as JSON."""

    @F.pandas_udf(StructType([StructField("score", DoubleType()), StructField("info", StringType())]))
    def run(source: pd.Series, solution: pd.Series, truth: pd.Series, extra: pd.Series) -> pd.DataFrame:
        rows = []
        for args in zip(source, solution, truth, extra):
            got = function(*args)
            info = {k: v for k, v in got.items() if k != "score"} if isinstance(got, dict) else {}
            rows.append((float(got["score"] if isinstance(got, dict) else got), json.dumps(info) if info else None))
        return pd.DataFrame(rows, columns=["score", "info"])

    return run


def on_last_token(score: Column, mask: str) -> Column:
    """Token rewards: the score on the last valid token."""
    last = F.array_max(F.transform(F.col(mask), lambda m, i: F.when(m > 0, i)))
    return F.transform(F.col(mask), lambda m, i: F.when(i == last, score).otherwise(T.zero()))


def naive(df: DataFrame, score: str, mask: str) -> DataFrame:
    """Adds rewards, unless the frame has rm_scores, which then are the rewards."""
    return df.withColumn("rewards", F.col("rm_scores") if "rm_scores" in df.columns else on_last_token(F.col(score), mask))


def overlong(df: DataFrame, score: str, mask: str, longest: int, buffer: int, factor: float) -> DataFrame:
    """As naive, less a penalty for valid tokens in the last ``buffer`` of ``longest``."""
    penalty = T.overlong_penalty(T.mask_count(mask), longest, buffer, factor)
    return df.withColumns({"overlong_reward": penalty, "rewards": on_last_token(F.col(score) + penalty, mask)})


def by_dimension(df: DataFrame, score: str, mask: str, sequence: tuple[str, str] | None = None) -> DataFrame:
    """``score`` is a map of named rewards, with their whole under "score", or a number. Adds
    rewards (the whole on the last valid token) and info, the map of all named ones (a
    number's under "acc"), from which each dimension can be normalised on its own.
    ``sequence``: (sample, order) columns of samples of several sequences, of which only the
    last one's row stays."""
    if sequence:
        sample, order = sequence
        last = df.groupBy(sample).agg(F.max(order).alias("_last"))
        df = df.join(last, sample).where(F.col(order) == F.col("_last")).drop("_last")
    named = isinstance(df.schema[score].dataType, MapType)
    whole = F.try_element_at(score, F.lit("score")) if named else F.col(score)
    missing = F.raise_error(F.lit("a map of rewards without score")).cast("double")
    info = F.col(score) if named else F.create_map(F.lit("acc"), F.col(score).cast("double"))
    return df.withColumns({"rewards": on_last_token(F.coalesce(whole.cast("double"), missing), mask), "info": info})


def rate_limited(df: DataFrame, score: str, mask: str, arrival: str, tokens: str, rate: float, most: float | None = None, order: list[str] | None = None) -> DataFrame:
    """As naive, with started and waited: when a limit of ``rate`` tokens a second would have
    let the request for each row's score through (``limits.token_bucket``)."""
    return naive(token_bucket(df, arrival, tokens, rate, most, order), score, mask)


MANAGERS: dict[str, Callable[..., DataFrame]] = {"naive": naive, "batch": naive, "prime": naive, "dapo": overlong, "gdpo": by_dimension, "rate_limited": rate_limited}


def register(name: str, manager: Callable[..., DataFrame]) -> None:
    """Adds a manager; a name can't be taken by two."""
    if MANAGERS.get(name, manager) is not manager:
        raise ValueError(f"{name} is already registered")
    MANAGERS[name] = manager


def manager(name: str) -> Callable[..., DataFrame]:
    if name not in MANAGERS:
        raise ValueError(f"unknown reward manager {name}; known: {sorted(MANAGERS)}")
    return MANAGERS[name]


def resample_weights(df: DataFrame, score: str, method: str = "pow", power: float = 2.0) -> DataFrame:
    """Adds weight: |score|^power, or 1 at the batch's best and worst scores and 0 else
    (max_min), or 0.4 at the best and 0.1 else (max_random); at least 1e-8."""
    if method not in ("pow", "max_min", "max_random"):
        raise ValueError(f"method {method!r}: pow, max_min or max_random")
    if method == "pow":
        return df.withColumn("weight", F.pow(F.abs(F.col(score)), F.lit(power)) + 1e-8)
    ends = df.agg(F.max(score).alias("_hi"), F.min(score).alias("_lo"))
    best = F.col(score) == F.col("_hi")
    weight = F.when(best | (F.col(score) == F.col("_lo")), 1.0).otherwise(0.0) if method == "max_min" else F.when(best, 0.4).otherwise(0.1)
    return df.join(F.broadcast(ends)).withColumn("weight", weight + 1e-8).drop("_hi", "_lo")  # ends: one row


def resample(df: DataFrame, score: str, key: str, method: str = "pow", power: float = 2.0, seed: int = 0) -> DataFrame:
    """As many rows as ``df`` has, drawn with replacement by weight (column draws: how often).

    Systematic draws over the running sum of weights in the order of a seeded hash of
    ``key``: a row of share p of n draws is drawn floor(pn) or ceil(pn) times, pn on
    average. Running sums are of partitions and inside them; no window spans the table."""
    rows = with_row_id(resample_weights(df, score, method, power), F.xxhash64(F.lit(seed), F.col(key)), F.col(key), name="_row")
    rows = rows.withColumn("_part", F.floor(F.col("_row") / 65536))
    parts = rows.groupBy("_part").agg(F.sum("weight").alias("_sum"), F.count("*").alias("_count"))
    upto = Window.orderBy("_part")  # one row for 65,536
    parts = parts.select("_part", (F.sum("_sum").over(upto) - F.col("_sum")).alias("_before"))
    whole = rows.agg(F.sum("weight").alias("_all"), F.count("*").alias("_n"))
    rows = rows.join(parts, "_part").join(F.broadcast(whole))  # whole: one row
    inside = Window.partitionBy("_part").orderBy("_row")
    high = (F.col("_before") + F.sum("weight").over(inside)) / F.col("_all") * F.col("_n")
    low = high - F.col("weight") / F.col("_all") * F.col("_n")
    start = F.pmod(F.xxhash64(F.lit(seed + 1)), F.lit(1 << 20)) / (1 << 20)
    draws = (F.ceil(high - start) - F.ceil(low - start)).cast("int")
    rows = rows.withColumn("draws", draws).where("draws > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("draws"))))
    return rows.drop("_part", "_before", "_all", "_n", "_row")
