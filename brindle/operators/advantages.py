"""Group-relative advantages: statistics of scores by ``uid``.

Inputs have uid, score (one number a row) and row_id (ties). Window functions over uid
keep rows in place: one shuffle on uid serves all of an estimator. Batch-wide figures
(whitening) are aggregated and joined as one row, never a window over everything.
Standard deviations are of samples. What a group of one gets differs by estimator.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, FloatType, StringType

from brindle.functions import tokens as T
from brindle.sources.order import with_row_id

EPS = 1e-6


def group():
    return Window.partitionBy("uid")


def group_index(df: DataFrame, label: str = "uid") -> DataFrame:
    """Adds gidx, a dense number for each label, in label order; null is a label, the last.

    Integers and booleans are labels as they are. A column of floating-point numbers that
    are all within 1e-6 of integers counts as those, and a column of strings that are all
    integers as their values; any other column is taken as its values. Which it is takes
    one aggregation; only distinct labels are sorted and numbered, over range partitions."""
    value = F.col(label)
    kind = df.schema[label].dataType
    if isinstance(kind, BooleanType):
        value = value.cast("long")
    elif isinstance(kind, (FloatType, DoubleType)):
        whole = F.abs(value - F.rint(value)) <= 1e-6
        if df.agg(F.bool_and(whole)).first()[0]:
            value = F.rint(value).cast("long")
    elif isinstance(kind, StringType):
        if df.agg(F.bool_and(value.try_cast("long").isNotNull() & value.rlike(r"^\s*[+-]?[0-9]+\s*$"))).first()[0]:
            value = value.try_cast("long")
    keyed = df.withColumn("_label", F.struct(value.alias("label")))
    ranks = with_row_id(keyed.select("_label").distinct(), F.col("_label.label").asc_nulls_last(), name="gidx")
    return keyed.join(ranks, "_label").drop("_label")


def group_mean_std(df: DataFrame, eps: float = EPS) -> DataFrame:
    """uid, mean, std, count; variance is floored, a single row has mean 0 and std 1."""
    n = F.count("score")
    g = df.groupBy("uid").agg(F.avg("score").alias("mean"), F.sqrt(F.greatest(F.var_samp("score"), F.lit(eps))).alias("std"), n.alias("count"))
    one = F.col("count") == 1
    return g.select("uid", F.when(one, 0.0).otherwise(F.col("mean")).alias("mean"), F.when(one, 1.0).otherwise(F.col("std")).alias("std"), "count")


def _mean_std(floor: float | None = None) -> tuple[Column, Column]:
    one = F.count("score").over(group()) == 1
    std = F.stddev_samp("score").over(group())
    if floor is not None:
        std = F.sqrt(F.greatest(F.var_samp("score").over(group()), F.lit(floor)))
    return F.when(one, 0.0).otherwise(F.avg("score").over(group())), F.when(one, 1.0).otherwise(std)


def grpo(df: DataFrame, by_std: bool = True, eps: float = EPS) -> DataFrame:
    mean, std = _mean_std()
    centred = F.col("score") - mean
    return df.withColumn("adv", centred / (std + eps) if by_std else centred)


def grpo_vectorized(df: DataFrame, by_std: bool = True, eps: float = EPS) -> DataFrame:
    mean, std = _mean_std(floor=eps)
    centred = F.col("score") - mean
    return df.withColumn("adv", centred / (std + eps) if by_std else centred)


def grpo_passk(df: DataFrame, by_std: bool = True, eps: float = EPS) -> DataFrame:
    """The best row (ties: the first row_id) gets its lead over the second; others 0.
    A group of one has no second: its rows raise."""
    order = group().orderBy(F.col("score").desc(), "row_id")
    second = F.nth_value("score", 2).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    lead = F.col("score") - second
    if by_std:
        lead = lead / (F.stddev_samp("score").over(group()) + eps)
    few = F.count("score").over(group()) < 2
    raised = F.raise_error(F.concat(F.lit("pass@k needs two samples in group "), F.col("uid").cast("string"))).cast("double")
    return df.withColumn("adv", F.when(few, raised).when(F.row_number().over(order) == 1, lead).otherwise(0.0))


def rloo(df: DataFrame) -> DataFrame:
    """A group of one keeps its score."""
    n, mean = F.count("score").over(group()), F.avg("score").over(group())
    return df.withColumn("adv", F.when(n > 1, F.try_divide((F.col("score") - mean) * n, n - 1)).otherwise(F.col("score")))


def rloo_vectorized(df: DataFrame) -> DataFrame:
    """A group of one gets 0."""
    n, s = F.count("score").over(group()), F.sum("score").over(group())
    return df.withColumn("adv", F.when(n > 1, F.try_divide(n * F.col("score") - s, n - 1)).otherwise(0.0))


def opo(df: DataFrame) -> DataFrame:
    """Baseline weighted by response length (column length); 0 for a group of one."""
    base = F.try_divide(F.sum(F.col("length") * F.col("score")).over(group()), F.sum("length").over(group()))
    return df.withColumn("adv", F.col("score") - F.when(F.count("score").over(group()) > 1, base).otherwise(0.0))


def gpg(df: DataFrame, f_norm: float = 1.0) -> DataFrame:
    """Centred scores times rows over rows with a score other than 0."""
    alpha = df.agg((F.count("*") / F.greatest(F.sum(F.when(F.col("score") != 0, 1).otherwise(0)), F.lit(1))).alias("alpha"))
    mean, _ = _mean_std()
    return df.join(F.broadcast(alpha)).withColumn("adv", F.col("alpha") * (F.col("score") - mean) / f_norm).drop("alpha")  # alpha: one row


def whiten(df: DataFrame, value: str, mask: str, shift_mean: bool = True) -> DataFrame:
    """Token array ``value`` whitened over all valid tokens of the batch: one aggregation
    over the tokens, which don't shuffle, gives a row that is joined back."""
    tokens = df.select(F.explode(F.filter(T.zipped(value, mask), lambda x: x[mask] > 0)).alias("x")).select(F.col(f"x.{value}").cast("double").alias("x"))
    one = tokens.agg(F.avg("x").alias("_mean"), F.var_samp("x").alias("_var"))
    out = F.transform(F.col(value), lambda x: (x - F.col("_mean")) / F.sqrt(F.col("_var") + 1e-8) + (T.zero() if shift_mean else F.col("_mean")))
    return df.join(F.broadcast(one)).withColumn(value, out).drop("_mean", "_var")  # one: one row


def tile(df: DataFrame, mask: str, value: str = "adv") -> DataFrame:
    """An outcome advantage on every valid token."""
    return df.withColumn(value, F.transform(F.col(mask), lambda m: F.col(value) * m))


def reinforce_plus_plus_baseline(df: DataFrame, mask: str) -> DataFrame:
    mean, _ = _mean_std()
    centred = tile(df.withColumn("adv", F.col("score") - mean), mask)
    return _masked(whiten(centred, "adv", mask), "adv", mask)


def gdpo(df: DataFrame, rewards: dict[str, float], mask: str, by_std: bool = True) -> DataFrame:
    """GRPO of each reward column, weighted, summed and whitened over all valid tokens."""
    total = F.lit(0.0)
    rows = df
    for i, (name, weight) in enumerate(rewards.items()):
        rows = grpo(rows.withColumn("score", F.col(name)), by_std).withColumnRenamed("adv", f"_a{i}")
        total = total + weight * F.col(f"_a{i}")
    rows = tile(rows.withColumn("adv", total), mask).drop(*[f"_a{i}" for i in range(len(rewards))])
    return _masked(whiten(rows, "adv", mask), "adv", mask)


def _masked(df: DataFrame, value: str, mask: str) -> DataFrame:
    return df.withColumn(value, T.per_token(lambda a, m: a * m, value, mask))


def final_session(df: DataFrame, estimator: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Sessions of several rows (columns session, index): the estimator sees the last row
    of each session, and all rows of the session get its advantage."""
    last = Window.partitionBy("uid", "session").orderBy(F.col("index").desc())
    marked = df.withColumn("_last", F.row_number().over(last))
    found = estimator(marked.where("_last = 1").drop("_last")).select("uid", "session", "adv")
    return marked.drop("_last").join(found, ["uid", "session"])


# Scans over the tokens of a row.


def reward_to_go(rewards: str, mask: str) -> Column:
    parts = F.transform(T.zipped(rewards, mask), lambda s: s[rewards] * s[mask])
    n = F.size(rewards)
    return F.transform(F.sequence(F.lit(1), n), lambda i: T.total(F.slice(parts, i, n)))


def discounted_return(rewards: str, mask: str, gamma: float) -> Column:
    """Right to left R = r + gamma R; R is forgotten after a token outside the mask."""
    pairs = F.reverse(T.zipped(rewards, mask))
    start = F.struct(F.lit(0.0).alias("run"), F.array().cast("array<double>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        now = x[rewards] + gamma * acc["run"]
        return F.struct((now * x[mask]).alias("run"), F.concat(acc["out"], F.array(now)).alias("out"))

    return F.reverse(F.aggregate(pairs, start, step)["out"])


def reinforce_plus_plus(df: DataFrame, rewards: str, mask: str, gamma: float) -> DataFrame:
    rows = df.withColumn("returns", discounted_return(rewards, mask, gamma)).withColumn("adv", F.col("returns"))
    return _masked(whiten(rows, "adv", mask), "adv", mask)


def remax(df: DataFrame, rewards: str, mask: str, baseline: str) -> DataFrame:
    rows = df.withColumn("returns", reward_to_go(rewards, mask))
    return rows.withColumn("adv", F.transform(T.zipped("returns", mask), lambda s: s["returns"] - F.col(baseline) * s[mask]))


def gae_raw(rewards: str, values: str, mask: str, gamma: float, lam: float) -> Column:
    """Unwhitened advantages; tokens outside the mask pass value and advantage through."""
    start = F.struct(F.lit(0.0).alias("next"), F.lit(0.0).alias("run"), F.array().cast("array<double>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        fresh = x[rewards] + gamma * acc["next"] - x[values] + gamma * lam * acc["run"]
        m = x[mask]
        run = fresh * m + (1 - m) * acc["run"]
        return F.struct((x[values] * m + (1 - m) * acc["next"]).alias("next"), run.alias("run"), F.concat(acc["out"], F.array(run)).alias("out"))

    return F.reverse(F.aggregate(F.reverse(T.zipped(rewards, values, mask)), start, step)["out"])


def gae(df: DataFrame, rewards: str, values: str, mask: str, gamma: float, lam: float) -> DataFrame:
    rows = df.withColumn("adv", gae_raw(rewards, values, mask, gamma, lam))
    rows = rows.withColumn("returns", F.transform(T.zipped("adv", values), lambda s: s["adv"] + s[values]))
    return whiten(rows, "adv", mask)


def optimal_token_baseline(long: DataFrame, compact: bool = False, zero_tail: bool = True, eps: float = 1e-8) -> DataFrame:
    """long: row_id, uid, t, r (reward), m (mask), olp, spi, and maybe w (importance).
    Adds returns and adv. At each (uid, t) the baseline is the mean of the returns,
    weighted by accumulated path variance; ``compact`` counts only valid tokens as steps.
    The longest row of a group, if alone, has no baseline past the second longest."""
    by_row = Window.partitionBy("row_id").orderBy("t")
    weight = 1 - 2 * F.exp("olp") + F.col("spi")
    if "w" in long.columns:
        weight = weight * F.col("w") * F.col("w")
    rows = long.withColumns({
        "returns": F.sum(F.col("r") * F.col("m")).over(by_row.rowsBetween(0, Window.unboundedFollowing)),
        "_w": F.sum(weight * F.col("m")).over(by_row.rowsBetween(Window.unboundedPreceding, 0)),
        "_len": F.sum("m").over(Window.partitionBy("row_id")),
    })
    rows = rows.withColumn("_step", F.sum("m").over(by_row.rowsBetween(Window.unboundedPreceding, 0)) if compact else F.col("t").cast("double"))
    lengths = rows.select("uid", "row_id", "_len").distinct()
    if compact:
        lengths = lengths.where("_len > 0")
    order = Window.partitionBy("uid").orderBy(F.col("_len").desc(), "row_id")
    ranked = lengths.withColumns({"_place": F.row_number().over(order), "_n": F.count("*").over(Window.partitionBy("uid"))})
    per_group = ranked.groupBy("uid").agg(F.max("_n").alias("_n"), F.max(F.when(F.col("_place") == 1, F.col("_len"))).alias("_longest"), F.max(F.when(F.col("_place") == 2, F.col("_len"))).alias("_second"))
    rows = rows.join(per_group, "uid", "left")
    at = Window.partitionBy("uid", "_step")
    part = F.col("_w") * F.col("m")
    base = F.sum(F.col("returns") * part).over(at) / (F.sum(part).over(at) + eps)
    base = F.when(F.coalesce(F.col("_n"), F.lit(0)) < 2, 0.0).otherwise(base)
    if zero_tail:
        base = F.when((F.col("_len") == F.col("_longest")) & (F.col("_longest") > F.col("_second")) & (F.col("_step") > F.col("_second")), 0.0).otherwise(base)
    return rows.withColumn("adv", (F.col("returns") - base) * F.col("m")).drop("_w", "_len", "_step", "_n", "_longest", "_second")


REGISTRY: dict[str, Callable[..., DataFrame]] = {
    "grpo": grpo, "grpo_vectorized": grpo_vectorized, "grpo_passk": grpo_passk, "gdpo": gdpo, "rloo": rloo, "rloo_vectorized": rloo_vectorized, "opo": opo,
    "gpg": gpg, "remax": remax, "reinforce_plus_plus": reinforce_plus_plus, "reinforce_plus_plus_baseline": reinforce_plus_plus_baseline, "gae": gae,
    "optimal_token_baseline": optimal_token_baseline, "tir_optimal_token_baseline": lambda long, **k: optimal_token_baseline(long, compact=True, **k),
}


def register(name: str, fn: Callable[..., DataFrame]) -> None:
    """Adds an estimator; a name can't be taken by two functions."""
    if REGISTRY.get(name, fn) is not fn:
        raise ValueError(f"{name} is already registered")
    REGISTRY[name] = fn


def estimator(name: str) -> Callable[..., DataFrame]:
    if name not in REGISTRY:
        raise ValueError(f"unknown estimator {name}; known: {sorted(REGISTRY)}")
    return REGISTRY[name]
