"""Forward values of policy, value and entropy losses on logged log-probabilities.

Inputs are in wide form: olp (old log-probability), lp, a (advantage), m (mask) and, if
given, w (importance weight) are arrays. A loss is a token array or a row value, reduced
by one aggregation without a shuffle of tokens; results are one row with ``loss`` and the
loss's metrics. Without a valid token the loss is null.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.functions import tokens as T
from brindle.operators.selection import first_rows


@dataclass(frozen=True)
class Options:
    clip: float = 0.2
    clip_low: float | None = None
    clip_high: float | None = None
    clip_c: float = 3.0
    mode: str = "token-mean"
    tau_pos: float = 1.0
    tau_neg: float = 1.05
    cov_ratio: float = 2e-4
    cov_low: float = 1.0
    cov_high: float = 5.0
    kl_coef: float = 1.0
    scale: float | None = None
    seed: int = 0

    @property
    def low(self) -> float:
        return self.clip if self.clip_low is None else self.clip_low

    @property
    def high(self) -> float:
        return self.clip if self.clip_high is None else self.clip_high


MODES = ("token-mean", "seq-mean-token-sum", "seq-mean-token-sum-norm", "seq-mean-token-mean")


def mean_of(values: Column, mask: str = "m") -> Column:
    """Aggregate: masked mean of a token array over the batch."""
    part = T.total(F.zip_with(values, F.col(mask), lambda v, m: F.when(m > 0, v * m).otherwise(T.zero())))
    return F.sum(part) / (F.sum(T.mask_count(mask)) + 1e-8)


def agg_loss(values: Column, mode: str, mask: str = "m", scale: float | None = None) -> Column:
    """Aggregate of a token array by one of MODES. Rows without a valid token count for
    nothing; the norm mode divides by ``scale``, else by the longest row."""
    part = T.total(F.zip_with(values, F.col(mask), lambda v, m: F.when(m > 0, v * m).otherwise(T.zero())))
    n = T.mask_count(mask)
    some = F.when(n > 0, 1.0).otherwise(0.0)
    if mode == "token-mean":
        return F.try_divide(F.sum(part), F.sum(n))
    if mode == "seq-mean-token-sum":
        return F.try_divide(F.sum(part * some), F.sum(some))
    if mode == "seq-mean-token-sum-norm":
        return F.try_divide(F.try_divide(F.sum(part * some), F.sum(some)), F.lit(scale) if scale else F.max(F.size(mask)))
    if mode == "seq-mean-token-mean":
        return F.try_divide(F.sum(part / (n + 1e-8) * some), F.sum(some))
    raise ValueError(f"loss mode {mode}; known: {MODES}")


def _tokens(fn: Callable[[Column], Column], df: DataFrame) -> Column:
    names = [c for c in ("olp", "lp", "a", "m", "w", "d", "extra") if c in df.columns]
    return F.transform(F.arrays_zip(*[F.col(c) for c in names]), fn)


def _weighted(value: Column, s: Column, df: DataFrame) -> Column:
    return value * s["w"] if "w" in df.columns else value


def _ratio(s: Column) -> tuple[Column, Column]:
    d = T.clamp(s["lp"] - s["olp"], -20, 20)
    return d, F.exp(d)


def _result(df: DataFrame, loss: Column, **metrics: Column) -> DataFrame:
    return df.agg(loss.alias("loss"), *[v.alias(k) for k, v in metrics.items()])


def _neg_kl(df: DataFrame, clamp: bool = True) -> Column:
    return mean_of(_tokens(lambda s: -(_ratio(s)[0] if clamp else s["lp"] - s["olp"]), df))


def vanilla(df: DataFrame, o: Options = Options()) -> DataFrame:
    """Clipped surrogate with a second bound for negative advantages."""

    def parts(s: Column) -> tuple[Column, Column, Column]:
        _, ratio = _ratio(s)
        first = -s["a"] * ratio
        both = F.greatest(first, -s["a"] * T.clamp(ratio, 1 - o.low, 1 + o.high))
        return first, both, -s["a"] * o.clip_c

    def loss(s: Column) -> Column:
        _, both, bound = parts(s)
        return _weighted(F.when(s["a"] < 0, F.least(bound, both)).otherwise(both), s, df)

    clipped = _tokens(lambda s: F.when(parts(s)[1] > parts(s)[0], 1.0).otherwise(0.0), df)
    lower = _tokens(lambda s: F.when((parts(s)[1] > parts(s)[2]) & (s["a"] < 0), 1.0).otherwise(0.0), df)
    return _result(df, agg_loss(_tokens(loss, df), o.mode, scale=o.scale), pg_clipfrac=mean_of(clipped), ppo_kl=_neg_kl(df), pg_clipfrac_lower=mean_of(lower))


def _dppo(df: DataFrame, o: Options, valid: Callable[[Column], Column]) -> DataFrame:
    def loss(s: Column) -> Column:
        return _weighted(-s["a"] * F.least(_ratio(s)[1], F.lit(20.0)) * s["lp"] * valid(s), s, df)

    over = _tokens(lambda s: F.when(_ratio(s)[1] > 20.0, valid(s)).otherwise(0.0), df)
    return _result(df, agg_loss(_tokens(loss, df), o.mode, scale=o.scale), pg_clipfrac=mean_of(_tokens(lambda s: 1.0 - valid(s), df)), ppo_kl=_neg_kl(df), pg_clipfrac_lower=mean_of(over))


def dppo_tv(df: DataFrame, o: Options = Options()) -> DataFrame:
    """A token counts while its probability has moved less than the bound."""

    def valid(s: Column) -> Column:
        move = F.exp(s["lp"]) - F.exp(s["olp"])
        return F.when(F.when(s["a"] > 0, move <= o.high).otherwise(move >= -o.low), 1.0).otherwise(0.0)

    return _dppo(df, o, valid)


def dppo_kl(df: DataFrame, o: Options = Options()) -> DataFrame:
    """The same with the divergence between two outcomes: this token or another."""

    def valid(s: Column) -> Column:
        p, q = F.exp(s["lp"]), F.exp(s["olp"])
        div = q * (s["olp"] - s["lp"]) + (1 - q) * F.log((1.0 - q + 1e-8) / (1.0 - p + 1e-8))
        good = F.when(s["a"] > 0, (div <= o.high) | (p <= q)).otherwise((div <= o.low) | (p >= q))
        return F.when(good, 1.0).otherwise(0.0)

    return _dppo(df, o, valid)


def gspo(df: DataFrame, o: Options = Options()) -> DataFrame:
    """The ratio of a sequence is its geometric mean; always seq-mean-token-mean."""
    d = T.total(_tokens(lambda s: (s["lp"] - s["olp"]) * s["m"], df)) / F.greatest(T.mask_count("m"), F.lit(1.0))
    rows = df.withColumn("_q", F.exp(F.least(d, F.lit(10.0))))
    first = lambda s: -s["a"] * F.col("_q")
    second = lambda s: -s["a"] * T.clamp(F.col("_q"), 1 - o.low, 1 + o.high)
    loss = _tokens(lambda s: _weighted(F.greatest(first(s), second(s)), s, df), df)
    clipped = _tokens(lambda s: F.when(second(s) > first(s), 1.0).otherwise(0.0), df)
    return _result(rows, agg_loss(loss, "seq-mean-token-mean"), pg_clipfrac=mean_of(clipped), ppo_kl=_neg_kl(df, clamp=False))


def sapo(df: DataFrame, o: Options = Options()) -> DataFrame:
    """A smooth gate on the ratio, its temperature by the sign of the advantage."""

    def loss(s: Column) -> Column:
        tau = F.when(s["a"] > 0, o.tau_pos).otherwise(o.tau_neg)
        gate = 1 / (1 + F.exp(-tau * (_ratio(s)[1] - 1.0))) * (4.0 / tau)
        return _weighted(-gate * s["a"], s, df)

    return _result(df, agg_loss(_tokens(loss, df), "seq-mean-token-mean"), ppo_kl=_neg_kl(df))


def gpg(df: DataFrame, o: Options = Options()) -> DataFrame:
    return _result(df, agg_loss(_tokens(lambda s: _weighted(-s["lp"] * s["a"], s, df), df), o.mode, scale=o.scale))


def _centred(df: DataFrame) -> DataFrame:
    """Adds the batch means of advantage and log-probability (one row, joined)."""
    return df.join(F.broadcast(df.agg(mean_of(F.col("a")).alias("_ma"), mean_of(F.col("lp")).alias("_ml"), F.sum(T.mask_count("m")).alias("_n"))))


def chosen_by_covariance(df: DataFrame, k: Column, order: list[Column], where: Column) -> DataFrame:
    """Adds ``extra``: 1 at the k tokens that come first in ``order`` (columns row_id, p,
    cov, all numbers; none equal in all) among those that meet ``where``, else 0. Their
    last place is found by counts over all tasks (``selection``), however large k is."""
    cov = F.transform(F.arrays_zip("a", "lp", "olp", "m"), lambda s: F.struct(((s["a"] - F.col("_ma")) * (s["lp"] - F.col("_ml"))).alias("cov"), s["a"].alias("a"), s["lp"].alias("lp"), s["olp"].alias("olp"), s["m"].alias("m")))
    rows = df.withColumn("_cov", cov)
    few = rows.select("row_id", "_n", F.posexplode("_cov").alias("p", "c")).select("row_id", "_n", "p", "c.*").where("m > 0").where(where)
    number = few.select(k.cast("int").alias("k")).limit(1).collect()
    top = first_rows(few, order, number[0]["k"] if number else 0).groupBy("row_id").agg(F.collect_set("p").alias("_at"))
    rows = rows.join(top, "row_id", "left")
    return rows.withColumn("extra", F.transform("m", lambda m, i: F.when(F.coalesce(F.array_contains(F.col("_at"), i), F.lit(False)), 1.0).otherwise(0.0))).drop("_cov", "_at")


def clip_cov(df: DataFrame, o: Options = Options()) -> DataFrame:
    """Drops a seeded random few of the unclipped tokens of high covariance."""
    ratio = F.exp(F.col("lp") - F.col("olp"))
    clipped = -F.col("a") * T.clamp(ratio, 1 - o.low, 1 + o.high) > -F.col("a") * ratio
    where = ~clipped & (F.col("cov") > o.cov_low) & (F.col("cov") < o.cov_high)
    few = F.greatest(F.floor(o.cov_ratio * F.col("_n")), F.lit(1))
    rows = chosen_by_covariance(_centred(df), few, [F.xxhash64(F.lit(o.seed), "row_id", "p"), F.col("row_id"), F.col("p")], where)

    def loss(s: Column) -> Column:
        q = F.exp(s["lp"] - s["olp"])
        return _weighted(F.greatest(-s["a"] * q, -s["a"] * T.clamp(q, 1 - o.low, 1 + o.high)) * (1 - s["extra"]), s, df)

    return _result(rows, agg_loss(_tokens(loss, rows), o.mode, scale=o.scale), pg_clipfrac=mean_of(F.col("extra")), ppo_kl=_neg_kl(df, clamp=False))


def kl_cov(df: DataFrame, o: Options = Options()) -> DataFrame:
    """Tokens of the highest covariance pay for their distance; ties by row and place."""
    few = F.greatest(F.floor(F.col("_n") * o.cov_ratio), F.lit(1))
    rows = chosen_by_covariance(_centred(df), few, [-F.col("cov"), F.col("row_id"), F.col("p")], F.lit(True))

    def loss(s: Column) -> Column:
        d = s["lp"] - s["olp"]
        return _weighted(-s["a"] * F.exp(d) + s["extra"] * o.kl_coef * F.abs(d), s, df)

    return _result(rows, agg_loss(_tokens(loss, rows), o.mode, scale=o.scale), ppo_kl=mean_of(_tokens(lambda s: F.abs(s["lp"] - s["olp"]), df)))


def geo_mean(df: DataFrame, o: Options = Options()) -> DataFrame:
    """Clipped geometric-mean ratio of a sequence times its mean advantage; a plain mean."""
    n = T.mask_count("m") + 1e-8

    def least(s: Column) -> Column:
        d, sign = s["lp"] - s["olp"], F.signum(s["a"])
        return sign * F.least(sign * d, sign * T.clamp(d, -o.low, o.high))

    ratio = F.exp(T.total(_tokens(lambda s: least(s) * s["m"], df)) / n)
    mean = T.total(_tokens(lambda s: s["a"] * s["m"], df)) / n
    loss = -mean * ratio
    if "w" in df.columns:
        loss = loss * F.exp(T.total(_tokens(lambda s: F.log(s["w"] + 1e-10) * s["m"], df)) / n)
    off = lambda s: (s["lp"] - s["olp"]) != T.clamp(s["lp"] - s["olp"], -o.low, o.high)
    up = _tokens(lambda s: F.when(off(s) & (s["a"] > 0), 1.0).otherwise(0.0), df)
    down = _tokens(lambda s: F.when(off(s) & (s["a"] < 0), 1.0).otherwise(0.0), df)
    return _result(df, F.avg(loss), pg_clipfrac=mean_of(up), ppo_kl=_neg_kl(df, clamp=False), pg_clipfrac_lower=mean_of(down))


def cispo(df: DataFrame, o: Options = Options()) -> DataFrame:
    clip = lambda s: T.clamp(_ratio(s)[1], 1 - o.low, 1 + o.high)
    loss = _tokens(lambda s: _weighted(-clip(s) * s["a"] * s["lp"], s, df), df)
    clipped = _tokens(lambda s: F.when(_ratio(s)[1] != clip(s), 1.0).otherwise(0.0), df)
    return _result(df, agg_loss(loss, o.mode, scale=o.scale), pg_clipfrac=mean_of(clipped), ppo_kl=_neg_kl(df))


def reinforce(df: DataFrame, o: Options = Options()) -> DataFrame:
    loss = _tokens(lambda s: _weighted(-s["a"] * s["lp"], s, df), df)
    return _result(df, agg_loss(loss, o.mode, scale=o.scale), ppo_kl=_neg_kl(df, clamp=False))


def bypass_mode(df: DataFrame, o: Options = Options(), kind: str = "ppo_clip", threshold: float = 2.0, rejection: dict | None = None) -> DataFrame:
    """Old log-probabilities are the rollout's; the weights and the rejection mask are
    made here, and given weights are ignored. ppo_clip doesn't use the weights."""
    from brindle.operators import correction as C

    rows = df.drop("w").withColumn("lr", T.per_token(lambda lp, olp: lp - olp, "lp", "olp"))
    for option, bounds in (rejection or {}).items():
        rows = rows.withColumn("m", C.rejection_mask("lr", "m", option, *bounds))
    if kind == "ppo_clip":
        return vanilla(rows.drop("lr"), o)
    if kind != "reinforce":
        raise ValueError(f"bypass loss {kind}")
    return reinforce(rows.withColumn("w", C.is_weights("lr", "m", "token", threshold)).drop("lr"), o)


def value_loss(df: DataFrame, clip: float, mode: str = "token-mean") -> DataFrame:
    """vpred, values, ret, m: half the larger of plain and clipped squared errors."""
    pair = F.arrays_zip("vpred", "values", "ret")
    clipped = lambda s: F.greatest(F.least(s["vpred"], s["values"] + clip), s["values"] - clip)
    one = lambda s: (s["vpred"] - s["ret"]) * (s["vpred"] - s["ret"])
    two = lambda s: (clipped(s) - s["ret"]) * (clipped(s) - s["ret"])
    loss = F.transform(pair, lambda s: F.greatest(one(s), two(s)))
    frac = F.transform(pair, lambda s: F.when(two(s) > one(s), 1.0).otherwise(0.0))
    return df.agg((0.5 * agg_loss(loss, mode)).alias("loss"), mean_of(frac).alias("vf_clipfrac"))


REGISTRY: dict[str, Callable[..., DataFrame]] = {
    "vanilla": vanilla, "dppo_tv": dppo_tv, "dppo_kl": dppo_kl, "gspo": gspo, "sapo": sapo, "gpg": gpg, "clip_cov": clip_cov, "kl_cov": kl_cov,
    "geo_mean": geo_mean, "cispo": cispo, "reinforce": reinforce, "bypass_mode": bypass_mode,
}


def policy_loss(name: str) -> Callable[..., DataFrame]:
    if name not in REGISTRY:
        raise ValueError(f"unknown loss {name}; known: {sorted(REGISTRY)}")
    return REGISTRY[name]


def register(name: str, fn: Callable[..., DataFrame]) -> None:
    """Adds a loss; a name can't be taken by two functions."""
    if REGISTRY.get(name, fn) is not fn:
        raise ValueError(f"{name} is already registered")
    REGISTRY[name] = fn
