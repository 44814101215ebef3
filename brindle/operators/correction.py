"""Rollout correction: importance weights, rejection masks and their diagnostics.

lr is the token array of log ratios (training minus rollout log-probability), m the
mask. Weights and masks are expressions on a row; batch figures are one aggregation.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.functions import tokens as T
from brindle.operators.losses import mean_of

BOUND = 20.0
TOKEN_OPTIONS = ("token_k1", "token_k2", "token_k3")
OPTIONS = (*TOKEN_OPTIONS, *(f"seq_{a}_{k}" for a in ("sum", "mean") for k in ("k1", "k2", "k3")), "seq_max_k2", "seq_max_k3")


def parse_threshold(spec: str | float) -> tuple[float | None, float]:
    """(lower or None, upper) of "upper" or "lower_upper"."""
    parts = [float(x) for x in str(spec).split("_")]
    if len(parts) not in (1, 2) or any(p <= 0 for p in parts):
        raise ValueError(f"threshold {spec!r}: positive upper, or lower_upper")
    low, high = (None, parts[0]) if len(parts) == 1 else parts
    if low is not None and low > high:
        raise ValueError(f"threshold {spec!r}: lower is above upper")
    return low, high


def parse_rejection(options: str, thresholds: str | float) -> dict[str, tuple[float | None, float]]:
    """A threshold for each option, or one for all. k1 options have both bounds; the
    lower is 1/upper unless given."""
    names = list(dict.fromkeys(o.strip() for o in options.split(",") if o.strip()))
    unknown = [o for o in names if o not in OPTIONS]
    if unknown or not names:
        raise ValueError(f"rejection options {unknown or options!r}; known: {OPTIONS}")
    specs = [s.strip() for s in str(thresholds).split(",")]
    if len(specs) not in (1, len(names)):
        raise ValueError("one threshold, or one for each option")
    out = {}
    for name, spec in zip(names, specs * len(names) if len(specs) == 1 else specs):
        low, high = parse_threshold(spec)
        out[name] = (low if low is not None else 1 / high, high) if name.endswith("k1") else (None, high)
    return out


def _statistic(kind: str, x: Column) -> Column:
    x = T.clamp(x, -BOUND, BOUND)
    return {"k1": -x, "k2": 0.5 * x * x, "k3": F.exp(x) - 1.0 - x}[kind]


def _within(stat: Column, kind: str, low: float | None, high: float) -> Column:
    if kind == "k1":
        return (stat >= math.log(low)) & (stat <= math.log(high))
    return stat <= high


def row_statistic(lr: str, m: str, option: str) -> Column:
    """Sum, mean or maximum over valid tokens of an option's statistic."""
    _, how, kind = option.split("_")
    stats = F.transform(F.arrays_zip(lr, m), lambda s: F.when(s[m] > 0, _statistic(kind, s[lr]) * s[m]).otherwise(T.zero()))
    if how == "max":
        valid = F.transform(F.filter(F.arrays_zip(lr, m), lambda s: s[m] > 0), lambda s: _statistic(kind, s[lr]))
        return F.coalesce(F.array_max(valid), T.zero())
    return T.total(stats) if how == "sum" else T.total(stats) / (T.mask_count(m) + 1e-8)


def rejection_mask(lr: str, m: str, option: str, low: float | None, high: float) -> Column:
    """The mask with what the option rejects set to 0. A statistic equal to a bound is
    kept. Statistics are sums of doubles: where a bound is a value that the data's sums can
    have, the last bit of a sum decides, so choose bounds between such values."""
    if option not in OPTIONS:
        raise ValueError(f"rejection option {option}; known: {OPTIONS}")
    kind = option[-2:]
    if option in TOKEN_OPTIONS:
        return F.transform(F.arrays_zip(lr, m), lambda s: F.when(_within(_statistic(kind, s[lr]), kind, low, high), s[m]).otherwise(T.zero()))
    keep = _within(row_statistic(lr, m, option), kind, low, high)
    return F.transform(F.col(m), lambda x: F.when(keep, x).otherwise(T.zero()))


def reject(df: DataFrame, lr: str, m: str, options: str, thresholds: str | float, out: str = "kept") -> DataFrame:
    """All options together: a token stays if every option keeps it."""
    masks = [rejection_mask(lr, m, o, *b) for o, b in parse_rejection(options, thresholds).items()]
    keep = masks[0]
    for other in masks[1:]:
        keep = F.zip_with(keep, other, lambda a, b: F.when((a > 0) & (b > 0), a).otherwise(T.zero()))
    return df.withColumn(out, keep)


def rejection_metrics(df: DataFrame, m: str = "m", kept: str = "kept") -> DataFrame:
    """Shares of valid tokens rejected, and of rows with a rejected token."""
    gone = F.zip_with(F.col(m), F.col(kept), lambda a, b: F.when((a > 0) & (b <= 0), 1.0).otherwise(0.0))
    return df.agg(mean_of(gone, m).alias("masked_fraction"), F.avg(F.when(T.total(gone) > 0, 1.0).otherwise(0.0)).alias("seq_masked_fraction"))


def raw_weights(lr: str, m: str, level: str) -> Column:
    if level == "token":
        return F.transform(F.arrays_zip(lr, m), lambda s: F.exp(T.clamp(s[lr], -BOUND, BOUND)) * s[m])
    if level != "sequence":
        raise ValueError(f"level {level}: token or sequence")
    whole = F.exp(T.clamp(T.masked_sum(lr, m), -BOUND, BOUND))
    return F.transform(F.col(m), lambda x: whole * x)


def is_weights(lr: str, m: str, level: str, threshold: str | float) -> Column:
    """exp of token or summed log ratios: cut at upper, or 0 outside [lower, upper]."""
    low, high = parse_threshold(threshold)
    raw = raw_weights(lr, m, level)
    if low is None:
        return F.transform(raw, lambda x: F.least(x, F.lit(high)))
    return F.transform(raw, lambda x: F.when((x >= low) & (x <= high), x).otherwise(T.zero()))


def normalise_weights(df: DataFrame, w: str, m: str, level: str) -> DataFrame:
    """Weights over their batch mean (of tokens, or of row means)."""
    if level == "token":
        mean = df.agg(mean_of(F.col(w), m).alias("_mean"))
    else:
        some = F.when(T.mask_count(m) > 0, 1.0).otherwise(0.0)
        mean = df.agg((F.sum(T.masked_mean(w, m) * some) / F.greatest(F.sum(some), F.lit(1e-8))).alias("_mean"))
    rows = df.join(F.broadcast(mean))
    return rows.withColumn(w, F.transform(w, lambda x: F.when(F.col("_mean") > 1e-8, x / F.col("_mean")).otherwise(x))).drop("_mean")


def is_metrics(df: DataFrame, lr: str, m: str, level: str, threshold: str | float) -> DataFrame:
    """One row of diagnostics of the weights of ``df`` (made here)."""
    low, high = parse_threshold(threshold)
    low = 1 / high if low is None else low
    rows = df.withColumns({"_w": is_weights(lr, m, level, threshold), "_raw": raw_weights(lr, m, level), "_sum": T.masked_sum(lr, m)})
    rows = rows.withColumns({"_row": T.masked_mean("_w", m), "_c": F.transform("_w", lambda x: F.greatest(F.least(x, F.lit(high)), T.zero()))})
    share = lambda c: F.avg(F.when(c, 1.0).otherwise(0.0))
    flag = lambda test: F.transform("_raw", lambda x: F.when(test(x), 1.0).otherwise(0.0))
    mean_c, mean_c2 = mean_of(F.col("_c"), m), mean_of(F.transform("_c", lambda x: x * x), m)
    out = {"is_mean": mean_of(F.col("_w"), m)}
    if level == "sequence":
        out |= {
            "is_max": F.exp(F.least(F.max("_sum"), F.lit(BOUND))), "is_min": F.exp(F.min("_sum")),
            "fraction_high": share(F.col("_sum") > math.log(high)), "fraction_low": share(F.col("_sum") < math.log(low)),
        }
    else:
        valid = F.transform(F.filter(F.arrays_zip("_w", m), lambda s: s[m] > 0), lambda s: s["_w"])
        out |= {
            "is_max": F.max(F.array_max(valid)), "is_min": F.min(F.array_min(valid)),
            "fraction_high": mean_of(flag(lambda x: x > high), m), "fraction_low": mean_of(flag(lambda x: x < low), m),
        }
    out |= {
        "is_std": F.sqrt(F.greatest(mean_c2 - mean_c * mean_c, T.zero())), "ess": (mean_c + 1e-8) * (mean_c + 1e-8) / mean_c2,
        "seq_mean": F.avg("_row"), "seq_std": F.coalesce(F.stddev_samp("_row"), T.zero()), "seq_max": F.max("_row"), "seq_min": F.min("_row"),
        "seq_max_deviation": F.max(F.abs(F.col("_row") - 1)), "seq_fraction_high": share(F.col("_row") > high), "seq_fraction_low": share(F.col("_row") < low),
    }
    return rows.agg(*[v.alias(k) for k, v in out.items()])


def offpolicy_metrics(df: DataFrame, training: str, rollout: str, m: str) -> DataFrame:
    """Perplexities and divergences between training and rollout log-probabilities."""
    rows = df.withColumn("_lr", T.per_token(lambda a, b: a - b, training, rollout))
    rows = rows.withColumns({"_t": T.masked_mean(training, m), "_r": T.masked_mean(rollout, m), "_s": T.clamp(T.masked_sum("_lr", m), -BOUND, BOUND)})
    diff = F.col("_r") - F.col("_t")
    out = {
        "training_ppl": F.avg(F.exp(-F.col("_t"))), "training_log_ppl": F.avg(-F.col("_t")), "kl": mean_of(F.transform("_lr", lambda x: -x), m),
        "k3_kl": mean_of(F.transform("_lr", lambda x: F.exp(x) - x - 1), m), "rollout_ppl": F.avg(F.exp(-F.col("_r"))), "rollout_log_ppl": F.avg(-F.col("_r")),
        "log_ppl_diff": F.avg(diff), "log_ppl_abs_diff": F.avg(F.abs(diff)), "log_ppl_diff_max": F.max(diff), "log_ppl_diff_min": F.min(diff), "ppl_ratio": F.avg(F.exp(diff)),
        "chi2_token": mean_of(F.transform("_lr", lambda x: F.exp(2.0 * T.clamp(x, -BOUND, BOUND))), m) - 1.0, "chi2_seq": F.avg(F.exp(2.0 * F.col("_s"))) - 1.0,
    }
    return rows.agg(*[v.alias(k) for k, v in out.items()])


def correct(df: DataFrame, lr: str, m: str, level: str | None, threshold: str | float, options: str | None = None, thresholds: str | float | None = None) -> DataFrame:
    """Weights and mask together; rejection does not change the weights."""
    rows = df.withColumn("w", is_weights(lr, m, level, threshold)) if level else df
    return reject(rows, lr, m, options, thresholds) if options else rows.withColumn("kept", F.col(m))


def option_metrics(df: DataFrame, lr: str, m: str, option: str, low: float | None, high: float) -> DataFrame:
    """One row of diagnostics of one rejection option: its statistic over tokens and over
    rows with a valid token, and what its mask rejects."""
    kind, sequence = option[-2:], option not in TOKEN_OPTIONS
    top = math.log(high) if kind == "k1" else high
    bottom = (math.log(low) if low is not None else None) if kind == "k1" else None
    rows = df.withColumns({"_k": rejection_mask(lr, m, option, low, high), "_n": T.mask_count(m)})
    if sequence:
        rows = rows.withColumn("_row", row_statistic(lr, m, option)).withColumn("_s", F.transform(F.col(m), lambda x: F.col("_row")))
    else:
        rows = rows.withColumn("_s", F.transform(F.col(lr), lambda x: _statistic(kind, x)))
        rows = rows.withColumn("_row", T.masked_mean("_s", m))
    gone = F.zip_with(F.col(m), F.col("_k"), lambda a, b: F.when((a > 0) & (b <= 0), 1.0).otherwise(0.0))
    valid = F.transform(F.filter(F.arrays_zip("_s", m), lambda s: s[m] > 0), lambda s: s["_s"])
    clamped = F.transform("_s", lambda x: T.clamp(x, bottom if bottom is not None else 0.0, top))
    row = F.when(F.col("_n") > 0, F.col("_row"))
    share = lambda c: F.coalesce(F.avg(F.when(row.isNotNull(), F.when(c, 1.0).otherwise(0.0))), T.zero())
    over = lambda test: mean_of(F.transform("_s", lambda x: F.when(test(x), 1.0).otherwise(0.0)), m)
    mean_c = mean_of(clamped, m)
    out = {"mean": mean_of(F.col("_s"), m)}
    if sequence:
        out |= {"max": F.max(row), "min": F.min(row), "fraction_high": share(row > top), "fraction_low": share(row < bottom) if bottom is not None else T.zero()}
    else:
        out |= {"max": F.max(F.array_max(valid)), "min": F.min(F.array_min(valid)), "fraction_high": over(lambda x: x > top), "fraction_low": over(lambda x: x < bottom) if bottom is not None else T.zero()}
    out |= {
        "std": F.sqrt(F.greatest(mean_of(F.transform(clamped, lambda x: x * x), m) - mean_c * mean_c, T.zero())),
        "seq_mean": F.avg(row), "seq_std": F.coalesce(F.stddev_samp(row), T.zero()), "seq_max": F.max(row), "seq_min": F.min(row), "seq_max_deviation": F.max(F.abs(row)),
        "seq_fraction_high": share(row > top), "seq_fraction_low": share(row < bottom) if bottom is not None else T.zero(),
        "masked_fraction": mean_of(gone, m), "seq_masked_fraction": F.avg(F.when(T.total(gone) > 0, 1.0).otherwise(0.0)),
    }
    return rows.agg(*[v.alias(k) for k, v in out.items()])


def all_option_metrics(df: DataFrame, lr: str, m: str, options: str, thresholds: str | float) -> DataFrame:
    """A row for each option, by name."""
    found = [option_metrics(df, lr, m, o, *b).withColumn("option", F.lit(o)) for o, b in parse_rejection(options, thresholds).items()]
    out = found[0]
    for other in found[1:]:
        out = out.unionByName(other)
    return out


@dataclass(frozen=True)
class Setting:
    """Level and threshold of weights (no level: none), rejection options and thresholds,
    and, without recomputed log-probabilities (bypass), the loss that is used."""

    level: str | None = None
    threshold: str | float = 2.0
    options: str | None = None
    thresholds: str | float | None = None
    bypass: bool = False
    loss: str = "ppo_clip"

    def apply(self, df: DataFrame, lr: str, m: str) -> DataFrame:
        return correct(df, lr, m, self.level, self.threshold, self.options, self.thresholds)


def _named_settings() -> dict[str, Setting]:
    """Weights of tokens or sequences, and rejection by the mean log ratio (geo) or by the
    mean of k3, alone and together; with policy gradient or clipping where bypassed."""
    weights = {"token": Setting("token"), "seq": Setting("sequence"), "icepop": Setting("token", "0.5_5.0")}
    rejects = {"geo": ("seq_mean_k1", "0.999_1.001"), "k3": ("seq_mean_k3", 0.01)}
    out = {"disabled": Setting(), "decoupled_token_is": weights["token"], "decoupled_seq_is": weights["seq"], "decoupled_token_icepop": weights["icepop"]}
    out["decoupled_seq_is_rs"] = Setting("sequence", 2.0, "seq_sum_k1", "0.5_2.0")
    for name, (option, threshold) in rejects.items():
        out[f"decoupled_{name}_rs"] = Setting(None, 2.0, option, threshold)
        for short in ("seq", "token"):
            out[f"decoupled_{name}_rs_{short}_tis"] = Setting(weights[short].level, 2.0, option, threshold)
        out[f"bypass_ppo_clip_{name}_rs"] = Setting(None, 2.0, option, threshold, True)
    geo = rejects["geo"]
    out["bypass_ppo_clip"] = Setting(bypass=True)
    out["bypass_pg_is"] = Setting("sequence", 2.0, bypass=True, loss="reinforce")
    out["bypass_pg_token_icepop"] = Setting("token", "0.5_5.0", bypass=True, loss="reinforce")
    out["bypass_pg_geo_rs"] = Setting(None, 2.0, *geo, bypass=True, loss="reinforce")
    for short in ("seq", "token"):
        out[f"bypass_pg_geo_rs_{short}_tis"] = Setting(weights[short].level, 2.0, *geo, bypass=True, loss="reinforce")
    return out


PRESETS: dict[str, Setting] = _named_settings()
