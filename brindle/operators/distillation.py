"""Distillation losses from logged top-k distributions.

A token's distribution is a ragged list of (id, lp): token ids and their log-probabilities,
the k likeliest of a vocabulary. Teacher and student lists are aligned by id inside the row
(a join of two lists, no shuffle); an id that the other list lacks has at most the
probability that the other has left, and counts as ``floor``. Log-probabilities are clamped
from below before a divergence, not before a mass. Ids of one list are distinct.

Rows are wide: ``teacher`` and ``student`` are arrays (tokens) of arrays of structs, m is
the mask. Null lists are empty ones; a token without teacher entries has divergence 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.functions import tokens as T
from brindle.operators.losses import agg_loss, mean_of

#: Log-probability of what a list doesn't have, and the least that counts.
FLOOR = -10.0


def _sum(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda t, v: t + v)


def top_k(entries: Column, k: int) -> Column:
    """The k likeliest entries of a list, ties by id."""
    ranked = F.array_sort(F.transform(entries, lambda e: F.struct((-e["lp"]).alias("_r"), e["id"].alias("id"), e["lp"].alias("lp"))))
    return F.transform(F.slice(ranked, 1, k), lambda e: F.struct(e["id"].alias("id"), e["lp"].alias("lp")))


def aligned(left: Column, right: Column) -> Column:
    """The entries of ``left`` with the other list's log-probability: id, lp, other (null
    where it has none)."""
    known = F.map_from_entries(F.transform(F.coalesce(right, F.array()), lambda e: F.struct(e["id"], e["lp"])))
    return F.transform(F.coalesce(left, F.array()), lambda e: F.struct(e["id"].alias("id"), e["lp"].alias("lp"), F.try_element_at(known, e["id"]).alias("other")))


def mass(pairs: Column, name: str = "lp") -> Column:
    """The probability that entries cover."""
    return _sum(F.transform(pairs, lambda e: F.coalesce(F.exp(e[name]), F.lit(0.0))))


def divergence(pairs: Column, floor: float = FLOOR, clamp: float | None = FLOOR) -> Column:
    """Sum over aligned entries of p (log p - log q). It can be negative, as lists don't
    hold all of a distribution."""
    low = (lambda x: x) if clamp is None else (lambda x: F.greatest(x, F.lit(clamp)))
    one = lambda e: F.exp(low(e["lp"])) * (low(e["lp"]) - low(F.coalesce(e["other"], F.lit(floor))))
    return _sum(F.transform(pairs, one))


def with_divergence(df: DataFrame, teacher: str = "teacher", student: str = "student", direction: str = "forward", floor: float = FLOOR, clamp: float | None = FLOOR) -> DataFrame:
    """Adds token arrays kl, teacher_mass, student_mass and shared: the divergence of the
    student from the teacher over the teacher's ids ("forward") or the other way ("reverse"),
    what the base list and the other cover of those ids, and how many ids are in both."""
    if direction not in ("forward", "reverse"):
        raise ValueError(f"direction {direction!r}: forward or reverse")
    base, other = (teacher, student) if direction == "forward" else (student, teacher)
    pairs = F.zip_with(F.coalesce(base, F.array()), F.coalesce(other, F.array()), aligned)
    rows = df.withColumn("_pairs", pairs)
    each = lambda fn: F.transform("_pairs", fn)
    masses = {base: each(lambda p: mass(p)), other: each(lambda p: mass(p, "other"))}
    return rows.withColumns({
        "kl": each(lambda p: divergence(p, floor, clamp)), "teacher_mass": masses[teacher], "student_mass": masses[student],
        "shared": each(lambda p: F.size(F.filter(p, lambda e: e["other"].isNotNull()))),
    }).drop("_pairs")


def distillation_loss(df: DataFrame, mode: str = "token-mean", most: float | None = None, m: str = "m") -> DataFrame:
    """One row: the loss over kl of ``with_divergence`` (negative ones count as 0, at most
    ``most`` where given), its least, mean and largest valid value before that bound, and the
    covered masses."""
    valid = lambda c: F.filter(F.transform(F.arrays_zip(c, m), lambda s: F.when(s[m] > 0, s[c])), lambda x: x.isNotNull())
    kl = F.transform("kl", lambda x: F.greatest(x, F.lit(0.0)))
    rows = df.withColumn("_kl", kl)
    bounded = F.transform("_kl", lambda x: F.least(F.greatest(x, F.lit(-most)), F.lit(most))) if most is not None else F.col("_kl")
    out = {"loss": agg_loss(bounded, mode, m), "kl_mean": mean_of(F.col("_kl"), m), "kl_min": F.min(F.array_min(valid("_kl"))), "kl_max": F.max(F.array_max(valid("_kl")))}
    for c in ("teacher_mass", "student_mass"):
        out |= {c: mean_of(F.col(c), m), f"{c}_min": F.min(F.array_min(valid(c))), f"{c}_max": F.max(F.array_max(valid(c)))}
    return rows.agg(*[v.alias(k) for k, v in out.items()])


def estimated_loss(df: DataFrame, kind: str, mode: str = "token-mean", lp: str = "lp", teacher_lp: str = "ref", m: str = "m") -> DataFrame:
    """One row: the loss by a one-sample estimator of the reverse divergence (``tokens.kl``:
    k1, k2, k3, abs, ..) and the mean absolute value of its tokens."""
    kl = T.per_token(lambda x, y: T.kl(kind, x, y), lp, teacher_lp)
    rows = df.withColumn("_kl", kl)
    return rows.agg(agg_loss(F.col("_kl"), mode, m).alias("loss"), mean_of(F.transform("_kl", lambda x: F.abs(x)), m).alias("abs_loss"))
