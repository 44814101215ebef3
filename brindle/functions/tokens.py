"""Reductions and maps over token arrays of one row (the wide form).

A row is a sample; its token columns are arrays of equal length. Everything here is an
expression on those arrays, so no plan built from it shuffles. ``mask`` is 1 for tokens
that count. Epsilons differ between functions on purpose.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

Name = str



def zero() -> Column:
    return F.lit(0.0)


def zipped(*names: Name) -> Column:
    return F.arrays_zip(*[F.col(n) for n in names])


def per_token(fn: Callable[..., Column], *names: Name) -> Column:
    """fn(values of the named arrays at a token) for each token."""
    return F.transform(zipped(*names), lambda s: fn(*[s[n] for n in names]))


def total(values: Column) -> Column:
    return F.aggregate(values, zero(), lambda a, x: a + x.cast("double"))


def masked_sum(value: Name, mask: Name) -> Column:
    """Sum over valid tokens; what lies outside the mask, NaN too, counts nothing."""
    return total(per_token(lambda v, m: F.when(m > 0, v * m).otherwise(zero()), value, mask))


def mask_count(mask: Name) -> Column:
    return total(F.col(mask))


def masked_mean(value: Name, mask: Name) -> Column:
    return masked_sum(value, mask) / (mask_count(mask) + 1e-8)


def masked_max(value: Name, mask: Name) -> Column:
    """0 where no token is valid."""
    return F.coalesce(F.array_max(F.transform(F.filter(zipped(value, mask), lambda s: s[mask] > 0), lambda s: s[value])), zero())


def clamp(x: Column, low: float | None = None, high: float | None = None) -> Column:
    if low is not None:
        x = F.greatest(x, F.lit(float(low)))
    return F.least(x, F.lit(float(high))) if high is not None else x


def clip_by_value(x: Column, low: Column, high: Column) -> Column:
    return F.greatest(F.least(x, high), low)


def response_mask(ids: Name, eos: int) -> Column:
    """1 up to the first end token, itself included; all 1 without one."""
    at = F.array_position(ids, F.lit(eos))
    return F.transform(F.col(ids), lambda x, i: F.when((at == 0) | (i < at), 1).otherwise(0))


def last_of_mask(attention: Name, n: int) -> Column:
    """The response part of an attention mask: its last n places."""
    return F.slice(attention, -n, n)


def pad_to(values: Name, n: int, pad: Column, left: bool = False) -> Column:
    fill = F.array_repeat(pad, F.greatest(F.lit(n) - F.size(values), F.lit(0)))
    return F.concat(fill, F.col(values)) if left else F.concat(F.col(values), fill)


def truncate(values: Name, n: int, side: str = "right") -> Column:
    """Keep n tokens: side "right" drops from the end, "left" from the start, "middle"
    from the middle; "error" raises where there are more."""
    size, col = F.size(values), F.col(values)
    if side == "right":
        return F.slice(col, 1, n)
    if side == "left":
        return F.when(size > n, F.slice(col, F.greatest(size - n, F.lit(0)) + 1, n)).otherwise(col)
    if side == "middle":
        head = n // 2
        return F.when(size > n, F.concat(F.slice(col, 1, head), F.slice(col, F.greatest(size - (n - head), F.lit(0)) + 1, n - head))).otherwise(col)
    if side == "error":
        return F.when(size > n, F.raise_error(F.concat(F.lit("sequence of length "), size.cast("string")))).otherwise(col)
    raise ValueError(side)


def unpad(values: Name, mask: Name) -> Column:
    """The tokens that the mask keeps."""
    return F.transform(F.filter(zipped(values, mask), lambda s: s[mask] > 0), lambda s: s[values])


def last_valid(mask: Name, value: Column) -> Column:
    """An array of zeros but for ``value`` at the last valid token."""
    at = mask_count(mask).cast("int") - 1
    return F.transform(F.col(mask), lambda m, i: F.when(i == at, value.cast("double")).otherwise(zero()))


def kl(kind: str, lp: Column, ref: Column) -> Column:
    """Per-token divergence estimate. A trailing + only changes gradients."""
    kind = kind.rstrip("+")
    if kind in ("kl", "k1"):
        return lp - ref
    if kind == "abs":
        return F.abs(lp - ref)
    if kind in ("mse", "k2"):
        return 0.5 * (lp - ref) * (lp - ref)
    if kind in ("low_var_kl", "k3"):
        d = clamp(ref - lp, -20, 20)
        return clamp(F.exp(d) - d - 1, -10, 10)
    raise NotImplementedError(kind)


def ceildiv(a: Column, b: Column | int) -> Column:
    return F.ceil(a / b).cast("long")


def roundup_divisible(a: Column, b: Column | int) -> Column:
    return ceildiv(a, b) * b


def overlong_penalty(length: Column, most: int, buffer: int, factor: float) -> Column:
    """0 up to most - buffer tokens, then falling linearly."""
    return F.least(-(length - (most - buffer)) / F.lit(buffer) * F.lit(factor), zero())
