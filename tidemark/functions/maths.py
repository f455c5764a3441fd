"""Null-safe arithmetic and statistics as Column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F


def ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is 0 or null."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def change(a: Column, b: Column, bound: float | None = None) -> Column:
    """(a - b) / |b|, null for b = 0, cut to +-bound."""
    out = ratio(a - b, F.abs(b))
    return out if bound is None else clip(out, -bound, bound)


def clip(x: Column, lo: float, hi: float) -> Column:
    """x within [lo, hi]; null stays null."""
    return F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(float(lo))), F.lit(float(hi))))


def first_nonzero(*columns: Column) -> Column:
    """The first of the columns that is neither null nor 0."""
    return F.coalesce(*(F.nullif(c, F.lit(0).cast("double")) for c in columns))


def labelled_coalesce(**columns: Column) -> tuple[Column, Column]:
    """The first non-null of the columns, and its name."""
    return F.coalesce(*columns.values()), F.coalesce(*(F.when(c.isNotNull(), F.lit(n)) for n, c in columns.items()))


def greatest_or_null(*columns: Column) -> Column:
    """Null if any column is: the rule of SQL dialects whose GREATEST doesn't skip nulls."""
    known = columns[0].isNotNull()
    for c in columns[1:]:
        known = known & c.isNotNull()
    return F.when(known, F.greatest(*columns))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def normalised(x: Column, lo: float, hi: float) -> Column:
    """Linear from [lo, hi] to [-1, 1], cut at the ends."""
    return clip((x - (lo + hi) / 2) / ((hi - lo) / 2), -1, 1)


def normal_tail(z: Column) -> Column:
    """P(|Z| > |z|) of the normal distribution, by a rational approximation of the error function (error under 1.5e-7)."""
    x = F.abs(z) / math.sqrt(2)
    t = 1 / (1 + 0.3275911 * x)
    poly = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
    return poly * F.exp(-x * x)


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - cosine similarity of two arrays; null for a zero vector."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return 1 - F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def kelly(win_rate: Column, win_loss: Column, fraction: float = 1.0) -> Column:
    """Share of capital to stake: p - (1 - p) / b, never below 0, times ``fraction``."""
    return F.greatest(win_rate - ratio(1 - win_rate, win_loss), F.lit(0.0)) * fraction


def correlation(a: str | Column, b: str | Column) -> Column:
    """Pearson's correlation as an aggregate, null where either side doesn't vary: corr() fails there under ANSI rules."""
    return F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))
