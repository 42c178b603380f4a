"""Guarded functions and parameter transforms as Columns: no NaN or infinity from arguments outside the domain."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Largest exponent, and smallest argument of a logarithm or divisor.
MOST, LEAST = 700.0, 1e-12


def safe_exp(x: Column, most: float = MOST) -> Column:
    return F.exp(F.least(F.greatest(x, F.lit(-most)), F.lit(most)))


def safe_log(x: Column, least: float = LEAST) -> Column:
    return F.log(F.greatest(x, F.lit(least)))


def safe_log1p(x: Column, least: float = -0.999999) -> Column:
    return F.log1p(F.greatest(x, F.lit(least)))


def safe_softplus(x: Column) -> Column:
    """log(1 + exp(x)) without overflow."""
    return F.greatest(x, F.lit(0.0)) + F.log1p(F.exp(-F.abs(x)))


def safe_sigmoid(x: Column) -> Column:
    e = F.exp(-F.abs(x))
    return F.when(x >= 0, 1 / (1 + e)).otherwise(e / (1 + e))


def safe_divide(a: Column, b: Column, least: float = LEAST) -> Column:
    """a / b; b keeps its sign and is at least `least` in size (0 counts as positive)."""
    return a / F.when(F.abs(b) >= least, b).when(b < 0, F.lit(-least)).otherwise(F.lit(least))


def safe_sqrt(x: Column) -> Column:
    return F.sqrt(F.greatest(x, F.lit(0.0)))


def positive_transform(x: Column) -> Column:
    return safe_softplus(x)


def bounded_transform(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.lit(low) + (high - low) * safe_sigmoid(x)


def ordered_transform(raw: Column) -> Column:
    """An array of doubles to an increasing one: the first value, then steps of positive size."""
    start = F.array().cast("array<double>")
    return F.aggregate(raw, start, lambda a, x: F.concat(a, F.array(F.when(F.size(a) == 0, x).otherwise(F.get(a, F.size(a) - 1) + safe_softplus(x)))))
