"""Scalar arithmetic used across the operators."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

CLIP = 1e-15


def ratio_squared(a: Column, b: Column, default: float | None = None) -> Column:
    """``(a / b) ** 2``; a zero divisor or NULL gives ``default``."""
    out = F.pow(F.try_divide(a, b), F.lit(2.0))
    return out if default is None else F.coalesce(out, F.lit(default))


def sigmoid(z: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))


def clip(p: Column, low: float = CLIP, high: float = 1 - CLIP) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), p))


def clip_log(p: Column) -> Column:
    """Natural log of a probability kept away from 0 and 1."""
    return F.log(clip(p))


def safe_ratio(num: Column, den: Column) -> Column:
    """Quotient as double, NULL for a zero divisor."""
    return F.try_divide(num.cast("double"), den.cast("double"))


def threshold(p: Column, t: float, inclusive: bool = False) -> Column:
    """1 above the threshold, else 0; NULL stays NULL."""
    hit = p >= F.lit(t) if inclusive else p > F.lit(t)
    return hit.cast("int")


def powers(x1: Column, x2: Column, top: int = 6) -> dict[str, Column]:
    """Products ``x1**(i-j) * x2**j`` for i = 1..top and j < i, named ``f{i}{j}``."""
    pairs = [(i, j) for i in range(1, top + 1) for j in range(i)]
    return {f"f{i}{j}": F.pow(x1, F.lit(float(i - j))) * F.pow(x2, F.lit(float(j))) for i, j in pairs}


def linear(cols: list[Column], weights: list[float]) -> Column:
    """Weighted sum of columns."""
    return reduce(lambda a, b: a + b, [F.lit(float(w)) * c for c, w in zip(cols, weights, strict=True)])
