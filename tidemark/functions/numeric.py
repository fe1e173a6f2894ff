"""Numeric column expressions; all of them stay inside generated JVM code."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Hart's rational approximation of the normal tail as published by
# G. West, "Better approximations to cumulative normal functions" (2005).
NORM_NUMERATOR = (
    3.52624965998911e-02, 0.700383064443688, 6.37396220353165, 33.912866078383,
    112.079291497871, 221.213596169931, 220.206867912376,
)
NORM_DENOMINATOR = (
    8.83883476483184e-02, 1.75566716318264, 16.064177579207, 86.7807322029461,
    296.564248779674, 637.333633378831, 793.826512519948, 440.413735824752,
)
NORM_SPLIT = 7.07106781186547
NORM_ZERO = 37.0
SQRT_TWO_PI = 2.506628274631


def _polynomial(coefficients: tuple[float, ...], x: Column) -> Column:
    return reduce(lambda acc, c: acc * x + F.lit(c), coefficients[1:], F.lit(coefficients[0]))


def norm_cdf(z: Column) -> Column:
    """Standard normal distribution function; NULL stays NULL."""
    x = F.abs(z)
    density = F.exp(-x * x / 2)
    near = density * _polynomial(NORM_NUMERATOR, x) / _polynomial(NORM_DENOMINATOR, x)
    fraction = reduce(lambda acc, k: x + F.lit(float(k)) / acc, (4, 3, 2, 1), x + F.lit(0.65))
    far = density / fraction / F.lit(SQRT_TWO_PI)
    tail = F.when(x > NORM_ZERO, F.lit(0.0)).when(x < NORM_SPLIT, near).otherwise(far)
    return F.when(z.isNull(), F.lit(None).cast("double")).when(z > 0, 1 - tail).otherwise(tail)


def clip(c: Column, low: float, high: float) -> Column:
    """Limit to a range; unlike bare greatest/least a NULL input stays NULL."""
    return F.when(c.isNotNull(), F.least(F.greatest(c, F.lit(low)), F.lit(high)))


def ratio_or(x: Column, y: Column, default: float = 0.0) -> Column:
    return F.coalesce(F.try_divide(x, y), F.lit(default))


def imbalance(bid: Column, ask: Column) -> Column:
    """(bid - ask) / (bid + ask), 0 for an empty book."""
    return ratio_or(bid - ask, bid + ask)


def spaced(low: Column, high: Column, index: Column, n: Column) -> Column:
    """Point ``index`` (from 0) of ``n`` evenly spaced points; a single point is ``low``."""
    return low + F.coalesce(F.try_divide(index * (high - low), n - 1), F.lit(0.0))


def softmax(logits: Column) -> Column:
    """Softmax of an array column, shifted by its maximum for stability."""
    shifted = F.transform(logits, lambda v: F.exp(v - F.array_max(logits)))
    total = F.aggregate(shifted, F.lit(0.0), lambda acc, v: acc + v)
    return F.transform(shifted, lambda v: v / total)


def null_if_nan(c: Column) -> Column:
    return F.nanvl(c, F.lit(None).cast("double"))
