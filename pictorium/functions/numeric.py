"""Numeric column expressions: guarded ratios, intervals, clamps, percentiles."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: 97.5 % point of the normal distribution.
Z95 = 1.959963984540054


def ratio(numerator: Column, denominator: Column) -> Column:
    """NULL where the denominator is zero or missing."""
    return F.try_divide(numerator.cast("double"), denominator.cast("double"))


def f1(precision: Column, recall: Column) -> Column:
    """NULL if either is NULL, 0 if both are 0."""
    both = precision + recall
    return F.when(both == 0, F.lit(0.0)).otherwise(2 * precision * recall / both)


def wilson(successes: Column, trials: Column) -> tuple[Column, Column]:
    """Lower and upper end of the 95 % Wilson interval within [0, 1]; NULLs without trials."""
    n, z2 = trials.cast("double"), Z95 * Z95
    p = ratio(successes, trials)
    centre = p + z2 / (2 * n)
    spread = Z95 * F.sqrt(p * (1 - p) / n + z2 / (4 * n * n))
    known = trials > 0
    low = F.when(known, F.greatest(F.lit(0.0), (centre - spread) / (1 + z2 / n)))
    high = F.when(known, F.least(F.lit(1.0), (centre + spread) / (1 + z2 / n)))
    return low, high


def clamp(value: Column, low: float, high: float, missing: float = 0.0) -> Column:
    """Within [low, high]; NaN and infinities give ``missing``, NULL stays NULL."""
    finite = ~F.isnan(value) & (F.abs(value) < F.lit(float("inf")))
    return F.when(value.isNull(), None).when(finite, F.least(F.greatest(value, F.lit(low)), F.lit(high))).otherwise(F.lit(missing))


def softmax(values: Column) -> Column:
    """Stable softmax of an array of doubles."""
    top = F.array_max(values)
    powers = F.transform(values, lambda v: F.exp(v - top))
    total = F.aggregate(powers, F.lit(0.0), lambda a, v: a + v)
    return F.transform(powers, lambda v: v / total)


def logsumexp(values: Column) -> Column:
    top = F.array_max(values)
    return top + F.log(F.aggregate(values, F.lit(0.0), lambda a, v: a + F.exp(v - top)))


def sigmoid(value: Column) -> Column:
    small = F.exp(-F.abs(value))
    return F.when(value >= 0, 1 / (1 + small)).otherwise(small / (1 + small))


def boundary_distance(score: Column, *bounds: float) -> Column:
    """Distance to the nearest decision boundary."""
    gaps = [F.abs(score - F.lit(b)) for b in bounds]
    return F.least(*gaps) if len(gaps) > 1 else gaps[0]


def retry_delay(attempt: Column, base: float, cap: float, retry_after: Column | None = None) -> Column:
    """The server's wish or exponential growth, between 0 and ``cap`` seconds."""
    grown = F.lit(base) * F.pow(F.lit(2.0), attempt)
    asked = F.coalesce(retry_after, grown) if retry_after is not None else grown
    return F.least(F.greatest(asked, F.lit(0.0)), F.lit(cap))
