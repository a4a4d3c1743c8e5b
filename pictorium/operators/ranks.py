"""Exact order statistics of large groups.

An approximate percentile brackets the wanted place; one further pass counts
what lies below the bracket and the values within it.  So no task holds the
values of a group, and only a thousandth of them on either side is ordered.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

#: Half the width of a bracket, and up to how many values a group is ordered whole.
MARGIN, WHOLE = 1e-3, 10_000


def values_at(df: DataFrame, by: list[str], value: str, q: float, places: dict[str, Column]) -> DataFrame:
    """(by..., name...): for each name the group's value at a 1-based place, given by ``q`` and ``_n``, the number of values.

    Places must lie within one of ``q * _n``.  NULL values don't count; NULL keys
    are a group of their own; groups without values have no row.
    """
    keys = [f"_k{k}" for k in range(len(by))]
    rows = df.select(*[F.col(c).alias(k) for c, k in zip(by, keys)], F.col(value).alias("_v")).where("_v is not null")
    marks = rows.groupBy(*keys).agg(F.percentile_approx("_v", [max(0.0, q - MARGIN), min(1.0, q + MARGIN)], 10_000).alias("_m"), F.min("_v").alias("_min"), F.max("_v").alias("_max"), F.count("*").alias("_n"))
    whole = F.col("_n") <= WHOLE
    bounds = marks.select(*[F.col(k).alias(f"{k}b") for k in keys], "_n", F.when(whole, F.col("_min")).otherwise(F.col("_m")[0]).alias("_low"), F.when(whole, F.col("_max")).otherwise(F.col("_m")[1]).alias("_high"))
    match = reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"{k}b")) for k in keys], F.lit(True))
    inside = rows.join(bounds, match).where(F.col("_v") <= F.col("_high"))
    counted = inside.groupBy(*keys, "_n", F.when(F.col("_v") >= F.col("_low"), F.col("_v")).alias("_v")).agg(F.count("*").alias("_c"))
    upto = F.sum("_c").over(Window.partitionBy(*keys).orderBy(F.col("_v").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0))
    walked = counted.withColumn("_upto", upto).where("_v is not null")
    found = walked.groupBy(*keys).agg(*[F.min(F.when(F.col("_upto") >= place, F.col("_v"))).alias(name) for name, place in places.items()])
    return found.select(*[F.col(k).alias(c) for c, k in zip(by, keys)], *places)


def discrete(q: float) -> Column:
    """The place of the smallest value that at least a share ``q`` doesn't exceed."""
    return F.greatest(F.lit(1), F.ceil(F.lit(q) * F.col("_n")))


def nearest(q: float) -> Column:
    return F.round(F.lit(q) * (F.col("_n") - 1)) + 1


def between(q: float) -> tuple[Column, Column]:
    """The places that a linear interpolation lies between."""
    at = F.lit(q) * (F.col("_n") - 1)
    return F.floor(at) + 1, F.ceil(at) + 1


def joined(left: DataFrame, right: DataFrame, by: list[str], names: list[str]) -> DataFrame:
    """``left`` with the named columns of ``right``, NULL keys being equal."""
    renamed = right.select(*[F.col(c).alias(f"_r{k}") for k, c in enumerate(by)], *names)
    match = reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(f"_r{k}")) for k, c in enumerate(by)], F.lit(True))
    return left.join(renamed, match, "left").drop(*[f"_r{k}" for k in range(len(by))])
