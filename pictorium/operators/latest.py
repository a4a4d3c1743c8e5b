"""Append-only logs reduced to their current state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def latest_per_key(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in ``order``, which should end with a unique column.

    The rank filter is a literal, so every task drops its surplus rows before the
    shuffle and a hot key sends one row per task.
    """
    ranked = df.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.where("_rank = 1").drop("_rank")


def source_versions(df: DataFrame, key: str, version: str, at: str, ordinal: str) -> DataFrame:
    """The latest row of every version of every key; a NULL version is one version."""
    filled = df.withColumn(version, F.coalesce(F.col(version), F.lit("")))
    return latest_per_key(filled, [key, version], [F.col(at).desc_nulls_last(), F.col(ordinal).desc_nulls_last()])


def current_rows(df: DataFrame, key: str, version: str, at: str, ordinal: str) -> DataFrame:
    """The latest version of every key."""
    return latest_per_key(df, [key], [F.col(at).desc_nulls_last(), F.col(version).desc_nulls_last(), F.col(ordinal).desc_nulls_last()])


def capped_per_group(df: DataFrame, group: str, order: list[Column], most: int, limit: int | None = None, lists: list[str] | None = None) -> DataFrame:
    """Greedy diversity: in ``order`` at most ``most`` rows per group, ranked anew, cut at ``limit``.

    ``lists`` names the columns of independent lists; NULL groups are one group.
    """
    lists = lists or []
    few = df.withColumn("_in_group", F.row_number().over(Window.partitionBy(*lists, group).orderBy(*order))).where(F.col("_in_group") <= most)
    again = few.withColumn("final_rank", F.row_number().over(Window.partitionBy(*lists).orderBy(*order)))
    return (again.where(F.col("final_rank") <= limit) if limit else again).drop("_in_group")
