"""Reproducible samples and sessions by hashed order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def hashed_order(seed: int, *keys: Column) -> Column:
    return F.sha2(F.concat_ws("|", F.lit(str(seed)), *[k.cast("string") for k in keys]), 256)


def sample(df: DataFrame, key: str, n: int, seed: int = 0) -> DataFrame:
    """``n`` rows in hashed order: the same for the same seed, whatever the partitions."""
    return df.orderBy(hashed_order(seed, F.col(key)), key).limit(n)


def sample_per_group(df: DataFrame, group: str, key: str, n: int, seed: int = 0) -> DataFrame:
    """``n`` rows per group with their ``position`` 1..n."""
    order = Window.partitionBy(group).orderBy(hashed_order(seed, F.col(group), F.col(key)), F.col(key))
    return df.withColumn("position", F.row_number().over(order)).where(F.col("position") <= n)


def sessions(df: DataFrame, group: str, key: str, count: int, seed: int = 0) -> DataFrame:
    """``count`` sessions without repeats: the i-th sampled row of every group is in session i."""
    return sample_per_group(df, group, key, count, seed).withColumn("session", F.col("position") - 1).drop("position")
