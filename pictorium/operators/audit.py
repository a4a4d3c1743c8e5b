"""Reports over the current state of the corpus."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from pictorium.operators.ranks import discrete, joined, values_at
from pictorium.operators.relational import unpivot_counts


def decision_summary(df: DataFrame, decision: str, artist: str, value: str, eligible: Column, exact: bool = True) -> DataFrame:
    """Rows, artists, eligible rows, mean and 95th percentile per decision."""
    artists = F.countDistinct(artist) if exact else F.approx_count_distinct(artist)
    grouped = df.groupBy(F.col(decision).alias("decision")).agg(
        F.count("*").alias("image_count"),
        artists.alias("artist_count"),
        F.count_if(eligible).alias("search_eligible_count"),
        F.round(F.avg(value), 9).alias("mean_value"),
        *([] if exact else [F.percentile_approx(value, 0.95, 10_000).cast("double").alias("p95_value")]),
    )
    if not exact:
        return grouped
    p95 = values_at(df.withColumn("decision", F.col(decision)), ["decision"], value, 0.95, {"p95_value": discrete(0.95)})
    return joined(grouped, p95.withColumn("p95_value", F.col("p95_value").cast("double")), ["decision"], ["p95_value"])


def artist_summary(df: DataFrame, artist: str, counters: dict[str, Column], label: str | None = None) -> DataFrame:
    """Counters per artist; the label is the smallest, so it doesn't depend on order."""
    extra = [F.min(label).alias(label)] if label else []
    return df.where(F.col(artist).isNotNull()).groupBy(artist).agg(*extra, F.count("*").alias("image_count"), *[F.count_if(c).alias(n) for n, c in counters.items()])


def duplicate_hashes(df: DataFrame, digest: str, record: str, owner: str) -> DataFrame:
    """Contents that occur more than once, with bounded evidence: counts and the two smallest records."""
    return (
        df.where(F.col(digest).isNotNull())
        .groupBy(digest)
        .agg(F.count("*").alias("occurrences"), F.countDistinct(owner).alias("owners"), F.min(record).alias("first_record"), F.max(record).alias("last_record"))
        .where("occurrences > 1")
    )


def quality_counts(df: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """One pass over the rows; a row per check with its violations."""
    wide = df.agg(F.count("*").alias("row_count"), *[F.count_if(F.coalesce(c, F.lit(True))).alias(n) for n, c in checks.items()])
    return unpivot_counts(wide)


def constraint_violations(tables: dict[str, tuple[DataFrame, dict[str, Column]]]) -> DataFrame:
    """(table_name, metric, value) for domain constraints of several tables."""
    out: DataFrame | None = None
    for name, (df, checks) in tables.items():
        part = quality_counts(df, checks).select(F.lit(name).alias("table_name"), "metric", "value")
        out = part if out is None else out.unionByName(part)
    return out
