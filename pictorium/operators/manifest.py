"""Candidates joined with their works into one manifest, and its measures."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from pictorium.operators.latest import latest_per_key
from pictorium.operators.ranks import discrete, joined, values_at
from pictorium.runtime import blank_to_null

MANIFEST_VERSION = 1


def latest_candidates(candidates: DataFrame) -> DataFrame:
    """The last delivery of every version of a candidate."""
    keyed = candidates.withColumn("candidate", blank_to_null(F.col("candidate_id"))).withColumn("version", F.coalesce(blank_to_null(F.col("post_cid")), F.lit("")))
    return latest_per_key(keyed.where("candidate is not null"), ["candidate", "version"], [F.col("received_at").desc_nulls_last(), F.col("delivery_id").desc()])


def manifest(candidates: DataFrame, artworks: DataFrame, artists: DataFrame) -> DataFrame:
    """One row per candidate version with the work made of it and its artist, where there are such."""
    latest = latest_candidates(candidates).select("candidate", "version", "author_did", "received_at", "created_at", "declared_width", "declared_height", "source")
    works = artworks.select(blank_to_null(F.col("source_id")).alias("candidate"), "artwork_id", blank_to_null(F.col("artist_id")).alias("artist"), "is_sfw", "validated", "date_added")
    works = latest_per_key(works.where("candidate is not null"), ["candidate"], [F.col("date_added").desc_nulls_last(), F.col("artwork_id")])
    known = artists.select(blank_to_null(F.col("artist_id")).alias("artist"), "display_name").groupBy("artist").agg(F.min("display_name").alias("display_name"))
    # Both right sides hold a key once, so the joins need no check of that.
    rows = latest.join(works, ["candidate"], "left").join(known, ["artist"], "left")
    linked = F.col("artwork_id").isNotNull()
    return rows.withColumns(
        {"manifest_version": F.lit(MANIFEST_VERSION), "is_linked": linked, "is_search_eligible": linked & F.coalesce(F.col("validated"), F.lit(False))}
    )


def manifest_summary(rows: DataFrame) -> DataFrame:
    return rows.agg(
        F.count("*").alias("row_count"), F.count_if("is_linked").alias("linked"), F.count_if(~F.col("is_linked")).alias("unlinked"), F.count_if("is_search_eligible").alias("eligible")
    )


def intake_metrics(rows: DataFrame) -> DataFrame:
    """Cohorts by day and source, ordered."""
    rows = rows.withColumn("day", F.to_date("received_at").cast("string"))
    grouped = rows.groupBy("day", "source").agg(
        F.count("*").alias("image_count"),
        F.countDistinct("author_did").alias("author_count"),
        F.count_if("is_linked").alias("linked_count"),
        F.round(F.avg(F.col("declared_width").cast("double")), 6).alias("mean_width"),
    )
    p95 = values_at(rows, ["day", "source"], "declared_width", 0.95, {"p95_width": discrete(0.95)})
    p95 = p95.withColumn("p95_width", F.col("p95_width").cast("double"))
    return joined(grouped, p95, ["day", "source"], ["p95_width"]).orderBy("day", "source")
