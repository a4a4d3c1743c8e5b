"""Queries of the two general data-quality problems."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from pictorium.operators.delivery import first_deliveries, repeated_deliveries
from pictorium.operators.orphans import Reference, orphan_references, orphan_report
from pictorium.runtime import read_table


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_deliveries(read_table(spark, sf_dir, "candidates"))


def p4_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    return first_deliveries(read_table(spark, sf_dir, "candidates")).select(F.col("delivery").alias("delivery_id"))


def _orphans(spark: SparkSession, sf_dir: str, counted: bool = False) -> DataFrame:
    artists, artworks, vectors = (read_table(spark, sf_dir, t) for t in ("artists", "artworks", "artwork_embeddings"))
    return orphan_references(
        {"artists": (artists, "artist_id"), "artworks": (artworks, "artwork_id")},
        [
            Reference("artworks.artist_id", artworks, "artwork_id", "artist_id", "artists", "date_added"),
            Reference("artworks.duplicate_of", artworks, "artwork_id", "duplicate_of", "artworks", "date_added"),
            Reference("artwork_embeddings.artwork_id", vectors, "artwork_id", "artwork_id", "artworks", "date_computed"),
        ],
        counted,
    )


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _orphans(spark, sf_dir).select("ref_field", "child_key").distinct()


def p6_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orphan_report(_orphans(spark, sf_dir, counted=True))


QUERIES = {"p4_found": p4_found, "p4_kept": p4_kept, "p6_found": p6_found, "p6_report": p6_report}

_VERSIONS = """
WITH v AS (
  SELECT delivery_id, received_at, lower(trim(candidate_id)) AS cand, lower(trim(coalesce(post_cid, ''))) AS ver
  FROM candidates WHERE trim(coalesce(candidate_id, '')) <> ''
), r AS (
  SELECT delivery_id, row_number() OVER (PARTITION BY cand, ver ORDER BY received_at NULLS LAST, delivery_id) AS n FROM v
)
"""

_ORPHANS = """
WITH r AS (
  SELECT 'artworks.artist_id' AS ref_field, artwork_id AS child_key, lower(trim(artist_id)) AS key, date_added AS seen_at, 'artists' AS parent FROM artworks
  UNION ALL SELECT 'artworks.duplicate_of', artwork_id, lower(trim(duplicate_of)), date_added, 'artworks' FROM artworks
  UNION ALL SELECT 'artwork_embeddings.artwork_id', artwork_id, lower(trim(artwork_id)), date_computed, 'artworks' FROM artwork_embeddings
), k AS (
  SELECT DISTINCT 'artists' AS parent, lower(trim(artist_id)) AS key FROM artists
  UNION SELECT DISTINCT 'artworks', lower(trim(artwork_id)) FROM artworks
), o AS (
  SELECT r.* FROM r LEFT JOIN k ON r.parent = k.parent AND r.key = k.key WHERE r.key <> '' AND k.key IS NULL
)
"""

ORACLES = {
    "p4_found": _VERSIONS + "SELECT delivery_id FROM r WHERE n > 1",
    "p4_kept": _VERSIONS + "SELECT delivery_id FROM r WHERE n = 1",
    "p6_found": _ORPHANS + "SELECT DISTINCT ref_field, child_key FROM o",
    "p6_report": _ORPHANS
    + "SELECT ref_field, strftime(seen_at, '%Y-%m') AS month, count(*)::BIGINT AS orphan_rows, count(DISTINCT key)::BIGINT AS missing_keys FROM o GROUP BY 1, 2",
}
