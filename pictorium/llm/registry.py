"""Registered queries of this subpackage and the SQL they are checked with."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from pictorium.llm.capping import left_out
from pictorium.llm.history import history_matches
from pictorium.llm.leaks import leaks
from pictorium.llm.mixing import mixture, mixture_shares, source_name
from pictorium.llm.neighbours import nearest, nearest_pairs, usable_vectors
from pictorium.llm.readability import reading_levels
from pictorium.llm.safety import fitted, flagged, rates, scored
from pictorium.runtime import blank_to_null, read_table, written


def _results_by_artist(spark: SparkSession, sf_dir: str) -> DataFrame:
    results = read_table(spark, sf_dir, "search_results").select("result_id", "search_id", "artwork_id", "score")
    artworks = read_table(spark, sf_dir, "artworks")
    artist = artworks.select(blank_to_null(F.col("artwork_id")).alias("_artwork"), blank_to_null(F.col("artist_id")).alias("artist"))
    artist = artist.groupBy("_artwork").agg(F.min("artist").alias("artist"))
    return results.join(artist, blank_to_null(F.col("artwork_id")) == F.col("_artwork")).select("result_id", "search_id", "artist", "score")


def _safety_scores(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Scores of documents (doc_id, source) and of candidates (candidate, source)."""
    documents, candidates = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "candidates")
    unrated = [(documents, "text"), (candidates, "post_text"), (candidates, "alt_text")]
    model = fitted(read_table(spark, sf_dir, "safety_samples"), read_table(spark, sf_dir, "reading_samples"), unrated)
    documents = scored(documents, model, ["text"], ["doc_id", "source"])
    candidates = candidates.withColumn("candidate", blank_to_null(F.col("candidate_id")))
    return documents, scored(candidates.where("candidate is not null"), model, ["post_text", "alt_text"], ["candidate", "source"])


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, candidates = _safety_scores(spark, sf_dir)
    bad = written(candidates.where(flagged()).select("candidate").distinct(), "flagged-candidates")
    works = read_table(spark, sf_dir, "artworks").where("is_sfw")
    works = works.join(bad, blank_to_null(F.col("source_id")) == F.col("candidate"), "left_semi")
    parts = [
        documents.where(flagged() & F.col("doc_id").isNotNull()).select(F.lit("documents").alias("table_name"), F.col("doc_id").cast("string").alias("record_key")),
        bad.select(F.lit("candidates").alias("table_name"), F.col("candidate").alias("record_key")),
        works.select(F.lit("artworks").alias("table_name"), F.col("artwork_id").alias("record_key")),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).distinct()


def p1_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, candidates = _safety_scores(spark, sf_dir)
    worst = [F.max(c).alias(c) for c in ("abuse", "hate", "sexual", "unsafe")]
    per = candidates.groupBy("candidate").agg(*worst).select(F.lit("candidates").alias("table_name"), F.col("candidate").alias("record_key"), "abuse", "hate", "sexual", "unsafe")
    return documents.select(F.lit("documents").alias("table_name"), F.col("doc_id").cast("string").alias("record_key"), "abuse", "hate", "sexual", "unsafe").unionByName(per)


def p1_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, candidates = _safety_scores(spark, sf_dir)
    both = documents.select(F.lit("documents").alias("table_name"), source_name(F.col("source")).alias("source"), "unsafe").unionByName(
        candidates.select(F.lit("candidates").alias("table_name"), source_name(F.col("source")).alias("source"), "unsafe")
    )
    return rates(both, ["table_name", "source"])


def p2_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read_table(spark, sf_dir, "artwork_embeddings")
    clip = usable_vectors(vectors, "artwork_id", "clip_vector", ["model_name_clip", "model_version_clip"], "date_computed")
    dino = usable_vectors(vectors, "artwork_id", "dino_pooled", ["model_name_dino", "model_version_dino"], "date_computed")
    return nearest(clip.unionByName(dino), k=5)


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = nearest_pairs(p2_neighbours(spark, sf_dir))
    return pairs.withColumnsRenamed({"record_a": "artwork_id_a", "record_b": "artwork_id_b"})


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return left_out(_results_by_artist(spark, sf_dir), ["search_id", "artist"], score="score", record="result_id", cap=3)


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs, _ = history_matches(read_table(spark, sf_dir, "artworks"))
    return pairs.select(F.col("record_a").alias("artwork_id_a"), F.col("record_b").alias("artwork_id_b"))


def p5_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accepted artworks per batch."""
    _, accepted = history_matches(read_table(spark, sf_dir, "artworks"))
    return accepted.groupBy(F.col("batch").alias("ingest_batch")).agg(F.count("*").alias("accepted"))


def p7_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "eval_items"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p7_leaks(spark, sf_dir).select("doc_id", "item_id").distinct()


def p8_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "mix_targets"))


def p8_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture_shares(p8_mixture(spark, sf_dir), read_table(spark, sf_dir, "mix_targets"))


def p9_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = read_table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return reading_levels(documents, read_table(spark, sf_dir, "reading_samples"))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p9_levels(spark, sf_dir).where("language = 'en' and expert_share > 0.5").select("doc_id")


def p9_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents, mean grade and shares of the bands per source."""
    levels = p9_levels(spark, sf_dir).withColumn("source", source_name(F.col("source")))
    band = [F.round(F.avg((F.col("band") == b).cast("double")), 6).alias(f"{b}_share") for b in ("beginner", "general", "expert")]
    return levels.where("band is not null").groupBy("source").agg(F.count("*").alias("documents"), F.round(F.avg("grade"), 4).alias("mean_grade"), *band)


QUERIES = {"p1_found": p1_found, "p1_scores": p1_scores, "p1_rates": p1_rates, "p2_found": p2_found, "p2_neighbours": p2_neighbours, "p3_found": p3_found, "p5_found": p5_found, "p5_batches": p5_batches, "p7_found": p7_found, "p7_leaks": p7_leaks, "p8_mixture": p8_mixture, "p8_shares": p8_shares, "p9_found": p9_found, "p9_levels": p9_levels, "p9_profile": p9_profile}

ORACLES = {
    "p3_found": """
WITH a AS (SELECT lower(trim(artwork_id)) AS art, min(lower(trim(artist_id))) AS artist FROM artworks GROUP BY 1),
r AS (
  SELECT s.result_id, row_number() OVER (PARTITION BY s.search_id, a.artist ORDER BY CASE WHEN isnan(s.score) THEN NULL ELSE s.score END DESC NULLS LAST, s.result_id) AS n
  FROM search_results s JOIN a ON lower(trim(s.artwork_id)) = a.art WHERE a.artist <> '' AND s.search_id IS NOT NULL
)
SELECT result_id FROM r WHERE n > 3
""",
}
