"""Limit what one contributor may hold, keeping its best records.

Quality histograms per contributor are built with a partial aggregate and
merged; they have at most ``BINS + 1`` rows per contributor, whatever the
number of records, and their edges are quantiles of all scores.  From the top
bin down they tell which bin a cap falls into.  Records above that cutoff bin
are kept and records below it left out without any ranking; only those of the
cutoff bin itself are ranked, after every task has already reduced its share to
``cap`` records per contributor.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from pictorium.runtime import written

BINS = 64


def _edges(rows: DataFrame) -> list[float]:
    """Scores that cut all usable ones into about BINS equal parts; an outlier moves none of them."""
    finite = F.when(~F.isnan("_score") & (F.abs("_score") != F.lit(float("inf"))), F.col("_score"))
    marks = rows.agg(F.percentile_approx(finite, [k / BINS for k in range(1, BINS)], 10_000)).first()[0]
    return sorted(set(marks or []))


def _bin(score: Column, edges: list[float]) -> Column:
    """0 for no score, else 1 and the number of edges that the score reaches, found by halving."""

    def among(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low + 1)
        middle = (low + high) // 2
        return F.when(score < F.lit(edges[middle]), among(low, middle)).otherwise(among(middle + 1, high))

    return F.when(score.isNull() | F.isnan(score), F.lit(0)).otherwise(among(0, len(edges))).cast("int")


def quality_histogram(df: DataFrame, by: list[str]) -> DataFrame:
    """(by..., bin, n): mergeable by adding ``n`` of equal (by..., bin)."""
    return df.groupBy(*by, "bin").agg(F.count("*").alias("n"))


def cutoffs(histogram: DataFrame, by: list[str], cap: Column) -> DataFrame:
    """(by..., cut, need): the bin that the cap falls into and how many of it fit."""
    down = Window.partitionBy(*by).orderBy(F.col("bin").desc())
    above = F.sum("n").over(down.rowsBetween(Window.unboundedPreceding, -1))
    walked = histogram.withColumn("above", F.coalesce(above, F.lit(0)))
    walked = walked.withColumn("cap", cap.cast("bigint"))
    last = (F.col("above") < F.col("cap")) & (F.col("above") + F.col("n") >= F.col("cap"))
    none = (F.col("cap") <= 0) & (F.col("above") == 0)
    return walked.where(last | none).select(
        *by, F.col("bin").alias("cut"), F.greatest(F.col("cap") - F.col("above"), F.lit(0)).alias("need")
    )


def left_out(df: DataFrame, by: list[str], *, score: str, record: str, cap: int | None = None, max_share: float | None = None) -> DataFrame:
    """The ``record`` keys beyond each contributor's cap.

    ``cap`` is a count per contributor; ``max_share`` limits a contributor to
    that share of all records instead (rounded down).  ``record`` is unique.

    Defined results: records whose contributor is NULL in any column of ``by``
    have no contributor and are never left out; no score (NULL or NaN) ranks
    last; equal scores go to the smaller record; a cap of 0 leaves out all.
    """
    rows = df.select(*[F.col(c).alias(f"_by{k}") for k, c in enumerate(by)], F.col(score).cast("double").alias("_score"), F.col(record).alias("_record"))
    keys = [f"_by{k}" for k in range(len(by))]
    for key in keys:
        rows = rows.where(F.col(key).isNotNull())
    rows = written(rows, "capped-rows")  # counted, binned and cut: what they are made of is worked out once
    limit = cap if cap is not None else int((max_share or 0) * rows.count())
    rows = rows.withColumn("bin", _bin(F.col("_score"), _edges(rows)))
    cuts = cutoffs(quality_histogram(rows, keys), keys, F.lit(limit))
    # Records above the cutoff bin stay and need no further look.
    placed = written(rows.join(cuts, keys).where(F.col("bin") <= F.col("cut")).select(*keys, "_score", "_record", "need", (F.col("bin") < F.col("cut")).alias("_below")), "below-and-border")
    below, border = placed.where("_below").select("_record"), placed.where("not _below")
    best = Window.partitionBy(*keys).orderBy(F.col("_score").desc_nulls_last(), F.col("_record"))
    # The literal bound lets every task drop its own surplus before the shuffle.
    kept = border.withColumn("_score", F.when(~F.isnan("_score"), F.col("_score"))).withColumn("_rank", F.row_number().over(best)).where(F.col("_rank") <= limit).where(F.col("_rank") <= F.col("need"))
    beyond = border.select("_record").join(kept.select("_record"), "_record", "left_anti")
    return below.unionByName(beyond).withColumnRenamed("_record", record)


def capped(df: DataFrame, by: list[str], *, record: str, **options) -> DataFrame:
    """``df`` without the records that :func:`left_out` names."""
    out = written(left_out(df, by, record=record, **options).select(record), "left-out")
    return df.join(out, record, "left_anti")
