"""Micro-batch intake: files as they arrive, each message once, resumable."""

from __future__ import annotations

import hashlib
import logging
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from pictorium.operators.delivery import IdentifierIndex, exactly_once_sink
from pictorium.operators.relational import ContractError
from pictorium.sources.readers import config_hash, read_or_empty
from pictorium.sources.writers import append_new


def file_stream(spark: SparkSession, path: str, schema: str, fmt: str = "json", files_per_batch: int = 32) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).format(fmt).load(path)


def process_available(stream: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Run the batches that are there and stop; the checkpoint makes a rerun skip what is done."""
    query = stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def versioned(stream: DataFrame, keys: tuple[str, str] = ("candidate_id", "post_cid"), at: str | None = None, late: str = "7 days") -> DataFrame:
    """The first message of every version; with a time column the state is bounded by a watermark."""
    filled = stream.withColumn(keys[1], F.coalesce(F.col(keys[1]), F.lit("")))
    if at:
        return filled.withWatermark(at, late).dropDuplicatesWithinWatermark(list(keys))
    return filled.dropDuplicates(list(keys))


def once_only(spark: SparkSession, stream: DataFrame, out: str, checkpoint: str, index: IdentifierIndex | None = None) -> StreamingQuery:
    """Deliveries appended to ``out`` at most once per version, across batches and restarts, by the identifier index.

    Without an ``index`` one is kept beside the checkpoint.
    """
    index = index or IdentifierIndex(spark, place=f"{checkpoint.rstrip('/')}-identifiers")
    name = hashlib.sha256(checkpoint.encode()).hexdigest()[:12]  # batches are numbered per checkpoint
    sink = exactly_once_sink(index, out, id_col="candidate_id", version_col="post_cid", arrived="received_at", delivery="delivery_id", stream=name)
    return process_available(stream, sink, checkpoint)


def completed_filter(work: DataFrame, done: DataFrame, keys: list[str], lineage: dict[str, str]) -> DataFrame:
    """Work not yet completed under the same lineage; errors count as not completed."""
    same = done.where("error is null")
    for column, value in lineage.items():
        same = same.where(F.col(column) == value)
    fill = lambda df: df.withColumns({f"_{k}": F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys})
    marks = [f"_{k}" for k in keys]
    return fill(work).join(fill(same).select(*marks), marks, "left_anti").drop(*marks)


def error_budget(outcomes: DataFrame, ok: str, most: float, strict: bool = False) -> float:
    """The share of failures; more than ``most`` of them, or any when strict, is an error."""
    row = outcomes.agg(F.count("*").alias("n"), F.count_if(~F.coalesce(F.col(ok), F.lit(False))).alias("bad")).first()
    share = row["bad"] / row["n"] if row["n"] else 0.0
    if share > most or strict and row["bad"]:
        raise ContractError(f"{row['bad']} of {row['n']} failed")
    return share


def windowed_counts(events: DataFrame, at: str, kind: str, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts per window and kind, for streams and tables alike."""
    return events.withWatermark(at, late).groupBy(F.window(at, width), kind).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), kind, "n")


class CheckpointStore:
    """Keys that are done, per settings: work under other settings starts anew."""

    SCHEMA = "settings string, key string"

    def __init__(self, spark: SparkSession, path: str, settings: dict):
        self.spark, self.path, self.settings = spark, path, config_hash(settings)

    def done(self) -> DataFrame:
        return read_or_empty(self.spark, self.path, self.SCHEMA).where(F.col("settings") == self.settings).select("key").distinct()

    def pending(self, work: DataFrame, key: str) -> DataFrame:
        return work.join(self.done(), F.col(key).cast("string") == F.col("key"), "left_anti")

    def mark(self, keys: DataFrame, key: str) -> int:
        rows = keys.select(F.lit(self.settings).alias("settings"), F.col(key).cast("string").alias("key")).where("key is not null")
        return append_new(rows, self.path, ["settings", "key"])


def durable(results: DataFrame, persist: Callable[[DataFrame], object], error: str = "error", strict: bool = True) -> DataFrame:
    """``results`` after ``persist`` has kept them.

    If that fails, strict results all carry the failure as their error; otherwise
    it is logged and the results stand.
    """
    try:
        persist(results)
    except Exception as failure:
        logging.getLogger(__name__).error("results couldn't be kept: %s", failure)
        if strict:
            return results.withColumn(error, F.lit(f"{type(failure).__name__}: {failure}"))
    return results
