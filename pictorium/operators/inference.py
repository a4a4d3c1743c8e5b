"""Model inference behind an interface: batches, cache, failures kept as rows."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from pictorium.functions.numeric import logsumexp, sigmoid, softmax
from pictorium.functions.vectors import is_valid


class EmbeddingProvider(Protocol):
    """Turns contents into vectors; instances travel to the executors."""

    model: str
    version: str
    dims: int

    def embed(self, contents: list[bytes]) -> np.ndarray: ...


class HashEmbedding:
    """A deterministic stand-in for a model: a unit vector seeded by the content's digest."""

    def __init__(self, dims: int = 16, model: str = "hash", version: str = "1"):
        self.dims, self.model, self.version = dims, model, version

    def embed(self, contents: list[bytes]) -> np.ndarray:
        rows = [np.random.default_rng(int.from_bytes(hashlib.sha256(c).digest()[:8], "big")).normal(size=self.dims) for c in contents]
        return np.stack([r / np.linalg.norm(r) for r in rows]).astype(np.float32) if rows else np.empty((0, self.dims), np.float32)


def embed_rows(df: DataFrame, key: str, content: str, provider: EmbeddingProvider, batch: int = 32, at_once: int | None = None) -> DataFrame:
    """(key, vector, model, version, error): a failing batch is halved down to the rows at fault.

    ``at_once`` bounds the tasks that use the model at a time.
    """
    kind = dict(df.dtypes)[key]

    def attempt(contents: list[bytes]) -> list[tuple[list[float] | None, str | None]]:
        try:
            return [(v.tolist(), None) for v in provider.embed(contents)]
        except Exception as error:  # a row's failure is its result
            if len(contents) == 1:
                return [(None, f"{type(error).__name__}: {error}")]
            half = len(contents) // 2
            return attempt(contents[:half]) + attempt(contents[half:])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            out: list[tuple[list[float] | None, str | None]] = []
            values = [v if isinstance(v, bytes) else bytes(v) if isinstance(v, bytearray) else str(v).encode() for v in frame[content]]
            for k in range(0, len(values), batch):
                out += attempt(values[k : k + batch])
            yield pd.DataFrame({key: frame[key], "vector": [o[0] for o in out], "model": provider.model, "version": provider.version, "error": [o[1] for o in out]})

    rows = df.where(F.col(content).isNotNull()).select(key, content)
    return (rows.repartition(at_once) if at_once else rows).mapInPandas(run, f"`{key}` {kind}, vector array<float>, model string, version string, error string")


def embed_missing(df: DataFrame, cache: DataFrame, key: str, content: str, provider: EmbeddingProvider) -> DataFrame:
    """Cached rows of the current model and newly computed ones; only misses are computed."""
    held = cache.where((F.col("model") == provider.model) & (F.col("version") == provider.version) & (F.size("vector") == provider.dims))
    held = held.dropDuplicates([key]).select(key, "vector", "model", "version", F.lit(None).cast("string").alias("error"))
    misses = df.join(held.select(key), key, "left_anti")
    return held.join(df.select(key), key, "left_semi").unionByName(embed_rows(misses, key, content, provider))


def top_mean(values: Column, k: int) -> Column:
    top = F.slice(F.sort_array(values, asc=False), 1, k)
    return F.aggregate(top, F.lit(0.0), lambda s, v: s + v) / F.size(top)


def zero_shot(logits: dict[str, Column], useful: list[str], routing: list[str], noise: list[str], k: int = 2) -> Column:
    """Struct of class probabilities, margin and group scores from arrays of prompt logits per class."""
    names = list(logits)
    each = {n: top_mean(c, k) for n, c in logits.items()}
    p = softmax(F.array(*each.values()))
    order = F.sort_array(p, asc=False)
    margin = F.when(F.size(p) > 1, F.element_at(order, 1) - F.try_element_at(order, F.lit(2))).otherwise(F.lit(1.0))
    u, r, n = (logsumexp(F.array(*[each[x] for x in group])) for group in (useful, routing, noise))
    best = F.element_at(F.array(*[F.lit(x) for x in names]), F.array_position(p, F.array_max(p)).cast("int"))
    return F.struct(
        p.alias("scores"), best.alias("predicted"), F.array_max(p).alias("confidence"), margin.alias("margin"), sigmoid(u - F.greatest(n, r)).alias("utility"), sigmoid(n - F.greatest(u, r)).alias("noise")
    )


def pair_logits(images: Column, prompts: list[list[float]], scale: float = 1.0, bias: float = 0.0) -> Column:
    """Scaled inner products of a vector with each prompt."""
    dots = [F.aggregate(F.zip_with(images, F.array(*[F.lit(float(x)) for x in p]), lambda a, b: a.cast("double") * b), F.lit(0.0), lambda s, v: s + v) for p in prompts]
    return F.array(*[d * F.lit(scale) + F.lit(bias) for d in dots])


def matching_prompts(df: DataFrame, key: str, vector: str, prompts: list[tuple[str, str, list[float]]], k: int = 15, digits: int = 9) -> DataFrame:
    """(key, place, class, prompt, score): the ``k`` prompts (class, text, vector) nearest to each image; ties go to the earlier prompt."""
    if k <= 0:
        raise ValueError("k must be positive")
    scores = pair_logits(F.col(vector), [p[2] for p in prompts])
    # All prompts of an image come from one row, so the order is an array's and nothing is shuffled.
    entry = F.transform("_s", lambda s, n: F.struct((-F.round(s, digits)).alias("s"), n.alias("n")))
    best = df.select(key, scores.alias("_s")).select(key, F.posexplode(F.slice(F.array_sort(entry), 1, k)).alias("place", "e"))
    names, texts = (F.array(*[F.lit(p[n]) for p in prompts]) for n in (0, 1))
    return best.select(key, (F.col("place") + 1).alias("place"), names[F.col("e.n")].alias("class"), texts[F.col("e.n")].alias("prompt"), (-F.col("e.s")).alias("score"))


class FeatureCache:
    """Vectors by content hash and model in an append-only table; damaged rows count as missing."""

    def __init__(self, spark: SparkSession, path: str, provider: EmbeddingProvider):
        self.spark, self.path, self.provider = spark, path, provider

    def get(self) -> DataFrame:
        from pictorium.sources.readers import read_or_empty

        rows = read_or_empty(self.spark, self.path, "content_hash string, vector array<float>, model string, version string")
        mine = (F.col("model") == self.provider.model) & (F.col("version") == self.provider.version)
        return rows.where(mine & is_valid(F.col("vector"), self.provider.dims))

    def put(self, rows: DataFrame) -> int:
        """Append the valid rows (content_hash, vector) that are new; returns their number."""
        from pictorium.runtime import written

        fresh = rows.select("content_hash", "vector").where(is_valid(F.col("vector"), self.provider.dims)).dropDuplicates(["content_hash"])
        fresh = written(fresh.join(self.get().select("content_hash"), "content_hash", "left_anti"), "features")
        n = fresh.count()
        if n:
            fresh.withColumns({"model": F.lit(self.provider.model), "version": F.lit(self.provider.version)}).write.mode("append").parquet(self.path)
        return n


def smoke_test(provider: EmbeddingProvider, contents: list[bytes], tolerance: float = 1e-4) -> dict[str, object]:
    """Whether a model gives the same finite vectors for a batch as one by one."""
    if not contents:
        raise ValueError("at least one content is needed")
    if tolerance < 0:
        raise ValueError("the tolerance must not be negative")
    batch = np.asarray(provider.embed(contents), np.float32)
    single = np.concatenate([np.asarray(provider.embed([c]), np.float32) for c in contents])
    if batch.shape != (len(contents), provider.dims) or single.shape != batch.shape:
        raise ValueError(f"vectors of shape {batch.shape} and {single.shape}")
    finite = bool(np.isfinite(batch).all() and np.isfinite(single).all())
    apart = float(np.abs(batch - single).max()) if finite else float("nan")
    return {"model": provider.model, "version": provider.version, "dims": provider.dims, "count": len(contents), "all_finite": finite, "largest_difference": apart, "passed": finite and apart <= tolerance}
