"""Exact search over vectors, fusion of ranked lists and late-interaction reranking."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from pictorium.functions.vectors import maxsim

#: Bytes of query vectors that one broadcast block may hold.
BLOCK_BYTES = 64 << 20


def _unit(values) -> np.ndarray:
    x = np.stack([np.asarray(v, np.float64) for v in values])
    n = np.sqrt((x**2).sum(axis=1, keepdims=True))
    return np.divide(x, n, out=np.zeros_like(x), where=n > 0)


def exact_top_k(queries: DataFrame, corpus: DataFrame, key: str, vector: str, k: int, group: str | None = None, digits: int = 9) -> DataFrame:
    """(query, item, score, rank): the ``k`` corpus rows of highest cosine per query.

    The stated queries go out in broadcast blocks of bounded size; each task
    scores its part of the corpus by matrix products and keeps its own best
    ``k`` per query, and only those are shuffled.  A query never finds itself
    nor, with ``group``, rows of its own group.  Ties go to the smaller key.
    """
    spark = queries.sparkSession
    cols = [key, vector, *([group] if group else [])]
    kind = dict(corpus.dtypes)[key]
    asked = queries.select(*cols).where(F.col(key).isNotNull() & F.col(vector).isNotNull())
    width = asked.select(F.max(F.size(vector))).first()[0]
    schema = f"query {kind}, item {kind}, score double"
    if not width:
        return spark.createDataFrame([], schema + ", rank int")
    per_block = max(1, BLOCK_BYTES // (8 * width))
    blocks = -(-asked.count() // per_block)
    out: DataFrame | None = None
    for b in range(blocks):
        part = asked.where(F.pmod(F.xxhash64(key), F.lit(blocks)) == b).toPandas()
        if not len(part):
            continue
        held = spark.sparkContext.broadcast((part[key].to_numpy(), _unit(part[vector]), part[group].to_numpy() if group else None))

        def score(batches: Iterator[pd.DataFrame], held=held) -> Iterator[pd.DataFrame]:
            keys, q, groups = held.value
            for frame in batches:
                frame = frame[frame[vector].notna() & frame[key].notna()]
                if not len(frame):
                    continue
                frame = frame.sort_values(key)
                items = frame[key].to_numpy()
                s = q @ _unit(frame[vector]).T
                blocked = keys[:, None] == items[None, :]
                if groups is not None:
                    blocked |= groups[:, None] == frame[group].to_numpy()[None, :]
                s = np.where(blocked, -np.inf, np.round(s, digits))
                best = np.argsort(-s, axis=1, kind="stable")[:, :k]
                top = np.take_along_axis(s, best, 1)
                row, col = np.nonzero(top > -np.inf)
                yield pd.DataFrame({"query": keys[row], "item": items[best[row, col]], "score": top[row, col]})

        found = corpus.select(*cols).mapInPandas(score, schema)
        out = found if out is None else out.unionByName(found)
    order = Window.partitionBy("query").orderBy(F.col("score").desc(), F.col("item"))
    return out.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def funnel_limits(prefetch: int, fusion: int, rerank: int, k: int) -> tuple[int, int, int, int]:
    """The limits, which must not grow from stage to stage."""
    if not prefetch >= fusion >= rerank >= k > 0:
        raise ValueError(f"limits must fall from stage to stage: {prefetch}, {fusion}, {rerank}, {k}")
    return prefetch, fusion, rerank, k


def reciprocal_rank_fusion(lists: list[DataFrame], limit: int | None = None, constant: float = 60.0, digits: int = 12, names: list[str] | None = None) -> DataFrame:
    """(query, item, score, rank) of several ranked lists (query, item, rank).

    With ``names`` for the lists, which then need a score, also each list's
    ``<name>_score`` and ``<name>_rank``, NULL where it doesn't hold the item.
    """
    votes: DataFrame | None = None
    for number, one in enumerate(lists):
        own = [F.lit(number).alias("_list"), F.col("score").alias("_score"), F.col("rank").alias("_rank")] if names else []
        part = one.select("query", "item", (F.lit(1.0) / (F.col("rank") + F.lit(constant))).alias("vote"), *own)
        votes = part if votes is None else votes.unionByName(part)
    evidence = [F.max(F.when(F.col("_list") == number, F.col(f"_{what}"))).alias(f"{name}_{what}") for number, name in enumerate(names or []) for what in ("score", "rank")]
    fused = votes.groupBy("query", "item").agg(F.round(F.sum("vote"), digits).alias("score"), *evidence)
    order = Window.partitionBy("query").orderBy(F.col("score").desc(), F.col("item"))
    ranked = fused.withColumn("rank", F.row_number().over(order))
    return ranked.where(F.col("rank") <= limit) if limit else ranked


def two_stage(queries: DataFrame, corpus: DataFrame, key: str, pooled: str, patch: Column, k: int, shortlist: int, group: str | None = None, top_n: int = 1, digits: int = 9) -> DataFrame:
    """Pooled shortlist, then patches joined for the shortlist only and reranked by maximum similarity."""
    short = exact_top_k(queries, corpus, key, pooled, max(k, shortlist), group)
    patches = corpus.select(F.col(key), patch.alias("_p"))
    near = short.withColumnsRenamed({"score": "pooled_score", "rank": "pooled_rank"})
    near = near.join(patches.withColumnsRenamed({key: "query", "_p": "_q"}), "query").join(patches.withColumnRenamed(key, "item"), "item")
    scored = near.withColumn("patch_score", F.round(maxsim(F.col("_q"), F.col("_p"), top_n), digits)).drop("_q", "_p")
    order = Window.partitionBy("query").orderBy(F.col("patch_score").desc(), F.col("pooled_score").desc(), F.col("item"))
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query", "item", "patch_score", "pooled_score", "pooled_rank", "rank")


def rerank_with_tail(hits: DataFrame, scores: DataFrame, limit: int) -> DataFrame:
    """The first ``limit`` hits by a second score, missing scores last, and the rest as it was."""
    joined = hits.join(scores.select("query", "item", "patch_score"), ["query", "item"], "left")
    head = F.col("rank") <= limit
    order = Window.partitionBy("query").orderBy(
        (~head).cast("int"), F.when(head, F.col("patch_score").isNull().cast("int")), F.when(head, F.col("patch_score")).desc_nulls_last(), F.col("rank"), F.col("item")
    )
    return joined.withColumn("final_rank", F.row_number().over(order))


def patch_matches(pairs: DataFrame, query_patches: str, item_patches: str, grid: int, digits: int = 9) -> DataFrame:
    """For every query patch its most similar item patch, with the grid coordinates of both."""
    q = pairs.select("query", "item", F.posexplode(query_patches).alias("query_patch", "_a"), item_patches)
    sims = F.transform(F.col(item_patches), lambda b: F.round(F.aggregate(F.zip_with("_a", b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v), digits))
    q = q.withColumn("_s", sims).withColumn("similarity", F.array_max("_s")).withColumn("item_patch", (F.array_position("_s", F.col("similarity")) - 1).cast("int"))
    cell = lambda c: [F.floor(F.col(c) / grid).cast("int"), (F.col(c) % grid).cast("int")]
    (qr, qc), (ir, ic) = cell("query_patch"), cell("item_patch")
    return q.select("query", "item", "query_patch", "item_patch", "similarity", qr.alias("query_row"), qc.alias("query_col"), ir.alias("item_row"), ic.alias("item_col"))


def recall_at_k(found: DataFrame, exact: DataFrame) -> DataFrame:
    """Per query, the share of the exact neighbours that were found."""
    hit = exact.select("query", "item").join(found.select("query", "item", F.lit(1).alias("_hit")), ["query", "item"], "left")
    return hit.groupBy("query").agg(F.round(F.avg(F.coalesce("_hit", F.lit(0)).cast("double")), 9).alias("recall"))


def mean_direction(df: DataFrame, vector: str, positive: Column, dims: int) -> DataFrame:
    """(dim, value): the unit vector from the mean of the other rows to the mean of ``positive`` rows."""
    cells = df.select(positive.alias("_p"), F.posexplode(vector).alias("dim", "x"))
    means = cells.groupBy("dim").agg((F.avg(F.when(F.col("_p"), F.col("x").cast("double"))) - F.avg(F.when(~F.col("_p"), F.col("x").cast("double")))).alias("d"))
    length = F.sqrt(F.sum(F.col("d") * F.col("d")).over(Window.partitionBy()))  # one row per dimension
    return means.select("dim", F.when(length > 0, F.col("d") / length).otherwise(F.lit(0.0)).alias("value"))


def gram_schmidt(axes: list[list[float]], least: float = 1e-8) -> list[list[float]]:
    """Orthonormal axes in the given order; an axis that depends on earlier ones is an error."""
    done: list[np.ndarray] = []
    for number, axis in enumerate(axes):
        rest = np.asarray(axis, float)
        for earlier in done:
            rest = rest - (rest @ earlier) * earlier
        size = float(np.linalg.norm(rest))
        if size <= least:
            raise ValueError(f"axis {number} depends on the earlier ones")
        done.append(rest / size)
    return [a.tolist() for a in done]


def top_patches(matches: DataFrame, n: int) -> DataFrame:
    """The ``n`` most similar query patches of each pair of :func:`patch_matches`; ties go to the smaller patch."""
    order = Window.partitionBy("query", "item").orderBy(F.col("similarity").desc(), F.col("query_patch"))
    return matches.withColumn("place", F.row_number().over(order)).where(F.col("place") <= n)


def recall_summary(per_query: DataFrame, digits: int = 9) -> DataFrame:
    """Queries, mean and least recall."""
    return per_query.agg(F.count("*").alias("queries"), F.round(F.avg("recall"), digits).alias("mean_recall"), F.round(F.min("recall"), digits).alias("minimum_recall"))


def latency_summary(timings: DataFrame, by: list[str], milliseconds: str, digits: int = 9) -> DataFrame:
    """Median and 95th percentile of measured times, interpolated; one row per measured search goes in."""
    at = lambda q: F.round(F.percentile(milliseconds, q), digits)
    return timings.groupBy(*by).agg(F.count("*").alias("searches"), at(0.5).alias("p50_ms"), at(0.95).alias("p95_ms"))


def payload_filter(df: DataFrame, must: dict[str, object] = {}, must_not: dict[str, object] = {}) -> DataFrame:
    """Rows whose columns equal every value of ``must`` and none of ``must_not``; NULL equals nothing."""
    for column, value in must.items():
        df = df.where(F.col(column) == F.lit(value))
    for column, value in must_not.items():
        df = df.where(~F.coalesce(F.col(column) == F.lit(value), F.lit(False)))
    return df


def collection_check(df: DataFrame, expected: dict[str, int]) -> DataFrame:
    """(vector_name, expected_dims, rows, missing, wrong_dims, not_unit) of the named vectors of a table, in one pass."""
    stats = []
    for name, dims in expected.items():
        v = F.col(name)
        right = F.size(v) == dims
        length = F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
        stats += [F.count_if(v.isNull()).alias(f"m_{name}"), F.count_if(v.isNotNull() & ~right).alias(f"w_{name}")]
        stats.append(F.count_if(right & ~F.coalesce(F.abs(F.sqrt(length) - 1) <= 1e-3, F.lit(False))).alias(f"u_{name}"))
    one = df.agg(F.count("*").alias("rows"), *stats)
    cells = [
        F.struct(F.lit(n).alias("vector_name"), F.lit(d).alias("expected_dims"), F.col("rows"), F.col(f"m_{n}").alias("missing"), F.col(f"w_{n}").alias("wrong_dims"), F.col(f"u_{n}").alias("not_unit"))
        for n, d in expected.items()
    ]
    return one.select(F.explode(F.array(*cells)).alias("c")).select("c.*")


def scroll(df: DataFrame, key: str, after: object | None, limit: int) -> DataFrame:
    """A page of rows in order of their unique key, after the last key of the page before."""
    rows = df if after is None else df.where(F.col(key) > F.lit(after))
    return rows.orderBy(key).limit(limit)
