"""Vector search, fusion, ranking measures and classifier evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from pictorium.functions import vectors
from pictorium.functions.numeric import ratio
from pictorium.operators import evaluation, inference, latest, relational, vector_search
from pictorium.plans.register import Register
from pictorium.runtime import blank_to_null, read_table

register = Register()

# ---------------------------------------------------------------- vectors

_SCORED = """
WITH e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v, embedding[1:32]::DOUBLE[] AS c, embedding[33:64]::DOUBLE[] AS d FROM embeddings),
n AS (SELECT vec_id, label, v, c, d, sqrt(list_dot_product(v, v)) AS nv, sqrt(list_dot_product(c, c)) AS nc, sqrt(list_dot_product(d, d)) AS nd FROM e),
s AS (SELECT q.vec_id AS query, i.vec_id AS item, q.label AS ql, i.label AS il, round(list_dot_product(q.v, i.v) / q.nv / i.nv, 9) AS sv, round(list_dot_product(q.c, i.c) / q.nc / i.nc, 9) AS sc, round(list_dot_product(q.d, i.d) / q.nd / i.nd, 9) AS sd
  FROM n q JOIN n i ON q.vec_id <> i.vec_id WHERE q.vec_id % 50 = 0)
"""


def _ranked(score: str, name: str, k: int, where: str = "TRUE") -> str:
    return f", {name} AS (SELECT query, item, {score} AS score, row_number() OVER (PARTITION BY query ORDER BY {score} DESC, item)::INTEGER AS rank FROM s WHERE {where} QUALIFY rank <= {k})"


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    e = read_table(spark, d, "embeddings")
    return e.withColumns({"clip": F.slice("embedding", 1, 32), "dino": F.slice("embedding", 33, 32)})


def _asked(df: DataFrame) -> DataFrame:
    return df.where("vec_id % 50 = 0")


@register(_SCORED + _ranked("sv", "r", 10) + "SELECT query, item, score, rank FROM r")
def topk_cosine(spark, d):
    e = _vectors(spark, d)
    return vector_search.exact_top_k(_asked(e), e, "vec_id", "embedding", 10)


@register(_SCORED + _ranked("sv", "r", 5, "ql <> il") + "SELECT query, item, score, rank FROM r")
def topk_filtered(spark, d):
    e = _vectors(spark, d)
    return vector_search.exact_top_k(_asked(e), e, "vec_id", "embedding", 5, group="label")


_FUSED = _SCORED + _ranked("sc", "rc", 50) + _ranked("sd", "rd", 50) + """
, u AS (SELECT query, item, 1.0::DOUBLE / (rank + 60.0::DOUBLE) AS vote FROM rc UNION ALL SELECT query, item, 1.0::DOUBLE / (rank + 60.0::DOUBLE) FROM rd),
f AS (SELECT query, item, round(sum(vote), 12) AS score FROM u GROUP BY 1, 2),
fr AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, item)::INTEGER AS rank FROM f QUALIFY rank <= 30)
"""


def _fused(spark: SparkSession, d: str) -> DataFrame:
    e = _vectors(spark, d)
    lists = [vector_search.exact_top_k(_asked(e), e, "vec_id", v, 50) for v in ("clip", "dino")]
    return vector_search.reciprocal_rank_fusion(lists, limit=30)


@register(_FUSED + "SELECT query, item, score, rank FROM fr")
def rrf_fusion(spark, d):
    return _fused(spark, d)


@register(
    _FUSED
    + """, g AS (SELECT fr.*, e.label, row_number() OVER (PARTITION BY query, e.label ORDER BY rank) AS in_group FROM fr JOIN embeddings e ON fr.item = e.vec_id)
SELECT query, item, label, row_number() OVER (PARTITION BY query ORDER BY rank)::INTEGER AS final_rank FROM g WHERE in_group <= 2 QUALIFY final_rank <= 10"""
)
def diversity_cap(spark, d):
    labels = read_table(spark, d, "embeddings").select(F.col("vec_id").alias("item"), "label")
    hits = _fused(spark, d).join(labels, "item")
    return latest.capped_per_group(hits, "label", [F.col("rank")], 2, limit=10, lists=["query"]).select("query", "item", "label", "final_rank")


_PATCHED = """
, p AS (SELECT vec_id, unnest([0, 1, 2, 3]) AS patch, embedding::DOUBLE[] AS v FROM embeddings), pp AS (SELECT vec_id, patch, v[patch * 16 + 1 : patch * 16 + 16] AS x FROM p)
"""


@register(
    _SCORED + _ranked("sv", "short", 20) + _PATCHED
    + """, b AS (SELECT s.query, s.item, a.patch, max(list_dot_product(a.x, c.x)) AS best FROM short s JOIN pp a ON s.query = a.vec_id JOIN pp c ON s.item = c.vec_id GROUP BY 1, 2, 3),
m AS (SELECT query, item, round(avg(best), 9) AS patch_score FROM b GROUP BY 1, 2)
SELECT m.query, m.item, patch_score, short.score AS pooled_score, short.rank AS pooled_rank, row_number() OVER (PARTITION BY m.query ORDER BY patch_score DESC, short.score DESC, m.item)::INTEGER AS rank
FROM m JOIN short USING (query, item) QUALIFY row_number() OVER (PARTITION BY m.query ORDER BY patch_score DESC, short.score DESC, m.item) <= 5"""
)
def ensemble_two_stage(spark, d):
    e = _vectors(spark, d)
    return vector_search.two_stage(_asked(e), e, "vec_id", "embedding", vectors.patches(F.col("embedding"), 4, 16), k=5, shortlist=20)


@register(
    _SCORED + _ranked("sv", "short", 3) + _PATCHED
    + """, x AS (SELECT s.query, s.item, a.patch AS query_patch, c.patch AS item_patch, round(list_dot_product(a.x, c.x), 9) AS similarity FROM short s JOIN pp a ON s.query = a.vec_id JOIN pp c ON s.item = c.vec_id)
SELECT query, item, query_patch::INTEGER AS query_patch, item_patch::INTEGER AS item_patch, similarity, (query_patch // 2)::INTEGER AS query_row, (query_patch % 2)::INTEGER AS query_col, (item_patch // 2)::INTEGER AS item_row, (item_patch % 2)::INTEGER AS item_col
FROM x QUALIFY row_number() OVER (PARTITION BY query, item, query_patch ORDER BY similarity DESC, item_patch) = 1"""
)
def patch_diagnostics(spark, d):
    e = _vectors(spark, d)
    grid = e.select("vec_id", vectors.patches(F.col("embedding"), 4, 16).alias("p"))
    pairs = vector_search.exact_top_k(_asked(e), e, "vec_id", "embedding", 3)
    pairs = pairs.join(grid.select(F.col("vec_id").alias("query"), F.col("p").alias("qp")), "query").join(grid.select(F.col("vec_id").alias("item"), F.col("p").alias("ip")), "item")
    return vector_search.patch_matches(pairs, "qp", "ip", 2)


@register(
    _SCORED + _ranked("sv", "ex", 10) + _ranked("sc", "ap", 40)
    + "SELECT ex.query, round(avg((ap.item IS NOT NULL)::INT::DOUBLE), 9) AS recall FROM ex LEFT JOIN ap ON ex.query = ap.query AND ex.item = ap.item GROUP BY 1"
)
def ann_recall(spark, d):
    """Recall of a search on half of the dimensions, four times as deep, against the exact one."""
    e = _vectors(spark, d)
    exact = vector_search.exact_top_k(_asked(e), e, "vec_id", "embedding", 10)
    rough = vector_search.exact_top_k(_asked(e), e, "vec_id", "clip", 40)
    return vector_search.recall_at_k(rough, exact)


@register(
    _SCORED + _ranked("sv", "h", 10) + _PATCHED
    + """, b AS (SELECT s.query, s.item, a.patch, max(list_dot_product(a.x, c.x)) AS best FROM h s JOIN pp a ON s.query = a.vec_id JOIN pp c ON s.item = c.vec_id WHERE s.item % 3 <> 0 GROUP BY 1, 2, 3),
m AS (SELECT query, item, round(avg(best), 9) AS patch_score FROM b GROUP BY 1, 2),
j AS (SELECT h.query, h.item, h.rank, m.patch_score FROM h LEFT JOIN m USING (query, item))
SELECT query, item, patch_score, row_number() OVER (PARTITION BY query ORDER BY (rank > 5), CASE WHEN rank <= 5 THEN patch_score IS NULL END, CASE WHEN rank <= 5 THEN patch_score END DESC NULLS LAST, rank, item)::INTEGER AS final_rank FROM j"""
)
def rerank_partial(spark, d):
    """Items whose number is divisible by three have no patches."""
    e = _vectors(spark, d)
    hits = vector_search.exact_top_k(_asked(e), e, "vec_id", "embedding", 10)
    p = e.select("vec_id", vectors.patches(F.col("embedding"), 4, 16).alias("p"))
    pairs = hits.where("item % 3 <> 0").join(p.select(F.col("vec_id").alias("query"), F.col("p").alias("qp")), "query").join(p.select(F.col("vec_id").alias("item"), F.col("p").alias("ip")), "item")
    scores = pairs.select("query", "item", F.round(vectors.maxsim(F.col("qp"), F.col("ip")), 9).alias("patch_score"))
    return vector_search.rerank_with_tail(hits, scores, 5).select("query", "item", "patch_score", "final_rank")


@register(
    _SCORED + _ranked("sc", "a", 10) + _ranked("sd", "b", 10)
    + """SELECT coalesce(a.query, b.query) AS query, count(*) FILTER (WHERE a.item IS NOT NULL AND b.item IS NOT NULL)::BIGINT AS shared, count(*) FILTER (WHERE a.rank = b.rank)::BIGINT AS same_place, round(avg(abs(a.rank - b.rank)), 9)::DOUBLE AS mean_move
FROM a FULL OUTER JOIN b ON a.query = b.query AND a.item = b.item GROUP BY 1"""
)
def funnel_stats(spark, d):
    e = _vectors(spark, d)
    a, b = (vector_search.exact_top_k(_asked(e), e, "vec_id", v, 10).select("query", "item", F.col("rank").alias(n)) for v, n in (("clip", "ra"), ("dino", "rb")))
    both = a.join(b, ["query", "item"], "full_outer")
    return both.groupBy("query").agg(
        F.count_if(F.col("ra").isNotNull() & F.col("rb").isNotNull()).alias("shared"), F.count_if(F.col("ra") == F.col("rb")).alias("same_place"), F.round(F.avg(F.abs(F.col("ra") - F.col("rb"))), 9).alias("mean_move")
    )


@register(
    """WITH x AS (SELECT label < 5 AS p, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) - 1 AS dim FROM embeddings),
m AS (SELECT dim, avg(v) FILTER (WHERE p) - avg(v) FILTER (WHERE NOT p) AS diff FROM x GROUP BY 1)
SELECT dim::INTEGER AS dim, round(diff / sqrt(sum(diff * diff) OVER ()), 9) AS value FROM m"""
)
def mean_direction(spark, d):
    rows = vector_search.mean_direction(read_table(spark, d, "embeddings"), "embedding", F.col("label") < 5, 64)
    return rows.select("dim", F.round("value", 9).alias("value"))


@register(
    """WITH x AS (SELECT clip_dim, clip_vector AS v FROM artwork_embeddings)
SELECT CASE WHEN v IS NULL THEN 'missing' WHEN len(v) <> clip_dim THEN 'wrong_length' WHEN len(list_filter(v, lambda y: y IS NULL OR isnan(y) OR isinf(y))) > 0 THEN 'not_finite' WHEN len(list_filter(v, lambda y: y <> 0)) = 0 THEN 'zero' ELSE 'valid' END AS state, count(*)::BIGINT AS n FROM x GROUP BY 1"""
)
def vector_validation(spark, d):
    v = F.col("clip_vector")
    bad = F.exists(v, lambda y: y.isNull() | F.isnan(y) | (F.abs(y) == F.lit(float("inf"))))
    state = F.when(v.isNull(), "missing").when(F.size(v) != F.col("clip_dim"), "wrong_length").when(bad, "not_finite").when(~F.exists(v, lambda y: y != 0), "zero").otherwise("valid")
    return read_table(spark, d, "artwork_embeddings").groupBy(state.alias("state")).agg(F.count("*").alias("n"))


@register("SELECT vec_id, round(sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])), 6) AS before, 1.0::DOUBLE AS after FROM embeddings")
def l2_normalize(spark, d):
    e = read_table(spark, d, "embeddings")
    return e.select("vec_id", F.round(vectors.norm(F.col("embedding")), 6).alias("before"), F.round(vectors.norm(vectors.l2_normalize(F.col("embedding"))), 6).alias("after"))


@register(
    """WITH l AS (SELECT vec_id, [embedding[1]::DOUBLE * 10, embedding[2]::DOUBLE * 10] AS art, [embedding[3]::DOUBLE * 10, embedding[4]::DOUBLE * 10] AS offer, [embedding[5]::DOUBLE * 10, embedding[6]::DOUBLE * 10] AS photo FROM embeddings),
c AS (SELECT vec_id, list_avg(art) AS a, list_avg(offer) AS o, list_avg(photo) AS p FROM l),
x AS (SELECT vec_id, a, o, p, exp(a - greatest(a, o, p)) AS ea, exp(o - greatest(a, o, p)) AS eo, exp(p - greatest(a, o, p)) AS ep FROM c)
SELECT vec_id, CASE WHEN a >= o AND a >= p THEN 'art' WHEN o >= p THEN 'offer' ELSE 'photo' END AS predicted, round(greatest(ea, eo, ep) / (ea + eo + ep), 9) AS confidence, round(1 / (1 + exp(-(a - greatest(o, p)))), 9) AS utility FROM x"""
)
def zero_shot_scores(spark, d):
    e = read_table(spark, d, "embeddings")
    logits = {n: F.transform(F.slice("embedding", k, 2), lambda v: v.cast("double") * 10) for n, k in (("art", 1), ("offer", 3), ("photo", 5))}
    z = e.select("vec_id", inference.zero_shot(logits, ["art"], ["offer"], ["photo"], k=2).alias("z"))
    return z.select("vec_id", "z.predicted", F.round("z.confidence", 9).alias("confidence"), F.round("z.utility", 9).alias("utility"))


@register("SELECT artwork_id, 8::INTEGER AS dims, NULL::VARCHAR AS error FROM artworks WHERE raw_path IS NOT NULL")
def embed_with_cache(spark, d):
    """Half of the works are in the cache; the others' vectors are computed."""
    works = read_table(spark, d, "artworks").select("artwork_id", "raw_path")
    provider = inference.HashEmbedding(8)
    cache = inference.embed_rows(works.where(F.pmod(F.xxhash64("artwork_id"), F.lit(2)) == 0), "artwork_id", "raw_path", provider)
    return inference.embed_missing(works, cache.drop("error"), "artwork_id", "raw_path", provider).select("artwork_id", F.size("vector").alias("dims"), "error")


# ---------------------------------------------------------------- ranked lists

_JUDGED = """
WITH a AS (SELECT lower(trim(artwork_id)) AS k, min(lower(trim(artist_id))) AS artist FROM artworks GROUP BY 1),
x AS (SELECT s.retrieval_mode, s.search_id, s.result_id, s.score, i.artist = q.artist AS relevant, row_number() OVER (PARTITION BY s.search_id ORDER BY s.result_rank, s.result_id) AS rank, s.candidate_count AS result_count, s.result_rank
  FROM search_results s JOIN a q ON lower(trim(s.query_artwork_id)) = q.k JOIN a i ON lower(trim(s.artwork_id)) = i.k),
j AS (SELECT retrieval_mode, search_id, result_id, CASE WHEN isnan(score) THEN NULL ELSE score END AS score, relevant, rank, result_count FROM x),
o AS (SELECT *, sum(relevant::INT) OVER (PARTITION BY retrieval_mode, search_id ORDER BY rank) AS seen FROM j),
q AS (SELECT retrieval_mode, search_id, count(*) AS n, count_if(relevant) AS r, max(result_count) AS expected,
  CASE WHEN count_if(relevant) > 0 THEN 1.0::DOUBLE / min(rank) FILTER (WHERE relevant) ELSE 0 END AS rr,
  CASE WHEN count_if(relevant) > 0 THEN sum(seen::DOUBLE / rank) FILTER (WHERE relevant) / count_if(relevant) ELSE 0 END AS ap,
  sum(1.0::DOUBLE / log2(rank + 1)) FILTER (WHERE relevant) AS dcg FROM o GROUP BY 1, 2),
i AS (SELECT n AS r, sum(1.0::DOUBLE / log2(k + 1)) AS ideal FROM (SELECT DISTINCT r AS n FROM q WHERE r > 0) JOIN (SELECT unnest(generate_series(1, 500)) AS k) ON k <= n GROUP BY 1)
"""


def _judged(spark: SparkSession, d: str) -> DataFrame:
    artist = read_table(spark, d, "artworks").groupBy(blank_to_null(F.col("artwork_id")).alias("k")).agg(F.min(blank_to_null(F.col("artist_id"))).alias("artist"))
    s = read_table(spark, d, "search_results")
    s = s.join(artist.select(F.col("k").alias("_q"), F.col("artist").alias("q_artist")), blank_to_null(F.col("query_artwork_id")) == F.col("_q"))
    s = s.join(artist.select(F.col("k").alias("_i"), F.col("artist").alias("i_artist")), blank_to_null(F.col("artwork_id")) == F.col("_i"))
    place = Window.partitionBy("search_id").orderBy("result_rank", "result_id")
    return s.select(
        "retrieval_mode", "search_id", "result_id", F.when(~F.isnan("score"), F.col("score")).alias("score"), (F.col("i_artist") == F.col("q_artist")).alias("relevant"), F.row_number().over(place).alias("rank"), F.col("candidate_count").alias("result_count")
    )


@register(
    _JUDGED
    + """SELECT retrieval_mode, sum(n)::BIGINT AS judgments, count(*)::BIGINT AS query_count, sum(q.r)::BIGINT AS relevant, round(sum(n) / sum(expected), 9)::DOUBLE AS annotation_coverage, round(sum(q.r) / sum(n), 9)::DOUBLE AS judged_precision,
  round(avg(rr), 9)::DOUBLE AS mrr, round(avg(ap), 9)::DOUBLE AS map, round(avg(coalesce(dcg / ideal, 0)), 9)::DOUBLE AS ndcg FROM q LEFT JOIN i ON q.r = i.r GROUP BY 1"""
)
def ir_metrics_by_mode(spark, d):
    return evaluation.ranking_metrics(_judged(spark, d), ["retrieval_mode"], "search_id")


def _prefix_sql(population: str) -> str:
    return (
        _JUDGED
        + f"""SELECT retrieval_mode, k::INTEGER AS k, sum(n)::BIGINT AS judgments, sum(r)::BIGINT AS relevant, round(sum(n) / sum(least(k, results)), 9)::DOUBLE AS coverage, round(sum(r) / sum(n), 9)::DOUBLE AS judged_precision,
  round(count_if(r > 0) / {population}, 9)::DOUBLE AS query_hit_rate, round(avg(CASE WHEN all_r > 0 THEN r / all_r END), 9)::DOUBLE AS pool_recall
FROM (SELECT retrieval_mode, search_id, k, count_if(rank <= k) AS n, count_if(rank <= k AND relevant) AS r, count_if(relevant) AS all_r, max(result_count) AS results FROM j JOIN (SELECT unnest([1, 5, 10]) AS k) ON TRUE GROUP BY 1, 2, 3) GROUP BY 1, 2"""
    )


@register(_prefix_sql("count(*)"))
def ir_at_k(spark, d):
    return evaluation.prefix_metrics(_judged(spark, d), ["retrieval_mode"], "search_id")


@register(_prefix_sql("count_if(n > 0)"))
def ir_at_k_session(spark, d):
    return evaluation.prefix_metrics(_judged(spark, d), ["retrieval_mode"], "search_id", scope="session")


@register(
    _JUDGED
    + """, b AS (SELECT k, -1.0::DOUBLE + k * 0.4::DOUBLE AS lo FROM (SELECT unnest([0, 1, 2, 3, 4]) AS k)), m AS (SELECT DISTINCT retrieval_mode FROM j)
SELECT m.retrieval_mode, b.k::INTEGER AS bin, b.lo AS score_min, b.lo + 0.4::DOUBLE AS score_max, count(j.result_id)::BIGINT AS judgments, coalesce(count_if(j.relevant), 0)::BIGINT AS relevant,
  CASE WHEN count(j.result_id) > 0 THEN round(count_if(j.relevant) / count(j.result_id), 9) END::DOUBLE AS precision
FROM m JOIN b ON TRUE LEFT JOIN j ON j.retrieval_mode = m.retrieval_mode AND j.score >= b.lo AND (j.score < b.lo + 0.4::DOUBLE OR (b.k = 4 AND j.score = b.lo + 0.4::DOUBLE)) GROUP BY 1, 2, 3, 4"""
)
def ir_calibration_bins(spark, d):
    return evaluation.score_calibration(_judged(spark, d), ["retrieval_mode"])


@register(
    """SELECT retrieval_mode, query_artwork_id, artwork_id, result_id FROM search_results QUALIFY row_number() OVER (PARTITION BY retrieval_mode, query_artwork_id, artwork_id ORDER BY searched_at DESC NULLS LAST, result_id DESC) = 1"""
)
def latest_judgments(spark, d):
    keys = ["retrieval_mode", "query_artwork_id", "artwork_id"]
    return evaluation.latest_judgments(read_table(spark, d, "search_results"), keys, "searched_at", "result_id").select(*keys, "result_id")


# ---------------------------------------------------------------- classifiers

_W = "1.959963984540054::DOUBLE"


def _wilson_sql(hit: str, n: str, sign: str) -> str:
    p = f"({hit}::DOUBLE / {n})"
    edge = f"({p} + {_W} * {_W} / (2 * {n}) {sign} {_W} * sqrt({p} * (1 - {p}) / {n} + {_W} * {_W} / (4.0::DOUBLE * {n} * {n}))) / (1 + {_W} * {_W} / {n})"
    bound = f"greatest(0.0::DOUBLE, {edge})" if sign == "-" else f"least(1.0::DOUBLE, {edge})"
    return f"CASE WHEN {n} > 0 THEN round({bound}, 9) END"


@register(
    _JUDGED
    + f""", b AS (SELECT retrieval_mode, count(*) AS n, count_if(coalesce(score >= 0.75, FALSE)) AS p, count_if(relevant) AS a, count_if(relevant AND coalesce(score >= 0.75, FALSE)) AS h, count_if(relevant = coalesce(score >= 0.75, FALSE)) AS s FROM j GROUP BY 1),
m AS (SELECT *, CASE WHEN p > 0 THEN h / p END AS pr, CASE WHEN a > 0 THEN h / a END AS re FROM b)
SELECT retrieval_mode, n::BIGINT AS samples, p::BIGINT AS predicted, a::BIGINT AS actual, h::BIGINT AS hit, round(pr, 9)::DOUBLE AS precision, {_wilson_sql('h', 'p', '-')}::DOUBLE AS precision_low, {_wilson_sql('h', 'p', '+')}::DOUBLE AS precision_high,
  round(re, 9)::DOUBLE AS recall, round(s / n, 9)::DOUBLE AS accuracy, round(CASE WHEN pr + re = 0 THEN 0 ELSE 2 * pr * re / (pr + re) END, 9)::DOUBLE AS f1 FROM m"""
)
def decision_metrics(spark, d):
    guess = F.coalesce(F.col("score") >= 0.75, F.lit(False))
    return evaluation.binary_metrics(_judged(spark, d), ["retrieval_mode"], F.col("relevant"), guess)


@register(
    _JUDGED
    + """, b AS (SELECT search_id, count(*) AS n, count_if(coalesce(score >= 0.75, FALSE)) AS p, count_if(relevant) AS a, count_if(relevant AND coalesce(score >= 0.75, FALSE)) AS h, count_if(relevant = coalesce(score >= 0.75, FALSE)) AS s FROM j GROUP BY 1),
m AS (SELECT *, round(CASE WHEN p > 0 THEN h / p END, 9) AS pr, round(CASE WHEN a > 0 THEN h / a END, 9) AS re FROM b)
SELECT count(*)::BIGINT AS groups, round(avg(pr), 6)::DOUBLE AS precision, round(avg(re), 6)::DOUBLE AS recall, round(avg(round(s / n, 9)), 6)::DOUBLE AS accuracy FROM m"""
)
def group_macro_metrics(spark, d):
    guess = F.coalesce(F.col("score") >= 0.75, F.lit(False))
    per = evaluation.binary_metrics(_judged(spark, d), ["search_id"], F.col("relevant"), guess)
    return evaluation.group_macro(per, ["precision", "recall", "accuracy"], digits=6)


_CLASSES = """
WITH t AS (SELECT source_platform AS truth, CASE WHEN trim(coalesce(source_id, '')) = '' THEN 'manual' ELSE 'bluesky' END AS predicted FROM artworks), c AS (SELECT truth AS class FROM t UNION SELECT predicted FROM t)
"""


def _classified(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "artworks").select(F.col("source_platform").alias("truth"), F.when(blank_to_null(F.col("source_id")).isNull(), "manual").otherwise("bluesky").alias("predicted"))


@register(_CLASSES + "SELECT truth, predicted, count(*)::BIGINT AS n FROM t GROUP BY 1, 2")
def classifier_confusion(spark, d):
    return evaluation.confusion(_classified(spark, d), "truth", "predicted")


@register(
    _CLASSES
    + """, m AS (SELECT class, count_if(truth = class) AS a, count_if(predicted = class) AS g, count_if(truth = class AND predicted = class) AS h FROM c JOIN t ON TRUE GROUP BY 1),
x AS (SELECT *, CASE WHEN g > 0 THEN h / g END AS p, CASE WHEN a > 0 THEN h / a END AS r FROM m)
SELECT class, a::BIGINT AS support, round(p, 9)::DOUBLE AS precision, round(r, 9)::DOUBLE AS recall, round(CASE WHEN p + r = 0 THEN 0 ELSE 2 * p * r / (p + r) END, 9)::DOUBLE AS f1 FROM x"""
)
def classifier_metrics(spark, d):
    return evaluation.multiclass_metrics(_classified(spark, d), "truth", "predicted")


_SWEEP = (
    _JUDGED
    + f""", y AS (SELECT score, relevant FROM j WHERE score IS NOT NULL), t AS (SELECT k / 100.0::DOUBLE AS threshold FROM (SELECT unnest(generate_series(0, 100)) AS k)),
z AS (SELECT threshold, count(*) AS n, count_if(relevant) AS pos, count_if(score >= threshold) AS an, count_if(score >= threshold AND relevant) AS ah, count_if(score <= threshold) AS rn, count_if(score <= threshold AND NOT relevant) AS rh FROM t JOIN y ON TRUE GROUP BY 1),
sweep AS (SELECT 'accept' AS kind, threshold, an::BIGINT AS decisions, round(CASE WHEN an > 0 THEN ah / an END, 9)::DOUBLE AS precision, {_wilson_sql('ah', 'an', '-')}::DOUBLE AS precision_low, round(CASE WHEN pos > 0 THEN ah / pos END, 9)::DOUBLE AS recall, round(an / n, 9)::DOUBLE AS coverage FROM z
UNION ALL SELECT 'reject', threshold, rn::BIGINT, round(CASE WHEN rn > 0 THEN rh / rn END, 9)::DOUBLE, {_wilson_sql('rh', 'rn', '-')}::DOUBLE, round(CASE WHEN n - pos > 0 THEN rh / (n - pos) END, 9)::DOUBLE, round(rn / n, 9)::DOUBLE FROM z)
"""
)


@register(_SWEEP + "SELECT * FROM sweep")
def threshold_sweep(spark, d):
    return evaluation.threshold_sweep(_judged(spark, d), "score", "relevant")


@register(
    _SWEEP
    + """, best AS (SELECT min(threshold) AS accept_threshold FROM sweep WHERE kind = 'accept' AND decisions >= 5 AND precision_low >= 0.05)
SELECT accept_threshold, (SELECT max(threshold) FROM sweep WHERE kind = 'reject' AND decisions >= 5 AND precision_low >= 0.5 AND threshold < coalesce(accept_threshold, 2)) AS reject_threshold FROM best"""
)
def threshold_recommendation(spark, d):
    sweep = evaluation.threshold_sweep(_judged(spark, d), "score", "relevant")
    return evaluation.recommended_thresholds(sweep, 0.05, 0.5, 5)


@register(
    _JUDGED
    + """SELECT count_if(score >= 0.8)::BIGINT AS accept_count, round(CASE WHEN count_if(score >= 0.8) > 0 THEN count_if(score >= 0.8 AND relevant) / count_if(score >= 0.8) END, 9)::DOUBLE AS accept_precision,
  count_if(score <= 0.5)::BIGINT AS reject_count, round(CASE WHEN count_if(score <= 0.5) > 0 THEN count_if(score <= 0.5 AND NOT relevant) / count_if(score <= 0.5) END, 9)::DOUBLE AS reject_precision,
  (count(*) - count_if(score >= 0.8 OR score <= 0.5))::BIGINT AS review_count, round((count(*) - count_if(score >= 0.8 OR score <= 0.5)) / count(*), 9)::DOUBLE AS review_rate FROM j"""
)
def policy_projection(spark, d):
    return evaluation.policy_projection(_judged(spark, d), "score", "relevant", 0.8, 0.5)


@register(
    _JUDGED + "SELECT result_id, round(least(abs(score - 0.8), abs(score - 0.5)), 9) AS distance, row_number() OVER (ORDER BY round(least(abs(score - 0.8), abs(score - 0.5)), 9), result_id)::INTEGER AS place FROM j WHERE score IS NOT NULL"
)
def review_priority(spark, d):
    """Every scored result, those nearest to a decision boundary first."""
    from pictorium.functions.numeric import boundary_distance

    rows = _judged(spark, d).where("score is not null").select("result_id", F.round(boundary_distance(F.col("score"), 0.8, 0.5), 9).alias("distance"))
    return relational.placed(rows, ["distance", "result_id"])


@register("SELECT retrieval_mode, count(*)::BIGINT AS results, round(avg(CASE WHEN isnan(score) THEN NULL ELSE score END), 9)::DOUBLE AS mean_score, round(count_if(is_sfw IS NULL) / count(*), 9)::DOUBLE AS unknown_rate FROM search_results GROUP BY 1")
def mode_statistics(spark, d):
    return read_table(spark, d, "search_results").groupBy("retrieval_mode").agg(
        F.count("*").alias("results"), F.round(F.avg(F.when(~F.isnan("score"), F.col("score"))), 9).alias("mean_score"), F.round(ratio(F.count_if(F.col("is_sfw").isNull()), F.count("*")), 9).alias("unknown_rate")
    )


QUERIES, ORACLES = register.queries, register.oracles
