"""What serves and inspects the corpus: evidence, mappings, filters, checks and ordered reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from pictorium.functions import keys, vectors
from pictorium.operators import evaluation, inference, latest, moderation, near_duplicates, relational, vector_search
from pictorium.plans.register import Register
from pictorium.plans.retrieval_queries import _JUDGED, _PATCHED, _SCORED, _asked, _judged, _ranked, _vectors
from pictorium.runtime import blank_to_null, read_table

register = Register()


def _key(column: str):
    return blank_to_null(F.col(column))


# ---------------------------------------------------------------- search

_LISTS = _SCORED + _ranked("sc", "rc", 50) + _ranked("sd", "rd", 50)


@register(
    _LISTS
    + """, u AS (SELECT query, item, 1.0::DOUBLE / (rank + 60.0::DOUBLE) AS vote FROM rc UNION ALL SELECT query, item, 1.0::DOUBLE / (rank + 60.0::DOUBLE) FROM rd),
f AS (SELECT query, item, round(sum(vote), 12) AS score FROM u GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, item)::INTEGER AS rank FROM f QUALIFY rank <= 20)
SELECT r.query, r.item, r.score, r.rank, rc.score AS clip_score, rc.rank AS clip_rank, rd.score AS dino_score, rd.rank AS dino_rank FROM r LEFT JOIN rc USING (query, item) LEFT JOIN rd USING (query, item)"""
)
def fused_evidence(spark, d):
    """Fused results with each retriever's score and rank."""
    e = _vectors(spark, d)
    prefetch, _, rerank, _ = vector_search.funnel_limits(50, 30, 20, 10)
    lists = [vector_search.exact_top_k(_asked(e), e, "vec_id", v, prefetch) for v in ("clip", "dino")]
    return vector_search.reciprocal_rank_fusion(lists, limit=rerank, names=["clip", "dino"])


@register(
    _SCORED + _ranked("sv", "ex", 10) + _ranked("sc", "ap", 40)
    + """, p AS (SELECT ex.query, round(avg((ap.item IS NOT NULL)::INT::DOUBLE), 9) AS recall FROM ex LEFT JOIN ap ON ex.query = ap.query AND ex.item = ap.item GROUP BY 1)
SELECT count(*)::BIGINT AS queries, round(avg(recall), 9) AS mean_recall, round(min(recall), 9) AS minimum_recall FROM p"""
)
def ann_summary(spark, d):
    e = _vectors(spark, d)
    exact = vector_search.exact_top_k(_asked(e), e, "vec_id", "embedding", 10)
    return vector_search.recall_summary(vector_search.recall_at_k(vector_search.exact_top_k(_asked(e), e, "vec_id", "clip", 40), exact))


@register("SELECT event_type, count(*)::BIGINT AS searches, round(quantile_cont(value, 0.5), 9) AS p50_ms, round(quantile_cont(value, 0.95), 9) AS p95_ms FROM events GROUP BY 1")
def latency_percentiles(spark, d):
    """The events' values taken as measured times."""
    return vector_search.latency_summary(read_table(spark, d, "events"), ["event_type"], "value")


@register(
    _SCORED + _ranked("sv", "short", 3) + _PATCHED
    + """, x AS (SELECT s.query, s.item, a.patch AS query_patch, c.patch AS item_patch, round(list_dot_product(a.x, c.x), 9) AS similarity FROM short s JOIN pp a ON s.query = a.vec_id JOIN pp c ON s.item = c.vec_id),
b AS (SELECT * FROM x QUALIFY row_number() OVER (PARTITION BY query, item, query_patch ORDER BY similarity DESC, item_patch) = 1)
SELECT query, item, query_patch::INTEGER AS query_patch, item_patch::INTEGER AS item_patch, similarity, row_number() OVER (PARTITION BY query, item ORDER BY similarity DESC, query_patch)::INTEGER AS place FROM b QUALIFY place <= 2"""
)
def top_patches(spark, d):
    e = _vectors(spark, d)
    grid = e.select("vec_id", vectors.patches(F.col("embedding"), 4, 16).alias("p"))
    pairs = vector_search.exact_top_k(_asked(e), e, "vec_id", "embedding", 3)
    pairs = pairs.join(grid.select(F.col("vec_id").alias("query"), F.col("p").alias("qp")), "query").join(grid.select(F.col("vec_id").alias("item"), F.col("p").alias("ip")), "item")
    return vector_search.top_patches(vector_search.patch_matches(pairs, "qp", "ip", 2), 2).select("query", "item", "query_patch", "item_patch", "similarity", "place")


_PROMPTS = [("art", "first", 1), ("art", "second", 2), ("offer", "third", 3), ("photo", "fourth", 4), ("photo", "fifth", 5)]


@register(
    f"""WITH s AS (SELECT vec_id, unnest([{', '.join(f"{{'class': '{c}', 'prompt': '{p}', 'pos': {n}, 'score': round(embedding[{n}]::DOUBLE, 9)}}" for c, p, n in _PROMPTS)}], recursive := true) FROM embeddings)
SELECT vec_id, class, prompt, score, row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, pos)::INTEGER AS place FROM s QUALIFY place <= 3"""
)
def prompt_matches(spark, d):
    """Unit vectors stand for the prompts."""
    prompts = [(c, p, [float(k == n - 1) for k in range(64)]) for c, p, n in _PROMPTS]
    return inference.matching_prompts(read_table(spark, d, "embeddings"), "vec_id", "embedding", prompts, k=3, digits=9)


@register("SELECT vec_id, len(embedding)::INTEGER AS dims, 4::INTEGER AS row_count, round(list_sum(embedding::DOUBLE[]), 6) AS total FROM embeddings")
def vector_blobs(spark, d):
    """Vectors written as bytes and read again."""
    blobs = read_table(spark, d, "embeddings").select("vec_id", vectors.to_bytes("embedding").alias("blob"))
    back = blobs.select("vec_id", vectors.from_bytes("blob").alias("v"))
    total = F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double"))
    return back.select("vec_id", F.size("v").alias("dims"), F.size(vectors.reshaped(F.col("v"), 16)).alias("row_count"), F.round(total, 6).alias("total"))


@register()
def point_hashes(spark, d):
    """A digest of each work's vectors and payload, as a sync compares it."""
    works = read_table(spark, d, "artworks").select(_key("artwork_id").alias("work"), _key("artist_id").alias("artist"), "is_sfw", "demo_eligible")
    held = read_table(spark, d, "artwork_embeddings").where("clip_vector is not null and dino_pooled is not null").withColumn("work", _key("artwork_id"))
    held = latest.latest_per_key(held, ["work"], [F.col("date_computed").desc_nulls_last(), F.col("model_version_clip").desc(), F.col("clip_vector")])
    payload = F.to_json(F.struct(F.col("artist"), F.col("demo_eligible"), F.col("is_sfw"), F.col("work")), {"ignoreNullFields": "false"})
    return works.join(held, "work").select("work", vectors.point_hash([vectors.to_bytes("clip_vector"), vectors.to_bytes("dino_pooled")], payload).alias("content_hash"))


@register(
    """WITH x AS (SELECT clip_vector AS c, dino_pooled AS p FROM artwork_embeddings)
SELECT 'clip_vector' AS vector_name, 64::INTEGER AS expected_dims, count(*)::BIGINT AS rows, count_if(c IS NULL)::BIGINT AS missing, count_if(len(c) <> 64)::BIGINT AS wrong_dims,
  count_if(len(c) = 64 AND NOT coalesce(abs(sqrt(list_dot_product(c::DOUBLE[], c::DOUBLE[])) - 1) <= 1e-3 AND NOT isnan(sqrt(list_dot_product(c::DOUBLE[], c::DOUBLE[]))), FALSE))::BIGINT AS not_unit FROM x
UNION ALL SELECT 'dino_pooled', 64, count(*), count_if(p IS NULL), count_if(len(p) <> 64), count_if(len(p) = 64 AND NOT coalesce(abs(sqrt(list_dot_product(p::DOUBLE[], p::DOUBLE[])) - 1) <= 1e-3 AND NOT isnan(sqrt(list_dot_product(p::DOUBLE[], p::DOUBLE[]))), FALSE)) FROM x"""
)
def collection_schema(spark, d):
    return vector_search.collection_check(read_table(spark, d, "artwork_embeddings"), {"clip_vector": 64, "dino_pooled": 64})


# ---------------------------------------------------------------- filters

@register(
    """WITH a AS (SELECT lower(trim(artwork_id)) AS k, min(lower(trim(artist_id))) AS artist FROM artworks GROUP BY 1)
SELECT result_id FROM search_results s LEFT JOIN a q ON lower(trim(s.query_artwork_id)) = q.k LEFT JOIN a i ON lower(trim(s.artwork_id)) = i.k
WHERE lower(trim(s.artwork_id)) <> lower(trim(s.query_artwork_id)) AND NOT coalesce(q.artist = i.artist, FALSE) AND s.review_status = 'confirmed_unique' AND s.is_sfw"""
)
def allowed_results(spark, d):
    """Results that aren't the query's own work nor of its artist, of one review status and known to be safe."""
    artist = read_table(spark, d, "artworks").groupBy(_key("artwork_id").alias("k")).agg(F.min(_key("artist_id")).alias("artist"))
    s = vector_search.payload_filter(read_table(spark, d, "search_results"), {"review_status": "confirmed_unique", "is_sfw": True})
    s = s.where(_key("artwork_id") != _key("query_artwork_id"))
    s = s.join(artist.withColumnsRenamed({"k": "_q", "artist": "q_artist"}), _key("query_artwork_id") == F.col("_q"), "left")
    s = s.join(artist.withColumnsRenamed({"k": "_i", "artist": "i_artist"}), _key("artwork_id") == F.col("_i"), "left")
    return s.where(~F.coalesce(F.col("q_artist") == F.col("i_artist"), F.lit(False))).select("result_id")


@register("SELECT artwork_id FROM artworks WHERE demo_eligible AND is_sfw AND NOT coalesce(source_platform = 'bluesky', FALSE) AND NOT coalesce(review_status = 'unreviewed', FALSE)")
def payload_filtered(spark, d):
    works = read_table(spark, d, "artworks")
    return vector_search.payload_filter(works, {"demo_eligible": True, "is_sfw": True}, {"source_platform": "bluesky", "review_status": "unreviewed"}).select("artwork_id")


@register(
    """WITH c AS (SELECT declared_width AS w, declared_height AS h, is_repost AS r, is_quote_post AS q, mime_type = 'image/webp' AS m FROM candidates),
x AS (SELECT unnest(['media.minimum_dimensions', 'media.minimum_area', 'media.extreme_aspect_ratio', 'media.animation', 'provenance.repost', 'provenance.quote_post']) AS rule,
  unnest([w < 256 OR h < 256, w * h < 100000, greatest(w / h, h / w) > 8.0, m, r, q]) AS hit FROM c)
SELECT rule, count(*)::BIGINT AS n FROM x WHERE hit GROUP BY 1"""
)
def rule_counts(spark, d):
    """WebP images stand for animated ones; pixels aren't in the tables, so their variance is unknown."""
    hits = moderation.rule_hits(F.col("declared_width"), F.col("declared_height"), F.col("is_repost"), F.col("is_quote_post"), F.col("mime_type") == "image/webp")
    return read_table(spark, d, "candidates").select(F.explode(hits).alias("h")).groupBy("h.rule").agg(F.count("*").alias("n"))


@register(
    """SELECT check_name, count(*)::BIGINT AS n FROM (SELECT unnest(['no_source', 'bad_size', 'bad_index', 'no_author', 'dated_after_receipt']) AS check_name,
  unnest([coalesce(thumbnail_url, '') = '' AND coalesce(fullsize_url, '') = '' AND coalesce(local_path, '') = '', coalesce(declared_width <= 0 OR declared_height <= 0, FALSE), coalesce(image_index < 0, FALSE), coalesce(author_did, '') = '' AND coalesce(author_handle, '') = '', coalesce(created_at > received_at, FALSE)]) AS bad FROM candidates) WHERE bad GROUP BY 1"""
)
def record_violations(spark, d):
    """How many candidates break each rule a record must keep; a record may break several."""
    empty = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    checks = {
        "no_source": empty("thumbnail_url") & empty("fullsize_url") & empty("local_path"),
        "bad_size": (F.col("declared_width") <= 0) | (F.col("declared_height") <= 0),
        "bad_index": F.col("image_index") < 0,
        "no_author": empty("author_did") & empty("author_handle"),
        "dated_after_receipt": F.col("created_at") > F.col("received_at"),
    }
    broken = F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in checks.items()]))
    return read_table(spark, d, "candidates").select(F.explode(broken).alias("check_name")).groupBy("check_name").agg(F.count("*").alias("n"))


@register(
    """WITH e AS (SELECT DISTINCT lower(trim(artwork_id)) AS k FROM artwork_embeddings WHERE model_name_clip = 'clip-fic-b' AND model_version_clip = '2026.2' AND clip_vector IS NOT NULL)
SELECT artwork_id, e.k IS NOT NULL AS is_current FROM artworks LEFT JOIN e ON lower(trim(artwork_id)) = e.k"""
)
def lineage_current(spark, d):
    state = read_table(spark, d, "artwork_embeddings").where("clip_vector is not null").select(_key("artwork_id").alias("k"), "model_name_clip", "model_version_clip")
    works = read_table(spark, d, "artworks").select("artwork_id", _key("artwork_id").alias("k"))
    return relational.lineage_matches(works, state, "k", {"model_name_clip": "clip-fic-b", "model_version_clip": "2026.2"}).select("artwork_id", "is_current")


@register("SELECT DISTINCT user_id FROM events a WHERE EXISTS (SELECT 1 FROM events b WHERE b.user_id = a.user_id AND b.event_type IN ('purchase', 'error', 'signup'))")
def with_terminal_event(spark, d):
    events = read_table(spark, d, "events")
    return relational.with_any_event(events.select("user_id").distinct(), events, "user_id", "event_type", ["purchase", "error", "signup"])


# ---------------------------------------------------------------- joins

_OBJECTS = """WITH o AS (SELECT artwork_id AS k, 'original' AS role, 'objects/sha256/' || substr(lower(trim(file_hash)), 1, 2) || '/' || substr(lower(trim(file_hash)), 3, 2) || '/' || lower(trim(file_hash)) || '.jpg' AS object_key
  FROM artworks WHERE regexp_full_match(lower(trim(file_hash)), '[0-9a-f]{64}') AND validated)"""


def _objects(spark: SparkSession, d: str) -> DataFrame:
    """Objects of validated works, one original each."""
    key = keys.content_path("objects", F.trim("file_hash"), ".jpg")
    works = read_table(spark, d, "artworks").where("validated")
    return works.select("artwork_id", F.lit("original").alias("role"), key.alias("object_key")).where("object_key is not null")


@register(_OBJECTS + " SELECT artwork_id, object_key FROM artworks LEFT JOIN o ON artwork_id = o.k")
def object_mapping(spark, d):
    works = read_table(spark, d, "artworks").select("artwork_id")
    return relational.validated_join(works, _objects(spark, d).drop("role"), ["artwork_id"], "left", "m:1")


@register(_OBJECTS + " SELECT artwork_id, orig_width, object_key FROM artworks JOIN o ON artwork_id = o.k WHERE role = 'original'")
def original_objects(spark, d):
    works = read_table(spark, d, "artworks").select("artwork_id", "orig_width")
    return works.join(_objects(spark, d).where("role = 'original'").drop("role"), "artwork_id")


@register(
    _OBJECTS
    + """ SELECT artwork_id, CASE WHEN o.k IS NULL THEN 'unpublished' WHEN substr(o.object_key, 22, 64) = lower(trim(file_hash)) THEN 'current' ELSE 'changed' END AS state FROM artworks LEFT JOIN o ON artwork_id = o.k"""
)
def object_checkpoint(spark, d):
    """Whether the published object holds what the work names."""
    works = read_table(spark, d, "artworks").select("artwork_id", F.lower(F.trim("file_hash")).alias("wanted"))
    held = _objects(spark, d).select("artwork_id", F.regexp_extract("object_key", "([0-9a-f]{64})", 1).alias("held"))
    state = F.when(F.col("held").isNull(), "unpublished").when(F.col("held") == F.col("wanted"), "current").otherwise("changed")
    return works.join(held, "artwork_id", "left").select("artwork_id", state.alias("state"))


_VERSIONS = """WITH k AS (SELECT *, lower(trim(candidate_id)) AS candidate, coalesce(nullif(lower(trim(post_cid)), ''), '') AS version FROM candidates WHERE trim(coalesce(candidate_id, '')) <> ''),
f AS (SELECT candidate, version, source FROM k QUALIFY row_number() OVER (PARTITION BY candidate, version ORDER BY received_at NULLS LAST, delivery_id) = 1)"""


def _versioned(spark: SparkSession, d: str) -> DataFrame:
    rows = read_table(spark, d, "candidates").withColumn("candidate", _key("candidate_id")).where("candidate is not null")
    return rows.withColumn("version", F.coalesce(_key("post_cid"), F.lit("")))


@register(_VERSIONS + " SELECT k.delivery_id, f.source AS route FROM k LEFT JOIN f ON k.candidate = f.candidate AND k.version = f.version")
def routes_by_version(spark, d):
    """Each delivery with the route its version took first."""
    rows = _versioned(spark, d)
    first = latest.latest_per_key(rows, ["candidate", "version"], [F.col("received_at").asc_nulls_last(), F.col("delivery_id")])
    return rows.select("delivery_id", "candidate", "version").join(first.select("candidate", "version", F.col("source").alias("route")), ["candidate", "version"], "left").select("delivery_id", "route")


@register(
    _VERSIONS
    + """, h AS (SELECT candidate, version, delivery_id AS decision, received_at AS processed_at FROM k WHERE batch_id > 0)
SELECT k.delivery_id, h.decision FROM k JOIN h ON k.candidate = h.candidate AND k.version = h.version AND h.processed_at >= coalesce(k.created_at, h.processed_at) QUALIFY row_number() OVER (PARTITION BY k.delivery_id ORDER BY h.processed_at DESC, h.decision DESC) = 1"""
)
def last_decision_of_version(spark, d):
    """Later batches taken as decisions: for every delivery the last one on its version that isn't older than the post."""
    rows = _versioned(spark, d)
    history = rows.where("batch_id > 0").select("candidate", "version", F.col("delivery_id").alias("decision"), F.col("received_at").alias("processed_at"))
    joined = rows.select("delivery_id", "candidate", "version", "created_at").join(history, ["candidate", "version"])
    joined = joined.where(F.col("processed_at") >= F.coalesce("created_at", "processed_at"))
    return latest.latest_per_key(joined, ["delivery_id"], [F.col("processed_at").desc(), F.col("decision").desc()]).select("delivery_id", "decision")


@register(
    """WITH a AS (SELECT result_id, row_number() OVER (ORDER BY result_id) AS place FROM search_results), b AS (SELECT result_id AS other, row_number() OVER (ORDER BY score DESC NULLS LAST, result_id) AS place FROM (SELECT result_id, CASE WHEN isnan(score) THEN NULL ELSE score END AS score FROM search_results))
SELECT result_id, other FROM a JOIN b USING (place)"""
)
def paired_by_position(spark, d):
    """Results in order of their number beside the same results in order of their score."""
    s = read_table(spark, d, "search_results")
    scored = s.select(F.col("result_id").alias("other"), F.when(~F.isnan("score"), F.col("score")).alias("score"))
    return relational.zip_strict(s.select("result_id"), scored, ["result_id"], [F.col("score").desc_nulls_last(), "other"]).select("result_id", "other")


@register(
    """SELECT a.artwork_id, s.display_name, count(*)::BIGINT AS vectors FROM artworks a JOIN (SELECT lower(trim(artist_id)) AS k, min(display_name) AS display_name FROM artists GROUP BY 1) s ON lower(trim(a.artist_id)) = s.k
JOIN artwork_embeddings e ON lower(trim(a.artwork_id)) = lower(trim(e.artwork_id)) WHERE a.validated AND e.clip_vector IS NOT NULL GROUP BY 1, 2"""
)
def searchable_works(spark, d):
    """Validated works with their artist and their vectors."""
    works = read_table(spark, d, "artworks").where("validated").select("artwork_id", _key("artwork_id").alias("work"), _key("artist_id").alias("artist"))
    artists = read_table(spark, d, "artists").groupBy(_key("artist_id").alias("artist")).agg(F.min("display_name").alias("display_name"))
    held = read_table(spark, d, "artwork_embeddings").where("clip_vector is not null").select(_key("artwork_id").alias("work"))
    return works.join(artists, "artist").join(held, "work").groupBy("artwork_id", "display_name").agg(F.count("*").alias("vectors"))


@register(
    """WITH r AS (SELECT lower(trim(artwork_id)) AS k, review_status FROM search_results QUALIFY row_number() OVER (PARTITION BY lower(trim(artwork_id)) ORDER BY searched_at DESC, result_id DESC) = 1),
e AS (SELECT lower(trim(artwork_id)) AS k, max(model_version_clip) AS indexed FROM artwork_embeddings GROUP BY 1)
SELECT artwork_id, r.review_status AS decision, e.indexed FROM artworks LEFT JOIN r ON lower(trim(artwork_id)) = r.k LEFT JOIN e ON lower(trim(artwork_id)) = e.k"""
)
def decision_and_index_state(spark, d):
    works = read_table(spark, d, "artworks").select("artwork_id", _key("artwork_id").alias("k"))
    last = latest.latest_per_key(read_table(spark, d, "search_results").withColumn("k", _key("artwork_id")), ["k"], [F.col("searched_at").desc(), F.col("result_id").desc()])
    index = read_table(spark, d, "artwork_embeddings").groupBy(_key("artwork_id").alias("k")).agg(F.max("model_version_clip").alias("indexed"))
    return works.join(last.select("k", F.col("review_status").alias("decision")), "k", "left").join(index, "k", "left").select("artwork_id", "decision", "indexed")


@register("SELECT artwork_id, file_hash FROM artworks")
def sync_applied(spark, d):
    """A state of which every third row is missing, every fifth outdated and some superfluous, brought to what is wanted."""
    wanted = read_table(spark, d, "artworks").select("artwork_id", "file_hash")
    turn = F.pmod(F.xxhash64("artwork_id"), F.lit(15))
    state = wanted.where(turn % 3 != 0).withColumn("file_hash", F.when(turn % 5 == 0, "old").otherwise(F.col("file_hash")))
    state = state.unionByName(wanted.where(turn == 1).select(F.concat(F.lit("gone-"), "artwork_id").alias("artwork_id"), "file_hash"))
    return relational.apply_sync(state, wanted, relational.sync_plan(wanted, state, "artwork_id", "file_hash"), "artwork_id")


# ---------------------------------------------------------------- measures

@register(
    _JUDGED
    + """, b AS (SELECT retrieval_mode, sum(n)::BIGINT AS judgments, count(*)::BIGINT AS query_count, sum(q.r)::BIGINT AS relevant, round(sum(n) / sum(expected), 9)::DOUBLE AS annotation_coverage, round(sum(q.r) / sum(n), 9)::DOUBLE AS judged_precision,
  round(avg(rr), 9)::DOUBLE AS mrr, round(avg(ap), 9)::DOUBLE AS map, round(avg(coalesce(dcg / ideal, 0)), 9)::DOUBLE AS ndcg FROM q LEFT JOIN i ON q.r = i.r GROUP BY 1),
y AS (SELECT retrieval_mode, count_if(NOT relevant)::BIGINT AS not_relevant, round(avg(score) FILTER (WHERE relevant), 9) AS mean_relevant_score, round(avg(score) FILTER (WHERE NOT relevant), 9) AS mean_not_relevant_score FROM j GROUP BY 1)
SELECT b.*, not_relevant, mean_relevant_score, mean_not_relevant_score, relevant AS true_positive, not_relevant AS false_positive, NULL::BIGINT AS true_negative, NULL::BIGINT AS false_negative FROM b JOIN y USING (retrieval_mode)"""
)
def ir_report(spark, d):
    return evaluation.mode_report(_judged(spark, d), ["retrieval_mode"], "search_id")


@register(
    _JUDGED + "SELECT retrieval_mode, count(*)::BIGINT AS support, count_if(coalesce(score >= 0.75, FALSE))::BIGINT AS accepted, round(count_if(coalesce(score >= 0.75, FALSE)) / count(*), 9)::DOUBLE AS rate FROM j WHERE NOT relevant GROUP BY 1"
)
def false_accepts(spark, d):
    return evaluation.false_accepts(_judged(spark, d), "retrieval_mode", F.col("relevant"), F.col("score") >= 0.75)


@register("SELECT source, review_status, count(*)::BIGINT AS n FROM (SELECT retrieval_mode AS source, review_status FROM search_results UNION ALL SELECT 'artworks', review_status FROM artworks) GROUP BY 1, 2")
def pipeline_counters(spark, d):
    """Outcomes counted per run and added up."""
    runs = [read_table(spark, d, "search_results").select(F.col("retrieval_mode").alias("source"), "review_status"), read_table(spark, d, "artworks").select(F.lit("artworks").alias("source"), "review_status")]
    return relational.merge_counters([r.groupBy("source", "review_status").agg(F.count("*").alias("n")) for r in runs], ["source", "review_status"])


# ---------------------------------------------------------------- ordered reports

@register(
    _VERSIONS.split(",\nf AS")[0]
    + """, l AS (SELECT * FROM k QUALIFY row_number() OVER (PARTITION BY candidate ORDER BY received_at DESC NULLS LAST, delivery_id DESC) = 1)
SELECT candidate, row_number() OVER (ORDER BY created_at DESC NULLS LAST, received_at DESC NULLS LAST, candidate DESC)::INTEGER AS place FROM l"""
)
def gallery_order(spark, d):
    """The latest row of every candidate in the order of the gallery."""
    last = latest.latest_per_key(_versioned(spark, d), ["candidate"], [F.col("received_at").desc_nulls_last(), F.col("delivery_id").desc()])
    rows = last.select("candidate", "created_at", "received_at")
    return relational.placed(rows, [F.col("created_at").desc_nulls_last(), F.col("received_at").desc_nulls_last(), F.col("candidate").desc()]).select("candidate", "place")


@register(
    """WITH p AS (SELECT author_did, count(*) AS posts, count_if(is_repost) / count(*) AS share, count_if(is_quote_post) AS quotes FROM candidates WHERE author_did IS NOT NULL GROUP BY 1)
SELECT author_did, posts::BIGINT AS posts, round(share, 9)::DOUBLE AS share, row_number() OVER (ORDER BY CASE WHEN quotes = 0 THEN 0 ELSE 1 END, round(share, 9), posts DESC, quotes, author_did)::INTEGER AS place FROM p WHERE posts >= 3 QUALIFY place <= 10"""
)
def pilot_roster(spark, d):
    """The ten accounts that come first by five keys."""
    posts = read_table(spark, d, "candidates").where("author_did is not null").groupBy("author_did")
    per = posts.agg(F.count("*").alias("posts"), F.round(F.avg(F.col("is_repost").cast("int")), 9).alias("share"), F.count_if("is_quote_post").alias("quotes")).where("posts >= 3")
    order = [F.when(F.col("quotes") == 0, 0).otherwise(1), F.col("share"), F.col("posts").desc(), F.col("quotes"), F.col("author_did")]
    few = per.orderBy(*order).limit(10)
    return few.withColumn("place", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*order))).select("author_did", "posts", "share", "place")


@register("SELECT result_id, retrieval_mode, score FROM search_results WHERE result_id > 40 ORDER BY result_id LIMIT 25")
def scroll_page(spark, d):
    return vector_search.scroll(read_table(spark, d, "search_results").select("result_id", "retrieval_mode", "score"), "result_id", 40, 25)


@register(
    """WITH x AS (SELECT delivery_id, list_distinct(list_transform(list_concat(content_labels, author_labels), lambda v: lower(trim(v)))) AS ls, declared_width::DOUBLE AS w, declared_height::DOUBLE AS h FROM candidates)
SELECT delivery_id, printf('%.8f', w / 1000) AS width_text, array_to_string(list_sort(list_filter(ls, lambda v: v <> '')), '|') AS reasons,
  CASE WHEN w >= h THEN 'width|height' ELSE 'height|width' END AS sides FROM x WHERE w IS NOT NULL AND h IS NOT NULL"""
)
def review_rows(spark, d):
    """Numbers in a fixed format, reasons joined to one text, and an array sorted by a field of its entries."""
    labels = F.array_distinct(F.transform(F.concat("content_labels", "author_labels"), lambda x: F.lower(F.trim(x))))
    reasons = F.array_join(F.array_sort(F.filter(labels, lambda x: x != "")), "|")
    sides = F.array(F.struct(F.lit("height").alias("name"), F.col("declared_height").alias("n")), F.struct(F.lit("width").alias("name"), F.col("declared_width").alias("n")))
    larger = lambda a, b: F.when(a["n"] > b["n"], -1).when(a["n"] < b["n"], 1).when(a["name"] > b["name"], -1).when(a["name"] < b["name"], 1).otherwise(0)
    ordered = F.array_join(F.transform(F.array_sort(sides, larger), lambda x: x["name"]), "|")
    rows = read_table(spark, d, "candidates").where("declared_width is not null and declared_height is not null")
    return rows.select("delivery_id", F.format_string("%.8f", F.col("declared_width") / 1000).alias("width_text"), reasons.alias("reasons"), ordered.alias("sides"))


@register("SELECT artwork_id, lpad(lower(to_hex(('0x' || lower(trim(phash)))::UBIGINT)), 16, '0') AS hash FROM artworks WHERE regexp_full_match(lower(trim(phash)), '[0-9a-f]{1,16}')")
def near_duplicate_members(spark, d):
    """Which works have each of the hashes that ``near_duplicate_hamming`` pairs."""
    return near_duplicates.hash_members(read_table(spark, d, "artworks"), "artwork_id", "phash")


QUERIES, ORACLES = register.queries, register.oracles
