"""Sources, sinks, states and scalar functions, each shown by what comes back from it."""

from __future__ import annotations

import json

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F

from pictorium.functions import geometry, keys, numeric, text, vectors
from pictorium.operators import inference, moderation, sampling, snapshots, vector_search
from pictorium.plans.register import Register
from pictorium.runtime import blank_to_null, fresh_path, read_table, written
from pictorium.sources import readers, writers
from pictorium.streaming import intake

register = Register()

# ---------------------------------------------------------------- logs and tables

_LOG = "delivery_id bigint, candidate_id string, post_cid string, is_repost boolean, langs array<string>"


def _logged(spark: SparkSession, d: str) -> str:
    path = fresh_path(spark, "log")
    read_table(spark, d, "candidates").select("delivery_id", "candidate_id", "post_cid", "is_repost", "langs").write.json(path)
    return path


@register("SELECT delivery_id, candidate_id, post_cid, len(langs)::INTEGER AS lang_count FROM candidates")
def strict_log(spark, d):
    return readers.read_json_log(spark, _logged(spark, d), _LOG).select("delivery_id", "candidate_id", "post_cid", F.size("langs").alias("lang_count"))


def _damaged(spark: SparkSession, d: str) -> str:
    """A log of which every tenth line is cut off."""
    path = fresh_path(spark, "damaged")
    line = F.to_json(F.struct("delivery_id", "candidate_id"))
    rows = read_table(spark, d, "candidates").select(F.when(F.col("delivery_id") % 10 == 0, F.substring(line, 1, 12)).otherwise(line).alias("value"))
    rows.write.text(path)
    return path


@register("SELECT delivery_id, candidate_id FROM candidates WHERE delivery_id % 10 <> 0")
def lenient_log(spark, d):
    rows = readers.read_json_log(spark, _damaged(spark, d), "delivery_id bigint, candidate_id string", strict=False)
    return rows.where("delivery_id is not null")


@register("SELECT count(*)::BIGINT AS malformed FROM candidates WHERE delivery_id % 10 = 0")
def malformed_lines(spark, d):
    return readers.malformed_lines(spark, _damaged(spark, d), "delivery_id bigint, candidate_id string").agg(F.count("*").alias("malformed"))


@register("SELECT DISTINCT candidate_id FROM candidates WHERE is_repost")
def decided_ids(spark, d):
    return readers.distinct_ids(readers.read_json_log(spark, _logged(spark, d), _LOG), "candidate_id", "is_repost")


@register("SELECT event_id, (props->>'$.k')::BIGINT AS k FROM events")
def struct_field(spark, d):
    rows = read_table(spark, d, "events").select("event_id", F.from_json("props", "k bigint").alias("p"))
    return rows.select("event_id", "p.k")


@register("SELECT source, count(*)::BIGINT AS n FROM candidates GROUP BY 1")
def partitioned_table(spark, d):
    """Written in a folder per source and read by pattern, with a guard on the columns."""
    path = writers.write_table(read_table(spark, d, "candidates").select("delivery_id", "batch_id", "source"), fresh_path(spark, "table"), ["batch_id"])
    return readers.read_tables(spark, f"{path}/batch_id=*", ["delivery_id", "source"]).groupBy("source").agg(F.count("*").alias("n"))


@register("SELECT source, count(*)::BIGINT AS n FROM documents GROUP BY 1")
def ordered_report(spark, d):
    counts = read_table(spark, d, "documents").groupBy("source").agg(F.count("*").alias("n"))
    return spark.read.schema(counts.schema).parquet(writers.write_ordered(counts, fresh_path(spark, "report"), ["source"]))


@register("SELECT artwork_id, is_sfw FROM artworks WHERE FALSE")
def empty_table(spark, d):
    return readers.read_or_empty(spark, fresh_path(spark, "nowhere"), "artwork_id string, is_sfw boolean")


@register("SELECT DISTINCT lower(trim(candidate_id)) AS candidate, coalesce(nullif(lower(trim(post_cid)), ''), '') AS version FROM candidates WHERE trim(coalesce(candidate_id, '')) <> ''")
def appended_once(spark, d):
    """A log appended to by two overlapping runs; every version is held once."""
    rows = read_table(spark, d, "candidates").select("delivery_id", blank_to_null(F.col("candidate_id")).alias("candidate"), F.coalesce(blank_to_null(F.col("post_cid")), F.lit("")).alias("version"))
    rows, path = rows.where("candidate is not null"), fresh_path(spark, "versions")
    for part in (rows.where("delivery_id % 3 <> 0"), rows.where("delivery_id % 3 <> 1")):
        writers.append_new(part.select("candidate", "version"), path, ["candidate", "version"])
    return spark.read.parquet(path)


@register("SELECT DISTINCT search_id, artwork_id, review_status FROM search_results")
def appended_labels(spark, d):
    """Labels whose content is already held are passed over."""
    rows, path = read_table(spark, d, "search_results").select("search_id", "artwork_id", "review_status"), fresh_path(spark, "labels")
    for _ in range(2):
        writers.append_changed(rows, path, ["search_id", "artwork_id", "review_status"])
    return spark.read.parquet(path).drop("content_hash")


@register("SELECT artwork_id FROM artworks WHERE validated")
def replaced_table(spark, d):
    works, path = read_table(spark, d, "artworks"), fresh_path(spark, "state")
    writers.replace_table(works.select("artwork_id", "validated"), path)
    writers.replace_table(spark.read.parquet(path).where("validated").select("artwork_id"), path)
    return spark.read.parquet(path)


@register("SELECT artist_id, display_name FROM artists")
def review_sheet(spark, d):
    """Written as a sheet and read again; rows without both cells would be left out."""
    path = writers.write_csv(read_table(spark, d, "artists").select("artist_id", "display_name", "notes"), fresh_path(spark, "sheet"))
    rows, _ = readers.read_review_csv(spark, path, ["artist_id", "display_name", "notes"], ["artist_id", "display_name"])
    return rows.select("artist_id", "display_name")


@register("SELECT DISTINCT trim(display_name) AS name FROM artists")
def name_list(spark, d):
    names = read_table(spark, d, "artists").select(F.trim("display_name").alias("name")).distinct()
    return readers.read_list(spark, writers.write_roster(names, "name", fresh_path(spark, "roster"), "artists"))


@register("SELECT n_nationkey, n_name FROM nation")
def json_report(spark, d):
    path = writers.write_json_report(read_table(spark, d, "nation").select("n_nationkey", "n_name"), fresh_path(spark, "report"))
    return spark.read.schema("n_nationkey bigint, n_name string").option("multiLine", True).json(path)


@register("SELECT delivery_id, local_path FROM candidates")
def json_lines(spark, d):
    path = writers.write_json_lines(read_table(spark, d, "candidates").select("delivery_id", "local_path"), fresh_path(spark, "lines"))
    return spark.read.schema("delivery_id bigint, local_path string").json(path)


@register("SELECT n_nationkey, n_name FROM nation")
def gallery_page(spark, d):
    """The payload that a written page embeds."""
    rows = read_table(spark, d, "nation").select(F.to_json(F.struct("n_nationkey", "n_name")).alias("j"))
    path = writers.write_gallery(rows, "j", fresh_path(spark, "page"), "Nations")
    page = spark.read.text(path, wholetext=True)
    payload = F.from_json(F.regexp_extract("value", r'(?s)id="payload">(.*?)</script>', 1), "array<struct<n_nationkey:bigint,n_name:string>>")
    return page.select(F.explode(payload).alias("p")).select("p.*")


@register("SELECT r_name, sha256(r_name) AS digest, TRUE AS stays FROM region")
def stored_objects(spark, d):
    """Five small objects put twice, read, and one of them deleted and put again."""
    store = writers.ObjectStore(spark, fresh_path(spark, "objects"))
    out = []
    for (name,) in read_table(spark, d, "region").select("r_name").collect():
        path = store.put("names", name.encode())
        again = store.put("names", name.encode()) == path and store.get(path) == name.encode()
        gone = store.delete(path) and not store.exists(path)
        out.append((name, path.rsplit("/", 1)[1], again and gone and store.put("names", name.encode()) == path))
    return spark.createDataFrame(out, "r_name string, digest string, stays boolean")


@register("SELECT r_name, sha256(r_name) AS digest FROM region")
def published_bundle(spark, d):
    store = writers.ObjectStore(spark, fresh_path(spark, "objects"))
    names = [r[0] for r in read_table(spark, d, "region").select("r_name").collect()]
    bundle = json.loads(store.get(writers.publish_bundle(store, {n: n.encode() for n in names})["path"]))
    return spark.createDataFrame([(n, a["sha256"]) for n, a in bundle["artifacts"].items()], "r_name string, digest string")


@register("SELECT artwork_id FROM artworks WHERE demo_eligible")
def promoted_version(spark, d):
    """The pointer names the second of two versions."""
    works, table = read_table(spark, d, "artworks"), writers.VersionedTable(spark, fresh_path(spark, "versions"))
    for rows, bundle in ((works, "m1"), (works.where("demo_eligible"), "m2")):
        table.promote(table.write(rows.select("artwork_id"), bundle), bundle)
    return table.current()


@register("SELECT artist_id FROM artists")
def archived_and_restored(spark, d):
    path, old = fresh_path(spark, "data"), fresh_path(spark, "archive")
    read_table(spark, d, "artists").select("artist_id").write.parquet(path)
    return spark.read.parquet(writers.restore(spark, writers.archive(spark, path, old, "2026-01-01")))


@register("SELECT * FROM (VALUES ('r1', 'start', '{\"rows\": 3}'), ('r1', 'end', '{}'), ('r2', 'start', '{}')) t(run, event, details)")
def run_events(spark, d):
    path = fresh_path(spark, "runs")
    for run, event, details in (("r1", "start", {"rows": 3}), ("r1", "end", None), ("r2", "start", None)):
        writers.log_run(spark, path, run, event, details)
    return spark.read.parquet(path).select("run", "event", "details")


@register("SELECT * FROM (VALUES ('spark.hadoop.fs.s3a.endpoint', 'http://store:9000'), ('spark.hadoop.fs.s3a.endpoint.region', 'eu'), ('spark.hadoop.fs.s3a.path.style.access', 'true')) t(name, value)")
def store_settings(spark, d):
    return spark.createDataFrame(sorted(readers.s3_settings("http://store:9000", "eu", True).items()), "name string, value string")


# ---------------------------------------------------------------- states

@register("SELECT DISTINCT author_did FROM candidates WHERE author_did IS NOT NULL AND (hash(author_did) IS NOT NULL) AND right(author_did, 1) NOT IN ('0', '1', '2', '3', '4', '5', '6', '7')")
def pending_actors(spark, d):
    """Actors not yet done under these settings; others' work doesn't count."""
    actors = read_table(spark, d, "candidates").where("author_did is not null").select("author_did").distinct()
    path = fresh_path(spark, "done")
    store, other = intake.CheckpointStore(spark, path, {"pages": 3}), intake.CheckpointStore(spark, path, {"pages": 9})
    other.mark(actors, "author_did")
    for _ in range(2):
        store.mark(actors.where(F.col("author_did").rlike("[0-7]$")), "author_did")
    return store.pending(actors, "author_did")


@register(
    """SELECT artwork_id FROM artworks a WHERE NOT EXISTS (SELECT 1 FROM artwork_embeddings e WHERE e.artwork_id = a.artwork_id AND e.model_version_clip = '2026.2' AND e.clip_vector IS NOT NULL)"""
)
def unfinished_work(spark, d):
    """Work without a result of the current model; a result without a vector is an error and counts as none."""
    done = read_table(spark, d, "artwork_embeddings").select("artwork_id", "model_version_clip", F.when(F.col("clip_vector").isNull(), "no vector").alias("error"))
    return intake.completed_filter(read_table(spark, d, "artworks").select("artwork_id"), done, ["artwork_id"], {"model_version_clip": "2026.2"})


@register("SELECT round(count_if(phash IS NULL) / count(*), 9)::DOUBLE AS share FROM artworks")
def failure_share(spark, d):
    share = intake.error_budget(read_table(spark, d, "artworks").select(F.col("phash").isNotNull().alias("ok")), "ok", 0.9)
    return spark.createDataFrame([(round(share, 9),)], "share double")


class _Refuses(inference.HashEmbedding):
    """Fails on every batch that holds a content with a 7."""

    def embed(self, contents: list[bytes]) -> np.ndarray:
        if any(b"7" in c for c in contents):
            raise ValueError("a seven")
        return super().embed(contents)


@register("SELECT artwork_id, CASE WHEN contains(raw_path, '7') THEN 'ValueError: a seven' END AS error, CASE WHEN NOT contains(raw_path, '7') THEN 8 END::INTEGER AS dims FROM artworks")
def isolated_failures(spark, d):
    """A failing batch costs only the rows at fault."""
    rows = inference.embed_rows(read_table(spark, d, "artworks"), "artwork_id", "raw_path", _Refuses(8), at_once=4)
    return rows.select("artwork_id", "error", F.when(F.col("vector").isNotNull(), F.size("vector")).alias("dims"))


@register("SELECT DISTINCT sha256(raw_path) AS content_hash, 8::INTEGER AS dims FROM artworks")
def feature_cache(spark, d):
    """Put twice, with a damaged row that isn't kept."""
    provider = inference.HashEmbedding(8)
    works = read_table(spark, d, "artworks").select(F.sha2("raw_path", 256).alias("content_hash"), "raw_path")
    rows = inference.embed_rows(works, "content_hash", "raw_path", provider).select("content_hash", "vector")
    rows = rows.unionByName(spark.createDataFrame([("bad", [1.0, float("nan")] * 4)], "content_hash string, vector array<float>"))
    cache = inference.FeatureCache(spark, fresh_path(spark, "cache"), provider)
    cache.put(rows)
    cache.put(rows)
    return cache.get().select("content_hash", F.size("vector").alias("dims"))


# ---------------------------------------------------------------- feed items

@register(
    """SELECT delivery_id, sha256(post_uri || '|0') AS candidate_id, post_cid, author_did, alt_text, declared_width, is_repost, is_quote_post, quoted_author_did,
  array_to_string(list_sort(list_distinct(list_filter(list_transform(content_labels, lambda v: lower(trim(v))), lambda v: v <> ''))), '|') AS labels
FROM (SELECT *, CASE WHEN is_quote_post THEN 'did:quoted' END AS q FROM candidates) WHERE post_uri IS NOT NULL"""
    .replace("quoted_author_did,", "q AS quoted_author_did,").replace("alt_text, d", "coalesce(alt_text, '') AS alt_text, d")
)
def feed_items(spark, d):
    """Candidates put back into feed items of one image each and flattened again."""
    c = read_table(spark, d, "candidates").where("post_uri is not null")
    label = lambda column: F.transform(column, lambda v: F.struct(v.alias("val"), F.lit(False).alias("neg")))
    image = F.struct(
        F.col("thumbnail_url").alias("thumb"), F.col("fullsize_url").alias("fullsize"), F.col("alt_text").alias("alt"), F.struct(F.col("declared_width").alias("width"), F.col("declared_height").alias("height")).alias("aspectRatio")
    )
    quoted = F.when(F.col("is_quote_post"), F.struct(F.struct(F.lit("did:quoted").alias("did")).alias("author")))
    # The delivery travels as the handle, so that the rows can be told apart again.
    author = F.struct(F.col("author_did").alias("did"), F.col("delivery_id").cast("string").alias("handle"), label("author_labels").alias("labels"))
    embed = F.struct(F.array(image).alias("images"), quoted.alias("record"))
    post = F.struct(F.col("post_uri").alias("uri"), F.col("post_cid").alias("cid"), label("content_labels").alias("labels"), author.alias("author"), F.struct(F.col("post_text").alias("text"), "langs").alias("record"), embed.alias("embed"))
    reason = F.when(F.col("is_repost"), F.struct(F.lit("feed#reasonRepost").alias("$type")))
    item = F.to_json(F.struct(post.alias("post"), reason.alias("reason")))
    flat = moderation.flatten_feed(c.select(F.from_json(item, moderation.FEED_SCHEMA).alias("i")).select("i.*"), public_safe=False)
    labels = F.array_join(F.array_sort("content_labels"), "|")
    return flat.select(F.col("author_handle").cast("bigint").alias("delivery_id"), "candidate_id", "post_cid", "author_did", "alt_text", "declared_width", "is_repost", "is_quote_post", "quoted_author_did", labels.alias("labels"))


# ---------------------------------------------------------------- scalar functions

@register("SELECT delivery_id, trim(regexp_replace(lower(post_text), '[\\s]+', ' ', 'g')) AS plain FROM candidates WHERE regexp_full_match(post_text, '[\\x00-\\x7F]*')")
def normalised_text(spark, d):
    """Of texts in ASCII, which NFKC leaves as they are; SQL has no NFKC for the rest."""
    rows = read_table(spark, d, "candidates").where(F.col("post_text").rlike(r"^[\x00-\x7F]*$"))
    return rows.select("delivery_id", text.normalize_text(F.col("post_text")).alias("plain"))


@register("SELECT delivery_id, CASE WHEN regexp_matches(post_text, '^[=+\\-@]') THEN '''' || post_text ELSE post_text END AS cell FROM candidates")
def spreadsheet_cells(spark, d):
    return read_table(spark, d, "candidates").select("delivery_id", text.spreadsheet_safe(F.col("post_text")).alias("cell"))


@register(
    """SELECT delivery_id, CASE WHEN regexp_full_match(candidate_id, '[A-Za-z0-9._-]{1,128}') THEN candidate_id ELSE sha256(candidate_id) END || CASE WHEN coalesce(post_cid, '') <> '' THEN '-' || substr(sha256(post_cid), 1, 12) ELSE '' END || '.jpg' AS file_name FROM candidates"""
)
def routed_names(spark, d):
    return read_table(spark, d, "candidates").select("delivery_id", keys.routed_filename(F.col("candidate_id"), F.col("post_cid")).alias("file_name"))


@register("SELECT event_id, sha256('{\"k\":' || (props->>'$.k') || '}') AS digest FROM events")
def stable_hashes(spark, d):
    return read_table(spark, d, "events").select("event_id", keys.stable_json_hash(F.col("props")).alias("digest"))


@register("SELECT result_id, CASE WHEN score IS NULL THEN NULL WHEN isnan(score) THEN 0 ELSE least(greatest(score, 0.4), 0.7) END::DOUBLE AS value FROM search_results")
def clamped_scores(spark, d):
    return read_table(spark, d, "search_results").select("result_id", numeric.clamp(F.col("score"), 0.4, 0.7).alias("value"))


@register("SELECT result_id, least(0.5::DOUBLE * pow(2::DOUBLE, result_rank), 60)::DOUBLE AS seconds FROM search_results")
def retry_delays(spark, d):
    return read_table(spark, d, "search_results").select("result_id", numeric.retry_delay(F.col("result_rank"), 0.5, 60.0).alias("seconds"))


@register("SELECT event_id, CASE event_type WHEN 'error' THEN 'error.failed' WHEN 'purchase' THEN 'error.paid' ELSE 'error.unknown' END AS code FROM events")
def reason_codes(spark, d):
    message = F.concat("event_type", F.lit(": "), F.col("value").cast("string"))
    return read_table(spark, d, "events").select("event_id", snapshots.reason_codes(F.coalesce(message, F.concat("event_type", F.lit(": none"))), {"error": "error.failed", "purchase": "error.paid"}).alias("code"))


@register("SELECT artwork_id, 10.0::DOUBLE AS x, 20.0::DOUBLE AS y FROM artworks WHERE orig_width > 0 AND orig_height > 0")
def coordinates_and_back(spark, d):
    """A point mapped to the standard image and back again."""
    rows = geometry.with_transform_plan(read_table(spark, d, "artworks"), "orig_width", "orig_height", "p").where("p is not null")
    sx, sy = geometry.to_standard(F.lit(10.0), F.lit(20.0), F.col("p"))
    x, y = geometry.to_original(F.col("sx"), F.col("sy"), F.col("p"))
    return rows.withColumns({"sx": sx, "sy": sy}).select("artwork_id", F.round(x, 6).alias("x"), F.round(y, 6).alias("y"))


@register(
    """WITH s AS (SELECT vec_id, list_transform(embedding::DOUBLE[], lambda x, i: CASE WHEN i = 1 THEN x + 0.5 ELSE x END) AS v FROM embeddings)
SELECT vec_id, round(v[1] / sqrt(list_dot_product(v, v)), 9) AS first, round(v[2] / sqrt(list_dot_product(v, v)), 9) AS second FROM s"""
)
def shifted_vectors(spark, d):
    direction = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda k: F.when(k == 0, 1.0).otherwise(0.0))
    rows = read_table(spark, d, "embeddings").select("vec_id", vectors.shifted(F.col("embedding"), direction, 0.5).alias("v"))
    return rows.select("vec_id", F.round(F.col("v")[0], 9).alias("first"), F.round(F.col("v")[1], 9).alias("second"))


@register("SELECT vec_id, round(1 / (1 + exp(-(10 * embedding[1]::DOUBLE - 1))), 9) AS first, round(1 / (1 + exp(-(10 * embedding[2]::DOUBLE - 1))), 9) AS second FROM embeddings")
def pair_scores(spark, d):
    """Sigmoids of scaled inner products; unit vectors stand for two prompts."""
    prompts = [[float(k == n) for k in range(64)] for n in (0, 1)]
    rows = read_table(spark, d, "embeddings").select("vec_id", inference.pair_logits(F.col("embedding"), prompts, 10.0, -1.0).alias("z"))
    return rows.select("vec_id", F.round(numeric.sigmoid(F.col("z")[0]), 9).alias("first"), F.round(numeric.sigmoid(F.col("z")[1]), 9).alias("second"))


@register(
    """SELECT axis, dim, round(value, 9) AS value FROM (VALUES (0, 0, sqrt(0.5)), (0, 1, sqrt(0.5)), (0, 2, 0.0), (1, 0, sqrt(1.0 / 6)), (1, 1, -sqrt(1.0 / 6)), (1, 2, sqrt(2.0 / 3)), (2, 0, -sqrt(1.0 / 3)), (2, 1, sqrt(1.0 / 3)), (2, 2, sqrt(1.0 / 3))) t(axis, dim, value)"""
)
def orthogonal_axes(spark, d):
    axes = vector_search.gram_schmidt([[1.0, 1.0, 0.0], [1.0, 0.0, 1.0], [0.0, 1.0, 1.0]])
    return spark.createDataFrame([(a, k, round(float(v), 9)) for a, axis in enumerate(axes) for k, v in enumerate(axis)], "axis int, dim int, value double")


@register("SELECT artwork_id FROM artworks ORDER BY sha256('7|' || artwork_id), artwork_id LIMIT 20")
def hashed_sample(spark, d):
    return sampling.sample(read_table(spark, d, "artworks").select("artwork_id"), "artwork_id", 20, seed=7)


@register("SELECT retrieval_mode, count(*)::BIGINT AS n, count(DISTINCT digest)::BIGINT AS digests FROM (SELECT retrieval_mode, 1 AS digest FROM search_results) GROUP BY 1")
def list_fingerprints(spark, d):
    """A digest per list doesn't depend on the order of the rows."""
    s = read_table(spark, d, "search_results").select("retrieval_mode", "artwork_id", "result_id")
    both = s.withColumn("way", F.lit(1)).unionByName(s.repartition(7).orderBy(F.desc("artwork_id")).withColumn("way", F.lit(2)))
    per = both.groupBy("retrieval_mode", "way").agg(keys.ordered_fingerprint(F.col("artwork_id"), F.col("result_id")).alias("digest"), F.count("*").alias("n"))
    return written(per, "fingerprints").groupBy("retrieval_mode").agg(F.max("n").alias("n"), F.countDistinct("digest").alias("digests"))


QUERIES, ORACLES = register.queries, register.oracles
