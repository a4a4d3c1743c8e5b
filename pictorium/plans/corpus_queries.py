"""Reconciliation, manifest, audit, differences and text over the domain tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from pictorium.functions import geometry, keys, text, times, web
from pictorium.operators import audit, latest, manifest, moderation, near_duplicates, ranks, relational, sampling, snapshots
from pictorium.plans.register import Register
from pictorium.runtime import blank_to_null, read_table

register = Register()

# ---------------------------------------------------------------- event log to current state

_EVENTS = """
WITH e AS (SELECT event_id, ts, user_id, event_type, value, (props->>'$.k')::BIGINT AS version FROM events),
v AS (SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY user_id, version ORDER BY ts DESC NULLS LAST, event_id DESC) = 1),
c AS (SELECT * FROM v QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC NULLS LAST, version DESC NULLS LAST, event_id DESC) = 1)
"""


def _versions(spark: SparkSession, d: str) -> DataFrame:
    events = read_table(spark, d, "events").withColumn("version", F.get_json_object("props", "$.k").cast("bigint"))
    return latest.latest_per_key(events, ["user_id", "version"], [F.col("ts").desc_nulls_last(), F.col("event_id").desc()])


def _current(spark: SparkSession, d: str) -> DataFrame:
    return latest.current_rows(_versions(spark, d), "user_id", "version", "ts", "event_id")


@register(_EVENTS + "SELECT user_id, version, event_id, event_type FROM v")
def reconcile_source_versions(spark, d):
    return _versions(spark, d).select("user_id", "version", "event_id", "event_type")


@register(_EVENTS + "SELECT user_id, version, event_id, event_type FROM c")
def reconcile_current(spark, d):
    return _current(spark, d).select("user_id", "version", "event_id", "event_type")


@register(
    _EVENTS
    + """SELECT event_type AS decision, count(*)::BIGINT AS image_count, count(DISTINCT user_id)::BIGINT AS artist_count,
  count_if(event_type = 'purchase')::BIGINT AS search_eligible_count, round(avg(value), 9) AS mean_value, quantile_disc(value, 0.95)::DOUBLE AS p95_value
FROM v GROUP BY 1"""
)
def decision_summary(spark, d):
    return audit.decision_summary(_versions(spark, d), "event_type", "user_id", "value", F.col("event_type") == "purchase")


@register(_EVENTS + "SELECT event_type AS decision, TRUE AS artists_close FROM v GROUP BY 1")
def decision_summary_approximate(spark, d):
    rough = audit.decision_summary(_versions(spark, d), "event_type", "user_id", "value", F.lit(True), exact=False)
    exact = _versions(spark, d).groupBy(F.col("event_type").alias("decision")).agg(F.countDistinct("user_id").alias("n"))
    return rough.join(exact, "decision").select("decision", (F.abs(F.col("artist_count") - F.col("n")) <= 0.1 * F.col("n")).alias("artists_close"))


@register(
    """SELECT event_type, list_sort(list(value))[round(0.95 * (count(value) - 1))::INT + 1]::DOUBLE AS p95_nearest, quantile_disc(value, 0.95)::DOUBLE AS p95_disc,
  round(quantile_cont(value, 0.95), 9)::DOUBLE AS p95_linear FROM events GROUP BY 1"""
)
def percentile_flavours(spark, d):
    events = read_table(spark, d, "events")
    low, high = ranks.between(0.95)
    found = ranks.values_at(events, ["event_type"], "value", 0.95, {"p95_nearest": ranks.nearest(0.95), "p95_disc": ranks.discrete(0.95), "low": low, "high": high})
    sizes = events.groupBy("event_type").agg((F.lit(0.95) * (F.count("value") - 1)).alias("at"))
    part = F.col("at") - F.floor("at")
    linear = F.col("low") * (1 - part) + F.col("high") * part
    return ranks.joined(sizes, found, ["event_type"], ["p95_nearest", "p95_disc", "low", "high"]).select("event_type", "p95_nearest", "p95_disc", F.round(linear, 9).alias("p95_linear"))


# ---------------------------------------------------------------- manifest

_MANIFEST = """
WITH k AS (
  SELECT *, lower(trim(candidate_id)) AS candidate, coalesce(nullif(lower(trim(post_cid)), ''), '') AS version FROM candidates WHERE trim(coalesce(candidate_id, '')) <> ''
), l AS (SELECT * FROM k QUALIFY row_number() OVER (PARTITION BY candidate, version ORDER BY received_at DESC NULLS LAST, delivery_id DESC) = 1),
w AS (
  SELECT lower(trim(source_id)) AS candidate, artwork_id, lower(trim(artist_id)) AS artist, is_sfw, validated, date_added FROM artworks WHERE trim(coalesce(source_id, '')) <> ''
  QUALIFY row_number() OVER (PARTITION BY lower(trim(source_id)) ORDER BY date_added DESC NULLS LAST, artwork_id) = 1
), a AS (SELECT lower(trim(artist_id)) AS artist, min(display_name) AS display_name FROM artists GROUP BY 1),
m AS (
  SELECT l.candidate, l.version, l.author_did, l.received_at, l.declared_width, l.source, w.artwork_id, w.artist, a.display_name, w.artwork_id IS NOT NULL AS is_linked,
    w.artwork_id IS NOT NULL AND coalesce(w.validated, FALSE) AS is_search_eligible
  FROM l LEFT JOIN w USING (candidate) LEFT JOIN a ON w.artist = a.artist
)
"""


def _manifest(spark: SparkSession, d: str) -> DataFrame:
    return manifest.manifest(*(read_table(spark, d, t) for t in ("candidates", "artworks", "artists")))


@register(_MANIFEST + "SELECT candidate, version, artwork_id, artist, display_name, is_linked, is_search_eligible, 1::INTEGER AS manifest_version FROM m")
def manifest_rows(spark, d):
    return _manifest(spark, d).select("candidate", "version", "artwork_id", "artist", "display_name", "is_linked", "is_search_eligible", "manifest_version")


@register(_MANIFEST + "SELECT count(*)::BIGINT AS row_count, count_if(is_linked)::BIGINT AS linked, count_if(NOT is_linked)::BIGINT AS unlinked, count_if(is_search_eligible)::BIGINT AS eligible FROM m")
def manifest_counts(spark, d):
    return manifest.manifest_summary(_manifest(spark, d))


@register(
    _MANIFEST
    + """SELECT strftime(received_at, '%Y-%m-%d') AS day, source, count(*)::BIGINT AS image_count, count(DISTINCT author_did)::BIGINT AS author_count,
  count_if(is_linked)::BIGINT AS linked_count, round(avg(declared_width::DOUBLE), 6) AS mean_width, quantile_disc(declared_width, 0.95)::DOUBLE AS p95_width FROM m GROUP BY 1, 2"""
)
def intake_metrics(spark, d):
    return manifest.intake_metrics(_manifest(spark, d))


@register(_MANIFEST + "SELECT source, count(*)::BIGINT AS images, count(DISTINCT author_did)::BIGINT AS authors, count_if(is_search_eligible)::BIGINT AS eligible FROM m GROUP BY 1")
def source_rollup(spark, d):
    return _manifest(spark, d).groupBy("source").agg(F.count("*").alias("images"), F.countDistinct("author_did").alias("authors"), F.count_if("is_search_eligible").alias("eligible"))


# ---------------------------------------------------------------- audit

@register(
    """SELECT lower(trim(artist_id)) AS artist, count(*)::BIGINT AS image_count, count(*) FILTER (WHERE is_sfw)::BIGINT AS safe, count_if(is_sfw IS NULL)::BIGINT AS unknown, count_if(validated)::BIGINT AS validated
FROM artworks WHERE trim(coalesce(artist_id, '')) <> '' GROUP BY 1"""
)
def artist_summary(spark, d):
    works = read_table(spark, d, "artworks").withColumn("artist", blank_to_null(F.col("artist_id")))
    return audit.artist_summary(works, "artist", {"safe": F.col("is_sfw"), "unknown": F.col("is_sfw").isNull(), "validated": F.col("validated")})


@register(
    """SELECT lower(trim(file_hash)) AS digest, count(*)::BIGINT AS occurrences, count(DISTINCT artist_id)::BIGINT AS owners, min(artwork_id) AS first_record, max(artwork_id) AS last_record
FROM artworks WHERE trim(coalesce(file_hash, '')) <> '' GROUP BY 1 HAVING count(*) > 1"""
)
def duplicate_hashes(spark, d):
    return audit.duplicate_hashes(read_table(spark, d, "artworks").withColumn("digest", blank_to_null(F.col("file_hash"))), "digest", "artwork_id", "artist_id")


@register("SELECT sha256(text) AS digest, count(*)::BIGINT AS copies, min(doc_id)::BIGINT AS representative FROM documents WHERE text IS NOT NULL GROUP BY 1 HAVING count(*) > 1")
def duplicate_texts(spark, d):
    return near_duplicates.exact_groups(read_table(spark, d, "documents").withColumn("digest", F.sha2("text", 256)), "doc_id", "digest")


@register(
    """WITH q AS (SELECT count(*)::BIGINT AS row_count, count_if(post_cid IS NULL)::BIGINT AS missing_version, count_if(author_did IS NULL)::BIGINT AS missing_author,
  count_if(created_at IS NULL)::BIGINT AS missing_created, count_if(coalesce(created_at > received_at, TRUE))::BIGINT AS created_late_or_unknown, count_if(mime_type IS NULL OR mime_type NOT IN ('image/jpeg','image/png','image/webp'))::BIGINT AS other_type FROM candidates)
SELECT metric, value FROM q UNPIVOT (value FOR metric IN (row_count, missing_version, missing_author, missing_created, created_late_or_unknown, other_type))"""
)
def quality_unpivot(spark, d):
    c = read_table(spark, d, "candidates")
    return audit.quality_counts(
        c,
        {
            "missing_version": F.col("post_cid").isNull(),
            "missing_author": F.col("author_did").isNull(),
            "missing_created": F.col("created_at").isNull(),
            "created_late_or_unknown": F.col("created_at") > F.col("received_at"),
            "other_type": F.col("mime_type").isNull() | ~F.col("mime_type").isin("image/jpeg", "image/png", "image/webp"),
        },
    )


@register(
    """WITH a AS (SELECT count(*)::BIGINT AS row_count, count_if(orig_width IS NULL OR orig_width <= 0)::BIGINT AS bad_width, count_if(ingest_batch < 0)::BIGINT AS bad_batch FROM artworks),
t AS (SELECT count(*)::BIGINT AS row_count, count_if(trim(folder_name) = '')::BIGINT AS no_folder FROM artists)
SELECT 'artworks' AS table_name, metric, value FROM a UNPIVOT (value FOR metric IN (row_count, bad_width, bad_batch))
UNION ALL SELECT 'artists', metric, value FROM t UNPIVOT (value FOR metric IN (row_count, no_folder))"""
)
def constraint_violations(spark, d):
    return audit.constraint_violations(
        {
            "artworks": (read_table(spark, d, "artworks"), {"bad_width": F.col("orig_width").isNull() | (F.col("orig_width") <= 0), "bad_batch": F.col("ingest_batch") < 0}),
            "artists": (read_table(spark, d, "artists"), {"no_folder": F.trim("folder_name") == ""}),
        }
    )


@register(
    """SELECT count(*)::BIGINT AS works, count_if(is_sfw)::BIGINT AS safe, count_if(NOT is_sfw)::BIGINT AS unsafe, count_if(is_sfw IS NULL)::BIGINT AS unknown,
  count_if(is_sfw AND demo_eligible AND validated)::BIGINT AS served FROM artworks"""
)
def tri_state_report(spark, d):
    return read_table(spark, d, "artworks").agg(
        F.count("*").alias("works"), F.count_if("is_sfw").alias("safe"), F.count_if(~F.col("is_sfw")).alias("unsafe"), F.count_if(F.col("is_sfw").isNull()).alias("unknown"),
        F.count_if(F.col("is_sfw") & F.col("demo_eligible") & F.col("validated")).alias("served"),
    )


# ---------------------------------------------------------------- joins, differences, upserts

@register(
    """SELECT s.result_id, coalesce(nullif(lower(trim(s.artist_id)), ''), lower(trim(a.artist_id))) AS artist FROM search_results s LEFT JOIN artworks a ON lower(trim(s.artwork_id)) = lower(trim(a.artwork_id))"""
)
def link_fallback(spark, d):
    works = read_table(spark, d, "artworks").select(blank_to_null(F.col("artwork_id")).alias("_w"), blank_to_null(F.col("artist_id")).alias("_a"))
    results = read_table(spark, d, "search_results")
    joined = results.join(works, blank_to_null(results["artwork_id"]) == F.col("_w"), "left")
    return joined.select("result_id", F.coalesce(blank_to_null(F.col("artist_id")), F.col("_a")).alias("artist"))


@register(
    """WITH u AS (SELECT lower(trim(a.artwork_id)) AS artwork, c.received_at AS seen, 1::INTEGER AS priority FROM artworks a JOIN candidates c ON lower(trim(a.source_id)) = lower(trim(c.candidate_id)) WHERE trim(coalesce(a.source_id, '')) <> ''
  UNION ALL SELECT lower(trim(artwork_id)), searched_at, 2 FROM search_results)
SELECT artwork, priority, epoch_us(seen) AS seen_us FROM u QUALIFY row_number() OVER (PARTITION BY artwork ORDER BY seen DESC NULLS LAST, priority) = 1"""
)
def union_priority_latest(spark, d):
    works = read_table(spark, d, "artworks").select(blank_to_null(F.col("artwork_id")).alias("artwork"), blank_to_null(F.col("source_id")).alias("_c"))
    seen = read_table(spark, d, "candidates").select(blank_to_null(F.col("candidate_id")).alias("_c"), F.col("received_at").alias("seen"))
    linked = works.join(seen, "_c").select("artwork", "seen", F.lit(1).alias("priority"))
    searched = read_table(spark, d, "search_results").select(blank_to_null(F.col("artwork_id")).alias("artwork"), F.col("searched_at").alias("seen"), F.lit(2).alias("priority"))
    both = linked.unionByName(searched)
    return latest.latest_per_key(both, ["artwork"], [F.col("seen").desc_nulls_last(), F.col("priority")]).select("artwork", "priority", F.unix_micros("seen").alias("seen_us"))


@register("SELECT artwork_id FROM artworks WHERE lower(trim(artwork_id)) NOT IN (SELECT lower(trim(artwork_id)) FROM artwork_embeddings)")
def works_without_vectors(spark, d):
    held = read_table(spark, d, "artwork_embeddings").select(blank_to_null(F.col("artwork_id")).alias("_k"))
    works = read_table(spark, d, "artworks")
    return works.join(held, blank_to_null(works["artwork_id"]) == F.col("_k"), "left_anti").select("artwork_id")


@register(
    """SELECT artwork_id FROM artworks a WHERE lower(trim(source_id)) IN (SELECT lower(trim(candidate_id)) FROM candidates WHERE is_repost)
  OR lower(trim(artwork_id)) IN (SELECT lower(trim(duplicate_of)) FROM artworks WHERE trim(coalesce(duplicate_of, '')) <> '')"""
)
def publish_scope(spark, d):
    works = read_table(spark, d, "artworks")
    reposts = read_table(spark, d, "candidates").where("is_repost").select(blank_to_null(F.col("candidate_id")).alias("c"))
    originals = works.select(blank_to_null(F.col("duplicate_of")).alias("c"))
    return relational.semi_join_any(works, [(blank_to_null(F.col("source_id")), reposts, "c"), (blank_to_null(F.col("artwork_id")), originals, "c")], "artwork_id").select("artwork_id")


_SYNC = """
WITH w AS (SELECT lower(trim(artwork_id)) AS artwork, lower(trim(coalesce(phash, ''))) AS digest FROM artworks WHERE validated),
s AS (SELECT lower(trim(artwork_id)) AS artwork, min(CASE WHEN model_version_clip = '2026.2' THEN 'x' ELSE 'y' END) AS held FROM artwork_embeddings GROUP BY 1),
p AS (SELECT coalesce(w.artwork, s.artwork) AS artwork,
  CASE WHEN w.artwork IS NULL THEN 'delete' WHEN s.artwork IS NULL THEN 'insert' WHEN (CASE WHEN w.digest <> '' THEN 'x' ELSE 'z' END) = s.held THEN 'unchanged' ELSE 'update' END AS action
  FROM w FULL OUTER JOIN s ON w.artwork = s.artwork)
"""


@register(_SYNC + "SELECT artwork, action FROM p")
def sync_plan(spark, d):
    works = read_table(spark, d, "artworks").where("validated").select(blank_to_null(F.col("artwork_id")).alias("artwork"), F.when(blank_to_null(F.col("phash")).isNotNull(), "x").otherwise("z").alias("digest"))
    held = read_table(spark, d, "artwork_embeddings").groupBy(blank_to_null(F.col("artwork_id")).alias("artwork")).agg(F.min(F.when(F.col("model_version_clip") == "2026.2", "x").otherwise("y")).alias("digest"))
    return relational.sync_plan(works, held, "artwork", "digest")


@register(
    """SELECT coalesce(a.k, c.k) AS candidate, CASE WHEN c.k IS NULL THEN 'missing' WHEN a.k IS NULL THEN 'unexpected' ELSE 'present' END AS state
FROM (SELECT DISTINCT lower(trim(source_id)) AS k FROM artworks WHERE trim(coalesce(source_id, '')) <> '') a
FULL OUTER JOIN (SELECT DISTINCT lower(trim(candidate_id)) AS k FROM candidates) c ON a.k = c.k"""
)
def expected_vs_present(spark, d):
    wanted = read_table(spark, d, "artworks").select(blank_to_null(F.col("source_id")).alias("candidate")).where("candidate is not null")
    present = read_table(spark, d, "candidates").select(blank_to_null(F.col("candidate_id")).alias("candidate")).where("candidate is not null")
    return relational.difference(wanted, present, ["candidate"])


@register(
    """WITH base AS (SELECT o_orderkey, o_custkey, o_orderstatus FROM orders WHERE o_orderkey % 3 <> 0),
delta AS (SELECT o_orderkey, o_custkey, 'N' AS o_orderstatus FROM orders WHERE o_orderkey % 3 = 0 OR o_orderkey % 5 = 0)
SELECT * FROM delta UNION ALL SELECT b.* FROM base b WHERE b.o_orderkey NOT IN (SELECT o_orderkey FROM delta)"""
)
def upsert_orders(spark, d):
    orders = read_table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    base = orders.where("o_orderkey % 3 <> 0")
    delta = orders.where("o_orderkey % 3 = 0 or o_orderkey % 5 = 0").withColumn("o_orderstatus", F.lit("N"))
    return relational.upsert(base, delta, ["o_orderkey"])


@register(
    """WITH base AS (SELECT DISTINCT author_did AS k FROM candidates WHERE author_did IS NOT NULL AND is_repost), delta AS (SELECT DISTINCT author_did AS k FROM candidates WHERE author_did IS NOT NULL)
SELECT k AS author, TRUE AS known FROM base UNION ALL SELECT k, FALSE FROM delta WHERE k NOT IN (SELECT k FROM base)"""
)
def insert_if_absent(spark, d):
    c = read_table(spark, d, "candidates").where("author_did is not null")
    base = c.where("is_repost").select(F.col("author_did").alias("author"), F.lit(True).alias("known")).distinct()
    delta = c.select(F.col("author_did").alias("author"), F.lit(False).alias("known"))
    return relational.insert_if_absent(base, delta, ["author"])


@register(
    """WITH p AS (SELECT lower(trim(artwork_id)) AS k, max(is_sfw::INT) = 1 AS flag FROM search_results WHERE is_sfw IS NOT NULL GROUP BY 1)
SELECT a.artwork_id, coalesce(p.flag, a.is_sfw) AS is_sfw FROM artworks a LEFT JOIN p ON lower(trim(a.artwork_id)) = p.k"""
)
def policy_update(spark, d):
    works = read_table(spark, d, "artworks").select("artwork_id", "is_sfw", blank_to_null(F.col("artwork_id")).alias("k"))
    policy = read_table(spark, d, "search_results").where("is_sfw is not null").groupBy(blank_to_null(F.col("artwork_id")).alias("k")).agg(F.max("is_sfw").alias("is_sfw"))
    return relational.updated(works, policy, ["k"], ["is_sfw"]).select("artwork_id", "is_sfw")


_GALLERY = """
WITH k AS (SELECT lower(trim(candidate_id)) AS candidate, nullif(lower(trim(post_cid)), '') AS version, received_at, delivery_id FROM candidates WHERE trim(coalesce(candidate_id, '')) <> ''),
c AS (SELECT * FROM k QUALIFY row_number() OVER (PARTITION BY candidate ORDER BY received_at DESC NULLS LAST, delivery_id DESC) = 1),
f AS (SELECT candidate, version AS first_version FROM k QUALIFY row_number() OVER (PARTITION BY candidate ORDER BY received_at NULLS LAST, delivery_id) = 1),
w AS (SELECT lower(trim(source_id)) AS candidate, count(*) AS works FROM artworks WHERE trim(coalesce(source_id, '')) <> '' GROUP BY 1)
"""


@register(
    _GALLERY
    + """SELECT CASE WHEN c.candidate IS NULL THEN 'unmatched' WHEN w.candidate IS NULL THEN 'undecided' WHEN c.version IS NOT NULL AND f.first_version IS NOT NULL AND c.version <> f.first_version THEN 'stale' ELSE 'current' END AS status,
  count(*)::BIGINT AS n FROM (c JOIN f USING (candidate)) FULL OUTER JOIN w ON c.candidate = w.candidate GROUP BY 1"""
)
def gallery_status(spark, d):
    """Works are taken to be made of a candidate's first version; stale only if both versions are known and differ."""
    rows = read_table(spark, d, "candidates").select(blank_to_null(F.col("candidate_id")).alias("candidate"), blank_to_null(F.col("post_cid")).alias("version"), "received_at", "delivery_id").where("candidate is not null")
    last = latest.latest_per_key(rows, ["candidate"], [F.col("received_at").desc_nulls_last(), F.col("delivery_id").desc()])
    first = latest.latest_per_key(rows, ["candidate"], [F.col("received_at").asc_nulls_last(), F.col("delivery_id")]).select("candidate", F.col("version").alias("first_version"))
    works = read_table(spark, d, "artworks").select(blank_to_null(F.col("source_id")).alias("candidate"), F.lit(1).alias("_w")).where("candidate is not null").distinct()
    joined = last.join(first, "candidate").withColumn("_c", F.lit(1)).join(works, "candidate", "full_outer")
    stale = F.col("version").isNotNull() & F.col("first_version").isNotNull() & (F.col("version") != F.col("first_version"))
    status = F.when(F.col("_c").isNull(), "unmatched").when(F.col("_w").isNull(), "undecided").when(stale, "stale").otherwise("current")
    return joined.groupBy(status.alias("status")).agg(F.count("*").alias("n"))


_CASCADE = """SELECT CASE WHEN trim(coalesce(artist_id, '')) = '' THEN 'no_artist' WHEN NOT validated THEN 'not_validated' WHEN trim(coalesce(file_hash, '')) = '' THEN 'no_content'
  WHEN trim(coalesce(duplicate_of, '')) <> '' THEN 'duplicate' WHEN is_sfw IS NULL THEN 'safety_unknown' WHEN NOT is_sfw THEN 'unsafe' ELSE 'selected' END AS reason, artwork_id FROM artworks"""


@register(f"SELECT reason, count(*)::BIGINT AS n FROM ({_CASCADE}) GROUP BY 1")
def exclusion_cascade(spark, d):
    ladder = [
        ("no_artist", blank_to_null(F.col("artist_id")).isNull()),
        ("not_validated", ~F.col("validated")),
        ("no_content", blank_to_null(F.col("file_hash")).isNull()),
        ("duplicate", blank_to_null(F.col("duplicate_of")).isNotNull()),
        ("safety_unknown", F.col("is_sfw").isNull()),
        ("unsafe", ~F.col("is_sfw")),
    ]
    return relational.first_match(read_table(spark, d, "artworks"), ladder, "selected").groupBy("reason").agg(F.count("*").alias("n"))


@register(
    """WITH h AS (SELECT DISTINCT ('0x' || lower(trim(phash)))::UBIGINT AS h FROM artworks WHERE regexp_full_match(lower(trim(phash)), '[0-9a-f]{1,16}')),
p AS (SELECT lpad(lower(to_hex(a.h)), 16, '0') AS a, lpad(lower(to_hex(b.h)), 16, '0') AS b, bit_count(xor(a.h, b.h))::INTEGER AS distance FROM h a JOIN h b ON a.h < b.h)
SELECT * FROM p WHERE distance <= 6"""
)
def near_duplicate_hamming(spark, d):
    return near_duplicates.near_duplicates(read_table(spark, d, "artworks"), "artwork_id", "phash", 6)


# ---------------------------------------------------------------- sets

@register(
    """SELECT 'union' AS op, count(*)::BIGINT AS n FROM (SELECT author_did FROM candidates WHERE author_did IS NOT NULL UNION SELECT author_did FROM documents WHERE author_did IS NOT NULL)
UNION ALL SELECT 'intersect', count(*)::BIGINT FROM (SELECT author_did FROM candidates WHERE author_did IS NOT NULL INTERSECT SELECT author_did FROM documents WHERE author_did IS NOT NULL)
UNION ALL SELECT 'except', count(*)::BIGINT FROM (SELECT author_did FROM candidates WHERE author_did IS NOT NULL EXCEPT SELECT author_did FROM documents WHERE author_did IS NOT NULL)"""
)
def author_sets(spark, d):
    a, b = (read_table(spark, d, t).select("author_did").where("author_did is not null") for t in ("candidates", "documents"))
    parts = [("union", a.union(b).distinct()), ("intersect", a.intersect(b)), ("except", a.subtract(b))]
    out = None
    for name, part in parts:
        row = part.agg(F.lit(name).alias("op"), F.count("*").alias("n"))
        out = row if out is None else out.unionByName(row)
    return out


@register("SELECT label, kind, count(*)::BIGINT AS n FROM (SELECT DISTINCT delivery_id, lower(trim(l)) AS label, kind FROM (SELECT delivery_id, unnest(content_labels) AS l, 'content' AS kind FROM candidates UNION ALL SELECT delivery_id, unnest(author_labels), 'author' FROM candidates) WHERE trim(coalesce(l, '')) <> '') GROUP BY 1, 2")
def label_counts(spark, d):
    def part(column: str, kind: str) -> DataFrame:
        clean = F.array_distinct(F.filter(F.transform(column, lambda x: F.lower(F.trim(x))), lambda x: x.isNotNull() & (x != "")))
        return c.select(F.explode(clean).alias("label"), F.lit(kind).alias("kind"))

    c = read_table(spark, d, "candidates")
    return part("content_labels", "content").unionByName(part("author_labels", "author")).groupBy("label", "kind").agg(F.count("*").alias("n"))


# ---------------------------------------------------------------- text and rules

def _rx(term: str) -> str:
    return r"(^|[^\p{L}\p{N}\p{M}_])" + term.replace("+", r"\+") + r"($|[^\p{L}\p{N}\p{M}_])"


def _sql_matches(terms: tuple[str, ...]) -> str:
    return " + ".join(f"regexp_matches(t, '{_rx(x)}')::INT" for x in terms)


_TEXT = "WITH x AS (SELECT delivery_id, trim(regexp_replace(lower(post_text || chr(10) || coalesce(alt_text, '')), '[\\s\\p{Z}]+', ' ', 'g')) AS t FROM candidates)"


@register(
    f"""{_TEXT}, m AS (SELECT delivery_id, least(1.0, 0.25 * ({_sql_matches(text.POSITIVE_TERMS)}))::DOUBLE AS positive_score,
  least(1.0, 0.25 * ({_sql_matches(text.NEGATIVE_TERMS)} + {_sql_matches(text.ROUTING_TERMS)}))::DOUBLE AS negative_score FROM x)
SELECT delivery_id, positive_score, negative_score, greatest(-1.0, least(1.0, positive_score - negative_score))::DOUBLE AS net_score FROM m"""
)
def text_signal_scores(spark, d):
    c = read_table(spark, d, "candidates")
    plain = text.collapse_blanks(F.concat_ws("\n", "post_text", F.coalesce("alt_text", F.lit(""))))
    s = text.with_text_scores(c.select("delivery_id", plain.alias("t")), "t")
    return s.select("delivery_id", "positive_score", "negative_score", "net_score")


@register()
def text_signal_scores_nfkc(spark, d):
    c = read_table(spark, d, "candidates")
    s = c.select("delivery_id", text.normalize_text(F.concat_ws("\n", "post_text", F.coalesce("alt_text", F.lit("")))).alias("t"))
    return text.with_text_scores(s, "t").drop("t")


@register(
    f"""{_TEXT}, l AS (SELECT delivery_id, list_concat(content_labels, author_labels) AS ls FROM candidates),
r AS (SELECT x.delivery_id, len(list_filter(list_distinct(list_transform(ls, lambda v: lower(trim(v)))), lambda v: v IN ('!hide','!warn','!no-unauthenticated','porn','sexual','sexual-figurative','nudity','graphic-media','gore'))) AS by_label,
  (contains(t, '18+')::INT + contains(t, '🔞')::INT + {_sql_matches(('explicit', 'lewd', 'nsfw', 'porn', 'yiff'))}) AS by_text FROM x JOIN l USING (delivery_id))
SELECT delivery_id, (by_label + by_text)::INTEGER AS reasons FROM r WHERE by_label + by_text > 0"""
)
def moderation_filter(spark, d):
    c = read_table(spark, d, "candidates")
    plain = text.collapse_blanks(F.concat_ws("\n", "post_text", F.coalesce("alt_text", F.lit(""))))
    reasons = moderation.moderation_reasons(F.concat("content_labels", "author_labels"), plain)
    return c.select("delivery_id", F.size(reasons).alias("reasons")).where("reasons > 0")


@register(
    """WITH c AS (SELECT declared_width AS w, declared_height AS h, is_repost AS r, is_quote_post AS q FROM candidates)
SELECT CASE WHEN coalesce(w < 256 OR h < 256, FALSE) OR coalesce(w * h < 100000, FALSE) THEN 'force_reject' WHEN coalesce(greatest(w / h, h / w) > 8.0, FALSE) OR coalesce(r, FALSE) OR coalesce(q, FALSE) THEN 'force_review' ELSE 'continue' END AS disposition, count(*)::BIGINT AS n FROM c GROUP BY 1"""
)
def rule_dispositions(spark, d):
    hits = moderation.rule_hits(F.col("declared_width"), F.col("declared_height"), F.col("is_repost"), F.col("is_quote_post"))
    return read_table(spark, d, "candidates").groupBy(moderation.disposition(hits).alias("disposition")).agg(F.count("*").alias("n"))


@register(
    """WITH c AS (SELECT author_did, len(list_intersect(list_distinct(list_transform(list_concat(content_labels, author_labels), lambda v: lower(trim(v)))), ['!hide','!warn','!no-unauthenticated','porn','sexual','sexual-figurative','nudity','graphic-media','gore'])) > 0 AS bad,
  regexp_extract_all(lower(post_text), '[a-z]+') AS ws FROM candidates WHERE author_did IS NOT NULL)
SELECT author_did, count(*)::BIGINT AS image_posts, count_if(bad)::BIGINT AS excluded_posts, count_if(NOT bad)::BIGINT AS allowed_posts,
  count_if(list_has_any(ws, ['sketch','study','drawing']))::BIGINT AS practice_posts, count_if(list_has_any(ws, ['commission','commissions','prints']))::BIGINT AS offer_posts, round(count_if(bad) / count(*), 9) AS excluded_fraction FROM c GROUP BY 1"""
)
def account_audit(spark, d):
    c = read_table(spark, d, "candidates")
    bad = F.size(moderation.moderation_reasons(F.concat("content_labels", "author_labels"), F.lit(""))) > 0
    return moderation.account_audit(c, "author_did", bad, {"practice": ("sketch", "study", "drawing"), "offer": ("commission", "commissions", "prints")}, text.word_set(F.col("post_text")))


# ---------------------------------------------------------------- scalar families

@register(
    """WITH w AS (SELECT artwork_id, orig_width AS w, orig_height AS h FROM artworks WHERE orig_width > 0 AND orig_height > 0),
c AS (SELECT *, CASE WHEN greatest(w, h) / least(w, h) > 2.5 THEN round_even(least(w, h) * 2.5, 0)::BIGINT ELSE greatest(w, h) END AS keep FROM w),
x AS (SELECT *, greatest(w, h) - keep AS excess FROM c),
y AS (SELECT *, CASE WHEN w > h THEN excess // 2 ELSE 0 END AS crop_left, CASE WHEN w > h THEN excess - excess // 2 ELSE 0 END AS crop_right, CASE WHEN w > h THEN 0 ELSE excess // 2 END AS crop_top, CASE WHEN w > h THEN 0 ELSE excess - excess // 2 END AS crop_bottom FROM x),
s AS (SELECT *, 448.0::DOUBLE / greatest(w - crop_left - crop_right, h - crop_top - crop_bottom) AS scale FROM y),
r AS (SELECT *, greatest(1, round_even((w - crop_left - crop_right) * scale, 0)::BIGINT) AS rw, greatest(1, round_even((h - crop_top - crop_bottom) * scale, 0)::BIGINT) AS rh FROM s)
SELECT artwork_id, crop_left::BIGINT AS crop_left, crop_top::BIGINT AS crop_top, rw::BIGINT AS resized_width, rh::BIGINT AS resized_height, ((448 - rw) // 2)::BIGINT AS pad_left, ((448 - rh) // 2)::BIGINT AS pad_top, round(scale, 9) AS scale_factor FROM r"""
)
def transform_geometry(spark, d):
    rows = geometry.with_transform_plan(read_table(spark, d, "artworks").select("artwork_id", "orig_width", "orig_height"), "orig_width", "orig_height", "p").where("p is not null")
    return rows.select("artwork_id", "p.crop_left", "p.crop_top", "p.resized_width", "p.resized_height", "p.pad_left", "p.pad_top", F.round("p.scale_factor", 9).alias("scale_factor"))


@register(
    """SELECT delivery_id, sha256(concat_ws('|', post_uri, image_index::VARCHAR)) AS candidate_key, 'bsky_' || substr(sha256(coalesce(nullif(author_did, ''), nullif(author_handle, ''), candidate_id)), 1, 24) AS artist_key,
  'objects/sha256/' || substr(sha256(coalesce(fullsize_url, '')), 1, 2) || '/' || substr(sha256(coalesce(fullsize_url, '')), 3, 2) || '/' || sha256(coalesce(fullsize_url, '')) || '.jpg' AS object_path FROM candidates"""
)
def record_keys(spark, d):
    return read_table(spark, d, "candidates").select(
        "delivery_id",
        keys.candidate_key(F.col("post_uri"), F.col("image_index")).alias("candidate_key"),
        keys.artist_key(F.col("author_did"), F.col("author_handle"), F.col("candidate_id")).alias("artist_key"),
        keys.content_path("objects", F.sha2(F.coalesce("fullsize_url", F.lit("")), 256), ".jpg").alias("object_path"),
    )


@register(
    """WITH h AS (SELECT artwork_id, sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || encode(artwork_id)) AS h FROM artworks)
SELECT artwork_id, concat_ws('-', h[1:8], h[9:12], '5' || h[14:16], substr('89ab', (('0x' || h[17:17])::INTEGER % 4) + 1, 1) || h[18:20], h[21:32]) AS point_id FROM h"""
)
def point_ids(spark, d):
    import uuid

    return read_table(spark, d, "artworks").select("artwork_id", keys.uuid5(uuid.NAMESPACE_URL, F.col("artwork_id")).alias("point_id"))


@register(
    """SELECT delivery_id, strftime(created_at, '%Y-%m-%dT%H:%M:%S.%fZ') AS created, coalesce(epoch_us(created_at) / 1e6, 0)::DOUBLE AS seconds, strftime(received_at, '%Y-%m-%d') AS day FROM candidates"""
)
def timestamps(spark, d):
    c = read_table(spark, d, "candidates")
    return c.select("delivery_id", times.rfc3339(F.col("created_at")).alias("created"), times.epoch_seconds(F.col("created_at")).alias("seconds"), F.to_date("received_at").cast("string").alias("day"))


@register("SELECT folder_name, regexp_replace(regexp_replace(display_name, '[^A-Za-z0-9._-]+', '_', 'g'), '^[._]+|[._]+$', '', 'g') AS file_name FROM artists")
def safe_names(spark, d):
    return read_table(spark, d, "artists").select("folder_name", text.safe_component(F.col("display_name")).alias("file_name"))


@register(
    """WITH r AS (SELECT artwork_id, lower(trim(artist_id)) AS artist, row_number() OVER (PARTITION BY lower(trim(artist_id)) ORDER BY sha256('7|' || lower(trim(artist_id)) || '|' || artwork_id), artwork_id) AS n FROM artworks WHERE trim(coalesce(artist_id, '')) <> '')
SELECT artist, artwork_id, (n - 1)::INTEGER AS session FROM r WHERE n <= 3"""
)
def sample_sessions(spark, d):
    works = read_table(spark, d, "artworks").select("artwork_id", blank_to_null(F.col("artist_id")).alias("artist")).where("artist is not null")
    return sampling.sessions(works, "artist", "artwork_id", 3, seed=7)


@register(
    """WITH h AS (SELECT delivery_id, lower(regexp_extract(fullsize_url, '^(https?)://([^/:?#]+)', 2)) AS host, fullsize_url LIKE 'https://%' AS secure FROM candidates)
SELECT nullif(host, '') AS host, coalesce(secure AND (host = 'artfeed.example' OR host LIKE '%.artfeed.example'), FALSE) AS allowed, count(*)::BIGINT AS n FROM h GROUP BY 1, 2"""
)
def url_hosts(spark, d):
    c = read_table(spark, d, "candidates")
    return c.groupBy(web.host(F.col("fullsize_url")).alias("host"), web.allowed(F.col("fullsize_url"), ("artfeed.example",)).alias("allowed")).agg(F.count("*").alias("n"))


@register(
    """SELECT delivery_id, CASE WHEN post_uri LIKE 'at://%' AND len(string_split(substr(post_uri, 6), '/')) >= 3 THEN 'https://posts.example/profile/' || coalesce(author_handle, string_split(substr(post_uri, 6), '/')[1]) || '/post/' || string_split(substr(post_uri, 6), '/')[3] END AS link FROM candidates"""
)
def post_links(spark, d):
    return read_table(spark, d, "candidates").select("delivery_id", web.post_link(F.col("post_uri"), F.col("author_handle")).alias("link"))


@register("SELECT artwork_id, CASE WHEN raw_path LIKE 'raw/%' THEN substr(raw_path, 5) ELSE raw_path END AS path FROM artworks")
def relative_paths(spark, d):
    return read_table(spark, d, "artworks").select("artwork_id", web.relative_path(F.col("raw_path"), "raw").alias("path"))


@register(
    """SELECT 'model_version_clip' AS field, model_version_clip AS value, count(*)::BIGINT AS n FROM artwork_embeddings GROUP BY 2
UNION ALL SELECT 'model_version_dino', model_version_dino, count(*)::BIGINT FROM artwork_embeddings GROUP BY 2 UNION ALL SELECT 'clip_dim', clip_dim::VARCHAR, count(*)::BIGINT FROM artwork_embeddings GROUP BY 2"""
)
def version_cohorts(spark, d):
    return snapshots.cohorts(read_table(spark, d, "artwork_embeddings"), ["model_version_clip", "model_version_dino", "clip_dim"])


@register(
    """WITH r AS (SELECT * FROM candidates WHERE contains(lower(concat_ws(' ', post_text, alt_text)), 'fox'))
SELECT 'source' AS facet, source AS value, count(*)::BIGINT AS n FROM r GROUP BY 2 UNION ALL SELECT 'mime_type', mime_type, count(*)::BIGINT FROM r GROUP BY 2 UNION ALL SELECT 'is_repost', is_repost::VARCHAR, count(*)::BIGINT FROM r GROUP BY 2"""
)
def facet_counts(spark, d):
    return snapshots.facet_counts(read_table(spark, d, "candidates"), ["source", "mime_type", "is_repost"], "Fox", ["post_text", "alt_text"])


@register(
    """WITH d AS (SELECT lower(trim(candidate_id)) AS candidate, received_at, delivery_id, is_repost FROM candidates WHERE trim(coalesce(candidate_id, '')) <> ''),
l AS (SELECT candidate, min(delivery_id) AS label, CASE WHEN min(delivery_id) % 2 = 0 THEN min(received_at) END AS snap FROM d GROUP BY 1),
n AS (SELECT l.label, d.delivery_id, row_number() OVER (PARTITION BY l.label ORDER BY d.delivery_id DESC) AS r FROM l JOIN d ON l.candidate = d.candidate AND l.snap = d.received_at),
f AS (SELECT l.label, d.delivery_id, row_number() OVER (PARTITION BY l.label ORDER BY d.received_at DESC NULLS LAST, d.delivery_id DESC) AS r FROM l JOIN d ON l.candidate = d.candidate WHERE l.snap IS NULL)
SELECT label, delivery_id FROM n WHERE r = 1 UNION ALL SELECT label, delivery_id FROM f WHERE r = 1"""
)
def snapshot_labels(spark, d):
    """Half of the labels name the delivery they were made about by its time."""
    rows = read_table(spark, d, "candidates").select(blank_to_null(F.col("candidate_id")).alias("candidate"), "received_at", "delivery_id").where("candidate is not null")
    labels = rows.groupBy("candidate").agg(F.min("delivery_id").alias("label"), F.min("received_at").alias("snap"))
    labels = labels.withColumn("snap", F.when(F.col("label") % 2 == 0, F.col("snap")))
    return snapshots.snapshot_join(labels, rows, "candidate", "label", "snap", "received_at", "delivery_id").select("label", "delivery_id")


@register(
    """WITH g AS (SELECT declared_width AS w, declared_height AS h, received_at, delivery_id, candidate_id FROM candidates QUALIFY row_number() OVER (PARTITION BY candidate_id ORDER BY received_at DESC NULLS LAST, delivery_id DESC) = 1)
SELECT delivery_id, to_json({'candidate_id': candidate_id, 'height': h, 'width': w})::VARCHAR AS payload FROM g"""
)
def gallery_payload(spark, d):
    """Every candidate's latest row as the JSON that a page would embed; a page orders them where it is written."""
    c = read_table(spark, d, "candidates")
    last = latest.latest_per_key(c, ["candidate_id"], [F.col("received_at").desc_nulls_last(), F.col("delivery_id").desc()])
    body = F.to_json(F.struct("candidate_id", F.col("declared_height").alias("height"), F.col("declared_width").alias("width")), {"ignoreNullFields": "false"})
    return last.select("delivery_id", text.html_safe_json(body).alias("payload"))


# ---------------------------------------------------------------- extras that Spark brings along

@register(
    """SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 4)::DOUBLE AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 4)::DOUBLE AS revenue, count(*)::BIGINT AS n
FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY 1, 2"""
)
def pricing_summary(spark, d):
    rows = read_table(spark, d, "lineitem").where(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp"))
    return rows.groupBy("l_returnflag", "l_linestatus").agg(
        F.round(F.sum("l_quantity"), 4).alias("sum_qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 4).alias("revenue"), F.count("*").alias("n")
    )


@register("SELECT n_name, o_orderstatus, count(*)::BIGINT AS n FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY ROLLUP (n_name, o_orderstatus)")
def orders_rollup(spark, d):
    o, c, n = (read_table(spark, d, t) for t in ("orders", "customer", "nation"))
    return o.join(c, o["o_custkey"] == c["c_custkey"]).join(n, c["c_nationkey"] == n["n_nationkey"]).rollup("n_name", "o_orderstatus").agg(F.count("*").alias("n"))


@register(
    """WITH g AS (SELECT user_id, ts, event_id, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) <= INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh FROM events),
s AS (SELECT user_id, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session FROM g)
SELECT user_id, count(DISTINCT session)::BIGINT AS sessions, count(*)::BIGINT AS events FROM s GROUP BY 1"""
)
def event_sessions(spark, d):
    e = read_table(spark, d, "events")
    by = Window.partitionBy("user_id").orderBy("ts", "event_id")
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    gap = at - F.lag(at).over(by)
    marked = e.withColumn("fresh", F.when(gap <= 6 * 3_600_000_000, 0).otherwise(1))
    return marked.withColumn("session", F.sum("fresh").over(by)).groupBy("user_id").agg(F.countDistinct("session").alias("sessions"), F.count("*").alias("events"))


@register("SELECT strftime(time_bucket(INTERVAL 1 HOUR, ts), '%Y-%m-%d %H:%M:%S') AS start, event_type, count(*)::BIGINT AS n FROM events GROUP BY 1, 2")
def hourly_counts(spark, d):
    from pictorium.streaming.intake import windowed_counts

    return windowed_counts(read_table(spark, d, "events"), "ts", "event_type").select(F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "event_type", "n")


@register(
    """WITH k AS (SELECT DISTINCT lower(trim(candidate_id)) AS candidate, coalesce(nullif(lower(trim(post_cid)), ''), '') AS version FROM candidates WHERE trim(coalesce(candidate_id, '')) <> '') SELECT * FROM k"""
)
def stream_once_only(spark, d):
    """The candidates table replayed as a stream; every version comes out once."""
    from pictorium.runtime import fresh_path
    from pictorium.operators.delivery import IdentifierIndex
    from pictorium.streaming.intake import once_only

    out, checkpoint = fresh_path(spark, "stream-out"), fresh_path(spark, "stream-checkpoint")
    schema = read_table(spark, d, "candidates").schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 32).parquet(f"{d}/candidates.parque[t]")
    once_only(spark, stream, out, checkpoint, IdentifierIndex(spark))
    kept = spark.read.schema(schema).parquet(out)
    return kept.select(blank_to_null(F.col("candidate_id")).alias("candidate"), F.coalesce(blank_to_null(F.col("post_cid")), F.lit("")).alias("version"))


QUERIES, ORACLES = register.queries, register.oracles
