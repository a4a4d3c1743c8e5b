"""Feed items flattened to candidates, labels and text rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from pictorium.functions.keys import candidate_key
from pictorium.functions.text import EXCLUDED_TERMS, contains_term, normalize_text

_IMAGES = "array<struct<thumb:string,fullsize:string,alt:string,aspectRatio:struct<width:bigint,height:bigint>>>"
_LABELS = "array<struct<val:string,neg:boolean>>"
FEED_SCHEMA = (
    "reason struct<`$type`:string>, post struct<uri:string,cid:string,"
    f"labels:{_LABELS},author:struct<did:string,handle:string,labels:{_LABELS}>,"
    f"record:struct<text:string,createdAt:string,langs:array<string>,labels:struct<values:{_LABELS}>>,"
    f"embed:struct<`$type`:string,images:{_IMAGES},media:struct<`$type`:string,images:{_IMAGES}>,record:struct<author:struct<did:string>>>>"
)
# Labels that leave a post out, and the image rules' limits.
EXCLUDED_LABELS = ("!hide", "!warn", "!no-unauthenticated", "porn", "sexual", "sexual-figurative", "nudity", "graphic-media", "gore")
LEAST_SIDE, LEAST_AREA, MOST_ASPECT, LEAST_SPREAD = 256, 100_000, 8.0, 5.0


def active_labels(labels: Column) -> Column:
    """Values in force, trimmed, lower-cased, each once, in order."""
    held = F.filter(labels, lambda x: ~F.coalesce(x["neg"], F.lit(False)) & (F.trim(F.coalesce(x["val"], F.lit(""))) != ""))
    return F.array_distinct(F.coalesce(F.transform(held, lambda x: F.lower(F.trim(x["val"]))), F.array().cast("array<string>")))


def moderation_reasons(labels: Column, text: Column, excluded_labels: tuple[str, ...] = EXCLUDED_LABELS, excluded_terms: tuple[str, ...] = EXCLUDED_TERMS) -> Column:
    """Why a post is left out: its labels, then terms of its normalised text; an empty array for none."""
    bad = F.array(*[F.lit(x) for x in excluded_labels])
    by_label = F.transform(F.array_intersect(F.array_distinct(F.transform(labels, lambda x: F.lower(F.trim(x)))), bad), lambda x: F.concat(F.lit("label:"), x))
    by_text = F.array_compact(F.array(*[F.when(contains_term(text, t), F.lit(f"text:{t}")) for t in excluded_terms]))
    return F.array_distinct(F.concat(by_label, by_text))


def flatten_feed(items: DataFrame, public_safe: bool = True) -> DataFrame:
    """One candidate per image of every feed item (columns of FEED_SCHEMA)."""
    post = F.col("post")
    images = F.coalesce(post["embed"]["images"], post["embed"]["media"]["images"])
    content = F.array_distinct(F.concat(active_labels(post["labels"]), active_labels(post["record"]["labels"]["values"])))
    author = active_labels(post["author"]["labels"])
    text = normalize_text(F.concat_ws("\n", F.coalesce(post["record"]["text"], F.lit("")), F.transform(images, lambda i: F.coalesce(i["alt"], F.lit("")))))
    rows = items.where(post.isNotNull() & post["uri"].isNotNull() & (F.size(F.coalesce(images, F.array())) > 0))
    rows = rows.withColumns({"_content": content, "_author": author, "_reasons": moderation_reasons(F.concat(content, author), text)})
    if public_safe:
        rows = rows.where(F.size("_reasons") == 0)
    flat = rows.select("post", "reason", "_content", "_author", F.posexplode(images).alias("image_index", "image"))
    image = F.col("image")
    return flat.select(
        candidate_key(post["uri"], F.col("image_index")).alias("candidate_id"),
        post["uri"].alias("post_uri"), post["cid"].alias("post_cid"), post["author"]["did"].alias("author_did"), post["author"]["handle"].alias("author_handle"),
        F.col("image_index").cast("bigint").alias("image_index"), image["thumb"].alias("thumbnail_url"), image["fullsize"].alias("fullsize_url"),
        F.coalesce(post["record"]["text"], F.lit("")).alias("post_text"), F.coalesce(image["alt"], F.lit("")).alias("alt_text"),
        F.try_to_timestamp(post["record"]["createdAt"]).alias("created_at"), F.coalesce(post["record"]["langs"], F.array().cast("array<string>")).alias("langs"),
        F.col("_content").alias("content_labels"), F.col("_author").alias("author_labels"),
        F.coalesce(F.col("reason")["$type"].contains("reasonRepost"), F.lit(False)).alias("is_repost"), post["embed"]["record"].isNotNull().alias("is_quote_post"),
        post["embed"]["record"]["author"]["did"].alias("quoted_author_did"), image["aspectRatio"]["width"].alias("declared_width"), image["aspectRatio"]["height"].alias("declared_height"),
    )


def rule_hits(width: Column, height: Column, is_repost: Column, is_quote: Column, animated: Column | None = None, spread: Column | None = None) -> Column:
    """Array of (rule, disposition, value) of the image and provenance rules that hold; what is unknown breaks no rule.

    ``spread`` is the largest standard deviation of the image's channels.
    """
    none = F.lit(None)
    aspect = F.greatest(width / height, height / width)
    rules = [
        ("media.minimum_dimensions", "force_reject", (width < LEAST_SIDE) | (height < LEAST_SIDE), F.least(width, height)),
        ("media.minimum_area", "force_reject", width * height < LEAST_AREA, width * height),
        ("media.extreme_aspect_ratio", "force_review", aspect > MOST_ASPECT, aspect),
        ("media.animation", "force_reject", none.cast("boolean") if animated is None else animated, none),
        ("media.low_variance", "force_review", none.cast("boolean") if spread is None else spread < LEAST_SPREAD, none if spread is None else spread),
        ("provenance.repost", "force_review", is_repost, F.lit(None)),
        ("provenance.quote_post", "force_review", is_quote, F.lit(None)),
    ]
    hits = [F.when(c, F.struct(F.lit(n).alias("rule"), F.lit(d).alias("disposition"), v.cast("double").alias("value"))) for n, d, c, v in rules]
    return F.array_compact(F.array(*hits))


def disposition(hits: Column) -> Column:
    """Reject beats review beats continue."""
    kinds = F.transform(hits, lambda h: h["disposition"])
    return F.when(F.array_contains(kinds, "force_reject"), "force_reject").when(F.array_contains(kinds, "force_review"), "force_review").otherwise("continue")


def account_audit(posts: DataFrame, author: str, excluded: Column, keyword_groups: dict[str, tuple[str, ...]], words: Column) -> DataFrame:
    """Posts, exclusions and the balance of caller-supplied word groups per account."""
    from pictorium.functions.numeric import ratio

    hits = {g: F.size(F.array_intersect(words, F.array(*[F.lit(w) for w in ws]))) > 0 for g, ws in keyword_groups.items()}
    per = posts.where(F.col(author).isNotNull()).groupBy(author).agg(
        F.count("*").alias("image_posts"), F.count_if(excluded).alias("excluded_posts"), F.count_if(~excluded).alias("allowed_posts"), *[F.count_if(c).alias(f"{g}_posts") for g, c in hits.items()]
    )
    return per.withColumn("excluded_fraction", F.round(ratio(F.col("excluded_posts"), F.col("image_posts")), 9))
