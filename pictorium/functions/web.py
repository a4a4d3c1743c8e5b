"""Addresses: hosts, allow-lists, links of posts."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def host(url: Column) -> Column:
    """The lower-cased host; NULL where the text isn't an address."""
    return F.lower(F.try_parse_url(url, F.lit("HOST")))


def allowed(url: Column, suffixes: tuple[str, ...]) -> Column:
    """https, a host that is or ends with one of the suffixes, and no address in numbers."""
    h = host(url)
    known = F.lit(False)
    for s in suffixes:
        known = known | (h == s) | h.endswith("." + s)
    named = ~h.rlike(r"^[0-9.]+$") & ~h.contains(":")
    return F.coalesce((F.lower(F.try_parse_url(url, F.lit("PROTOCOL"))) == "https") & named & known, F.lit(False))


def _quoted(text: Column) -> Column:
    return F.replace(F.replace(F.url_encode(text), F.lit("+"), F.lit("%20")), F.lit("%3A"), F.lit(":"))


def post_link(uri: Column, actor: Column | None = None, site: str = "https://posts.example") -> Column:
    """``at://author/collection/key`` as a link, under the actor's name if given; anything else has none."""
    parts = F.split(F.regexp_replace(uri, "^at://", ""), "/")
    good = uri.startswith("at://") & (F.size(parts) >= 3)
    name = F.coalesce(actor, parts[0]) if actor is not None else parts[0]
    return F.when(good, F.concat_ws("/", F.lit(site), F.lit("profile"), _quoted(name), F.lit("post"), _quoted(F.element_at(parts, 3))))


def relative_path(path: Column, root: str) -> Column:
    """The part below ``root``; paths elsewhere stay as they are."""
    base = root.rstrip("/") + "/"
    return F.when(path.startswith(base), F.substring(path, len(base) + 1, 1 << 20)).otherwise(path)
