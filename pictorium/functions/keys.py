"""Keys, digests and identifiers."""

from __future__ import annotations

import json
import uuid

import pandas as pd
from pyspark.sql import Column, functions as F
from pyspark.sql.types import StringType


def candidate_key(uri: Column, index: Column) -> Column:
    return F.sha2(F.concat_ws("|", uri, index.cast("string")), 256)


def artist_key(*names: Column) -> Column:
    """Stable id of the first name that isn't missing or empty."""
    return F.concat(F.lit("bsky_"), F.substring(F.sha2(F.coalesce(*[F.nullif(n, F.lit("")) for n in names]), 256), 1, 24))


def routed_filename(identifier: Column, version: Column, suffix: str = ".jpg") -> Column:
    """The safe identifier, with twelve digits of the version's hash where there is a version."""
    from pictorium.functions.text import safe_filename

    part = F.when(F.coalesce(version, F.lit("")) != "", F.concat(F.lit("-"), F.substring(F.sha2(version, 256), 1, 12))).otherwise(F.lit(""))
    return F.concat(safe_filename(identifier), part, F.lit(suffix))


def content_path(namespace: str, digest: Column, suffix: str = "") -> Column:
    """namespace/sha256/ab/cd/digest + suffix; NULL unless the digest is 64 hexadecimal digits."""
    low = F.lower(digest)
    path = F.concat_ws("/", F.lit(namespace), F.lit("sha256"), F.substring(low, 1, 2), F.substring(low, 3, 2), F.concat(low, F.lit(suffix)))
    return F.when(low.rlike("^[0-9a-f]{64}$"), path)


def uuid5(namespace: uuid.UUID, name: Column) -> Column:
    """RFC 4122 version 5 in column expressions."""
    digest = F.sha1(F.concat(F.unhex(F.lit(namespace.hex)), F.encode(name, "UTF-8")))
    variant = F.lower(F.hex(F.conv(F.substring(digest, 17, 2), 16, 10).cast("int").bitwiseAND(F.lit(0x3F)).bitwiseOR(F.lit(0x80))))
    return F.concat_ws(
        "-",
        F.substring(digest, 1, 8),
        F.substring(digest, 9, 4),
        F.concat(F.lit("5"), F.substring(digest, 14, 3)),
        F.concat(variant, F.substring(digest, 19, 2)),
        F.substring(digest, 21, 12),
    )


def hash_bits(column: Column) -> Column:
    """A hexadecimal 64-bit hash as a bigint; NULL where it isn't one."""
    full = F.lpad(F.lower(F.trim(column)), 16, "0")
    high, low = (F.conv(F.substring(full, k, 8), 16, 10).cast("bigint") for k in (1, 9))
    return F.when(F.lower(F.trim(column)).rlike("^[0-9a-f]{1,16}$"), F.shiftleft(high, 32).bitwiseOR(low))


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


@F.pandas_udf(StringType())
def stable_json_hash(text: pd.Series) -> pd.Series:
    """SHA-256 of JSON in its canonical form: sorted keys, no blanks, ASCII."""
    import hashlib

    def one(value: str | None) -> str | None:
        if value is None:
            return None
        try:
            parsed = json.loads(value)
        except ValueError:
            return None
        return hashlib.sha256(json.dumps(parsed, sort_keys=True, separators=(",", ":"), ensure_ascii=True).encode()).hexdigest()

    return text.map(one)


def ordered_fingerprint(value: Column, order: Column) -> Column:
    """Aggregate: SHA-256 over a group's values in order, through per-row digests.

    The digest of each row enters by its sum of two independent hashes, so the
    aggregate is mergeable and holds no list of the group.
    """
    row = F.sha2(F.concat_ws("\u001f", order.cast("string"), value), 256)
    halves = [F.sum(F.conv(F.substring(row, k, 12), 16, 10).cast("decimal(38,0)")) for k in (1, 13, 25)]
    return F.sha2(F.concat_ws(",", F.count("*").cast("string"), *[h.cast("string") for h in halves]), 256)
