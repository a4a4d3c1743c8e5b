"""Exact and near copies by content and perceptual hash."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from pictorium.functions.keys import hamming, hash_bits


def exact_groups(df: DataFrame, record: str, digest: str) -> DataFrame:
    """(digest, copies, representative) of contents held more than once; one row per group, not per pair."""
    groups = df.where(F.col(digest).isNotNull()).groupBy(digest).agg(F.count("*").alias("copies"), F.min(record).alias("representative"))
    return groups.where("copies > 1")


BANDS, BAND_BITS = 4, 16


def near_duplicates(df: DataFrame, record: str, phash: str, most: int = 6) -> DataFrame:
    """(a, b, distance): distinct hashes within ``most`` bits (at most 7), as hexadecimal text a < b.

    Copies of a hash are one row; :func:`hash_members` says which records have it.
    Two 64-bit hashes within 7 bits differ in one of four 16-bit bands by at most
    one bit.  So every hash is looked for under its four bands and, where more
    than three bits may differ, under those with one bit changed: 1 in 65,536
    hashes shares a band by chance.  A band that many hashes share is a skewed
    join key, which adaptive execution splits.
    """
    if not 0 <= most < 2 * BANDS:
        raise ValueError("most must be between 0 and 7")
    hashes = df.select(hash_bits(F.col(phash)).alias("h")).where("h is not null").distinct()

    def bits(band: int) -> Column:
        return F.shiftrightunsigned("h", BAND_BITS * band).bitwiseAND(F.lit((1 << BAND_BITS) - 1)).cast("int")

    masks = [0] + ([1 << k for k in range(BAND_BITS)] if most >= BANDS else [])
    held = hashes.select(F.col("h").alias("o"), F.posexplode(F.array(*[bits(b) for b in range(BANDS)])).alias("band", "bits"))
    asked = hashes.select("h", F.posexplode(F.array(*[bits(b) for b in range(BANDS)])).alias("band", "own"))
    asked = asked.select("h", "band", F.explode(F.array(*[F.col("own").bitwiseXOR(F.lit(m)) for m in masks])).alias("bits"))
    pairs = asked.join(held, ["band", "bits"]).where((F.col("h") < F.col("o")) & (hamming(F.col("h"), F.col("o")) <= most))
    pairs = pairs.select("h", "o").distinct().withColumn("distance", hamming(F.col("h"), F.col("o")))
    text = [F.lower(F.lpad(F.hex(c), 16, "0")) for c in ("h", "o")]
    return pairs.select(F.least(*text).alias("a"), F.greatest(*text).alias("b"), F.col("distance").cast("int").alias("distance"))


def hash_members(df: DataFrame, record: str, phash: str) -> DataFrame:
    """(record, hash): the hash, as :func:`near_duplicates` names it, of every record with a readable one."""
    return df.select(F.col(record), hash_bits(F.col(phash)).alias("h")).where("h is not null").select(record, F.lower(F.lpad(F.hex("h"), 16, "0")).alias("hash"))
