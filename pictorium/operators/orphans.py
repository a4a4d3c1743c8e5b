"""References to records that do not exist.

The parents' keys are range-partitioned and stored as sorted arrays, one row
per range, in a table in the shared folder.  References find their range by
binary search over the ranges' first keys and are probed in vectorised batches
by binary search in the range's array.  A range with many references is split
into salted groups, each of which gets a copy of that one array, so a key that
a third of all rows refer to is spread over many tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from pictorium.runtime import blank_to_null, written

#: Keys in one range and references in one probed group.
KEYS_PER_RANGE = 50_000
REFS_PER_GROUP = 200_000


@dataclass(frozen=True)
class Reference:
    """``column`` of ``child`` refers to ``parent_key`` of the table registered as ``parent``."""

    name: str
    child: DataFrame
    child_key: str
    column: str
    parent: str
    when: str


def _ranges(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    held: list[tuple[str, str]] = [
        (p, k) for frame in batches for p, k in zip(frame["parent"], frame["key"])
    ]
    held.sort()
    start = 0
    while start < len(held):
        stop = start
        while stop < len(held) and stop - start < KEYS_PER_RANGE and held[stop][0] == held[start][0]:
            stop += 1
        yield pd.DataFrame({"parent": [held[start][0]], "low": [held[start][1]], "keys": [[k for _, k in held[start:stop]]]})
        start = stop


def parent_ranges(parents: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """(parent, low, keys): the distinct normalised keys of every parent as sorted arrays per range."""
    keys: DataFrame | None = None
    for name, (df, key) in parents.items():
        part = df.select(F.lit(name).alias("parent"), blank_to_null(F.col(key)).alias("key")).where("key is not null").distinct()
        keys = part if keys is None else keys.unionByName(part)
    keys = written(keys, "parent-keys")
    pieces = max(1, -(-keys.count() // KEYS_PER_RANGE))
    ordered = keys.repartitionByRange(pieces, "parent", "key")
    return written(ordered.mapInPandas(_ranges, "parent string, low string, keys array<string>"), "parent-ranges")


def _range_number(held):
    @F.pandas_udf("int")
    def number(parent: pd.Series, key: pd.Series) -> pd.Series:
        lows = held.value
        out = np.full(len(key), -1, dtype=np.int32)
        for name in parent.unique():
            here = (parent == name).to_numpy()
            if name in lows:
                out[here] = np.searchsorted(lows[name], key.to_numpy(object)[here], side="right") - 1
        return pd.Series(out)

    return number


def _misses(refs: pd.DataFrame, ranges: pd.DataFrame) -> pd.DataFrame:
    wanted = refs["key"].to_numpy(object)
    held = np.zeros(len(refs), dtype=bool)
    for keys in ranges["keys"]:
        keys = np.asarray(keys, dtype=object)
        at = np.searchsorted(keys, wanted, side="left")
        inside = np.flatnonzero(at < len(keys))
        held[inside] |= keys[at[inside]] == wanted[inside]
    return refs.loc[~held, ["ref_field", "child_key", "key", "month", "n"]]


def orphan_references(parents: dict[str, tuple[DataFrame, str]], references: list[Reference], counted: bool = False) -> DataFrame:
    """One row (ref_field, child_key, key, month) per referring row whose key no parent has.

    ``counted`` gives one row (ref_field, key, month, n) per key and month
    instead; equal references are then added up before anything is shuffled.

    Defined results: keys are compared without blanks around them and in lower
    case; an empty or NULL reference is no reference; a NULL time gives a NULL
    month; a NULL child key is reported as NULL; against an empty parent table
    every reference is an orphan.  Repeated rows stay repeated.
    """
    refs: DataFrame | None = None
    for r in references:
        part = r.child.select(
            F.lit(r.name).alias("ref_field"),
            F.lit(r.parent).alias("parent"),
            F.col(r.child_key).cast("string").alias("child_key"),
            blank_to_null(F.col(r.column)).alias("key"),
            F.date_format(F.col(r.when), "yyyy-MM").alias("month"),
        ).where("key is not null")
        refs = part if refs is None else refs.unionByName(part)
    refs = refs.groupBy("ref_field", "parent", "key", "month").agg(F.lit(None).cast("string").alias("child_key"), F.count("*").alias("n")) if counted else refs.withColumn("n", F.lit(1).cast("bigint"))
    ranges = parent_ranges(parents)
    # The list of ranges has one short row per KEYS_PER_RANGE parents.
    lows: dict[str, list[str]] = {}
    for row in ranges.select("parent", "low").sort("parent", "low").collect():
        lows.setdefault(row["parent"], []).append(row["low"])
    number = _range_number(ranges.sparkSession.sparkContext.broadcast({k: np.asarray(v, dtype=object) for k, v in lows.items()}))
    numbered = written(refs.withColumn("rng", number("parent", "key")), "references")
    groups = numbered.groupBy("parent", "rng").agg(F.ceil(F.count("*") / REFS_PER_GROUP).cast("int").alias("salts"))
    ranges = ranges.withColumn("rng", number("parent", F.col("low"))).join(groups, ["parent", "rng"])
    ranges = ranges.withColumn("salt", F.explode(F.expr("sequence(0, salts - 1)"))).drop("salts", "low")
    rows = groups.agg(F.max("salts")).first()[0] or 1
    salt: Column = F.pmod(F.xxhash64("child_key", "key", F.monotonically_increasing_id()), F.lit(rows))
    if rows > 1:  # the groups' list is as short as the list of ranges
        numbered = numbered.join(groups, ["parent", "rng"]).withColumn("salt", F.pmod(salt, F.col("salts")).cast("int")).drop("salts")
    else:
        numbered = numbered.withColumn("salt", F.lit(0))
    cols = ["parent", "rng", "salt"]
    found = numbered.groupBy(*cols).cogroup(ranges.groupBy(*cols)).applyInPandas(_misses, "ref_field string, child_key string, key string, month string, n bigint")
    return found.drop("child_key") if counted else found.drop("n")


def orphan_report(orphans: DataFrame) -> DataFrame:
    """Rows and distinct missing keys per reference and month of the referring row, of references counted or not."""
    rows = F.sum("n") if "n" in orphans.columns else F.count("*")
    return orphans.groupBy("ref_field", "month").agg(rows.alias("orphan_rows"), F.countDistinct("key").alias("missing_keys"))


__all__ = ["Reference", "orphan_references", "orphan_report", "parent_ranges"]
