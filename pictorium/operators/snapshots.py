"""Labels joined with the decisions they were made about, cohorts and facets."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from pictorium.operators.ranks import nearest, values_at

from pictorium.operators.latest import latest_per_key


def snapshot_join(labels: DataFrame, decisions: DataFrame, key: str, label_id: str, snapshot: str, at: str, ordinal: str) -> DataFrame:
    """Every label with the decision it names by time, or the key's last one where it names none.

    Labels whose named decision doesn't exist have no partner and drop out; among
    several decisions of one time the highest ordinal counts.
    """
    named = labels.where(F.col(snapshot).isNotNull()).join(decisions.withColumnRenamed(at, "_at"), key).where(F.col("_at") == F.col(snapshot))
    named = latest_per_key(named, [label_id], [F.col(ordinal).desc()])
    last = latest_per_key(decisions.withColumnRenamed(at, "_at"), [key], [F.col("_at").desc_nulls_last(), F.col(ordinal).desc()])
    free = labels.where(F.col(snapshot).isNull()).join(last, key)
    return named.unionByName(free).withColumnRenamed("_at", at)


def cohorts(df: DataFrame, columns: list[str]) -> DataFrame:
    """(field, value, n): the distinct values of each lineage column."""
    parts = [df.groupBy(F.col(c).cast("string").alias("value")).agg(F.count("*").alias("n")).select(F.lit(c).alias("field"), "value", "n") for c in columns]
    return reduce(DataFrame.unionByName, parts)


def facet_counts(df: DataFrame, facets: list[str], needle: str | None = None, text: list[str] | None = None) -> DataFrame:
    """Counts per facet value in one pass, over rows whose joined text contains ``needle`` in any case."""
    rows = df
    if needle:
        rows = rows.where(F.contains(F.lower(F.concat_ws(" ", *(text or []))), F.lit(needle.lower())))
    cells = F.array(*[F.struct(F.lit(f).alias("facet"), F.col(f).cast("string").alias("value")) for f in facets])
    return rows.select(F.explode(cells).alias("c")).groupBy("c.facet", "c.value").agg(F.count("*").alias("n"))


def nearest_rank(df: DataFrame, by: list[str], value: str, q: float, name: str) -> DataFrame:
    """The element at index round(q * (n - 1)) of each group's sorted values."""
    return values_at(df, by, value, q, {name: nearest(q)}).withColumn(name, F.col(name).cast("double"))


def reason_codes(error: Column, codes: dict[str, str], otherwise: str = "error.unknown") -> Column:
    """The code of an error's type, the part before the first colon."""
    kind = F.trim(F.split(error, ":")[0])
    table = F.create_map(*[F.lit(x) for pair in codes.items() for x in pair])
    return F.when(error.isNotNull(), F.coalesce(F.try_element_at(table, kind), F.lit(otherwise)))
