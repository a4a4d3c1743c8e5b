"""Validated joins, upserts and differences between table states."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from pictorium.runtime import written


class ContractError(ValueError):
    """Data that breaks what an operator was promised."""


def require_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    missing = sorted(set(columns) - set(df.columns))
    if missing:
        raise ContractError(f"missing columns: {', '.join(missing)}")
    return df


def assert_unique(df: DataFrame, keys: list[str]) -> DataFrame:
    """``df``, after one aggregate has shown that no key occurs twice."""
    twice = df.groupBy(*keys).count().where("count > 1").limit(3).collect()
    if twice:
        raise ContractError(f"keys {keys} aren't unique: {[tuple(r[:-1]) for r in twice]}")
    return df


def validated_join(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner", validate: str = "m:1") -> DataFrame:
    """A join whose cardinality is checked first, ``1:1`` on both sides or ``m:1`` on the right."""
    if validate not in ("1:1", "m:1"):
        raise ValueError(validate)
    if validate == "1:1":
        assert_unique(left, on)
    return left.join(assert_unique(right, on), on, how)


def upsert(base: DataFrame, delta: DataFrame, keys: list[str]) -> DataFrame:
    """``delta`` and the rows of ``base`` that it doesn't replace."""
    return delta.unionByName(base.join(delta.select(*keys), keys, "left_anti"), allowMissingColumns=True)


def insert_if_absent(base: DataFrame, delta: DataFrame, keys: list[str]) -> DataFrame:
    """``base`` and those rows of ``delta``, one per key, whose key is new."""
    return base.unionByName(delta.dropDuplicates(keys).join(base.select(*keys), keys, "left_anti"))


def updated(base: DataFrame, delta: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """``base`` with ``columns`` taken from ``delta`` where it has a value."""
    changes = delta.select(*keys, *[F.col(c).alias(f"_new_{c}") for c in columns])
    joined = base.join(changes, keys, "left")
    return joined.withColumns({c: F.coalesce(F.col(f"_new_{c}"), F.col(c)) for c in columns}).select(*base.columns)


def difference(wanted: DataFrame, present: DataFrame, keys: list[str]) -> DataFrame:
    """Keys of either side with ``state``: missing, unexpected or present."""
    a, b = wanted.select(*keys, F.lit(1).alias("_w")).distinct(), present.select(*keys, F.lit(1).alias("_p")).distinct()
    state = F.when(F.col("_p").isNull(), "missing").when(F.col("_w").isNull(), "unexpected").otherwise("present")
    return a.join(b, keys, "full_outer").select(*keys, state.alias("state"))


def sync_plan(wanted: DataFrame, state: DataFrame, key: str, digest: str, force: bool = False) -> DataFrame:
    """(key, action): insert, update, delete or unchanged, by content digest."""
    a = wanted.select(F.col(key), F.col(digest).alias("_wanted"), F.lit(True).alias("_in"))
    b = state.select(F.col(key), F.col(digest).alias("_held"), F.lit(True).alias("_had"))
    same = F.col("_wanted").eqNullSafe(F.col("_held"))
    action = F.when(F.col("_in").isNull(), "delete").when(F.col("_had").isNull(), "insert").when(same & F.lit(not force), "unchanged").otherwise("update")
    return a.join(b, key, "full_outer").select(key, action.alias("action"))


def semi_join_any(df: DataFrame, scopes: list[tuple[Column, DataFrame, str]], key: str) -> DataFrame:
    """Rows with a partner in any scope: a union of hash semi-joins in place of an OR."""
    parts = [df.join(other.select(F.col(c).alias("_scope")), expr == F.col("_scope"), "left_semi") for expr, other, c in scopes]
    return reduce(DataFrame.unionByName, parts).dropDuplicates([key])


def first_match(df: DataFrame, ladder: list[tuple[str, Column]], otherwise: str, name: str = "reason") -> DataFrame:
    """An exclusion cascade: the first rule of the ladder that holds names the row's reason."""
    chain = F
    for reason, rule in ladder:
        chain = chain.when(F.coalesce(rule, F.lit(False)), reason)
    return df.withColumn(name, chain.otherwise(otherwise))


def unpivot_counts(wide: DataFrame, name: str = "metric", value: str = "value") -> DataFrame:
    """One row per column of a single-row table of counts."""
    return wide.select(*[F.col(c).cast("bigint").alias(c) for c in wide.columns]).unpivot([], wide.columns, name, value)


def placed(df: DataFrame, order: list[str | Column], name: str = "place") -> DataFrame:
    """``df`` with ``name``, each row's place in the whole table by ``order``, which should end with a unique column.

    Rows are cut into ranges of ``order``, written and numbered range by range;
    only the ranges' sizes, one row each, are ever added up in one task.
    """
    ranged = written(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), "ranges")
    before = Window.partitionBy(F.lit(0)).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sizes = ranged.groupBy("_range").agg(F.count("*").alias("_n"))
    sizes = sizes.select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    return ranged.withColumn(name, inside).join(F.broadcast(sizes), "_range").withColumn(name, (F.col("_before") + F.col(name)).cast("int")).drop("_range", "_before")


def zip_strict(left: DataFrame, right: DataFrame, left_order: list[str | Column], right_order: list[str | Column]) -> DataFrame:
    """Rows of two tables of equal size paired by their place in each one's order, which should end with a unique column.

    Columns of the two must not clash; tables of different size are an error.
    """
    if both := sorted(set(left.columns) & set(right.columns)):
        raise ContractError(f"columns of both: {', '.join(both)}")
    a, b = placed(left, left_order, "_place"), placed(right, right_order, "_place")
    n, m = a.count(), b.count()
    if n != m:
        raise ContractError(f"{n} rows can't be paired with {m}")
    return a.join(b, "_place").drop("_place")


def apply_sync(state: DataFrame, wanted: DataFrame, plan: DataFrame, key: str) -> DataFrame:
    """The state after a :func:`sync_plan`: rows to insert or update from ``wanted``, unchanged ones as they are."""
    kept = state.join(plan.where("action = 'unchanged'").select(key), key, "left_semi")
    return kept.unionByName(wanted.join(plan.where("action in ('insert', 'update')").select(key), key, "left_semi"), allowMissingColumns=True)


def with_any_event(df: DataFrame, events: DataFrame, key: str, kind: str, kinds: list[str]) -> DataFrame:
    """Rows with an event of any of the kinds."""
    return df.join(events.where(F.col(kind).isin(*kinds)).select(key).distinct(), key, "left_semi")


def lineage_matches(df: DataFrame, state: DataFrame, key: str, lineage: dict[str, str], name: str = "is_current") -> DataFrame:
    """``df`` with whether the state holds its key under exactly this lineage; a key it lacks doesn't."""
    same = state
    for column, value in lineage.items():
        same = same.where(F.col(column) == F.lit(value))
    held = same.select(F.col(key).alias("_held")).distinct()
    return df.join(held, F.col(key) == F.col("_held"), "left").withColumn(name, F.col("_held").isNotNull()).drop("_held")


def merge_counters(parts: list[DataFrame], by: list[str], counter: str = "n") -> DataFrame:
    """Counters of several runs added up."""
    return reduce(DataFrame.unionByName, parts).groupBy(*by).agg(F.sum(counter).alias(counter))


def sample_errors(df: DataFrame, message: Column, most: int = 100) -> tuple[DataFrame, DataFrame]:
    """The number of rows with a message, and the first ``most`` messages in order."""
    bad = df.select(message.alias("message")).where("message is not null")
    return bad.agg(F.count("*").alias("errors")), bad.orderBy("message").limit(most)
