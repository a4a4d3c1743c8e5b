"""Exactly one copy of every message that was delivered at least once.

An :class:`IdentifierIndex` holds what has been seen as immutable *runs*.  A
run is a table in the shared folder with one row per hash prefix and chunk:
the sorted 128-bit identifiers of the messages accepted in one batch.  An
incoming batch is reduced to its distinct identifiers by a partial aggregate
(so an identifier delivered a billion times costs one row per task), meets the
runs of its prefix, and is looked up by binary search.  What no run holds is
novel and becomes a new run.  Runs of about one size are merged when
``merge_every`` of them have gathered.  A manifest names the current runs, so a
later process goes on where the last one ended.

Replaying a history in slices of arrival time gives, for every version, the
delivery that arrived first, because a slice only ever meets earlier arrivals.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from pictorium.operators.runs import Runs
from pictorium.runtime import blank_to_null, fresh_path, written

RUN_SCHEMA = "prefix int, hi array<bigint>, lo array<bigint>"
#: Distinct identifiers that one prefix of one slice may hold on average.
PER_PREFIX = 250_000
CHUNK = 100_000


def message_version(df: DataFrame, id_col: str = "candidate_id", version_col: str = "post_cid") -> DataFrame:
    """Add ``hi`` and ``lo``, 128 bits that stand for (identifier, version).

    Both parts are normalised.  A version without a value equals an empty one;
    a message without an identifier has no version and gets NULL.
    """
    key = F.concat_ws("\u001f", blank_to_null(F.col(id_col)), F.coalesce(blank_to_null(F.col(version_col)), F.lit("")))
    known = blank_to_null(F.col(id_col)).isNotNull()
    return df.withColumn("hi", F.when(known, F.xxhash64(key))).withColumn("lo", F.when(known, F.xxhash64(F.lit("second half"), key)))


def in_sorted(hi: np.ndarray, lo: np.ndarray, q_hi: np.ndarray, q_lo: np.ndarray) -> np.ndarray:
    """Which queries occur in the identifiers sorted by (hi, lo)."""
    found = np.zeros(len(q_hi), dtype=bool)
    if not len(hi):
        return found
    at = np.searchsorted(hi, q_hi, side="left")
    open_ = np.flatnonzero(at < len(hi))
    while len(open_):  # one turn per identifier that shares its first half
        open_ = open_[hi[at[open_]] == q_hi[open_]]
        found[open_] |= lo[at[open_]] == q_lo[open_]
        at[open_] += 1
        open_ = open_[(at[open_] < len(hi)) & ~found[open_]]
    return found


def _novel(batch: pd.DataFrame, runs: pd.DataFrame) -> pd.DataFrame:
    seen = np.zeros(len(batch), dtype=bool)
    q_hi, q_lo = batch["hi"].to_numpy(np.int64), batch["lo"].to_numpy(np.int64)
    for hi, lo in zip(runs["hi"], runs["lo"]):
        seen |= in_sorted(np.asarray(hi, np.int64), np.asarray(lo, np.int64), q_hi, q_lo)
    return batch.loc[~seen]


def _sorted_arrays(rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values(["hi", "lo"])
    out = [
        (int(rows["prefix"].iloc[0]), rows["hi"].to_numpy()[k : k + CHUNK], rows["lo"].to_numpy()[k : k + CHUNK])
        for k in range(0, len(rows), CHUNK)
    ]
    return pd.DataFrame(out, columns=["prefix", "hi", "lo"])


def _merged_runs(rows: pd.DataFrame) -> pd.DataFrame:
    hi, lo = (np.concatenate([np.asarray(x, np.int64) for x in rows[c]]) for c in ("hi", "lo"))
    return _sorted_arrays(pd.DataFrame({"prefix": rows["prefix"].iloc[0], "hi": hi, "lo": lo}))


class IdentifierIndex:
    """Identifiers seen so far, as sorted arrays by hash prefix in immutable runs.

    With a ``place`` the index is kept there and found again by a later process;
    without one it lies in a fresh folder.  The number of prefixes grows with
    what is held, so no prefix outgrows a task.
    """

    def __init__(self, spark: SparkSession, prefixes: int = 1, merge_every: int = 4, place: str | None = None, per_prefix: int = PER_PREFIX):
        self.spark, self.merge_every, self.per_prefix = spark, merge_every, per_prefix
        self.state = Runs(spark, place or fresh_path(spark, "identifiers"))
        self.prefixes = self.state.notes.get("prefixes", prefixes)

    @property
    def runs(self) -> list[dict]:
        return self.state.runs

    @property
    def held(self) -> int:
        return sum(run["rows"] for run in self.runs)

    def done(self, stream: str) -> int:
        """The last batch of ``stream`` whose identifiers the index holds; -1 before the first."""
        return self.state.notes.get(f"stream:{stream}", -1)

    def prefix(self):
        return F.pmod(F.shiftright(F.col("hi"), 16), F.lit(self.prefixes)).cast("int")

    def novel(self, firsts: DataFrame) -> DataFrame:
        """The rows of ``firsts`` (hi, lo, delivery) whose identifier no run holds."""
        rows = firsts.withColumn("prefix", self.prefix())
        if not self.runs:
            return rows
        kept = rows.groupBy("prefix").cogroup(self.state.read(RUN_SCHEMA).groupBy("prefix"))
        return kept.applyInPandas(_novel, rows.schema)

    def accept(self, novel: DataFrame, stream: str | None = None, epoch: int = -1) -> None:
        """Persist the identifiers of ``novel`` as a new run, and with it that ``epoch`` is done; merge runs when enough have gathered."""
        rows = novel.count()
        run = self.state.write(novel.select("prefix", "hi", "lo").groupBy("prefix").applyInPandas(_sorted_arrays, RUN_SCHEMA), rows=rows)
        self.state.commit([run], prefixes=self.prefixes, **({f"stream:{stream}": epoch} if stream is not None else {}))
        if self.held > self.prefixes * self.per_prefix:
            self._split(max(2 * self.prefixes, -(-2 * self.held // self.per_prefix)))
        elif small := self.state.small_runs(self.merge_every):
            merged = self.state.read(RUN_SCHEMA, small).groupBy("prefix").applyInPandas(_merged_runs, RUN_SCHEMA)
            self.state.commit([self.state.write(merged, rows=sum(r["rows"] for r in small))], small)

    def _split(self, prefixes: int) -> None:
        """All runs as one with more prefixes; each time at least twice as many, so a row is moved seldom."""
        self.prefixes = prefixes
        held = self.state.read(RUN_SCHEMA).select(F.explode(F.arrays_zip("hi", "lo")).alias("x")).select("x.hi", "x.lo").withColumn("prefix", self.prefix())
        old = list(self.runs)
        run = self.state.write(held.groupBy("prefix").applyInPandas(_sorted_arrays, RUN_SCHEMA), rows=self.held)
        self.state.commit([run], old, prefixes=prefixes)

    def unseen(self, batch: DataFrame, arrived: str, delivery: str) -> DataFrame:
        """The first delivery of every version in ``batch`` that the index doesn't hold, written; the index doesn't learn it."""
        firsts = (
            batch.where(F.col("hi").isNotNull() & F.col(delivery).isNotNull())
            .groupBy("hi", "lo")
            .agg(F.min(F.struct(F.col(arrived).isNull().alias("late"), F.col(arrived).alias("arrived"), F.col(delivery).alias("delivery"))).alias("first"))
            .select("hi", "lo", F.col("first.delivery").alias("delivery"))
        )
        return written(self.novel(firsts), "novel")

    def check(self, batch: DataFrame, arrived: str, delivery: str) -> DataFrame:
        """One batch: its first delivery of every version not seen before; the index learns them."""
        novel = self.unseen(batch, arrived, delivery)
        self.accept(novel)
        return novel


def _slices(df: DataFrame, arrived: str, count: int) -> list:
    """Boundaries that cut the arrivals into ``count`` batches of about equal size."""
    marks = df.agg(F.percentile_approx(arrived, [k / count for k in range(1, count)], 1000)).first()[0] if count > 1 else None
    return sorted(set(marks or []))


def first_deliveries(
    df: DataFrame,
    *,
    id_col: str = "candidate_id",
    version_col: str = "post_cid",
    arrived: str = "received_at",
    delivery: str = "delivery_id",
    slices: int = 4,
    per_prefix: int = PER_PREFIX,
) -> DataFrame:
    """(hi, lo, delivery) of the kept delivery of every version, by replay in order of arrival.

    Defined results: a NULL arrival counts as the latest; equal arrivals go to
    the smaller delivery; an empty or NULL version is one version; rows without
    an identifier or a delivery have no kept row.
    """
    spark = df.sparkSession
    keyed = message_version(df.select(id_col, version_col, arrived, delivery), id_col, version_col)
    total = df.select(arrived).count()
    index = IdentifierIndex(spark, prefixes=max(1, -(-total // per_prefix)), per_prefix=per_prefix)
    marks = _slices(df, arrived, slices)
    kept: DataFrame | None = None
    for low, high in zip([None, *marks], [*marks, None]):
        here = F.lit(True)
        if low is not None:
            here = here & (F.col(arrived) > F.lit(low) if high is not None else F.col(arrived).isNull() | (F.col(arrived) > F.lit(low)))
        if high is not None:
            here = here & (F.col(arrived) <= F.lit(high))
        novel = index.check(keyed.where(here), arrived, delivery)
        kept = novel if kept is None else kept.unionByName(novel)
    return kept.select("hi", "lo", "delivery")


def repeated_deliveries(df: DataFrame, *, delivery: str = "delivery_id", id_col: str = "candidate_id", **options) -> DataFrame:
    """Every delivery of ``df`` that is not the kept one of its version.

    ``delivery`` must be unique; the kept deliveries are taken off by that key,
    so no version, however often delivered, gathers in one task.  Rows without
    an identifier can't repeat anything and are not reported.
    """
    kept = first_deliveries(df, delivery=delivery, id_col=id_col, **options).select(F.col("delivery").alias("_kept"))
    known = df.where(blank_to_null(F.col(id_col)).isNotNull() & F.col(delivery).isNotNull()).select(delivery)
    return known.join(kept, known[delivery] == kept["_kept"], "left_anti")


def exactly_once_sink(index: IdentifierIndex, out: str, *, id_col: str, version_col: str, arrived: str, delivery: str, stream: str = "intake"):
    """A ``foreachBatch`` function that appends only first deliveries to the table at ``out``.

    A batch's rows go to a folder of its own, ``out/batch=<stream>-<number>``,
    which a repeated batch overwrites; only then does the index learn them and
    that the batch is done.  A failure between the two steps loses and doubles
    nothing.  ``stream`` names the checkpoint whose batches are numbered.
    """

    def sink(batch: DataFrame, epoch: int) -> None:
        if epoch <= index.done(stream):
            return
        novel = index.unseen(message_version(batch, id_col, version_col), arrived, delivery)
        fresh = batch.join(novel.select(F.col("delivery").alias("_kept")), F.col(delivery) == F.col("_kept"), "left_semi")
        fresh.write.mode("overwrite").parquet(f"{out}/batch={stream}-{epoch:09d}")
        index.accept(novel, stream, epoch)

    return sink
