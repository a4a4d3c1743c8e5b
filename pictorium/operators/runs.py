"""Immutable tables in one folder and a manifest that names the current ones.

A state that grows by batches is kept as *runs*: tables that are written once
and never changed.  The newest manifest says which runs are current and holds
the owner's notes; it is written whole under a new name, so a reader or a
restarted process sees the state before or after a change, never between.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession

from pictorium.runtime import remove_path


class Runs:
    def __init__(self, spark: SparkSession, place: str):
        """Open the state at ``place``, or begin one there."""
        self.spark, self.place = spark, place.rstrip("/")
        self.version, self.runs, self.notes = 0, [], {}
        if (newest := max(self._manifests(), default=None)) is not None:
            held = json.loads(self._read(self._name(newest)))
            self.version, self.runs, self.notes = newest, held["runs"], held["notes"]

    def _fs(self, path: str):
        target = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return target.getFileSystem(self.spark._jsc.hadoopConfiguration()), target

    def _name(self, version: int) -> str:
        return f"{self.place}/manifest-{version:09d}.json"

    def _manifests(self) -> list[int]:
        fs, target = self._fs(self.place)
        if not fs.exists(target):
            return []
        names = [f.getPath().getName() for f in fs.listStatus(target)]
        return [int(n[9:-5]) for n in names if n.startswith("manifest-") and n.endswith(".json")]

    def _read(self, path: str) -> str:
        fs, target = self._fs(path)
        stream = fs.open(target)
        try:
            return self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def write(self, df: DataFrame, **about) -> dict:
        """Write a run that isn't current yet; see :meth:`commit`."""
        path = f"{self.place}/run-{uuid.uuid4().hex}"
        df.write.option("compression", "zstd").parquet(path)
        return {"path": path, **about}

    def commit(self, add: list[dict] = [], drop: list[dict] = [], **notes) -> None:
        """Make ``add`` current in place of ``drop``, together with the notes; then delete what was dropped."""
        gone = {r["path"] for r in drop}
        runs, noted = [r for r in self.runs if r["path"] not in gone] + list(add), {**self.notes, **notes}
        fs, staged = self._fs(f"{self.place}/.staged-{uuid.uuid4().hex}")
        out = fs.create(staged, False)
        out.write(bytearray(json.dumps({"runs": runs, "notes": noted}).encode()))
        out.close()
        _, target = self._fs(self._name(self.version + 1))
        if not fs.rename(staged, target):
            raise OSError(f"{target} is already there: another process writes to this state")
        before = self._name(self.version)
        self.version, self.runs, self.notes = self.version + 1, runs, noted
        for path in [*gone, before]:
            remove_path(self.spark, path)

    def read(self, schema: str, runs: list[dict] | None = None) -> DataFrame:
        paths = [r["path"] for r in (self.runs if runs is None else runs)]
        if not paths:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*paths)

    def of(self, kind: str) -> list[dict]:
        return [r for r in self.runs if r.get("kind") == kind]

    def small_runs(self, most: int, kind: str | None = None) -> list[dict]:
        """Runs to merge: those of one size class and all smaller ones, once ``most`` of a class have gathered; so a row is rewritten about once per class."""
        classes: dict[int, list[dict]] = {}
        for run in self.of(kind) if kind else self.runs:
            classes.setdefault((max(1, run["rows"]).bit_length() - 1) // max(1, most.bit_length() - 1), []).append(run)
        full = [c for c in sorted(classes) if len(classes[c]) >= most]
        return [r for c in sorted(classes) if c <= full[-1] for r in classes[c]] if full else []
