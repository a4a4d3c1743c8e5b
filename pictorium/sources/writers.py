"""Writers: tables, logs, reports, objects and pointers.

Paths are Hadoop paths; a table becomes visible only when it is whole.
"""

from __future__ import annotations

import hashlib
import html
import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from pictorium.functions.text import html_safe_json, spreadsheet_safe
from pictorium.operators.relational import ContractError


def _fs(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def exists(spark: SparkSession, path: str) -> bool:
    fs, target = _fs(spark, path)
    return fs.exists(target)


def delete(spark: SparkSession, path: str) -> bool:
    fs, target = _fs(spark, path)
    return fs.delete(target, True)


def _rename(spark: SparkSession, source: str, target: str) -> None:
    fs, a = _fs(spark, source)
    _, b = _fs(spark, target)
    if not fs.rename(a, b):
        raise OSError(f"can't move {source} to {target}")


def write_table(df: DataFrame, path: str, partition_by: list[str] | None = None) -> str:
    writer = df.write.mode("overwrite").option("compression", "zstd")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    return path


def write_ordered(df: DataFrame, path: str, keys: list[str]) -> str:
    """A small report as one sorted file."""
    df.orderBy(*keys).coalesce(1).write.mode("overwrite").option("compression", "zstd").parquet(path)
    return path


def replace_table(df: DataFrame, path: str) -> str:
    """Overwrite so that readers see the old or the new table: written aside, then moved."""
    spark = df.sparkSession
    staged, old = f"{path}.staged-{uuid.uuid4().hex}", f"{path}.old-{uuid.uuid4().hex}"
    df.write.parquet(staged)
    if exists(spark, path):
        _rename(spark, path, old)
    _rename(spark, staged, path)
    if exists(spark, old):
        delete(spark, old)
    return path


def append_new(df: DataFrame, path: str, keys: list[str]) -> int:
    """Append the rows, one per key, whose key the log doesn't hold; returns their number."""
    spark = df.sparkSession
    fresh = df.dropDuplicates(keys)
    if exists(spark, path):
        held = spark.read.schema(df.schema).parquet(path).select(*[F.coalesce(F.col(k).cast("string"), F.lit("\u0000")).alias(f"_{k}") for k in keys])
        match = [F.coalesce(F.col(k).cast("string"), F.lit("\u0000")) == F.col(f"_{k}") for k in keys]
        fresh = fresh.join(held, match, "left_anti")
    from pictorium.runtime import written

    fresh = written(fresh, "append")
    n = fresh.count()
    if n:
        fresh.write.mode("append").parquet(path)
    return n


def append_changed(df: DataFrame, path: str, content: list[str]) -> int:
    """Append rows whose content differs from all rows held; ``content_hash`` is kept with them."""
    digest = F.sha2(F.to_json(F.struct(*content)), 256)
    return append_new(df.withColumn("content_hash", digest), path, ["content_hash"])


def write_csv(df: DataFrame, path: str) -> str:
    """CSV with header; text cells that a spreadsheet would take for formulas are quoted."""
    safe = [spreadsheet_safe(F.col(n)).alias(n) if t == "string" else F.col(n) for n, t in df.dtypes]
    df.select(*safe).coalesce(1).write.mode("overwrite").option("header", True).csv(path)
    return path


def write_json_report(df: DataFrame, path: str) -> str:
    """A result as one JSON document with sorted keys; rows pass through the driver one partition at a time."""
    fs, target = _fs(df.sparkSession, path)
    out = fs.create(target, True)
    try:
        out.write(bytearray(b"["))
        for number, row in enumerate(df.select(F.to_json(F.struct("*")).alias("j")).toLocalIterator()):
            body = json.dumps(json.loads(row["j"]), sort_keys=True, indent=2)
            out.write(bytearray(((",\n" if number else "\n") + body).encode()))
        out.write(bytearray(b"\n]"))
    finally:
        out.close()
    return path


def write_json_lines(df: DataFrame, path: str) -> str:
    """One JSON object to a line, NULL fields included, in as many files as there are tasks."""
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(path)
    return path


def write_roster(df: DataFrame, name: str, path: str, title: str) -> str:
    """A short list of names, one to a line under a comment, as ``readers.read_list`` reads it."""
    names = [r[0] for r in df.select(name).collect()]
    return _write_text(df.sparkSession, path, "\n".join([f"# {title}", *names]) + "\n")


_PAGE = """<!doctype html><meta charset="utf-8"><title>{title}</title>
<style>body{{font:14px sans-serif;margin:2em}}td,th{{padding:.2em .6em;text-align:left}}</style>
<h1>{title}</h1><table id="rows"></table>
<script type="application/json" id="payload">"""
_SCRIPT = """</script>
<script>
const rows = JSON.parse(document.getElementById("payload").textContent), table = document.getElementById("rows");
const names = rows.length ? Object.keys(rows[0]) : [], line = (cells, tag) => { const tr = table.insertRow(); for (const c of cells) { const e = document.createElement(tag); e.textContent = c ?? ""; tr.append(e); } };
line(names, "th"); for (const r of rows) line(names.map(n => r[n]), "td");
</script>
"""


def write_gallery(payload: DataFrame, column: str, path: str, title: str) -> str:
    """A static page that holds the JSON texts of ``column`` and shows them as a table."""
    fs, target = _fs(payload.sparkSession, path)
    out = fs.create(target, True)
    try:
        out.write(bytearray(_PAGE.format(title=html.escape(title)).encode()))
        out.write(bytearray(b"["))
        for number, row in enumerate(payload.select(html_safe_json(F.col(column)).alias("j")).toLocalIterator()):
            out.write(bytearray(((",\n" if number else "") + row["j"]).encode()))
        out.write(bytearray(("]" + _SCRIPT).encode()))
    finally:
        out.close()
    return path


def _write_text(spark: SparkSession, path: str, body: str) -> str:
    fs, target = _fs(spark, path)
    out = fs.create(target, True)
    out.write(bytearray(body.encode()))
    out.close()
    return path


def read_text(spark: SparkSession, path: str) -> str:
    return "\n".join(r[0] for r in spark.read.text(path).collect())


class ObjectStore:
    """Immutable objects under their digest: ``root/namespace/sha256/ab/cd/<digest><suffix>``."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def path(self, namespace: str, digest: str, suffix: str = "") -> str:
        if len(digest) != 64 or set(digest) - set("0123456789abcdef"):
            raise ContractError("not a SHA-256 digest")
        return f"{self.root}/{namespace}/sha256/{digest[:2]}/{digest[2:4]}/{digest}{suffix}"

    def put(self, namespace: str, content: bytes, suffix: str = "") -> str:
        """Store once; an object that is already there must have the same content."""
        path = self.path(namespace, hashlib.sha256(content).hexdigest(), suffix)
        if exists(self.spark, path):
            if self.get(path) != content:
                raise ContractError(f"another content is held at {path}")
            return path
        staged = f"{path}.{uuid.uuid4().hex}"
        fs, target = _fs(self.spark, staged)
        out = fs.create(target, False)
        out.write(bytearray(content))
        out.close()
        _rename(self.spark, staged, path)
        return path

    def get(self, path: str) -> bytes:
        row = self.spark.read.format("binaryFile").load(path).select("content").first()
        content = bytes(row[0])
        digest = path.rsplit("/", 1)[1][:64]
        if hashlib.sha256(content).hexdigest() != digest:
            raise ContractError(f"{path} doesn't hold what its name says")
        return content

    def delete(self, path: str) -> bool:
        return delete(self.spark, path)

    def exists(self, path: str) -> bool:
        return exists(self.spark, path)


class VersionedTable:
    """Versions of a table in one folder and a pointer to the current one."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def write(self, df: DataFrame, bundle: str) -> str:
        name = f"v-{bundle}-{uuid.uuid4().hex[:8]}"
        df.write.parquet(f"{self.root}/{name}")
        _write_text(self.spark, f"{self.root}/{name}.schema.json", json.dumps({"bundle": bundle, "schema": df.schema.jsonValue()}))
        return name

    def promote(self, name: str, expected_bundle: str) -> None:
        """Point to a version after checking what it was made with."""
        meta = json.loads(read_text(self.spark, f"{self.root}/{name}.schema.json"))
        if meta["bundle"] != expected_bundle:
            raise ContractError(f"{name} was made with {meta['bundle']}")
        _write_text(self.spark, f"{self.root}/current.json", json.dumps({"version": name}))

    def current(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/{json.loads(read_text(self.spark, f'{self.root}/current.json'))['version']}")


def archive(spark: SparkSession, path: str, to: str, stamp: str) -> str:
    """Move a table into a dated folder with a note of where it came from; see :func:`restore`."""
    target = f"{to}/{stamp}"
    fs, parent = _fs(spark, target)
    fs.mkdirs(parent)
    _rename(spark, path, f"{target}/data")
    _write_text(spark, f"{target}/manifest.json", json.dumps({"from": path}))
    return target


def restore(spark: SparkSession, archived: str) -> str:
    origin = json.loads(read_text(spark, f"{archived}/manifest.json"))["from"]
    _rename(spark, f"{archived}/data", origin)
    return origin


def log_run(spark: SparkSession, path: str, run: str, event: str, details: dict | None = None) -> None:
    """Append one event of a run."""
    row = [(run, event, json.dumps(details or {}, sort_keys=True))]
    stamped: Column = F.current_timestamp()
    spark.createDataFrame(row, "run string, event string, details string").withColumn("at", stamped).write.mode("append").parquet(path)


def publish_bundle(store: ObjectStore, artifacts: dict[str, bytes], details: dict | None = None) -> dict:
    """Store each artifact under its digest and write the bundle that names them; equal artifacts give an equal bundle."""
    held = {name: {"path": store.put("artifacts", content), "sha256": hashlib.sha256(content).hexdigest(), "bytes": len(content)} for name, content in sorted(artifacts.items())}
    body = json.dumps({"artifacts": held, "details": details or {}}, sort_keys=True).encode()
    return {"path": store.put("bundles", body, ".json"), "artifacts": held}
