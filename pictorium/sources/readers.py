"""Readers: logs, tables, files and pages."""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from pictorium.operators.relational import ContractError, require_columns
from pictorium.runtime import retried

CORRUPT = "_corrupt_record"


def read_json_log(spark: SparkSession, path: str, schema: str, strict: bool = True) -> DataFrame:
    """A log of JSON lines with a given schema.

    ``strict`` fails on the first malformed line when the rows are read;
    otherwise malformed lines are passed over.
    """
    return spark.read.schema(schema).option("mode", "FAILFAST" if strict else "DROPMALFORMED").json(path)


def malformed_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """(path, line) of the lines that a strict reader would refuse."""
    lines = spark.read.text(path).select(F.input_file_name().alias("path"), F.col("value").alias("line"))
    parsed = lines.withColumn("row", F.from_json("line", f"{schema}, {CORRUPT} string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT}))
    return parsed.where(F.col(f"row.{CORRUPT}").isNotNull() & (F.trim("line") != "")).select("path", "line")


def read_tables(spark: SparkSession, pattern: str, required: list[str] | None = None) -> DataFrame:
    """Parquet tables by pattern, ``s3://`` as ``s3a://``, with a guard on the columns."""
    path = "s3a://" + pattern[5:] if pattern.startswith("s3://") else pattern
    df = spark.read.parquet(path)
    return require_columns(df, required) if required else df


def read_or_empty(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A table, or an empty one of its schema where it isn't there."""
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jvm_path)
    return spark.read.schema(schema).parquet(path) if there else spark.createDataFrame([], schema)


def read_review_csv(spark: SparkSession, path: str, columns: list[str], required: list[str]) -> tuple[DataFrame, DataFrame]:
    """Complete rows, and counts of seen, complete, blank and partial rows.

    A missing header column is an error; a row with only some of the required
    cells is partial.
    """
    schema = ", ".join(f"`{c}` string" for c in columns)
    header = spark.read.option("header", True).csv(path).columns
    if missing := sorted(set(columns) - set(header)):
        raise ContractError(f"missing columns: {', '.join(missing)}")
    rows = spark.read.option("header", True).csv(path).select(*columns).to(StructType.fromDDL(schema))
    filled = sum((F.when(F.trim(F.coalesce(F.col(c), F.lit(""))) != "", 1).otherwise(0) for c in required), F.lit(0))
    rows = rows.withColumn("_filled", filled)
    counts = rows.agg(
        F.count("*").alias("rows_seen"), F.count_if(F.col("_filled") == len(required)).alias("complete"), F.count_if(F.col("_filled") == 0).alias("blank"),
        F.count_if((F.col("_filled") > 0) & (F.col("_filled") < len(required))).alias("partial"),
    )
    return rows.where(F.col("_filled") == len(required)).drop("_filled"), counts


def read_list(spark: SparkSession, path: str) -> DataFrame:
    """Names one to a line; blanks around them, empty lines and # comments are passed over."""
    name = F.trim(F.col("value"))
    return spark.read.text(path).select(name.alias("name")).where((F.col("name") != "") & ~F.col("name").startswith("#"))


def read_files(spark: SparkSession, path: str, suffixes: tuple[str, ...] = (".jpg", ".jpeg", ".png", ".webp")) -> DataFrame:
    """(path, length, modificationTime, content, sha256) of the files with these suffixes, recursively."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    wanted = F.lower(F.regexp_extract("path", r"(\.[A-Za-z0-9]+)$", 1)).isin(*suffixes)
    return files.where(wanted).withColumn("sha256", F.sha2("content", 256))


def distinct_ids(log: DataFrame, key: str, where: str | None = None) -> DataFrame:
    """Distinct keys of a log; a row without one is an error."""
    rows = log.where(where) if where else log
    if rows.where(F.col(key).isNull()).limit(1).count():
        raise ContractError(f"a row has no {key}")
    return rows.select(key).distinct()


def _document(path: str) -> object:
    """What a JSON, TOML or YAML file holds; YAML needs its library."""
    with open(path, "rb") as file:
        if path.endswith(".toml"):
            import tomllib

            return tomllib.load(file)
        if path.endswith((".yaml", ".yml")):
            try:
                import yaml
            except ImportError as missing:
                raise ContractError(f"{path} needs PyYAML") from missing
            return yaml.safe_load(file)
        return json.load(file)


def load_config(path: str, defaults: dict, checks: dict[str, Callable[[object], bool]] | None = None) -> dict:
    """Settings from JSON, TOML or YAML over defaults.

    Unknown names, values of another type than the default's and values that a
    check refuses are errors.
    """
    given = _document(path) or {}
    if not isinstance(given, dict):
        raise ContractError(f"{path} holds no settings")
    if unknown := sorted(set(given) - set(defaults)):
        raise ContractError(f"unknown settings: {', '.join(unknown)}")
    for name, value in given.items():
        default = defaults[name]
        fits = default is None or type(value) is type(default) or isinstance(default, float) and type(value) is int
        if not fits:
            raise ContractError(f"{name} must be a {type(default).__name__}")
    settings = {**defaults, **given}
    for name, check in (checks or {}).items():
        if not check(settings[name]):
            raise ContractError(f"{name} can't be {settings[name]!r}")
    return settings


def config_hash(settings: dict) -> str:
    """A digest of settings, whatever their order."""
    return hashlib.sha256(json.dumps(settings, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


def read_manifest(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A list of records in a JSON, TOML (under ``items``) or YAML file as a table; missing fields are NULL."""
    held = _document(path)
    rows = held.get("items", []) if isinstance(held, dict) else held or []
    fields = StructType.fromDDL(schema)
    if bad := sorted({k for r in rows for k in r} - set(fields.names)):
        raise ContractError(f"unknown fields: {', '.join(bad)}")
    return spark.createDataFrame([tuple(r.get(n) for n in fields.names) for r in rows], fields)


def s3_settings(endpoint: str | None = None, region: str | None = None, path_style: bool = False) -> dict[str, str]:
    """Session settings for an S3-compatible store; credentials come from the provider chain."""
    out = {"spark.hadoop.fs.s3a.path.style.access": str(path_style).lower()}
    if endpoint:
        out["spark.hadoop.fs.s3a.endpoint"] = endpoint
    if region:
        out["spark.hadoop.fs.s3a.endpoint.region"] = region
    return out


class FeedPages(DataSource):
    """Pages of author feeds kept as JSON files ``<author>/<cursor>.json``: (author, page, item).

    Follows each page's ``cursor`` until none is given, or to the end of so many
    ``pages`` if that option is set; with ``mark_cut`` a feed that this cuts off
    ends with a row of page -1 that holds the cursor to go on from.  One
    partition per author.  The same reader serves an HTTP client by another
    ``load`` function; a load that fails is tried ``attempts`` times.
    """

    @classmethod
    def name(cls) -> str:
        return "feed_pages"

    def schema(self) -> str:
        return "author string, page int, item string"

    def reader(self, schema: StructType) -> "FeedReader":
        return FeedReader(self.options)


class AuthorPartition(InputPartition):
    def __init__(self, author: str):
        self.author = author


class FeedReader(DataSourceReader):
    def __init__(self, options: dict):
        self.root, self.attempts = options["path"], int(options.get("attempts", 3))
        self.pages = int(options["pages"]) if "pages" in options else None
        self.mark_cut = str(options.get("mark_cut", "false")).lower() == "true"

    def partitions(self) -> list[AuthorPartition]:
        return [AuthorPartition(a) for a in sorted(os.listdir(self.root))]

    def load(self, author: str, cursor: str) -> dict:
        place = os.path.join(self.root, author, f"{cursor}.json")
        if not os.path.exists(place):
            return {}
        with open(place) as file:
            return json.load(file)

    def read(self, partition: AuthorPartition):
        cursor: str | None = "first"
        page = 0
        while cursor is not None and (self.pages is None or page < self.pages):
            got = retried(lambda c=cursor: self.load(partition.author, c), self.attempts)
            for item in got.get("feed", []):
                yield partition.author, page, json.dumps(item)
            cursor, page = got.get("cursor"), page + 1
        if cursor is not None and self.mark_cut:
            yield partition.author, -1, json.dumps({"cursor": cursor})


class SqliteTable(DataSource):
    """A table of a SQLite file, read only, in ranges of its row numbers: options ``path``, ``table`` and ``rows`` per range.

    A file or table that isn't there gives no rows.  The schema must be given.
    The file must lie where all executors can read it.
    """

    @classmethod
    def name(cls) -> str:
        return "sqlite_table"

    def reader(self, schema: StructType) -> "SqliteReader":
        return SqliteReader(self.options, schema)


class RowRange(InputPartition):
    def __init__(self, low: int, high: int):
        self.low, self.high = low, high


class SqliteReader(DataSourceReader):
    def __init__(self, options: dict, schema: StructType):
        self.path, self.table, self.rows, self.columns = options["path"], options["table"], int(options.get("rows", 100_000)), schema.names

    def _connect(self):
        import sqlite3

        return sqlite3.connect(f"file:{self.path}?mode=ro", uri=True)

    def partitions(self) -> list[RowRange]:
        import sqlite3

        if not os.path.exists(self.path):
            return [RowRange(0, -1)]
        db = self._connect()
        try:
            low, high = db.execute(f'SELECT min(rowid), max(rowid) FROM "{self.table}"').fetchone()
        except sqlite3.OperationalError:
            low = high = None
        finally:
            db.close()
        if low is None:
            return [RowRange(0, -1)]
        return [RowRange(k, min(high, k + self.rows - 1)) for k in range(low, high + 1, self.rows)]

    def read(self, partition: RowRange):
        if partition.high < partition.low:
            return
        db = self._connect()
        try:
            names = ", ".join(f'"{c}"' for c in self.columns)
            yield from db.execute(f'SELECT {names} FROM "{self.table}" WHERE rowid BETWEEN ? AND ?', (partition.low, partition.high))
        finally:
            db.close()
