"""Session factory and lineage cuts that survive the loss of an executor.

Iterative operators cut their lineage by writing a table into the folder that
the cluster names in ``spark.checkpoint.dir``.  That folder is shared by all
executors, so a written step is never recomputed and never lost with one of
them.  Only where the setting is missing on a local master (tests, a laptop) is
a folder chosen here.
"""

from __future__ import annotations

import atexit
import os
import tempfile
import time
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager, suppress
from typing import TypeVar

from pyspark import SparkContext
from pyspark.sql import DataFrame, SparkSession, functions as F

CHECKPOINT_KEY = "spark.checkpoint.dir"
Result = TypeVar("Result")


def build_session(app: str = "pictorium", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators assume: UTC, AQE, Arrow, ANSI on."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
    }
    for key, value in {**defaults, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder for intermediate tables, read from the session."""
    place = spark.conf.get(CHECKPOINT_KEY, None)
    if place:
        return place.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError(f"{CHECKPOINT_KEY} must name a folder that all executors share")
    place = "file://" + os.path.join(tempfile.gettempdir(), f"pictorium-{os.getpid()}")
    spark.conf.set(CHECKPOINT_KEY, place)
    return place


_made: list[str] = []


def fresh_path(spark: SparkSession, label: str) -> str:
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    _made.append(path)
    return path


def remove_intermediate(spark: SparkSession, since: int = 0) -> None:
    """Delete what this process has written to the shared folder; results not yet read are lost."""
    while len(_made) > since:
        remove_path(spark, _made.pop())


@contextmanager
def intermediate(spark: SparkSession) -> Iterator[None]:
    """Delete at the end of the block what was written to the shared folder within it.

    The results of queries begun in the block must have been read or written by then.
    """
    since = len(_made)
    try:
        yield
    finally:
        remove_intermediate(spark, since)


@atexit.register
def _at_exit() -> None:
    """What no block has deleted goes with the process."""
    context = SparkContext._active_spark_context
    session = SparkSession.getActiveSession()
    if _made and context is not None and session is not None:
        with suppress(Exception):
            remove_intermediate(session)


def remove_path(spark: SparkSession, path: str) -> None:
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def written(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder once and return a scan of what was written."""
    spark = df.sparkSession
    path = fresh_path(spark, label)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def blank_to_null(column):
    """Text with the blanks around it removed and lower-cased; nothing left is no value."""
    text = F.lower(F.regexp_replace(column.cast("string"), r"(?U)^\s+|\s+$", ""))
    return F.when(text != "", text)


def slots(spark: SparkSession) -> int:
    """Tasks that run at once; a floor for the number of independent groups."""
    return max(2, spark.sparkContext.defaultParallelism)


def spread(df: DataFrame) -> DataFrame:
    """``df`` over at least as many partitions as tasks run at once.

    For the Python kernels: a small table that lies in a few files would keep
    most cores idle.  A table with enough partitions is left as it is, so large
    inputs are never shuffled for this.
    """
    wanted = slots(df.sparkSession)
    return df.repartition(wanted) if df.rdd.getNumPartitions() < wanted else df


def ship(spark: SparkSession) -> None:
    """Send the package to the executors, unless they find it by the driver's PYTHONPATH or working directory."""
    import zipfile
    from pathlib import Path

    package = Path(__file__).resolve().parent
    root = str(package.parent)
    if root in os.environ.get("PYTHONPATH", "").split(os.pathsep) or os.path.realpath(os.getcwd()) == root:
        return
    context = spark.sparkContext
    if getattr(context, "_pictorium_shipped", False):
        return
    archive = os.path.join(tempfile.mkdtemp(prefix="pictorium-"), "pictorium.zip")
    with zipfile.ZipFile(archive, "w") as out:
        for file in package.rglob("*.py"):
            out.write(file, str(file.relative_to(package.parent)))
    context.addPyFile(archive)
    context._pictorium_shipped = True


def retried(work: Callable[[], Result], attempts: int = 3, base: float = 0.0, cap: float = 60.0) -> Result:
    """The result of ``work``, tried up to ``attempts`` times with growing pauses; the last failure is raised."""
    for attempt in range(attempts):
        try:
            return work()
        except Exception:
            if attempt == attempts - 1:
                raise
            time.sleep(min(cap, base * 2**attempt))
    raise ValueError("attempts must be positive")
