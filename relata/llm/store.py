"""Intermediate tables in the folder that the cluster shares, and files and the package to Python workers."""

from __future__ import annotations

import hashlib
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from functools import cache
from pathlib import Path
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session; where it is unset, a folder of this machine if Spark runs in this process only (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not (spark.sparkContext.master == "local" or spark.sparkContext.master.startswith("local[")):
            raise RuntimeError("spark.checkpoint.dir is unset: executors need a shared folder for intermediate tables")
        found = f"{own_dir()}/shared"
        spark.conf.set("spark.checkpoint.dir", found)
    return found


@cache
def _own_dir() -> tempfile.TemporaryDirectory:
    return tempfile.TemporaryDirectory(prefix="relata")


def own_dir() -> str:
    """The driver's own folder, until it ends: for what Spark sends to executors from there."""
    return _own_dir().name


_SHIPPED: set[tuple[str, str]] = set()


def ship_package(spark: SparkSession) -> None:
    """Sends this package to the Python workers, once for each application; they may not have it installed."""
    sc = spark.sparkContext
    if (sc.applicationId, "package") in _SHIPPED:
        return
    root = Path(__file__).resolve().parent.parent
    path = f"{own_dir()}/relata.zip"
    with zipfile.ZipFile(path, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    sc.addPyFile(path)
    _SHIPPED.add((sc.applicationId, "package"))


def ship_file(spark: SparkSession, path: str) -> str:
    """Sends a file of the driver to executors; returns its name for SparkFiles.get. Equal files go once."""
    sc, hashed = spark.sparkContext, hashlib.sha256()
    with open(path, "rb") as f:
        while block := f.read(1 << 20):
            hashed.update(block)
    name = f"relata-{hashed.hexdigest()[:32]}"
    if (sc.applicationId, name) not in _SHIPPED:
        shutil.copyfile(path, f"{own_dir()}/{name}")
        sc.addFile(f"{own_dir()}/{name}")
        _SHIPPED.add((sc.applicationId, name))
    return name


@contextmanager
def small_batches(spark: SparkSession, rows: int) -> Iterator[None]:
    """Within, workers get their rows in Arrow batches of at most so many."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, min(rows, int(before)) if int(before) > 0 else rows)
    try:
        yield
    finally:
        spark.conf.set(key, before)


_PATHS: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()
_MADE: list[str] = []


def _at(spark: SparkSession, path: str):  # noqa: ANN202
    """(file system, path) of the JVM."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def cut(df: DataFrame) -> DataFrame:
    """df, written to the shared folder and read back: later steps do not compute it again.

    The table goes when the driver's JVM ends, or earlier by free().
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/relata-{uuid.uuid4().hex}"
    df.write.parquet(path)
    files, at = _at(spark, path)
    files.deleteOnExit(at)
    out = spark.read.schema(df.schema).parquet(path)
    _PATHS[out] = path
    _MADE.append(path)
    return out


def same_table(table: DataFrame, view: DataFrame) -> DataFrame:
    """view (a select of table), which stands for the table of cut() from now on."""
    _PATHS[view] = _PATHS.pop(table)
    return view


def _delete(spark: SparkSession, path: str) -> None:
    files, at = _at(spark, path)
    files.delete(at, True)
    files.cancelDeleteOnExit(at)
    _MADE.remove(path)


def free(*tables: DataFrame) -> None:
    """Deletes tables that cut() wrote; nothing that is still to be computed may read them."""
    for t in tables:
        if path := _PATHS.pop(t, None):
            _delete(t.sparkSession, path)


@contextmanager
def last_only(spark: SparkSession) -> Iterator[None]:
    """Deletes at its end all tables that cut() wrote within, but the last one."""
    before = set(_MADE)
    yield
    for path in [p for p in _MADE if p not in before][:-1]:
        _delete(spark, path)
