"""Stored tables: Parquet folders with a sidecar that says how they lie.

A heap keeps rows as they come. A sorted table is range-partitioned and sorted by its keys, so that row-group
statistics let a bounded scan skip what lies outside. Inserts into a sorted table are merged with the old
rows into a new version; the sidecar then names that version, so readers never see half of one.
"""

from __future__ import annotations

import json
import tempfile
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from relata.functions import cnf
from relata.sources import text


def scratch_path(spark: SparkSession) -> str:
    """A new folder under spark.checkpoint.dir; of this machine only where Spark runs in this process."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("spark.checkpoint.dir is unset: executors need a shared folder")
        base = tempfile.mkdtemp(prefix="relata")
        spark.conf.set("spark.checkpoint.dir", base)
    path = f"{base}/relata-{uuid.uuid4().hex}"
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = place.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(place)
    fs.deleteOnExit(place)
    return path


@dataclass
class StoredTable:
    spark: SparkSession
    path: str
    kind: str  # heap or sorted
    keys: list[str]
    version: str
    schema: T.StructType | None = None  # where it was declared

    # the sidecar is one line of text, read and written through Spark's file systems

    @staticmethod
    def _file(spark: SparkSession, path: str):  # noqa: ANN205
        jvm = spark._jvm
        place = jvm.org.apache.hadoop.fs.Path(f"{path}/_meta.json")
        return place.getFileSystem(spark._jsc.hadoopConfiguration()), place

    def _save(self) -> None:
        fs, place = self._file(self.spark, self.path)
        out = fs.create(place, True)
        out.write(bytearray(json.dumps({"kind": self.kind, "keys": self.keys, "version": self.version, "schema": self.schema and self.schema.jsonValue()}).encode()))
        out.close()

    @classmethod
    def create(cls, spark: SparkSession, path: str, kind: str = "heap", keys: list[str] | str = (), schema: T.StructType | None = None) -> StoredTable:
        keys = cnf.sort_keys(keys) if isinstance(keys, str) else list(keys)
        if kind not in ("heap", "sorted") or (kind == "sorted") != bool(keys):
            raise ValueError("a heap has no keys, a sorted table has some")
        out = cls(spark, path, kind, keys, "", schema)
        out._save()
        return out

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> StoredTable:
        fs, place = cls._file(spark, path)
        stream = fs.open(place)
        meta = json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        stream.close()
        schema = meta.get("schema")
        return cls(spark, path, meta["kind"], meta["keys"], meta["version"], schema and T.StructType.fromJson(schema))

    @classmethod
    def exists(cls, spark: SparkSession, path: str) -> bool:
        fs, place = cls._file(spark, path)
        return fs.exists(place)

    def drop(self) -> None:
        fs, place = self._file(self.spark, self.path)
        fs.delete(place.getParent(), True)

    def scan(self, predicate: str | None = None) -> DataFrame:
        """All rows, or those of a predicate, which is pushed to the reader."""
        if not self.version and self.schema:
            return self.spark.createDataFrame([], self.schema)
        if not self.version:
            raise FileNotFoundError(f"{self.path} has no rows yet")
        df = self.spark.read.parquet(f"{self.path}/{self.version}")
        return df if predicate is None else df.where(cnf.to_column(predicate, df.schema))

    def bounded_scan(self, predicate: str) -> DataFrame:
        """Rows of a sorted table that meet a predicate with a bound on its leading key; the rest is skipped."""
        bounded = any(len(c) == 1 and self.keys[:1] == c[0].names for c in cnf.parse(predicate).clauses)
        if self.kind != "sorted" or not bounded:
            raise ValueError("needs a sorted table and a bound on its leading key")
        return self.scan(predicate)

    def _lay(self, df: DataFrame, version: str) -> None:
        if self.kind == "sorted":
            df = df.orderBy(*self.keys)
        df.write.parquet(f"{self.path}/{version}")

    def append(self, rows: DataFrame) -> None:
        """Adds rows: a heap appends, a sorted table merges into a new version."""
        if self.kind == "heap" and self.version:
            rows.write.mode("append").parquet(f"{self.path}/{self.version}")
            return
        version = f"v-{uuid.uuid4().hex}"
        self._lay(self.scan().unionByName(rows) if self.version else rows, version)
        self.version = version
        self._save()

    def load_text(self, path: str, schema) -> None:  # noqa: ANN001
        """Bulk load of a text table."""
        self.append(text.read_table(self.spark, path, schema))

    def count(self) -> int:
        return self.scan().agg(F.count("*")).first()[0]
