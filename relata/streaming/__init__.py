"""Structured Streaming entry points. Every operator of this library is a DataFrame function without state
of its own, so filters, projections and static joins run on streams as they are; see ``follow``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from relata.sources.storage import StoredTable


def follow(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """A stream of the rows appended to a heap, or to a plain Parquet folder (whose schema must be given).

    A sorted table can't be followed: each insert writes its old rows again. A heap can from its first rows on.
    """
    if StoredTable.exists(spark, path):
        table = StoredTable.open(spark, path)
        if table.kind != "heap":
            raise ValueError(f"{path} is sorted: its inserts write old rows again")
        if not table.version:
            raise FileNotFoundError(f"{path} has no rows yet")
        path, schema = f"{path}/{table.version}", schema or table.scan().schema
    return spark.readStream.schema(schema).parquet(path)
