"""Relational operators over DataFrames; Catalyst picks the physical ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from relata.functions import arith, cnf
from relata.functions.cnf import type_name


def select_file(spark: SparkSession, path: str, predicate: str, strict: bool = False) -> DataFrame:
    """Scan of a stored table with a predicate, which reaches the Parquet reader."""
    return select(spark.read.parquet(path), predicate, strict)


def select(df: DataFrame, predicate: str | cnf.CNF, strict: bool = False) -> DataFrame:
    return df.where(cnf.to_column(predicate, df.schema, strict))


def project(df: DataFrame, keep: list[str] | list[int]) -> DataFrame:
    """Columns by name or place, in the given order; unknown ones raise KeyError."""
    names = [df.columns[k] if isinstance(k, int) else k for k in keep]
    if unknown := [n for n in names if n not in df.columns]:
        raise KeyError(f"no columns {unknown}")
    return df.select(*[F.col(f"`{n}`") for n in names])


def join(left: DataFrame, right: DataFrame, predicate: str | cnf.CNF, keep: list[str] | None = None) -> DataFrame:
    """Inner join on the whole predicate: equalities become keys, what is left is a residual condition.

    A name that both sides have is the left one's, here and in keep. The result has the left columns, then the
    right ones, or those in keep.
    """
    predicate = cnf.parse(predicate) if isinstance(predicate, str) else predicate
    both = [c for c in right.columns if c in left.columns]
    if not set(both) & {*predicate.names, *(keep or ())}:
        out = left.join(right, cnf.to_column(predicate), "inner")
        return out if keep is None else out.select(*keep)
    names = [f"__right.{c}" if c in both else c for c in right.columns]
    out = left.join(right.toDF(*names), cnf.to_column(predicate), "inner")
    if keep is not None:
        return out.select(*keep)
    return out.select(*[F.col(f"`{c}`") for c in left.columns], *[F.col(f"`{n}`").alias(c) for n, c in zip(names, right.columns)])


def _amount(df: DataFrame, function: str | Column, grammar: str) -> Column:
    return arith.to_column(function, df.schema, grammar) if isinstance(function, str) else function


def sum_(df: DataFrame, function: str | Column, grammar: str = "standard", distinct: bool = False) -> DataFrame:
    """One row with the sum: bigint for ints, double for doubles, null over no rows."""
    f = _amount(df, function, grammar)
    return df.agg((F.sum_distinct(f) if distinct else F.sum(f)).alias("sum"))


def group_sum(df: DataFrame, keys: list[str], function: str | Column, grammar: str = "standard", distinct: bool = False) -> DataFrame:
    """One row for each group: the sum, then the keys."""
    f = _amount(df, function, grammar)
    out = df.groupBy(*keys).agg((F.sum_distinct(f) if distinct else F.sum(f)).alias("sum"))
    return out.select("sum", *[k.split(".")[-1] for k in keys])


def distinct(df: DataFrame) -> DataFrame:
    return df.distinct()


def sort(df: DataFrame, keys: list[str] | str, descending: bool = False) -> DataFrame:
    """Global sort by keys, which may be spelt ``(a) AND (b)``."""
    keys = cnf.sort_keys(keys) if isinstance(keys, str) else keys
    return df.orderBy(*[F.col(k).desc() if descending else F.col(k).asc() for k in keys])


def schema_order(df: DataFrame) -> list[str]:
    """All columns: ints, then doubles, then strings, each in schema order."""
    return [f.name for kind in ("Int", "Double", "String") for f in df.schema.fields if type_name(f.dataType) == kind]


def places(df: DataFrame, path: str) -> DataFrame:
    """Rows with their places (from 1) in the order in which they lie, which is written to a new folder.

    Each partition numbers its own rows; what lies before it is the sum of the counts of the partitions before.
    """
    df.withColumn("__i", F.monotonically_increasing_id()).write.parquet(path)
    laid = df.sparkSession.read.parquet(path).withColumn("__p", F.shiftright("__i", 33))
    counts = laid.groupBy("__p").agg(F.count("*").alias("__n"))  # a row for each partition
    before = counts.withColumn("__before", F.sum("__n").over(Window.orderBy("__p")) - F.col("__n")).drop("__n")
    place = F.col("__before") + F.col("__i").bitwiseAND((1 << 33) - 1) + 1
    return laid.join(before, "__p").withColumn("place", place.cast("long")).drop("__i", "__p", "__before")


def inversions(df: DataFrame, keys: list[str], path: str) -> int:
    """Adjacent rows out of order, as rows lie, within partitions and from one to the next; 0: sorted. Rows are written to a new folder."""
    df.select(*keys).withColumn("__i", F.monotonically_increasing_id()).write.parquet(path)
    laid = df.sparkSession.read.parquet(path).withColumns({"__p": F.shiftright("__i", 33), "__k": F.struct(*keys)})
    before = F.lag("__k").over(Window.partitionBy("__p").orderBy("__i"))
    within = laid.withColumn("__down", (before > F.col("__k")).cast("long"))
    ends = within.groupBy("__p").agg(F.sum(F.coalesce("__down", F.lit(0))).alias("n"), F.min_by("__k", "__i").alias("first"), F.max_by("__k", "__i").alias("last"))
    between = F.lag("last").over(Window.orderBy("__p")) > F.col("first")  # a row for each partition
    return ends.withColumn("e", between.cast("long")).agg(F.sum(F.col("n") + F.coalesce("e", F.lit(0)))).first()[0] or 0


def partition_inversions(df: DataFrame, keys: list[str]) -> DataFrame:
    """(partition, inversions): adjacent rows out of order, within each partition as it lies."""
    at = df.withColumns({"__p": F.spark_partition_id(), "__i": F.monotonically_increasing_id()})
    before = F.lag(F.struct(*keys)).over(Window.partitionBy("__p").orderBy("__i"))
    return at.withColumn("__down", (before > F.struct(*keys)).cast("long")).groupBy(F.col("__p").alias("partition")).agg(F.sum(F.coalesce("__down", F.lit(0))).alias("inversions"))
