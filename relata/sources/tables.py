"""The benchmark tables as DataFrames and views."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NAMES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem")


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    if name == "partsupp":
        return partsupp(load(spark, sf_dir, "lineitem"))
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partsupp(lineitem: DataFrame) -> DataFrame:
    """The supply table that the data lacks, derived from lineitem: one row for each part and supplier."""
    out = lineitem.groupBy(F.col("l_partkey").alias("ps_partkey"), F.col("l_suppkey").alias("ps_suppkey"))
    return out.agg(F.min("l_quantity").cast("int").alias("ps_availqty"), F.min("l_extendedprice").alias("ps_supplycost"))


def load_all(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return {n: load(spark, sf_dir, n) for n in (*NAMES, "partsupp")}
