"""Rows as text: every field ends with ``|``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_table(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Rows of a text table; empty numbers are 0, empty strings are empty."""
    raw = T.StructType([T.StructField(f.name, T.StringType()) for f in schema] + [T.StructField("__end", T.StringType())])
    df = spark.read.schema(raw).option("sep", "|").option("quote", "").option("escape", "").option("emptyValue", "").option("nullValue", "\x00").csv(path)
    return df.select(*[_typed(F.col(f.name), f.dataType).alias(f.name) for f in schema])


def _typed(c: Column, kind: T.DataType) -> Column:
    if isinstance(kind, T.StringType):
        return F.coalesce(c, F.lit(""))
    return F.when(F.coalesce(F.trim(c), F.lit("")) == "", F.lit("0")).otherwise(F.trim(c)).cast(kind)


def compose_rows(spark: SparkSession, schema: T.StructType, lines: list[str]) -> DataFrame:
    """Rows from strings in the same form."""
    made = {"int": int, "double": float, "string": str}
    rows = []
    for line in lines:
        parts = line.rstrip("\n").split("|")
        if parts[-1:] == [""]:
            parts.pop()
        if len(parts) != len(schema):
            raise ValueError(f"{len(parts)} fields for {len(schema)} attributes: {line!r}")
        rows.append(tuple(made[f.dataType.simpleString()](p or 0) if not isinstance(f.dataType, T.StringType) else p for p, f in zip(parts, schema)))
    return spark.createDataFrame(rows, schema)


def _shown(c: Column, kind: T.DataType, double: str) -> Column:
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return F.format_string(double, c)
    return c.cast("string")


def written_lines(df: DataFrame) -> DataFrame:
    """(line): ``name:[value], name:[value]``, doubles with six decimals."""
    parts = [F.concat(F.lit(f"{f.name}:["), _shown(F.col(f"`{f.name}`"), f.dataType, "%f"), F.lit("]")) for f in df.schema]
    return df.select(F.concat_ws(", ", *parts).alias("line"))


def printed_lines(df: DataFrame) -> DataFrame:
    """(line): ``name: [value], name: [value]``, doubles with six significant digits."""
    parts = [F.concat(F.lit(f"{f.name}: ["), _six_digits(F.col(f"`{f.name}`")) if isinstance(f.dataType, T.DoubleType) else F.col(f"`{f.name}`").cast("string"), F.lit("]")) for f in df.schema]
    return df.select(F.concat_ws(", ", *parts).alias("line"))


def print_rows(df: DataFrame) -> int:
    """Prints all rows as printed_lines, a partition at a time, then their number, which it returns."""
    n = 0
    for row in printed_lines(df).toLocalIterator():
        print(row.line)
        n += 1
    print(f"{n} rows")
    return n


def _six_digits(c: Column) -> Column:
    """As a C++ stream prints doubles by default."""
    size = F.abs(c)
    exponent = F.when(size == 0, 0).otherwise(F.regexp_extract(F.format_string("%.5e", c), "e([-+][0-9]+)$", 1).cast("int"))
    plain = [F.regexp_replace(F.format_string(f"%.{d}f", c), r"\.?0+$" if d else "^$", "") for d in range(10)]
    fixed = F.element_at(F.array(*plain), F.greatest(F.lit(1), F.least(F.lit(10), 6 - exponent)))
    power = F.concat(F.regexp_replace(F.regexp_extract(F.format_string("%.5e", c), "^(.*)e", 1), r"\.?0+$", ""), F.regexp_extract(F.format_string("%.5e", c), "(e.*)$", 1))
    return F.when((exponent < -4) | (exponent >= 6), power).otherwise(fixed)


def write_out(df: DataFrame, path: str) -> None:
    """Text sink of written_lines."""
    written_lines(df).write.text(path)
