from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    s = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "3g")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .config("spark.sql.warehouse.dir", str(tmp_path_factory.mktemp("warehouse")))
        .getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def sf() -> str:
    return SF


@pytest.fixture(scope="session")
def duck():
    import duckdb

    c = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        c.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return c


@pytest.fixture(scope="session")
def same(spark, sf, duck):
    """Asserts that a query and its SQL have the same rows."""

    def check(query, sql: str) -> None:
        got, want = query(spark, sf).toPandas(), duck.sql(sql).df()
        columns = sorted(got.columns)
        assert sorted(want.columns) == columns
        rows = lambda df: sorted((tuple(_plain(x) for x in r) for r in df[columns].astype(object).itertuples(index=False)), key=repr)
        assert rows(got) == rows(want)

    return check


def _plain(x):
    if x is None or x != x:
        return None
    return round(float(x), 9) if isinstance(x, float) else int(x) if hasattr(x, "dtype") and x.dtype.kind in "iu" else x
