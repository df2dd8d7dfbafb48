import pytest

from relata import queries


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_query_matches_sql(name, same):
    same(queries.queries()[name], queries.oracle_sql()[name])


def test_every_query_has_sql():
    assert queries.queries().keys() == queries.oracle_sql().keys()


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).columns == ["sum", "s_suppkey"]
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


@pytest.mark.parametrize("name", ["int_div", "unary_minus", "mixed_promotion", "double_div", "arith_right_grammar"])
def test_arithmetic_of_every_row(spark, sf, name):
    assert queries.queries()[f"{name}_whole"](spark, sf).count() == spark.read.parquet(f"{sf}/lineitem.parquet").count()
