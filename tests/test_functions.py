import operator

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

from relata.functions import arith, cnf
from relata.functions.lexer import ParseError

SCHEMA = T.StructType([T.StructField("a", T.IntegerType()), T.StructField("b", T.DoubleType()), T.StructField("s", T.StringType())])


def test_parse_and_print():
    c = cnf.parse("(a < 1 OR s = 'it\\'s') AND (b > -2.5)")
    assert str(c) == "( a < 1 OR s = it's ) AND\n( b > -2.5 )".replace("it's", "'it's'")
    assert c.names == ["a", "s", "b"]


@pytest.mark.parametrize("text", ["a < 1", "(a < 1", "(a < 1) and (b > 2.0)", "(a <= 1)", "(1)", "(a < 1) OR (b > 2.0)", "(a ! 1)", "()"])
def test_not_in_the_grammar(text):
    with pytest.raises(ParseError):
        cnf.parse(text)


def test_sort_keys():
    assert cnf.sort_keys("(c_name) AND (c_custkey)") == ["c_name", "c_custkey"]
    with pytest.raises(ParseError):
        cnf.sort_keys("(a < 1)")


def test_strict_types(spark):
    cnf.to_column("(b > 1.0) AND (a = 3) AND (s < 'x')", SCHEMA, strict=True)
    with pytest.raises(TypeError):
        cnf.to_column("(b > 1000)", SCHEMA, strict=True)
    with pytest.raises(ParseError):
        cnf.to_column("(nothing > 1000)", SCHEMA, strict=True)


def test_bound_text():
    right = T.StructType([T.StructField("c", T.IntegerType())])
    assert cnf.bound_text(cnf.parse("(a = c) AND (s < 'x')"), SCHEMA, right) == "( Att 0 from left record = Att 0 from right record (Int) ) AND\n( Att 2 from left record < Att 0 from literal record (String) )"


def test_tautology_keeps_null(spark):
    df = spark.createDataFrame([(None,), (1,)], "a int")
    assert df.where(cnf.to_column("(a = a)")).count() == 2
    assert df.where(cnf.to_column("(a = a OR a < 0)")).count() == 2


_ROWS = [Row(a=a, b=b, s=s) for a in (-1, 0, 3) for b in (-0.5, 2.0) for s in ("", "x", "Y")]
_OPS = {"<": operator.lt, ">": operator.gt, "=": operator.eq}
_SIDE = st.sampled_from([("a", 0), ("a", 3), ("b", 2.0), ("s", "x")])
_CNF = st.lists(st.lists(st.tuples(_SIDE, st.sampled_from("<>=")), min_size=1, max_size=3), min_size=1, max_size=3)


@settings(max_examples=15, deadline=None)
@given(_CNF)
def test_predicate_against_rows(spark, clauses):
    shown = lambda v: f"'{v}'" if isinstance(v, str) else str(v)
    text = " AND ".join("(" + " OR ".join(f"{n} {op} {shown(v)}" for (n, v), op in c) + ")" for c in clauses)
    want = [r for r in _ROWS if all(any(_OPS[op](r[n], v) for (n, v), op in c) for c in clauses)]
    got = spark.createDataFrame(_ROWS).where(cnf.to_column(text)).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want))


@pytest.mark.parametrize(("text", "standard", "right"), [
    ("a - a - 1", "a a - 1 -", "a a 1 - -"), ("a * b + 2", "a b * 2 +", "a b 2 + *"), ("-a + b", "a neg b +", "a b + neg"),
    ("(a + b) * 2", "a b + 2 *", "a b + 2 *"), ("a-b", "a-b", "a-b"),
])
def test_arithmetic_grammars(text, standard, right):
    assert arith.rpn(arith.parse(text)) == standard
    assert arith.rpn(arith.parse(text, "right")) == right


def test_arithmetic_types(spark):
    df = spark.createDataFrame([(-7, 2.0, "x")], SCHEMA)
    values = df.select(*[arith.to_column(t, SCHEMA).alias(t) for t in ("a / 2", "a / b", "a + 1", "-a", "a * b")]).first()
    assert tuple(values) == (-3, -3.5, -6, 7, -14.0)
    assert arith.result_type(arith.parse("a / 2"), SCHEMA) == "Int"
    with pytest.raises(TypeError):
        arith.to_column("a + s", SCHEMA)
    with pytest.raises(ParseError):
        arith.parse("a -1")
    with pytest.raises(ParseError):
        arith.to_column("zz + 1", SCHEMA)
    assert F is not None
