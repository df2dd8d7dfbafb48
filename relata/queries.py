"""The registered queries of the relational engine, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from relata.functions import arith
from relata.operators import relational as r
from relata.plans import engine, planner, sql
from relata.plans.statistics import Statistics
from relata.sources import catalog, storage, tables, text

Query = Callable[[SparkSession, str], DataFrame]

#: Inlined in SQL, where the table doesn't exist.
PARTSUPP = "(SELECT l_partkey AS ps_partkey, l_suppkey AS ps_suppkey, CAST(MIN(l_quantity) AS INT) AS ps_availqty, MIN(l_extendedprice) AS ps_supplycost FROM lineitem GROUP BY l_partkey, l_suppkey)"

_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def _query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _QUERIES[name] = f
        if sql:
            _SQL[name] = sql
        return f

    return add


def _load(spark: SparkSession, sf_dir: str, *names: str) -> tuple[DataFrame, ...]:
    return tuple(tables.load(spark, sf_dir, n) for n in names)


def money(c: Column | str, digits: int = 2) -> Column:
    """Exact decimal of a double: sums don't depend on the order of rows."""
    return (F.col(c) if isinstance(c, str) else c).cast(f"decimal(18,{digits})")


def _dollars(df: DataFrame) -> DataFrame:
    return df.withColumn("sum", F.col("sum").cast("double"))


def _filter(name: str, table: str, predicate: str, keep: list[str], where: str) -> None:
    source = PARTSUPP + " ps" if table == "partsupp" else table

    @_query(name, f"SELECT {', '.join(keep)} FROM {source} WHERE {where}")
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        if table == "partsupp":
            return r.project(r.select(tables.load(spark, sf_dir, table), predicate), keep)
        return r.project(r.select_file(spark, f"{sf_dir}/{table}.parquet", predicate), keep)


_filter("filter_region_equal", "region", "(r_name = 'EUROPE')", ["r_regionkey", "r_name"], "r_name = 'EUROPE'")
_filter("scan_filter_double", "partsupp", "(ps_supplycost < 1100.0)", ["ps_partkey", "ps_suppkey", "ps_availqty", "ps_supplycost"], "ps_supplycost < 1100.0")
_filter("filter_and_range", "part", "(p_retailprice > 931.01) AND (p_retailprice < 931.3)", ["p_partkey", "p_name", "p_retailprice"], "p_retailprice > 931.01 AND p_retailprice < 931.3")
_filter("filter_or", "lineitem", "(l_returnflag = 'R') AND (l_discount < 0.04 OR l_linestatus = 'F')", ["l_orderkey", "l_linenumber", "l_discount", "l_linestatus"], "l_returnflag = 'R' AND (l_discount < 0.04 OR l_linestatus = 'F')")
_filter("filter_string_lt", "region", "(r_name < 'middle east') AND (r_regionkey > 1)", ["r_regionkey", "r_name"], "r_name < 'middle east' AND r_regionkey > 1")
_filter("filter_three_way", "nation", "(n_regionkey = 3) AND (n_nationkey > 10) AND (n_name > 'NATION_1')", ["n_nationkey", "n_name"], "n_regionkey = 3 AND n_nationkey > 10 AND n_name > 'NATION_1'")
_filter("filter_supplier", "supplier", "(s_suppkey < 10)", ["s_suppkey", "s_name"], "s_suppkey < 10")
_filter("filter_customer", "customer", "(c_nationkey = 23) AND (c_mktsegment = 'FURNITURE') AND (c_acctbal > 0.0)", ["c_custkey", "c_name", "c_acctbal"], "c_nationkey = 23 AND c_mktsegment = 'FURNITURE' AND c_acctbal > 0.0")
_filter("filter_part", "part", "(p_brand = 'Brand#13') AND (p_retailprice > 500.0) AND (p_retailprice < 930.0) AND (p_size > 28)", ["p_partkey", "p_name", "p_size"], "p_brand = 'Brand#13' AND p_retailprice > 500.0 AND p_retailprice < 930.0 AND p_size > 28")
_filter("filter_partsupp", "partsupp", "(ps_supplycost > 1000.0) AND (ps_supplycost < 1200.0) AND (ps_suppkey > 10)", ["ps_partkey", "ps_suppkey", "ps_supplycost"], "ps_supplycost > 1000.0 AND ps_supplycost < 1200.0 AND ps_suppkey > 10")
_filter("filter_orders", "orders", "(o_orderpriority = '1-URGENT') AND (o_orderstatus = 'F') AND (o_totalprice > 1015.68) AND (o_totalprice < 20000.0)", ["o_orderkey", "o_totalprice"], "o_orderpriority = '1-URGENT' AND o_orderstatus = 'F' AND o_totalprice > 1015.68 AND o_totalprice < 20000.0")
_filter("filter_lineitem", "lineitem", "(l_orderkey > 100) AND (l_orderkey < 1000) AND (l_partkey > 100) AND (l_partkey < 5000) AND (l_linestatus = 'F') AND (l_tax < 0.07)", ["l_orderkey", "l_partkey", "l_linenumber", "l_tax"], "l_orderkey > 100 AND l_orderkey < 1000 AND l_partkey > 100 AND l_partkey < 5000 AND l_linestatus = 'F' AND l_tax < 0.07")
_filter("filter_date_range", "lineitem", "(l_shipdate > '1996-01-01') AND (l_shipdate < '1996-01-07') AND (l_quantity = 4.0)", ["l_orderkey", "l_linenumber", "l_quantity"], "l_shipdate > TIMESTAMP '1996-01-01' AND l_shipdate < TIMESTAMP '1996-01-07' AND l_quantity = 4")
_filter("literal_on_left", "supplier", "(5 > s_suppkey) AND (1 < 2)", ["s_suppkey", "s_name"], "5 > s_suppkey")
_filter("tautology_scan", "nation", "(n_nationkey = n_nationkey)", ["n_nationkey", "n_name"], "TRUE")


@_query("filter_mid_plan", f"SELECT s_suppkey, ps_partkey FROM supplier JOIN {PARTSUPP} ps ON s_suppkey = ps_suppkey WHERE ps_supplycost < 2000.0 AND s_acctbal > 1000.0")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, ps = _load(spark, sf_dir, "supplier", "partsupp")
    return r.project(r.select(r.join(s, ps, "(s_suppkey = ps_suppkey)"), "(ps_supplycost < 2000.0) AND (s_acctbal > 1000.0)"), ["s_suppkey", "ps_partkey"])


@_query("attr_vs_attr", "SELECT count(*) AS n FROM lineitem WHERE l_discount > l_tax")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r.select(tables.load(spark, sf_dir, "lineitem"), "(l_discount > l_tax)").agg(F.count("*").alias("n"))


@_query("project_by_index", "SELECT n_regionkey, n_nationkey FROM nation")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r.project(tables.load(spark, sf_dir, "nation"), [2, 0])


@_query("sum_expression", "SELECT CAST(SUM(CAST(s_acctbal + (s_acctbal * 1.05) AS DECIMAL(18,4))) AS DOUBLE) AS sum FROM supplier")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = tables.load(spark, sf_dir, "supplier")
    return _dollars(r.sum_(s, money(arith.to_column("s_acctbal + (s_acctbal * 1.05)", s.schema), 4)))


@_query("sum_int", "SELECT CAST(SUM(l_orderkey) AS BIGINT) AS sum FROM lineitem")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r.sum_(tables.load(spark, sf_dir, "lineitem"), "l_orderkey")


@_query("sum_empty", "SELECT SUM(n_nationkey) IS NULL AS no_sum FROM nation WHERE n_nationkey > 1000")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r.sum_(r.select(tables.load(spark, sf_dir, "nation"), "(n_nationkey > 1000)"), "n_nationkey").select(F.col("sum").isNull().alias("no_sum"))


@_query("join_sum", f"SELECT CAST(SUM(CAST(ps_supplycost AS DECIMAL(18,2))) AS DOUBLE) AS sum FROM supplier JOIN {PARTSUPP} ps ON s_suppkey = ps_suppkey")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, ps = _load(spark, sf_dir, "supplier", "partsupp")
    return _dollars(r.sum_(r.join(s, ps, "(s_suppkey = ps_suppkey)"), money("ps_supplycost")))


@_query("join3_filter_sum", f"SELECT CAST(SUM(CAST(ps_supplycost AS DECIMAL(18,2))) AS DOUBLE) AS sum FROM part JOIN {PARTSUPP} ps ON p_partkey = ps_partkey JOIN supplier ON s_suppkey = ps_suppkey WHERE s_acctbal > 2500.0")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, s, ps = _load(spark, sf_dir, "part", "supplier", "partsupp")
    joined = r.join(r.join(p, ps, "(p_partkey = ps_partkey)"), r.select(s, "(s_acctbal > 2500.0)"), "(ps_suppkey = s_suppkey)")
    return _dollars(r.sum_(joined, money("ps_supplycost")))


@_query("group_sum", f"SELECT CAST(SUM(CAST(ps_supplycost AS DECIMAL(18,2))) AS DOUBLE) AS sum, s_nationkey FROM supplier JOIN {PARTSUPP} ps ON s_suppkey = ps_suppkey GROUP BY s_nationkey")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, ps = _load(spark, sf_dir, "supplier", "partsupp")
    return _dollars(r.group_sum(r.join(s, ps, "(s_suppkey = ps_suppkey)"), ["s_nationkey"], money("ps_supplycost")))


@_query("multi_key_group", "SELECT CAST(SUM(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS sum, l_returnflag, l_linestatus FROM lineitem GROUP BY l_returnflag, l_linestatus")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _dollars(r.group_sum(tables.load(spark, sf_dir, "lineitem"), ["l_returnflag", "l_linestatus"], money("l_quantity")))


@_query("distinct_projection", f"SELECT DISTINCT ps_suppkey FROM {PARTSUPP} ps WHERE ps_supplycost < 2000.0")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r.distinct(r.project(r.select(tables.load(spark, sf_dir, "partsupp"), "(ps_supplycost < 2000.0)"), ["ps_suppkey"]))


@_query("duplicate_removal", "SELECT DISTINCT l_returnflag, l_linestatus, l_linenumber FROM lineitem")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r.distinct(r.project(tables.load(spark, sf_dir, "lineitem"), ["l_returnflag", "l_linestatus", "l_linenumber"]))


def _arithmetic(name: str, function: str, sql: str, grammar: str = "standard") -> None:
    """name_whole: an expression on every row of lineitem."""

    @_query(f"{name}_whole", f"SELECT l_orderkey, l_linenumber, {sql} AS value FROM lineitem")
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        l = tables.load(spark, sf_dir, "lineitem")  # noqa: E741
        return l.select("l_orderkey", "l_linenumber", arith.to_column(function, l.schema, grammar).alias("value"))


_arithmetic("int_div", "-l_orderkey / 7", "-l_orderkey // 7")
_arithmetic("unary_minus", "-(l_orderkey + l_linenumber)", "-(l_orderkey + l_linenumber)")
_arithmetic("mixed_promotion", "l_quantity * l_linenumber + 2", "l_quantity * l_linenumber + 2")
_arithmetic("double_div", "l_extendedprice / l_quantity - l_tax", "l_extendedprice / l_quantity - l_tax")
_arithmetic("arith_right_grammar", "l_quantity * l_linenumber + 2", "l_quantity * (l_linenumber + 2)", "right")


@_query("theta_join", "SELECT n_nationkey, r_regionkey FROM nation JOIN region ON n_regionkey < r_regionkey")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, g = _load(spark, sf_dir, "nation", "region")
    return r.join(n, g, "(n_regionkey < r_regionkey)", ["n_nationkey", "r_regionkey"])


@_query("self_join", "SELECT n1.n_nationkey AS k1, n2.n_nationkey AS k2 FROM nation n1 JOIN nation n2 ON n1.n_regionkey = n2.n_regionkey")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = tables.load(spark, sf_dir, "nation")
    joined = r.join(n.alias("n1"), n.alias("n2"), "(n1.n_regionkey = n2.n_regionkey)")
    return joined.select(F.col("n1.n_nationkey").alias("k1"), F.col("n2.n_nationkey").alias("k2"))


@_query("multi_key_join", f"SELECT count(*) AS n FROM lineitem JOIN {PARTSUPP} ps ON l_partkey = ps_partkey AND l_suppkey = ps_suppkey")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    l, ps = _load(spark, sf_dir, "lineitem", "partsupp")  # noqa: E741
    return r.join(l, ps, "(l_partkey = ps_partkey) AND (l_suppkey = ps_suppkey)").agg(F.count("*").alias("n"))


@_query("join_residual", "SELECT count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey AND (l_extendedprice > o_totalprice OR l_discount < l_tax)")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    l, o = _load(spark, sf_dir, "lineitem", "orders")  # noqa: E741
    return r.join(l, o, "(l_orderkey = o_orderkey) AND (l_extendedprice > o_totalprice OR l_discount < l_tax)").agg(F.count("*").alias("n"))


def _sorted(spark: SparkSession, df: DataFrame, keys: list[str], descending: bool = False) -> DataFrame:
    """Rows with the places at which the sort operator lays them."""
    return r.places(r.sort(df, keys, descending), storage.scratch_path(spark) + "/rows")


@_query("sort_multi", "SELECT n_regionkey, n_name, CAST(row_number() OVER (ORDER BY n_regionkey, n_name) AS BIGINT) AS place FROM nation")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = r.project(tables.load(spark, sf_dir, "nation"), ["n_regionkey", "n_name"])
    return _sorted(spark, n, ["n_regionkey", "n_name"])


@_query("sort_descending", "SELECT s_acctbal, s_suppkey, CAST(row_number() OVER (ORDER BY s_acctbal DESC, s_suppkey DESC) AS BIGINT) AS place FROM supplier")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = r.project(tables.load(spark, sf_dir, "supplier"), ["s_acctbal", "s_suppkey"])
    return _sorted(spark, s, ["s_acctbal", "s_suppkey"], descending=True)


@_query("sort_schema_order", "SELECT s_suppkey, CAST(row_number() OVER (ORDER BY s_suppkey, s_nationkey, s_acctbal, s_name) AS BIGINT) AS place FROM supplier")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = tables.load(spark, sf_dir, "supplier")
    return _sorted(spark, s, r.schema_order(s)).select("s_suppkey", "place")


@_query("sort_places", "SELECT o_orderkey, CAST(row_number() OVER (ORDER BY o_totalprice, o_orderkey) AS BIGINT) AS place FROM orders")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sorted(spark, r.project(tables.load(spark, sf_dir, "orders"), ["o_totalprice", "o_orderkey"]), ["o_totalprice", "o_orderkey"]).select("o_orderkey", "place")


@_query("sortedness", "SELECT CAST(0 AS BIGINT) AS sorted_rows, TRUE AS others")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, path = tables.load(spark, sf_dir, "orders").select("o_totalprice", "o_orderkey"), storage.scratch_path(spark)
    keys = ["o_totalprice", "o_orderkey"]
    found = r.inversions(r.sort(o, keys), keys, f"{path}/a"), r.inversions(o, keys, f"{path}/b") > 0
    return spark.createDataFrame([found], "sorted_rows long, others boolean")


@_query("sort_rows", "SELECT o_totalprice, o_custkey FROM orders")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r.sort(r.project(tables.load(spark, sf_dir, "orders"), ["o_totalprice", "o_custkey"]), "(o_totalprice) AND (o_custkey)")


@_query("heap_append", "SELECT n_nationkey, n_name, n_regionkey FROM nation UNION ALL SELECT n_nationkey, n_name, n_regionkey FROM nation WHERE n_regionkey < 2")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, t = tables.load(spark, sf_dir, "nation"), storage.StoredTable.create(spark, storage.scratch_path(spark))
    t.append(n)
    t.append(r.select(n, "(n_regionkey < 2)"))
    return storage.StoredTable.open(spark, t.path).scan()


@_query("sorted_bounded_scan", "SELECT c_custkey, c_acctbal FROM customer WHERE c_acctbal > 100.0 AND c_acctbal < 900.0")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = storage.StoredTable.create(spark, storage.scratch_path(spark), "sorted", "(c_acctbal)")
    t.append(r.project(tables.load(spark, sf_dir, "customer"), ["c_custkey", "c_acctbal"]))
    return t.bounded_scan("(c_acctbal > 100.0) AND (c_acctbal < 900.0)")


@_query("sorted_insert", "SELECT n_nationkey, n_regionkey FROM nation")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = r.project(tables.load(spark, sf_dir, "nation"), ["n_nationkey", "n_regionkey"])
    t = storage.StoredTable.create(spark, storage.scratch_path(spark), "sorted", ["n_regionkey", "n_nationkey"])
    t.append(r.select(n, "(n_nationkey > 11)"))
    t.append(r.select(n, "(n_nationkey < 12)"))
    return t.scan()


@_query("write_out_format", "SELECT 's_suppkey:[' || s_suppkey || '], s_name:[' || s_name || '], s_nationkey:[' || s_nationkey || '], s_acctbal:[' || printf('%.6f', s_acctbal) || ']' AS line FROM supplier")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text.written_lines(tables.load(spark, sf_dir, "supplier"))


@_query("print_format", "SELECT 'n_nationkey: [' || n_nationkey || '], n_name: [' || n_name || '], n_regionkey: [' || n_regionkey || ']' AS line FROM nation")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text.printed_lines(tables.load(spark, sf_dir, "nation"))


@_query("text_round_trip", "SELECT s_suppkey, s_name, s_nationkey, s_acctbal FROM supplier")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = tables.load(spark, sf_dir, "supplier")
    return text.read_table(spark, _as_text(spark, s), s.schema)


def _as_text(spark: SparkSession, df: DataFrame) -> str:
    """Path of a text table with the rows of df."""
    path = storage.scratch_path(spark) + "/text"
    df.select(F.concat(*[F.concat(F.col(c).cast("string"), F.lit("|")) for c in df.columns])).write.text(path)
    return path


@_query("catalog_load", "SELECT n_nationkey, n_name, n_regionkey FROM nation")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = r.project(tables.load(spark, sf_dir, "nation"), ["n_nationkey", "n_name", "n_regionkey"])
    found = catalog.parse(f"BEGIN\nnation\n{_as_text(spark, n)}\nn_nationkey Int\nn_name String\nn_regionkey Int\nEND\n")["nation"]
    t = storage.StoredTable.create(spark, storage.scratch_path(spark), schema=found.schema)
    t.load_text(found.file, found.schema)
    return t.scan()


@_query("ddl_insert_select", "SELECT s_suppkey, s_name FROM supplier WHERE s_acctbal > 0.0")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, path = r.project(tables.load(spark, sf_dir, "supplier"), ["s_suppkey", "s_name", "s_acctbal"]), storage.scratch_path(spark)
    first = engine.Engine(spark, path)
    first.execute("CREATE TABLE s (s_suppkey Int, s_name String, s_acctbal Double) AS SORTED ON s_suppkey")
    first.execute("CREATE TABLE gone (a Int) AS HEAP")
    first.execute(f"INSERT '{_as_text(spark, rows)}' INTO s")
    first.execute("DROP TABLE gone")
    second = engine.Engine(spark, path)  # knows the tables of the folder
    second.execute("SET OUTPUT NONE")
    return second.execute("SELECT t.s_suppkey, t.s_name FROM s AS t WHERE (t.s_acctbal > 0.0)").withColumn("s_suppkey", F.col("s_suppkey").cast("long"))


@_query("print_format_double", "SELECT 's_suppkey: [' || s_suppkey || '], s_acctbal: [' || printf('%g', s_acctbal) || ']' AS line FROM supplier")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text.printed_lines(r.project(tables.load(spark, sf_dir, "supplier"), ["s_suppkey", "s_acctbal"]))


@_query("join_left_first", "SELECT a.n_nationkey AS k, b.n_nationkey AS other FROM nation a JOIN nation b ON a.n_regionkey = b.n_nationkey WHERE a.n_nationkey < 20")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = tables.load(spark, sf_dir, "nation")
    right = n.select("n_nationkey", F.col("n_nationkey").alias("b_key"))
    joined = r.join(n.select("n_nationkey", "n_regionkey"), right, "(n_regionkey = b_key) AND (n_nationkey < 20)")
    return joined.toDF("k", "region", "other", "b_key").select("k", "other")


def _select(name: str, statement: str, same: str, exact: tuple[str, ...] = ()) -> None:
    """A SELECT, its join order chosen by estimates from the tables' own counts."""

    @_query(name, same)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        own = {n: df for n, df in tables.load_all(spark, sf_dir).items() if f"{n} AS" in statement}
        for t, c in (x.split(".") for x in exact):
            own[t] = own[t].withColumn(c, money(c))
        out = planner.run(statement, own, _sizes(sf_dir, own, statement))
        return _dollars(out) if exact else out


_MEASURED: dict[tuple[str, str], tuple[float, dict[str, float]]] = {}


def _sizes(sf_dir: str, own: dict[str, DataFrame], statement: str) -> Statistics | None:
    """Counts of the tables and of the attributes that a SELECT joins and filters by, measured once for each folder."""
    parsed = sql.parse_select(statement)
    if len(parsed.tables) < 2 or parsed.where is None:
        return None  # nothing to order
    wanted = {n.split(".")[-1] for n in parsed.where.names}
    out = Statistics()
    for name, df in own.items():
        columns = [c for c in df.columns if c in wanted]
        rows, distinct = _MEASURED.get((sf_dir, name), (None, {}))
        if rows is None or set(columns) - distinct.keys():
            found = Statistics.from_tables({name: df.select(*columns)}).relations[name]
            rows, distinct = found.tuples, distinct | found.distinct
            _MEASURED[sf_dir, name] = rows, distinct
        out.add_relation(name, rows)
        for c in columns:
            out.add_attribute(name, c, distinct[c])
    return out


_select("sql_tc1", "SELECT n.n_nationkey FROM nation AS n WHERE (n.n_name = 'NATION_24')", "SELECT n_nationkey FROM nation WHERE n_name = 'NATION_24'")
_select("sql_tc2", "SELECT n.n_name FROM nation AS n, region AS r WHERE (n.n_regionkey = r.r_regionkey) AND (n.n_nationkey > 5)", "SELECT n_name FROM nation, region WHERE n_regionkey = r_regionkey AND n_nationkey > 5")
_select("sql_tc3", "SELECT SUM (n.n_nationkey) FROM nation AS n, region AS r WHERE (n.n_regionkey = r.r_regionkey) AND (n.n_name = 'NATION_24')", "SELECT CAST(SUM(n_nationkey) AS BIGINT) AS sum FROM nation, region WHERE n_regionkey = r_regionkey AND n_name = 'NATION_24'")
_select("sql_tc4", "SELECT SUM (n.n_regionkey) FROM nation AS n, region AS r WHERE (n.n_regionkey = r.r_regionkey) AND (n.n_name = 'NATION_24') GROUP BY n.n_regionkey", "SELECT CAST(SUM(n_regionkey) AS BIGINT) AS sum FROM nation, region WHERE n_regionkey = r_regionkey AND n_name = 'NATION_24' GROUP BY n_regionkey")
_TC5 = "FROM nation AS n, region AS r, customer AS c WHERE (n.n_regionkey = r.r_regionkey) AND (n.n_nationkey = c.c_nationkey) AND (n.n_nationkey > 10) GROUP BY r.r_regionkey"
_TC5_SQL = "FROM nation, region, customer WHERE n_regionkey = r_regionkey AND n_nationkey = c_nationkey AND n_nationkey > 10 GROUP BY r_regionkey"
_select("sql_tc5", f"SELECT SUM DISTINCT (n.n_nationkey + r.r_regionkey) {_TC5}", f"SELECT CAST(SUM(DISTINCT n_nationkey + r_regionkey) AS BIGINT) AS sum {_TC5_SQL}")
_select("sum_distinct_group", f"SELECT SUM DISTINCT (n.n_nationkey + r.r_regionkey), r.r_regionkey {_TC5}", f"SELECT CAST(SUM(DISTINCT n_nationkey + r_regionkey) AS BIGINT) AS sum, r_regionkey {_TC5_SQL}")
_select("sql_tc6", "SELECT SUM (ps.ps_supplycost), s.s_suppkey FROM part AS p, supplier AS s, partsupp AS ps WHERE (p.p_partkey = ps.ps_partkey) AND (s.s_suppkey = ps.ps_suppkey) AND (s.s_acctbal > 2500.0) GROUP BY s.s_suppkey", f"SELECT CAST(SUM(CAST(ps_supplycost AS DECIMAL(18,2))) AS DOUBLE) AS sum, s_suppkey FROM part, supplier, {PARTSUPP} ps WHERE p_partkey = ps_partkey AND s_suppkey = ps_suppkey AND s_acctbal > 2500.0 GROUP BY s_suppkey", ("partsupp.ps_supplycost",))
_select("sql_select_distinct", "SELECT DISTINCT n.n_regionkey FROM nation AS n, customer AS c WHERE (n.n_nationkey = c.c_nationkey)", "SELECT DISTINCT n_regionkey FROM nation, customer WHERE n_nationkey = c_nationkey")
_select("sql_self_join", "SELECT a.n_nationkey FROM nation AS a, nation AS b WHERE (a.n_regionkey = b.n_regionkey) AND (b.n_nationkey = 3)", "SELECT a.n_nationkey FROM nation a, nation b WHERE a.n_regionkey = b.n_regionkey AND b.n_nationkey = 3")


@_query("distinct_over_group_sum", f"SELECT DISTINCT CAST(SUM(n_nationkey + r_regionkey) AS BIGINT) AS sum {_TC5_SQL}")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, g, c = _load(spark, sf_dir, "nation", "region", "customer")
    joined = r.join(r.join(r.select(n, "(n_nationkey > 10)"), g, "(n_regionkey = r_regionkey)"), c, "(n_nationkey = c_nationkey)")
    return r.distinct(r.project(r.group_sum(joined, ["r_regionkey"], "n_nationkey + r_regionkey"), ["sum"]))


@_query("estimate_join", "SELECT CAST(count(*) AS DOUBLE) * (SELECT count(*) FROM nation) / (SELECT greatest(count(DISTINCT n_nationkey), (SELECT count(DISTINCT s_nationkey) FROM supplier)) FROM nation) AS estimate FROM supplier")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, n = _load(spark, sf_dir, "supplier", "nation")
    stats = Statistics.from_tables({"supplier": s, "nation": n}, exact=True)
    return spark.createDataFrame([(stats.estimate("(s_nationkey = n_nationkey)", ["supplier", "nation"]),)], "estimate double")


def _estimate(name: str, made: str, names: tuple[str, ...], estimate: Callable[[Statistics], float]) -> None:
    """An estimate from exact counts; `made` is its formula over counts in SQL."""

    @_query(name, f"SELECT round({made}, 6) AS estimate")
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        found = estimate(Statistics.from_tables({n: tables.load(spark, sf_dir, n) for n in names}, exact=True))
        return spark.createDataFrame([(float(found),)], "estimate double").select(F.round("estimate", 6).alias("estimate"))


def _n(table: str) -> str:
    return f"(SELECT CAST(count(*) AS DOUBLE) FROM {table})"


def _d(table: str, column: str) -> str:
    return f"(SELECT CAST(count(DISTINCT {column}) AS DOUBLE) FROM {table})"


def _after_apply(s: Statistics) -> float:
    s.apply("(n_regionkey = r_regionkey)", ["nation", "region"])
    return s.estimate("(n_nationkey = c_nationkey)", ["nation", "region", "customer"])


def _of_copies(s: Statistics) -> float:
    s.copy_relation("nation", "a")
    s.copy_relation("nation", "b")
    return s.estimate("(a.n_regionkey = b.n_regionkey)", ["a", "b"])


_estimate("estimate_product", f"{_n('nation')} * {_n('region')}", ("nation", "region"), lambda s: s.estimate(None, ["nation", "region"]))
_estimate("estimate_range_and_equal", f"{_n('customer')} / 3 / {_d('customer', 'c_nationkey')}", ("customer",), lambda s: s.estimate("(c_acctbal > 0.0) AND (c_nationkey = 3)", ["customer"]))
_estimate("estimate_or_same", f"{_n('nation')} * least(1, 2 / {_d('nation', 'n_regionkey')})", ("nation",), lambda s: s.estimate("(n_regionkey = 1 OR n_regionkey = 2)", ["nation"]))
_estimate("estimate_or_different", f"{_n('nation')} * (1 - (1 - 1 / {_d('nation', 'n_regionkey')}) * (1 - 1 / {_d('nation', 'n_nationkey')}))", ("nation",), lambda s: s.estimate("(n_regionkey = 1 OR n_nationkey = 2)", ["nation"]))
_estimate("estimate_apply", f"{_n('nation')} * {_n('region')} / greatest({_d('nation', 'n_regionkey')}, {_d('region', 'r_regionkey')}) * {_n('customer')} / greatest({_d('nation', 'n_nationkey')}, {_d('customer', 'c_nationkey')})", ("nation", "region", "customer"), _after_apply)
_estimate("estimate_copies", f"{_n('nation')} * {_n('nation')} / {_d('nation', 'n_regionkey')}", ("nation",), _of_copies)


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
