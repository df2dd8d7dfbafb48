import pytest

from relata.operators import relational as r
from relata.sources import catalog, storage, tables, text

CATALOG = """
BEGIN
region
region.tbl
r_regionkey Int
r_name String
r_size Double
END
"""


def test_catalog_round_trip():
    found = catalog.parse(CATALOG)
    assert found["region"].file == "region.tbl"
    assert [f.dataType.simpleString() for f in found["region"].schema] == ["int", "string", "double"]
    assert catalog.parse(catalog.render(found)) == found
    for bad in ("BEGIN\nx\nx.tbl\na Date\nEND", "BEGIN\nx\nx.tbl\na Int", "END", "BEGIN\nx\nx.tbl\na\nEND"):
        with pytest.raises(ValueError):
            catalog.parse(bad)


def test_text_rows(spark, tmp_path):
    schema = catalog.parse(CATALOG)["region"].schema
    (tmp_path / "r.tbl").write_text('1|a "quoted" one|2.5|\n2|||\n')
    want = [(1, 'a "quoted" one', 2.5), (2, "", 0.0)]
    assert sorted(map(tuple, text.read_table(spark, str(tmp_path / "r.tbl"), schema).collect())) == want
    assert sorted(map(tuple, text.compose_rows(spark, schema, ['1|a "quoted" one|2.5|', "2|||"]).collect())) == want
    with pytest.raises(ValueError):
        text.compose_rows(spark, schema, ["1|2"])


def test_formats(spark):
    values = [0.0, 1.5, 123456.0, 1234567.0, 0.00012345678, 1e-7, -2.0, 100.0, 3.14159265]
    df = spark.createDataFrame([(k, v) for k, v in enumerate(values)], "k int, x double").orderBy("k")
    shown = [row.line.split("x: [")[1][:-1] for row in text.printed_lines(df).collect()]
    assert shown == [f"{v:g}" for v in values]
    assert text.written_lines(df).first().line == "k:[0], x:[0.000000]"


def test_stored_tables(spark, sf, tmp_path):
    n = tables.load(spark, sf, "nation")
    heap = storage.StoredTable.create(spark, str(tmp_path / "heap"))
    with pytest.raises(FileNotFoundError):
        heap.scan()
    heap.append(n)
    heap.append(n)
    assert heap.count() == 50
    s = storage.StoredTable.create(spark, str(tmp_path / "sorted"), "sorted", "(n_regionkey) AND (n_name)")
    s.append(r.select(n, "(n_nationkey > 9)"))
    s.append(r.select(n, "(n_nationkey < 10)"))
    again = storage.StoredTable.open(spark, s.path)
    assert again.kind == "sorted"
    assert again.keys == ["n_regionkey", "n_name"]
    assert again.count() == 25
    assert again.bounded_scan("(n_regionkey > 2) AND (n_name < 'NATION_2')").count() == r.select(n, "(n_regionkey > 2) AND (n_name < 'NATION_2')").count()
    assert r.partition_inversions(again.scan(), again.keys).agg({"inversions": "sum"}).first()[0] == 0
    with pytest.raises(ValueError):
        again.bounded_scan("(n_name < 'X')")
    with pytest.raises(ValueError):
        storage.StoredTable.create(spark, str(tmp_path / "x"), "heap", ["a"])
    assert "PushedFilters: [" in again.bounded_scan("(n_regionkey > 2)")._jdf.queryExecution().toString()


def test_operators(spark, sf):
    n = tables.load(spark, sf, "nation")
    assert r.schema_order(n) == ["n_nationkey", "n_regionkey", "n_name"]
    with pytest.raises(KeyError):
        r.project(n, ["nothing"])
    assert [x.n_nationkey for x in r.sort(n, ["n_nationkey"], descending=True).collect()] == list(range(24, -1, -1))
    assert r.group_sum(n, ["n_regionkey"], "n_nationkey").columns == ["sum", "n_regionkey"]
    assert r.sum_(n, "n_regionkey", distinct=True).first()[0] == 10
    assert r.sum_(n, "n_nationkey").schema[0].dataType.simpleString() == "bigint"


def test_streaming(spark, sf, tmp_path):
    from relata.streaming import follow

    n = tables.load(spark, sf, "nation")
    n.write.parquet(str(tmp_path / "in"))
    stream = r.select(follow(spark, str(tmp_path / "in"), n.schema), "(n_regionkey = 1)")
    q = stream.writeStream.format("memory").queryName("followed").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
    q.awaitTermination()
    assert spark.table("followed").count() == 5


def test_following_stored_tables(spark, sf, tmp_path):
    from relata.streaming import follow

    n = tables.load(spark, sf, "nation").select("n_nationkey", "n_regionkey")
    heap = storage.StoredTable.create(spark, str(tmp_path / "heap"))
    with pytest.raises(FileNotFoundError):
        follow(spark, heap.path)
    heap.append(r.select(n, "(n_regionkey < 2)"))
    stream = r.select(follow(spark, heap.path), "(n_regionkey = 1)")

    def run() -> int:
        q = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
        q.awaitTermination(120)
        return spark.read.parquet(str(tmp_path / "out")).count()

    assert run() == 5
    heap.append(n)
    assert run() == 10  # only what was appended since
    ordered = storage.StoredTable.create(spark, str(tmp_path / "sorted"), "sorted", ["n_nationkey"])
    ordered.append(n)
    with pytest.raises(ValueError):
        follow(spark, ordered.path)


def test_places_and_inversions(spark, tmp_path):
    df = spark.createDataFrame([(k * 37 % 101,) for k in range(101)], "k int").repartition(5)
    ordered = r.sort(df, ["k"])
    assert sorted((x.place, x.k) for x in r.places(ordered, str(tmp_path / "a")).collect()) == [(k + 1, k) for k in range(101)]
    assert r.inversions(ordered, ["k"], str(tmp_path / "b")) == 0
    assert r.inversions(df, ["k"], str(tmp_path / "c")) > 0
    edge = spark.createDataFrame([(5,), (6,), (1,), (2,)], "k int").coalesce(1).unionByName(spark.createDataFrame([(0,), (9,)], "k int").coalesce(1))
    assert r.inversions(edge, ["k"], str(tmp_path / "d")) == 2  # one within, one between partitions


def test_bulk_loads_lie_in_order(spark, tmp_path):
    (tmp_path / "r.tbl").write_text("".join(f"{k * 7 % 50}|n{k}|{k}.5|\n" for k in range(50)))
    schema = catalog.parse(CATALOG)["region"].schema
    t = storage.StoredTable.create(spark, str(tmp_path / "t"), "sorted", ["r_regionkey"])
    t.load_text(str(tmp_path / "r.tbl"), schema)
    files = sorted((tmp_path / "t" / t.version).glob("part-*.parquet"))
    keys = [k for f in files for k in spark.read.parquet(str(f)).toPandas().r_regionkey]
    assert keys == sorted(keys) and len(keys) == 50


def test_all_answers_are_printed(spark, capsys):
    assert text.print_rows(spark.range(37).selectExpr("CAST(id AS INT) AS k")) == 37
    out = capsys.readouterr().out.splitlines()
    assert len(out) == 38
    assert out[-1] == "37 rows"
    assert sorted(out[:-1]) == sorted(f"k: [{k}]" for k in range(37))


def test_joins_bind_names_left_first(spark):
    a = spark.createDataFrame([(1, 10), (2, 20)], "k int, x int")
    b = spark.createDataFrame([(10, 1, 7), (20, 3, 8)], "y int, k int, x int")
    got = r.join(a, b, "(x = y) AND (k < 2)")
    assert got.columns == ["k", "x", "y", "k", "x"]
    assert [tuple(x) for x in got.collect()] == [(1, 10, 10, 1, 7)]
    assert [tuple(x) for x in r.join(a, b, "(x = y)", ["k", "y"]).orderBy("y").collect()] == [(1, 10), (2, 20)]
