"""Operators on small tables; queries against DuckDB."""

from __future__ import annotations

import datetime
import math
import os

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from quillon.operators import imports, position, sizechart
from quillon.sources import landed
from quillon.streaming import state

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def shown(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}")
    return v.replace(tzinfo=None) if isinstance(v, datetime.datetime) else v


@pytest.fixture(scope="module")
def oracle(sf_dir):
    c = duckdb.connect()
    for name in TABLES:
        c.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(entry.catalogue.ORACLES))
def test_query_equals_sql(spark, sf_dir, oracle, name):
    df = entry.queries()[name](spark, sf_dir)
    got = df.collect()
    want = oracle.execute(entry.oracle_sql()[name])
    columns = [x[0] for x in want.description]
    assert sorted(columns) == sorted(df.columns)
    as_rows = lambda rows: sorted((tuple(shown(r[c]) for c in sorted(columns)) for r in rows), key=repr)
    assert as_rows(r.asDict() for r in got) == as_rows(dict(zip(columns, r, strict=True)) for r in want.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_missing_price_never_wins(spark):
    rows = spark.createDataFrame([(10.0, None, 12.0), (10.0, None, None), (5.0, 5.0, 5.0)], "own double, a double, b double")
    got = position.market(rows, "own", ["a", "b"]).select("gap", "position", "cheapest", "dearest", "spread").collect()
    assert [tuple(r) for r in got] == [(-2.0, "Cheapest", "own", "b", 2.0), (None, "No competitor data", None, None, 0.0), (0.0, "Parity", None, None, 0.0)]


def test_facets_equal_brute_force(spark):
    rows = [(b, p, g) for b in "xyz" for p in ("u", "c", None) for g in (-1, 0, 5)]
    d = spark.createDataFrame(rows, "b string, p string, g int")
    got = {(r["facet"], r["value"]): r["n"] for r in position.facets(d, {"b": F.col("b") == "x", "p": F.col("p") == "u", "g": F.col("g") > 0}, {"b": F.col("b"), "p": F.col("p")}).collect()}
    assert got == {("b", v): sum(b == v and p == "u" and g > 0 for b, p, g in rows) for v in "xyz"} | {("p", v): sum(p == v and b == "x" and g > 0 for b, p, g in rows) for v in ("u", "c", None)}


CHART = "product_id int, platform string, pos int, size string, raw_axis string, basis string, inch double, cm double, inch_lo double, inch_hi double, cm_lo double, cm_hi double"


def test_chart_intervals(spark):
    n = None
    rows = [
        (1, "a", 0, "M", "Chest", n, n, 97.0, n, n, n, n), (1, "b", 0, "m", "1. Bust", n, 38.0, n, n, n, n, n), (2, "a", 0, "L", "Chest", n, n, n, 36.0, 38.0, n, n), (2, "b", 0, "L", "Chest", n, 38.0, n, n, n, n, n),
        (3, "a", 0, "XXL", "Chest", n, 41.0, n, n, n, n, n), (3, "b", 0, "2XL", "Chest", n, 40.0, n, n, n, n, n), (3, "a", 9, "XXL", "Chest", n, 99.0, n, n, n, n, n), (4, "a", 0, "S", "Waist", n, 30.0, n, n, n, n, n),
    ]
    grid = sizechart.cells(sizechart.indexed(spark.createDataFrame(rows, CHART)))
    got = {r["product_id"]: (r["size"], r["status"], r["delta"], r["severity"], r["low"], r["high"]) for r in grid.collect()}
    assert got == {1: ("M", "match", 0.19, n, n, n), 2: ("L", "match", 0.0, n, n, n), 3: ("2XL", "mismatch", 1.0, "major", "b", "a"), 4: ("S", "single", n, n, n, n)}
    assert {r["product_id"]: r["verdict"] for r in sizechart.summary(grid).collect()} == {1: "consistent", 2: "consistent", 3: "major differences", 4: "not comparable"}


def test_stock_stays_unknown(spark):
    chart = spark.createDataFrame([(1, "M"), (1, "2 XL")], "product_id int, size string")
    stock = sizechart.size_stock(spark.createDataFrame([(1, 0, "m", False, 2), (1, 1, "m", True, None)], "product_id int, pos int, size string, available boolean, stock int"))
    assert sorted((r["size"], r["available"], r["stock"]) for r in sizechart.with_stock(chart, stock).collect()) == [("2 XL", None, None), ("M", True, 2)]


def test_csv_and_import_rows(spark):
    lines = spark.createDataFrame([(1, 'a,"b, c","say ""hi"""'), (2, "  "), (3, "x,,z")], "row int, line string")
    assert [(r["row"], r["cells"]) for r in imports.parsed_csv(lines).orderBy("row").collect()] == [(1, ["a", "b, c", 'say "hi"']), (3, ["x", "", "z"])]
    cells = [("s", 1, 0, "note"), ("s", 1, 1, "https://shop.example/x/p-MP123456"), ("s", 1, 2, "https://www.myntra.com/1"), ("s", 1, 3, "https://myntra.com/2"), ("s", 2, 0, "mp123456"), ("s", 2, 1, "http://www.ajio.com/q"), ("s", 3, 0, "nothing")]
    got = imports.items(imports.rows(spark.createDataFrame(cells, "sheet string, row int, col int, text string"))).collect()
    assert [(r["id"], r["row"], r["source_rows"], r["myntra"], r["ajio"], r["nykaa"]) for r in got] == [("MP123456", 1, [1, 2], "https://www.myntra.com/1", "http://www.ajio.com/q", None)]


def test_embedded_json(spark):
    pages = spark.createDataFrame([('x window.data = {"a": "}{", "b": [1, {"c": 2}]}; {', 1), ("none", 2), ("window.data = {broken", 3), (None, 4)], "html string, id int")
    assert [r["json"] for r in landed.embedded(pages, "window.data").orderBy("id").collect()] == ['{"a": "}{", "b": [1, {"c": 2}]}', None, None, None]


def test_comparisons_are_partitioned_by_fingerprint(spark, tmp_path):
    path = f"{tmp_path}/c"
    landed.write_comparisons(spark.createDataFrame([(1,)], "id int"), path, "v1")
    landed.write_comparisons(spark.createDataFrame([(2,)], "id int"), path, "v2")
    assert [r["id"] for r in landed.comparisons(spark, path, "v2").collect()] == [2]


def test_pairs_map(spark):
    d = spark.createDataFrame([([("a", "1"), ("b", "NA"), ("a", "2"), ("c", " ")],)], "p array<struct<key:string,value:string>>")
    assert d.select(landed.pairs_map(F.col("p"))).first()[0] == {"a": "2"}


def test_recents_expire_and_stream_equals_batch(spark, tmp_path):
    t0 = datetime.datetime(2024, 1, 1)
    rows = [("a", t0), ("b", t0 + datetime.timedelta(hours=1)), ("a", t0 + datetime.timedelta(hours=2)), ("c", t0 - datetime.timedelta(hours=49))]
    d = spark.createDataFrame(rows, "id string, searchedAt timestamp")
    got = state.recents(d, F.lit("2024-01-01 03:00:00").cast("timestamp")).collect()
    assert [r["id"] for r in got] == ["a", "b"]
    d.write.parquet(f"{tmp_path}/in")
    stream = state.recent_stream(spark.readStream.schema(d.schema).parquet(f"{tmp_path}/in"))
    q = stream.writeStream.outputMode("complete").format("memory").queryName("recent_test").trigger(availableNow=True).option("checkpointLocation", f"{tmp_path}/check").start()
    q.awaitTermination(60)
    assert {r["id"]: r["searchedAt"] for r in spark.table("recent_test").collect()} == {r["id"]: r["searchedAt"] for r in d.groupBy("id").agg(F.max("searchedAt").alias("searchedAt")).collect()}


def test_rest_works_without_the_text_operators():
    """The entry point guards its imports; nothing else refers to the subpackage."""
    root = os.path.dirname(entry.__file__)
    for folder, _, files in os.walk(f"{root}/quillon"):
        if "/llm" not in folder:
            for f in files:
                if f.endswith(".py"):
                    with open(f"{folder}/{f}") as source:
                        assert "quillon.llm" not in source.read()
