"""Landed payloads, workbooks and stored comparisons: awkward rows against what they must give."""

from __future__ import annotations

import json
import zipfile

import pytest
from pyspark.sql import functions as F

from quillon.operators import imports
from quillon.plans import payloads
from quillon.sources import charts, landed, mappers, sheets


def bodies(spark, *items, ids=None, status=200):
    rows = [(f"x{i}", status, x if isinstance(x, str) or x is None else json.dumps(x)) for i, x in enumerate(items)]
    return spark.createDataFrame(rows, "id string, status int, body string")


def test_folds_of_maps_and_choices(spark):
    rows = spark.createDataFrame([([{"a": "1"}, None, {"a": "2", "b": "3"}],), ([],), (None,)], "m array<map<string,string>>")
    assert [r[0] for r in rows.select(mappers.folded(F.col("m"))).collect()] == [{"a": "2", "b": "3"}, {}, None]
    s = spark.createDataFrame([("Womens Wear",), ("Girls",), ("Boyswear",), ("MEN",), ("Home",), (None,)], "s string")
    assert [r[0] for r in s.select(mappers.gender_of_segment(F.col("s"))).collect()] == ["women", "girls", "boys", "men", None, None]
    v = spark.createDataFrame([("469525293_black", None), ("", "/x/p/1_dark_blue2"), (None, "/x/p/77"), (None, None), ("plain", "/p/1_red")], "g string, u string")
    assert [r[0] for r in v.select(mappers.colour_of_variant(F.col("g"), F.col("u"))).collect()] == ["black", "dark blue", None, None, None]


def test_listings_of_malformed_and_empty_payloads(spark):
    rows = bodies(spark, None, "", "{", "[]", {}, {"productId": "P1", "price": None, "categoryHierarchy": None}, {"productId": 7, "brandname": None, "imageURL": "//x"})
    got = {r["id"]: r for r in mappers.listings_a(rows).collect()}
    assert set(got) == {"P1", "7"} and got["7"]["image"] == "https://x" and got["P1"]["brand"] == "" and got["P1"]["category"] == (None, None, None)
    assert [r["id"] for r in mappers.listings_c(bodies(spark, {"id": "", "code": None}, {"id": "5", "price": {"value": 3}})).collect()] == ["5"]
    b = mappers.listings_b(bodies(spark, {"productId": 1, "mrp": 1099, "price": 499, "discount": 600}, {"productId": 2, "discount": 600}, {"productId": 3, "discount": 40})).orderBy("id").collect()
    assert [r["discountPercent"] for r in b] == [55.0, None, 40.0] and b[0]["sizes"] == [] and b[0]["inventory"] == []


def test_details_that_could_not_be_read(spark):
    pages = spark.createDataFrame([("1", 403, "{}"), ("2", 404, None), ("3", 200, "<html>"), ("", 200, "{}"), ("5", 200, "{}"), ("6", None, "{}")], "id string, status int, body string")
    got = {(r["platform"], r["id"]): r for r in mappers.details(a=pages, b=pages, c=pages).collect()}
    assert got["a", "1"]["reason"] == "blocked" and got["c", "1"]["reason"] == "akamai-ip-block" and got["b", "2"]["reason"] == "HTTP 404"
    assert got["a", "3"]["reason"] == "no_payload" and got["a", ""]["reason"] == "no_product_id" and got["b", "6"]["reason"] == "HTTP 0"
    assert got["b", "5"]["available"] and got["b", "5"]["attributes"] == {} and got["c", "5"]["images"] == [] and got["a", "1"]["images"] is None


def test_measures_of_a_guide(spark):
    guide = {"sizeGuideList": [{"dimensionSize": "S", "dimensionList": [{"dimension": "3.WAIST", "dimensionValue": "28 - 30", "dimensionUnit": "Inch"}, {"dimension": "1.HIP", "dimensionValue": "90", "dimensionUnit": "cms"}]}, {"dimensionSize": "M", "dimensionList": [{"dimension": "WAIST", "dimensionValue": "32", "dimensionUnit": "INCH"}]}]}
    rows = bodies(spark, guide, {"status": "failed", **guide}, None).withColumnRenamed("id", "product_id")
    got = charts.guides_a(rows).orderBy("pos", "ord").collect()
    assert [(r["size"], r["raw_axis"], r["ord"], r["inch_lo"], r["inch"], r["cm"]) for r in got] == [("S", "Hip", 1, None, None, 90.0), ("S", "Waist", 3, 28.0, 29.0, None), ("M", "Waist", 3, 32.0, 32.0, None)]
    assert [tuple(r) for r in charts.units(charts.guides_a(rows)).collect()] == [("a", "x0", ["cm", "inch"])]


def test_hydration_skips_and_counts_corrupt_rows(spark):
    whole = json.dumps({"anchor": {"id": "p"}, "competitors": []})
    rows = [("a", whole), ("b", whole[:-4]), ("c", None), ("d", json.dumps({"anchor": {}})), ("e", whole), ("f", whole), ("g", "[1]")]
    stored = spark.createDataFrame(rows, "key string, raw string").repartition(3)
    assert [r["key"] for r in landed.hydrated(stored, 5).orderBy("key").collect()] == ["a", "e"]
    assert tuple(landed.hydration(stored, 5).first()) == (5, 1, 1, 1) and tuple(landed.hydration(stored).first()) == (7, 1, 1, 2)
    assert landed.hydrated(stored.where("false")).count() == 0 and tuple(landed.hydration(stored.where("false")).first()) == (0, 0, 0, 0)


MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
REL = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"


def test_cells_of_a_foreign_workbook(spark, tmp_path):
    """Shared, rich and inline texts, formulas, numbers, dates, booleans, errors, links and rows without references."""
    head = '<?xml version="1.0"?>'
    sheet = f"""{head}<worksheet xmlns="{MAIN}" xmlns:r="{REL}"><sheetData><row r="2"><c r="A2" t="s"><v>0</v></c><c r="C2" t="s"><v>1</v></c><c r="AB2"><v>12.0</v></c></row>
<row><c t="inlineStr"><is><r><t>in</t></r><r><t>line</t></r></is></c><c t="str"><f>A1</f><v>MP000000001</v></c><c t="b"><v>1</v></c><c t="e"><v>#N/A</v></c><c t="d"><v>2024-01-01</v></c><c><v>1.5</v></c><c t="s"/></row>
<row r="9"><c r="B9" t="s"><v>2</v></c></row></sheetData><hyperlinks><hyperlink ref="A2" r:id="rId7"/><hyperlink ref="B9:B10" r:id="rId8"/><hyperlink ref="C9" location="x"/></hyperlinks></worksheet>"""
    rels = lambda *r: f'{head}<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">' + "".join(f'<Relationship Id="{i}" Target="{t}" Type="x"/>' for i, t in r) + "</Relationships>"
    with zipfile.ZipFile(tmp_path / "a.xlsx", "w") as z:
        z.writestr("xl/workbook.xml", f'{head}<workbook xmlns="{MAIN}" xmlns:r="{REL}"><sheets><sheet name="One &amp; two" r:id="r1"/><sheet name="Empty" r:id="r2"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", rels(("r1", "/xl/worksheets/sheet1.xml"), ("r2", "worksheets/s2.xml")))
        z.writestr("xl/worksheets/sheet1.xml", sheet)
        z.writestr("xl/worksheets/s2.xml", f'{head}<worksheet xmlns="{MAIN}"><sheetData/></worksheet>')
        z.writestr("xl/worksheets/_rels/sheet1.xml.rels", rels(("rId7", "https://shop.example/p-mp000000007"), ("rId8", "https://www.myntra.com/a/1/buy")))
        z.writestr("xl/sharedStrings.xml", f'{head}<sst xmlns="{MAIN}"><si><t>https://shop…</t></si><si><r><t>ri</t></r><r><t>ch</t></r><rPh><t>no</t></rPh></si><si><t xml:space="preserve">  </t></si></sst>')
    (tmp_path / "_b.xlsx").write_text("hidden")
    got = sorted(tuple(r)[1:] for r in sheets.cells(spark, str(tmp_path)).collect())
    s = "One & two"
    assert got == [(s, 2, 1, 0, "https://shop.example/p-mp000000007"), (s, 2, 1, 1, "https://shop…"), (s, 2, 3, 0, "rich"), (s, 2, 28, 0, "12"), (s, 3, 1, 0, "inline"), (s, 3, 2, 0, "MP000000001"), (s, 3, 6, 0, "1.5"), (s, 9, 2, 0, "https://www.myntra.com/a/1/buy")]
    rows = {r["row"]: (r["id"], r["myntra"]) for r in imports.rows(sheets.cells(spark, str(tmp_path / "a.xlsx"))).collect()}
    assert rows == {2: ("MP000000007", None), 3: ("MP000000001", None)}


def test_workbooks_round_trip(spark, tmp_path):
    rows = [("a", 1, 1, "x<&>\"'", None), ("a", 1, 30, None, "https://e.example/?a=1&b=2"), ("a", 7, 2, " 漢字 \x07😀 ", "https://f.example"), ("b", 2, 1, "5", None), ("c", 1, 1, None, None)]
    frame = spark.createDataFrame(rows, "sheet string, row int, col int, text string, link string")
    sheets.write(frame, str(tmp_path / "w"))
    got = {tuple(r)[1:] for r in sheets.cells(spark, f"file://{tmp_path}/w").collect()}
    assert got == {("a", 1, 1, 0, "x<&>\"'"), ("a", 1, 30, 0, "https://e.example/?a=1&b=2"), ("a", 7, 2, 0, "https://f.example"), ("a", 7, 2, 1, "漢字 😀"), ("b", 2, 1, 0, "5")}
    assert [sheets.column_number(sheets.column_letters(n)) for n in (1, 26, 27, 52, 703, 16384)] == [1, 26, 27, 52, 703, 16384]


def test_files_that_are_no_workbooks(spark, tmp_path):
    (tmp_path / "x.xlsx").write_text("no zip")
    with pytest.raises(Exception, match="is no workbook"):
        sheets.cells(spark, str(tmp_path)).collect()
    with zipfile.ZipFile(tmp_path / "x.xlsx", "w") as z:
        z.writestr("a", "b")
    with pytest.raises(Exception, match="is no workbook"):
        sheets.cells(spark, str(tmp_path)).collect()
    (tmp_path / "empty").mkdir()
    assert sheets.cells(spark, str(tmp_path / "empty")).count() == 0


def test_an_id_counts_only_where_it_stands_alone(spark):
    cells = spark.createDataFrame([("s", 1, 1, "see /p-mp000001 for more"), ("s", 1, 2, " mp000002 "), ("s", 2, 1, "note mp000003")], "sheet string, row int, col int, text string")
    assert [(r["row"], r["id"]) for r in imports.rows(cells).collect()] == [(1, "MP000002")]


def test_long_sheets_are_written_in_parts(spark, tmp_path):
    """No file holds more than some rows, so no task holds a whole sheet's links."""
    rows = spark.range(50_000).select(F.lit("S").alias("sheet"), (F.col("id") + 1).cast("int").alias("row"), F.lit(1).alias("col"), F.lit("x").alias("text"), F.concat(F.lit("http://l/"), "id").alias("link"))
    sheets.write(rows, str(tmp_path / "w"))
    got = sheets.cells(spark, str(tmp_path / "w"))
    assert len(list((tmp_path / "w").glob("*.xlsx"))) == 3
    assert (got.count(), got.select("sheet", "row").distinct().count(), got.where("ord = 0 and text = concat('http://l/', row - 1)").count()) == (100_000, 50_000, 50_000)


def test_parts_are_dealt_out(spark):
    """A small file is few tasks, and payloads are dear."""
    assert payloads.parts(spark, "/root/testdata/sf0.001").rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
