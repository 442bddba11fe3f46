"""Export rows and filters, chart payloads."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from quillon.functions import decision as dec
from quillon.functions import text as t
from quillon.operators import exports, images, imports, position, reports, sizechart
from quillon.sources import charts, landed

ANCHOR = "id string, brand string, title string, category string, gender string, price double, fresh boolean"
DECISION = "anchor_id string, platform string, status string, price double, score double, matchType string, sizes array<string>"


def test_export_rows_and_filters(spark):
    anchors = spark.createDataFrame([("a", "Nike", "Men Polo Tee", None, None, 100.0, True), ("b", "Puma", "Women Shoes", "shoes", "women", 50.0, False), ("c", None, "Thing", None, None, 70.0, True)], ANCHOR)
    decided = spark.createDataFrame([("a", "p", "matched", 80.0, 0.9, "EXACT MATCH", ["2XL", "M"]), ("a", "q", "no_match", 10.0, 0.1, None, ["S"]), ("b", "p", "matched", 60.0, 0.8, "CLOSE MATCH", None)], DECISION)
    rows = exports.rows(anchors, decided, ["p", "q"])
    got = {r["id"]: r for r in rows.collect()}
    assert (got["a"]["gap"], got["a"]["position"], got["a"]["category"], got["a"]["gender"], sorted(got["a"]["sizes"])) == (20.0, "Undercut", "polo", "men", ["M", "XXL"])
    assert got["b"]["gap"] == -10.0 and got["c"]["position"] == "No competitor data" and got["a"]["q_price"] is None
    ids = lambda **f: [r["id"] for r in exports.filtered(rows, exports.Filters(**f)).collect()]
    assert ids() == ["a", "b", "c"] and ids(position="winning") == ["b"] and ids(categories=("unclassified",)) == ["c"] and ids(sizes=("XXL",)) == ["a"]
    assert ids(low=60.0, high=90.0) == ["c"] and ids(matched="yes", fresh="no") == ["b"] and ids(query="PUMA sho") == ["b"]


def test_whole_export_rows(spark):
    """Several decisions for a platform, none for another, other statuses, equal scores, null prices and ages, empty tables."""
    anchors = spark.createDataFrame([("a", 100.0, "2024-01-01 00:00:00"), ("b", None, None), ("c", 50.0, "2023-01-01 00:00:00"), ("d", 10.0, None)], "id string, price double, matched_at string")
    schema = "anchor_id string, platform string, status string, score double, matchType string, title string, mrp double, price double, discount double, url string"
    decided = spark.createDataFrame(
        [("a", "p", "matched", 0.8, "CLOSE MATCH", "t", 90.0, 80.0, 11.0, "u"), ("a", "p", "matched", 0.95, "EXACT MATCH", "best", 90.0, 85.0, 5.0, "u"), ("a", "p", "blocked", None, None, None, None, None, None, None),
         ("a", "q", "matched", 0.95, "EXACT MATCH", "q", 90.0, None, None, None), ("b", "p", "matched", 0.9, "EXACT MATCH", "t", None, 5.0, None, None), ("b", "q", "odd", 1.0, "X", "t", 1.0, 1.0, 1.0, "u"),
         ("c", "q", "color_mismatch", 0.99, "EXACT MATCH", "t", 1.0, 1.0, 1.0, "u"), (None, "p", "matched", 1.0, "X", "t", 1.0, 1.0, 1.0, "u")], schema)
    rows = exports.whole_rows(anchors, decided, ["p", "q"], F.expr("timestamp'2024-01-01 12:00:00'"), 24.0)
    got = {r["id"]: r for r in rows.collect()}
    assert len(got) == 4
    a = got["a"]
    assert (a["p_title"], a["p_price"], a["q_price"], a["best_platform"], a["matched_count"], a["match_type"], a["gap"], a["age_hours"], a["fresh"]) == ("best", 85.0, None, "p", 2, "EXACT MATCH", 15.0, 12.0, True)
    b = got["b"]
    assert (b["gap"], b["position"], b["q_status"], b["q_status_label"], b["q_price"], b["age_hours"], b["fresh"]) == (None, "No competitor data", "odd", "odd", None, None, False)
    assert (got["c"]["p_status"], got["c"]["q_status_label"], got["c"]["match_type"], got["c"]["best_platform"], got["c"]["q_price"]) == ("error", "Different colourway", "NO MATCH", None, None)
    assert (got["d"]["p_status_label"], got["d"]["matched_count"], got["d"]["confidence"]) == ("Error", 0, None)
    assert exports.coverage(rows).first().asDict() == {"products": 4, "matched": 2, "match_rate": 50.0, "fresh": 1}
    assert exports.coverage(rows.where("false")).first().asDict() == {"products": 0, "matched": 0, "match_rate": 0.0, "fresh": 0}


def test_catalog_with_comparisons(spark):
    catalog = spark.createDataFrame([(1,), (2,), (2,), (None,)], "id int")
    found = spark.createDataFrame([(2, 1, None, 7.0, "x"), (9, 0, 1.0, 1.0, "y")], "id int, matched_count int, p_price double, q_price double, matched_at string")
    got = position.with_summaries(catalog, found, ["p", "q"]).collect()
    assert sorted((r["id"] or 0, r["comparison"] and (r["comparison"]["cheapest"], r["comparison"]["prices"]["p"])) for r in got) == [(0, None), (1, None), (2, ("q", None)), (2, ("q", None))]
    assert [r["id"] for r in position.compared_only(catalog, found.unionByName(found)).collect()] == [2, 2]
    assert sorted((r["k"] or 0, r["n"]) for r in position.counts(catalog, "id", "k").collect()) == [(0, 1), (1, 1), (2, 2)]


def test_reachable_prices(spark):
    rows = spark.createDataFrame([(5.0, 1.0, "x"), (50.0, 2.0, "x"), (70.0, 4.0, "y"), (None, None, "x"), (9.0, 8.0, None)], "price double, gap double, brand string")
    chosen = {"brand": F.col("brand") == "x", "price": F.col("price") > 10}
    assert tuple(position.reachable(rows, chosen, "price").first()) == (5.0, 50.0, 1, 2.0)
    assert tuple(position.reachable(rows, {}, "price").first()) == (5.0, 70.0, 5, 15.0)
    assert tuple(position.reachable(rows.where("false"), chosen, "price").first()) == (None, None, 0, None)


def test_filters_are_parsed(spark):
    f = exports.Filters.parsed({"brand": ["Nike,Puma", "X"], "position": "odd", "fresh": "yes", "min": "10", "max": "x"})
    assert f.brands == ("Nike", "Puma", "X") and f.position == "all" and f.fresh == "yes" and f.low == 10 and f.high is None
    assert exports.Filters().sentence() == "everything" and exports.Filters(brands=("A B",)).filename("csv") == "comparisons-brand-a-b.csv"


def test_chart_payloads_meet_on_one_grid(spark):
    a = charts.measured(spark.createDataFrame([(1, 0, "1. CHEST", "inches", "M", "38"), (1, 1, "1. CHEST", "cm", "M", "96.5")], "product_id int, ord int, axis string, unit string, size string, value string"), "a")
    b = charts.ranged(spark.createDataFrame([(1, 0, "M", "Chest", "GARMENT", "in", None, "37", "39")], "product_id int, pos int, size string, axis string, kind string, unit string, value string, lo string, hi string"), "b")
    inner = json.dumps([{"size": "M", "attributes": {"chest_attribute": "41", "size_label": "M"}}])
    c = charts.encoded(spark.createDataFrame([(1, json.dumps({"chart": inner}))], "product_id int, payload string"), "c")
    grid = sizechart.cells(sizechart.indexed(a.unionByName(b).unionByName(c))).collect()
    assert [(r["axis"], r["n"], r["status"], r["severity"], r["delta"]) for r in grid] == [("Chest", 3, "mismatch", "major", 3.0)]


def test_image_colours(spark):
    rows = [(1, x, y, *((200, 30, 40) if 5 <= x < 15 and 5 <= y < 15 else (250, 250, 250))) for x in range(20) for y in range(20)] + [(2, x, y, 9, 9, 9) for x in range(10) for y in range(10)]
    # a few pixels in the middle: the boxes widen; half of a large one beside the narrow box: the wide one is taken; too few: no colour
    rows += [(3, x, y, *((0, 0, 90 + x % 2) if 8 <= x < 12 and 8 <= y < 12 else (250, 250, 250))) for x in range(20) for y in range(20)]
    rows += [(4, x, y, *((10, 90, 10) if 3 <= x < 7 and 3 <= y < 17 else (250, 250, 250))) for x in range(20) for y in range(20)]
    rows += [(5, x, y, *((10, 90, 10) if x == 10 and 5 <= y < 15 else (250, 250, 250))) for x in range(20) for y in range(20)]
    got = images.colours(spark.createDataFrame(rows, "image_id int, x int, y int, r int, g int, b int")).orderBy("image_id").collect()
    assert [(r["image_id"], r["rgb"], r["dominant"], r["sampled"]) for r in got] == [(1, [200, 30, 40], 81, 81), (3, [0, 0, 91], 16, 16), (4, [10, 90, 10], 56, 56)]
    assert spark.range(1).select(images.region(F.lit("jeans")), images.region(F.lit(None).cast("string"))).first() == ("bottom", "object")


def test_report_texts(spark):
    d = spark.createDataFrame([([("S", True), ("M", None), ("L", False)],), ([],), (None,)], "s array<struct<size:string,available:boolean>>")
    assert [r[0] for r in d.select(reports.size_sentence(F.col("s"))).collect()] == ["In stock: S. Sold out: M, L", None, None]
    assert [r[0] for r in spark.createDataFrame([(5.0,), (20.0,), (30.0,), (None,)], "d double").select(reports.colour_verdict(F.col("d"))).collect()] == ["best", "moderate", "low", "na"]


def test_details_and_renditions(spark):
    d = spark.createDataFrame([(None, ["Men's Clothing", "Casual", "T-shirts & Polos"]), ("Women", None)], "g string, p array<string>")
    assert [tuple(r) for r in d.select(t.garment_from_path(F.col("p")), t.gender_from_detail(F.col("g"), F.col("p"))).collect()] == [("tshirt", "men"), (None, "women")]
    links = ["https://x.example/a/437Wx649H/b.jpg", "https://y.example/-473Wx593H-z.jpg", "https://assets.myntassets.com/h_720,q_90,w_540/v1/dpr_2.jpg", "plain", None]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in links], "u string").select(t.small_rendition(F.col("u"))).collect()]
    assert got == ["https://x.example/a/158Wx198H/b.jpg", "https://y.example/-286Wx359H-z.jpg", "https://assets.myntassets.com/h_256,q_90,w_192/v1/dpr_1.jpg".replace("q_90", "q_60"), "plain", None]


def test_older_scorer_and_cheapest(spark):
    lit = F.lit
    yes, no, unknown = lit(True), lit(False), lit(None).cast("boolean")
    row = spark.range(1).select(
        dec.all_or_nothing(lit(1.0), yes, yes, yes, yes, unknown, yes, unknown, lit(1.0), unknown).alias("a"), dec.all_or_nothing(lit(1.0), yes, yes, no, yes, yes, yes, yes, lit(1.0), yes).alias("b"),
        dec.cheapest({"p": lit(None).cast("double"), "q": lit(2.0), "r": lit(2.0)}).alias("c")).first()
    assert tuple(row["a"]) == (0.886, True) and tuple(row["b"]) == (0.304, False) and row["c"] == "q"


def test_import_checks(spark):
    assert [imports.problem(*x) for x in (("a.csv", 0, 0, 9), ("a.txt", 1, 1, 9), ("a.CSV", 1, 0, 9), ("a.xlsx", 1, 10, 9), ("a.xlsm", 1, 9, 9))] == ["empty_upload", "unsupported_format", "no_links_found", "too_many_rows", None]
    sheet = imports.template(spark)
    cells = sheet.select(F.lit("s").alias("sheet"), F.col("n").alias("row"), F.posexplode(F.array("product", "myntra", "ajio", "note")).alias("col", "text"))
    found = imports.rows(cells)
    assert imports.summary(found, imports.items(found)).first().asDict() == {"rows": 3, "products": 3, "hints_myntra": 1, "hints_ajio": 0, "hints_nykaa": 0, "repeated": 0}


def test_lookups_fall_back(spark):
    ids = spark.createDataFrame([(1,), (2,), (3,)], "id int")
    first, second = (spark.createDataFrame(x, "id int, v string") for x in ([(1, "a")], [(1, "b"), (2, "c")]))
    got = {r["id"]: (r["found"] and r["found"]["v"], r["source"]) for r in landed.resolved(ids, "id", first, second).collect()}
    assert got == {1: ("a", 0), 2: ("c", 1), 3: (None, None)}
