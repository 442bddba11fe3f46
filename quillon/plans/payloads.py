"""Landed payloads, workbooks and size charts: JSON and files that Spark makes of the tables, read back by the mappers.

The SQL computes what the mappers must give from the tables themselves, without any JSON.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.functions.plan import dealt
from quillon.plans.catalogue import query, table
from quillon.operators import images, imports
from quillon.sources import charts, landed, mappers, shared, sheets

c, lit = F.col, F.lit


def if_(condition: str, value) -> Column:
    """A value where a SQL condition holds, else null, which JSON leaves out."""
    return F.when(F.expr(condition), value if isinstance(value, Column) else lit(value))


def structs(names: tuple[str, ...], *rows: tuple) -> Column:
    """An array of structs of texts."""
    text = lambda x: x if isinstance(x, Column) else lit(x).cast("string")
    return F.array(*[F.struct(*[text(x).alias(n) for n, x in zip(names, r, strict=True)]) for r in rows])


def parts(spark, sf_dir) -> DataFrame:
    """Parts, dealt out: making and reading their payloads costs far more than a shuffle of a few short columns."""
    return dealt(table(spark, sf_dir, "part")).withColumn("k", c("p_partkey").cast("string"))


def body(*fields: Column) -> Column:
    return F.to_json(F.struct(*fields))


def _listing_a() -> list[Column]:
    price = F.struct(if_("p_partkey % 7 > 0", F.struct((c("p_retailprice") - c("p_size")).alias("doubleValue"),
        if_("p_size % 2 = 0", "EUR").alias("currencyIso"))).alias("sellingPrice"), if_("p_partkey % 5 > 0", F.struct(c("p_retailprice").alias("doubleValue"))).alias("mrpPrice"))
    levels = F.array(F.create_map(lit("L1"), c("p_type")), F.create_map(lit("L2"), lit("old"), lit("L3"), if_("p_size % 3 > 0", "third")), F.create_map(lit("L2"), c("p_brand")))
    return [
        if_("p_partkey % 17 > 0", F.concat(lit("MP"), "k")).alias("productId"), F.concat(lit(" "), "p_brand").alias("brandname"),
        F.concat("p_name", lit("  ")).alias("productname"), if_("p_size % 4 > 0", F.substring_index("p_name", " ", 1)).alias("productColor"),
        price.alias("price"), levels.alias("categoryHierarchy"), if_("p_size % 6 > 0", F.when(c("p_size") % 5 == 0, "").otherwise(c("p_size").cast("string"))).alias("discountPercent"),
        F.when(c("p_size") % 2 == 0, F.concat(lit("//img.example/"), "k")).otherwise(F.concat(lit("https://img.example/"), "k")).alias("imageURL"),
        if_("p_size % 9 > 0", F.concat(lit("/p-"), "k")).alias("webURL"),
    ]


@query("""SELECT 'MP' || p_partkey AS id, p_brand AS brand, p_name AS title, CASE WHEN p_size % 4 > 0 THEN string_split(p_name, ' ')[1] END AS color,
  CASE WHEN p_partkey % 5 > 0 THEN p_retailprice WHEN p_partkey % 7 > 0 THEN p_retailprice - p_size END AS mrp, CASE WHEN p_partkey % 7 > 0 THEN p_retailprice - p_size END AS price,
  CASE WHEN p_partkey % 7 > 0 AND p_size % 2 = 0 THEN 'EUR' ELSE 'INR' END AS currency, CASE WHEN p_size % 6 > 0 AND p_size % 5 > 0 THEN p_size::DOUBLE END AS "discountPercent",
  'https://img.example/' || p_partkey AS image, CASE WHEN p_size % 9 > 0 THEN 'https://www.tatacliq.com/p-' || p_partkey END AS url, p_type AS l1, p_brand AS l2, CASE WHEN p_size % 3 > 0 THEN 'third' END AS l3
FROM part WHERE p_partkey % 17 > 0""")
def listings_own(spark, sf_dir):
    rows = parts(spark, sf_dir).select(body(*_listing_a()).alias("body"))
    return mappers.listings_a(rows).select("id", "brand", "title", "color", "mrp", "price", "currency", "discountPercent", "image", "url", "category.*")


@query("""WITH p AS (SELECT *, CASE WHEN p_partkey % 6 > 0 THEN p_retailprice END AS mrp, CASE WHEN p_partkey % 8 > 0 THEN p_retailprice - 10 * p_size END AS price FROM part)
SELECT CAST(p_partkey AS VARCHAR) AS id, p_brand AS brand, p_name AS title, CASE WHEN p_size % 2 = 0 THEN 'men' END AS gender, mrp, price,
  coalesce(CASE WHEN mrp > 0 AND price > 0 THEN round((mrp - price) / mrp * 100) END, CASE WHEN p_size * 4 <= 100 THEN p_size * 4.0 END) AS "discountPercent", CASE WHEN p_size % 3 = 0 THEN 's' WHEN p_size % 3 = 1 THEN 'i' END AS image,
  'https://www.myntra.com/x/' || p_partkey AS url, CASE WHEN p_size % 5 > 0 THEN 'S,' || p_size ELSE '' END AS sizes,
  CASE WHEN p_size % 4 > 0 THEN 'S:true:' || p_size || ',M:false:-' ELSE '' END AS inventory, 'red:1,blue:2' AS colours FROM p""")
def listings_rival_b(spark, sf_dir):
    fields = [
        c("p_partkey").alias("productId"), c("p_brand").alias("brand"), F.concat(lit(" "), "p_name").alias("productName"),
        if_("p_size % 2 = 0", "Men").alias("gender"), if_("p_partkey % 6 > 0", c("p_retailprice")).alias("mrp"),
        if_("p_partkey % 8 > 0", c("p_retailprice") - 10 * c("p_size")).alias("price"), (c("p_size") * 4).alias("discount"),
        if_("p_size % 3 = 0", "s").alias("searchImage"), if_("p_size % 3 < 2", F.array(F.struct(lit("i").alias("src")))).alias("images"),
        F.concat(lit("x/"), "k").alias("landingPageUrl"), if_("p_size % 5 > 0", F.concat(lit(" S , ,"), c("p_size").cast("string"))).alias("sizes"),
        if_("p_size % 4 > 0", F.array(F.struct(lit("S").alias("label"), lit(True).alias("available"), c("p_size").alias("inventory")),
        F.struct(lit("M").alias("label"), lit(None).cast("boolean").alias("available"), lit(None).cast("int").alias("inventory")))).alias("inventoryInfo"),
        structs(("color", "colour", "styleId"), ("red", None, "1"), ("", "blue", "2"), (None, "", "3")).alias("colourVariants"),
    ]
    found = mappers.listings_b(parts(spark, sf_dir).select(body(*fields).alias("body")))
    shown = lambda items, one: F.array_join(F.transform(items, one), ",")
    inventory = shown("inventory", lambda i: F.concat_ws(":", i["size"], i["available"].cast("string"), F.coalesce(i["count"].cast("string"), lit("-"))))
    colours = shown("colourVariants", lambda v: F.concat_ws(":", v["color"], v["id"]))
    return found.select("id", "brand", "title", "gender", "mrp", "price", "discountPercent", "image", "url", F.array_join("sizes", ",").alias("sizes"),
        inventory.alias("inventory"), colours.alias("colours"))


_SEGMENT = ["Men", "Women", "Boys", "Girls Western", "Unisex", "Home", None]


@query("""WITH p AS (SELECT *, p_partkey % 7 AS s, string_split(p_name, ' ') AS w FROM part)
SELECT CASE WHEN p_partkey % 3 = 0 THEN 'c' || p_partkey ELSE CAST(p_partkey AS VARCHAR) END AS id, p_brand AS brand, CASE WHEN p_size % 3 < 2 THEN w[1] || ' ' || w[2] ELSE 'given' END AS color,
  CASE s WHEN 0 THEN 'men' WHEN 1 THEN 'women' WHEN 2 THEN 'boys' WHEN 3 THEN 'girls' WHEN 4 THEN 'unisex' END AS gender, p_type AS "articleType", CASE s WHEN 0 THEN 'Men' WHEN 1 THEN 'Women' WHEN 2 THEN 'Boys' WHEN 3 THEN 'Girls Western' WHEN 4 THEN 'Unisex' WHEN 5 THEN 'Home' END AS l1,
  p_type AS l3, p_retailprice AS mrp, CASE WHEN p_size % 4 > 0 THEN p_retailprice - 5 ELSE p_retailprice - 7 END AS price, p_size::DOUBLE AS "discountPercent", round(p_retailprice / 1000, 2) AS rating, 'M,' || p_size AS sizes FROM p""")
def listings_rival_c(spark, sf_dir):
    group = F.concat("k", lit("99_"), F.replace("p_name", lit(" "), lit("_")))
    fields = [
        if_("p_partkey % 3 = 0", F.concat(lit("c"), "k")).alias("code"), c("k").alias("id"), if_("p_size % 2 = 0", c("p_brand")).alias("brandName"),
        c("p_name").alias("name"), if_("p_size % 3 = 2", "given").alias("color"),
        F.when(c("p_size") % 3 == 1, F.concat(lit("/x/p/"), group)).otherwise(F.concat(lit("/x/p/"), "k")).alias("url"),
        F.element_at(F.array(*map(lit, _SEGMENT)), (c("p_partkey") % 7 + 1).cast("int")).alias("segmentName"), c("p_type").alias("brickNameText"),
        F.struct(c("p_retailprice").alias("value")).alias("wasPriceData"),
        if_("p_size % 4 > 0", F.struct((c("p_retailprice") - 5).alias("value"))).alias("price"), F.struct((c("p_retailprice") - 7).alias("value")).alias("offerPrice"),
        F.concat(c("p_size").cast("string"), lit("% off")).alias("discountPercent"), (c("p_retailprice") / 1000).alias("averageRating"),
        structs(("sizeValue", "value"), ("M", None), ("", c("p_size").cast("string"))).alias("sizeOptions"),
        F.struct(c("p_brand").alias("brandName"), if_("p_size % 3 = 0", group).alias("colorGroup")).alias("fnlColorVariantData"),
    ]
    found = mappers.listings_c(parts(spark, sf_dir).select(body(*fields).alias("body")))
    return found.select("id", "brand", "color", "gender", "articleType", "category.l1", "category.l3", "mrp", "price", "discountPercent", "rating", F.array_join("sizes", ",").alias("sizes"))


@query("""WITH p AS (SELECT *, p_partkey // 20 AS page, (p_partkey // 20) % 7 AS s FROM part), n AS (SELECT page, count(*) AS n FROM p GROUP BY 1)
SELECT CAST(p.page AS BIGINT) AS page, s = 3 AS blocked, CASE s WHEN 3 THEN 'blocked' WHEN 4 THEN 'HTTP 500' WHEN 5 THEN 'malformed' END AS reason, CASE WHEN s IN (3, 4, 5) THEN 0 WHEN s = 1 THEN 1000 ELSE n END AS total,
  CASE WHEN s = 1 THEN 50 END AS total_pages, CASE WHEN s NOT IN (3, 4, 5) THEN 'MP' || p_partkey END AS id, CASE WHEN s NOT IN (3, 4, 5) THEN p_brand END AS brand
FROM p JOIN n USING (page) WHERE s NOT IN (3, 4, 5) OR p_partkey % 20 = 0""")
def search_pages(spark, sf_dir):
    """Pages of twenty listings; some were refused, failed or are cut off."""
    rows = parts(spark, sf_dir).withColumns({"page": F.floor(c("p_partkey") / 20), "item": F.struct(F.concat(lit("MP"), "k").alias("productId"), c("p_brand").alias("brandname"))})
    s = c("page") % 7
    pages = rows.groupBy("page").agg(F.sort_array(F.collect_list("item")).alias("searchresult"))  # twenty
    totals = F.when(s == 1, F.struct(lit(1000).alias("totalResults"), lit(50).alias("totalPages")))
    text = F.to_json(F.struct("searchresult", totals.alias("pagination")))
    landed = pages.select(lit("q").alias("query"), "page", F.when(s == 3, 403).when(s == 4, 500).otherwise(200).alias("status"), F.when(s == 5, F.substring(text, 1, 30)).otherwise(text).alias("body"))
    found = mappers.search_pages(landed)
    item = F.from_json("item", "productId string, brandname string")
    return found.select("page", "blocked", "reason", "total", "total_pages", item["productId"].alias("id"), item["brandname"].alias("brand"))


def _detail_a() -> list[Column]:
    image = lambda key, at: F.struct(lit(key).alias("key"), F.concat(lit(at), "k").alias("value"))
    album = lambda *images: F.struct(F.array(*images).alias("galleryImages"))
    views = F.array(album(image("zoom", "//z/"), image("product", "//p/")), album(image("product", "https://p/"), image("product", "//p/")))
    zoomed = F.array(album(image("zoom", "//z/"), image("zoom", "//z/")))
    money = lambda x: F.struct(x.alias("doubleValue"))
    pair = lambda k, v: F.struct(lit(k).alias("key"), v.alias("value"))
    return [
        if_("p_size % 10 > 0", c("p_name")).alias("productName"), if_("p_size % 20 > 0", F.concat(lit("t "), "p_name")).alias("productTitle"),
        c("p_brand").alias("brandName"), money(c("p_retailprice") - c("p_size")).alias("winningSellerPrice"), if_("p_size % 3 > 0", money(c("p_retailprice"))).alias("mrpPrice"),
        if_("p_size % 4 = 0", F.concat(lit("Rs "), c("p_size").cast("string"), lit("% off"))).alias("discount"), F.when(c("p_size") % 5 == 0, zoomed).otherwise(views).alias("galleryImagesList"),
        structs(("category_id", "category_name"), (c("p_type"), ""), ("", "Top"), (c("p_brand"), c("p_type"))).alias("categoryHierarchy"), if_("p_size % 2 = 0", "Women").alias("gender"),
        if_("p_size % 3 = 1", c("p_name")).alias("productDescription"), lit("note").alias("styleNote"), F.array(pair("Fit", lit("old")), pair("Fit", c("p_type")), pair("", lit("x"))).alias("details"),
        structs(("knowMoreItemV2",), ("Free delivery",), (if_("p_size % 2 = 1", "Easy returns"),)).alias("knowMoreV2"), if_("p_size % 3 > 0", "policy").alias("returnPolicy"),
        F.array(F.struct(if_("p_size % 7 = 0", "d").alias("description"), lit("o").alias("title"))).alias("potentialPromotions"),
        F.array(F.struct(F.when(c("p_size") % 8 == 0, "Video 1").otherwise("x").alias("key"))).alias("imageGalleryAttributes"),
        (c("p_size") % 6 > 0).alias("allOOStock"), (c("p_size") % 4).alias("winningSellerAvailableStock"), lit("seller").alias("winningSellerName"),
    ]


@query("""WITH p AS (SELECT *, p_retailprice - p_size AS price, CASE WHEN p_size % 3 > 0 THEN p_retailprice ELSE p_retailprice - p_size END AS mrp FROM part)
SELECT 'mp' || p_partkey AS id, p_brand AS brand, CASE WHEN p_size % 10 > 0 THEN p_name ELSE 't ' || p_name END AS title, mrp, price, CASE WHEN p_size % 4 = 0 THEN nullif(p_size, 0)::DOUBLE WHEN mrp > price THEN round((mrp - price) / mrp * 100) END AS "discountPercent",
  CASE WHEN p_size % 5 = 0 THEN 'https://z/' ELSE 'https://p/' END || p_partkey AS image, 'https://www.tatacliq.com/p-mp' || p_partkey AS url, p_type AS l1, p_brand AS l2, CASE WHEN p_size % 2 = 0 THEN 'women' END AS gender FROM p WHERE p_size % 20 > 0""")
def anchor_details(spark, sf_dir):
    """Anchors of pasted links: from the own retailer's detail pages."""
    rows = parts(spark, sf_dir).select(F.concat(lit("mp"), "k").alias("id"), body(*_detail_a()).alias("body"))
    return mappers.anchors_a(rows).select("id", "brand", "title", "mrp", "price", "discountPercent", "image", "url", "category.l1", "category.l2", "gender")


def _detail_b() -> list[Column]:
    said = lambda k, v: F.struct(lit(k).alias("title"), v.alias("description"))
    link = lambda a, b: F.struct(lit(a).cast("string").alias("secureSrc"), F.concat(lit(b), "k").alias("src"))
    album = lambda *images: F.struct(F.array(*images).alias("images"))
    return [
        F.create_map(lit("Fit"), c("p_type"), lit("Neck"), F.when(c("p_size") % 2 == 0, " na ").otherwise("round"), lit("Wash"), lit("")).alias("articleAttributes"),
        F.array(said("style_note", lit("a<br/>b")),
        said("description", if_("p_size % 3 = 0", F.concat(lit("<p>"), "p_name", lit("</p>"))))).alias("descriptors"),
        F.array(said("Other", lit("no")), said("Product Details", c("p_type"))).alias("productDetails"),
        F.struct(F.array(album(link(None, "//i/"), link("https://s", "x")), album(link(None, "//i/"))).alias("albums")).alias("media"),
        F.struct(lit("Men").alias("gender"), lit("Apparel").alias("masterCategory"), c("p_type").alias("articleType")).alias("analytics"),
        F.struct(if_("p_size % 4 = 0", 14).alias("returnPeriod"), F.array(lit("Cash"), lit("Return in 7")).alias("descriptors")).alias("serviceability"),
        F.struct(F.when(c("p_size") % 5 == 0, True).otherwise(False).alias("outOfStock")).alias("flags"),
        F.struct((c("p_retailprice") / 300).alias("averageRating"), F.struct((c("p_size") % 3).alias("reviewsCount")).alias("reviewInfo")).alias("ratings"),
    ]


def _detail_c() -> list[Column]:
    value = lambda x: F.struct(x.alias("value"))
    feature = lambda name, *values: F.struct(lit(name).alias("name"), F.array(*map(value, values)).alias("featureValues"))
    return [
        if_("p_size % 3 = 0", c("p_name")).alias("description"), F.array(feature("Fit", c("p_type"), lit(""), lit("Slim")), feature("Additional Information", lit("more"))).alias("featureData"),
        F.array(F.struct(F.array(feature("Country of Origin", lit("India")), feature("Empty", lit("")), feature("Fit", lit("last"))).alias("features"))).alias("classifications"),
        structs(("format", "url"), (F.when(c("p_size") % 2 == 0, "product").otherwise("zoom"), "u1"), ("zoom", "u2")).alias("images"),
        F.struct(F.when(c("p_size") % 4 == 0, "outOfStock").otherwise("inStock").alias("stockLevelStatus")).alias("stock"),
    ]


def detail_pages(spark, sf_dir) -> dict[str, DataFrame]:
    """Landed detail pages of all parts at three retailers; some were refused, failed or hold no payload."""
    rows = parts(spark, sf_dir)
    page = lambda fields: F.when(c("p_size") % 19 == 3, lit("<html>")).otherwise(body(*fields))
    status = F.when(c("p_size") % 13 == 5, 403).when(c("p_size") % 17 == 4, 500).otherwise(200)
    return {n: rows.select(F.concat(lit(n), "k").alias("id"), status.alias("status"), page(fields()).alias("body")) for n, fields in (("a", _detail_a), ("b", _detail_b), ("c", _detail_c))}


@query("""WITH p AS (SELECT *, CASE WHEN p_size % 13 = 5 THEN 'blocked' WHEN p_size % 17 = 4 THEN 'HTTP 500' WHEN p_size % 19 = 3 THEN 'no_payload' END AS why, CAST(p_partkey AS VARCHAR) AS k FROM part),
r AS (SELECT 'a' AS platform, 'a' || k AS id, why AS reason, CASE WHEN p_size % 3 = 1 THEN p_name ELSE 'note' END AS description, 'Fit=' || p_type AS attributes, 3 AS "bulletPoints", 'Top>' || p_type AS path, NULL AS "countryOfOrigin",
  CASE WHEN p_size % 2 = 1 THEN 'Easy returns' WHEN p_size % 3 > 0 THEN 'policy' END AS "returnPolicy", CASE WHEN p_size % 7 = 0 THEN 'd' ELSE 'o' END AS offers, CASE WHEN p_size % 5 = 0 THEN 'https://z/' || k ELSE 'https://p/' || k END AS images,
  p_size % 8 = 0 AS "videoAvailable", p_size % 6 = 0 OR p_size % 4 > 0 AS "inStock", 'seller' AS seller, NULL::DOUBLE AS rating, NULL::BIGINT AS "reviewCount" FROM p
UNION ALL SELECT 'b', 'b' || k, why, CASE WHEN p_size % 3 = 0 THEN p_name ELSE p_type END, 'Fit=' || p_type || CASE WHEN p_size % 2 = 1 THEN ';Neck=round' ELSE '' END, 1 + p_size % 2, 'Apparel>' || p_type, NULL,
  CASE WHEN p_size % 4 = 0 THEN '14 Days Return' ELSE 'Return in 7' END, '', '//i/' || k || ',https://s', false, p_size % 5 > 0, NULL, round(p_retailprice / 300, 2), nullif(p_size % 3, 0) FROM p
UNION ALL SELECT 'c', 'c' || k, CASE why WHEN 'blocked' THEN 'akamai-ip-block' ELSE why END, CASE WHEN p_size % 3 = 0 THEN p_name ELSE 'more' END, 'Additional Information=more;Country of Origin=India;Fit=last', NULL, NULL, 'India', NULL, '',
  CASE WHEN p_size % 2 = 0 THEN 'u1' ELSE 'u1,u2' END, false, p_size % 4 > 0, NULL, NULL, NULL FROM p)
SELECT platform, id, reason IS NULL AS available, reason, CASE WHEN reason IS NULL THEN description END AS description, CASE WHEN reason IS NULL THEN attributes END AS attributes, CASE WHEN reason IS NULL THEN "bulletPoints" END AS "bulletPoints", CASE WHEN reason IS NULL THEN path END AS path,
  CASE WHEN reason IS NULL THEN "countryOfOrigin" END AS "countryOfOrigin", CASE WHEN reason IS NULL THEN "returnPolicy" END AS "returnPolicy", CASE WHEN reason IS NULL THEN offers END AS offers, CASE WHEN reason IS NULL THEN images END AS images,
  CASE WHEN reason IS NULL THEN "videoAvailable" END AS "videoAvailable", CASE WHEN reason IS NULL THEN "inStock" END AS "inStock", CASE WHEN reason IS NULL THEN seller END AS seller, CASE WHEN reason IS NULL THEN rating END AS rating, CASE WHEN reason IS NULL THEN "reviewCount" END AS "reviewCount"
FROM r""")
def details_union(spark, sf_dir):
    """Details of three retailers in one table."""
    found = mappers.details(**detail_pages(spark, sf_dir))
    pairs = F.array_join(F.transform(F.array_sort(F.map_entries("attributes")), lambda e: F.concat_ws("=", e["key"], e["value"])), ";")
    keep = ["platform", "id", "available", "reason", "description", pairs.alias("attributes"), "bulletPoints", F.array_join("categoryPath", ">").alias("path"),
        "countryOfOrigin", "returnPolicy", F.array_join("offers", ",").alias("offers")]
    return found.select(*keep, F.array_join("images", ",").alias("images"), "videoAvailable", "inStock", "seller", "rating", "reviewCount")


# ---- size charts of payloads


def _guide_a() -> list[Column]:
    """Apparel where the key is odd, footwear where it is even."""
    names = ("dimension", "dimensionValue", "dimensionUnit", "dimensionSize", "usSize", "euroSize", "footlength")
    n = c("p_size").cast("string")
    worn = lambda axis, value, unit: (axis, value, unit, None, None, None, None)
    chest = F.concat(n, lit(" - "), (c("p_size") + 2).cast("string"))
    clothes = structs(names, worn("2.CHEST", chest, "INCH"), worn("1) across shoulder", n, "CMS"), worn("2.CHEST", (c("p_size") * 2).cast("string"), "CMS"),
        worn("Sleeve", "n/a", "INCH"), worn("2.CHEST", F.concat(lit("9"), n), "inches"))
    shoes = structs(names, (None, None, "CMS", " 7 ", "8", "", n), (None, None, "Inches", "8", None, "42", "none"), (None, None, None, "", "9", None, "4"))
    group = lambda size, entries: F.struct(lit(size).cast("string").alias("dimensionSize"), entries.alias("dimensionList"))
    both = F.array(group("M", clothes), group("L", structs(names, worn("Sleeve", "x", "INCH"))))
    return [F.when(c("p_size") % 11 == 0, "error").otherwise("Success").alias("status"), F.when(c("p_partkey") % 2 == 1, both).otherwise(F.array(group(None, shoes))).alias("sizeGuideList")]


def _guide_b() -> list[Column]:
    names = ("name", "value", "minValue", "maxValue", "unit", "measurementType", "type")
    n = lambda k=0: (c("p_size") + k).cast("string")
    measures = structs(names, (" Chest ", "old", "1", "1", "In", "GARMENT", None), ("Chest", n(), n(-1), n(3), "Inches", "Body", None),
        ("Waist", None, n(5), n(7), "cm", None, "BODY"), ("Hip", "x", None, None, "cm", None, None))
    size = lambda label, ok, m, scales: F.struct(lit(label).alias("label"), ok.alias("available"), m.alias("measurements"), scales.alias("allSizesList"))
    scales = structs(("scaleCode", "sizeValue"), ("uk_size", "7"), ("us_size", n()), ("brand_size", "40"))
    return [F.array(size("M", c("p_size") % 2 == 0, measures, F.when(c("p_size") % 3 == 0, scales)), size("L", lit(None).cast("boolean"), F.slice(measures, 4, 1), scales)).alias("sizes")]


def _guide_c() -> list[Column]:
    names = ("attributeName", "attributeValue", "convertedAttributeValue")
    n = c("p_size").cast("string")
    attributes = structs(names, ("Brand Size", "B1", None), ("Universal Size Format", "x", None), ("Chest_attribute", n, (c("p_size") * 2.5).cast("string")),
        ("Length_Attribute", "none", F.concat(n, lit("-99"))), ("Neck_attribute", "", None))
    chart = F.struct(F.when(c("p_size") % 2 == 0, "Body Measurement").otherwise("Garment Measurement").alias("measurementType"),
        F.array(F.struct(lit("S").alias("sizeName"), attributes.alias("sizeChartAttributes"))).alias("brickBrandSizes"))
    inner = F.to_json(F.struct(F.array(chart).alias("sizechart")))
    return [F.struct(F.when(c("p_size") % 7 == 0, "no chart").otherwise(inner).alias("sizeGuideDesktop")).alias("fnlColorVariantData")]


def size_guides(spark, sf_dir) -> DataFrame:
    rows = parts(spark, sf_dir)
    page = lambda fields: rows.select(c("k").alias("product_id"), body(*fields()).alias("body"))
    return charts.guides_a(page(_guide_a)).unionByName(charts.guides_b(page(_guide_b))).unionByName(charts.guides_c(page(_guide_c)))


_GUIDES = """WITH p AS (SELECT CAST(p_partkey AS VARCHAR) AS product_id, p_partkey AS i, p_size::DOUBLE AS n, p_size AS z FROM part),
guides(product_id, platform, pos, size, "brandSize", available, uk, us, euro, raw_axis, ord, basis, inch, inch_lo, inch_hi, cm, cm_lo, cm_hi) AS (
SELECT product_id, 'a', 0, 'M', NULL, NULL::BOOLEAN, NULL, NULL, NULL, 'Chest', 2, NULL, ('9' || z)::DOUBLE, ('9' || z)::DOUBLE, ('9' || z)::DOUBLE, 2 * n, 2 * n, 2 * n FROM p WHERE i % 2 = 1 AND z % 11 > 0
UNION ALL SELECT product_id, 'a', 0, 'M', NULL, NULL, NULL, NULL, NULL, 'Across Shoulder', 1, NULL, NULL, NULL, NULL, n, n, n FROM p WHERE i % 2 = 1 AND z % 11 > 0
UNION ALL SELECT product_id, 'a', 1, 'L', NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM p WHERE i % 2 = 1 AND z % 11 > 0
UNION ALL SELECT product_id, 'a', 0, '7', '7', NULL, '7', '8', NULL, 'Foot Length', 1, 'body', NULL, NULL, NULL, n, n, n FROM p WHERE i % 2 = 0 AND z % 11 > 0
UNION ALL SELECT product_id, 'a', 1, '8', '8', NULL, '8', NULL, '42', NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM p WHERE i % 2 = 0 AND z % 11 > 0
UNION ALL SELECT product_id, 'b', 0, 'M', CASE WHEN z % 3 = 0 THEN '40' ELSE 'M' END, z % 2 = 0, CASE WHEN z % 3 = 0 THEN '7' END, CASE WHEN z % 3 = 0 THEN z::VARCHAR END, NULL, 'Chest', 0, 'body', n, n - 1, n + 3, NULL, NULL, NULL FROM p
UNION ALL SELECT product_id, 'b', 0, 'M', CASE WHEN z % 3 = 0 THEN '40' ELSE 'M' END, z % 2 = 0, CASE WHEN z % 3 = 0 THEN '7' END, CASE WHEN z % 3 = 0 THEN z::VARCHAR END, NULL, 'Waist', 2, 'body', NULL, NULL, NULL, n + 5, n + 5, n + 7 FROM p
UNION ALL SELECT product_id, 'c', 0, 'S', 'B1', NULL, NULL, NULL, NULL, 'Chest', 2, CASE WHEN z % 2 = 0 THEN 'body' ELSE 'garment' END, n, n, n, 2.5 * n, 2.5 * n, 2.5 * n FROM p WHERE z % 7 > 0
UNION ALL SELECT product_id, 'c', 0, 'S', 'B1', NULL, NULL, NULL, NULL, 'Length', 3, CASE WHEN z % 2 = 0 THEN 'body' ELSE 'garment' END, NULL, NULL, NULL, (n + -99) / 2, least(n, -99), n FROM p WHERE z % 7 > 0)
"""


@query(_GUIDES + "SELECT * FROM guides")
def size_guide_rows(spark, sf_dir):
    """Charts of three payloads as rows for each size and measure, with both units and the scales of shoes."""
    return size_guides(spark, sf_dir).select("*", "scales.*").drop("scales")


@query(_GUIDES + """SELECT platform, product_id, concat_ws(',', CASE WHEN count(cm) > 0 THEN 'cm' END, CASE WHEN count(inch) > 0 THEN 'inch' END) AS units FROM guides GROUP BY 1, 2""")
def size_guide_units(spark, sf_dir):
    return charts.units(size_guides(spark, sf_dir)).select("platform", "product_id", F.array_join("units", ",").alias("units"))


# ---- stored comparisons


@query("""WITH s AS (SELECT *, lpad(p_partkey::VARCHAR, 12, '0') AS key FROM part ORDER BY key LIMIT 1500)
SELECT key, 'p' || p_partkey AS id, p_brand AS brand, p_retailprice AS price, CASE WHEN p_size % 2 = 0 THEN 'matched' ELSE 'no_match' END AS status FROM s WHERE p_partkey % 7 <> 3 AND p_partkey % 11 <> 5 AND p_partkey % 13 <> 4""")
def hydrated_comparisons(spark, sf_dir):
    """The first 1500 stored comparisons by key; some are cut off, some name no anchor, some are null."""
    return landed.hydrated(stored_texts(spark, sf_dir), 1500).select("key", "anchor.id", "anchor.brand", "anchor.price", F.get("competitors", lit(0))["status"].alias("status"))


@query("""WITH s AS (SELECT *, lpad(p_partkey::VARCHAR, 12, '0') AS key FROM part ORDER BY key LIMIT 1500)
SELECT count(*) AS keys, count(*) FILTER (p_partkey % 13 = 4) AS missing, count(*) FILTER (p_partkey % 13 <> 4 AND p_partkey % 7 = 3) AS corrupt, count(*) FILTER (p_partkey % 13 <> 4 AND p_partkey % 7 <> 3 AND p_partkey % 11 = 5) AS nameless FROM s""")
def hydrated_skips(spark, sf_dir):
    return landed.hydration(stored_texts(spark, sf_dir), 1500)


def stored_texts(spark, sf_dir) -> DataFrame:
    anchor = F.struct(if_("p_partkey % 11 <> 5", F.concat(lit("p"), "k")).alias("id"), c("p_brand").alias("brand"), c("p_retailprice").alias("price"))
    text = body(anchor.alias("anchor"), F.array(F.struct(F.when(c("p_size") % 2 == 0, "matched").otherwise("no_match").alias("status"))).alias("competitors"))
    raw = F.when(c("p_partkey") % 13 == 4, lit(None)).when(c("p_partkey") % 7 == 3, F.expr("substring(text, 1, length(text) - 5)")).otherwise(c("text"))
    return parts(spark, sf_dir).withColumn("text", text).select(F.lpad("k", 12, "0").alias("key"), raw.alias("raw"))


# ---- import sheets, written as workbooks and read back


def sheet_cells(spark, sf_dir) -> DataFrame:
    """An import sheet of all parts in four sheets: a number, the product's link behind a cut text, a rival's link for some, notes; each 97th
    row repeats the product of the row before it in its sheet."""
    row = (c("p_partkey") / 4).cast("int") + 2
    pid = F.concat(lit("MP"), F.lpad(F.when(c("p_partkey") % 97 == 96, c("p_partkey") - 4).otherwise(c("p_partkey")).cast("string"), 9, "0"))
    link = F.concat(lit("https://shop.example/x-y/p-"), F.lower(pid))
    cell = lambda col, text, to=None: F.struct(lit(col).alias("col"), text.cast("string").alias("text"), (lit(None) if to is None else to).cast("string").alias("link"))
    product = F.when(c("p_size") % 3 == 0, cell(2, pid)).when(c("p_size") % 3 == 1, cell(2, F.concat(F.substring(link, 1, 20), lit("…")), link)).otherwise(cell(2, link))
    cells = F.array(cell(1, c("p_partkey")), product, cell(3, if_("p_partkey % 11 = 0", F.concat(lit("https://www.myntra.com/a/b/"), "k", lit("/buy")))),
        cell(28, F.concat(lit("see <p-1> & "), c("p_name"))), cell(29, if_("p_size % 2 = 0", "www.ajio.com")))
    rows = parts(spark, sf_dir).select(F.concat(lit("Sheet "), (c("p_partkey") % 4).cast("string")).alias("sheet"), row.alias("row"), F.explode(cells).alias("c"))
    return rows.select("sheet", "row", "c.*").where("text is not null or link is not null")


@query("""WITH p AS (SELECT 'Sheet ' || p_partkey % 4 AS sheet, p_partkey // 4 + 2 AS row, 'MP' || lpad((CASE WHEN p_partkey % 97 = 96 THEN p_partkey - 4 ELSE p_partkey END)::VARCHAR, 9, '0') AS id,
  CASE WHEN p_partkey % 11 = 0 THEN 'https://www.myntra.com/a/b/' || p_partkey || '/buy' END AS myntra FROM part)
SELECT id, arg_min(sheet, row) AS sheet, CAST(min(row) AS INTEGER) AS row, count(*) AS n_rows, arg_min(myntra, row) FILTER (myntra IS NOT NULL) AS myntra FROM p GROUP BY id""")
def import_sheets(spark, sf_dir):
    """The sheet as workbooks, read back by the workbook source and folded to distinct products with their hints."""
    path = shared.fresh(spark, "sheets")
    sheets.write(sheet_cells(spark, sf_dir), path)
    found = imports.items(imports.rows(sheets.cells(spark, path)))
    return found.select("id", "sheet", "row", F.size("source_rows").cast("long").alias("n_rows"), "myntra")


@query("""WITH p AS (SELECT 'Sheet ' || p_partkey % 4 AS sheet, CAST(p_partkey // 4 + 2 AS INTEGER) AS row, p_partkey AS i, p_size AS z, p_name,
  'https://shop.example/x-y/p-mp' || lpad((CASE WHEN p_partkey % 97 = 96 THEN p_partkey - 4 ELSE p_partkey END)::VARCHAR, 9, '0') AS link FROM part)
SELECT sheet, row, 1 AS col, 0 AS ord, i::VARCHAR AS text FROM p UNION ALL SELECT sheet, row, 2, 0, CASE WHEN z % 3 = 0 THEN upper(substr(link, 28)) ELSE link END FROM p
UNION ALL SELECT sheet, row, 2, 1, substr(link, 1, 20) || '…' FROM p WHERE z % 3 = 1 UNION ALL SELECT sheet, row, 3, 0, 'https://www.myntra.com/a/b/' || i || '/buy' FROM p WHERE i % 11 = 0
UNION ALL SELECT sheet, row, 28, 0, 'see <p-1> & ' || p_name FROM p UNION ALL SELECT sheet, row, 29, 0, 'www.ajio.com' FROM p WHERE z % 2 = 0""")
def sheet_texts(spark, sf_dir):
    path = shared.fresh(spark, "sheets")
    sheets.write(sheet_cells(spark, sf_dir), path)
    return sheets.cells(spark, path).drop("file")


# ---- signatures of pictures that many products share


@query("""WITH p AS (SELECT p_partkey, p_partkey % 50 AS k FROM part), s AS (SELECT *, k % 3 = 0 AS small, k % 5 > 0 AS large FROM p)
SELECT p_partkey, CASE WHEN small THEN 's' WHEN large THEN 'l' END AS rendition, CASE WHEN small OR large THEN k || ',' || CASE WHEN small THEN 10 ELSE 60 END || ',20' END AS rgb FROM s""")
def image_signatures(spark, sf_dir):
    """Fifty pictures of all parts, each in a small and a large rendition, some of which have not landed."""
    k = c("p_partkey") % 50
    at = lambda size: F.concat(lit(f"//img.example/{size}/"), k.cast("string"), lit(".jpg"))
    large, small = "437Wx649H", "158Wx198H"
    region = F.element_at(F.array(lit("top"), lit("bottom"), lit("object")), (c("p_size") % 3 + 1).cast("int"))
    requests = table(spark, sf_dir, "part").select("p_partkey", region.alias("region"), at(large).alias("url"))
    pictures = table(spark, sf_dir, "part").select(k.alias("k"),
        F.explode(F.array(F.struct(F.concat(lit("https:"), at(small)).alias("url"), lit(10).alias("g"), (k % 3 == 0).alias("ok")),
        F.struct(F.concat(lit("https:"), at(large)).alias("url"), lit(60).alias("g"), (k % 5 > 0).alias("ok")))).alias("i")).where("i.ok").distinct()
    xy = pictures.select("k", "i.*", F.explode(F.sequence(lit(0), lit(399))).alias("n")).withColumns({"x": (c("n") % 20).cast("int"), "y": F.floor(c("n") / 20).cast("int")})
    inner = c("x").between(2, 17) & c("y").between(2, 17)
    colour = lambda v: F.when(inner, v).otherwise(250).cast("int")
    found = images.signatures(requests, xy.select("url", "x", "y", colour(c("k")).alias("r"), colour(c("g")).alias("g"), colour(lit(20)).alias("b")))
    return found.select("p_partkey", F.when(c("image").contains(small), "s").when(c("image").isNotNull(), "l").alias("rendition"), F.array_join("rgb", ",").alias("rgb"))
