"""Landed payloads of three retailers as rows of one shape: listings, anchors from detail pages, and details.

Every mapper takes rows with a JSON text (``body``) and reads it with a fixed schema, so that only named fields are parsed; what a payload
lacks is null. Retailer ``a`` is the anchors' own, ``b`` and ``c`` are the rivals.

Defined cases: a null or malformed body gives no listing and an unavailable detail; empty texts are null but for brand and title;
a repeated field's last value counts in folds of maps, the first one in choices of images and policies.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.functions import text as t

SITES = {"a": "https://www.tatacliq.com", "b": "https://www.myntra.com/", "c": "https://www.ajio.com"}

_MONEY = "struct<doubleValue:double,currencyIso:string>"
_GALLERY = "galleryImagesList array<struct<galleryImages:array<struct<key:string,value:string>>>>"
LISTING_A = (
    f"productId string, brandname string, productname string, productColor string, styleCode string, baseProductId string, price struct<sellingPrice:{_MONEY},mrpPrice:{_MONEY}>,"
    " categoryHierarchy array<map<string,string>>, discountPercent string, averageRating double, ratingCount bigint, imageURL string, webURL string"
)
LISTING_B = (
    "productId string, brand string, productName string, primaryColour string, gender string, articleType string, mrp double, price double, discount double, rating double, ratingCount bigint, searchImage string,"
    " images array<struct<src:string>>, landingPageUrl string, sizes string, inventoryInfo array<struct<label:string,available:boolean,inventory:bigint>>, colourVariants array<struct<color:string,colour:string,styleId:string>>"
)
LISTING_C = (
    "code string, id string, brandName string, name string, color string, url string, segmentNameText string, segmentName string, verticalNameText string, verticalName string, brickNameText string, brickName string,"
    " wasPriceData struct<value:double>, mrp double, price struct<value:double>, offerPrice struct<value:double>, discountPercent string, averageRating double, totalRatingsCount bigint, imageUrl string,"
    " images array<struct<url:string>>, sizeOptions array<struct<sizeValue:string,value:string>>, fnlColorVariantData struct<brandName:string,colorGroup:string>"
)
DETAIL_A = (
    f"productName string, productTitle string, brandName string, productColor string, styleCode string, winningSellerPrice {_MONEY}, mrpPrice {_MONEY}, discount string, averageRating double, ratingCount bigint, {_GALLERY},"
    " seo struct<canonicalUrl:string>, categoryHierarchy array<struct<category_id:string,category_name:string>>, gender string, productDescription string, styleNote string, details array<struct<key:string,value:string>>,"
    " mfgDetails struct<countryOfOrigin:string,manufacturer:array<struct<value:string>>>, knowMoreV2 array<struct<knowMoreItemV2:string>>, returnPolicy string, deliveryModesATP array<struct<key:string,value:string>>,"
    " potentialPromotions array<struct<description:string,title:string>>, imageGalleryAttributes array<struct<key:string>>, videoUrl string, allOOStock boolean, winningSellerAvailableStock bigint, winningSellerName string,"
    " winningSellerRating double, numberOfReviews bigint"
)
DETAIL_B = (
    "articleAttributes map<string,string>, descriptors array<struct<title:string,description:string>>, productDetails array<struct<title:string,description:string>>, media struct<albums:array<struct<images:array<struct<secureSrc:string,src:string>>>>,videos:array<struct<url:string>>>,"
    " analytics struct<gender:string,masterCategory:string,subCategory:string,articleType:string>, countryOfOrigin string, manufacturer string, serviceability struct<returnPeriod:int,descriptors:array<string>>, offers array<struct<title:string>>,"
    " flags struct<outOfStock:boolean>, sellers array<struct<name:string>>, ratings struct<averageRating:double,totalCount:bigint,reviewInfo:struct<reviewsCount:bigint>>"
)
_FEATURES = "array<struct<name:string,code:string,value:string,featureValues:array<struct<value:string>>>>"
DETAIL_C = (
    f"description string, featureData {_FEATURES}, classifications array<struct<features:{_FEATURES}>>, images array<struct<format:string,url:string>>, countryOfOrigin string, stock struct<stockLevelStatus:string>,"
    " potentialPromotions array<struct<description:string,title:string>>, returnPolicy string, sellerName string"
)


def some(c: Column) -> Column:
    """Null in place of an empty text."""
    return F.when(c != "", c)


def first(items: Column, ok) -> Column:
    """The first item that passes a test; null without one."""
    return F.get(F.filter(items, ok), F.lit(0))


def absolute(url: Column) -> Column:
    """With a protocol, where the link has none."""
    return F.when(url.startswith("//"), F.concat(F.lit("https:"), url)).otherwise(some(url))


def last_wins(entries: Column) -> Column:
    """(key, value) entries as a map; the last value of a key counts. Null keys are dropped."""
    kept = F.filter(entries, lambda e: e["key"].isNotNull())
    behind = lambda i: F.slice(kept, i + 2, F.size(kept))
    return F.map_from_entries(F.filter(kept, lambda e, i: ~F.exists(behind(i), lambda later: later["key"] == e["key"])))


def folded(maps: Column) -> Column:
    """A list of maps as one; later maps win."""
    entries = F.flatten(F.transform(F.filter(maps, lambda m: m.isNotNull()), lambda m: F.map_entries(m)))
    return last_wins(entries)


def percent_off(mrp: Column, price: Column) -> Column:
    return F.when((mrp > 0) & (price > 0), F.round((mrp - price) / mrp * 100))


def number_in(s: Column) -> Column:
    """The number in a text such as '40% off'; null without one and for 0."""
    n = F.regexp_replace(s, "[^0-9.]", "").try_cast("double")
    return F.when(n != 0, n)


def colour_of_variant(group: Column, url: Column) -> Column:
    """The letters behind the first underscore of a variant's key, or of the link's last part where there is no key."""
    tail = lambda s: F.array_join(F.slice(F.split(s, "_"), 2, 100), " ")
    raw = F.coalesce(some(group), F.get(F.split(url, "/p/"), F.lit(1)))
    return some(F.trim(F.regexp_replace(F.regexp_replace(tail(raw), "[^a-zA-Z ]+", " "), r"\s+", " ")))


#: Parts of a segment's name and the gender that they tell, in order; 'women' holds 'men'.
SEGMENTS = (("girl", "girls"), ("boy", "boys"), ("women", "women"), ("woman", "women"), ("ladies", "women"), ("men", "men"), ("man", "men"), ("unisex", "unisex"))


def gender_of_segment(segment: Column) -> Column:
    s = F.lower(segment)
    return F.coalesce(*[F.when(s.contains(part), F.lit(gender)) for part, gender in SEGMENTS])


def gallery(albums: Column, ok=lambda g: g["key"] == "product") -> Column:
    """Distinct links of all albums' images of a kind, in order; of all images where there are none of that kind."""
    links = F.filter(F.flatten(F.transform(albums, lambda a: F.coalesce(a["galleryImages"], F.array().cast("array<struct<key:string,value:string>>")))), lambda g: some(g["value"]).isNotNull())
    of = lambda images: F.array_distinct(F.transform(images, lambda g: absolute(g["value"])))
    kind = F.filter(links, ok)
    return F.coalesce(F.when(F.size(kind) > 0, of(kind)).otherwise(of(links)), F.array().cast("array<string>"))


def parsed(rows: DataFrame, schema: str, body: str = "body") -> DataFrame:
    """Rows with ``j``, their body read by a schema; null if it is malformed."""
    valid = F.try_parse_json(F.col(body)).isNotNull()
    return rows.withColumn("j", F.when(valid, F.from_json(F.col(body), schema)))


def _shape(source: str, **columns: Column) -> list[Column]:
    """The columns of a listing in their order, those that a retailer doesn't have as nulls or empty lists."""
    kinds = {
        "id": "string", "source": "string", "brand": "string", "title": "string", "color": "string", "styleCode": "string", "baseProductId": "string",
        "mrp": "double", "price": "double", "currency": "string",
        "discountPercent": "double", "rating": "double", "ratingCount": "bigint", "image": "string", "url": "string",
        "category": "struct<l1:string,l2:string,l3:string>", "gender": "string", "articleType": "string",
        "sizes": "array<string>", "inventory": "array<struct<size:string,available:boolean,count:bigint>>", "colourVariants": "array<struct<color:string,id:string>>",
    }
    columns["source"] = F.lit(source)
    empty = lambda kind: F.array() if kind.startswith("array") else F.lit(None)
    return [F.coalesce(columns[n].cast(k), empty(k).cast(k)).alias(n) if k.startswith("array") and n in columns else columns.get(n, empty(k)).cast(k).alias(n) for n, k in kinds.items()]


def _category(*levels: Column) -> Column:
    return F.struct(*[some(c).alias(f"l{i}") for i, c in enumerate(levels, 1)])


def listings_a(rows: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Listings of the own retailer: nested prices, the category levels folded from a list of maps."""
    j = F.col("j")
    tree = folded(j["categoryHierarchy"])
    price = F.col("j.price.sellingPrice.doubleValue")
    shape = _shape(
        "a", id=some(j["productId"]), brand=F.trim(F.coalesce(j["brandname"], F.lit(""))), title=F.trim(F.coalesce(j["productname"], F.lit(""))),
        color=some(j["productColor"]), styleCode=some(j["styleCode"]),
        baseProductId=some(j["baseProductId"]), mrp=F.coalesce(F.col("j.price.mrpPrice.doubleValue"), price), price=price,
        currency=F.coalesce(some(F.col("j.price.sellingPrice.currencyIso")), F.lit("INR")),
        discountPercent=some(j["discountPercent"]).try_cast("double"), rating=j["averageRating"], ratingCount=j["ratingCount"], image=absolute(j["imageURL"]),
        url=F.concat(F.lit(SITES["a"]), some(j["webURL"])), category=_category(*[F.try_element_at(tree, F.lit(f"L{i}")) for i in (1, 2, 3)]),
    )
    return parsed(rows, LISTING_A).where("j.productId <> ''").select(*keep, *shape)


def listings_b(rows: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Listings of the first rival: sizes as one text, an inventory, colour variants; the discount is from the prices, else the given one up to 100."""
    j = F.col("j")
    given = F.when(j["discount"] <= 100, j["discount"])
    shape = _shape(
        "b", id=some(j["productId"]), brand=F.trim(F.coalesce(j["brand"], F.lit(""))), title=F.trim(F.coalesce(j["productName"], F.lit(""))),
        color=some(j["primaryColour"]), gender=F.lower(some(j["gender"])), articleType=some(j["articleType"]),
        mrp=j["mrp"], price=j["price"], currency=F.lit("INR"), discountPercent=F.coalesce(percent_off(j["mrp"], j["price"]), given),
        rating=F.when(j["rating"] > 0, F.round(j["rating"], 2)), ratingCount=j["ratingCount"],
        image=F.coalesce(some(j["searchImage"]), some(F.get(j["images"], F.lit(0))["src"])), url=F.concat(F.lit(SITES["b"]), some(j["landingPageUrl"])),
        sizes=F.filter(F.transform(F.split(F.coalesce(j["sizes"], F.lit("")), ","), lambda s: F.trim(s)), lambda s: s != ""),
        inventory=F.transform(j["inventoryInfo"], lambda i: F.struct(i["label"].alias("size"), F.coalesce(i["available"], F.lit(False)).alias("available"), i["inventory"].alias("count"))),
        colourVariants=F.filter(F.transform(j["colourVariants"],
        lambda v: F.struct(F.coalesce(some(v["color"]), some(v["colour"])).alias("color"), v["styleId"].alias("id"))), lambda v: v["color"].isNotNull()),
    )
    return parsed(rows, LISTING_B).where("j.productId <> ''").select(*keep, *shape)


def listings_c(rows: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Listings of the second rival: the colour from a variant's key or link, the gender from the segment's name."""
    j = F.col("j")
    either = lambda *names: F.coalesce(*[some(j[n]) for n in names])
    segment, brick = either("segmentNameText", "segmentName"), either("brickNameText", "brickName")
    shape = _shape(
        "c", id=either("code", "id"), brand=F.trim(F.coalesce(some(j["brandName"]), F.col("j.fnlColorVariantData.brandName"), F.lit(""))), title=F.trim(F.coalesce(j["name"], F.lit(""))),
        color=F.coalesce(colour_of_variant(F.col("j.fnlColorVariantData.colorGroup"), j["url"]), some(j["color"])), gender=gender_of_segment(segment), articleType=brick,
        category=_category(segment, either("verticalNameText", "verticalName"), brick), mrp=F.coalesce(F.col("j.wasPriceData.value"), j["mrp"]),
        price=F.coalesce(F.col("j.price.value"), F.col("j.offerPrice.value")), currency=F.lit("INR"),
        discountPercent=F.regexp_replace(some(j["discountPercent"]), "[^0-9.]", "").try_cast("double"),
        rating=F.when(j["averageRating"] > 0, F.round(j["averageRating"], 2)), ratingCount=j["totalRatingsCount"],
        image=F.coalesce(some(j["imageUrl"]), some(F.get(j["images"], F.lit(0))["url"])), url=F.concat(F.lit(SITES["c"]), some(j["url"])),
        sizes=F.filter(F.transform(j["sizeOptions"], lambda s: F.coalesce(some(s["sizeValue"]), some(s["value"]))), lambda s: s.isNotNull()),
    )
    return parsed(rows, LISTING_C).where("coalesce(nullif(j.code, ''), nullif(j.id, '')) is not null").select(*keep, *shape)


def search_pages(pages: DataFrame, results: str = "searchresult") -> DataFrame:
    """Landed search pages (query, page, status, body) as ``query, page, blocked, reason, total, total_pages, position, item``: a row for each
    listing (JSON of it), and one without a listing for a page that is empty, was refused or failed."""
    j = F.col("j")
    read = parsed(pages, f"{results} array<variant>, pagination struct<totalResults:bigint,totalPages:bigint>")
    blocked = F.col("status") == 403
    reason = F.when(blocked, "blocked").when(F.coalesce(F.col("status"), F.lit(0)) != 200,
        F.concat(F.lit("HTTP "), F.coalesce(F.col("status").cast("string"), F.lit("?")))).when(j.isNull(), "malformed")
    items = F.when(reason.isNull(), j[results])
    total = F.when(reason.isNull(), F.coalesce(F.col("j.pagination.totalResults"), F.size(F.coalesce(items, F.array().cast("array<variant>"))).cast("bigint"))).otherwise(F.lit(0))
    head = read.select("query", "page", blocked.alias("blocked"), reason.alias("reason"), total.alias("total"),
        F.when(reason.isNull(), F.col("j.pagination.totalPages")).alias("total_pages"), items.alias("items"))
    each = head.select(*[c for c in head.columns if c != "items"], F.posexplode_outer("items").alias("position", "item"))
    return each.withColumn("item", F.to_json("item"))


def anchors_a(rows: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Anchors from detail pages (id, body): the first product image, the discount as given or from the prices; pages without a title have none."""
    j = F.col("j")
    title = F.trim(F.coalesce(some(j["productName"]), j["productTitle"], F.lit("")))
    price = F.col("j.winningSellerPrice.doubleValue")
    mrp = F.coalesce(F.col("j.mrpPrice.doubleValue"), price)
    discount = F.when(j["discount"].isNotNull(), number_in(j["discount"])).when(mrp > price, percent_off(mrp, price))
    levels = F.filter(F.transform(j["categoryHierarchy"], lambda c: c["category_id"]), lambda c: some(c).isNotNull())
    shape = _shape(
        "a", id=F.col("id"), brand=F.trim(F.coalesce(j["brandName"], F.lit(""))), title=title, color=some(j["productColor"]), styleCode=some(j["styleCode"]), mrp=mrp, price=price,
        currency=F.coalesce(some(F.col("j.winningSellerPrice.currencyIso")), F.lit("INR")), discountPercent=discount, rating=j["averageRating"],
        ratingCount=j["ratingCount"], image=F.get(gallery(j["galleryImagesList"]), F.lit(0)),
        url=F.concat(F.lit(SITES["a"]), F.coalesce(some(F.col("j.seo.canonicalUrl")), F.concat(F.lit("/p-"), F.lower("id")))),
        category=_category(*[F.get(levels, F.lit(i)) for i in range(3)]), gender=F.lower(some(j["gender"])),
    )
    return parsed(rows, DETAIL_A).where((F.col("id") != "") & (title != "")).select(*keep, *shape)


#: Columns of a detail in their order.
DETAILS = {
    "platform": "string", "id": "string", "available": "boolean", "reason": "string", "description": "string", "styleNote": "string",
    "attributes": "map<string,string>", "bulletPoints": "int", "gender": "string",
    "categoryPath": "array<string>", "countryOfOrigin": "string", "manufacturer": "string", "returnPolicy": "string",
    "deliveryModes": "array<struct<mode:string,promise:string>>", "offers": "array<string>",
    "images": "array<string>", "imageCount": "int", "videoAvailable": "boolean", "inStock": "boolean", "seller": "string", "sellerRating": "double",
    "rating": "double", "ratingCount": "bigint", "reviewCount": "bigint",
}


def _detail(rows: DataFrame, platform: str, schema: str, refused: str, **columns: Column) -> DataFrame:
    """Details of landed pages (id, status, body); what could not be read is unavailable, with a reason and nothing else."""
    status = F.coalesce(F.col("status"), F.lit(0))
    reason = (
        F.when(F.coalesce(F.col("id"), F.lit("")) == "", "no_product_id").when(status == 403, refused)
        .when(status != 200, F.concat(F.lit("HTTP "), status.cast("string"))).when(F.col("j").isNull(), "no_payload")
    )
    read = parsed(rows, schema).withColumn("reason", reason)
    ok = F.col("reason").isNull()
    columns |= {"available": F.lit(True)}
    fixed = {"platform": F.lit(platform), "id": F.col("id"), "reason": F.col("reason"), "available": ok}
    return read.select(*[fixed.get(n, F.when(ok, columns.get(n, F.lit(None).cast(k)).cast(k))).alias(n) for n, k in DETAILS.items()])


def _texts(items: Column, value) -> Column:
    """The values of items that aren't empty; an empty list without items."""
    return F.coalesce(F.filter(F.transform(items, value), lambda x: some(x).isNotNull()), F.array().cast("array<string>"))


def details_a(rows: DataFrame) -> DataFrame:
    j = F.col("j")
    images = gallery(j["galleryImagesList"])
    returns = first(F.transform(j["knowMoreV2"], lambda k: k["knowMoreItemV2"]), lambda x: x.rlike("(?i)return"))
    video = F.exists(j["imageGalleryAttributes"], lambda a: F.coalesce(a["key"].rlike("(?i)video"), F.lit(False)))
    return _detail(
        rows, "a", DETAIL_A, "blocked", description=F.coalesce(some(j["productDescription"]), some(j["styleNote"])), styleNote=some(j["styleNote"]),
        attributes=last_wins(F.filter(j["details"], lambda d: d["key"] != "")),
        bulletPoints=F.size(F.coalesce(j["details"], F.array().cast("array<struct<key:string,value:string>>"))), gender=some(j["gender"]),
        categoryPath=_texts(j["categoryHierarchy"], lambda c: c["category_name"]), countryOfOrigin=some(F.col("j.mfgDetails.countryOfOrigin")),
        manufacturer=some(F.get(F.col("j.mfgDetails.manufacturer"), F.lit(0))["value"]), returnPolicy=F.coalesce(returns, some(j["returnPolicy"])),
        deliveryModes=F.transform(j["deliveryModesATP"], lambda m: F.struct(m["key"].alias("mode"), m["value"].alias("promise"))),
        offers=_texts(j["potentialPromotions"], lambda o: F.coalesce(some(o["description"]), o["title"])), images=images, imageCount=F.size(images),
        videoAvailable=F.coalesce(video, F.lit(False)) | some(j["videoUrl"]).isNotNull(),
        inStock=F.coalesce(j["allOOStock"] == F.lit(False), F.lit(False)) | (F.coalesce(j["winningSellerAvailableStock"], F.lit(0)) > 0),
        seller=some(j["winningSellerName"]), sellerRating=j["winningSellerRating"],
        rating=j["averageRating"], ratingCount=j["ratingCount"], reviewCount=j["numberOfReviews"],
    )


def details_b(rows: DataFrame) -> DataFrame:
    j = F.col("j")
    attributes = F.map_filter(F.coalesce(j["articleAttributes"], F.create_map().cast("map<string,string>")), lambda k, v: v.isNotNull() & (F.trim(v) != "") & (F.upper(F.trim(v)) != "NA"))
    said = last_wins(F.transform(F.filter(j["descriptors"], lambda d: d["title"] != ""), lambda d: F.struct(d["title"].alias("key"), t.plain(d["description"]).alias("value"))))
    of = lambda key: some(F.try_element_at(said, F.lit(key)))
    about = t.plain(first(j["productDetails"], lambda p: p["title"].rlike("(?i)product details"))["description"])
    links = _texts(F.flatten(F.transform(F.col("j.media.albums"),
        lambda a: F.coalesce(a["images"], F.array().cast("array<struct<secureSrc:string,src:string>>")))), lambda im: F.coalesce(some(im["secureSrc"]), im["src"]))
    images = F.array_distinct(links)
    period, service = F.col("j.serviceability.returnPeriod"), F.col("j.serviceability.descriptors")
    returns = F.when(period > 0, F.concat(period.cast("string"), F.lit(" Days Return"))).otherwise(first(service, lambda x: x.rlike("(?i)return")))
    path = F.filter(F.array(F.col("j.analytics.masterCategory"), F.col("j.analytics.subCategory"), F.col("j.analytics.articleType")), lambda c: some(c).isNotNull())
    reviews = F.col("j.ratings.reviewInfo.reviewsCount")
    return _detail(
        rows, "b", DETAIL_B, "blocked", description=F.coalesce(of("description"), some(about)), styleNote=of("style_note"), attributes=attributes,
        bulletPoints=F.size(attributes), gender=F.lower(some(F.col("j.analytics.gender"))), categoryPath=path,
        countryOfOrigin=some(j["countryOfOrigin"]), manufacturer=some(j["manufacturer"]), returnPolicy=returns,
        deliveryModes=F.transform(service, lambda x: F.struct(F.lit("standard").alias("mode"), x.alias("promise"))),
        offers=_texts(j["offers"], lambda o: o["title"]), images=images, imageCount=F.size(images),
        videoAvailable=F.coalesce(F.size(F.col("j.media.videos")) > 0, F.lit(False)), inStock=F.coalesce(F.col("j.flags.outOfStock") == F.lit(False), F.lit(False)),
        seller=some(F.get(j["sellers"], F.lit(0))["name"]), rating=F.when(F.col("j.ratings.averageRating") > 0, F.round(F.col("j.ratings.averageRating"), 2)),
        ratingCount=F.col("j.ratings.totalCount"), reviewCount=F.when(reviews > 0, reviews),
    )


#: Features that hold a description where the page has none, in order.
ABOUT = ("Additional Information 1", "Additional Information")


def features(flat: Column, groups: Column) -> Column:
    """Features, flat or in groups, as a map: several values are joined by commas, later features of a name win, those without name or value are none."""
    none = F.array().cast(_FEATURES)
    every = F.concat(F.coalesce(flat, none), F.coalesce(F.flatten(F.transform(groups, lambda g: F.coalesce(g["features"], none))), none))
    values = lambda f: F.array_join(F.filter(F.transform(f["featureValues"], lambda v: v["value"]), lambda v: some(v).isNotNull()), ", ")
    entry = lambda f: F.struct(F.coalesce(some(f["name"]), some(f["code"])).alias("key"), F.when(f["featureValues"].isNotNull(), values(f)).otherwise(f["value"]).alias("value"))
    return last_wins(F.filter(F.transform(every, entry), lambda e: some(e["value"]).isNotNull()))


def details_c(rows: DataFrame) -> DataFrame:
    j = F.col("j")
    known = features(j["featureData"], j["classifications"])
    of = lambda key: some(F.try_element_at(known, F.lit(key)))
    products = F.filter(j["images"], lambda i: i["format"] == "product")
    shown = F.when(F.size(products) > 0, products).otherwise(j["images"])
    images = _texts(shown, lambda i: i["url"])
    return _detail(
        rows, "c", DETAIL_C, "akamai-ip-block", description=F.coalesce(some(j["description"]), *map(of, ABOUT)), attributes=known,
        countryOfOrigin=F.coalesce(some(j["countryOfOrigin"]), of("Country of Origin")), images=images,
        imageCount=F.coalesce(F.size(shown), F.lit(0)), videoAvailable=F.lit(False),
        inStock=F.coalesce(F.col("j.stock.stockLevelStatus") != "outOfStock", F.lit(True)), offers=_texts(j["potentialPromotions"], lambda o: F.coalesce(some(o["description"]), o["title"])),
        returnPolicy=some(j["returnPolicy"]), seller=some(j["sellerName"]),
    )


DETAIL_MAPPERS = {"a": details_a, "b": details_b, "c": details_c}


def details(**pages: DataFrame) -> DataFrame:
    """Details of several retailers, by name: ``details(a=..., b=...)``. Columns that one retailer lacks are null for it."""
    return reduce(lambda x, y: x.unionByName(y), (DETAIL_MAPPERS[k](rows) for k, rows in pages.items()))
