"""Size charts of landed payloads as long rows (product_id, platform, pos, size, raw_axis, basis, inch…)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.functions import text as t
from quillon.sources.mappers import parsed

LONG = ("product_id", "platform", "pos", "size", "raw_axis", "basis", "inch", "cm", "inch_lo", "inch_hi", "cm_lo", "cm_hi")


def _long(rows: DataFrame, inch: str | None = None, cm: str | None = None) -> DataFrame:
    """Text measurements of either unit as intervals and middles."""
    out = rows
    for unit, name in (("inch", inch), ("cm", cm)):
        m = t.measurement(F.col(name)) if name else F.lit(None).cast("struct<lo:double,hi:double,value:double>")
        out = out.withColumns({unit: m["value"], f"{unit}_lo": m["lo"], f"{unit}_hi": m["hi"]})
    return out.select(*LONG)


def measured(rows: DataFrame, platform: str) -> DataFrame:
    """Rows for each measure and unit (product_id, ord, axis, unit, size, value): units side by side, axes by their least ordinal."""
    g = rows.groupBy("product_id", "size", "axis").agg(F.min("ord").alias("pos"),
        *[F.min_by(F.when(F.col("unit").rlike(p), F.col("value")), F.when(F.col("unit").rlike(p), F.col("ord"))).alias(n) for n, p in (("i", "(?i)^in"), ("c", "(?i)^cm"))])
    return _long(g.withColumns({"platform": F.lit(platform), "raw_axis": F.col("axis"), "basis": F.lit(None).cast("string")}), "i", "c")


def ranged(rows: DataFrame, platform: str) -> DataFrame:
    """Rows with a value or a least and a most (product_id, pos, size, axis, kind, unit, value, lo, hi); kind BODY is of the wearer."""
    number = lambda c: F.col(c).try_cast("double")
    lo, hi = F.least(number("lo"), number("hi")), F.greatest(number("lo"), number("hi"))
    middle = F.coalesce(number("value"), (lo + hi) / 2)
    inches = F.col("unit").rlike("(?i)^in")
    cols = {"platform": F.lit(platform), "raw_axis": F.col("axis"), "basis": F.when(F.upper("kind") == "BODY", "body").otherwise("garment")}
    for unit, on in (("inch", inches), ("cm", ~inches)):
        cols |= {unit: F.when(on, middle), f"{unit}_lo": F.when(on, F.coalesce(lo, middle)), f"{unit}_hi": F.when(on, F.coalesce(hi, middle))}
    return rows.withColumns(cols).select(*LONG)


def encoded(rows: DataFrame, platform: str) -> DataFrame:
    """Charts that are JSON inside JSON (product_id, payload with a text field 'chart' of [{size, attributes: {name_attribute: text}}]): label
    attributes are no axes, and the suffix is dropped."""
    inner = F.from_json(F.get_json_object("payload", "$.chart"), "array<struct<size:string,attributes:map<string,string>>>")
    each = rows.select("product_id", F.posexplode(inner).alias("pos", "row")).select("product_id", "pos", "row.size", F.explode("row.attributes").alias("name", "v"))
    axes = each.where(~F.col("name").rlike("(?i)(^|_)(size|label|brand)(_|$)")).withColumn("axis", F.regexp_replace("name", "(?i)_attribute$", ""))
    return _long(axes.withColumns({"platform": F.lit(platform), "raw_axis": F.col("axis"), "basis": F.lit(None).cast("string")}), "v")


# ---- whole payloads of the three retailers

SCALES = "struct<uk:string,us:string,euro:string>"
#: Columns of a chart's row for each size and measure; a size without measures has one row with a null axis.
CHART = {
    "product_id": "string", "platform": "string", "pos": "int", "size": "string", "brandSize": "string", "available": "boolean", "scales": SCALES,
    "raw_axis": "string", "ord": "int", "basis": "string",
    "inch": "double", "inch_lo": "double", "inch_hi": "double", "cm": "double", "cm_lo": "double", "cm_hi": "double",
}
GUIDE_A = (
    "status string, sizeGuideList array<struct<dimensionSize:string,dimensionList:array<struct<dimension:string,dimensionValue:string,dimensionUnit:string,dimensionSize:string,usSize:string,euroSize:string,footlength:string>>>>"
)
GUIDE_B = (
    "sizes array<struct<label:string,available:boolean,measurements:array<struct<name:string,value:string,minValue:string,maxValue:string,unit:string,measurementType:string,type:string>>,allSizesList:array<struct<scaleCode:string,sizeValue:string>>>>"
)
GUIDE_C = "sizechart array<struct<measurementType:string,brickBrandSizes:array<struct<sizeName:string,sizeChartAttributes:array<struct<attributeName:string,attributeValue:string,convertedAttributeValue:string>>>>>>"
FOOT = "Foot Length"


def _chart(rows: DataFrame, platform: str, **columns) -> DataFrame:
    columns["platform"] = F.lit(platform)
    return rows.select(*[columns.get(n, F.col(n) if n in rows.columns else F.lit(None)).cast(k).alias(n) for n, k in CHART.items()])


def _units(m, inches) -> dict:
    """The measurement ``m`` (lo, hi, value) in the columns of its unit."""
    return {f"{unit}{end}": F.when(on, m[field]) for unit, on in (("inch", inches), ("cm", ~inches)) for end, field in (("", "value"), ("_lo", "lo"), ("_hi", "hi"))}


def _scales(uk, us, euro):
    return F.when(F.coalesce(uk, us, euro).isNotNull(), F.struct(uk.alias("uk"), us.alias("us"), euro.alias("euro")))


def guides_a(rows: DataFrame) -> DataFrame:
    """Size guides of the own retailer (product_id, body). Apparel: an entry for each measure and unit, folded, the last one of a unit
    counts; axes are ordered by the number before their name, 99 without one. Footwear, which has no size on a group: an entry for each size, whose
    labels in three countries are scales of one shoe, with the foot's length."""
    c = F.col
    read = parsed(rows, GUIDE_A).where("lower(coalesce(nullif(j.status, ''), 'success')) = 'success'")
    groups = read.select("product_id", F.posexplode("j.sizeGuideList").alias("pos", "g")).withColumn("size", F.trim(F.coalesce("g.dimensionSize", F.lit(""))))
    each = groups.select("product_id", "pos", "size", F.posexplode_outer("g.dimensionList").alias("n", "d"))
    inches = F.coalesce(c("d.dimensionUnit").rlike("(?i)inch"), F.lit(False))

    name = F.coalesce(c("d.dimension"), F.lit(""))
    axis = F.trim(F.initcap(F.lower(F.regexp_replace(name, r"^\s*\d+\s*[.)]\s*", ""))))
    ordinal = F.coalesce(F.regexp_extract(name, r"^\s*(\d+)", 1).try_cast("int"), F.lit(99))
    worn = each.where("size <> ''").select("product_id", "pos", "size", "n", F.when(name != "", axis).alias("raw_axis"),
        F.when(name != "", ordinal).alias("ord"), t.measurement(c("d.dimensionValue")).alias("m"), inches.alias("inches"))
    last = lambda on, field: F.max_by(c(f"m.{field}"), F.when(on & c("m").isNotNull(), c("n")))
    folds = [last(on, field).alias(f"{unit}{end}") for unit, on in (("inch", c("inches")), ("cm", ~c("inches"))) for end, field in (("", "value"), ("_lo", "lo"), ("_hi", "hi"))]
    folded = worn.groupBy("product_id", "pos", "size", "raw_axis").agg(F.min("ord").alias("ord"), *folds, F.count("m").alias("known"))
    named = folded.withColumn("blank", F.col("known") == 0)
    order = named.where("raw_axis is not null").groupBy("product_id", "raw_axis").agg(F.min("ord").alias("least"))
    apparel = named.where("not blank").drop("ord").join(order, ["product_id", "raw_axis"]).withColumnRenamed("least", "ord")
    bare = named.groupBy("product_id", "pos", "size").agg(F.bool_and("blank").alias("none")).where("none")
    shaped = _chart(apparel, "a").unionByName(_chart(bare, "a"))

    uk = F.trim(F.coalesce(c("d.dimensionSize"), F.lit("")))
    foot = t.measurement(c("d.footlength"))
    shoes = each.where("size = ''").withColumns({"uk": uk, "m": foot}).where("uk <> ''")
    m, some = c("m"), lambda x: F.nullif(F.trim(x), F.lit(""))
    known = lambda x: F.when(m.isNotNull(), F.lit(x))
    columns = {"size": c("uk"), "brandSize": c("uk"), "scales": _scales(c("uk"), some(c("d.usSize")), some(c("d.euroSize"))), "raw_axis": known(FOOT),
        "ord": known(1), "basis": known("body")} | _units(m, inches)
    return shaped.unionByName(_chart(shoes, "a", pos=c("pos") * 1000 + c("n"), **columns))


def guides_b(rows: DataFrame) -> DataFrame:
    """Charts of the first rival (product_id, body): a value with a least and a most, each an interval; the last measure of a name counts.
    Sizes without any measure are left out."""
    c = F.col
    sizes = parsed(rows, GUIDE_B).select("product_id", F.posexplode("j.sizes").alias("pos", "s")).withColumn("size", F.trim(F.coalesce("s.label", F.lit("")))).where("size <> ''")
    scale = lambda p: F.get(F.filter("s.allSizesList", lambda a: a["scaleCode"].rlike(p)), F.lit(0))["sizeValue"]
    sizes = sizes.withColumns({"scales": _scales(scale("(?i)^uk"), scale("(?i)^us"), scale("(?i)^euro")), "brandSize": F.coalesce(scale("(?i)brand"), "size"), "available": c("s.available")})
    each = sizes.select("product_id", "pos", "size", "scales", "brandSize", "available", F.posexplode("s.measurements").alias("n", "d"))
    each = each.withColumns({"raw_axis": F.trim("d.name"), "lo": t.measurement(c("d.minValue")), "hi": t.measurement(c("d.maxValue")), "of": t.measurement(c("d.value"))})
    each = each.withColumn("mid", F.coalesce("of", "lo", "hi")).where("raw_axis <> '' and mid is not null")
    m = F.struct(c("mid.value").alias("value"), F.least(c("lo.lo"), c("mid.lo")).alias("lo"), F.greatest(c("hi.hi"), c("mid.hi")).alias("hi"))
    basis = F.when(F.upper(F.coalesce(F.nullif(c("d.measurementType"), F.lit("")), c("d.type"))) == "BODY", "body").otherwise("garment")
    inches = F.coalesce(c("d.unit").rlike("(?i)^in"), F.lit(False))
    found = each.select("product_id", "pos", "size", "scales", "brandSize", "available", "raw_axis", "n", basis.alias("basis"), *[v.alias(k) for k, v in _units(m, inches).items()])
    values = [k for k in CHART if k in found.columns and k not in ("product_id", "pos", "raw_axis")]
    one = found.groupBy("product_id", "pos", "raw_axis").agg(F.max_by(F.struct(*values), "n").alias("v"), F.min("n").alias("ord")).select("product_id", "pos", "raw_axis", "ord", "v.*")
    return _chart(one, "b")


#: Attributes of a chart that are labels, not measures.
LABELS = r"(?i)^(universal size|brand size)( format)?$"


def guides_c(rows: DataFrame) -> DataFrame:
    """Charts of the second rival (product_id, body): JSON in a text of JSON; labels are no axes, ``_attribute`` is dropped from names, and both units
    come as they are. Sizes without any measure are left out."""
    c = F.col
    inner = parsed(rows.withColumn("body", F.get_json_object("body", "$.fnlColorVariantData.sizeGuideDesktop")), GUIDE_C)
    groups = inner.select("product_id", F.posexplode("j.sizechart").alias("g", "chart"))
    basis = F.when(c("chart.measurementType").rlike("(?i)body"), "body").otherwise("garment")
    sizes = groups.select("product_id", "g", basis.alias("basis"), F.posexplode("chart.brickBrandSizes").alias("n", "s")).withColumn("size",
        F.trim(F.coalesce("s.sizeName", F.lit("")))).where("size <> ''")
    named = F.transform("s.sizeChartAttributes", lambda a: F.struct(F.trim(F.regexp_replace(F.coalesce(a["attributeName"], F.lit("")), "(?i)_attribute$",
        "")).alias("name"), a["attributeValue"].alias("inch"), a["convertedAttributeValue"].alias("cm")))
    sizes = sizes.withColumn("a", named)
    brand = F.get(F.reverse(F.filter("a", lambda a: a["name"].rlike("(?i)^brand size$"))), F.lit(0))["inch"]
    each = sizes.select("product_id", (c("g") * 1000 + c("n")).alias("pos"), "size", F.coalesce(F.nullif(F.trim(brand), F.lit("")), "size").alias("brandSize"),
        "basis", F.posexplode("a").alias("ord", "d"))
    each = each.withColumns({"raw_axis": c("d.name"), "i": t.measurement(c("d.inch")), "m": t.measurement(c("d.cm"))})
    each = each.where((c("raw_axis") != "") & ~c("raw_axis").rlike(LABELS) & F.coalesce(c("i.value"), c("m.value")).isNotNull())
    keyed = each.groupBy("product_id", "pos", "size", "brandSize", "basis", "raw_axis").agg(F.max_by(F.struct("i", "m"), "ord").alias("v"), F.min("ord").alias("ord"))
    columns = {f"{unit}{end}": c(f"v.{of}.{field}") for unit, of in (("inch", "i"), ("cm", "m")) for end, field in (("", "value"), ("_lo", "lo"), ("_hi", "hi"))}
    return _chart(keyed, "c", **columns)


def units(charts: DataFrame) -> DataFrame:
    """The units that each chart (platform, product_id) really has, in alphabetical order."""
    has = [F.max(F.when(F.col(u).isNotNull(), F.lit(u))) for u in ("cm", "inch")]
    return charts.groupBy("platform", "product_id").agg(F.array_compact(F.array(*has)).alias("units"))
