"""Landed files as tables: catalog and listing payloads, detail pages, comparisons under a fingerprint."""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillon.functions import text as t

CATALOG = "products array<struct<id:string,source:string,brand:string,title:string,color:string,mrp:double,price:double,currency:string,discountPercent:double,rating:double,ratingCount:bigint,image:string,url:string,gender:string>>"


def catalog(spark: SparkSession, path: str) -> DataFrame:
    """Products of JSON documents {products: [...]}; ids in upper case."""
    return spark.read.schema(CATALOG).option("multiLine", True).json(path).select(F.explode("products").alias("p")).select("p.*").withColumn("id", F.upper("id"))


def comparisons(spark: SparkSession, path: str, fingerprint: str) -> DataFrame:
    """Stored comparisons of one fingerprint, which is a partition: others are never read."""
    return spark.read.parquet(path).where(F.col("fingerprint") == fingerprint).drop("fingerprint")


def write_comparisons(rows: DataFrame, path: str, fingerprint: str) -> None:
    rows.withColumn("fingerprint", F.lit(fingerprint)).write.mode("append").partitionBy("fingerprint").parquet(path)


#: A stored comparison.
STORED = (
    "anchor struct<id:string,brand:string,title:string,price:double,mrp:double>, competitors array<struct<platform:string,id:string,status:string,score:double,price:double,mrp:double,matchType:string,reason:string>>,"
    " matchedAt string, fingerprint string"
)


def _scanned_first(stored: DataFrame, limit: int) -> DataFrame:
    """The first ``limit`` of (key, raw) in the order of their keys, read; ``why``: what is wrong with a row. Only keys are sorted, each task keeps
    ``limit`` of them at most."""
    keys = stored.select("key").orderBy("key").limit(limit)
    rows = keys.join(stored, "key")
    j = F.from_json("raw", STORED)
    why = F.when(F.col("raw").isNull(), "missing").when(F.try_parse_json("raw").isNull(), "corrupt").when(F.coalesce(j["anchor"]["id"], F.lit("")) == "", "nameless")
    return rows.select("key", why.alias("why"), j.alias("j"))


def hydrated(stored: DataFrame, limit: int = 5000) -> DataFrame:
    """Stored comparisons (key, raw JSON) in the order of their keys: of the first ``limit`` keys those whose text is whole and names its anchor.

    Keys are distinct. Missing and corrupt rows count toward the limit, as they are found only when they are read."""
    return _scanned_first(stored, limit).where("why is null").select("key", "j.*")


def hydration(stored: DataFrame, limit: int = 5000) -> DataFrame:
    """How many keys ``hydrated`` has looked at, and how many of them it skipped, by reason."""
    rows = _scanned_first(stored, limit)
    return rows.agg(F.count("*").alias("keys"), *[F.count_if(F.coalesce(F.col("why") == w, F.lit(False))).alias(w) for w in ("missing", "corrupt", "nameless")])


def listing(rows: DataFrame) -> DataFrame:
    """Raw listings (id, brand, title, price, mrp, discount, sizes as text, image, url) with one shape: absolute links, list
    price no less than known, discount from the prices, else the given one up to 100."""
    derived = F.when((F.col("mrp") > 0) & (F.col("price") < F.col("mrp")), F.round((1 - F.col("price") / F.col("mrp")) * 100))
    link = lambda c: F.when(F.col(c).startswith("//"), F.concat(F.lit("https:"), F.col(c))).otherwise(F.col(c))
    return rows.withColumns({
        "id": F.upper("id"), "mrp": F.coalesce("mrp", "price"), "discountPercent": F.coalesce(derived, F.when(F.col("discount") <= 100, F.col("discount"))),
        "sizes": F.filter(F.transform(F.split(F.coalesce("sizes", F.lit("")), ","), lambda s: F.trim(s)), lambda s: s != ""), "image": link("image"), "url": link("url"),
    })


def pairs_map(pairs: Column) -> Column:
    """A list of (key, value) as a map; the last of a key wins, blank and NA values are none."""
    ok = F.filter(pairs, lambda p: (F.trim(p["value"]) != "") & (F.upper(F.trim(p["value"])) != "NA"))
    last = F.filter(ok, lambda p, i: ~F.exists(F.slice(ok, i + 2, F.size(ok)), lambda q: q["key"] == p["key"]))
    return F.map_from_entries(last)


def first_by(rows: DataFrame, keys: list[str], *order: str) -> DataFrame:
    """The first row of each key in a given order."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def embedded(pages: DataFrame, anchor: str, html: str = "html") -> DataFrame:
    """``json``: the balanced object behind ``anchor`` in each page, null without one. Braces in strings don't count.

    Nesting is beyond regular expressions, so batches go through Python."""

    def run(batches: Iterator):
        import pyarrow as pa

        decode = json.JSONDecoder().raw_decode
        for batch in batches:
            found = []
            for page in batch.column(html).to_pylist():
                at = (page or "").find(anchor)
                start = page.find("{", at + len(anchor)) if at >= 0 else -1
                try:
                    found.append(page[start : decode(page, start)[1]] if start >= 0 else None)
                except ValueError:
                    found.append(None)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.string())], [*batch.schema.names, "json"])

    return pages.mapInArrow(run, ", ".join(f"`{n}` {k}" for n, k in pages.dtypes) + ", json string")


def page_fields(pages: DataFrame) -> DataFrame:
    """(page_id, host, path, query, title, text) of raw pages: link parts and text without markup."""
    part = lambda p: F.try_parse_url(F.col("url"), F.lit(p))
    body = F.regexp_replace("html", r"(?is)<(script|style)[^>]*>.*?</\1>|<!--.*?-->", " ")
    return pages.select("page_id", F.lower(part("HOST")).alias("host"), part("PATH").alias("path"), part("QUERY").alias("query"),
        F.regexp_extract("html", r"(?is)<title>(.*?)</title>", 1).alias("title"), t.plain(body).alias("text"))


def resolved(ids: DataFrame, key: str, *sources: DataFrame) -> DataFrame:
    """Each id with the row of the first source that has it (as ``found``) and that source's place; null without one."""
    out = ids
    for i, source in enumerate(sources):
        one = first_by(source, [key], key).select(key, F.struct("*").alias(f"_s{i}"))
        out = out.join(one, key, "left")
    names = [f"_s{i}" for i in range(len(sources))]
    where = F.coalesce(*[F.when(F.col(n).isNotNull(), F.lit(i)) for i, n in enumerate(names)])
    return out.withColumns({"found": F.coalesce(*names), "source": where}).drop(*names)
