"""Price positions, KPIs, facets, filters and paging over comparisons."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.functions import decision as dec
from quillon.functions import text as t


def market(rows: DataFrame, own: str, rivals: list[str]) -> DataFrame:
    """Position of ``own`` price among rivals' (columns named as platforms): gap, percentages, cheapest, dearest, spread.

    A missing price is never the least. Cheapest and dearest are named only where prices differ; ties go to the first platform."""
    r = [F.col(x) for x in rivals]
    best = F.least(*r) if len(r) > 1 else r[0]
    everyone = [F.col(own), *r]
    lo, hi = F.least(*everyone), F.greatest(*everyone)
    named = lambda v: F.coalesce(*[F.when(F.col(x) == v, F.lit(x)) for x in (own, *rivals)])
    gap = F.col(own) - best
    return rows.withColumns({
        "best_rival": best, "cheapest_rival": F.coalesce(*[F.when(F.col(x) == best, F.lit(x)) for x in rivals]), "gap": gap, "gap_pct": F.round(F.try_divide(gap, F.col(own)) * 100, 1),
        "position": dec.posture(gap), "cheapest": F.when(lo != hi, named(lo)), "dearest": F.when(lo != hi, named(hi)), "spread": F.when(lo != hi, hi - lo).when(lo.isNotNull(), 0.0),
        "price_index": F.round(F.try_divide(F.col(own), lo) * 100, 1),
    })


def kpis(rows: DataFrame) -> DataFrame:
    """Counts and averages over positions."""
    at = lambda name: F.count_if(F.col("position") == name)
    compared = F.count("gap")
    return rows.agg(
        F.count("*").alias("products"), compared.alias("compared"), at("Undercut").alias("undercut"), at("Cheapest").alias("winning"), at("Parity").alias("parity"),
        F.round(F.try_divide(at("Cheapest") + at("Parity"), compared) * 100, 1).alias("cheapest_share"),
        F.round(F.avg(F.when(F.col("gap") > 0, F.col("gap")))).alias("avg_undercut"), F.sum(F.when(F.col("gap") > 0, F.col("gap"))).alias("exposure"),
        F.max("gap").alias("max_gap"), F.max("spread").alias("max_spread"), F.round(F.avg("spread"), 4).alias("avg_spread"),
    )


def top(rows: DataFrame, by: Column, n: int, *ties: str) -> DataFrame:
    """The first n rows; becomes a partial top-k in each task."""
    return rows.orderBy(by, *ties).limit(n)


def breakdown(rows: DataFrame, key: str, n: int = 20) -> DataFrame:
    """Counts by a key, the most frequent ones first."""
    g = rows.groupBy(F.coalesce(F.col(key).cast("string"), F.lit("unspecified")).alias("key"))
    out = g.agg(F.count("*").alias("n"), F.count_if(F.col("gap") > 0).alias("undercut"), F.count_if(F.col("gap") < 0).alias("winning"), F.round(F.avg("gap"), 4).alias("avg_gap"))
    return out.orderBy(F.col("n").desc(), "key").limit(n)


def tally(rows: DataFrame) -> DataFrame:
    """How often each platform is cheapest and dearest; platforms that are never cheapest are left out."""
    count = lambda c, name: rows.where(F.col(c).isNotNull()).groupBy(F.col(c).alias("platform")).agg(F.count("*").alias(name))
    return count("cheapest", "times_cheapest").join(count("dearest", "times_dearest"), "platform", "left").select("platform", "times_cheapest",
        F.coalesce("times_dearest", F.lit(0)).alias("times_dearest"))


def search(rows: DataFrame, query: str, *columns: str) -> DataFrame:
    """Rows whose normalised columns hold every word of the query, as parts of words too."""
    said = t.normalize(F.concat_ws(" ", *columns))
    terms = [w for w in "".join(c if c.isascii() and c.isalnum() else " " for c in query.lower()).split() if w]
    return rows.where(reduce(lambda a, b: a & b, [said.contains(w) for w in terms], F.lit(True)))


SORTS = {
    "price_asc": lambda: F.coalesce("price", F.lit(1e12)).asc(),
    "price_desc": lambda: F.coalesce("price", F.lit(-1.0)).desc(),
    "discount": lambda: F.coalesce("discount", F.lit(0.0)).desc(),
    "rating": lambda: F.coalesce("rating", F.lit(0.0)).desc(),
}


def page(rows: DataFrame, sort: str, number: int, size: int, tie: str, most: int = 60) -> DataFrame:
    """One page, with the total and the number of pages beside each row."""
    size = max(1, min(most, size))
    total = rows.agg(F.count("*").alias("total")).withColumn("pages", F.ceil(F.col("total") / size).cast("long"))
    order = [SORTS[sort](), tie] if sort in SORTS else [tie]
    return rows.orderBy(*order).offset((max(1, number) - 1) * size).limit(size).crossJoin(F.broadcast(total))


def facets(rows: DataFrame, predicates: dict[str, Column], keys: dict[str, Column]) -> DataFrame:
    """Leave-one-out counts (facet, value, n): every value of the unfiltered rows, counted under all predicates but the facet's own.

    One scan: each predicate is a flag, each facet one row a row, counted with the flags of the others."""
    others = {k: reduce(lambda a, b: a & b, [F.coalesce(p, F.lit(False)) for n, p in predicates.items() if n != k], F.lit(True)) for k in keys}
    each = F.array(*[F.struct(F.lit(k).alias("facet"), c.cast("string").alias("value"), others[k].alias("ok")) for k, c in keys.items()])
    return rows.select(F.explode(each).alias("f")).groupBy("f.facet", "f.value").agg(F.count_if("f.ok").alias("n"))


def counts(rows: DataFrame, key: str, name: str) -> DataFrame:
    """``name, n``: how many rows each value has; null is a value of its own."""
    return rows.groupBy(F.col(key).alias(name)).agg(F.count("*").alias("n"))


def compared_only(catalog: DataFrame, comparisons: DataFrame, key: str = "id") -> DataFrame:
    """The products that have a comparison, each once however many there are."""
    return catalog.join(comparisons.select(key), key, "left_semi")


def with_summaries(catalog: DataFrame, comparisons: DataFrame, platforms: list[str], key: str = "id") -> DataFrame:
    """The catalog with ``comparison`` (matched_count, prices by platform, cheapest platform, matched_at), null where there is none.

    ``comparisons`` has a row for each product with ``{platform}_price`` columns; a missing price is never the cheapest, ties go to the first platform."""
    prices = [F.col(f"{p}_price") for p in platforms]
    least = F.least(*prices) if len(prices) > 1 else prices[0]
    cheapest = F.coalesce(*[F.when(x == least, F.lit(p)) for p, x in zip(platforms, prices, strict=True)])
    shown = F.struct("matched_count", F.struct(*[x.alias(p) for p, x in zip(platforms, prices, strict=True)]).alias("prices"), cheapest.alias("cheapest"), "matched_at")
    return catalog.join(comparisons.select(key, shown.alias("comparison")), key, "left")


def reachable(rows: DataFrame, predicates: dict[str, Column], price: str, band: str = "price") -> DataFrame:
    """One row: the least and greatest price under all predicates but the price band's own, and what all of them leave (``n``, ``total_gap``)."""
    whole = lambda chosen: reduce(lambda a, b: a & b, [F.coalesce(p, F.lit(False)) for p in chosen], F.lit(True))
    others, every = whole(p for n, p in predicates.items() if n != band), whole(predicates.values())
    seen = F.when(others, F.col(price))
    return rows.agg(F.min(seen).alias("lo"), F.max(seen).alias("hi"), F.count_if(every).alias("n"), F.sum(F.when(every, F.col("gap"))).alias("total_gap"))


def size_facet(rows: DataFrame, sizes: str, others: Column) -> DataFrame:
    """Counts by size over a column of size arrays, each row once for each of its sizes."""
    each = rows.select(F.explode(F.array_distinct(F.transform(sizes, t.export_size))).alias("size"), others.alias("ok")).where("size is not null")
    return each.groupBy("size").agg(F.count_if("ok").alias("n"))


def tiers(rows: DataFrame, value: str, within: str) -> DataFrame:
    """Price verdicts within a group."""
    from pyspark.sql.window import Window

    w = Window.partitionBy(within)
    return rows.withColumn("verdict", dec.price_verdict(F.col(value), F.min(value).over(w), F.max(value).over(w)))
