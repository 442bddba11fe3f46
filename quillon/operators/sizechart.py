"""Size charts of several platforms on one grid: intervals in both units, verdict for each cell, flags and summary."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillon.functions import text as t

MATCH_INCHES, MAJOR_INCHES = 0.4, 1.0


def indexed(charts: DataFrame) -> DataFrame:
    """(product_id, platform, size, axis, basis, lo, hi, inch) of F4 rows: canonical labels, inches, the first value of a cell kept."""
    axis = t.chart_axis(F.col("raw_axis"), F.col("basis"))
    to_inch = lambda inch, cm: F.coalesce(inch, cm / 2.54)
    middle = to_inch(F.col("inch"), F.col("cm"))
    rows = charts.select("product_id", "platform", "pos", t.chart_size(F.col("size")).alias("size"), axis.alias("a"), middle.alias("inch"),
        F.coalesce(to_inch(F.col("inch_lo"), F.col("cm_lo")), middle).alias("lo"), F.coalesce(to_inch(F.col("inch_hi"), F.col("cm_hi")), middle).alias("hi"))
    rows = rows.where("size is not null and a is not null and lo is not null").withColumn("inch", F.coalesce("inch", (F.col("lo") + F.col("hi")) / 2))
    first = rows.groupBy("product_id", "platform", "size", "a.axis", "a.basis").agg(F.min_by(F.struct("lo", "hi", "inch"), "pos").alias("v"))
    return first.select("product_id", "platform", "size", "axis", "basis", "v.lo", "v.hi", "v.inch")


def cells(index: DataFrame) -> DataFrame:
    """A verdict for every (product, size, axis, basis): the gap between the platforms' intervals."""
    g = index.groupBy("product_id", "size", "axis", "basis").agg(
        F.count("*").alias("n"), (F.max("lo") - F.min("hi")).alias("d"), F.min_by("platform", F.struct("inch", "platform")).alias("low"),
        F.max_by("platform", F.struct("inch", "platform")).alias("high"))
    delta = F.greatest(F.lit(0.0), F.col("d"))
    off = (F.col("n") > 1) & (delta > MATCH_INCHES)
    return g.select(
        "product_id", "size", "axis", "basis", "n", F.when(F.col("n") > 1, F.round(delta, 2)).alias("delta"),
        F.when(F.col("n") == 1, "single").when(off, "mismatch").otherwise("match").alias("status"),
        F.when(off, F.when(delta >= MAJOR_INCHES, "major").otherwise("minor")).alias("severity"), F.when(off, F.col("low")).alias("low"), F.when(off, F.col("high")).alias("high"),
        t.size_rank(F.col("size")).alias("size_rank"), t.axis_order(F.col("axis")).alias("axis_rank"),
    )


def summary(grid: DataFrame) -> DataFrame:
    """Counters and the overall verdict of each product."""
    is_ = lambda s: F.count_if(F.col("status") == s)
    g = grid.groupBy("product_id").agg(is_("match").alias("matches"), is_("mismatch").alias("mismatches"), is_("single").alias("singles"),
        F.count_if(F.col("severity") == "major").alias("major"), F.max("delta").alias("worst"))
    return g.withColumn("verdict", F.when(F.col("matches") + F.col("mismatches") == 0, "not comparable").when(F.col("major") > 0,
        "major differences").when(F.col("mismatches") > 0, "minor differences").otherwise("consistent"))


def only_on(index: DataFrame) -> DataFrame:
    """(product_id, size, platform) of sizes that one platform alone has, where several have a chart: gaps of a catalog, no mismatches."""
    charts = index.groupBy("product_id").agg(F.count_distinct("platform").alias("charts")).where("charts > 1").select("product_id")
    sizes = index.groupBy("product_id", "size").agg(F.count_distinct("platform").alias("n"), F.min("platform").alias("platform")).where("n = 1")
    return sizes.join(charts, "product_id", "left_semi").select("product_id", "size", "platform")


def flags(grid: DataFrame) -> DataFrame:
    """Mismatched cells with ``ord``: major ones first, then by the gap, then in the order of the chart."""
    w = Window.partitionBy("product_id").orderBy((F.col("severity") == "major").desc(), F.col("delta").desc(), "size_rank", "size", "axis_rank", "axis", "basis")
    return grid.where("status = 'mismatch'").withColumn("ord", F.row_number().over(w))


def verdicts(index: DataFrame, grid: DataFrame) -> DataFrame:
    """Counters of each product and its verdict: single_source, mismatch, minor_variance, consistent or not_comparable."""
    charts = index.groupBy("product_id").agg(F.count_distinct("platform").alias("charts"))
    n = lambda c: F.count_if(c)
    is_ = F.col("status")
    sums = grid.groupBy("product_id").agg(n(is_.isin("match", "mismatch")).alias("compared"), n(is_ == "match").alias("matched"),
        n(F.col("severity") == "minor").alias("minor"), n(F.col("severity") == "major").alias("major"))
    verdict = F.when(F.col("charts") < 2, "single_source").when(F.col("major") > 0, "mismatch").when(F.col("minor") > 0,
        "minor_variance").when(F.col("compared") > 0, "consistent").otherwise("not_comparable")
    return charts.join(sums, "product_id").withColumn("verdict", verdict)


def unavailable(wanted: DataFrame, index: DataFrame) -> DataFrame:
    """Why a wanted chart (product_id, platform, reason, published) isn't there: its stated reason, else no_table or not_published."""
    there = index.select("product_id", "platform").distinct()
    why = F.coalesce("reason", F.when(F.coalesce("published", F.lit(False)), "no_table").otherwise("not_published"))
    return wanted.join(there, ["product_id", "platform"], "left_anti").select("product_id", "platform", why.alias("reason"))


def size_stock(variants: DataFrame) -> DataFrame:
    """Stock by size of (product_id, pos, size, available, stock): any available, numbers summed, in order of first sight."""
    return variants.groupBy("product_id", "size").agg(F.bool_or("available").alias("available"), F.sum("stock").alias("stock"), F.min("pos").alias("pos"))


def with_stock(chart: DataFrame, stock: DataFrame) -> DataFrame:
    """Chart rows with their stock; an unknown one stays null."""
    label = lambda c: F.upper(F.regexp_replace(c, r"\s+", ""))
    return chart.withColumn("_s", label(F.col("size"))).join(stock.select("product_id", label(F.col("size")).alias("_s"), "available", "stock"), ["product_id", "_s"], "left").drop("_s")
