"""Image signatures over pixel rows (image_id, x, y, r, g, b): the product's dominant colour in a region, and a difference hash.

Pixels are rows, so a signature is two aggregations by image; decoding files is left to the source."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.functions import similarity as sim
from quillon.functions import text as t
from quillon.functions.vocab import DEFAULT, Taxonomy

# Where products are in a picture, as (top, bottom, left, right) shares of it, by region: the box and a wider one.
BOXES = {
    "top": ((0.42, 0.78, 0.36, 0.64), (0.40, 0.85, 0.28, 0.72)),
    "bottom": ((0.55, 0.86, 0.38, 0.62), (0.48, 0.92, 0.30, 0.70)),
    "footwear": ((0.35, 0.85, 0.20, 0.80), (0.25, 0.95, 0.10, 0.90)),
    "object": ((0.30, 0.75, 0.28, 0.72), (0.18, 0.88, 0.15, 0.85)),
}
WHOLE = (0.1, 0.9, 0.1, 0.9)
BACKDROP = 16.0
#: Fewer pixels than these lead to the wider box, to the whole picture, and to no colour.
NARROW, WIDE, LEAST_PIXELS = 40, 20, 12


def region(garment: Column, tax: Taxonomy = DEFAULT) -> Column:
    """Where a kind of product is seen; unknown kinds in the middle."""
    return F.coalesce(F.try_element_at(t.literal_map(tax.regions), garment), F.lit("object"))


def _border(of: str) -> Column:
    """How wide the border is, of a side of the picture."""
    return F.greatest(F.lit(2), F.round(F.col(of) * 0.06))


def colours(pixels: DataFrame, where: str | None = "object") -> DataFrame:
    """``where``: the region, or null if each pixel has its picture's in a column ``region``. (image_id, rgb, lab, sampled, dominant): the mean of the fullest 4-bit bin (the first seen of several) of the pixels that differ from the border.

    The border's colour is the upper median of each channel. All three boxes are counted in one aggregation by image and bin."""
    size = pixels.groupBy("image_id").agg((F.max("x") + 1).alias("w"), (F.max("y") + 1).alias("h"))
    p = pixels.join(size, "image_id")
    at_edge = lambda c, of: (F.col(c) < _border(of)) | (F.col(c) >= F.col(of) - _border(of))
    edge = at_edge("x", "w") | at_edge("y", "h")
    upper = lambda c: F.get(F.sort_array(F.collect_list(c)), F.floor(F.count(c) / 2).cast("int"))  # noqa: E731  (of a border, which is short)
    back = p.where(edge).groupBy("image_id").agg(*[upper(c).alias(f"b{c}") for c in "rgb"])
    own = p.join(back, "image_id")
    off = F.sqrt(F.aggregate(F.zip_with(sim.lab(F.col("r"), F.col("g"), F.col("b")), sim.lab(F.col("br"), F.col("bg"), F.col("bb")), lambda x, y: F.pow(x - y, 2)), F.lit(0.0), lambda s, v: s + v))
    bins = F.shiftright("r", 4) * 256 + F.shiftright("g", 4) * 16 + F.shiftright("b", 4)

    def inside(*boxes: tuple) -> Column:
        """Of a region's box: one box, or one for each region in their order."""
        bound = lambda i: F.lit(boxes[0][i]) if len(boxes) == 1 else F.coalesce(*[F.when(F.col("region") == n, F.lit(b[i])) for n, b in zip(BOXES, boxes, strict=True)])
        top, bottom, left, right = map(bound, range(4))
        within = lambda c, of, lo, hi: (F.col(c) >= F.floor(F.col(of) * lo)) & (F.col(c) < F.floor(F.col(of) * hi))
        return within("y", "h", top, bottom) & within("x", "w", left, right)

    of = [BOXES[where]] if where else list(BOXES.values())
    boxes = {"narrow": inside(*[b[0] for b in of]), "wide": inside(*[b[1] for b in of]), "whole": inside(WHOLE)}
    counts = [x for n, i in boxes.items() for x in (F.count_if(i).alias(f"{n}_n"), F.min(F.when(i, F.struct("y", "x"))).alias(f"{n}_at"),
        *[F.avg(F.when(i, F.col(c))).alias(f"{n}_{c}") for c in "rgb"])]
    binned = own.where(off >= BACKDROP).groupBy("image_id", bins.alias("bin")).agg(*counts)
    best = binned.groupBy("image_id").agg(*[x for n in boxes for x in (
        F.sum(f"{n}_n").alias(f"{n}_sampled"), F.min_by(F.struct(*[F.col(f"{n}_{c}").alias(c) for c in ("n", *"rgb")]), F.when(F.col(f"{n}_n") > 0, F.struct(-F.col(f"{n}_n"), f"{n}_at"))).alias(n)
    )])
    pick = lambda n: F.struct(F.col(f"{n}_sampled").alias("sampled"), F.col(n).alias("d"))
    first = F.when((F.col("narrow_sampled") < NARROW) & (F.col("wide_sampled") > 0), pick("wide")).otherwise(pick("narrow"))
    chosen = best.select("image_id", first.alias("s"), pick("whole").alias("all")).select("image_id",
        F.when(F.col("s.sampled") < WIDE, F.col("all")).otherwise(F.col("s")).alias("s")).where(F.col("s.sampled") >= LEAST_PIXELS)
    rgb = [F.floor(F.col(f"s.d.{c}") + 0.5).cast("int") for c in "rgb"]
    return chosen.select("image_id", F.array(*rgb).alias("rgb"), sim.lab(*rgb).alias("lab"), F.col("s.sampled").alias("sampled"), F.col("s.d.n").alias("dominant"))


def difference_hash(grey: DataFrame) -> DataFrame:
    """(image_id, dhash) of 9 x 8 grey rows (image_id, x, y, v): a bit where a pixel is brighter than its right neighbour.

    A line of pixels is one row of partial aggregates, so pixels are neither joined nor broadcast."""
    x, v = F.col("x"), F.col("v")
    at = [F.max(F.when(x == i, v)).alias(f"v{i}") for i in range(9)] + [F.min(F.when(x == i, v)).alias(f"n{i}") for i in range(1, 9)]
    there = F.bit_or(F.when(x.between(0, 8), F.expr("shiftleft(1, cast(x as int))")).otherwise(0)).alias("there")
    lines = grey.groupBy("image_id", "y").agg(*at, there)
    bits = [F.when(F.col(f"v{i}") > F.col(f"n{i + 1}"), F.expr(f"shiftleft(1L, cast(63 - (y * 8 + {i}) as int))")).otherwise(F.lit(0).cast("long")) for i in range(8)]
    both = F.col("there").bitwiseAND(F.shiftright("there", 1)) != 0  # a pixel beside another
    return lines.where(both).select("image_id", reduce(lambda p, q: p.bitwiseOR(q), bits).alias("bits")).groupBy("image_id").agg(F.bit_or("bits").alias("dhash"))


def signatures(requests: DataFrame, pixels: DataFrame) -> DataFrame:
    """Requests (region, url, whatever else) with the ``image`` that was read for them, its ``rgb``, ``lab``, ``sampled`` and ``dominant``: computed once for each
    different region and link, however many products show it. The small rendition of a link counts where it has landed, else the link itself;
    where neither has, or no product stands out, the rest is null.

    ``pixels``: (url, x, y, r, g, b) of all landed pictures."""
    link = F.when(F.col("url").startswith("//"), F.concat(F.lit("https:"), F.col("url"))).otherwise(F.col("url"))
    asked = requests.withColumn("_link", link)
    keys = asked.where("_link is not null and region is not null").select("region", "_link").distinct()
    landed = lambda name: pixels.select(F.col("url").alias(name)).distinct()
    small = t.small_rendition(F.col("_link"))
    chosen = keys.withColumn("_small", small).join(landed("_s"), F.col("_small") == F.col("_s"), "left").join(landed("_o"), F.col("_link") == F.col("_o"), "left")
    chosen = chosen.select("region", "_link", F.coalesce("_s", "_o").alias("image")).where("image is not null")
    named = chosen.select("region", "image", F.concat_ws("|", "region", "image").alias("image_id"))
    seen = pixels.withColumnRenamed("url", "image").join(named.distinct(), "image")
    found = colours(seen, None).join(named.distinct(), "image_id").drop("image_id")
    known = chosen.join(found, ["region", "image"], "left").withColumnRenamed("region", "_region").withColumnRenamed("_link", "_key")
    return asked.join(known, (F.col("region") == F.col("_region")) & (F.col("_link") == F.col("_key")), "left").drop("_link", "_key", "_region")
