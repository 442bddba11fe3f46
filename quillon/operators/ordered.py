"""Global order without one sorted task: row numbers, deep pages and stops at a limit.

Rows are dealt into ranges of the order, sorted inside them and stored once; the number of rows of each range, one row a range, tells where
each begins. A page or the first n rows then read only the ranges that hold them: the stored place is a column that Parquet can skip by.

Defined cases: the order must end in something unique, else ties are numbered in any order; nulls stand where the order puts them; an empty table has no pages.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillon.sources import shared

#: Bits of a place inside its range.
INNER = 33


@dataclass(frozen=True)
class Ordered:
    """Rows in an order. ``rows`` have ``_place``: range and place inside it; ``ranges``: (range, n, before) for each range that has rows."""

    rows: DataFrame
    ranges: DataFrame

    def total(self) -> int:
        return self.ranges.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]

    def between(self, first: int, last: int) -> DataFrame:
        """Rows number ``first`` to ``last``, from 1, with ``number``."""
        held = self.ranges.where((F.col("before") < last) & (F.col("before") + F.col("n") >= first)).collect()  # the ranges of one page
        ok, number = F.lit(False), F.lit(None).cast("long")
        for r in held:
            begin = r["range"] << INNER
            low, high = begin + max(0, first - 1 - r["before"]), begin + min(r["n"], last - r["before"]) - 1
            here = F.col("_place").between(low, high)
            ok, number = ok | here, F.when(here, F.col("_place") - begin + r["before"] + 1).otherwise(number)
        return self.rows.where(ok).withColumn("number", number).drop("_place")

    def numbered(self) -> DataFrame:
        """All rows with their ``number``, from 1."""
        inner = F.col("_place").bitwiseAND(F.lit((1 << INNER) - 1))
        at = self.rows.withColumn("range", F.shiftright("_place", INNER))
        return at.join(self.ranges.select("range", "before"), "range").withColumn("number", F.col("before") + inner + 1).drop("range", "before", "_place")


def ordered(rows: DataFrame, *order: Column | str) -> Ordered:
    """Store rows in ranges of an order. The places are taken behind the sort, in the same task."""
    sorted_ = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_place", F.monotonically_increasing_id())
    stored = shared.settled(sorted_, "ordered")
    counts = stored.groupBy(F.shiftright("_place", INNER).alias("range")).agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row a range
    return Ordered(stored, shared.settled(counts.withColumn("before", before), "ranges"))


def page(rows: DataFrame, order: list[Column | str], number: int, size: int) -> DataFrame:
    """A page, with ``number`` of each row, ``total`` and ``pages``."""
    at = ordered(rows, *order)
    total = at.total()
    first = (max(1, number) - 1) * size + 1
    return at.between(first, first + size - 1).withColumns({"total": F.lit(total).cast("long"), "pages": F.lit(-(-total // size)).cast("long")})


def first_rows(rows: DataFrame, order: list[Column | str], n: int) -> DataFrame:
    """The first ``n`` rows of an order, however large ``n`` is."""
    return ordered(rows, *order).between(1, n).drop("number")


def gathered(pages: DataFrame, order: list[str], target: int, key: str = "id") -> DataFrame:
    """Rows of landed result pages as a catalog: those with a title and a price, the first of each id in the order, until ``target`` ids are found."""
    fine = pages.where((F.trim("title") != "") & F.col("price").isNotNull() & F.col(key).isNotNull())
    rest = [c for c in pages.columns if c != key]
    one = fine.groupBy(key).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("r")).select(key, "r.*")
    return first_rows(one, [*order, key], target)
