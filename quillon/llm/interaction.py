"""Which filter of a chain removes what, for every order of the chain, by incidence matrix products.

Five filters fail a document where

====  ======================================================================
A     it has under 200 words
B     100 * distinct words < 50 * words
C     100 * characters A-Z > 2 * code points
D     it holds any of ``#$%&*|``
E     its text is that of a document with a smaller id, wherever that one is
====  ======================================================================

1. Each text is read once, for the bits of A to D and a SHA-256 digest. What follows handles some 60 bytes a document.
2. E: the least id of each digest is a partial aggregate; a document is free of E if (digest, id) is that pair, found by
   a join on both, so that a text with a third of all documents is no hot key.
3. Documents are summed to a histogram for each part: 32 masks, thrice (all documents, those of quality 1, toxic ones).
4. Histograms of many parts are stacked as rows and multiplied by four integer matrices of 32 masks by 600 outcomes (120 orders by
   5 steps): kept after the step, removed by it, redundant at it, failing its filter alone. Shapley sums are the removed
   of a filter over all orders.

Defined cases: a null text is empty (it fails A alone, and E if it isn't the first one); a null part is the empty string; a
null id is neither smaller nor larger than any, so E never fails it, it makes no other fail, and it has no label; repeated rows count each, and as they share an
id, E treats them alike; a document with several labels is good (toxic) if any of them says so; an empty table gives no
rows; other columns are ignored; very long texts are read whole.
"""

from __future__ import annotations

from itertools import permutations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import computed_once, words, written

FILTERS = "ABCDE"
MASKS = 1 << len(FILTERS)
ORDERS = ["".join(p) for p in permutations(FILTERS)]
STEPS = len(FILTERS)
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS = 200, 50, 2
SYMBOLS = "[#$%&*|]"
#: Parts whose histograms are multiplied at once.
STACK = 512
RESULT = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"


def incidence() -> dict[str, np.ndarray]:
    """32-by-600 matrices of 0 and 1: which mask counts for which outcome, columns by order and step."""
    masks = np.arange(MASKS)[:, None]
    bit = np.array([[1 << FILTERS.index(f) for f in order] for order in ORDERS])
    earlier = np.cumsum(bit, axis=1) - bit
    bit, earlier = bit.reshape(1, -1), earlier.reshape(1, -1)
    fails, gone = (masks & bit) > 0, (masks & earlier) > 0
    out = {"kept": ~fails & ~gone, "removed": fails & ~gone, "redundant": fails & gone, "unique_fails": masks == bit}
    return {k: v.astype(np.int64) for k, v in out.items()}


def facts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """``doc_id, part, low`` (the bits of A to D) and ``digest`` of every row."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    read = computed_once(
        docs,
        F.col(id_col).cast("long").alias("doc_id"),
        F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"),
        words(text).alias("words"),
        (F.octet_length(text) - F.octet_length(F.regexp_replace(text, "[A-Z]+", ""))).cast("long").alias("capitals"),
        F.char_length(text).cast("long").alias("chars"),
        text.rlike(SYMBOLS).alias("symbols"),
        F.unhex(F.sha2(text, 256)).alias("digest"),
    )
    n, distinct = F.size("words").cast("long"), F.size(F.array_distinct("words")).cast("long")
    fails = [n < LEAST_WORDS, 100 * distinct < LEAST_DISTINCT * n, 100 * F.col("capitals") > MOST_CAPITALS * F.col("chars"), F.col("symbols")]
    low = sum((F.when(f, 1 << i).otherwise(0) for i, f in enumerate(fails)), F.lit(0))
    return read.select("doc_id", "part", low.alias("low"), "digest")


def histograms(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """``part, mask, n, good, toxic``: a row for each mask that occurs in a part."""
    every = written(facts(docs, id_col, text_col, part_col), "facts")
    first = every.where("doc_id is not null").groupBy("digest").agg(F.min("doc_id").alias("doc_id")).withColumn("first", F.lit(True))
    says = lambda c: F.coalesce(F.max(F.col(c) == 1), F.lit(False)).alias(c)
    marks = labels.select(F.col(id_col).cast("long").alias("doc_id"), "quality", "toxic").groupBy("doc_id").agg(says("quality"), says("toxic")).where("quality or toxic")
    copied = F.col("doc_id").isNotNull() & F.col("first").isNull()
    mask = F.col("low") + F.when(copied, 1 << FILTERS.index("E")).otherwise(0)
    count = lambda c: F.coalesce(F.count_if(c), F.lit(0)).alias({"quality": "good"}.get(c, c))
    joined = every.join(first, ["digest", "doc_id"], "left").join(marks, "doc_id", "left")
    return joined.groupBy("part", mask.alias("mask")).agg(F.count("*").alias("n"), count("quality"), count("toxic"))


def outcomes(hist: DataFrame) -> DataFrame:
    """600 rows for each part of ``histograms``."""

    def run(batches):
        import pyarrow as pa

        by = incidence()
        order = pa.array(np.repeat(ORDERS, STEPS))
        step = np.tile(np.arange(1, STEPS + 1, dtype=np.int32), len(ORDERS))
        place = np.array([FILTERS.index(f) for o in ORDERS for f in o])
        of_filter = (place[:, None] == np.arange(STEPS)).astype(np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, STACK):
                some = batch.slice(at, STACK)
                rows = np.zeros((3, some.num_rows, MASKS), np.int64)
                for i, cells in enumerate(some.column("cells").to_pylist()):
                    for c in cells:
                        rows[:, i, c["mask"]] = c["n"], c["good"], c["toxic"]
                every, good, toxic = rows
                product = {k: every @ m for k, m in by.items()} | {"good_lost": good @ by["removed"], "toxic_lost": toxic @ by["removed"]}
                product["shapley"] = (product["removed"] @ of_filter)[:, place]
                k = some.num_rows
                part = some.column("part").take(pa.array(np.repeat(np.arange(k), len(place))))
                head = [part, pa.concat_arrays([order] * k), pa.array(np.tile(step, k))]
                names = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
                yield pa.RecordBatch.from_arrays([*head, *(pa.array(product[c].ravel()) for c in names)], ["part", "filter_order", "step", *names])

    cells = hist.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells"))  # 32 at most
    return cells.mapInArrow(run, RESULT)


def audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """A row for each part, order of the filters and step."""
    return outcomes(histograms(docs, labels, id_col, text_col, part_col))
