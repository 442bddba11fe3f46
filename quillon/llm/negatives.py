"""Hard negatives by a two-dimensional block matrix multiply of anchors and all rows.

1. Rows become integer vectors and are cut into blocks of at most ``ROWS`` rows, in the order of their labels, so that most blocks have one
   label alone; a label with a third of all rows lies in many blocks. Blocks of anchors have ``ANCHORS`` rows. Every block is stored
   as chunks of ``DIMS`` dimensions.
2. Each pair of an anchor block and a row block is a tile. Row blocks are dealt into groups of at most ``HELD`` components; anchor blocks go to every
   group in a shuffle and meet its blocks there, where their labels leave something to compare. Each pair of chunks of the
   same dimensions gives a partial tile of int64 scores.
3. Partial tiles are added where they are made, one tile at a time, and each sum is reduced to the first ``k`` of each anchor, or of
   each window of an anchor and a positive, over all tiles of the group. Only those leave the task; first ranks of all groups are a limited window.
4. The first multiplication takes tiles with equal labels and gives the positives, the second takes tiles with different
   labels and the windows of scores that the positives give. So each pair of rows is multiplied once.

Anchors are a stated set of queries; they go in panels of ``PANEL`` anchors, each a job of its own, which bounds what a task holds: the
components of a panel and of a group, and one tile of 256 by 2048 scores. No row of scores is ever collected, written or shuffled.

Products are exact: float64 matrices where no sum can leave 2^53, else int64. Components whose squares times the dimensions could leave
int64 a hundredfold are clamped there (beyond 38 million for 64 dimensions).

Defined cases: rows with a null id, label or vector, or with a null or non-finite component, take no part; shorter vectors are
filled with 0, so that empty ones score 0; repeated rows take part each, and "other" rows are those with another id; ties go to
the smaller id; an anchor without positives, or a positive without negatives in its window, gives no rows; an empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

import os

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillon.llm.common import computed_once, written

SCALE = 256
ANCHORS, ROWS, DIMS = 256, 2048, 32
PANEL = 16384
POSITIVES, NEGATIVES = 5, 10
#: Of a positive's score: the window of its negatives, in hundredths.
LEAST, MOST = 30, 90
BLOCKS = "block long, chunk int, lo long, hi long, n int, ids binary, labels binary, data binary"
#: Components that are held at once to be cut into blocks.
HELD = 1 << 23
WINDOWS = "array<struct<place:int,rank:int,score:long>>"
FIRSTS = "block long, place int, anchor_id long, of int, id long, score long"
NAMES = ["block", "place", "anchor_id", "of", "id", "score"]
NOWHERE = np.iinfo(np.int64).min


def integers(rows: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """``id, label, v`` of the rows that take part; ``v``: floor(256 x) of each component, as a long."""
    v = F.col(vec_col).cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & (F.abs(x) < float("inf")))  # NaN is above all
    most = F.floor(F.sqrt(F.lit(float(1 << 63)) / 101 / F.greatest(F.size(v), F.lit(1))))
    whole = lambda x: F.greatest(F.least(F.floor(x * SCALE), most), -most)
    ids = (F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"))
    return computed_once(rows, *ids, F.when(fine, F.transform(v, whole)).alias("v")).where("id is not null and label is not null and v is not null")


def blocked(rows: DataFrame, many: int, size: int, width: int) -> DataFrame:
    """Blocks of ``size`` of ``many`` rows, by chunk of ``width`` dimensions in all. Block numbers are drawn, so this is to be written before use."""

    def cut(ids, labels, m):
        order = np.lexsort((ids, labels))
        ids, labels, m = ids[order], labels[order], m[order]
        edge = np.flatnonzero(np.r_[True, labels[1:] != labels[:-1], True])
        if len(edge) - 1 > 2 * (len(ids) // size + 1):  # many small labels share blocks
            edge = np.array([0, len(ids)])
        for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
            for i in range(a, b, size):
                j = min(b, i + size)
                block = int.from_bytes(os.urandom(8), "little") >> 1
                for c in range(-(-width // DIMS)):
                    meta = (ids[i:j].tobytes(), labels[i:j].tobytes()) if c == 0 else (None, None)
                    yield block, c, int(labels[i]), int(labels[j - 1]), j - i, *meta, narrow(m[i:j, c * DIMS : (c + 1) * DIMS])

    def run(batches):
        import pyarrow as pa

        kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary())
        names = ["block", "chunk", "lo", "hi", "n", "ids", "labels", "data"]

        def out(held):
            for r in cut(*(np.concatenate([h[k] for h in held]) for k in range(3))):
                yield pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(r, kinds, strict=True)], names)

        held, n = [], 0
        for batch in batches:
            v = batch.column("v")
            length = np.diff(v.offsets.to_numpy())
            m = np.zeros((batch.num_rows, width), np.int64)
            at = np.repeat(np.arange(batch.num_rows), length)
            m[at, np.arange(len(at)) - np.repeat(np.cumsum(length) - length, length)] = v.flatten().to_numpy()
            held.append((batch.column("id").to_numpy(), batch.column("label").to_numpy(), m))
            n += batch.num_rows
            if n * width >= HELD:
                yield from out(held)
                held, n = [], 0
        if n:
            yield from out(held)

    # dealt by label, so that blocks have one label; the rows of a large label, and copies of one row, go to many partitions
    parts = max(1, -(-many // (8 * size)))
    dealt = rows.repartitionByRange(parts, "label", F.xxhash64("id"), F.monotonically_increasing_id()).select("id", "label", "v")
    return dealt.coalesce(parts).mapInArrow(run, BLOCKS)


def narrow(m: np.ndarray) -> bytes:
    """Integers in the least of 2, 4 and 8 bytes each, the number of bytes first."""
    most = int(np.abs(m).max(initial=0))
    kind = np.int16 if most < 1 << 15 else np.int32 if most < 1 << 31 else np.int64
    return bytes([np.dtype(kind).itemsize]) + m.astype(kind).tobytes()


def wide(data: bytes, n: int) -> np.ndarray:
    return np.frombuffer(data, f"i{data[0]}", offset=1).astype(np.int64).reshape(n, -1)


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a times b transposed, exact in int64."""
    most = int(np.abs(a).max(initial=0)) * int(np.abs(b).max(initial=0)) * max(1, a.shape[1])
    if most < 1 << 53:
        return np.rint(a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a @ b.T


def firsts(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the first ``k`` scores of every row that aren't ``NOWHERE``: higher ones first, then smaller ids."""
    if scores.shape[1] > k:
        edge = np.partition(scores, scores.shape[1] - k, axis=1)[:, scores.shape[1] - k]
    else:
        edge = np.full(len(scores), NOWHERE)
    row, col = np.nonzero((scores >= edge[:, None]) & (scores != NOWHERE))
    order = np.lexsort((ids[col], -scores[row, col], row))
    row, col = row[order], col[order]
    start = np.searchsorted(row, np.arange(len(scores)))
    keep = np.arange(len(row)) - start[row] < k
    return row[keep], col[keep]


def blocks_of(table) -> list[dict]:
    """The blocks of a table of chunks: what is known of their rows, with ``chunks`` in their order."""
    found: dict[int, dict] = {}
    for row in table.select(["block", "chunk", "lo", "hi", "n"]).to_pylist():
        found.setdefault(row["block"], row | {"chunks": {}})
    for i, (block, chunk) in enumerate(zip(table.column("block").to_pylist(), table.column("chunk").to_pylist(), strict=True)):
        one = found[block]
        one["chunks"][chunk] = table.column("data")[i].as_py()
        if chunk == 0:
            one |= {c: np.frombuffer(table.column(c)[i].as_py(), np.int64) for c in ("ids", "labels")}
            one["windows"] = table.column("windows")[i].as_py() if "windows" in table.column_names else None
    return list(found.values())


def meet(a: dict, b: dict, same: bool) -> bool:
    """Whether two blocks can have rows to compare, by their least and greatest labels."""
    if same:
        return a["lo"] <= b["hi"] and b["lo"] <= a["hi"]
    return not a["lo"] == a["hi"] == b["lo"] == b["hi"]


def tile(a: dict, b: dict) -> np.ndarray:
    """The scores of two blocks: partial tiles of their chunks, added."""
    return sum(product(wide(a["chunks"][c], a["n"]), wide(b["chunks"][c], b["n"])) for c in a["chunks"])


class Firsts:
    """The first ``k`` rows of each of ``n`` anchors over the tiles that have been seen: higher scores first, then smaller ids."""

    def __init__(self, n: int, k: int):
        self.k, self.least = k, np.full(n, NOWHERE)
        self.row, self.id, self.score = (np.zeros(0, np.int64) for _ in range(3))

    def add(self, scores: np.ndarray, fit: np.ndarray, ids: np.ndarray) -> None:
        fit = fit & (scores >= self.least[:, None])  # equal ones may have smaller ids
        if np.count_nonzero(fit) > 4 * self.k * len(fit):
            row, col = firsts(np.where(fit, scores, NOWHERE), ids, self.k)
        else:
            row, col = np.nonzero(fit)
        if not len(row):
            return
        row, score, ids = np.r_[self.row, row], np.r_[self.score, scores[row, col]], np.r_[self.id, ids[col]]
        order = np.lexsort((ids, -score, row))
        row, score, ids = row[order], score[order], ids[order]
        start = np.searchsorted(row, np.arange(len(fit)))
        place = np.arange(len(row)) - start[row]
        keep = place < self.k
        self.row, self.score, self.id = row[keep], score[keep], ids[keep]
        last = place == self.k - 1
        self.least[row[last]] = score[last]


def reduced(same: bool):
    """Of a panel's anchor blocks and a group of row blocks: the first rows of every anchor, of its own label (``same``), or of other labels inside each
    of its windows. One tile is held at a time."""

    def run(asked, held):
        import pyarrow as pa

        out, others = [], blocks_of(held)
        for a in blocks_of(asked):
            n, ids, labels = a["n"], a["ids"], a["labels"]
            best = [Firsts(n, POSITIVES)] if same else [Firsts(n, NEGATIVES) for _ in range(POSITIVES)]
            low, high = np.ones((2, POSITIVES, n), np.int64)
            high[:] = 0  # a window that holds nothing
            for w in a["windows"] or []:
                low[w["rank"] - 1, w["place"]], high[w["rank"] - 1, w["place"]] = LEAST * w["score"], MOST * w["score"]
            for b in others:
                if not meet(a, b, same):
                    continue
                scores, alike = tile(a, b), labels[:, None] == b["labels"]
                if same:
                    best[0].add(scores, alike & (ids[:, None] != b["ids"]), b["ids"])
                    continue
                other, scaled = ~alike, 100 * scores
                for k, first in enumerate(best):
                    first.add(scores, other & (scaled >= low[k][:, None]) & (scaled <= high[k][:, None]), b["ids"])
            for k, first in enumerate(best):
                of = np.full(len(first.row), k, np.int32)
                columns = [np.full(len(of), a["block"], np.int64), first.row.astype(np.int32), ids[first.row], of, first.id, first.score]
                out.append(pa.RecordBatch.from_arrays([pa.array(c) for c in columns], NAMES))
        kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int64())
        return pa.Table.from_batches(out, pa.schema(list(zip(NAMES, kinds, strict=True))))

    return run


def ranked(rows: DataFrame, k: int) -> DataFrame:
    """The first ``k`` rows of each anchor row and window over all groups, with their ``rank``."""
    order = Window.partitionBy("block", "place", "of").orderBy(F.desc("score"), "id")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def multiplied(anchors: DataFrame, rows: DataFrame, groups: int, same: bool) -> DataFrame:
    """Tiles of anchor blocks and row blocks: the former go to each of ``groups`` groups of the latter and meet there, where labels allow.

    The copies of the anchors are dealt by group in a shuffle; they never go through the driver."""
    b = rows.withColumn("g", F.pmod("block", F.lit(groups)))
    a = anchors.withColumn("g", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long"))))
    return a.groupBy("g").cogroup(b.groupBy("g")).applyInArrow(reduced(same), FIRSTS)


def mine(rows: DataFrame, anchor: Column | None = None, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", panel: int = PANEL) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``; ``anchor``: which ``id`` is an anchor, by default each hundredth."""
    dealt_to = 4 * rows.sparkSession.sparkContext.defaultParallelism
    # read by several jobs, and dear: dealt out first, however few files there are
    dealt = rows.select(id_col, vec_col, label_col).repartition(dealt_to)
    given = written(integers(dealt, id_col, vec_col, label_col), "integers")
    asks = F.col("id") % 100 == 0 if anchor is None else anchor
    width, n, n_asks = given.agg(F.coalesce(F.max(F.size("v")), F.lit(0)), F.count("*"), F.count_if(asks)).first()
    b = written(blocked(given, n, ROWS, max(1, width)), "blocks")
    every = written(blocked(given.where(asks), n_asks, ANCHORS, max(1, width)), "anchors")
    blocks, panels = b.where("chunk = 0").count(), max(1, -(-n_asks // panel))
    most = max(1, HELD // (ROWS * max(1, width)))  # blocks that a group holds
    groups = max(1, -(-blocks // most), min(blocks, dealt_to))
    out = None
    for p in range(panels):
        a = every.where(F.pmod("block", F.lit(panels)) == p)
        positives = written(ranked(multiplied(a.withColumn("windows", F.lit(None).cast(WINDOWS)), b, groups, True), POSITIVES), "positives")
        windows = positives.groupBy("block").agg(F.collect_list(F.struct("place", "rank", "score")).alias("w"))  # ANCHORS * POSITIVES at most
        a = a.join(windows, "block").withColumn("windows", F.when(F.col("chunk") == 0, F.col("w"))).drop("w")
        negatives = ranked(multiplied(a, b, groups, False), NEGATIVES)
        of = positives.select("block", "place", (F.col("rank") - 1).alias("of"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
        found = negatives.join(of, ["block", "place", "of"])
        some = found.select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
        some = written(some, "negatives") if panels > 1 else some
        out = some if out is None else out.unionByName(some)
    return out
