"""Packing documents into fixed-length sequences by linear grouping.

1. Texts become token ids inside tasks; longer ones are cut, the odd piece first. Only
   (document, piece, start, length, checksum) is kept, written once to the shared folder.
2. Lengths lie between 1 and the capacity, so their histogram is all that the plan needs; it has at
   most ``capacity`` rows, whatever the input. Large lengths are dealt into ``GROUPS`` groups of equal cardinality
   and rounded up to their group's largest. How often each configuration of these few sizes is to be used is a linear
   program, solved by column generation: a knapsack over the groups' dual prices finds the next configuration, until none
   would save anything. Whole uses are taken (at most one use for each group is lost to rounding down). Actual
   lengths are put into their places, the longest left up to the place's size, and into a configuration's last place the longest left that
   fits, so that what rounding wasted is used. What is over, then the small pieces, longest first,
   go where they leave the least room (best fit). The plan holds runs: "pieces of length L with ranks
   r to r+n go to sequences s to s+n at offset o". Its size follows the lengths, not the documents.
3. Pieces are ranked within their length. Lengths are split over salts, each ranked for itself, and
   the salts' counts give each its first rank: a length that a third of all pieces share is no hot key.

Defined cases: a null or empty text is its end token alone; null ids and repeated rows are packed as
any other; an empty table gives no rows; other columns are ignored; very long texts are cut, none of their ids is lost.
"""

from __future__ import annotations

import base64
import zlib
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillon.llm.common import text_of, written
from quillon.llm.tokencount import chunks

CAPACITY = 2048
END_ID = 0
#: Shares of the capacity: lengths above 1/8 are large. Groups of large pieces.
SMALL_SHARE = 8
GROUPS = 48
MOST_PIVOTS = 5_000
#: Salts a length is ranked in: one for so many pieces.
PIECES_PER_SALT = 5_000

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


@lru_cache(maxsize=2)
def encoder(path: str):
    """The byte-level BPE of a rank file, with the end-of-text string as the id behind the ranks."""
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={"<|endoftext|>": len(ranks)})


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each piece of each document."""

    def run(batches):
        import pyarrow as pa

        encode = encoder(path).encode
        for batch in batches:
            ids, texts = batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()
            for a, b in chunks(texts, 4 << 20):
                rows = []
                for doc_id, text in zip(ids[a:b], texts[a:b], strict=True):
                    tokens = np.array([*encode(text, allowed_special="all"), END_ID], "<u4")
                    cuts = [0, *range(len(tokens) % capacity or capacity, len(tokens) + 1, capacity)]
                    rows += [(doc_id, k, s, e - s, zlib.crc32(tokens[s:e])) for k, (s, e) in enumerate(zip(cuts, cuts[1:], strict=False))]
                columns = list(zip(*rows, strict=True))
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(columns, kinds, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return text_of(docs, id_col, text_col).mapInArrow(run, PIECES)


def best_configuration(sizes: np.ndarray, prices: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The multiset of sizes within the capacity that is worth most: (worth, number of each size)."""
    at = np.arange(capacity + 1)[:, None] - sizes  # the room left by a piece of each size
    worth, with_ = np.full(capacity + 1, -1.0), np.zeros((capacity + 1, 1))
    while (with_.max(1) > worth).any():  # one more piece each time
        worth = np.maximum(worth, with_.max(1))
        with_ = np.where(at >= 0, np.maximum(worth[at], 0) + prices, 0.0)
    used, room = np.zeros(len(sizes), np.int64), capacity
    while with_[room].max() > 0:
        j = int(with_[room].argmax())
        used[j] += 1
        room = int(at[room, j])
    return float(worth[capacity]), used


def configurations(sizes: list[int], counts: list[int], capacity: int) -> list[tuple[np.ndarray, int]]:
    """(number of each size, whole uses) by the fewest sequences, in fractions, that hold ``counts`` of ``sizes``.

    The simplex method over configurations: the basis begins with one configuration of each size alone."""
    if not sizes:
        return []
    size, want, m = np.array(sizes), np.array(counts, float), len(sizes)
    basis = np.diag(capacity // size).astype(float)
    inverse = np.diag(1 / (capacity // size))
    uses = inverse @ want
    for _ in range(MOST_PIVOTS):
        prices = inverse.sum(0)  # each configuration costs one sequence
        worth, used = best_configuration(size, np.maximum(prices, 0), capacity)
        if worth <= 1 + 1e-7:
            break
        step = inverse @ used
        with np.errstate(divide="ignore", invalid="ignore"):
            ratio = np.where(step > 1e-12, uses / step, np.inf)
        out = int(ratio.argmin())
        basis[:, out] = used
        pivot = inverse[out] / step[out]
        inverse -= np.outer(step, pivot)
        inverse[out] = pivot
        uses = inverse @ want
    return [(basis[:, j].astype(np.int64), n) for j, x in enumerate(uses) if (n := int(x + 1e-6)) > 0]


def grouped(counts: np.ndarray, groups: int) -> tuple[list[int], list[int]]:
    """Sizes, descending, and numbers of pieces of at most ``groups`` groups of equal cardinality, each as long as its longest piece."""
    total, done = int(counts.sum()), 0
    sizes: dict[int, list[int]] = {}  # by group: longest, pieces
    for length in np.flatnonzero(counts)[::-1].tolist():
        n = int(counts[length])
        while n:  # the groups' borders lie at equal shares of the pieces
            group = done * groups // total
            take = min(n, -(-(group + 1) * total // groups) - done)
            sizes.setdefault(group, [length, 0])[1] += take
            n, done = n - take, done + take
    return [x for x, _ in sizes.values()], [n for _, n in sizes.values()]


class _Plan:
    """Runs (length, first rank, n, first sequence, offset), and the room that sequences have left."""

    def __init__(self, capacity: int):
        self.capacity, self.runs, self.sequences = capacity, [], 0
        self.open: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]  # by room: (first sequence, n)

    def new(self, n: int) -> int:
        self.sequences += n
        return self.sequences - n

    def leave(self, first: int, n: int, room: int) -> None:
        if n and room:
            self.open[room].append((first, n))

    def place(self, length: int, rank: int, n: int, first: int, room: int) -> None:
        self.runs.append((length, rank, n, first, self.capacity - room))

    def best_fit(self, length: int, rank: int, n: int) -> None:
        """Pieces of one length, each where it leaves the least room."""
        room = length
        while n:
            while room <= self.capacity and not self.open[room]:
                room += 1
            if room > self.capacity:
                need = -(-n // (self.capacity // length))
                self.open[self.capacity].append((self.new(need), need))
                room = self.capacity
            first, many = self.open[room].pop()
            take = min(many, n)
            self.place(length, rank, take, first, room)
            self.leave(first, take, room - length)
            self.leave(first + take, many - take, room)
            rank, n, room = rank + take, n - take, max(length, room - length)


    def fill(self, sizes: list[int], times: int, left: np.ndarray, taken: np.ndarray) -> None:
        """At most ``times`` new sequences with places of the given sizes, longest first.

        ``left``, ``taken``: how many pieces of each length are over and how many have been placed, which is the next one's rank."""
        while times:
            chosen: list[int] = []
            room = self.capacity
            for k, size in enumerate(sizes):
                free = left[: (size if k < len(sizes) - 1 else room) + 1].copy()
                for x in chosen:
                    if x < len(free):
                        free[x] -= 1
                if len(at := np.flatnonzero(free)):
                    chosen.append(int(at[-1]))
                    room -= chosen[-1]
            if not chosen:
                return
            need = {x: chosen.count(x) for x in chosen}
            span = min(times, *(int(left[x]) // n for x, n in need.items()))  # as far as the same lengths are there
            first, room = self.new(span), self.capacity
            for x in chosen:
                self.place(x, int(taken[x]), span, first, room)
                left[x], taken[x], room = left[x] - span, taken[x] + span, room - x
            self.leave(first, span, room)
            times -= span


def plan(counts: np.ndarray, capacity: int = CAPACITY, groups: int = GROUPS) -> tuple[np.ndarray, int]:
    """Runs for ``counts[length]`` pieces, and the number of sequences."""
    p = _Plan(capacity)
    if n := int(counts[capacity]):
        p.place(capacity, 0, n, p.new(n), capacity)
    small = capacity // SMALL_SHARE
    left, taken = np.array(counts, np.int64), np.zeros(len(counts), np.int64)
    left[[*range(small + 1), capacity]] = 0
    sizes, many = grouped(left, groups)
    for used, times in sorted(configurations(sizes, many, capacity), key=lambda x: x[0].tolist(), reverse=True):
        p.fill([size for size, k in zip(sizes, used.tolist(), strict=True) for _ in range(k)], times, left, taken)
    for length in np.flatnonzero(left)[::-1].tolist():
        p.best_fit(length, int(taken[length]), int(left[length]))
    for length in range(small, 0, -1):
        if counts[length]:
            p.best_fit(length, 0, int(counts[length]))
    return np.array(p.runs, np.int64).reshape(-1, 5), p.sequences


def ranked(rows: DataFrame, n_rows: int) -> DataFrame:
    """``rank``: 0, 1, ... within each length, whatever share of all rows a length has."""
    salts = max(1, -(-n_rows // PIECES_PER_SALT))
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(salts)))
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    base = salted.groupBy("length", "salt").agg(F.count("*").alias("n")).select("length", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    own = F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32"))
    return salted.withColumn("own", own).join(base, ["length", "salt"]).withColumn("rank", F.col("base") + F.col("own") - 1).drop("salt", "own", "base")


def pack(docs: DataFrame, path: str, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each piece with its ``sequence_id`` and ``offset``."""
    rows = written(pieces(docs, path, capacity, id_col, text_col), "pieces")
    counts = np.zeros(capacity + 1, np.int64)
    for r in rows.groupBy("length").count().collect():  # at most `capacity` rows
        counts[r["length"]] = r["count"]
    runs, _ = plan(counts, capacity)
    runs = runs[np.lexsort((runs[:, 1], runs[:, 0]))]
    keys = runs[:, 0] << 44 | runs[:, 1]

    def place(batches):
        import pyarrow as pa

        for batch in batches:
            if not batch.num_rows:
                continue
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            run = runs[np.searchsorted(keys, length << 44 | rank, "right") - 1]
            kept = [batch.column(x) for x in ("doc_id", "piece", "start", "length", "ids_crc32")]
            placed = [pa.array(run[:, 3] + rank - run[:, 1]), pa.array(run[:, 4])]
            yield pa.RecordBatch.from_arrays([*kept, *placed], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return ranked(rows, int(counts.sum())).mapInArrow(place, f"{PIECES}, sequence_id long, offset long")
