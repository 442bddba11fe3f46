"""Benchmark decontamination by the q-gram lemma and banded alignment.

Texts are compared letter by letter after lower-casing and turning each run of other characters into
one space. Benchmark items are cut into passages of ``PASSAGE`` and of ``SHORT`` letters, each beginning as many letters
after the one before as its edit budget (the last ends with the item); so a verbatim quote of ``SHORT`` letters and the
budget of such a passage, less one, holds a passage wherever it begins. A passage of m letters that occurs with at most e edits shares at least
m + 1 - q(e + 1) q-grams with the place where it occurs, on diagonals at most e apart. So q-grams that
a text shares with passages are counted in bands of 2e diagonals, each overlapping the next by e; bands
that reach the bound are kept, and aligned with the passage inside the band.
The edit budget is ``EDIT_RATE`` of a passage, lowered for short ones so that the bound stays at
``LEAST_SHARED``; passages under q + ``LEAST_SHARED`` letters must occur as they are, and items with
fewer than q letters are not searched for. Places of an item's passages that overlap are one region; every region is
a row, with the most edits of its passages and the letters of the longest.

The benchmark is the stated query set: it goes to the workers in blocks of about ``BLOCK_LETTERS``, each
against all documents, so that no broadcast grows with it. Documents are neither shuffled nor gathered.

Defined cases: null and empty texts match nothing; null ids are kept as null; repeated rows each match;
empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

import uuid
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import text_of
from quillon.llm.tokencount import chunks

Q = 9
PASSAGE = 110
SHORT = 55
EDIT_RATE = 0.1
LEAST_SHARED = 12
BLOCK_LETTERS = 250_000
SCAN = 1 << 20
PRIME = np.uint64(0x9E3779B97F4A7C15)
SPACE, GAP = 32, 0
MAP_BITS = 22
MASK = (1 << 40) - 1

MATCHES = "doc_id long, item_id long, start long, end long, edits int, passage_letters int"


@lru_cache(maxsize=1)
def letters_table() -> np.ndarray:
    """For each code point below 65536 its letter in lower case, or SPACE."""
    low = [chr(c).lower() for c in range(1 << 16)]
    return np.array([(ord(x) if len(x) == 1 else c) if chr(c).isalnum() else SPACE for c, x in enumerate(low)], np.uint32)


def letters(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Normalised letters, and the place of each in the text."""
    raw = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
    table = letters_table()
    code = table[np.minimum(raw, 0xFFFF)]
    if len(raw) and raw.max() > 0xFFFF:
        code = np.where(raw > 0xFFFF, raw, code)
    keep = code != SPACE
    keep[1:] |= code[:-1] != SPACE
    at = np.flatnonzero(keep)
    return code[at], at


def gram_hashes(code: np.ndarray, q: int = Q) -> np.ndarray:
    """A hash of the q letters from each place on."""
    n = len(code) - q + 1
    if n < 1:
        return np.zeros(0, np.uint64)
    power, have, out, done = {1: code.astype(np.uint64)}, 1, None, 0
    with np.errstate(over="ignore"):
        factor = {1: PRIME}
        while have * 2 <= q:  # hashes of 2, 4, 8, ... letters from those of half as many
            h = power[have]
            power[have * 2] = h[:-have] * factor[have] + h[have:]
            factor[have * 2] = factor[have] * factor[have]
            have *= 2
        for k in sorted(power, reverse=True):
            if q - done >= k:
                part = power[k][done : done + n]
                out = part if out is None else out * factor[k] + part
                done += k
        return (out ^ (out >> np.uint64(29))) * PRIME


def budgets(size: np.ndarray, q: int, rate: float) -> np.ndarray:
    """Edits that passages of such sizes may have."""
    return np.maximum(0, np.minimum((size * rate).astype(np.int64), (size + 1 - LEAST_SHARED) // q - 1))


def spread(values: np.ndarray, first: np.ndarray, many: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each value as often as ``many`` says, and the places from ``first`` on."""
    out = np.repeat(values, many)
    return out, np.repeat(first, many) + np.arange(len(out)) - np.repeat(np.cumsum(many) - many, many)


def among(keys: np.ndarray, some: np.ndarray) -> np.ndarray:
    """Which keys are among some sorted ones."""
    if not len(some):
        return np.zeros(len(keys), bool)
    return some[np.minimum(np.searchsorted(some, keys), len(some) - 1)] == keys


class Passages:
    """The index of a block of the benchmark."""

    def __init__(self, items: list[tuple[int, str]], q: int = Q, rate: float = EDIT_RATE, passage: int = PASSAGE):
        self.q = q
        self.code, self.item, grams, owner, place, letter, item_of, spot, n = [], [], [], [], [], [], [], [], 0
        for item_id, text in items:
            code, _ = letters(text or "")
            code = code[1:] if len(code) and code[0] == SPACE else code
            code = code[:-1] if len(code) and code[-1] == SPACE else code
            if len(code) < q:
                continue
            every = gram_hashes(code, q)
            grams.append(every)
            item_of.append(np.full(len(every), len(item_of)))
            spot.append(np.arange(len(every)))
            for size in sorted({min(len(code), passage), min(len(code), passage, SHORT)} if len(code) > SHORT else {min(len(code), passage)}):
                stride = max(1, int(budgets(np.array([size]), q, rate)[0]))
                for s in sorted({*range(0, len(code) - size + 1, stride), len(code) - size}):
                    owner.append(np.full(size - q + 1, len(self.code)))
                    place.append(np.arange(size - q + 1))
                    letter.append(n + s + place[-1])
                    self.code.append(code[s : s + size])
                    self.item.append(item_id)
            n += len(every)
        self.size = np.array([len(x) for x in self.code], np.int64)
        self.budget = budgets(self.size, q, rate)
        self.need = np.maximum(1, self.size + 1 - q * (self.budget + 1))
        if not self.code:
            return
        h = np.concatenate(grams)
        order = np.argsort(h, kind="stable")
        self.grams, self.first, self.many = np.unique(h[order], return_index=True, return_counts=True)
        self.letter = order  # of the items' q-grams one after another
        self.item_of, self.spot = np.concatenate(item_of), np.concatenate(spot)
        letter = np.concatenate(letter)
        order = np.argsort(letter, kind="stable")
        self.owner, self.place = np.concatenate(owner)[order], np.concatenate(place)[order]  # the passages of each letter
        self.held = np.bincount(letter, minlength=n)
        self.held_from = np.cumsum(self.held) - self.held
        self.longest = int(self.spot.max()) + 1
        self.seen = np.zeros(1 << MAP_BITS, bool)
        self.seen[self.grams >> np.uint64(64 - MAP_BITS)] = True
        self.span = int((self.size + self.budget).max()) + passage  # diagonals and bands moved up by it stay above zero
        self.least = int(self.need.min())

    def scan(self, code: np.ndarray) -> list[tuple[int, int, int, int]]:
        """(passage, start, end, edits) of the best place in each band that is near enough; ``code`` may hold GAPs."""
        h = gram_hashes(code, self.q)
        hit = np.flatnonzero(self.seen[h >> np.uint64(64 - MAP_BITS)])
        if not len(hit):
            return []
        row = np.minimum(np.searchsorted(self.grams, h[hit]), len(self.grams) - 1)
        real = self.grams[row] == h[hit]
        hit, row = hit[real], row[real]
        # places where enough shared q-grams of any passages lie near
        near = np.searchsorted(hit, hit + self.span) - np.searchsorted(hit, hit)
        dense = np.zeros(len(hit) + 1, np.int64)
        begin = np.flatnonzero(near >= self.least)
        np.add.at(dense, begin, 1)
        np.add.at(dense, begin + near[begin], -1)
        stay = np.cumsum(dense[:-1]) > 0
        hit, row = hit[stay], row[stay]
        if not len(hit):
            return []
        at, k = spread(hit, self.first[row], self.many[row])
        letter = self.letter[k]
        # a passage that is near enough has all it needs in a band of its item's diagonals
        wide = max(1, int(self.budget.max()))
        band = (at - self.spot[letter] + self.longest) // wide + 1
        both = np.sort(np.concatenate([band << 32 | letter, (band - 1) << 32 | letter]))
        both = both[np.r_[True, both[1:] != both[:-1]]]
        both = np.sort((both >> 32) << 32 | self.item_of[both & 0xFFFFFFFF])
        begin = np.flatnonzero(np.r_[True, both[1:] != both[:-1]])
        full = both[begin][np.diff(np.r_[begin, len(both)]) >= self.least]
        item = self.item_of[letter]
        stay = among(band << 32 | item, full) | among((band - 1) << 32 | item, full)
        at, letter = at[stay], letter[stay]
        if not len(at):
            return []
        at, k = spread(at, self.held_from[letter], self.held[letter])
        owner, place = self.owner[k], self.place[k]
        diagonal = at - place
        out, exact = [], []
        lines, count = np.unique(owner << 40 | (diagonal + self.span), return_counts=True)
        for i in np.flatnonzero(count > self.size[lines >> 40] - self.q):  # all q-grams: the passage as it is
            p, d = int(lines[i] >> 40), int(lines[i] & MASK) - self.span
            if d >= 0 and np.array_equal(code[d : d + self.size[p]], self.code[p]):
                out.append((p, d, d + int(self.size[p]), 0))
                band = (d + self.span) // max(1, int(self.budget[p]))
                exact += [p << 28 | band, p << 28 | (band - 1)]
        # places of a passage whose q-gram is in a band, each once: repetitive texts hold the same ones again and again
        band = (diagonal + self.span) // np.maximum(1, self.budget[owner])
        both = np.concatenate([owner << 40 | band << 12 | place, owner << 40 | (band - 1) << 12 | place])
        keys, shared = np.unique(np.unique(both) >> 12, return_counts=True)
        keys = keys[shared >= self.need[keys >> 28]]
        keys = keys[~np.isin(keys, np.array(exact, np.int64))]
        owner, band = keys >> 28, keys & ((1 << 28) - 1)
        shape = self.size[owner] << 32 | self.budget[owner]
        for x in np.unique(shape):
            own = owner[shape == x]
            out += self.align(own, code, band[shape == x] * int(max(1, self.budget[own[0]])) - self.span)
        return out

    def align(self, owner: np.ndarray, code: np.ndarray, low: np.ndarray) -> list[tuple[int, int, int, int]]:
        """Banded alignment of passages of one length from the diagonals ``low`` on, a row of the tables at a time."""
        e, size, out = int(self.budget[owner[0]]), int(self.size[owner[0]]), []
        width = 2 * max(1, e) + 2 * e  # the path may leave the band by as much as the budget
        j = np.arange(width)
        for a in range(0, len(low), 512):
            own, base = owner[a : a + 512], (low[a : a + 512] - e)[:, None]
            n = len(own)
            passage = np.stack([self.code[p] for p in own])
            cost = np.zeros((n, width), np.int64)  # starts anywhere in the band at no cost
            origin = j + base
            far, last = np.full((n, 1), 10**6), len(code) - 1
            for i in range(size):
                where = base + (j + i)
                there = code[np.clip(where, 0, last)]
                step = cost + (there != passage[:, i : i + 1])  # on the diagonal
                step[(where < 0) | (where > last) | (there == GAP)] = 10**6  # not into another text
                up = np.concatenate([cost[:, 1:] + 1, far], 1)  # a letter of the passage left out
                take = up < step
                best = np.where(take, up, step)
                begin = np.where(take, np.concatenate([origin[:, 1:], origin[:, :1]], 1), origin)
                # letters put in: each cell from the best to its left
                left = np.minimum.accumulate((best - j) * width + j, 1)
                cost = left // width + j
                origin = np.take_along_axis(begin, left % width, 1)
            end = np.argmin(cost, 1)
            edits = cost[np.arange(n), end]
            for r in np.flatnonzero(edits <= e):
                out.append((int(own[r]), int(max(0, origin[r, end[r]])), int(base[r, 0] + end[r] + size), int(edits[r])))
        return out


def matches(docs: DataFrame, benchmark: DataFrame, q: int = Q, rate: float = EDIT_RATE, id_col: str = "doc_id", text_col: str = "text",
    item_id_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The regions of each document that hold passages of an item: ``start`` and ``end`` are code points of the text."""
    spark = docs.sparkSession
    items = benchmark.select(F.col(item_id_col).cast("long").alias("item_id"), F.col(item_text_col).cast("string").alias("text")).where("text is not null")
    total = items.agg(F.sum(F.char_length("text"))).first()[0] or 0
    blocks = max(1, -(-total // BLOCK_LETTERS))
    found = None
    for b in range(blocks):
        block = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b).collect()
        part = _scan(docs, spark.sparkContext.broadcast([tuple(r) for r in block]), q, rate, id_col, text_col)
        found = part if found is None else found.unionByName(part)
    return found


#: A worker's index of the last block of items that it saw, by a key of the block.
_kept: dict[str, Passages] = {}


def _index(key: str, items: list, q: int, rate: float) -> Passages:
    """The index of a block's passages, built once in each worker."""
    if key not in _kept:
        _kept.clear()
        _kept[key] = Passages(items, q, rate)
    return _kept[key]


def _scan(docs: DataFrame, items, q: int, rate: float, id_col: str, text_col: str) -> DataFrame:
    key = uuid.uuid4().hex

    def run(batches):
        import pyarrow as pa

        passages = _index(key, items.value, q, rate)
        for batch in batches:
            rows: list[tuple] = []
            if passages.code and batch.num_rows:
                ids, texts = batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()
                for a, b in chunks(texts, SCAN):
                    rows += scan_texts(passages, ids[a:b], texts[a:b])
            columns = list(zip(*rows, strict=True)) or [()] * 6
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(columns, kinds, strict=True)], ["doc_id", "item_id", "start", "end", "edits", "passage_letters"])

    return text_of(docs, id_col, text_col).mapInArrow(run, MATCHES)


def scan_texts(passages: Passages, ids: list, texts: list[str]) -> list[tuple]:
    """(doc_id, item_id, start, end, edits, passage letters): the regions of an item in each text."""
    out: list[tuple] = []
    found = [letters(t) for t in texts]
    sizes = np.array([len(c) + 1 for c, _ in found])
    starts = np.cumsum(sizes) - sizes
    code = np.full(int(sizes.sum()), GAP, np.uint32)
    for s, (c, _) in zip(starts, found, strict=True):
        code[s : s + len(c)] = c
    places: dict[tuple[int, int], set] = {}
    overlap = 2 * getattr(passages, "span", 0) + passages.q
    for s in range(0, len(code), SCAN):
        begin = max(0, s - overlap)
        for p, first, last, edits in passages.scan(code[begin : s + SCAN]):
            doc = int(np.searchsorted(starts, begin + last - 1, "right")) - 1
            places.setdefault((doc, passages.item[p]), set()).add((begin + first, begin + last, edits, int(passages.size[p])))
    for (doc, item), some in sorted(places.items(), key=lambda x: x[0]):
        at = found[doc][1]
        for first, last, edits, size in regions(some):
            a, b = int(min(max(0, first - starts[doc]), len(at) - 1)), int(min(last - starts[doc], len(at)))
            out.append((ids[doc], item, int(at[a]), int(at[max(a, b - 1)]) + 1, edits, size))
    return out


def regions(places: set[tuple[int, int, int, int]]) -> list[list[int]]:
    """Places (start, end, edits, letters) with those that overlap as one: the most edits, the most letters."""
    out: list[list[int]] = []
    for first, last, edits, size in sorted(places):
        if out and first < out[-1][1]:
            out[-1][1:] = [max(out[-1][1], last), max(out[-1][2], edits), max(out[-1][3], size)]
        else:
            out.append([first, last, edits, size])
    return out


def clean(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that hold no benchmark passage, with all their columns; null ids are kept (nothing can name them)."""
    hit = matches(docs, benchmark, id_col=id_col, text_col=text_col).select(F.col("doc_id").alias("_leak")).distinct()
    return docs.join(hit, F.col(id_col).cast("long") == F.col("_leak"), "left_anti")
