"""Distinct word shingles of texts as 64-bit hashes, whole batches at a time in numpy."""

from __future__ import annotations

import numpy as np

LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
STEP = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A hash of each word in bytes ``raw``, and where it starts and ends.

    Bytes are read as 8-byte numbers from the start of a word on, masked at its end; a word's numbers
    are mixed one after another."""
    space = _SPACE[raw]
    edge = np.flatnonzero(np.diff(np.r_[True, space, True].astype(np.int8)))
    start, end = edge[::2], edge[1::2]
    padded = np.concatenate([raw, np.zeros(8, np.uint8)])
    eight = np.lib.stride_tricks.as_strided(padded, (len(raw) + 1, 8), (1, 1))
    out = np.zeros(len(start), np.uint64)
    live, k = np.arange(len(start)), 0
    while len(live):
        at, left = start[live] + k, end[live] - start[live] - k
        value = np.ascontiguousarray(eight[at]).view(np.uint64).ravel()
        short = np.maximum(0, 8 - left).astype(np.uint64) * np.uint64(8)
        value = np.where(short > 0, value & (np.uint64(0xFFFFFFFFFFFFFFFF) >> short), value)
        with np.errstate(over="ignore"):
            out[live] = mix(out[live] * np.uint64(3) + value + np.uint64(k + 1) * STEP)
        live, k = live[left > 8], k + 8
    with np.errstate(over="ignore"):
        return mix(out + (end - start).astype(np.uint64)), start, end


def shingle_sets(texts: list[str], n: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of every text, one after another, and each text's number of them.

    A text with fewer than ``n`` words has its whole sequence as its only shingle; one without words none."""
    data = [t.encode("utf-8", "replace").translate(LOWER) for t in texts]
    raw = np.frombuffer(b"\n".join(data) + b"\n", np.uint8)
    size = np.fromiter((len(d) + 1 for d in data), np.int64, len(data))
    ends = np.cumsum(size)
    h, at, _ = word_hashes(raw)
    doc = np.searchsorted(ends, at, "right")
    many = np.bincount(doc, minlength=len(data))
    first = np.cumsum(many) - many
    with np.errstate(over="ignore"):
        # the same word has another value in another place of the shingle
        place = np.arange(len(h)) - first[doc]
        have = np.minimum(many[doc] - place, n)
        total = np.zeros(len(h), np.uint64)
        for k in range(n):
            part = mix(h + np.uint64(k + 1) * STEP)
            total[: len(h) - k] += np.where(have[: len(h) - k] > k, part[k:], np.uint64(0))
        total = mix(total + have.astype(np.uint64))
    whole = (have == n) | ((place == 0) & (many[doc] < n))
    total, doc = total[whole], doc[whole]
    order = np.lexsort((total, doc))
    total, doc = total[order], doc[order]
    new = np.ones(len(total), bool)
    new[1:] = (total[1:] != total[:-1]) | (doc[1:] != doc[:-1])
    return total[new], np.bincount(doc[new], minlength=len(data))
