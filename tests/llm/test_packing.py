"""Packing: every piece once, gapless, near the bound."""

from __future__ import annotations

import zlib
from collections import defaultdict

import numpy as np
from helpers import AWKWARD, clashing, docs

from quillon.llm import packing
from quillon.llm.common import table
from quillon.llm.vocabularies import vocabulary_path

PATH = vocabulary_path("byte_bpe_50k.tiktoken")


def test_plan_places_every_rank_once():
    rng = np.random.default_rng(7)
    for _ in range(150):
        capacity = int(rng.integers(8, 60))
        counts = rng.integers(0, rng.integers(1, 30), capacity + 1) * (rng.random(capacity + 1) < rng.random())
        counts[0] = 0
        runs, n = packing.plan(counts, capacity, int(rng.integers(1, 20)))
        seen, at = set(), defaultdict(list)
        for length, rank, many, first, offset in runs.tolist():
            for k in range(many):
                assert (length, rank + k) not in seen
                seen.add((length, rank + k))
                at[first + k].append((offset, length))
        assert len(seen) == counts.sum() and len(at) == n
        for placed in at.values():
            end = 0
            for offset, length in sorted(placed):
                assert offset == end
                end += length
            assert end <= capacity


def test_groups_are_few_and_of_equal_cardinality():
    counts = np.random.default_rng(2).integers(0, 40, 2049)
    sizes, many = packing.grouped(counts, packing.GROUPS)
    assert len(sizes) == packing.GROUPS <= 64 and sorted(sizes, reverse=True) == sizes
    assert sum(many) == counts.sum() and max(many) - min(many) <= 1
    assert np.all(np.cumsum(many) <= [counts[x:].sum() for x in [*sizes[1:], 0]])  # no piece is longer than its group's size
    assert packing.grouped(np.zeros(5, int), 3) == ([], []) and packing.grouped(np.array([0, 0, 7]), 3) == ([2, 2, 2], [3, 2, 2])


def test_best_configuration_by_brute_force():
    from itertools import product

    rng = np.random.default_rng(3)
    for _ in range(60):
        capacity, m = int(rng.integers(5, 30)), int(rng.integers(1, 5))
        sizes, prices = rng.integers(1, capacity + 1, m), rng.random(m).round(2)
        worth, used = packing.best_configuration(sizes, prices, capacity)
        best = max(np.dot(k, prices) for k in product(*(range(capacity // s + 1) for s in sizes)) if np.dot(k, sizes) <= capacity)
        assert abs(worth - best) < 1e-9 and np.dot(used, sizes) <= capacity and abs(np.dot(used, prices) - best) < 1e-9


def test_configurations_are_optimal():
    """Halves, thirds and sixths fill whole sequences; no whole use is missing."""
    got = packing.configurations([30, 20, 10], [200, 300, 600], 60)
    assert sum(n for _, n in got) == 300 and all(np.dot(used, [30, 20, 10]) == 60 for used, _ in got)
    # 7 + 4 + 4 = 15 and 5 + 5 + 5 = 15 leave nothing; the longest first alone would waste
    got = packing.configurations([7, 5, 4], [100, 300, 200], 15)
    assert sum(n for _, n in got) == 200


def test_plan_is_near_the_bound():
    rng = np.random.default_rng(1)
    counts = np.bincount(np.minimum(2048, rng.lognormal(6.5, 0.9, 50_000).astype(int) + 1), minlength=2049)
    runs, n = packing.plan(counts)
    assert n <= 1.003 * -(-int((counts * np.arange(2049)).sum()) // 2048)
    assert len(runs) < 20_000
    # without small pieces the sum of lengths is out of reach, and what rounding wastes can't be filled: a few per cent over best fit alone
    counts = np.bincount(rng.integers(300, 2049, 50_000), minlength=2049)
    alone = packing._Plan(2048)
    for length in range(2048, 0, -1):
        alone.best_fit(length, 0, int(counts[length]))
    assert packing.plan(counts)[1] <= 1.04 * alone.sequences
    # lengths just over a third, of which only two go together
    third = np.zeros(2049, int)
    third[700] = 1001
    assert packing.plan(third)[1] == 501


def test_pack_against_the_library(spark, sf_dir):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(vocabulary_path("byte_bpe_50k.json"))
    rows = AWKWARD + [(50, "a<|endoftext|>b"), (51, "\u0085 \u3000x\u200b  'S's 12½")] + [(1000 + r["doc_id"], r["text"]) for r in table(spark, sf_dir, "documents").collect()]
    got = packing.pack(clashing(docs(spark, rows)), PATH).collect()
    want = []
    for doc_id, text in rows:
        ids = np.array([*library.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        start = len(ids) % 2048 or 2048
        cuts = [0, *range(start, len(ids) + 1, 2048)]
        want += [(doc_id, k, a, b - a, zlib.crc32(ids[a:b].tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))]
    key = lambda x: (x[0] is not None, *((x[0] or 0), *x[1:]))
    assert sorted(map(lambda r: tuple(r)[:5], got), key=key) == sorted(want, key=key)
    ends = defaultdict(int)
    for r in sorted(got, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == ends[r["sequence_id"]]
        ends[r["sequence_id"]] += r["length"]
    assert max(ends.values()) <= 2048
    assert packing.pack(docs(spark, []), PATH).count() == 0
