"""Near duplicates against all pairs."""

from __future__ import annotations

import random
import re

import numpy as np
import pytest
from helpers import AWKWARD, clashing, docs

from quillon.llm import neardup, shingles
from quillon.llm.common import table


def brute_set(text, n):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


def brute_components(rows, n):
    sets: dict = {}
    for i, t in rows:
        if i is not None:
            sets.setdefault(i, []).append(brute_set(t, n))
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            for x in sets[a]:
                for y in sets[b]:
                    if x and y and 100 * len(x & y) >= 80 * len(x | y):
                        p, q = find(a), find(b)
                        root[max(p, q)] = min(p, q)
    return {i: find(i) for i in ids}


def test_shingle_sets_are_the_brute_ones():
    random.seed(2)
    texts = ["".join(random.choices(["a", "B", "word", "longerthaneightbytes", " ", "\n", "\t ", "é", "\x0b", " ", "漢字漢字漢字"], k=random.randint(0, 40))) for _ in range(300)]
    texts += ["", "abcdefgh abcdefgh", "abcdefghi", "a b c d", "a b c d e", "b a", "a b", " \x00 \x00\x00"]
    for n in (1, 4, 5):
        values, many = shingles.shingle_sets(texts, n)
        want = [brute_set(t, n) for t in texts]
        assert many.tolist() == [len(x) for x in want]
        names: dict = {}
        at = np.cumsum(many) - many
        for x, a, k in zip(want, at, many, strict=True):
            got = set(values[a : a + k].tolist())
            for y in x:
                names.setdefault(y, got & names.get(y, got))
        pool = {v for x in names.values() for v in x}
        assert len(pool) >= len(names)
        assert len(set(values.tolist())) == len(set().union(*want))


def copies(seed, n_base, n_copies, change):
    random.seed(seed)
    vocabulary = [f"w{k}" for k in range(400)]
    rows, i = [], 0
    for _ in range(n_base):
        base = random.choices(vocabulary, k=random.randint(30, 90))
        for _ in range(n_copies):
            x = list(base)
            for _ in range(random.randint(0, change)):
                x[random.randrange(len(x))] = random.choice(vocabulary)
            rows.append((i, " ".join(x)))
            i += 1
    random.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed,bases,many,change", [(1, 4, 60, 4), (2, 40, 4, 5)])
def test_components_against_all_pairs(spark, seed, bases, many, change):
    rows = copies(seed, bases, many, change)
    got = neardup.near_duplicates(docs(spark, rows), shingle=4).collect()
    want = brute_components(rows, 4)
    assert {r["doc_id"]: r["component_id"] for r in got} == want
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)


def test_blocks_find_links_past_both_centres(spark, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK", 200)
    monkeypatch.setattr(neardup, "SLICE", 500)
    rows = copies(7, 1, 90, 6)
    got = {r["doc_id"]: r["component_id"] for r in neardup.near_duplicates(docs(spark, rows), shingle=4).collect()}
    assert got == brute_components(rows, 4)


@pytest.mark.parametrize("shared,percent", [(120, 80), (135, 80), (60, 50)])
def test_a_block_gives_the_links_of_all_pairs(shared, percent):
    """Members of one bucket that share a passage, some of which are alike enough."""
    import pyarrow as pa

    rng = np.random.default_rng(shared)
    passage = rng.integers(1, 1 << 60, shared)
    sets = [np.unique(np.r_[rng.permutation(passage)[: shared - rng.integers(0, 12)], rng.integers(1, 1 << 60, rng.integers(1, 45))]) for _ in range(80)]
    head = np.arange(80) % 3 == 0
    n = len(sets)
    group = pa.table({"bucket": np.zeros(n, np.int64), "id": np.arange(n) + 5, "component": np.where(np.arange(n) % 10 == 0, 0, np.arange(n)), "head": head,
        "bands": [[0, 1]] * n, "shingles": [x.tolist() for x in sets]})
    got = set(zip(*neardup._compare(group, percent), strict=True))
    want = set()
    for i in np.flatnonzero(head):
        for j in np.flatnonzero(~head):
            both = len(np.intersect1d(sets[i], sets[j]))
            if group["component"][i] != group["component"][j] and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                want.add((min(i, j) + 5, max(i, j) + 5))
    assert got == want and want
    assert neardup._compare(group.set_column(0, "bucket", pa.array([1] * n)), percent) == ([], [])


def test_awkward_rows(spark, sf_dir):
    rows = AWKWARD + [(60, "A b"), (61, "a  B"), (62, None)] + [(1000 + r["doc_id"], r["text"]) for r in table(spark, sf_dir, "documents").collect()]
    got = neardup.near_duplicates(clashing(docs(spark, rows)), shingle=4).collect()
    assert len(got) == len(rows)
    want = brute_components(rows, 4)
    assert all(r["component_id"] == want.get(r["doc_id"]) for r in got)
    assert sorted((r["doc_id"] or 0, r["n_shingles"]) for r in got) == sorted((i or 0, len(brute_set(t, 4))) for i, t in rows)
    assert all(r["kept"] for r in got if r["doc_id"] is None or r["n_shingles"] == 0)


def test_empty(spark):
    assert neardup.near_duplicates(docs(spark, [])).count() == 0
    assert neardup.near_duplicates(docs(spark, [(1, None), (2, "")])).count() == 2


def test_components_of_a_long_chain(spark):
    n = 200
    order = list(range(n))
    random.Random(3).shuffle(order)
    links = spark.createDataFrame([(order[k], order[k + 1]) for k in range(n - 1)], "a long, b long")
    got = neardup.components(links).collect()
    assert {r["id"]: r["component"] for r in got} == dict.fromkeys(range(n), 0)
