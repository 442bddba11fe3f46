"""Toxicity and language-model scores: parts against plain code, the whole on held-out rows."""

from __future__ import annotations

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from helpers import AWKWARD, clashing, docs

from quillon.llm import lm, toxicity
from quillon.llm.common import table

LOW = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def plain_segments(s, at=0):
    """All maximal segments by their definition: the best one (shortest, first), then those left and right of it."""
    best = max(((sum(s[i:j]), i - j, -i, i, j) for i in range(len(s)) for j in range(i + 1, len(s) + 1)), default=(0,))
    if best[0] <= 0:
        return []
    _, _, _, i, j = best
    return [*plain_segments(s[:i], at), (at + i, at + j, best[0]), *plain_segments(s[j:], at + j)]


def test_maximal_segments():
    random.seed(1)
    for _ in range(400):
        s = [random.choice([-3.5, -1.25, -0.5, 0.75, 2.0, 1.125]) + random.random() / 1000 for _ in range(random.randint(0, 14))]
        got = [(a, b, round(x, 6)) for a, b, x in toxicity.segments_of(s)]
        assert got == [(a, b, round(x, 6)) for a, b, x in plain_segments(s)]


def test_root():
    p, s = np.array([0.75, 0.25]), np.array([-1.0, 1.0])
    assert toxicity.positive_root(p, s) == pytest.approx(math.log(3), abs=1e-6)


def test_toxicity_held_out(spark):
    docs_, labels = (table(spark, "/root/testdata/sf0.1", n) for n in ("documents", "labels"))
    known = {r["doc_id"]: r["toxic"] for r in labels.collect()}
    model = toxicity.fit(docs_, labels)
    few = docs_.join(labels.select("doc_id"), "doc_id", "left_semi")
    held = [(r["score"], known[r["doc_id"]]) for r in toxicity.score(few, model).collect() if zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0]
    assert sum((s >= 0.5) == (y == 1) for s, y in held) / len(held) > 0.94
    toxic, other = sorted(s for s, y in held if y), sorted(s for s, y in held if not y)
    assert sum(np.searchsorted(other, t) for t in toxic) / (len(toxic) * len(other)) > 0.955
    assert model.weights[1] > 0 and model.weights[2] > 0  # more evidence, more toxic
    text = {r["doc_id"]: r["text"] for r in few.collect()}
    for r in toxicity.passages(few, model).limit(50).collect():
        assert r["passage"] in text[r["doc_id"]].lower() or r["passage"] in text[r["doc_id"]]
        assert len(r["passage"].encode().split()) == r["end"] - r["start"]


def plain_toxicity(rows, labels):
    """Scores of (id, text) rows by the definition, with words and prefixes themselves in place of buckets."""
    fold = lambda i: zlib.crc32(str(i).encode()) % 5
    parts = lambda w: [w, *(("prefix", k, w[:k]) for k in toxicity.PREFIXES if len(w) > k)]
    split = lambda t: t.encode().translate(LOW).split()

    def table(which):
        n = [Counter(), Counter()]
        for i, t in which:
            n[labels[i]].update(p for w in split(t) for p in parts(w))
        total = [sum(c.values()) for c in n]
        out = {}
        for p in n[0] | n[1]:
            prior = toxicity.PRIOR * (n[0][p] + n[1][p]) / sum(total)
            a, b = n[1][p] + prior, n[0][p] + prior
            delta = math.log(a / (total[1] + toxicity.PRIOR - a)) - math.log(b / (total[0] + toxicity.PRIOR - b))
            out[p] = math.copysign(max(0.0, abs(delta) - toxicity.DOUBT * math.sqrt(1 / a + 1 / b)), delta)
        return out

    words = lambda t, of: [max((of.get(p, 0.0) for p in parts(w)), key=abs) - toxicity.DRIFT for w in split(t)]
    train = [(i, t) for i, t in rows if i in labels and fold(i)]
    halves = [[r for r in train if (fold(r[0]) > 2) == bool(h)] for h in (0, 1)]
    seen = [(labels[i], words(t, of)) for h, of in ((0, table(halves[1])), (1, table(halves[0]))) for i, t in halves[h]]
    levels = [min(20.0, max(-10.0, round(x * 20) / 20)) for y, s in seen if not y for x in s]
    low, high = 1e-4, 20.0
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (low, mid) if sum(math.exp(mid * x) for x in levels) > len(levels) else (mid, high)
    calm = [(max((x for *_, x in plain_segments(s)), default=0.0), len(s)) for y, s in seen if not y and s]
    k = math.exp(sum(low * b - math.log(n) for b, n in calm) / len(calm) - 0.5772)

    def features(s):
        e = sorted((k * max(1, len(s)) * math.exp(-low * x) for *_, x in plain_segments(s)))
        p = [-math.log(1 - math.exp(-x)) for x in e]
        return [1.0, math.log1p(sum(p[:1])), math.log1p(sum(v for v, x in zip(p[1:], e[1:], strict=True) if x < toxicity.EVIDENCE_EXPECTED)), math.log(max(1, len(s)))]

    x, y = np.array([features(s) for _, s in seen]), np.array([v for v, _ in seen])
    w = np.zeros(4)
    for _ in range(2000):  # plain gradient steps scaled by the curvature
        p = 1 / (1 + np.exp(-x @ w))
        w += np.linalg.lstsq((x * (p * (1 - p))[:, None]).T @ x + 0.01 * np.eye(4), x.T @ (y - p) - 0.01 * w, rcond=None)[0] * 0.5
    all_ = table(train)
    return {i: float(1 / (1 + np.exp(-np.dot(features(words(t, all_)), w)))) for i, t in rows}, w


def test_toxicity_against_plain_code(spark):
    rng = random.Random(3)
    calm, foul = [f"word{i}x" for i in range(30)], ["vile", "nastyish", "horrid", "loathsome"]
    rows = [(i, " ".join(rng.choices(calm, k=rng.randint(0, 12)) + (rng.choices(foul, k=2) if i % 3 == 0 else []) + rng.choices(calm, k=4))) for i in range(240)]
    labels = {i: int(i % 3 == 0) ^ (rng.random() < 0.05) for i, _ in rows[:200]}
    want, weights = plain_toxicity(rows, labels)
    model = toxicity.fit(docs(spark, rows), spark.createDataFrame(list(labels.items()), "doc_id long, toxic int"))
    assert model.weights == pytest.approx(weights.tolist(), rel=2e-3, abs=2e-3)
    got = {r["doc_id"]: r["score"] for r in toxicity.score(docs(spark, rows), model).collect()}
    assert got == pytest.approx(want, abs=2e-3)


def test_toxicity_awkward(spark):
    frame = clashing(docs(spark, AWKWARD))
    labels = spark.createDataFrame([(i, None if i == 4 else i % 2) for i in range(1, 30)], "doc_id long, toxic int")
    got = toxicity.report(frame, labels).collect()
    assert len(got) == len(AWKWARD) and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got)
    assert toxicity.report(frame, labels.where("false")).select("score").distinct().collect() == [(0.0,)]
    assert toxicity.report(docs(spark, []), labels).count() == 0


def tokens(text):
    return [*(text or "").encode().translate(LOW).split(), None]


def plain_model(rows):
    """Exact counts of the training texts: words, bigrams, trigrams (which begin behind two ends)."""
    count, pairs, triples = Counter(), Counter(), Counter()
    for i, t in rows:
        if zlib.crc32(("" if i is None else str(i)).encode()) % 5 != 1:
            w = tokens(t)
            count.update(w)
            pairs.update(zip([None, *w], w, strict=False))
            triples.update(zip([None, None, *w], [None, *w], w, strict=False))
    return count, pairs, triples


def quantised(c):
    return float(lm.level_values()[np.searchsorted(lm.levels(), c, "right")])


def plain_score(text, count, pairs, triples):
    """log10 probability by the smoothed trigram model over quantised counts."""
    n, v, total = sum(count.values()), len(count), 0.0
    a, b = "start", None
    for w in tokens(text):
        p = (count[w] + 0.5) / (n + 0.5 * (v + 1))
        if count[b]:
            p = lm.WEIGHT * min(quantised(pairs[b, w]), count[b]) / count[b] + (1 - lm.WEIGHT) * p
        deep = 0.0 if a == "start" else quantised(pairs[a, b])
        if deep:
            p = lm.WEIGHT * min(quantised(triples[a, b, w]), deep) / deep + (1 - lm.WEIGHT) * p
        total += math.log10(p)
        a, b = b, w
    return total


def corpus(spark, sf_dir, size):
    return AWKWARD + ([(100 + r["doc_id"], r["text"]) for r in table(spark, sf_dir, "documents").collect()] if size == "all" else [])


@pytest.mark.parametrize("size", ["awkward", "all"])
def test_lm_base_is_exact_and_score_is_the_model_s(spark, sf_dir, size):
    rows = corpus(spark, sf_dir, size)
    count, pairs, triples = plain_model(rows)
    n, v = sum(count.values()), len(count)
    want = Counter()
    for i, t in rows:
        w = tokens(t)
        own = [(count[k] + 0.5) / (n + 0.5 * (v + 1)) for k in w]
        want[(i, len(w), sum(count[k] > 0 for k in w), n, round(sum(map(math.log10, own)), 4), round(plain_score(t, count, pairs, triples), 4))] += 1
    # with 64 bits an entry hardly a false positive is left, so that the plain model must come out
    found = lm.score(clashing(docs(spark, rows)), bits_each=64).collect()
    got = Counter((r["doc_id"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 4), round(r["score"], 4)) for r in found)
    assert sum((got & want).values()) >= len(rows) - 2  # one probe chain in a million may go too far


def test_lm_score_with_production_bits(spark, sf_dir):
    rows = corpus(spark, sf_dir, "all")
    model = plain_model(rows)
    want = {i: plain_score(t, *model) for i, t in rows if i is not None}
    off = [abs(r["score"] - want[r["doc_id"]]) / abs(want[r["doc_id"]]) for r in lm.score(docs(spark, rows)).collect() if r["doc_id"] is not None]
    assert max(off) < 0.05 and sum(off) / len(off) < 0.003


def test_filter_holds_counts():
    rng = np.random.default_rng(5)
    parts = 7
    bits = lm.key_bits(parts)
    keys = np.unique(rng.integers(0, 2**bits, 20_000).astype(np.uint64))
    counts = np.minimum(rng.zipf(1.6, len(keys)), 10**6)
    part = lm.part_of(keys, parts, bits)
    f = lm.Filter({p: lm.segment(keys[part == p], counts[part == p]).tobytes() for p in range(parts) if (part == p).any()}, parts)
    want = np.searchsorted(lm.levels(), counts, "right")
    got = f.levels(keys)
    assert (got >= want).all() and (got != want).mean() < 0.012
    assert (f.levels(rng.integers(0, 2**bits, 20_000).astype(np.uint64)) > 0).mean() < 0.012
    some = lm.Filter({2: lm.segment(keys[part == 2], counts[part == 2]).tobytes()}, parts)
    assert (some.levels(keys)[part != 2] == 0).all() and (some.levels(keys)[part == 2] >= want[part == 2]).all()


def test_lm_empty(spark):
    assert lm.score(docs(spark, [])).count() == 0
    only_held_out = next(i for i in range(99) if zlib.crc32(str(i).encode()) % 5 == 1)
    assert lm.score(docs(spark, [(only_held_out, "a b")])).select("n_tokens", "n_known", "train_tokens").collect() == [(3, 0, 0)]


def test_lm_scores_do_not_depend_on_passes_and_chunks(spark, sf_dir, monkeypatch):
    frame = docs(spark, corpus(spark, sf_dir, "all"))
    want = Counter(map(tuple, lm.score(frame).collect()))
    monkeypatch.setattr(lm, "CHUNK", 1 << 14)
    for piece, most in ((100_000, 4 << 30), (100_000, 100_000), (100_000, 400_000)):
        assert Counter(map(tuple, lm.score(frame, piece=piece, most=most).collect())) == want


def test_lm_packing_of_keys():
    rng = np.random.default_rng(2)
    for n, most in ((1, 1 << 40), (2, 5), (500, 1 << 20), (500, 1 << 38), (500, 1 << 62), (3, 1 << 63)):
        keys = np.unique(rng.integers(0, most, n).astype(np.uint64))
        assert (lm.unpacked(lm.packed(keys), len(keys)) == keys).all()


def test_lm_pieces():
    sizes = [(k, p, 10 * (k + 1)) for k in (lm.WORDS, lm.PAIRS, lm.TRIPLES) for p in range(4)]
    assert lm.pieces_of([], 50) == [[]] and lm.pieces_of(sizes, 1000) == [[(k, p) for k in (2, 1, 0) for p in range(4)]]
    plan = lm.pieces_of(sizes, 50)
    size = {(k, p): s for k, p, s in sizes}
    assert [x for p in plan for x in p] == lm.pieces_of(sizes, 1000)[0] and all(sum(size[x] for x in p) <= 50 for p in plan)
    assert lm.pieces_of(sizes, 1) == [[x] for x in lm.pieces_of(sizes, 1000)[0]]
