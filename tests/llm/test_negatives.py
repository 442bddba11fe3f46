"""Hard negatives against plain code, with awkward rows, ties and small blocks."""

from __future__ import annotations

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.llm import negatives

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, every=100):
    ok = [(i, [math.floor(256 * x) for x in v], y) for i, v, y in rows if i is not None and y is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    dot = lambda a, b: sum(p * q for p, q in zip(a, b, strict=False))
    out = Counter()
    for i, v, y in ok:
        if i % every:
            continue
        alike = sorted((-dot(v, w), j) for j, w, z in ok if z == y and j != i)[: negatives.POSITIVES]
        others = sorted((-dot(v, w), j) for j, w, z in ok if z != y)
        for s, p in alike:
            inside = [(t, j) for t, j in others if 30 * -s <= 100 * -t <= 90 * -s][: negatives.NEGATIVES]
            out.update((i, p, k + 1, j, -s, -t) for k, (t, j) in enumerate(inside))
    return out


def mined(spark, rows, **kw):
    return Counter(map(tuple, negatives.mine(spark.createDataFrame(rows, SCHEMA), **kw).collect()))


@pytest.fixture
def small_blocks(monkeypatch):
    monkeypatch.setattr(negatives, "ANCHORS", 4)
    monkeypatch.setattr(negatives, "ROWS", 16)
    monkeypatch.setattr(negatives, "DIMS", 3)
    monkeypatch.setattr(negatives, "HELD", 200)


def awkward():
    random.seed(3)
    f = lambda n=7: [float(np.float32(random.choice((random.uniform(-1, 1), 0.25, 0.5)))) for _ in range(n)]
    rows = [(i, f(), 0 if random.random() < 0.4 else random.randrange(1, 5)) for i in range(301)]
    rows += [(400, f(), None), (401, None, 1), (402, [None, *f(6)], 1), (403, [float("nan"), *f(6)], 1), (404, [float("inf"), *f(6)], 0), (None, f(), 0)]
    rows += [(405, [], 0), (500, [], 1), (406, f(3), 0), (600, f(2), 2), (700, f(), 99)]
    rows += [rows[0], rows[7], rows[7], rows[100]] + [(800 + k, rows[200][1], rows[200][2]) for k in range(12)] + [(850 + k, rows[200][1], 3) for k in range(12)]
    return rows


def test_against_plain_code(spark, small_blocks):
    rows = awkward()
    want = brute(rows)
    assert len(want) > 100 and mined(spark, rows) == want
    assert mined(spark, rows, panel=2) == want  # anchors in several panels


def test_wide_values_and_other_anchors(spark, small_blocks):
    random.seed(5)
    rows = [(i, [float(np.float32(random.uniform(-1, 1) * 2.0 ** random.choice((0, 8, 17)))) for _ in range(5)], i % 3) for i in range(90)]
    assert mined(spark, rows, anchor=F.col("id") % 10 == 0) == brute(rows, 10)
    far = [(0, [3e38, 1.0], 0), (1, [3e38, -1.0], 0), (2, [2.5e6, 1e6], 1)]
    assert mined(spark, far) == mined(spark, far)  # clamped, and no overflow


def test_empty_tables_other_columns_and_many_labels(spark):
    assert not mined(spark, [])
    assert not mined(spark, [(1, [1.0], 0)])
    random.seed(6)
    rows = [(i, [random.randrange(-4, 5) / 4 for _ in range(4)], i // 2) for i in range(400)]
    assert mined(spark, rows) == brute(rows)
    clashing = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("x") for c in ("id", "v", "block", "chunk", "n", "rank", "score", "g", "windows")})
    assert Counter(map(tuple, negatives.mine(clashing).collect())) == brute(rows)


def test_products_are_exact():
    rng = np.random.default_rng(1)
    for most in (10, 1 << 20, 1 << 28):
        a, b = rng.integers(-most, most, (9, 32)), rng.integers(-most, most, (11, 32))
        want = [[sum(int(x) * int(y) for x, y in zip(p, q, strict=True)) for q in b] for p in a]
        assert negatives.product(a, b).tolist() == want
    for m in (a, b % 100, b % 100_000):
        assert (negatives.wide(negatives.narrow(m), len(m)) == m).all()


def test_copies_of_anchors_stay_out_of_the_driver(spark, small_blocks):
    """They grow with anchors times rows: a broadcast of them would take the driver."""
    rows = spark.createDataFrame(awkward(), SCHEMA)
    given = negatives.integers(rows)
    blocks = negatives.written(negatives.blocked(given, 300, 16, 7), "blocks")
    anchors = negatives.written(negatives.blocked(given.where("id % 100 = 0"), 4, 4, 7), "anchors").withColumn("windows", F.lit(None).cast(negatives.WINDOWS))
    plan = negatives.multiplied(anchors, blocks, 8, True)._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan
