"""Filters in every order against a plain loop over documents and orders."""

from __future__ import annotations

import re
from collections import Counter
from itertools import permutations

from pyspark.sql import functions as F

from quillon.llm import interaction
from quillon.llm.common import table

DOCS = "doc_id long, text string, source string"
LABELS = "doc_id long, quality int, toxic int"


def brute(rows, labels):
    first = {}
    for i, t, _ in rows:
        if i is not None:
            first[t or ""] = min(i, first.get(t or "", i))
    good, toxic = ({r[0] for r in labels if r[k] == 1 and r[0] is not None} for k in (1, 2))
    out = Counter()
    parts = set()
    for i, t, part in rows:
        t, part = t or "", part or ""
        parts.add(part)
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        is_ = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 2 * len(t), "D": bool(re.search(r"[#$%&*|]", t)), "E": i is not None and i > first[t]}
        fails = {k for k, v in is_.items() if v}
        for order in permutations("ABCDE"):
            gone = False
            for step, f in enumerate(order, 1):
                key = (part, "".join(order), step)
                removed = f in fails and not gone
                out[(*key, "removed")] += removed
                out[(*key, "redundant")] += f in fails and gone
                out[(*key, "unique_fails")] += fails == {f}
                out[(*key, "good_lost")] += removed and i in good
                out[(*key, "toxic_lost")] += removed and i in toxic
                out[(part, f, "shapley")] += removed
                gone |= f in fails
                out[(*key, "kept")] += not gone
    names = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")
    return {(p, "".join(o), s, *(out[(p, "".join(o), s, n)] for n in names), out[(p, o[s - 1], "shapley")]) for p in parts for o in permutations("ABCDE") for s in range(1, 6)}


def audited(spark, rows, labels):
    return interaction.audit(spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, LABELS))


def test_against_a_plain_loop(spark, sf_dir):
    rows = [tuple(r) for r in table(spark, sf_dir, "documents").select("doc_id", "text", "source").collect()]
    labels = [tuple(r) for r in table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic").collect()]
    long = " ".join(f"w{i}" for i in range(60_000))
    rows += [(9001, None, None), (9002, "", ""), (9003, " \n", "a|b"), (9004, "A b # c", None), (9004, "A b # c", "other"), (None, "A b # c", "x"), (None, None, None), (9005, long, "x"), (9006, long, "x"), (9000, "é " * 300, "x")]
    labels += [(9004, 1, None), (9004, None, 1), (None, 1, 1), (9005, 1, 0), (9006, 1, 1)]
    got = audited(spark, rows, labels)
    assert {tuple(r) for r in got.collect()} == brute(rows, labels)
    assert got.count() == 600 * len({r[2] or "" for r in rows})


def test_other_columns_and_empty_tables(spark):
    rows = [(1, "x", "a"), (2, "x", "b"), (3, "y $", "a")]
    d = spark.createDataFrame(rows, DOCS).withColumns({c: F.lit(1) for c in ("part", "mask", "n", "digest", "words", "quality", "first")})
    labels = spark.createDataFrame([(2, 1, 1)], LABELS).withColumn("part", F.lit("z"))
    assert {tuple(r) for r in interaction.audit(d, labels).collect()} == brute(rows, [(2, 1, 1)])
    assert not audited(spark, [], [(1, 1, 1)]).collect()
    assert {r["good_lost"] for r in audited(spark, rows, []).collect()} == {0}


def test_matrices_cover_each_failing_mask_once():
    by = interaction.incidence()
    assert by["kept"].shape == (32, 600)
    per_order = by["removed"].reshape(32, 120, 5).sum(axis=2)
    assert (per_order[1:] == 1).all() and (per_order[0] == 0).all()  # one step removes what fails at all
    assert (by["removed"] + by["redundant"]).reshape(32, 120, 5).sum(axis=2).tolist() == [[bin(m).count("1")] * 120 for m in range(32)]
