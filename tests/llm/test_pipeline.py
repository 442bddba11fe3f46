"""The pipeline, stage by stage, against plain code."""

from __future__ import annotations

import re
from collections import Counter, defaultdict

from helpers import AWKWARD, clashing, docs
from test_decontaminate import norm
from test_neardup import brute_components
from test_pii import brute

from pyspark.sql import functions as F

import corpus_pipeline
from quillon.llm import common, quality
from quillon.llm.common import table


def test_stages_against_plain_code(spark, sf_dir, tmp_path):
    frame = table(spark, sf_dir, "documents")
    steps = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, frame, sf_dir)
        if name != "packed sequences":
            assert out.columns == table(spark, sf_dir, "documents").columns
        out.write.parquet(f"{tmp_path}/{name}")
        before = {r["doc_id"]: r["text"] for r in frame.collect()}
        frame = spark.read.parquet(f"{tmp_path}/{name}")
        steps[name] = before, frame.collect()
    before, after = steps["quality rules"]
    kept = {r["doc_id"] for r in quality.apply_policy(quality.ledger(docs(spark, list(before.items())))).where("kept").collect()}
    assert {r["doc_id"] for r in after} == kept and 0 < len(kept) < len(before)
    before, after = steps["near duplicates"]
    group = brute_components(list(before.items()), 5)
    assert {r["doc_id"] for r in after} == set(group.values())
    before, after = steps["benchmark leaks"]
    items = [norm(r["text"]) for r in table(spark, sf_dir, "benchmark").collect()]
    leaks = {i for i, t in before.items() if any(b in norm(t) for b in items)}
    assert {r["doc_id"] for r in after} == set(before) - leaks
    before, after = steps["personal data"]
    assert {r["doc_id"] for r in after} == set(before)
    for r in after:
        secrets = re.findall(r'= "[0-9a-f]{40}"', before[r["doc_id"]])
        assert (r["text"] == before[r["doc_id"]]) == (not brute(before[r["doc_id"]]) and not secrets)
        assert not brute(r["text"]) and r["text"].count('= "<secret>"') == len(secrets) and r["n_chars"] == len(r["text"])
    before, after = steps["packed sequences"]
    assert {r["doc_id"] for r in after} == set(before)
    room = Counter()
    for r in after:
        room[r["sequence_id"]] += r["length"]
    assert max(room.values()) <= 2048
    pieces = defaultdict(list)
    for r in after:
        pieces[r["doc_id"]].append((r["piece"], r["start"], r["length"]))
    assert all(sorted(p)[k][1] + sorted(p)[k][2] == sorted(p)[k + 1][1] for p in pieces.values() for k in range(len(p) - 1))


def test_secrets_are_gone(spark):
    frame = table(spark, "/root/testdata/sf0.01", "documents")
    secret = F.regexp_count("text", F.lit('= "[0-9a-f]{40}"'))
    out = dict(corpus_pipeline.STAGES)["personal data"](spark, frame.where(secret > 0), "")
    assert out.count() > 0 and out.where(secret > 0).count() == 0


def test_scratch_tables_are_deleted(spark, sf_dir):
    from pathlib import Path

    folder = Path(common.scratch_dir(spark).removeprefix("file://"))
    before = {x.name for x in folder.iterdir()}
    corpus_pipeline.run(spark, sf_dir).count()
    left = {x.name for x in folder.iterdir()} - before
    assert len(left) == 2 and any("pieces" in x for x in left) and any("personal-data" in x for x in left)  # what the result is read from


def test_stages_take_awkward_rows(spark, sf_dir):
    for rows in (AWKWARD, []):
        for name, stage in corpus_pipeline.STAGES:
            given = clashing(docs(spark, rows))
            out = stage(spark, given, sf_dir)
            assert name == "packed sequences" or out.columns == given.columns
            got = Counter((r["doc_id"], r["text"]) for r in out.collect()) if name != "packed sequences" else out.collect()
            want = Counter((i, t) for i, t in rows)
            if name == "quality rules":  # short ones go, and so do null and empty ones
                assert not got
            elif name == "near duplicates":  # repeated rows are one document of one group
                assert got == want
            elif name == "benchmark leaks":
                assert got == want
            elif name == "personal data":
                assert sum(got.values()) == len(rows)
            else:
                assert len(got) >= len(rows) and sum(r["length"] for r in got) >= len(rows)
