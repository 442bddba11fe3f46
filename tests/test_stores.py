"""Streams, snapshots, stores, order and isolation against plain code."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from quillon.operators import imports, isolation, ordered, position
from quillon.sources import store
from quillon.streaming import pacing, snapshots

EVENTS = "k string, id long, at timestamp, v long"
START = datetime(2024, 1, 1)


def events(spark, n=60, seed=1):
    rng = random.Random(seed)
    return [(rng.choice("ab"), rng.randrange(12), START + timedelta(minutes=i), i) for i in range(n)]


def test_a_stream_that_is_stopped_and_resumed_gives_the_batch_result(spark, tmp_path):
    rows = events(spark)
    landing, to, checkpoint = (str(tmp_path / n) for n in ("in", "out", "checkpoint"))
    versions = snapshots.Snapshots(spark, to)
    fold = snapshots.latest_rows(["id"], "at", "v")
    seen = []
    for part in (rows[:20], rows[20:45], rows[45:]):
        spark.createDataFrame(part, EVENTS).repartition(2).write.mode("append").parquet(landing)
        stream = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).parquet(landing)
        snapshots.run(stream, versions, fold, checkpoint)
        seen.append(versions.current())
    want = {}
    for r in rows:
        want[r[1]] = max(want.get(r[1], r), r, key=lambda x: (x[2], x[3]))
    assert {tuple(r[c] for c in ("k", "id", "at", "v")) for r in versions.read().collect()} == set(want.values())
    assert [s["batch"] for s in seen] == sorted({s["batch"] for s in seen}) and seen[-1]["before"]


def test_a_replayed_batch_changes_nothing_and_failures_leave_the_old_version(spark, tmp_path):
    versions = snapshots.Snapshots(spark, str(tmp_path / "s"))
    assert versions.read() is None and versions.current() is None
    count = lambda before, batch: snapshots.union(before, batch.groupBy().count()).agg(F.sum("count").alias("count"))
    each = snapshots.folded(versions, count)
    for number in (0, 1, 1, 0, 2):
        each(spark.range(10), number)
    assert versions.read().first()["count"] == 30 and versions.current()["batch"] == 2

    def broken(before, batch):
        return batch.select(F.raise_error(F.lit("no")).alias("count"))

    with pytest.raises(Exception, match="no"):
        snapshots.folded(versions, broken)(spark.range(3), 3)
    assert versions.read().first()["count"] == 30
    each(spark.range(5), 3)
    assert versions.read().first()["count"] == 35
    kept = {p.name for p in (tmp_path / "s").iterdir() if p.is_dir()}
    assert kept == {versions.current()["version"], versions.current()["before"]}


def test_newest_keys_are_bounded_and_expire(spark):
    rows = events(spark, 80, 2)
    fold, state = snapshots.newest_keys("k", "id", "at", 4), None
    for i in range(0, 80, 16):
        state = spark.createDataFrame(fold(state, spark.createDataFrame(rows[i : i + 16], EVENTS)).collect(), "k string, id long, at timestamp")
    want = set()
    for k in "ab":
        last = {}
        for r in rows:
            if r[0] == k:
                last[r[1]] = r[2]
        want |= {(k, i, t) for i, t in sorted(last.items(), key=lambda x: (-x[1].timestamp(), x[0]))[:4]}
    assert {tuple(r) for r in state.collect()} == want
    live = snapshots.pinned(state, "at", F.lit(START + timedelta(minutes=80)), 0.25).collect()
    assert {r["id"] for r in live} == {i for _, i, t in want if t >= START + timedelta(minutes=65)} and all(0 <= r["expires_in_hours"] <= 0.25 for r in live)


def test_store_reads_only_the_days_that_count(spark, tmp_path):
    rows = [(i % 5, START + timedelta(hours=7 * i), i, i % 11 == 0) for i in range(40)] + [(None, START, 0, False), (1, None, 0, False)]
    frame = spark.createDataFrame(rows, "id long, saved_at timestamp, v long, deleted boolean")
    path = str(tmp_path / "store")
    store.save(frame, path, "comparison", fingerprint="new")
    store.save(frame.withColumn("v", F.lit(-1)), path, "comparison", fingerprint="old")
    store.save(frame.drop("deleted"), path, "anchor")
    for hours in (0, 30, 100, 300):
        as_of = START + timedelta(hours=hours)
        for kind, ttl in (("comparison", 24), ("anchor", 720)):
            want = {}
            for i, at, v, gone in rows:
                if i is not None and at is not None and at <= as_of and at > as_of - timedelta(hours=ttl):
                    want[i] = (v, gone and kind == "comparison")
            got = {r["id"]: r["v"] for r in store.load(spark, path, kind, as_of, fingerprint="new").collect()}
            assert got == {i: v for i, (v, gone) in want.items() if not gone}
    plan = store.load(spark, path, "comparison", START + timedelta(hours=100), fingerprint="new")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "day" in plan.split("PartitionFilters: [")[1].split("]")[0]
    assert {r["kind"]: r["rows"] for r in store.statistics(spark, path).collect()} == {"comparison": 80, "anchor": 40}


def test_pages_and_limits_of_an_order(spark):
    rng = random.Random(4)
    rows = [(i, rng.choice([None, 1.0, 2.0, 3.5])) for i in range(500)]
    frame = spark.createDataFrame(rows, "id long, price double").repartition(7)
    for sort, key in (("price_asc", lambda r: (r[1] if r[1] is not None else 1e12, r[0])), ("price_desc", lambda r: (-(r[1] if r[1] is not None else -1), r[0]))):
        want = sorted(rows, key=key)
        order = [position.SORTS[sort](), "id"]
        at = ordered.ordered(frame, *order)
        assert at.total() == 500 and [r["id"] for r in at.numbered().orderBy("number").collect()] == [r[0] for r in want]
        for first, last in ((1, 1), (1, 60), (250, 310), (490, 900), (501, 600)):
            got = at.between(first, last).orderBy("number").collect()
            assert [(r["id"], r["number"]) for r in got] == [(w[0], first + i) for i, w in enumerate(want[first - 1 : last])]
        assert {r["id"] for r in ordered.first_rows(frame, order, 123).collect()} == {w[0] for w in want[:123]}
    assert ordered.page(frame.where("false"), ["id"], 1, 5).count() == 0
    page = ordered.page(frame, ["id"], 4, 150).collect()
    assert [r["id"] for r in page] == list(range(450, 500)) and {(r["total"], r["pages"]) for r in page} == {(500, 4)}


def test_gathered_pages_keep_the_first_of_each_id(spark):
    rows = [("a", 1, "t", 5.0), ("a", 0, " ", 5.0), ("b", 2, "t", None), ("b", 3, "u", 1.0), ("c", 4, "t", 2.0), (None, 0, "t", 1.0), ("a", 5, "z", 9.0)]
    got = ordered.gathered(spark.createDataFrame(rows, "id string, page int, title string, price double"), ["page"], 2).collect()
    assert sorted((r["id"], r["page"]) for r in got) == [("a", 1), ("b", 3)]


def test_rows_fail_alone(spark):
    raw = spark.createDataFrame([(1, "5", "7"), (2, "x", "7"), (3, None, "1"), (4, "9", "7"), (5, "1e400", "y")], "id long, price string, mrp string")
    types, rules = {"price": "double", "mrp": "double"}, {"price above mrp": F.col("price") <= F.col("mrp")}
    assert [tuple(r) for r in isolation.kept(isolation.read(raw, types, rules)).orderBy("id").collect()] == [(1, 5.0, 7.0), (3, None, 1.0)]
    bad = {r["id"]: (r["price"], r["problem"]) for r in isolation.quarantine(raw, types, rules).collect()}
    assert bad == {2: ("x", "price: not double"), 4: ("9", "price above mrp"), 5: ("1e400", "mrp: not double")}
    decided = spark.createDataFrame([(1, "p", "matched")], "anchor_id long, platform string, status string")
    out = isolation.with_errors(decided, isolation.quarantine(raw, types, rules), spark.createDataFrame([("p",), ("q",)], "platform string"))
    assert sorted((r["anchor_id"], r["platform"], r["status"]) for r in out.collect()) == [(1, "p", "matched"), *[(i, p, "error") for i in (2, 4, 5) for p in "pq"]]


def test_jobs_and_their_restart(spark):
    t = START
    items = [("done", "done", "matched", t), ("done", "done", "error", t), ("going", "running", None, t), ("going", "pending", None, t), ("waiting", "pending", None, t + timedelta(1)), ("gone", "pending", None, t), ("gone", "done", "no_match", t)]
    frame = spark.createDataFrame(items, "job_id string, state string, status string, at timestamp")
    jobs = imports.jobs(frame, spark.createDataFrame([("gone",), ("done",)], "job_id string"))
    got = {r["job_id"]: r for r in jobs.collect()}
    assert {j: r["job_status"] for j, r in got.items()} == {"done": "done", "going": "running", "waiting": "queued", "gone": "cancelled"}
    assert (got["done"]["matched"], got["done"]["failed"], got["gone"]["no_match"], got["going"]["total"]) == (1, 1, 1, 2)
    again = {r["job_id"]: (r["state"], r["pending"]) for r in pacing.resumed(jobs.select("job_id", F.col("job_status").alias("state")), frame).collect()}
    assert again == {"done": ("done", 0), "going": ("queued", 2), "waiting": ("queued", 1), "gone": ("queued", 1)}
    assert [r["state"] for r in imports.restarted(frame.where("job_id = 'going'")).collect()] == ["pending", "pending"]
    listed = imports.job_list(jobs, 2).collect()
    assert [(r["job_id"], r["jobs"]) for r in listed] == [("waiting", 4), ("done", 4)]
    o = spark.createDataFrame([(["matched", "error"], None), (["no_match"], None), ([], "not found")], "s array<string>, p string")
    assert [r[0] for r in o.select(imports.outcome(F.col("s"), F.col("p"))).collect()] == ["matched", "no_match", "error"]


def test_load_circuits_and_the_queue(spark):
    rows = [("a", 1.0, True), ("a", 5.0, False), ("a", 11.0, None), ("a", 25.0, True), ("b", 3.0, False)]
    frame = spark.createDataFrame(rows, "key string, at double, ok boolean")
    got = {(r["key"], r["window"]): (r["requests"], r["errors"], r["mean_gap"], r["over"]) for r in pacing.load(frame, 10, 1).collect()}
    assert got == {("a", 0): (2, 1, 4.0, 1), ("a", 1): (1, 0, None, 0), ("a", 2): (1, 0, None, 0), ("b", 0): (1, 1, None, 0)}
    assert {(r["key"], r["window"]): r["circuit"] for r in pacing.circuits(frame, 10, 1).collect()} == {("a", 0): "tripped", ("a", 1): "open", ("a", 2): "closed", ("b", 0): "tripped"}
    wanted = spark.createDataFrame([("x",), ("x",), ("y",), ("z",), ("w",)], "k string")
    tried = spark.createDataFrame([("y", False, 100.0), ("y", False, 200.0), ("z", True, 1.0), *[("w", False, float(i)) for i in range(3)]], "k string, ok boolean, at double")
    assert {r["k"]: (r["wanted"], r["tries"], r["not_before"]) for r in pacing.work_queue(wanted, tried, "k").collect()} == {"x": (2, 0, None), "y": (1, 2, 320.0)}


def test_breaker_tells_each_event(spark):
    rng = random.Random(8)
    rows = [(i, rng.choice("ab"), float(rng.randrange(120)), rng.choice((True, True, True, False, None))) for i in range(150)]
    want, seen = {}, {}
    for i, key, at, ok in sorted(rows, key=lambda r: (r[2], r[0])):
        last, previous = seen.get(key, (None, None))
        probe = last is not None and (previous < last + 10 or previous == last)
        want[i] = "open" if last is not None and at < last + 10 else "probe" if probe else "closed"
        seen[key] = (at if ok is False else last, at)
    frame = spark.createDataFrame(rows, "event_id long, key string, at double, ok boolean")
    got = {r["event_id"]: r["circuit"] for r in pacing.breaker(frame, 10, "event_id").collect()}
    assert got == want and set(got.values()) == {"open", "probe", "closed"}
