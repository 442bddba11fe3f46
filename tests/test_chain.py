"""The match chain's parts against plain code."""

from __future__ import annotations

import math
import random
import re

from pyspark.sql import functions as F

from quillon.operators import audit, matching
from quillon.plans import chain


def test_nearest_against_all_rows(spark):
    rng = random.Random(4)
    rows = [(i, [float(rng.randint(-2, 2)) for _ in range(3)]) for i in range(120)] + [(200, None), (201, [0.0, 0.0, 0.0]), (202, [1.0, 1.0, 1.0]), (203, [1.0, 1.0, 1.0])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(5)

    def cosine(x, y):
        n = math.sqrt(sum(v * v for v in x)) * math.sqrt(sum(v * v for v in y))
        return round(sum(a * b for a, b in zip(x, y, strict=True)) / n, 6) + 0.0 if n else 0.0

    vectors = {i: v or [0.0] * 3 for i, v in rows}
    want = {(q, i, c, r) for q in range(0, 120, 7) for r, (c, i) in enumerate(sorted(((cosine(vectors[q], v), i) for i, v in vectors.items() if i != q), key=lambda x: (-x[0], x[1]))[:4], 1)}
    for block in (4096, 5):
        got = matching.nearest(frame, frame.where("vec_id % 7 = 0 and vec_id < 120"), 4, block).collect()
        assert {(r["query_id"], r["vec_id"], r["cosine"], r["rank"]) for r in got} == want
    assert matching.nearest(frame, frame.where("false"), 4).count() == 0


def test_similar_titles_against_all_pairs(spark):
    rng = random.Random(5)
    words = ["men", "men", "men", "red", "blue", "slim", "polo", "tee", "cotton", "x1"]
    rows = [(i, " ".join(rng.choices(words, k=rng.randint(0, 5)))) for i in range(80)] + [(100, None), (101, "MEN  Red!"), (102, "men red")]
    first: dict[str, int] = {}
    for i, title in sorted(rows):
        first.setdefault(re.sub("[^a-z0-9]+", " ", (title or "").lower()).strip(), i)
    for least in (0.3, 0.5, 0.8):
        want = set()
        for x, a in first.items():
            for y, b in first.items():
                u, v = set(x.split()), set(y.split())
                if a < b and u and v and len(u & v) / len(u | v) >= least:
                    want.add((a, b, round(len(u & v) / len(u | v), 9)))
        got = matching.similar_titles(spark.createDataFrame(rows, "id long, title string"), least).collect()
        assert {(r["a"], r["b"], round(r["jaccard"], 9)) for r in got} == want


def test_a_pair_is_barred_if_all_its_pages_are(spark):
    pages = spark.createDataFrame([(1, "p", True), (1, "p", True), (2, "p", True), (2, "p", False), (3, "p", None)], "anchor_id long, platform string, blocked boolean")
    assert [tuple(r) for r in matching.barred(pages).collect()] == [(1, "p")]


def test_weights_of_seen_and_unseen_tokens(spark):
    rows = spark.createDataFrame([(1, ["red", "new"]), (2, []), (3, ["red", "new"])], "id long, tokens array<string>").select("id", F.struct(F.struct("tokens").alias("title")).alias("f"))
    weights = matching.idf_table(spark.createDataFrame([("red polo",), ("blue polo",)], "title string"))
    got = {r["id"]: r["w"] for r in matching.weighted(rows, weights).collect()}
    assert got[2] is None and got[1] == got[3]
    assert abs(got[1]["red"] - (math.log(3 / 2) + 1)) < 1e-12 and abs(got[1]["new"] - (math.log(3) + 1)) < 1e-12


def test_verdicts_against_a_pool(spark):
    decided = spark.createDataFrame([(1, "p", "matched", 10), (2, "p", "matched", 10), (3, "p", "matched", 10), (4, "p", "no_match", None), (5, "p", "ambiguous", None), (6, "p", "blocked", None)], "anchor_id long, platform string, status string, listing_id long")
    pool = spark.createDataFrame([(1, "p", 10, True, True), (1, "p", 10, True, True), (2, "p", 10, False, True), (2, "p", 11, True, True), (3, "p", 12, False, False), (4, "p", 10, True, True)], "anchor_id long, platform string, id long, strict boolean, standard boolean")
    got = {r["anchor_id"]: (r["pool_size"], r["verdict_strict"], r["verdict_standard"]) for r in audit.pooled(decided, pool).collect()}
    assert got == {1: (1, "TP", "TP"), 2: (2, "FP_MISSED_BETTER", "TP"), 3: (1, "FP", "FP"), 4: (1, "FN", "FN"), 5: (0, "TN", "TN"), 6: (0, "BLOCKED", "BLOCKED")}


def test_contradictions_of_a_claim(spark):
    rows = spark.createDataFrame([("M1", "men"), ("M2", "women"), ("M3", "men"), ("M3", "boys"), ("M4", None)], "code string, gender string")
    claim = F.when(F.col("code").startswith("M"), "men")
    assert {r["code"] for r in audit.contradictions(rows, "code", "gender", claim).collect()} == {"M2", "M3"}
    assert {r["code"] for r in audit.contradictions(rows, "code", "gender").collect()} == {"M3"}


ANCHORS = [
    ("A1", "Levis", "Men 541 Athletic Tapered Jeans", "Blue", 1899.0, 1310.0, "men", None), ("A2", "Nike", "Men Solid Polo T-shirt", "Black", 1999.0, 1500.0, None, None),
    ("A3", "Puma", "Women Regular Running Shoes", "Red", 4999.0, 3000.0, None, None), ("A4", "Zara", "Women Floral Dress", "Green", 2999.0, 2500.0, None, None), ("A5", "Nike", "Men Graphic Tee", "White", 999.0, 800.0, None, None),
]
LISTINGS = [
    ("L1", "p0", "Levi's", "Men 541 Athletic Tapered Fit Jeans", "Blue", 1899.0, 1250.0, "men", None, 0, 0), ("L2", "p0", "Levis", "Men 511 Slim Jeans", "Blue", 1899.0, 1100.0, "men", None, 0, 1),
    ("L1b", "p1", "Levis", "Men 541 Athletic Tapered Jeans", "Brown", 1899.0, 1250.0, "men", None, 0, 0), ("L3", "p0", "Nike", "Men Solid Polo T-shirt", "Black", 1999.0, 1450.0, "men", None, 0, 0),
    ("L4", "p0", "Nike", "Men Solid Polo T-shirt", "Black", 1999.0, 1700.0, "men", None, 0, 1), ("L5", "p1", "Nike", "Men Solid Polo T-shirt", "Black", 2200.0, 1700.0, "men", None, 0, 1),
    ("L6", "p0", "Puma", "Women Slim Running Shoes", "Red", 4999.0, 2900.0, "women", None, 0, 0), ("L7", "p1", "Puma", "Women Running Shoes", "Red", 4999.0, 2900.0, "women", None, 0, 0), ("L8", "p0", "Nike", "Men Graphic Tee", "White", 1010.0, 700.0, "men", None, 0, 0),
]
DECIDED = [
    ("A1", "p0", "matched", None, "L1"), ("A1", "p1", "color_mismatch", None, None), ("A2", "p0", "ambiguous", None, None), ("A2", "p1", "no_match", "mrp_mismatch", None), ("A3", "p0", "no_match", "hard_gate", None),
    ("A3", "p1", "matched", None, "L7"), ("A4", "p0", "no_results", None, None), ("A4", "p1", "no_results", None, None), ("A5", "p0", "matched", None, "L8"), ("A5", "p1", "no_results", None, None),
    *[(f"A{i}", "p2", "blocked", None, None) for i in range(1, 6)],
]
_PRODUCT = "id string, {p}brand string, title string, color string, mrp double, price double, gender string, articleType string"


def test_status_precedence(spark):
    """Literal products for every status and reason, in the order of precedence."""
    anchors = spark.createDataFrame(ANCHORS, _PRODUCT.format(p=""))
    listings = spark.createDataFrame(LISTINGS, _PRODUCT.format(p="platform string, ") + ", query_ord int, rank_in_query int")
    platforms = spark.createDataFrame([("p0", False), ("p1", False), ("p2", True)], "platform string, blocked boolean")
    got = matching.match(anchors, listings, platforms).select("anchor_id", "platform", "status", "rejectedBy", "listing_id").collect()
    assert {tuple(r) for r in got} == set(DECIDED)


def test_statuses_of_the_chain_over_parts(spark):
    """The derived listings reach these statuses, so the SQL of ``match_parts`` is held against all of them."""
    got = chain.decided(spark, "/root/testdata/sf0.01").select("status", "rejectedBy").distinct().collect()
    assert {r["status"] for r in got} >= {"matched", "ambiguous", "blocked", "no_results", "color_mismatch", "no_match"}
    assert {r["rejectedBy"] for r in got if r["status"] == "no_match"} >= {"mrp_mismatch"}


def test_pairs_meet_once_by_their_first_key(spark):
    f = lambda *keys: F.struct(F.array(*map(F.lit, keys)).alias("shared"), *[F.lit("x").alias(n) for n in matching.COMPARED])
    own = spark.range(1).select(F.col("id"), F.lit(1.0).alias("mrp"), f("k1", "k2", "k3").alias("f"))
    theirs = spark.range(1).select(F.lit("p").alias("platform"), F.lit(7).alias("id"), F.lit(1.0).alias("price"), F.lit(1.0).alias("mrp"), F.lit(5).alias("rank_in_query"), f("k3", "k2").alias("f"))
    theirs = theirs.unionByName(theirs.withColumns({"rank_in_query": F.lit(2), "price": F.lit(9.0)})).unionByName(theirs.withColumn("id", F.lit(8)))
    got = matching.blocked(own, theirs).select("listing_id", "query_ord", "listing.price").orderBy("listing_id").collect()
    assert [tuple(r) for r in got] == [(7, 1, 9.0), (8, 1, 1.0)]


def test_copies_of_products_cost_no_pairs(spark):
    """Kinds are paired, whatever the number of their copies; each copy gets the decision of its kind, from the best ranked listings."""
    one = spark.createDataFrame(ANCHORS, _PRODUCT.format(p=""))
    anchors = spark.range(4).crossJoin(one.drop("id").withColumn("a", F.lit("A"))).select(F.concat("a", "brand", "title", F.col("id").cast("string")).alias("id"), *one.columns[1:])
    listed = spark.createDataFrame(LISTINGS, _PRODUCT.format(p="platform string, ") + ", query_ord int, rank_in_query int")
    listings = spark.range(30).withColumnRenamed("id", "k").crossJoin(listed).withColumn("id", F.concat("id", F.lit("-"), F.col("k").cast("string"))).withColumn("rank_in_query", F.col("rank_in_query") + 2 * F.col("k")).drop("k")
    own, theirs = matching.ready(anchors), matching.ready(listings)
    of, (stands, members, placed) = matching.kinds(own), matching.shelves(theirs, 10)
    assert of.select("kind").distinct().count() == 5 and placed.count() == 270
    assert (stands.count(), stands.agg(F.sum("n")).first()[0]) == (listed.select("platform", "brand", "title", "color", "mrp", "gender").distinct().count(), 270)
    assert members.agg(F.max(F.size("members"))).first()[0] == 10
    pairs = matching.candidates(matching.of_kinds(own, of), stands)
    assert pairs.count() <= 5 * stands.count()


def test_nearest_in_slices(spark, monkeypatch):
    """A task holds the cosines of a slice, and what it keeps is the same."""
    rng = random.Random(6)
    frame = spark.createDataFrame([(i, [float(rng.randint(-2, 2)) for _ in range(3)]) for i in range(150)], "vec_id long, embedding array<float>").repartition(2)
    asked = frame.where("vec_id % 4 = 0")
    want = sorted(map(tuple, matching.nearest(frame, asked, 4).collect()))
    monkeypatch.setattr(matching, "SLICE", 7)
    assert sorted(map(tuple, matching.nearest(frame, asked, 4).collect())) == want


def test_different_prices_cost_no_pairs(spark, monkeypatch):
    """Lines of products are paired, whatever the number of their prices; each anchor still gets the listing whose price is nearest, and the best ranked one of those."""
    anchors = spark.range(30).select(F.concat(F.lit("A"), "id").alias("id"), F.lit("Nike").alias("brand"), F.lit("Men Solid Polo T-shirt").alias("title"), F.lit("Black").alias("color"),
        (1000.0 + 40 * F.col("id")).alias("mrp"), F.lit("men").alias("gender"), F.lit(None).cast("string").alias("articleType"))
    listings = spark.range(80).crossJoin(anchors.limit(1).drop("id", "mrp")).select(F.lit("p0").alias("platform"), F.concat(F.lit("L"), "id").alias("id"), "brand", "title", "color",
        (1000.0 + 40 * (F.col("id") % 40)).alias("mrp"), F.lit(900.0).alias("price"), "gender", "articleType", (100 - F.col("id")).alias("rank_in_query"))
    paired, whole = [], matching.candidates
    monkeypatch.setattr(matching, "candidates", lambda a, b: paired.append(whole(a, b)) or paired[-1])
    got = matching.match(anchors, listings, spark.createDataFrame([("p0", False)], "platform string, blocked boolean")).collect()
    assert {(r["anchor_id"], r["status"], r["listing_id"]) for r in got} == {(f"A{i}", "matched", f"L{i + 40}") for i in range(30)}
    assert [p.count() for p in paired] == [1]


def test_nearest_prices_against_all_listings(spark):
    rng = random.Random(8)
    prices = [None, 1000.0, 1000.4, 1020.0, 1100.0, 990.0, 1250.0, 2000.0, 0.0]
    rows = [("p", i, 7, 1.0, rng.choice(prices), rng.randint(0, 20)) for i in range(70)]
    placed = spark.createDataFrame(rows, "platform string, id long, line long, price double, mrp double, rank_in_query int").withColumn("cell", F.round("mrp"))
    wanted = spark.createDataFrame([("p", 7, c) for c in (1000.0, 1121.0, 0.0, None)], "_p string, other long, cell double")

    def evidence(x, y):
        if x is None or y is None:
            return None
        x, y = round(x), round(y)
        gap = abs(x - y) / max(x, y) if max(x, y) else 0.0
        return 1.0 if x == y else 0.9 if gap <= 0.02 else 0.55 if gap <= 0.1 else 0.25 if gap <= 0.25 else 0.0

    for r in matching.nearest_prices(wanted, matching.offered(placed, 4), 4).collect():
        told = [(evidence(r["cell"], m), rank, i) for _, i, _, _, m, rank in rows]
        want = [sorted((-e, rank, i) for e, rank, i in told if e is not None)[:4], sorted((rank, i) for e, rank, i in told if e is None)[:4]]
        got = [(b["less"], b["rank_in_query"], b["id"]) for b in r["best"]]
        assert [x for x in got if x[0] is not None] == want[0]
        assert [x[1:] for x in got if x[0] is None][:4] == want[1]


def test_near_prices_are_counted_to_the_last_bit(spark):
    rng = random.Random(7)
    prices = sorted({x for m in (960.0, 912.0, 100.0, 95.0, 19.99, 1e-3, 12345.67) for x in (m, m * 0.95, m / 0.95, math.nextafter(m * 0.95, 0), math.nextafter(m * 0.95, 1e9), math.nextafter(m / 0.95, 0), math.nextafter(m / 0.95, 1e9))})
    points = [(own, "p", m, rng.randint(1, 3)) for own in (1, 2) for m in prices] + [(1, "q", 960.0, 5), (1, "p", None, 9)]
    asked = [(own, m) for own in (1, 2) for m in prices] + [(1, None), (3, 960.0)]
    got = audit.counted_near(spark.createDataFrame(points, "own long, platform string, mrp double, n long"), spark.createDataFrame(asked, "own long, mrp double")).collect()
    want = {}
    for own, m in asked:
        for p in {p for o, p, _, _ in points if o == own and m is not None}:
            want[own, p, m] = sum(n for o, q, x, n in points if (o, q) == (own, p) and x is not None and abs(m - x) / max(m, x) <= 0.05)
    assert {(r["own"], r["platform"], r["mrp"]): r["n"] for r in got} == want


def test_pools_of_lines_give_the_verdicts_of_pools_of_products(spark):
    rng = random.Random(3)
    anchors = spark.createDataFrame([(i, i % 3, rng.choice([100.0, 100.4, 104.0, 120.0, None])) for i in range(25)], "id long, line long, mrp double")
    listings = spark.createDataFrame([("p", 100 + i, i % 4, rng.choice([100.0, 99.6, 105.0, 120.0, None])) for i in range(30)], "platform string, id long, line long, mrp double")
    lines = [(o, "p", x, rng.random() < 0.6, True) for o in range(2) for x in range(3)]
    counts = listings.groupBy("platform", F.col("line").alias("other")).agg(F.count("*").alias("n"))
    pool = spark.createDataFrame(lines, "own long, platform string, other long, strict boolean, standard boolean").join(counts, ["platform", "other"])
    decided = spark.createDataFrame([(i, "p", *rng.choice([("matched", 100 + rng.randint(0, 29)), ("no_match", None), ("blocked", None)])) for i in range(25)], "anchor_id long, platform string, status string, listing_id long")
    a, c = anchors.select(F.col("id").alias("anchor_id"), F.col("line").alias("own"), F.col("mrp").alias("x")), listings.select("platform", "id", F.col("line").alias("other"), F.col("mrp").alias("y"))
    each = pool.join(a, "own").join(c, ["platform", "other"]).select("anchor_id", "platform", "id", (F.col("strict") & F.coalesce(F.round("x") == F.round("y"), F.lit(False))).alias("strict"),
        (F.col("standard") & audit.near(F.col("x"), F.col("y"))).alias("standard"))
    assert sorted(map(tuple, audit.pooled_lines(decided, pool, anchors, listings).collect())) == sorted(map(tuple, audit.pooled(decided, each).collect()))


def test_tiers_read_the_decisions_once(spark):
    reads = spark.sparkContext.accumulator(0)

    def read(batches):
        for b in batches:
            reads.add(b.num_rows)
            yield b

    rows = [("p", "matched", "EXACT MATCH"), ("p", "no_match", None), ("p", "no_match", None), ("q", "matched", "EXACT MATCH")]
    decided = spark.createDataFrame(rows, "platform string, status string, matchType string")
    got = audit.tiers(decided.mapInArrow(read, decided.schema)).collect()
    assert sorted(map(tuple, got), key=repr) == [("p", "matched", "EXACT MATCH", 1, 0.333333), ("p", "no_match", None, 2, 0.666667), ("q", "matched", "EXACT MATCH", 1, 1.0)]
    assert reads.value == len(rows)
