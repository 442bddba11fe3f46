"""Column functions on worked examples and properties."""

from __future__ import annotations

import itertools
import random

import pytest
from pyspark.sql import functions as F

from quillon.functions import attributes as att
from quillon.functions import decision as dec
from quillon.functions import similarity as sim
from quillon.functions import text as t
from quillon.functions.plan import computed_once
from quillon.functions.vocab import DEFAULT, EngineConfig
from quillon.operators import images


def values(spark, column, *given):
    """A column over literals, one row for each tuple."""
    rows = [x if isinstance(x, tuple) else (x,) for x in given]
    names = "abcd"[: len(rows[0])]
    kinds = [next((type(r[i]) for r in rows if r[i] is not None), str) for i in range(len(names))]
    schema = ", ".join(f"{n} {'string' if k is str else 'double' if k is float else 'bigint' if k is int else 'boolean'}" for n, k in zip(names, kinds, strict=True))
    return [r[0] for r in spark.createDataFrame([(*r,) for r in rows], schema).select(column(*[F.col(n) for n in names])).collect()]


def test_normalised_text(spark):
    assert values(spark, t.normalize, "Café-Tee", "  A__b  ", None, "") == ["caf tee", "a b", "", ""]


def test_brand_scores(spark):
    got = values(spark, t.brand_score, ("Levis", "Levi's"), ("Nike", "Nike Sport"), ("Van Heusen", "Heusen Van"), (None, "x"), ("abc", "xyz"))
    assert got == [1.0, 0.85, pytest.approx(0.8), 0.0, 0.0]


def test_gender(spark):
    assert values(spark, t.gender, "Girls and women", "Mens", "kids", "unisex", "thing") == ["girls", "men", "kids", "unisex", None]
    assert values(spark, t.gender_compatible, ("men", "women"), ("men", "boys"), ("men", "men"), (None, "men"), ("unisex", "girls"), ("kids", "men")) == [False, False, True, True, True, False]


def test_classifiers(spark):
    assert values(spark, t.garment, "Polo T-Shirt", "Slim Jeans", "Open Toe Flats", "nothing") == ["polo", "jeans", "flats", None]
    assert values(spark, t.fit, "Comfort Fit", "boot cut", "Slim tapered", "none") == ["regular", "bootcut", "slim", None]
    assert values(spark, t.colour_family, "Navy Blue", "Dark Olive", "Blue Navy Shirt", "unheard", None) == ["blue", "green", "blue", None, None]


def test_overlay_extends_without_changing_the_default(spark):
    more = DEFAULT.extended(garments=(("widget", r"\bwidget\b"),), colour_family={"zaffre": "blue"}, key_aliases={"fit": ("Shape",)})
    assert values(spark, lambda a: t.garment(a, tax=more), "red widget") == ["widget"] and values(spark, t.garment, "red widget") == [None]
    assert values(spark, lambda a: t.colour_family(a, more), "zaffre") == ["blue"] and more.key_aliases["fit"] == ("Fit", "Shape")


def test_model_codes(spark):
    assert values(spark, t.model_score, ("WH-CH520", "ch520 black"), ("ab12", "cd34"), ("SM 9085", "SM 401"), ("levis 541", "541 jeans"), ("a", "b")) == [1.0, 0.0, 0.25, 0.85, None]
    assert values(spark, t.strong_codes, "xl 2xl 32b 200gm ve8g00124") == [["ve8g00124"]]


def test_sizes(spark):
    assert values(spark, t.chart_size, "XXL", " xl ", "Free", "", "04XL") == ["2XL", "XL", "FREE", None, "4XL"]
    assert values(spark, t.export_size, "2XL", "xxxl", "free", "a label that is too long") == ["XXL", "3XL", "FREE SIZE", None]
    assert values(spark, t.size_rank, *"S M L XL 2XL 32 odd".split()) == sorted(values(spark, t.size_rank, *"S M L XL 2XL 32 odd".split()))


def test_ids_links_numbers(spark):
    assert values(spark, t.product_id, "mp000000024358256", "https://x.example/a/p-mp12", "https://x.example/?productId=ab9", "word", None) == ["MP000000024358256", "MP12", "AB9", None, None]
    assert values(spark, t.rupees, 1234567.0, 999.0, 100000.0, -1500.0, None) == ["₹12,34,567", "₹999", "₹1,00,000", "-₹1,500", None]
    got = values(spark, t.measurement, "36 - 38", "36–38", "40", "none")
    assert [(r and (r["lo"], r["hi"], r["value"])) for r in got] == [(36, 38, 37), (36, 38, 37), (40, 40, 40), None]


def test_fabric(spark):
    shown = lambda r: r and [(c["material"], c["pct"]) for c in r["composition"]]
    got = values(spark, att.fabric, "98% Cotton, 2% Elastane", "Pure Cotton", "Single Jersey, 100% Cotton", "Cotton Blend", "", None)
    assert list(map(shown, got)) == [[("cotton", 98), ("elastane", 2)], [("cotton", 100)], [("cotton", 100)], [("cotton", None)], None, None]


def test_pockets(spark):
    assert values(spark, att.pockets, ("5", ""), ("Two Pockets", ""), ("", "has three pockets"), ("no", ""), (None, "plain")) == [5, 2, 3, 0, None]


def test_attribute_agreement_counts_only_what_both_say(spark):
    rows = [("Slim jeans", {"Fit": "Slim Fit", "Fabric": "98% Cotton 2% Elastane"}, "Slim Fit jeans", {"Fit": "Slim", "Material": "100% cotton"}), ("a", None, "b", None)]
    d = spark.createDataFrame(rows, "ta string, aa map<string,string>, tb string, ab map<string,string>")
    side = lambda n: att.canonical(F.col(f"t{n}"), F.lit(None).cast("string"), F.col(f"a{n}"), F.lit(None).cast("string"), F.lit(None).cast("string"))
    first, second = [r[0] for r in computed_once(d, side("a").alias("a"), side("b").alias("b")).select(att.agreement(F.col("a"), F.col("b"))).collect()]
    fields = {f["key"]: f["agreement"] for f in first["fields"]}
    assert fields["fit"] == 1 and fields["material"] == 1 and fields["stretch"] == 0 and fields["rise"] is None
    assert first["compared"] == 3 and second["score"] is None and second["compared"] == 0


def test_similarity_properties(spark):
    pairs = list(itertools.product(["Nike Men Black Polo", "Nike Women Black Polo", "Puma red shoes", "tee shirt"], repeat=2))
    both = lambda f: lambda a, b: F.round(f(a, b), 9)
    for f in (sim.token_cosine, sim.trigram_cosine, lambda a, b: t.jaccard(t.words(a), t.words(b))):
        got = dict(zip(pairs, values(spark, both(f), *pairs), strict=True))
        assert all(got[a, b] == got[b, a] and 0 <= got[a, b] <= 1 for a, b in pairs) and all(got[a, a] == 1 for a, _ in pairs)
    titles = spark.createDataFrame([pairs[0], pairs[1]], "a string, b string")
    profiles = computed_once(titles, sim.text_profile(F.col("a")).alias("a"), sim.text_profile(F.col("b")).alias("b"))
    men, women = [r[0] for r in profiles.select(sim.title_similarity(F.col("a"), F.col("b"))).collect()]
    assert men > 0.99 and women < 0.65


def test_colour_and_images(spark):
    white = [r[0] for r in spark.range(1).select(sim.lab(F.lit(255), F.lit(255), F.lit(255))).collect()][0]
    assert white[0] == pytest.approx(100, abs=0.1) and abs(white[1]) < 0.1
    assert spark.range(1).select(sim.hamming(F.lit(0b1011), F.lit(0b0010))).first()[0] == 2


def test_mrp_and_blend(spark):
    assert values(spark, dec.mrp_evidence, (1899.0, 1999.0), (100.0, 100.4), (100.0, 102.0), (100.0, 130.0), (100.0, 500.0), (None, 1.0)) == [0.55, 1.0, 0.9, 0.25, 0.0, None]
    blend = lambda a, b: dec.blend({"mrp": a, "title": b, "image": F.lit(None).cast("double")})["score"]
    assert values(spark, blend, (1.0, None), (1.0, 1.0), (0.5, 0.5), (None, None)) == [1.0, 1.0, 0.5, None]


def test_tiers_and_fingerprint(spark):
    assert values(spark, dec.tier, 0.9, 0.8, 0.6, 0.5, None) == ["EXACT MATCH", "CLOSE MATCH", "PARTIAL MATCH", "NO MATCH", "NO MATCH"]
    assert EngineConfig().fingerprint == "v7-s1-m058"


def test_difference_hash_joins_nothing(spark):
    """A small file may hold many pictures: their pixels must not be broadcast."""
    rng = random.Random(2)
    rows = [(i, x, y, rng.randrange(5) if rng.random() < 0.95 else None) for i in range(20) for x in range(9) for y in range(8) if rng.random() < 0.9] + [(99, 3, 3, 1)]
    v = {(i, x, y): z for i, x, y, z in rows}
    want = {}
    for i, x, y in v:
        if (i, x + 1, y) in v:
            p, q = v[i, x, y], v[i, x + 1, y]
            want[i] = want.get(i, 0) | (p is not None and q is not None and p > q) << (63 - (y * 8 + x))
    out = images.difference_hash(spark.createDataFrame(rows, "image_id long, x int, y int, v int"))
    assert {r["image_id"]: r["dhash"] % (1 << 64) for r in out.collect()} == want
    assert "Join" not in out._jdf.queryExecution().executedPlan().toString()
