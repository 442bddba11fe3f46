"""Canonical product attributes from attribute maps and free text, and how far two products agree in them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillon.functions import text as t
from quillon.functions import vocab
from quillon.functions.vocab import DEFAULT, Taxonomy

COMPOSITION = "array<struct<material:string,pct:double>>"


def stated(attributes: Column, name: str, tax: Taxonomy = DEFAULT) -> Column:
    """The first non-blank value under any of a field's spellings."""
    return F.coalesce(*[F.nullif(F.trim(F.try_element_at(attributes, F.lit(k))), F.lit("")) for k in tax.key_aliases[name]])


def fabric(s: Column) -> Column:
    """(composition, primary, blend): explicit shares, else the fibres named; null without any."""
    low = F.lower(F.regexp_replace(F.coalesce(s, F.lit("")), vocab.WEAVES, " "))
    pattern = r"([0-9]{1,3}(?:\.[0-9]+)?)\s*%\s*([a-z]+)"
    pairs = F.arrays_zip(F.regexp_extract_all(low, F.lit(pattern), F.lit(1)).alias("pct"), F.regexp_extract_all(low, F.lit(pattern), F.lit(2)).alias("word"))
    fibre = lambda w: F.coalesce(*[F.when(w.startswith(f[:5]), F.lit(f)) for f in vocab.FIBRES])
    exact = F.filter(F.transform(pairs, lambda p: F.struct(fibre(p["word"]).alias("material"), p["pct"].cast("double").alias("pct"))), lambda p: p["material"].isNotNull())
    by_share = F.array_sort(exact, lambda a, b: F.when(a["pct"] > b["pct"], -1).when(a["pct"] < b["pct"], 1).otherwise(0)).cast(COMPOSITION)
    blended = low.rlike(r"\bblend(ed)?\b")
    share = F.when(low.rlike(r"\b(pure|100)\b") & ~blended, 100.0)
    named = F.array_compact(F.array(*[F.when(low.rlike(rf"\b{f}\b"), F.struct(F.lit(f).alias("material"), share.alias("pct"))) for f in vocab.FIBRES])).cast(COMPOSITION)
    made = lambda c, blend: F.struct(c.alias("composition"), F.get(c, F.lit(0))["material"].alias("primary"), blend.alias("blend"))
    return F.when(F.size(exact) > 0, made(by_share, F.size(by_share) > 1)).when(F.size(named) > 0, made(named, blended | (F.size(named) > 1)))


def stretch(f: Column, s: Column) -> Column:
    """From the share of an elastic fibre, else from the text; a known fabric without either doesn't stretch."""
    elastic = F.get(F.filter(f["composition"], lambda c: c["material"].isin("elastane", "spandex", "lycra")), F.lit(0))
    said = t.normalize(s)
    return (
        F.when(elastic.isNotNull(), F.when(elastic["pct"].isNull() | (elastic["pct"] >= 3), "stretchable").otherwise("slight stretch"))
        .when(said.rlike(r"\b(stretchable|stretch)\b"), "stretchable")
        .when(said.rlike(r"\bnon stretch\b") | f.isNotNull(), "non stretch")
    )


def pockets(value: Column, s: Column) -> Column:
    """A count: digits, a number word, or a phrase of the text."""
    number = t.literal_map(vocab.NUMBER_WORDS)
    count = lambda w: F.coalesce(w.try_cast("int"), F.try_element_at(number, w))
    digits = F.regexp_extract(F.coalesce(value, F.lit("")), r"\b(\d{1,2})\b", 1).try_cast("int")
    word = F.get(F.filter(t.words(value), lambda w: w.isin(*vocab.NUMBER_WORDS)), F.lit(0))
    phrase = F.nullif(F.regexp_extract(t.normalize(s), r"\b(one|two|three|four|five|six|\d{1,2})\s+pockets?\b", 1), F.lit(""))
    return F.coalesce(digits, F.try_element_at(number, word), count(phrase))


def attribute_fit(value: Column, title: Column, tax: Taxonomy = DEFAULT) -> Column:
    v = F.nullif(F.trim(F.regexp_replace(t.normalize(value), r"\bfit\b", "")), F.lit(""))
    f = F.coalesce(t.fit(v, tax), F.get(F.split(v, " "), F.lit(0)), t.fit(title, tax))
    return F.coalesce(F.try_element_at(t.literal_map(vocab.ATTRIBUTE_FIT_NAMES), f), f)


def canonical(title: Column, colour: Column, attributes: Column, description: Column, origin: Column, tax: Taxonomy = DEFAULT) -> Column:
    """The struct of all canonical attributes; a stated field comes before free text."""
    s = F.concat(F.coalesce(title, F.lit("")), F.lit(" "), F.coalesce(description, F.lit("")))
    said = lambda name: stated(attributes, name, tax)
    ruled = lambda name, rules, otherwise: t.first_rule(F.coalesce(said(name), otherwise), rules)
    f = fabric(F.coalesce(said("fabric"), s))
    plain = lambda c: F.when(c.isNotNull(), t.normalize(c))
    return F.struct(
        attribute_fit(said("fit"), title, tax).alias("fit"),
        ruled("rise", vocab.RISES, s).alias("rise"),
        ruled("wash", vocab.FADES, s).alias("fade"),
        t.first_rule(s, vocab.DISTRESS).alias("distress"),
        F.when(said("pattern").isNotNull(), F.coalesce(t.pattern(said("pattern")), t.normalize(said("pattern")))).otherwise(t.pattern(title)).alias("pattern"),
        plain(colour).alias("color"),
        f["primary"].alias("material"),
        f.alias("fabricComposition"),
        stretch(f, s).alias("stretch"),
        ruled("closure", vocab.CLOSURES, s).alias("closure"),
        pockets(said("pockets"), s).alias("pockets"),
        ruled("neck", vocab.NECKS, title).alias("neck"),
        ruled("sleeve", vocab.SLEEVES, title).alias("sleeve"),
        plain(said("washCare")).alias("washCare"),
        plain(said("weave")).alias("weave"),
        ruled("occasion", vocab.OCCASIONS, s).alias("occasion"),
        plain(origin).alias("countryOfOrigin"),
    )


def text_agreement(a: Column, b: Column) -> Column:
    """1 if equal, 0.9 if one's words hold the other's, else their Jaccard index."""
    x, y = F.array_distinct(t.words(a)), F.array_distinct(t.words(b))
    both = F.size(F.array_intersect(x, y))
    return (
        F.when((t.normalize(a) == t.normalize(b)) & (t.normalize(a) != ""), 1.0)
        .when(both == 0, 0.0)
        .when((both == F.size(x)) | (both == F.size(y)), 0.9)
        .otherwise(t.jaccard(x, y))
    )


def fabric_agreement(a: Column, b: Column) -> Column:
    share = lambda f: F.get(F.filter(f["composition"], lambda c: c["material"] == a["primary"]), F.lit(0))["pct"]
    gap = F.abs(share(a) - share(b))
    return F.when(a["primary"] != b["primary"], 0.0).when(gap.isNull(), 0.85).when(gap <= 2, 1.0).when(gap <= 10, 0.75).otherwise(0.4)


def agreement(a: Column, b: Column) -> Column:
    """(score, compared, agreed, fields) over the attributes that both sides declare, by weight."""
    fields = []
    for name, weight in vocab.ATTRIBUTE_WEIGHTS.items():
        x, y = a[name], b[name]
        if name == "material":
            value = fabric_agreement(a["fabricComposition"], b["fabricComposition"])
        elif name == "pockets":
            value = F.when(x == y, 1.0).when(F.abs(x - y) == 1, 0.5).otherwise(0.0)
        elif name in ("washCare", "weave", "occasion"):
            value = text_agreement(x, y)
        else:
            value = (x == y).cast("double")
        value = F.when(x.isNotNull() & y.isNotNull(), value)
        fields.append(F.struct(F.lit(name).alias("key"), F.lit(weight).alias("weight"), value.alias("agreement")))
    listed = F.array(*fields)
    known = F.filter(listed, lambda f: f["agreement"].isNotNull())
    total = lambda g: F.aggregate(known, F.lit(0.0), lambda s, f: s + g(f))
    verdict = lambda v: F.when(v.isNull(), "na").when(v >= 0.99, "match").when(v >= 0.5, "partial").otherwise("differ")
    return F.struct(
        F.round(F.try_divide(total(lambda f: f["agreement"] * f["weight"]), total(lambda f: f["weight"])), 4).alias("score"),
        F.size(known).alias("compared"),
        F.size(F.filter(known, lambda f: f["agreement"] >= 0.99)).alias("agreed"),
        F.transform(listed, lambda f: F.struct(f["key"].alias("key"), f["agreement"].alias("agreement"), verdict(f["agreement"]).alias("verdict"))).alias("fields"),
    )


def content_quality(available: Column, description: Column, attributes: Column, bullets: Column, images: Column, image: Column, video: Column) -> Column:
    """Counts of a detail page's content; all unknown where the page couldn't be read."""
    n = F.size(F.filter(F.split(F.coalesce(description, F.lit("")), r"\s+"), lambda w: w != ""))
    specs = F.when(attributes.isNull(), 0).otherwise(F.size(F.map_keys(attributes)))
    on = F.coalesce(available, F.lit(False))
    return F.struct(
        F.when(on, n).alias("descriptionWords"), F.when(on, F.coalesce(bullets, specs)).alias("bulletPoints"), F.when(on, specs).alias("specificationsListed"),
        F.when(on, F.coalesce(images, image.isNotNull().cast("int"))).alias("imageCount"), F.when(on, F.coalesce(video, F.lit(False))).alias("videoAvailable"), on.alias("available"),
    )
