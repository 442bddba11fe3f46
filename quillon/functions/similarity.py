"""Similarity kernels: words, trigrams, concepts, vectors, colours and images, as column expressions.

Kernels over large vocabularies (IDF) are joins, in ``quillon.operators.matching``; here each works
on the values of one row.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillon.functions import attributes as att
from quillon.functions import text as t
from quillon.functions import vocab
from quillon.functions.vocab import DEFAULT, Taxonomy


Weight = Callable[[Column], Column]


def semantic_tokens(s: Column, tax: Taxonomy = DEFAULT) -> Column:
    same = t.literal_map(tax.synonyms)
    kept = F.filter(t.words(s), lambda w: (F.length(w) > 1) & ~w.isin(*vocab.SEMANTIC_STOP))
    return F.transform(kept, lambda w: F.coalesce(F.try_element_at(same, w), w))


def _cosine(a: Column, b: Column, weight: Callable[[Column], Column] | None = None) -> Column:
    """Of two arrays as bags; 0 if either is empty."""
    count = lambda bag, x: F.size(F.filter(bag, lambda y: y == x)).cast("double")
    w = weight or (lambda x: F.lit(1.0))
    add = lambda items, f: F.aggregate(items, F.lit(0.0), lambda s, x: s + f(x))
    dot = add(F.array_intersect(a, b), lambda x: count(a, x) * count(b, x) * w(x) * w(x))
    norm = lambda bag: add(F.array_distinct(bag), lambda x: F.pow(count(bag, x) * w(x), 2))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(F.coalesce(F.try_divide(dot, F.sqrt(norm(a) * norm(b))), F.lit(0.0)))


def token_cosine(a: Column, b: Column, idf: Column | None = None, tax: Taxonomy = DEFAULT) -> Column:
    """``idf``: a map of weights; without one, or for words outside it, the weight is 1."""
    weight = None if idf is None else lambda w: F.coalesce(F.try_element_at(idf, w), F.lit(1.0))
    return _cosine(semantic_tokens(a, tax), semantic_tokens(b, tax), weight)


def trigrams(s: Column) -> Column:
    """Character trigrams of the normalised text with a space at either end."""
    padded = F.concat(F.lit(" "), t.normalize(s), F.lit(" "))
    n = F.length(padded) - 2
    return F.when(n > 0, F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.substring(padded, i, F.lit(3)))).otherwise(F.array().cast("array<string>"))


def trigram_cosine(a: Column, b: Column) -> Column:
    return _cosine(trigrams(a), trigrams(b))


def concepts(s: Column, tax: Taxonomy = DEFAULT) -> Column:
    """What a text says of a product."""
    found = {
        "garment": t.garment(s, tax=tax), "gender": t.gender(s), "fit": t.fit(s, tax), "pattern": t.pattern(s), "neck": t.first_rule(s, vocab.NECKS),
        "sleeve": t.first_rule(s, vocab.SLEEVES), "rise": t.first_rule(s, vocab.RISES), "closure": t.first_rule(s, vocab.CLOSURES),
        "occasion": t.first_rule(s, vocab.OCCASIONS), "material": att.fabric(t.normalize(s))["primary"], "color": t.colour_word(s),
    }
    return F.struct(*[c.alias(n) for n, c in found.items()])


def concept_overlap(a: Column, b: Column) -> Column:
    """Weighted agreement of two concept structs over what both say; a critical contradiction leaves 0.3 of it."""
    pairs = F.array(*[F.struct(F.lit(w).alias("w"), (a[n] == b[n]).alias("same"), F.lit(n in vocab.CRITICAL_CONCEPTS).alias("critical")) for n, w in vocab.CONCEPT_WEIGHTS.items()])
    known = F.filter(pairs, lambda p: p["same"].isNotNull())
    add = lambda f: F.aggregate(known, F.lit(0.0), lambda s, p: s + f(p))
    score = F.try_divide(add(lambda p: F.when(p["same"], p["w"]).otherwise(0.0)), add(lambda p: p["w"]))
    return score * F.when(F.exists(known, lambda p: p["critical"] & ~p["same"]), vocab.CRITICAL_FACTOR).otherwise(1.0)


def bag(items: Column) -> Column:
    """(counts, norm2) of an array's items: what a cosine needs of one side."""
    count = lambda x: F.size(F.filter(items, lambda y: y == x)).cast("double")
    counts = F.map_from_entries(F.transform(F.array_distinct(items), lambda x: F.struct(x, count(x))))
    return F.struct(counts.alias("counts"), F.aggregate(F.array_distinct(items), F.lit(0.0), lambda s, x: s + F.pow(count(x), 2)).alias("norm2"))


def bag_cosine(a: Column, b: Column) -> Column:
    """Of two bags; 0 if either is empty."""
    both = F.array_intersect(F.map_keys(a["counts"]), F.map_keys(b["counts"]))
    dot = F.aggregate(both, F.lit(0.0), lambda s, x: s + F.try_element_at(a["counts"], x) * F.try_element_at(b["counts"], x))
    return F.coalesce(F.try_divide(dot, F.sqrt(a["norm2"] * b["norm2"])), F.lit(0.0))


def text_profile(s: Column, tax: Taxonomy = DEFAULT) -> Column:
    """What similarity needs of a text, so that it is derived once a text and not once a pair."""
    return F.struct(semantic_tokens(s, tax).alias("tokens"), bag(trigrams(s)).alias("trigrams"), concepts(s, tax).alias("concepts"), (F.coalesce(s, F.lit("")) != "").alias("some"))


def _mixed(a: Column, b: Column, weight: Weight | None, token_share: float, lexical_share: float) -> Column:
    lexical = token_share * _cosine(a["tokens"], b["tokens"], weight) + (1 - token_share) * bag_cosine(a["trigrams"], b["trigrams"])
    con = concept_overlap(a["concepts"], b["concepts"])
    return F.when(a["some"] & b["some"], F.round(F.coalesce(lexical_share * lexical + (1 - lexical_share) * con, lexical), 4))


def title_similarity(a: Column, b: Column, weight: Weight | None = None) -> Column:
    """Of two profiles of titles: words lead, concepts support. ``weight``: of a token; 1 without it."""
    return _mixed(a, b, weight, 0.62, 0.62)


def description_similarity(a: Column, b: Column, weight: Weight | None = None) -> Column:
    """Of two profiles of descriptions: concepts lead."""
    return _mixed(a, b, weight, 0.7, 0.4)


def vector_cosine(a: Column, b: Column) -> Column:
    add = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return F.coalesce(F.try_divide(add(a, b), F.sqrt(add(a, a) * add(b, b))), F.lit(0.0))


def lab(r: Column, g: Column, b: Column) -> Column:
    """sRGB (0-255) as CIE L*a*b* under D65."""
    linear = [F.when(c / 255.0 > 0.04045, F.pow((c / 255.0 + 0.055) / 1.055, 2.4)).otherwise(c / 255.0 / 12.92) for c in (r, g, b)]
    # The sRGB matrix and the D65 white point.
    matrix = ((0.4124, 0.3576, 0.1805), (0.2126, 0.7152, 0.0722), (0.0193, 0.1192, 0.9505))
    white = (0.95047, 1.0, 1.08883)
    xyz = [sum(m * c for m, c in zip(row, linear, strict=True)) / w for row, w in zip(matrix, white, strict=True)]
    x, y, z = (F.when(v > 0.008856, F.cbrt(v)).otherwise(7.787 * v + 16 / 116) for v in xyz)
    return F.array(116 * y - 16, 500 * (x - y), 200 * (y - z))


def delta_e(a: Column, b: Column) -> Column:
    """CIE76 distance to one decimal."""
    return F.round(F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: F.pow(x - y, 2)), F.lit(0.0), lambda s, v: s + v)), 1)


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def image_similarity(lab_a: Column, lab_b: Column, hash_a: Column, hash_b: Column) -> Column:
    """(score, deltaE, confirmed, rejected) of two signatures; colour leads, structure supports."""
    d = delta_e(lab_a, lab_b)
    colour, structure = 1 / (1 + F.pow(d / 18, 2)), 1 - hamming(hash_a, hash_b) / 64
    score = F.coalesce(0.72 * colour + 0.28 * structure, colour, structure)
    return F.struct(F.round(score, 4).alias("score"), d.alias("deltaE"), F.coalesce(d <= 15, F.lit(False)).alias("confirmed"), F.coalesce(d > 26, F.lit(False)).alias("rejected"))
