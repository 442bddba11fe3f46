"""Text normalisation and product classification as column expressions.

Unknown is null throughout and is never taken for a difference. Classifiers are ordered rules, the first
that matches wins, and stay inside the JVM.
"""

from __future__ import annotations

from collections.abc import Iterable
from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillon.functions import vocab
from quillon.functions.vocab import DEFAULT, Taxonomy


def _sql(x: str | int | float) -> str:
    return "'" + x.replace("\\", "\\\\").replace("'", "\\'") + "'" if isinstance(x, str) else f"{x!r}D" if isinstance(x, float) else repr(x)


def literal_map(values: dict) -> Column:
    """One expression for the driver, however many entries there are."""
    return F.expr("map(" + ", ".join(_sql(x) for x in chain.from_iterable(values.items())) + ")")


def literal_array(values: Iterable) -> Column:
    return F.expr("array(" + ", ".join(map(_sql, values)) + ")")


def normalize(s: Column) -> Column:
    """Lower case; runs of anything but a-z and 0-9 are one space; '' for null."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(s, F.lit(""))), "[^a-z0-9]+", " "))


def words(s: Column) -> Column:
    """Words of the normalised text."""
    return F.filter(F.split(normalize(s), " "), lambda w: w != "")


def first_rule(text: Column, rules: Iterable[tuple[str, str]]) -> Column:
    """The name of the first rule whose pattern the normalised text holds."""
    t = normalize(text)
    return F.coalesce(*[F.when(t.rlike(p), F.lit(n)) for n, p in rules])


def brand(s: Column, tax: Taxonomy = DEFAULT) -> Column:
    n = normalize(s)
    return F.coalesce(F.try_element_at(literal_map(tax.brand_aliases), n), n)


def tokens(s: Column, keep_stop: bool = False) -> Column:
    """Words of two letters or more, without stop words unless they are to be kept."""
    long = F.filter(words(s), lambda w: F.length(w) > 1)
    return long if keep_stop else F.filter(long, lambda w: ~w.isin(*vocab.TITLE_STOP))


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays as sets; 0 if either is empty."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(F.try_divide(both.cast("double"), F.size(F.array_union(a, b)).cast("double")))


def brand_score(a: Column, b: Column, tax: Taxonomy = DEFAULT) -> Column:
    return brand_agreement(brand(a, tax), brand(b, tax))


def brand_agreement(x: Column, y: Column) -> Column:
    """Of two canonical brands."""
    j = jaccard(F.split(x, " "), F.split(y, " "))
    return (
        F.when((x == "") | (y == ""), 0.0)
        .when(x == y, 1.0)
        .when(x.contains(y) | y.contains(x), 0.85)
        .otherwise(F.when(j >= 0.5, 0.6 + j * 0.2).otherwise(j * 0.4))
    )


def gender(text: Column) -> Column:
    return first_rule(text, vocab.GENDERS)


def gender_from_code(code: Column) -> Column:
    """From a category code whose first letter says it."""
    return F.try_element_at(literal_map({"M": "men", "W": "women", "B": "boys", "G": "girls"}), F.upper(F.substring(code, 1, 1)))


def gender_compatible(a: Column, b: Column) -> Column:
    """Compatible in both sex and age; an unknown one never contradicts."""
    ok = []
    for axis in (0, 1):
        of = literal_map({g: x[axis] for g, x in vocab.GENDER_AXES.items()})
        x, y = F.try_element_at(of, a), F.try_element_at(of, b)
        ok.append(F.coalesce((x == "any") | (y == "any") | (x == y), F.lit(True)))
    return ok[0] & ok[1]


def garment(text: Column, article: Column | None = None, tax: Taxonomy = DEFAULT) -> Column:
    found = first_rule(text, tax.garments)
    return found if article is None else F.coalesce(found, first_rule(article, tax.garments))


def fit(text: Column, tax: Taxonomy = DEFAULT) -> Column:
    return first_rule(text, [(vocab.FIT_NAMES.get(f, f), rf"\b{f}\b") for f in tax.fits])


def pattern(text: Column) -> Column:
    return first_rule(text, vocab.PATTERNS)


def colour_family(name: Column, tax: Taxonomy = DEFAULT) -> Column:
    """The family of the last word that names a colour."""
    of = literal_map({**{c: c for c in vocab.BASE_COLOURS}, **tax.colour_family})
    families = F.transform(F.reverse(words(name)), lambda w: F.try_element_at(of, w))
    return F.get(F.filter(families, lambda f: f.isNotNull()), F.lit(0))


def colour_word(text: Column) -> Column:
    """The first word of the vocabulary, in its order, that the text holds."""
    return first_rule(text, [(c, rf"\b{c}\b") for c in vocab.COLOUR_WORDS])


def last_colour_word(colour: Column, title: Column | None = None) -> Column:
    last = lambda c: F.try_element_at(words(c), F.lit(-1))
    return last(colour) if title is None else F.coalesce(last(colour), last(title))


def colour_affinity(a_colour: Column, c_colour: Column, c_title: Column) -> Column:
    """1 if the last words agree, else 0; orders candidates and decides nothing."""
    return F.coalesce((last_colour_word(a_colour) == last_colour_word(c_colour, c_title)).cast("int"), F.lit(0))


def strip_brand(title: Column, brand_: Column) -> Column:
    """The normalised title without any word of the brand."""
    own = tokens(brand_, keep_stop=True)
    return F.array_join(F.filter(words(title), lambda w: ~F.array_contains(own, w)), " ")


def distinctive(title: Column, brand_: Column) -> Column:
    own = tokens(brand_, keep_stop=True)
    drop = (*vocab.COLOUR_WORDS, *vocab.GENERIC)
    return F.filter(tokens(title), lambda w: ~w.isin(*drop) & ~F.array_contains(own, w))


UNIT = r"^\d+(ml|gm|gms|g|kg|cm|mm|in|inch|tc|gsm|w|hz|mah|hr|hrs|day|days|pc|pcs|pack)$"
SIZE = r"^(x{0,3}[sl]|\d+x[sl]|\d+[a-f])$"


def strong_codes(text: Column) -> Column:
    """Model codes of letters and digits that are neither size nor unit."""
    ok = lambda w: F.length(w).between(3, 12) & w.rlike("[0-9]") & w.rlike("[a-z]") & ~w.rlike(SIZE) & ~w.rlike(UNIT)
    return F.array_distinct(F.filter(words(text), ok))


def weak_codes(text: Column) -> Column:
    """Numbers of three to six digits."""
    return F.array_distinct(F.filter(words(text), lambda w: w.rlike("^[0-9]{3,6}$")))


def model_score(a: Column, b: Column) -> Column:
    """Of two texts; see ``code_score``."""
    return code_score(strong_codes(a), strong_codes(b), weak_codes(a), weak_codes(b))


def code_score(sa: Column, sb: Column, wa: Column, wb: Column) -> Column:
    """1: a strong code is shared; 0: both have strong ones and share none; weak ones say less; null: nothing to go by."""
    return (
        F.when(F.arrays_overlap(sa, sb), 1.0)
        .when((F.size(sa) > 0) & (F.size(sb) > 0), 0.0)
        .when(F.arrays_overlap(wa, wb), 0.85)
        .when((F.size(wa) > 0) & (F.size(wb) > 0), 0.25)
    )


def code_conflict(sa: Column, sb: Column) -> Column:
    return (F.size(sa) > 0) & (F.size(sb) > 0) & ~F.arrays_overlap(sa, sb)


# Size orders and aliases; exports and charts fold XXL in opposite directions.
EXPORT_SIZES = ("XXS", "XS", "S", "M", "L", "XL", "XXL", "3XL", "4XL", "5XL", "FREE SIZE", "ONE SIZE")
EXPORT_ALIASES = {"2XL": "XXL", "2XS": "XXS", "XXXL": "3XL", "FREE": "FREE SIZE", "OS": "ONE SIZE"}
CHART_LETTERS = ("XXS", "XS", "S", "M", "L", "XL")


def export_size(s: Column) -> Column:
    """A size label for exports; null for blank ones and those of more than 12 letters."""
    t = F.upper(F.trim(F.regexp_replace(s, r"\s+", " ")))
    return F.when((F.length(t) > 0) & (F.length(t) <= 12), F.coalesce(F.try_element_at(literal_map(EXPORT_ALIASES), t), t))


def export_size_order(s: Column) -> list[Column]:
    """Sort keys of export sizes: clothing order, then numbers, then letters."""
    rank = F.try_element_at(literal_map({n: i for i, n in enumerate(EXPORT_SIZES)}), s)
    number = s.try_cast("double")
    return [F.coalesce(rank, F.when(number.isNotNull(), 100).otherwise(200)), number.asc_nulls_last(), s]


def chart_size(s: Column) -> Column:
    """A size label for charts."""
    t = F.upper(F.regexp_replace(F.coalesce(s, F.lit("")), r"\s+", ""))
    many, number = F.regexp_extract(t, r"^(X{2,})L$", 1), F.regexp_extract(t, r"^0*([0-9]+)XL$", 1)
    named = F.when(many != "", F.concat(F.length(many).cast("string"), F.lit("XL"))).when(number != "", F.concat(number, F.lit("XL")))
    return F.when(t == "", F.lit(None)).when(t.isin("FREE", "FREESIZE", "ONESIZE", "OS"), "FREE").otherwise(F.coalesce(named, t))


def size_rank(s: Column) -> Column:
    """Order of chart sizes: letters, 2XL and up, numbers, the rest."""
    letters = literal_map({n: float(i) for i, n in enumerate(CHART_LETTERS)})
    more = F.regexp_extract(s, r"^([0-9]+)XL$", 1).try_cast("double") + len(CHART_LETTERS)
    return F.coalesce(F.try_element_at(letters, s), more, s.try_cast("double") + 1000, F.lit(2000.0))


# Chart axes, in display order, with their spellings.
AXES = {
    "Chest": ("chest", "bust", "to fit chest", "to fit bust", "chest width"), "Waist": ("waist", "to fit waist", "waist width"),
    "Hip": ("hip", "hips", "to fit hip", "to fit hips"), "Shoulder": ("shoulder", "across shoulder", "shoulder width", "across shoulders"),
    "Front Length": ("front length", "length front"), "Back Length": ("back length", "length back"), "Length": ("length", "garment length", "total length"),
    "Sleeve Length": ("sleeve length", "sleeve", "sleeves length"), "Inseam": ("inseam", "inseam length", "inside leg", "inside leg length"),
    "Thigh": ("thigh", "thigh width"), "Leg Opening": ("leg opening", "bottom hem", "hem", "bottom width"), "Neck": ("neck", "collar", "neck size"),
    "Foot Length": ("foot length", "to fit foot length", "footlength"), "Cuff": ("cuff", "cuff width"),
}


def chart_axis(raw: Column, basis: Column | None = None) -> Column:
    """(axis, basis) of a chart's column: without ordinal and unit, by its known spellings, else in title case."""
    t = F.regexp_replace(F.coalesce(raw, F.lit("")), r"^\s*\d+\s*[.)]\s*", "")
    t = F.regexp_replace(F.regexp_replace(t, r"(?i)\((?:in|inch|inches|cm|cms)\)", ""), "[_-]+", " ")
    t = F.lower(F.trim(F.regexp_replace(t, r"\s+", " ")))
    known = F.try_element_at(literal_map({a: n for n, spelled in AXES.items() for a in spelled}), t)
    said = F.when(t.rlike(r"^to fit\b"), "body").otherwise("garment")
    return F.when(t != "", F.struct(F.coalesce(known, F.initcap(t)).alias("axis"), (said if basis is None else F.coalesce(basis, said)).alias("basis")))


def axis_order(axis: Column) -> Column:
    return F.coalesce(F.try_element_at(literal_map({n: i for i, n in enumerate(AXES)}), axis), F.lit(len(AXES)))


def host_kind(url: Column, hosts: dict[str, str]) -> Column:
    """The platform of a link by its host; ``hosts`` maps platforms to patterns."""
    host = F.lower(F.try_parse_url(F.trim(url), F.lit("HOST")))
    return F.coalesce(*[F.when(host.rlike(p), F.lit(n)) for n, p in hosts.items()])


def product_id(s: Column) -> Column:
    """An upper-cased product id: bare (two letters and digits), behind /p- in a path, or as a query parameter."""
    t = F.trim(s)
    part = lambda p: F.nullif(F.regexp_extract(t, p, 1), F.lit(""))
    return F.upper(F.coalesce(F.when(t.rlike(r"(?i)^[a-z]{2}\d{6,}$"), t), part(r"(?i)/p-([a-z0-9]+)"), part(r"(?i)[?&]productId=([a-z0-9]+)")))


def hint_id(platform: Column, url: Column) -> Column:
    """The product id in a rival's link, by where each platform's links have it; null for anything else."""
    path = F.try_parse_url(F.trim(url), F.lit("PATH"))
    part = lambda p: F.nullif(F.regexp_extract(path, p, 1), F.lit(""))
    # The paths of the platforms' product pages.
    return F.when(platform == "myntra", part(r"/(\d+)/buy")).when(platform == "ajio", part(r"/p/(\w+)"))


def plain(html: Column) -> Column:
    """Text without tags; line breaks and tags are spaces."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(html, r"(?i)<br\s*/?>", " "), r"<[^>]+>", " "), r"\s+", " "))


def measurement(s: Column) -> Column:
    """(lo, hi, value) of '36', '36 - 38' or '36–38'; a sign counts only before a number that stands alone."""
    t = F.regexp_replace(F.coalesce(s.cast("string"), F.lit("")), "[–—]", " - ")
    n = F.transform(F.regexp_extract_all(t, F.lit(r"-?\d+(?:\.\d+)?"), F.lit(0)), lambda x: x.try_cast("double"))
    lo, hi = F.array_min(n), F.array_max(n)
    return F.when(F.size(n) > 0, F.struct(lo.alias("lo"), hi.alias("hi"), ((lo + hi) / 2).alias("value")))


def rupees(n: Column) -> Column:
    """Indian digit grouping with the currency sign."""
    whole = F.abs(F.round(n)).cast("long").cast("string")
    head = F.regexp_replace(F.substring(whole, F.lit(1), F.length(whole) - 3), r"(\d)(?=(\d\d)+$)", "$1,")
    grouped = F.when(F.length(whole) <= 3, whole).otherwise(F.concat(head, F.lit(","), F.substring(whole, -3, 3)))
    return F.when(n.isNotNull(), F.concat(F.when(F.round(n) < 0, "-").otherwise(""), F.lit("₹"), grouped))


def truncated(s: Column, most: int = 260) -> Column:
    """Cut at a word's end, with an ellipsis."""
    cut = F.regexp_replace(F.substring(s, 1, most), r"\s+\S*$", "")
    return F.when(F.length(s) <= most, s).otherwise(F.concat(cut, F.lit("…")))


def age_text(seconds: Column) -> Column:
    """How long ago in words."""
    n = lambda unit: F.floor(seconds / unit).cast("string")
    return (
        F.when(seconds < 60, "just now")
        .when(seconds < 3600, F.concat(n(60), F.lit(" min ago")))
        .when(seconds < 86400, F.concat(n(3600), F.lit(" h ago")))
        .when(seconds >= 86400, F.concat(n(86400), F.lit(" d ago")))
    )


def queries(brand_: Column, gender_: Column, kind: Column, colour: Column, pattern_: Column, extra: Column) -> tuple[Column, Column]:
    """(shared, specific) search strings of a product's derived facts; they become blocking keys.

    The brand is the canonical one, so that spellings of a brand meet."""
    g = F.when(gender_ == "unisex", "").otherwise(F.coalesce(gender_, F.lit("")))
    k = F.coalesce(F.try_element_at(literal_map({"tshirt": "t-shirt", "polo": "polo t-shirt"}), kind), kind, F.lit(""))
    c, p = F.coalesce(colour, F.lit("")), F.coalesce(pattern_, F.lit(""))
    joined = lambda *parts: F.array_join(F.filter(F.array(*parts), lambda x: x != ""), " ")
    clean = lambda a: F.filter(F.array_distinct(a), lambda q: q != "")
    shared = clean(F.array(joined(brand_, g, k), joined(brand_, g, k, c)))
    specific = clean(F.array(joined(brand_, g, k, F.array_join(F.slice(extra, 1, 2), " ")), joined(brand_, g, k, p, c)))
    return shared, F.array_except(specific, shared)


def garment_from_path(path: Column, tax: Taxonomy = DEFAULT) -> Column:
    """From a breadcrumb, deepest part first."""
    return F.get(F.filter(F.transform(F.reverse(path), lambda p: garment(p, tax=tax)), lambda g: g.isNotNull()), F.lit(0))


def gender_from_detail(stated: Column, path: Column) -> Column:
    """From a stated gender, else from the breadcrumb's first part that has one."""
    return F.coalesce(gender(stated), F.get(F.filter(F.transform(path, gender), lambda g: g.isNotNull()), F.lit(0)))


def small_rendition(url: Column) -> Column:
    """An image link to a small rendition, where the link shows its size; others stay as they are."""
    # The renditions that the image hosts offer, by how their links show the size.
    shapes = ((r"/\d{3,4}Wx\d{3,4}H/", "/158Wx198H/"), (r"_\d{3,4}Wx\d{3,4}H_", "_158Wx198H_"), (r"-\d{3,4}Wx\d{3,4}H-", "-286Wx359H-"))
    params = ((r"([,(/])h_\d{3,4}", "$1h_256"), (r"([,(/])w_\d{3,4}", "$1w_192"), (r"([,(/])q_\d{2,3}", "$1q_60"), (r"dpr_\d", "dpr_1"))
    for pattern_, by in shapes:
        url = F.regexp_replace(url, pattern_, by)
    changed = url
    for pattern_, by in params:
        changed = F.regexp_replace(changed, pattern_, by)
    return F.when(url.contains("myntassets.com"), changed).otherwise(url)
