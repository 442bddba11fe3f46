"""Candidate retrieval, gates, evidence, ranking and decisions over whole catalogs.

Two shuffles are inherent: by blocking key and by (anchor, platform). Pairs carry ids and what is compared field by field, a few short texts; titles are
compared once for each pair of different titles that occurs. Gates come before detail joins, so that costly evidence is computed
for finalists only. Products that give the same profile are one line (``lined``): lines are paired, gated and compared, and prices are looked up for each line and
price in whole units (``nearest_prices``), so neither copies nor different prices cost pairs; an anchor takes the decision of its line and price. Ties have an
explicit order throughout. Profiles and pairs are stored once (``sources.shared``): several steps read them, and a lost executor takes nothing away.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillon.functions import attributes as att
from quillon.functions import decision as dec
from quillon.functions import similarity as sim
from quillon.functions import text as t
from quillon.functions.plan import computed_once, made_once
from quillon.functions.vocab import DEFAULT, EngineConfig, Taxonomy
from quillon.sources.shared import settled


def _steps(tax: Taxonomy) -> tuple[list[Column], list[Column], list[Column]]:
    """The columns of the three steps of a profile: what a later step uses several times is a column by then."""
    c = F.col
    one = [t.normalize(c("title")).alias("title"), t.brand(c("brand"), tax).alias("brand"), t.strip_brand(c("title"), c("brand")).alias("bare"), t.distinctive(c("title"), c("brand")).alias("extra")]
    facts = {
        "gender": F.coalesce(c("p.gender"), t.gender(F.concat_ws(" ", "brand", "title"))), "garment": t.garment(c("bare"), c("p.articleType"), tax),
        "fit": t.fit(c("title"), tax), "pattern": t.pattern(c("title")),
        "family": F.coalesce(t.colour_family(c("p.color"), tax), t.colour_family(c("title"), tax)), "colour": t.last_colour_word(c("p.color")),
        "any_colour": t.last_colour_word(c("p.color"), c("title")),
        "strong": t.strong_codes(c("title")), "weak": t.weak_codes(c("title")), "profile": sim.text_profile(c("title"), tax),
    }
    two = [c("p"), c("brand"), c("extra"), c("title").alias("name"), *[v.alias(n) for n, v in facts.items()]]
    shared, specific = t.queries(c("brand"), c("gender"), c("garment"), c("colour"), c("pattern"), c("extra"))
    f = F.struct("brand", c("name"), *[n for n in facts if n != "profile"], c("profile").alias("title"), shared.alias("shared"), specific.alias("specific"))
    return one, two, [c("p.*"), f.alias("f")]


def profiled(products: DataFrame, tax: Taxonomy = DEFAULT) -> DataFrame:
    """Products with ``f``, all that pairs are compared by, derived once a product: its canonical brand, gender, garment,
    fit, colour family and words, model codes, title profile and search keys."""
    one, two, three = made_once(("profile", repr(tax)), lambda: _steps(tax))
    given = F.struct(*[F.col(f"`{n}`") for n in products.columns]).alias("p")
    return computed_once(computed_once(computed_once(products, given, *one), *two), *three)


def weighted(rows: DataFrame, weights: DataFrame, at: str = "f.title", into: str = "w") -> DataFrame:
    """Rows with ``into``, a map of the weights of the tokens of their profile at ``at``: no vocabulary is collected.

    ``weights``: (token, idf, unseen) of ``idf_table``; a token that it lacks weighs ``unseen``. Equal token lists are looked up once."""
    tokens = F.col(f"{at}.tokens")
    each = rows.select(tokens.alias("_tokens")).distinct().select("_tokens", F.explode(F.array_distinct("_tokens")).alias("token"))
    unseen = F.coalesce(weights.agg(F.max("unseen")).scalar(), F.lit(1.0))
    known = each.join(weights.select("token", "idf"), "token", "left").groupBy("_tokens").agg(F.map_from_entries(F.collect_list(F.struct("token", F.coalesce("idf", unseen)))).alias(into))
    return rows.join(known, tokens == F.col("_tokens"), "left").drop("_tokens")


def weight_in(x: Column, y: Column) -> Callable[[Column], Column]:
    """The weight of a token of either of two products, by their maps ``w``."""
    return lambda token: F.coalesce(F.try_element_at(x, token), F.try_element_at(y, token), F.lit(1.0))


#: What gates look at.
GATED = ("brand", "gender", "garment", "fit", "family")
#: What is compared of a pair field by field.
COMPARED = ("brand", "name", "gender", "garment", "fit", "family", "colour", "any_colour", "strong", "weak")


def _thin(*fields: str) -> Column:
    """The named fields of a profiled row and those of its profile that are compared; ``kind``: what gates look at, as one text."""
    kind = F.to_json(F.struct(*[F.col(f"f.{n}").alias(n) for n in GATED])).alias("kind")
    return F.struct(*fields, F.struct(*[F.col(f"f.{n}").alias(n) for n in COMPARED], kind).alias("f"))


def blocked(anchors: DataFrame, listings: DataFrame, key: str = "shared") -> DataFrame:
    """(anchor_id, platform, listing_id, row, listing, query_ord) of profiled products that share a search key of a kind, once a pair: by the first key
    of the anchor that the listing has. That is told from the pair alone, so pairs are never sorted or shuffled to find their copies. ``row`` and
    ``listing`` are thin; of listings with one id on a platform the best ranked counts. Large keys are split by Spark's skew join."""
    keys, c = F.col(f"f.{key}").alias("keys"), F.col
    count = ["n"] if "n" in listings.columns else []  # of a kind of listings (``shelves``)
    own = anchors.select(_thin("id", "mrp").alias("row"), keys).select("row", "keys", F.posexplode("keys").alias("query_ord", "key"))
    theirs = listings.select(_thin("platform", "id", "price", "mrp", "rank_in_query", *count).alias("listing"), keys)
    theirs = theirs.groupBy(c("listing.platform").alias("platform"), c("listing.id").alias("listing_id")).agg(F.min_by(F.struct("listing", "keys"), "listing.rank_in_query").alias("l"))
    theirs = theirs.select("platform", "listing_id", c("l.listing").alias("listing"), c("l.keys").alias("other_keys"), F.explode("l.keys").alias("key"))
    earlier = F.slice("keys", F.lit(1), c("query_ord"))
    pairs = own.join(theirs, "key").where(~F.arrays_overlap(earlier, c("other_keys")))
    return pairs.select(c("row.id").alias("anchor_id"), "platform", "listing_id", "row", "listing", "query_ord")


def gates(a: Column, c: Column) -> Column:
    """Of two profiles. Only a proven contradiction fails a gate; null on either side passes."""
    brand = t.brand_agreement(a["brand"], c["brand"])
    same = lambda n: F.coalesce(a[n] == c[n], F.lit(True))
    multi = F.coalesce(a["family"] == "multi", F.lit(False)) | F.coalesce(c["family"] == "multi", F.lit(False))
    gender_ok = t.gender_compatible(a["gender"], c["gender"])
    return F.struct(
        brand.alias("brand"), (brand >= 0.8).alias("brandOk"), gender_ok.alias("genderOk"), same("garment").alias("garmentOk"), same("fit").alias("fitOk"),
        ((brand >= 0.8) & gender_ok & same("garment") & same("fit")).alias("pass"), multi.alias("colorMulti"),
        (F.coalesce(a["family"] != c["family"], F.lit(False)) & ~multi).alias("colorConflict"), (F.coalesce(a["family"] == c["family"], F.lit(False)) & ~multi).alias("colorAgree"),
    )


def gated(pairs: DataFrame) -> DataFrame:
    """Pairs with their ``gate``, which is computed once for each two classes of products that meet."""
    classed = pairs.withColumns({"_a": F.col("row.f.kind"), "_b": F.col("listing.f.kind")})
    kind = "struct<" + ",".join(f"{n}:string" for n in GATED) + ">"
    read = lambda c: F.from_json(c, kind)
    met = classed.select("_a", "_b").distinct().select(F.col("_a").alias("_x"), F.col("_b").alias("_y"), read("_a").alias("a"), read("_b").alias("b"))
    told = computed_once(met, "_x", "_y", made_once(("gates",), lambda: gates(F.col("a"), F.col("b")).alias("gate")))
    return classed.join(told, (F.col("_a") == F.col("_x")) & (F.col("_b") == F.col("_y"))).drop("_a", "_b", "_x", "_y")


def candidates(anchors: DataFrame, listings: DataFrame) -> DataFrame:
    """Gated pairs of profiled products, stored; anchors without a survivor are searched again by their specific keys."""
    shared = settled(gated(blocked(anchors, listings)), "pairs")
    done = shared.where("gate.pass").select(F.col("anchor_id").alias("id")).distinct()
    return shared.unionByName(settled(gated(blocked(anchors.join(done, "id", "left_anti"), listings, "specific")), "pairs"))


def title_classes_of(weights: DataFrame, *products: DataFrame) -> DataFrame:
    """(name, title, w): the different normalised titles of profiled products, with their profiles and the weights of their tokens, stored."""
    names = [p.select(F.col("f.name").alias("name"), F.col("f.title").alias("title")) for p in products]
    return settled(weighted(reduce(DataFrame.unionByName, names).dropDuplicates(["name"]), weights, "title"), "titles")


def title_scores(pairs: DataFrame, titles: DataFrame) -> DataFrame:
    """(own, other, title) for each pair of different titles that occurs among the pairs."""
    one = pairs.select(F.col("row.f.name").alias("own"), F.col("listing.f.name").alias("other")).distinct()
    side = lambda name, of: titles.select(F.col("name").alias(name), F.struct("title", "w").alias(of))
    both = one.join(side("own", "a"), "own").join(side("other", "b"), "other")
    score = made_once(("title",), lambda: sim.title_similarity(F.col("a.title"), F.col("b.title"), weight_in(F.col("a.w"), F.col("b.w"))).alias("title"))
    return both.select("own", "other", score)


def _signals() -> Column:
    a, c = F.col("row"), F.col("listing")
    x, y = a["f"], c["f"]
    affinity = F.coalesce((x["colour"] == y["any_colour"]).cast("int"), F.lit(0))
    model = t.code_score(x["strong"], y["strong"], x["weak"], y["weak"])
    return F.struct(F.col("title"), model.alias("model"), F.col("gate.brand"), affinity.alias("affinity"))


def evidence(pairs: DataFrame, titles: DataFrame) -> DataFrame:
    """Surviving pairs with the signals that prices don't change: title, model codes, brand and ``affinity``. ``titles``: see ``title_classes_of``."""
    passed = pairs.where("gate.pass")
    alike = title_scores(passed, titles)
    named = passed.join(alike, (F.col("row.f.name") == F.col("own")) & (F.col("listing.f.name") == F.col("other")))
    return computed_once(named, "anchor_id", "platform", "listing_id", "query_ord", "gate", "row", "listing", made_once(("signals",), _signals).alias("signals"))


def _refusal(config: EngineConfig, more: bool) -> list[Column]:
    """``rejected`` and ``proven`` of a pair (row, listing, gate), by its pictures (``more``) too."""
    x, y = F.col("row.f"), F.col("listing.f")
    delta, out = (F.col("more.image.deltaE"), F.col("more.image.rejected")) if more else (F.lit(None).cast("double"), F.lit(None).cast("boolean"))
    why = dec.rejection(F.col("gate.colorMulti"), delta, out, F.col("gate.colorAgree"), F.col("gate.colorConflict"), t.code_conflict(x["strong"], y["strong"]), config)
    shared = F.arrays_overlap(F.array_union(x["strong"], x["weak"]), F.array_union(y["strong"], y["weak"]))
    return [why.alias("rejected"), (F.col("gate.colorAgree") & shared).alias("proven")]


#: The signals of a pair of lines.
OF_LINES = ("title", "model", "brand")


def compared(pairs: DataFrame, config: EngineConfig = EngineConfig(), whole: bool = False) -> DataFrame:
    """Pairs of lines with their evidence as narrow rows, stored; with all that details are compared by, if ``whole``."""
    ids = [F.col("anchor_id").alias("own"), "platform", F.col("listing_id").alias("other"), "query_ord"]
    numbers = [F.col(f"signals.{n}") for n in (*OF_LINES, "affinity")]
    rows = computed_once(pairs, *ids, *numbers, F.col("gate.colorConflict").alias("conflict"), *_refusal(config, False), *(["row", "listing", "gate"] if whole else []))
    return settled(rows, "compared")


def offered(placed: DataFrame, scan: int) -> DataFrame:
    """(platform, line, cells): for each price in whole units of a line its first ``scan`` listings by (rank_in_query, id). ``placed``: see ``shelved``."""
    key = ("platform", "line", "cell")
    w = Window.partitionBy(*key).orderBy("rank_in_query", "id")
    some = placed.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= scan)
    cells = some.groupBy(*key).agg(F.sort_array(F.collect_list(F.struct("rank_in_query", "id", "price", "mrp"))).alias("members"))
    return cells.groupBy("platform", "line").agg(F.collect_list(F.struct("cell", "members")).alias("cells"))


def nearest_prices(wanted: DataFrame, offers: DataFrame, scan: int) -> DataFrame:
    """(platform, other, cell, best): of a line's listings the ``scan`` whose list prices are the best evidence at an anchor's price, by (rank_in_query, id)
    where it is the same; those without a price, which are no evidence, count apart. All others of the line rank behind them for every anchor of that price.

    ``wanted``: (platform, other: a line of listings, cell: an anchor's list price in whole units); ``offers``: see ``offered``."""
    c = F.col
    both = wanted.join(offers, (c("other") == c("line")) & (c("_p") == c("platform"))).drop("_p", "line")
    told = F.transform("cells", lambda x: F.struct((-dec.rounded_evidence(c("cell"), x["cell"])).alias("less"), x["members"].alias("members")))
    first = F.slice(F.sort_array(told), 1, scan + 1)  # a cell stands where its first listing does; the one without a price comes first
    each = F.flatten(F.transform(first, lambda x: F.transform(x["members"], lambda m: F.struct(x["less"].alias("less"), m["rank_in_query"].alias("rank_in_query"), m["id"].alias("id"),
        m["price"].alias("price"), m["mrp"].alias("mrp")))))
    sorted_ = computed_once(both, "platform", "other", "cell", F.sort_array(each).alias("best"))
    unknown = F.size(F.filter("best", lambda x: x["less"].isNull()))
    return sorted_.withColumn("best", F.slice("best", F.lit(1), F.lit(scan) + unknown))


def priced(pairs: DataFrame, anchors: DataFrame, placed: DataFrame, config: EngineConfig = EngineConfig()) -> DataFrame:
    """Finalists of each kind of anchors and platform, from pairs of lines (``compared``): a line's listings are looked up once for each price that is asked of it."""
    c = F.col
    asked = settled(anchors.select("line", "kind", F.round("mrp").alias("cell")).distinct(), "asked").withColumnRenamed("line", "own")
    pairs = pairs.join(asked, "own")
    near = nearest_prices(pairs.select(c("platform").alias("_p"), "other", "cell").distinct(), offered(placed, config.scan), config.scan)
    near = near.select(c("platform").alias("_p"), c("other").alias("_o"), c("cell").alias("_c"), "best")
    met = pairs.join(near, (c("platform") == c("_p")) & (c("other") == c("_o")) & c("cell").eqNullSafe(c("_c"))).drop("_p", "_o", "_c", "cell")
    named = met.withColumnRenamed("kind", "anchor_id").repartition("anchor_id", "platform")
    each = named.select("*", F.inline("best")).drop("best").withColumn("signal", -c("less")).drop("less")
    score = dec.blend({"mrp": c("signal")} | {n: c(n) for n in OF_LINES})["score"]
    return finalists(each.withColumn("score", score), config)


def finalists(scored: DataFrame, config: EngineConfig = EngineConfig()) -> DataFrame:
    """The best ``scan`` survivors of each anchor and platform, with ``rank`` and ``batch``."""
    order = (F.coalesce(F.col("score"), F.lit(0.0)) + 0.1 * F.col("affinity")).desc()
    w = Window.partitionBy("anchor_id", "platform").orderBy(order, "query_ord", "rank_in_query", "id")
    ranked = scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= config.scan)
    return ranked.withColumn("batch", F.ceil(F.col("rank") / config.enrich).cast("int"))


def judged(final: DataFrame, details: DataFrame | None = None, config: EngineConfig = EngineConfig(), weights: DataFrame | None = None, tax: Taxonomy = DEFAULT) -> DataFrame:
    """Finalists with full evidence and their reason of rejection; a later batch counts only if all earlier ones were rejected.

    ``details``: (platform, id, title, color, description, attributes, countryOfOrigin, lab, dhash), anchors under the platform 'anchor'; then the
    finalists are of anchors and have row, listing and gate."""
    if details is None:
        return batches(final.withColumn("image", F.lit(None).cast("double")), "anchor_id", "platform")
    c = F.col
    known = computed_once(details, "platform", "id", "lab", "dhash",
        att.canonical(c("title"), c("color"), c("attributes"), c("description"), c("countryOfOrigin"), tax).alias("attrs"), sim.text_profile(c("description"), tax).alias("text"))
    known = known.withColumn("w", F.lit(None).cast("map<string,double>")) if weights is None else weighted(known, weights, "text")
    own = known.where("platform = 'anchor'").select(c("id").alias("anchor_id"), F.struct("*").alias("da"))
    theirs = known.select(c("platform").alias("_p"), c("id").alias("_i"), F.struct("*").alias("dc"))
    both = final.join(own, "anchor_id", "left").join(theirs, (c("platform") == c("_p")) & (c("id") == c("_i")), "left").drop("_p", "_i")
    more = F.struct(
        att.agreement(c("da.attrs"), c("dc.attrs")).alias("am"), sim.image_similarity(c("da.lab"), c("dc.lab"), c("da.dhash"), c("dc.dhash")).alias("image"),
        sim.description_similarity(c("da.text"), c("dc.text"), None if weights is None else weight_in(c("da.w"), c("dc.w"))).alias("description"),
    )
    kept = [n for n in final.columns if n not in ("score", "rejected", "proven")]
    seen = computed_once(both, *kept, more.alias("more"))
    signals = {"mrp": c("signal")} | {n: c(n) for n in OF_LINES} | {"attributes": c("more.am.score"), "image": c("more.image.score"), "description": c("more.description")}
    score = dec.blend(signals, {"attributes": dec.attribute_scale(c("more.am.compared"))})["score"]
    full = computed_once(seen, *[n for n in kept if n not in ("row", "listing", "gate")], c("more.image.score").alias("image"), score.alias("score"), *_refusal(config, True))
    return batches(full, "anchor_id", "platform")


def batches(scored: DataFrame, *by: str) -> DataFrame:
    """Drops batches behind the first one that holds a viable candidate, of each anchor and platform or of ``by``."""
    w = Window.partitionBy(*(by or ("anchor_id", "listing.platform")))
    first = F.min(F.when(F.col("rejected").isNull(), F.col("batch"))).over(w)
    return scored.withColumn("_first", first).where("_first is null or batch <= _first").drop("_first")


def rivals(viable: DataFrame, config: EngineConfig = EngineConfig()) -> DataFrame:
    """Viable candidates with the best one beside each and ``tied``: as good within noise, at another price."""
    group = Window.partitionBy("anchor_id", "platform")
    order = group.orderBy(F.coalesce("score", F.lit(0.0)).desc(), "rank")
    best = lambda c: F.first(c).over(order)
    price = F.try_divide(F.abs(F.col("price") - best("price")), F.greatest(F.col("price"), best("price")))
    beaten = F.coalesce(best("image") - F.col("image") > config.image_dominance, F.lit(False))
    tied = (F.coalesce(best("score"), F.lit(0.0)) - F.coalesce("score",
        F.lit(0.0)) <= config.ambiguity_delta) & (F.col("id") != best("id")) & F.coalesce(price > config.price_tie, F.lit(False)) & ~beaten
    return viable.withColumn("n", F.row_number().over(order)).withColumn("tied", tied)


def barred(pages: DataFrame) -> DataFrame:
    """(anchor_id, platform) whose every page (anchor_id, platform, blocked) was blocked."""
    return pages.groupBy("anchor_id", "platform").agg(F.bool_and(F.coalesce("blocked", F.lit(False))).alias("b")).where("b").select("anchor_id", "platform")


def decisions(anchors: DataFrame, platforms: DataFrame, searched: DataFrame, scored: DataFrame, config: EngineConfig = EngineConfig(), pages: DataFrame | None = None,
    by: str = "kind") -> DataFrame:
    """One status for each anchor and platform, in the fixed order of precedence.

    ``anchors``: (id, mrp, line, kind); ``platforms``: (platform, blocked: on the whole); ``pages``: see ``barred``; ``searched``: all gated pairs of
    lines; ``scored``: judged finalists, of kinds or, ``by`` id, of anchors."""
    n = F.col("listing.n")
    seen = searched.groupBy(F.col("anchor_id").alias("line"), "platform").agg(F.sum(n).alias("scanned"), F.sum(F.when(F.col("gate.pass"), n).otherwise(0)).alias("survivors"))
    viable = rivals(scored.where("rejected is null"), config)
    best = viable.groupBy("anchor_id", "platform").agg(
        F.count_if("tied").alias("ties"), F.max(F.when(F.col("n") == 1, F.struct("id", "price", "mrp", "score", "proven", "conflict"))).alias("best"),
    )
    each = platforms.agg(F.sort_array(F.collect_list(F.struct("platform", "blocked")))).scalar()  # a handful of rows
    rows = anchors.select("id", "mrp", "line", "kind", each.alias("p")).select("id", "mrp", "line", "kind", F.inline("p"))
    if pages is not None:
        none = barred(pages).withColumnRenamed("anchor_id", "id").withColumn("_barred", F.lit(True))
        rows = rows.join(none, ["id", "platform"], "left").withColumn("blocked", F.coalesce("_barred", "blocked")).drop("_barred")
    rows = rows.join(seen, ["line", "platform"], "left").join(best.withColumnRenamed("anchor_id", by), [by, "platform"], "left").withColumnRenamed("id", "anchor_id")
    b = F.col("best")
    out = dec.strict_rejection(b["score"], F.col("mrp"), b["mrp"], b["proven"], config)
    status = (
        F.when(F.col("blocked"), "blocked")
        .when(F.coalesce("scanned", F.lit(0)) == 0, "no_results")
        .when(F.col("survivors") == 0, "no_match")
        .when(b.isNull(), "color_mismatch")
        .when(out.isNotNull(), "no_match")
        .when(F.lit(config.strict) & (F.col("ties") > 0), "ambiguous")
        .otherwise("matched")
    )
    tier = F.when(b["conflict"] & (b["score"] >= config.min_score), "PARTIAL MATCH").otherwise(dec.tier(b["score"], config))
    matched = F.col("status") == "matched"
    return rows.withColumn("status", status).select(
        "anchor_id", "platform", "status",
        F.when(F.col("status") == "no_match", F.when(F.col("survivors") == 0, "hard_gate").otherwise(out)).alias("rejectedBy"),
        F.when(matched, b["id"]).alias("listing_id"), F.when(matched, b["price"]).alias("price"), F.when(matched, b["score"]).alias("score"), F.when(matched, tier).alias("matchType"),
    )


#: What a profile is made of.
GIVEN = ("brand", "title", "color", "gender", "articleType")


#: What makes anchors or listings of a platform the same to all steps but details.
ALIKE = (*GIVEN, "mrp")


def lined(products: DataFrame, tax: Taxonomy = DEFAULT) -> tuple[DataFrame, DataFrame]:
    """(products, stored, with ``line``, a number for what gives them the same profile; (line, f): the profiles, stored). Profiles are dealt out before
    they are made: a profile costs more than a shuffle of what it is made of, however few files there are."""
    products = settled(products, "products")
    tasks = max(products.sparkSession.sparkContext.defaultParallelism, products.rdd.getNumPartitions())  # of what is stored: nothing is computed for it
    names = settled(products.select(*GIVEN).distinct().withColumn("line", F.monotonically_increasing_id()), "lines")
    lines = settled(profiled(names.repartition(tasks), tax).select("line", "f"), "profiles")
    names = names.withColumnsRenamed({n: f"_{n}" for n in GIVEN})
    return products.join(names, _same(GIVEN)).drop(*[f"_{n}" for n in GIVEN]), lines


def ready(products: DataFrame, tax: Taxonomy = DEFAULT) -> DataFrame:
    """Products with their profile; products and profiles are stored, profiles once for products that give them the same."""
    products, lines = lined(products, tax)
    return products.join(lines, "line").drop("line")


def _same(names: tuple[str, ...]) -> Column:
    return reduce(lambda x, y: x & y, (F.col(n).eqNullSafe(F.col(f"_{n}")) for n in names))


def kinds(anchors: DataFrame) -> DataFrame:
    """(id, kind), stored: the least id of the anchors that have the same ``ALIKE``."""
    rows = anchors.select("id", *ALIKE)
    least = rows.groupBy(*[F.col(n).alias(f"_{n}") for n in ALIKE]).agg(F.min("id").alias("kind"))
    return settled(rows.join(least, _same(ALIKE)).select("id", "kind").distinct(), "kinds")


def of_kinds(anchors: DataFrame, kinds_: DataFrame) -> DataFrame:
    """The anchors that stand for their kind."""
    return anchors.join(kinds_.where("id = kind").select("id").distinct(), "id", "left_semi")


def _best_ranked(listings: DataFrame, *columns: str) -> DataFrame:
    """(platform, id, columns): of listings with one id on a platform the best ranked one."""
    return listings.groupBy("platform", "id").agg(F.min_by(F.struct(*columns), "rank_in_query").alias("l")).select("platform", "id", "l.*")


def shelved(listings: DataFrame) -> DataFrame:
    """(platform, id, line, price, mrp, rank_in_query, cell: the list price in whole units) of listings with their line, one row for each id of a platform, stored."""
    return settled(_best_ranked(listings, "line", "price", "mrp", "rank_in_query").withColumn("cell", F.round("mrp")), "shelved")


def standing(lines: DataFrame, placed: DataFrame | None = None) -> DataFrame:
    """Lines as products that can be paired, under their number; those of listings for each platform, with ``n``, how many listings they have. They have no prices."""
    none = F.lit(None).cast("double").alias("mrp")
    if placed is None:
        return lines.select(F.col("line").alias("id"), none, "f")
    counts = placed.groupBy("platform", "line").agg(F.count("*").alias("n"))
    return counts.join(lines, "line").select("platform", F.col("line").alias("id"), none.alias("price"), none, F.lit(0).alias("rank_in_query"), "n", "f")


def kind() -> Column:
    """What anchors that get the same finalists have in common: their line and their list price in whole units."""
    return F.concat_ws(":", F.col("line").cast("string"), F.round("mrp").cast("string")).alias("kind")


def shelves(listings: DataFrame, scan: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Listings by kind: the same platform and ``ALIKE``; of listings with one id on a platform the best ranked counts.

    (the first listing of each kind, with its profile and ``n``, how many there are; (_platform, _kind, members): the first ``scan`` of each kind by
    (rank_in_query, id); (platform, id, kind) of all listings). A kind's name is the id of its first listing."""
    c, key = F.col, ("platform", *ALIKE)
    one = _best_ranked(listings, *ALIKE, "price", "rank_in_query")
    first = one.groupBy(*[c(n).alias(f"_{n}") for n in key]).agg(F.min(F.struct("rank_in_query", "id")).alias("_first"), F.count("*").alias("n"))
    placed = settled(one.join(first, _same(key)).select(*key, "id", "price", "rank_in_query", c("_first.id").alias("kind"), "n"), "shelves")
    w = Window.partitionBy("platform", "kind").orderBy("rank_in_query", "id")
    some = placed.withColumn("_rn", F.row_number().over(w)).where(c("_rn") <= scan)
    members = some.groupBy(c("platform").alias("_platform"), c("kind").alias("_kind")).agg(F.collect_list(F.struct("id", "price", "rank_in_query")).alias("members"))
    heads = placed.where("id = kind").select(*[c(n).alias(f"_{n}") for n in (*key, "id", "rank_in_query")], "n")
    stands = listings.join(heads, _same((*key, "id", "rank_in_query"))).drop(*[f"_{n}" for n in (*key, "id", "rank_in_query")]).dropDuplicates(["platform", "id"])
    return stands, settled(members, "members"), placed.select("platform", "id", "kind")


def title_weights(anchors: DataFrame, tax: Taxonomy = DEFAULT) -> DataFrame:
    """Token weights trained on brands and titles."""
    return idf_table(anchors.select(F.concat_ws(" ", F.coalesce("brand", F.lit("")), F.coalesce("title", F.lit(""))).alias("title")), tax=tax)


def decide(
    anchors: tuple[DataFrame, DataFrame], listings: tuple[DataFrame, DataFrame], platforms: DataFrame, weights: DataFrame, details: DataFrame | None = None,
    config: EngineConfig = EngineConfig(), tax: Taxonomy = DEFAULT, pages: DataFrame | None = None, placed: DataFrame | None = None,
) -> DataFrame:
    """The chain over products that are ``lined``, with given token weights. Lines are paired and compared; only with details, which anchors of a kind
    don't share, are finalists judged for each anchor. ``placed``: the listings as ``shelved``, if they are already."""
    placed = shelved(listings[0]) if placed is None else placed
    named = anchors[0].select("id", "mrp", "line", kind())
    own, theirs = standing(anchors[1]), standing(listings[1], placed)
    searched = candidates(own, theirs)
    pairs = compared(evidence(searched, title_classes_of(weights, own, theirs)), config, details is not None)
    whole = [n for n in ("row", "listing", "gate") if n in pairs.columns]
    final = priced(pairs.drop(*whole), named, placed, config)
    if details is not None:
        final = final.withColumnRenamed("anchor_id", "kind").join(named.select(F.col("id").alias("anchor_id"), "kind"), "kind").drop("kind")
        final = final.join(pairs.select("own", "platform", "other", *whole), ["own", "platform", "other"])
    scored = judged(final, details, config, weights, tax)
    return decisions(named, platforms, searched, scored, config, pages, "kind" if details is None else "id")


def match(
    anchors: DataFrame, listings: DataFrame, platforms: DataFrame, details: DataFrame | None = None, config: EngineConfig = EngineConfig(), tax: Taxonomy = DEFAULT,
    pages: DataFrame | None = None, weights: DataFrame | None = None,
) -> DataFrame:
    """The whole chain, for all anchors at once. Token weights are trained on the anchors' brands and titles unless they are given."""
    weights = title_weights(anchors, tax) if weights is None else weights
    return decide(lined(anchors, tax), lined(listings, tax), platforms, weights, details, config, tax, pages)


def idf_table(titles: DataFrame, column: str = "title", tax: Taxonomy = DEFAULT) -> DataFrame:
    """(token, df, idf) over all titles; ``unseen``: the weight of a token that none has."""
    rows = titles.select(F.array_distinct(sim.semantic_tokens(F.col(column), tax)).alias("w"))
    n = titles.agg(F.count("*")).scalar()
    counted = rows.select(F.explode("w").alias("token")).groupBy("token").agg(F.count("*").alias("df"))
    return counted.select("token", "df", (F.log((n + 1) / (F.col("df") + 1)) + 1).alias("idf"), (F.log(n + 1) + 1).alias("unseen"))


def cosine_pairs(titles: DataFrame, pairs: DataFrame, weights: DataFrame, tax: Taxonomy = DEFAULT) -> DataFrame:
    """IDF cosine of (a, b) pairs of title ids, as joins: no vocabulary is collected. ``titles``: (id, title)."""
    bags = titles.select("id", F.explode(sim.semantic_tokens(F.col("title"), tax)).alias("token")).groupBy("id", "token").agg(F.count("*").alias("c"))
    vectors = bags.join(weights.select("token", "idf"), "token").select("id", "token", (F.col("c") * F.col("idf")).alias("w"))
    norms = vectors.groupBy("id").agg(F.sum(F.col("w") * F.col("w")).alias("n2"))
    left, right = (vectors.select(F.col("id").alias(n), "token", F.col("w").alias(f"w{n}")) for n in ("a", "b"))
    dots = pairs.join(left, "a").join(right, ["b", "token"]).groupBy("a", "b").agg(F.sum(F.col("wa") * F.col("wb")).alias("dot"))
    na, nb = (norms.select(F.col("id").alias(n), F.col("n2").alias(f"n{n}")) for n in ("a", "b"))
    return pairs.join(dots, ["a", "b"], "left").join(na, "a", "left").join(nb, "b", "left").select("a", "b",
        F.coalesce(F.try_divide(F.col("dot"), F.sqrt(F.col("na") * F.col("nb"))), F.lit(0.0)).alias("cosine"))


def nearest(vectors: DataFrame, queries_: DataFrame, k: int, block: int = 4096) -> DataFrame:
    """The k vectors of another id that are most alike (cosine) to each query, among all rows of (vec_id, embedding): exact, no index.

    Queries go out in blocks of ``block`` rows, each a pass over the vectors, which a task multiplies ``SLICE`` by ``SLICE`` rows at a time; it keeps
    k rows for each query, so that only those are shuffled. A null or zero vector is alike to none (0)."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    asked = queries_.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    blocks = -(-asked.count() // block)
    found = None
    for b in range(blocks):
        mine = asked.where(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == b).toArrow()  # about `block` rows
        part = _nearest_block(rows, mine, k)
        found = part if found is None else found.unionByName(part)
    if found is None:
        found = rows.sparkSession.createDataFrame([], "query_id long, vec_id long, cosine double")
    w = Window.partitionBy("query_id").orderBy(F.col("cosine").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _unit_rows(column):
    """Vectors of an Arrow list column as a matrix of unit rows; those of another length than the first, null or zero are zero."""
    import numpy as np

    lists = column.to_pylist()
    size = next((len(x) for x in lists if x), 1)
    m = np.array([[v or 0.0 for v in x] if x is not None and len(x) == size else [0.0] * size for x in lists], float).reshape(len(lists), size)
    norm = np.linalg.norm(m, axis=1, keepdims=True)
    return np.divide(m, norm, out=np.zeros_like(m), where=norm > 0)


#: Queries and vectors whose cosines a task holds at once.
SLICE = 1024


def _nearest_block(rows: DataFrame, asked, k: int) -> DataFrame:
    import numpy as np

    q, ids = _unit_rows(asked.column("embedding")), np.array(asked.column("vec_id").to_pylist(), np.int64)

    def run(batches):
        import pyarrow as pa

        worst = np.full(len(q), np.inf)  # minus the cosine of each query's k-th so far
        best: list[np.ndarray] = [np.zeros(0), np.zeros(0, np.int64), np.zeros(0, np.int64)]  # minus cosine, id, query

        def keep(rows: list[np.ndarray]) -> list[np.ndarray]:
            order = np.lexsort((rows[1], rows[0], rows[2]))
            rows = [r[order] for r in rows]
            first = np.r_[True, rows[2][1:] != rows[2][:-1]][: len(order)]
            start = np.flatnonzero(first)[np.cumsum(first) - 1] if len(order) else order
            return [r[np.arange(len(order)) - start < k] for r in rows]

        for batch in (x.slice(i, SLICE) for x in batches for i in range(0, x.num_rows, SLICE)):
            there = np.array([x if x is not None else -1 for x in batch.column("vec_id").to_pylist()], np.int64)
            v = _unit_rows(batch.column("embedding"))
            if not len(v) or v.shape[1] != q.shape[1]:
                continue
            for at in range(0, len(q), SLICE):
                cosine = np.round(q[at : at + SLICE] @ v.T, 6) + 0.0
                cosine[ids[at : at + SLICE, None] == there[None, :]] = -np.inf
                if len(there) > k:  # ties at the border stay until ids decide
                    border = np.partition(cosine, -k, axis=1)[:, -k][:, None]
                    a, b = np.nonzero((cosine >= border) & np.isfinite(cosine))
                else:
                    a, b = np.nonzero(np.isfinite(cosine))
                fit = -cosine[a, b] <= worst[at + a]
                a, b, cosine = a[fit] + at, b[fit], cosine[a[fit], b[fit]]
                if len(a):
                    best = keep([np.concatenate(x) for x in zip(best, (-cosine, there[b], a), strict=True)])
                    last = np.flatnonzero(np.r_[best[2][1:] != best[2][:-1], True])
                    many = np.diff(np.r_[-1, last]) == k
                    worst[best[2][last[many]]] = best[0][last[many]]
        yield pa.RecordBatch.from_arrays([pa.array(ids[best[2]]), pa.array(best[1]), pa.array(-best[0])], ["query_id", "vec_id", "cosine"])

    return rows.mapInArrow(run, "query_id long, vec_id long, cosine double")


def similar_titles(titles: DataFrame, least: float) -> DataFrame:
    """(a, b, title_a, title_b, jaccard): pairs of different normalised titles whose words' Jaccard index is ``least`` or more, by an exact prefix join.

    ``titles``: (id, title). ``a`` and ``b`` are the least ids of their title: equal titles are one class (``title_classes``), so that a
    title that many products share costs nothing. Words are ordered from the rarest on; two sets that are so alike share one
    of the first |x| - ceil(least |x|) + 1 words, so only those are joined, and common words hardly ever."""
    one = title_classes(titles).groupBy("title").agg(F.min("id").alias("id"))
    sets = one.select("id", "title", F.array_distinct(t.words(F.col("title"))).alias("words")).where(F.size("words") > 0)
    each = sets.select("id", F.explode("words").alias("word"))
    often = each.groupBy("word").agg(F.count("*").alias("df"))
    ordered = each.join(often, "word").groupBy("id").agg(F.sort_array(F.collect_list(F.struct("df", "word"))).alias("o"))
    n = F.size("o")
    prefix = ordered.select("id", F.explode(F.slice("o", F.lit(1), (n - F.ceil(n * least - 1e-9) + 1).cast("int"))).alias("w")).select("id", "w.word")
    left, right = prefix.withColumnRenamed("id", "a"), prefix.withColumnRenamed("id", "b")
    pairs = left.join(right, "word").where("a < b").select("a", "b").distinct()
    side = lambda x: sets.select(F.col("id").alias(x), F.col("title").alias(f"title_{x}"), F.col("words").alias(f"w{x}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b").withColumn("jaccard", t.jaccard(F.col("wa"), F.col("wb")))
    return both.where(F.col("jaccard") >= least - 1e-12).select("a", "b", "title_a", "title_b", "jaccard")


def title_classes(titles: DataFrame) -> DataFrame:
    """(id, title) with normalised titles."""
    return titles.select("id", t.normalize(F.col("title")).alias("title"))
