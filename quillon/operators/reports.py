"""Report cells in long form, their verdicts, and the saved-report roll-up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillon.functions import decision as dec
from quillon.functions import text as t


def cells(columns: DataFrame, numbers: dict[str, str]) -> DataFrame:
    """(anchor_id, platform, label, value, verdict) of one row for each anchor and platform.

    ``numbers``: label -> 'price', 'count' or 'score', how values of a column of that name are judged. Labels without
    any value are dropped, but for scores."""
    each = F.array(*[F.struct(F.lit(n).alias("label"), F.lit(k).alias("kind"), F.col(n).cast("double").alias("value")) for n, k in numbers.items()])
    rows = columns.select("anchor_id", "platform", F.explode(each).alias("c")).select("anchor_id", "platform", "c.*")
    w = Window.partitionBy("anchor_id", "label")
    least, most, n = F.min("value").over(w), F.max("value").over(w), F.count("value").over(w)
    v = F.col("value")
    judged = F.when(F.col("kind") == "price", dec.price_verdict(v, least, most)).when(F.col("kind") == "count", dec.count_verdict(v, least, most, n)).otherwise(dec.score_verdict(v))
    return rows.withColumn("verdict", judged).withColumn("_n", n).where("_n > 0 or kind = 'score'").drop("_n")


def saved(comparisons: DataFrame, as_of: Column, ttl_hours: float) -> DataFrame:
    """For each anchor's (anchor_id, platform, status, price, score, matched_at): best platform, matches, age and freshness."""
    ok = F.col("status") == "matched"
    g = comparisons.groupBy("anchor_id").agg(F.count_if(ok).alias("matched"),
        F.max_by(F.when(ok, F.col("platform")), F.when(ok, F.struct("score", "platform"))).alias("best_platform"),
        F.min(F.when(ok, F.col("price"))).alias("best_price"), F.max("matched_at").alias("matched_at"))
    age = (as_of.cast("timestamp").cast("double") - F.col("matched_at").cast("timestamp").cast("double")) / 3600
    return g.withColumn("age_hours", F.round(age, 4)).withColumn("fresh", (age >= 0) & (age < ttl_hours))


def listed(comparisons: DataFrame, products: DataFrame, as_of: Column, ttl_hours: float, query: str = "", fresh_only: bool = False) -> DataFrame:
    """Saved reports as the list shows them: brand and title, the best rival's platform, score and tier, matches, age, what is left of their
    life, and whether the product is of the catalog or came as a link.

    ``comparisons``: see ``saved``, with matchType; ``products``: (id, brand, title, source)."""
    from quillon.operators.position import search

    ok = F.col("status") == "matched"
    order = F.when(ok, F.struct(F.coalesce("score", F.lit(0.0)).alias("score"), "platform"))
    best = F.max_by(F.when(ok, F.struct("platform", "score", "matchType")), order)
    g = comparisons.groupBy("anchor_id").agg(F.count_if(ok).alias("matched"), best.alias("b"), F.min(F.when(ok, F.col("price"))).alias("cheapest"), F.max("matched_at").alias("matched_at"))
    hours = (as_of.cast("timestamp").cast("double") - F.col("matched_at").cast("timestamp").cast("double")) / 3600
    g = g.withColumn("hours", hours).join(products.withColumnRenamed("id", "anchor_id"), "anchor_id", "left")
    out = g.select(
        F.col("anchor_id").alias("id"), "brand", "title", F.coalesce("b.matchType", F.lit("NO MATCH")).alias("matchType"),
        F.col("b.score").alias("confidence"), F.col("b.platform").alias("bestPlatform"), "matched", "cheapest", "matched_at",
        F.round("hours", 1).alias("age_hours"), ((F.col("hours") >= 0) & (F.col("hours") < ttl_hours)).alias("fresh"),
        F.greatest(F.lit(0.0), F.round(F.lit(ttl_hours) - F.col("hours"), 1)).alias("expires_in_hours"), F.coalesce("source", F.lit("link")).alias("source"),
    )
    found = search(out.withColumn("_id", F.col("id").cast("string")), query, "brand", "title", "_id").drop("_id") if query else out
    return found.where("fresh") if fresh_only else found


def colour_verdict(delta_e: Column) -> Column:
    """Of a colour distance between two images."""
    return F.when(delta_e.isNull(), "na").when(delta_e <= 15, "best").when(delta_e <= 26, "moderate").otherwise("low")


def size_sentence(sizes: Column) -> Column:
    """'In stock: S, M. Sold out: L' of an array of (size, available); null without sizes."""
    named = lambda ok: F.array_join(F.transform(F.filter(sizes, lambda s: F.coalesce(s["available"], F.lit(False)) == ok), lambda s: s["size"]), ", ")
    part = lambda label, ok: F.when(named(ok) != "", F.concat(F.lit(label), named(ok)))
    return F.when(F.size(sizes) > 0, F.concat_ws(". ", part("In stock: ", True), part("Sold out: ", False)))


def summary(market: DataFrame, own: str) -> DataFrame:
    """What to do about each position, in words."""
    gap, price = F.abs("gap").cast("bigint").cast("string"), F.col("best_rival").cast("bigint").cast("string")
    text = (
        F.when(F.col("gap") > 0, F.concat(F.lit("Undercut by "), gap, F.lit(": match "), price, F.lit(" on "), "cheapest_rival"))
        .when(F.col("gap") < 0, F.concat(F.lit("Cheapest by "), gap, F.lit(": room to raise the price")))
        .when(F.col("gap") == 0, "At parity: hold the price")
        .otherwise("No rival price: nothing to compare")
    )
    return market.withColumn("action", text)


# ---- the decision in words


def size_flag(major: Column, minor: Column, compared: Column, verdict: Column, first_flag: Column) -> Column:
    """(severity, label, detail) at the head of a report: how the size charts of its platforms agree. Null where nothing was compared, which never
    means that they agree."""
    n = F.when(major > 0, major).otherwise(minor)
    text = F.concat(n.cast("string"), F.when(n > 1, F.lit(" measurements differ")).otherwise(F.lit(" measurement differs")), F.coalesce(F.concat(F.lit(" — "), first_flag), F.lit(".")))
    flag = lambda severity, label, detail: F.struct(F.lit(severity).alias("severity"), F.lit(label).alias("label"), detail.alias("detail"))
    agree = flag("none", "Size charts match", F.concat(compared.cast("string"), F.lit(" measurements agree across platforms.")))
    differ = F.when(major > 0, flag("major", "Size chart differs", text)).when(minor > 0, flag("minor", "Size chart varies slightly", text))
    return F.coalesce(differ, F.when((verdict == "consistent") & (compared > 0), agree))


def decision(anchors: DataFrame, columns: DataFrame, own: str) -> DataFrame:
    """Each anchor's decision in words: best match, posture, action, insights in their order, and the header's reason.

    ``anchors``: (anchor_id, price, images, size_insight: a sentence on its size charts or null); ``columns``: (anchor_id, ord, label, status, score, price, images,
    matchType, why, differences), one for each rival. ``own``: the own platform's name. Of rivals with one score or price the first by ``ord`` counts.
    Sentences are fixed values."""
    c = F.col
    hit = (c("status") == "matched") & c("score").isNotNull()
    said = (
        F.when(c("status") == "matched", F.lit(None).cast("string"))
        .when(c("status") == "blocked", F.concat("label", F.lit(" data is not available for this product.")))
        .when(c("status") == "ambiguous", F.concat("label", F.lit(" has several near-identical listings at different prices — the exact SKU cannot be proven from public data. Verify manually.")))
        .when(c("status") == "color_mismatch", F.concat("label", F.lit(" has a same-style listing in a different colourway — not treated as a match.")))
        .otherwise(F.concat(F.lit("No confident "), "label", F.lit(" match was found for this product.")))
    )
    rival = F.struct("ord", "label", "score", "price", "images", "matchType", "why", "differences")
    per = columns.withColumns({"said": said, "hit": hit}).groupBy("anchor_id").agg(
        F.max_by(rival, F.when(c("hit"), F.struct("score", -c("ord")))).alias("best"),
        F.min_by(rival, F.when(c("hit") & c("price").isNotNull(), F.struct("price", "ord"))).alias("cheapest"),
        F.sort_array(F.collect_list(F.when(c("said").isNotNull(), F.struct("ord", "said")))).alias("others"),
        F.sort_array(F.collect_list(F.when(c("hit"), F.struct(-c("score"), "ord", "label", "images")))).alias("hits"),
    )  # a handful of rivals
    rows = anchors.join(per, "anchor_id", "left").withColumn("gap", c("price") - c("cheapest.price"))
    gap, name = t.rupees(F.abs("gap")), c("cheapest.label")
    posture = F.when(c("gap") > 0, "undercut").when(c("gap") < 0, "winning").when(c("gap") == 0, "parity").otherwise("unknown")
    action = (
        F.when(c("gap") > 0, F.concat(name, F.lit(" is "), gap, F.lit(" cheaper — review pricing or promotion on this SKU.")))
        .when(c("gap") < 0, F.concat(F.lit(f"{own} holds the best price by "), gap, F.lit(" — safe to promote as a price win.")))
        .when(c("gap") == 0, "Priced at parity — differentiate on delivery, offers or content quality.")
        .otherwise("Insufficient competitor data for a pricing recommendation.")
    )
    money = (
        F.when(c("gap") > 0, F.concat(name, F.lit(f" undercuts {own} by "), gap, F.lit(" on the same item.")))
        .when(c("gap") < 0, F.concat(F.lit(f"{own} is "), gap, F.lit(" cheaper than the closest competitor.")))
        .when(c("gap") == 0, "Price parity with the closest competitor.")
    )
    closest = F.concat("best.label", F.lit(" is the closest match ("), F.floor(c("best.score") * 100 + 0.5).cast("string"), F.lit("% overall similarity)."))
    mine = F.coalesce(c("images"), F.lit(0))
    richer = F.get(F.filter("hits", lambda h: F.coalesce(h["images"], F.lit(0)) > mine), F.lit(0))
    content = F.concat(richer["label"], F.lit(" shows "), richer["images"].cast("string"), F.lit(f" images vs {own}'s "), mine.cast("string"), F.lit(" — richer content."))
    others = F.coalesce(F.transform("others", lambda o: o["said"]), F.array().cast("array<string>"))
    insights = F.array_compact(F.concat(F.array(closest), others, F.array(money, c("size_insight"), content)))
    why, differences = F.array_join(F.slice("best.why", 1, 3), ", "), F.array_join(F.slice("best.differences", 1, 2), "; ")
    found = F.concat_ws(" ", F.coalesce(F.nullif(why, F.lit("")), F.lit("Matched on core attributes")), F.when(differences != "", F.concat(F.lit("Differences: "), differences, F.lit("."))))
    reason = F.when(c("best").isNull(), "No competitor listing cleared the matching gates for this product.").otherwise(found)
    return rows.select(
        "anchor_id", c("best.label").alias("bestMatch"), F.coalesce("best.matchType", F.lit("NO MATCH")).alias("matchType"),
        c("best.score").alias("confidence"), posture.alias("posture"), action.alias("action"), insights.alias("insights"), reason.alias("matchReason")
    )


def anchor_error(id_: Column, reason: Column, own: str) -> Column:
    """Why a product could not be found, in words."""
    return F.when(reason == "not_found", F.concat(F.lit(f"{own} has no product with id "), id_, F.lit("."))).when(reason.isNotNull(),
        F.concat(F.lit("Could not read "), id_, F.lit(f" from {own} ("), reason, F.lit(").")))


def split(rows: DataFrame) -> DataFrame:
    """How all products (matched, gap) split: ``cheapest``, ``parity``, ``undercut`` and ``unmatched``; what is matched and neither cheaper nor dearer is at parity."""
    n = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    g = rows.agg(F.count("*").alias("total"), n(F.col("matched")).alias("matched"), n(F.col("matched") & (F.col("gap") < 0)).alias("cheapest"),
        n(F.col("matched") & (F.col("gap") > 0)).alias("undercut"))
    return g.select("total", "cheapest", F.greatest(F.lit(0), F.col("matched") - F.col("cheapest") - F.col("undercut")).alias("parity"), "undercut",
        F.greatest(F.lit(0), F.col("total") - F.col("matched")).alias("unmatched"))


def savings(prices: DataFrame) -> DataFrame:
    """(anchor_id, dearest, savings) of (anchor_id, price): the longest bar and what the cheapest offer saves against it, nothing with one price."""
    g = prices.groupBy("anchor_id").agg(F.max("price").alias("dearest"), F.min("price").alias("_least"), F.count("price").alias("_n"))
    return g.select("anchor_id", F.coalesce("dearest", F.lit(0.0)).alias("dearest"), F.when(F.col("_n") > 1, F.col("dearest") - F.col("_least")).otherwise(F.lit(0.0)).alias("savings"))
