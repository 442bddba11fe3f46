"""The match chain and its audits over whole tables: parts are the anchors, the newest line item of each part and platform a listing.

The SQL computes every step on its own: blocking, token weights, title similarity, ranking, batches, ties and statuses.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.functions import text as t
from quillon.functions import vocab
from quillon.functions.vocab import DEFAULT, EngineConfig
from quillon.operators import audit, imports, matching, sizechart
from quillon.plans.catalogue import case_sql, in_sql, map_sql, norm_sql, query, table, words_sql
from quillon.sources.shared import settled

#: An overlay of garments for the names of parts; they have no fit and no code, and two colours.
NOUNS = ("anvil", "bolt", "gear", "gizmo", "plate", "ring", "rod", "widget")
OVERLAY = DEFAULT.extended(garments=tuple((n, rf"\b{n}s?\b") for n in NOUNS))
GENDERS = ("men", "women", "unisex", None)


#: One platform doesn't carry a brand, the other has only one colour of another; list prices of some brands differ between rivals. So all statuses occur.
CARRIED = "NOT (k = 1 AND brand = 'Brand#13') AND NOT (k = 0 AND brand = 'Brand#7' AND title NOT LIKE 'blue%')"
DEARER = "CASE brand WHEN 'Brand#5' THEN 1.3D WHEN 'Brand#9' THEN 1.08D ELSE 1.0D END"


def anchors(spark, sf_dir) -> DataFrame:
    none = F.lit(None).cast("string")
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("id"), F.col("p_brand").alias("brand"), F.col("p_name").alias("title"), none.alias("color"),
        F.col("p_retailprice").alias("mrp"), none.alias("gender"), none.alias("articleType")
    )


def listings(spark, sf_dir) -> DataFrame:
    """The newest line item of each part and platform as a listing."""
    order = F.struct("l_shipdate", "l_orderkey", "l_linenumber", "l_suppkey", "l_quantity", "l_extendedprice")
    newest = table(spark, sf_dir, "lineitem").groupBy("l_partkey", (F.col("l_suppkey") % 2).alias("k")).agg(F.max_by("l_discount", order).alias("off"))
    rows = newest.join(anchors(spark, sf_dir), F.col("l_partkey") == F.col("id")).where(CARRIED).withColumn("mrp", F.col("mrp") * F.expr(DEARER))
    return rows.select(
        F.concat(F.lit("p"), F.col("k").cast("string")).alias("platform"), (F.col("id") * 10 + F.col("k")).alias("id"), "brand", "title", "color", "mrp",
        F.round(F.col("mrp") * (1 - F.col("off"))).alias("price"), "gender", "articleType", F.col("id").alias("rank_in_query"),
    )


def pages(spark, sf_dir) -> DataFrame:
    """Two pages for each part and platform; on p1 both are blocked for some parts, on p0 one."""
    platforms = F.explode(F.array(F.lit("p0"), F.lit("p1"))).alias("platform")
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("anchor_id"), "p_size", platforms).select("*", F.explode(F.array(F.lit(0), F.lit(1))).alias("page"))
    return rows.select("anchor_id", "platform", ((F.col("p_size") % 11 == 3) & ((F.col("platform") == "p1") | (F.col("page") == 0))).alias("blocked"))


def prepared(spark, sf_dir) -> tuple[tuple[DataFrame, DataFrame], tuple[DataFrame, DataFrame]]:
    """Anchors and listings with their lines and profiles, stored."""
    return matching.lined(anchors(spark, sf_dir), OVERLAY), matching.lined(listings(spark, sf_dir), OVERLAY)


def decided(spark, sf_dir, config: EngineConfig = EngineConfig(), products=None, placed: DataFrame | None = None) -> DataFrame:
    platforms = spark.createDataFrame([("p0", False), ("p1", False)], "platform string, blocked boolean")
    weights = matching.title_weights(anchors(spark, sf_dir), OVERLAY)
    return matching.decide(*(products or prepared(spark, sf_dir)), platforms, weights, config=config, tax=OVERLAY, pages=pages(spark, sf_dir), placed=placed)


_TOKENS = lambda c: f"list_transform(list_filter({words_sql(c)}, lambda w: length(w) > 1 AND w NOT IN {in_sql(vocab.SEMANTIC_STOP)}), lambda w: coalesce({map_sql(DEFAULT.synonyms, 'w')}, w))"
_COLOUR = case_sql([(c, rf"\b{c}\b") for c in vocab.COLOUR_WORDS], "s")
_CARRIED = CARRIED.replace("brand", "b.p_brand").replace("title", "b.p_name")
_CHAIN = f"""WITH dear AS (SELECT *, p_retailprice * {DEARER.replace("brand", "p_brand").replace("D ", "::DOUBLE ").replace("0D", "0::DOUBLE")} AS lmrp FROM part), newest AS (SELECT l_partkey, l_suppkey % 2 AS k, l_discount, row_number() OVER (PARTITION BY l_partkey, l_suppkey % 2
    ORDER BY l_shipdate DESC, l_orderkey DESC, l_linenumber DESC, l_suppkey DESC, l_quantity DESC, l_extendedprice DESC) AS rn FROM lineitem),
names AS (SELECT DISTINCT p_name AS name, {norm_sql('p_name')} AS s FROM part),
facts AS (SELECT name, s, {case_sql(OVERLAY.garments, 's')} AS garment, {_COLOUR} AS colour, {_TOKENS('name')} AS ts, ' ' || s || ' ' AS p FROM names),
fact AS (SELECT *, CASE WHEN colour IN ('red', 'blue') THEN colour END AS family FROM facts),
df AS (SELECT token, count(*) AS df FROM (SELECT unnest(list_distinct({_TOKENS("p_brand || ' ' || p_name")})) AS token FROM part) GROUP BY token),
bag AS (SELECT name, f.token, count(*) AS c, ln(((SELECT count(*) FROM part) + 1) / (any_value(coalesce(d.df, 0)) + 1)) + 1 AS w FROM (SELECT name, unnest(ts) AS token FROM fact) f LEFT JOIN df d ON d.token = f.token GROUP BY 1, 2),
tri AS (SELECT name, substr(p, i::INT, 3) AS g, count(*) AS c FROM fact, range(1, 200) r(i) WHERE i <= length(p) - 2 GROUP BY 1, 2),
bag_norm AS (SELECT name, sum(c * c * w * w) AS n2 FROM bag GROUP BY 1), tri_norm AS (SELECT name, sum(c * c) AS n2 FROM tri GROUP BY 1),
bag_dot AS (SELECT x.name AS na, y.name AS nb, sum(x.c * y.c * x.w * y.w) AS d FROM bag x JOIN bag y USING (token) GROUP BY 1, 2), tri_dot AS (SELECT x.name AS na, y.name AS nb, sum(x.c * y.c) AS d FROM tri x JOIN tri y USING (g) GROUP BY 1, 2),
alike AS (SELECT x.name AS na, y.name AS nb, x.family AS fa, y.family AS fb, 0.62 * coalesce(b.d / sqrt(bx.n2 * by_.n2), 0) + 0.38 * coalesce(t.d / sqrt(tx.n2 * ty.n2), 0) AS lex,
  (3 + CASE WHEN x.colour = y.colour THEN 1.5 ELSE 0 END) / (3 + CASE WHEN x.colour IS NOT NULL AND y.colour IS NOT NULL THEN 1.5 ELSE 0 END) AS con
  FROM fact x JOIN fact y ON x.garment = y.garment LEFT JOIN bag_dot b ON b.na = x.name AND b.nb = y.name LEFT JOIN tri_dot t ON t.na = x.name AND t.nb = y.name
  JOIN bag_norm bx ON bx.name = x.name JOIN bag_norm by_ ON by_.name = y.name JOIN tri_norm tx ON tx.name = x.name JOIN tri_norm ty ON ty.name = y.name),
titles AS (SELECT *, round(0.62 * lex + 0.38 * con, 4) AS title FROM alike),
pairs AS (SELECT a.p_partkey AS anchor_id, 'p' || n.k AS platform, b.p_partkey * 10 + n.k AS id, round(b.lmrp * (1 - l_discount)) AS price, a.p_retailprice AS am, b.lmrp AS lm, b.p_partkey AS ord, title, fa, fb,
  coalesce(fa <> fb, false) AS conflict, abs(round(a.p_retailprice) - round(b.lmrp)) / greatest(round(a.p_retailprice), round(b.lmrp)) AS gap
  FROM part a JOIN dear b ON a.p_brand = b.p_brand JOIN titles ON na = a.p_name AND nb = b.p_name JOIN newest n ON n.l_partkey = b.p_partkey AND rn = 1 AND {_CARRIED}),
scored AS (SELECT *, round((0.24 * CASE WHEN gap = 0 THEN 1.0 WHEN gap <= 0.02 THEN 0.9 WHEN gap <= 0.1 THEN 0.55 WHEN gap <= 0.25 THEN 0.25 ELSE 0 END + 0.16 * title + 0.05) / 0.45, 4) AS score FROM pairs),
ranked AS (SELECT *, row_number() OVER (PARTITION BY anchor_id, platform ORDER BY score DESC, ord, id) AS rank FROM scored),
final AS (SELECT *, ceil(rank / 5.0) AS batch, min(ceil(rank / 5.0)) FILTER (NOT conflict) OVER (PARTITION BY anchor_id, platform) AS first FROM ranked WHERE rank <= 10),
viable AS (SELECT *, row_number() OVER w AS n, first_value(id) OVER w AS bi, first_value(price) OVER w AS bp, first_value(score) OVER w AS bs FROM final WHERE NOT conflict AND batch <= first WINDOW w AS (PARTITION BY anchor_id, platform ORDER BY score DESC, rank)),
best AS (SELECT anchor_id, platform, count(*) FILTER (bs - score <= 0.04 AND id <> bi AND abs(price - bp) / greatest(price, bp) > 0.02) AS ties, max(id) FILTER (n = 1) AS id, max(price) FILTER (n = 1) AS price, max(score) FILTER (n = 1) AS score,
  max(abs(am - lm) / greatest(am, lm)) FILTER (n = 1) AS apart FROM viable GROUP BY 1, 2),
seen AS (SELECT anchor_id, platform, count(*) AS scanned FROM pairs GROUP BY 1, 2),
judged AS (SELECT p_partkey AS anchor_id, v.platform, scanned, id, price, score, ties, p_size % 11 = 3 AND v.platform = 'p1' AS blocked,
  CASE WHEN score < 0.58 THEN 'low_confidence' WHEN apart > 0.06 THEN 'mrp_mismatch' WHEN score < 0.70 THEN 'below_strict_tier' END AS why
  FROM part CROSS JOIN (VALUES ('p0'), ('p1')) v(platform) LEFT JOIN seen ON seen.anchor_id = p_partkey AND seen.platform = v.platform LEFT JOIN best ON best.anchor_id = p_partkey AND best.platform = v.platform
  ) , named AS (SELECT *, CASE WHEN blocked THEN 'blocked' WHEN scanned IS NULL THEN 'no_results' WHEN id IS NULL THEN 'color_mismatch' WHEN why IS NOT NULL THEN 'no_match' WHEN ties > 0 THEN 'ambiguous' ELSE 'matched' END AS status FROM judged),
decided AS (SELECT anchor_id, platform, status, CASE WHEN status = 'no_match' THEN why END AS "rejectedBy", CASE WHEN status = 'matched' THEN id END AS listing_id, CASE WHEN status = 'matched' THEN price END AS price,
  CASE WHEN status = 'matched' THEN score END AS score, CASE WHEN status = 'matched' THEN CASE WHEN score >= 0.85 THEN 'EXACT MATCH' WHEN score >= 0.72 THEN 'CLOSE MATCH' ELSE 'PARTIAL MATCH' END END AS "matchType" FROM named),
pool AS (SELECT anchor_id, platform, id, coalesce(fa = fb, false) AND gap = 0 AS strict, NOT conflict AND abs(am - lm) / greatest(am, lm) <= 0.05 AS standard FROM pairs),
sums AS (SELECT anchor_id, platform, count(*) AS pool_size, count(*) FILTER (strict) AS n_strict, count(*) FILTER (standard) AS n_standard, bool_or(strict AND id = listing_id) AS is_strict, bool_or(standard AND id = listing_id) AS is_standard
  FROM pool JOIN decided USING (anchor_id, platform) GROUP BY 1, 2)
"""


def _verdict_sql(n: str) -> str:
    hit = "WHEN status = 'matched'"
    return f"CASE WHEN status = 'blocked' THEN 'BLOCKED' {hit} AND coalesce(is_{n}, false) THEN 'TP' {hit} AND n_{n} > 0 THEN 'FP_MISSED_BETTER' {hit} THEN 'FP' WHEN n_{n} > 0 THEN 'FN' ELSE 'TN' END AS verdict_{n}"


_AUDIT = _CHAIN + f", audit AS (SELECT anchor_id, platform, status, coalesce(pool_size, 0) AS pool_size, coalesce(n_strict, 0) AS n_strict, coalesce(n_standard, 0) AS n_standard, {_verdict_sql('strict')}, {_verdict_sql('standard')} FROM decided LEFT JOIN sums USING (anchor_id, platform)) "


@query(_CHAIN + "SELECT * FROM decided")
def match_parts(spark, sf_dir):
    return decided(spark, sf_dir)


@query(_CHAIN + ", total AS (SELECT platform, count(*) AS total FROM decided GROUP BY 1) SELECT platform, status, \"matchType\", count(*) AS n, round(count(*) / any_value(total), 6) AS share FROM decided JOIN total USING (platform) GROUP BY 1, 2, 3")
def match_tiers(spark, sf_dir):
    return audit.tiers(decided(spark, sf_dir))


def audited(spark, sf_dir) -> DataFrame:
    """Against a pool of all pairs with a search key in common, by lines of products."""
    (own, lines), (theirs, others) = products = prepared(spark, sf_dir)
    placed = matching.shelved(theirs)
    pairs = matching.blocked(matching.standing(lines), matching.standing(others, placed))
    pool = pairs.select(F.col("anchor_id").alias("own"), "platform", F.col("listing_id").alias("other"), F.col("listing.n").alias("n"), audit.alike(F.col("row.f"), F.col("listing.f")).alias("same"))
    pool = settled(pool.select("own", "platform", "other", "n", "same.*"), "pool")
    return audit.pooled_lines(decided(spark, sf_dir, products=products, placed=placed), pool, own, placed)


@query(_AUDIT + "SELECT * FROM audit")
def identity_checklist(spark, sf_dir):
    return audited(spark, sf_dir)


@query(_AUDIT + """, c AS (SELECT platform, count(*) FILTER (verdict_strict = 'TP') AS tp, count(*) FILTER (verdict_strict LIKE 'FP%') AS fp, count(*) FILTER (verdict_strict = 'FN') AS fn, count(*) FILTER (verdict_strict = 'TN') AS tn FROM audit GROUP BY 1)
SELECT *, round(tp / nullif(tp + fp, 0), 6) AS precision, round(tp / nullif(tp + fn, 0), 6) AS recall, round((tp + tn) / nullif(tp + fp + fn + tn, 0), 6) AS accuracy FROM c""")
def audit_by_source(spark, sf_dir):
    return audit.confusion(audited(spark, sf_dir).withColumn("verdict", F.col("verdict_strict")), "platform")


_GENDER = lambda c: f"CASE {c} % 4 WHEN 0 THEN 'men' WHEN 1 THEN 'women' WHEN 2 THEN 'unisex' END"


@query(_CHAIN + f", g AS (SELECT platform, {_GENDER('a.p_size')} AS x, {_GENDER('b.p_size')} AS y FROM decided JOIN part a ON a.p_partkey = anchor_id JOIN part b ON b.p_partkey = listing_id // 10) SELECT platform, count(*) AS checked, count(*) FILTER (x <> y AND x <> 'unisex' AND y <> 'unisex') AS leaks FROM g GROUP BY 1")
def gender_leaks(spark, sf_dir):
    """Genders by the size of a part, which the chain doesn't know, so that there are leaks to find."""
    of = lambda n: table(spark, sf_dir, "part").select(F.col("p_partkey").alias(n),
        F.when(F.col("p_size") % 4 < 3, F.element_at(F.array(*map(F.lit, GENDERS[:3])), (F.col("p_size") % 4 + 1).cast("int"))).alias(f"{n}_gender"))
    won = decided(spark, sf_dir).where("status = 'matched'").withColumn("listing", F.floor(F.col("listing_id") / 10))
    return audit.gender_leaks(won.join(of("anchor").withColumnRenamed("anchor", "anchor_id"), "anchor_id").join(of("listing"), "listing"))


# ---- size charts over line items, whole products at a time

_CHART = """WITH c AS (SELECT l_partkey AS product_id, l_suppkey % 2 AS platform, l_linenumber AS size, l_quantity + 20 AS lo, l_quantity + 20 + (l_orderkey % 3) AS hi, row_number() OVER (PARTITION BY l_partkey, l_suppkey % 2, l_linenumber ORDER BY l_orderkey, l_suppkey, l_quantity) AS rn FROM lineitem WHERE l_linenumber > 4),
f AS (SELECT * FROM c WHERE rn = 1), g AS (SELECT product_id, size, count(*) AS n, round(greatest(0, max(lo) - min(hi)), 2) AS d, min(platform) AS platform FROM f GROUP BY 1, 2),
k AS (SELECT *, CASE WHEN n > 1 AND d >= 1 THEN 'major' WHEN n > 1 AND d > 0.4 THEN 'minor' END AS severity FROM g), charts AS (SELECT product_id, count(DISTINCT platform) AS charts FROM f GROUP BY 1)
"""


def chart_index(spark, sf_dir) -> DataFrame:
    """The larger sizes only, so that some products have a size on one platform alone."""
    c, none = F.col, F.lit(None).cast("double")
    rows = table(spark, sf_dir, "lineitem").where("l_linenumber > 4").select(
        c("l_partkey").alias("product_id"), (c("l_suppkey") % 2).cast("string").alias("platform"),
        F.struct("l_orderkey", "l_suppkey", "l_quantity").alias("pos"), c("l_linenumber").cast("string").alias("size"), F.lit("Waist").alias("raw_axis"), F.lit(None).cast("string").alias("basis"),
        *[none.alias(n) for n in ("inch", "cm", "cm_lo", "cm_hi")], (c("l_quantity") + 20).alias("inch_lo"), (c("l_quantity") + 20 + c("l_orderkey") % 3).alias("inch_hi"))
    return sizechart.indexed(rows)


@query(_CHART + """, s AS (SELECT product_id, count(*) FILTER (n > 1) AS compared, count(*) FILTER (n > 1 AND severity IS NULL) AS matched, count(*) FILTER (severity = 'minor') AS minor, count(*) FILTER (severity = 'major') AS major FROM k GROUP BY 1)
SELECT product_id, charts, compared, matched, minor, major, CASE WHEN charts < 2 THEN 'single_source' WHEN major > 0 THEN 'mismatch' WHEN minor > 0 THEN 'minor_variance' WHEN compared > 0 THEN 'consistent' ELSE 'not_comparable' END AS verdict FROM s JOIN charts USING (product_id)""")
def sizechart_verdicts(spark, sf_dir):
    index = chart_index(spark, sf_dir)
    return sizechart.verdicts(index, sizechart.cells(index))


@query(_CHART + "SELECT product_id, CAST(size AS VARCHAR) AS size, CAST(platform AS VARCHAR) AS platform FROM g JOIN charts USING (product_id) WHERE n = 1 AND charts > 1")
def sizechart_only_on(spark, sf_dir):
    return sizechart.only_on(chart_index(spark, sf_dir))


@query(_CHART + "SELECT product_id, CAST(size AS VARCHAR) AS size, d AS delta, severity, CAST(row_number() OVER (PARTITION BY product_id ORDER BY severity, d DESC, size) AS INTEGER) AS ord FROM k WHERE severity IS NOT NULL")
def sizechart_flags(spark, sf_dir):
    return sizechart.flags(sizechart.cells(chart_index(spark, sf_dir))).select("product_id", "size", "delta", "severity", "ord")


@query(_CHART + """, w AS (SELECT p_partkey AS product_id, v.platform, CASE WHEN p_size % 5 = 0 THEN 'blocked' END AS reason, p_size % 2 = 0 AS published FROM part CROSS JOIN (VALUES (0), (1)) v(platform))
SELECT product_id, CAST(platform AS VARCHAR) AS platform, coalesce(reason, CASE WHEN published THEN 'no_table' ELSE 'not_published' END) AS reason FROM w WHERE NOT EXISTS (SELECT 1 FROM f WHERE f.product_id = w.product_id AND f.platform = w.platform)""")
def sizechart_unavailable(spark, sf_dir):
    each = F.explode(F.array(F.lit("0"), F.lit("1"))).alias("platform")
    wanted = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("product_id"), each, F.when(F.col("p_size") % 5 == 0, "blocked").alias("reason"),
        (F.col("p_size") % 2 == 0).alias("published"))
    return sizechart.unavailable(wanted, chart_index(spark, sf_dir))


# ---- import jobs over conversations and events


@query(r"""WITH u AS (SELECT conv_id, turn, CASE turn % 3 WHEN 0 THEN 'myntra' WHEN 1 THEN 'ajio' ELSE 'other' END AS platform,
  CASE turn % 3 WHEN 0 THEN '/shirts/' || role || '/' || conv_id || CASE WHEN conv_id % 4 > 0 THEN '/buy' ELSE '' END ELSE '/' || role || '/p/' || conv_id || '_x?c=/p/0' END AS link FROM conversations)
SELECT conv_id, turn, CASE platform WHEN 'myntra' THEN nullif(regexp_extract(string_split(link, '?')[1], '/(\d+)/buy', 1), '') WHEN 'ajio' THEN nullif(regexp_extract(string_split(link, '?')[1], '/p/(\w+)', 1), '') END AS hint FROM u""")
def hint_ids(spark, sf_dir):
    c, k = F.col, F.col("turn") % 3
    platform = F.when(k == 0, "myntra").when(k == 1, "ajio").otherwise("other")
    buy = F.when(c("conv_id") % 4 > 0, "/buy").otherwise("")
    path = F.when(k == 0, F.concat(F.lit("/shirts/"), "role", F.lit("/"), c("conv_id").cast("string"), buy)).otherwise(F.concat(F.lit("/"), "role",
        F.lit("/p/"), c("conv_id").cast("string"), F.lit("_x?c=/p/0")))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", t.hint_id(platform, F.concat(F.lit("https://shop.example"), path)).alias("hint"))


@query("""WITH i AS (SELECT event_id AS id, CASE event_type WHEN 'purchase' THEN 'matched' WHEN 'error' THEN 'error' WHEN 'view' THEN 'no_match' ELSE 'ambiguous' END AS status FROM events)
SELECT id, status, l_quantity AS quantity FROM i JOIN (SELECT l_orderkey AS id, max(l_quantity) AS l_quantity FROM lineitem GROUP BY 1) USING (id) WHERE status IN ('matched', 'no_match')""")
def finished_items(spark, sf_dir):
    e = F.col("event_type")
    items = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"),
        F.when(e == "purchase", "matched").when(e == "error", "error").when(e == "view", "no_match").otherwise("ambiguous").alias("status"))
    return imports.finished(items, table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.max("l_quantity").alias("quantity")))
