"""The registered queries of the matching and pricing operators, with their SQL.

Concepts stand on the star schema: parts are the anchors, line items the rival listings on two platforms, events the
state, documents, pages and embeddings the texts and vectors. What has no table is given as rows, alike in both.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.functions import attributes as att
from quillon.functions import decision as dec
from quillon.functions import similarity as sim
from quillon.functions import text as t
from quillon.functions import vocab
from quillon.functions.plan import dealt
from quillon.functions.vocab import DEFAULT
from quillon.operators import audit, images, imports, matching, position, reports, sizechart
from quillon.sources import landed
from quillon.streaming import pacing, state

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its function's name."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def values_sql(name: str, columns: str, rows: list[tuple]) -> str:
    """A common table expression of literal rows."""

    def one(x) -> str:
        if x is None:
            return "NULL"
        if isinstance(x, bool):
            return str(x).upper()
        return "'" + x.replace("'", "''") + "'" if isinstance(x, str) else repr(x)

    return f"{name}({columns}) AS (VALUES " + ", ".join("(" + ", ".join(map(one, r)) + ")" for r in rows) + ")"


def picked_sql(values: list, column: str) -> str:
    """The value at a column's place, modulo their number."""
    shown = ", ".join("NULL" if x is None else "'" + x.replace("'", "''") + "'" for x in values)
    return f"([{shown}])[{column} % {len(values)} + 1]"


def picked(values: list, column: str) -> Column:
    return F.element_at(F.array(*[F.lit(x).cast("string") for x in values]), (F.col(column) % len(values) + 1).cast("int"))


def case_sql(rules, column: str) -> str:
    """The first rule that matches a normalised column."""
    return "CASE " + " ".join(f"WHEN regexp_matches({column}, '{p}') THEN '{n}'" for n, p in rules) + " END"


def norm_sql(column: str) -> str:
    return f"trim(regexp_replace(lower(coalesce({column}, '')), '[^a-z0-9]+', ' ', 'g'))"


def words_sql(column: str) -> str:
    return f"list_filter(string_split({norm_sql(column)}, ' '), lambda w: w <> '')"


def map_sql(values: dict[str, str], column: str) -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in values.items()) + " END"


def in_sql(values) -> str:
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


# ---- price positions over parts and the newest listing of each platform

OWN, RIVALS = "own_price", ["rival_0", "rival_1"]


def prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each part with its own price and each rival platform's newest price; one partial aggregation over listings."""
    newest = F.struct("l_shipdate", "l_orderkey", "l_linenumber", "l_suppkey", "l_quantity", "l_extendedprice")
    lines = table(spark, sf_dir, "lineitem").withColumn("platform", F.col("l_suppkey") % 2)
    found = lines.groupBy("l_partkey").agg(*[F.max_by(F.when(F.col("platform") == p, F.col("l_discount")), F.when(F.col("platform") == p, newest)).alias(f"d{p}") for p in (0, 1)])
    p = table(spark, sf_dir, "part").join(found, F.col("p_partkey") == F.col("l_partkey"), "left")
    price = lambda off: F.round(F.col("p_retailprice") * (1 - off))
    return p.select("p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice",
        F.round(F.col("p_retailprice") * (1 - (F.col("p_size") % 11) / 100)).alias(OWN), price(F.col("d0")).alias("rival_0"), price(F.col("d1")).alias("rival_1"))


def positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return position.market(prices(spark, sf_dir), OWN, RIVALS)


POSITIONS = """WITH newest AS (
  SELECT l_partkey, l_suppkey % 2 AS platform, l_discount, row_number() OVER (PARTITION BY l_partkey, l_suppkey % 2
    ORDER BY l_shipdate DESC, l_orderkey DESC, l_linenumber DESC, l_suppkey DESC, l_quantity DESC, l_extendedprice DESC) AS rn FROM lineitem),
found AS (SELECT l_partkey, max(l_discount) FILTER (platform = 0) AS d0, max(l_discount) FILTER (platform = 1) AS d1 FROM newest WHERE rn = 1 GROUP BY l_partkey),
prices AS (SELECT p.*, round(p_retailprice * (1 - (p_size % 11) / 100.0)) AS own_price, round(p_retailprice * (1 - d0)) AS rival_0, round(p_retailprice * (1 - d1)) AS rival_1
  FROM part p LEFT JOIN found ON p_partkey = l_partkey),
m AS (SELECT *, least(rival_0, rival_1) AS best_rival, least(own_price, rival_0, rival_1) AS lo, greatest(own_price, rival_0, rival_1) AS hi FROM prices),
positions AS (SELECT *, own_price - best_rival AS gap, CASE WHEN rival_0 = best_rival THEN 'rival_0' WHEN rival_1 = best_rival THEN 'rival_1' END AS cheapest_rival,
  round((own_price - best_rival) / own_price * 100, 1) AS gap_pct,
  CASE WHEN best_rival IS NULL THEN 'No competitor data' WHEN own_price > best_rival THEN 'Undercut' WHEN own_price < best_rival THEN 'Cheapest' ELSE 'Parity' END AS position,
  CASE WHEN lo <> hi THEN CASE lo WHEN own_price THEN 'own_price' WHEN rival_0 THEN 'rival_0' ELSE 'rival_1' END END AS cheapest,
  CASE WHEN lo <> hi THEN CASE hi WHEN own_price THEN 'own_price' WHEN rival_0 THEN 'rival_0' ELSE 'rival_1' END END AS dearest,
  hi - lo AS spread, round(own_price / lo * 100, 1) AS price_index FROM m)
"""


@query(POSITIONS + "SELECT p_partkey, p_brand, own_price, rival_0, rival_1, gap, gap_pct, position, cheapest, dearest, cheapest_rival, spread, price_index FROM positions")
def position_gap(spark, sf_dir):
    return positions(spark, sf_dir).select("p_partkey", "p_brand", OWN, *RIVALS, "gap", "gap_pct", "position", "cheapest", "dearest", "cheapest_rival",
        "spread", "price_index").orderBy(F.col("gap").desc_nulls_last(), "p_partkey")


@query(POSITIONS + """SELECT count(*) AS products, count(gap) AS compared, count(*) FILTER (position = 'Undercut') AS undercut, count(*) FILTER (position = 'Cheapest') AS winning,
  count(*) FILTER (position = 'Parity') AS parity, round(count(*) FILTER (position IN ('Cheapest', 'Parity')) * 100.0 / count(gap), 1) AS cheapest_share,
  round(avg(gap) FILTER (gap > 0)) AS avg_undercut, sum(gap) FILTER (gap > 0) AS exposure, max(gap) AS max_gap, max(spread) AS max_spread, round(avg(spread), 4) AS avg_spread FROM positions""")
def kpi_stats(spark, sf_dir):
    return position.kpis(positions(spark, sf_dir))


@query(POSITIONS + "SELECT p_partkey, gap FROM positions WHERE gap > 0 ORDER BY gap DESC, p_partkey LIMIT 50")
def top_undercuts(spark, sf_dir):
    return position.top(positions(spark, sf_dir).where("gap > 0").select("p_partkey", "gap"), F.col("gap").desc(), 50, "p_partkey")


@query(POSITIONS + "SELECT p_partkey, gap FROM positions WHERE gap < 0 ORDER BY gap, p_partkey LIMIT 50")
def top_wins(spark, sf_dir):
    return position.top(positions(spark, sf_dir).where("gap < 0").select("p_partkey", "gap"), F.col("gap").asc(), 50, "p_partkey")


@query("SELECT p_brand AS brand, count(*) AS n FROM part GROUP BY p_brand")
def brand_facets(spark, sf_dir):
    return position.counts(table(spark, sf_dir, "part"), "p_brand", "brand")


_FLAGS = "coalesce(p_brand IN ('Brand#11', 'Brand#23', 'Brand#17'), false) AS b, coalesce(position = 'Undercut', false) AS p, coalesce(gap BETWEEN -40 AND 60, false) AS g"


@query(POSITIONS + f""", f AS (SELECT *, {_FLAGS} FROM positions)
SELECT 'brand' AS facet, p_brand AS value, count(*) FILTER (p AND g) AS n FROM f GROUP BY p_brand
UNION ALL SELECT 'position', position, count(*) FILTER (b AND g) FROM f GROUP BY position UNION ALL SELECT 'type', p_type, count(*) FILTER (b AND p AND g) FROM f GROUP BY p_type""")
def leave_one_out_facets(spark, sf_dir):
    c = F.col
    predicates = {"brand": c("p_brand").isin("Brand#11", "Brand#23", "Brand#17"), "position": c("position") == "Undercut", "price": c("gap").between(-40, 60)}
    return position.facets(positions(spark, sf_dir), predicates, {"brand": c("p_brand"), "position": c("position"), "type": c("p_type")})


@query(POSITIONS + "SELECT min(own_price) AS lo, max(own_price) AS hi, count(*) AS n, sum(gap) AS total_gap FROM positions WHERE position = 'Undercut'")
def price_range(spark, sf_dir):
    return positions(spark, sf_dir).where("position = 'Undercut'").agg(F.min(OWN).alias("lo"), F.max(OWN).alias("hi"), F.count("*").alias("n"), F.sum("gap").alias("total_gap"))


@query(POSITIONS + "SELECT p_type AS key, count(*) AS n, count(*) FILTER (gap > 0) AS undercut, count(*) FILTER (gap < 0) AS winning, round(avg(gap), 4) AS avg_gap FROM positions GROUP BY 1 ORDER BY n DESC, key LIMIT 20")
def breakdown_by_type(spark, sf_dir):
    return position.breakdown(positions(spark, sf_dir), "p_type")


@query(POSITIONS + """, c AS (SELECT cheapest AS platform, count(*) AS times_cheapest FROM positions WHERE cheapest IS NOT NULL GROUP BY 1), d AS (SELECT dearest AS platform, count(*) AS n FROM positions WHERE dearest IS NOT NULL GROUP BY 1)
SELECT platform, times_cheapest, coalesce(n, 0) AS times_dearest FROM c LEFT JOIN d USING (platform)""")
def platform_tally(spark, sf_dir):
    return position.tally(positions(spark, sf_dir))


_SEARCH = f"contains({norm_sql('p_name')}, 'red') AND contains({norm_sql('p_name')}, 'wid')"


@query(f"SELECT p_partkey, p_name FROM part WHERE {_SEARCH}")
def catalog_search(spark, sf_dir):
    return position.search(table(spark, sf_dir, "part").select("p_partkey", "p_name"), "Red wid", "p_name")


@query("SELECT p_partkey, p_retailprice AS price, (SELECT count(*) FROM part) AS total, CAST(ceil((SELECT count(*) FROM part) / 25.0) AS BIGINT) AS pages FROM part ORDER BY coalesce(p_retailprice, 1e12), p_partkey LIMIT 25 OFFSET 50")
def catalog_page(spark, sf_dir):
    return position.page(table(spark, sf_dir, "part").select("p_partkey", F.col("p_retailprice").alias("price")), "price_asc", 3, 25, "p_partkey")


@query("SELECT p_partkey FROM part WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_shipdate >= TIMESTAMP '2001-10-01')")
def compared_only_semi(spark, sf_dir):
    recent = table(spark, sf_dir, "lineitem").where("l_shipdate >= timestamp'2001-10-01'").select(F.col("l_partkey").alias("p_partkey"))
    return position.compared_only(table(spark, sf_dir, "part").select("p_partkey"), recent, "p_partkey")


@query("SELECT p_partkey FROM part WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_shipdate >= TIMESTAMP '2001-10-01')")
def uncompared_anti(spark, sf_dir):
    recent = table(spark, sf_dir, "lineitem").where("l_shipdate >= timestamp'2001-10-01'").select(F.col("l_partkey").alias("p_partkey"))
    return audit.unknown(table(spark, sf_dir, "part").select("p_partkey"), recent, "p_partkey")


@query(POSITIONS + """, l AS (SELECT p_partkey, unnest(['own_price', 'rival_0', 'rival_1']) AS platform, unnest([own_price, rival_0, rival_1]) AS price FROM positions),
w AS (SELECT *, min(price) OVER p AS lo, max(price) OVER p AS hi FROM l WINDOW p AS (PARTITION BY p_partkey))
SELECT p_partkey, platform, price, CASE WHEN price IS NULL THEN 'na' WHEN price = lo AND lo <> hi THEN 'best' WHEN price = hi AND lo <> hi THEN 'low' ELSE 'moderate' END AS verdict FROM w""")
def price_verdict(spark, sf_dir):
    long = prices(spark, sf_dir).unpivot("p_partkey", [OWN, *RIVALS], "platform", "price")
    return position.tiers(long, "price", "p_partkey")


# ---- text over documents and part names


@query(f"SELECT doc_id, md5({norm_sql('text')}) AS normalized FROM documents")
def normalize_text(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(t.normalize(F.col("text"))).alias("normalized"))


@query("SELECT page_id, lower(regexp_extract(url, '^[a-z]+://([^/?#]+)', 1)) AS host, nullif(regexp_extract(url, '[?]([^#]*)', 1), '') AS query, regexp_extract(html, '(?is)<title>(.*?)</title>', 1) AS title FROM pages")
def page_fields(spark, sf_dir):
    return landed.page_fields(table(spark, sf_dir, "pages")).select("page_id", "host", "query", "title")


BRANDS = [(i, a, b) for i, (a, b) in enumerate([("Levis", "Levi's"), ("US Polo Assn", "U.S. Polo Assn."), ("Nike", "Nike Sport"),
    ("Polo Assn U S", "U.S. Polo Assn."), ("Van Heusen", "Heusen Van"), ("", "Nike"), (None, "Nike"), ("Puma", "Adidas Originals"), ("red tape", "tape red co")])]
_B = lambda c: f"coalesce({map_sql(vocab.BRAND_ALIASES, norm_sql(c))}, {norm_sql(c)})"


_LEFT, _RIGHT = [a for _, a, _ in BRANDS], [b for *_, b in BRANDS]


@query(f"WITH v AS (SELECT p_partkey AS i, CASE WHEN p_size % 3 = 0 THEN p_brand ELSE {picked_sql(_LEFT, 'p_partkey')} END AS a, {picked_sql(_RIGHT, 'p_size')} AS b FROM part)" + f""", n AS (SELECT i, {_B('a')} AS x, {_B('b')} AS y FROM v),
j AS (SELECT *, len(list_intersect(string_split(x, ' '), string_split(y, ' '))) * 1.0 / len(list_distinct(list_concat(string_split(x, ' '), string_split(y, ' ')))) AS j FROM n)
SELECT i, round(CASE WHEN x = '' OR y = '' THEN 0 WHEN x = y THEN 1 WHEN contains(x, y) OR contains(y, x) THEN 0.85 WHEN j >= 0.5 THEN 0.6 + j * 0.2 ELSE j * 0.4 END, 6) AS score FROM j""")
def brand_score_pairs(spark, sf_dir):
    brands = F.when(F.col("p_size") % 3 == 0, F.col("p_brand")).otherwise(picked(_LEFT, "p_partkey"))
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("i"), brands.alias("a"), picked(_RIGHT, "p_size").alias("b"))
    return rows.select("i", F.round(t.brand_score(F.col("a"), F.col("b")), 6).alias("score"))


_FAMILY = {**{c: c for c in vocab.BASE_COLOURS}, **DEFAULT.colour_family}


@query(f"WITH w AS (SELECT p_partkey, list_reverse({words_sql('p_name')}) AS ws FROM part), f AS (SELECT p_partkey, list_filter(list_transform(ws, lambda w: {map_sql(_FAMILY, 'w')}), lambda x: x IS NOT NULL) AS fs FROM w) SELECT p_partkey, fs[1] AS family FROM f")
def colour_family(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", t.colour_family(F.col("p_name")).alias("family"))


NOUNS = tuple((n, rf"\b{n}s?\b") for n in ("widget", "gadget", "gizmo", "bolt", "valve", "gear", "panel", "cable", "sprocket"))
OVERLAY = DEFAULT.extended(garments=NOUNS)


@query(f"WITH n AS (SELECT p_partkey, {norm_sql('p_name')} AS s FROM part) SELECT p_partkey, {case_sql(OVERLAY.garments, 's')} AS garment, {case_sql([(vocab.FIT_NAMES.get(f, f), rf'\b{f}\b') for f in vocab.FITS], 's')} AS fit, {case_sql(vocab.PATTERNS, 's')} AS pattern FROM n")
def garment_overlay(spark, sf_dir):
    n = F.col("p_name")
    return table(spark, sf_dir, "part").select("p_partkey", t.garment(n, tax=OVERLAY).alias("garment"), t.fit(n, OVERLAY).alias("fit"), t.pattern(n).alias("pattern"))


TITLES = [(i, s) for i, s in enumerate([
    "Levis Men 541 Athletic Tapered Jeans", "Sparx SM9085 Running Shoes Size 9", "Solid Polo T-Shirt 100% Cotton", "Women Floral Print A-Line Dress XL",
    "WH-CH520 Headphones 30w 200gm", "Boys Blue Striped Half Sleeve Tee",
    "Kids Unisex Navy Hooded Sweatshirt 2xl", "Slim Fit Mid Rise Stone Washed Jeans with Five Pockets", "Formal Spread Collar Shirt Button Closure",
    "Comfort Fit Boot Cut Trousers", "", None, "Girls Party Sandals 32b 140 144", "Ripped Acid Wash Denim Jacket zip"])]
_TITLES = [x for _, x in TITLES]
_V = f"WITH v AS (SELECT p_partkey AS i, {picked_sql(_TITLES, 'p_partkey')} || ' ' || p_name AS s0 FROM part)" + f", n AS (SELECT i, {norm_sql('s0')} AS s FROM v) "



def titled_parts(spark, sf_dir) -> DataFrame:
    """(i, s): titles of the fixed list, one for each part, with the part's name."""
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("i"), F.concat(picked(_TITLES, "p_partkey"), F.lit(" "), "p_name").alias("s"))


_LONG = "list_filter(string_split(s, ' '), lambda w: length(w) BETWEEN 3 AND 12)"


@query(_V + f"""SELECT i, array_to_string(list_sort(list_distinct(list_filter({_LONG}, lambda w: regexp_matches(w, '[0-9]') AND regexp_matches(w, '[a-z]') AND NOT regexp_matches(w, '{t.SIZE}') AND NOT regexp_matches(w, '{t.UNIT}')))), ',') AS strong,
  array_to_string(list_sort(list_distinct(list_filter({_LONG}, lambda w: regexp_matches(w, '^[0-9]{{3,6}}$')))), ',') AS weak FROM n""")
def model_codes(spark, sf_dir):
    s = F.col("s")
    show = lambda c: F.array_join(F.array_sort(c), ",")
    return titled_parts(spark, sf_dir).select("i", show(t.strong_codes(s)).alias("strong"), show(t.weak_codes(s)).alias("weak"))


@query(_V + f"SELECT i, {case_sql(vocab.GENDERS, 's')} AS gender, {case_sql(vocab.GARMENTS, 's')} AS garment, {case_sql([(c, rf'\b{c}\b') for c in vocab.COLOUR_WORDS], 's')} AS colour, {case_sql(vocab.FADES, 's')} AS fade, {case_sql(vocab.DISTRESS, 's')} AS distress, {case_sql(vocab.RISES, 's')} AS rise, {case_sql(vocab.SLEEVES, 's')} AS sleeve, {case_sql(vocab.CLOSURES, 's')} AS closure, {case_sql(vocab.OCCASIONS, 's')} AS occasion, CASE WHEN regexp_matches(s, '\\bpolo\\b') OR (regexp_matches(s, '\\bcollar\\b') AND NOT regexp_matches(s, '\\bcollar\\b.*\\bround\\b')) THEN 'polo collar' ELSE {case_sql(vocab.NECKS[1:], 's')} END AS neck FROM n")
def classify_titles(spark, sf_dir):
    s = F.col("s")
    rules = {"fade": vocab.FADES, "distress": vocab.DISTRESS, "rise": vocab.RISES, "sleeve": vocab.SLEEVES, "closure": vocab.CLOSURES, "occasion": vocab.OCCASIONS, "neck": vocab.NECKS}
    return titled_parts(spark, sf_dir).select("i", t.gender(s).alias("gender"), t.garment(s).alias("garment"), t.colour_word(s).alias("colour"),
        *[t.first_rule(s, r).alias(n) for n, r in rules.items()])


_AXES = [(g, *x) for g, x in vocab.GENDER_AXES.items()] + [(None, None, None)]


_NAMES = [g for g, *_ in _AXES]


@query("WITH " + values_sql("g", "name, sex, age", _AXES) + f""", p AS (SELECT p_partkey, {picked_sql(_NAMES, 'p_partkey')} AS anchor_gender, {picked_sql(_NAMES, 'p_size')} AS cand_gender FROM part)
SELECT p_partkey, anchor_gender, cand_gender, coalesce(a.sex = 'any' OR c.sex = 'any' OR a.sex = c.sex, true) AND coalesce(a.age = 'any' OR c.age = 'any' OR a.age = c.age, true) AS ok FROM p LEFT JOIN g a ON a.name = anchor_gender LEFT JOIN g c ON c.name = cand_gender""")
def gender_matrix(spark, sf_dir):
    pairs = table(spark, sf_dir, "part").select("p_partkey", picked(_NAMES, "p_partkey").alias("anchor_gender"), picked(_NAMES, "p_size").alias("cand_gender"))
    return pairs.withColumn("ok", t.gender_compatible(F.col("anchor_gender"), F.col("cand_gender")))


SIZES = [(i, s) for i, s in enumerate([" xl ", "2XL", "XXXL", "xxl", "Free", "32", "os", "a label that is too long", "", None, "10.5", "4XL"])]


_SIZES = [x for _, x in SIZES]


@query(f"WITH v AS (SELECT p_partkey AS i, CASE WHEN p_size % 4 = 0 THEN ' ' || p_size ELSE {picked_sql(_SIZES, 'p_partkey')} END AS s FROM part)" + f""", e AS (SELECT i, s, upper(trim(regexp_replace(s, '\\s+', ' ', 'g'))) AS x, upper(regexp_replace(coalesce(s, ''), '\\s+', '', 'g')) AS c FROM v)
SELECT i, CASE WHEN length(x) BETWEEN 1 AND 12 THEN coalesce({map_sql(t.EXPORT_ALIASES, 'x')}, x) END AS export_size,
  CASE WHEN c = '' THEN NULL WHEN c IN ('FREE', 'FREESIZE', 'ONESIZE', 'OS') THEN 'FREE' WHEN regexp_matches(c, '^X{{2,}}L$') THEN (length(c) - 1) || 'XL' ELSE c END AS chart_size FROM e""")
def size_labels(spark, sf_dir):
    label = F.when(F.col("p_size") % 4 == 0, F.concat(F.lit(" "), F.col("p_size").cast("string"))).otherwise(picked(_SIZES, "p_partkey"))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("i"), label.alias("s")).select("i", t.export_size(F.col("s")).alias("export_size"),
        t.chart_size(F.col("s")).alias("chart_size"))


# ---- similarity


LEAST_ALIKE = 0.33


def title_pairs(spark, sf_dir) -> DataFrame:
    """Pairs of alike names, each by the least part of that name."""
    return matching.similar_titles(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("title")), LEAST_ALIKE)


_PAIRS = f"""cls AS (SELECT min(p_partkey) AS id, {norm_sql('p_name')} AS s FROM part GROUP BY 2), both_ AS (SELECT x.id AS a, y.id AS b, x.s AS na, y.s AS nb, list_distinct({words_sql('x.s')}) AS wx, list_distinct({words_sql('y.s')}) AS wy FROM cls x JOIN cls y ON x.id < y.id),
measured AS (SELECT *, len(list_intersect(wx, wy)) * 1.0 / len(list_distinct(list_concat(wx, wy))) AS j FROM both_), pairs AS (SELECT * FROM measured WHERE j >= {LEAST_ALIKE})"""


@query(f"WITH {_PAIRS} SELECT a, b, round(j, 6) AS jaccard FROM pairs")
def jaccard_titles(spark, sf_dir):
    return title_pairs(spark, sf_dir).select("a", "b", F.round("jaccard", 6).alias("jaccard"))


_SEM = lambda c: f"list_transform(list_filter({words_sql(c)}, lambda w: length(w) > 1 AND w NOT IN {in_sql(vocab.SEMANTIC_STOP)}), lambda w: coalesce({map_sql(DEFAULT.synonyms, 'w')}, w))"
_IDF = f"idf AS (SELECT token, count(*) AS df, ln(((SELECT count(*) FROM part) + 1) / (count(*) + 1)) + 1 AS idf FROM (SELECT unnest(list_distinct({_SEM('p_name')})) AS token FROM part) GROUP BY token)"


@query(f"WITH {_IDF} SELECT token, df, round(idf, 9) AS idf FROM idf")
def idf_table(spark, sf_dir):
    return matching.idf_table(table(spark, sf_dir, "part").select(F.col("p_name").alias("title"))).select("token", "df", F.round("idf", 9).alias("idf"))


@query(f"""WITH {_PAIRS}, {_IDF}, bag AS (SELECT p_partkey AS id, token, count(*) * any_value(idf) AS w FROM (SELECT p_partkey, unnest({_SEM('p_name')}) AS token FROM part) JOIN idf USING (token) GROUP BY 1, 2),
norm AS (SELECT id, sum(w * w) AS n2 FROM bag GROUP BY id), dot AS (SELECT a, b, sum(x.w * y.w) AS d FROM pairs JOIN bag x ON x.id = a JOIN bag y ON y.id = b AND y.token = x.token GROUP BY 1, 2)
SELECT a, b, round(coalesce(d / sqrt(p.n2 * q.n2), 0), 6) AS cosine FROM pairs LEFT JOIN dot USING (a, b) LEFT JOIN norm p ON p.id = a LEFT JOIN norm q ON q.id = b""")
def token_cosine(spark, sf_dir):
    titles = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("title"))
    return matching.cosine_pairs(titles, title_pairs(spark, sf_dir).select("a", "b"), matching.idf_table(titles)).withColumn("cosine", F.round("cosine", 6))


_TRI = lambda c: f"(SELECT list(substr(' ' || {norm_sql(c)} || ' ', i::INT, 3)) FROM range(1, length({norm_sql(c)}) + 1) r(i))"


@query(f"""WITH {_PAIRS}, names AS (SELECT na AS s FROM pairs UNION SELECT nb FROM pairs), g AS (SELECT s, ' ' || {norm_sql('s')} || ' ' AS p FROM names),
tri AS (SELECT s, k, count(*) AS c FROM (SELECT s, substr(p, i::INT, 3) AS k FROM g, range(1, 200) r(i) WHERE i <= length(p) - 2) GROUP BY 1, 2), norm AS (SELECT s, sum(c * c) AS n2 FROM tri GROUP BY s),
np AS (SELECT DISTINCT na, nb FROM pairs), dot AS (SELECT na, nb, sum(x.c * y.c) AS d FROM np JOIN tri x ON x.s = na JOIN tri y ON y.s = nb AND y.k = x.k GROUP BY 1, 2)
SELECT a, b, round(coalesce(d / sqrt(p.n2 * q.n2), 0), 6) AS cosine FROM pairs LEFT JOIN dot USING (na, nb) LEFT JOIN norm p ON p.s = na LEFT JOIN norm q ON q.s = nb""")
def trigram_cosine(spark, sf_dir):
    return title_pairs(spark, sf_dir).select("a", "b", F.round(sim.trigram_cosine(F.col("title_a"), F.col("title_b")), 6).alias("cosine"))


@query("""WITH q AS (SELECT * FROM embeddings WHERE vec_id % 20 = 0), p AS (SELECT q.vec_id AS query_id, e.vec_id, round(list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[])), 6) AS cosine FROM q JOIN embeddings e ON e.vec_id <> q.vec_id),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY cosine DESC, vec_id) AS INTEGER) AS rank FROM p) SELECT query_id, vec_id, cosine, rank FROM r WHERE rank <= 5""")
def embedding_cosine_topk(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    return matching.nearest(e, e.where("vec_id % 20 = 0"), 5)


#: Two colours of a part, of its key and size.
_RGB = {"r1": "p_partkey % 256", "g1": "p_size * 5 % 256", "b1": "p_partkey * 7 % 256", "r2": "p_size * 3 % 256", "g2": "p_partkey * 11 % 256", "b2": "(p_partkey + p_size) % 256"}
_LIN = lambda c: f"CASE WHEN {c} / 255.0 > 0.04045 THEN pow(({c} / 255.0 + 0.055) / 1.055, 2.4) ELSE {c} / 255.0 / 12.92 END"
_FN = lambda v: f"CASE WHEN {v} > 0.008856 THEN cbrt({v}) ELSE 7.787 * {v} + 16 / 116.0 END"


def _lab_sql(n: str) -> str:
    lin = [f"({_LIN(f'{c}{n}')})" for c in "rgb"]
    x, y, z = (f"({_FN(f'(({a} * {lin[0]} + {b} * {lin[1]} + {c} * {lin[2]}) / {w})')})" for (a, b, c),
        w in zip(((0.4124, 0.3576, 0.1805), (0.2126, 0.7152, 0.0722), (0.0193, 0.1192, 0.9505)), (0.95047, 1.0, 1.08883), strict=True))
    return f"116 * {y} - 16 AS l{n}, 500 * ({x} - {y}) AS a{n}, 200 * ({y} - {z}) AS b{n}_"


@query("WITH v AS (SELECT p_partkey AS i, " + ", ".join(f"{x} AS {n}" for n,
    x in _RGB.items()) + f" FROM part), l AS (SELECT i, {_lab_sql('1')}, {_lab_sql('2')} FROM v) SELECT i, round(sqrt(pow(l1 - l2, 2) + pow(a1 - a2, 2) + pow(b1_ - b2_, 2)), 1) AS delta_e FROM l")
def colour_distance(spark, sf_dir):
    c = [F.col(x) for x in ("r1", "g1", "b1", "r2", "g2", "b2")]
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("i"), *[F.expr(x).cast("int").alias(n) for n, x in _RGB.items()]).select("i",
        sim.delta_e(sim.lab(*c[:3]), sim.lab(*c[3:])).alias("delta_e"))


# ---- evidence and decisions


@query("""WITH v AS (SELECT p_partkey, p_retailprice AS a, CASE p_size % 5 WHEN 0 THEN p_retailprice WHEN 1 THEN p_retailprice * 1.015 WHEN 2 THEN p_retailprice * 1.08 WHEN 3 THEN p_retailprice * 0.8 ELSE NULL END AS b FROM part),
r AS (SELECT *, round(a) AS x, round(b) AS y FROM v)
SELECT p_partkey, CAST(CASE WHEN x = y THEN 1.0 WHEN abs(x - y) / greatest(x, y) <= 0.02 THEN 0.9 WHEN abs(x - y) / greatest(x, y) <= 0.1 THEN 0.55 WHEN abs(x - y) / greatest(x, y) <= 0.25 THEN 0.25 WHEN y IS NOT NULL THEN 0.0 END AS DOUBLE) AS evidence FROM r""")
def mrp_evidence(spark, sf_dir):
    m = F.col("p_size") % 5
    p = F.col("p_retailprice")
    other = F.when(m == 0, p).when(m == 1, p * 1.015).when(m == 2, p * 1.08).when(m == 3, p * 0.8)
    return table(spark, sf_dir, "part").select("p_partkey", dec.mrp_evidence(p, other).alias("evidence"))


_SIGNALS = {"mrp": ("l_tax", 3), "attributes": ("l_discount", 4), "title": ("l_tax", 5), "model": ("l_discount", 2), "brand": ("l_tax", 7)}


@query("WITH v AS (SELECT l_orderkey, l_linenumber, " + ", ".join(f"CASE WHEN (l_orderkey + l_linenumber) % {k} <> 0 THEN least(1, {c} * 10) END AS {n}" for n,
    (c, k) in _SIGNALS.items()) + ", l_quantity FROM lineitem), w AS (SELECT *, "
       + " + ".join(f"CASE WHEN {n} IS NOT NULL THEN {vocab.SIGNAL_WEIGHTS[n]}::DOUBLE{' * least(1, l_quantity / 10 / 5)' if n == 'attributes' else ''} ELSE 0 END" for n in _SIGNALS) + " AS den, "
       + " + ".join(f"coalesce({n} * ({vocab.SIGNAL_WEIGHTS[n]}::DOUBLE{' * least(1, l_quantity / 10 / 5)' if n == 'attributes' else ''}), 0)" for n in _SIGNALS) + " AS num FROM v) SELECT l_orderkey, l_linenumber, round(CASE WHEN den > 0 THEN num / den END, 4) AS score, round(den, 3) AS coverage FROM w")
def blend_renormalised(spark, sf_dir):
    on = F.col("l_orderkey") + F.col("l_linenumber")
    signals = {n: F.when(on % k != 0, F.least(F.lit(1.0), F.col(c) * 10)) for n, (c, k) in _SIGNALS.items()}
    b = dec.blend(signals, {"attributes": dec.attribute_scale(F.col("l_quantity") / 10)})
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", b.alias("b")).select("l_orderkey", "l_linenumber", "b.score", "b.coverage")


_SCORED = "s AS (SELECT l_partkey AS anchor_id, l_suppkey % 2 AS platform, l_orderkey * 10 + l_linenumber AS id, l_extendedprice AS price, round(1 - l_discount * 4 - l_tax / 2, 4) AS score, l_quantity FROM lineitem), ranked AS (SELECT *, row_number() OVER (PARTITION BY anchor_id, platform ORDER BY score DESC, id, price) AS rank FROM s)"


def _scored(spark, sf_dir) -> DataFrame:
    from pyspark.sql.window import Window

    rows = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("anchor_id"), (F.col("l_suppkey") % 2).alias("platform"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.col("l_extendedprice").alias("price"),
        F.round(1 - F.col("l_discount") * 4 - F.col("l_tax") / 2, 4).alias("score"), "l_quantity")
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("anchor_id", "platform").orderBy(F.col("score").desc(), "id", "price")))


@query(f"""WITH {_SCORED}, t AS (SELECT *, CAST(ceil(rank / 5.0) AS INT) AS batch, l_quantity < 35 AS rejected FROM ranked WHERE rank <= 10), f AS (SELECT *, min(batch) FILTER (NOT rejected) OVER (PARTITION BY anchor_id, platform) AS first FROM t)
SELECT anchor_id, platform, id, CAST(rank AS INTEGER) AS rank, batch FROM f WHERE first IS NULL OR batch <= first""")
def rank_topk_batches(spark, sf_dir):
    ten = _scored(spark, sf_dir).where("rank <= 10").withColumn("batch", F.ceil(F.col("rank") / 5).cast("int")).withColumn("rejected", F.when(F.col("l_quantity") < 35, "color"))
    kept = matching.batches(ten.withColumn("listing", F.struct("platform")))
    return kept.select("anchor_id", "platform", "id", "rank", "batch")


@query(f"""WITH {_SCORED}, v AS (SELECT * FROM ranked WHERE rank <= 6), b AS (SELECT *, first_value(score) OVER w AS bs, first_value(price) OVER w AS bp, first_value(id) OVER w AS bi FROM v WINDOW w AS (PARTITION BY anchor_id, platform ORDER BY score DESC, rank))
SELECT anchor_id, platform, count(*) FILTER (bs - score <= 0.04 AND id <> bi AND abs(price - bp) / greatest(price, bp) > 0.02) AS ties FROM b GROUP BY 1, 2""")
def ambiguity_rivals(spark, sf_dir):
    viable = _scored(spark, sf_dir).where("rank <= 6").withColumn("image", F.lit(None).cast("double"))
    return matching.rivals(viable).groupBy("anchor_id", "platform").agg(F.count_if("tied").alias("ties"))


_FABRIC = """SELECT p_partkey AS id, CASE p_partkey % 6 WHEN 0 THEN (78 + p_size % 22) || '% Cotton, ' || (22 - p_size % 22) || '% Elastane' WHEN 1 THEN 'Pure Wool' WHEN 2 THEN 'Cotton Blend'
  WHEN 3 THEN (30 + p_size % 45) || ' % polyester ' || (70 - p_size % 45) || '.5% viscose' WHEN 4 THEN 'Single Jersey, 100% ' || p_type ELSE p_name || ' in silk and linen' END AS s FROM part"""
_SHARE = r"([0-9]{1,3}(?:\.[0-9]+)?)\s*%\s*([a-z]+)"


@query(rf"""WITH s AS ({_FABRIC}), low AS (SELECT id, lower(s) AS s FROM s), fibre AS (SELECT unnest({list(vocab.FIBRES)}) AS f, generate_subscripts({list(vocab.FIBRES)}, 1) AS ford),
said AS (SELECT id, CAST(unnest(regexp_extract_all(s, '{_SHARE}', 1)) AS DOUBLE) AS pct, unnest(regexp_extract_all(s, '{_SHARE}', 2)) AS w FROM low),
pair AS (SELECT id, pct, arg_min(f, ford) AS f FROM said JOIN fibre ON starts_with(w, f[1:5]) GROUP BY id, pct, w), exact AS (SELECT id, arg_max(f, pct) AS material, max(pct) AS pct, count(*) > 1 AS blend, max(pct) FILTER (f IN ('elastane', 'spandex', 'lycra')) AS elastic FROM pair GROUP BY id),
named AS (SELECT id, arg_min(f, ford) AS material, CASE WHEN any_value(regexp_matches(s, '\bpure\b|\b100\b') AND NOT regexp_matches(s, '\bblend(ed)?\b')) THEN 100.0 END AS pct, any_value(regexp_matches(s, '\bblend(ed)?\b')) OR count(*) > 1 AS blend FROM low JOIN fibre ON regexp_matches(s, '\b' || f || '\b') GROUP BY id)
SELECT low.id, coalesce(e.material, n.material) AS material, CASE WHEN e.id IS NULL THEN n.pct ELSE e.pct END AS pct, coalesce(e.blend, n.blend) AS blend,
  CASE WHEN elastic >= 3 THEN 'stretchable' WHEN elastic < 3 THEN 'slight stretch' WHEN e.id IS NOT NULL OR n.id IS NOT NULL THEN 'non stretch' END AS stretch FROM low LEFT JOIN exact e ON e.id = low.id LEFT JOIN named n ON n.id = low.id""")
def fabric_parse(spark, sf_dir):
    size, text = F.col("p_size"), lambda c: c.cast("string")
    made = (
        F.when(F.col("p_partkey") % 6 == 0, F.concat(text(78 + size % 22), F.lit("% Cotton, "), text(22 - size % 22), F.lit("% Elastane")))
        .when(F.col("p_partkey") % 6 == 1, "Pure Wool").when(F.col("p_partkey") % 6 == 2, "Cotton Blend")
        .when(F.col("p_partkey") % 6 == 3, F.concat(text(30 + size % 45), F.lit(" % polyester "), text(70 - size % 45), F.lit(".5% viscose")))
        .when(F.col("p_partkey") % 6 == 4, F.concat(F.lit("Single Jersey, 100% "), "p_type")).otherwise(F.concat("p_name", F.lit(" in silk and linen")))
    )
    d = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), made.alias("s")).withColumn("f", att.fabric(F.col("s")))
    return d.select("id", F.col("f.primary").alias("material"), F.get("f.composition", F.lit(0))["pct"].alias("pct"), F.col("f.blend").alias("blend"),
        att.stretch(F.col("f"), F.col("s")).alias("stretch"))


# ---- size charts: parts as products, two suppliers' lines as charts


@query("""WITH c AS (SELECT l_partkey AS product_id, l_suppkey % 2 AS platform, l_linenumber AS size, l_quantity + 20 AS lo, l_quantity + 20 + (l_orderkey % 3) AS hi, row_number() OVER (PARTITION BY l_partkey, l_suppkey % 2, l_linenumber ORDER BY l_orderkey, l_suppkey, l_quantity) AS rn FROM lineitem),
f AS (SELECT *, (lo + hi) / 2 AS inch FROM c WHERE rn = 1), g AS (SELECT product_id, size, count(*) AS n, greatest(0, max(lo) - min(hi)) AS d FROM f GROUP BY 1, 2)
SELECT product_id, CAST(size AS VARCHAR) AS size, n, CASE WHEN n > 1 THEN round(d, 2) END AS delta, CASE WHEN n = 1 THEN 'single' WHEN d <= 0.4 THEN 'match' ELSE 'mismatch' END AS status, CASE WHEN n > 1 AND d >= 1 THEN 'major' WHEN n > 1 AND d > 0.4 THEN 'minor' END AS severity FROM g""")
def sizechart_cells(spark, sf_dir):
    c = F.col
    rows = table(spark, sf_dir, "lineitem").select(
        c("l_partkey").alias("product_id"), (c("l_suppkey") % 2).cast("string").alias("platform"),
        F.struct("l_orderkey", "l_suppkey", "l_quantity").alias("pos"), c("l_linenumber").cast("string").alias("size"),
        F.lit("1. To Fit Chest (in)").alias("raw_axis"), F.lit(None).cast("string").alias("basis"),
        *[F.lit(None).cast("double").alias(n) for n in ("inch", "cm", "cm_lo", "cm_hi")], (c("l_quantity") + 20).alias("inch_lo"),
        (c("l_quantity") + 20 + c("l_orderkey") % 3).alias("inch_hi"))
    return sizechart.cells(sizechart.indexed(rows)).select("product_id", "size", "n", "delta", "status", "severity")


RAW_AXES = ("ACROSS SHOULDER", "to fit waist", "Chest", "hip_width", "To Fit  Hips", "bottom-hem", "", "FootLength", "sleeve length", "odd Name of it")
_AXIS_NAMES = {a: n for n, spelled in t.AXES.items() for a in spelled}


@query(rf"""WITH r AS (SELECT DISTINCT CASE l_quantity % 3 WHEN 0 THEN '' WHEN 1 THEN l_linenumber || '. ' ELSE ' ' || l_linenumber || ')' END || {list(RAW_AXES)}[l_suppkey % 10 + 1] || CASE l_orderkey % 3 WHEN 0 THEN '' WHEN 1 THEN ' (in)' ELSE '(CMS)' END AS raw
  FROM (SELECT CAST(l_quantity AS INT) AS l_quantity, l_linenumber, l_suppkey, l_orderkey FROM lineitem)),
n AS (SELECT raw, lower(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(raw, '^\s*\d+\s*[.)]\s*', ''), '\((in|inch|inches|cm|cms)\)', '', 'gi'), '[_-]+', ' ', 'g'), '\s+', ' ', 'g'))) AS s FROM r)
SELECT raw, CASE WHEN s <> '' THEN coalesce({map_sql(_AXIS_NAMES, 's')}, array_to_string(list_transform(string_split(s, ' '), lambda w: upper(w[1]) || w[2:]), ' ')) END AS axis, CASE WHEN s <> '' THEN CASE WHEN regexp_matches(s, '^to fit\b') THEN 'body' ELSE 'garment' END END AS basis FROM n""")
def chart_axes(spark, sf_dir):
    """Headings of charts put together from line items."""
    q, k, line = F.col("l_quantity").cast("int") % 3, F.col("l_orderkey") % 3, F.col("l_linenumber").cast("string")
    ordinal = F.when(q == 0, "").when(q == 1, F.concat(line, F.lit(". "))).otherwise(F.concat(F.lit(" "), line, F.lit(")")))
    unit = F.when(k == 0, "").when(k == 1, " (in)").otherwise("(CMS)")
    raw = F.concat(ordinal, F.element_at(t.literal_array(RAW_AXES), (F.col("l_suppkey") % 10 + 1).cast("int")), unit)
    return table(spark, sf_dir, "lineitem").select(raw.alias("raw")).distinct().select("raw", t.chart_axis(F.col("raw")).alias("x")).select("raw", "x.axis", "x.basis")


# ---- imports over conversations: turns are cells


@query("""WITH c AS (SELECT conv_id, turn, role, 'MP' || lpad(CAST(conv_id % 50 AS VARCHAR), 6, '0') AS pid FROM conversations), r AS (SELECT DISTINCT conv_id AS row, pid AS id FROM c),
h AS (SELECT conv_id AS row, arg_min('https://www.myntra.com/' || role || '/' || turn, turn) FILTER (role = 'assistant') AS myntra, arg_min('http://ajio.com/x/' || turn, turn) FILTER (role = 'system') AS ajio FROM c GROUP BY conv_id)
SELECT id, min(row) AS row, count(*) AS n_rows, arg_min(myntra, row) FILTER (myntra IS NOT NULL) AS myntra, arg_min(ajio, row) FILTER (ajio IS NOT NULL) AS ajio FROM r JOIN h USING (row) GROUP BY id""")
def import_dedupe(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    pid = F.concat(F.lit("mp"), F.lpad((F.col("conv_id") % 50).cast("string"), 6, "0"))
    link = F.when(F.col("role") == "assistant", F.concat(F.lit("https://www.myntra.com/"), "role", F.lit("/"), "turn")).when(F.col("role") == "system", F.concat(F.lit("http://ajio.com/x/"), "turn"))
    cells = c.select(F.lit("S").alias("sheet"), F.col("conv_id").alias("row"), (F.col("turn") + 1).cast("int").alias("col"),
        link.alias("text")).unionByName(c.select("conv_id").distinct().select(F.lit("S").alias("sheet"), F.col("conv_id").alias("row"), F.lit(0).alias("col"),
        F.concat(F.lit("https://shop.example/x/p-"), pid).alias("text")))
    return imports.items(imports.rows(cells)).select("id", "row", F.size("source_rows").cast("long").alias("n_rows"), "myntra", "ajio")


@query("""SELECT conv_id AS id, CASE WHEN bool_and(role = 'user') FILTER (turn % 3 <> 0) THEN 'agreed' WHEN NOT bool_and(role = 'user') FILTER (turn % 3 <> 0) THEN 'disagreed' END AS agreement FROM conversations GROUP BY conv_id""")
def hint_agreement(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select(F.lit("j").alias("job_id"), F.col("conv_id").alias("id"),
        F.when(F.col("turn") % 3 != 0, F.col("role")).alias("found"), F.lit("user").alias("hint"))
    return imports.agreement(c).select("id", "agreement")


@query("""WITH j AS (SELECT user_id AS job_id, event_type = 'purchase' OR event_type = 'view' OR event_type = 'error' AS fin, event_type, value FROM events)
SELECT job_id, count(*) AS total, count(*) FILTER (fin) AS done, count(*) FILTER (event_type = 'purchase') AS matched, count(*) FILTER (event_type = 'error') AS errors, round(count(*) FILTER (fin) * 100.0 / count(*), 1) AS percent,
  round((avg(value) FILTER (fin)) * (count(*) - count(*) FILTER (fin)), 3) AS eta_seconds FROM j GROUP BY job_id""")
def job_progress(spark, sf_dir):
    e = F.col("event_type")
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("job_id"),
        F.when(e.isin("purchase", "view", "error"), "done").otherwise("queued").alias("state"),
        F.when(e == "purchase", "matched").when(e == "error", "error").alias("status"), F.col("value").alias("seconds"))
    return imports.progress(rows)


# ---- state over events

AS_OF = "2024-01-28 00:00:00"


@query(f"SELECT user_id AS id, max(ts) AS \"searchedAt\" FROM events WHERE event_type = 'view' GROUP BY user_id HAVING max(ts) <= TIMESTAMP '{AS_OF}' AND max(ts) > TIMESTAMP '{AS_OF}' - INTERVAL 48 HOUR ORDER BY 2 DESC, 1 LIMIT 12")
def recent_latest_ttl(spark, sf_dir):
    views = table(spark, sf_dir, "events").where("event_type = 'view'").select(F.col("user_id").alias("id"), F.col("ts").alias("searchedAt"))
    return state.recents(views, F.lit(AS_OF).cast("timestamp"))


@query(f"SELECT event_id, ts <= TIMESTAMP '{AS_OF}' AND ts > TIMESTAMP '{AS_OF}' - INTERVAL 24 HOUR AND (event_type <> 'error' OR ts > TIMESTAMP '{AS_OF}' - INTERVAL 10 MINUTE) AS replayable FROM events")
def replayable_flag(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", state.replayable(F.col("ts"), F.array("event_type"), F.lit(AS_OF).cast("timestamp"), 24).alias("replayable"))


@query("WITH r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) SELECT user_id, event_id, event_type FROM r WHERE rn = 1 AND event_type <> 'signup'")
def latest_upsert(spark, sf_dir):
    last = state.latest(table(spark, sf_dir, "events"), ["user_id"], F.col("ts").desc(), F.col("event_id").desc())
    return last.where("event_type <> 'signup'").select("user_id", "event_id", "event_type")


@query("""SELECT user_id AS key, CAST(floor(epoch(ts) / 86400) AS BIGINT) AS "window", count(*) AS requests, count(*) FILTER (event_type = 'error') AS errors, round(count(*) FILTER (event_type = 'error') / count(*), 6) AS error_share,
  CASE WHEN count(*) > 1 THEN round((max(epoch(ts)) - min(epoch(ts))) / (count(*) - 1), 3) END AS mean_gap, CAST(greatest(0, count(*) - 2) AS BIGINT) AS over FROM events GROUP BY 1, 2""")
def token_bucket(spark, sf_dir):
    """The load of each user and day: what a budget of two requests a day would have held back."""
    return pacing.load(paced(spark, sf_dir), 86400, 2)


def paced(spark, sf_dir, *more: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(*more, F.col("user_id").alias("key"), F.col("ts").cast("timestamp").cast("double").alias("at"), (F.col("event_type") != "error").alias("ok"))


@query(f"""WITH c AS (SELECT user_id AS anchor_id, CAST(event_id % 2 AS VARCHAR) AS platform, event_type = 'purchase' AS ok, value, ts FROM events),
g AS (SELECT anchor_id, count(*) FILTER (ok) AS matched, min(value) FILTER (ok) AS best_price, max(ts) AS matched_at FROM c GROUP BY 1), b AS (SELECT anchor_id, platform AS best_platform, row_number() OVER (PARTITION BY anchor_id ORDER BY value DESC, platform DESC) AS rn FROM c WHERE ok)
SELECT g.anchor_id, matched, best_platform, best_price, round(epoch(TIMESTAMP '{AS_OF}' - matched_at) / 3600, 2) AS age_hours, matched_at <= TIMESTAMP '{AS_OF}' AND matched_at > TIMESTAMP '{AS_OF}' - INTERVAL 24 HOUR AS fresh FROM g LEFT JOIN b ON b.anchor_id = g.anchor_id AND rn = 1""")
def saved_reports(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    c = e.select(F.col("user_id").alias("anchor_id"), (F.col("event_id") % 2).cast("string").alias("platform"),
        F.when(F.col("event_type") == "purchase", "matched").otherwise("no_match").alias("status"), F.col("value").alias("price"), F.col("value").alias("score"), F.col("ts").alias("matched_at"))
    return reports.saved(c, F.lit(AS_OF).cast("timestamp"), 24).select("anchor_id", "matched", "best_platform", "best_price", F.round("age_hours", 2).alias("age_hours"), "fresh")


@query("""WITH v AS (SELECT l_partkey AS anchor_id, l_suppkey % 2 AS platform, max(l_extendedprice) AS price, CAST(count(*) AS DOUBLE) AS lines, max(l_discount) * 10 AS score FROM lineitem GROUP BY 1, 2),
l AS (SELECT anchor_id, platform, unnest(['price', 'lines', 'score']) AS label, unnest([price, lines, score]) AS value FROM v), w AS (SELECT *, min(value) OVER p AS lo, max(value) OVER p AS hi, count(value) OVER p AS n FROM l WINDOW p AS (PARTITION BY anchor_id, label))
SELECT anchor_id, platform, label, value, CASE label WHEN 'price' THEN CASE WHEN value = lo AND lo <> hi THEN 'best' WHEN value = hi AND lo <> hi THEN 'low' ELSE 'moderate' END
  WHEN 'lines' THEN CASE WHEN n < 2 THEN 'na' WHEN lo = hi THEN 'moderate' WHEN value = hi THEN 'best' ELSE 'low' END ELSE CASE WHEN value >= 0.85 THEN 'best' WHEN value >= 0.6 THEN 'moderate' ELSE 'low' END END AS verdict FROM w""")
def report_cells(spark, sf_dir):
    c = table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("anchor_id"),
        (F.col("l_suppkey") % 2).alias("platform")).agg(F.max("l_extendedprice").alias("price"), F.count("*").cast("double").alias("lines"), (F.max("l_discount") * 10).alias("score"))
    return reports.cells(c, {"price": "price", "lines": "count", "score": "score"}).select("anchor_id", "platform", "label", "value", "verdict")


# ---- audits


@query("""WITH v AS (SELECT lang, n_chars > 1500 AS decided, quality = 1 AS truth FROM documents JOIN labels USING (doc_id)), c AS (SELECT lang, count(*) FILTER (decided AND truth) AS tp, count(*) FILTER (decided AND NOT truth) AS fp, count(*) FILTER (NOT decided AND truth) AS fn, count(*) FILTER (NOT decided AND NOT truth) AS tn FROM v GROUP BY lang)
SELECT lang, tp, fp, fn, tn, round(tp / nullif(tp + fp, 0), 6) AS precision, round(tp / nullif(tp + fn, 0), 6) AS recall, round((tp + tn) / (tp + fp + fn + tn), 6) AS accuracy FROM c""")
def audit_confusion(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars").join(table(spark, sf_dir, "labels"), "doc_id")
    return audit.confusion(d.withColumn("verdict", audit.verdict(F.col("n_chars") > 1500, F.col("quality") == 1)), "lang")


CLAIMS = {0: "AUTOMOBILE", 1: "BUILDING", 2: "FURNITURE", 3: "HOUSEHOLD", 4: "MACHINERY"}


@query(f"WITH c AS (SELECT c_custkey % 1000 AS code, c_mktsegment AS s FROM customer) SELECT code, array_to_string(list_sort(list(DISTINCT s)), ',') AS segments, count(*) AS n FROM c GROUP BY code HAVING count(DISTINCT s) > 1 OR NOT list_contains(list(s), {map_sql({str(k): v for k, v in CLAIMS.items()}, 'CAST(code % 5 AS VARCHAR)')})")
def prefix_contradictions(spark, sf_dir):
    """Codes of customers, whose last digit claims a segment."""
    rows = table(spark, sf_dir, "customer").select((F.col("c_custkey") % 1000).alias("code"), "c_mktsegment")
    found = audit.contradictions(rows, "code", "c_mktsegment", F.try_element_at(t.literal_map(CLAIMS), (F.col("code") % 5).cast("int")))
    return found.select("code", F.array_join("values", ",").alias("segments"), "n")


@query("""WITH r AS (SELECT r_name AS region, n_name AS nation, c_mktsegment AS segment, o_totalprice FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)
SELECT region, count(*) AS n, round(sum(o_totalprice), 2) AS total, count(DISTINCT segment) AS segments FROM r GROUP BY region""")
def sales_by_region(spark, sf_dir):
    o, c, n, r = (table(spark, sf_dir, x) for x in ("orders", "customer", "nation", "region"))
    rows = o.join(c, o.o_custkey == c.c_custkey).join(n, F.col("c_nationkey") == F.col("n_nationkey")).join(r, F.col("n_regionkey") == F.col("r_regionkey"))
    return rows.groupBy(F.col("r_name").alias("region")).agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"), F.count_distinct("c_mktsegment").alias("segments"))


@query(POSITIONS + """SELECT p_partkey, CASE WHEN gap > 0 THEN 'Undercut by ' || CAST(gap AS BIGINT) || ': match ' || CAST(best_rival AS BIGINT) || ' on ' || cheapest_rival
  WHEN gap < 0 THEN 'Cheapest by ' || CAST(-gap AS BIGINT) || ': room to raise the price' WHEN gap = 0 THEN 'At parity: hold the price' ELSE 'No rival price: nothing to compare' END AS action FROM positions""")
def decision_summary(spark, sf_dir):
    return reports.summary(positions(spark, sf_dir), OWN).select("p_partkey", "action")


@query("""WITH c AS (SELECT DISTINCT user_id AS key, max(ts) OVER (PARTITION BY user_id) AS last FROM events) SELECT p_partkey, last IS NOT NULL AS compared, last FROM part LEFT JOIN c ON key = p_partkey""")
def catalog_summaries(spark, sf_dir):
    last = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("p_partkey")).agg(F.max("ts").alias("last"))
    return table(spark, sf_dir, "part").select("p_partkey").join(last, "p_partkey", "left").select("p_partkey", F.col("last").isNotNull().alias("compared"), "last")


@query("""WITH w AS (SELECT user_id AS key, CAST(floor(epoch(ts) / 7200) AS BIGINT) AS w, count(*) AS requests, count(*) FILTER (event_type = 'error') AS errors FROM events GROUP BY 1, 2)
SELECT a.key, a.w AS "window", a.requests, a.errors, CASE WHEN coalesce(b.errors, 0) > 0 THEN 'open' WHEN a.errors > 0 THEN 'tripped' ELSE 'closed' END AS circuit FROM w a LEFT JOIN w b ON b.key = a.key AND b.w = a.w - 1""")
def circuit_windows(spark, sf_dir):
    """Each user's windows of two hours: open behind one with errors."""
    return pacing.circuits(paced(spark, sf_dir), 7200, 1)


@query("""WITH e AS (SELECT user_id, epoch(ts) AS t, event_type = 'error' AS slow, event_id FROM events), w AS (SELECT *, max(CASE WHEN slow THEN t END) OVER (PARTITION BY user_id ORDER BY t, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last, lag(t) OVER (PARTITION BY user_id ORDER BY t, event_id) AS prev FROM e)
SELECT event_id, CASE WHEN t < last + 7200 THEN 'open' WHEN last IS NOT NULL AND (prev < last + 7200 OR prev = last) THEN 'probe' ELSE 'closed' END AS circuit FROM w""")
def circuit_breaker(spark, sf_dir):
    """Each event of a user: open within two hours of the last error, a probe first behind them."""
    return pacing.breaker(paced(spark, sf_dir, "event_id"), 7200, "event_id").select("event_id", "circuit")


@query("""WITH w AS (SELECT l_partkey AS k, count(*) AS wanted FROM lineitem WHERE l_returnflag <> 'R' GROUP BY 1), t AS (SELECT l_partkey AS k, count(*) AS tries, bool_or(l_quantity > 48) AS done, max(epoch(l_shipdate)) AS last FROM lineitem WHERE l_returnflag = 'R' AND l_linestatus = 'F' GROUP BY 1)
SELECT k, wanted, coalesce(tries, 0) AS tries, last + 60 * pow(2, tries - 1) AS not_before FROM w LEFT JOIN t USING (k) WHERE NOT coalesce(done, false) AND coalesce(tries, 0) < 3""")
def work_queue(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").withColumns({"k": F.col("l_partkey"), "at": F.col("l_shipdate").cast("timestamp").cast("double")})
    tried = rows.where("l_returnflag = 'R' and l_linestatus = 'F'").withColumn("ok", F.col("l_quantity") > 48)
    return pacing.work_queue(rows.where("l_returnflag <> 'R'"), tried, "k")


@query("""WITH s AS (SELECT l_partkey AS id, list_distinct(list(CAST(l_linenumber AS VARCHAR))) AS sizes FROM lineitem GROUP BY 1), x AS (SELECT unnest(sizes) AS size, p_brand <> 'Brand#2' AS ok FROM s JOIN part ON id = p_partkey)
SELECT size, count(*) FILTER (ok) AS n FROM x GROUP BY size""")
def size_facets(spark, sf_dir):
    sizes = table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.collect_set(F.col("l_linenumber").cast("string")).alias("sizes"))
    return position.size_facet(table(spark, sf_dir, "part").join(sizes, "p_partkey"), "sizes", F.col("p_brand") != "Brand#2")


@query("""WITH v AS (SELECT p_partkey AS image_id, r.i AS x, s.j AS y, (r.i * 37 + s.j * 91 + p_partkey * 13 + r.i * s.j * p_size) % 256 AS v FROM part, range(9) r(i), range(8) s(j)),
d AS (SELECT a.image_id, a.x, a.y, a.v > b.v AS bit FROM v a JOIN v b ON b.image_id = a.image_id AND b.x = a.x + 1 AND b.y = a.y)
SELECT image_id, bit_or(CASE WHEN bit THEN CASE WHEN y * 8 + x = 0 THEN -9223372036854775808 ELSE 1::BIGINT << CAST(63 - (y * 8 + x) AS INT) END ELSE 0 END) AS dhash FROM d GROUP BY image_id""")
def difference_hash(spark, sf_dir):
    """Of a picture of each part."""
    pixels = dealt(table(spark, sf_dir, "part").select("p_partkey", "p_size")).select(F.col("p_partkey").alias("image_id"), "p_size", F.explode(F.sequence(F.lit(0), F.lit(71))).alias("i"))
    grey = pixels.select("image_id", "p_size", (F.col("i") % 9).alias("x"), F.floor(F.col("i") / 9).alias("y"))
    return images.difference_hash(grey.withColumn("v", (F.col("x") * 37 + F.col("y") * 91 + F.col("image_id") * 13 + F.col("x") * F.col("y") * F.col("p_size")) % 256))
