"""Stores, streams, pages and jobs over the tables: what is folded from streams must equal the SQL over the whole table."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.functions import text as t
from quillon.operators import exports, imports, isolation, ordered, position, reports
from quillon.plans.catalogue import AS_OF, OWN, POSITIONS, map_sql, positions, query, table
from quillon.sources import shared, store
from quillon.streaming import pacing, snapshots

c, lit = F.col, F.lit


def in_halves(spark, events: DataFrame, fold: snapshots.Fold) -> DataFrame:
    """The snapshot of a stream over the events: files land in two portions, and after the first one the stream ends and is started again."""
    landing, checkpoint, to = (shared.fresh(spark, n) for n in ("landing", "stream", "snapshots"))
    versions = snapshots.Snapshots(spark, to)
    for half in (0, 1):
        events.where(c("event_id") % 2 == half).repartitionByRange(3, "ts", "event_id").write.mode("append").parquet(landing)
        stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 2).parquet(landing)
        snapshots.run(stream, versions, fold, checkpoint)
    return versions.read()


@query("WITH r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) SELECT user_id, event_id, event_type FROM r WHERE rn = 1")
def snapshot_stream(spark, sf_dir):
    """The newest event of each user, folded batch by batch into snapshots behind an atomic pointer."""
    events = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "event_type")
    return in_halves(spark, events, snapshots.latest_rows(["user_id"], "ts", "event_id")).select("user_id", "event_id", "event_type")


@query("""WITH v AS (SELECT event_type AS owner, user_id AS id, max(ts) AS seen FROM events GROUP BY 1, 2), n AS (SELECT max(ts) AS now FROM events),
r AS (SELECT *, row_number() OVER (PARTITION BY owner ORDER BY seen DESC, id) AS rn FROM v)
SELECT owner, id, seen AS "searchedAt", round((epoch(now) - epoch(seen)) / 3600, 4) AS age_hours, round(greatest(0, 12 - (epoch(now) - epoch(seen)) / 3600), 4) AS expires_in_hours FROM r, n WHERE rn <= 20 AND (epoch(now) - epoch(seen)) / 3600 <= 12""")
def recents_stream(spark, sf_dir):
    """The users each kind of event saw last, 20 a kind at most and none older than twelve hours, kept up by a stream."""
    events = table(spark, sf_dir, "events")
    rows = events.select(c("event_type").alias("owner"), c("user_id").alias("id"), c("ts").alias("searchedAt"), "event_id", "ts")
    kept = in_halves(spark, rows, snapshots.newest_keys("owner", "id", "searchedAt", 20))
    now = events.agg(F.max("ts")).scalar()
    return snapshots.pinned(kept, "searchedAt", now, 12).select("owner", "id", "searchedAt", F.round("age_hours", 4).alias("age_hours"), F.round("expires_in_hours", 4).alias("expires_in_hours"))


def job_events(spark, sf_dir) -> DataFrame:
    """Changes of job items: a job for each 40 users, an item for each user, states and outcomes by the kind of event."""
    e = c("event_type")
    state = F.when(e == "view", "pending").when(e == "click", "running").otherwise("done")
    status = F.when(e == "purchase", "matched").when(e == "error", "error").when(e == "signup", "no_match")
    return table(spark, sf_dir, "events").select(F.floor(c("user_id") / 4).alias("job_id"), c("user_id").alias("item"), state.alias("state"),
        status.alias("status"), c("ts").alias("at"), "ts", "event_id")


_JOBS = """WITH r AS (SELECT user_id // 4 AS job_id, user_id AS item, event_type AS e, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events), i AS (SELECT * FROM r WHERE rn = 1),
g AS (SELECT job_id, count(*) AS total, count(*) FILTER (e = 'view') AS pending, count(*) FILTER (e = 'click') AS running, count(*) FILTER (e NOT IN ('view', 'click')) AS done, count(*) FILTER (e = 'purchase') AS matched,
  count(*) FILTER (e = 'signup') AS no_match, count(*) FILTER (e = 'error') AS failed, min(ts) AS created_at FROM i GROUP BY 1),
j AS (SELECT *, CASE WHEN job_id % 5 = 0 AND pending + running > 0 THEN 'cancelled' WHEN running > 0 THEN 'running' WHEN pending > 0 THEN 'queued' ELSE 'done' END AS job_status FROM g)
"""
_COUNTS = ["job_id", "total", "pending", "running", "done", "matched", "no_match", "failed", "job_status"]


def job_states(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """(items as a stream left them, jobs); each fifth job was cancelled."""
    items = in_halves(spark, job_events(spark, sf_dir), snapshots.latest_rows(["job_id", "item"], "at", "event_id"))
    return items, imports.jobs(items, items.where("job_id % 5 = 0").select("job_id"))


@query(_JOBS + "SELECT job_id, total, pending, running, done, matched, no_match, failed, job_status FROM j")
def job_states_stream(spark, sf_dir):
    return job_states(spark, sf_dir)[1].select(*_COUNTS)


@query(_JOBS + """SELECT job_id, CASE WHEN pending + running > 0 AND job_status IN ('running', 'cancelled') THEN 'queued' ELSE job_status END AS state, pending + running AS pending FROM j""")
def resumed_jobs(spark, sf_dir):
    """Jobs after a restart, with what they have still to do."""
    items, jobs = job_states(spark, sf_dir)
    return pacing.resumed(jobs.select("job_id", c("job_status").alias("state")), items).select("job_id", "state", "pending")


@query(_JOBS + "SELECT job_id, job_status, pending, total, (SELECT count(*) FROM j) AS jobs FROM j ORDER BY created_at DESC, job_id LIMIT 20")
def job_list(spark, sf_dir):
    """The newest twenty jobs."""
    e = job_events(spark, sf_dir)
    items = snapshots.latest_rows(["job_id", "item"], "at", "event_id")(None, e)
    return imports.job_list(imports.jobs(items, items.where("job_id % 5 = 0").select("job_id"))).select("job_id", "job_status", "pending", "total", "jobs")


# ---- a store with a time to live


def stored_events(spark, sf_dir) -> str:
    path = shared.fresh(spark, "store")
    e = table(spark, sf_dir, "events").select(c("user_id").alias("id"), c("ts").cast("timestamp").alias("saved_at"), "event_id", "value", (c("event_type") == "error").alias("deleted"))
    store.save(e, path, "comparison", fingerprint="f1")
    store.save(e.where("event_id % 3 = 0"), path, "comparison", fingerprint="f2")
    store.save(e.drop("deleted"), path, "recent")
    return path


_NOW = datetime.fromisoformat(AS_OF)


def _store_sql(ttl: int, keep: str = "true") -> str:
    return f"""WITH r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events WHERE {keep} AND ts <= TIMESTAMP '{AS_OF}' AND ts > TIMESTAMP '{AS_OF}' - INTERVAL {ttl} HOUR)
SELECT user_id AS id, event_id, value FROM r WHERE rn = 1"""


@query(_store_sql(24, "event_id % 3 = 0") + " AND event_type <> 'error'")
def store_comparisons(spark, sf_dir):
    """Live comparisons of one fingerprint as of a time; errors took keys away."""
    return store.load(spark, stored_events(spark, sf_dir), "comparison", _NOW, fingerprint="f2").select("id", "event_id", "value")


@query(_store_sql(48))
def store_recents(spark, sf_dir):
    return store.load(spark, stored_events(spark, sf_dir), "recent", _NOW).select("id", "event_id", "value")


@query("""SELECT 'comparison' AS kind, count(*) + count(*) FILTER (event_id % 3 = 0) AS rows, count(*) FILTER (event_type = 'error') + count(*) FILTER (event_type = 'error' AND event_id % 3 = 0) AS deletions, count(DISTINCT ts::DATE) AS days FROM events
UNION ALL SELECT 'recent', count(*), 0, count(DISTINCT ts::DATE) FROM events""")
def store_statistics(spark, sf_dir):
    return store.statistics(spark, stored_events(spark, sf_dir))


# ---- order, pages and limits


def _page_sql(order: str, number: int, size: int) -> str:
    return f"""WITH p AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice AS price, l_discount AS discount, row_number() OVER (ORDER BY {order}, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS number FROM lineitem), t AS (SELECT count(*) AS total FROM lineitem)
SELECT l_orderkey, l_linenumber, price, discount, number, total, CAST(ceil(total / {size}.0) AS BIGINT) AS pages FROM p, t WHERE number > {(number - 1) * size} AND number <= {number * size}"""


_TIES = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "price"]


def _line_page(spark, sf_dir, sort: str, number: int, size: int) -> DataFrame:
    from quillon.operators.position import SORTS

    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", c("l_extendedprice").alias("price"), c("l_discount").alias("discount"))
    return ordered.page(rows, [SORTS[sort](), *_TIES], number, size).select("l_orderkey", "l_linenumber", "price", "discount", "number", "total", "pages")


@query(_page_sql("coalesce(l_extendedprice, -1) DESC", 100, 50))
def deep_page_price(spark, sf_dir):
    """A page far behind the first, from the ranges that hold it alone."""
    return _line_page(spark, sf_dir, "price_desc", 100, 50)


@query(_page_sql("coalesce(l_discount, 0) DESC", 73, 60))
def deep_page_discount(spark, sf_dir):
    return _line_page(spark, sf_dir, "discount", 73, 60)


@query("""WITH p AS (SELECT l_partkey AS id, l_suppkey % 5 AS term, l_orderkey AS page, l_linenumber AS pos, l_suppkey, l_quantity, l_extendedprice AS price FROM lineitem WHERE l_quantity > 3 AND l_returnflag <> 'A'),
f AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY term, page, pos, l_suppkey, l_quantity, price) AS rn FROM p), o AS (SELECT *, row_number() OVER (ORDER BY term, page, pos, l_suppkey, l_quantity, price, id) AS n FROM f WHERE rn = 1)
SELECT id, term, page, pos FROM o WHERE n <= 1200""")
def gathered_catalog(spark, sf_dir):
    """Listings of all terms and pages as a catalog: the first of each id, until 1200 are found."""
    title = F.when(c("l_returnflag") != "A", "t").otherwise(" ")
    pages = table(spark, sf_dir, "lineitem").select(
        c("l_partkey").alias("id"), (c("l_suppkey") % 5).alias("term"), c("l_orderkey").alias("page"), c("l_linenumber").alias("pos"), "l_suppkey",
        "l_quantity", title.alias("title"), F.when(c("l_quantity") > 3, c("l_extendedprice")).alias("price")
    )
    return ordered.gathered(pages, ["term", "page", "pos", "l_suppkey", "l_quantity", "price"], 1200).select("id", "term", "page", "pos")


# ---- rows that fail alone

_BAD = """WITH r AS (SELECT p_partkey AS id, p_size AS z, p_retailprice AS p, CASE WHEN p_size % 10 = 3 THEN 'price: not double' WHEN p_size % 10 = 4 THEN 'mrp: not double' WHEN p_size % 10 = 5 THEN 'negative price' WHEN p_size % 10 = 6 THEN 'price above mrp' END AS problem FROM part)
"""


def _raw(spark, sf_dir) -> DataFrame:
    z = c("p_size") % 10
    price = F.when(z == 3, "free").when(z == 5, "-1").when(z == 6, (c("p_retailprice") + 5).cast("string")).when(z != 7, (c("p_retailprice") - 5).cast("string"))
    return table(spark, sf_dir, "part").select(c("p_partkey").alias("id"), price.alias("price"), F.when(z == 4, "1,2,3").otherwise(c("p_retailprice").cast("string")).alias("mrp"))


_TYPES = {"price": "double", "mrp": "double"}


def _rules() -> dict:
    return {"negative price": c("price") >= 0, "price above mrp": c("price") <= c("mrp")}


@query(_BAD + "SELECT id, CASE WHEN z % 10 <> 7 THEN p - 5 END AS price, p AS mrp FROM r WHERE problem IS NULL")
def typed_rows(spark, sf_dir):
    return isolation.kept(isolation.read(_raw(spark, sf_dir), _TYPES, _rules()))


@query(_BAD + """SELECT id AS anchor_id, v.platform, CASE WHEN problem IS NULL THEN 'matched' ELSE 'error' END AS status, problem AS reason FROM r, (VALUES ('p0'), ('p1')) v(platform)""")
def row_errors(spark, sf_dir):
    """Decisions of whole rows, and an error with its reason on each platform for every row that could not be read."""
    raw, platforms = _raw(spark, sf_dir), spark.createDataFrame([("p0",), ("p1",)], "platform string")
    good = isolation.kept(isolation.read(raw, _TYPES, _rules())).select(c("id").alias("anchor_id")).crossJoin(F.broadcast(platforms)).withColumn("status", lit("matched"))
    return isolation.with_errors(good, isolation.quarantine(raw, _TYPES, _rules()), platforms).select("anchor_id", "platform", "status", "reason")


# ---- imports and reports


@query("""WITH c AS (SELECT conv_id AS id, CASE WHEN bool_and(role = 'user') FILTER (turn % 3 <> 0) THEN 'agreed' WHEN NOT bool_and(role = 'user') FILTER (turn % 3 <> 0) THEN 'disagreed' END AS agreement FROM conversations GROUP BY 1)
SELECT id, agreement FROM c WHERE agreement = 'disagreed'""")
def disagreed_items(spark, sf_dir):
    """Items whose match isn't what the sheet named, by the job's filter."""
    pair = table(spark, sf_dir, "conversations").select(lit("j").alias("job_id"), c("conv_id").alias("id"), F.when(c("turn") % 3 != 0, "user").alias("hint"), c("role").alias("found"))
    return imports.filtered(imports.agreement(pair), "disagreed").select("id", "agreement")


#: When the list of reports is looked at; some are fresh then.
LOOKED = "2024-01-31 06:00:00"


def _reports_sql(keep: str) -> str:
    return f"""WITH c AS (SELECT user_id AS id, 'p' || event_id % 3 AS platform, event_type = 'purchase' AS ok, value, ts, CASE WHEN value > 20 THEN 'EXACT MATCH' ELSE 'CLOSE MATCH' END AS tier FROM events),
g AS (SELECT id, count(*) FILTER (ok) AS matched, min(value) FILTER (ok) AS cheapest, max(ts) AS seen FROM c GROUP BY 1), b AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY value DESC, platform DESC) AS rn FROM c WHERE ok),
r AS (SELECT g.id, p_brand AS brand, p_name AS title, coalesce(tier, 'NO MATCH') AS "matchType", value AS confidence, platform AS "bestPlatform", matched, cheapest, (epoch(TIMESTAMP '{LOOKED}') - epoch(seen)) / 3600 AS h, CASE WHEN p_partkey IS NULL THEN 'link' ELSE 'catalog' END AS source
  FROM g LEFT JOIN b ON b.id = g.id AND rn = 1 LEFT JOIN part ON p_partkey = g.id AND p_size % 4 > 0)
SELECT id, brand, title, "matchType", confidence, "bestPlatform", matched, cheapest, round(h, 1) AS age_hours, h >= 0 AND h < 24 AS fresh, greatest(0, round(24 - h, 1)) AS expires_in_hours, source FROM r WHERE {keep}"""


def _report_list(spark, sf_dir, **how) -> DataFrame:
    rows = table(spark, sf_dir, "events").select(
        c("user_id").alias("anchor_id"), F.concat(lit("p"), (c("event_id") % 3).cast("string")).alias("platform"),
        F.when(c("event_type") == "purchase", "matched").otherwise("no_match").alias("status"), c("value").alias("price"), c("value").alias("score"),
        F.when(c("value") > 20, "EXACT MATCH").otherwise("CLOSE MATCH").alias("matchType"), c("ts").alias("matched_at"),
    )
    products = table(spark, sf_dir, "part").where("p_size % 4 > 0").select(c("p_partkey").alias("id"), c("p_brand").alias("brand"), c("p_name").alias("title"), lit("catalog").alias("source"))
    return reports.listed(rows, products, lit(LOOKED).cast("timestamp"), 24, **how)


_REPORT = ["id", "brand", "title", "matchType", "confidence", "bestPlatform", "matched", "cheapest", "age_hours", "fresh", "expires_in_hours", "source"]


@query(_reports_sql("true"))
def report_list(spark, sf_dir):
    return _report_list(spark, sf_dir).select(*_REPORT)


@query(_reports_sql("title LIKE '%red%' AND h >= 0 AND h < 24"))
def report_search(spark, sf_dir):
    """Fresh reports of red products."""
    return _report_list(spark, sf_dir, query="RED", fresh_only=True).select(*_REPORT)


@query("WITH l AS (" + _reports_sql("true").replace("SELECT id, brand", "SELECT id, at_, brand", 1).replace("SELECT g.id, p_brand", "SELECT g.id, seen AS at_, p_brand") + """), n AS (SELECT *, row_number() OVER (ORDER BY at_ DESC, id) AS number FROM l)
SELECT id, title, number, (SELECT count(*) FROM l) AS total FROM n WHERE number BETWEEN 49 AND 72""")
def report_page(spark, sf_dir):
    """The third page of reports, the newest first."""
    return ordered.page(_report_list(spark, sf_dir), [c("matched_at").desc(), "id"], 3, 24).select("id", "title", "number", "total")


# ---- decisions in words

_STATUSES = ["matched", "matched", "blocked", "ambiguous", "color_mismatch", "no_match"]
_COLUMNS = """WITH p AS (SELECT *, p_retailprice::BIGINT::DOUBLE AS own FROM part), c AS (SELECT p_partkey AS anchor_id, own, p_size AS z, v.o, 'P' || v.o AS label,
  (['matched', 'matched', 'blocked', 'ambiguous', 'color_mismatch', 'no_match'])[(p_size + v.o * p_partkey) % 6 + 1] AS status, CASE WHEN p_size % 9 > 0 THEN round(((p_partkey * (v.o + 1)) % 40 + 60) / 100, 2) END AS score,
  CASE WHEN p_size % 8 > 0 THEN own + (p_partkey * (v.o + 2)) % 7 - 3 END AS price, (p_partkey + v.o) % 5 AS images FROM p, (VALUES (0), (1)) v(o)),
h AS (SELECT *, status = 'matched' AND score IS NOT NULL AS hit FROM c), b AS (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, o) AS rn FROM h WHERE hit), q AS (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY price, o) AS rn FROM h WHERE hit AND price IS NOT NULL),
r AS (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, o) AS rn FROM h WHERE hit AND images > z % 4),
s AS (SELECT anchor_id, string_agg(CASE status WHEN 'blocked' THEN label || ' data is not available for this product.' WHEN 'ambiguous' THEN label || ' has several near-identical listings at different prices — the exact SKU cannot be proven from public data. Verify manually.'
  WHEN 'color_mismatch' THEN label || ' has a same-style listing in a different colourway — not treated as a match.' ELSE 'No confident ' || label || ' match was found for this product.' END, '|' ORDER BY o) AS said FROM h WHERE status <> 'matched' GROUP BY 1),
j AS (SELECT p.p_partkey AS anchor_id, p.own, p.p_size AS z, b.label AS best, b.score, b.o AS bo, q.label AS cheap, p.own - q.price AS gap, said, r.label AS rich, r.images AS shown FROM p LEFT JOIN b ON b.anchor_id = p_partkey AND b.rn = 1 LEFT JOIN q ON q.anchor_id = p_partkey AND q.rn = 1
  LEFT JOIN s ON s.anchor_id = p_partkey LEFT JOIN r ON r.anchor_id = p_partkey AND r.rn = 1)
"""


@query(_COLUMNS + """SELECT anchor_id, best AS "bestMatch", CASE WHEN best IS NULL THEN 'NO MATCH' WHEN score >= 0.85 THEN 'EXACT MATCH' ELSE 'CLOSE MATCH' END AS "matchType", score AS confidence,
  CASE WHEN gap > 0 THEN 'undercut' WHEN gap < 0 THEN 'winning' WHEN gap = 0 THEN 'parity' ELSE 'unknown' END AS posture,
  CASE WHEN gap > 0 THEN cheap || ' is ₹' || gap::BIGINT || ' cheaper — review pricing or promotion on this SKU.' WHEN gap < 0 THEN 'Own holds the best price by ₹' || (-gap)::BIGINT || ' — safe to promote as a price win.'
    WHEN gap = 0 THEN 'Priced at parity — differentiate on delivery, offers or content quality.' ELSE 'Insufficient competitor data for a pricing recommendation.' END AS action,
  concat_ws('|', best || ' is the closest match (' || round(score * 100)::BIGINT || '% overall similarity).', said, CASE WHEN gap > 0 THEN cheap || ' undercuts Own by ₹' || gap::BIGINT || ' on the same item.' WHEN gap < 0 THEN 'Own is ₹' || (-gap)::BIGINT || ' cheaper than the closest competitor.'
    WHEN gap = 0 THEN 'Price parity with the closest competitor.' END, CASE WHEN z % 7 = 0 THEN 'Size charts agree.' END, rich || ' shows ' || shown || ' images vs Own''s ' || (z % 4) || ' — richer content.') AS insights,
  CASE WHEN best IS NULL THEN 'No competitor listing cleared the matching gates for this product.' WHEN z % 3 = 0 THEN 'Brand matches, Exact MRP match' || CASE WHEN z % 2 = 0 THEN ' Differences: d1; d2.' ELSE '' END ELSE 'Matched on core attributes' || CASE WHEN z % 2 = 0 THEN ' Differences: d1; d2.' ELSE '' END END AS "matchReason" FROM j""")
def report_decisions(spark, sf_dir):
    """What each report says at its head and in its summary."""
    z, i, o = c("p_size"), c("p_partkey"), c("ord")
    rows = table(spark, sf_dir, "part").withColumn("own", F.round("p_retailprice"))
    each = rows.select("*", F.explode(F.array(lit(0), lit(1))).alias("ord"))
    status = F.element_at(F.array(*map(lit, _STATUSES)), ((z + o * i) % 6 + 1).cast("int"))
    score = F.when(z % 9 > 0, F.round(((i * (o + 1)) % 40 + 60) / 100, 2))
    texts = lambda ok, *x: F.when(ok, F.array(*map(lit, x))).otherwise(F.array().cast("array<string>"))
    columns = each.select(
        i.alias("anchor_id"), "ord", F.concat(lit("P"), o.cast("string")).alias("label"), status.alias("status"), score.alias("score"),
        F.when(z % 8 > 0, c("own") + (i * (o + 2)) % 7 - 3).alias("price"), ((i + o) % 5).alias("images"),
        F.when(score >= 0.85, "EXACT MATCH").otherwise("CLOSE MATCH").alias("matchType"), texts(z % 3 == 0, "Brand matches", "Exact MRP match").alias("why"),
        texts(z % 2 == 0, "d1", "d2", "d3").alias("differences"),
    )
    anchors = rows.select(i.alias("anchor_id"), c("own").alias("price"), (z % 4).alias("images"), F.when(z % 7 == 0, "Size charts agree.").alias("size_insight"))
    return reports.decision(anchors, columns, "Own").withColumn("insights", F.array_join("insights", "|"))


@query("""WITH v AS (SELECT p_partkey AS id, p_size % 4 AS major, p_size % 3 AS minor, p_size AS compared, p_size % 5 > 0 AS ok, CASE WHEN p_size % 2 = 0 THEN 'M: chest' END AS flag FROM part), n AS (SELECT *, CASE WHEN major > 0 THEN major ELSE minor END AS n FROM v)
SELECT id, CASE WHEN major > 0 THEN 'major' WHEN minor > 0 THEN 'minor' WHEN ok AND compared > 0 THEN 'none' END AS severity, CASE WHEN major > 0 THEN 'Size chart differs' WHEN minor > 0 THEN 'Size chart varies slightly' WHEN ok AND compared > 0 THEN 'Size charts match' END AS label,
  CASE WHEN n > 0 THEN n || CASE WHEN n > 1 THEN ' measurements differ' ELSE ' measurement differs' END || coalesce(' — ' || flag, '.') WHEN ok AND compared > 0 THEN compared || ' measurements agree across platforms.' END AS detail FROM n""")
def size_flags_of_reports(spark, sf_dir):
    z = c("p_size")
    verdict = F.when(z % 5 > 0, "consistent").otherwise("not_comparable")
    flag = reports.size_flag(z % 4, z % 3, z, verdict, F.when(z % 2 == 0, "M: chest"))
    return table(spark, sf_dir, "part").select(c("p_partkey").alias("id"), flag.alias("f")).select("id", "f.*")


@query("""WITH p AS (SELECT l_partkey AS id, l_suppkey % 2 AS k, max(l_extendedprice) AS price FROM lineitem GROUP BY 1, 2) SELECT id AS anchor_id, max(price) AS dearest, CASE WHEN count(*) > 1 THEN max(price) - min(price) ELSE 0 END AS savings FROM p GROUP BY 1""")
def report_savings(spark, sf_dir):
    prices = table(spark, sf_dir, "lineitem").groupBy(c("l_partkey").alias("anchor_id"), (c("l_suppkey") % 2).alias("k")).agg(F.max("l_extendedprice").alias("price"))
    return reports.savings(prices)


@query("""WITH m AS (SELECT p_partkey, p_size % 5 > 0 AS matched, p_size % 7 - 3 AS gap FROM part) SELECT count(*) AS total, count(*) FILTER (matched AND gap < 0) AS cheapest, count(*) FILTER (matched AND gap = 0) AS parity, count(*) FILTER (matched AND gap > 0) AS undercut, count(*) FILTER (NOT matched) AS unmatched FROM m""")
def split_meter(spark, sf_dir):
    return reports.split(table(spark, sf_dir, "part").select((c("p_size") % 5 > 0).alias("matched"), (c("p_size") % 7 - 3).alias("gap")))


@query("""SELECT p_partkey AS id, CASE p_size % 3 WHEN 0 THEN 'Own has no product with id ' || p_partkey || '.' WHEN 1 THEN 'Could not read ' || p_partkey || ' from Own (blocked).' END AS message,
  CASE WHEN p_size % 4 = 0 THEN 'na' WHEN p_size % 6 = 0 THEN 'na' ELSE (['best', 'moderate', 'low', 'na', 'moderate'])[p_partkey % 5 + 1] END AS verdict FROM part""")
def report_texts(spark, sf_dir):
    """Messages for products that could not be found, and verdicts of attribute cells."""
    from quillon.functions import decision as dec

    z, i = c("p_size"), c("p_partkey")
    reason = F.when(z % 3 == 0, "not_found").when(z % 3 == 1, "blocked")
    compared = F.element_at(F.array(*[lit(x).cast("string") for x in ("match", "partial", "differ", "na", None)]), (i % 5 + 1).cast("int"))
    verdict = dec.attribute_verdict(F.when(z % 6 > 0, c("p_type")), compared, z % 4 == 0)
    return table(spark, sf_dir, "part").select(i.alias("id"), reports.anchor_error(i.cast("string"), reason, "Own").alias("message"), verdict.alias("verdict"))


# ---- whole export rows: each part as an anchor, each line item as a decision on one of two platforms

STATUSES = {"1": "matched", "2": "no_match", "3": "matched", "4": "no_results", "5": "blocked", "6": "ambiguous", "7": "color_mismatch"}
EXPORTS = f"""WITH d AS (SELECT l_partkey AS id, l_suppkey % 2 AS k, {map_sql(STATUSES, 'CAST(l_linenumber AS VARCHAR)')} AS status, round(1 - l_tax - l_discount, 4) AS score,
  'Line ' || l_linenumber AS title, l_extendedprice AS mrp, round(l_extendedprice / l_quantity) AS price, l_discount AS discount, '/' || l_orderkey || '/' || l_linenumber AS url FROM lineitem),
r AS (SELECT *, status = 'matched' AS ok, row_number() OVER (PARTITION BY id, k ORDER BY status = 'matched' DESC, score DESC, status DESC, title DESC, mrp DESC, price DESC, discount DESC, url DESC) AS rn FROM d),
one AS (SELECT id, k, status, {map_sql(exports.STATUS_LABELS, 'status')} AS label, CASE WHEN ok THEN CASE WHEN score >= 0.9 THEN 'EXACT MATCH' ELSE 'CLOSE MATCH' END END AS kind, CASE WHEN ok THEN score END AS confidence,
  CASE WHEN ok THEN title END AS title, CASE WHEN ok THEN mrp END AS mrp, CASE WHEN ok THEN price END AS price, CASE WHEN ok THEN discount END AS discount, CASE WHEN ok THEN url END AS url FROM r WHERE rn = 1),
j AS (SELECT p_partkey AS id, p_brand AS brand, p_name AS title, round(p_retailprice) AS price, CASE WHEN p_size % 5 > 0 THEN CAST(p_size AS DOUBLE) END AS age_hours,
  """ + ", ".join(f"coalesce({p}.status, 'error') AS {p}_status, coalesce({p}.label, 'Error') AS {p}_status_label, {p}.kind AS {p}_match_type, "
    + ", ".join(f"{p}.{x} AS {p}_{x}" for x in ("confidence", *exports.LISTED)) for p in ("p0", "p1")) + """
  FROM part LEFT JOIN one p0 ON p0.id = p_partkey AND p0.k = 0 LEFT JOIN one p1 ON p1.id = p_partkey AND p1.k = 1),
e AS (SELECT *, coalesce(age_hours <= 24, false) AS fresh, CAST((p0_status = 'matched') AS BIGINT) + CAST((p1_status = 'matched') AS BIGINT) AS matched_count,
  CASE WHEN p0_confidence >= coalesce(p1_confidence, -1) THEN 'p0' WHEN p1_confidence IS NOT NULL THEN 'p1' END AS best_platform,
  least(p0_price, p1_price) AS best_rival, least(price, p0_price, p1_price) AS lo, greatest(price, p0_price, p1_price) AS hi FROM j)
"""  # fmt: skip


def decided(spark, sf_dir) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select(
        c("l_partkey").alias("anchor_id"), F.concat(lit("p"), (c("l_suppkey") % 2).cast("string")).alias("platform"),
        F.try_element_at(t.literal_map(STATUSES), c("l_linenumber").cast("string")).alias("status"), F.round(1 - c("l_tax") - c("l_discount"), 4).alias("score"),
        F.concat(lit("Line "), c("l_linenumber").cast("string")).alias("title"), c("l_extendedprice").alias("mrp"), F.round(c("l_extendedprice") / c("l_quantity")).alias("price"),
        c("l_discount").alias("discount"), F.concat(lit("/"), c("l_orderkey").cast("string"), lit("/"), c("l_linenumber").cast("string")).alias("url"),
    )
    return rows.withColumn("matchType", F.when(c("score") >= 0.9, "EXACT MATCH").otherwise("CLOSE MATCH"))


def whole_rows(spark, sf_dir) -> DataFrame:
    matched_at = F.expr("CASE WHEN p_size % 5 > 0 THEN timestamp'2002-03-04 00:00:00' - make_interval(0, 0, 0, 0, p_size) END")
    anchors = table(spark, sf_dir, "part").select(c("p_partkey").alias("id"), c("p_brand").alias("brand"), c("p_name").alias("title"), F.round("p_retailprice").alias("price"), matched_at.alias("matched_at"))
    return exports.whole_rows(anchors, decided(spark, sf_dir), ["p0", "p1"], F.expr("timestamp'2002-03-04 00:00:00'"), 24.0)


@query(EXPORTS + """SELECT e.* EXCLUDE (lo, hi), CASE best_platform WHEN 'p0' THEN p0_confidence ELSE p1_confidence END AS confidence, coalesce(CASE best_platform WHEN 'p0' THEN p0_match_type ELSE p1_match_type END, 'NO MATCH') AS match_type,
  CASE WHEN p0_price = best_rival THEN 'p0_price' WHEN p1_price = best_rival THEN 'p1_price' END AS cheapest_rival, price - best_rival AS gap, round((price - best_rival) / price * 100, 1) AS gap_pct,
  CASE WHEN best_rival IS NULL THEN 'No competitor data' WHEN price > best_rival THEN 'Undercut' WHEN price < best_rival THEN 'Cheapest' ELSE 'Parity' END AS position,
  CASE WHEN lo <> hi THEN CASE lo WHEN price THEN 'price' WHEN p0_price THEN 'p0_price' ELSE 'p1_price' END END AS cheapest, CASE WHEN lo <> hi THEN CASE hi WHEN price THEN 'price' WHEN p0_price THEN 'p0_price' ELSE 'p1_price' END END AS dearest,
  hi - lo AS spread, round(price / lo * 100, 1) AS price_index FROM e""")
def export_rows(spark, sf_dir):
    """The whole row of every part."""
    return whole_rows(spark, sf_dir).drop("matched_at")


@query(EXPORTS + "SELECT count(*) AS products, count(*) FILTER (matched_count > 0) AS matched, round(count(*) FILTER (matched_count > 0) * 100.0 / count(*), 1) AS match_rate, count(*) FILTER (fresh) AS fresh FROM e")
def export_coverage(spark, sf_dir):
    return exports.coverage(whole_rows(spark, sf_dir))


@query(EXPORTS + """SELECT p_partkey AS id, p_brand AS brand, m.id IS NOT NULL AS compared, CASE WHEN m.id IS NOT NULL THEN e.matched_count END AS matched_count, e.p0_price AS p0, e.p1_price AS p1,
  CASE WHEN e.p0_price = e.best_rival THEN 'p0' WHEN e.p1_price = e.best_rival THEN 'p1' END AS cheapest, m.at AS matched_at
FROM part JOIN e ON e.id = p_partkey LEFT JOIN (SELECT l_partkey AS id, max(l_shipdate) AS at FROM lineitem GROUP BY 1) m ON m.id = p_partkey""")
def catalog_comparisons(spark, sf_dir):
    """Every part with the summary of its comparison."""
    at = table(spark, sf_dir, "lineitem").groupBy(c("l_partkey").alias("id")).agg(F.max("l_shipdate").alias("matched_at"))
    found = exports.listed(decided(spark, sf_dir), ["p0", "p1"]).join(at, "id")
    catalog = table(spark, sf_dir, "part").select(c("p_partkey").alias("id"), c("p_brand").alias("brand"))
    s = c("comparison")
    return position.with_summaries(catalog, found, ["p0", "p1"]).select("id", "brand", s.isNotNull().alias("compared"), s["matched_count"].alias("matched_count"),
        s["prices"]["p0"].alias("p0"), s["prices"]["p1"].alias("p1"), s["cheapest"].alias("cheapest"), s["matched_at"].alias("matched_at"))


@query(POSITIONS + """, f AS (SELECT *, coalesce(p_brand IN ('Brand#11', 'Brand#23', 'Brand#17'), false) AS b, coalesce(position = 'Undercut', false) AS p, coalesce(own_price BETWEEN 950 AND 1300, false) AS g FROM positions)
SELECT min(own_price) FILTER (b AND p) AS lo, max(own_price) FILTER (b AND p) AS hi, count(*) FILTER (b AND p AND g) AS n, sum(gap) FILTER (b AND p AND g) AS total_gap FROM f""")
def price_reach(spark, sf_dir):
    """The price band that the other filters leave, with a preview of what all of them leave."""
    chosen = {"brand": c("p_brand").isin("Brand#11", "Brand#23", "Brand#17"), "position": c("position") == "Undercut", "price": c(OWN).between(950, 1300)}
    return position.reachable(positions(spark, sf_dir), chosen, OWN)
