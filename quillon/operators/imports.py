"""Bulk imports: rows of spreadsheet cells become deduplicated items with hints, then jobs with states."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.functions import text as t

#: Rival platforms by host.
HOSTS = {"myntra": r"(^|\.)myntra\.com", "ajio": r"(^|\.)ajio\.com", "nykaa": r"(^|\.)nykaafashion\.com"}


def rows(cells: DataFrame, hosts: dict[str, str] = HOSTS) -> DataFrame:
    """(sheet, row, id, hints) of cells (sheet, row, col, text): the first valid id and the first link for each rival.

    An id counts in a link or where it stands alone, not inside a note. With a column ``ord``, as the workbook source has it, a cell may hold
    several texts."""
    text = F.trim("text")
    kind = t.host_kind(F.when(text.rlike("(?i)^https?://"), text), hosts)
    trusted = text.rlike(r"(?i)^https?:") | text.rlike(r"(?i)^[a-z]{2}\d{6,}$")
    d = cells.withColumn("kind", kind).withColumn("pid", F.when(kind.isNull() & trusted, t.product_id(text)))
    place = F.struct("col", "ord") if "ord" in cells.columns else F.col("col")
    first = lambda value, ok: F.min_by(value, F.when(ok, place))
    hints = [first(F.when(F.col("kind") == h, text), F.col("kind") == h).alias(h) for h in hosts]
    g = d.groupBy("sheet", "row").agg(first("pid", F.col("pid").isNotNull()).alias("id"), *hints)
    return g.where("id is not null")


def items(found: DataFrame, hosts: dict[str, str] = HOSTS) -> DataFrame:
    """One item for each id: its first row, all its rows, and each hint from the first row that has one."""
    order = F.struct("sheet", "row")
    g = found.groupBy("id").agg(F.min(order).alias("o"), F.sort_array(F.collect_list("row")).alias("source_rows"), *[F.min_by(h, F.when(F.col(h).isNotNull(), order)).alias(h) for h in hosts])
    return g.select("id", F.col("o.sheet").alias("sheet"), F.col("o.row").alias("row"), "source_rows", *hosts)


def agreement(item_hints: DataFrame) -> DataFrame:
    """(job_id, id, agreement) of (hint, found) pairs: any disagreement wins; null without a pair to compare."""
    same = F.when(F.col("hint").isNotNull() & F.col("found").isNotNull(), F.col("hint") == F.col("found"))
    g = item_hints.groupBy("job_id", "id").agg(F.bool_and(same).alias("ok"))
    return g.select("job_id", "id", F.when(F.col("ok"), "agreed").when(~F.col("ok"), "disagreed").alias("agreement"))


def progress(job_items: DataFrame) -> DataFrame:
    """Counters, percentage and time to go of each job (job_id, state, status, seconds)."""
    done = F.count_if(F.col("state") == "done")
    g = job_items.groupBy("job_id").agg(F.count("*").alias("total"), done.alias("done"), F.count_if(F.col("status") == "matched").alias("matched"),
        F.count_if(F.col("status") == "error").alias("errors"), F.avg(F.when(F.col("state") == "done", F.col("seconds"))).alias("mean"))
    return g.select("job_id", "total", "done", "matched", "errors", F.round(F.try_divide(F.col("done") * 100.0, F.col("total")), 1).alias("percent"),
        F.round(F.col("mean") * (F.col("total") - F.col("done")), 3).alias("eta_seconds"))


def outcome(statuses: Column, problem: Column) -> Column:
    """What a job counts an item as, of its decisions' statuses: matched if any platform is, failed if the item itself could not be read or found."""
    return F.when(problem.isNotNull(), "error").when(F.array_contains(statuses, "matched"), "matched").otherwise("no_match")


def jobs(items: DataFrame, cancelled: DataFrame | None = None) -> DataFrame:
    """Each job of (job_id, state, status, at): its items by state and outcome, and its own status.

    ``cancelled``: (job_id). A job is running while an item is, queued while items are pending, and done behind its last one."""
    n = lambda c, name: F.count_if(F.coalesce(c, F.lit(False))).alias(name)
    state, status = F.col("state"), F.col("status")
    g = items.groupBy("job_id").agg(
        F.count("*").alias("total"), n(state == "pending", "pending"), n(state == "running", "running"), n(state == "done", "done"),
        n(status == "matched", "matched"), n(status == "no_match", "no_match"),
        n(status == "error", "failed"), F.min("at").alias("created_at"), F.max("at").alias("changed_at"),
    )
    gone = F.lit(False)
    if cancelled is not None:
        g = g.join(cancelled.select("job_id").distinct().withColumn("_gone", F.lit(True)), "job_id", "left")
        gone = F.coalesce("_gone", F.lit(False))
    left = F.col("pending") + F.col("running") > 0
    named = F.when(gone & left, "cancelled").when(F.col("running") > 0, "running").when(F.col("pending") > 0, "queued").otherwise("done")
    return g.withColumn("job_status", named).drop("_gone")


def restarted(items: DataFrame) -> DataFrame:
    """Items after a restart: what was running is pending again; what is done stays done."""
    return items.withColumn("state", F.when(F.col("state") == "running", "pending").otherwise(F.col("state")))


def job_list(summaries: DataFrame, limit: int = 20) -> DataFrame:
    """The newest jobs without their items, with ``pending`` and the number of all jobs. ``limit`` is the list's length."""
    all_ = summaries.agg(F.count("*").alias("jobs"))
    return summaries.orderBy(F.col("created_at").desc(), "job_id").limit(limit).crossJoin(F.broadcast(all_))


def parsed_csv(lines: DataFrame) -> DataFrame:
    """(row, cells) of (row, line): quoted commas and doubled quotes; blank lines are none."""
    cell = r'(?:^|,)(?:"((?:[^"]|"")*)"|([^,]*))'
    take = lambda i: F.regexp_extract_all("line", F.lit(cell), F.lit(i))
    both = F.zip_with(take(1), take(2), lambda q, p: F.trim(F.when(q != "", F.replace(q, F.lit('""'), F.lit('"'))).otherwise(p)))
    return lines.where(F.trim("line") != "").select("row", both.alias("cells"))


def problem(filename: str, size: int, found: int, most: int) -> str | None:
    """Why an upload is refused, null if it isn't; from its name, its size and how many products it names."""
    if not size:
        return "empty_upload"
    if filename.rsplit(".", 1)[-1].lower() not in ("xlsx", "xlsm", "csv"):
        return "unsupported_format"
    return "no_links_found" if not found else "too_many_rows" if found > most else None


def summary(found: DataFrame, distinct: DataFrame, hosts: dict[str, str] = HOSTS) -> DataFrame:
    """What a dry run tells: rows with a product, products, repeated rows, and hints for each rival."""
    rows_ = found.agg(F.count("*").alias("rows"))
    items_ = distinct.agg(F.count("*").alias("products"), *[F.count(h).alias(f"hints_{h}") for h in hosts])
    return rows_.join(F.broadcast(items_)).withColumn("repeated", F.col("rows") - F.col("products"))


def template(spark, own: str = "https://shop.example/x/p-mp000000000000001", rival: str = "https://www.myntra.com/x/1") -> DataFrame:
    """An example sheet: a link with a rival's link, a link alone, and a bare id."""
    rows_ = [(1, own, rival, None, "with a rival's link, whose agreement is reported"), (2, own[:-1] + "2", None, None, "a link alone"), (3, "MP000000000000003", None, None, "a bare id")]
    return spark.createDataFrame(rows_, "n int, product string, myntra string, ajio string, note string")


#: Filters of a job's rows, by the column and value that they ask for.
FILTERS = {"failed": ("status", "error"), "unmatched": ("status", "no_match"), "matched": ("status", "matched"), "disagreed": ("agreement", "disagreed")}


def filtered(items: DataFrame, name: str = "all") -> DataFrame:
    """Items of a job by their outcome; an unknown filter keeps all."""
    if name not in FILTERS:
        return items
    column, value = FILTERS[name]
    return items.where(F.col(column) == value)


def finished(items: DataFrame, comparisons: DataFrame) -> DataFrame:
    """A job's matched and unmatched items with their saved comparison, of which there is one an id; those without one are left out."""
    return items.where(F.col("status").isin("matched", "no_match")).join(comparisons, "id")
