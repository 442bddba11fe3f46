"""A store of records by key with a time to live: appended by day, read as of a time.

Every write is a row with its time; the newest row of a key counts, and one that is marked ``deleted`` takes the key away. A read as of a time
looks only at the days that its time to live reaches, which are partitions, so its cost doesn't grow with the store's age. Comparisons
lie under a fingerprint of the engine, a partition too, so that another engine's are never read; anchors, recents and jobs don't.

Defined cases: a row without a key or a time is not written; of rows of one key and time the last one by all columns counts; rows after the
time of the read are not seen.
"""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Hours to live by kind; null: for good.
TTL_HOURS = {"comparison": 24.0, "anchor": 24.0 * 30, "recent": 48.0, "job": 24.0 * 7}


def save(rows: DataFrame, path: str, kind: str, key: str = "id", at: str = "saved_at", fingerprint: str = "") -> None:
    """Append rows of a kind. ``deleted``, if there is such a column, takes keys away."""
    gone = F.coalesce("deleted", F.lit(False)) if "deleted" in rows.columns else F.lit(False)
    fine = rows.where(F.col(key).isNotNull() & F.col(at).isNotNull())
    out = fine.withColumns({"deleted": gone, "kind": F.lit(kind), "fingerprint": F.lit(fingerprint if kind == "comparison" else "any"), "day": F.to_date(F.col(at))})
    out.write.mode("append").partitionBy("kind", "fingerprint", "day").parquet(path)


def load(spark: SparkSession, path: str, kind: str, as_of: datetime, key: str = "id", at: str = "saved_at", fingerprint: str = "", ttl_hours: float | None = None) -> DataFrame:
    """The live records of a kind at a time, one a key."""
    hours = TTL_HOURS.get(kind) if ttl_hours is None else ttl_hours
    rows = spark.read.parquet(path).where((F.col("kind") == kind) & (F.col("fingerprint") == (fingerprint if kind == "comparison" else "any")) & (F.col("day") <= F.lit(as_of.date())) & (F.col(at) <= F.lit(as_of)))
    if hours is not None:
        oldest = as_of - timedelta(hours=hours)
        rows = rows.where((F.col("day") >= F.lit(oldest.date())) & (F.col(at) > F.lit(oldest)))
    rest = [c for c in rows.columns if c not in (key, "kind", "fingerprint", "day")]
    order = F.struct(at, *[c for c in rest if c != at])
    newest = rows.groupBy(key).agg(F.max_by(F.struct(*rest), order).alias("r")).select(key, "r.*")
    return newest.where(~F.col("deleted")).drop("deleted")


def statistics(spark: SparkSession, path: str) -> DataFrame:
    """Rows, keys and days of each kind."""
    return spark.read.parquet(path).groupBy("kind").agg(F.count("*").alias("rows"), F.count_if("deleted").alias("deletions"), F.countDistinct("day").alias("days"))
