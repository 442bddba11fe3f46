"""State over time: freshness, recents and upserts, for batches and streams alike."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def age_hours(at: Column, as_of: Column) -> Column:
    return (as_of.cast("timestamp").cast("double") - at.cast("timestamp").cast("double")) / 3600


def fresh(at: Column, as_of: Column, ttl_hours: float) -> Column:
    return F.coalesce((age_hours(at, as_of) >= 0) & (age_hours(at, as_of) < ttl_hours), F.lit(False))


def replayable(at: Column, statuses: Column, as_of: Column, ttl_hours: float, transient_minutes: float = 10) -> Column:
    """Fresh; with a transient failure among its statuses for some minutes only."""
    failed = F.exists(statuses, lambda s: s.isin("blocked", "error"))
    return fresh(at, as_of, ttl_hours) & (~failed | (age_hours(at, as_of) * 60 < transient_minutes))


def recents(events: DataFrame, as_of: Column, ttl_hours: float = 48, limit: int = 12, key: str = "id", at: str = "searchedAt") -> DataFrame:
    """Keys by their last time, newest first, without those that have expired."""
    last = events.groupBy(key).agg(F.max(at).alias(at))
    return last.where(fresh(F.col(at), as_of, ttl_hours)).orderBy(F.col(at).desc(), key).limit(limit)


def latest(rows: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The latest row of each key; deletions are rows marked so, dropped afterwards."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def recent_stream(events: DataFrame, delay: str = "10 minutes", key: str = "id", at: str = "searchedAt") -> DataFrame:
    """Streaming recency: each key's last time so far. Emit with output mode 'update' or 'complete'."""
    return events.withWatermark(at, delay).groupBy(key).agg(F.max(at).alias(at))


def unique_stream(events: DataFrame, key: str = "id", at: str = "searchedAt", delay: str = "10 minutes") -> DataFrame:
    """Identical requests within the watermark collapse into the first."""
    return events.withWatermark(at, delay).dropDuplicatesWithinWatermark([key])
