"""Rows that fail alone: what can't be read or computed goes to quarantine with its reason, and the rest goes on.

A cast or a condition that fails must not fail the job, so values are read by ``try_`` functions and a row's first problem is a column. A row is
whole or it is quarantined, so nothing computed from half a row reaches a decision.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def read(rows: DataFrame, types: dict[str, str], rules: dict[str, Column] | None = None) -> DataFrame:
    """Rows with the columns of ``types`` read from text, and ``problem``: null, or what is wrong first, a text that isn't of its column's type
    or a rule (name, condition that must hold) that doesn't hold. A null text is a null value, not a problem; a rule of unknown outcome holds."""
    typed = {n: F.col(n).try_cast(k) for n, k in types.items()}
    unread = [F.when(F.col(n).isNotNull() & v.isNull(), F.lit(f"{n}: not {types[n]}")) for n, v in typed.items()]
    first = rows.withColumn("problem", F.coalesce(*unread, F.lit(None).cast("string"))).withColumns(typed)
    broken = [F.when(~ok, F.lit(name)) for name, ok in (rules or {}).items()]
    return first.withColumn("problem", F.coalesce("problem", *broken))


def kept(read_rows: DataFrame) -> DataFrame:
    return read_rows.where("problem is null").drop("problem")


def quarantine(raw: DataFrame, types: dict[str, str], rules: dict[str, Column] | None = None) -> DataFrame:
    """The rows with a problem, as they came, with it."""
    both = raw.withColumn("_raw", F.struct("*"))
    return read(both, types, rules).where("problem is not null").select("_raw.*", "problem")


def with_errors(decided: DataFrame, failed: DataFrame, platforms: DataFrame) -> DataFrame:
    """Decisions with an ``error`` on every platform for each failed anchor (id, problem); ``reason`` says why."""
    rows = failed.select(F.col("id").alias("anchor_id"), F.col("problem").alias("reason")).crossJoin(F.broadcast(platforms.select("platform")))  # a handful of platforms
    return decided.withColumn("reason", F.lit(None).cast("string")).unionByName(rows.withColumn("status", F.lit("error")), allowMissingColumns=True)
