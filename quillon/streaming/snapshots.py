"""Streams folded into versioned snapshots behind one atomic pointer.

Each batch is folded into the current snapshot, the result is written as a version of its own, and then the pointer is replaced by one rename. A
reader sees the old version or the new one, never a part. The pointer holds the number of its batch: a batch that comes again after a
failure changes nothing, so folds count each row once. The version before the current one stays for those who still read it.

The trigger is the debounce: with a processing time of some seconds, changes of that time are one version.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillon.sources.shared import filesystem

POINTER = "_current"


class Snapshots:
    """Versions of a table in a folder."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def current(self) -> dict | None:
        """``version``, ``batch`` and ``before`` (the version before) of the pointer; null where there is none."""
        files, at = filesystem(self.spark, f"{self.path}/{POINTER}")
        if not files.exists(at):
            return None
        stream = files.open(at)
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def read(self) -> DataFrame | None:
        now = self.current()
        return self.spark.read.parquet(f"{self.path}/{now['version']}") if now else None

    def put(self, rows: DataFrame, batch: int) -> None:
        """Write a version, then point to it."""
        now = self.current()
        version = f"v{batch}-{uuid.uuid4().hex[:8]}"  # a failed attempt leaves another name behind
        rows.write.parquet(f"{self.path}/{version}")
        self._point({"version": version, "batch": batch, "before": now and now["version"]})
        self._sweep({version, now and now["version"]})

    def _point(self, to: dict) -> None:
        jvm = self.spark._jvm
        files, new = filesystem(self.spark, f"{self.path}/{POINTER}-{uuid.uuid4().hex[:8]}")
        out = files.create(new, True)
        try:
            out.write(bytearray(json.dumps(to).encode()))
        finally:
            out.close()
        rename = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
        how = self.spark.sparkContext._gateway.new_array(rename, 1)
        how[0] = rename.OVERWRITE
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(files.getUri(), self.spark._jsc.hadoopConfiguration())
        context.rename(new, jvm.org.apache.hadoop.fs.Path(f"{self.path}/{POINTER}"), how)

    def _sweep(self, keep: set[str | None]) -> None:
        """Delete all other versions, those of failed attempts too."""
        files, at = filesystem(self.spark, self.path)
        for found in files.listStatus(at):
            if found.isDirectory() and found.getPath().getName() not in keep:
                files.delete(found.getPath(), True)


Fold = Callable[[DataFrame | None, DataFrame], DataFrame]


def folded(snapshots: Snapshots, fold: Fold) -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch``: folds a batch into the current snapshot, unless it is there already."""

    def each(batch: DataFrame, number: int) -> None:
        now = snapshots.current()
        if now is None or number > now["batch"]:
            snapshots.put(fold(snapshots.read(), batch), number)

    return each


def run(stream: DataFrame, snapshots: Snapshots, fold: Fold, checkpoint: str) -> None:
    """Fold all that a stream has to give now; a later run goes on from the checkpoint."""
    stream.writeStream.foreachBatch(folded(snapshots, fold)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def union(before: DataFrame | None, batch: DataFrame) -> DataFrame:
    return batch if before is None else before.unionByName(batch)


def latest_rows(keys: list[str], *order: str) -> Fold:
    """The newest row of each key, by partial aggregation."""

    def fold(before: DataFrame | None, batch: DataFrame) -> DataFrame:
        rows = union(before, batch)
        rest = [c for c in rows.columns if c not in keys]
        return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("r")).select(*keys, "r.*")

    return fold


def newest_keys(owner: str, key: str, at: str, limit: int) -> Fold:
    """Of each owner the ``limit`` keys that were seen last, once each: a key that comes again moves to the front."""

    def fold(before: DataFrame | None, batch: DataFrame) -> DataFrame:
        last = union(before, batch.select(owner, key, at)).groupBy(owner, key).agg(F.max(at).alias(at))
        w = Window.partitionBy(owner).orderBy(F.col(at).desc(), key)
        return last.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= limit).drop("_n")

    return fold


def pinned(snapshot: DataFrame, at: str, as_of: Column, ttl_hours: float) -> DataFrame:
    """What of a snapshot has not expired, with ``age_hours`` and ``expires_in_hours``."""
    seconds = lambda x: x.cast("timestamp").cast("double")
    age = (seconds(as_of) - seconds(F.col(at))) / 3600
    return snapshot.withColumn("age_hours", age).where(F.col("age_hours") <= ttl_hours).withColumn("expires_in_hours", F.greatest(F.lit(0.0), F.lit(ttl_hours) - F.col("age_hours")))
