"""What the text operators share: reading tables, words, shared scratch tables."""

from __future__ import annotations

import os
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space between words: space and tab to carriage return, nothing else.
SPACE = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the input folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id`` and ``text`` only, null texts as empty ones; other columns can't clash with the operators' own."""
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))


def words(text: Column) -> Column:
    """The words of a text, in order."""
    return F.filter(F.split(text, SPACE), lambda w: w != "")


def computed_once(df: DataFrame, *cols: Column | str) -> DataFrame:
    """``df.select(*cols)`` behind a generator of one row a row, through which no filter is pushed: a
    filter on a costly column would otherwise be computed from copies of its expression, even inside lambdas."""
    return df.select(F.inline(F.array(F.struct(*cols))))


def residue(id_col: str, mod: int) -> Column:
    """crc32 of the id as text, modulo ``mod`` (null id: of the empty text)."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % mod


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder of ``spark.checkpoint.dir``. Where that is unset, as in tests: a temporary one in local mode, an error on a cluster."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not shared and spark.sparkContext.master.split("[")[0] != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return (shared or os.path.join(tempfile.gettempdir(), "quillon-checkpoints")).rstrip("/")


#: Scratch tables that this process wrote and has not deleted.
_tables: list[str] = []


def stored(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """``df`` as a Parquet table in the shared folder, and its path: lineage ends here, and lost executors don't lose it."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/quillon-{name}-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    _tables.append(path)
    return spark.read.schema(df.schema).parquet(path), path


def written(df: DataFrame, name: str) -> DataFrame:
    """The table of ``stored``."""
    return stored(df, name)[0]


def discard(spark: SparkSession, paths: list[str]) -> None:
    """Delete scratch tables that nothing reads any more."""
    for path in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
        if path in _tables:
            _tables.remove(path)


@contextmanager
def passing(spark: SparkSession):
    """Deletes at its end the scratch tables written inside; what was made of them must have been written or collected by then."""
    before = len(_tables)
    try:
        yield
    finally:
        discard(spark, _tables[before:])
