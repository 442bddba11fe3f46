"""Helpers on the shape of a plan."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark import SparkContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_made: dict[tuple, Any] = {}


def made_once(key: tuple, make: Callable[[], Any]) -> Any:
    """What ``make`` gives, made once a process and JVM. Columns name what they read and not whose it is, so any plan may use them again; making
    thousands of expressions takes the driver seconds."""
    key = (id(SparkContext._gateway), *key)
    if key not in _made:
        _made[key] = make()
    return _made[key]


def computed_once(df: DataFrame, *cols: Column | str) -> DataFrame:
    """``df.select(*cols)`` behind a generator of one row a row: no filter is pushed through it and no later
    projection merged with it, so costly columns aren't copied into what uses them."""
    return df.select(F.inline(F.array(F.struct(*cols))))


def dealt(df: DataFrame) -> DataFrame:
    """Rows dealt out evenly over a few tasks a core: for costly columns, where a small file holds many rows and few tasks would read it."""
    return df.repartition(4 * df.sparkSession.sparkContext.defaultParallelism)
