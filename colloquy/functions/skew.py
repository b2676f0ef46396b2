"""Helpers for keys that hold far more rows than the others."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# A key with more rows than this is split over several tasks.
HOT_ROWS = 5_000_000
# A table is broadcast only when it is counted to hold no more rows than this;
# the tables in question have two or three narrow columns.
BROADCAST_ROWS = 1_000_000
# Up to this many hot keys are brought to the driver.
LISTED_KEYS = 10_000


@dataclass(frozen=True)
class HotKeys:
    """The hot keys of a table: at most (table rows / max_rows) of them."""

    keys: DataFrame
    count: int
    rows: int
    max_rows: int

    @property
    def slices(self) -> int:
        """How many slices of at most about max_rows rows the hot rows need."""
        return max(2, math.ceil(2 * self.rows / self.max_rows))


def find_hot_keys(rows: DataFrame, key: str, max_rows: int = HOT_ROWS) -> HotKeys | None:
    """The keys with more than max_rows rows, or None when there are none.

    Runs one job that reads only the key column and counts before shuffling;
    the driver gets one row and, if there are few hot keys, these.
    """
    hot = (
        rows.filter(F.col(key).isNotNull())
        .groupBy(key)
        .agg(F.count(F.lit(1)).alias("_rows"))
        .filter(F.col("_rows") > max_rows)
    )
    found = hot.agg(F.count(F.lit(1)).alias("n"), F.sum("_rows").alias("rows")).first()
    if not found.n:
        return None
    keys = hot.select(key)
    if found.n <= LISTED_KEYS:
        # A short list is kept, so that later joins do not count the table again.
        keys = rows.sparkSession.createDataFrame(keys.collect(), T.StructType([rows.schema[key]]))
    return HotKeys(keys, found.n, found.rows, max_rows)


def small_enough(table: DataFrame, max_rows: int = BROADCAST_ROWS) -> bool:
    """Counted, not estimated. A full count is cheaper than a limited one,
    which would bring max_rows rows of every partition to one task."""
    return table.count() <= max_rows


def broadcast_if_small(table: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Hint a broadcast after counting the table; beyond the bound leave the
    join to Spark, which shuffles it and splits skewed partitions."""
    return F.broadcast(table) if small_enough(table, max_rows) else table


def hot_side(hot: HotKeys) -> DataFrame:
    return F.broadcast(hot.keys) if hot.count <= BROADCAST_ROWS else hot.keys
