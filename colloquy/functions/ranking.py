"""Ranks and running sums over a whole table without bringing it to one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import written
from .skew import broadcast_if_small


def sums_before(
    rows: DataFrame, order: str, weight: Column, *, by: Sequence[str] = (), name: str = "before"
) -> DataFrame:
    """Add the sum of the weights of all rows before each row, in the order of a column.

    The rows are range-partitioned by group and order and written, so that the parts stay as
    they are; each part's total is one row, and the totals before a part are added to the
    running sum inside it. Rows with equal keys lie in one part: aggregate repeated
    values into a weight first. The (by, order) pairs must be unique and ``by`` not NULL.
    """
    spread = rows.repartitionByRange(*by, order).withColumn("_part", F.spark_partition_id())
    spread = written(spread, "ordered-rows")
    totals = spread.groupBy(*by, "_part").agg(F.sum(weight).alias("_total"))
    earlier = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    if not by:  # a row for each partition
        earlier = Window.partitionBy(F.lit(0)).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*by, "_part", F.coalesce(F.sum("_total").over(earlier), F.lit(0)).alias("_offset"))
    within = Window.partitionBy(*by, "_part").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    running = F.col("_offset") + F.coalesce(F.sum(weight).over(within), F.lit(0))
    return spread.join(broadcast_if_small(offsets), [*by, "_part"]).withColumn(name, running).drop("_part", "_offset")


def ranks(rows: DataFrame, order: str, *, by: Sequence[str] = (), name: str = "rank") -> DataFrame:
    """Number rows of different keys 0, 1, 2 … in the order of a column."""
    return sums_before(rows, order, F.lit(1), by=by, name=name)
