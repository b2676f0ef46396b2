"""Report tables that grow by loads instead of being computed anew.

The stored rows are sums, so they merge: one row for each day, topic and load, in a folder
for each day. A load aggregates its own rows alone, and replaces the folders of the days it
touches, late days among them, by dynamic partition overwrite; other days are not
read. What a load gave before is taken out first, so loading it again, whole or after a
failure in between, leaves the same table.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import is_folder, written

MEASURES = ("rows", "questions", "answers")
# A load may touch this many days; more are better loaded in parts.
MAX_DAYS = 10_000


def day_sums(chats: DataFrame, by: Sequence[str] = ("topic",)) -> DataFrame:
    """Mergeable sums of the chats of each day."""
    return chats.groupBy(F.to_date("created_at").alias("date"), *by).agg(
        F.count(F.lit(1)).alias("rows"), F.count("question").alias("questions"), F.count("answer").alias("answers")
    )


def stored(spark: SparkSession, folder: str) -> DataFrame | None:
    """The rows of all loads, or None before the first."""
    return spark.read.parquet(folder) if is_folder(spark, folder) else None


def load(chats: DataFrame, folder: str, name: str, *, by: Sequence[str] = ("topic",)) -> None:
    """Add the chats to the stored table under the load's name, in place of what that name gave before.

    One load writes at a time. An empty load takes its earlier rows out.
    """
    spark = chats.sparkSession
    new = written(day_sums(chats, by).withColumn("load", F.lit(name)), "load")
    before = stored(spark, folder)
    days = new.select("date")
    if before is not None:
        days = days.unionByName(before.filter(F.col("load") == name).select("date"))
    touched = [row.date for row in days.distinct().limit(MAX_DAYS + 1).collect()]
    if len(touched) > MAX_DAYS:
        raise ValueError(f"a load may touch at most {MAX_DAYS} days")
    if before is not None:
        same_days = F.col("date").isin([d for d in touched if d is not None]) | (F.col("date").isNull() if None in touched else F.lit(False))
        others = written(before.filter(same_days & (F.col("load") != name)), "other-loads")
        # A day that only this load had keeps an empty row, as a folder without rows is not replaced.
        emptied = spark.createDataFrame([(d,) for d in touched], "date date").join(
            others.select("date").unionByName(new.select("date")).distinct(), "date", "left_anti"
        )
        blank = emptied.select(
            "date", *[F.lit(None).cast(new.schema[c].dataType).alias(c) for c in by], *[F.lit(0).cast("bigint").alias(m) for m in MEASURES],
            F.lit("").alias("load"),
        )
        new = new.unionByName(others.select(new.columns)).unionByName(blank)
    if touched:
        sized = new.repartition("date")  # one file a day: a day has a row for each topic and load
        sized.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("date").parquet(folder)


def report(spark: SparkSession, folder: str, *, by: Sequence[str] = ("topic",)) -> DataFrame:
    """The sums of all loads, as :func:`day_sums` of all their rows gives them."""
    table = stored(spark, folder)
    if table is None:
        raise ValueError(f"nothing has been loaded into {folder}")
    sums = table.groupBy("date", *by).agg(*[F.sum(m).alias(m) for m in MEASURES])
    return sums.filter("rows > 0")
