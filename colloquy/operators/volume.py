"""Message counts by time, topic and user."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .names import with_names


def messages_per_day(chats: DataFrame, *, by: Sequence[str] = ()) -> DataFrame:
    """Questions per calendar date, for each series in ``by`` when given.

    A date that has rows but no question counts 0; a date without rows is absent.
    """
    return chats.groupBy(*by, F.to_date("created_at").alias("date")).agg(F.count("question").alias("message_count"))


def messages_per_week(chats: DataFrame, *, iso_year: bool = False) -> DataFrame:
    """Questions per calendar year and ISO week.

    The last days of December can be week 1 of their own calendar year;
    ``iso_year`` counts them in the ISO year of that week instead.
    """
    ts = F.col("created_at")
    year = F.extract(F.lit("YEAROFWEEK"), ts) if iso_year else F.year(ts)
    return chats.groupBy(year.cast("long").alias("year"), F.weekofyear(ts).cast("long").alias("week")).agg(
        F.count("question").alias("message_count")
    )


def messages_per_month(chats: DataFrame) -> DataFrame:
    """Questions per month with a label such as 2024-Jan, in time order."""
    first_day = F.make_date("year", "month", F.lit(1))
    return (
        chats.groupBy(F.year("created_at").alias("year"), F.month("created_at").alias("month"))
        .agg(F.count("question").alias("message_count"))
        .withColumn("month_name", F.date_format(first_day, "MMM"))
        .withColumn("year_month", F.concat_ws("-", "year", "month_name"))
        .orderBy("year", "month")
    )


def messages_per_topic(chats: DataFrame) -> DataFrame:
    """Rows per topic, most frequent first."""
    return (
        chats.groupBy("topic")
        .agg(F.count(F.lit(1)).alias("message_count"))
        .orderBy(F.desc("message_count"), "topic")
    )


def messages_per_user(chats: DataFrame) -> DataFrame:
    """Rows per client, most active first; rows without a client drop."""
    return _rows_per_client(chats).orderBy(F.desc("message_count"), "client_id")


def top_users(chats: DataFrame, clients: DataFrame, *, n: int = 10) -> DataFrame:
    """The n names with most rows; clients of one name count together, unnamed ones drop.

    Rows are counted per client before the names are joined.
    """
    return (
        with_names(_rows_per_client(chats), clients)
        .filter(F.col("name").isNotNull())
        .groupBy("name")
        .agg(F.sum("message_count").alias("message_count"))
        .orderBy(F.desc("message_count"), "name")
        .limit(n)
    )


def _rows_per_client(chats: DataFrame) -> DataFrame:
    return (
        chats.filter(F.col("client_id").isNotNull())
        .groupBy("client_id")
        .agg(F.count(F.lit(1)).alias("message_count"))
    )


def topic_performance(chats: DataFrame) -> DataFrame:
    """Rows per topic and their share of all rows in percent, two decimals half-even.

    The window runs over one row per topic.
    """
    total = F.sum("frequency").over(Window.partitionBy())
    return (
        chats.groupBy("topic")
        .agg(F.count(F.lit(1)).alias("frequency"))
        .withColumn("percentage", F.bround(F.col("frequency") / total * 100, 2))
    )


def underrepresented_topics(chats: DataFrame, *, below: float = 5.0) -> DataFrame:
    """Topics with less than the given share of all rows."""
    return topic_performance(chats).filter(F.col("percentage") < below)


def data_bounds(chats: DataFrame) -> DataFrame:
    """First and last date and the number of rows."""
    return chats.agg(
        F.to_date(F.min("created_at")).alias("min_date"),
        F.to_date(F.max("created_at")).alias("max_date"),
        F.count(F.lit(1)).alias("row_count"),
    )
