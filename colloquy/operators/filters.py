"""Selection of chats for the interactive reports."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.skew import HOT_ROWS, broadcast_if_small
from ..functions.times import in_days
from .names import unique_names, with_names_on_rows
from .sentiment import with_sentiment


@dataclass(frozen=True)
class Filters:
    """Dates (both included) and choices; no choice means no filter."""

    first_date: str
    last_date: str
    users: Sequence[str] = ()
    topics: Sequence[str] = ()
    sentiments: Sequence[str] = ()


def apply_filters(
    chats: DataFrame,
    clients: DataFrame,
    filters: Filters,
    *,
    lexicon: DataFrame | None = None,
    max_rows: int = HOT_ROWS,
) -> DataFrame:
    """The chosen rows with their names.

    An active choice drops rows whose value is NULL. ``chats`` needs a topic for
    a choice of topics. With a lexicon the chosen rows get their sentiment here,
    after dates, topics and users have been applied, so other rows are not scored;
    without one, a choice of sentiments needs question_sentiment_category.
    """
    rows = chats.filter(in_days("created_at", filters.first_date, filters.last_date))
    if "date" in rows.columns:
        # Chats written by date: the same days again, to prune partitions.
        days = [F.to_date(F.lit(day)) for day in (filters.first_date, filters.last_date)]
        rows = rows.filter(F.col("date").between(*days))
    if filters.topics:
        rows = rows.filter(F.col("topic").isin(*filters.topics))
    if filters.users:
        if "name" in rows.columns:
            rows = rows.filter(F.col("name").isin(*filters.users))
        else:
            chosen = unique_names(clients).filter(F.col("name").isin(*filters.users))
            rows = rows.join(broadcast_if_small(chosen), "client_id")
    if lexicon is not None:
        rows = with_sentiment(rows, lexicon)
    if filters.sentiments:
        rows = rows.filter(F.col("question_sentiment_category").isin(*filters.sentiments))
    return rows if "name" in rows.columns else with_names_on_rows(rows, clients, max_rows=max_rows)


def user_options(clients: DataFrame) -> DataFrame:
    """Distinct names in alphabetical order."""
    return clients.select("name").na.drop().distinct().orderBy("name")


def topic_options(chats: DataFrame) -> DataFrame:
    return chats.select("topic").distinct().orderBy("topic")
