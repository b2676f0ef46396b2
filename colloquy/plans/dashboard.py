"""All report tables of the dashboard."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.rules import TOPIC_DEFAULT, TOPIC_RULES, Rules, with_topic
from ..operators import engagement, sentiment, timeline, volume
from ..operators.names import with_names


def prepare(chats: DataFrame, lexicon: DataFrame, rules: Rules = TOPIC_RULES, default: str = TOPIC_DEFAULT) -> DataFrame:
    """Chats with topic, sentiment scores and categories."""
    return sentiment.with_sentiment(with_topic(chats, rules, default), lexicon)


def overall_reports(chats: DataFrame, clients: DataFrame) -> dict[str, DataFrame]:
    """The tables that do not react to filters; ``chats`` needs a topic."""
    return {
        "user_engagement": engagement.user_engagement(chats, clients),
        "avg_session_length": timeline.avg_session_length(chats),
        "drop_off_rate": engagement.drop_off_rate(chats),
        "topic_performance": volume.topic_performance(chats),
        "satisfaction_proxy": engagement.satisfaction_proxy(chats),
        "avg_response_time": engagement.avg_response_time(chats),
        "mean_turns": engagement.mean_turns(chats),
    }


def filtered_reports(rows: DataFrame, clients: DataFrame) -> dict[str, DataFrame]:
    """The tables over the chosen rows, which :func:`apply_filters` gives
    for chats from :func:`prepare`. Persist or write ``rows`` before, as every
    table reads them.
    """
    return {
        "messages_per_day": volume.messages_per_day(rows).orderBy("date"),
        "messages_per_month": volume.messages_per_month(rows),
        "messages_per_topic": volume.messages_per_topic(rows),
        "top_users": volume.top_users(rows.drop("name"), clients),
        "sentiment_distribution": sentiment.sentiment_distribution(rows),
        "sentiment_over_time": sentiment.sentiment_over_time(rows),
        "data_bounds": volume.data_bounds(rows),
    }


def client_overview(chats: DataFrame, clients: DataFrame) -> DataFrame:
    """Activity of each client with its name, most active first."""
    return with_names(timeline.client_activity(chats), clients).orderBy(F.desc("message_count"), "client_id")
