"""Per-client activity, turns, drop-off, response times and derived features."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.rules import sender, with_sender
from ..functions.skew import HOT_ROWS
from ..functions.times import seconds_between
from .names import with_names
from .timeline import GAP_MINUTES, starts_session, with_neighbors


def _with_client(chats: DataFrame) -> DataFrame:
    return chats.filter(F.col("client_id").isNotNull())


def user_engagement(chats: DataFrame, clients: DataFrame) -> DataFrame:
    """Questions and distinct active dates per client with its name, most active first."""
    active = (
        _with_client(chats)
        .groupBy("client_id")
        .agg(
            F.count("question").alias("message_count"),
            F.count_distinct(F.to_date("created_at")).alias("active_days"),
        )
    )
    return with_names(active, clients).orderBy(F.desc("message_count"), "client_id")


def satisfaction_proxy(chats: DataFrame) -> DataFrame:
    """Per topic: mean rows of the clients that used it, and how many they are."""
    return (
        _with_client(chats)
        .groupBy("client_id", "topic")
        .agg(F.count(F.lit(1)).alias("rows"))
        .groupBy("topic")
        .agg(F.avg("rows").alias("avg_messages_per_conversation"), F.count(F.lit(1)).alias("unique_users"))
        .orderBy(F.desc("avg_messages_per_conversation"), "topic")
    )


def turns(chats: DataFrame) -> DataFrame:
    """Rows, questions and answers per client."""
    return (
        _with_client(chats)
        .groupBy("client_id")
        .agg(
            F.count(F.lit(1)).alias("total_messages"),
            F.count("question").alias("user_messages"),
            F.count("answer").alias("bot_messages"),
        )
    )


def mean_turns(chats: DataFrame) -> DataFrame:
    """Means of the turn counts over all clients."""
    counts = ("total_messages", "user_messages", "bot_messages")
    return turns(chats).agg(*[F.avg(c).alias(c) for c in counts])


def drop_off_rate(chats: DataFrame) -> DataFrame:
    """Share of bot rows, in percent, after which the client wrote nothing more.

    Only the last row of a client can be such a row, so the largest
    (created_at, id, sender) of each client decides and no window is needed.
    Bot rows without a client all count as dropped. Without bot rows the rate
    is 0; bot_messages tells the two kinds of 0 apart.
    """
    is_bot = F.col("sender") == "bot"
    per_client = (
        with_sender(chats)
        .groupBy("client_id")
        .agg(F.count_if(is_bot).alias("bots"), F.max(F.struct("created_at", "id", "sender")).alias("last"))
    )
    dropped = (
        F.when(F.col("client_id").isNull(), F.col("bots"))
        .when(F.col("last.sender") == "bot", F.lit(1))
        .otherwise(F.lit(0))
    )
    return (
        per_client.agg(
            F.coalesce(F.sum("bots"), F.lit(0)).alias("bot_messages"),
            F.coalesce(F.sum(dropped), F.lit(0)).alias("dropped"),
        )
        .withColumn(
            "drop_off_rate",
            F.coalesce(F.try_divide(F.col("dropped"), F.col("bot_messages")) * 100, F.lit(0.0)),
        )
    )


def response_times(chats: DataFrame, *, max_rows: int = HOT_ROWS) -> DataFrame:
    """Seconds from an answered question to the client's next answered row.

    Rows without an answer are not seen at all; rows that have no question, or
    no answered row after them, give no result.
    """
    answered = chats.filter(F.col("answer").isNotNull()).select(
        "id", "client_id", "created_at", F.col("question").isNotNull().alias("asked")
    )
    return (
        with_neighbors(answered, {"next_created_at": ("created_at", 1)}, max_rows=max_rows)
        .filter(F.col("asked") & F.col("next_created_at").isNotNull())
        .select(
            "id",
            "client_id",
            "created_at",
            "next_created_at",
            seconds_between("created_at", "next_created_at").alias("response_time_sec"),
        )
    )


def avg_response_time(chats: DataFrame, *, max_rows: int = HOT_ROWS) -> DataFrame:
    """Mean response time in seconds and minutes; NULL when there are no pairs."""
    return (
        response_times(chats, max_rows=max_rows)
        .agg(F.avg("response_time_sec").alias("avg_response_time_sec"), F.count(F.lit(1)).alias("pairs"))
        .withColumn("avg_response_time_min", F.col("avg_response_time_sec") / 60)
    )


def _reply_seconds() -> Column:
    replied = (F.col("sender") == "user") & (F.col("next_sender") == "bot")
    return F.when(replied, seconds_between("created_at", "next_time"))


def reply_times(chats: DataFrame, *, max_rows: int = HOT_ROWS) -> DataFrame:
    """Every row of a client with the seconds to its next row, if a bot row follows a user row."""
    rows = chats.select("id", "client_id", "created_at", sender().alias("sender"))
    shifts = {"next_time": ("created_at", 1), "next_sender": ("sender", 1)}
    return with_neighbors(rows, shifts, max_rows=max_rows).withColumn("response_time_sec", _reply_seconds())


def _client_features(
    chats: DataFrame, *, gap_minutes: float, max_rows: int
) -> DataFrame:
    """All per-client features in one aggregation over rows with their neighbours.

    Rows are in time order, so a session starts where the gap is long enough
    and an active date where the date differs from the row before; only the
    topics need a distinct count, and that by client and topic before the client.
    """
    rows = chats.select(
        "id",
        "client_id",
        "created_at",
        "topic",
        F.length("question").alias("question_length"),
        sender().alias("sender"),
    )
    shifts = {
        "prev_time": ("created_at", -1),
        "next_time": ("created_at", 1),
        "next_sender": ("sender", 1),
    }
    prev, now = F.col("prev_time"), F.col("created_at")
    new_day = prev.isNull() | (F.to_date(prev) != F.to_date(now))
    return (
        with_neighbors(rows, shifts, max_rows=max_rows)
        .groupBy("client_id")
        .agg(
            F.count(F.lit(1)).alias("total_messages"),
            F.count("question_length").alias("questions"),
            F.count_if(new_day).alias("active_days"),
            F.avg("question_length").alias("avg_message_length"),
            F.avg(_reply_seconds()).alias("avg_response_time"),
            F.count_if(starts_session(prev, now, gap_minutes)).alias("session_count"),
            F.count_distinct("topic").alias("unique_topics"),
            (seconds_between(F.min("created_at"), F.max("created_at")) / 3600).alias("span_hours"),
        )
    )


def user_behavior(
    chats: DataFrame,
    clients: DataFrame,
    sentiment: DataFrame,
    *,
    gap_minutes: float = GAP_MINUTES,
    max_rows: int = HOT_ROWS,
) -> DataFrame:
    """Seven behaviour features per client and its name.

    ``chats`` needs a topic column, whose labels are all counted; ``sentiment``
    holds avg_sentiment per client_id. Missing numbers of the clustering features
    become 0.
    """
    features = _client_features(chats, gap_minutes=gap_minutes, max_rows=max_rows).join(
        sentiment.select("client_id", "avg_sentiment"), "client_id", "left"
    )
    return with_names(features, clients).select(
        "client_id",
        "total_messages",
        "active_days",
        F.coalesce("avg_message_length", F.lit(0.0)).alias("avg_message_length"),
        F.coalesce("avg_response_time", F.lit(0.0)).alias("avg_response_time"),
        "session_count",
        "unique_topics",
        "avg_sentiment",
        "name",
    )


def satisfaction_features(
    chats: DataFrame,
    sentiment: DataFrame,
    *,
    gap_minutes: float = GAP_MINUTES,
    max_rows: int = HOT_ROWS,
) -> DataFrame:
    """Features of the satisfaction label per client.

    ``session_length`` is the mean number of rows per session. A client without
    questions has no engagement_diversity.
    """
    features = _client_features(chats, gap_minutes=gap_minutes, max_rows=max_rows).join(
        sentiment.select("client_id", "avg_sentiment"), "client_id", "left"
    )
    return features.select(
        "client_id",
        F.col("session_count").alias("sessions"),
        "questions",
        F.col("unique_topics").alias("topics"),
        "avg_sentiment",
        "span_hours",
        (F.col("questions") / F.col("session_count")).alias("avg_messages_per_session"),
        F.try_divide("unique_topics", "questions").alias("engagement_diversity"),
        F.coalesce("avg_response_time", F.lit(0.0)).alias("avg_response_time"),
        (F.col("total_messages") / F.col("session_count")).alias("session_length"),
        F.col("questions").alias("conversation_turns"),
    )


@dataclass(frozen=True)
class SatisfactionLimits:
    """The default limits of the satisfaction label."""

    high_turns: int = 3
    high_response_sec: float = 60
    high_session: float = 5
    low_turns: int = 1
    low_response_sec: float = 300
    low_session: float = 2


def satisfaction_label(limits: SatisfactionLimits = SatisfactionLimits()) -> Column:
    turns_, response, session = F.col("conversation_turns"), F.col("avg_response_time"), F.col("session_length")
    high = (
        (turns_ >= limits.high_turns)
        & (response < limits.high_response_sec)
        & (session > limits.high_session)
    )
    low = (
        (turns_ <= limits.low_turns)
        | (response > limits.low_response_sec)
        | (session < limits.low_session)
    )
    return F.when(high, "high").when(low, "low").otherwise("medium")


def with_satisfaction(features: DataFrame, limits: SatisfactionLimits = SatisfactionLimits()) -> DataFrame:
    return features.withColumn("satisfaction", satisfaction_label(limits))
