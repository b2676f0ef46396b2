"""Chat-shaped views of generic event, conversation and document tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import read_source


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return read_source(spark, name, folder=folder)


def event_chats(spark: SparkSession, folder: str) -> DataFrame:
    return as_event_chats(_table(spark, folder, "events"))


def as_event_chats(events: DataFrame) -> DataFrame:
    """Events as messages: an error is a bot answer, a view is both, the rest are questions."""
    kind = F.col("event_type")
    return events.select(
        F.col("event_id").alias("id"),
        F.col("user_id").alias("client_id"),
        F.col("ts").alias("created_at"),
        F.when(kind != "error", kind).alias("question"),
        F.when(kind.isin("error", "view"), kind).alias("answer"),
    )


def customer_clients(spark: SparkSession, folder: str) -> DataFrame:
    return _table(spark, folder, "customer").select(
        F.col("c_custkey").alias("client_id"), F.col("c_name").alias("name")
    )


def message_id(conversation: Column, turn: Column) -> Column:
    """One number for both, without collisions: 31 bits of conversation, 32 of turn; more of either raises."""
    fits = conversation.between(0, (1 << 31) - 1) & turn.between(0, (1 << 32) - 1)
    wrong = F.raise_error(F.concat_ws(" ", F.lit("no message id for conversation and turn"), conversation, turn))
    return F.when(fits, F.shiftleft(conversation, 32) + turn).otherwise(wrong.cast("long"))


def conversation_chats(spark: SparkSession, folder: str) -> DataFrame:
    """A user turn and the assistant turn after it become one message.

    Turns are numbered without holes, so an answer belongs to the turn one
    below its own: grouping by that number pairs the two rows without a join,
    in groups of at most two rows, however long a conversation is.
    """
    spoken = _table(spark, folder, "conversations").filter(F.col("role").isin("user", "assistant"))
    asked = F.col("role") == "user"
    pair = F.when(asked, F.col("turn")).otherwise(F.col("turn") - 1)
    minutes = F.col("conv_id") * 7 + F.col("turn")
    return (
        spoken.groupBy("conv_id", pair.alias("turn"))
        .agg(
            F.max(F.when(asked, F.col("text"))).alias("question"),
            F.max(F.when(~asked, F.col("text"))).alias("answer"),
            F.max(asked).alias("asked"),
        )
        .filter("asked")
        .select(
            message_id(F.col("conv_id"), F.col("turn")).alias("id"),
            F.col("conv_id").alias("client_id"),
            F.timestamp_add("MINUTE", minutes, F.expr("TIMESTAMP_NTZ '2024-01-01 00:00:00'"))
            .cast("timestamp_ntz")
            .alias("created_at"),
            "question",
            "answer",
        )
    )


def document_texts(spark: SparkSession, folder: str) -> DataFrame:
    """Documents as questions without an answer."""
    return _table(spark, folder, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("question"))


def all_names(spark: SparkSession, folder: str) -> DataFrame:
    """Every name in the region, nation, part and customer tables with its key."""
    parts = [("region", "r_regionkey", "r_name"), ("nation", "n_nationkey", "n_name"),
             ("part", "p_partkey", "p_name"), ("customer", "c_custkey", "c_name")]
    frames = [
        _table(spark, folder, table).select(
            F.lit(table).alias("source"), F.col(key).cast("long").alias("client_id"), F.col(name).alias("name")
        )
        for table, key, name in parts
    ]
    result = frames[0]
    for frame in frames[1:]:
        result = result.unionByName(frame)
    return result
