"""Report tables over a stream of chats."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.times import seconds_between
from ..operators.timeline import GAP_MINUTES
from ..session import make_folder, new_folder


# The client of the row that closes all sessions; its own session is never given out.
CLOSING_CLIENT = -(1 << 63)
CLOSING_TIME = "9000-01-01 00:00:00"


def _with_event_time(chats: DataFrame, delay: str) -> DataFrame:
    """Watermarks need a TIMESTAMP; with the session time zone UTC the clock reads the same."""
    zone = chats.sparkSession.conf.get("spark.sql.session.timeZone")
    if zone not in ("UTC", "Etc/UTC", "GMT", "Z", "+00:00"):
        raise ValueError(f"days and sessions of a stream need the session time zone UTC, not {zone}")
    return chats.withColumn("created_at", F.col("created_at").cast("timestamp")).withWatermark("created_at", delay)


def streaming_messages_per_day(
    chats: DataFrame, *, by: Sequence[str] = (), delay: str = "1 day"
) -> DataFrame:
    """Questions per date, and per series in ``by``, over a stream.

    In append mode a date is emitted once the watermark has passed it; rows
    later than ``delay`` are dropped. In update mode each change is emitted.
    """
    return (
        _with_event_time(chats, delay)
        .groupBy(F.window("created_at", "1 day"), *by)
        .agg(F.count("question").alias("message_count"))
        .select(*by, F.to_date("window.start").alias("date"), "message_count")
    )


def streaming_session_lengths(
    chats: DataFrame, *, gap_minutes: int = GAP_MINUTES, delay: str = "1 hour"
) -> DataFrame:
    """Sessions per client over a stream, for append mode.

    A session is emitted once the watermark is a gap past its last message; rows
    later than ``delay`` are dropped. Numbering sessions would need all earlier
    ones, so they carry their start instead.
    """
    gap = f"{gap_minutes} minutes"
    return (
        _with_event_time(chats.filter(F.col("client_id").isNotNull()), delay)
        .groupBy("client_id", F.session_window("created_at", gap).alias("session"))
        .agg(F.count(F.lit(1)).alias("messages"))
        .select(
            "client_id",
            F.col("session.start").cast("timestamp_ntz").alias("session_start"),
            (F.col("session.end") - F.expr(f"INTERVAL {gap_minutes} MINUTES"))
            .cast("timestamp_ntz")
            .alias("session_end"),
            "messages",
        )
        .withColumn("session_length_min", seconds_between("session_start", "session_end") / 60)
    )


def all_sessions(
    chats: DataFrame, folder: str, *, checkpoint: str, gap_minutes: int = GAP_MINUTES, delay: str = "1 hour"
) -> DataFrame:
    """Every session of a stream that has ended, the last ones included.

    Append mode keeps a session until the watermark has passed it, which nothing
    does for the last ones. So a second source stands beside the stream, empty at
    first. When all that is available has been processed, a row of a reserved
    client far in the future is written into it, and one more run on the same
    checkpoint gives out what was kept. After that all rows are late: a stream
    that goes on uses :func:`streaming_session_lengths`.
    """
    spark = chats.sparkSession
    columns = ("client_id", "created_at")
    chats = chats.select(*columns)
    closing = new_folder(spark, "closing")
    make_folder(spark, closing)
    beside = spark.readStream.schema(chats.schema).parquet(closing)
    report = streaming_session_lengths(chats.unionByName(beside), gap_minutes=gap_minutes, delay=delay)
    stream_to_table(report, folder, checkpoint=checkpoint)
    row = spark.range(1).select(
        F.lit(CLOSING_CLIENT).cast(chats.schema["client_id"].dataType).alias("client_id"),
        F.lit(CLOSING_TIME).cast(chats.schema["created_at"].dataType).alias("created_at"),
    )
    row.write.mode("append").parquet(closing)
    stream_to_table(report, folder, checkpoint=checkpoint)
    return spark.read.schema(report.schema).parquet(folder)


def stream_to_table(report: DataFrame, folder: str, *, checkpoint: str, mode: str = "append") -> None:
    """Process everything available and write it as parquet; safe to run again.
    The folder is there afterwards, even if nothing was.

    The file sink takes appended rows only; with ``update`` each micro-batch is
    written to its own folder, so that a retried batch replaces itself.
    """
    make_folder(report.sparkSession, folder)
    writer = report.writeStream.trigger(availableNow=True).option("checkpointLocation", checkpoint)
    if mode == "append":
        query = writer.outputMode("append").format("parquet").option("path", folder).start()
    else:

        def write_batch(batch: DataFrame, number: int) -> None:
            batch.write.mode("overwrite").parquet(f"{folder}/batch={number}")

        query = writer.outputMode(mode).foreachBatch(write_batch).start()
    query.awaitTermination()


def latest(updates: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The last update of each key from a folder written in update mode."""
    values = [c for c in updates.columns if c not in (*keys, "batch")]
    return (
        updates.groupBy(*keys)
        .agg(F.max_by(F.struct(*values), "batch").alias("_v"))
        .select(*keys, *[F.col(f"_v.{v}").alias(v) for v in values])
    )
