from __future__ import annotations

import datetime as dt

import pytest
from helpers import rows_of

from colloquy.functions.rules import with_topic
from colloquy.operators import timeline, volume
from colloquy.plans import registry
from colloquy.schema import CHATS
from colloquy.session import new_folder
from colloquy.streaming import reports

START = dt.datetime(2024, 1, 1)


def message(i, client, minutes, question="open"):
    return (i, client, START + dt.timedelta(minutes=minutes), question, None)


MESSAGES = [
    message(1, 1, 0), message(2, 1, 30), message(3, 1, 61), message(4, 2, 5, None), message(5, 2, 1500, "menu"),
    message(6, None, 7),
]


def stream_of(spark, tmp_path, batches):
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, CHATS).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    return spark.readStream.schema(CHATS).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")


def test_all_sessions_of_part_files(spark, tmp_path, chats):
    stream = stream_of(spark, tmp_path, [MESSAGES[:2], MESSAGES[2:4], MESSAGES[4:]])
    got = reports.all_sessions(stream, f"{tmp_path}/out", checkpoint=f"{tmp_path}/state", delay="2 days")
    batch = timeline.session_lengths(chats(MESSAGES)).drop("session_id")
    columns = ("client_id", "session_start", "session_end", "messages", "session_length_min")
    assert sorted(rows_of(got, *columns)) == sorted(rows_of(batch, *columns))


@pytest.mark.parametrize("parts", [1, 3])
def test_queries_on_a_table_of_part_files(spark, tmp_path, parts):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    events.repartition(parts).write.parquet(f"{tmp_path}/events.parquet")
    days = registry.QUERIES["streaming_messages_per_day"](spark, str(tmp_path))
    assert days.agg({"message_count": "sum"}).first()[0] == events.where("event_type <> 'error'").count()
    sessions = registry.QUERIES["streaming_sessions"](spark, str(tmp_path))
    assert sessions.count() == timeline.session_lengths(registry.events(spark, str(tmp_path))).count()


def test_other_time_zones_raise(spark, tmp_path):
    stream = stream_of(spark, tmp_path, [MESSAGES])
    spark.conf.set("spark.sql.session.timeZone", "Europe/Berlin")
    try:
        with pytest.raises(ValueError, match="UTC"):
            reports.streaming_messages_per_day(stream)
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_daily_stream_equals_batch(spark, tmp_path, chats):
    stream = with_topic(stream_of(spark, tmp_path, [MESSAGES[:3], MESSAGES[3:]]))
    report = reports.streaming_messages_per_day(stream, by=("topic",), delay="3 days")
    reports.stream_to_table(report, f"{tmp_path}/out", checkpoint=f"{tmp_path}/state", mode="update")
    got = reports.latest(spark.read.parquet(f"{tmp_path}/out"), ("topic", "date"))
    batch = volume.messages_per_day(with_topic(chats(MESSAGES)), by=("topic",))
    assert sorted(rows_of(got, "topic", "date", "message_count")) == sorted(rows_of(batch, "topic", "date", "message_count"))


def test_session_stream_equals_batch_after_drain(spark, tmp_path, chats):
    closing = [message(99, 9, 100_000)]
    stream = stream_of(spark, tmp_path, [MESSAGES, closing])
    report = reports.streaming_session_lengths(stream, delay="2 days")
    out = new_folder(spark, "test-sessions")
    reports.stream_to_table(report, out, checkpoint=f"{tmp_path}/state")
    got = spark.read.schema(report.schema).parquet(out)
    batch = timeline.session_lengths(chats(MESSAGES)).drop("session_id")
    columns = ("client_id", "session_start", "session_end", "messages", "session_length_min")
    assert sorted(rows_of(got, *columns)) == sorted(rows_of(batch, *columns))
    assert got.count() == 4
