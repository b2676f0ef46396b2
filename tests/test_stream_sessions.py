from __future__ import annotations

import datetime as dt
import random

from helpers import rows_of

from colloquy.operators import timeline
from colloquy.schema import CHATS
from colloquy.streaming import sessions

START = dt.datetime(2024, 1, 1)
COLUMNS = ("id", "client_id", "created_at", "session_id")


def message(i, client, minutes):
    return (i, client, START + dt.timedelta(minutes=minutes), "open", None)


def stream_of(spark, tmp_path, batches):
    for rows in batches:
        spark.createDataFrame(rows, CHATS).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    return spark.readStream.schema(CHATS).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")


def test_numbers_equal_the_batch(spark, tmp_path, chats):
    r = random.Random(1)
    rows = [message(i, r.choice([1, 2, 3, None]), r.choice([r.randrange(0, 3000), 30 * r.randrange(100)])) for i in range(300)]
    rows += [message(400, 1, 10), message(399, 1, 10), message(401, 7, 2999.5)]
    r.shuffle(rows)
    rows.sort(key=lambda x: x[2] + dt.timedelta(minutes=r.randrange(200)))  # out of order, but not late
    stream = stream_of(spark, tmp_path, [rows[k : k + 80] for k in range(0, len(rows), 80)])
    got = sessions.all_session_ids(stream, f"{tmp_path}/out", checkpoint=f"{tmp_path}/state", delay="3 days")
    assert got.columns == [*COLUMNS, "late"]
    assert not got.where("late").count()
    expected = timeline.sessionize(chats(rows))
    assert sorted(rows_of(got, *COLUMNS), key=str) == sorted(rows_of(expected, *COLUMNS), key=str)


def test_late_messages_are_listed(spark, tmp_path, chats):
    first = [message(1, 1, 0), message(2, 1, 500), message(3, 2, 500)]
    stream = stream_of(spark, tmp_path, [first, [message(4, 2, 600)]])
    report = sessions.streaming_session_ids(stream, delay="10 minutes")

    def run():
        from colloquy.streaming.reports import stream_to_table

        with sessions.with_state_store(spark):
            stream_to_table(report, f"{tmp_path}/out", checkpoint=f"{tmp_path}/state")

    run()
    spark.createDataFrame([message(5, 1, 3), message(6, 1, 700), message(7, 3, 595)], CHATS).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    run()
    spark.createDataFrame([message(8, 9, 90_000)], CHATS).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    run()
    got = spark.read.schema(report.schema).parquet(f"{tmp_path}/out")
    late = rows_of(got.where("late"), "id", "client_id", "session_id")
    assert late == [(5, 1, None)]
    kept = [x for x in first + [message(4, 2, 600), message(6, 1, 700), message(7, 3, 595)]]
    expected = timeline.sessionize(chats(kept))
    assert sorted(rows_of(got.where("not late"), *COLUMNS)) == sorted(rows_of(expected, *COLUMNS))
