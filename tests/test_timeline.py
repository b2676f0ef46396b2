from __future__ import annotations

import datetime as dt
import random

import pandas as pd
from helpers import rows_of
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from colloquy.functions.skew import find_hot_keys
from colloquy.operators import engagement, timeline
from colloquy.functions.rules import sender

START = dt.datetime(2024, 1, 1)


def random_rows(seed, n=400, hot_share=0.6):
    """One client with most rows, bursts of equal times, rows without a client."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        client = 1 if rng.random() < hot_share else rng.choice([None, 2, 3, 4])
        if rng.random() < 0.3:
            time = START + dt.timedelta(hours=5)
        else:
            time = START + dt.timedelta(seconds=rng.randrange(200_000))
        question = rng.choice(["open hours", "menu", None])
        answer = rng.choice(["yes", None])
        rows.append((i, client, time, question, answer))
    return rows


def brute_sessions(rows, gap=1800):
    """prev_time and session_id by id, one row after the other."""
    result, last, number = {}, {}, {}
    for i, client, time, *_ in sorted((r for r in rows if r[1] is not None), key=lambda r: (r[1], r[2], r[0])):
        prev = last.get(client)
        if prev is None or (time - prev).total_seconds() > gap:
            number[client] = number.get(client, 0) + 1
        result[i] = (prev, number[client])
        last[client] = time
    return result


def test_gap_edges(chats):
    frame = chats(
        [
            (1, 1, "2024-01-01 10:00:00", "a", None),
            (2, 1, "2024-01-01 10:29:59", "a", None),
            (3, 1, "2024-01-01 10:59:59", "a", None),
            (4, 1, "2024-01-01 11:30:00", "a", None),
            (5, None, "2024-01-01 11:30:00", "a", None),
        ]
    )
    got = dict(rows_of(timeline.sessionize(frame), "id", "session_id"))
    assert got == {1: 1, 2: 1, 3: 1, 4: 2, 5: None}
    sessions = rows_of(timeline.session_lengths(frame).orderBy("session_id"), "client_id", "session_id", "messages", "session_length_min")
    assert sessions == [(1, 1, 3, 59 + 59 / 60), (1, 2, 1, 0.0)]
    assert rows_of(timeline.avg_session_length(frame), "sessions") == [(2,)]


def test_gap_is_a_parameter(chats):
    frame = chats([(1, 1, "2024-01-01 10:00:00", "a", None), (2, 1, "2024-01-01 10:06:00", "a", None)])
    assert timeline.session_lengths(frame, gap_minutes=5).count() == 2
    assert timeline.session_lengths(frame, gap_minutes=6).count() == 1


def test_hot_keys(chats):
    frame = chats(random_rows(1))
    assert find_hot_keys(frame, "client_id", 1000) is None
    hot = find_hot_keys(frame, "client_id", 100)
    assert rows_of(hot.keys) == [(1,)]
    assert hot.slices >= 2


def test_hot_client_equals_brute_force(chats):
    rows = random_rows(2)
    expected = brute_sessions(rows)
    for limit in (20, 10_000):
        frame = timeline.sessionize(chats(rows), max_rows=limit)
        got = {i: (p, s) for i, p, s in rows_of(frame, "id", "prev_time", "session_id")}
        assert len(got) == len(rows)
        for i, client, *_ in rows:
            assert got[i] == ((None, None) if client is None else expected[i])


def test_session_table_equals_sessionized_rows(chats):
    rows = random_rows(3)
    by_row = (
        timeline.sessionize(chats(rows))
        .filter("client_id IS NOT NULL")
        .groupBy("client_id", "session_id")
        .agg(F.min("created_at"), F.max("created_at"), F.count("*"))
    )
    table = timeline.session_lengths(chats(rows)).drop("session_length_min")
    assert sorted(rows_of(by_row)) == sorted(rows_of(table))


def test_activity_equals_sessionized_rows(chats):
    rows = random_rows(6)
    by_row = (
        timeline.sessionize(chats(rows))
        .filter("client_id IS NOT NULL")
        .groupBy("client_id")
        .agg(F.count("question"), F.count_distinct(F.to_date("created_at")), F.max("session_id"))
    )
    got = timeline.client_activity(chats(rows)).drop("mean_session_min")
    assert sorted(rows_of(got)) == sorted(rows_of(by_row))


def test_session_over_midnight(chats):
    frame = chats([(1, 1, "2024-01-01 23:50:00", "a", None), (2, 1, "2024-01-02 00:10:00", "a", None)])
    assert rows_of(timeline.client_activity(frame)) == [(1, 2, 2, 1, 20.0)]


def test_partitions_and_order_do_not_matter(chats):
    rows = random_rows(7, n=200)
    frame = chats(rows)
    shuffled = chats(rows[::-1]).repartition(7, "question")
    for op in (timeline.session_lengths, timeline.sessionize, engagement.reply_times, engagement.drop_off_rate, engagement.turns):
        assert sorted(rows_of(op(frame)), key=str) == sorted(rows_of(op(shuffled)), key=str)


def test_neighbors_both_ways_on_hot_client(chats):
    rows = random_rows(4)
    frame = chats(rows).withColumn("sender", sender())
    shifts = {"p": ("sender", -1), "n": ("sender", 1), "t": ("created_at", 1)}
    plain = timeline.with_neighbors(frame, shifts, keep_keyless=True)
    sliced = timeline.with_neighbors(frame, shifts, keep_keyless=True, max_rows=15)
    key = lambda r: r[0]
    columns = ("id", "p", "n", "t")
    assert sorted(rows_of(plain, *columns), key=key) == sorted(rows_of(sliced, *columns), key=key)
    assert plain.columns == sliced.columns


def test_response_times_equal_pandas_and_split_hot(chats):
    rows = random_rows(5)
    data = pd.DataFrame(rows, columns=["id", "client_id", "created_at", "question", "answer"])
    data = data.sort_values(["client_id", "created_at", "id"])
    answered = data[data.answer.notna()]
    following = answered.groupby("client_id")["created_at"].shift(-1)
    asked = data[data.question.notna()].copy()
    asked["s"] = (following - asked.created_at).dt.total_seconds()
    expected = dict(asked[asked.s.notna()][["id", "s"]].itertuples(index=False, name=None))
    for limit in (20, 10_000):
        got = engagement.response_times(chats(rows), max_rows=limit)
        assert dict(rows_of(got, "id", "response_time_sec")) == expected


def test_reply_times_skip_nothing(chats):
    frame = chats(
        [
            (1, 1, "2024-01-01 10:00:00", "q", "a"),
            (2, 1, "2024-01-01 10:00:10", "q", None),
            (3, 1, "2024-01-01 10:00:30", None, "a"),
            (4, 1, "2024-01-01 10:01:00", None, "a"),
        ]
    )
    assert sorted(rows_of(engagement.reply_times(frame), "id", "response_time_sec")) == [(1, None), (2, 20.0), (3, None), (4, None)]
    # Row 2 has no answer, so the next answered row after 1 is 3.
    assert rows_of(engagement.response_times(frame), "id", "response_time_sec") == [(1, 30.0)]
    assert rows_of(engagement.avg_response_time(frame.filter("id > 1"))) == [(None, 0, None)]


def test_equal_times_are_ordered_by_id(chats):
    frame = chats([(2, 1, "2024-01-01 10:00:00", None, "a"), (1, 1, "2024-01-01 10:00:00", "q", None)])
    assert sorted(rows_of(engagement.reply_times(frame), "id", "response_time_sec")) == [(1, 0.0), (2, None)]


times = st.lists(
    st.tuples(st.sampled_from([None, 1, 2]), st.integers(0, 20_000)), min_size=1, max_size=30
)


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(times)
def test_sessions_partition_the_rows(spark, times):
    from colloquy.schema import CHATS

    rows = [(i, c, START + dt.timedelta(seconds=s), "q", None) for i, (c, s) in enumerate(times)]
    frame = spark.createDataFrame(rows, CHATS)
    expected = brute_sessions(rows)
    sessions = rows_of(timeline.session_lengths(frame), "client_id", "session_id", "messages")
    assert sum(m for *_, m in sessions) == len(expected)
    by_id = {r[0]: r[1] for r in rows}
    counted = {}
    for i, (_, s) in expected.items():
        counted[by_id[i], s] = counted.get((by_id[i], s), 0) + 1
    assert {(c, s): m for c, s, m in sessions} == counted
