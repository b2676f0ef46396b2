from __future__ import annotations

import datetime as dt

import pytest
from helpers import rows_of
from pyspark.sql import functions as F

from colloquy.functions import rules
from colloquy.functions.text import normalized, occurrences, words
from colloquy.operators import engagement, filters, names, sentiment, volume
from colloquy.schema import CHATS, conform
from colloquy.sources.tables import write_chats


@pytest.fixture
def sample(chats):
    return chats(
        [
            (1, 1, "2024-12-30 08:00:00", "Flight menu", None),
            (2, 1, "2024-12-30 09:00:00", None, "answer"),
            (3, 2, "2023-01-01 00:00:00", "OPENING HOURS", "both"),
            (4, None, "2023-01-02 00:00:00", None, "lost"),
            (5, None, "2023-01-02 00:00:00", None, None),
            (6, 2, "2023-01-03 00:00:00", "how much", None),
        ]
    )


def test_rules(spark):
    texts = ["Flight menu", "OPENING HOURS", "how much", "Facebook", None, "", "café ouvert", "مرحبا"]
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, question string")
    labelled = rules.with_intent(rules.with_topic(frame)).orderBy("id")
    assert rows_of(labelled, "topic", "intent") == [
        ("Flight Information", "menu"),
        ("Operating Hours", "hours"),
        ("Other", "pricing"),
        ("Other", "booking"),
        ("Other", "other"),
        ("Other", "other"),
        ("Other", "other"),
        ("Other", "other"),
    ]


def test_rules_from_table(spark):
    table = spark.createDataFrame(
        [(2, "b", "y"), (1, "a", "x"), (1, "a", "z")], "priority int, label string, keyword string"
    )
    assert rules.rules_from_table(table) == (("a", ("x", "z")), ("b", ("y",)))
    assert rules.labels_of(rules.TOPIC_RULES, "Other")[-1] == "Other"


def test_sentiment_bins(spark):
    edges = [-1.0, -0.05, -0.0499, 0.0, 0.05, 0.0501, 1.0, None]
    frame = spark.createDataFrame([(i, e) for i, e in enumerate(edges)], "i int, s double")
    got = rows_of(frame.orderBy("i").select(rules.sentiment_category(F.col("s"))))
    assert [g[0] for g in got] == [None, "negative", "neutral", "neutral", "neutral", "positive", "positive", None]


def test_text_functions(spark):
    frame = spark.createDataFrame([("Don't, Zoé! aaa_1",), (None,)], "t string")
    got = rows_of(frame.select(normalized(F.col("t")), words(F.col("t")), occurrences(F.col("t"), "aa")))
    assert got == [("dont zoé aaa_1", ["don", "zoé", "aaa_1"], 1), ("", [], None)]


def test_day_week_month(sample):
    days = dict(rows_of(volume.messages_per_day(sample)))
    assert days == {
        dt.date(2024, 12, 30): 1,
        dt.date(2023, 1, 1): 1,
        dt.date(2023, 1, 2): 0,
        dt.date(2023, 1, 3): 1,
    }
    weeks = {(y, w): n for y, w, n in rows_of(volume.messages_per_week(sample))}
    assert weeks == {(2024, 1): 1, (2023, 52): 1, (2023, 1): 1}
    iso = {(y, w): n for y, w, n in rows_of(volume.messages_per_week(sample, iso_year=True))}
    assert iso == {(2025, 1): 1, (2022, 52): 1, (2023, 1): 1}
    assert rows_of(volume.messages_per_month(sample), "year_month", "message_count") == [("2023-Jan", 2), ("2024-Dec", 1)]


def test_topics(sample):
    frame = rules.with_topic(sample)
    assert rows_of(volume.messages_per_topic(frame)) == [
        ("Other", 4), ("Flight Information", 1), ("Operating Hours", 1)
    ]
    shares = {t: p for t, _, p in rows_of(volume.topic_performance(frame))}
    assert shares == {"Other": 66.67, "Flight Information": 16.67, "Operating Hours": 16.67}
    assert volume.underrepresented_topics(frame, below=20).count() == 2
    proxy = {t: (a, u) for t, a, u in rows_of(engagement.satisfaction_proxy(frame))}
    assert proxy == {"Other": (1.0, 2), "Flight Information": (1.0, 1), "Operating Hours": (1.0, 1)}


def test_percentages_round_half_even(spark):
    frame = spark.range(800).select(F.when(F.col("id") == 0, "rare").otherwise("usual").alias("topic"))
    assert dict(rows_of(volume.topic_performance(frame), "topic", "percentage"))["rare"] == 0.12


def test_users_and_names(sample, clients):
    people = clients([(1, "Mary Ann"), (2, "Mary Ann"), (3, "Bob"), (4, None)])
    assert rows_of(volume.messages_per_user(sample)) == [(1, 2), (2, 2)]
    assert rows_of(volume.top_users(sample, people)) == [("Mary Ann", 4)]
    assert rows_of(engagement.user_engagement(sample, people), "client_id", "message_count", "active_days", "name") == [
        (2, 2, 2, "Mary Ann"), (1, 1, 1, "Mary Ann")
    ]
    assert rows_of(filters.user_options(people)) == [("Bob",), ("Mary Ann",)]


def test_duplicate_client_raises(sample, clients):
    with pytest.raises(Exception, match="not unique"):
        engagement.user_engagement(sample, clients([(1, "a"), (1, "b")])).collect()


def test_names_on_rows(sample, clients, monkeypatch):
    people = clients([(1, "Ann"), (2, "Bob")])
    expected = {1: "Ann", 2: "Ann", 3: "Bob", 4: None, 5: None, 6: "Bob"}
    assert dict(rows_of(names.with_names_on_rows(sample, people), "id", "name")) == expected
    monkeypatch.setattr(names, "small_enough", lambda table: False)
    assert dict(rows_of(names.with_names_on_rows(sample, people), "id", "name")) == expected
    assert dict(rows_of(names.with_names_on_rows(sample, people, max_rows=1), "id", "name")) == expected


def test_drop_off(sample, chats):
    # Bot rows: 2 (last of client 1) and 4 (no client).
    assert rows_of(engagement.drop_off_rate(sample)) == [(2, 2, 100.0)]
    more = sample.unionByName(chats([(7, 1, "2024-12-31 00:00:00", "x", None)]))
    assert rows_of(engagement.drop_off_rate(more)) == [(2, 1, 50.0)]
    assert rows_of(engagement.drop_off_rate(sample.filter("question IS NOT NULL"))) == [(0, 0, 0.0)]


def test_turns(sample):
    assert sorted(rows_of(engagement.turns(sample))) == [(1, 2, 1, 1), (2, 2, 2, 1)]
    assert rows_of(engagement.mean_turns(sample)) == [(2.0, 1.5, 1.0)]


def test_features_and_labels(sample, clients, spark):
    frame = rules.with_topic(sample)
    mood = spark.createDataFrame([(1, 0.5), (2, -0.5)], "client_id long, avg_sentiment double")
    for limit in (1, 100):
        got = engagement.user_behavior(frame, clients([(1, "Ann")]), mood, max_rows=limit)
        assert sorted(rows_of(got)) == [
            (1, 2, 1, 11.0, 3600.0, 2, 2, 0.5, "Ann"),
            (2, 2, 2, 10.5, 0.0, 2, 2, -0.5, None),
        ]
    features = engagement.satisfaction_features(frame, mood)
    got = {r["client_id"]: r for r in features.collect()}
    assert (got[1].sessions, got[1].questions, got[1].engagement_diversity, got[1].session_length) == (2, 1, 2.0, 1.0)
    silent = engagement.satisfaction_features(frame.filter("question IS NULL"), mood)
    assert rows_of(silent, "engagement_diversity") == [(None,)]
    assert set(rows_of(engagement.with_satisfaction(features), "satisfaction")) == {("low",)}


def test_label_limits(spark):
    frame = spark.createDataFrame(
        [(3, 59.0, 6.0), (3, 60.0, 6.0), (1, 10.0, 6.0), (2, 301.0, 6.0), (2, 300.0, 2.0), (5, 1.0, 1.9)],
        "conversation_turns int, avg_response_time double, session_length double",
    )
    got = [r[0] for r in rows_of(engagement.with_satisfaction(frame), "satisfaction")]
    assert got == ["high", "medium", "low", "low", "medium", "low"]


def test_filters(sample, clients):
    people = clients([(1, "Ann"), (2, "Bob")])
    frame = rules.with_topic(sample).withColumn("question_sentiment_category", F.lit("neutral"))

    def ids(**choice):
        chosen = filters.Filters("2023-01-01", "2024-12-30", **choice)
        return sorted(r[0] for r in rows_of(filters.apply_filters(frame, people, chosen), "id"))

    assert ids() == [1, 2, 3, 4, 5, 6]
    assert ids(users=["Bob"]) == [3, 6]
    assert ids(topics=["Other"], users=["Ann", "Bob"]) == [2, 6]
    assert ids(sentiments=["positive"]) == []
    short = filters.Filters("2023-01-02", "2023-01-02")
    assert filters.apply_filters(frame, people, short).count() == 2
    named = frame.withColumn("name", F.lit("Zoé"))
    assert filters.apply_filters(named, people, filters.Filters("2023-01-01", "2024-12-30", users=["Zoé"])).count() == 6
    assert rows_of(filters.topic_options(frame)) == [("Flight Information",), ("Operating Hours",), ("Other",)]


def test_date_filter_reaches_the_scan(sample, clients, tmp_path, spark, capsys):
    sample.write.parquet(f"{tmp_path}/chats")
    frame = spark.read.parquet(f"{tmp_path}/chats")
    filters.apply_filters(frame, clients([(1, "a")]), filters.Filters("2023-01-01", "2023-01-02")).explain()
    plan = capsys.readouterr().out
    assert "GreaterThanOrEqual(created_at" in plan and "LessThan(created_at" in plan


def test_dates_prune_partitions(sample, clients, tmp_path, spark, capsys):
    write_chats(sample, f"{tmp_path}/chats")
    chosen = filters.Filters("2023-01-02", "2023-01-03")
    got = filters.apply_filters(spark.read.parquet(f"{tmp_path}/chats"), clients([(1, "a")]), chosen)
    assert sorted(r[0] for r in rows_of(got, "id")) == [4, 5, 6]
    got.explain()
    assert "PartitionFilters: [isnotnull(date" in capsys.readouterr().out


def test_filters_score_the_chosen_rows(sample, clients, spark):
    lexicon = spark.createDataFrame([("much", 3.0)], "term string, valence double")
    chosen = filters.Filters("2023-01-01", "2024-12-30", sentiments=("positive",))
    got = filters.apply_filters(sample, clients([(2, "Bob")]), chosen, lexicon=lexicon)
    assert rows_of(got, "id", "name") == [(6, "Bob")]


def test_contract(spark):
    frame = spark.createDataFrame([(1, 2, "2024-01-01 10:00:00", "q", None, "x")], "id int, client_id int, created_at string, question string, answer string, extra string")
    checked = conform(frame, CHATS)
    assert checked.schema["created_at"].dataType == CHATS["created_at"].dataType
    assert checked.columns[-1] == "extra"
    with pytest.raises(ValueError, match="answer"):
        conform(frame.drop("answer"), CHATS)
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        conform(frame.withColumn("created_at", F.lit("never")), CHATS).collect()


def test_bounds(sample):
    assert rows_of(volume.data_bounds(sample)) == [(dt.date(2023, 1, 1), dt.date(2024, 12, 30), 6)]


def test_all_labels_count_however_many(spark, clients):
    rows = [(k, 1, None, "q", None, f"topic {k}") for k in range(70)]
    frame = spark.createDataFrame(rows, "id long, client_id long, created_at timestamp_ntz, question string, answer string, topic string")
    mood = spark.createDataFrame([(1, 0.5)], "client_id long, avg_sentiment double")
    assert engagement.user_behavior(frame, clients([(1, "Ann")]), mood).first().unique_topics == 70


def test_sentiment_keeps_rows_of_null_and_repeated_ids(spark):
    rows = [(None, "good"), (1, "good"), (1, "bad"), (1, "bad"), (2, None)]
    frame = spark.createDataFrame([(i, q, None) for i, q in rows], "id long, question string, answer string")
    got = sentiment.with_sentiment(frame, sentiment.lexicon_table(spark))
    scores = {q: s for q, s in rows_of(got, "question", "question_sentiment")}
    assert got.count() == 5 and scores["good"] > 0 > scores["bad"] and scores[None] == 0
