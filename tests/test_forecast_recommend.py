from __future__ import annotations

import datetime as dt

import numpy as np
import pytest
from helpers import rows_of
from pyspark.sql import functions as F

from colloquy.operators import forecast, recommend

FIRST = dt.datetime(2024, 1, 1)


def daily_chats(chats, days, per_day=lambda d: 3, start=0):
    rows, i = [], start
    for d in range(days):
        for _ in range(per_day(d)):
            rows.append((i, 1, FIRST + dt.timedelta(days=d, minutes=i % 60), "q", None))
            i += 1
    return chats(rows)


def test_lags_are_rows(chats):
    frame = daily_chats(chats, 10, lambda d: d + 1).filter("to_date(created_at) <> date'2024-01-05'")
    got = rows_of(
        forecast.forecast_features(forecast.daily_volume(frame)).orderBy("date"),
        "date", "volume", "lag_1", "lag_2", "lag_3", "lag_7", "day_of_week", "is_weekend", "month", "day_of_month",
    )
    assert got == [
        (dt.date(2024, 1, 9), 9, 8, 7, 6, 1, 1, 0, 1, 9),
        (dt.date(2024, 1, 10), 10, 9, 8, 7, 2, 2, 0, 1, 10),
    ]


def test_too_few_days_give_no_forecast(chats):
    history, future = forecast.forecast_volume(daily_chats(chats, 16), trees=5)
    assert history.count() == 0 and future.count() == 0
    assert future.columns == ["date", "predicted_volume"]


def test_forecast(chats):
    frame = daily_chats(chats, 17)
    history, future = forecast.forecast_volume(frame, trees=5)
    assert history.count() == 10
    assert rows_of(future.orderBy("date")) == [(dt.date(2024, 1, 18 + i), 3) for i in range(7)]
    both = forecast.history_and_forecast(history, future)
    assert sorted(rows_of(both.groupBy("type").count())) == [("Forecast", 7), ("Historical", 10)]
    dates = forecast.forecast_dates(forecast.daily_volume(frame), days=2)
    assert sorted(rows_of(dates)) == [(dt.date(2024, 1, 18),), (dt.date(2024, 1, 19),)]


def test_forecast_uses_its_own_predictions(chats):
    """Weekly pattern: with right lags the model can continue it."""
    frame = daily_chats(chats, 42, lambda d: 20 if d % 7 == 3 else 2)
    _, future = forecast.forecast_volume(frame, trees=30)
    got = [v for _, v in rows_of(future.orderBy("date"))]
    assert got[3] > 12 and all(v < 9 for i, v in enumerate(got) if i != 3)


def test_many_series(chats):
    long = daily_chats(chats, 20).withColumn("topic", F.lit("a"))
    other = daily_chats(chats, 20, lambda d: 9, start=1000).withColumn("topic", F.lit("b"))
    short = daily_chats(chats, 12, start=5000).withColumn("topic", F.lit("c"))
    history, future = forecast.forecast_volume(
        long.unionByName(other).unionByName(short), by=("topic",), trees=10
    )
    got = sorted(rows_of(future.groupBy("topic").agg(F.count("*"), F.max("predicted_volume"))))
    assert got == [("a", 7, 3), ("b", 7, 9), ("c", 7, got[2][2])] and got[2][2] is not None
    assert {r[0] for r in rows_of(history, "topic")} == {"a", "b", "c"}
    few = daily_chats(chats, 5, start=9000).withColumn("topic", F.lit("d"))
    _, future = forecast.forecast_volume(long.unionByName(few), by=("topic",), trees=5)
    assert sorted(rows_of(future.groupBy("topic").agg(F.count("*"), F.count("predicted_volume")))) == [("a", 7, 7), ("d", 7, 0)]


@pytest.fixture
def topical(spark):
    rng = np.random.default_rng(5)
    rows = [(int(c), str(t)) for c, t in zip(rng.integers(0, 12, 300), rng.choice(["x", "y", "z"], 300, p=[0.5, 0.3, 0.2]))]
    return spark.createDataFrame([*rows, (None, "x")], "client_id long, topic string")


def matrix_of(frame):
    data = frame.toPandas().dropna()
    return data.groupby(["client_id", "topic"]).size().unstack(fill_value=0)


def test_similarities_equal_pandas(topical, spark):
    expected = matrix_of(topical)
    columns = ["x", "y", "z"]
    got = {r.client_id: [r.x, r.y, r.z] for r in recommend.client_topic_matrix(topical, columns).collect()}
    assert got == {int(c): list(row) for c, row in zip(expected.index, expected[columns].to_numpy())}
    for a, b, r in rows_of(recommend.topic_similarity(topical, columns)):
        assert r == pytest.approx(expected.corr().loc[a, b])
    by_client = expected.T.corr()
    top = rows_of(recommend.top_client_similarity(topical, n=4))
    assert len(top) == 6
    for a, b, r in top:
        assert r == pytest.approx(by_client.loc[a, b])
    pairs = spark.createDataFrame([(0, 1), (3, 11)], "client_a long, client_b long")
    profiles = recommend.client_topic_profiles(topical, columns)
    for a, b, r in rows_of(recommend.similarity_of(pairs, profiles), "client_a", "client_b", "correlation"):
        assert r == pytest.approx(by_client.loc[a, b])


def test_constant_topic_has_no_similarity(spark):
    frame = spark.createDataFrame([(1, "x"), (2, "x"), (2, "y")], "client_id long, topic string")
    assert rows_of(recommend.topic_similarity(frame, ["x", "y"])) == [("x", "y", None)]


def test_recommendations(spark):
    frame = spark.createDataFrame(
        [("An ERROR, error!", "Other"), ("what is the price", "Integration"), (None, "Other"), ("api api", "Other")],
        "question string, topic string",
    )
    assert rows_of(recommend.recommend_topics(frame, n=3)) == [
        ("Technical Support", 2), ("Product Information", 1), ("Pricing & Billing", 1)
    ]
    assert rows_of(recommend.keyword_scores(frame), "score") == [(2,), (1,), (1,), (0,), (2,)]


def test_topics_outside_the_domain_raise(spark):
    rows = spark.createDataFrame([(1, "a"), (1, "b"), (2, None)], "client_id long, topic string")
    with pytest.raises(Exception, match="outside the domain: b"):
        recommend.client_topic_matrix(rows, ["a"]).collect()
    assert recommend.client_topic_matrix(rows).columns == ["client_id", "a", "b"]
