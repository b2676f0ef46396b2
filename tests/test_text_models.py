from __future__ import annotations

import math
import random

import pytest
from helpers import rows_of
from pyspark.sql import functions as F

from colloquy.operators import clustering, evaluation, intent, satisfaction, sentiment, tfidf
from colloquy.functions.rules import with_intent

LEXICON = [("good", 2.0), ("bad", -2.0), ("fine", 0.5)]


def norm(s):
    return round(s / math.sqrt(s * s + 15), 4)


CASES = [
    ("good", 2.0),
    ("not good", -1.48),
    ("this isn't good", -1.48),
    ("very good", 2.293),
    ("very bad", -2.293),
    ("barely good", 1.707),
    ("very x good", 2.0 + 0.293 * 0.95),
    ("very x y good", 2.0 + 0.293 * 0.9),
    ("very x y z good", 2.0),
    ("not very good", (2.0 + 0.293) * -0.74),
    ("good but bad", 2.0 * 0.5 - 2.0 * 1.5),
    ("GOOD stuff", 2.733),
    ("GOOD STUFF", 2.0),
    ("good!!", 2.0 + 2 * 0.292),
    ("good!!!!!!", 2.0 + 4 * 0.292),
    ("bad??", -2.0 - 0.36),
    ("bad?????", -2.96),
    ("nothing here!!", 0.0),
    ("", 0.0),
    (None, 0.0),
]


def test_sentiment_rules(spark):
    frame = spark.createDataFrame([(i, t, t) for i, (t, _) in enumerate(CASES)], "id long, question string, answer string")
    lexicon = sentiment.lexicon_table(spark, LEXICON)
    got = {r.id: r for r in sentiment.score_texts(frame, lexicon).collect()}
    for i, (text, raw) in enumerate(CASES):
        expected = norm(raw) if raw else 0.0
        assert got[i].question_sentiment == pytest.approx(expected, abs=1e-4), text
        assert got[i].answer_sentiment == got[i].question_sentiment


def test_sentiment_of_long_text_uses_all_of_it(spark):
    frame = spark.createDataFrame([(1, "word " * 30_000 + "good")], "id long, question string")
    lexicon = sentiment.lexicon_table(spark, LEXICON)
    assert rows_of(sentiment.score_texts(frame, lexicon, ("question",))) == [(1, norm(2.0))]


def test_sentiment_tables(spark, chats):
    frame = chats([(1, 1, "2024-01-01 10:00:00", "good", None), (2, 1, "2024-01-01 11:00:00", "bad bad", "fine"), (3, None, "2024-01-01 12:00:00", None, "x")])
    lexicon = sentiment.lexicon_table(spark, LEXICON)
    scored = sentiment.with_sentiment(frame, lexicon)
    assert sorted(rows_of(scored, "id", "question_sentiment_category", "answer_sentiment_category")) == [
        (1, "positive", "neutral"), (2, "negative", "positive"), (3, "neutral", "neutral")
    ]
    assert rows_of(sentiment.sentiment_distribution(scored.filter("id < 3"))) == [("negative", 1), ("positive", 1), ("neutral", 0)]
    assert rows_of(sentiment.sentiment_by_client(frame, lexicon)) == [(1, pytest.approx((norm(2.0) + norm(-4.0)) / 2))]
    assert sentiment.sentiment_over_time(scored).columns == ["created_at", "question_sentiment", "question_sentiment_category"]


DOCS = ["the cat sat", "the cat and the dog", "a dog dog dog", "", None]


def test_tfidf_by_hand(spark):
    frame = spark.createDataFrame(list(enumerate(DOCS)), "id long, question string")
    model = tfidf.fit_tfidf(frame, max_features=3, stop_words=("and",))
    vocabulary = {r.term: r for r in model.vocabulary.collect()}
    assert {t: (r.occurrences, r.documents) for t, r in vocabulary.items()} == {"cat": (2, 2), "dog": (4, 2), "the": (3, 2)}
    idf = math.log(6 / 3) + 1
    assert vocabulary["cat"].idf == pytest.approx(idf)
    got = {(i, t): w for i, t, w in rows_of(model.weights(frame))}
    length = math.sqrt(1 + 4 + 1)
    assert got == {
        (0, "cat"): pytest.approx(1 / math.sqrt(2)),
        (0, "the"): pytest.approx(1 / math.sqrt(2)),
        (1, "cat"): pytest.approx(1 / length),
        (1, "dog"): pytest.approx(1 / length),
        (1, "the"): pytest.approx(2 / length),
        (2, "dog"): pytest.approx(1.0),
    }
    with pytest.raises(ValueError):
        tfidf.fit_tfidf(frame.filter("id > 2"))


def test_topic_clusters_find_planted_groups(spark):
    groups = [["flight", "gate", "plane"], ["pizza", "menu", "soup"]]
    rng = random.Random(1)
    rows = [(i, " ".join(rng.choices(groups[i % 2], k=6))) for i in range(40)]
    frame = spark.createDataFrame(rows, "id long, question string")
    found = clustering.cluster_topics(frame, n_clusters=2, max_features=50)
    labels = rows_of(found.assignments())
    sides = {}
    for i, cluster, x, y in labels:
        sides.setdefault(i % 2, set()).add(cluster)
    assert len(labels) == 40 and sorted(map(len, sides.values())) == [1, 1]
    centre = found.assignments().agg(F.avg("pca_x"), F.avg("pca_y")).first()
    assert abs(centre[0]) < 1e-9 and abs(centre[1]) < 1e-9
    terms = {}
    for cluster, term in rows_of(found.top_terms(3), "topic_cluster", "term"):
        terms.setdefault(cluster, set()).add(term)
    assert sorted(map(sorted, terms.values())) == sorted(map(sorted, groups))
    assert found.silhouette() > 0.5


def test_segments(spark):
    rows = [(i, float(i % 2 * 100 + i % 3), 5.0, 1.0, 1.0, 1.0, 1.0) for i in range(20)]
    columns = ", ".join(f"{f} double" for f in clustering.SEGMENT_FEATURES)
    frame = spark.createDataFrame(rows, f"client_id long, {columns}")
    found = clustering.segment_users(frame)
    assert set(found.scores) == {2, 3, 4, 5}
    pairs = {(c % 2, s) for c, s in rows_of(found.users, "client_id", "segment")}
    if max(found.scores, key=found.scores.get) == 2:
        assert len(pairs) == 2
    assert found.profiles().count() == len({s for _, s in pairs})
    assert {"pca_x", "pca_y"} <= set(found.users.columns)
    single = clustering.segment_users(frame.limit(2))
    assert set(rows_of(single.users, "segment")) == {(0,)} and single.scores == {}


def test_scaling_uses_the_population_deviation(spark):
    frame = spark.createDataFrame([(1.0, 7.0), (3.0, 7.0)], "a double, b double")
    scaled = evaluation.fit_scaling(frame, ["a", "b"]).transform(frame)
    assert sorted(rows_of(scaled)) == [(-1.0, 0.0), (1.0, 0.0)]


def test_split_and_encoding(spark):
    frame = spark.range(2000).select("id", evaluation.in_test_set("id").alias("t"))
    share = frame.filter("t").count() / 2000
    assert 0.16 < share < 0.24
    again = spark.range(2000).repartition(7).select("id", evaluation.in_test_set("id").alias("t"))
    assert sorted(rows_of(frame)) == sorted(rows_of(again))
    labels = spark.createDataFrame([("b",), ("a",), (None,), ("b",)], "l string")
    coded = evaluation.encode_labels(labels, "l", "code")
    assert sorted(rows_of(coded), key=str) == [("a", 0), ("b", 1), ("b", 1), (None, None)]


def test_report_by_hand(spark):
    pairs = [("a", "a")] * 3 + [("a", "b")] + [("b", "b")] + [("b", "c")]
    frame = spark.createDataFrame(pairs, "actual string, predicted string")
    got = {r[0]: r[1:] for r in rows_of(evaluation.classification_report(frame, "actual", "predicted"))}
    assert got["a"] == (1.0, 0.75, pytest.approx(6 / 7), 4)
    assert got["b"] == (0.5, 0.5, 0.5, 2)
    assert got["c"] == (0.0, 0.0, 0.0, 0)
    assert got["accuracy"] == (pytest.approx(4 / 6),) * 3 + (6,)
    assert got["weighted avg"][0] == pytest.approx((4 * 1.0 + 2 * 0.5) / 6)


def test_intent_model(chats):
    rng = random.Random(3)
    words = ["book", "price", "open", "dish", "refund", "hello"]
    rows = [(i, 1, "2024-01-01 10:00:00", f"{words[i % 6]} please {rng.choice('xyz')}{rng.choice('xyz')}", None) for i in range(90)]
    frame = chats(rows)
    model = intent.train_intent_model(frame, trees=20, max_depth=5)
    report = {r[0]: r for r in rows_of(model.report(frame))}
    assert report["accuracy"][1] > 0.9
    hybrid = model.hybrid(frame)
    assert hybrid.count() == 90
    assert hybrid.filter("intent <> 'other' AND hybrid_intent <> intent").count() == 0
    assert hybrid.filter("intent = 'other' AND hybrid_intent <> predicted_intent").count() == 0
    assert rows_of(with_intent(frame).select("intent").distinct().agg(F.count("*"))) == [(6,)]


def features(spark, n):
    rows = [(i, "high" if i % 2 else "low", i % 2 * 10, 1, 0.1, 1.0, 0.5, float(i % 2), 1.0, i % 2 * 10) for i in range(n)]
    return spark.createDataFrame(
        rows,
        "client_id long, satisfaction string, questions long, topics long, avg_sentiment double, "
        "avg_messages_per_session double, engagement_diversity double, avg_response_time double, "
        "session_length double, conversation_turns long",
    )


def test_satisfaction_model(spark):
    assert satisfaction.train_satisfaction_model(features(spark, 9)) is None
    frame = features(spark, 40)
    model = satisfaction.train_satisfaction_model(frame, trees=10)
    assert model.accuracy() == 1.0
    weights = rows_of(model.importances)
    assert sum(w for _, w in weights) == pytest.approx(1.0)
    assert weights == sorted(weights, key=lambda r: -r[1]) and len(weights) == 8
    assert {r[0] for r in rows_of(model.report())} >= {"accuracy", "macro avg", "weighted avg"}
    same = satisfaction.train_satisfaction_model(frame, trees=10)
    assert rows_of(same.importances) == weights


def test_clusters_have_no_stop_words_by_default(spark):
    rows = [(k, f"the {a} of the {b} and with that {a}") for k, (a, b) in enumerate([("flight", "gate"), ("menu", "food"), ("hotel", "room")] * 4)]
    clusters = clustering.cluster_topics(spark.createDataFrame(rows, "id long, question string"), n_clusters=3)
    terms = {r.term for r in clusters.top_terms().select("term").collect()}
    assert terms <= {"flight", "gate", "menu", "food", "hotel", "room"} and terms


def test_text_count_comes_from_the_term_pass(spark):
    rows = spark.createDataFrame([(1, "aa bb"), (2, None), (3, "")], "id long, question string")
    model = tfidf.fit_tfidf(rows)
    assert [round(r.idf, 9) for r in model.vocabulary.collect()] == [round(math.log(4 / 2) + 1, 9)] * 2
