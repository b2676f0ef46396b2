"""Every operator as a query over the given tables."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.rules import label_by_rules, with_sender, with_topic
from ..functions.text import normalized
from ..operators import (
    cleaning,
    clustering,
    engagement,
    evaluation,
    filters,
    forecast,
    intent,
    keywords,
    profiling,
    recommend,
    satisfaction,
    sentiment,
    tfidf,
    timeline,
    volume,
)
from ..session import new_folder
from ..sources import adapters, increments
from ..sources.tables import read_source, register_views, stream_source
from ..streaming import reports as streaming
from ..streaming import sessions as streaming_session_numbers
from . import dashboard
from . import fixtures as fx

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(build: Query) -> Query:
    QUERIES[build.__name__] = build
    return build


def rounded(frame: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return frame.withColumns({c: F.round(c, digits) for c in columns})


def events(spark, folder):
    return adapters.event_chats(spark, folder)


def topics(spark, folder):
    return with_topic(events(spark, folder), fx.TOPICS, fx.TOPIC_DEFAULT)


def clients(spark, folder):
    return adapters.customer_clients(spark, folder)


def lexicon(spark):
    return sentiment.lexicon_table(spark, fx.LEXICON)


# Volume


@query
def messages_per_day(spark, folder):
    return volume.messages_per_day(events(spark, folder))


@query
def messages_per_week(spark, folder):
    return volume.messages_per_week(events(spark, folder))


@query
def messages_per_iso_week(spark, folder):
    return volume.messages_per_week(events(spark, folder), iso_year=True)


@query
def messages_per_month(spark, folder):
    return volume.messages_per_month(events(spark, folder))


@query
def messages_per_topic(spark, folder):
    return volume.messages_per_topic(topics(spark, folder))


@query
def messages_per_user(spark, folder):
    return volume.messages_per_user(events(spark, folder))


@query
def top_users(spark, folder):
    return volume.top_users(events(spark, folder), clients(spark, folder))


@query
def topic_performance(spark, folder):
    return volume.topic_performance(topics(spark, folder))


@query
def underrepresented_topics(spark, folder):
    return volume.underrepresented_topics(topics(spark, folder), below=25.0)


@query
def data_bounds(spark, folder):
    return volume.data_bounds(events(spark, folder))


# Sessions, responses and engagement


@query
def client_overview(spark, folder):
    return rounded(dashboard.client_overview(events(spark, folder), clients(spark, folder)), "mean_session_min")


@query
def user_engagement(spark, folder):
    return engagement.user_engagement(events(spark, folder), clients(spark, folder))


@query
def sessionized_chats(spark, folder):
    rows = timeline.sessionize(events(spark, folder))
    return rounded(rows.drop("question", "answer"), "gap", digits=9)


@query
def session_lengths(spark, folder):
    return rounded(timeline.session_lengths(events(spark, folder)), "session_length_min", digits=9)


@query
def avg_session_length(spark, folder):
    return rounded(timeline.avg_session_length(events(spark, folder)), "avg_session_length_min")


@query
def senders(spark, folder):
    return with_sender(events(spark, folder)).select("id", "sender")


@query
def drop_off_rate(spark, folder):
    return rounded(engagement.drop_off_rate(events(spark, folder)), "drop_off_rate")


@query
def response_times(spark, folder):
    return rounded(engagement.response_times(events(spark, folder)), "response_time_sec")


@query
def response_time(spark, folder):
    averages = engagement.avg_response_time(events(spark, folder))
    return rounded(averages, "avg_response_time_sec", "avg_response_time_min")


@query
def reply_times(spark, folder):
    return rounded(engagement.reply_times(events(spark, folder)), "response_time_sec")


@query
def turns(spark, folder):
    return engagement.turns(events(spark, folder))


@query
def mean_turns(spark, folder):
    means = engagement.mean_turns(events(spark, folder))
    return rounded(means, *means.columns)


@query
def satisfaction_proxy(spark, folder):
    return rounded(engagement.satisfaction_proxy(topics(spark, folder)), "avg_messages_per_conversation")


def _behavior(spark, folder):
    chats = topics(spark, folder)
    return engagement.user_behavior(
        chats,
        clients(spark, folder),
        sentiment.sentiment_by_client(chats, lexicon(spark)),
    )


@query
def user_behavior(spark, folder):
    behavior = rounded(_behavior(spark, folder), "avg_message_length", "avg_response_time", digits=4)
    return rounded(behavior, "avg_sentiment", digits=10)


def _satisfaction(spark, folder):
    chats = topics(spark, folder)
    return engagement.satisfaction_features(
        chats, sentiment.sentiment_by_client(chats, lexicon(spark))
    )


@query
def satisfaction_features(spark, folder):
    features = rounded(
        _satisfaction(spark, folder),
        "span_hours",
        "avg_messages_per_session",
        "engagement_diversity",
        "avg_response_time",
        "session_length",
        digits=4,
    )
    return rounded(features, "avg_sentiment", digits=10)


@query
def satisfaction_labels(spark, folder):
    labelled = engagement.with_satisfaction(_satisfaction(spark, folder), fx.LIMITS)
    return labelled.select("client_id", "satisfaction")


# Filters


@query
def filtered_chats(spark, folder):
    return filters.apply_filters(
        topics(spark, folder), clients(spark, folder), fx.FILTERS, lexicon=lexicon(spark)
    )


@query
def user_chats(spark, folder):
    """The chats of some users, by name, in a range of days."""
    return filters.apply_filters(topics(spark, folder), clients(spark, folder), fx.USER_FILTERS, lexicon=lexicon(spark))


@query
def filter_options(spark, folder):
    users = filters.user_options(clients(spark, folder)).select(F.lit("user").alias("kind"), F.col("name").alias("value"))
    names = filters.topic_options(topics(spark, folder)).select(
        F.lit("topic").alias("kind"), F.col("topic").alias("value")
    )
    return users.unionByName(names)


# Sources, cleaning and profiles


@query
def custom_query(spark, folder):
    register_views(spark, {"chats": events(spark, folder), "clients": clients(spark, folder)})
    return read_source(spark, query=fx.CUSTOM_QUERY)


@query
def clean_names(spark, folder):
    names = adapters.all_names(spark, folder)
    steps = [step for step in cleaning.CLEANING["clients"] if step[0] != "rename"]
    return cleaning.clean(names, steps)


@query
def clean_tables(spark, folder):
    tables = {name: read_source(spark, name, folder=folder) for name in fx.CLEANING}
    cleaned = cleaning.drop_empty_tables(cleaning.clean_tables(tables, fx.CLEANING))
    supplier = cleaned["supplier"].select(F.lit("supplier").alias("source"), F.col("supplier_id").alias("key"), F.col("s_name").alias("name"))
    customer = cleaned["customer"].select(F.lit("customer").alias("source"), F.col("client_id").alias("key"), "name")
    part = cleaned["part"].select(F.lit("part").alias("source"), F.col("part_id").alias("key"), F.col("p_name").alias("name"))
    return supplier.unionByName(customer).unionByName(part)


PROFILED = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "conversations", "documents",
    "labels", "pages", "benchmark", "embeddings",
)


@query
def table_profile(spark, folder):
    profiles = [profiling.profile_table(read_source(spark, name, folder=folder), name, exact=True) for name in PROFILED]
    return reduce(DataFrame.unionByName, profiles)


@query
def column_top_values(spark, folder):
    tops = [profiling.top_values(read_source(spark, name, folder=folder), name) for name in PROFILED]
    return reduce(DataFrame.unionByName, tops)


@query
def column_quartiles(spark, folder):
    return profiling.quartiles({name: read_source(spark, name, folder=folder) for name in PROFILED})


# Labels, sentiment and text


@query
def topic_labels(spark, folder):
    return topics(spark, folder).select("id", "topic")


@query
def intent_labels(spark, folder):
    return adapters.document_texts(spark, folder).select(
        "id", label_by_rules("question", fx.INTENTS, fx.INTENT_DEFAULT).alias("intent")
    )


@query
def sentiment_scores(spark, folder):
    texts = adapters.document_texts(spark, folder)
    scores = sentiment.score_texts(texts, lexicon(spark), ("question",), modifiers=fx.MODIFIERS)
    return sentiment.with_categories(scores)


@query
def conversation_sentiment(spark, folder):
    chats = adapters.conversation_chats(spark, folder)
    scores = sentiment.score_texts(chats, lexicon(spark), modifiers=fx.MODIFIERS)
    return sentiment.with_categories(scores)


@query
def sentiment_distribution(spark, folder):
    return sentiment.sentiment_distribution(sentiment_scores(spark, folder))


@query
def sentiment_over_time(spark, folder):
    return sentiment.sentiment_over_time(filtered_chats(spark, folder))


@query
def term_weights(spark, folder):
    texts = adapters.document_texts(spark, folder)
    fitted = tfidf.fit_tfidf(texts, max_features=1000, stop_words=fx.STOP_WORDS)
    return rounded(fitted.weights(texts), "weight")


def keyword_rules(spark, folder):
    """Every word and pair of words of the benchmark, in alphabetical order, under seven labels."""
    words = F.filter(F.split(F.lower("text"), "\\s+"), lambda w: w != "")
    split = read_source(spark, "benchmark", folder=folder).select(words.alias("w"))
    pairs = F.when(F.size("w") > 1, F.zip_with(F.slice("w", F.lit(1), F.size("w") - 1), F.slice("w", F.lit(2), F.size("w") - 1), lambda a, b: F.concat_ws(" ", a, b)))
    listed = split.select(F.explode(F.concat("w", F.coalesce(pairs, F.array().cast("array<string>")))).alias("keyword")).distinct()
    code = F.conv(F.substring(F.md5("keyword"), 1, 6), 16, 10).cast("long")
    return listed.select(code.alias("priority"), F.concat(F.lit("label "), (code % 7).cast("string")).alias("label"), "keyword")


@query
def keyword_labels(spark, folder):
    texts = adapters.document_texts(spark, folder)
    return keywords.label_by_table(texts, keyword_rules(spark, folder), default="none").select("id", "topic")


@query
def keyword_totals(spark, folder):
    table = keyword_rules(spark, folder).select(F.lit(0).alias("ord"), F.col("label").alias("topic"), "keyword")
    return keywords.scores_by_table(adapters.document_texts(spark, folder), table).select("topic", "score")


# Scaling, encoding, splits, evaluation


@query
def scaled_features(spark, folder):
    behavior = _behavior(spark, folder)
    names = clustering.SEGMENT_FEATURES
    scaled = evaluation.fit_scaling(behavior, names).transform(behavior)
    return rounded(scaled.select("client_id", *names), *names, digits=4)


@query
def encoded_labels(spark, folder):
    table = read_source(spark, "events", folder=folder).select("event_id", "event_type")
    return evaluation.encode_labels(table, "event_type", "code")


@query
def train_test_split(spark, folder):
    return adapters.document_texts(spark, folder).select("id", evaluation.in_test_set("id").alias("in_test"))


@query
def classification_report(spark, folder):
    table = read_source(spark, "labels", folder=folder).select(
        F.when(F.col("quality") == 1, "good").otherwise("poor").alias("actual"),
        F.when(F.col("toxic") == 0, "good").otherwise("poor").alias("predicted"),
    )
    measures = ("precision", "recall", "f1")
    return rounded(evaluation.classification_report(table, "actual", "predicted"), *measures)


# Forecast


@query
def forecast_features(spark, folder):
    return forecast.forecast_features(forecast.daily_volume(events(spark, folder)))


@query
def topic_forecast_features(spark, folder):
    daily = forecast.daily_volume(topics(spark, folder), by=("topic",))
    return forecast.forecast_features(daily, by=("topic",))


@query
def forecast_dates(spark, folder):
    return forecast.forecast_dates(forecast.daily_volume(events(spark, folder)))


@query
def volume_forecast(spark, folder):
    return forecast.forecast_volume(events(spark, folder))[1]


@query
def topic_volume_forecast(spark, folder):
    return forecast.forecast_volume(topics(spark, folder), by=("topic",))[1]


@query
def forecast_union(spark, folder):
    return forecast.history_and_forecast(*forecast.forecast_volume(events(spark, folder)))


# Recommendation


@query
def client_topic_pivot(spark, folder):
    return recommend.client_topic_matrix(topics(spark, folder), fx.TOPIC_NAMES)


@query
def topic_similarity(spark, folder):
    return rounded(recommend.topic_similarity(topics(spark, folder), fx.TOPIC_NAMES), "correlation")


@query
def client_similarity(spark, folder):
    return rounded(recommend.top_client_similarity(topics(spark, folder)), "correlation")


@query
def client_topic_profiles(spark, folder):
    profiles = recommend.client_topic_profiles(topics(spark, folder), fx.TOPIC_NAMES)
    columns = [F.round(F.col("profile")[i], 6).alias(t.lower()) for i, t in enumerate(fx.TOPIC_NAMES)]
    return profiles.select("client_id", *columns)


@query
def word_topic_similarity(spark, folder):
    """Every two of 150 topics, brands and types of parts, over the suppliers as clients."""
    lines = read_source(spark, "lineitem", folder=folder).select(F.col("l_suppkey").alias("client_id"), F.col("l_partkey"))
    parts = read_source(spark, "part", folder=folder).select("p_partkey", F.concat_ws(" ", "p_brand", "p_type").alias("topic"))
    chats = lines.join(parts, F.col("l_partkey") == F.col("p_partkey")).select("client_id", "topic")
    return rounded(recommend.topic_similarity(chats), "correlation")


@query
def nearest_clients(spark, folder):
    """Clients like each other by the days on which they write."""
    days = events(spark, folder).select("client_id", F.to_date("created_at").cast("string").alias("topic"))
    return rounded(recommend.nearest_clients(days), "correlation")


@query
def topic_recommendations(spark, folder):
    texts = adapters.document_texts(spark, folder)
    labelled = texts.withColumn("topic", label_by_rules("question", (("Support", ("hour", "that")),), "Other"))
    return recommend.recommend_topics(labelled, fx.CANDIDATES)


# Models


def _clusters(spark, folder):
    texts = adapters.document_texts(spark, folder)
    return clustering.cluster_topics(texts, stop_words=fx.STOP_WORDS)


@query
def topic_clusters(spark, folder):
    return _clusters(spark, folder).assignments()


@query
def cluster_terms(spark, folder):
    return _clusters(spark, folder).top_terms()


@query
def cluster_quality(spark, folder):
    clusters = _clusters(spark, folder)
    return clusters.assigned.groupBy("topic_cluster").agg(
        F.count(F.lit(1)).alias("members"), F.lit(clusters.silhouette()).alias("silhouette")
    )


@query
def segment_scores(spark, folder):
    scores = clustering.segment_users(_behavior(spark, folder)).scores
    return spark.createDataFrame(sorted(scores.items()), "k long, silhouette double")


@query
def user_segments(spark, folder):
    return clustering.segment_users(_behavior(spark, folder)).users


@query
def segment_profiles(spark, folder):
    return clustering.segment_users(_behavior(spark, folder)).profiles()


def _intents(spark, folder):
    chats = adapters.conversation_chats(spark, folder)
    return intent.train_intent_model(chats, fx.INTENTS, fx.INTENT_DEFAULT), chats


@query
def intent_model(spark, folder):
    model, chats = _intents(spark, folder)
    return model.report(chats)


@query
def hybrid_intent(spark, folder):
    model, chats = _intents(spark, folder)
    return model.hybrid(chats).select("id", "intent", "predicted_intent", "hybrid_intent")


def _satisfaction_model(spark, folder):
    labelled = engagement.with_satisfaction(_satisfaction(spark, folder), fx.LIMITS)
    return satisfaction.train_satisfaction_model(labelled), labelled


@query
def satisfaction_model(spark, folder):
    model, labelled = _satisfaction_model(spark, folder)
    return model.predict(labelled).select("client_id", "satisfaction", "predicted_satisfaction", "in_test")


@query
def satisfaction_report(spark, folder):
    return _satisfaction_model(spark, folder)[0].report()


@query
def feature_importance(spark, folder):
    return _satisfaction_model(spark, folder)[0].importances


# The parts of the models that follow from given assignments, which SQL can check


@query
def given_segment_profiles(spark, folder):
    users = _behavior(spark, folder).withColumn("segment", (F.col("client_id") % 4).cast("int"))
    return rounded(clustering.Segments(users, {}).profiles(), *clustering.SEGMENT_FEATURES, digits=4)


@query
def given_cluster_terms(spark, folder):
    texts = adapters.document_texts(spark, folder)
    fitted = tfidf.fit_tfidf(texts, max_features=1000, stop_words=fx.STOP_WORDS)
    assigned = fitted.vectors(texts).withColumn("topic_cluster", (F.col("id") % 3).cast("int"))
    return rounded(clustering.TopicClusters(assigned, fitted.vocabulary, None).top_terms(), "weight")


@query
def given_forecast_union(spark, folder):
    daily = forecast.daily_volume(topics(spark, folder), by=("topic",))
    future = forecast.forecast_dates(daily, by=("topic",)).withColumn("predicted_volume", F.dayofmonth("date").cast("bigint"))
    return forecast.history_and_forecast(forecast.forecast_features(daily, by=("topic",)), future, by=("topic",))


@query
def given_hybrid_intent(spark, folder):
    texts = adapters.document_texts(spark, folder)
    labels = {"intent": fx.INTENTS[:2], "predicted_intent": fx.INTENTS[2:]}
    predicted = texts.withColumns({name: label_by_rules("question", rules, fx.INTENT_DEFAULT) for name, rules in labels.items()})
    return intent.with_hybrid(predicted, fx.INTENT_DEFAULT).drop("question")


@query
def recent_volumes(spark, folder):
    """The last seven volumes of each topic, newest first, as the forecast starts from them."""
    recent = forecast._recent(forecast.daily_volume(topics(spark, folder), by=("topic",)), ("topic",))
    listed = F.array_join(F.transform("_recent", lambda v: v.cast("bigint").cast("string")), ",")
    return recent.select("topic", F.col("_last").alias("last_date"), listed.alias("volumes"))


@query
def normalized_texts(spark, folder):
    return adapters.document_texts(spark, folder).select("id", F.md5(normalized(F.col("question"))).alias("digest"))


@query
def cleaned_suppliers(spark, folder):
    """All columns that cleaning leaves, with an empty table beside that is left out."""
    tables = {"supplier": read_source(spark, "supplier", folder=folder), "part": read_source(spark, "part", folder=folder).filter("p_partkey < 0")}
    cleaned = cleaning.drop_empty_tables(cleaning.clean_tables(tables, {name: fx.CLEANING[name] for name in tables}))
    return cleaned["supplier"].withColumn("tables", F.lit(",".join(sorted(cleaned))))


# Reports that grow


@query
def incremental_days(spark, folder):
    """Day sums loaded in two halves that share all days, the second half twice."""
    stored = new_folder(spark, "days")
    rows = topics(spark, folder)
    for name, part in (("even", rows.filter("id % 2 = 0")), ("odd", rows.filter("id % 2 = 1 AND id % 3 = 0")), ("odd", rows.filter("id % 2 = 1"))):
        increments.load(part, stored, name)
    return increments.report(spark, stored)


# Streams


def _event_stream(spark, folder):
    return adapters.as_event_chats(stream_source(spark, "events", folder=folder))


@query
def streaming_messages_per_day(spark, folder):
    out = new_folder(spark, "daily")
    report = streaming.streaming_messages_per_day(
        with_topic(_event_stream(spark, folder), fx.TOPICS, fx.TOPIC_DEFAULT), by=("topic",)
    )
    streaming.stream_to_table(report, out, checkpoint=new_folder(spark, "daily-state"), mode="update")
    updates = spark.read.schema("topic string, date date, message_count bigint, batch int").parquet(out)
    return streaming.latest(updates, ("topic", "date"))


@query
def streaming_sessions(spark, folder):
    sessions = streaming.all_sessions(
        _event_stream(spark, folder), new_folder(spark, "sessions"), checkpoint=new_folder(spark, "sessions-state")
    )
    return rounded(sessions, "session_length_min", digits=9)


@query
def streaming_session_ids(spark, folder):
    return streaming_session_numbers.all_session_ids(
        _event_stream(spark, folder), new_folder(spark, "session-ids"), checkpoint=new_folder(spark, "session-ids-state")
    )
