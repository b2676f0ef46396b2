"""Every query with SQL must give the SQL's rows on the small tables."""

from __future__ import annotations

import pytest
from compare import database, differences

import __spark_entry__ as contract
from colloquy.operators.filters import Filters, apply_filters
from colloquy.plans import dashboard, fixtures, registry

FOLDER = "/root/testdata/sf0.001"
QUERIES, ORACLES = contract.queries(), contract.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return database(FOLDER)


def test_names():
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, con, name):
    got = QUERIES[name](spark, FOLDER).toPandas()
    assert differences(got, con.execute(ORACLES[name]).df()) == []
    assert len(got)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_runs(spark, name):
    assert QUERIES[name](spark, FOLDER).count() > 0


def test_entry(spark):
    frame = contract.entry(spark)
    assert frame.count() > 0 and "mean_session_min" in frame.columns


def test_dashboard(spark):
    chats, people = registry.events(spark, FOLDER), registry.clients(spark, FOLDER)
    prepared = dashboard.prepare(chats, registry.lexicon(spark), fixtures.TOPICS, "Other")
    chosen = Filters("2024-01-01", "2024-01-31", topics=("Navigation",))
    chosen_rows = apply_filters(prepared, people, chosen).persist()
    tables = dashboard.filtered_reports(chosen_rows, people) | dashboard.overall_reports(prepared, people)
    rows = prepared.filter("topic = 'Navigation'").count()
    assert tables["data_bounds"].first().row_count == rows
    assert tables["messages_per_topic"].collect() == [("Navigation", rows)]
    assert tables["top_users"].count() <= 10
    assert sum(r["count"] for r in tables["sentiment_distribution"].collect()) == rows
    assert tables["topic_performance"].count() == 3
    assert tables["user_engagement"].count() == chats.select("client_id").distinct().count()


def test_forecast_against_what_sql_can_decide(spark, con):
    union = QUERIES["forecast_union"](spark, FOLDER).toPandas()
    past, future = union[union.type == "Historical"], union[union.type == "Forecast"]
    expected = con.execute(ORACLES["forecast_features"]).df()
    assert sorted(zip(past.date.astype(str), past.volume)) == sorted(zip(expected.date.astype(str).str[:10], expected.volume))
    dates = con.execute(ORACLES["forecast_dates"]).df()
    assert sorted(future.date.astype(str)) == sorted(dates.date.astype(str).str[:10])
    assert future.volume.between(past.volume.min(), past.volume.max()).all()


def test_hybrid_intent_follows_the_rules(spark):
    rows = QUERIES["hybrid_intent"](spark, FOLDER).toPandas()
    ruled = rows.intent != fixtures.INTENT_DEFAULT
    assert ruled.any() and (rows.hybrid_intent[ruled] == rows.intent[ruled]).all()
    assert (rows.hybrid_intent[~ruled] == rows.predicted_intent[~ruled]).all()


def test_satisfaction_model_against_sql(spark, con):
    rows = QUERIES["satisfaction_model"](spark, FOLDER).toPandas()
    labels = con.execute(ORACLES["satisfaction_labels"]).df()
    assert sorted(zip(rows.client_id, rows.satisfaction)) == sorted(zip(labels.client_id, labels.satisfaction))
    assert set(rows.predicted_satisfaction) <= set(labels.satisfaction)
    importance = QUERIES["feature_importance"](spark, FOLDER).toPandas()
    assert len(importance) == 8 and abs(importance.importance.sum() - 1) < 1e-9
