"""Forecast of the daily message volume, for one series or many together."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import written
from .volume import messages_per_day

# The lags, in rows of the daily series.
LAGS = (1, 2, 3, 7)
CALENDAR = ("day_of_week", "month", "day_of_month", "is_weekend")
FEATURES = CALENDAR + tuple(f"lag_{n}" for n in LAGS)
MIN_ROWS = 10


def calendar_features(date: Column) -> dict[str, Column]:
    """Weekday from Monday = 0, month, day of month and weekend flag."""
    weekday = F.weekday(date)
    return {
        "day_of_week": weekday,
        "month": F.month(date),
        "day_of_month": F.dayofmonth(date),
        "is_weekend": weekday.isin(5, 6).cast("int"),
    }


def daily_volume(chats: DataFrame, *, by: Sequence[str] = ()) -> DataFrame:
    return messages_per_day(chats, by=by).withColumnRenamed("message_count", "volume")


def forecast_features(daily: DataFrame, *, by: Sequence[str] = ()) -> DataFrame:
    """Calendar and lag features of each day; days without all lags drop.

    Lags count rows of a series, not calendar days. The windows run over one
    row per day and series.
    """
    w = Window.partitionBy(*by).orderBy("date")
    lags = {f"lag_{n}": F.lag("volume", n).over(w) for n in LAGS}
    return daily.withColumns(calendar_features(F.col("date")) | lags).na.drop(subset=[f"lag_{n}" for n in LAGS])


def forecast_dates(daily: DataFrame, *, days: int = 7, by: Sequence[str] = ()) -> DataFrame:
    """The days after the last one of each series."""
    last = F.max("date")
    return (
        daily.groupBy(*by)
        .agg(F.sequence(F.date_add(last, 1), F.date_add(last, days)).alias("dates"))
        .select(*by, F.explode("dates").alias("date"))
    )


def _recent(daily: DataFrame, by: Sequence[str]) -> DataFrame:
    """Last date and last seven volumes of each series, newest first."""
    newest = Window.partitionBy(*by).orderBy(F.desc("date"))
    return (
        daily.withColumn("_n", F.row_number().over(newest))
        .filter(F.col("_n") <= max(LAGS))
        .groupBy(*by)
        .agg(
            F.max("date").alias("_last"),
            F.sort_array(F.collect_list(F.struct(-F.col("_n"), F.col("volume").cast("double").alias("volume"))), asc=False)[
                "volume"
            ].alias("_recent"),
        )
    )


def forecast_volume(
    chats: DataFrame,
    *,
    days: int = 7,
    by: Sequence[str] = (),
    trees: int = 100,
    max_depth: int = 10,
    seed: int = 42,
) -> tuple[DataFrame, DataFrame]:
    """History with its features, and the predicted volume of the next days.

    All series train one random forest together, if their complete days are ten or
    more; else both results are empty. Each further day uses the days predicted
    before it as its lags, for all series in one step. A series needs as many days
    as the longest lag to be predicted; shorter ones are listed with NULL volumes.
    The daily table, a row per day and series, is written once and all else reads it.
    """
    daily = written(daily_volume(chats, by=by), "daily-volume")
    history = forecast_features(daily, by=by)
    series = _recent(daily, by)
    if history.limit(MIN_ROWS).count() < MIN_ROWS:
        nothing = series.select(*by, F.col("_last").alias("date"), F.lit(0).cast("long").alias("predicted_volume"))
        return history.filter("false"), nothing.filter("false")
    short = series.filter(F.size("_recent") < max(LAGS))
    series = series.filter(F.size("_recent") >= max(LAGS))
    training = history.persist()
    try:
        model = RandomForestRegressor(
            featuresCol="features",
            labelCol="volume",
            numTrees=trees,
            maxDepth=max_depth,
            featureSubsetStrategy="all",
            seed=seed,
        ).fit(VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(training))
    finally:
        training.unpersist()
    predicted = []
    for day in range(1, days + 1):
        date = F.date_add("_last", day)
        lags = {f"lag_{n}": F.col("_recent")[n - 1] for n in LAGS}
        step = VectorAssembler(inputCols=list(FEATURES), outputCol="_features")
        model.setFeaturesCol("_features").setPredictionCol("_predicted")
        series = (
            model.transform(step.transform(series.withColumns(calendar_features(date) | lags)))
            .withColumn("_recent", F.concat(F.array("_predicted"), F.slice("_recent", 1, max(LAGS) - 1)))
            .withColumnRenamed("_predicted", f"_day{day}")
            .drop("_features", *FEATURES)
        )
        volume = F.bround(F.col(f"_day{day}"), 0).cast("long")
        predicted.append(F.struct(date.alias("date"), volume.alias("predicted_volume")))
    dates = F.explode(F.sequence(F.date_add("_last", 1), F.date_add("_last", days)))
    unknown = short.select(*by, dates.alias("date"), F.lit(None).cast("long").alias("predicted_volume"))
    return history, series.select(*by, F.inline(F.array(*predicted))).unionByName(unknown)


def history_and_forecast(history: DataFrame, forecast: DataFrame, *, by: Sequence[str] = ()) -> DataFrame:
    """Both as one table with a type column."""
    past = history.select(*by, "date", "volume", F.lit("Historical").alias("type"))
    future = forecast.withColumnRenamed("predicted_volume", "volume").withColumn("type", F.lit("Forecast"))
    return past.unionByName(future)
