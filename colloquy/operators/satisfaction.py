"""A classifier of the satisfaction label.

The label is a function of three of the features, so a high accuracy is to be
expected. The accuracy reported is the measured one.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import IndexToString, StringIndexer, VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import written
from .evaluation import classification_report, in_test_set

FEATURES = (
    "questions", "topics", "avg_sentiment", "avg_messages_per_session",
    "engagement_diversity", "avg_response_time", "session_length", "conversation_turns",
)
MIN_ROWS = 10


@dataclass(frozen=True)
class SatisfactionModel:
    model: PipelineModel
    importances: DataFrame
    complete: DataFrame
    seed: int

    def predict(self, features: DataFrame) -> DataFrame:
        complete = features.na.drop(subset=[*FEATURES])
        return (
            self.model.transform(complete)
            .withColumn("in_test", in_test_set("client_id", seed=self.seed))
            .drop("features", "rawPrediction", "probability", "prediction")
        )

    def _held_out(self) -> DataFrame:
        return self.predict(self.complete).filter("in_test")

    def report(self) -> DataFrame:
        return classification_report(self._held_out(), "satisfaction", "predicted_satisfaction")

    def accuracy(self) -> float | None:
        """Share of right predictions on the held-out clients; None if there are none."""
        right = (F.col("satisfaction") == F.col("predicted_satisfaction")).cast("double")
        return self._held_out().agg(F.avg(right)).first()[0]


def train_satisfaction_model(
    labelled: DataFrame, *, trees: int = 100, max_depth: int = 10, seed: int = 42
) -> SatisfactionModel | None:
    """Random forest on 80 % of the complete rows; None with fewer than ten of them.

    The complete rows, one per client, are written once and kept with the model.
    """
    complete = written(labelled.na.drop(subset=[*FEATURES, "satisfaction"]), "satisfaction")
    if complete.limit(MIN_ROWS).count() < MIN_ROWS:
        return None
    indexer = StringIndexer(inputCol="satisfaction", outputCol="label", stringOrderType="alphabetAsc").fit(complete)
    assembler = VectorAssembler(inputCols=list(FEATURES), outputCol="features")
    forest = RandomForestClassifier(numTrees=trees, maxDepth=max_depth, seed=seed).fit(
        assembler.transform(indexer.transform(complete.filter(~in_test_set("client_id", seed=seed))))
    )
    importances = labelled.sparkSession.createDataFrame(
        [(name, float(value)) for name, value in zip(FEATURES, forest.featureImportances.toArray())],
        "feature string, importance double",
    ).orderBy(F.desc("importance"), "feature")
    names = IndexToString(inputCol="prediction", outputCol="predicted_satisfaction", labels=indexer.labels)
    return SatisfactionModel(PipelineModel([assembler, forest, names]), importances, complete, seed)
