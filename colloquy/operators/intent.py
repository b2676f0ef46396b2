"""A classifier of question intents, trained on rule labels.

The labels are a function of the words the model sees, so its accuracy says how
well it learned the rules, not how well it understands users.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import IndexToString, StringIndexer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.rules import INTENT_DEFAULT, INTENT_RULES, Rules, with_intent
from ..functions.text import ENGLISH_STOP_WORDS
from ..session import written
from .evaluation import classification_report, in_test_set
from .tfidf import Tfidf, fit_tfidf


@dataclass(frozen=True)
class IntentModel:
    tfidf: Tfidf
    model: PipelineModel
    rules: Rules
    default: str
    seed: int

    def predict(self, chats: DataFrame) -> DataFrame:
        """Chats with the rule label ``intent``, ``predicted_intent`` and ``in_test``."""
        rows = self.tfidf.vectors(with_intent(chats, self.rules, self.default))
        return (
            self.model.transform(rows)
            .withColumn("in_test", in_test_set("id", seed=self.seed))
            .drop("features", "intent_index", "rawPrediction", "probability", "prediction")
        )

    def report(self, chats: DataFrame) -> DataFrame:
        """Classification report on the rows held out of training."""
        return classification_report(self.predict(chats).filter("in_test"), "intent", "predicted_intent")

    def hybrid(self, chats: DataFrame) -> DataFrame:
        return with_hybrid(self.predict(chats), self.default)


def with_hybrid(predicted: DataFrame, default: str = INTENT_DEFAULT) -> DataFrame:
    """Add ``hybrid_intent``: the rule's label where a rule applies, else the classifier's."""
    by_rule = F.col("intent") != default
    return predicted.withColumn("hybrid_intent", F.when(by_rule, F.col("intent")).otherwise(F.col("predicted_intent")))


def train_intent_model(
    chats: DataFrame,
    rules: Rules = INTENT_RULES,
    default: str = INTENT_DEFAULT,
    *,
    max_features: int = 500,
    stop_words: Sequence[str] = ENGLISH_STOP_WORDS,
    trees: int = 100,
    max_depth: int = 10,
    seed: int = 42,
) -> IntentModel:
    """TF-IDF of the question and a random forest on 80 % of the rows."""
    tfidf = fit_tfidf(chats, "question", max_features=max_features, stop_words=stop_words)
    labelled = with_intent(chats, rules, default).select("id", "question", "intent")
    rows = written(tfidf.vectors(labelled).drop("question"), "intents")
    indexer = StringIndexer(inputCol="intent", outputCol="intent_index", stringOrderType="alphabetAsc").fit(rows)
    forest = RandomForestClassifier(
        featuresCol="features", labelCol="intent_index", numTrees=trees, maxDepth=max_depth, seed=seed
    ).fit(indexer.transform(rows.filter(~in_test_set("id", seed=seed))))
    names = IndexToString(inputCol="prediction", outputCol="predicted_intent", labels=indexer.labels)
    return IntentModel(tfidf, PipelineModel([forest, names]), rules, default, seed)
