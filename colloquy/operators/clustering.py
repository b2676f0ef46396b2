"""Clusters of texts and of users."""

from __future__ import annotations

from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark import inheritable_thread_target
from pyspark.ml.clustering import KMeans, KMeansModel
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import PCA, PCAModel, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import ENGLISH_STOP_WORDS, normalized
from ..session import written
from .evaluation import fit_scaling
from .tfidf import fit_tfidf, long_form

SEGMENT_FEATURES = (
    "total_messages", "active_days", "avg_message_length",
    "avg_response_time", "session_count", "unique_topics",
)
MAX_SEGMENTS = 5
FIT_PARTITIONS = 4096


@dataclass(frozen=True)
class Projection:
    """Centred projection on the first two principal components."""

    model: PCAModel
    centre: tuple[float, float]

    def transform(self, rows: DataFrame) -> DataFrame:
        """Add pca_x and pca_y."""
        point = vector_to_array("_pca")
        return (
            self.model.transform(rows)
            .withColumn("pca_x", point[0] - self.centre[0])
            .withColumn("pca_y", point[1] - self.centre[1])
            .drop("_pca")
        )


def fit_projection(rows: DataFrame, features: str = "features") -> Projection:
    """The driver holds a features x features matrix, never rows.

    Each partition sends such a matrix up a two-level tree, so their number is
    bounded before the fit; coalescing reads more per task and shuffles nothing.
    """
    rows = rows.select(features).coalesce(FIT_PARTITIONS)
    model = PCA(k=2, inputCol=features, outputCol="_pca").fit(rows)
    mean = rows.select(Summarizer.mean(F.col(features))).first()[0]
    x, y = mean.toArray() @ model.pc.toArray()
    return Projection(model, (float(x), float(y)))


def silhouette(assigned: DataFrame, *, cluster: str, features: str = "features") -> float:
    """Mean silhouette with squared distances, linear in the rows; -1 for a single cluster."""
    if assigned.select(cluster).distinct().limit(2).count() < 2:
        return -1.0
    evaluator = ClusteringEvaluator(predictionCol=cluster, featuresCol=features)
    return evaluator.evaluate(assigned.withColumn(cluster, F.col(cluster).cast("double")))


@dataclass(frozen=True)
class TopicClusters:
    """Rows with cluster, position and vector; the vocabulary; the fitted model."""

    assigned: DataFrame
    vocabulary: DataFrame
    model: KMeansModel

    def assignments(self, *keep: str) -> DataFrame:
        return self.assigned.select(*(keep or ("id",)), "topic_cluster", "pca_x", "pca_y")

    def top_terms(self, n: int = 10) -> DataFrame:
        """The n terms of each cluster with the largest mean weight of its members."""
        members = self.assigned.groupBy("topic_cluster").agg(F.count(F.lit(1)).alias("members"))
        sums = (
            long_form(self.assigned, self.vocabulary, "topic_cluster")
            .groupBy("topic_cluster", "term")
            .agg(F.sum("weight").alias("total"))
        )
        by_weight = Window.partitionBy("topic_cluster").orderBy(F.desc("weight"), "term")
        return (
            sums.join(F.broadcast(members), "topic_cluster")
            .select("topic_cluster", "term", (F.col("total") / F.col("members")).alias("weight"))
            .withColumn("rank", F.row_number().over(by_weight))
            .filter(F.col("rank") <= n)
        )

    def silhouette(self) -> float:
        return silhouette(self.assigned, cluster="topic_cluster")


def cluster_topics(
    chats: DataFrame,
    column: str = "question",
    *,
    n_clusters: int = 5,
    max_features: int = 1000,
    stop_words: Sequence[str] = ENGLISH_STOP_WORDS,
    seed: int = 42,
) -> TopicClusters:
    """Group texts by k-means on their TF-IDF vectors and place them in the plane.

    The vectors stay sparse. They are written once, so that the passes of the
    fits and the results do not tokenize the texts again.
    """
    rows = chats.withColumn("cleaned_text", normalized(F.col(column)))
    tfidf = fit_tfidf(rows, "cleaned_text", max_features=max_features, stop_words=stop_words)
    vectors = written(tfidf.vectors(rows).drop("cleaned_text"), "vectors")
    model = KMeans(k=n_clusters, seed=seed, predictionCol="topic_cluster").fit(vectors)
    projection = fit_projection(vectors)
    return TopicClusters(projection.transform(model.transform(vectors)), tfidf.vocabulary, model)


@dataclass(frozen=True)
class Segments:
    """Users with segment and position, and the silhouette of each k tried."""

    users: DataFrame
    scores: dict[int, float]

    def profiles(self, features: Sequence[str] = SEGMENT_FEATURES) -> DataFrame:
        """Mean of each feature per segment."""
        return self.users.groupBy("segment").agg(*[F.avg(f).alias(f) for f in features])


def segment_users(
    behavior: DataFrame, features: Sequence[str] = SEGMENT_FEATURES, *, seed: int = 42
) -> Segments:
    """Split users into the number of segments, 2 to 5, with the best silhouette.

    The smallest k wins a tie. With fewer than three users there is one segment
    and no position. The per-user table is written once, as every fit reads it;
    the fits are short jobs on few rows and run side by side.
    """
    behavior = written(behavior, "behavior")
    scaling = fit_scaling(behavior, features)
    scaled = {f"_{f}": scaling.scaled(f) for f in features}
    assembler = VectorAssembler(inputCols=list(scaled), outputCol="features")
    vectors = assembler.transform(behavior.withColumns(scaled)).drop(*scaled)
    kept = vectors.select("features").persist()
    try:
        most = min(MAX_SEGMENTS, kept.limit(MAX_SEGMENTS + 1).count() - 1)

        def fit(k: int) -> tuple[KMeansModel, float]:
            model = KMeans(k=k, seed=seed, predictionCol="segment").fit(kept)
            return model, silhouette(model.transform(kept), cluster="segment")

        tried = range(2, most + 1)
        with ThreadPoolExecutor(MAX_SEGMENTS) as pool:
            fitted = dict(zip(tried, pool.map(inheritable_thread_target(behavior.sparkSession)(fit), tried)))
        scores = {k: score for k, (_, score) in fitted.items()}
        if not scores:
            return Segments(behavior.withColumn("segment", F.lit(0)), scores)
        best = max(sorted(scores), key=scores.get)
        projection = fit_projection(kept)
    finally:
        kept.unpersist()
    return Segments(projection.transform(fitted[best][0].transform(vectors)).drop("features"), scores)
