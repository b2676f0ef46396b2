"""Feature scaling, label encoding, splits and classification reports."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ranking import ranks
from ..functions.skew import broadcast_if_small

SPLIT_BUCKETS = 10_000


@dataclass(frozen=True)
class Scaling:
    """Mean and population standard deviation of each feature."""

    stats: dict[str, tuple[float, float]]

    def scaled(self, feature: str) -> Column:
        """Zero mean, unit deviation; a constant feature becomes 0."""
        mean, deviation = self.stats[feature]
        return (F.col(feature) - mean) / (deviation or 1.0)

    def transform(self, rows: DataFrame) -> DataFrame:
        return rows.withColumns({f: self.scaled(f) for f in self.stats})


def fit_scaling(rows: DataFrame, features: Sequence[str]) -> Scaling:
    """One aggregation, one row to the driver."""
    row = rows.agg(
        *[F.avg(f).alias(f"m{i}") for i, f in enumerate(features)],
        *[F.stddev_pop(f).alias(f"s{i}") for i, f in enumerate(features)],
    ).first()
    return Scaling({f: (row[f"m{i}"] or 0.0, row[f"s{i}"] or 0.0) for i, f in enumerate(features)})


def in_test_set(key: str, *, test_share: float = 0.2, seed: int = 42) -> Column:
    """True for about test_share of the keys, always the same ones.

    Decided by a hash of key and seed, so it does not depend on partitions,
    row order or reruns.
    """
    digest = F.md5(F.concat_ws(":", F.col(key).cast("string"), F.lit(str(seed))))
    bucket = F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") % SPLIT_BUCKETS
    return bucket < round(test_share * SPLIT_BUCKETS)


def encode_labels(rows: DataFrame, label: str, output: str) -> DataFrame:
    """Add the 0-based alphabetical position of each label; NULL has none.

    The distinct labels are ranked over range partitions, so there may be any number of them.
    Their codes are broadcast if they are counted to be few, so a label that most rows share
    moves no rows.
    """
    labels = rows.filter(F.col(label).isNotNull()).select(label).distinct()
    return rows.join(broadcast_if_small(ranks(labels, label, name=output)), label, "left")


def classification_report(predictions: DataFrame, label: str, prediction: str) -> DataFrame:
    """Precision, recall, F1 and support per class, then accuracy and averages.

    Everything comes from the confusion counts, one row per (label, prediction).
    A class never predicted, or never present, has 0 where a ratio is undefined.
    """
    confusion = predictions.groupBy(F.col(label).alias("actual"), F.col(prediction).alias("predicted")).agg(
        F.count(F.lit(1)).alias("n")
    )
    hit = F.when(F.col("actual") == F.col("predicted"), F.col("n")).otherwise(0)
    both_sides = F.inline(
        F.array(
            F.struct(F.col("actual").alias("class"), F.col("n").alias("support"), F.lit(0).cast("long").alias("called"), hit.alias("hits")),
            F.struct(F.col("predicted").alias("class"), F.lit(0).cast("long").alias("support"), F.col("n").alias("called"), F.lit(0).cast("long").alias("hits")),
        )
    )

    def ratio(a, b):
        return F.coalesce(F.try_divide(a, b), F.lit(0.0))

    p, r = ratio(F.col("hits"), F.col("called")), ratio(F.col("hits"), F.col("support"))
    classes = (
        confusion.select(both_sides)
        .groupBy("class")
        .agg(*[F.sum(c).alias(c) for c in ("support", "called", "hits")])
        .select("class", p.alias("precision"), r.alias("recall"), ratio(2 * p * r, p + r).alias("f1"), "support", "hits")
    )
    measures = ("precision", "recall", "f1")
    weighted = [(F.sum(F.col(m) * F.col("support")) / F.sum("support")).alias(f"w_{m}") for m in measures]
    totals = classes.agg(
        *[F.avg(m).alias(f"m_{m}") for m in measures],
        *weighted,
        (F.sum("hits") / F.sum("support")).alias("accuracy"),
        F.sum("support").alias("support"),
    )

    def line(name, precision, recall, f1):
        return F.struct(
            F.lit(name).alias("class"),
            *[F.col(c).alias(m) for c, m in zip((precision, recall, f1), measures)],
            "support",
        )

    summary = totals.select(
        F.inline(
            F.array(
                line("accuracy", "accuracy", "accuracy", "accuracy"),
                line("macro avg", "m_precision", "m_recall", "m_f1"),
                line("weighted avg", "w_precision", "w_recall", "w_f1"),
            )
        )
    )
    return classes.select("class", *measures, "support").unionByName(summary)
