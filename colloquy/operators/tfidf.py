"""TF-IDF over whole texts with a bounded vocabulary."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.ml.feature import CountVectorizerModel, ElementwiseProduct, Normalizer
from pyspark.ml.linalg import Vectors
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import words


@dataclass(frozen=True)
class Tfidf:
    """A fitted vocabulary and the transformers that use it.

    Transforming is per row: no shuffle, however large the corpus.
    """

    column: str
    vocabulary: DataFrame
    stages: PipelineModel

    def vectors(self, rows: DataFrame, output: str = "features") -> DataFrame:
        """Rows with a sparse, L2-normalised TF-IDF vector."""
        tokens = rows.withColumn("_tokens", words(F.col(self.column)))
        return self.stages.transform(tokens).withColumnRenamed("_unit", output).drop("_tokens", "_tf", "_tfidf")

    def weights(self, rows: DataFrame, key: str = "id") -> DataFrame:
        """The same weights in long form: key, term, weight."""
        return long_form(self.vectors(rows), self.vocabulary, key)


def long_form(rows: DataFrame, vocabulary: DataFrame, *keep: str, features: str = "features") -> DataFrame:
    """Vector entries as rows. The vocabulary holds at most max_features terms, so it is broadcast."""
    vector = F.unwrap_udt(features)
    entries = F.arrays_zip(vector["indices"].alias("term_index"), vector["values"].alias("weight"))
    return (
        rows.select(*keep, F.inline(entries).alias("term_index", "weight"))
        .join(F.broadcast(vocabulary.select("term_index", "term")), "term_index")
        .select(*keep, "term", "weight")
    )


def term_counts(rows: DataFrame, column: str, stop_words: Sequence[str] = ()) -> DataFrame:
    """Occurrences and containing texts of every term, counted before the shuffle.

    Each text gives its words once as occurrences and its distinct words once
    as a document, so both counts come from one pass over the texts. The row of
    the NULL term holds the number of all texts.
    """
    tokens = rows.select(words(F.col(column)).alias("tokens")).select(
        "tokens", F.array_distinct("tokens").alias("once")
    )
    both = F.array(
        F.struct(F.lit(1).alias("n"), F.lit(0).alias("d"), F.col("tokens").alias("terms")),
        F.struct(F.lit(0).alias("n"), F.lit(1).alias("d"), F.concat("once", F.array(F.lit(None).cast("string"))).alias("terms")),
    )
    counted = tokens.select(F.inline(both)).select("n", "d", F.explode("terms").alias("term"))
    if stop_words:
        counted = counted.filter(F.col("term").isNull() | ~F.col("term").isin(*stop_words))
    return counted.groupBy("term").agg(F.sum("n").alias("occurrences"), F.sum("d").alias("documents"))


def fit_tfidf(
    rows: DataFrame,
    column: str = "question",
    *,
    max_features: int = 1000,
    stop_words: Sequence[str] = (),
) -> Tfidf:
    """Keep the max_features most frequent terms, ties alphabetically.

    Weight = occurrences in the text x (ln((1 + texts) / (1 + texts with the
    term)) + 1), rows scaled to length 1. The driver receives the vocabulary
    only, never more than max_features rows.
    """
    top = (
        term_counts(rows, column, stop_words)
        .orderBy(F.desc(F.isnull("term")), F.desc("occurrences"), "term")
        .limit(max_features + 1)
        .collect()
    )
    texts = sum(row.documents for row in top if row.term is None)
    top = [row for row in top if row.term is not None]
    if not top:
        raise ValueError("the texts hold no terms")
    top.sort(key=lambda row: row.term)
    idf = [math.log((1 + texts) / (1 + row.documents)) + 1 for row in top]
    vocabulary = rows.sparkSession.createDataFrame(
        [(i, row.term, row.occurrences, row.documents, w) for i, (row, w) in enumerate(zip(top, idf))],
        "term_index int, term string, occurrences long, documents long, idf double",
    )
    stages = PipelineModel(
        [
            CountVectorizerModel.from_vocabulary([row.term for row in top], "_tokens", "_tf"),
            ElementwiseProduct(scalingVec=Vectors.dense(idf), inputCol="_tf", outputCol="_tfidf"),
            Normalizer(p=2.0, inputCol="_tfidf", outputCol="_unit"),
        ]
    )
    return Tfidf(column, vocabulary, stages)
