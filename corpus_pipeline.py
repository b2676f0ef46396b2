"""Corpus cleaning as a sequence of stages, each on all that the one before kept.

language ID -> line dedup -> near-duplicate removal -> benchmark
decontamination -> SentencePiece encoding and decoding. Every stage but the last returns the
columns of ``documents``; each result is written as Parquet in the shared folder
and read again, so a lost executor costs a stage's tasks and no more.

Defined results: documents without a text or a letter go in the first stage, so later stages meet them
only if called alone, where a null text stays null (the line stage drops it); rows that repeat id and
text leave one in the third stage; null ids are ids; an empty table stays empty; other columns,
whatever their names, are kept by all stages but the last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colloquy.llm import decontaminate, language_id, line_dedup, minhash_forest, piece_encoding
from colloquy.llm.store import bounded_broadcast, ship_package, table, unused, written

# A language must be this probable for a document to stay.
LEAST_PROBABILITY = 0.5
# Near duplicates in the pipeline: five-word shingles, similarity 0.8 or more.
SHINGLE_WORDS = 5


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a known language: not those without letters, of doubtful language, or
    less like their best language than nearly all that was learned of it.

    Where no row names a language, all documents with a letter stay.
    """
    ship_package(spark)
    model = language_id.fit(docs)
    if not model.languages:
        return docs.where(F.col("text").rlike("\\p{L}"))
    pred, score, familiar = (unused(docs.columns, name) for name in ("lang_pred", "lang_score", "lang_familiar"))
    floors = language_id.floors(docs, model)
    found = language_id.predict(docs, model, lang_pred=pred, score=score, floors=floors, familiar=familiar)
    sure = (F.col(pred) != language_id.UNDETERMINED) & (F.col(score) >= LEAST_PROBABILITY) & F.col(familiar)
    return found.where(sure).select(*docs.columns)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every line once in the corpus; documents that are left without a word go."""
    ship_package(spark)
    lean = line_dedup.dedup_lines(docs)
    return _recounted(lean.where(F.col("text").rlike("\\S")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    ship_package(spark)
    groups = minhash_forest.near_duplicates(docs, words=SHINGLE_WORDS)
    version, other_id, other_version = (unused(docs.columns, name) for name in ("_version", "_id", "_other"))
    gone = groups.where("not kept").select(F.col("doc_id").alias(other_id), F.col("version").alias(other_version)).distinct()
    named = docs.withColumn(version, F.xxhash64("text"))
    same = F.col("doc_id").eqNullSafe(F.col(other_id)) & (F.col(version) == F.col(other_version))
    stay = named.join(gone, same, "left_anti")
    # Rows that repeat both id and text: one stays. There are few or none, so only these are compared.
    again = stay.groupBy("doc_id", version).agg(F.count(F.lit(1)).alias(other_id)).where(F.col(other_id) > 1)
    again = again.select(F.col("doc_id").alias(other_id), F.col(version).alias(other_version))
    again = bounded_broadcast(written(again, "repeated-rows"))
    once = stay.join(again, same, "left_anti")
    first = stay.join(again, same, "left_semi").dropDuplicates(["doc_id", version])
    return once.unionByName(first).select(*docs.columns)


def decontaminate_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark passages cut out; documents that are mostly such passages go."""
    ship_package(spark)
    return _recounted(decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark")))


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' ids, with language and source, and whether they decode to the text again.

    That fails only for what the vocabulary's rules lose: a text that holds U+2581.
    """
    ship_package(spark)
    return piece_encoding.encode(docs, keep=("doc_id", "lang", "source"), round_trip="round_trip")


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", drop_repeated_lines),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", decontaminate_benchmark),
    ("sentencepiece", encode_pieces),
]

# Edit distance, components and piece lattices are beyond SQL; the tests compare
# each stage with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs


def _recounted(docs: DataFrame) -> DataFrame:
    """n_chars brought up to date where the table has it."""
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else docs
