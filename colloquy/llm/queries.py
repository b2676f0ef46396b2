"""The registered queries of this subpackage: each applies its operator, with
the parameters used in production, to its whole table."""

from __future__ import annotations

import secrets
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import new_folder
from . import (
    decontaminate,
    hard_negatives,
    language_id,
    line_dedup,
    main_text,
    minhash_forest,
    periodic_runs,
    piece_encoding,
    preference,
    pseudonyms,
    quality,
    separators,
    warc_bundles,
)
from .store import ship_package, table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(build: Query) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship_package(spark)
        return build(spark, sf_dir)

    run.__name__, run.__doc__ = build.__name__, build.__doc__
    QUERIES[build.__name__] = run
    return run


@query
def op3_decontamination(spark, sf_dir):
    """Windows of ten words that documents share with benchmark items."""
    found = decontaminate.overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    names = F.array_sort(F.transform("items", lambda i: i.cast("string")))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(names, ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


@query
def op5_near_duplicates(spark, sf_dir):
    """Components of documents whose sets of word pairs have similarity 0.8 or more."""
    return minhash_forest.near_duplicates(table(spark, sf_dir, "documents")).drop("version")


@query
def op9_language_id(spark, sf_dir):
    """Languages predicted by a model of the documents that are not held out."""
    remainder = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4))
    docs = table(spark, sf_dir, "documents").withColumn("held_out", F.coalesce(remainder == 2, F.lit(False)))
    model = language_id.fit(docs.where("not held_out"))
    return language_id.predict(docs.select("doc_id", "text", "held_out"), model).drop("text")


@query
def op7_sentencepiece(spark, sf_dir):
    """Documents as SentencePiece ids, and whether these decode to the text again."""
    encoded = piece_encoding.encode(table(spark, sf_dir, "documents"), round_trip="round_trip")
    return encoded.select("doc_id", F.size("ids").cast("long").alias("n_ids"), F.xxhash64("ids").alias("ids_hash"), "round_trip")


@query
def op10_quality(spark, sf_dir):
    """Base counts of every document, and the verdict of its group's thresholds."""
    found = quality.quality(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


@query
def op1_line_dedup(spark, sf_dir):
    """Documents without lines that repeat, or nearly repeat, an earlier line."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = line_dedup.dedup_lines(docs, counts=("n_lines", "n_dropped"))
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("text_sha256"))


@query
def op2_token_counts(spark, sf_dir):
    """Tokens of every document, found by scanning the flat token files of all."""
    return separators.counted(table(spark, sf_dir, "documents")).select("doc_id", "n_tokens")


@query
def op4_preference_pairs(spark, sf_dir):
    """Conversations 2k (chosen) and 2k + 1 (rejected) as prompt and masked completions."""
    turns = table(spark, sf_dir, "conversations").withColumns(
        {
            "pair_id": F.shiftright("conv_id", 1),
            "side": F.when(F.col("conv_id") % 2 == 0, "chosen").otherwise("rejected"),
        }
    )
    pairs = preference.format_pairs(turns)
    spans = {f"{s}_mask": F.array_join(F.transform(f"{s}_mask", lambda x: F.concat_ws("-", x["start"].cast("string"), x["end"].cast("string"))), ",") for s in preference.SIDES}
    return pairs.withColumns(spans)


@query
def op6_main_text(spark, sf_dir):
    """The main text of every page."""
    return main_text.extract(table(spark, sf_dir, "pages"))


def pseudonym_key(spark) -> bytes:
    """The key that the session sets; else a random one, which links values in this session alone."""
    key = spark.conf.get("spark.colloquy.pseudonymKey", None)
    held = spark.sparkContext.__dict__.setdefault("_colloquy_key", secrets.token_bytes(32))
    return key.encode() if key else held


@query
def op8_pseudonyms(spark, sf_dir):
    """Documents with personal values replaced by pseudonyms under the session's key."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pseudonyms.pseudonymise(docs, pseudonym_key(spark))


@query
def op11_warc_bundles(spark, sf_dir):
    """Pages written to WARC bundles, repeated payloads as revisits, and read back."""
    index = warc_bundles.write(table(spark, sf_dir, "pages"), new_folder(spark, "warc"))
    found = warc_bundles.read(index, payload=False)
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query
def op12_hard_negatives(spark, sf_dir):
    """Three hard negatives for each of the five positives of every fiftieth vector."""
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", moved.alias("label"))
    return hard_negatives.mine(rows, F.col("vec_id") % 50 == 0)


def looped(docs: DataFrame) -> DataFrame:
    """The documents, of which a tenth repeat a stretch of their words to the end."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    chosen = F.when(h % 10 == 0, F.regexp_extract_all("text", F.lit("[^\\x20\\x09-\\x0D]+"), F.lit(0)))
    split = docs.select("doc_id", "text", F.floor(h / 10).alias("g"), chosen.alias("w")).withColumn("n", F.size("w"))
    start = split.withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")).cast("int"))
    period = F.lit(1) + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8)).cast("int")
    parted = start.withColumns({"p": period, "rest": F.col("n") - F.col("a")})
    cycle = F.slice("w", F.col("a") + 1, F.col("p"))
    again = F.flatten(F.array_repeat(cycle, F.ceil(F.col("rest") / F.col("p")).cast("int")))
    words = F.concat(F.slice("w", F.lit(1), F.col("a")), F.slice(again, F.lit(1), F.col("rest")))
    return parted.select("doc_id", F.when(F.col("n") > 0, F.array_join(words, " ")).otherwise(F.col("text")).alias("text"))


@query
def op13_periodic_runs(spark, sf_dir):
    """Runs of every document, and its words without the runs' repetitions."""
    found = periodic_runs.find_runs(looped(table(spark, sf_dir, "documents")))
    rank = F.transform("runs", lambda r: F.struct(r["length"], -r["start"], -r["period"]))
    best = found.withColumn("best", F.array_max(rank).cast("struct<length:bigint,start:bigint,period:bigint>"))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", *(r[x].cast("string") for x in ("start", "length", "period"))), F.lit("\n")))
    return best.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        (-F.col("best.start")).alias("start"),
        F.col("best.length").alias("length"),
        (-F.col("best.period")).alias("period"),
        F.expr("(1000 * best.length) div -best.period").alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
