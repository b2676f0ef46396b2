"""Quality rules with thresholds from quantile sketches per language and source.

Each text is measured once; the measures of texts that pass the base rules go
into quantile sketches, one for each measure of each (language, source). A sketch counts values in
bins whose edges grow by GAMMA (a published form, with a relative error of 1 % in the value and
none in the rank): it merges by addition, before and after the shuffle, and is the same
whatever the order of rows. A sketch's limit for a measure is the larger of 2 Q(TAIL) - Q(1/2)
and the quantile RARE of the values that are not 0, where Q are its quantiles; for word length
there is also a lower one, 2 Q(1 - TAIL) - Q(1/2).

A group's limit is the mean of its own, weighted by its texts, and those of its language and of
all texts, with the weight of PRIOR texts each: a small group speaks through its language and a
large one for itself, without a size at which the rule changes. A text is kept if it passes
the base rules and all its measures lie within its group's limits.

Words are runs of anything but ASCII white space.

Defined results: a null text has no words and fails; null languages and sources
are groups of their own; repeated rows are measured each and weigh twice in the
sketches; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .store import bounded_broadcast, written
from .words import SPLIT_AT_SPACE, hashed_texts, text_bytes, windows

WINDOW = 8
SYMBOLS = b"#*$%&|<>"


@dataclass(frozen=True)
class Measure:
    name: str
    column: str  # SQL over the counts
    both_sides: bool = False


MEASURES = (
    Measure("word_length", "word_chars / n_words", both_sides=True),
    Measure("symbols", "n_symbols / n_words"),
    # Four more lines, so that one repeat in a text of three lines is not a third of it.
    Measure("dup_lines", "n_dup_lines / (n_lines + 4)"),
    Measure("repeats", "n_repeat_words / n_words"),
)
TAIL = 0.99
RARE = 0.9
GAMMA = 1.02
PRIOR = 100  # texts
ZERO = -(1 << 20)  # the bin of the value 0

COUNTS = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")


def repeated_words(hashes: np.ndarray, width: int = WINDOW) -> int:
    """Words inside windows found twice or more, the first included."""
    if len(hashes) <= width:
        return 0
    found = windows(hashes, width)
    order = np.argsort(found, kind="stable")
    same = found[order[1:]] == found[order[:-1]]
    if not same.any():
        return 0
    twice = np.zeros(len(found), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    edges = np.zeros(len(hashes) + 1, np.int64)
    edges[:-width][twice] += 1
    edges[width:][twice] -= 1
    return int((np.cumsum(edges) > 0).sum())


def repeated_lines(text: bytes) -> tuple[int, int]:
    """Lines with a word, and those of them that are equal to an earlier line."""
    lines = [line for line in text.split(b"\n") if line and not line.isspace()]
    return len(lines), len(lines) - len(set(lines))


def counts_of(texts: list[bytes | None]):
    """The COUNTS of each text."""
    for text, (hashes, _, lengths) in zip(texts, hashed_texts(texts, SPLIT_AT_SPACE)):
        text = text or b""
        # Code points are the bytes that do not continue another.
        buf = np.frombuffer(text, np.uint8)
        inner = int(np.count_nonzero((buf & 0xC0) == 0x80))
        symbols = sum(map(text.count, (bytes([c]) for c in SYMBOLS)))
        yield (len(hashes), int(lengths.sum()) - inner, symbols, *repeated_lines(text), repeated_words(hashes))


def measured(docs: DataFrame, doc_id: str, text: str, lang: str, source: str) -> DataFrame:
    """(id, lang, source) and the COUNTS of every text."""
    rows = docs.select(
        F.col(doc_id).alias("id"), F.col(lang).alias("lang"), F.col(source).alias("source"), F.col(text).alias("words")
    )
    counts = [T.StructField(c, T.LongType()) for c in COUNTS]
    schema = T.StructType([*rows.schema.fields[:3], *counts])

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            columns = list(zip(*counts_of(text_bytes(batch.column(3))))) or [[] for _ in COUNTS]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], *(pa.array(c, pa.int64()) for c in columns)], schema.names
            )

    return rows.mapInArrow(run, schema)


def _value(m: Measure) -> F.Column:
    top, bottom = m.column.split(" / ")
    return F.coalesce(F.expr(f"try_divide(double({top}), {bottom})"), F.lit(0.0))


def _bins(rows: DataFrame) -> DataFrame:
    """(lang, source, measure, bin, n): the sketches of all groups."""
    cells = []
    for m in MEASURES:
        place = F.ceil(F.log(_value(m)) / F.log(F.lit(GAMMA))).cast("int")
        cells.append(F.struct(F.lit(m.name).alias("measure"), F.when(_value(m) > 0, place).otherwise(ZERO).alias("bin")))
    each = rows.select("lang", "source", F.inline(F.array(*cells)))
    return each.groupBy("lang", "source", "measure", "bin").agg(F.count(F.lit(1)).alias("n"))


def _points(sketches: DataFrame, *keys: str) -> DataFrame:
    """(keys, measure), the number of texts and the limits of the merged sketches."""
    merged = sketches.groupBy(*keys, "measure", "bin").agg(F.sum("n").alias("n"))
    # A sketch has one row for each bin, so these windows are short.
    whole = Window.partitionBy(*keys, "measure")
    upto = whole.orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    zero = F.col("bin") == ZERO
    placed = merged.withColumns(
        {
            "total": F.sum("n").over(whole),
            "zeros": F.sum(F.when(zero, F.col("n")).otherwise(0)).over(whole),
            "reach": F.sum("n").over(upto),
            "value": F.when(zero, 0.0).otherwise(F.pow(F.lit(GAMMA), F.col("bin"))),
        }
    )

    def quantile(q: float) -> F.Column:
        return F.min(F.when(F.col("reach") >= q * F.col("total"), F.col("value")))

    beyond = F.col("reach") - F.col("zeros") >= RARE * (F.col("total") - F.col("zeros"))
    rare = F.coalesce(F.min(F.when(~zero & beyond, F.col("value"))), F.lit(0.0))
    found = placed.groupBy(*keys, "measure").agg(
        F.max("total").alias("texts"),
        F.greatest(2 * quantile(TAIL) - quantile(0.5), rare).alias("high"),
        (2 * quantile(1 - TAIL) - quantile(0.5)).alias("low"),
    )
    return found


def limits(sketches: DataFrame) -> DataFrame:
    """(lang, source) and for each measure its lowest and highest value that is kept."""
    own = _points(sketches, "lang", "source")
    of_lang = _points(sketches, "lang").select(
        F.col("lang").alias("_lang"), F.col("measure").alias("_measure"), F.col("high").alias("lang_high"), F.col("low").alias("lang_low")
    )
    of_all = _points(sketches).select("measure", F.col("high").alias("all_high"), F.col("low").alias("all_low"))
    same = F.col("lang").eqNullSafe(F.col("_lang")) & (F.col("measure") == F.col("_measure"))
    every = own.join(of_lang, same).join(of_all, "measure")

    def blended(end: str) -> F.Column:
        weighed = F.col("texts") * F.col(end) + PRIOR * F.col(f"lang_{end}") + PRIOR * F.col(f"all_{end}")
        return weighed / (F.col("texts") + 2 * PRIOR)

    both = [m.name for m in MEASURES if m.both_sides]
    low = F.when(F.col("measure").isin(both), blended("low")).otherwise(float("-inf"))
    reach = F.struct(low.alias("low"), blended("high").alias("high"))
    return every.groupBy("lang", "source").agg(*[F.max(F.when(F.col("measure") == m.name, reach)).alias(m.name) for m in MEASURES])


def base_failed() -> F.Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def quality(
    docs: DataFrame,
    *,
    doc_id: str = "doc_id",
    text: str = "text",
    lang: str = "lang",
    source: str = "source",
) -> DataFrame:
    """<doc_id>, the COUNTS, base_failed and kept for every document."""
    rows = written(measured(docs, doc_id, text, lang, source).withColumn("base_failed", base_failed()), "measures")
    sketches = written(_bins(rows.where("not base_failed")), "sketches")
    # A row for each language and source.
    reach = written(limits(sketches), "limits")
    reach = bounded_broadcast(reach.select(F.col("lang").alias("_lang"), F.col("source").alias("_source"), *(m.name for m in MEASURES)))
    both = rows.join(reach, F.col("lang").eqNullSafe(F.col("_lang")) & F.col("source").eqNullSafe(F.col("_source")), "left")
    inside = F.lit(True)
    for m in MEASURES:
        inside &= F.coalesce(_value(m).between(F.col(f"{m.name}.low"), F.col(f"{m.name}.high")), F.lit(False))
    return both.select(F.col("id").alias(doc_id), *COUNTS, "base_failed", (~F.col("base_failed") & inside).alias("kept"))
