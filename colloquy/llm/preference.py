"""Preference formatting of chosen and rejected conversations, in DataFrame functions alone.

The longest common prefix of turns (equal role and text) of a pair is rendered once
as the prompt; what follows on either side is its completion. A completion's mask
lists the character spans that are trained on: the texts of the trained role and
the marks that end them.

Turns are ordered by number, then role and text. Markers inside a text are broken
up by a blank, so that no text can pose as a turn. One shuffle, by pair; running
lengths and grouping share it.

Defined results: null roles and texts render as empty ones and equal each other;
rows that repeat are turns that repeat; a pair of equal conversations has two empty
completions; a side that is missing has a null completion and mask, and then the
prompt is empty; rows without a pair or a side are left out; other columns are not
read. A conversation is one row of the result, and so is bounded as any row is.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    """How a turn is rendered: opening + role + middle + text + closing + gap."""

    opening: str = "<|im_start|>"
    middle: str = "\n"
    closing: str = "<|im_end|>"
    gap: str = "\n"
    # What is broken up in texts, and how.
    marker: str = "<|"
    broken: str = "< |"


SIDES = ("chosen", "rejected")


def format_pairs(
    turns: DataFrame,
    *,
    pair: str = "pair_id",
    side: str = "side",
    turn: str = "turn",
    role: str = "role",
    text: str = "text",
    trained: str = "assistant",
    template: Template = Template(),
) -> DataFrame:
    """<pair>, n_prompt_turns, prompt, and for both sides completion and mask.

    ``turns`` has a row for each turn; ``side`` is "chosen" or "rejected".
    """
    t = template
    rows = turns.select(
        F.col(pair).alias("pair"),
        F.col(side).alias("side"),
        F.col(turn).alias("turn"),
        F.coalesce(F.col(role), F.lit("")).alias("role"),
        F.replace(F.coalesce(F.col(text), F.lit("")), F.lit(t.marker), F.lit(t.broken)).alias("text"),
    ).where(F.col("pair").isNotNull() & F.col("side").isin(*SIDES))
    rows = rows.withColumn(
        "rendered", F.concat(F.lit(t.opening), "role", F.lit(t.middle), "text", F.lit(t.closing), F.lit(t.gap))
    )
    order = "partition by pair, side order by turn, role, text rows between unbounded preceding and current row"
    rows = rows.repartition("pair").withColumn("end", F.expr(f"sum(length(rendered)) over ({order})"))
    rows = rows.withColumn("place", F.expr(f"row_number() over (partition by pair, side order by turn, role, text)"))
    item = F.struct("place", "role", "text", "rendered", "end")
    sides = [F.array_sort(F.collect_list(F.when(F.col("side") == s, item))).alias(s) for s in SIDES]
    pairs = rows.groupBy("pair").agg(*sides)
    same = F.zip_with("chosen", "rejected", lambda x, y: x.isNotNull() & y.isNotNull() & (x["role"] == y["role"]) & (x["text"] == y["text"]))
    mismatch = F.array_position(same, F.lit(False))
    pairs = pairs.withColumn("n_prompt_turns", F.when(mismatch == 0, F.size("chosen").cast("long")).otherwise(mismatch - 1))

    def rendered(turns_: Column) -> Column:
        return F.array_join(F.transform(turns_, lambda x: x["rendered"]), "")

    def completion(name: str) -> list[Column]:
        here = F.size(name) > 0
        rest = F.filter(name, lambda x: x["place"] > F.col("n_prompt_turns"))
        spans = F.transform(
            F.filter(rest, lambda x: x["role"] == trained),
            lambda x: F.struct(
                (x["end"] - len(t.gap) - len(t.closing) - F.length(x["text"]) - F.col("prompt_length")).alias("start"),
                (x["end"] - len(t.gap) - F.col("prompt_length")).alias("end"),
            ),
        )
        return [F.when(here, rendered(rest)).alias(name), F.when(here, spans).alias(f"{name}_mask")]

    prompt = rendered(F.filter("chosen", lambda x: x["place"] <= F.col("n_prompt_turns")))
    pairs = pairs.withColumn("prompt", prompt).withColumn("prompt_length", F.length("prompt"))
    return pairs.select(
        F.col("pair").alias(pair), "n_prompt_turns", "prompt", *completion("chosen"), *completion("rejected")
    )
