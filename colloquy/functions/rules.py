"""Ordered keyword rules and the other label expressions."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Rules = Sequence[tuple[str, Sequence[str]]]

# Topic rules, in the order in which they are tried.
TOPIC_RULES: Rules = (
    ("Flight Information", ("flight", "arrival", "departure")),
    ("Restaurant", ("menu", "food", "restaurant")),
    ("Operating Hours", ("hours", "open")),
)
TOPIC_DEFAULT = "Other"

# Intent rules, in the order in which they are tried.
INTENT_RULES: Rules = (
    ("booking", ("book", "reserve", "appointment")),
    ("pricing", ("price", "cost", "how much")),
    ("hours", ("open", "close", "hour")),
    ("menu", ("menu", "food", "dish")),
    ("cancellation", ("cancel", "refund")),
)
INTENT_DEFAULT = "other"

# Sentiment categories and the upper edges of the first two bins.
SENTIMENTS = ("negative", "neutral", "positive")
NEGATIVE_UP_TO = -0.05
NEUTRAL_UP_TO = 0.05


def rules_from_table(table: DataFrame, *, max_keywords: int = 10_000) -> Rules:
    """Rules from a (priority, label, keyword) table.

    Rules become expressions, so a table of more than ``max_keywords`` rows raises.
    """
    rows = table.select("priority", "label", "keyword").limit(max_keywords + 1).collect()
    if len(rows) > max_keywords:
        raise ValueError(f"a rule table may hold at most {max_keywords} keywords")
    grouped: dict[tuple[int, str], list[str]] = {}
    for row in sorted(rows):
        grouped.setdefault((row.priority, row.label), []).append(row.keyword)
    return tuple((label, tuple(keywords)) for (_, label), keywords in grouped.items())


def label_by_rules(text: Column | str, rules: Rules, default: str) -> Column:
    """The first rule with a keyword inside the lower-cased text names the label.

    NULL text gets the default.
    """
    lowered = F.lower(F.col(text) if isinstance(text, str) else text)
    label = None
    for name, keywords in rules:
        hit = reduce(or_, (lowered.contains(k) for k in keywords))
        label = F.when(hit, name) if label is None else label.when(hit, name)
    return F.lit(default) if label is None else label.otherwise(default)


def labels_of(rules: Rules, default: str) -> list[str]:
    """Every label the rules can give, each once, in rule order."""
    return list(dict.fromkeys([name for name, _ in rules] + [default]))


def with_topic(chats: DataFrame, rules: Rules = TOPIC_RULES, default: str = TOPIC_DEFAULT) -> DataFrame:
    return chats.withColumn("topic", label_by_rules("question", rules, default))


def with_intent(chats: DataFrame, rules: Rules = INTENT_RULES, default: str = INTENT_DEFAULT) -> DataFrame:
    return chats.withColumn("intent", label_by_rules("question", rules, default))


def sender() -> Column:
    """A row with a question comes from the user, else one with an answer from the bot."""
    return F.when(F.col("question").isNotNull(), "user").when(F.col("answer").isNotNull(), "bot")


def with_sender(chats: DataFrame) -> DataFrame:
    return chats.withColumn("sender", sender())


def sentiment_category(score: Column) -> Column:
    """Right-closed bins over (-1, 1]; -1 itself and anything outside is NULL."""
    low, mid, high = SENTIMENTS
    return (
        F.when((score > -1) & (score <= NEGATIVE_UP_TO), low)
        .when((score > NEGATIVE_UP_TO) & (score <= NEUTRAL_UP_TO), mid)
        .when((score > NEUTRAL_UP_TO) & (score <= 1), high)
    )
