"""Text expressions; all of them stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# A word of two or more word characters, in any script.
WORD = r"[\p{L}\p{N}_]{2,}"
# Common English words that say little about a text's topic.
ENGLISH_STOP_WORDS = tuple(
    "about above after again all also am an and any are as at be because been before being below between both but by "
    "can could did do does doing down during each else ever few for from further had has have having he her here hers "
    "him his how however if in into is it its itself just me more most much must my myself no nor not now of off on "
    "once only or other our ours out over own same she should so some such than that the their theirs them then there "
    "these they this those through to too under until up upon us very was we were what when where which while who whom "
    "why will with within without would yet you your yours".split()
)


def normalized(text: Column) -> Column:
    """Lower case without punctuation; NULL becomes the empty string."""
    return F.coalesce(F.regexp_replace(F.lower(text), r"(?U)[^\w\s]", ""), F.lit(""))


def words(text: Column) -> Column:
    """Array of the lower-cased words of a text; empty for NULL."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))


def occurrences(text: Column, keyword: str) -> Column:
    """Number of non-overlapping occurrences of keyword in text; 0 of an empty one, NULL in NULL.

    Bytes are counted, which needs no pass over the text, and only texts that hold the keyword are copied.
    """
    if not keyword:
        return F.when(text.isNotNull(), 0).cast("long")
    gone = F.octet_length(text) - F.octet_length(F.replace(text, F.lit(keyword), F.lit("")))
    return F.when(F.contains(text, F.lit(keyword)), gone / len(keyword.encode())).when(text.isNotNull(), 0).cast("long")
