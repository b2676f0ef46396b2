"""Lexicon sentiment of texts.

The scoring follows the published VADER rules (Hutto and Gilbert 2014) on a
lexicon the caller supplies as a (term, valence) table:

* negations and intensity words in the three words before a term, unless these are terms
  themselves; "never so" strengthens, "without doubt" does not negate, and "least" negates
  unless it is "at least" or "very least";
* an intensity word has no valence of its own, neither has "kind" in "kind of";
* idioms around a term, up to three words before and two after it, replace its valence, and
  "sort of" before it weakens it (both only where a third word stands before the term and is no
  term, as published);
* capitals for emphasis in a text of mixed case, on terms and intensity words;
* emoticons: terms of the lexicon that are not words count where blanks stand around them;
* the shift at the first "but", exclamation and question marks, and the normalisation to (-1, 1).

A text without any term scores 0.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.rules import SENTIMENTS, sentiment_category
from ..functions.skew import BROADCAST_ROWS

# A token is a run of word characters and apostrophes.
TOKEN = r"[\p{L}\p{N}_']+"
# The published constants of the scoring.
NEGATION = -0.74
INTENSITY = 0.293
DAMPING = (1.0, 0.95, 0.9)
CAPITALS = 0.733
BEFORE_BUT = 0.5
AFTER_BUT = 1.5
EXCLAMATION = 0.292
MAX_EXCLAMATIONS = 4
QUESTION = 0.18
MANY_QUESTIONS = 0.96
NEVER_SO = (1.5, 1.25)  # "never" two and three words before the term
ALPHA = 15.0

# Single words that turn, strengthen or weaken what follows.
NEGATIONS = (
    "not", "no", "never", "none", "nobody", "nothing", "neither", "nor", "nowhere", "cannot",
    "without", "rarely", "seldom", "despite",
)
STRENGTHENERS = (
    "very", "extremely", "really", "so", "absolutely", "completely", "totally", "particularly",
    "incredibly", "highly", "especially", "more", "most", "deeply", "truly", "quite", "too",
)
WEAKENERS = ("barely", "hardly", "slightly", "somewhat", "partly", "less", "almost", "scarcely")
# Pairs of words that weaken what follows, and idioms with their valence.
WEAKENING_PAIRS = ("kind of", "sort of", "just enough")
IDIOMS = (
    ("the bomb", 3.0), ("bad ass", 1.5), ("yeah right", -2.0), ("cut the mustard", 2.0), ("kiss of death", -1.5),
    ("hand to mouth", -2.0),
)

# A small general lexicon of our own.
DEFAULT_LEXICON = (
    ("amazing", 2.8), ("annoying", -1.7), ("awful", -2.0), ("bad", -2.5), ("best", 3.2),
    ("better", 1.9), ("broken", -1.6), ("cancel", -0.9), ("clear", 1.0), ("confusing", -1.3),
    ("delay", -1.3), ("delayed", -1.2), ("disappointed", -1.9), ("easy", 1.9), ("error", -1.4),
    ("excellent", 2.7), ("fail", -2.5), ("fast", 1.2), ("fine", 0.8), ("friendly", 2.2),
    ("good", 1.9), ("great", 3.1), ("happy", 2.7), ("hate", -2.7), ("help", 1.7),
    ("helpful", 1.8), ("horrible", -2.5), ("late", -0.8), ("like", 1.5), ("lost", -1.3),
    ("love", 3.2), ("nice", 1.8), ("perfect", 2.7), ("problem", -1.7), ("rude", -2.0),
    ("sad", -2.1), ("slow", -1.0), ("sorry", -0.3), ("terrible", -2.1), ("thank", 1.5),
    ("thanks", 1.9), ("useful", 1.9), ("useless", -1.8), ("worst", -3.1), ("wrong", -2.1),
)


# A lexicon counted to hold no more terms than this also sorts out, inside each text, the
# words that are no terms; a larger one meets all words in its joins.
LISTED_TERMS = 10_000
MAX_EMOTICONS = 1_000


@dataclass(frozen=True)
class Modifiers:
    """Words that change the terms near them, in lower case; replace them for another language."""

    negations: Sequence[str] = NEGATIONS
    strengtheners: Sequence[str] = STRENGTHENERS
    weakeners: Sequence[str] = WEAKENERS
    never: Sequence[str] = ("never",)
    so: Sequence[str] = ("so", "this")
    without: Sequence[str] = ("without",)
    doubt: Sequence[str] = ("doubt",)
    least: Sequence[str] = ("least",)
    before_least: Sequence[str] = ("at", "very")
    unweighted_pairs: Sequence[str] = ("kind of",)
    weakening_pairs: Sequence[str] = WEAKENING_PAIRS
    idioms: Sequence[tuple[str, float]] = IDIOMS


def lexicon_table(spark: SparkSession, terms: Sequence[tuple[str, float]] = DEFAULT_LEXICON) -> DataFrame:
    return spark.createDataFrame(list(terms), "term string, valence double")


def _sign(value: Column) -> Column:
    return F.when(value < 0, -1.0).otherwise(1.0)


def _in(word: Column, words: Sequence[str]) -> Column:
    return F.coalesce(word.isin(*words), F.lit(False)) if words else F.lit(False)


# The parts that a word can play, as bits: one look-up a word keeps the generated code small
# enough to be compiled.
ROLES = ("negations", "strengtheners", "weakeners", "never", "so", "without", "doubt", "least", "before_least")


def _lookup(table: Mapping, key: Column) -> Column:
    """The value of a short constant table, NULL for another key."""
    if not table:
        return F.lit(None)
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), key)


def _roles(word: Column, modifiers: Modifiers) -> Column:
    bits: dict[str, int] = {}
    for k, role in enumerate(ROLES):
        for listed in getattr(modifiers, role):
            bits[listed] = bits.get(listed, 0) | 1 << k
    negated = F.when(word.endswith("n't"), 1 << ROLES.index("negations")).otherwise(0)
    return F.coalesce(_lookup(bits, word).cast("int"), F.lit(0)).bitwiseOR(negated)


def _plays(roles: Column, *names: str) -> Column:
    return roles.bitwiseAND(sum(1 << ROLES.index(name) for name in names)) != 0


def _phrase(*names: str) -> Column:
    """The words with blanks between; a missing word is empty, so such a phrase is none that is listed."""
    return F.concat(*[part for name in names for part in (F.lit(" "), F.col(name))][1:])


def _idiom(valence: Column, modifiers: Modifiers) -> Column:
    phrases = [
        _phrase("word", "n1", "n2"), _phrase("word", "n1"),  # what stands after the term counts last
        _phrase("p1", "word"), _phrase("p2", "p1", "word"), _phrase("p2", "p1"), _phrase("p3", "p2", "p1"), _phrase("p3", "p2"),
    ]
    idioms = dict(reversed(modifiers.idioms))
    known = [_lookup(idioms, phrase).cast("double") for phrase in phrases]
    weakened = _in(_phrase("p3", "p2"), modifiers.weakening_pairs) | _in(_phrase("p2", "p1"), modifiers.weakening_pairs)
    return F.coalesce(*known, valence) - F.when(weakened, INTENSITY).otherwise(0.0)


def _after_words(tokens: DataFrame, modifiers: Modifiers) -> DataFrame:
    """Change the valence by the words around the term, the nearest before it first.

    One projection per word: as a single expression the valence would be
    repeated in every branch and the generated method would grow too large to
    be compiled.
    """
    r1, r2, r3, valence = (F.col(c) for c in ("r1", "r2", "r3", "valence"))
    tokens = tokens.withColumns({f"r{n}": _roles(F.col(f"p{n}"), modifiers) for n in (1, 2, 3)})
    said = {
        1: (F.lit(False), F.lit(False)),
        2: (_plays(r2, "never") & _plays(r1, "so"), _plays(r2, "without") & _plays(r1, "doubt")),
        3: (_plays(r3, "never") & _plays(r2.bitwiseOR(r1), "so"), _plays(r3, "without") & _plays(r2.bitwiseOR(r1), "doubt")),
    }
    for n, damping, never_so in zip((1, 2, 3), DAMPING, (1.0, *NEVER_SO)):
        roles, (never, doubtless) = F.col(f"r{n}"), said[n]
        counts = (F.col(f"p{n}") != "") & ~F.col(f"p{n}_is_term")
        strength = F.when(_plays(roles, "strengtheners"), INTENSITY).when(_plays(roles, "weakeners"), -INTENSITY).otherwise(0.0)
        loud = F.when(_plays(roles, "strengtheners", "weakeners") & F.col("mixed_case") & _in_capitals(F.col(f"t{n}")), CAPITALS)
        change = (strength + F.coalesce(loud, F.lit(0.0))) * damping
        negated = ~doubtless & _plays(roles, "negations")
        factor = F.when(~counts, 1.0).when(never, never_so).when(negated, NEGATION).otherwise(1.0)
        tokens = tokens.withColumns({"_change": F.when(counts, change).otherwise(0.0), "_factor": factor})
        tokens = tokens.withColumn("valence", (valence + F.col("_change") * _sign(valence)) * F.col("_factor"))
    idiomatic = (F.col("p3") != "") & ~F.col("p3_is_term")
    tokens = tokens.withColumn("valence", F.when(idiomatic, _idiom(valence, modifiers)).otherwise(valence))
    least = _plays(r1, "least") & ~F.col("p1_is_term") & ~_plays(r2, "before_least")
    return tokens.withColumn("valence", F.when(least, valence * NEGATION).otherwise(valence))


def _in_capitals(token: Column) -> Column:
    return (token == F.upper(token)) & (token != F.lower(token))


def _read(lexicon: DataFrame) -> tuple[int, list[str] | None, list[str]]:
    """How many terms there are, all of them if they are few, and those that are no words."""
    symbol = ~F.col("term").rlike(rf"\A{TOKEN}\z") & ~F.col("term").rlike(r"\s") & (F.col("term") != "")
    terms = lexicon.select("term", symbol.alias("symbol")).filter("term IS NOT NULL")
    listed = terms.limit(LISTED_TERMS + 1).collect()
    if len(listed) <= LISTED_TERMS:
        size, symbols = len(listed), [row.term for row in listed if row.symbol]
    else:
        size, symbols = terms.count(), [row.term for row in terms.filter("symbol").limit(MAX_EMOTICONS + 1).collect()]
    if len(symbols) > MAX_EMOTICONS:
        raise ValueError(f"a lexicon may hold at most {MAX_EMOTICONS} terms that are no words")
    return size, [row.term for row in listed] if size <= LISTED_TERMS else None, symbols


def _token_pattern(symbols: Sequence[str]) -> str:
    """Words, and the given terms with blanks around them."""
    quoted = "|".join("\\Q" + term.replace("\\E", "\\E\\\\E\\Q") + "\\E" for term in sorted(symbols))
    return rf"(?<!\S)(?iu:{quoted})(?!\S)|{TOKEN}" if symbols else TOKEN


def _marks(text: Column, mark: str) -> Column:
    """How often the mark is in the text; most texts have none."""
    return F.when(F.contains(text, F.lit(mark)), F.length(text) - F.length(F.replace(text, F.lit(mark), F.lit("")))).otherwise(0)


def _punctuation(text: Column) -> Column:
    asks = _marks(text, "?")
    questions = F.when(asks > 3, MANY_QUESTIONS).when(asks > 1, asks * QUESTION).otherwise(0.0)
    return F.least(_marks(text, "!"), F.lit(MAX_EXCLAMATIONS)) * EXCLAMATION + questions


def _compound(total: Column, punctuation: Column) -> Column:
    total = F.when(total > 0, total + punctuation).when(total < 0, total - punctuation).otherwise(0.0)
    return F.round(total / F.sqrt(total * total + ALPHA), 4)


def score_texts(
    rows: DataFrame,
    lexicon: DataFrame,
    columns: Sequence[str] = ("question", "answer"),
    *,
    keep: Sequence[str] = ("id",),
    modifiers: Modifiers = Modifiers(),
) -> DataFrame:
    """``keep`` and, for each text column, its score as ``<column>_sentiment``.

    Rows with equal ``keep`` must have equal texts, and give one row. The tokens of
    a text meet the lexicon where they are split, so only one number per text is
    shuffled; with a lexicon of up to LISTED_TERMS terms, only these become rows at all.
    A whole text is scored, however long it is; NULL text scores 0. Terms are in lower case.
    """
    lexicon = lexicon.select("term", "valence")
    size, listed, symbols = _read(lexicon)
    sides = F.array(*[F.struct(F.lit(i).alias("side"), F.coalesce(c, F.lit("")).alias("text")) for i, c in enumerate(columns)])
    token = F.regexp_extract_all("text", F.lit(_token_pattern(symbols)), F.lit(0))
    texts = rows.select(*keep, F.inline(sides)).withColumn("token", token)
    texts = texts.withColumn("places", F.transform("token", lambda t, i: F.when(_in(F.lower(t), listed), i) if listed is not None else i))
    mixed = F.exists("token", lambda t: _in_capitals(t)) & F.exists("token", lambda t: ~_in_capitals(t))
    but_at = F.array_position(F.transform("token", F.lower), "but") - 1

    def hit(i: Column) -> Column:
        around = {"t0": 0, "t1": 1, "t2": 2, "t3": 3, "a1": -1, "a2": -2}
        return F.struct(i.alias("at"), *[F.get("token", i - k).alias(name) for name, k in around.items()])

    # Only the terms and the words around them become rows, not the arrays.
    texts = texts.select(
        *keep, "side",
        F.when(F.contains(F.lower("text"), F.lit("but")), but_at).alias("but_at"),
        mixed.alias("mixed_case"),
        _punctuation(F.col("text")).alias("punctuation"),
        F.transform(F.filter("places", lambda i: i.isNotNull()), hit).alias("hits"),
    )
    # A text without a term gives a row without a place.
    tokens = texts.select(*keep, "side", "but_at", "mixed_case", "punctuation", F.posexplode_outer("hits").alias("nth", "t"))
    tokens = tokens.select(
        *keep, "side", "nth", "but_at", "punctuation", F.coalesce("mixed_case", F.lit(False)).alias("mixed_case"), F.col("t.at").alias("at"),
        *[F.coalesce(f"t.t{n}", F.lit("")).alias(f"t{n}") for n in range(4)],
        *[F.coalesce(F.lower(f"t.t{n}"), F.lit("")).alias(name) for n, name in enumerate(("word", "p1", "p2", "p3"))],
        *[F.coalesce(F.lower(f"t.a{n}"), F.lit("")).alias(f"n{n}") for n in (1, 2)],
    )
    at, before = F.col("at"), ("p1", "p2", "p3")
    terms = F.broadcast(lexicon) if size <= BROADCAST_ROWS else lexicon
    for name in before:
        if listed is not None:
            tokens = tokens.withColumn(f"{name}_is_term", _in(F.col(name), listed))
        else:
            known = terms.select(F.col("term").alias(name), F.lit(True).alias("_known")).distinct()
            tokens = tokens.join(known, name, "left").withColumn(f"{name}_is_term", F.col("_known").isNotNull()).drop("_known")
    no_weight = _plays(_roles(F.col("word"), modifiers), "strengtheners", "weakeners") | _in(_phrase("word", "n1"), modifiers.unweighted_pairs)
    valence = F.col("valence") + F.when(F.col("mixed_case") & _in_capitals(F.col("t0")), _sign(F.col("valence")) * CAPITALS).otherwise(0.0)
    shift = (
        F.when(F.col("but_at").isNull() | F.col("at").isNull() | (F.col("but_at") < 0) | (at == F.col("but_at")), 1.0)
        .when(at < F.col("but_at"), BEFORE_BUT)
        .otherwise(AFTER_BUT)
    )
    found = tokens.join(terms.withColumnRenamed("term", "word"), "word", "left")
    found = found.withColumns({"counts": F.col("valence").isNotNull() & ~no_weight, "valence": F.coalesce("valence", F.lit(0.0))})
    found = found.withColumn("valence", valence)
    weight = F.when(F.col("counts"), F.col("valence") * shift).otherwise(0.0)
    weighted = _after_words(found, modifiers).withColumn("weight", weight)
    sums = []
    for i, column in enumerate(columns):
        side = F.col("side") == i
        copies = F.greatest(F.count_if(side & (F.coalesce("nth", F.lit(0)) == 0)), F.lit(1))
        sums.append((F.coalesce(F.sum(F.when(side, F.col("weight"))), F.lit(0.0)) / copies).alias(f"_sum{i}"))
        sums.append(F.max(F.when(side, F.col("punctuation"))).alias(f"_marks{i}"))
    return weighted.groupBy(*keep).agg(*sums).select(
        *keep,
        *[_compound(F.col(f"_sum{i}"), F.col(f"_marks{i}")).alias(f"{c}_sentiment") for i, c in enumerate(columns)],
    )


def with_categories(scores: DataFrame) -> DataFrame:
    """Add ``<column>_sentiment_category`` for every score column."""
    names = [c for c in scores.columns if c.endswith("_sentiment")]
    return scores.select("*", *[sentiment_category(F.col(c)).alias(f"{c}_category") for c in names])


def with_sentiment(
    chats: DataFrame, lexicon: DataFrame, columns: Sequence[str] = ("question", "answer")
) -> DataFrame:
    """Chats with scores and categories.

    Scores are joined on the id and two hashes of the texts: NULL and repeated ids lose or
    multiply no rows, and a text that many rows have is spread by their ids.
    """
    keys = {f"_text{k}": F.xxhash64(F.lit(k), *columns) for k in (1, 2)}
    keyed = chats.withColumns(keys)
    scores = with_categories(score_texts(keyed, lexicon, columns, keep=("id", *keys)))
    scores = scores.withColumnsRenamed({c: f"{c}_" for c in ("id", *keys)})
    same = [F.col(c).eqNullSafe(F.col(f"{c}_")) for c in ("id", *keys)]
    return keyed.join(scores, same).drop(*keys, *(f"{c}_" for c in ("id", *keys)))


def sentiment_by_client(chats: DataFrame, lexicon: DataFrame) -> DataFrame:
    """Mean question sentiment per client; no join back to the rows."""
    keyed = chats.filter(F.col("client_id").isNotNull())
    scores = score_texts(keyed, lexicon, ("question",), keep=("id", "client_id"))
    return scores.groupBy("client_id").agg(F.avg("question_sentiment").alias("avg_sentiment"))


def sentiment_distribution(scored: DataFrame, column: str = "question_sentiment_category") -> DataFrame:
    """Rows per category, most frequent first; categories without rows show 0."""
    counts = scored.agg(*[F.count_if(F.col(column) == name).alias(name) for name in SENTIMENTS])
    cells = [F.struct(F.lit(name).alias("sentiment"), F.col(name).alias("count")) for name in SENTIMENTS]
    return counts.select(F.inline(F.array(*cells))).orderBy(F.desc("count"), "sentiment")


def sentiment_over_time(scored: DataFrame) -> DataFrame:
    return scored.select("created_at", "question_sentiment", "question_sentiment_category")
