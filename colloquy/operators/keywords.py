"""Keyword rules from tables of any size.

A keyword without a blank lies inside one word (a run without blanks) of a text or not in it
at all. So the keywords are sought in the vocabulary, every different word of all
texts once, and not in the texts. There an index of shared grams finds them: of each
keyword one gram of up to GRAM characters stands for it, the one that the fewest other
keywords have; the words are joined to the index on their grams, and what meets is
compared in full. The texts then meet the words that hold keywords by equality.

A keyword with one run of blanks lies inside one joint of a text, a run of blanks and the words
on both sides, or not in it at all. The joints meet a broadcast index of the keywords by the last and first
characters beside the blanks, where the texts are read, and are compared in full. Of a keyword with
more runs the longest joint is sought; texts that hold it are compared.

Nothing is brought to the driver but the lengths of the grams, and tables are broadcast only
where they are counted to be small, or in slices of a counted size. Of texts and words nothing is shuffled but
the words' counts and the occurrences of rare ones. What grows faster than texts and keywords is
the number of pairs of a word and a keyword that share the keyword's gram.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ranking import ranks
from ..functions.rules import Rules
from ..functions.skew import BROADCAST_ROWS, broadcast_if_small, small_enough
from ..session import written

GRAM = 3
# Characters on each side of the blanks by which joints meet keywords.
ENDS = 2
# Keywords with blanks that are broadcast at once.
SLICE = 500_000
BLANKS = r"\s+"
MAX_BLANK = 100


def rule_table(spark, rules: Rules) -> DataFrame:
    """A (priority, label, keyword) table of an ordered list of rules."""
    rows = [(i, label, keyword) for i, (label, keywords) in enumerate(rules) for keyword in keywords]
    return spark.createDataFrame(rows, "priority int, label string, keyword string")


def _words(text: Column) -> Column:
    return F.filter(F.split(text, BLANKS), lambda w: w != "")


def _grams(word: str, n: int) -> Column:
    """Every n characters that follow each other in the word."""
    return F.regexp_extract_all(word, F.lit(f"(?s)(?=(.{{{n}}}))"), F.lit(1))


def _anchored(keywords: DataFrame) -> DataFrame:
    """Keywords without a blank, with a gram."""
    anchored = keywords.filter(~F.col("keyword").rlike(BLANKS) & (F.length("keyword") > 0))
    distinct = anchored.select("keyword").distinct()
    length = F.least(F.length("keyword"), F.lit(GRAM))
    choices = F.when(length == 1, _grams("keyword", 1)).when(length == 2, _grams("keyword", 2)).otherwise(_grams("keyword", GRAM))
    grams = distinct.select("keyword", F.explode(F.array_distinct(choices)).alias("gram"))
    rarity = grams.groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    chosen = grams.join(rarity, "gram").groupBy("keyword").agg(F.min(F.struct("n", "gram"))["gram"].alias("gram"))
    return anchored.join(chosen, "keyword")


def _in_words(vocabulary: DataFrame, index: DataFrame) -> DataFrame:
    """The words of the vocabulary with each row of the index whose keyword they hold."""
    lengths = sorted(row.n for row in index.select(F.length("gram").alias("n")).distinct().collect())
    if not lengths:
        return vocabulary.join(index, F.lit(False))
    grams = F.array_distinct(F.concat(*[_grams("word", n) for n in lengths]))
    pairs = vocabulary.withColumn("gram", F.explode(grams)).join(broadcast_if_small(index), "gram")
    return pairs.filter(F.contains("word", "keyword"))


def _joints(text: Column) -> Column:
    """Every run of blanks of a text, in order, with the words before and after, empty at the ends."""
    words, runs = F.split(text, BLANKS), F.regexp_extract_all(text, F.lit(f"({BLANKS})"), F.lit(1))
    both = F.array(F.struct(words.alias("words"), runs.alias("runs")))
    listed = F.transform(
        both,
        lambda b: F.transform(
            b["runs"], lambda run, i: F.struct(F.get(b["words"], i).alias("before"), run.alias("run"), F.get(b["words"], i + 1).alias("after"))
        ),
    )
    return F.get(listed, 0)


def _ends(i: Column | int, j: Column | int) -> Column:
    """The last i characters before the blanks and the first j after them."""
    tail, head = (F.right("before", F.lit(i) if isinstance(i, int) else i), F.left("after", F.lit(j) if isinstance(j, int) else j))
    return F.concat(tail, F.lit(" "), head)


def _joined(keywords: DataFrame) -> DataFrame:
    """Keywords with blanks: their longest joint, whether that is all of them, and its ends."""
    size = lambda j: F.length(j["before"]) + F.length(j["run"]) + F.length(j["after"])
    spaced = keywords.filter(F.col("keyword").rlike(BLANKS) & F.col("keyword").rlike(r"\S")).withColumn("_all", _joints(F.col("keyword")))
    longest = F.get(F.array_sort("_all", lambda a, b: size(b) - size(a)), 0)
    joined = spaced.withColumn("whole", F.size("_all") == 1).withColumn("_longest", longest).drop("_all").select("*", "_longest.*").drop("_longest")
    i, j = (F.least(F.length(c), F.lit(ENDS)) for c in ("before", "after"))
    joined = joined.withColumn("key", _ends(i, j)).withColumns({"shape": i * 10 + j, "part": F.concat("before", "run", "after")})
    return joined.withColumnsRenamed({"before": "head", "after": "tail"}).drop("run")


def _at_joints(texts: DataFrame, index: DataFrame) -> DataFrame:
    """The texts' joints (place, before, run, after) with each row of the index whose part they hold.

    The index is broadcast, in slices of a counted size: the joints, as many as words, are not shuffled.
    """
    shapes = sorted(row["shape"] for row in index.select("shape").distinct().collect())
    said = texts.withColumn("joints", _joints(F.col("text"))).select(*[c for c in texts.columns if c != "text"], F.posexplode("joints").alias("place", "joint"))
    said = said.select("*", "joint.*").drop("joint")
    if not shapes:
        return said.join(index.drop("shape"), F.lit(False))
    # Words too short for a shape have no key of it, so that no keyword is met twice at a joint.
    fits = [(F.length("before") >= s // 10) & (F.length("after") >= s % 10) for s in shapes]
    said = said.withColumn("key", F.explode(F.array(*[F.when(fit, _ends(s // 10, s % 10)) for fit, s in zip(fits, shapes)])))
    slices = max(1, -(-index.count() // SLICE))
    parts = [index.drop("shape").filter(F.pmod(F.xxhash64("keyword"), F.lit(slices)) == k) for k in range(slices)]
    met = reduce(DataFrame.unionByName, [said.join(F.broadcast(part), "key") for part in parts])
    return met.filter(F.contains(F.concat("before", "run", "after"), F.col("part")))


def _blank(keywords: DataFrame) -> list:
    """Keywords of nothing but blanks, which are in no word. More than MAX_BLANK raise."""
    rows = keywords.filter(F.size(_words(F.col("keyword"))) == 0).limit(MAX_BLANK + 1).collect()
    if len(rows) > MAX_BLANK:
        raise ValueError(f"at most {MAX_BLANK} keywords may be of nothing but blanks")
    return rows


def label_by_table(
    rows: DataFrame, rules: DataFrame, *, default: str, column: str = "question", label: str = "topic", row_id: str = "id"
) -> DataFrame:
    """The rows with the label of the first rule that has a keyword inside their lower-cased text.

    ``rules`` is a (priority, label, keyword) table of any size; the least (priority, label) wins.
    The result is that of :func:`..functions.rules.label_by_rules`: an empty keyword is in
    every text, NULL text gets the default, and a NULL keyword is in none. Repeated and NULL ids
    do no harm.
    """
    keys = {f"_key{k}": F.xxhash64(F.lit(k), column) for k in (1, 2)}
    keyed = rows.withColumns(keys)
    names = ("_id", *keys)
    texts = keyed.select(F.col(row_id).alias("_id"), *keys, F.lower(column).alias("text")).filter("text IS NOT NULL")
    rule = F.struct(F.col("priority"), F.col("label"))
    listed = written(rules.filter("keyword IS NOT NULL").groupBy("keyword").agg(F.min(rule).alias("rule")), "keywords")
    # Rules go by their number: the least of each text is kept where it is read.
    numbered = written(ranks(listed.select("rule").distinct(), "rule", name="number"), "rules")
    same_rule = F.col("l.rule").eqNullSafe(F.col("r.rule"))
    by_number = listed.alias("l").join(broadcast_if_small(numbered).alias("r"), same_rule).select("keyword", "number")
    by_number = written(by_number, "numbered-keywords")
    found = _least_by_words(texts, names, written(_anchored(by_number), "keyword-index"))
    joints = written(_joined(by_number), "joint-index")
    whole, longer = joints.filter("whole"), joints.filter("not whole")
    if not whole.isEmpty():
        found = found.unionByName(_at_joints(texts, whole).select(*names, "number"))
    if not longer.isEmpty():
        # Keywords with blanks at several places: texts that hold the longest joint are compared.
        candidates = _at_joints(texts, longer).groupBy(*names, "keyword").agg(F.min("number").alias("number"))
        same = [F.col(f"t.{c}").eqNullSafe(F.col(f"c.{c}")) for c in names]
        compared = texts.alias("t").join(candidates.alias("c"), same).filter(F.contains("text", "keyword"))
        found = found.unionByName(compared.select(*[f"t.{c}" for c in names], "number"))
    found = found.groupBy(*names).agg(F.min("number").alias("number"))
    found = found.join(broadcast_if_small(numbered), "number").select(*names, "rule")
    blank = _blank(listed)
    if blank:
        rule_type = listed.schema["rule"].dataType
        held = [F.when(F.contains("text", F.lit(b.keyword)), F.lit(b.rule.priority)) for b in blank]
        held = [F.when(x.isNotNull(), F.struct(x.alias("priority"), F.lit(b.rule.label).alias("label"))) for x, b in zip(held, blank)]
        least = F.array_min(F.array(*held)).cast(rule_type).alias("rule")
        found = found.unionByName(texts.select(*names, least).filter("rule IS NOT NULL").distinct())
    found = found.groupBy(*[F.col(c).alias(f"{c}_") for c in names]).agg(F.min("rule").alias("_rule"))
    same = [F.col(c).eqNullSafe(F.col(f"{c}_")) for c in keys] + [F.col(row_id).eqNullSafe(F.col("_id_"))]
    labelled = keyed.join(found, same, "left").withColumn(label, F.coalesce("_rule.label", F.lit(default)))
    return labelled.drop("_rule", *keys, *(f"{c}_" for c in names))


def _least_by_words(texts: DataFrame, names: tuple, index: DataFrame) -> DataFrame:
    """The least rule number of each word of a text that holds keywords of the index.

    With too many such words for a broadcast only the most frequent are, and the other words' occurrences, few, are shuffled.
    """
    vocabulary = written(vocabulary_counts(texts, "text"), "vocabulary")
    best = written(_in_words(vocabulary, index).groupBy("word", "n").agg(F.min("number").alias("number")), "words-with-keywords")
    said = texts.select(*names, F.explode(F.array_distinct(_words(F.col("text")))).alias("word"))
    if small_enough(best):
        return said.join(F.broadcast(best), "word").select(*names, "number")
    size = F.floor(F.log2("n")).cast("int")
    often = None
    total = 0
    for row in sorted(vocabulary.groupBy(size.alias("size")).count().collect(), reverse=True):
        total += row["count"]
        if total > BROADCAST_ROWS:
            break
        often = row["size"]
    if often is None:
        return said.join(best, "word").select(*names, "number")
    frequent = vocabulary.filter(size >= often)
    common = said.join(F.broadcast(best.filter(size >= often)), "word").select(*names, "number")
    rare = said.join(F.broadcast(frequent.select("word")), "word", "left_anti").join(best.filter(size < often), "word")
    return common.unionByName(rare.select(*names, "number"))


def vocabulary_counts(rows: DataFrame, column: str) -> DataFrame:
    """(word, n): how often each word is said in the lower-cased texts."""
    return rows.select(F.explode(_words(F.lower(column))).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def occurrences_in(text: Column, keyword: Column) -> Column:
    """Number of non-overlapping occurrences; 0 of an empty keyword."""
    gone = F.octet_length(text) - F.octet_length(F.replace(text, keyword, F.lit("")))
    return F.when(F.length(keyword) > 0, gone / F.octet_length(keyword)).otherwise(0).cast("long")


def scores_by_table(rows: DataFrame, candidates: DataFrame, *, column: str = "question", row_id: str = "id") -> DataFrame:
    """ord, topic and score: how often the keywords of each topic occur in all texts.

    ``candidates`` is an (ord, topic, keyword) table of any size. As with
    :func:`.recommend.keyword_scores`, occurrences of a keyword do not overlap and lie inside one text.
    """
    listed = candidates.filter("keyword IS NOT NULL").select(F.lower("keyword").alias("keyword")).distinct()
    listed = written(listed, "keywords")
    index = written(_anchored(listed), "keyword-index")
    met = _in_words(vocabulary_counts(rows, column), index)
    once = met.select("keyword", (occurrences_in(F.col("word"), F.col("keyword")) * F.col("n")).alias("times"))
    texts = rows.select(F.col(row_id).alias("_id"), F.lower(column).alias("text")).filter("text IS NOT NULL")
    texts = texts.select("_id", F.xxhash64("text").alias("_key"), "text")
    # A joint holds such a keyword once. Two that follow each other may share characters of the word between
    # them; only where that word is so short, or more than the joint is to be compared, the place is kept.
    reaches = (F.length("head") > 0) & (F.length("tail") > 0)
    before, after = (
        reaches & F.startswith(F.col(c), F.col("tail")) & F.endswith(F.col(c), F.col("head")) & (F.length(c) < F.length("head") + F.length("tail"))
        for c in ("before", "after")
    )
    at = F.struct("_id", "_key", "place", after.alias("shared"))
    place = F.when(F.col("whole") & ~before & ~after, F.lit(None)).otherwise(at)
    hits = _at_joints(texts, written(_joined(listed), "joint-index")).select("keyword", "whole", place.alias("at"))
    hits = written(hits.groupBy("keyword", "whole", "at").agg(F.count(F.lit(1)).alias("times")), "joint-hits")
    times = once.unionByName(hits.filter("at IS NULL").select("keyword", "times"))
    # Of k in a row that share characters every other one counts.
    order = Window.partitionBy("keyword", "_id", "_key").orderBy("place")
    rows_of_hits = hits.filter("whole AND at IS NOT NULL").select("keyword", "times", "at.*")
    linked = (F.lag("place").over(order) == F.col("place") - 1) & F.lag("shared").over(order)
    chains = rows_of_hits.withColumn("first", F.coalesce(~linked, F.lit(True)).cast("int")).withColumn("chain", F.sum("first").over(order))
    odd = F.row_number().over(Window.partitionBy("keyword", "_id", "_key", "chain").orderBy("place")) % 2 == 1
    times = times.unionByName(chains.withColumn("odd", odd).filter("odd").select("keyword", "times"))
    longer = hits.filter("not whole").select("keyword", "at._id", "at._key").distinct()
    if not longer.isEmpty():
        same = [F.col(f"t.{c}").eqNullSafe(F.col(f"c.{c}")) for c in ("_id", "_key")]
        compared = texts.alias("t").join(longer.alias("c"), same)
        times = times.unionByName(compared.select("keyword", occurrences_in(F.col("text"), F.col("keyword")).alias("times")))
    blank = [b.keyword for b in _blank(listed)]
    if blank:
        cells = [F.struct(F.lit(k).alias("keyword"), occurrences_in(F.col("text"), F.lit(k)).alias("times")) for k in blank]
        times = times.unionByName(texts.select(F.inline(F.array(*cells))))
    times = times.groupBy("keyword").agg(F.sum("times").alias("times"))
    named = candidates.select("ord", "topic", F.lower("keyword").alias("keyword")).join(times, "keyword", "left")
    return named.groupBy("ord", "topic").agg(F.coalesce(F.sum("times"), F.lit(0)).alias("score"))
