"""Topic recommendations and similarities."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ranking import ranks
from ..functions.rules import Rules
from ..functions.skew import broadcast_if_small
from ..functions.text import occurrences
from ..session import written

# Candidate topics in order, with their keywords.
CANDIDATE_TOPICS: Rules = (
    ("Technical Support", ("error", "bug", "issue", "problem", "help", "support")),
    ("Product Information", ("feature", "specification", "details", "information", "what is")),
    ("Pricing & Billing", ("cost", "price", "billing", "payment", "subscription", "plan")),
    ("Account Management", ("login", "password", "account", "profile", "settings")),
    ("Integration", ("api", "connect", "integration", "webhook", "sync")),
)


def keyword_scores(chats: DataFrame, candidates: Rules = CANDIDATE_TOPICS, *, column: str = "question") -> DataFrame:
    """For each candidate, how often its keywords occur in all texts.

    Occurrences are counted inside each text, so a keyword never spans two
    messages; only one row of sums per task is shuffled. Each keyword is sought in each
    text: for a long list or a table of them see :func:`.keywords.scores_by_table`.
    """
    totals = [
        F.coalesce(F.sum(reduce(add, (occurrences(F.col("text"), k.lower()) for k in keywords))), F.lit(0)).alias(f"s{i}")
        for i, (_, keywords) in enumerate(candidates)
    ]
    cells = [
        F.struct(F.lit(i).alias("ord"), F.lit(topic).alias("topic"), F.col(f"s{i}").alias("score"))
        for i, (topic, _) in enumerate(candidates)
    ]
    return chats.select(F.lower(column).alias("text")).agg(*totals).select(F.inline(F.array(*cells)))


def recommend_topics(
    chats: DataFrame, candidates: Rules = CANDIDATE_TOPICS, *, n: int = 5, column: str = "question"
) -> DataFrame:
    """The n best-scored candidates that are not topics of the chats yet; ties in candidate order."""
    new = keyword_scores(chats, candidates, column=column).join(
        chats.select("topic").distinct(), "topic", "left_anti"
    )
    return new.orderBy(F.desc("score"), "ord").limit(n).select("topic", "score")


def topic_domain(chats: DataFrame, *, max_topics: int = 1_000) -> list[str]:
    """The topics that occur, in order; each becomes a column, so more than ``max_topics`` raise."""
    rows = chats.select("topic").na.drop().distinct().orderBy("topic").limit(max_topics + 1).collect()
    if len(rows) > max_topics:
        raise ValueError(f"there are more than {max_topics} topics")
    return [row.topic for row in rows]


def client_topic_matrix(chats: DataFrame, topics: Sequence[str] | None = None) -> DataFrame:
    """Rows per client and topic with a column for each topic of the domain, 0 where none.

    Without ``topics`` the domain is taken from the chats. A topic outside a given
    domain raises when the result is run; rows without a topic count nowhere.
    Written as conditional counts: one aggregation instead of a pivot's two.
    """
    topics = topic_domain(chats) if topics is None else topics
    outside = F.raise_error(F.concat(F.lit("topic outside the domain: "), F.col("topic"))).cast("string")
    topic = F.when(F.col("topic").isNull() | F.col("topic").isin(*topics), F.col("topic")).otherwise(outside)
    chats = chats.select("client_id", topic.alias("topic"))
    counts = [F.count_if(F.col("topic") == t).alias(t) for t in topics]
    return chats.filter(F.col("client_id").isNotNull()).groupBy("client_id").agg(*counts)


def _pearson(a: Column, b: Column) -> Column:
    """Correlation of two columns; NULL where one is constant."""
    return F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))


def _counts(chats: DataFrame) -> DataFrame:
    """The client x topic matrix in long form, without its zeros."""
    named = chats.filter(F.col("client_id").isNotNull() & F.col("topic").isNotNull())
    return named.groupBy("client_id", "topic").agg(F.count(F.lit(1)).cast("double").alias("n"))


def _correlation(n, x: str, y: str, xx: str, yy: str, xy: Column) -> Column:
    """Pearson's from sums over n places; NULL where one side is constant."""
    spread = (n * F.col(xx) - F.col(x) * F.col(x)) * (n * F.col(yy) - F.col(y) * F.col(y))
    return F.when(spread > 0, (n * xy - F.col(x) * F.col(y)) / F.sqrt(spread))


def topic_similarity(chats: DataFrame, topics: Sequence[str] | None = None) -> DataFrame:
    """Correlation of every two topics over the clients, for any number of topics.

    The products of two topics are summed where a client has both (a sparse Gram matrix in long form);
    with the sums of each topic these give the correlations. Without ``topics`` all
    topics of the chats are paired; a topic outside a given domain raises.
    """
    spark = chats.sparkSession
    clients = chats.filter(F.col("client_id").isNotNull()).select("client_id").distinct().count()
    counts = _counts(chats)
    if topics is None:
        numbered = ranks(counts.select("topic").distinct(), "topic", name="k")
    else:
        numbered = spark.createDataFrame([(t, k) for k, t in enumerate(topics)], "topic string, k bigint")
        outside = F.raise_error(F.concat(F.lit("topic outside the domain: "), F.col("topic")))
        counts = counts.join(numbered, "topic", "left").withColumn("k", F.coalesce("k", outside.cast("bigint")))
    numbered = written(numbered, "topics")
    counts = counts if topics is not None else counts.join(broadcast_if_small(numbered), "topic")
    counts = written(counts.select("client_id", "k", "n"), "client-topics")
    sums = counts.groupBy("k").agg(F.sum("n").alias("x"), F.sum(F.col("n") * F.col("n")).alias("xx"))
    sums = written(numbered.join(sums, "k", "left").na.fill(0.0), "topic-sums")
    both = counts.alias("a").join(counts.alias("b"), (F.col("a.client_id") == F.col("b.client_id")) & (F.col("a.k") < F.col("b.k")))
    products = both.groupBy(F.col("a.k").alias("k"), F.col("b.k").alias("l")).agg(F.sum(F.col("a.n") * F.col("b.n")).alias("xy"))
    last = numbered.count() - 1
    other = sums.select(F.col("k").alias("l"), F.col("topic").alias("topic_b"), F.col("x").alias("y"), F.col("xx").alias("yy"))
    pairs = sums.filter(F.col("k") < last).withColumn("l", F.explode(F.sequence(F.col("k") + 1, F.lit(last).cast("bigint"))))
    pairs = pairs.join(broadcast_if_small(other), "l").join(products, ["k", "l"], "left")
    correlation = _correlation(F.lit(float(clients)), "x", "y", "xx", "yy", F.coalesce("xy", F.lit(0.0)))
    return pairs.select(F.col("topic").alias("topic_a"), "topic_b", correlation.alias("correlation"))


PLANES = 64
TREES = 8
REACH = 12
# Neighbours in an order whose profiles meet in one group.
BLOCK = 512


def nearest_clients(chats: DataFrame, *, n: int = 10, trees: int = TREES, reach: int = REACH) -> DataFrame:
    """client_id, rank, other_id, correlation: for every client, the clients most like it over the topics.

    Not all pairs are formed. The signs of random projections of the centred profiles give each
    client a bit string; in ``trees`` orders, each by another stretch of the string and a
    projection's value, the ``reach`` clients on both sides are candidates. Profiles meet in blocks of
    the orders, once for each order, and a block gives each client's best alone, so no pairs are shuffled. The
    correlations are exact, and the first ``n`` by correlation and id stay; so a neighbour may be
    missed but none is wrong. Clients with the same number of rows in every topic have no correlation.
    """
    counts = written(_counts(chats), "client-topics")
    topics = counts.select("topic").distinct().count()
    # The sign of a topic in plane k is a bit of its hash; centring subtracts the mean count times all signs.
    hashes = [F.xxhash64(F.lit(17 + s), "topic") for s in range(-(-(PLANES + trees) // 64))]
    bit = lambda k: (F.shiftrightunsigned(hashes[k // 64], k % 64).bitwiseAND(F.lit(1)) * 2 - 1).cast("double")
    planes = list(range(PLANES + trees))
    signs = counts.select("topic").distinct().agg(*[F.sum(bit(k)).alias(f"s{k}") for k in planes]).first()
    stats = [F.sum("n").alias("x"), F.sum(F.col("n") * F.col("n")).alias("xx")]
    dots = [F.sum(F.col("n") * bit(k)).alias(f"d{k}") for k in planes]
    sums = counts.groupBy("client_id").agg(*stats, *dots)
    centred = [F.col(f"d{k}") - F.col("x") * F.lit((signs[f"s{k}"] or 0.0) / max(topics, 1)) for k in planes]
    spread = F.col("xx") - F.col("x") * F.col("x") / F.lit(float(max(topics, 1)))
    sums = written(
        sums.filter(F.lit(float(topics)) * F.col("xx") - F.col("x") * F.col("x") > 0).select(
            "client_id", "x", "xx",
            F.concat(*[F.when(c > 0, "1").otherwise("0") for c in centred[:PLANES]]).alias("bits"),
            F.array(*[c / F.sqrt(spread) for c in centred[PLANES:]]).alias("values"),
        ),
        "projections",
    )
    width = PLANES // trees
    tree = F.explode(F.sequence(F.lit(0), F.lit(trees - 1))).alias("tree")
    spots = sums.select("client_id", "bits", "values", tree)
    turned = F.concat(F.expr(f"substring(bits, tree * {width} + 1)"), F.expr(f"substring(bits, 1, tree * {width})"))
    first = F.substring(turned, 1, width)
    spots = spots.select("tree", F.struct(first.alias("bits"), F.get("values", F.col("tree")).alias("value"), "client_id").alias("place"))
    placed = ranks(spots, "place", by=("tree",), name="rank").select("tree", "rank", F.col("place.client_id").alias("client_id"))
    placed = written(placed, "orders")
    # Each row lies in a block of its order, and those that the block before reaches also in that one.
    size = max(BLOCK, reach)
    block = F.floor(F.col("rank") / size)
    blocks = F.when((F.col("rank") % size < reach) & (block > 0), F.array(block, block - 1)).otherwise(F.array(block))
    parts = placed.select("tree", "rank", "client_id", F.explode(blocks).alias("block"))
    parts = parts.withColumn("home", block == F.col("block"))
    profiles = _profiles(counts, sums)
    met = parts.join(profiles, "client_id").groupBy("tree", "block")
    client = sums.schema["client_id"].dataType.simpleString()
    found = met.applyInPandas(_best_in_block(n, reach, topics), f"client_id {client}, other_id {client}, correlation double")
    order = Window.partitionBy("client_id").orderBy(F.desc("correlation"), "other_id")
    best = found.distinct().withColumn("rank", F.row_number().over(order).cast("int")).filter(F.col("rank") <= n)
    return best.select("client_id", "rank", "other_id", "correlation")


def _profiles(counts: DataFrame, sums: DataFrame) -> DataFrame:
    """client_id, x, xx, and the client's topics, as numbers, with its rows in each."""
    numbered = written(ranks(counts.select("topic").distinct(), "topic", name="k"), "topics")
    listed = counts.join(broadcast_if_small(numbered), "topic").groupBy("client_id")
    listed = listed.agg(F.collect_list("k").alias("ks"), F.collect_list("n").alias("ns"))
    return written(listed.join(sums.select("client_id", "x", "xx"), "client_id"), "profiles")


def _best_in_block(n: int, reach: int, topics: int):
    """The n best of each client among the next and previous ones of a block of an order."""

    def best(block):
        import numpy as np
        import pandas as pd

        block = block.sort_values("rank", ignore_index=True)
        rows, home, ids = len(block), block["home"].to_numpy(), block["client_id"].to_numpy()
        x, xx = block["x"].to_numpy(), block["xx"].to_numpy()
        sizes = block["ks"].map(len).to_numpy()
        keys = np.repeat(np.arange(rows) * topics, sizes) + np.concatenate(block["ks"].to_list())
        values = np.concatenate(block["ns"].to_list())
        order = np.argsort(keys)
        keys, values = keys[order], values[order]
        left, right, correlation = [], [], []
        for step in range(1, min(reach, rows - 1) + 1):
            at = np.searchsorted(keys, keys + step * topics)
            same = at < len(keys)
            same[same] = keys[at[same]] == keys[same] + step * topics
            owner = keys[same] // topics
            xy = np.bincount(owner, values[same] * values[at[same]], rows)[: rows - step]
            a = np.arange(rows - step)[home[: rows - step]]
            b, xy = a + step, xy[home[: rows - step]]
            spread = (topics * xx[a] - x[a] * x[a]) * (topics * xx[b] - x[b] * x[b])
            left.append(a)
            right.append(b)
            correlation.append((topics * xy - x[a] * x[b]) / np.sqrt(spread))
        if not left:
            return pd.DataFrame({"client_id": ids[:0], "other_id": ids[:0], "correlation": np.zeros(0)})
        one, two, correlation = np.concatenate(left + right), np.concatenate(right + left), np.concatenate(correlation * 2)
        place = np.unique(ids, return_inverse=True)[1]
        order = np.lexsort((place[two], -correlation, one))
        one, two, correlation = one[order], two[order], correlation[order]
        starts = np.searchsorted(one, one)
        first = np.arange(len(one)) - starts < n
        return pd.DataFrame({"client_id": ids[one[first]], "other_id": ids[two[first]], "correlation": correlation[first]})

    return best


def top_client_similarity(chats: DataFrame, *, n: int = 10) -> DataFrame:
    """Correlation over the topics of every two of the n most active clients.

    The n keys come to the driver and become n columns of a table with one row
    per topic, so no pairs of rows are formed; the plan grows with n * n, so n may
    be 100 at most. For other clients see
    :func:`client_topic_profiles` and :func:`similarity_of`.
    """
    if n > 100:
        raise ValueError("at most 100 clients; use client_topic_profiles for more")
    top = [
        row.client_id
        for row in chats.filter(F.col("client_id").isNotNull())
        .groupBy("client_id")
        .agg(F.count(F.lit(1)).alias("_rows"))
        .orderBy(F.desc("_rows"), "client_id")
        .limit(n)
        .collect()
    ]
    per_topic = chats.groupBy("topic").agg(*[F.count_if(F.col("client_id") == c).alias(f"k{c}") for c in top])
    pairs = [(a, b) for i, a in enumerate(top) for b in top[i + 1 :]]
    if not pairs:
        return chats.sparkSession.createDataFrame([], "client_a long, client_b long, correlation double")
    columns = [_pearson(F.col(f"k{a}"), F.col(f"k{b}")).alias(f"c{i}") for i, (a, b) in enumerate(pairs)]
    cells = [
        F.struct(
            F.lit(a).cast("long").alias("client_a"),
            F.lit(b).cast("long").alias("client_b"),
            F.col(f"c{i}").alias("correlation"),
        )
        for i, (a, b) in enumerate(pairs)
    ]
    return per_topic.agg(*columns).select(F.inline(F.array(*cells)))


def client_topic_profiles(chats: DataFrame, topics: Sequence[str] | None = None) -> DataFrame:
    """For every client a vector whose products with others are the correlations.

    One row per client instead of one per pair of clients. A client with the
    same count in every topic has a NULL profile.
    """
    topics = topic_domain(chats) if topics is None else topics
    counts = F.array(*[F.col(f"`{t}`").cast("double") for t in topics])
    mean = F.aggregate("counts", F.lit(0.0), lambda total, x: total + x) / len(topics)
    length = F.sqrt(F.aggregate("centred", F.lit(0.0), lambda total, x: total + x * x))
    return (
        client_topic_matrix(chats, topics)
        .select("client_id", counts.alias("counts"))
        .withColumn("mean", mean)
        .withColumn("centred", F.transform("counts", lambda x: x - F.col("mean")))
        .withColumn("length", length)
        .select(
            "client_id",
            F.when(F.col("length") > 0, F.transform("centred", lambda x: F.try_divide(x, F.col("length")))).alias("profile"),
        )
    )


def similarity_of(pairs: DataFrame, profiles: DataFrame) -> DataFrame:
    """Correlation of the given (client_a, client_b) pairs from the profiles."""
    for side in ("a", "b"):
        named = profiles.select(F.col("client_id").alias(f"client_{side}"), F.col("profile").alias(f"_{side}"))
        pairs = pairs.join(named, f"client_{side}", "left")
    product = F.aggregate(F.zip_with("_a", "_b", lambda x, y: x * y), F.lit(0.0), lambda total, x: total + x)
    return pairs.withColumn("correlation", product).drop("_a", "_b")
