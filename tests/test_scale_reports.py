"""Ranks, quartiles, frequent values, similarities and growing reports against plain versions."""

from __future__ import annotations

import datetime as dt
import math
import random
from collections import Counter

import numpy as np
import pytest
from helpers import rows_of
from pyspark.sql import functions as F

from colloquy.functions.ranking import ranks, sums_before
from colloquy.operators import profiling, recommend
from colloquy.operators.evaluation import encode_labels
from colloquy.operators.volume import messages_per_topic
from colloquy.sources import increments


def test_running_sums_in_groups(spark):
    r = random.Random(1)
    rows = [(g, v, r.randrange(9)) for g in ("a", "b", "c") for v in r.sample(range(1000), 200)]
    frame = spark.createDataFrame(rows, "g string, v int, w int").repartition(5)
    got = sorted(rows_of(sums_before(frame, "v", F.col("w"), by=("g",)), "g", "v", "before"))
    expected = sorted((g, v, sum(w for h, u, w in rows if h == g and u < v)) for g, v, _ in rows)
    assert got == expected


def test_labels_are_numbered_without_a_bound(spark):
    labels = [f"label {i:05}" for i in range(3000)]
    rows = [(i, labels[i % 3000]) for i in range(4000)] + [(9000, None)]
    got = dict(rows_of(encode_labels(spark.createDataFrame(rows, "id long, label string"), "label", "code"), "id", "code"))
    assert got == {i: None if k is None else labels.index(k) for i, k in rows}
    assert rows_of(ranks(spark.createDataFrame([], "v int"), "v")) == []


def plain_top(values, n):
    return sorted(Counter(v for v in values if v is not None).items(), key=lambda x: (-x[1], x[0]))[:n]


@pytest.mark.parametrize("tracked", [64, 4096])
def test_top_values_equal_full_counts(spark, monkeypatch, tracked):
    r = random.Random(2)
    skewed = [f"v{int(r.paretovariate(0.7))}" for _ in range(6000)]
    unique = [f"u{i:06}" for i in r.sample(range(10**6), 6000)]
    few = [r.choice(["a", "b", None]) for _ in range(6000)]
    heavy = [r.choice(["x", "y"]) if r.random() < 0.5 else f"z{r.random()}" for _ in range(6000)]
    frame = spark.createDataFrame([(*x, [1], None) for x in zip(skewed, unique, few, heavy)], "skewed string, `un ique` string, few string, heavy string, nested array<int>, empty string")
    got = rows_of(profiling.top_values(frame.repartition(6), "t", n=5, tracked=tracked), "column_name", "value", "frequency")
    for name, values in (("skewed", skewed), ("un ique", unique), ("few", few), ("heavy", heavy)):
        assert sorted([x[1:] for x in got if x[0] == name], key=lambda x: (-x[1], x[0])) == plain_top(values, 5)
    assert {x[0] for x in got} == {"skewed", "un ique", "few", "heavy"}
    assert profiling.top_values(frame.select("nested"), "t").count() == 0


def test_numbers_are_counted_as_numbers(spark, capsys):
    r = random.Random(4)
    long = [r.randrange(10**6) for _ in range(3000)] + [7, 7, None, -1]
    double = [r.choice([0.0, -0.0, math.nan, 1.5, r.random()]) for _ in range(3003)] + [None]
    when = [dt.datetime(2024, 1, 1) + dt.timedelta(microseconds=r.randrange(10**12)) for _ in range(3002)] + [dt.datetime(2024, 5, 1)] * 2
    short = [r.choice([1, 2, None]) for _ in range(3004)]
    schema = "n long, d double, f float, t timestamp_ntz, day date, s short, yes boolean, p decimal(9,2), x string"
    rows = [(a, b, b, c, c.date(), e, e == 1, e, str(a)) for a, b, c, e in zip(long, double, when, short)]
    frame = spark.createDataFrame(rows, "n long, d double, f float, t timestamp_ntz, day date, s short, yes boolean, p int, x string")
    frame = frame.withColumn("p", F.col("p").cast("decimal(9,2)")).repartition(4)
    assert frame.schema.simpleString() == spark.createDataFrame([], schema).schema.simpleString()
    found = profiling.top_values(frame, "t", n=5, tracked=160)
    got = rows_of(found, "column_name", "value", "frequency")
    for name in frame.columns:
        text = F.date_format(name, "yyyy-MM-dd HH:mm:ss.SSSSSS") if name == "t" else F.col(name).cast("string")
        assert [x[1:] for x in got if x[0] == name] == plain_top([x for x, in rows_of(frame.select(text))], 5), name
    assert {"-0.0", "0.0", "NaN"} < {v for c, v, _ in got if c == "d"}
    # Rows meet no interpreted function over arrays.
    found.explain("formatted")
    plan = capsys.readouterr().out
    assert "inline(array(" in plan and "lambda" not in plan


def test_the_sketch_decides_for_frequent_values_only():
    item = lambda *counts: [{"item": i, "count": c} for i, c in enumerate(counts)]
    assert profiling._surely_frequent(item(50, 30, 20), 100, 2, 150, 4096) == [0, 1, 2]  # all values are there
    assert profiling._surely_frequent(item(50, 30, 5), 1000, 2, 150, 4096) == [0, 1]
    assert profiling._surely_frequent(item(2, 2, 2), 10**6, 2, 150, 4096) is None  # too rare to be sure
    assert profiling._surely_frequent(item(500, 400, 399), 10_000, 2, 3, 4096) is None  # more may be as frequent


def test_quartiles(spark):
    r = random.Random(3)
    a = [r.choice([1, 1, 1, 5, None]) for _ in range(999)]
    b = [r.gauss(0, 1) for _ in range(999)]
    frame = spark.createDataFrame(list(zip(a, b, ["x"] * 999, [None] * 999)), "a int, b double, c string, d double")
    got = {x[1]: x[2:] for x in rows_of(profiling.quartiles({"t": frame.repartition(4)}))}
    near = {x[1]: x[2:] for x in rows_of(profiling.approximate_quartiles(frame, "t"))}

    def plain(values):
        values = sorted(v for v in values if v is not None)
        return tuple(float(values[math.ceil(k * len(values) / 4) - 1]) for k in (1, 2, 3))

    assert got == {"a": plain(a), "b": plain(b), "d": (None, None, None)}
    assert near["a"] == got["a"] and near["d"] == (None, None, None)
    assert np.allclose(near["b"], got["b"], atol=0.2)


def correlation(x, y):
    return None if np.std(x) == 0 or np.std(y) == 0 else float(np.corrcoef(x, y)[0, 1])


def test_similarity_of_five_thousand_topics(spark):
    r = random.Random(4)
    rows = [(r.randrange(40), f"t{int(r.paretovariate(0.3)) % 5000:04}") for _ in range(20_000)] + [(None, "t0001"), (3, None), (77, None)]
    rows += [(i % 40, f"t{i:04}") for i in range(5000)]
    frame = spark.createDataFrame(rows, "client_id long, topic string")
    got = recommend.topic_similarity(frame)
    assert got.count() == 5000 * 4999 // 2
    matrix = np.zeros((41, 5000))
    for c, t in rows:
        if c is not None and t is not None:
            matrix[c, int(t[1:])] += 1
    some = [(f"t{a:04}", f"t{b:04}") for a, b in (sorted(r.sample(range(5000), 2)) for _ in range(150))]
    chosen = got.join(spark.createDataFrame(some, "topic_a string, topic_b string").distinct(), ["topic_a", "topic_b"])
    found = {(a, b): c for a, b, c in rows_of(chosen, "topic_a", "topic_b", "correlation")}
    assert len(found) == len(set(some))
    for (a, b), c in found.items():
        expected = correlation(matrix[:, int(a[1:])], matrix[:, int(b[1:])])
        assert (c is None) == (expected is None) and (c is None or abs(c - expected) < 1e-9)


def profiles(rows):
    topics = sorted({t for _, t in rows})
    clients = sorted({c for c, _ in rows})
    matrix = np.zeros((len(clients), len(topics)))
    for c, t in rows:
        matrix[clients.index(c), topics.index(t)] += 1
    return clients, matrix


def test_nearest_clients_equal_brute_force_on_few(spark):
    r = random.Random(5)
    rows = [(c, r.choice("abcdefgh"[: 2 + c % 7])) for c in range(20) for _ in range(r.randrange(1, 30))]
    clients, matrix = profiles(rows)
    got = recommend.nearest_clients(spark.createDataFrame(rows, "client_id long, topic string"), n=4, reach=20)
    found = {(c, k): v for c, k, v in rows_of(got, "client_id", "rank", "correlation")}
    for i, c in enumerate(clients):
        own = sorted((x for j, _ in enumerate(clients) if j != i and (x := correlation(matrix[i], matrix[j])) is not None), reverse=True)
        for k, x in enumerate(own[:4]):
            assert abs(found[c, k + 1] - x) < 1e-9


def test_nearest_clients_recall(spark):
    r = np.random.default_rng(6)
    centres = r.dirichlet([0.2] * 60, 25)
    rows = [(c, f"t{t}") for c in range(700) for t in r.choice(60, 60, p=0.8 * centres[c % 25] + 0.2 / 60)]
    clients, matrix = profiles(rows)
    every = np.corrcoef(matrix)
    np.fill_diagonal(every, -2)
    got = rows_of(recommend.nearest_clients(spark.createDataFrame(rows, "client_id long, topic string")), "client_id", "rank", "other_id", "correlation")
    assert Counter(x[0] for x in got) == {c: 10 for c in clients}
    hits = 0
    for c, _, other, value in got:
        assert abs(every[c, other] - value) < 1e-9
        hits += value >= np.sort(every[c])[-10] - 1e-9
    assert hits / 7000 >= 0.9


def test_loads_add_up_and_repeat_without_change(spark, chats, tmp_path):
    r = random.Random(7)
    start = dt.datetime(2024, 1, 1)
    rows = [(i, i % 5, start + dt.timedelta(hours=r.randrange(400)), r.choice(["a", None]), r.choice(["b", None])) for i in range(300)]
    labelled = lambda part: chats(part).withColumn("topic", F.when(F.col("id") % 3 == 0, "x").otherwise("y"))
    folder = f"{tmp_path}/days"

    def table():
        return sorted(rows_of(increments.report(spark, folder), "date", "topic", *increments.MEASURES))

    whole = sorted(rows_of(increments.day_sums(labelled(rows)), "date", "topic", *increments.MEASURES))
    with pytest.raises(ValueError, match="nothing"):
        increments.report(spark, folder)
    increments.load(labelled(rows[:150]), folder, "one")
    increments.load(labelled(rows[100:]), folder, "two")  # wrong: some twice
    assert table() != whole
    increments.load(labelled(rows[150:]), folder, "two")
    assert table() == whole
    increments.load(labelled(rows[150:]), folder, "two")
    assert table() == whole
    increments.load(labelled([]), folder, "two")
    increments.load(labelled([]), folder, "none")
    assert table() == sorted(rows_of(increments.day_sums(labelled(rows[:150])), "date", "topic", *increments.MEASURES))
    increments.load(labelled(rows[150:]), folder, "two")
    assert table() == whole
    counted = increments.report(spark, folder).groupBy("topic").agg(F.sum("rows").alias("message_count"))
    assert sorted(rows_of(counted)) == sorted(rows_of(messages_per_topic(labelled(rows)), "topic", "message_count"))


def test_nearest_clients_meet_across_blocks_without_pairs(spark, monkeypatch):
    r = random.Random(5)
    rows = [(c, f"t{r.randrange(12)}") for c in range(150) for _ in range(r.randrange(1, 15))]
    frame = spark.createDataFrame(rows, "client_id long, topic string")
    whole = sorted(rows_of(recommend.nearest_clients(frame, n=4, reach=7)))
    monkeypatch.setattr(recommend, "BLOCK", 10)
    got = recommend.nearest_clients(frame, n=4, reach=7)
    assert sorted(rows_of(got)) == whole and len(whole) > 500
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapGroupsInPandas" in plan and "xy" not in plan
