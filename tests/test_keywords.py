from __future__ import annotations

import random

import pytest
from helpers import rows_of

from colloquy.functions.rules import label_by_rules
from colloquy.operators import keywords, recommend


@pytest.fixture
def said(spark):
    return lambda texts: spark.createDataFrame(list(enumerate(texts)), "id long, question string")


def brute_label(text, rules, default):
    held = [(p, label) for p, label, k in rules if k is not None and text is not None and k in text.lower()]
    return min(held)[1] if held else default


def some_text(r):
    if r.random() < 0.05:
        return r.choice([None, "", "  ", "\n"])
    blank = lambda: r.choice([" ", "  ", "\n", " \t"])
    return "".join("".join(r.choice("abcDÉß") for _ in range(r.randrange(1, 9))) + blank() for _ in range(r.randrange(1, 9)))


def some_keyword(r):
    word = lambda: "".join(r.choice("abcdéß") for _ in range(r.randrange(1, 5)))
    kind = r.random()
    if kind < 0.7:
        return word()
    if kind < 0.95:
        return r.choice([" {} {}", "{} {}", "{}  {}", "{}\n{}", "{} ", " {}"]).replace("{}", word(), 1).replace("{}", word(), 1)
    return r.choice([None, "\t", "  "])


def test_labels_equal_brute_force(spark, said):
    r = random.Random(2)
    texts = [some_text(r) for _ in range(300)]
    rules = [(r.randrange(50), r.choice(["x", "y", "z"]), some_keyword(r)) for _ in range(60)]
    rules = [x for x in rules if x[2] is None or len(x[2]) > 2]
    table = spark.createDataFrame(rules, "priority int, label string, keyword string")
    got = keywords.label_by_table(said(texts), table, default="none")
    assert got.columns == ["id", "question", "topic"]
    expected = [(i, t, brute_label(t, rules, "none")) for i, t in enumerate(texts)]
    assert sorted(rows_of(got)) == sorted(expected)
    assert len({x[2] for x in expected}) == 4


def test_many_keywords(spark, said):
    r = random.Random(3)
    rules = [(i, f"label {i % 7}", f"k{r.randrange(10**7):x}" + r.choice(["", " z", "-"])) for i in range(100_000)]
    texts = [" ".join(r.choice(rules)[2] if r.random() < 0.3 else f"w{r.random()}" for _ in range(r.randrange(9))) for _ in range(200)]
    texts = [f"pre{t}post" if r.random() < 0.5 else t.upper() for t in texts]
    table = spark.createDataFrame(rules, "priority int, label string, keyword string")
    got = dict(rows_of(keywords.label_by_table(said(texts), table, default="none"), "id", "topic"))
    for i, text in enumerate(texts):
        assert got[i] == brute_label(text, rules, "none")


def test_table_equals_expressions(spark, said):
    rules = (("A", ("how much", "men")), ("B", ("open", "")), ("C", ("never",)))
    texts = ["How much?", "HOW  much", "the menu", "reopened", None, "", "never", "how\nmuch"]
    got = keywords.label_by_table(said(texts), keywords.rule_table(spark, rules[:1] + (("B", ("open",)),)), default="D")
    expected = said(texts).withColumn("topic", label_by_rules("question", rules[:1] + (("B", ("open",)),), "D"))
    assert sorted(rows_of(got)) == sorted(rows_of(expected))
    got = keywords.label_by_table(said(texts), keywords.rule_table(spark, rules), default="D")
    expected = said(texts).withColumn("topic", label_by_rules("question", rules, "D"))
    assert sorted(rows_of(got)) == sorted(rows_of(expected))


def test_rows_that_repeat_and_have_no_id(spark):
    rows = [(1, "menu", "p"), (1, "menu", "p"), (1, "open", "q"), (None, "menu", "r"), (None, None, "s"), (None, "menu", "r")]
    frame = spark.createDataFrame(rows, "id long, question string, rule string")
    rules = spark.createDataFrame([(0, "M", "men"), (1, "O", "open door"), (2, "O", "pen")], "priority int, label string, keyword string")
    got = keywords.label_by_table(frame, rules, default="-")
    assert sorted(map(str, rows_of(got))) == sorted(map(str, [(*x, {"menu": "M", "open": "O", None: "-"}[x[1]]) for x in rows]))


def test_no_rules_and_no_rows(spark, said):
    none = spark.createDataFrame([], "priority int, label string, keyword string")
    assert rows_of(keywords.label_by_table(said(["a"]), none, default="-"), "topic") == [("-",)]
    one = spark.createDataFrame([(0, "A", "a")], none.schema)
    assert rows_of(keywords.label_by_table(said([]), one, default="-")) == []


def test_scores_equal_brute_force(spark, said):
    r = random.Random(4)
    texts = [some_text(r) for _ in range(200)] + ["aaaa aaa", "aaaa aaa", "a a a a", None]
    rules = [(i % 9, f"t{i % 9}", some_keyword(r)) for i in range(80)] + [(9, "t9", "aa"), (9, "t9", "a a"), (9, "t9", ""), (10, "t10", "zz")]
    table = spark.createDataFrame(rules, "ord int, topic string, keyword string")
    got = dict(rows_of(keywords.scores_by_table(said(texts), table), "topic", "score"))
    expected = {}
    for _, topic, k in rules:
        n = sum(t.lower().count(k.lower()) for t in texts if t and k)
        expected[topic] = expected.get(topic, 0) + n
    assert got == expected


def test_scores_by_table_equal_those_of_a_list(spark, said):
    texts = ["An error, what is the error?", "billing plan", "WHAT IS", None, "sync api"] * 3
    rows = [(i, topic, k) for i, (topic, ks) in enumerate(recommend.CANDIDATE_TOPICS) for k in ks]
    table = spark.createDataFrame(rows, "ord int, topic string, keyword string")
    by_table = keywords.scores_by_table(said(texts), table)
    by_list = recommend.keyword_scores(said(texts))
    assert sorted(rows_of(by_table, "ord", "topic", "score")) == sorted(rows_of(by_list, "ord", "topic", "score"))


def test_phrases_are_not_compared_with_whole_texts(spark, said):
    """Texts with the longest part of a phrase were all compared with it: their number times that of the phrases."""
    rules = spark.createDataFrame([(i, "x", f"the w{i}") for i in range(50)], "priority int, label string, keyword string")
    got = keywords.label_by_table(said(["the w7 and", "the", "w7 the"]), rules, default="-")
    assert "contains(text" not in got._jdf.queryExecution().optimizedPlan().toString().lower()
    assert sorted(rows_of(got, "id", "topic")) == [(0, "x"), (1, "-"), (2, "-")]


def test_labels_with_few_broadcast_words_and_slices(spark, said, monkeypatch):
    monkeypatch.setattr(keywords, "BROADCAST_ROWS", 40)
    monkeypatch.setattr(keywords, "small_enough", lambda table: False)
    monkeypatch.setattr(keywords, "SLICE", 5)
    r = random.Random(7)
    texts = [some_text(r) for _ in range(150)]
    rules = [(r.randrange(50), r.choice(["x", "y", "z"]), some_keyword(r)) for _ in range(40)] + [(-1, "w", "a b c"), (-2, "v", " a "), (-3, "u", "b  c d")]
    rules = [x for x in rules if x[2] is None or len(x[2]) > 2]
    texts += ["x a b cd", "ba  b  c d", "b  c da", "a b  c", "a "]
    table = spark.createDataFrame(rules, "priority int, label string, keyword string")
    got = keywords.label_by_table(said(texts), table, default="none")
    assert sorted(rows_of(got, "id", "topic")) == [(i, brute_label(t, rules, "none")) for i, t in enumerate(texts)]


def test_phrases_that_share_characters_count_once(spark, said):
    texts = ["a a a a", "ab ab ab", "aba aba xab aba", "a a a a", None, " a a", "mosthe mosthe mosthe mosthe", "a b c a b c"]
    phrases = ["a a", "ab a", "the mos", "a b c", " a", "c a ", "b  c"]
    table = spark.createDataFrame([(i, f"t{i}", k) for i, k in enumerate(phrases)], "ord int, topic string, keyword string")
    got = keywords.scores_by_table(said(texts), table)
    assert dict(rows_of(got, "ord", "score")) == {i: sum(t.count(k) for t in texts if t) for i, k in enumerate(phrases)}
    # Phrases with one run of blanks are not compared with the texts that hold their longest part.
    short = keywords.scores_by_table(said(texts), table.filter("keyword NOT IN ('a b c', 'c a ')"))
    assert "replace(text" not in short._jdf.queryExecution().optimizedPlan().toString().lower()
