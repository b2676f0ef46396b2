from __future__ import annotations

import random

import pytest

from colloquy.llm.components import components
from colloquy.llm.minhash_forest import near_duplicates


def sets_of(text, words):
    w = (text or "").encode().lower().split()
    n = min(words, len(w))
    return frozenset(tuple(w[k : k + n]) for k in range(len(w) - n + 1)) if w else frozenset()


def brute(rows, words=2, percent=80):
    """Component and set size of each row, by comparing all pairs."""
    sets = [sets_of(t, words) for _, t in rows]
    top = list(range(len(rows)))

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if sets[a] and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both) and both:
                top[find(a)] = find(b)
    least: dict = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[find(k)] = min(i, least.get(find(k), i))
    return [(i, len(sets[k]), least.get(find(k), i)) for k, (i, _) in enumerate(rows)]


def planted(r, n, words):
    rows, k = [], 0
    vocabulary = [f"w{x}" for x in range(400)]
    for _ in range(n):
        base = [r.choice(vocabulary) for _ in range(r.choice([1, 2, 6, 30, 80]))]
        for _ in range(r.randrange(1, 7)):
            copy = list(base)
            for _ in range(r.randrange(0, max(1, len(copy) // 12) + 1)):
                copy[r.randrange(len(copy))] = r.choice(vocabulary)
            rows.append((k, " ".join(copy).upper() if r.random() < 0.2 else "\t".join(copy)))
            k += 1
    return rows


@pytest.mark.parametrize("words", [2, 5])
def test_equals_all_pairs(documents, words):
    rows = planted(random.Random(3), 60, words)
    rows += [rows[4], (900, ""), (901, None), (902, " \n"), (903, None), (904, "one"), (905, "ONE")]
    found = near_duplicates(documents(rows), words=words).select("doc_id", "n_shingles", "component_id", "kept").collect()
    expected = brute(rows, words)
    assert sorted((x.doc_id, x.n_shingles, x.component_id) for x in found) == sorted(expected)
    assert all(x.kept == (x.doc_id == x.component_id) for x in found)
    assert sum(i != c for i, _, c in expected) > 30


def test_null_ids_and_repeated_ids(documents):
    rows = [(None, "a b c d"), (7, "a b c d"), (None, "e f g"), (None, "e f g"), (8, "x y z"), (8, "x y z"), (8, "other words")]
    found = near_duplicates(documents(rows)).select("doc_id", "component_id", "kept").collect()
    got = sorted((str(x.doc_id), str(x.component_id), x.kept) for x in found)
    assert got == sorted(
        [("None", "7", False), ("7", "7", True), *[("None", "None", True)] * 2, *[("8", "8", True)] * 3]
    )


def test_empty_table_and_long_text(documents):
    assert near_duplicates(documents([])).count() == 0
    text = " ".join(f"w{k % 5000}" for k in range(1_000_000))
    found = near_duplicates(documents([(1, text), (2, text + " tail")])).collect()
    assert [x.component_id for x in found] == [1, 1]


@pytest.mark.parametrize("links_a_task", [3, 1_000])
def test_components(spark, links_a_task):
    chain = [(k, k + 1) for k in range(0, 60)]
    star = [(100, k) for k in range(101, 130)]
    frame = spark.createDataFrame([*chain, *star, (200, 201), (201, 200), (5, 5)], "x long, y long")
    found = dict(map(tuple, components(frame, "x", "y", links_a_task=links_a_task).collect()))
    expected = {k: 0 for k in range(61)} | {k: 100 for k in range(100, 130)} | {200: 200, 201: 200}
    assert found == expected
