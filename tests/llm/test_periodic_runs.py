from __future__ import annotations

import hashlib
import random
import re
import zlib

import pytest

from colloquy.llm import periodic_runs, queries
from colloquy.llm.periodic_runs import Interval, find_runs, runs

WORDS = re.compile("[^\x20\x09-\x0d]+")


def brute(words, least):
    """Every stretch that repeats a period, extended word by word."""
    found, n = [], len(words)
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            start = i
            while i + q < n and words[i] == words[i + q]:
                i += 1
            length = i + q - start
            stretch = words[start : start + length]
            smaller = any(stretch[p:] == stretch[:-p] for p in range(1, q))
            if length >= max(least, 2 * q) and not smaller:
                found.append((start, length, q))
            i += 1
    return sorted(found, key=lambda r: (r[0], r[2]))


def lean(words, found):
    gone = {i for start, length, q in found for i in range(start + q, start + length)}
    return [w for i, w in enumerate(words) if i not in gone]


def some_words(r, n):
    words = [r.choice("abcdeé"[: r.randrange(1, 7)]) for _ in range(n)]
    if n and r.random() < 0.5:
        a = r.randrange(n)
        p = 1 + (n - a) // (3 + r.randrange(8))
        words = [words[i if i < a else a + (i - a) % p] for i in range(n)]
    return words


@pytest.mark.parametrize("least", [2, 3, 5, 12])
def test_runs_equal_brute_force(least):
    r, n = random.Random(least), 0
    for _ in range(150):
        texts = [[w.encode() for w in some_words(r, r.choice([0, 1, 2, 20, 70]))] for _ in range(r.randrange(1, 4))]
        expected = [brute(words, least) for words in texts]
        assert runs(texts, least) == expected
        n += sum(map(len, expected))
    assert n > 40


def test_places_stay_in_order(monkeypatch):
    monkeypatch.setattr(periodic_runs, "CHUNK", 4)
    r = random.Random(7)
    places = r.sample(range(500), 120)
    held = Interval(places[0], 0)
    for k, place in enumerate(places[1:], 1):
        before, after = [p for p in places[:k] if p < place], [p for p in places[:k] if p > place]
        assert list(held.neighbours(place)) == [*([max(before)] if before else []), *([min(after)] if after else [])]
        held.take(Interval(place, k % 3))
    assert sum(held.chunks, []) == sorted(places)
    assert held.size == len(places) and sorted(sum(held.lists.values(), [])) == sorted(places)


def test_long_texts_of_one_word_and_of_fibonacci_words():
    assert runs([[b"a"] * 60_000]) == [[(0, 60_000, 1)]]
    a, b = [b"a"], [b"a", b"b"]
    while len(b) < 200:
        a, b = b, b + a
    assert runs([b])[0] == brute(b, 12)


def test_texts_of_all_kinds(documents, monkeypatch):
    monkeypatch.setattr(periodic_runs, "GROUP_BYTES", 300)
    r = random.Random(8)
    docs = [(k, " \t".join(some_words(r, r.randrange(80)))) for k in range(50)]
    docs += [docs[0], (None, "é " * 20), (60, None), (61, ""), (62, " \n "), (63, "x y " * 9000), (64, "one line"), (65, "a b " * 12)]
    rows = find_runs(documents(docs)).collect()
    assert rows[0].__fields__ == ["doc_id", "n_words", "runs", "collapsed"]
    expected = []
    for i, text in docs:
        words = WORDS.findall(text or "")
        found = [(0, 18_000, 2)] if i == 63 else brute(words, 12)
        expected.append((i, len(words), found, " ".join(lean(words, found))))
    got = [(x.doc_id, x.n_words, [tuple(y) for y in x.runs], x.collapsed) for x in rows]
    assert sorted(map(str, got)) == sorted(map(str, expected))


def test_no_rows(documents):
    assert find_runs(documents([])).collect() == []


def test_the_query(spark, tmp_path):
    r = random.Random(9)
    docs = [(k, " ".join(some_words(r, r.randrange(60)))) for k in range(200)] + [(None, "a " * 30), (900, None), (901, " ")]
    looping = [k for k in range(1000, 4000) if zlib.crc32(str(k).encode()) % 10 == 0][:60]
    docs += [(k, "  ".join(r.choice("abcdefghij") for _ in range(r.randrange(1, 90)))) for k in looping] + [(looping[0], None), (looping[1], "")]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {}
    for x in queries.QUERIES["op13_periodic_runs"](spark, str(tmp_path)).collect():
        got.setdefault(x.doc_id, []).append(tuple(x[1:]))
    expected = {}
    for i, text in docs:
        words = WORDS.findall(text or "")
        h = zlib.crc32(str(i).encode()) if i is not None else 1
        if h % 10 == 0 and words:
            n, g = len(words), h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[k if k < a else a + (k - a) % p] for k in range(n)]
        found = brute(words, 12)
        best = min(found, key=lambda x: (-x[1], x[0], x[2]), default=(None,) * 3)
        digest = [hashlib.sha256(x.encode()).hexdigest() for x in ("".join(f"{a},{b},{c}\n" for a, b, c in found), " ".join(lean(words, found)))]
        milli = 1000 * best[1] // best[2] if found else None
        expected.setdefault(i, []).append((len(found), *best, milli, *digest))
    assert {k: sorted(map(str, v)) for k, v in got.items()} == {k: sorted(map(str, v)) for k, v in expected.items()}
    assert sum(x[0][0] > 0 for x in expected.values()) > 40
