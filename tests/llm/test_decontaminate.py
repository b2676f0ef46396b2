from __future__ import annotations

import random
import re

import pytest

from colloquy.llm.decontaminate import decontaminate, overlaps

WORDS = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def words_of(text):
    return WORDS.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, width):
    out = []
    for i, text in docs:
        words, hit, found = words_of(text), set(), set()
        for item, item_text in items:
            w = words_of(item_text)
            n = min(width, len(w))
            for s in range(len(w) - n + 1 if n else 0):
                for p in range(len(words) - n + 1):
                    if words[p : p + n] == w[s : s + n]:
                        hit |= set(range(p, p + n))
                        found.add(item)
        out.append((i, len(words), len(hit), sorted(x for x in found if x is not None)))
    return out


@pytest.fixture
def items(spark):
    def build(rows):
        return spark.createDataFrame(rows, "item_id long, text string")

    return build


@pytest.mark.parametrize("block_words", [5, 100_000])
def test_equals_brute_force(documents, items, block_words):
    r = random.Random(4)
    word = lambda: r.choice(["A", "b", "c1", "É", "über", "z"])
    bench = [(k, " ".join(word() for _ in range(r.randrange(9)))) for k in range(12)]
    bench += [(3, "b c1 b"), (None, "zz yy"), (50, None), (51, "...")]
    docs = [(k, ", ".join(word() for _ in range(r.randrange(40)))) for k in range(40)]
    docs += [docs[0], (None, "zz yy b"), (90, None), (91, ""), (92, "b " * 30_000)]
    found = overlaps(documents(docs), items(bench), width=4, block_words=block_words, blocks_at_once=2).collect()
    expected = brute(docs[:-1], bench, 4)
    got = [(x.doc_id, x.n_words, x.n_hit, list(x["items"])) for x in found if x.doc_id != 92]
    assert sorted(map(str, got)) == sorted(map(str, expected))
    assert sum(n > 0 for _, _, n, _ in expected) > 10
    for x in found:
        assert x.n_hit == sum(s.end - s.first for s in x.spans)


def test_spans_go(documents, items):
    passage = " ".join(f"w{k}" for k in range(12))
    docs = [(1, f"Clean before. {passage.upper()}! Clean after, with some words more to stay."), (2, passage), (3, None), (4, "clean"), (5, "")]
    frame = documents(docs)
    out = decontaminate(frame, items([(1, passage)]), max_coverage=0.7)
    assert out.columns == frame.columns
    rows = {x.doc_id: x.text for x in out.collect()}
    assert rows == {1: "Clean before. ! Clean after, with some words more to stay.", 3: None, 4: "clean", 5: ""}


def test_nothing_to_find(documents, items):
    docs = documents([(1, "a b c")])
    assert decontaminate(docs, items([])).collect() == docs.collect()
    assert overlaps(documents([]), items([(1, "a")])).count() == 0
