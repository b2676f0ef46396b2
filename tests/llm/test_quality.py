from __future__ import annotations

import collections
import math
import random
import re

from colloquy.llm import quality as Q

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    words = WORDS.findall(text)
    seen, dup, lines = set(), 0, 0
    for line in text.split("\n"):
        if WORDS.search(line):
            lines += 1
            dup += line in seen
            seen.add(line)
    spans = [tuple(words[k : k + 8]) for k in range(len(words) - 7)]
    counts = collections.Counter(spans)
    covered = {p for k, s in enumerate(spans) if counts[s] > 1 for p in range(k, k + 8)}
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), lines, dup, len(covered))


def texts(r, n):
    out = []
    for _ in range(n):
        words = [r.choice(["alpha", "beta", "é", "x#y", "gamma", "delta"]) for _ in range(r.randrange(60))]
        if r.random() < 0.3:
            words = words[:12] * 3
        out.append("".join(w + r.choice([" ", " ", "\n", "  \t"]) for w in words))
    return out


def test_counts_equal_brute_force():
    many = [*texts(random.Random(1), 200), None, "", "\n \n", "a a a a a a a a a", "word " * 5000]
    got = list(Q.counts_of([t.encode() if t is not None else None for t in many]))
    assert got == [brute(t) for t in many]


def frame_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_words string, limits string")


def brute_verdicts(rows):
    """(doc_id, kept), with quantiles of the binned values counted one by one."""
    measured = []
    for i, text, lang, source, *_ in rows:
        n, chars, symbols, lines, dup, repeats = brute(text)
        failed = n < 20 or 100 * repeats > 30 * n
        values = (chars / n, symbols / n, dup / (lines + 4), repeats / n) if n else (0.0,) * 4
        measured.append((i, lang, source, failed, values))

    def binned(v):
        return math.ceil(math.log(v) / math.log(Q.GAMMA)) if v > 0 else None

    def points(chosen, k):
        """(texts, lowest, highest) of one measure of some texts."""
        values = sorted((binned(v[k]) is not None, binned(v[k]) or 0) for *_, v in chosen)
        values = [Q.GAMMA**b if some else 0.0 for some, b in values]
        at = lambda found, q: next(v for n, v in enumerate(found, 1) if n >= q * len(found))
        others = [v for v in values if v]
        middle = at(values, 0.5)
        high = max(2 * at(values, Q.TAIL) - middle, at(others, Q.RARE) if others else 0.0)
        return len(values), 2 * at(values, 1 - Q.TAIL) - middle, high

    good = [x for x in measured if not x[3]]
    out = []
    for i, lang, source, failed, values in measured:
        kept = not failed
        for k in range(4 if kept else 0):
            n, *own = points([x for x in good if x[1:3] == (lang, source)], k)
            _, *of_lang = points([x for x in good if x[1] == lang], k)
            _, *of_all = points(good, k)
            low, high = ((n * a + Q.PRIOR * b + Q.PRIOR * c) / (n + 2 * Q.PRIOR) for a, b, c in zip(own, of_lang, of_all))
            kept &= (k > 0 or low <= values[k]) and values[k] <= high
        out.append((i, kept))
    return out


def plain(r, length, words=60):
    return " ".join("".join(r.choice("abcdefghij") for _ in range(max(1, round(r.gauss(length, 1))))) for _ in range(words))


def test_verdicts_equal_brute_force(spark):
    r = random.Random(2)
    rows = [(k, plain(r, 5) + (" #" if k < 40 else ""), "en", "a", "x", "x") for k in range(250)]
    rows += [(1000 + k, plain(r, 12), "de", r.choice("bcd"), "x", "x") for k in range(150)]
    rows += [(1500 + k, "\n".join(r.choice(["one line of words here", plain(r, 4, 6)]) for _ in range(30)), "en", "lines", "x", "x") for k in range(60)]
    odd = [(2000, plain(r, 12), "en", "a", "x", "x"), (2001, plain(r, 4), "de", "b", "x", "x"), (2002, plain(r, 5).replace(" ", "### "), "en", "a", "x", "x")]
    fine = [(3000, plain(r, 5), "en", "rare", "x", "x"), (3001, plain(r, 5), "en", None, "x", "x")]
    rest = [(4000, None, None, None, "x", "x"), (4001, "", "en", "a", "x", "x"), (4002, plain(r, 5), None, "a", "x", "x"), rows[0]]
    every = rows + odd + fine + rest
    found = Q.quality(frame_of(spark, every).repartition(5)).collect()
    assert sorted((x.doc_id, x.kept) for x in found) == sorted(brute_verdicts(every))
    kept = {x.doc_id: x.kept for x in found}
    failed = {x.doc_id for x in found if x.base_failed}
    assert sum(not kept[i] and i not in failed for i, *_ in rows) <= 0.02 * len(rows) and all(kept[i] for i, *_ in fine)
    assert not any(kept[i] for i, *_ in odd) and not kept[4000] and not kept[4001]
    for x in found:
        assert x.base_failed == (x.n_words < 20 or 100 * x.n_repeat_words > 30 * x.n_words)


def test_empty_and_hopeless_tables(spark):
    assert Q.quality(frame_of(spark, [])).count() == 0
    assert [x.kept for x in Q.quality(frame_of(spark, [(1, "short", "en", "a", "x", "x")])).collect()] == [False]
