from __future__ import annotations

import itertools
import random

import numpy as np
from pyspark.sql import functions as F

from colloquy.llm import language_id as L
from colloquy.llm.pieces import Pieces


def test_forward_sums_all_segmentations():
    ids = {p: k for k, p in enumerate(["a", "b", "ab", "ba", "aba"])}
    trie = Pieces(ids, [0.0] * 5, size=5).trie()
    r = np.random.default_rng(0)
    p = np.vstack([r.uniform(0.01, 0.3, (5, 3)), np.full((1, 3), 1e-3)])
    lattice = L.Lattice(trie, 5)

    def brute(word):
        total, uses = np.zeros(3), np.zeros((6, 3))
        for cuts in itertools.product([0, 1], repeat=len(word) - 1):
            parts, start = [], 0
            for k, c in enumerate(cuts, 1):
                if c:
                    parts.append(word[start:k])
                    start = k
            parts.append(word[start:])
            numbers = [ids.get(x, 5 if len(x) == 1 else None) for x in parts]
            if None not in numbers:
                weight = np.prod([p[k] for k in numbers], axis=0)
                total += weight
                for k in numbers:
                    uses[k] += weight
        return total, uses / total

    words = ["abab", "a", "cab", "bbaabab"]
    assert np.allclose(lattice.log_probabilities(words, p), [np.log(brute(w)[0]) for w in words])
    counts = np.array([[1.0, 2, 0], [0, 1, 1], [3, 0, 1], [1, 1, 1]])
    expected = sum(brute(w)[1] * c for w, c in zip(words, counts))
    assert np.allclose(lattice.expected(words, counts, p), expected)


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    held = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2
    model = L.fit(docs.where(~held), docs_each=60)
    found = L.predict(docs.where(held).select("doc_id", "text", "lang"), model).collect()
    assert len(found) > 200
    assert np.mean([x.lang == x.lang_pred for x in found]) >= 0.98
    assert all(0 <= x.score <= 1 for x in found)


def test_odd_rows(spark, documents):
    train = spark.createDataFrame(
        [(k, t, g) for k, (t, g) in enumerate([("the thing of that", "en"), ("der das und ein", "de"), (None, "en"), ("x", None)] * 5)],
        "doc_id long, text string, lang string",
    )
    model = L.fit(train)
    assert model.languages == ["de", "en"]
    rows = [(1, "the that"), (1, "the that"), (2, None), (3, ""), (4, "123 !?"), (None, "und das"), (6, "the thing " * 300_000), (7, "DER" * 20_000)]
    out = L.predict(documents(rows), model, lang_pred="guess", score="sure")
    found = [(x.doc_id, x.guess, x.sure) for x in out.collect()]
    guesses = [(i, g) for i, g, _ in found]
    assert guesses == [(1, "en"), (1, "en"), (2, "und"), (3, "und"), (4, "und"), (None, "de"), (6, "en"), (7, "de")]
    assert all(s == 0 for _, g, s in found if g == "und")
    nothing = L.fit(train.limit(0))
    assert [x.guess for x in L.predict(documents(rows[:1]), nothing, lang_pred="guess").collect()] == ["und"]
    assert L.predict(documents([]), model).count() == 0


def test_long_words_are_summed_without_a_cut():
    r = random.Random(5)
    ids = {c: k for k, c in enumerate(["a", "b", "ab", "ba", "aab", L.SPACE, L.SPACE + "a"])}
    lattice = L.Lattice(Pieces(ids, [0.0] * 7, size=7).trie(), 7)
    probabilities = np.random.default_rng(1).random((8, 3))
    words = [L.SPACE + "".join(r.choice("abx") for _ in range(n)) for n in (1, 20, 33, 60, 90)]
    counts = np.random.default_rng(2).random((5, 3))
    sums, lengths, _ = lattice.forward(words, probabilities)
    assert np.allclose(lattice.log_probabilities(words, probabilities), np.log(sums[lengths, range(5)]))
    assert np.allclose(lattice.expected(words, counts, probabilities), lattice._expected_plain(words, counts, probabilities))
    giant = L.SPACE + "abx" * 4000
    assert np.isfinite(lattice.log_probabilities([giant], probabilities * 1e-6)).all()


def test_languages_without_blanks_are_told_apart(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("lang in ('en', 'de') and length(text) between 300 and 900")
    glued = docs.select("doc_id", F.regexp_replace("text", r"[^\p{L}]", "").alias("text"), "lang").where("length(text) > 100")
    model = L.fit(glued.where("doc_id % 2 = 0"))
    found = L.predict(glued.where("doc_id % 2 = 1"), model).collect()
    assert len(found) > 40
    assert sum(x.lang == x.lang_pred for x in found) >= 0.95 * len(found)


def test_words_are_cut_and_scored_together(monkeypatch):
    """Steps are numpy calls over all words of a batch, with the sums of a walk of the trie character by character."""
    r = random.Random(3)
    ids = {p: k for k, p in enumerate(["a", "b", "é", "ab", "ba", "aé", "𝒜", "abab", L.SPACE, L.SPACE + "a"])}
    trie = Pieces(ids, [0.0] * len(ids), size=len(ids)).trie()
    lattice = L.Lattice(trie, len(ids))
    words = [L.SPACE + "".join(r.choice("abé𝒜x") for _ in range(r.randint(0, 12))) for _ in range(300)]
    found = sorted((w, begin, end, p) for begin, end, at, pieces in lattice.steps(words) for w, p in zip(at.tolist(), pieces.tolist()))
    walked = sorted((w, i, *edge) for w, word in enumerate(words) for i in range(len(word)) for edge in lattice.pieces_at(word, i))
    assert found == walked
    assert list(lattice.steps([])) == [] and list(lattice.steps([""])) == []
    monkeypatch.setattr(L.Lattice, "pieces_at", None)
    assert np.isfinite(lattice.log_probabilities(words, np.full((len(ids) + 1, 2), 0.1))).all()


def test_words_are_those_of_the_pattern():
    import regex

    for text in ("", "!", "It's 3 o'clock_x", "Straße ŒUVRE İstanbul", "éa ́b ć", "日本語 한국어 ǅ ª º Ⅷ ²", "a\x00b c\xa0d", "नमस्ते"):
        assert [w for part in L.text_words(text) for w in part] == regex.findall(L.WORD, text.lower())


def test_rates_of_many_texts_are_those_of_each():
    ids = {p: k for k, p in enumerate(["a", "b", "ab", L.SPACE])}
    trie = Pieces(ids, [0.0] * 4, size=4).trie()
    model = L.LanguageModel(["x", "y"], np.random.default_rng(0).random((5, 2)) / 5, np.zeros(2))
    r = random.Random(1)
    parts = [(k % 2, ["".join(r.choice("abc") for _ in range(r.randint(1, 5))) for _ in range(n)]) for k, n in enumerate((1, 2, 3, 9, 40))]
    found = sorted((k, n, round(x, 9)) for ks, n, rates in L.Scorer(model, trie).rates_together(parts) for k, x in zip(ks.tolist(), rates.tolist()))
    lattice, expected = L.Lattice(trie, 4), []
    for k, words in parts:
        logs = lattice.log_probabilities([L.SPACE + w for w in words], model.probabilities)[:, k]
        for n in (1, 2, 4, 8, 16, 32):
            for i in range(0, len(words) - n + 1, n):
                expected.append((k, n, round(sum(logs[i : i + n]) / sum(len(w) + 1 for w in words[i : i + n]), 9)))
    assert found == sorted(expected)
    assert list(L.Scorer(model, trie).rates_together([])) == []
