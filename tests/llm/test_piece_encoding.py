from __future__ import annotations

import random

import numpy as np
import pytest
import sentencepiece

from colloquy.llm import piece_encoding as P
from colloquy.llm.pieces import VOCABULARY, Pieces, load

TEXTS = ["Hello world", "  two  blanks ", "tab\tand\nline", "日本語テキスト and é€𝛀", "x" * 300, "the" * 200, " ", "ﬁ \x00 end", "a" + " " * 40 + "b"]


@pytest.fixture(scope="module")
def model():
    return sentencepiece.SentencePieceProcessor(model_file=VOCABULARY)


@pytest.fixture(scope="module")
def pieces():
    return load()


def words(r):
    return "".join(r.choice(["the", "tion", " ", "a", "é", "\n", "ing", "  ", "Z", "日", "€", "un"]) for _ in range(r.randrange(60)))


def test_whole_texts_equal_the_library(model, pieces):
    encoder, r = P.Encoder(pieces), random.Random(1)
    for text in TEXTS + [words(r) for _ in range(300)]:
        assert np.frombuffer(encoder.encode(text), np.int32).tolist() == model.encode(text)


def by_chunks(encoder, text, size):
    whole, reach = P.normalised(text), encoder.longest
    chunks = [(whole[max(0, a - reach) : a], whole[a : a + size], whole[a + size : a + size + reach]) for a in range(0, len(whole), size)]
    matrices = [encoder.matrix(*c, first=k == 0) for k, c in enumerate(chunks)]
    states = P.best_states(matrices, (0, P.START), None)
    # Products may be taken in any order.
    half = len(matrices) // 2
    if half:
        total = None
        for side in (matrices[:half], matrices[half:]):
            product = side[0]
            for m in side[1:]:
                product = P.combined(product, m)
            total = product if total is None else P.combined(total, product)
        assert states[-1] in total[0, P.START]
    return b"".join(encoder.trace_chunk(c[1], c[2], a, b) for c, a, b in zip(chunks, states, states[1:]))


def test_chunks_equal_the_whole(pieces):
    encoder, r = P.Encoder(pieces), random.Random(2)
    for text in TEXTS + [words(r) for _ in range(100)]:
        for size in (16, 17, 40):
            assert by_chunks(encoder, text, size) == encoder.encode(text)


def test_unigram_scores():
    r = random.Random(3)
    alphabet = "▁abc"
    ids = {c: k for k, c in enumerate(alphabet)}
    for n in (2, 3, 4):
        for _ in range(12):
            ids.setdefault(r.choice(["▁", ""]) + "".join(r.choice("abc") for _ in range(n)), len(ids))
    made = Pieces(ids, [-r.uniform(1, 9) for _ in ids], unknown=0, size=len(ids), is_unigram=True)
    encoder = P.Encoder(made)

    def best(word):
        totals = [0.0] + [-1e9] * len(word)
        for i in range(len(word)):
            for p, k in ids.items():
                if word.startswith(p, i):
                    totals[i + len(p)] = max(totals[i + len(p)], totals[i] + made.scores[k])
        return totals[-1]

    for _ in range(200):
        text = " ".join("".join(r.choice("abc") for _ in range(r.randrange(1, 30))) for _ in range(r.randrange(1, 4)))
        for found in (encoder.encode(text), by_chunks(encoder, text, 8)):
            numbers = np.frombuffer(found, np.int32).tolist()
            assert "".join(encoder.text_of[i] for i in numbers) == P.normalised(text)
            assert abs(sum(made.scores[i] for i in numbers) - best(P.normalised(text))) < 1e-9


def test_rows(spark, documents, model):
    r = random.Random(4)
    rows = [(k, t) for k, t in enumerate(TEXTS + [words(r) for _ in range(60)])] + [(0, TEXTS[0]), (None, "null id"), (500, None), (501, "")]
    rows.append((502, "long and longer words of a text " * 20_000 + "unbroken" * 5_000))
    frame = documents(rows)
    encoded = P.encode(frame, keep=("doc_id", "cls"), chunk=64, group=3)
    found = [(x.doc_id, x.ids) for x in encoded.collect()]
    expected = [(i, None if t is None else model.encode(t)) for i, t in rows]
    assert sorted(map(str, found)) == sorted(map(str, expected))
    decoded = {x.doc_id: x.decoded for x in P.decode(encoded).collect()}
    assert decoded == {i: t for i, t in rows}


def test_decode_odd_ids(spark, model):
    rows = [(1, [None, 99_999, -1] + model.encode("ok")), (2, None), (3, []), (4, [230, 10])]
    out = P.decode(spark.createDataFrame(rows, "k long, ids array<int>"))
    found = {x.k: x.decoded for x in out.collect()}
    assert found[1] == "ok" and found[2] is None and found[3] == "" and "�" in found[4]


def test_empty_table(documents):
    assert P.encode(documents([])).count() == 0


def test_many_words_at_once_are_cut_as_one_by_one():
    pieces, r = load(VOCABULARY), random.Random(9)
    encoder = P.Encoder(pieces)
    words = ["".join(r.choice("abcdefghijklmnopqrstuvwxyzéßñüЖ李0123.,-'\t\n") for _ in range(r.randrange(1, 14))) for _ in range(4000)]
    words += [w + r.choice(["ing", "tion", "ed", "s", "heit"]) for w in ("walk", "read", "na", "Frei", "THE", "the", "x" * 80, "")] + ["a" * 50]
    marked = [P.SPACE + w for w in words]
    assert encoder.new_words(marked) == [encoder.new_word(w) for w in marked]
    texts = [" ".join(r.choice(words) or "e" for _ in range(r.randrange(1, 30))) for _ in range(300)] + [None, "", " a", "a  b", "a\u2581b"]
    fresh = P.Encoder(pieces)
    assert encoder.encode_all(texts) == [None if t is None else fresh.encode(t) for t in texts]
    assert encoder.new_words([]) == []
