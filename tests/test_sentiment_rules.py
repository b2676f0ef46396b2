"""All scoring rules against a plain version that goes word by word."""

from __future__ import annotations

import math
import random

import pytest
import regex

from colloquy.operators import sentiment
from colloquy.operators.sentiment import Modifiers, lexicon_table, score_texts

LEXICON = {"good": 1.9, "bad": -2.5, "love": 3.2, "hate": -2.7, "so": 0.5, "not": -0.4, "least": -0.3, ":)": 2.0, ":-d": 2.6, "<3": 1.9, "8)": 0.4}
RULES = Modifiers(
    negations=("not", "no", "never", "without"), strengtheners=("very", "so"), weakeners=("hardly", "less"),
    idioms=(("the bomb", 3.0), ("bad good", 1.5), ("kiss of bad", -1.5), ("good at all", -2.2), ("hate it", 0.7), ("the most less", 1.1)),
    weakening_pairs=("sort of", "kind of"), unweighted_pairs=("good of",),
)
WORDS = (
    "good bad love hate so not never this without doubt least at very hardly less but the bomb kiss of it all most sort kind no isn't "
    "GOOD Bad LOVE VERY SO NOT Hate :) :-D <3 8) word other ! ?? !!!"
).split()


def plain(text, lexicon, m):
    symbols = sorted(t for t in lexicon if not regex.fullmatch(r"[\p{L}\p{N}_']+", t))
    pattern = "|".join(rf"(?<!\S)(?i:{regex.escape(s)})(?!\S)" for s in symbols)
    tokens = regex.findall(rf"{pattern}|[\p{{L}}\p{{N}}_']+" if symbols else r"[\p{L}\p{N}_']+", text or "")
    words = [t.lower() for t in tokens]
    shouted = [t.upper() == t != t.lower() for t in tokens]
    mixed = 0 < sum(shouted) < len(tokens)
    but = words.index("but") if "but" in words else None
    total = 0.0
    word = lambda k: words[k] if 0 <= k < len(words) else None
    for i, w in enumerate(words):
        if w not in lexicon or w in m.strengtheners + m.weakeners or f"{w} {word(i + 1)}" in m.unweighted_pairs:
            continue
        v = lexicon[w]
        if mixed and shouted[i]:
            v += math.copysign(0.733, v)
        for back, damping in ((1, 1.0), (2, 0.95), (3, 0.9)):
            p = word(i - back)
            if p is None or p in lexicon:
                continue
            s = 0.293 if p in m.strengtheners else -0.293 if p in m.weakeners else 0.0
            if s and mixed and shouted[i - back]:
                s += 0.733
            v += math.copysign(1, v) * s * damping
            between = [word(i - k) for k in range(1, back)]
            if back > 1 and p in m.never and any(x in m.so for x in between):
                v *= {2: 1.5, 3: 1.25}[back]
            elif back > 1 and p in m.without and any(x in m.doubt for x in between):
                pass
            elif p in m.negations or p.endswith("n't"):
                v *= -0.74
            if back == 3:
                around = {k: word(i + k) for k in range(-3, 3)}
                spans = [(0, 2), (0, 1), (-1, 0), (-2, 0), (-2, -1), (-3, -1), (-3, -2)]
                phrases = [" ".join(str(around[k]) for k in range(a, b + 1)) for a, b in spans]
                v = next((dict(m.idioms)[x] for x in phrases if x in dict(m.idioms)), v)
                if phrases[6] in m.weakening_pairs or phrases[4] in m.weakening_pairs:
                    v -= 0.293
        p = word(i - 1)
        if p in m.least and p not in lexicon and word(i - 2) not in m.before_least:
            v *= -0.74
        total += v * (1 if but is None or i == but else 0.5 if i < but else 1.5)
    marks, asks = min((text or "").count("!"), 4) * 0.292, (text or "").count("?")
    marks += 0.96 if asks > 3 else asks * 0.18 if asks > 1 else 0
    total += marks if total > 0 else -marks if total < 0 else 0
    return round(total / math.sqrt(total * total + 15), 4)


@pytest.mark.parametrize("lexicon", [LEXICON, {"good": 1.9, "bad": -2.5, "love": 3.2, "hate": -2.7}])
@pytest.mark.parametrize("listed", [10_000, 0])
def test_scores_equal_the_plain_rules(spark, monkeypatch, lexicon, listed):
    monkeypatch.setattr(sentiment, "LISTED_TERMS", listed)
    r = random.Random(len(lexicon))
    texts = [" ".join(r.choice(WORDS) for _ in range(r.randrange(14))) + r.choice(["", ".", " !", "!!!!!", "??", "????"]) for _ in range(1500)]
    texts += [None, "", "so good:) :)", ":)", "x\n:-D\t<3"]
    frame = spark.createDataFrame(list(enumerate(texts)), "id long, question string")
    got = dict(score_texts(frame, lexicon_table(spark, list(lexicon.items())), ("question",), modifiers=RULES).collect())
    wrong = [(t, got[i], plain(t, lexicon, RULES)) for i, t in enumerate(texts) if abs(got[i] - plain(t, lexicon, RULES)) > 2e-4]
    assert wrong == []
    assert len(set(got.values())) > 300


def test_published_examples_of_the_special_rules(spark):
    texts = {
        "it is the least good thing": -1, "it is at least good": 1, "never so good": 1, "it was never good": -1,
        "this is without doubt good": 1, "a day with :)": 1, "they are kind of people": 0, "it was the bomb good": 1,
    }
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, question string")
    terms = lexicon_table(spark, [("good", 1.9), (":)", 2.0), ("kind", 2.4)])
    got = dict(score_texts(frame, terms, ("question",)).collect())
    signs = {t: (got[i] > 0) - (got[i] < 0) for i, t in enumerate(texts)}
    assert signs == texts


def test_too_many_emoticons_raise(spark, monkeypatch):
    monkeypatch.setattr(sentiment, "MAX_EMOTICONS", 2)
    frame = spark.createDataFrame([(1, "a")], "id long, question string")
    with pytest.raises(ValueError, match="no words"):
        score_texts(frame, lexicon_table(spark, [(":)", 1.0), (":(", -1.0), (":|", 0.0)]), ("question",))
