from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from colloquy.llm import hard_negatives
from colloquy.llm.hard_negatives import mine, pack, scores, subset_sums

SCHEMA = "vec_id long, embedding array<float>, label int, id string, block string, slice int, kind string, score double"


def whole(vector):
    return [math.floor(256 * float(np.float32(x))) for x in vector]


def brute(rows, is_anchor, positives=5, negatives=3, band=(50, 95)):
    fit = [
        (i, label, whole(v))
        for i, v, label in rows
        if i is not None and label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)
    ]
    out = []
    for i, label, v in fit:
        if not is_anchor(i):
            continue
        scored = sorted(((-sum(a * b for a, b in zip(v, w)), j, other) for j, other, w in fit))
        for s, j, _ in [x for x in scored if x[2] == label and x[1] != i][:positives]:
            inside = [x for x in scored if x[2] != label and band[0] * -s <= 100 * -x[0] <= band[1] * -s][:negatives]
            out += [(i, j, k + 1, x[1], -s, -x[0]) for k, x in enumerate(inside)]
    return sorted(out)


@pytest.fixture
def embeddings(spark):
    return lambda rows: spark.createDataFrame([(i, v, k, "x", "x", 1, "x", 0.5) for i, v, k in rows], SCHEMA)


def found(frame):
    return sorted(map(tuple, frame.collect()))


def test_scores_are_inner_products():
    r = np.random.default_rng(3)
    for low, high in ((-1, 1), (0, 2), (-300, 200), (-(2**20), 2**20)):
        rows, anchors = r.integers(low, high, (50, 24)), r.integers(low, high, (7, 24))
        assert (scores(subset_sums(anchors), pack(rows)) == rows @ anchors.T).all()


@pytest.mark.parametrize("tiles", [(3, 2, 4, 5), (2048, 256, 8192, 1024)])
def test_equals_brute_force(embeddings, monkeypatch, tiles):
    block, anchor_tile, rows_block, row_tile = tiles
    for name, value in (("ANCHOR_TILE", anchor_tile), ("ROWS_A_BLOCK", rows_block), ("ROW_TILE", row_tile)):
        monkeypatch.setattr(hard_negatives, name, value)
    r = random.Random(5)
    rows = [(i, [r.uniform(-0.1, 0.5) for _ in range(11)], r.randrange(3)) for i in range(90)]
    rows += [(90 + k, rows[k][1], rows[k + 1][2]) for k in range(20)]  # ties
    rows += [rows[4], rows[4], rows[5]]  # rows that repeat
    rows += [(None, [0.5] * 11, 1), (200, None, 1), (201, [0.5] * 11, None), (205, [], 2), (210, [0.4, 0.4], 2)]
    rows += [(202, [0.5, None] + [0.5] * 9, 1), (203, [float("nan")] * 11, 1), (204, [float("inf")] * 11, 1), (220, [-0.4] * 11, 0)]
    expected = brute(rows, lambda i: i % 5 == 0)
    got = mine(embeddings(rows), F.col("vec_id") % 5 == 0, anchors_a_block=block, rows_a_slice=7)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert found(got) == expected
    assert len(expected) > 150


def test_large_components_are_exact_or_refused(embeddings):
    rows = [(0, [30000.0, -20000.5], 0), (1, [30000.0, -20000.0], 0), (2, [16000.0, -10000.0], 1), (3, [15000.0, -20000.0], 1)]
    assert found(mine(embeddings(rows), F.col("vec_id") == 0)) == brute(rows, lambda i: i == 0)
    with pytest.raises(Exception, match="64 bits"):
        mine(embeddings([(0, [1e30], 0), (1, [1e30], 0)]), F.col("vec_id") == 0).collect()


def test_nothing_to_mine(embeddings):
    assert found(mine(embeddings([]), F.col("vec_id") == 0)) == []
    alone = [(0, [0.5], 0), (1, [0.25], 1)]
    assert found(mine(embeddings(alone), F.col("vec_id") >= 0)) == []  # no positives
    assert found(mine(embeddings(alone), F.col("vec_id") > 5)) == []  # no anchors


def test_more_dimensions_than_a_short_number_holds(embeddings):
    r = random.Random(6)
    rows = [(i, [r.uniform(-1, 2) for _ in range(200)], i % 2) for i in range(30)]
    assert found(mine(embeddings(rows), F.col("vec_id") < 9)) == brute(rows, lambda i: i < 9)
