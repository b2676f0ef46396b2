from __future__ import annotations

import random

import numpy as np

from colloquy.llm.line_dedup import dedup_lines, near


def distance(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]


def edited(r: random.Random, line: str, edits: int) -> str:
    chars = list(line)
    for _ in range(edits):
        at = r.randrange(len(chars) + 1)
        kind = r.randrange(3)
        if kind == 0:
            chars.insert(at, r.choice("abcé"))
        elif at < len(chars):
            if kind == 1:
                del chars[at]
            else:
                chars[at] = r.choice("xyz𝛀")
    return "".join(chars)


def brute(rows, edits, min_chars):
    """Every pair of lines compared."""
    order = sorted({(i is not None, i or 0, t) for i, t in rows if t is not None})
    first = {}
    for named, i, text in order:
        for k, line in enumerate(text.split("\n")):
            if line.strip():
                first.setdefault(line, (named, i, text, k))
    long = [x for x in first if len(x) >= min_chars]
    drop = {
        max(a, b, key=first.get)
        for n, a in enumerate(long)
        for b in long[n + 1 :]
        if abs(len(a) - len(b)) <= edits and distance(a, b) <= edits
    }
    out = []
    for i, text in rows:
        if text is None:
            out.append((i, None, 0, 0))
            continue
        lines = text.split("\n")
        place = (i is not None, i or 0, text)
        kept = [x for k, x in enumerate(lines) if not x.strip() or (first[x] == (*place, k) and x not in drop)]
        visible = sum(bool(x.strip()) for x in lines)
        out.append((i, "\n".join(kept), visible, visible - sum(bool(x.strip()) for x in kept)))
    return out, drop


def test_banded_distance():
    r = random.Random(5)
    for edits in (0, 1, 2, 3, 5):
        left = ["".join(r.choice("abé𝛀"[: r.choice([1, 2, 4])]) for _ in range(r.randrange(14))) for _ in range(800)]
        right = [edited(r, a, r.randrange(edits + 3)) for a in left]
        expected = np.array([distance(a, b) <= edits for a, b in zip(left, right)])
        assert (near(left, right, edits) == expected).all()


def test_equals_all_pairs(documents):
    r = random.Random(2)
    base = ["".join(r.choice("abcdé fgh") for _ in range(r.randrange(30, 60))) for _ in range(20)]
    rows = []
    for i in range(60):
        lines = [edited(r, r.choice(base), r.randrange(4)) if r.random() < 0.8 else r.choice(["", "  ", "short"]) for _ in range(r.randrange(6))]
        rows.append((i, "\n".join(lines)))
    rows += [rows[5], (None, base[0]), (None, None), (200, None), (201, ""), (202, "\n\n"), (203, "one\n" * 50 + "tail")]
    expected, drop = brute(rows, 2, 30)
    found = dedup_lines(documents(rows), counts=("lines", "gone")).select("doc_id", "text", "lines", "gone").collect()
    assert len(drop) > 20
    assert sorted(map(str, map(tuple, found))) == sorted(map(str, expected))


def test_columns_stay_and_empty_table(documents):
    frame = documents([])
    out = dedup_lines(frame)
    assert out.columns == frame.columns and out.count() == 0


def test_long_text(documents):
    text = "\n".join(f"line number {k} of a very long text with its own words {k * k}" for k in range(3000))
    found = dedup_lines(documents([(1, text), (2, text)])).select("doc_id", "text").collect()
    one, two = (dict(map(tuple, found))[i] for i in (1, 2))
    assert two == "" and 0 < len(one) <= len(text)
