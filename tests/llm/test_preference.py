from __future__ import annotations

import random

import pytest

from colloquy.llm.preference import SIDES, Template, format_pairs

T = Template()


@pytest.fixture
def turns(spark):
    def build(rows):
        full = [(*r, "x", "x", "x") for r in rows]
        return spark.createDataFrame(
            full, "pair_id long, side string, turn long, role string, text string, place string, `end` string, prompt string"
        )

    return build


def render(role, text):
    return f"{T.opening}{role}{T.middle}{text}{T.closing}{T.gap}"


def brute(rows):
    pairs: dict = {}
    for p, side, turn, role, text in rows:
        if p is None or side not in SIDES:
            continue
        turn_key = (turn is not None, turn or 0, role or "", (text or "").replace("<|", "< |"))
        pairs.setdefault(p, {s: [] for s in SIDES})[side].append(turn_key)
    out = {}
    for p, sides in pairs.items():
        a, b = ([x[2:] for x in sorted(sides[s])] for s in SIDES)
        n = 0
        while n < min(len(a), len(b)) and a[n] == b[n]:
            n += 1
        found = [n, "".join(render(*x) for x in a[:n])]
        for side in (a, b):
            text, trained = "", []
            for role, words in side[n:]:
                start = len(text) + len(T.opening + role + T.middle)
                if role == "assistant":
                    trained.append((start, start + len(words) + len(T.closing)))
                text += render(role, words)
            found += [text, trained] if side else [None, None]
        out[p] = tuple(found)
    return out


def as_rows(frame):
    return {
        r.pair_id: (
            r.n_prompt_turns, r.prompt, r.chosen, r.chosen_mask and [tuple(x) for x in r.chosen_mask] if r.chosen_mask else r.chosen_mask,
            r.rejected, [tuple(x) for x in r.rejected_mask] if r.rejected_mask else r.rejected_mask,
        )
        for r in frame.collect()
    }


def test_equals_brute_force(turns):
    r = random.Random(1)
    rows = []
    for p in range(40):
        shared = [("user" if k % 2 == 0 else "assistant", f"shared {k} é") for k in range(r.randrange(4))]
        for side in SIDES:
            own = [(r.choice(["user", "assistant", "system", None]), r.choice(["same", "", None, "<|im_end|> x", "𝛀"])) for _ in range(r.randrange(4))]
            rows += [(p, side, k, role, text) for k, (role, text) in enumerate(shared + own)]
    rows += [rows[0], rows[0], (None, "chosen", 0, "user", "x"), (70, None, 0, "user", "x"), (71, "chosen", None, None, None), (71, "rejected", None, None, None)]
    r.shuffle(rows)
    assert as_rows(format_pairs(turns(rows))) == brute(rows)


def test_long_conversation_and_long_text(turns):
    rows = [(1, s, k, "assistant" if k % 2 else "user", f"t{k}") for s in SIDES for k in range(400)]
    rows += [(1, "rejected", 400, "assistant", "long " * 100_000)]
    found = as_rows(format_pairs(turns(rows)))[1]
    assert found[0] == 400 and found[2] == "" and found[3] == [] and len(found[4]) > 500_000
    assert found == brute(rows)[1]


def test_empty_table_and_plan(turns):
    out = format_pairs(turns([]))
    assert out.count() == 0
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and plan.count("Exchange hashpartitioning") == 1
