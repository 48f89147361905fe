import random

import pytest

from llm import chat
from llm.queries import ORACLES, QUERIES

first = lambda v: (v is not None, v)  # noqa: E731  nulls first


def brute(rows):
    """{conv_id: (n_turns, text)} by comparing all conversations."""
    by = {}
    for c, turn, role, text in set(rows):
        if c is not None:
            by.setdefault(c, []).append((first(turn), first(role), first(text)))
    talks = {c: [t[1:] for t in sorted(v)] for c, v in by.items()}
    out = {}
    for c, t in talks.items():
        if not any(d != c and u[: len(t)] == t and (len(u) > len(t) or d < c)
                   for d, u in talks.items()):
            out[c] = (len(t), "".join(f"<|{r[1] or ''}|>\n{x[1] or ''}\n" for r, x in t))
    return out


def run(frame):
    out = {}
    for r in sorted(chat.render(frame).collect(), key=lambda r: (r.conv_id, r.part)):
        n, text = out.get(r.conv_id, (r.n_turns, ""))
        assert n == r.n_turns
        out[r.conv_id] = (n, text + r.rendered)
    return out


def rows_of(seed):
    rng = random.Random(seed)
    rows, c = [], 0
    for _ in range(30):
        talk = [(rng.choice(["user", "assistant"]), f"t{rng.randrange(6)}")
                for _ in range(rng.randrange(1, 12))]
        for _ in range(rng.randrange(1, 5)):
            cut = talk[: rng.randrange(1, len(talk) + 1)]
            if rng.random() < 0.2:
                cut[-1] = ("user", "other")
            start = rng.randrange(3)
            rows += [(c, start + 2 * k, r, x) for k, (r, x) in enumerate(cut)]
            c += 1
    rows += rows[:10]  # repeated rows
    rows += [(500, None, "user", "a"), (500, 0, None, "b"), (501, None, "user", "a"),
             (502, None, "user", ""), (503, None, "user", None), (504, 0, "", "b"),
             (None, 0, "user", "lost"), (505, 1, "user", "z"), (505, 1, "user", "y"),
             (506, 0, "user", "long " * 20_000)]
    rows += [(600, k, "user", f"{k}") for k in range(70)]
    rows += [(601, k, "user", f"{k}") for k in range(50)]
    return rows


@pytest.mark.parametrize("block,part", [(1024, 1000), (4, 7)])
def test_equals_brute_force(spark, monkeypatch, block, part):
    monkeypatch.setattr(chat, "BLOCK", block)
    monkeypatch.setattr(chat, "PART", part)
    rows = rows_of(block)
    frame = spark.createDataFrame(
        [(*r, 1, "x") for r in rows],
        "conv_id bigint, turn bigint, role string, text string, k int, h1 string")
    assert run(frame) == brute(rows)
    assert run(frame.limit(0)) == {}


def test_query_equals_its_sql(spark):
    from oracle import compare, connect

    sf = "/root/testdata/sf0.001"
    got = QUERIES["op5_chat"](spark, sf)
    assert compare(got, connect(sf).sql(ORACLES["op5_chat"]).to_arrow_table()) is None
