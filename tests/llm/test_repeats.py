import hashlib
import random
import re

import numpy as np
import pytest

from llm import repeats
from llm.queries import QUERIES

WORD = re.compile(r"[^\x20\x09-\x0D]+")
N = repeats.WINDOW


def brute(rows):
    """rows: (doc_id or None, text) -> sorted results by the definition."""
    last = 1 << 63
    tokens = [(last if i is None else i, i, WORD.findall(t or "")) for i, t in rows]
    first = {}
    for key, _, w in sorted(tokens, key=lambda r: r[0]):
        for s in range(len(w) - N + 1):
            first.setdefault(tuple(w[s : s + N]), key)
    out = []
    for key, i, w in tokens:
        gone = [False] * len(w)
        for s in range(len(w) - N + 1):
            if first[tuple(w[s : s + N])] < key:
                gone[s : s + N] = [True] * N
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        out.append((i, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=repr)


def run(docs):
    got = repeats.remove(docs, digest=True).select(
        "doc.doc_id", "n_words", "n_removed", "kept_sha256")
    return sorted(map(tuple, got.collect()), key=repr)


@pytest.mark.parametrize("most", [1 << 19, 1500, 1])
def test_equals_brute_force(spark, monkeypatch, most):
    """With partitions of the anchor's words, of a longer stretch, and of whole windows."""
    monkeypatch.setattr(repeats, "GROUP_WORDS", most)
    rng = random.Random(most)
    words = [f"w{k}" for k in range(40)] + ["é", "日本", "X|Y", "\x1c"]
    passages = [[rng.choice(words) for _ in range(n)] for n in (49, 50, 51, 80, 200)]
    rows = []
    for i in range(120):
        w = []
        for _ in range(rng.randrange(4)):
            w += [rng.choice(words) for _ in range(rng.randrange(60))]
            p = rng.choice(passages)
            a = rng.randrange(len(p) // 3)
            w += p[a:] if rng.random() < 0.5 else p
        rows.append((i - 60, rng.choice([" ", "\n", " \t"]).join(w)))
    rows += [(500, None), (501, ""), (502, "  "), (None, rows[3][1]), (None, rows[3][1]),
             (None, " ".join(passages[4][::-1])), (None, " ".join(passages[4][::-1])),
             (rows[7][0], rows[7][1]), (rows[9][0], " ".join(passages[3] + passages[4])),
             (503, "same " * 30000), (504, "same " * 20000), (505, "y" * 200_000)]
    docs = spark.createDataFrame(
        [(i, t, 1, "a") for i, t in rows], "doc_id bigint, text string, key int, starts string")
    assert run(docs) == brute(rows)


def test_empty_table(spark):
    assert run(spark.createDataFrame([], "doc_id bigint, text string")) == []


def test_query_over_the_whole_table(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    got = QUERIES["op9_substring_dedup"](spark, sf).collect()
    assert sorted(map(tuple, got), key=repr) == brute([(d.doc_id, d.text) for d in docs])


def test_suffix_order_and_common_prefixes():
    rng = np.random.default_rng(2)
    text = rng.integers(0, 2, 400).astype(np.uint64)
    text[150:290] = text[:140]
    at = np.concatenate([np.arange(0, 200 - N + 1), np.arange(200, 400 - N + 1)])
    end = np.where(at < 200, 200, 400)
    tree = np.arange(len(at)) % 2
    order, common = repeats.suffix_order(text, at, end, tree)
    rows = [(tree[k], text[at[k] : at[k] + N].tolist()) for k in order]
    assert rows == sorted(rows)
    for n in range(1, len(order)):
        a, b = order[n - 1], order[n]
        x, y = text[at[a] : end[a]].tolist(), text[at[b] : end[b]].tolist()
        same = next((k for k, (p, q) in enumerate(zip(x, y)) if p != q), min(len(x), len(y)))
        assert common[n] == (min(same, 63) if tree[a] == tree[b] else 0)
    assert (common >= N).any()


@pytest.mark.parametrize("most", [1 << 19, 20_000])
def test_a_very_common_start(spark, monkeypatch, most):
    """A third of the texts begin alike and go on in a few hundred ways."""
    monkeypatch.setattr(repeats, "GROUP_WORDS", most)
    rng = random.Random(3)
    head = [f"h{k}" for k in range(30)]
    rows = []
    for i in range(900):
        body = [f"{i}x{k}" for k in range(20)]
        if i % 3 == 0:
            way = i % 101
            body = head + [f"{way}y{k}" for k in range(rng.randrange(15, 60))] + body
        rows.append((i, " ".join(body)))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert run(docs) == brute(rows)


def test_one_row_three_thousand_times(spark):
    text = " ".join(f"w{k}" for k in range(900))
    rows = [(5, text)] * 3000 + [(None, text)] * 50 + [(4, "a " + text[: len(text) // 2]), (9, text)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(8)
    assert run(docs) == brute(rows)
