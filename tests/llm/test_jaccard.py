import random
import re
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from llm import jaccard
from llm.components import components, roots
from llm.queries import QUERIES

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sets_of(text):
    w = WORD.findall(text or "")
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute(rows):
    """{doc_id: (class_id, n_links)} by comparing all pairs of texts."""
    by = defaultdict(list)
    for i, t in rows:
        by[t].append(i)
    texts = [t for t in by if sets_of(t)]
    sets = [sets_of(t) for t in texts]
    links, top = [len(by[t]) - 1 for t in texts], list(range(len(texts)))

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for a in range(len(texts)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if 5 * both >= 4 * (len(sets[a]) + len(sets[b]) - both):
                links[a] += len(by[texts[b]])
                links[b] += len(by[texts[a]])
                top[find(a)] = find(b)
    low = defaultdict(lambda: 1 << 62)
    for k, t in enumerate(texts):
        low[find(k)] = min(low[find(k)], *by[t])
    out = {i: (i, 0) for i, _ in rows}
    for k, t in enumerate(texts):
        for i in by[t]:
            out[i] = (low[find(k)], links[k])
    return out


def rows_of(seed):
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(3000)]
    rows, n = [], 0
    for _ in range(25):
        base = [rng.choice(vocabulary) for _ in range(rng.randrange(30, 200))]
        for _ in range(rng.randrange(1, 9)):
            w = list(base)
            for _ in range(rng.randrange(0, max(1, len(w) // 40) + 1)):
                w[rng.randrange(len(w))] = rng.choice(vocabulary)
            for _ in range(rng.randrange(1, 3)):
                rows.append((n, " ".join(w)))
                n += 1
    rows += [(n, ""), (n + 1, "   "), (n + 2, "a b"), (n + 3, "a b"), (n + 4, "a\tb"),
             (n + 5, "a b c"), (n + 6, "long " * 20000), (n + 7, "long " * 30000),
             (n + 8, "q" * 100_000)]
    return rows


@pytest.mark.parametrize("leaf,block", [(1024, 256), (2, 3)])
def test_equals_brute_force(spark, monkeypatch, leaf, block):
    monkeypatch.setattr(jaccard, "LEAF", leaf)
    monkeypatch.setattr(jaccard, "SKETCH_BLOCK", block)
    monkeypatch.setattr(jaccard, "TEXT_BLOCK", block)
    rows = rows_of(leaf)
    docs = spark.createDataFrame([(i, t, 0, 1, "x") for i, t in rows],
                                 "doc_id bigint, text string, node int, n int, path string")
    got = {r.doc_id: (r.class_id, r.n_links) for r in jaccard.join(docs).collect()}
    want = brute(rows)
    assert len(got) == len(want)
    # Links are exact; the target recall allows none of these few hundred pairs to be missed.
    assert got == want


def test_dedup_keeps_one_of_each_class_and_all_columns(spark):
    rows = rows_of(5) + [(None, None), (None, "only here one two three"), (3, "dup row x y z"),
                         (3, "dup row x y z")]
    docs = spark.createDataFrame([(i, t, "c") for i, t in rows],
                                 "doc_id bigint, text string, class_id string")
    out = jaccard.dedup(docs)
    assert out.columns == docs.columns
    kept = [(r.doc_id, r.text) for r in out.collect()]
    assert (None, None) in kept and (None, "only here one two three") in kept
    want = {c for c, _ in brute([r for r in rows_of(5) if sets_of(r[1])]).values()}
    empty = {i for i, t in rows_of(5) if not sets_of(t)}
    assert {i for i, _ in kept if i is not None} >= (want | empty) - {3}
    assert len([1 for i, t in kept if t == "dup row x y z"]) == 1
    assert jaccard.join(docs.limit(0)).count() == 0


def test_query_over_the_whole_table(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    got = {r.doc_id: (r.class_id, r.n_links) for r in QUERIES["op8_jaccard"](spark, sf).collect()}
    assert got == brute([(d.doc_id, d.text) for d in docs])


def test_components_of_a_long_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(300)] + [(1000, 1000 + i) for i in range(1, 200)] + [(7, 7)]
    frame = spark.createDataFrame(edges[::-1], "a bigint, b bigint")
    got = {r.node: r.component for r in components(frame).collect()}
    assert got == {i: 0 for i in range(301)} | {1000 + i: 1000 for i in range(200)}
    assert components(frame.limit(0)).count() == 0


@settings(max_examples=40, deadline=None)
@given(st.lists(st.sets(st.integers(0, 30), min_size=1), min_size=1, max_size=8))
def test_overlaps(sets):
    got = jaccard.overlaps([np.array(sorted(s), np.uint64) for s in sets])
    assert got.tolist() == [[len(a & b) for b in sets] for a in sets]


def test_roots():
    got = roots(5, np.array([0, 1]), np.array([1, 3]), np.array([9, 4, 5, 2, 7]))
    assert got.tolist() == [2, 2, 5, 2, 7]


def test_one_id_with_two_texts(spark):
    """Each text has its own links and class, and a clean one is not deleted with the other."""
    def text(name, changed=0):
        return " ".join([f"{name}{k}" for k in range(100 - changed)] + ["end"] * changed)

    rows = [(0, text("a")), (3, text("a", 2)), (3, text("b")), (5, text("b", 2)), (6, text("c")),
            (3, text("d")), (7, text("e")), (7, text("e", 2)), (8, text("e"))]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = sorted(tuple(r) for r in jaccard.join(docs).select(
        "doc_id", "class_id", "n_links").collect())
    assert got == [(0, 0, 1), (3, 0, 1), (3, 3, 0), (3, 3, 1), (5, 3, 1), (6, 6, 0), (7, 7, 1 + 1),
                   (7, 7, 2), (8, 7, 2)]
    kept = sorted((r.doc_id, r.text) for r in jaccard.dedup(docs).collect())
    assert kept[:-1] == sorted([rows[0], rows[2], rows[4], rows[5]])
    assert kept[-1] in rows[6:8]
    assert sum(r.kept for r in jaccard.join(docs).collect()) == len(kept)
