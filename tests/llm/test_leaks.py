import hashlib
import random
import re

import pytest

from llm import leaks
from llm.queries import ORACLES, QUERIES
from tests.oracle import compare, connect

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
N = leaks.WINDOW


def tokens(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def windows(items):
    found = {}
    for name, text in items:
        w = tokens(text)
        for s in range(max(1, len(w) - N + 1) if w else 0):
            found.setdefault(tuple(w[s : s + N]), set()).add("" if name is None else str(name))
    return found


def brute(docs, items):
    known = windows(items)
    out = []
    for doc_id, text in docs:
        w = tokens(text)
        hit, names = set(), set()
        for n in {len(k) for k in known}:
            for s in range(len(w) - n + 1):
                found = known.get(tuple(w[s : s + n]))
                if found:
                    hit.update(range(s, s + n))
                    names |= found
        sha = hashlib.sha256(",".join(sorted(names)).encode()).hexdigest()
        out.append((doc_id, len(w), len(hit), len(names), sha, bool(hit)))
    return sorted(out, key=repr)


def made(seed):
    rng = random.Random(seed)
    pool = ["a", "B", "c9", "é", "日本", "x_y", "D", "0"]
    def text(n):
        return "".join(rng.choice(pool) + rng.choice([" ", ", ", "\n", "--"]) for _ in range(n))
    items = [(i, text(rng.randrange(1, 60))) for i in range(40)]
    items += [(50, items[30][1]), (50, items[31][1]), (50, items[31][1]), (None, text(30)),
              (60, None), (61, ""), (62, "-- "), (63, "a b"), (64, "Zz")]
    docs = []
    for i in range(150):
        parts = [text(rng.randrange(40))]
        for _ in range(rng.randrange(3)):
            w = tokens(rng.choice(items)[1])
            a = rng.randrange(len(w) + 1)
            parts += [" ".join(w[a : a + rng.randrange(5, 40)]).upper(), text(rng.randrange(3))]
        docs.append((i, " ".join(parts)))
    docs += [(200, None), (201, ""), (202, " ,"), (None, items[5][1]), (203, items[5][1]),
             (203, items[5][1]), (204, "b c9 " * 20000 + items[9][1]), (205, "q" * 200_000)]
    return docs, items


def frames(spark, docs, items):
    return (spark.createDataFrame([(i, t, "x", 1) for i, t in docs],
                                  "doc_id bigint, text string, spans string, items int"),
            spark.createDataFrame([(i, t, 2) for i, t in items],
                                  "item_id bigint, text string, doc_id int"))


# A small block makes several passes; a small shard splits the texts of a batch.
@pytest.mark.parametrize("block, shard", [(32 << 20, 8 << 20), (400, 8 << 20), (32 << 20, 2000)])
def test_equals_brute_force(spark, monkeypatch, block, shard):
    monkeypatch.setattr(leaks, "BLOCK_BYTES", block)
    docs, items = made(1)
    d, b = frames(spark, docs, items)
    assert (leaks.block_count(b) > 5) == (block < 1000)
    got = leaks.report(leaks.find(d, b, shard_bytes=shard)).collect()
    assert sorted(map(tuple, got), key=repr) == brute(docs, items)


def test_longest_matches(spark):
    docs, items = made(2)
    docs = docs[:-2]
    d, b = frames(spark, docs, items)
    texts = [(i, tokens(t)) for i, t in docs]
    expected = {}
    for name, text in items:
        w = tokens(text)
        for s in range(max(1, len(w) - N + 1) if w else 0):
            best = 0
            for _, t in texts:
                for p in range(len(t)):
                    n = 0
                    while n < len(w) - s and p + n < len(t) and t[p + n] == w[s + n]:
                        n += 1
                    best = max(best, n)
                    if best == len(w) - s:
                        break
            if best >= min(N, len(w)):
                key = ("" if name is None else str(name), s)
                expected[key] = max(best, expected.get(key, 0))
    got = leaks.longest(d, b).collect()
    assert {(r.item_id, r.item_start): r.length for r in got} == expected
    by_id = {}
    for i, t in texts:
        by_id.setdefault(i, []).append(t)
    named = {}
    for i, t in items:
        named.setdefault("" if i is None else str(i), []).append(tokens(t))
    for r in got:
        assert any(t[r.doc_start : r.doc_start + r.length] == w[r.item_start :][: r.length]
                   for t in by_id[r.doc_id] for w in named[r.item_id])


def test_clean_keeps_rows_and_columns(spark):
    docs, items = made(3)
    d, b = frames(spark, docs, items)
    d = d.withColumnRenamed("items", "a.b")
    left = leaks.clean(d, b)
    assert left.columns == d.columns
    expected = [(i, t) for i, t in docs if not brute([(i, t)], items)[0][-1]]
    assert sorted(((r.doc_id, r.text) for r in left.collect()), key=repr) == sorted(
        expected, key=repr)


def test_empty_tables(spark):
    d = spark.createDataFrame([], "doc_id bigint, text string")
    b = spark.createDataFrame([], "item_id bigint, text string")
    assert leaks.report(leaks.find(d, b)).count() == 0 and leaks.longest(d, b).count() == 0
    one = spark.createDataFrame([(1, "a")], "doc_id bigint, text string")
    row = leaks.report(leaks.find(one, b)).first()
    assert tuple(row) == (1, 1, 0, 0, hashlib.sha256(b"").hexdigest(), False)


def test_query_over_the_whole_table(spark):
    sf = "/root/testdata/sf0.01"
    read = lambda t, c: [tuple(r) for r in spark.read.parquet(f"{sf}/{t}.parquet").select(
        c, "text").collect()]
    got = QUERIES["op12_leaks"](spark, sf).collect()
    expected = brute(read("documents", "doc_id"), read("benchmark", "item_id"))
    assert sorted(map(tuple, got), key=repr) == expected
    assert any(r.contaminated for r in got)
    assert compare(QUERIES["op12_leaks"](spark, sf), connect(sf).sql(
        ORACLES["op12_leaks"]).to_arrow_table()) is None
