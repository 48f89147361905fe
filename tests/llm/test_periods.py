import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from llm import periods
from llm.queries import QUERIES

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_runs(w, min_length=6, min_exponent=4):
    """Every maximal stretch of every period, kept where that period is its smallest."""
    n, found = len(w), []
    ids = np.unique(np.array(w, dtype=object), return_inverse=True)[1] if n else np.zeros(0)
    for q in range(1, n // min_exponent + 1):
        same = np.concatenate([[0], (ids[q:] == ids[:-q]).astype(int), [0]])
        for a, b in zip(np.flatnonzero(np.diff(same) == 1), np.flatnonzero(np.diff(same) == -1)):
            a, length = int(a), int(b - a) + q
            part = ids[a : a + length]
            if length >= max(min_length, min_exponent * q) and not any(
                    (part[d:] == part[:-d]).all() for d in range(1, q)):
                found.append((a, length, q))
    return sorted(found, key=lambda r: (r[0], r[2]))


def kept(w, runs):
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    return " ".join(x for i, x in enumerate(w) if i not in gone)


def looped(doc_id, w):
    h = zlib.crc32(str(doc_id).encode())
    if doc_id is None or h % 10 or not w:
        return w
    n, g = len(w), h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]


def brute(rows):
    out = []
    for doc_id, text in rows:
        w = looped(doc_id, WORD.findall(text or ""))
        runs = brute_runs(w)
        best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
        lines = "".join(f"{s},{length},{q}\n" for s, length, q in runs)
        out.append((doc_id, len(runs), *(best or (None,) * 3),
                    best and 1000 * best[1] // best[2],
                    hashlib.sha256(lines.encode()).hexdigest(),
                    hashlib.sha256(kept(w, runs).encode()).hexdigest()))
    return sorted(out, key=repr)


def found(docs):
    made = docs.select("doc_id", periods.looped(F.col("doc_id"), F.col("text")).alias("text"))
    return sorted(map(tuple, periods.digest(periods.detect(made)).collect()), key=repr)


def texts(seed, n):
    rng = random.Random(seed)
    for i in range(n):
        w = []
        for _ in range(rng.randrange(5)):
            unit = [rng.choice("abc" if i % 2 else "abcdefgh") for _ in range(rng.randrange(1, 9))]
            w += unit * rng.randrange(1, 9) + unit[: rng.randrange(len(unit) + 1)]
        yield rng.choice([" ", "\n", " \t "]).join(w)


def test_equals_brute_force(spark):
    rows = list(enumerate(texts(1, 400)))
    rows += [(None, "a b " * 9), (None, None), (900, None), (901, ""), (902, " \n "), (903, "x"),
             (904, "same " * 3000), (905, "é 日本 " * 700 + "é"), (905, "é 日本 " * 700 + "é"),
             (906, "y" * 300_000), (907, " ".join(map(str, range(5000))) + " z" * 6)]
    # Thue-Morse has no run; a Fibonacci word has many of exponent under four.
    fib = ["a", "ab"]
    while len(fib[-1]) < 600:
        fib.append(fib[-1] + fib[-2])
    rows += [(908, " ".join(fib[-1])), (909, " ".join("ab"[bin(i).count("1") % 2]
                                                       for i in range(512)))]
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows],
                                 "doc_id bigint, text string, runs string, doc int")
    assert found(docs) == brute(rows)


@pytest.mark.parametrize("length, exponent", [(2, 2), (4, 2), (9, 3), (1, 5)])
def test_other_limits(spark, length, exponent):
    rows = list(enumerate(texts(length, 120)))
    docs = spark.createDataFrame(rows, "`a.b` bigint, text string")
    got = periods.detect(docs, ["a.b"], length, exponent).collect()
    for row in got:
        w = WORD.findall(rows[row.doc["a.b"]][1])
        expected = brute_runs(w, length, exponent)
        assert list(map(tuple, row.runs)) == expected
        assert row.collapsed == kept(w, expected) and row.n_words == len(w)
    assert len(got) == len(rows)


def test_long_periodic_text_in_bounded_time(spark):
    text = "a b c " * 100_000
    row = periods.detect(spark.createDataFrame([(1, text)], "doc_id bigint, text string")).first()
    assert list(map(tuple, row.runs)) == [(0, 300_000, 3)] and row.collapsed == "a b c"


def test_empty_table(spark):
    assert found(spark.createDataFrame([], "doc_id bigint, text string")) == []


def test_query_over_the_whole_table(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(d.doc_id, d.text) for d in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = sorted(map(tuple, QUERIES["op13_periods"](spark, sf).collect()), key=repr)
    assert got == brute(rows)
