import random
import time

from pyspark.sql import functions as F

from hearsay.normalize import bili as B
from hearsay.operators import chains as K

SCHEMA = "k string, cursor string, nxt string, body string, ended boolean, gone boolean"


def walked(pages):
    """(k, cursor, page_no) by following the cursors one by one."""
    out = []
    for k in {p[0] for p in pages if p[0] is not None}:
        nodes = {}
        for _, cursor, nxt, _, ended, gone in (p for p in pages if p[0] == k):
            if gone:
                continue
            nxt = None if ended or not nxt else nxt
            at = cursor or ""
            old = nodes.get(at, nxt)
            nodes[at] = min((x for x in (old, nxt) if x is not None), default=None)
        at, n, seen = "", 0, set()
        while at in nodes and at not in seen:
            n += 1
            seen.add(at)
            out.append((k, at, n))
            at = nodes[at]
    return sorted(out)


def ranked(spark, pages):
    df = spark.createDataFrame(pages, SCHEMA)
    got = K.pages_by_cursor(df, ["k"], "cursor", F.col("nxt"), F.col("gone"), F.col("ended"))
    assert got.columns == [*df.columns, "page_no"]
    return sorted({(r.k, r.cursor or "", r.page_no) for r in got.collect()})


def test_random_chains_with_breaks_and_cycles(spark):
    rng = random.Random(5)
    pages = []
    for k in range(40):
        n = rng.randrange(1, 30)
        names = ["" if rng.random() < 0.5 else None, *(f"c{rng.randrange(10**6)}" for _ in range(n))]
        for i, name in enumerate(names):
            nxt = names[i + 1] if i < n else rng.choice([None, "", "lost", names[n // 2]])
            if rng.random() < 0.04:
                nxt = rng.choice(["lost", names[rng.randrange(1, n + 1)]])
            pages.append((f"k{k}", name, nxt, "b", rng.random() < 0.02, rng.random() < 0.02))
    pages += [rng.choice(pages) for _ in range(30)]
    pages += [(None, "", "x", "b", False, False), ("other", "x", "y", "b", False, False),
              ("self", "", "a", "b", None, None), ("self", "a", "a", "b", None, None)]
    rng.shuffle(pages)
    assert ranked(spark, pages) == walked(pages)


def test_no_pages(spark):
    assert ranked(spark, []) == []


def test_one_chain_of_a_hundred_thousand_pages(spark):
    n = 100_000
    pages = spark.range(n).select(
        F.lit("k").alias("k"), F.when(F.col("id") > 0, F.md5(F.col("id").cast("string"))).alias(
            "cursor"), F.md5((F.col("id") + 1).cast("string")).alias("nxt"),
        F.col("id").alias("place")).repartition(8, "cursor")
    start = time.time()
    got = K.pages_by_cursor(pages, ["k"], "cursor", F.col("nxt"))
    assert got.where(F.col("place") + 1 == F.col("page_no")).count() == n == got.count()
    assert time.time() - start < 180


def test_feed_stops_where_it_says_so(spark):
    body = '{"data": {"has_more": %s, "offset": "%s", "items": [{"id_str": "%s"}]}}'
    pages = spark.createDataFrame(
        [(1, "b", body % ("false", "c", 2)), (1, None, body % ("true", "b", 1)),
         (1, "c", body % ("true", "d", 3)), (2, None, "no json")],
        "mid bigint, cursor string, body string")
    got = B.feed_pages(pages).select("mid", "page_no", "cursor").collect()
    assert sorted(map(tuple, got)) == [(1, 1, None), (1, 2, "b")]
