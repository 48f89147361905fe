import itertools
import random

from pyspark.sql import functions as F

from hearsay.operators import coverage as C

LINKS = "keyword string, post_id string, fetched_at bigint"
DAY = 86400


def estimates(df, *by):
    return sorted((tuple(r) for r in C.coverage(df, by).collect()), key=repr)


def test_small_sets_are_exact_whatever_the_batches(spark, tmp_path):
    rng = random.Random(1)
    data = [(rng.choice(["a", "b", None]), rng.choice([None, *map(str, range(300))]),
             rng.choice([5, DAY + 5, 2 * DAY])) for _ in range(4000)]
    for batch in (0, 1, 2, 0, 2):
        C.store_sketches(spark.createDataFrame(data[batch::3], LINKS), str(tmp_path), batch)
    stored = C.stored_sketches(spark, str(tmp_path))

    def exact(key, rows=data):
        sets = {}
        for r in rows:
            sets.setdefault(key(r), set()).update([r[1]] if r[1] else [])
        return sorted(((*k, len(v)) for k, v in sets.items()), key=repr)

    assert estimates(stored, "keyword") == exact(lambda r: (r[0],))
    assert estimates(stored) == exact(lambda r: ())
    first = [r for r in data if r[2] < 2 * DAY]
    got = C.coverage(stored, ["keyword"], "1970-01-01", "1970-01-02").collect()
    assert sorted(map(tuple, got), key=repr) == exact(lambda r: (r[0],), first)
    both = {r[1] for r in data if r[0] == "a"} & {r[1] for r in data if r[0] == "b"} - {None}
    assert C.shared_coverage(stored, "a", "b").first()[0] == len(both)
    assert C.shared_coverage(stored, "a", "none").first()[0] == 0


def test_large_sets_keep_the_stated_error_in_any_order(spark):
    n = 60_000
    parts = [spark.range(lo, lo + n).select(
        F.lit("k").alias("keyword"), F.col("id").cast("string").alias("post_id"),
        F.lit(DAY * i).cast("bigint").alias("fetched_at"))
        for i, lo in enumerate((0, n // 2, 5 * n))]
    made = [C.coverage_sketches(p.repartition(2 + i)).cache() for i, p in enumerate(parts)]
    found = {estimates(C.merge_sketches(*order), "keyword")[0][1]
             for order in itertools.permutations(made)}
    found.add(estimates(C.merge_sketches(C.merge_sketches(*made[:2]), made[2], made[0]),
                        "keyword")[0][1])
    assert len(found) == 1
    true = n + n // 2 + n
    assert 0 < abs(found.pop() - true) <= C.stated_error() * true
    size = made[0].select(F.length("posts")).first()[0]
    assert size <= 8 * (1 << C.LG_ENTRIES) + 64
    for m in made:
        m.unpersist()


def test_no_links(spark):
    made = C.coverage_sketches(spark.createDataFrame([], LINKS))
    assert estimates(made, "keyword") == []
    assert estimates(made) == [(0,)]
