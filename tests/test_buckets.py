import os

import pytest
from pyspark.sql import functions as F

from hearsay.sources import buckets as B

SCHEMA = "id bigint, v string, fetched_at bigint"


def files(root):
    return {os.path.join(d, n): os.stat(os.path.join(d, n)).st_mtime_ns
            for d, _, names in os.walk(f"{root}/data") for n in names if n.endswith(".parquet")}


@pytest.fixture
def root(spark, tmp_path):
    rows = spark.range(200).select("id", F.lit("old").alias("v"), F.col("id").alias("fetched_at"))
    B.create(rows, str(tmp_path), ["id"], 16)
    return str(tmp_path)


def updates(spark, *rows):
    return spark.createDataFrame(rows, "id int, v string, fetched_at bigint, seq bigint")


def changed(spark, root, **at):
    return sorted(tuple(r) for r in B.read(spark, root, **at).where("v <> 'old' or v is null").collect())


def test_untouched_files_stay(spark, root):
    before = files(root)
    B.merge(spark, root, updates(spark, (7, "a", 1, 1), (7, "b", 2, 2), (900, "n", 3, 1)), "seq")
    after = files(root)
    assert {f: t for f, t in after.items() if f in before} == before
    touched = {r[0] for r in spark.createDataFrame([(7,), (900,)], "id bigint").select(
        B.bucket_of(["id"], 16)).collect()}
    assert {int(f.split("bucket=")[1].split("/")[0]) for f in set(after) - set(before)} == touched
    assert changed(spark, root) == [(7, "b", 7), (900, "n", 3)]
    assert B.read(spark, root).count() == 201
    # Only the files of the new version's buckets are read.
    assert len(B.read(spark, root).inputFiles()) == 16


def test_merging_again_changes_nothing(spark, root):
    upd = updates(spark, (7, "a", 1, 1), (201, None, 5, 1))
    B.merge(spark, root, upd, "seq")
    once = changed(spark, root)
    assert B.merge(spark, root, upd, "seq").number == 2 and changed(spark, root) == once
    assert B.merge(spark, root, upd.limit(0), "seq").number == 2


def test_crash_between_data_and_version(spark, root, monkeypatch):
    with monkeypatch.context() as m:
        m.setattr(B, "_add_version", lambda *a: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            B.merge(spark, root, updates(spark, (7, "a", 1, 1)), "seq")
    assert B.versions(spark, root) == [0] and changed(spark, root) == []
    B.merge(spark, root, updates(spark, (7, "c", 1, 1)), "seq")
    assert changed(spark, root) == [(7, "c", 7)]
    assert B.expire(spark, root, 1) == 2  # the lost write and the bucket before
    assert changed(spark, root) == [(7, "c", 7)] and B.read(spark, root).count() == 200


def test_two_writers(spark, root):
    old = B.version(spark, root)
    B.merge(spark, root, updates(spark, (7, "a", 1, 1)), "seq")
    with pytest.raises(B.Conflict):
        B._switch(spark, root, old, B.read(spark, root, only=[3]))
    with pytest.raises(B.Conflict):
        B.create(B.read(spark, root), root, ["id"])
    assert changed(spark, root) == [(7, "a", 7)]
    assert changed(spark, root, number=0) == []


def test_first_wins_and_lookup(spark, root):
    rows = spark.createDataFrame([(7, "x", 1), (300, "z", 2), (300, "y", 1)], SCHEMA)
    B.append_new(spark, root, rows, ["fetched_at"])
    assert changed(spark, root) == [(300, "y", 1)]
    found = B.lookup(spark, root, spark.createDataFrame([(7,), (300,), (999,)], "id int"))
    assert sorted(r.id for r in found.collect()) == [7, 300] and len(found.inputFiles()) <= 3


def test_empty_table(spark, tmp_path):
    B.create(spark.createDataFrame([], SCHEMA), str(tmp_path), ["id"], 4)
    assert B.read(spark, str(tmp_path)).count() == 0
    B.merge(spark, str(tmp_path), updates(spark, (1, "a", 5, 1)), "seq")
    assert changed(spark, str(tmp_path)) == [(1, "a", 5)]
