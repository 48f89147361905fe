import zlib

import numpy as np
import pytest
from test_packing import TEXTS

from llm import packing, training_order as to
from llm.queries import QUERIES

MASK = (1 << 64) - 1


def mix(h):
    h ^= h >> 32
    h = h * 0xC2B2AE3D27D4EB4F & MASK
    h ^= h >> 29
    h = h * 0xD6E8FEB86659FD93 & MASK
    return h ^ h >> 32


def slow_permute(x, n, key):
    half = max(1, (max(1, n - 1).bit_length() + 1) // 2)
    mask = (1 << half) - 1
    while True:
        left, right = x >> half, x & mask
        for r in range(1, to.ROUNDS + 1):
            k = mix((r * 0x9E3779B97F4A7C15 + key) & MASK)
            left, right = right, left ^ (mix((right + k) & MASK) & mask)
        x = left << half | right
        if x < n:
            return x


@pytest.mark.parametrize("n", [1, 2, 3, 17, 1000, 4097])
def test_permutation(n):
    got = to.permute(np.arange(n), n, 99)
    assert sorted(got) == list(range(n))
    assert got.tolist() == [slow_permute(i, n, 99) for i in range(n)]
    if n > 100:
        assert abs(np.corrcoef(got, np.arange(n))[0, 1]) < 0.1
        assert (got != to.permute(np.arange(n), n, 98)).any()


def ids_of(texts):
    import public_tokenizers
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(str(public_tokenizers.path(packing.TOKENIZER)))
    return [tok.encode(t or "", add_special_tokens=False).ids + [0] for t in texts]


def check(rows, docs, stride, shard_rows):
    """Every sequence of every document once, in a slot of its own."""
    assert sorted(r.slot for r in rows) == list(range(len(rows)))
    want, got = [], []
    for (i, _), ids in zip(docs, ids_of([t for _, t in docs])):
        want += [(i, p, ids[a : a + stride]) for p, a in enumerate(range(0, len(ids), stride))]
    for r in rows:
        assert (r.shard, r.position) == divmod(r.slot, shard_rows)
        ids = np.frombuffer(r.record, to.TYPE)
        assert len(ids) == stride and not ids[r.length :].any()
        assert zlib.crc32(ids[: r.length].tobytes()) == r.ids_crc32
        got.append((r.doc_id, r.piece, ids[: r.length].tolist()))
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_round_trip_through_the_shards(spark, tmp_path):
    docs = [(i, t) for i, t in enumerate(TEXTS)] + [(None, "no id"), (3, "one")]
    frame = spark.createDataFrame([(i, t, 5, b"x") for i, t in docs],
                                  "doc_id bigint, text string, slot int, record binary")
    out = to.materialise(frame, stride=16, shard_rows=64)
    rows = out.collect()
    check(rows, docs, 16, 64)
    folder = f"file://{tmp_path}/shards"
    manifest = to.write_shards(out, folder).collect()
    again = to.write_shards(out, folder).collect()  # a repeated task changes nothing
    assert sorted(manifest) == sorted(again)
    assert sum(r.rows for r in manifest) == len(rows)
    assert len(list((tmp_path / "shards").iterdir())) == len(manifest)
    want = {r.slot: bytes(r.record) for r in rows}
    for first in (0, 1, 63, 64, 100, len(rows) - 1):
        read = list(to.read_slots(folder, first, len(rows) - first, 16, 64))
        assert [x.tobytes() for x in read] == [want[s] for s in range(first, len(rows))]


def test_empty_table(spark):
    empty = spark.createDataFrame([], "doc_id bigint, text string")
    assert to.materialise(empty).count() == 0


def test_query_over_the_whole_table(spark):
    sf = "/root/testdata/sf0.001"
    docs = [(d.doc_id, d.text) for d in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    check(QUERIES["op3_training_order"](spark, sf).collect(), docs, to.STRIDE, to.SHARD_ROWS)


def test_shards_are_written_and_slots_do_not_follow_the_input_splits(spark, tmp_path):
    docs = [(i, t) for i, t in enumerate(TEXTS)] + [(None, "no id"), (3, "one"), (3, "one")]
    frame = spark.createDataFrame(docs, "doc_id bigint, text string")
    folder = f"file://{tmp_path}/out"
    rows = to.shards(frame.repartition(5), 16, 64, folder=folder).collect()
    check(rows, docs, 16, 64)
    read = list(to.read_slots(folder, 0, len(rows), 16, 64))
    assert [x.tobytes() for x in read] == [bytes(r.record) for r in sorted(rows)]
    other = to.shards(frame.coalesce(1), 16, 64).collect()
    assert sorted(rows) == sorted(other)
    parts = to.materialise(frame, 16, 64).rdd.mapPartitions(
        lambda p: [[r.slot for r in p]]).collect()
    assert sum(parts, []) == list(range(len(rows)))  # slot order over all partitions


def test_shards_of_several_passes(spark, tmp_path, monkeypatch):
    """Each pass writes whole shards of its own and moves no other record; the stored sequences
    are gone afterwards."""
    docs = [(i, t) for i, t in enumerate(TEXTS)] + [(None, "no id"), (3, "one"), (3, "one")]
    frame = spark.createDataFrame(docs, "doc_id bigint, text string")
    seen, records, dropped, drop = [], to._records, [], to.drop
    monkeypatch.setattr(to, "_records", lambda *a: seen.append((*a[-2:], records(*a))) or seen[-1][2])
    monkeypatch.setattr(to, "drop", lambda t: dropped.append(
        [f.count() for _, _, f in seen]) or drop(t))
    rows = to.shards(frame, 16, 8, folder=f"file://{tmp_path}/out").collect()
    check(rows, docs, 16, 8)
    shards = -(-len(rows) // 8)
    assert len(seen) == min(to.PASSES, shards) > 1 and seen[0][0] == 0 and seen[-1][1] == shards
    assert all(a[1] == b[0] for a, b in zip(seen, seen[1:]))
    assert dropped == [[sum(a <= r.shard < b for r in rows) for a, b, _ in seen]]
    assert len(list((tmp_path / "out").iterdir())) == shards
    whole = to.materialise(frame, 16, 8).collect()
    assert sorted(rows) == sorted(whole)
