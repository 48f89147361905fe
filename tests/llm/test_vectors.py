import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from llm import lattice, search
from llm.queries import QUERIES

SF = "/root/testdata/sf0.01"
BAD = [None, [0.0] * 6, [1.0, None, 0.0, 0.0, 0.0, 0.0], [float("nan")] * 6,
       [float("inf"), 0.0, 0.0, 0.0, 0.0, 0.0], []]


def usable(v):
    return bool(v) and None not in v and np.isfinite(v).all() and np.any(v)


def clustered(seed, n, dim=6):
    rng = np.random.default_rng(seed)
    centers = rng.normal(size=(12, dim))
    rows = [(i, (centers[rng.integers(12)] + rng.normal(0, 0.15, dim)).tolist())
            for i in range(n)]
    rows += [(n + i, v) for i, v in enumerate(BAD)] + [(None, rows[0][1])]
    rows += [(n + 20 + i, rows[5][1]) for i in range(30)]
    rows += [(n + 60, [1.0, 2.0]), (n + 61, [1.0, 2.0]), (n + 62, (3 * np.array(rows[5][1])).tolist())]
    return rows


def brute_links(rows):
    links, reach = {}, {}
    good = [(i, np.array(v)) for i, v in rows if i is not None and usable(v)]
    near = {i: [j for j, w in good if j != i and len(w) == len(v)
                and v @ w / np.sqrt((v @ v) * (w @ w)) >= 0.95] for i, v in good}
    for i, v in rows:
        if i not in near:
            links[i], reach[i] = 0, i
            continue
        links[i], seen, todo = len(near[i]), {i}, [i]
        while todo:
            for j in near[todo.pop()]:
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        reach[i] = min(seen)
    return {i: (links[i], reach[i], reach[i] == i) for i in links if i is not None}


@pytest.mark.parametrize("block", [512, 5])
def test_lattice_equals_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(lattice, "CELL_BLOCK", block)
    monkeypatch.setattr(lattice, "GROUP_BLOCK", block)
    rows = clustered(block, 250)
    docs = spark.createDataFrame([(i, v, 1, "n") for i, v in rows],
                                 "vec_id bigint, embedding array<double>, n int, node string")
    out = lattice.near_dups(docs).collect()
    assert len(out) == len(rows)
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in out if r.vec_id is not None}
    assert got == brute_links(rows)
    assert lattice.near_dups(docs.limit(0)).count() == 0


def test_lattice_query_over_the_whole_table(spark):
    v = spark.read.parquet(f"{SF}/embeddings.parquet").collect()
    got = {r.vec_id: (r.n_links, r.component_id, r.kept)
           for r in QUERIES["op4_lattice"](spark, SF).collect()}
    assert got == brute_links([(r.vec_id, r.embedding) for r in v])


def test_decoding_finds_the_nearest_lattice_point():
    rng = np.random.default_rng(0)
    y = rng.normal(0, 2, (300, 8))
    x = lattice.decode(y)
    doubled = np.rint(2 * x).astype(int)
    assert ((doubled % 2 == doubled[:, :1] % 2).all(1)).all()
    assert (np.rint(x.sum(1)) % 2 == 0).all() and np.allclose(doubled, 2 * x)
    best = np.square(y - x).sum(1)
    for step in lattice._STEPS:
        assert (np.square(y - x - step).sum(1) >= best - 1e-9).all()
    assert (np.square(lattice._STEPS).sum(1) == 2).all() and len(lattice._STEPS) == 240


def test_near_vectors_meet_and_others_do_not():
    rng = np.random.default_rng(2)
    x, z = rng.normal(size=(2, 1500, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    z -= (z * x).sum(1)[:, None] * x
    y = 0.95 * x + np.sqrt(1 - 0.95**2) * z / np.linalg.norm(z, axis=1)[:, None]
    a, b = lattice.cells(x), lattice.cells(y)
    met = [bool(set(p) & set(q)) for p, q in zip(a.tolist(), b.tolist())]
    assert np.mean(met) > 0.995
    apart = [bool(set(p) & set(q)) for p, q in zip(a.tolist(), np.roll(b, 1, 0).tolist())]
    assert np.mean(apart) < 0.05


def brute_search(rows, k, step):
    out = {}
    good = [(i, np.array(v)) for i, v in rows if i is not None and usable(v) and len(v) > 2]
    for q, v in good:
        if q % step == 0:
            best = sorted((-(v @ w), i) for i, w in good if i != q)[:k]
            out[q] = [(i, -s) for s, i in best]
    return out


def recall(rows, got, k, step):
    want = brute_search(rows, k, step)
    assert set(got) == set(want)
    hit = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want)
    values = {i: np.array(v) for i, v in rows if i is not None and v}
    for q, found in got.items():
        assert len(found) == len(want[q])
        assert found == sorted(found, key=lambda r: (-r[1], r[0]))
        assert all(abs(s - values[q] @ values[i]) < 1e-9 for i, s in found)
    return hit / max(1, sum(map(len, want.values())))


def answers(frame):
    got = {}
    for r in sorted(frame.collect(), key=lambda r: (r["query_id"], r["rank"])):
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
        assert r["rank"] == len(got[r["query_id"]])
    return got


@pytest.mark.parametrize("slice_rows", [4000, 30])
def test_search_recall_with_bad_rows(spark, monkeypatch, slice_rows):
    monkeypatch.setattr(search, "SLICE_ROWS", slice_rows)
    monkeypatch.setattr(search, "SAMPLE", 200)
    rows = clustered(8, 900)
    docs = spark.createDataFrame([(i, v, 1) for i, v in rows],
                                 "vec_id bigint, embedding array<double>, rank int")
    got = answers(search.nearest(docs))
    assert recall(rows, got, 20, 20) >= 0.9
    few = spark.createDataFrame([(r[0], r[1]) for r in rows[:3]],
                                "vec_id bigint, embedding array<double>")
    assert recall(rows[:3], answers(search.nearest(few)), 20, 20) == 1
    assert search.nearest(docs.limit(0)).count() == 0


def test_search_query_over_the_whole_table(spark):
    rows = [(r.vec_id, list(map(float, r.embedding)))
            for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    assert recall(rows, answers(QUERIES["op7_search"](spark, SF)), 20, 20) >= 0.9


def test_scan_abandons_few_of_the_near_ones():
    rng = np.random.default_rng(4)
    x, q = rng.normal(size=(3000, 64)), rng.normal(size=(20, 64))
    d = np.square(q[:, None] - x[None]).sum(2)
    limit = np.sort(d, 1)[:, 30]
    i, j = search.scan(q, x, limit)
    assert (d[i, j] <= limit[i] * (1 + 1e-9) + 1e-9).all()
    assert len(i) >= 0.97 * 20 * 31


def test_scan_makes_no_rows_of_pairs_while_most_are_left():
    rng = np.random.default_rng(5)
    x, q = rng.normal(size=(4000, 65)), rng.normal(size=(64, 65))
    d = np.square(q[:, None] - x[None]).sum(2)
    limit = np.sort(d, 1)[:, 20]
    limit[3] = np.inf
    tracemalloc.start()
    i, j = search.scan(q, x, limit)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 60 * d.size
    assert (d[i, j] <= limit[i] * (1 + 1e-9) + 1e-9).all() and (i == 3).sum() == len(x)
    assert len(i) >= len(x) + 0.97 * 63 * 21


@pytest.mark.parametrize("repeat", ["equal", "different"])
@pytest.mark.parametrize("sample", [4000, 60])
def test_search_with_one_id_in_a_hundred_rows(spark, monkeypatch, repeat, sample):
    """An id of many rows takes one place, as a candidate and beside its own query."""
    monkeypatch.setattr(search, "SAMPLE", sample)
    rng = np.random.default_rng(6)
    rows = [(i, (np.ones(6) + rng.normal(0, 0.2, 6)).tolist()) for i in range(200)]
    long = 3 * np.ones(6)
    for i in (401, 420):  # 420 asks as well
        rows += [(i, (long + (0 if repeat == "equal" else rng.normal(0, 0.01, 6))).tolist())
                 for _ in range(100)]
    docs = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    got = answers(search.nearest(docs, probes=1.0))
    values = {}
    for i, v in rows:
        values.setdefault(i, []).append(np.array(v))
    assert set(got) == {i for i in values if i % 20 == 0}
    hit = 0
    for q, found in got.items():
        score = {i: max(float(a @ b) for a in values[q] for b in w)
                 for i, w in values.items() if i != q}
        want = sorted(score, key=lambda i: (-score[i], i))[:20]
        assert len({i for i, _ in found}) == len(found) == 20
        assert all(abs(s - score[i]) < 1e-9 for i, s in found)
        hit += len({i for i, _ in found} & set(want))
    assert hit >= 0.95 * 20 * len(got)


def test_queries_of_a_list_stream_past_its_candidates():
    """A task answers each batch of queries before it reads the next, across batch borders."""
    rng = np.random.default_rng(9)
    v = rng.normal(size=(60, 8))
    index = search.Index(v, float(np.sqrt(np.square(v).sum(1)).max()), 60)
    read = []

    def batches():
        parts = [(0, 0, 30), (0, 30, 60)] + [(1, a, a + 5) for a in range(0, 60, 5)]
        for group in (0, 1):  # the second list holds every vector again
            for query, a, b in parts:
                read.append(query)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(b - a, group, np.int32)),
                     pa.array(np.zeros(b - a, np.int32)), pa.array(np.full(b - a, bool(query))),
                     pa.array(np.arange(a, b)), pa.array(v[a:b].tolist())],
                    ["list", "slice", "query", "vec_id", "v"])

    out = []
    for batch in search.in_lists(batches(), index, 3):
        out.append(batch)
        assert sum(read) == len(out)
    assert len(out) == 24
    for half in (out[:12], out[12:]):
        got = pa.Table.from_batches(half).to_pydict()
        for q in range(60):
            want = sorted((-(v[q] @ v[i]), i) for i in range(60) if i != q)[:3]
            assert [i for a, i in zip(got["query_id"], got["vec_id"]) if a == q] == [
                i for _, i in want]
