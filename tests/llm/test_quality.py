import zlib

import numpy as np

from llm import quality, words
from llm.queries import QUERIES

SF = "/root/testdata/sf0.01"


def test_word_vectors_equal_a_plain_sum(spark):
    texts = ["a b c a", None, "", "B b  b", "x1 %%% é!", "one"]
    docs = spark.createDataFrame([(t,) for t in texts], "text string")
    index = quality._index_vectors().astype(int)
    total = np.zeros(index.shape)
    import pyarrow as pa
    for text in texts:
        for c in words.chunks(pa.array([text])):
            word, shape, _ = quality._tokens(c)
            for i in range(len(word)):
                for j in range(max(0, i - quality.REACH), min(len(word), i + quality.REACH + 1)):
                    if i != j:
                        for token in (word[i], shape[i]):
                            total[token] += index[word[j]] + index[shape[j]]
    got = quality.word_vectors(docs)
    want = np.zeros_like(total)
    for part in (slice(0, quality.WORDS), slice(quality.WORDS, None)):
        v = total[part]
        some = v.any(1)
        v[some] /= np.linalg.norm(v[some], axis=1, keepdims=True)
        v[some] -= v[some].mean(0)
        want[part][some] = v[some] / np.maximum(1e-9, np.linalg.norm(v[some], axis=1))[:, None]
    assert np.allclose(got, want, atol=1e-5)


def test_temperature_calibrates():
    rng = np.random.default_rng(1)
    z = rng.normal(0, 2, 20000)
    y = rng.random(20000) < 1 / (1 + np.exp(-z))
    assert abs(quality.temperature(3 * z, y) - 3) < 0.3


def test_held_out_accuracy_over_the_whole_table(spark):
    got = QUERIES["op6_quality"](spark, SF).toPandas()
    assert len(got) == spark.read.parquet(f"{SF}/documents.parquet").count()
    assert (got.held_out == [zlib.crc32(str(i).encode()) % 5 == 0 for i in got.doc_id]).all()
    assert got.score.between(0, 1).all() and (got.predicted == (got.score >= 0.3)).all()
    labels = spark.read.parquet(f"{SF}/labels.parquet").toPandas()
    known = got.merge(labels, on="doc_id")
    known = known[known.held_out]
    assert (known.predicted == known.quality).mean() >= 0.95


def test_edge_rows(spark):
    rows = [(i, "the cat sat on a mat near the door" if i % 2 else "cat!! cat!! CAT!! %%% ###", i)
            for i in range(40)]
    rows += [(None, None, 1), (100, "", 1), (100, "", 1), (101, " \t", 1), (102, "z" * 90_000, 1),
             (103, "the cat " * 20_000, 1)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, score int")
    labels = spark.createDataFrame(
        [(i, i % 2, 0) for i in range(40)] + [(None, 1, 1), (3, None, 0), (777, 0, 0)],
        "doc_id bigint, quality int, toxic int")
    model = quality.fit(docs, labels)
    got = quality.score(docs, model).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    good = [r.score for r in got if r.doc_id is not None and r.doc_id < 40]
    assert all((s >= 0.3) == bool(r.doc_id % 2) for s, r in zip(good, got))
    assert quality.fit(docs, labels.limit(0)) is None
    assert {r.score for r in quality.score(docs, None).collect()} == {1.0}
    assert quality.score(docs.limit(0), model).count() == 0
    assert quality.fit(docs.limit(0), labels) is None


def test_an_id_of_many_rows_trains_once(spark, monkeypatch):
    """The bound holds for rows, not only for ids, and reruns agree."""
    rows = [(i, ("the cat sat on a mat " if i % 2 else "%%% ### !! ") + str(i)) for i in range(60)]
    rows += [(7, f"the dog number {k} sat") for k in range(5000)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id bigint, quality int")
    seen, train = [], quality.train
    monkeypatch.setattr(quality, "train", lambda x, y: seen.append(len(x)) or train(x, y))
    a = quality.fit(docs, labels)
    b = quality.fit(docs.repartition(3), labels)
    assert seen[0] <= 60 and seen[0] == seen[1]
    assert all(np.allclose(p, q) for p, q in zip(a.layers, b.layers))


def test_every_shape_has_a_vector(spark):
    import pyarrow as pa
    text = " ".join(("A" * n + "b" * m + "9" * d + "%" * s) for n in range(3) for m in range(9)
                    for d in range(2) for s in range(4) if n + m + d + s)
    (c,) = words.chunks(pa.array([text]))
    _, shape, _ = quality._tokens(c)
    assert quality.WORDS <= shape.min() and shape.max() < quality.WORDS + quality.SHAPES
    mixed = quality._tokens(next(words.chunks(pa.array(["McDonald mcdonald"]))))[1]
    assert mixed[0] != mixed[1]


def test_sums_around_words_by_token():
    """Rows beside each other in a text only, and tokens met more often than a run is long."""
    rng = np.random.default_rng(2)
    first = np.array([0, 0, 1, 3, 3, 2000, 2004])
    own = rng.integers(-2, 3, (2004, quality.DIM)).astype(np.int8)
    own[3:1500] = -2
    want = np.zeros(own.shape, int)
    for a, b in zip(first[:-1], first[1:]):
        for i in range(a, b):
            for j in range(max(a, i - quality.REACH), min(b, i + quality.REACH + 1)):
                want[i] += own[j].astype(int) * (i != j)
    got = quality._around(own, first)
    assert got.dtype == np.int8 and (got == want).all()
    token = rng.integers(0, 4, len(own)) * 2000
    token[3:1200] = 7
    total = np.ones((quality.WORDS + quality.SHAPES, quality.DIM), np.int64)
    plain = total.copy()
    np.add.at(plain, token, want)
    quality._add_by_token(total, token, got)
    assert (total == plain).all()


def test_repeated_words_differ_by_case_and_text():
    import pyarrow as pa
    (c,) = words.chunks(pa.array(["b b B B", "B", "", "é é É"]))
    shape = quality._tokens(c)[1] - quality.WORDS
    assert ((shape // 4) % 2).tolist() == [0, 1, 0, 1, 0, 0, 1, 0]
