import zlib

import numpy as np
from pyspark.sql import functions as F

from llm import toxicity
from llm.queries import QUERIES

SF = "/root/testdata/sf0.01"


def test_label_model_recovers_accuracies_despite_correlated_voters():
    rng = np.random.default_rng(3)
    y = rng.random(4000) < 0.3
    fires = np.array([0.8, 0.7, 0.75, 0.6, 0.65])
    votes = np.where(y[:, None], rng.random((4000, 5)) < fires, rng.random((4000, 5)) < 0.08)
    copy = votes[:, 0] ^ (rng.random(4000) < 0.02)
    votes = np.column_stack([votes, copy])
    posterior, parent = toxicity.fit_label_model(votes, votes.sum(1) >= 2)
    assert parent[5] == 0 or parent[0] == 5
    assert ((posterior > 0.5) == y).mean() > 0.93


def test_linear_classifier_separates():
    rng = np.random.default_rng(5)
    x = (rng.random((600, 8)) < 0.3).astype(np.float32)
    w, b = toxicity.fit_linear(x, x[:, 2].astype(float))
    assert (((x @ w + b) > 0) == (x[:, 2] > 0)).all()


def test_learns_only_from_its_rows_and_scores_the_rest(spark):
    got = QUERIES["op1_toxicity"](spark, SF).toPandas()
    assert len(got) == spark.read.parquet(f"{SF}/documents.parquet").count()
    assert (got.held_out == [zlib.crc32(str(i).encode()) % 3 == 1 for i in got.doc_id]).all()
    assert got.score.between(0, 1).all()
    assert (got.predicted == (got.score >= 0.7)).all()
    labels = spark.read.parquet(f"{SF}/labels.parquet").toPandas()
    known = got.merge(labels, on="doc_id")
    known = known[known.held_out]
    assert (known.predicted == known.toxic).mean() >= 0.9
    assert not ((known.predicted == 1) & (known.toxic == 0)).any()


def test_edge_rows(spark):
    words = ["alpha", "beta", "gamma", "delta", "omega"]
    rows = [(i, " ".join(words[(i + k) % 5] + str(i * 7 + k) for k in range(30))
             + (" scum" if i % 3 == 0 else ""), 1.0) for i in range(90)]
    labels = [(i, 1, int(i % 3 == 0)) for i in range(90)] + [(None, 1, 1), (5, 1, None)]
    rows += [(None, None, 0.5), (1000, "", 0.5), (1001, "S c u m", 0.5), (1001, "SCUM!", 0.5),
             (1002, "scum " * 20000, 0.5), (1003, "x" * 100_000, 0.5)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, score double")
    label = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    scored = toxicity.score(docs, toxicity.fit(docs, label)).collect()
    assert len(scored) == len(rows)
    new = {(r.doc_id, round(r.score, 9)): r.score for r in scored if (r.doc_id or 0) >= 1000}
    assert all(r.held_out is False for r in scored if r.doc_id is None)
    assert sorted(v >= 0.7 for k, v in new.items() if k[0] == 1001) == [False, True]
    assert max(v for k, v in new.items() if k[0] == 1002) >= 0.7
    assert max(v for k, v in new.items() if k[0] in (1000, 1003)) < 0.7
    kept = toxicity.reject(docs, label)
    assert kept.columns == docs.columns
    assert {1000, 1003} <= {r.doc_id for r in kept.collect()}
    none = toxicity.fit(docs, label.limit(0))
    assert none is None
    assert {r.score for r in toxicity.score(docs, none).collect()} == {0.0}
    assert toxicity.score(docs.limit(0), None).count() == 0


def test_held_out_labels_change_nothing(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1
    flipped = labels.withColumn("toxic", F.when(out, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = toxicity.fit(docs, labels), toxicity.fit(docs, flipped)
    assert (a is None and b is None) or np.allclose(a.weights, b.weights)


def _precision_and_recall(spark, docs):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    got = toxicity.score(docs, toxicity.fit(docs, labels)).toPandas()
    known = got.merge(labels.toPandas(), on="doc_id")
    known = known[known.held_out]
    hit = ((known.score >= toxicity.THRESHOLD) & (known.toxic == 1)).sum()
    return hit / max(1, (known.score >= toxicity.THRESHOLD).sum()), hit / known.toxic.sum()


def test_a_header_that_all_texts_share_merges_none(spark):
    """Texts are told apart by all their words."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    header = " ".join(f"h{k}" for k in range(400))
    plain = _precision_and_recall(spark, docs)
    headed = _precision_and_recall(spark, docs.withColumn("text", F.concat(F.lit(header + " "), "text")))
    assert plain[0] >= 0.9 and headed[0] >= 0.9
    assert plain[1] >= 0.5 and headed[1] >= plain[1] - 0.12


def test_an_id_of_many_rows_counts_once_and_reruns_agree(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    one = docs.where("crc32(cast(cast(doc_id as string) as binary)) % 3 <> 1").orderBy("doc_id").first()
    many = docs.union(spark.range(3000).select(
        F.lit(one.doc_id), F.concat(F.lit("again "), F.col("id").cast("string"))))
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    a = toxicity.fit(many, labels)
    b = toxicity.fit(many.repartition(7), labels)
    assert np.array_equal(a.terms, b.terms) and np.allclose(a.weights, b.weights)
