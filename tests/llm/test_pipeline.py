import importlib
import re
import subprocess
import sys
from pathlib import Path

import corpus_pipeline
import pytest
from llm import jaccard, toxicity
from llm.shared import cut

from test_jaccard import brute as brute_classes, sets_of
from test_packing import _check_sequences, _expected
from test_repeats import brute as brute_repeats
from test_mixing import size

SF = "/root/testdata/sf0.001"
ROOT = Path(__file__).resolve().parents[2]
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        out.append(cut(stage(spark, out[-1], SF), name))
    return out


def test_stages_keep_the_columns(stages):
    for frame in stages[1:-1]:
        assert frame.dtypes == stages[0].dtypes


def test_every_stage_against_brute_force(spark, stages):
    docs, clean, unique, passed, mixed, packed = ([r for r in f.collect()] for f in stages)
    # 1: exactly the documents that the operator predicts to be toxic go.
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    scores = toxicity.score(stages[0], toxicity.fit(stages[0], labels)).collect()
    assert {d.doc_id for d in clean} == {r.doc_id for r in scores if r.score < 0.7}
    # 8: the smallest id of each class.
    want = brute_classes([(d.doc_id, d.text) for d in clean])
    assert sorted(d.doc_id for d in unique) == sorted(i for i, (c, _) in want.items() if c == i)
    assert all(sets_of(d.text) for d in unique if want[d.doc_id][1])
    # 9: the words that are left.
    expected = {i: (n, gone) for i, n, gone, _ in brute_repeats(
        [(d.doc_id, d.text) for d in unique])}
    before = {d.doc_id: d.text for d in unique}
    assert {d.doc_id for d in passed} == set(before)
    for d in passed:
        n, gone = expected[d.doc_id]
        assert size(d.text) == n - gone
        assert gone or d.text == before[d.doc_id]
    # 2: half as many words again, no document more than twice.
    total = sum(size(d.text) for d in passed)
    assert abs(sum(size(d.text) for d in mixed) - 1.5 * total) < 0.1 * total
    times = {}
    for d in mixed:
        times[d.doc_id] = times.get(d.doc_id, 0) + 1
    assert max(times.values()) <= 2 and set(times) <= set(before)
    # 10: all pieces of all documents of the mix.
    pieces = sorted((mixed[i].doc_id, *rest) for i, *rest in _expected([d.text for d in mixed]))
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in packed) == pieces
    _check_sequences(packed)


def test_planted_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    some = docs.collect()
    base = next(d.text for d in some if len(WORD.findall(d.text)) > 300)
    words = WORD.findall(base)
    toxic = spark.createDataFrame(
        [(10**6, "You stupid idiot, a worthless loser and a disgusting clown.", "en", "p", 9)],
        docs.schema)
    copies = spark.createDataFrame(
        [(10**6 + 1, base, "en", "p", 9), (10**6 + 2, " ".join(words[:-3] + ["changed"]), "en",
                                           "p", 9)], docs.schema)
    model = toxicity.fit(docs, labels)
    assert toxicity.score(toxic, model).first().score >= 0.7
    got = {r.doc_id: r for r in jaccard.join(docs.union(copies)).collect()}
    assert got[10**6 + 1].class_id == got[10**6 + 2].class_id < 10**6
    assert got[10**6 + 1].n_links >= 2


def test_the_rest_stands_alone():
    code = ("import sys\nsys.modules['llm'] = None\nimport __spark_entry__ as e\n"
            "names = e.queries()\nassert 'pipeline' not in names and len(names) > 100\n"
            "assert not any(n.startswith('op1') for n in names)\ne.oracle_sql()\n")
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True, timeout=120)
    for path in list((ROOT / "hearsay").rglob("*.py")) + list((ROOT / "catalog").rglob("*.py")):
        assert not re.search(r"^\s*(from|import) (llm|corpus_pipeline)\b", path.read_text(), re.M)


def test_all_queries_are_registered():
    entry = importlib.import_module("__spark_entry__")
    names = [n for n in entry.queries() if re.match(r"op\d+_", n)]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14))


def test_stages_take_columns_of_any_name(spark):
    from llm import jaccard, mixing, repeats, toxicity
    text = " ".join(f"w{k}" for k in range(60))
    rows = [(i, text if i < 3 else f"{i} {text} {i}", "s", i, "x") for i in range(12)]
    docs = spark.createDataFrame(
        rows, "doc_id bigint, text string, source string, `a.b` int, `it``s` string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(12)], "doc_id bigint, toxic int")
    for stage in (lambda d: toxicity.reject(d, labels), mixing.mix, jaccard.dedup, repeats.clean):
        out = stage(docs)
        assert out.columns == docs.columns
        assert {r["a.b"] == r.doc_id and r["it`s"] for r in out.collect()} == {"x"}
