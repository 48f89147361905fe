import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings, strategies as st


from llm import packing, words

CAP = packing.CAPACITY
TEXTS = [
    None, "", "  \n\t ", "one", "One one ONE", "a<|endoftext|>b <|startoftext|>", "x y\u0085z",
    "ΑΣ ΣΑΣ é ́a", "can't 12,3 日本語 " * 40, "word " * 9000,
    "".join(chr(97 + i % 26) for i in range(30000)), "\x1c\x1d a\x1fb", "same text", "same text",
]


def _expected(texts):
    import public_tokenizers
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(str(public_tokenizers.path(packing.TOKENIZER)))
    for i, text in enumerate(texts):
        ids = tok.encode(text or "", add_special_tokens=False).ids + [0]
        for p, at in enumerate(range(0, len(ids), CAP)):
            part = ids[at : at + CAP]
            yield i, p, at, len(part), zlib.crc32(np.array(part, "<u4").tobytes())


def _check_sequences(rows):
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= CAP
    return len(by)


def test_pieces_are_the_tokenizers_and_sequences_are_gapless(spark):
    docs = spark.createDataFrame(
        [(i, t, "x", i, 1) for i, t in enumerate(TEXTS)],
        "doc_id bigint, text string, length string, _rank int, piece int")
    rows = packing.pack(docs, with_ids=True).collect()
    got = sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows)
    assert got == sorted(_expected(TEXTS))
    assert all(zlib.crc32(r.ids) == r.ids_crc32 and len(r.ids) == 4 * r.length for r in rows)
    total = sum(r.length for r in rows)
    assert -(-total // CAP) <= _check_sequences(rows) <= -(-total // CAP) + 2


def test_empty_table_and_null_ids(spark):
    empty = spark.createDataFrame([], "doc_id bigint, text string")
    assert packing.pack(empty).count() == 0
    nulls = spark.createDataFrame([(None, "a"), (None, "a")], "doc_id bigint, text string")
    assert [r.doc_id for r in packing.pack(nulls).collect()] == [None, None]


def test_query_over_the_whole_table(spark):
    from llm.queries import QUERIES

    sf = "/root/testdata/sf0.001"
    rows = QUERIES["op10_packing"](spark, sf).collect()
    docs = spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").collect()
    names = [d.doc_id for d in docs]
    want = sorted((names[i], *rest) for i, *rest in _expected([d.text for d in docs]))
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    total = sum(r.length for r in rows)
    assert _check_sequences(rows) <= 1.05 * total / CAP + 1


@settings(max_examples=25, deadline=None)
@given(st.lists(st.integers(1, CAP), max_size=60))
def test_plan_places_every_piece_once(lengths):
    counts = np.bincount(np.array(lengths, np.int64), minlength=CAP + 1)
    runs, n = packing.plan_with(counts, CAP, 4)
    fill = np.zeros(n, np.int64)
    seen = np.zeros(CAP + 1, np.int64)
    for length, _, many, sequence, each, _ in runs:
        seen[length] += many
        i = np.arange(many)
        np.add.at(fill, sequence + i // each, length)
    assert (seen == counts).all()
    assert (fill <= CAP).all() and (fill > 0).all()
    # Never worse than first-fit decreasing's guarantee on the volume bound.
    assert n <= max(1, 2 * -(-sum(lengths) // CAP)) + 1 if lengths else n == 0


def test_linear_program_finds_the_known_optimum():
    shapes = packing.configurations(np.array([700, 1000, 1300]), np.array([30.0, 10.0, 30.0]), CAP)
    assert sum(t for _, t in shapes) == pytest.approx(35.0)


def test_parts_of_plain_words_have_the_ids_of_the_words():
    """Words that differ by case, digits and symbols only share their parts."""
    import random

    import public_tokenizers
    from tokenizers import Tokenizer

    path = str(public_tokenizers.path(packing.TOKENIZER))
    tok, encoder = Tokenizer.from_file(path), packing._Encoder(path)
    r = random.Random(5)
    some = ["a", "B", "the", "É", "é", "ß", "×", "÷", "ÿ", "'", "'s", "'LL", "<", "|", "<|", "|>",
            "<|endoftext|>", "<|ENDOFTEXT|>", "1", "90", "!", "#", "_", "\x7f", "\x00", "\x1c",
            "\x85", "\u00a0", "\u00ad", "\u0301", "\u0307", "\u0338", "\u0331", "I", "H", "=",
            "\u212a", "İ", "Σ", "中", "²", "½", "ª", "µ", "ł", "😀", "\u200d", " ", "\n"]
    texts = ["".join(r.choice(some) for _ in range(r.randrange(12))) for _ in range(4000)]
    texts += ["<", "|x", "É", "é", "z" * 5000 + "!!", "", None]
    for chunk in words.chunks(pa.array(texts), 1000):
        ids, bounds = encoder.encode(chunk)
        for i in range(chunk.lo, chunk.hi):
            a, b = bounds[i - chunk.lo], bounds[i - chunk.lo + 1]
            assert ids[a:b].tolist() == tok.encode(
                texts[i] or "", add_special_tokens=False).ids + [0], texts[i]
    known = packing._Encoder(path)
    for chunk in words.chunks(pa.array(["heute Heute HEUTE heute! Heute!! (heute) heute1 heute21"])):
        known.encode(chunk)
    assert len(known.keys) == 7  # heute, "!", "!!", "(", ")", "1" and "2"
