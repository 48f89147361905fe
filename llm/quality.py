"""Quality by random-indexing word vectors and a small neural network.

1. Every word gives two tokens: its letters (hashed into buckets) and its shape (case, digits,
   symbols around it, length, whether it repeats the word before). Each token has a fixed sparse
   random index vector. A token's word vector is the sum of the index vectors around all its
   occurrences, over all whole texts of the table.
2. A document is the mean of its words' vectors and shapes' vectors, and its length.
3. A two-layer network learns the labels from at most ``SAMPLE`` labelled rows. A share of them is
   kept back to fit the temperature that calibrates its probabilities.

Sums of index vectors are integers, so the vectors do not depend on how the work is divided.

Defined results: a null text is an empty one; a text without words is scored like every other,
from zero means; without labelled rows of both classes every score is 1 (nothing is known against
a text); a row without an id is never learned and not held out; labels that disagree about an id
count as the lowest.
"""

from __future__ import annotations

from typing import Iterator, NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from llm import words
from llm.shared import arrow, held_out, one_text_per_id

FOLDS, HELD_OUT = 5, 0
SAMPLE = 20_000
THRESHOLD = 0.3
WORDS, SHAPES = 1 << 13, 1_536
DIM = 32
REACH = 2
HIDDEN = 32
_U = np.uint64
# Sums of eight bits are at least -_RAISE; so many of them, raised, stay below 2 ** 16.
_RAISE, _RUN = 128, 256

_CLASS = np.full(256, 3, np.uint8)  # symbols
_CLASS[[*range(97, 123), *range(128, 256)]] = 0
_CLASS[65:91] = 1
_CLASS[48:58] = 2
_CLASS[[ord(c) for c in ".,;:'\"()-?"]] = 4
# Classes 0 and 1, and 2 and 3, counted in the lower and the upper half of a number.
_HALVES = np.array([[1, 1 << 32, 0, 0, 0], [0, 0, 1, 1 << 32, 0]], np.uint64)
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32


class Model(NamedTuple):
    vectors: np.ndarray
    scale: tuple[np.ndarray, np.ndarray]
    layers: list[np.ndarray]
    temperature: float


def _index_vectors() -> np.ndarray:
    """Ternary vectors with four entries, the same in every process."""
    rng = np.random.default_rng(11)
    out = np.zeros((WORDS + SHAPES, DIM), np.int8)
    at = np.argsort(rng.random(out.shape), 1)[:, :4]
    np.put_along_axis(out, at, rng.choice(np.array([-1, 1], np.int8), at.shape), 1)
    return out


def _tokens(c: words.Chunk) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word token and shape token of every word, and the first word of each text."""
    w = words.split(c.raw, c.offsets)
    n = len(w.start)
    if not n:
        none = np.zeros(0, np.int64)
        return none, none, w.first
    h = words.hash_spans(_FOLD[c.raw], w.start, w.end)
    kind = _CLASS[c.raw]
    length = w.end - w.start

    def share(counts: np.ndarray) -> np.ndarray:
        """Two counts of every word, in the halves of one number."""
        total = np.zeros(len(c.raw) + 1, np.uint64)
        np.cumsum(counts[kind], out=total[1:])
        return total[w.end] - total[w.start]

    lower, upper, digit, symbol = (
        half.astype(np.int64) for pair in map(share, _HALVES)
        for half in (pair & _U(0xFFFFFFFF), pair >> _U(32)))
    # Only words that are equal but for their case can be equal.
    again = np.zeros(n, np.int64)
    twins = np.flatnonzero(h[1:] == h[:-1])
    again[twins + 1] = (words.hash_spans(c.raw, w.start[twins], w.end[twins])
                        == words.hash_spans(c.raw, w.start[twins + 1], w.end[twins + 1]))
    again[w.first[:-1][w.first[:-1] < n]] = 0
    case = np.where(upper == 0, 0, np.where(lower == 0, 2, np.where(upper == 1, 1, 3)))
    last = np.where(symbol > 0, c.raw[w.end - 1] % 8, 0).astype(np.int64)
    size = np.minimum(3, length // 5)
    shape = (((case * 2 + (digit > 0)) * 3 + np.minimum(symbol, 2)) * 8 + last) * 2 + again
    shape = shape * 4 + size  # below SHAPES
    return (h >> _U(51)).astype(np.int64), WORDS + shape, w.first


def _around(own: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The sum of the ``REACH`` rows on either side of every row within its text. Two rows of four
    entries of 1 are summed for each word, so eight bits hold the sums."""
    gap = len(first) * REACH  # empty rows behind every text
    at = np.arange(len(own)) + REACH * words.text_of(first)
    spread = np.zeros((len(own) + gap, DIM), np.int8)
    spread[at] = own
    total = np.zeros_like(spread)
    for k in range(1, REACH + 1):
        total[:-k] += spread[k:]
        total[k:] += spread[:-k]
    return total[at]


def _add_by_token(total: np.ndarray, token: np.ndarray, rows: np.ndarray) -> None:
    """Add each of the rows (of eight bits) to the row of its token. Four values, raised by
    ``_RAISE``, are summed as one number of 64 bits over at most ``_RUN`` rows."""
    order = np.argsort(token.astype(np.uint16), kind="stable")
    kinds, cut, n = np.unique(token[order], return_index=True, return_counts=True)
    runs = -(-n // _RUN)
    where = np.cumsum(runs) - runs
    starts = np.repeat(cut, runs) + (np.arange(runs.sum()) - np.repeat(where, runs)) * _RUN
    lanes = np.ascontiguousarray((rows.astype("<u2") + np.uint16(_RAISE)).view("<u8").T)
    sums = np.ascontiguousarray(np.add.reduceat(lanes.take(order, 1), starts, axis=1).T)
    sums = sums.view("<u2").astype(np.int64)
    total[kinds] += np.add.reduceat(sums, where, axis=0) - _RAISE * n[:, None]


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sum of the index vectors around every token, over a whole partition."""
    index = _index_vectors()
    total = np.zeros((WORDS + SHAPES, DIM), np.int64)
    for batch in batches:
        for c in words.chunks(batch.column("text")):
            word, shape, first = _tokens(c)
            if len(word) < 2:
                continue
            around = _around(index.take(word, 0) + index.take(shape, 0), first)
            for token in (word, shape):
                _add_by_token(total, token, around)
    used = np.flatnonzero(total.any(1))
    yield pa.RecordBatch.from_arrays(
        [pa.array(used), *(pa.array(total[used, d]) for d in range(DIM))],
        ["token", *(f"c{d}" for d in range(DIM))])


def word_vectors(docs: DataFrame) -> np.ndarray:
    """Unit word vectors of all tokens; the table has a fixed number of rows."""
    columns = [f"c{d}" for d in range(DIM)]
    sums = arrow(docs.select("text"), _contexts,
                 "token bigint, " + ", ".join(f"{c} bigint" for c in columns))
    rows = sums.groupBy("token").agg(*(F.sum(c).alias(c) for c in columns)).toPandas()
    out = np.zeros((WORDS + SHAPES, DIM))
    out[rows["token"].to_numpy(np.int64)] = rows[columns].to_numpy(float)
    for part in (slice(0, WORDS), slice(WORDS, None)):
        v = out[part]
        some = v.any(1)
        if some.any():
            v[some] /= np.linalg.norm(v[some], axis=1, keepdims=True)
            v[some] -= v[some].mean(0)
            v[some] /= np.maximum(1e-9, np.linalg.norm(v[some], axis=1, keepdims=True))
    return out.astype(np.float32)


def _pool(column: pa.Array, vectors: np.ndarray) -> np.ndarray:
    """The document vectors of a text column."""
    out = np.zeros((len(column), 2 * DIM + 1), np.float32)
    by_dimension = np.ascontiguousarray(vectors.T)  # sums run along the memory
    for c in words.chunks(column):
        word, shape, first = _tokens(c)
        count = np.diff(first)
        some = np.flatnonzero(count)
        rows = c.lo + some
        if len(some):
            for k, token in enumerate((word, shape)):
                total = np.add.reduceat(by_dimension.take(token, 1), first[some], axis=1).T
                out[rows, k * DIM : (k + 1) * DIM] = total / count[some, None]
        out[c.lo : c.hi, -1] = np.log1p(count)
    return out


def _forward(x: np.ndarray, layers: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    a, b, c, d = layers
    hidden = np.maximum(0, x @ a + b)
    return hidden, (hidden @ c + d)[:, 0]


def train(x: np.ndarray, y: np.ndarray, epochs: int = 60, seed: int = 5) -> list[np.ndarray]:
    """The two layers, by Adam on the cross entropy."""
    rng = np.random.default_rng(seed)
    layers = [rng.normal(0, np.sqrt(2 / x.shape[1]), (x.shape[1], HIDDEN)), np.zeros(HIDDEN),
              rng.normal(0, np.sqrt(1 / HIDDEN), (HIDDEN, 1)), np.zeros(1)]
    mean, square, t = [0 * v for v in layers], [0 * v for v in layers], 0
    epochs = max(epochs, 2000 * 64 // max(1, len(x)))
    for _ in range(epochs):
        order = rng.permutation(len(x))
        for at in range(0, len(x), 64):
            rows = order[at : at + 64]
            hidden, out = _forward(x[rows], layers)
            error = ((1 / (1 + np.exp(-np.clip(out, -30, 30)))) - y[rows])[:, None] / len(rows)
            back = (error @ layers[2].T) * (hidden > 0)
            slopes = [x[rows].T @ back, back.sum(0), hidden.T @ error, error.sum(0)]
            t += 1
            for k, g in enumerate(slopes):
                g = g + 1e-4 * layers[k]
                mean[k] = 0.9 * mean[k] + 0.1 * g
                square[k] = 0.999 * square[k] + 0.001 * g * g
                layers[k] = layers[k] - 2e-3 * (mean[k] / (1 - 0.9**t)) / (
                    np.sqrt(square[k] / (1 - 0.999**t)) + 1e-8)
    return layers


def temperature(out: np.ndarray, y: np.ndarray) -> float:
    """The divisor (at least 1) of the network's outputs that makes the labels likeliest."""
    def loss(t: float) -> float:
        z = out / t
        return float(np.mean(np.logaddexp(0, z) - y * z))

    return min(np.geomspace(1, 64, 120), key=loss)


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model | None:
    """Word vectors of the whole table, and the network on labelled rows."""
    vectors = word_vectors(docs)
    known = (
        labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull())
        .where(~held_out("doc_id", FOLDS, HELD_OUT))
        .groupBy(F.col("doc_id").alias("_id")).agg(F.min("quality").cast("int").alias("_y"))
        .orderBy(F.xxhash64("_id"), "_id").limit(sample)
    )
    # At most ``sample`` rows of two numbers, and one text for each.
    texts = one_text_per_id(docs, known)

    def pooled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = _pool(batch.column("text"), vectors)
            flat = pa.FixedSizeListArray.from_arrays(pa.array(rows.ravel()), rows.shape[1])
            yield pa.RecordBatch.from_arrays(
                [batch.column("_id"), batch.column("_y"), flat.cast(pa.list_(pa.float32()))],
                ["id", "y", "x"])

    rows = arrow(texts, pooled, "id bigint, y int, x array<float>").collect()
    rows.sort(key=lambda r: (r["id"], r["x"]))
    y = np.array([r["y"] for r in rows], float)
    if len(set(y)) < 2:
        return None
    x = np.array([r["x"] for r in rows], np.float64)
    scale = x.mean(0), x.std(0) + 1e-3
    x = (x - scale[0]) / scale[1]
    back = np.arange(len(x)) % 6 == 5
    if len(set(y[back])) < 2:
        back[:] = False
    layers = train(x[~back], y[~back])
    t = temperature(_forward(x[back], layers)[1], y[back]) if back.any() else 1.0
    return Model(vectors, scale, layers, t)


def score(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, held_out and score of every document."""
    rows = docs.select(
        "doc_id", held_out("doc_id", FOLDS, HELD_OUT).alias("held_out"), "text")
    if model is None:
        return rows.select("doc_id", "held_out", F.lit(1.0).alias("score"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = (_pool(batch.column("text"), model.vectors) - model.scale[0]) / model.scale[1]
            out = _forward(x, model.layers)[1] / model.temperature
            value = 1 / (1 + np.exp(-np.clip(out, -40, 40)))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), pa.array(value)],
                ["doc_id", "held_out", "score"])

    kind = dict(rows.dtypes)["doc_id"]
    return arrow(rows, run, f"doc_id {kind}, held_out boolean, score double")
