"""Toxicity by weak supervision.

1. A lexicon is mined from labelled rows: lower-case words and word beginnings that occur far more
   often in toxic than in other texts. Equal texts count once.
2. Voters: slices of the lexicon (by kind of term and strength) and patterns of the writing (upper
   case, symbol runs, repetitions and the like). A voter fires on a text or does not.
3. A generative model with a hidden label explains the votes: how often each voter fires for
   either label (its accuracy), and which voter it leans on besides (a tree of the strongest
   correlations given the label). It is fitted by expectation maximisation; the labelled rows
   give each voter's prior rates, which settles what a lone vote means.
4. A logistic regression on the terms and patterns found in a text learns the posterior labels.

The fit uses at most ``SAMPLE`` labelled rows, chosen by a hash of the id; every whole text of the
table is scored. Nothing but the text enters a score.

Defined results: a null text is an empty one and gets the score of a text without any sign;
without learnable labels (none, or only one class) every score is 0; a row without an id is never
learned and not held out; labels that disagree about an id count as toxic if one says so.
"""

from __future__ import annotations

from typing import Iterator, NamedTuple, Sequence

import numpy as np
import pyarrow as pa
from pyarrow import compute as pc
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import StructType

from llm import words
from llm.shared import arrow, cut, every_column, held_out, one_text_per_id

FOLDS, HELD_OUT = 3, 1
# Bounds of the fit: labelled rows, and terms of the lexicon.
SAMPLE = 20_000
TERMS = 500
LEAST_TEXTS = 3
LEAST_LIFT = 20.0
THRESHOLD = 0.7
_PREFIXES = (4, 5, 6)
_TIERS = 6
_U = np.uint64

_BREAK = np.ones(256, bool)
_BREAK[[*range(48, 58), *range(97, 123), *range(128, 256)]] = False
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "%&*$#@"]] = True
PATTERNS = ("upper", "exclaim", "symbols", "pipes", "repeats", "leet", "short")


class Model(NamedTuple):
    terms: np.ndarray  # sorted hashes
    weights: np.ndarray  # of the terms, then of the patterns
    bias: float


def _terms(raw: np.ndarray, w: words.Words) -> list[tuple[np.ndarray, np.ndarray]]:
    """(term hashes, number of the word) for whole words and for each length of beginning."""
    out = [(words.hash_spans(raw, w.start, w.end, 1), np.arange(len(w.start)))]
    length = w.end - w.start
    for n in _PREFIXES:
        at = np.flatnonzero(length > n)
        out.append((words.hash_spans(raw, w.start[at], w.start[at] + n, 100 + n), at))
    return out


def _per_text(mask: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    return np.diff(np.concatenate([[0], np.cumsum(mask)])[offsets])


def patterns(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Whether each text shows each of ``PATTERNS``."""
    size = np.maximum(1, np.diff(offsets))
    letters = np.maximum(1, _per_text(_LETTER[raw], offsets))
    w = words.split(raw, offsets)
    count = np.maximum(1, np.diff(w.first))
    h = words.hash_spans(raw, w.start, w.end)
    again = np.zeros(len(h), bool)
    again[1:] = h[1:] == h[:-1]
    digit, letter = _DIGIT[raw], _LETTER[raw]
    leet = np.zeros(len(raw), bool)
    leet[1:-1] = letter[:-2] & digit[1:-1] & letter[2:]
    shout = np.zeros(len(raw), bool)
    shout[1:] = (raw[1:] == 33) & (raw[:-1] == 33)
    return np.stack([
        _per_text(_UPPER[raw], offsets) > 0.5 * letters,
        _per_text(shout, offsets) > 0.02 * size,
        _per_text(_SYMBOL[raw], offsets) > 0.03 * size,
        _per_text(raw == 124, offsets) > 0.02 * size,
        _per_text(again, w.first) > 0.1 * count,
        _per_text(leet, offsets) > 0,
        count < 20,
    ], 1)


def _lower(column: pa.Array) -> pa.Array:
    return pc.utf8_lower(column.fill_null(""))


def _count_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per batch: in how many toxic and other texts each term occurs."""
    for batch in batches:
        toxic = batch.column("toxic").to_numpy(zero_copy_only=False).astype(bool)
        found: list[tuple[np.ndarray, np.ndarray]] = []
        for c in words.chunks(_lower(batch.column("text"))):
            w = words.split(c.raw, c.offsets, _BREAK)
            doc = words.text_of(w.first)
            for kind, (h, at) in enumerate(_terms(c.raw, w)):
                order = np.lexsort((h, doc[at]))
                h, d = h[order], doc[at][order]
                new = np.ones(len(h), bool)
                new[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
                found.append((kind, h[new], toxic[c.lo + d[new]]))
        for kind in range(1 + len(_PREFIXES)):
            h = np.concatenate([f[1] for f in found if f[0] == kind] or [np.zeros(0, _U)])
            t = np.concatenate([f[2] for f in found if f[0] == kind] or [np.zeros(0, bool)])
            keys, where = np.unique(h, return_inverse=True)
            yes = np.bincount(where, t, len(keys)).astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(keys), kind, np.int32)), pa.array(keys.view(np.int64)),
                 pa.array(yes), pa.array(np.bincount(where, minlength=len(keys)) - yes)],
                ["kind", "term", "yes", "no"])


def _finder(terms: np.ndarray):
    """Function from a text column to (chunk, text number, term number) of distinct hits."""
    maybe = np.zeros(1 << 20, bool)
    maybe[(terms >> _U(44)).astype(np.int64)] = True

    def find(column: pa.Array):
        for c in words.chunks(_lower(column)):
            w = words.split(c.raw, c.offsets, _BREAK)
            doc = words.text_of(w.first)
            hits = [np.zeros(0, np.int64)]
            for h, at in _terms(c.raw, w):
                near = np.flatnonzero(maybe[(h >> _U(44)).astype(np.int64)])
                place = np.minimum(np.searchsorted(terms, h[near]), max(0, len(terms) - 1))
                good = terms[place] == h[near] if len(terms) else np.zeros(len(near), bool)
                hits.append(doc[at[near[good]]] * len(terms) + place[good])
            both = np.unique(np.concatenate(hits))
            yield c, both // max(1, len(terms)), both % max(1, len(terms))

    return find


def fit_label_model(votes: np.ndarray, start: np.ndarray, prior: np.ndarray | None = None,
                    rounds: int = 30) -> tuple[np.ndarray, np.ndarray]:
    """Posterior probability of the hidden label for each row of a 0/1 vote matrix, and each
    voter's parent in the correlation tree (-1: none).

    P(label) and P(vote | label, parent's vote) are estimated by expectation maximisation from
    ``start``, smoothed towards ``prior`` (rate of each vote for labels 0 and 1); the tree is the
    spanning tree of largest conditional mutual information.
    """
    v = votes.astype(np.float64)
    n, m = v.shape
    q = np.clip(start.astype(np.float64), 0.02, 0.98)
    parent = np.full(m, -1)
    if prior is None:
        prior = np.stack([v.mean(0), v.mean(0)])
        firm = np.array([2.0, 2.0])
    else:
        firm = np.array([1 - q.mean(), q.mean()]) * n / 2
    for step in range(rounds):
        weight = np.stack([1 - q, q])
        if step % 10 == 0 and m > 1:
            parent = _tree(v, weight)
        score = np.log(np.clip(weight.mean(1), 1e-6, 1))[:, None] + np.zeros((2, n))
        for j in range(m):
            lean = v[:, parent[j]].astype(int) if parent[j] >= 0 else np.zeros(n, int)
            for y in range(2):
                for p in range(2):
                    rows = lean == p
                    if not rows.any():
                        continue
                    total, fires = weight[y][rows].sum(), weight[y][rows] @ v[rows, j]
                    rate = (fires + firm[y] * prior[y, j] + 0.01) / (total + firm[y] + 0.02)
                    score[y, rows] += np.where(v[rows, j] > 0, np.log(rate), np.log1p(-rate))
        new = 1 / (1 + np.exp(np.clip(score[0] - score[1], -50, 50)))
        done, q = np.abs(new - q).max() < 1e-4, np.clip(new, 1e-6, 1 - 1e-6)
        if done and step % 10:
            break
    return q, parent


def _tree(v: np.ndarray, weight: np.ndarray) -> np.ndarray:
    n, m = v.shape
    info = np.zeros((m, m))
    for w in weight:
        both = (v * w[:, None]).T @ v / n
        one = (v * w[:, None]).sum(0) / n
        all_ = w.sum() / n
        for a in range(2):
            for b in range(2):
                pa_ = one if a else all_ - one
                pb = one if b else all_ - one
                joint = (both if a and b else one[:, None] - both if a
                         else one[None, :] - both if b
                         else all_ - one[:, None] - one[None, :] + both)
                joint = np.maximum(joint, 1e-9)
                info += joint * np.log(joint * all_ / np.maximum(np.outer(pa_, pb), 1e-12))
    parent = np.full(m, -1)
    inside, best, by = np.zeros(m, bool), np.full(m, -np.inf), np.full(m, -1)
    best[0] = 0
    for _ in range(m):
        j = int(np.where(inside, -np.inf, best).argmax())
        inside[j], parent[j] = True, by[j]
        closer = ~inside & (info[j] > best)
        best[closer], by[closer] = info[j][closer], j
    parent[(parent >= 0) & (info[np.arange(m), parent] < 1e-3)] = -1  # as good as independent
    return parent


def fit_linear(x: np.ndarray, y: np.ndarray, rounds: int = 12, ridge: float = 0.05
               ) -> tuple[np.ndarray, float]:
    """Logistic regression on soft labels, by Newton steps (the bias is not shrunk)."""
    x = np.concatenate([x, np.ones((len(x), 1), np.float32)], 1)
    w, shrink = np.zeros(x.shape[1]), np.full(x.shape[1], ridge)
    shrink[-1] = 1e-3
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (p - y) + shrink * w
        bend = (x * (p * (1 - p) + 1e-6).astype(np.float32)[:, None]).T @ x
        step = np.linalg.solve(bend + np.diag(shrink), slope)
        w -= step * min(1.0, 4.0 / max(1e-9, np.abs(step).max()))
        if np.abs(step).max() < 1e-3:
            break
    return w[:-1], float(w[-1])


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model | None:
    """Mine the lexicon, run the voters, fit the label model and the classifier."""
    known = (
        labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull())
        .where(~held_out("doc_id", FOLDS, HELD_OUT))
        .groupBy(F.col("doc_id").alias("_id")).agg(F.max("toxic").cast("int").alias("_toxic"))
        .orderBy(F.xxhash64("_id"), "_id").limit(sample)
    )
    # At most ``sample`` rows of two numbers; equal texts are one, toxic if any of them is.
    texts = one_text_per_id(docs, known).groupBy(
        F.xxhash64("text").alias("_k1"), F.xxhash64(F.lit("second"), "text").alias("_k2")
    ).agg(F.min("text").alias("text"), F.max("_toxic").alias("toxic"))
    texts = cut(texts.select("text", "toxic"), "toxic-sample")
    sizes = {r["toxic"]: r["count"] for r in texts.groupBy("toxic").count().collect()}
    if len(sizes) < 2:
        return None
    no, yes = sizes[0], sizes[1]
    lift = (F.col("yes") / yes) / ((F.col("no") + 0.5) / no)
    lexicon = (
        arrow(texts.select("text", "toxic"), _count_terms,
              "kind int, term bigint, yes bigint, no bigint")
        .groupBy("kind", "term").agg(F.sum("yes").alias("yes"), F.sum("no").alias("no"))
        .where((F.col("yes") >= LEAST_TEXTS) & (lift >= LEAST_LIFT))
        .orderBy(F.desc(F.col("yes") * F.log(lift)), "kind", "term").limit(TERMS).collect()
    )
    if not lexicon:
        return None
    hashes = np.array([r["term"] for r in lexicon], np.int64).view(np.uint64)
    order = np.argsort(hashes)
    terms = hashes[order]
    kind = np.array([r["kind"] for r in lexicon])[order]
    tier = np.minimum(_TIERS - 1, np.log2(1 + np.arange(len(terms)) / 8).astype(int))[order]
    voter = kind * _TIERS + tier
    find = _finder(terms)

    def hits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen = [np.zeros(0, np.int64) for _ in range(batch.num_rows)]
            for c, doc, term in find(batch.column("text")):
                for i, part in enumerate(np.split(term, np.searchsorted(
                        doc, np.arange(1, c.hi - c.lo)))):
                    seen[c.lo + i] = part
            shown = np.concatenate([np.zeros((0, len(PATTERNS)), bool)] + [
                patterns(c.raw, c.offsets) for c in words.chunks(batch.column("text"))])
            rows = [np.concatenate([s, len(terms) + np.flatnonzero(p)])
                    for s, p in zip(seen, shown)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(rows, pa.list_(pa.int64())), batch.column("toxic")],
                ["hits", "toxic"])

    # At most ``sample`` short lists.
    rows = arrow(texts.select("text", "toxic"), hits, "hits array<bigint>, toxic int").collect()
    found, toxic = [r["hits"] for r in rows], np.array([r["toxic"] for r in rows], bool)
    x = np.zeros((len(found), len(terms) + len(PATTERNS)), np.float32)
    for i, row in enumerate(found):
        x[i, row] = 1
    votes = np.zeros((len(found), (1 + len(_PREFIXES)) * _TIERS + len(PATTERNS)), bool)
    for i, row in enumerate(found):
        for k in row:
            votes[i, voter[k] if k < len(terms) else votes.shape[1] - len(PATTERNS)
                  + k - len(terms)] = True
    votes = votes[:, votes.any(0) & ~votes.all(0)]
    start = x[:, : len(terms)].any(1)
    rates = np.stack([(votes[toxic == y].sum(0) + 0.02) / ((toxic == y).sum() + 1)
                      for y in (False, True)])
    posterior, _ = fit_label_model(votes, start, rates)
    weights, bias = fit_linear(x, posterior)
    return Model(terms, weights, bias)


def score(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, held_out and score of every document."""
    return _scored(docs, model, ("doc_id",)).select("doc.doc_id", "held_out", "score")


def _scored(docs: DataFrame, model: Model | None, carry: Sequence[str | Column]) -> DataFrame:
    """doc (struct of the ``carry`` columns), held_out and score."""
    if model is None:
        return docs.select(
            F.struct(*carry).alias("doc"),
            held_out("doc_id", FOLDS, HELD_OUT).alias("held_out"), F.lit(0.0).alias("score"))
    terms, weights, bias = model
    find = _finder(terms)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = batch.column("text")
            total = np.full(batch.num_rows, bias)
            for c, doc, term in find(text):
                total[c.lo : c.hi] += np.bincount(doc, weights[term], c.hi - c.lo)
            for c in words.chunks(text):
                total[c.lo : c.hi] += patterns(c.raw, c.offsets) @ weights[len(terms) :]
            value = 1 / (1 + np.exp(-np.clip(total, -40, 40)))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc"), batch.column("held_out"), pa.array(value)],
                ["doc", "held_out", "score"])

    rows = docs.select(F.struct(*carry).alias("doc"),
                       held_out("doc_id", FOLDS, HELD_OUT).alias("held_out"), "text")
    out = StructType().add(rows.schema["doc"]).add("held_out", "boolean").add("score", "double")
    return arrow(rows, run, out)


def reject(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents whose score is below the threshold, with all their columns."""
    scored = _scored(docs, fit(docs, labels), every_column(docs))
    return scored.where(F.col("score") < THRESHOLD).select("doc.*")
