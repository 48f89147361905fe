"""Maximal periodic runs of words, and texts collapsed to one period of each.

A run is a stretch of words with smallest period ``q`` that no neighbouring word extends keeping
that period. Its first word ``s`` and ``s + q`` agree for all but ``q`` words of the stretch, and
no word between them starts a suffix that agrees as far. So, while suffixes are united by
decreasing length of common prefix, ``s`` and ``s + q`` become neighbours in the ordered positions
of their class at exactly that length:

1. Suffixes are ranked by prefix doubling, all texts of a chunk at once; only words whose prefix
   still has an equal are sorted again. The ranks of all rounds give common prefix lengths.
2. Descending-LCP Kruskal: neighbouring suffixes are edges, taken from the longest common prefix
   down. A class is an interval of the suffix order with its sorted positions; an edge unites the
   two classes whose ends it touches, and the smaller one's positions go into the larger one's.
3. Two positions that are neighbours now and were not before, at a distance ``q`` within the
   common prefix, seed a run with period ``q``; it is kept if the word before does not extend it.

Prefixes too short for any run that counts are not taken, and a text without a repeated prefix of
that length is not sorted. Everything happens inside a text, so nothing is shuffled; memory is a
few arrays over a chunk or the longest text for each doubling round. Words are compared by 64-bit
hashes.

Defined results: a null text has no words and no runs, its collapsed text is null; an empty text
or one without separators repeats nothing; texts without runs are still joined by single spaces;
equal rows are rows of their own; ids are not read; an empty table gives no rows; other columns
may have any names.
"""

from __future__ import annotations

from bisect import bisect
from functools import partial
from typing import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import StructType

from llm import words
from llm.shared import arrow
from llm.suffixes import doubled

MIN_LENGTH = 6
MIN_EXPONENT = 4
_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
_SPLIT = r"[\x20\x09-\x0D]+"


def _least_prefix(min_length: int, min_exponent: int) -> int:
    """Shortest common prefix that can seed a run of that length and exponent."""
    return min(max(min_length - q, (min_exponent - 1) * q) for q in range(1, min_length + 1))


def _repeating(h: np.ndarray, first: np.ndarray, n: int) -> np.ndarray:
    """Texts that hold ``n`` words twice."""
    doc = words.text_of(first)
    at = np.flatnonzero(words.whole(first, n))
    code = words.mix(words.ngrams(h, n)[at] + doc[at].astype(np.uint64) * words._K1)
    order = np.argsort(code)
    twice = code[order[1:]] == code[order[:-1]]
    return np.unique(doc[at[order[1:][twice]]])


def _common(levels: list[np.ndarray], i: np.ndarray, j: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Words that the suffixes ``i`` and ``j`` have in common."""
    length = np.zeros(len(i), np.int64)
    for k in reversed(range(len(levels))):
        a, b = i + length, j + length
        inside = (a < end[i]) & (b < end[j])
        a[~inside] = b[~inside] = 0
        length += (inside & (levels[k][a] == levels[k][b])).astype(np.int64) << k
    return length


def _kruskal(order: np.ndarray, slot: np.ndarray, length: np.ndarray, ids: np.ndarray,
             begin: np.ndarray, min_length: int, min_exponent: int) -> list[tuple]:
    """(start, length, period) of the runs. ``slot`` and ``length`` are edges between suffix
    ``order[slot]`` and the next, the longest first. Positions are kept negated, so a class that
    grows to the left, as in a periodic text, grows at the end of its list."""
    at, ids, begin = (-order).tolist(), ids.tolist(), begin.tolist()
    other = list(range(len(at)))  # the far end of the interval that ends or begins at a slot
    members: list = [None] * len(at)  # positions of a class, at its first slot
    runs = []
    for k, l in zip(slot.tolist(), length.tolist()):
        lo, hi = other[k], other[k + 1]
        big, small = members[lo] or [at[k]], members[k + 1] or [at[k + 1]]
        if len(big) < len(small):
            big, small = small, big
        members[k + 1] = None
        members[lo], other[lo], other[hi] = big, hi, lo
        i = j = 0
        while j < len(small):
            i = bisect(big, small[j], i)
            until = bisect(small, big[i], j) if i < len(big) else len(small)
            pairs = []
            if i:
                pairs.append((big[i - 1], small[j]))
            if i < len(big):
                pairs.append((small[until - 1], big[i]))
            for after, p in pairs:
                q = p - after
                if l + q >= min_length and l >= (min_exponent - 1) * q:
                    p = -p
                    if p == begin[p] or ids[p - 1] != ids[p + q - 1]:
                        runs.append((p, l + q, q))
            big[i:i] = small[j:until]
            i, j = i + until - j, until
    return runs


def find(h: np.ndarray, first: np.ndarray, min_length: int = MIN_LENGTH,
         min_exponent: int = MIN_EXPONENT) -> np.ndarray:
    """Rows (word, length, period) sorted by word, then period, for texts with word hashes ``h``
    whose first words are ``first``; words are numbered over all texts."""
    none = np.zeros((0, 3), np.int64)
    least = _least_prefix(min_length, min_exponent)
    docs = _repeating(h, first, least) if len(h) else none
    if not len(docs):
        return none
    size = first[docs + 1] - first[docs]
    begin = np.repeat(np.cumsum(size) - size, size)
    end = begin + np.repeat(size, size)
    where = np.arange(len(begin)) - begin + np.repeat(first[docs], size)
    ids = np.unique(h[where], return_inverse=True)[1]
    key = np.repeat(np.arange(len(docs)), size) * len(ids) + ids
    levels = [rank.astype(np.int32) for _, rank in doubled(key, end, 1)]
    order = np.empty(len(ids), np.int64)
    order[levels[-1]] = np.arange(len(ids))
    slot = np.flatnonzero(levels[0][order[:-1]] == levels[0][order[1:]])
    length = _common(levels, order[slot], order[slot + 1], end)
    keep = np.flatnonzero(length >= least)
    keep = keep[np.argsort(-length[keep], kind="stable")]
    found = _kruskal(order, slot[keep], length[keep], ids, begin, min_length, min_exponent)
    runs = np.array(found, np.int64).reshape(-1, 3)
    runs[:, 0] = where[runs[:, 0]]
    return runs[np.lexsort((runs[:, 2], runs[:, 0]))]


def joined(raw: np.ndarray, w: words.Words, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of the kept words of all texts, joined by one space, and the bounds of the texts."""
    kept = np.flatnonzero(keep)
    text = words.text_of(w.first)[kept]
    glue = np.zeros(len(kept), np.int64)
    glue[:-1] = text[1:] == text[:-1]
    mark = np.zeros(len(raw) + 1, np.int8)
    mark[w.start[kept]] += 1
    mark[w.end[kept] + glue] -= 1
    out = raw.copy()
    # The byte after a word that has a successor is a separator.
    out[w.end[kept[glue > 0]]] = 32
    size = np.bincount(text, w.end[kept] - w.start[kept] + glue, len(w.first) - 1)
    bounds = np.concatenate([[0], np.cumsum(size)]).astype(np.int64)
    return out[np.cumsum(mark[:-1], dtype=np.int8).view(bool)], bounds


def _runs(batches: Iterator[pa.RecordBatch], min_length: int,
          min_exponent: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for c in words.chunks(batch.column("text")):
            w = words.split(c.raw, c.offsets)
            h = words.hash_spans(c.raw, w.start, w.end)
            runs = find(h, w.first, min_length, min_exponent)
            edge = np.zeros(len(h) + 1, np.int32)
            np.add.at(edge, runs[:, 0] + runs[:, 2], 1)
            np.add.at(edge, runs[:, 0] + runs[:, 1], -1)
            data, bounds = joined(c.raw, w, np.cumsum(edge[:-1]) == 0)
            text = np.searchsorted(w.first, runs[:, 0], "right") - 1
            items = pa.StructArray.from_arrays(
                [pa.array(runs[:, 0] - w.first[text]), pa.array(runs[:, 1]),
                 pa.array(runs[:, 2])], fields=list(_RUN))
            per = np.searchsorted(text, np.arange(c.hi - c.lo + 1)).astype(np.int32)
            texts = pa.LargeStringArray.from_buffers(
                c.hi - c.lo, pa.py_buffer(bounds), pa.py_buffer(data)).cast(pa.string())
            source = batch.slice(c.lo, c.hi - c.lo)
            texts = pa.compute.if_else(source.column("text").is_valid(), texts,
                                       pa.scalar(None, pa.string()))
            yield pa.RecordBatch.from_arrays(
                [source.column("doc"), pa.array(np.diff(w.first)),
                 pa.ListArray.from_arrays(pa.array(per), items), texts],
                ["doc", "n_words", "runs", "collapsed"])


def detect(docs: DataFrame, carry: list[str] | None = None, min_length: int = MIN_LENGTH,
           min_exponent: int = MIN_EXPONENT) -> DataFrame:
    """doc (struct of the ``carry`` columns), n_words, runs (array of start, length, period by
    start, then period) and the collapsed text of every row: no word that a run contains after
    its first period, the others joined by one space. ``min_exponent`` is 2 at least."""
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in carry or ["doc_id"])).alias("doc"),
                       F.col("text"))
    schema = StructType([rows.schema["doc"], *StructType.fromDDL(
        "n_words bigint, runs array<struct<start:bigint,length:bigint,period:bigint>>, "
        "collapsed string")])
    return arrow(rows, partial(_runs, min_length=min_length, min_exponent=min_exponent), schema)


def looped(doc_id: Column, text: Column) -> Column:
    """The text, its words looped from one on where crc32(doc_id) is divisible by ten: every word
    from ``a`` on becomes one of the ``p`` words from ``a`` on, in turn."""
    crc = F.crc32(doc_id.cast("string").cast("binary"))
    g = F.floor(crc / 10)

    def loop(w: Column) -> Column:
        n = F.size(w)
        a = (g % n).cast("int")
        p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
        turns = F.ceil((n - a) / p).cast("int")
        tail = F.slice(F.flatten(F.array_repeat(F.slice(w, a + 1, p), turns)), F.lit(1), n - a)
        return F.when(n > 0, F.array_join(F.concat(F.slice(w, F.lit(1), a), tail), " "))

    # The lambda binds the words, so that they are split once.
    split = F.filter(F.split(text, _SPLIT), lambda w: w != "")
    return F.when(crc % 10 == 0, F.coalesce(F.transform(F.array(split), loop)[0], text)).otherwise(
        text)


def digest(found: DataFrame) -> DataFrame:
    """What a run report needs of :func:`detect`: the number of runs, the longest one (ties:
    smallest start, then period), and digests of all runs and of the collapsed text."""
    best = F.array_max(F.transform("runs", lambda r: F.struct(
        r["length"].alias("length"), (-r["start"]).alias("s"), (-r["period"]).alias("p"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(
        F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    return found.withColumn("_best", best).select(
        "doc.*", F.size("runs").cast("bigint").alias("n_runs"),
        (-F.col("_best.s")).alias("start"), F.col("_best.length").alias("length"),
        (-F.col("_best.p")).alias("period"),
        F.expr("1000 * _best.length div -_best.p").alias("exponent_milli"),
        F.sha2(lines.cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.coalesce("collapsed", F.lit("")).cast("binary"), 256).alias("collapsed_sha256"))
