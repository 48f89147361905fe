"""Substring dedup with prefix-partitioned suffix trees.

A window is ``WINDOW`` consecutive words of one text. A word is removed when it lies in a window
whose words also start a window of a document with a smaller id.

0. Of equal texts only the one with the smallest id takes part: all windows of the others repeat.
1. *Which suffixes matter.* In every window the smallest hash of ``PREFIX`` consecutive words (the
   leftmost, if equal) is its anchor, so equal windows have equal anchors at equal places. A window
   can only repeat if its anchor occurs in two texts; only such windows are suffixes of the tree.
   One that its text repeats is taken once. Neighbouring suffixes with one anchor travel together, as
   one stretch of words.
2. *Prefix partitions.* All suffixes of a partition hold a common stretch of words, of variable length:
   the anchor's ``PREFIX`` words; where these would gather more than ``GROUP_WORDS`` words, a stretch
   about twice as long, which the windows that begin in the same half before the anchor share; where
   that gathers too many as well, the whole window. The lengths follow from sums over all texts.
3. *Subtrees.* The suffixes of a partition are sorted by their words (prefix doubling) with the common
   prefix lengths of neighbours. Where these are ``WINDOW`` or more lies a deep internal node: the
   smallest id below it is its owner, and the other suffixes below it repeat. Neighbouring repeats of a
   stretch are one maximal repeat.
4. A whole window is a node already, however many texts have it: its owner is an aggregate with map-side
   combination, which its suffixes meet over several salts.

Words are compared by 64-bit hashes, whole windows of step 4 by one of their words' hashes. Memory is
bounded by ``GROUP_WORDS`` and the longest single text.

Defined results: a null text has no words; a row without an id counts as later than every id, and
such rows do not repeat each other; rows with the same id do not repeat each other; a text shorter
than the window is kept whole; an empty table gives no rows. The kept words are joined by one
space. Only doc_id and text are read.
"""

from __future__ import annotations

import hashlib
from typing import Iterator, NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import StructType

from llm import words
from llm.shared import arrow, cut, every_column, group_bounds, quoted, whole_groups

WINDOW = 50
PREFIX = 16
# Words of a partition, at most: a sort of them takes about a hundred bytes a word.
GROUP_WORDS = 1 << 19
# Windows that begin less than this before their anchor share its first PREFIX + HALF - 1 words, the
# others at least as many around its first.
HALF = (WINDOW - PREFIX + 2) // 2
SALTS = 16
_LAST = (1 << 63) - 1


class _Windows(NamedTuple):
    """All windows of a chunk of texts, and the words they are made of."""

    split: words.Words
    hashes: np.ndarray  # of every word
    at: np.ndarray  # first word, counted over the chunk
    doc: np.ndarray
    window: np.ndarray  # hash of all words
    anchor: np.ndarray  # hash of the anchor's words
    place: np.ndarray  # first word of the anchor, counted over the chunk


def _windows(raw: np.ndarray, offsets: np.ndarray) -> _Windows:
    w = words.split(raw, offsets)
    h = words.hash_spans(raw, w.start, w.end)
    if len(h) < WINDOW:
        none = np.zeros(0, np.int64)
        empty = none.view(np.uint64)
        return _Windows(w, h, none, none, empty, empty, none)
    # The leftmost minimum over the prefixes that lie in a window, by doubling.
    low, place = words.ngrams(h, PREFIX), np.arange(len(h))
    span, width = WINDOW - PREFIX + 1, 1
    while width < span:
        by = min(width, span - width)
        other = np.full_like(low, np.iinfo(np.uint64).max)
        other[: len(low) - by] = low[by:]
        less = np.flatnonzero(other < low)
        low, place = np.minimum(low, other), place.copy()
        place[less] = place[less + by]
        width += by
    at = np.flatnonzero(words.whole(w.first, WINDOW))
    return _Windows(w, h, at, words.text_of(w.first)[at], words.ngrams(h, WINDOW)[at], low[at],
                    place[at])


def _anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The distinct anchors of every text, and about how many words their windows hold."""
    for batch in batches:
        for c in words.chunks(batch.column("text")):
            x = _windows(c.raw, c.offsets)
            order = np.lexsort((x.anchor, x.doc))
            doc, anchor, place = x.doc[order], x.anchor[order], x.place[order]
            new = np.ones(len(doc), bool)
            new[1:] = (doc[1:] != doc[:-1]) | (anchor[1:] != anchor[:-1])
            start = np.flatnonzero(new)
            rows = pa.array(c.lo + doc[start])
            held = np.minimum(np.diff(np.append(start, len(doc))), WINDOW) + WINDOW - 1
            yield pa.RecordBatch.from_arrays(
                [batch.column("id").take(rows), batch.column("key").take(rows),
                 pa.array(anchor[start].view(np.int64)), pa.array(held.astype(np.int64))],
                ["id", "key", "anchor", "held"])


def _suffixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Stretches of neighbouring windows with a shared anchor: their partition, whether it is of a
    grown prefix, id and key of the text, first start, number of windows, and word hashes."""
    for batch in batches:
        shared = batch.column("anchors")
        for c in words.chunks(batch.column("text")):
            x = _windows(c.raw, c.offsets)
            bounds = np.searchsorted(x.doc, np.arange(c.hi - c.lo + 1))
            keep = np.zeros(len(x.doc), bool)
            often = np.zeros(len(x.doc), bool)
            for i in range(c.hi - c.lo):
                a, b = bounds[i], bounds[i + 1]
                if a == b:
                    continue
                item = shared[c.lo + i].values
                known = item.field("anchor").to_numpy().view(np.uint64)
                order = np.argsort(known)
                known = known[order]
                place = np.minimum(np.searchsorted(known, x.anchor[a:b]), len(known) - 1)
                flags = item.field("often").to_numpy(zero_copy_only=False)[order]
                often[a:b] = flags[place]
                one = np.unique(x.window[a:b], return_index=True)[1]
                keep[a + one] = (known[place] == x.anchor[a:b])[one]
            rows = np.flatnonzero(keep)
            if not len(rows):
                continue
            at, place, often = x.at[rows], x.place[rows], often[rows]
            late = often & (place - at >= HALF)
            new = np.ones(len(rows), bool)
            new[1:] = ((at[1:] != at[:-1] + 1) | (place[1:] != place[:-1])
                       | (late[1:] != late[:-1]))
            first = np.flatnonzero(new)
            count = np.diff(np.append(first, len(rows)))
            start, place, often, late = at[first], place[first], often[first], late[first]
            group = x.anchor[rows[first]]
            n = PREFIX + HALF - 1
            if often.any():
                longer = words.ngrams(x.hashes, n)
                early, late = np.flatnonzero(often & ~late), np.flatnonzero(late)
                group[early] = words.mix(longer[place[early]])
                group[late] = words.mix(~longer[place[late] - HALF])
            size = count + WINDOW - 1
            end = np.cumsum(size)
            held = np.arange(end[-1]) + np.repeat(start - end + size, size)
            offsets = pa.py_buffer(np.append(0, end * 8).astype(np.int32))
            text = pa.array(c.lo + x.doc[rows[first]])
            yield pa.RecordBatch.from_arrays(
                [pa.array(group.view(np.int64)), pa.array(often), batch.column("id").take(text),
                 batch.column("key").take(text),
                 pa.array((start - x.split.first[x.doc[rows[first]]]).astype(np.int32)),
                 pa.array(count.astype(np.int32)),
                 pa.Array.from_buffers(pa.binary(), len(first),
                                       [None, offsets, pa.py_buffer(x.hashes[held])])],
                ["group", "often", "id", "key", "start", "n", "words"])


def _hashes(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """The word hashes of all stretches, one after the other."""
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks)
    _, where, data = column.buffers()
    offsets = np.frombuffer(where, np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]].copy().view(np.uint64)


def suffix_order(text: np.ndarray, at: np.ndarray, end: np.ndarray, tree: np.ndarray
                 ) -> tuple[np.ndarray, np.ndarray]:
    """The suffixes that start at ``at``, sorted by ``tree`` and their first ``WINDOW`` words, and
    the common prefix length of each with the one before it (at most 63; 0 across trees).
    ``end`` is the end of the suffix's stretch, ``WINDOW`` words on at least."""
    rank, width = np.unique(text, return_inverse=True)[1], 1
    ranks = {}
    while True:
        # Beyond the text nothing is compared; the lengths are cut to the stretch.
        ranks[width] = np.append(rank, np.zeros(64, np.int64))
        if 2 * width > WINDOW:
            break
        key = rank * (len(text) + 1)
        key[: len(text) - width] += rank[width:] + 1
        rank = np.unique(key, return_inverse=True)[1]
        width *= 2
    whole = ranks[width][at] * (len(text) + 1) + ranks[width][at + WINDOW - width]
    order = np.lexsort((whole, tree))
    i, j = at[order[:-1]], at[order[1:]]
    common = np.zeros(len(i), np.int64)
    while width:
        common += width * (ranks[width][i + common] == ranks[width][j + common])
        width //= 2
    left = (end - at)[order]
    common = np.minimum(common, np.minimum(left[:-1], left[1:]))
    common[tree[order[1:]] != tree[order[:-1]]] = 0
    return order, np.append(0, common)[: len(order)]


def _subtrees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Maximal repeats of the partitions: id, key, first start and number of the windows below a
    deep node that its owner does not hold."""
    for table in _bounded(whole_groups(batches, ["group"])):
        count = table.column("n").to_numpy().astype(np.int64)
        size = count + WINDOW - 1
        end = np.cumsum(size)
        text = _hashes(table.column("words"))
        group = table.column("group").to_numpy()
        tree = np.append(0, np.cumsum(group[1:] != group[:-1]))
        item = np.repeat(np.arange(len(count)), count)
        step = np.arange(len(item)) - np.repeat(np.cumsum(count) - count, count)
        order, common = suffix_order(text, (end - size)[item] + step, end[item], tree[item])
        ids = table.column("id").to_numpy()[item]
        node = np.flatnonzero(common < WINDOW)
        owner = np.minimum.reduceat(ids[order], node) if len(node) else ids[:0]
        found = np.zeros(len(item), bool)
        found[order] = ids[order] > np.repeat(owner, np.diff(np.append(node, len(order))))
        rows = np.flatnonzero(found)
        new = np.ones(len(rows), bool)
        new[1:] = (rows[1:] != rows[:-1] + 1) | (item[rows[1:]] != item[rows[:-1]])
        first = np.flatnonzero(new)
        one = rows[first]
        start = table.column("start").to_numpy()[item[one]] + step[one]
        yield pa.RecordBatch.from_arrays(
            [pa.array(ids[one]), pa.array(table.column("key").to_numpy()[item[one]]),
             pa.array(start.astype(np.int32)),
             pa.array(np.diff(np.append(first, len(rows))).astype(np.int32))],
            ["id", "key", "start", "n"])


def _bounded(tables: Iterator[pa.Table]) -> Iterator[pa.Table]:
    """The tables, small ones together, large ones in parts of whole groups."""
    for table in tables:
        bounds = group_bounds(table, ["group"])
        size = np.append(0, np.cumsum(table.column("n").to_numpy().astype(np.int64) + WINDOW - 1))
        a = 0
        while a < table.num_rows:
            fits = bounds[np.searchsorted(size[bounds], size[a] + GROUP_WORDS, "right") - 1]
            b = int(fits) if fits > a else int(bounds[np.searchsorted(bounds, a, "right")])
            yield table.slice(a, b - a).combine_chunks()
            a = b


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The windows of stretches, one by one: hash of all words, id, key, start."""
    for batch in batches:
        count = batch.column("n").to_numpy().astype(np.int64)
        end = np.cumsum(count + WINDOW - 1)
        h = words.ngrams(_hashes(batch.column("words")), WINDOW)
        item = np.repeat(np.arange(len(count)), count)
        step = np.arange(len(item)) - np.repeat(np.cumsum(count) - count, count)
        at = (end - count - WINDOW + 1)[item] + step
        rows = pa.array(item)
        yield pa.RecordBatch.from_arrays(
            [pa.array(h[at].view(np.int64)), batch.column("id").take(rows),
             batch.column("key").take(rows),
             pa.array((batch.column("start").to_numpy()[item] + step).astype(np.int32))],
            ["window", "id", "key", "start"])


def repeats(docs: DataFrame) -> DataFrame:
    """(id, k1, k2, starts) for the first document of every text: the starts of its windows that
    an earlier document has, as (start, n) of neighbours (null: none; a window that it repeats is
    named once). ``docs`` has id, k1, k2 (key of the text) and text."""
    owners = docs.groupBy("k1", "k2").agg(F.min("id").alias("id"))
    keyed = docs.withColumn("key", F.col("k1"))
    first = owners.withColumn("key", F.col("k1"))
    # Only the first of equal texts, and rows that repeat its id and text once.
    anchors = arrow(keyed.select("id", "key", "text"), _anchors,
                    "id bigint, key bigint, anchor bigint, held bigint")
    anchors = cut(anchors.join(first.select("id", "key"), ["id", "key"], "left_semi").groupBy(
        "id", "key", "anchor").agg(F.max("held").alias("held")), "anchors")
    shared = anchors.groupBy("anchor").agg(
        F.min("key").alias("_a"), F.max("key").alias("_b"), F.sum("held").alias("_n")
    ).where("_a < _b").select("anchor", (F.col("_n") > GROUP_WORDS).alias("often"))
    # At most as many as the text has anchors.
    per_doc = anchors.join(shared, "anchor").groupBy("id", "key").agg(
        F.collect_list(F.struct("anchor", "often")).alias("anchors"))
    texts = keyed.join(per_doc.join(first, ["id", "key"]), ["id", "k1", "k2", "key"])
    suffixes = cut(arrow(
        texts.dropDuplicates(["id", "k1", "k2", "key"]).select("id", "key", "text", "anchors"),
        _suffixes, "group bigint, often boolean, id bigint, key bigint, start int, n int, "
                   "words binary"), "suffixes")
    stretch = ["group", "id", "key", "start", "n", "words"]
    every = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt")
    salt = F.pmod(F.xxhash64("id", "key"), F.lit(SALTS)).cast("int")
    # Partitions that even the longer prefix leaves too large.
    large = suffixes.where("often").groupBy("group").agg(
        F.sum(F.col("n") + F.lit(WINDOW - 1)).alias("_n")).where(F.col("_n") > GROUP_WORDS)
    large = large.select("group", F.lit(True).alias("_large"), every)
    grown = suffixes.where("often").withColumn("_salt", salt).join(
        large, ["group", "_salt"], "left")
    trees = suffixes.where(~F.col("often")).select(*stretch).union(
        grown.where(F.col("_large").isNull()).select(*stretch))
    walked = arrow(trees.repartition("group").sortWithinPartitions("group"), _subtrees,
                   "id bigint, key bigint, start int, n int")
    whole = cut(arrow(grown.where("_large").select(*stretch), _whole,
                      "window bigint, id bigint, key bigint, start int"), "windows")
    owner = whole.groupBy("window").agg(F.min("id").alias("owner"), F.max("id").alias("_b")).where(
        "owner < _b").select("window", "owner", every)
    met = whole.withColumn("_salt", salt).join(
        owner, ["window", "_salt"]).where(F.col("id") > F.col("owner"))
    found = walked.union(met.select("id", "key", "start", F.lit(1).alias("n"))).groupBy(
        "id", "key").agg(F.collect_set(F.struct("start", "n")).alias("starts"))
    return first.join(found, ["id", "key"], "left").drop("key")


def _covered(found: np.ndarray, window: np.ndarray, n: int) -> np.ndarray:
    """Words in a window whose hash is that of one of the windows at ``found``."""
    known = np.sort(window[found])
    place = np.minimum(np.searchsorted(known, window), len(known) - 1)
    starts = np.flatnonzero(known[place] == window)
    edge = np.zeros(n + 1, np.int64)
    edge[starts] += 1
    edge[starts + WINDOW] -= 1
    return np.cumsum(edge[:n]) > 0


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """n_words, n_removed and the kept words joined by one space, next to ``doc``."""
    for batch in batches:
        starts, first = batch.column("starts"), batch.column("first").to_numpy(False)
        for c in words.chunks(batch.column("text")):
            x = _windows(c.raw, c.offsets)
            w, doc, window = x.split, x.doc, x.window
            bounds = np.searchsorted(doc, np.arange(c.hi - c.lo + 1))
            data = c.raw.tobytes()
            total, gone, texts = [], [], []
            for i in range(c.hi - c.lo):
                a, b = w.first[i], w.first[i + 1]
                drop = np.full(b - a, not first[c.lo + i] and b - a >= WINDOW)
                if starts[c.lo + i].is_valid:
                    part = starts[c.lo + i].values
                    n = part.field("n").to_numpy()
                    at = np.repeat(part.field("start").to_numpy() - np.cumsum(n) + n, n)
                    drop = _covered(at + np.arange(len(at)),
                                    window[bounds[i] : bounds[i + 1]], b - a)
                total.append(b - a)
                gone.append(int(drop.sum()))
                texts.append(b" ".join([data[x:y] for x, y in zip(
                    w.start[a:b][~drop].tolist(), w.end[a:b][~drop].tolist())]))
            rows = pa.array(np.arange(c.lo, c.hi))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc").take(rows), pa.array(total, pa.int64()),
                 pa.array(gone, pa.int64()), pa.array(texts, pa.binary()).cast(pa.string())],
                ["doc", "n_words", "n_removed", "kept"])


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in _kept(batches):
        sha = [hashlib.sha256(t.as_buffer() or b"").hexdigest() for t in batch.column("kept")]
        yield pa.RecordBatch.from_arrays(
            [*batch.columns[:3], pa.array(sha)], ["doc", "n_words", "n_removed", "kept_sha256"])


def remove(docs: DataFrame, carry: list[str | Column] | None = None, digest: bool = False
           ) -> DataFrame:
    """doc (struct of the ``carry`` columns), n_words, n_removed, and the kept text (``kept``) or
    its SHA-256 (``kept_sha256``) of every document."""
    carry = carry or ["doc_id"]
    rows = docs.select(
        F.coalesce(F.col("doc_id").cast("bigint"), F.lit(_LAST)).alias("id"),
        F.xxhash64("text").alias("k1"), F.xxhash64(F.lit("second"), "text").alias("k2"),
        F.col("text"), F.struct(*carry).alias("doc"))
    found = repeats(rows.select("id", "k1", "k2", "text")).withColumn("first", F.lit(True))
    # A text that is carried anyway is moved once.
    carried = "text" in rows.schema["doc"].dataType.names
    own = rows.drop("text") if carried else rows
    joined = own.join(found, ["id", "k1", "k2"], "left").select(
        "doc", F.col("doc.text" if carried else "text").alias("text"), "starts",
        F.coalesce("first", F.lit(False)).alias("first"))
    last = "kept_sha256" if digest else "kept"
    out = StructType().add(rows.schema["doc"]).add("n_words", "long").add("n_removed", "long")
    return arrow(joined, _digest if digest else _kept, out.add(last, "string"))


def clean(docs: DataFrame) -> DataFrame:
    """The documents without their repeated words. A text that loses none stays as it is; every
    row and column stays; n_chars, where there is one, follows the text."""
    found = remove(docs, every_column(docs))
    text = F.when(F.col("n_removed") > 0, F.col("kept")).otherwise(F.col("doc.text"))
    new = {"text": text, "n_chars": F.when(F.col("n_removed") > 0, F.length("kept").cast(
        dict(docs.dtypes).get("n_chars", "bigint"))).otherwise(F.col("doc.n_chars"))
        if "n_chars" in docs.columns else None}
    return found.select(*(
        new[c].alias(c) if c in new else F.col(f"doc.{quoted(c)}") for c in docs.columns))
