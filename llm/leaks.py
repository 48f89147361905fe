"""Benchmark decontamination with suffix arrays of the training texts.

A window is ``WINDOW`` consecutive words of a benchmark item; an item of fewer words is one window.
A document word inside any occurrence of a window is hit.

1. *Shards.* Texts are cut into shards of about ``SHARD_BYTES``. A shard's words are numbered and
   its suffixes sorted: first by the words that fit a 64-bit key, then by prefix doubling among
   those still equal, to the depth of the longest item.
2. *Search.* Every suffix of every item is searched in the shard by binary search: by the packed
   key, then word by word inside the interval found, as long as it is not empty. The last interval
   that is not empty is the longest verbatim match, its suffixes are the locations; the interval
   at the window's length is all its occurrences.
3. *Removal.* Occurrences become spans of the documents; :func:`clean` keeps documents without.

The items are dealt into blocks of at most about ``BLOCK_BYTES``. One block at a time is read by the
driver and broadcast, and each is one pass over the documents, so neither the driver nor a task
ever holds more of the benchmark than a block; nothing of the documents is shuffled or collected.
Words are compared by 64-bit hashes.

Defined results: a null or empty text has no words and no hits; null and empty items, and equal
rows of the benchmark, add nothing; an item without an id is named by the empty string; equal item
ids count once; equal documents are rows of their own; either table may be empty; other columns may
have any names.
"""

from __future__ import annotations

from functools import partial
from typing import Iterator, NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import StructType

from llm import words
from llm.shared import arrow, cut, slice_of
from llm.suffixes import doubled, following

WINDOW = 10
SHARD_BYTES = 8 << 20
BLOCK_BYTES = 32 << 20

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_GAP = np.ones(256, bool)
_GAP[48:58] = _GAP[97:123] = _GAP[128:] = False

_FOUND = "n_words bigint, spans array<struct<start:bigint,end:bigint>>, items array<string>"
_MATCH = "item_id string, item_start bigint, length bigint, doc_start bigint"


class Items(NamedTuple):
    """A block of the benchmark: word hashes of its different texts, the first word of each, and
    the ids of the items that have it."""

    hashes: np.ndarray
    first: np.ndarray
    names: list[list[str]]


def _words(c: words.Chunk) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of a chunk and the first word of each text."""
    raw = _LOWER[c.raw]
    w = words.split(raw, c.offsets, _GAP)
    return words.hash_spans(raw, w.start, w.end), w.first


def _block(rows: pa.Table) -> Items:
    seen: dict[bytes, list[str]] = {}
    names = rows.column("item_id").to_pylist()
    for c in words.chunks(rows.column("text"), BLOCK_BYTES):
        h, first = _words(c)
        for i in range(c.hi - c.lo):
            if first[i] < first[i + 1]:
                seen.setdefault(h[first[i] : first[i + 1]].tobytes(), []).append(names[c.lo + i])
    size = [len(k) // 8 for k in seen]
    return Items(np.frombuffer(b"".join(seen), np.uint64),
                 np.concatenate([[0], np.cumsum(size)]).astype(np.int64), list(seen.values()))


def _rows(bench: DataFrame) -> DataFrame:
    return bench.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"),
                        F.coalesce("text", F.lit("")).alias("text")).distinct()


def block_count(bench: DataFrame) -> int:
    """Number of blocks; one at least."""
    size = _rows(bench).agg(
        F.sum(F.octet_length("text") + F.octet_length("item_id") + 16)).first()[0]
    return -(-(size or 1) // BLOCK_BYTES)


def block(bench: DataFrame, k: int, n: int) -> Items:
    """Block ``k`` of ``n`` of the benchmark."""
    rows = _rows(bench)
    return _block(rows.where(slice_of(F.struct("item_id", "text"), n) == k).toArrow())


class _Shard:
    """The suffix array of some texts."""

    def __init__(self, h: np.ndarray, first: np.ndarray, depth: int):
        self.vocabulary, ids = np.unique(h, return_inverse=True)
        self.ids, self.first = ids + 1, first
        self.end = np.repeat(first[1:], np.diff(first))
        # As many words as fit the bits of a key.
        self.bits = max(1, int(len(self.vocabulary) + 1).bit_length())
        self.packed = min(3, 62 // self.bits)
        key, word = np.zeros(len(h), np.int64), self.ids
        for k in range(self.packed):
            key = key << self.bits | word
            word = following(word, first) if k + 1 < self.packed else word
        rank = np.zeros(0, np.int64)
        for width, rank in doubled(key, self.end, self.packed):
            if width >= depth:
                break
        self.order = np.argsort(rank)
        self.key = key[self.order]

    def numbers(self, hashes: np.ndarray) -> np.ndarray:
        """The shard's numbers of words; -1 for a word that it does not have."""
        place = np.minimum(np.searchsorted(self.vocabulary, hashes), len(self.vocabulary) - 1)
        return np.where(self.vocabulary[place] == hashes, place + 1, -1)

    def _bound(self, lo: np.ndarray, hi: np.ndarray, at: int, word: np.ndarray) -> np.ndarray:
        """First slot of each interval whose suffix has ``word`` or a greater one at ``at``."""
        lo, hi = lo.copy(), hi.copy()
        open_ = np.flatnonzero(lo < hi)
        while len(open_):
            mid = (lo[open_] + hi[open_]) // 2
            where = self.order[mid]
            inside = where + at < self.end[where]
            less = np.where(inside, self.ids[np.where(inside, where + at, 0)], 0) < word[open_]
            lo[open_[less]] = mid[less] + 1
            hi[open_[~less]] = mid[~less]
            open_ = open_[lo[open_] < hi[open_]]
        return lo

    def search(self, ids: np.ndarray, at: np.ndarray, left: np.ndarray, need: np.ndarray):
        """For the suffixes of ``ids`` at ``at`` with ``left`` words: the length and the interval
        of the longest match, and the interval at ``need`` words."""
        some = np.minimum(left, self.packed)
        key, known = np.zeros(len(at), np.int64), np.ones(len(at), bool)
        for k in range(self.packed):
            word = ids[np.minimum(at + k, len(ids) - 1)]
            known &= (word > 0) | (k >= some)
            key = key << self.bits | np.where(k < some, word, 0)
        lo = np.searchsorted(self.key, key)
        hi = np.searchsorted(self.key, key + (1 << self.bits * (self.packed - some)))
        hi = np.where(known, hi, lo)
        # Suffixes that do not even have the packed words are left out: a window is as long.
        length = np.where(lo < hi, some, 0)
        window = np.stack([lo, np.where(need <= some, hi, lo)])
        live, depth = np.flatnonzero((lo < hi) & (left > self.packed)), self.packed
        while len(live):
            word = ids[at[live] + depth]
            a = self._bound(lo[live], hi[live], depth, word)
            b = self._bound(a, hi[live], depth, word + 1)
            depth += 1
            more = (a < b) & (word > 0)
            live, a, b = live[more], a[more], b[more]
            lo[live], hi[live], length[live] = a, b, depth
            exact = need[live] == depth
            window[:, live[exact]] = a[exact], b[exact]
            live = live[left[live] > depth]
        return length, lo, hi, window


def _spread(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of the intervals, and the interval of each."""
    size = hi - lo
    which = np.repeat(np.arange(len(lo)), size)
    return np.arange(len(which)) - np.repeat(np.cumsum(size) - size, size) + lo[which], which


class _Searched:
    """All suffixes of a block that hold a window, searched in a shard."""

    def __init__(self, h: np.ndarray, first: np.ndarray, items: Items):
        size = np.diff(items.first)
        item = words.text_of(items.first)
        at = np.arange(len(item))
        left, need = items.first[1:][item] - at, np.minimum(size, WINDOW)[item]
        self.at = np.flatnonzero(left >= need)
        self.item, self.need = item[self.at], need[self.at]
        self.shard = _Shard(h, first, int(size.max(initial=0)))
        found = self.shard.search(self.shard.numbers(items.hashes), self.at, left[self.at],
                                  self.need)
        self.length, self.lo, self.hi, (self.window_lo, self.window_hi) = found

    def hits(self) -> tuple[np.ndarray, dict[int, np.ndarray]]:
        """Steps of the number of occurrences that cover each word of the shard, and the numbers
        of the items of each text that has any."""
        first, order = self.shard.first, self.shard.order
        edge = np.zeros(len(order) + 1, np.int64)
        found = np.flatnonzero(self.window_lo < self.window_hi)
        if not len(found):
            return edge, {}
        # Equal windows have one interval; its occurrences are taken once.
        _, one, inverse = np.unique(
            self.window_lo[found] * (WINDOW + 1) + self.need[found], return_index=True,
            return_inverse=True)
        lo, hi, need = (x[found[one]] for x in (self.window_lo, self.window_hi, self.need))
        slot, which = _spread(lo, hi)
        where = order[slot]
        np.add.at(edge, where, 1)
        np.add.at(edge, where + need[which], -1)
        doc = np.searchsorted(first, where, "right") - 1
        pairs = np.unique(doc * len(one) + which)
        doc, which = pairs // len(one), pairs % len(one)
        # The items of each window.
        by = np.argsort(inverse, kind="stable")
        item, bounds = self.item[found][by], np.searchsorted(inverse[by], np.arange(len(one) + 1))
        cuts = np.flatnonzero(np.diff(doc, prepend=-1, append=-1))
        return edge, {
            int(doc[a]): np.unique(item[_spread(bounds[which[a:b]], bounds[which[a:b] + 1])[0]])
            for a, b in zip(cuts[:-1], cuts[1:])}


def _spans(edge: np.ndarray, first: np.ndarray) -> pa.ListArray:
    """The stretches of covered words of each text; a stretch ends with its text."""
    hit = np.zeros(len(edge) + 1, np.int8)
    hit[1:-1] = np.cumsum(edge[:-1]) > 0
    step = np.diff(hit)
    border = np.unique(first[(first > 0) & (first < len(edge) - 1)])
    border = border[(hit[border] == 1) & (hit[border + 1] == 1)]
    start = np.sort(np.concatenate([np.flatnonzero(step == 1), border]))
    end = np.sort(np.concatenate([np.flatnonzero(step == -1), border]))
    text = np.searchsorted(first, start, "right") - 1
    spans = pa.StructArray.from_arrays(
        [pa.array(start - first[text]), pa.array(end - first[text])], ["start", "end"])
    per = np.searchsorted(text, np.arange(len(first))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(per), spans)


def _find(batches: Iterator[pa.RecordBatch], block, shard: int,
          last: bool) -> Iterator[pa.RecordBatch]:
    items = block.value
    for batch in batches:
        for c in words.chunks(batch.column("text"), shard):
            source = batch.slice(c.lo, c.hi - c.lo)
            h, first = _words(c)
            edge, found = np.zeros(len(h) + 1, np.int64), {}
            if len(h) and items.names:
                edge, found = _Searched(h, first, items).hits()
            names: list = [[]] * (c.hi - c.lo)
            if source.column("items").null_count < len(names):  # what earlier blocks found
                names = source.column("items").to_pylist()
                for i, spans in enumerate(source.column("spans").to_pylist()):
                    for span in spans:
                        edge[first[i] + span["start"]] += 1
                        edge[first[i] + span["end"]] -= 1
            for i, new in found.items():
                names[i] = sorted({n for u in new for n in items.names[u]}.union(names[i]))
            out = [source.column("doc"), source.column("text"), pa.array(np.diff(first)),
                   _spans(edge, first), pa.array(names, pa.list_(pa.string()))]
            kept = ["doc", "text", "n_words", "spans", "items"]
            if last:
                del out[1], kept[1]
            yield pa.RecordBatch.from_arrays(out, kept)


def find(docs: DataFrame, bench: DataFrame, carry: list[str] | None = None,
         shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """doc (struct of the ``carry`` columns), n_words, spans (start and end of the stretches of
    hit words) and items (sorted ids of the items with windows that occur) of every document."""
    spark = docs.sparkSession
    out = docs.select(
        F.struct(*(F.col(f"`{c}`") for c in carry or ["doc_id"])).alias("doc"), F.col("text"))
    added = StructType.fromDDL(_FOUND)
    schema = StructType([*out.schema, *added])
    out = out.select("*", *(F.lit(None).cast(f.dataType).alias(f.name) for f in added))
    made = block_count(bench)
    for k in range(made):
        value, last = spark.sparkContext.broadcast(block(bench, k, made)), k + 1 == made
        out = arrow(cut(out, "leaks") if k else out,
                    partial(_find, block=value, shard=shard_bytes, last=last),
                    StructType([f for f in schema if not last or f.name != "text"]))
    return out


def _longest(batches: Iterator[pa.RecordBatch], block) -> Iterator[pa.RecordBatch]:
    items = block.value
    for batch in batches:
        for c in words.chunks(batch.column("text"), SHARD_BYTES):
            h, first = _words(c)
            if not len(h) or not items.names:
                continue
            s = _Searched(h, first, items)
            one = np.flatnonzero(s.length >= s.need)
            where = s.shard.order[s.lo[one]]
            text = np.searchsorted(first, where, "right") - 1
            times = np.array([len(items.names[u]) for u in s.item[one]], np.int64)
            row = np.repeat(np.arange(len(one)), times)
            names = [n for u in s.item[one] for n in items.names[u]]
            yield pa.RecordBatch.from_arrays(
                [pa.array(names, pa.string()),
                 pa.array((s.at[one] - items.first[s.item[one]])[row]),
                 pa.array(s.length[one][row]), pa.array((where - first[text])[row]),
                 batch.column("doc_id").take(pa.array((c.lo + text)[row]))],
                ["item_id", "item_start", "length", "doc_start", "doc_id"])


def longest(docs: DataFrame, bench: DataFrame) -> DataFrame:
    """The longest verbatim match of every item suffix that matches a window at least: item_id,
    item_start, length in words, and one place of it, doc_id and doc_start."""
    rows = docs.select("doc_id", "text")
    schema = StructType([*StructType.fromDDL(_MATCH), rows.schema["doc_id"]])
    made, out = block_count(bench), None
    for k in range(made):
        value = docs.sparkSession.sparkContext.broadcast(block(bench, k, made))
        found = arrow(rows, partial(_longest, block=value), schema)
        out = found if out is None else out.union(found)
    best = F.max_by(F.struct("length", "doc_id", "doc_start"),
                    F.struct("length", F.xxhash64("doc_id", "doc_start").alias("tie")))
    return out.groupBy("item_id", "item_start").agg(best.alias("m")).select(
        "item_id", "item_start", "m.*")


def clean(docs: DataFrame, bench: DataFrame) -> DataFrame:
    """The documents in which no window occurs, with all their columns."""
    return find(docs, bench, docs.columns).where(F.size("spans") == 0).select("doc.*")


def report(found: DataFrame) -> DataFrame:
    """Counts and a digest per document, from :func:`find`."""
    hit = F.aggregate("spans", F.lit(0).cast("bigint"), lambda n, s: n + s["end"] - s["start"])
    return found.select(
        "doc.*", "n_words", hit.alias("n_hit"), F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.size("spans") > 0).alias("contaminated"))


_AZ = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
SQL = rf"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(
    translate(coalesce(text, ''), {_AZ}), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
b AS (
  SELECT DISTINCT coalesce(CAST(item_id AS VARCHAR), '') AS item_id, regexp_extract_all(
    translate(coalesce(text, ''), {_AZ}), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
windows AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n,
    array_to_string(list_slice(w, i, i + least(len(w), 10) - 1), ' ') AS window_text
  FROM (SELECT *, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM b WHERE len(w) > 0)),
places AS (
  SELECT rid, i, n, array_to_string(list_slice(w, i, i + n - 1), ' ') AS window_text
  FROM (SELECT rid, w, n, unnest(range(1, len(w) - n + 2)) AS i
        FROM d, (SELECT DISTINCT n FROM windows) WHERE len(w) >= n)),
met AS (
  SELECT rid, i, n, window_text FROM places
  SEMI JOIN windows USING (n, window_text)),
hit AS (
  SELECT rid, count(*) AS n_hit FROM (
    SELECT DISTINCT rid, unnest(range(i, i + n)) AS pos FROM met) GROUP BY rid),
held AS (
  SELECT rid, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS names FROM (
    SELECT DISTINCT rid, item_id FROM met JOIN windows USING (n, window_text)) GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit,
  coalesce(n_items, 0) AS n_items, sha256(coalesce(names, '')) AS items_sha256,
  n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN hit USING (rid) LEFT JOIN held USING (rid)
"""
