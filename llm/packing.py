"""Packing documents into sequences of bounded length, by linear grouping.

The plan depends on the lengths only, of which there are at most ``capacity``, so it is made from
a histogram: however many pieces there are, the driver sees one count per length.

1. Pieces longer than ``capacity / 8`` are large. They are sorted, cut into groups of equal
   cardinality, and every length is rounded up to the largest of its group.
2. The configuration program over the few rounded sizes (how many sequences hold which
   multiset of sizes) is optimised by column generation; whole multiples are used.
3. The places of a configuration take actual pieces of their group, longest first.
4. What is left, large pieces beyond the whole multiples and then the small ones, goes best-fit
   by decreasing length into the free space and, where nothing fits, into new sequences.

The plan is a list of runs: "pieces number a..b of this length go to sequences s, s+1, ...". Pieces
are numbered within their length in slices, so a length shared by a third of all pieces is not
ranked in one task.

Defined results: a null text is empty and holds only the closing id; every document has a piece,
so none is lost; equal rows are packed one by one; an empty table gives no rows. Only the columns
doc_id and text are read.
"""

from __future__ import annotations

import functools
import json
import os
import zlib
from typing import Iterator, NamedTuple, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from llm import words
from llm.shared import arrow, cut, slice_of

CAPACITY = 2048
TOKENIZER = "word_bpe_49k.json"
END = 0
SEPARATOR = " <|endoftext|> "
SLICES = 1024
# Numbers of rounded sizes of the configuration program; the plan with the fewest sequences wins.
GROUPS = (32, 96)
# Distinct words a Python worker remembers; forgotten words are encoded again.
REMEMBERED = 1_500_000


# Kinds of bytes. Letters, digits and symbols are plain; all else is not, nor is an apostrophe, which
# begins contractions.
_OTHER, _LETTERS, _DIGIT, _SYMBOL, _GAP = range(5)
_KIND = np.full(256, _OTHER, np.uint8)
_KIND[33:127] = _SYMBOL
_KIND[[*range(65, 91), *range(97, 123)]] = _LETTERS
_KIND[48:58] = _DIGIT
_KIND[ord("'")] = _OTHER
_KIND[words._SPACE] = _GAP
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
# The characters by which a byte-level tokenizer names the bytes of lower-case plain words, where
# they are not those of Latin 1.
_BYTES = {0x9F: 321, 0xA0: 322, 0xAD: 323}
# What a tokenizer has to do with a text for its plain words to be cut into parts.
_NORMALIZER = {"type": "Sequence", "normalizers": [
    {"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "},
    {"type": "Lowercase"}]}
_PRE_TOKENIZER = {"type": "Sequence", "pretokenizers": [
    {"type": "Split", "behavior": "Removed", "invert": True, "pattern": {
        "Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}},
    {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]}


class _Parts(NamedTuple):
    """The bytes that are encoded, the spans of the parts, the number of the first part of each
    text, and whether each part is plain."""

    raw: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray
    plain: np.ndarray


def _whole_words(raw: np.ndarray, w: words.Words) -> _Parts:
    return _Parts(raw, w.start, w.end, w.first, np.zeros(len(w.start), bool))


def _plain_parts(raw: np.ndarray, w: words.Words) -> _Parts:
    """Words of plain characters (ASCII, and letters of Latin 1) in lower case, cut into letters,
    single digits and symbols; other words are whole and unchanged.

    A plain word has nothing to compose, each of its characters has a lower case of its own, and
    the tokenizer's pattern splits it at these places, so its ids are those of its parts."""
    if not len(w.start):
        return _whole_words(raw, w)
    kind, text = _KIND[raw], _LOWER[raw]
    second = np.flatnonzero(raw[:-1] == 0xC3) + 1
    second = second[(raw[second] != 0x97) & (raw[second] != 0xB7)]  # the signs for times and divide
    kind[second - 1] = kind[second] = _LETTERS
    text[second[raw[second] < 0x9F]] += 32
    special = np.flatnonzero((raw[:-1] == ord("<")) & (raw[1:] == ord("|")))
    kind[special] = _OTHER
    odd = np.unique(np.searchsorted(w.start, np.flatnonzero(kind == _OTHER), "right") - 1)
    if len(odd):
        inside = np.zeros(len(raw) + 1, np.int8)
        inside[w.start[odd]] = 1
        inside[w.end[odd]] -= 1
        inside = np.cumsum(inside[:-1], dtype=np.int8).astype(bool)
        text[inside], kind[inside] = raw[inside], _OTHER
    begins = np.zeros(len(raw), bool)
    begins[w.start] = True
    edge = begins.copy()
    edge[1:] |= (kind[1:] != kind[:-1]) | (kind[1:] == _DIGIT)
    start = np.flatnonzero(edge & (kind != _GAP))
    opens = begins[start]
    end = np.minimum(np.append(start[1:], len(raw)), w.end[np.cumsum(opens) - 1])
    first = np.append(np.flatnonzero(opens), len(start))[w.first]
    return _Parts(text, start, end, first, kind[start] != _OTHER)


class _Encoder:
    """Token ids of words. The tokenizer drops white space and treats the words between it
    independently, so a text's ids are its words' ids in order. If the tokenizer is known to treat
    the parts of plain words independently too, these are remembered: words differ far more often
    than their parts, and parts need no normalizing."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.separator = self.tokenizer.token_to_id(SEPARATOR.strip())
        with open(path, encoding="utf-8") as f:
            known = json.load(f)
        same = (known["normalizer"], known["pre_tokenizer"]) == (_NORMALIZER, _PRE_TOKENIZER)
        self.parts = _plain_parts if same else _whole_words
        self.plain = Tokenizer(self.tokenizer.model)
        self.plain.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        self._forget()

    def _forget(self) -> None:
        self.keys = np.zeros(0, np.uint64)
        self.at = np.zeros(0, np.int64)
        self.n = np.zeros(0, np.int64)
        self.pool = np.zeros(1 << 20, np.uint32)
        self.used = 0

    def _encode_plain(self, parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of plain parts, and how many each has."""
        found = self.plain.encode(
            b" ".join(parts).decode("latin-1").translate(_BYTES), add_special_tokens=False)
        return np.array(found.ids, np.uint32), np.bincount(found.word_ids, minlength=len(parts))

    def _encode_words(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of words without special tokens, encoded with one between them."""
        joined = np.array(self.tokenizer.encode(
            SEPARATOR + SEPARATOR.join(texts), add_special_tokens=False).ids, np.uint32)
        cuts = np.flatnonzero(joined == self.separator)
        return np.delete(joined, cuts), np.diff(np.append(cuts, len(joined))) - 1

    def _encode_one(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        return np.array(ids, np.uint32), np.array([len(ids)])

    def _learn(self, keys: np.ndarray, parts: list[bytes], plain: np.ndarray) -> None:
        if len(self.keys) + len(keys) > REMEMBERED:
            self._forget()
        # Some thousand parts at once; a word that may hold special tokens is encoded alone.
        special = np.array([b"<|" in p for p in parts], bool) & ~plain
        n = np.zeros(len(parts), np.int64)
        at = np.zeros(len(parts), np.int64)
        for which, size, encode in ((plain, 2000, self._encode_plain),
                                    (~plain & ~special, 2000, self._encode_words),
                                    (special, 1, self._encode_one)):
            rows = np.flatnonzero(which)
            for lo in range(0, len(rows), size):
                some = rows[lo : lo + size]
                given = [parts[i] for i in some]
                if encode != self._encode_plain:
                    given = [p.decode("utf-8", "replace") for p in given]
                ids, n[some] = encode(given[0] if size == 1 else given)
                at[some] = self.used + np.cumsum(n[some]) - n[some]
                while self.used + len(ids) > len(self.pool):
                    self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
                self.pool[self.used : self.used + len(ids)] = ids
                self.used += len(ids)
        place = np.searchsorted(self.keys, keys)
        self.keys = np.insert(self.keys, place, keys)
        self.at, self.n = np.insert(self.at, place, at), np.insert(self.n, place, n)

    def encode(self, chunk: words.Chunk) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the chunk's texts, each text closed by END, and the bounds of the texts."""
        p = self.parts(chunk.raw, words.split(chunk.raw, chunk.offsets))
        h = words.hash_spans(p.raw, p.start, p.end)
        keys, one, inverse = np.unique(h, return_index=True, return_inverse=True)
        for learnt in range(2):
            where = np.searchsorted(self.keys, keys)
            known = np.zeros(len(keys), bool)
            inside = where < len(self.keys)
            known[inside] = self.keys[where[inside]] == keys[inside]
            if known.all():
                break
            # After forgetting, the words that were known are missing as well.
            new = np.flatnonzero(~known)
            if len(self.keys) + len(new) > REMEMBERED:
                self._forget()
                new = np.arange(len(keys))
            data, one_new = p.raw.tobytes(), one[new]
            self._learn(keys[new], [data[a:b] for a, b in zip(p.start[one_new], p.end[one_new])],
                        p.plain[one_new])
        n = self.n[where][inverse]
        docs = len(chunk.offsets) - 1
        before = np.concatenate([[0], np.cumsum(n)])
        bounds = before[p.first] + np.arange(docs + 1)
        ids = np.full(int(bounds[-1]), END, np.uint32)
        body = np.ones(len(ids), bool)
        body[bounds[1:] - 1] = False
        ids[body] = self.pool[np.repeat(self.at[where][inverse] - before[:-1], n)
                              + np.arange(before[-1])]
        return ids, bounds


@functools.lru_cache(2)
def _encoder(path: str) -> _Encoder:
    return _Encoder(path)


def pieces(docs: DataFrame, capacity: int = CAPACITY, path: str | None = None,
           with_ids: bool = False, store: str = "<u4") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every piece of every document's ids (and the
    ``ids`` as little-endian unsigned integers of type ``store``)."""
    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path is None:
            import public_tokenizers

            encoder = _encoder(str(public_tokenizers.path(TOKENIZER)))
        else:
            encoder = _encoder(path)
        for batch in batches:
            for chunk in words.chunks(batch.column("text")):
                ids, bounds = encoder.encode(chunk)
                size = np.diff(bounds)
                n = -(-size // capacity)
                doc = np.repeat(np.arange(chunk.lo, chunk.hi), n)
                piece = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
                start = piece * capacity
                length = np.minimum(capacity, np.repeat(size, n) - start)
                at = np.repeat(bounds[:-1], n) + start
                data = ids.astype(store, copy=False)
                parts = [data[a : a + k] for a, k in zip(at, length)]
                columns = [
                    batch.column("doc_id").take(pa.array(doc)), pa.array(piece, pa.int32()),
                    pa.array(start, pa.int64()), pa.array(length, pa.int64()),
                    pa.array([zlib.crc32(p) for p in parts], pa.int64()),
                ]
                names = ["doc_id", "piece", "start", "length", "ids_crc32"]
                if with_ids:
                    columns.append(pa.array([p.tobytes() for p in parts], pa.binary()))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names)

    schema = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return arrow(docs, cut_up, schema + (", ids binary" if with_ids else ""))


def _best_configuration(value: np.ndarray, size: np.ndarray, capacity: int) -> np.ndarray:
    """The multiset of sizes of the largest total value that fits. All sizes exceed
    ``capacity / 8``, so it has at most seven: one round of the knapsack for each."""
    best, picks = np.zeros(capacity + 1), []
    for _ in range(capacity // int(size.min())):
        new, pick = best.copy(), np.full(capacity + 1, -1)
        for k, c in enumerate(size):
            gain = best[: capacity + 1 - c] + value[k]
            better = gain > new[c:] + 1e-12
            new[c:][better], pick[c:][better] = gain[better], k
        best = new
        picks.append(pick)
    out, c = np.zeros(len(size)), capacity
    for pick in picks[::-1]:
        k = pick[c]
        if k >= 0:
            out[k] += 1
            c -= size[k]
    return out


def configurations(size: np.ndarray, need: np.ndarray, capacity: int, rounds: int = 1000
                   ) -> list[tuple[np.ndarray, float]]:
    """Configurations and how often each is used, minimising their number while covering
    ``need`` pieces of each ``size``: the linear program, by column generation."""
    m = len(size)
    base = np.diag((capacity // size).astype(float))
    for _ in range(rounds):
        inverse = np.linalg.inv(base)
        used = inverse @ need
        new = _best_configuration(np.maximum(inverse.sum(0), 0), size, capacity)
        if new @ inverse.sum(0) <= 1 + 1e-9:
            break
        direction = inverse @ new
        ratio = np.where(direction > 1e-12, used / np.where(direction > 1e-12, direction, 1),
                         np.inf)
        base[:, int(ratio.argmin())] = new
    used = np.linalg.inv(base) @ need
    return [(base[:, k].astype(int), max(0.0, used[k])) for k in range(m)]


class _Plan:
    """Open sequences by free space, and the runs placed so far."""

    def __init__(self, counts: np.ndarray, capacity: int):
        self.capacity = capacity
        self.left = counts.astype(np.int64).copy()
        self.next = np.zeros_like(self.left)
        self.sequences = 0
        self.runs: list[tuple[int, int, int, int, int, int]] = []
        self.free: dict[int, list[tuple[int, int]]] = {}

    def open(self, n: int) -> int:
        self.sequences += n
        return self.sequences - n

    def keep(self, room: int, first: int, n: int) -> None:
        if n and room:
            self.free.setdefault(room, []).append((first, n))

    def place(self, length: int, n: int, first: int, each: int, room: int) -> None:
        """The next ``n`` pieces of a length, ``each`` to a sequence from ``first`` on, all with
        ``room`` left."""
        self.runs.append((length, int(self.next[length]), n, first, each, self.capacity - room))
        self.next[length] += n
        self.left[length] -= n

    def best_fit(self, length: int) -> None:
        while self.left[length]:
            rooms = [r for r in self.free if r >= length]
            n = int(self.left[length])
            if rooms:
                room = min(rooms)
                first, have = self.free[room].pop()
                if not self.free[room]:
                    del self.free[room]
            else:
                each = self.capacity // length
                room, have = self.capacity, -(-n // each)
                first = self.open(have)
            each = room // length
            full = min(have, n // each)
            if full:
                self.place(length, full * each, first, each, room)
                self.keep(room - full // full * each * length, first, full)
            if full < have:
                rest = int(self.left[length])
                if rest:  # fewer than one sequence takes
                    self.place(length, rest, first + full, rest, room)
                    self.keep(room - rest * length, first + full, 1)
                    self.keep(room, first + full + 1, have - full - 1)
                else:
                    self.keep(room, first + full, have - full)


def plan(counts: np.ndarray, capacity: int = CAPACITY, groups: Sequence[int] = GROUPS
         ) -> tuple[list[tuple[int, int, int, int, int, int]], int]:
    """The best of the plans for each number of groups; see :func:`plan_with`."""
    return min((plan_with(counts, capacity, g) for g in groups), key=lambda p: p[1])


def plan_with(counts: np.ndarray, capacity: int, groups: int
              ) -> tuple[list[tuple[int, int, int, int, int, int]], int]:
    """Runs (length, number of the first piece of that length, pieces, first sequence, pieces
    per sequence, offset) and the number of sequences, for ``counts[length]`` pieces."""
    p = _Plan(counts, capacity)
    if p.left[capacity]:
        n = int(p.left[capacity])
        p.place(capacity, n, p.open(n), 1, capacity)
    smallest = capacity // 8 + 1
    large = [k for k in range(capacity - 1, smallest - 1, -1) if p.left[k]]
    total = sum(int(p.left[k]) for k in large)
    if total:
        per_group = -(-total // groups)
        queues: list[list[list[int]]] = []
        room = 0
        for k in large:
            n = int(p.left[k])
            while n:
                if not room:
                    queues.append([])
                    room = per_group
                take = min(n, room)
                queues[-1].append([k, take])
                n, room = n - take, room - take
        # Groups that round to one size are one row of the program.
        size = np.array([q[0][0] for q in queues])
        need = np.array([sum(n for _, n in q) for q in queues], float)
        sizes, row = np.unique(size, return_inverse=True)
        merged = [[x for i in np.flatnonzero(row == k) for x in queues[i]]
                  for k in range(len(sizes))]
        for shape, times in configurations(sizes, np.bincount(row, need), capacity):
            have = [sum(n for _, n in q) for q in merged]
            times = min([int(times + 1e-9)] + [have[k] // shape[k] for k in range(len(sizes))
                                               if shape[k]])
            if times <= 0 or not shape.any():
                continue
            parts = [(p.open(times), times, capacity)]
            for k in np.flatnonzero(shape)[::-1]:
                for _ in range(int(shape[k])):
                    parts = _fill(p, parts, merged[k])
            for first, n, room in parts:
                p.keep(room, first, n)
    for length in range(capacity - 1, 0, -1):
        p.best_fit(length)
    return p.runs, p.sequences


def _fill(p: _Plan, parts: list[tuple[int, int, int]], queue: list[list[int]]
          ) -> list[tuple[int, int, int]]:
    """One more piece into every sequence of ``parts``, from the front of the queue."""
    out = []
    for first, n, room in parts:
        while n:
            length, have = queue[0]
            take = min(n, have)
            p.place(length, take, first, 1, room)
            out.append((first, take, room - length))
            first, n = first + take, n - take
            queue[0][1] -= take
            if not queue[0][1]:
                queue.pop(0)
    return out


def pack(docs: DataFrame, capacity: int = CAPACITY, path: str | None = None,
         with_ids: bool = False) -> DataFrame:
    """The pieces with their sequence_id and offset."""
    cutted = cut(pieces(docs, capacity, path, with_ids), "pieces")
    counts = np.zeros(capacity + 1, np.int64)
    for length, n in cutted.groupBy("length").count().collect():  # at most ``capacity`` rows
        counts[length] = n
    runs, _ = plan(counts, capacity)
    table = np.array(sorted(runs), np.int64).reshape(-1, 6)

    sliced = cutted.withColumn("_slice", slice_of(F.struct("doc_id", "piece"), SLICES))
    sizes = sliced.groupBy("length", "_slice").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("length").orderBy("_slice").rowsBetween(
        Window.unboundedPreceding, -1)
    offsets = sizes.select(
        "length", "_slice", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("length", "_slice").orderBy("doc_id", "piece", "ids_crc32")
    ranked = sliced.withColumn("_rank", F.row_number().over(inside) - 1).join(
        offsets, ["length", "_slice"]
    ).withColumn("_rank", F.col("_rank") + F.col("_before")).drop("_slice", "_before")

    def seat(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Runs are sorted by length and first rank: one number orders both.
        key = table[:, 0] * (1 << 50) + table[:, 1]
        for batch in batches:
            length = batch.column("length").to_numpy()
            rank = batch.column("_rank").to_numpy()
            run = table[np.searchsorted(key, length * (1 << 50) + rank, "right") - 1]
            nth = rank - run[:, 1]
            sequence = run[:, 3] + nth // run[:, 4]
            offset = run[:, 5] + nth % run[:, 4] * length
            columns = [batch.column(n) for n in names]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(sequence), pa.array(offset)],
                [*names, "sequence_id", "offset"])

    names = cutted.columns
    schema = ", ".join(f"{n} {t}" for n, t in cutted.dtypes)
    return arrow(ranked.select(*names, "_rank"), seat,
                 f"{schema}, sequence_id bigint, offset bigint")
