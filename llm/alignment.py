"""Alignment of the tokens of two tokenizers, and how many documents link each pair of ids.

Every text is encoded by a ``tokenizers`` file (A) and a ``sentencepiece`` model (B). Byte offsets
where tokens of both end cut them into groups; every A token of a group is linked to every B token
of it.

1. *Segments.* Neither encoding looks across a space between two words, so a text is cut there and
   only segments that the worker has not met are encoded.
2. *Coarse cuts* are the character offsets of A's tokens and the spans of B's pieces. A character
   of several bytes that is spread over tokens has one offset for all of them, and a byte-fallback
   piece an empty span: there the lengths of the decoded bytes refine the cuts. Segments whose
   joined bytes are not the text make their document one without tokens.
3. *Chunks.* Texts of about ``CHUNK_BYTES`` share one row of the written table: their segments'
   different pairs, the number of its documents that hold each, and the segments of each document.
   Pairs are counted over chunks with map-side combination; the counts go back to the chunks by
   a join on the pair, sorted like the chunk's own pairs. Links of single documents are never
   shuffled, and no count table is broadcast.

B's spans are the library's ``offset_mapping`` in bytes, those of its proto.

Defined results: texts that are null, empty or not restored by the tokens have no tokens: zeros and
an empty digest; equal rows are documents of their own; ids are not read; an empty table gives no
rows; other columns may have any names. One text is never split, so memory is bounded by a chunk
or the longest text.
"""

from __future__ import annotations

import functools
import hashlib
import os
from functools import partial
from itertools import chain
from typing import Iterator, NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.types import ArrayType, StructType

from llm import words
from llm.shared import arrow, cut, group_bounds, whole_groups

TOKENIZER_A = "byte_bpe_50k.json"
TOKENIZER_B = "piece_bpe_32k.model"
CHUNK_BYTES = 8 << 20
# Segments and pairs that a Python worker remembers; a full memory forgets what was rarest, and
# forgotten segments are encoded again.
REMEMBERED = 600_000
REMEMBERED_PAIRS = 8_000_000
# A chunk is a row of many MB; the writer and the readers hold few of them at once.
_FEW_ROWS = {"parquet.block.size": str(16 << 20), "parquet.block.size.row.check.min": "1",
             "parquet.page.size.row.check.min": "1"}
_STEP = 10_000
_SHARE = 500_000
_SPACE = "▁"

_chain = chain.from_iterable
_COUNTS = ["n_a", "n_b", "n_groups", "n_links"]
_CHUNK = ("chunk bigint, n_a array<bigint>, n_b array<bigint>, n_groups array<bigint>, "
          "n_links array<bigint>, groups_sha256 array<string>, pairs array<bigint>, "
          "docs array<int>, text_bounds binary, segments binary, segment_bounds binary, "
          "segment_pairs binary, segment_times binary")
_RESULT = ("n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, "
           "count_sum bigint, groups_sha256 string")


def _visible_bytes() -> dict[str, int]:
    """The character that stands for each byte in a byte-level vocabulary: printable ones stand
    for themselves, the others are numbered from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(rest)}


def _sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sum of every part of ``values``."""
    total = np.concatenate([[0], np.cumsum(values)])
    return total[bounds[1:]] - total[bounds[:-1]]


def _different(values: np.ndarray) -> np.ndarray:
    """The different values, sorted; faster than hashing them."""
    values = np.sort(values)
    return values[np.concatenate([[True], values[1:] != values[:-1]])[: len(values)]]


def _shares(text: np.ndarray, size: np.ndarray) -> Iterator[tuple[int, int]]:
    """Cuts sorted rows into runs of whole texts of about ``_SHARE`` values together."""
    if not len(text):
        return
    last = np.append(np.flatnonzero(text[1:] != text[:-1]) + 1, len(text))
    filled = np.cumsum(size)[last - 1] // _SHARE
    ends = last[np.append(filled[1:] != filled[:-1], True)]
    yield from zip([0, *ends[:-1].tolist()], ends.tolist())


def _spread(bounds: np.ndarray, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of all values of the given parts, and the number in ``parts`` of each."""
    size = bounds[parts + 1] - bounds[parts]
    which = np.repeat(np.arange(len(parts)), size)
    return np.arange(len(which)) - np.repeat(np.cumsum(size) - size - bounds[parts], size), which


class _Pool:
    """Growing array of parts."""

    def __init__(self, dtype=np.int64):
        self.values, self.bounds = np.zeros(1 << 16, dtype), np.zeros(1, np.int64)

    def add(self, values: np.ndarray, size: np.ndarray) -> None:
        used, total = int(self.bounds[-1]), int(self.bounds[-1]) + len(values)
        if total > len(self.values):
            grown = np.zeros(max(total, 2 * len(self.values)), self.values.dtype)
            grown[:used] = self.values[:used]
            self.values = grown
        self.values[used:total] = values
        self.bounds = np.concatenate([self.bounds, used + np.cumsum(size)])

    def keep(self, chosen: np.ndarray) -> None:
        size = np.diff(self.bounds)
        self.values = self.values[: self.bounds[-1]][np.repeat(chosen, size)]
        self.bounds = np.concatenate([[0], np.cumsum(size[chosen])])

    def __getitem__(self, part: int) -> np.ndarray:
        return self.values[self.bounds[part] : self.bounds[part + 1]]


class Tokens(NamedTuple):
    """Tokens of some segments: ids, the end of each in the joined bytes, and bounds by segment."""

    ids: np.ndarray
    ends: np.ndarray
    bounds: np.ndarray
    restored: np.ndarray


class Aligner:
    """Both tokenizers, and the alignment of the segments met so far."""

    def __init__(self, path_a: str, path_b: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True  # their strings are plain text
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        byte = _visible_bytes()
        self.bytes_a = [b""] * self.a.get_vocab_size()
        for token, i in self.a.get_vocab().items():
            known = all(ch in byte for ch in token)
            self.bytes_a[i] = bytes(map(byte.get, token)) if known else token.encode()
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.fallback = np.array([self.b.is_byte(i) for i in range(len(pieces))])
        self.bytes_b = [bytes([int(p[3:-1], 16)]) if f else p.replace(_SPACE, " ").encode()
                        for p, f in zip(pieces, self.fallback)]
        # A piece with a space after another character would look across words.
        self.splits = not any(_SPACE in p.lstrip(_SPACE) for p in pieces)
        self.name = [str(i).encode() for i in range(max(len(pieces), len(self.bytes_a)))]
        self.forget()

    def forget(self) -> None:
        self.keys, self.place = np.zeros(0, np.uint64), np.zeros(0, np.int32)
        self.counts = np.zeros((0, 5), np.int32)  # n_a, n_b, n_groups, n_links, restored
        # A pair is numbered A id * number of ids + B id.
        self.pairs = _Pool(np.uint32 if len(self.name) < 1 << 16 else np.int64)
        self.times, self.text = _Pool(np.int32), _Pool(np.uint8)
        self.uses = np.zeros(0, np.int64)

    def _full(self, new: int) -> bool:
        return bool(len(self.keys)) and (len(self.keys) + new > REMEMBERED
                                         or self.pairs.bounds[-1] > REMEMBERED_PAIRS)

    def _thin(self) -> None:
        """Keep the segments that occurred most often, half of a full memory at most."""
        half = max(1, REMEMBERED // 2)
        if len(self.uses) > half:
            often = self.uses > np.partition(self.uses, len(self.uses) - half)[-half]
        else:
            often = self.uses > np.median(self.uses)
        for pool in (self.pairs, self.times, self.text):
            pool.keep(often)
        self.counts, self.uses = self.counts[often], self.uses[often] // 2
        inside = often[self.place]
        self.keys = self.keys[inside]
        self.place = (np.cumsum(often) - 1)[self.place[inside]].astype(np.int32)

    def _unmet(self, keys: np.ndarray) -> np.ndarray:
        """Numbers of the sorted keys that are not in the memory."""
        where = np.searchsorted(self.keys, keys)
        inside = where < len(self.keys)
        met = np.zeros(len(keys), bool)
        met[inside] = self.keys[where[inside]] == keys[inside]
        return np.flatnonzero(~met)

    def _joined(self, ids: np.ndarray, table: list[bytes], bounds: np.ndarray, raw: bytes,
                base: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """End of every token by decoded bytes, and whether a segment's tokens give its bytes."""
        parts = [table[i] for i in ids.tolist()]
        size = np.fromiter(map(len, parts), np.int64, len(parts))
        data, own = b"".join(parts), np.concatenate([[0], np.cumsum(size)])
        at = own[bounds]
        restored = np.array([data[x:y] == raw[u:v] for x, y, u, v in zip(
            at[:-1].tolist(), at[1:].tolist(), base[:-1].tolist(), base[1:].tolist())], bool)
        shift = np.repeat(base[:-1] - at[:-1], np.diff(bounds))
        return own[1:] + shift, restored

    def _tokens_a(self, segments: list[str], raw: bytes, base: np.ndarray) -> Tokens:
        made = self.a.encode_batch(segments, add_special_tokens=False)
        bounds = np.cumsum([0] + [len(e) for e in made])
        total = int(bounds[-1])
        ids = np.fromiter(_chain(e.ids for e in made), np.int64, total)
        spans = np.fromiter(_chain(_chain(e.offsets for e in made)), np.int64, 2 * total)
        spans = spans.reshape(-1, 2)
        decoded, restored = self._joined(ids, self.bytes_a, bounds, raw, base)
        data = np.frombuffer(raw, np.uint8)
        character = np.append(np.flatnonzero((data & 0xC0) != 0x80), len(data))
        shift = np.repeat(np.searchsorted(character, base[:-1]), np.diff(bounds))
        begin, end = spans[:, 0] + shift, spans[:, 1] + shift
        # The next token begins inside the last character of this one.
        inside = np.zeros(len(ids), bool)
        inside[:-1] = begin[1:] < end[:-1]
        return Tokens(ids, np.where(inside, decoded, character[end]), bounds, restored)

    def _tokens_b(self, segments: list[str], raw: bytes, base: np.ndarray) -> Tokens:
        made = self.b.encode(segments, return_type="offset_mapping", return_bytes=True,
                             num_threads=1)
        bounds = np.cumsum([0] + [len(m["ids"]) for m in made])
        total = int(bounds[-1])
        ids = np.fromiter(_chain(m["ids"] for m in made), np.int64, total)
        spans = np.fromiter(_chain(_chain(m["offsets"] for m in made)), np.int64, 2 * total)
        coarse = spans[1::2].copy()
        decoded, restored = self._joined(ids, self.bytes_b, bounds, raw, base)
        # The model adds the space in front.
        coarse += 1 + np.repeat(base[:-1], np.diff(bounds))
        return Tokens(ids, np.where(self.fallback[ids], decoded, coarse), bounds, restored)

    def _learn(self, keys: np.ndarray, segments: list[bytes]) -> None:
        """Align segments, each without the space in front of it."""
        for lo in range(0, len(keys), _STEP):
            part = segments[lo : lo + _STEP]
            raw = b" " + b" ".join(part)
            base = np.cumsum([0] + [len(s) + 1 for s in part])
            texts = [s.decode() for s in part]
            a = self._tokens_a([" " + t for t in texts], raw, base)
            b = self._tokens_b(texts, raw, base)
            self._add(a, b, a.restored & b.restored, len(part))
        at = np.arange(len(self.counts) - len(keys), len(self.counts), dtype=np.int32)
        where = np.searchsorted(self.keys, keys)
        self.keys = np.insert(self.keys, where, keys)
        self.place = np.insert(self.place, where, at)

    def _add(self, a: Tokens, b: Tokens, good: np.ndarray, n: int) -> None:
        of = [np.repeat(np.arange(n), np.diff(t.bounds)) for t in (a, b)]
        keep = [good[s] for s in of]
        (seg_a, seg_b), (end_a, end_b), (ids_a, ids_b) = (
            [x[k] for x, k in zip(pair, keep)] for pair in (of, (a.ends, b.ends), (a.ids, b.ids)))
        cuts = np.intersect1d(end_a, end_b, assume_unique=True)
        group_a, group_b = np.searchsorted(cuts, end_a), np.searchsorted(cuts, end_b)
        segment = np.zeros(len(cuts), np.int64)
        segment[group_a] = seg_a
        # Different ids of each group with their number, and all pairs of them.
        wide = len(self.name)
        code_a, n_a = np.unique(group_a * wide + ids_a, return_counts=True)
        code_b, n_b = np.unique(group_b * wide + ids_b, return_counts=True)
        bounds_b = np.searchsorted(code_b, np.arange(len(cuts) + 1) * wide)
        in_b, row = _spread(bounds_b, code_a // wide)
        owner = segment[code_a[row] // wide]
        pair = code_a[row] % wide * wide + code_b[in_b] % wide
        order = np.lexsort((pair, owner))
        owner, pair, times = owner[order], pair[order], (n_a[row] * n_b[in_b])[order]
        first = np.flatnonzero(np.concatenate([[True], (owner[1:] != owner[:-1]) | (
            pair[1:] != pair[:-1])])[: len(owner)])
        times = np.add.reduceat(times, first) if len(first) else times
        owner, pair = owner[first], pair[first]
        size = np.bincount(owner, minlength=n)
        self.pairs.add(pair, size)
        self.times.add(times, size)
        self.counts = np.concatenate([self.counts, np.stack([
            np.bincount(seg_a, minlength=n), np.bincount(seg_b, minlength=n),
            np.bincount(segment, minlength=n),
            np.bincount(owner, times, n).astype(np.int64), good], axis=1).astype(np.int32)])
        # a1,a2|b1;a3|b2 for each segment: A ids before B ids in every group.
        group = np.concatenate([group_a, group_b])
        kind = np.repeat([0, 1], [len(ids_a), len(ids_b)])
        order = np.lexsort((kind, group))
        group, kind, ids = group[order], kind[order], np.concatenate([ids_a, ids_b])[order]
        owner = segment[group]
        after = np.zeros(len(ids), np.int64)  # nothing, comma, bar, semicolon
        same = group[1:] == group[:-1]
        after[:-1] = np.where(same, np.where(kind[1:] == kind[:-1], 1, 2),
                              np.where(owner[1:] == owner[:-1], 3, 0))
        mark = (b"", b",", b"|", b";")
        parts = [self.name[i] + mark[m] for i, m in zip(ids.tolist(), after.tolist())]
        size = np.fromiter(map(len, parts), np.int64, len(parts))
        ends = np.concatenate([[0], np.cumsum(size)])[np.searchsorted(owner, np.arange(n + 1))]
        self.text.add(np.frombuffer(b"".join(parts), np.uint8), np.diff(ends))

    def known(self, raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple:
        """(segments, number): the different segments among byte spans, the most frequent first,
        as places in the memory, and the number of every span."""
        keys, one, number, count = np.unique(
            words.hash_spans(raw, start, end), return_index=True, return_inverse=True,
            return_counts=True)
        new = self._unmet(keys)
        for less in (self._thin, self.forget):
            if len(new) and self._full(len(new)):
                less()
                new = self._unmet(keys)
        if len(new):
            data = raw.tobytes()
            self._learn(keys[new], [data[x:y] for x, y in zip(
                start[one[new]].tolist(), end[one[new]].tolist())])
        self.uses = np.concatenate([self.uses, np.zeros(len(new), np.int64)])
        self.uses[self.place[np.searchsorted(self.keys, keys)]] += count
        order = np.argsort(-count, kind="stable")
        back = np.empty(len(order), np.int64)
        back[order] = np.arange(len(order))
        return self.place[np.searchsorted(self.keys, keys[order])], back[number]

    def cuts(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
        """Byte spans of the segments of texts, without the space in front of each but the
        first of a text, and the bounds of each text."""
        first = offsets[:-1][np.diff(offsets) > 0]
        at = np.flatnonzero(raw == 32) if self.splits else np.zeros(0, np.int64)
        at = at[(at > 0) & (at + 1 < len(raw))]
        # The character before is not white space or the model's own sign of it, and a
        # character of the same text follows.
        one, two, three = (raw[np.maximum(at - k, 0)] for k in (1, 2, 3))
        blank = (two == 0xC2) & ((one == 0x85) | (one == 0xA0))
        blank |= (three == 0xE1) & (two == 0x9A) & (one == 0x80)
        blank |= (three == 0xE2) & (two == 0x80) & ((one <= 0x8A) | (one == 0xA8) | (
            one == 0xA9) | (one == 0xAF))
        blank |= (three == 0xE2) & (two == 0x81) & (one == 0x9F)
        blank |= (three == 0xE2) & (two == 0x96) & (one == 0x81)
        blank |= (three == 0xE3) & (two == 0x80) & (one == 0x80)
        border = np.zeros(len(raw) + 1, bool)
        border[offsets] = True
        at = at[(one > 32) & ~blank & ~border[at] & ~border[at + 1]]
        start = np.sort(np.concatenate([first, at + 1]))
        stop = np.sort(np.concatenate([at, first[1:], [len(raw)][: len(first)]]))
        return start, stop, np.searchsorted(start, offsets)


@functools.lru_cache(2)
def _aligner(path_a: str, path_b: str) -> Aligner:
    return Aligner(path_a, path_b)


def _packed(values: np.ndarray) -> pa.Array:
    return pa.array([values.astype("<i4").tobytes()], pa.binary())


def _unpacked(value: pa.Scalar) -> np.ndarray:
    return np.frombuffer(value.as_buffer(), "<i4").astype(np.int64)


def _one(values: pa.Array) -> pa.Array:
    """A list array of one row."""
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)


def _align(batches: Iterator[pa.RecordBatch], path_a: str | None, path_b: str | None,
           size: int) -> Iterator[pa.RecordBatch]:
    """One row per chunk of texts."""
    import public_tokenizers

    tool = _aligner(str(path_a or public_tokenizers.path(TOKENIZER_A)),
                    str(path_b or public_tokenizers.path(TOKENIZER_B)))
    number = TaskContext.get().partitionId() << 32
    names_out = ["doc", *(field.split()[0] for field in _CHUNK.split(", "))]
    for batch in batches:
        for c in words.chunks(batch.column("text"), size):
            start, stop, first = tool.cuts(c.raw, c.offsets)
            place, segment = tool.known(c.raw, start, stop)
            text = words.text_of(first)
            bad = np.unique(text[tool.counts[place, 4][segment] == 0])
            good = np.ones(c.hi - c.lo, bool)
            good[bad] = False
            segment, text = segment[good[text]], text[good[text]]
            if len(bad):  # segments of other texts only
                used, segment = np.unique(segment, return_inverse=True)
                place = place[used]
            bounds = np.searchsorted(text, np.arange(c.hi - c.lo + 1))
            counts = [_sums(tool.counts[place, k][segment], bounds) for k in range(4)]
            shown = memoryview(tool.text.values)
            names = [bytes(shown[x:y]) for x, y in zip(tool.text.bounds[place].tolist(),
                                                       tool.text.bounds[place + 1].tolist())]
            sha = [hashlib.sha256(b";".join([names[s] for s in segment[x:y].tolist()])).hexdigest()
                   if x < y else "" for x, y in zip(bounds[:-1].tolist(), bounds[1:].tolist())]
            del names, shown
            # The chunk's pairs, numbered; and in how many of its texts each is.
            there, which = _spread(tool.pairs.bounds, place)
            pairs, pair = np.unique(tool.pairs.values[there], return_inverse=True)
            pairs = pairs.astype(np.int64)
            pairs = pairs // len(tool.name) << 32 | pairs % len(tool.name)
            segment_bounds = np.searchsorted(which, np.arange(len(place) + 1))
            once = _different(text * len(place) + segment)
            docs = np.zeros(len(pairs), np.int64)
            for x, y in _shares(once // max(1, len(place)),
                                np.diff(segment_bounds)[once % max(1, len(place))]):
                part = once[x:y]
                inside, row = _spread(segment_bounds, part % len(place))
                held = _different((part // len(place))[row] * len(pairs) + pair[inside])
                docs += np.bincount(held % len(pairs), minlength=len(pairs))
            lists = [*map(pa.array, counts), pa.array(sha, pa.string()), pa.array(pairs),
                     pa.array(docs.astype(np.int32))]
            packed = [bounds, segment, segment_bounds, pair, tool.times.values[there]]
            yield pa.RecordBatch.from_arrays(
                [_one(batch.column("doc").slice(c.lo, c.hi - c.lo)), pa.array([number]),
                 *map(_one, lists), *map(_packed, packed)], names_out)
            number += 1


def _values(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by chunk and pair to one row of values per chunk."""
    for table in whole_groups(batches, ["chunk"]):
        table = table.combine_chunks()
        bounds = group_bounds(table, ["chunk"])
        chunk, value = table.column("chunk").to_numpy(), table.column("value").to_numpy()
        yield pa.RecordBatch.from_arrays(
            [pa.array(chunk[bounds[:-1]]), pa.array(
                [value[x:y].astype("<i8").tobytes() for x, y in zip(bounds[:-1], bounds[1:])],
                pa.binary())], ["chunk", "found"])


def _finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The documents of every chunk, with the sums over their links."""
    for batch in batches:
        for i in range(batch.num_rows):
            cell = {n: batch.column(n)[i] for n in batch.schema.names}
            bounds, segment, segment_bounds, pair, times = (_unpacked(cell[n]) for n in (
                "text_bounds", "segments", "segment_bounds", "segment_pairs", "segment_times"))
            found = np.zeros(0, np.int64)
            if cell["found"].is_valid:
                found = np.frombuffer(cell["found"].as_buffer(), "<i8")
            best = _sums(times * (found[pair] & 1), segment_bounds)[segment]
            count = _sums(times * (found[pair] >> 1), segment_bounds)[segment]
            yield pa.RecordBatch.from_arrays(
                [cell["doc"].values, *(cell[n].values for n in _COUNTS),
                 pa.array(_sums(best, bounds)), pa.array(_sums(count, bounds)),
                 cell["groups_sha256"].values],
                ["doc", *_COUNTS, "n_best", "count_sum", "groups_sha256"])


def chunked(docs: DataFrame, carry: list[str] | None = None, path_a: str | None = None,
            path_b: str | None = None, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """The aligned texts, written: one row per chunk."""
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in carry or ["doc_id"])).alias("doc"),
                       F.col("text"))
    schema = StructType().add("doc", ArrayType(rows.schema["doc"].dataType))
    for field in StructType.fromDDL(_CHUNK):
        schema = schema.add(field)
    return cut(arrow(rows, partial(_align, path_a=path_a, path_b=path_b, size=chunk_bytes), schema),
               "aligned", "zstd", **_FEW_ROWS)


def links(chunks: DataFrame) -> DataFrame:
    """pair, a, b, n: in how many documents A id ``a`` is linked to B id ``b``."""
    held = chunks.select(F.explode(F.arrays_zip("pairs", "docs")).alias("p"))
    n = held.groupBy(F.col("p.pairs").alias("pair")).agg(F.sum("p.docs").alias("n"))
    return n.select("pair", F.shiftright("pair", 32).alias("a"),
                    F.col("pair").bitwiseAND(F.lit((1 << 32) - 1)).alias("b"), "n")


def align(docs: DataFrame, carry: list[str] | None = None, path_a: str | None = None,
          path_b: str | None = None, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """doc (struct of the ``carry`` columns) and, for every document: numbers of A tokens, B
    tokens, groups and links; links whose count is the highest of their A id; the sum of the
    counts over all links; and a digest of the groups."""
    chunks = chunked(docs, carry, path_a, path_b, chunk_bytes)
    # An A id has at most as many partners as B has ids, so no window is larger.
    top = F.max("n").over(Window.partitionBy("a"))
    counts = links(chunks).select(
        "pair", (F.col("n") * 2 + (F.col("n") == top).cast("int")).alias("value"))
    met = chunks.select("chunk", F.explode("pairs").alias("pair")).join(counts, "pair")
    values = arrow(met.select("chunk", "pair", "value").repartition("chunk").sortWithinPartitions(
        "chunk", "pair").drop("pair"), _values, "chunk bigint, found binary")
    joined = chunks.drop("pairs", "docs").join(values, "chunk", "left")
    kind = chunks.schema["doc"].dataType.elementType
    schema = StructType().add("doc", kind)
    for field in StructType.fromDDL(_RESULT):
        schema = schema.add(field)
    return arrow(joined, _finish, schema)
