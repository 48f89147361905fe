"""Words of whole texts as numpy arrays, straight from the Arrow string buffers.

A word is ``[^\\x20\\x09-\\x0D]+``. Its separators are ASCII, so splitting the UTF-8 bytes is the
same as splitting the characters. Nothing here loops over words; memory is bounded by the chunk
size and the longest single text.
"""

from __future__ import annotations

from typing import Iterator, NamedTuple

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 2 << 20

_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_U = np.uint64
_K1, _K2, _K3 = _U(0x9E3779B97F4A7C15), _U(0xC2B2AE3D27D4EB4F), _U(0xD6E8FEB86659FD93)
_MASK = np.array([(1 << (8 * n)) - 1 for n in range(9)], np.uint64)


class Chunk(NamedTuple):
    """Some rows of a text column: row numbers, their bytes, and where each text begins."""

    lo: int
    hi: int
    raw: np.ndarray
    offsets: np.ndarray


class Words(NamedTuple):
    """Byte spans of all words of a chunk, and the number of the first word of each text."""

    start: np.ndarray
    end: np.ndarray
    first: np.ndarray


def chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[Chunk]:
    """Cut a string column (nulls are empty texts) into runs of whole texts of about ``limit``
    bytes; one longer text is a chunk of its own."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    n = len(column)
    if not n:
        return
    _, where, data = column.buffers()
    offsets = np.frombuffer(where, np.int64)[column.offset : column.offset + n + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1
        hi = min(n, max(lo + 1, hi))
        yield Chunk(lo, hi, raw[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
        lo = hi


def split(raw: np.ndarray, offsets: np.ndarray, space: np.ndarray = _SPACE) -> Words:
    """Spans of the words; ``space`` marks the bytes that separate."""
    if not len(raw):
        none = np.zeros(0, np.int64)
        return Words(none, none, np.zeros(len(offsets), np.int64))
    gap = space[raw]
    edge = np.empty(len(raw), bool)
    edge[0], edge[1:] = True, gap[:-1]
    edge[offsets[:-1][offsets[:-1] < len(raw)]] = True
    start = np.flatnonzero(edge & ~gap)
    edge[-1], edge[:-1] = True, gap[1:]
    edge[offsets[1:][offsets[1:] > 0] - 1] = True
    end = np.flatnonzero(edge & ~gap) + 1
    return Words(start, end, np.searchsorted(start, offsets))


def mix(h: np.ndarray) -> np.ndarray:
    """Scramble 64-bit values, one to one."""
    h = h ^ (h >> _U(32))
    h *= _K2
    h ^= h >> _U(29)
    h *= _K3
    h ^= h >> _U(32)
    return h


def hash_spans(raw: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int = 0) -> np.ndarray:
    """64-bit hashes of byte spans, eight bytes a step."""
    padded = np.zeros(len(raw) + 8, np.uint8)
    padded[: len(raw)] = raw
    eight = np.ndarray(len(raw) + 1, "<u8", padded, strides=(1,))
    length = end - start
    h = mix((length + seed).astype(np.uint64) * _K1)
    h = mix(h ^ (eight[start] & _MASK[np.minimum(length, 8)]) * _K1)
    live, done = np.flatnonzero(length > 8), 8
    while len(live):
        word = eight[start[live] + done] & _MASK[np.minimum(length[live] - done, 8)]
        h[live] = mix(h[live] ^ word * _K1)
        done += 8
        live = live[length[live] > done]
    return h


def _shifted(h: np.ndarray, by: int) -> np.ndarray:
    out = np.zeros_like(h)
    if by < len(h):
        out[: len(h) - by] = h[by:]
    return out


def ngrams(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of the ``n`` words that start at each word, by doubling. Positions with fewer than
    ``n`` words left in their text hold no meaningful value; see :func:`whole`."""
    out, offset, width, level = None, 0, 1, h
    while True:
        if n & width:
            part = _shifted(level, offset) if offset else level
            out = part if out is None else mix(out * _K1 + part)
            offset += width
        if 2 * width > n:
            return out
        level = mix(level * _K1 + _shifted(level, width))
        width *= 2


def text_of(first: np.ndarray) -> np.ndarray:
    """Number of the text of every word."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))


def whole(first: np.ndarray, n: int) -> np.ndarray:
    """True at words that start ``n`` words of one text."""
    left = np.repeat(first[1:], np.diff(first)) - np.arange(first[-1])
    return left >= n


def shingles(raw: np.ndarray, offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all ``n``-word shingles (repeats kept) and the bounds of each text's. A text of
    fewer words has one shingle, all its words; a text without words has none."""
    w = split(raw, offsets)
    h = hash_spans(raw, w.start, w.end)
    count = np.diff(w.first)
    keep = whole(w.first, n)
    out = ngrams(h, n)
    for i in np.flatnonzero((count > 0) & (count < n)):
        a, b = w.first[i], w.first[i + 1]
        value = np.array([b - a], np.uint64)
        for x in h[a:b]:
            value = mix(value * _K1 + x)
        out[a], keep[a] = value[0], True
    bounds = np.concatenate([[0], np.cumsum(keep)])[w.first]
    return out[keep], bounds
