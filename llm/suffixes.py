"""Suffix order of words in numpy, all texts of a chunk at once."""

from __future__ import annotations

from typing import Iterator

import numpy as np


def doubled(key: np.ndarray, end: np.ndarray, width: int) -> Iterator[tuple[int, np.ndarray]]:
    """(width, rank): the rank of every suffix by its first ``width`` words, twice as many in each
    round, until no two are equal. ``key`` orders suffixes by the first ``width`` words, in such
    a way that suffixes with fewer words are equal to no other unless they may be; ``end`` is the
    end of the suffix's text. A rank is the number of smaller suffixes. The array yielded is
    changed by the next round; only suffixes that still have an equal are sorted again."""
    n = len(key)
    live, rank = np.arange(n), np.zeros(n, np.int64)
    while len(live):
        order = np.argsort(key)
        live, key, old = live[order], key[order], rank[live[order]]
        new = np.ones(len(live) + 1, bool)
        new[1:-1] = key[1:] != key[:-1]
        at = np.arange(len(live))
        base = np.ones(len(live), bool)
        base[1:] = old[1:] != old[:-1]
        group = np.maximum.accumulate(np.where(new[:-1], at, 0))
        rank[live] = old + group - np.maximum.accumulate(np.where(base, at, 0))
        yield width, rank
        live = live[~(new[:-1] & new[1:])]
        ahead = live + width
        inside = ahead < end[live]
        ahead[~inside] = 0
        key = rank[live] * (n + 1) + np.where(inside, rank[ahead] + 1, 0)
        width *= 2


def following(ids: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The word after each word of the texts that begin at ``first``; 0 after a text's last."""
    out = np.zeros_like(ids)
    out[:-1] = ids[1:]
    out[first[1:][first[1:] > 0] - 1] = 0
    return out
