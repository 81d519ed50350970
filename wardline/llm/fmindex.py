"""Bidirectional FM-index of a sequence of word ids, with all intervals of a level extended at once.

Ids are 32-bit numbers; 0 separates pieces and a sequence begins and ends with it.  Separators are all
different and come before the words, so no suffix comparison passes one.
Everything is numpy on arrays as long as the sequence.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


def suffix_order(ids: np.ndarray) -> np.ndarray:
    """Places of all suffixes in their order, by prefix doubling of those that are still tied."""
    n = len(ids)
    breaks = ids == 0
    first = np.where(breaks, np.cumsum(breaks) - 1, ids + int(breaks.sum()) - 1)
    order = np.argsort(first, kind="stable")
    head = np.ones(n, dtype=bool)  # first row of a group of tied suffixes
    head[1:] = first[order[1:]] != first[order[:-1]]
    rank = np.empty(n, dtype=np.int32)
    rank[order] = np.maximum.accumulate(np.where(head, np.arange(n, dtype=np.int32), 0))
    del first
    known = 1
    while True:
        alone = head.copy()
        alone[:-1] &= head[1:]
        tied = np.flatnonzero(~alone)
        if not len(tied):
            return order
        # tied suffixes agree on ``known`` words, so none of them ends before place + known
        place = order[tied]
        key = rank[place].astype(np.int64) * n + rank[place + known]
        by = np.argsort(key, kind="stable")
        place, key = place[by], key[by]
        order[tied] = place
        starts = np.ones(len(tied), dtype=bool)
        starts[1:] = key[1:] != key[:-1]
        head[tied] = starts
        rank[place] = np.maximum.accumulate(np.where(starts, tied, 0))
        known *= 2


class FMIndex:
    """Burrows-Wheeler transform of a sequence with its last-to-first mapping."""

    def __init__(self, ids: np.ndarray):
        order = suffix_order(ids)
        self.symbols = int(ids.max(initial=0)) + 1
        self.bwt = ids[order - 1]  # the first suffix is preceded by the last id, a separator as well
        order = np.argsort(self.bwt, kind="stable")
        self.lf = np.empty(len(ids), dtype=np.int32)
        self.lf[order] = np.arange(len(ids), dtype=np.int32)
        self.first = np.concatenate([[0], np.cumsum(np.bincount(ids, minlength=self.symbols))])

    def extend(self, low: np.ndarray, count: np.ndarray):
        """Every word in front of the given disjoint intervals.

        Returns (parent, symbol, low, count, smaller): the interval of symbol +
        parent, and how many rows of the parent have a smaller symbol.
        """
        before = np.cumsum(count) - count
        parent = np.repeat(np.arange(len(low), dtype=np.int64), count)
        row = np.arange(len(parent), dtype=np.int32) + np.repeat((low - before).astype(np.int32), count)
        parent *= self.symbols
        parent += self.bwt[row]
        key = parent
        by = np.argsort(key, kind="stable")
        key = key[by]
        start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
        number = np.diff(np.append(start, len(key)))
        top = by[start]
        symbol, parent = key[start] % self.symbols, key[start] // self.symbols
        word = symbol > 0
        return (parent[word], symbol[word], self.lf[row[top]][word], number[word], (start - before[parent])[word])


@dataclass
class Level:
    """All phrases of one length in a sequence: their words, counts, and rows in both indexes."""

    words: np.ndarray   # (phrases, length) word ids
    count: np.ndarray
    ahead: np.ndarray   # first row in the index of the sequence
    back: np.ndarray    # first row in the index of the reversed sequence

    def take(self, keep: np.ndarray) -> "Level":
        """The kept phrases, in the order of their rows ahead."""
        return Level(self.words[keep], self.count[keep], self.ahead[keep], self.back[keep])


class TwoWayIndex:
    """FM-indexes of a sequence and its reverse whose intervals are kept in step."""

    def __init__(self, ids: np.ndarray):
        self.ids = ids
        self._ahead: FMIndex | None = None
        self.back = FMIndex(ids[::-1].copy())

    @property
    def ahead(self) -> FMIndex:
        if self._ahead is None:
            self._ahead = FMIndex(self.ids)
        return self._ahead

    def single(self) -> Level:
        """Phrases of one word."""
        first = self.back.first
        word = np.arange(1, self.back.symbols)
        return Level(word[:, None], first[2:] - first[1:-1], first[1:-1], first[1:-1])

    def right(self, level: Level) -> Level:
        """Every phrase of the level with each word that follows it."""
        parent, symbol, back, count, smaller = self.back.extend(level.back, level.count)
        return Level(np.column_stack([level.words[parent], symbol]), count, level.ahead[parent] + smaller, back)

    def left(self, level: Level) -> Level:
        """Every phrase of the level with each word in front of it."""
        parent, symbol, ahead, count, smaller = self.ahead.extend(level.ahead, level.count)
        return Level(np.column_stack([symbol, level.words[parent]]), count, ahead, level.back[parent] + smaller)
