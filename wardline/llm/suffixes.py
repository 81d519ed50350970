"""External induced sorting of suffixes.

Sorts all suffixes of a text of many short strings.  Only the suffixes at the
leftmost positions of rising runs are sorted directly: their substrings are
sorted by an induction pass, named, and the string of names is sorted
recursively.  All other suffixes follow by induction: a suffix taken from the
queue of its first character puts its left neighbour into the queue of that
neighbour's character.  As suffixes leave the queues in order, each queue is
filled in order, so a first-in first-out queue for each character is a
priority queue; what a queue holds beyond a limit goes to an unnamed file on
the task's disk and is read back in pieces.

Strings end with the character 0.  Ends are distinct and ordered by position,
so no comparison runs beyond a string.  Common prefixes are carried for
neighbours of the result as "at least so many characters", which is all that
a search for repeats of a fixed length needs.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import numpy as np

from wardline.llm.text import mix64, powers

SPILL_ITEMS = 1 << 22    # positions that a queue or array keeps in memory
PIECE_ITEMS = 1 << 20    # positions that are handled at a time
SMALL_ALPHABET = 4096    # larger alphabets of names are ranked by doubling


class Queue:
    """Positions in order of arrival; what exceeds the limit is kept in an unnamed file.

    Items stay after they have been read, because the queues are the result.
    """

    def __init__(self, limit: int):
        self.limit, self.file, self.filed, self.held = limit, None, 0, 0
        self.memory = np.empty(16, dtype=np.int64)

    def __len__(self) -> int:
        return self.filed + self.held

    def push(self, items: np.ndarray) -> None:
        need = self.held + len(items)
        if need > len(self.memory):
            grown = np.empty(max(need, 2 * len(self.memory)), dtype=np.int64)
            grown[:self.held] = self.memory[:self.held]
            self.memory = grown
        self.memory[self.held:need] = items
        self.held = need
        if need > self.limit:
            if self.file is None:
                self.file = tempfile.TemporaryFile()
            self.file.seek(0, 2)
            self.file.write(self.memory[:need].tobytes())
            self.filed, self.held = self.filed + need, 0
            self.memory = np.empty(16, dtype=np.int64)

    def read(self, start: int, end: int) -> np.ndarray:
        """Items from place ``start``, up to ``end`` or fewer."""
        if start < self.filed:
            n = min(end, self.filed) - start
            self.file.seek(8 * start)
            return np.frombuffer(self.file.read(8 * n), dtype=np.int64)
        return self.memory[start - self.filed:min(end - self.filed, self.held)].copy()

    def pieces(self) -> Iterator[np.ndarray]:
        """All items in order of arrival, also those that arrive while others are handled."""
        at = 0
        while at < len(self):
            piece = self.read(at, at + PIECE_ITEMS)
            at += len(piece)
            yield piece

    def backwards(self) -> Iterator[np.ndarray]:
        """All items, the last one first."""
        end = len(self)
        while end > 0:
            start = max(0 if end <= self.filed else self.filed, end - PIECE_ITEMS)
            yield self.read(start, end)[::-1]
            end = start


def rising(text: np.ndarray) -> np.ndarray:
    """Whether each suffix is smaller than the one after it; ends (0) count as rising."""
    n = len(text)
    last_of_run = np.flatnonzero(np.append(text[1:] != text[:-1], True))
    up = np.zeros(len(last_of_run), dtype=bool)
    up[:-1] = text[last_of_run[:-1] + 1] > text[last_of_run[:-1]]
    up |= text[last_of_run] == 0
    return np.repeat(up, np.diff(np.append(-1, last_of_run)))[:n]


def _deal(items: np.ndarray, keys: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Items by key, each group in the given order."""
    order = np.argsort(keys, kind="stable")
    keys, items = keys[order], items[order]
    start = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else []
    for a, b in zip(start, [*start[1:], len(keys)]):
        yield int(keys[a]), items[a:b]


def induce(text: np.ndarray, up: np.ndarray, seeds: np.ndarray, limit: int) -> tuple[list[Queue], list[Queue]]:
    """Falling and rising suffixes by first character, from the sorted leftmost rising ones.

    The rising queues hold the largest suffix first.
    """
    n_chars = int(text.max()) + 1
    falling, leftmost, rise = ([Queue(limit) for _ in range(n_chars)] for _ in range(3))
    for a in range(0, len(seeds), PIECE_ITEMS):
        piece = seeds[a:a + PIECE_ITEMS]
        for c, items in _deal(piece, text[piece]):
            leftmost[c].push(items)

    def spread(items: np.ndarray, want_up: bool, queues: list[Queue]) -> None:
        """Queue the left neighbours of the wanted kind."""
        left = items[items > 0] - 1
        chars = text[left]
        wanted = (up[left] == want_up) & (chars > 0)
        for c, group in _deal(left[wanted], chars[wanted]):
            queues[c].push(group)

    for c in range(n_chars):
        for queue in (falling[c], leftmost[c]):
            for piece in queue.pieces():
                spread(piece, False, falling)
    for c in range(n_chars - 1, 0, -1):
        for piece in rise[c].pieces():
            spread(piece, True, rise)
        for piece in falling[c].backwards():
            spread(piece, True, rise)
    for piece in leftmost[0].backwards():  # ends keep the order of their positions
        rise[0].push(piece)
    return falling, rise


def in_order(falling: list[Queue], rise: list[Queue]) -> Iterator[np.ndarray]:
    for f, r in zip(falling, rise):
        yield from f.pieces()
        yield from r.backwards()


def rank_by_doubling(names: np.ndarray) -> np.ndarray:
    """Suffix order of a string of names (0, 1, ... without gaps) whose suffixes are distinct.

    A suffix's rank is where its group of equal beginnings starts; only groups
    of two or more are sorted again, by the rank of what follows.
    """
    n, width = len(names), 1
    counts = np.bincount(names)
    rank = (np.cumsum(counts) - counts)[names]
    todo = np.flatnonzero(counts[names] > 1)
    while len(todo):
        after = np.where(todo + width < n, rank[np.minimum(todo + width, n - 1)] + 1, 0)
        order = np.argsort(rank[todo] * (n + 1) + after)
        todo, after = todo[order], after[order]
        old = rank[todo]
        new_group = np.append(True, old[1:] != old[:-1])
        new_part = new_group | np.append(True, after[1:] != after[:-1])
        at = np.arange(len(todo))
        group_start = np.maximum.accumulate(np.where(new_group, at, 0))
        part_start = np.maximum.accumulate(np.where(new_part, at, 0))
        rank[todo] = old + part_start - group_start
        alone = new_part & np.append(new_part[1:], True)
        todo, width = todo[~alone], width * 2
    order = np.empty(n, dtype=np.int64)
    order[rank] = np.arange(n)
    return order


def suffix_order(text: np.ndarray, limit: int = SPILL_ITEMS) -> Iterator[np.ndarray]:
    """All positions of ``text`` in the order of their suffixes, in pieces.

    ``text`` holds numbers of which 0 ends each string (and the last one).
    """
    up = rising(text)
    leftmost = np.flatnonzero(up & np.append(True, ~up[:-1])) if len(text) else np.zeros(0, np.int64)
    if not len(leftmost):
        return
    # sort the substrings from one leftmost position to the next
    falling, rise = induce(text, up, leftmost, limit)
    is_seed = np.zeros(len(text), dtype=bool)
    is_seed[leftmost] = True
    by_substring = np.concatenate([p[is_seed[p]] for p in in_order(falling, rise)])
    names = _names(text, leftmost, by_substring)
    if names.max() + 1 < len(names):
        if names.max() < SMALL_ALPHABET:
            order = np.concatenate(list(_sorted_names(names, limit)))
        else:
            order = rank_by_doubling(names)
        seeds = leftmost[order]
    else:
        seeds = by_substring
    yield from in_order(*induce(text, up, seeds, limit))


def _names(text: np.ndarray, leftmost: np.ndarray, by_substring: np.ndarray) -> np.ndarray:
    """For each leftmost position in text order the rank of its substring; equal ones share a rank."""
    ends = np.append(leftmost[1:], len(text) - 1)
    pw = powers(int((ends - leftmost).max()) + 2)
    # substrings that contain an end are like no other
    has_end = (text[leftmost] == 0) | (text[ends] == 0)
    first = leftmost[0]
    rel = np.arange(first, len(text)) - np.repeat(leftmost, np.diff(np.append(leftmost, len(text))))
    value = (text[first:].astype(np.uint64) + np.uint64(1)) * pw[rel]
    h = np.add.reduceat(value, leftmost - first)
    h = mix64(h ^ mix64((text[ends].astype(np.uint64) << np.uint64(32)) + (ends - leftmost).astype(np.uint64)))
    at = np.searchsorted(leftmost, by_substring)
    hs, alone = h[at], has_end[at]
    new = np.append(True, (hs[1:] != hs[:-1]) | alone[1:] | alone[:-1])
    names = np.empty(len(leftmost), dtype=np.int64)
    names[at] = np.cumsum(new) - 1
    return names


def _sorted_names(names: np.ndarray, limit: int) -> Iterator[np.ndarray]:
    """Recursion: the suffix order of a string of names, closed by an end."""
    closed = np.append(names + 1, 0)
    for piece in suffix_order(closed, limit):
        yield piece[piece < len(names)]


def equal_windows(codes: np.ndarray, order: Iterator[np.ndarray], room: np.ndarray, width: int) -> Iterator[
        tuple[np.ndarray, np.ndarray]]:
    """(positions, first of its group) for suffixes with at least ``width`` characters before their end.

    Suffixes stand in order; a group shares its first ``width`` characters.
    Comparison is eight characters at a time.
    """
    padded = np.concatenate([codes, np.zeros(width + 8, dtype=np.uint8)])
    eight = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(padded, 8)).view("<u8").ravel()
    steps = [*range(0, width - 7, 8)]
    if width % 8:
        steps.append(width - 8)
    last = -1
    for piece in order:
        piece = piece[room[piece] >= width]
        if not len(piece):
            continue
        before = np.append(last if last >= 0 else piece[0], piece[:-1])
        same = np.ones(len(piece), dtype=bool)
        for s in steps:
            same &= eight[piece + s] == eight[before + s]
        if last < 0:
            same[0] = False
        last = int(piece[-1])
        yield piece, ~same
