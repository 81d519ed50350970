"""R-tree over count vectors, for joins by a bound on the overlap of two sets.

A set's elements are hashed into groups; the numbers of elements in the groups
are a point.  Two sets share at most the sum of the smaller of both counts in
each group.  The same sum over the upper corners of two boxes bounds every
pair of points in them, so pairs of nodes whose bound is below what the
smallest sets of both need are never opened.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np

LEAF = 16
SATURATED = 0xFF  # a count stored as this may be larger


def needed(a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    """Least overlap with which sets of a and b elements have a Jaccard similarity of ``percent`` %."""
    return -(-percent * (a + b) // (100 + percent))


def overlap_bound(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """Largest possible overlap of sets with count vectors a and b (saturated counts bound nothing)."""
    low = np.minimum(a, b)
    bound = low.sum(axis=-1, dtype=np.int64)
    open_ended = (low == SATURATED).any(axis=-1)
    return np.where(open_ended, np.minimum(n_a, n_b), bound)


@dataclass
class Node:
    rows: np.ndarray          # points below the node
    top: np.ndarray           # largest count of each group
    least: int                # size of the smallest set below
    most: int                 # size of the largest set below
    label: int | None         # the label all rows share, if they do
    children: list["Node"] = field(default_factory=list)


def build(points: np.ndarray, sizes: np.ndarray, labels: np.ndarray | None = None, leaf: int = LEAF) -> Node:
    """Bulk-load a tree: slabs along the coordinate (or size) that varies most, down to leaves."""
    def node(rows: np.ndarray) -> Node:
        own, n = points[rows], sizes[rows]
        label = None
        if labels is not None and (labels[rows] == labels[rows[0]]).all():
            label = int(labels[rows[0]])
        made = Node(rows, own.max(axis=0), int(n.min()), int(n.max()), label)
        if len(rows) > leaf:
            spread = own.max(axis=0).astype(np.int64) - own.min(axis=0)
            along = n if int(n.max() - n.min()) > int(spread.max()) else own[:, int(spread.argmax())]
            parts = min(8, -(-len(rows) // leaf))
            ordered = rows[np.argsort(along, kind="stable")]
            made.children = [node(p) for p in np.array_split(ordered, parts)]
        return made
    return node(np.arange(len(points)))


def _may_link(p: Node, q: Node, percent: int) -> bool:
    if p.label is not None and p.label == q.label:
        return False
    if 100 * min(p.most, q.most) < percent * max(p.least, q.least):
        return False  # sizes too far apart
    low = np.minimum(p.top, q.top)
    bound = min(p.most, q.most) if (low == SATURATED).any() else int(low.sum(dtype=np.int64))
    return bound >= int(needed(np.int64(p.least), np.int64(q.least), percent))


def join(p: Node, q: Node, points: tuple[np.ndarray, np.ndarray], sizes: tuple[np.ndarray, np.ndarray],
         labels: tuple[np.ndarray, np.ndarray], percent: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row pairs (of p's and q's points) with different labels whose bound reaches the needed overlap.

    With ``p is q`` every unordered pair comes once.
    """
    stack = [(p, q)]
    while stack:
        x, y = stack.pop()
        if not _may_link(x, y, percent):
            continue
        if x.children or y.children:
            if x is y:
                kids = x.children
                stack.extend((kids[i], kids[j]) for i in range(len(kids)) for j in range(i, len(kids)))
            elif x.children and (not y.children or len(x.rows) >= len(y.rows)):
                stack.extend((kid, y) for kid in x.children)
            else:
                stack.extend((x, kid) for kid in y.children)
            continue
        i, j = np.meshgrid(x.rows, y.rows, indexing="ij")
        i, j = i.ravel(), j.ravel()
        if x is y:
            upper = np.arange(len(x.rows))[:, None] < np.arange(len(y.rows))[None, :]
            i, j = i[upper.ravel()], j[upper.ravel()]
        differ = labels[0][i] != labels[1][j]
        i, j = i[differ], j[differ]
        if not len(i):
            continue
        n_i, n_j = sizes[0][i], sizes[1][j]
        keep = overlap_bound(points[0][i], points[1][j], n_i, n_j) >= needed(n_i, n_j, percent)
        if keep.any():
            yield i[keep], j[keep]
