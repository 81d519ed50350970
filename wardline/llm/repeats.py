"""Suffix-array dedup: removes bytes of passages that an earlier document has.

A byte of a document is removed if it lies in a string of ``width`` bytes that
also starts in a document with a smaller id.  Matches never cross documents
and are judged on the input.

Sorting every suffix of the corpus would write several times its size to
disk, so the suffixes that can matter are found first, without loss: every
window of ``width`` bytes has an anchor, the smallest hash of its 16-byte
strings, so equal windows have equal anchors.  Consecutive windows with one
anchor are a segment.

1. One row (anchor, digest of the segment) for each segment is dealt by
   anchor.  Equal segments of different documents settle all their windows at
   once.  An anchor with different segments in different documents is open.
2. The segments of open anchors are dealt by anchor; a task reads them as
   shards of some megabytes that end with an anchor.  Each shard sorts the
   suffixes of its distinct segments by external induced sorting
   (``suffixes.py``: queues on disk, recursion on named substrings); suffixes
   that share ``width`` bytes stand together, and the smallest id of such a
   group decides for all its windows.
3. The removed windows of each document are collected and its bytes cut.

Hot groups: rows of a busy anchor are read as a stream and never held; in a
shard only distinct segments have a text; one anchor's distinct segments are
sorted together, however many they are.

Defined results: a null or empty text has no bytes; a null id is never
smaller than another; rows that share an id do not remove from each other;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardline.llm.bitmaps import Bitmap
from wardline.llm.scratch import Scratch
from wardline.llm.suffixes import equal_windows, suffix_order
from wardline.llm.text import chunks, mix64, power_tables, segment_sums

WIDTH = 50
ANCHOR_BYTES = 16
MAX_STARTS = 4096      # windows of a segment
BITMAP_BITS = 26
SHARD_BYTES = 2 << 20  # distinct segments that are sorted together
CUT_ROWS = 1000
_NO_ID = np.iinfo(np.int64).max
_ODD = np.uint64(0x9E3779B97F4A7C55)


class Segments:
    """The segments of a chunk of documents."""

    def __init__(self, data: np.ndarray, off: np.ndarray, width: int):
        n, reach = len(data), width - ANCHOR_BYTES + 1
        self.doc = self.lo = self.n = np.zeros(0, np.int64)
        self.anchor = np.zeros(0, np.uint64)
        self.data, self.off, self.width = data, off, width
        if n < width:
            return
        padded = np.concatenate([data, np.zeros(ANCHOR_BYTES, np.uint8)])
        eight = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(padded, 8)[:n + 8]).view("<u8").ravel()
        low = mix64(eight[:n] * _ODD ^ mix64(eight[8:n + 8]))
        span = 1
        while 2 * span <= reach:
            low, span = np.minimum(low[:-span], low[span:]), 2 * span
        if reach > span:
            low = np.minimum(low[:span - reach], low[reach - span:])
        doc = np.repeat(np.arange(len(off) - 1), np.diff(off))[:len(low)]
        at = np.flatnonzero(np.arange(len(low)) + width <= off[doc + 1])
        if not len(at):
            return
        low, doc = low[at], doc[at]
        new = np.append(True, (low[1:] != low[:-1]) | (at[1:] != at[:-1] + 1) | (doc[1:] != doc[:-1]))
        start = np.flatnonzero(new)
        size = np.diff(np.append(start, len(at)))
        if size.max() > MAX_STARTS:  # repetitive text: cut long runs of windows
            pieces = -(-size // MAX_STARTS)
            start = np.repeat(start, pieces) + MAX_STARTS * (
                np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces))
            size = np.diff(np.append(start, len(at)))
        self.anchor, self.doc, self.begin, self.n = low[start], doc[start], at[start], size
        self.lo = self.begin - off[self.doc]

    def digests(self) -> np.ndarray:
        n, size = len(self.data), self.n + self.width - 1
        up, down = power_tables(n + 1)
        sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum((self.data.astype(np.uint64) + np.uint64(1)) * up[:n], out=sums[1:])
        own = (sums[self.begin + size] - sums[self.begin]) * down[self.begin]
        return mix64(own ^ mix64(size.astype(np.uint64)))


def _int64(values: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(values).view(np.int64))


def _segment_rows(width: int, wanted: Bitmap | None):
    """(anchor, digest, place, row, span) of all segments, or with their bytes those of the wanted anchors."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, place = batch.column("row").to_numpy(), batch.column("place").to_numpy()
            for a, _, data, off in chunks(batch.column("text"), 1 << 20):
                seg = Segments(data, off, width)
                if not len(seg.n):
                    continue
                digest, at = seg.digests(), a + seg.doc
                columns = [seg.anchor.view(np.int64), digest.view(np.int64), place[at], row[at],
                           seg.lo * 2 * MAX_STARTS + seg.n]
                names = ["anchor", "digest", "place", "row", "span"]
                if wanted is None:
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=names)
                    continue
                take = np.flatnonzero(wanted.has(seg.anchor))
                if not len(take):
                    continue
                size = seg.n[take] + width - 1
                ends = np.cumsum(size)
                bytes_at = np.repeat(seg.begin[take], size) + np.arange(ends[-1]) - np.repeat(ends - size, size)
                offsets = np.concatenate([[0], ends]).astype(np.int32)
                binary = pa.Array.from_buffers(pa.binary(), len(take), [
                    None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(data[bytes_at].tobytes())])
                yield pa.RecordBatch.from_arrays([pa.array(c[take]) for c in columns] + [binary],
                                                 names=[*names, "bytes"])
    return run


def _settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (anchor, digest, place) -> (row, span) whose segment an earlier document has,
    and the open anchors."""
    names = ["row", "span", "anchor"]
    group = None  # of the anchor in hand: anchor, last digest, least place of that digest, several digests?, places

    def open_anchors(anchors: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.nulls(len(anchors), pa.int64())] * 2 + [pa.array(anchors)], names=names)

    for batch in batches:
        if not batch.num_rows:
            continue
        anchor, digest, place, row, span = (batch.column(i).to_numpy() for i in range(5))
        new_anchor = np.append(True, anchor[1:] != anchor[:-1])
        new = new_anchor | np.append(True, digest[1:] != digest[:-1])
        start = np.flatnonzero(new)
        least = place[start]
        goes_on = group is not None and group[0] == anchor[0]
        if goes_on and group[1] == digest[0]:
            least[0] = group[2]
        removed = place > np.repeat(least, np.diff(np.append(start, len(place))))
        if removed.any():
            yield pa.RecordBatch.from_arrays(
                [pa.array(row[removed]), pa.array(span[removed]), pa.nulls(int(removed.sum()), pa.int64())], names=names)
        at = np.flatnonzero(new_anchor)
        several = np.add.reduceat(new.astype(np.int64), at) > 1
        low, high = np.minimum.reduceat(place, at), np.maximum.reduceat(place, at)
        if goes_on:
            several[0] |= group[3] or group[1] != digest[0]
            low[0], high[0] = min(low[0], group[4]), max(high[0], group[5])
        elif group is not None and group[3] and group[4] != group[5]:
            yield open_anchors(np.array([group[0]]))
        is_open = several & (low != high)
        if is_open[:-1].any():
            yield open_anchors(anchor[at[:-1]][is_open[:-1]])
        group = (anchor[-1], digest[-1], least[-1], bool(several[-1]), low[-1], high[-1])
    if group is not None and group[3] and group[4] != group[5]:
        yield open_anchors(np.array([group[0]]))


def shard_windows(texts: list[bytes], least: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """For distinct segments with their least place: (first position of each segment, least place of the
    documents that have the window at each position)."""
    sizes = np.array([len(t) for t in texts])
    first = np.concatenate([[0], np.cumsum(sizes + 1)])
    plain = np.frombuffer(b"\0".join(texts) + b"\0", dtype=np.uint8)
    codes = plain.astype(np.int16) + 1
    codes[first[1:] - 1] = 0
    owner = np.repeat(np.arange(len(texts)), sizes + 1)
    room = first[owner + 1] - 1 - np.arange(len(codes))
    group = np.full(len(codes), -1, dtype=np.int64)
    mins: list[np.ndarray] = []
    n = 0
    for positions, new in equal_windows(plain, suffix_order(codes), room, width):
        ids = n - 1 + np.cumsum(new)
        group[positions] = ids
        own = least[owner[positions]]
        starts = np.flatnonzero(np.append(True, ids[1:] != ids[:-1]))
        low = np.minimum.reduceat(own, starts)
        if not new[0]:  # the last group goes on
            mins[-1][-1] = min(mins[-1][-1], low[0])
            low = low[1:]
        if len(low):
            mins.append(low)
        n = int(ids[-1]) + 1
    by_group = np.append(np.concatenate(mins) if mins else np.zeros(0, np.int64), _NO_ID)
    return first, by_group[group]


class _Shard:
    """Distinct segments of some anchors, and the rows that have them."""

    def __init__(self):
        self.texts: list[bytes] = []
        self.least: list[np.ndarray] = []
        self.rows: list[tuple[np.ndarray, ...]] = []
        self.n_bytes = 0

    def add(self, batch: pa.RecordBatch, new: np.ndarray) -> None:
        place, row, span = (batch.column(i).to_numpy() for i in (2, 3, 4))
        index = len(self.texts) - 1 + np.cumsum(new)
        at = np.flatnonzero(new)
        texts = batch.column("bytes").take(pa.array(at)).to_pylist()
        self.texts.extend(texts)
        self.n_bytes += sum(map(len, texts))
        self.least.append(place[at])
        self.rows.append((index, place, row, span))

    def removed(self, width: int) -> Iterator[pa.RecordBatch]:
        """(row, lo, n) runs of windows that a document of smaller place has."""
        first, earliest = shard_windows(self.texts, np.concatenate(self.least), width)
        for index, place, row, span in self.rows:
            lo, n = span // (2 * MAX_STARTS), span % (2 * MAX_STARTS)
            ends = np.cumsum(n)
            rel = np.arange(ends[-1]) - np.repeat(ends - n, n)
            removed = earliest[np.repeat(first[index], n) + rel] < np.repeat(place, n)
            edge = np.diff(np.concatenate([[0], removed.view(np.int8), [0]]))
            # runs end with their row
            begin = np.flatnonzero(removed & ((edge[:-1] == 1) | (rel == 0)))
            if not len(begin):
                continue
            last = np.flatnonzero(removed & ((edge[1:] == -1) | (rel == np.repeat(n, n) - 1)))
            owner = np.repeat(np.arange(len(n)), n)[begin]
            yield pa.RecordBatch.from_arrays(
                [pa.array(row[owner]), pa.array(lo[owner] + rel[begin]), pa.array(last - begin + 1)],
                names=["row", "lo", "n"])


def _sort_shard(width: int):
    """Rows sorted by (anchor, digest, place) -> (row, lo, n) runs of removed windows.

    Equal windows have equal anchors, so a shard may end with any anchor; it
    does once it has ``SHARD_BYTES`` of distinct segments.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, last = _Shard(), None
        for batch in batches:
            if not batch.num_rows:
                continue
            anchor, digest = batch.column("anchor").to_numpy(), batch.column("digest").to_numpy()
            new_anchor = np.append(last is None or last[0] != anchor[0], anchor[1:] != anchor[:-1])
            new = new_anchor | np.append(last is None or last[1] != digest[0], digest[1:] != digest[:-1])
            last = (anchor[-1], digest[-1])
            start = 0
            cuts = np.flatnonzero(new_anchor)
            while start < batch.num_rows:
                if shard.n_bytes >= SHARD_BYTES and new_anchor[start]:
                    yield from shard.removed(width)
                    shard = _Shard()
                # rows up to an anchor's start at least CUT_ROWS further on
                later = cuts[cuts >= start + CUT_ROWS]
                end = int(later[0]) if len(later) else batch.num_rows
                shard.add(batch.slice(start, end - start), new[start:end])
                start = end
        if shard.texts:
            yield from shard.removed(width)
    return run


def _cut(width: int, keep_text: bool):
    """Bytes of each document without its removed windows."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("windows")
            off_l = lists.offsets.to_numpy().astype(np.int64)
            values = lists.values
            los, ns = values.field("lo").to_numpy(), values.field("n").to_numpy()
            counts = np.diff(off_l) * (~lists.is_null().to_numpy(zero_copy_only=False))
            for a, b, data, off in chunks(batch.column("text")):
                take = np.arange(off_l[a], off_l[b])
                doc = np.repeat(np.arange(b - a), counts[a:b])
                cover = np.zeros(len(data) + 1, dtype=np.int64)
                begin = off[doc] + los[take]
                np.add.at(cover, begin, 1)
                np.add.at(cover, begin + ns[take] - 1 + width, -1)
                gone = np.cumsum(cover[:-1]) > 0
                rise = gone.copy()
                rise[1:] &= ~gone[:-1] | np.isin(np.arange(1, len(data)), off)
                n_removed = segment_sums(gone.astype(np.int64), off)
                n_spans = segment_sums(rise.astype(np.int64), off)
                kept = [data[s:e][~gone[s:e]].tobytes() if r else data[s:e].tobytes()
                        for s, e, r in zip(off[:-1].tolist(), off[1:].tolist(), n_removed.tolist())]
                columns = [batch.column("doc_id").slice(a, b - a), pa.array(np.diff(off)), pa.array(n_removed),
                           pa.array(n_spans), pa.array([hashlib.sha256(k).hexdigest() for k in kept])]
                names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
                if keep_text:
                    columns.append(pa.array(kept, pa.binary()))
                    names.append("kept")
                yield pa.RecordBatch.from_arrays(columns, names=names)
    return run


def remove_repeats(docs: DataFrame, width: int = WIDTH, keep_text: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 (and the kept bytes) of each row of ``docs``."""
    scratch = Scratch(docs.sparkSession, "repeats")
    rows = scratch.number(docs, "doc_id", "text").select("row", "doc.doc_id", "doc.text").withColumn(
        "place", F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_ID)))
    keyed = rows.select("row", "place", "text")
    dealt = "anchor long, digest long, place long, row long, span long"
    settled = scratch.write(
        keyed.mapInArrow(_segment_rows(width, None), dealt).repartition("anchor")
        .sortWithinPartitions("anchor", "digest", "place").mapInArrow(_settle, "row long, span long, anchor long"),
        "settled")
    scratch.release()
    open_anchors = Bitmap.of(settled.where("anchor is not null"), "anchor", BITMAP_BITS)
    sorted_out = scratch.write(
        keyed.mapInArrow(_segment_rows(width, open_anchors), dealt + ", bytes binary").repartition("anchor")
        .sortWithinPartitions("anchor", "digest", "place").mapInArrow(_sort_shard(width), "row long, lo long, n long"),
        "sorted")
    scratch.release()
    two = 2 * MAX_STARTS
    whole = settled.where("row is not null").select(
        "row", F.expr(f"span div {two}").alias("lo"), (F.col("span") % two).alias("n"))
    windows = scratch.write(whole.union(sorted_out).groupBy("row").agg(
        F.collect_list(F.struct("lo", "n")).alias("windows")), "windows")
    scratch.release()
    id_type = docs.schema["doc_id"].dataType.simpleString()
    met = rows.join(windows, "row", "left").select("doc_id", "text", "windows")
    return met.mapInArrow(_cut(width, keep_text), f"doc_id {id_type}, n_bytes long, n_removed long, n_spans long, "
                                                  f"kept_sha256 string{', kept binary' if keep_text else ''}")


def op6_query(documents: DataFrame) -> DataFrame:
    return remove_repeats(documents)


ORACLE_SQL = f"""
WITH t AS (SELECT doc_id, lower(hex(encode(coalesce(text, '')))) AS x FROM documents),
w AS (
  SELECT doc_id, p, substr(x, 2 * p + 1, {2 * WIDTH}) AS s
  FROM (SELECT doc_id, x, unnest(range(0, length(x) // 2 - {WIDTH - 1})) AS p FROM t)),
least AS (SELECT s, min(doc_id) AS d FROM w GROUP BY s),
hit AS (SELECT w.doc_id, w.p FROM w JOIN least USING (s) WHERE least.d < w.doc_id),
isl AS (
  SELECT doc_id, p, CASE WHEN p <= lag(p) OVER (PARTITION BY doc_id ORDER BY p) + {WIDTH} THEN 0 ELSE 1 END AS fresh
  FROM hit),
spans AS (
  SELECT doc_id, g, min(p) AS a, max(p) + {WIDTH} AS b
  FROM (SELECT *, sum(fresh) OVER (PARTITION BY doc_id ORDER BY p) AS g FROM isl) GROUP BY doc_id, g),
gaps AS (
  SELECT doc_id, b AS s, lead(a, 1, NULL) OVER (PARTITION BY doc_id ORDER BY a) AS e FROM spans
  UNION ALL SELECT doc_id, 0, min(a) FROM spans GROUP BY doc_id),
kept AS (
  SELECT g.doc_id, string_agg(substr(x, 2 * s + 1, 2 * (coalesce(e, length(x) // 2) - s)), '' ORDER BY s) AS k
  FROM gaps g JOIN t USING (doc_id) GROUP BY g.doc_id),
sums AS (SELECT doc_id, sum(b - a) AS n, count(*) AS c FROM spans GROUP BY doc_id)
SELECT t.doc_id, length(x) // 2 AS n_bytes, CAST(coalesce(sums.n, 0) AS BIGINT) AS n_removed,
       coalesce(sums.c, 0) AS n_spans, sha256(unhex(coalesce(k, x))) AS kept_sha256
FROM t LEFT JOIN sums USING (doc_id) LEFT JOIN kept USING (doc_id)
"""
