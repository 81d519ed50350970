"""Line deduplication: segment-partition edit join.

Lines are what ``\\n`` separates.  An occurrence of a line is removed if the
same line occurs earlier in the corpus, or if another line within ``threshold``
edits of it (insert, delete or replace a character) does.  Earlier means: in a
document of smaller id, or before it in the same document.  Lines are judged
on the input, not on what is left.  Equal lines are found at every length;
blank lines (nothing but white space) are layout and stay.  Only the edit join
has a least length, ``min_chars``: in a shorter line the threshold is a large
part of the text, and two edits make another line of it.

A line is split into threshold + 1 even segments.  Of two lines within the
threshold, one segment of the shorter stands unchanged in the longer, near its
own place; so every line files its segments under (length, segment number,
segment) and looks up those of its substrings that can match, for each length
in reach.  Only hashes are exchanged for this.  Lines that meet under a key form a unit, long
units are cut into pages; their texts are then compared: counts of characters
drop most pairs, a banded bit-parallel edit distance decides the others.

Hot groups: repeated lines collapse by an aggregate; units hold distinct lines
only, each set of lines once, at most a page at a time, every two pages of a
unit meet in a task of their own.

Defined results: a null text has no lines and stays null; rows without an id
come last in the order; rows that share an id are in the order of the table;
an empty table gives an empty result; other columns pass through
``drop_repeated_lines`` untouched and are ignored otherwise.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardline.llm.bitmaps import Bitmap
from wardline.llm.ngram_join import consecutive_groups
from wardline.llm.scratch import Scratch
from wardline.llm.text import chunks, mix64, power_tables, segment_sums

THRESHOLD = 2
MIN_CHARS = 30
PAGE = 2048
BITMAP_BITS = 23
_NO_ID = np.iinfo(np.int64).max


# -- edit distance ------------------------------------------------------------
def within(a: str, b: str, limit: int) -> bool:
    """Whether at most ``limit`` (up to 20) edits lead from a to b; banded bit-parallel."""
    if abs(len(a) - len(b)) > limit:
        return False
    if a == b:
        return True
    lo, top = 0, min(len(a), len(b))
    while lo < top and a[lo] == b[lo]:
        lo += 1
    end_a, end_b = len(a), len(b)
    while end_a > lo and end_b > lo and a[end_a - 1] == b[end_b - 1]:
        end_a, end_b = end_a - 1, end_b - 1
    a, b = a[lo:end_a], b[lo:end_b]
    if len(a) < len(b):
        a, b = b, a
    if len(a) <= limit:
        return True
    if not b:
        return False
    # Column by column, only the cells whose row and column differ by at most the limit matter.  Bit i of
    # the vectors is row (column - limit + i): vertical steps up (vp) and down (vn), equal diagonals (d0).
    width = 2 * limit + 1
    full = (1 << width) - 1
    places: dict[str, int] = {}
    for i, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << i
    vp, vn = full & ~((1 << limit) - 1), 0
    corner, distance = 1 << (width - 1), limit
    rows = len(a)
    lowest = corner >> 1  # moves up once the band's lower edge has left the last row
    for j in range(len(b)):
        start = j - limit
        own = places.get(b[j], 0)
        match = (own >> start if start >= 0 else own << -start) & full
        d0 = ((((match & vp) + vp) ^ vp) | match | vn) & full
        hp = (vn | ~(d0 | vp)) & full
        hn = d0 & vp
        if j + limit < rows:
            distance += not d0 & corner
        else:
            distance += bool(hp & lowest) - bool(hn & lowest)
            lowest >>= 1
        vp = (hn | ~((d0 >> 1) | hp)) & full
        vn = (d0 >> 1) & hp
    return distance <= limit


# -- keys ---------------------------------------------------------------------
class Characters:
    """Code points of a chunk of documents, its lines, and hashes of any substrings."""

    def __init__(self, data: np.ndarray, off: np.ndarray):
        points = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), dtype="<u4")
        # code point offset of each document: bytes that begin a code point
        begins = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
        doc_off = begins[off]
        self.points, n = points, len(points)
        up, self.down = power_tables(n + 1)
        self.sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum((points.astype(np.uint64) + np.uint64(1)) * up[:n], out=self.sums[1:])
        breaks = np.flatnonzero(points == 10)
        doc_of_break = np.searchsorted(doc_off, breaks, side="right") - 1
        n_docs = len(off) - 1
        # a document of k breaks has k + 1 lines
        self.doc = np.sort(np.concatenate([np.arange(n_docs), doc_of_break]), kind="stable")
        self.start = np.sort(np.concatenate([doc_off[:-1], breaks + 1]), kind="stable")
        ends = np.concatenate([doc_off[1:], breaks])
        self.end = ends[np.lexsort((ends, np.concatenate([np.arange(n_docs), doc_of_break])))]
        first = np.searchsorted(self.doc, np.arange(n_docs))
        self.number = np.arange(len(self.doc)) - first[self.doc]
        written = np.concatenate([[0], np.cumsum((points != 0x20) & ((points < 0x09) | (points > 0x0D)))])
        self.blank = written[self.end] == written[self.start]

    def hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        h = (self.sums[end] - self.sums[start]) * self.down[start]
        return mix64(h ^ mix64((end - start).astype(np.uint64)))

    def text(self, i: int) -> str:
        return self.points[self.start[i]:self.end[i]].tobytes().decode("utf-32-le")


def segment(length: np.ndarray, i: int, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """Start and size of segment i when ``length`` characters are split evenly (longer ones last)."""
    small, long_ones = length // parts, length % parts
    short_ones = parts - long_ones
    return i * small + np.maximum(0, i - short_ones), small + (i >= short_ones)


def _key(segment_hash: np.ndarray, length: np.ndarray, i: int) -> np.ndarray:
    return mix64(segment_hash ^ mix64(length.astype(np.uint64) * np.uint64(64) + np.uint64(i)))


def keys_of(ch: Characters, lines: np.ndarray, threshold: int) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
    """(line numbers, keys, filed): the keys under which lines are filed, and others that they look up."""
    start, length, parts = ch.start[lines], ch.end[lines] - ch.start[lines], threshold + 1
    for delta in range(threshold + 1):
        target = length - delta  # length of the lines that are looked up
        for i in range(parts):
            at, size = segment(target, i, parts)
            low = np.maximum(-i, delta - (threshold - i))
            high = np.minimum(i, delta + (threshold - i))
            for shift in range(int(low), int(high) + 1):
                filed = delta == 0 and shift == 0
                s = at + shift
                ok = (s >= 0) & (s + size <= length) & (size > 0)
                begin = (start + s)[ok]
                yield lines[ok], _key(ch.hash(begin, begin + size[ok]), target[ok], i), filed


# -- scans --------------------------------------------------------------------
def _int64(values: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(values).view(np.int64))


def _occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every line with something in it (a null text has none)."""
    for batch in batches:
        row, order = batch.column("row"), batch.column("place")
        for a, _, data, off in chunks(batch.column("text")):
            ch = Characters(data, off)
            keep = ~ch.blank
            at = pa.array(a + ch.doc[keep])
            yield pa.RecordBatch.from_arrays(
                [row.take(at), order.take(at), pa.array(ch.number[keep].astype(np.int32)),
                 _int64(ch.hash(ch.start[keep], ch.end[keep]))], names=["row", "place", "line", "h"])


class _Fresh:
    """Tells which hashes a task meets for the first time (it forgets after a million)."""

    def __init__(self):
        self.seen: set[int] = set()

    def __call__(self, values: np.ndarray) -> np.ndarray:
        if len(self.seen) > 1 << 20:
            self.seen.clear()
        fresh = np.zeros(len(values), dtype=bool)
        for i, v in enumerate(values.tolist()):
            if v not in self.seen:
                self.seen.add(v)
                fresh[i] = True
        return fresh


def _line_keys(min_chars: int, threshold: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fresh = _Fresh()
        for batch in batches:
            for _, _, data, off in chunks(batch.column("text")):
                ch = Characters(data, off)
                lines = np.flatnonzero((ch.end - ch.start >= min_chars) & ~ch.blank)
                h = ch.hash(ch.start, ch.end)
                lines = lines[fresh(h[lines])]
                for own, keys, filed in keys_of(ch, lines, threshold):
                    yield pa.RecordBatch.from_arrays(
                        [_int64(keys), pa.array(np.full(len(own), not filed)), _int64(h[own])],
                        names=["key", "asks", "h"])
    return run


def _texts(min_chars: int, wanted: Bitmap):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fresh = _Fresh()
        for batch in batches:
            for _, _, data, off in chunks(batch.column("text")):
                ch = Characters(data, off)
                lines = np.flatnonzero((ch.end - ch.start >= min_chars) & ~ch.blank)
                h = ch.hash(ch.start, ch.end)
                lines = lines[wanted.has(h[lines])]
                lines = lines[fresh(h[lines])]
                if len(lines):
                    yield pa.RecordBatch.from_arrays([_int64(h[lines]), pa.array([ch.text(i) for i in lines.tolist()])],
                                                     names=["h", "text"])
    return run


def _units(page_rows: int):
    """Rows sorted by (key, asks, h) -> (unit, page, h, asks) for keys with a filed line and another one."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = [np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(0, np.int64)]
        page, filed_before = 0, False
        fresh = _Fresh()

        def batch_of(unit, page_no, h, asks):
            return pa.RecordBatch.from_arrays([pa.array(unit), pa.array(page_no.astype(np.int32)), pa.array(h),
                                               pa.array(asks)], names=["unit", "page", "h", "asks"])

        def distinct(key, asks, h):
            keep = np.append(True, (key[1:] != key[:-1]) | (h[1:] != h[:-1]) | (asks[1:] != asks[:-1])) \
                if len(key) else np.zeros(0, bool)
            return [key[keep], asks[keep], h[keep]]

        def whole(key, asks, h):
            start = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
            bounds = np.append(start, len(key))
            size = np.diff(bounds)
            differ = np.maximum.reduceat(h, start) != np.minimum.reduceat(h, start)
            keep = (size > 1) & ~asks[start] & differ
            unit = segment_sums(mix64(h.view(np.uint64) ^ mix64(asks.astype(np.uint64))), bounds) ^ mix64(
                size.astype(np.uint64))
            at = np.flatnonzero(keep)
            keep[at] = fresh(unit[at])
            run_of = np.repeat(np.arange(len(size)), size)
            take = keep[run_of]
            if take.any():
                yield batch_of(unit.view(np.int64)[run_of[take]], np.zeros(int(take.sum())), h[take], asks[take])

        def one_page(key, asks, h, page_no):
            return batch_of(mix64(key.view(np.uint64)).view(np.int64), np.full(len(key), page_no), h, asks)

        for batch in batches:
            new = [batch.column(0).to_numpy(), batch.column(1).to_numpy(zero_copy_only=False),
                   batch.column(2).to_numpy()]
            key, asks, h = distinct(*[np.concatenate(x) for x in zip(held, new)])
            if not len(key):
                continue
            last = int(np.searchsorted(key, key[-1]))
            if last:
                if page:
                    end = int(np.searchsorted(key, key[0], side="right"))
                    yield one_page(key[:end], asks[:end], h[:end], page)
                    page = 0
                    if end < last:
                        yield from whole(key[end:last], asks[end:last], h[end:last])
                else:
                    yield from whole(key[:last], asks[:last], h[:last])
                key, asks, h = key[last:], asks[last:], h[last:]
            if not page and asks[0] and len(key) > page_rows:
                # nobody files under this key: its lookups find nothing
                key, asks, h = key[-1:], asks[-1:], h[-1:]
            while len(key) > 2 * page_rows:
                yield one_page(key[:page_rows], asks[:page_rows], h[:page_rows], page)
                key, asks, h, page = key[page_rows:], asks[page_rows:], h[page_rows:], page + 1
            held = [key, asks, h]
        key, asks, h = held
        if len(key):
            if page:
                yield one_page(key, asks, h, page)
            else:
                yield from whole(key, asks, h)
    return run


def near_earlier(texts: list[str], rank: np.ndarray, side: np.ndarray, asks: np.ndarray, threshold: int) -> np.ndarray:
    """Rows that have an earlier row within the threshold.  Pairs need a filed row and, if both sides
    are present, a row of each side."""
    n = len(texts)
    length = np.array([len(t) for t in texts])
    counts = np.zeros((n, 32), dtype=np.int32)
    for i, t in enumerate(texts):
        counts[i] = np.bincount(np.frombuffer(t.encode("utf-32-le"), dtype="<u4") & 31, minlength=32)
    order = np.argsort(rank, kind="stable")
    two_sides = bool(side.any())
    near = np.zeros(n, dtype=bool)
    for p in range(1, n):
        y = order[p]
        x = order[:p]
        ok = (np.abs(length[x] - length[y]) <= threshold) & ~(asks[x] & asks[y])
        if two_sides:
            ok &= side[x] != side[y]
        x = x[ok]
        x = x[np.abs(counts[x] - counts[y]).sum(axis=1) <= 2 * threshold]
        near[y] = any(texts[i] != texts[y] and within(texts[i], texts[y], threshold) for i in x.tolist())
    return near


def _near(threshold: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in consecutive_groups(batches, ["unit", "page", "other"]):
            if len(t) < 2:
                continue
            place, row, line = (t[c].to_numpy() for c in ("place", "row", "line"))
            rank = np.empty(len(t), dtype=np.int64)
            rank[np.lexsort((line, row, place))] = np.arange(len(t))
            near = near_earlier(t["text"].to_pylist(), rank, t["side"].to_numpy(),
                                t["asks"].to_numpy(), threshold)
            if near.any():
                yield pa.RecordBatch.from_arrays([pa.array(t["h"].to_numpy()[near])], names=["h"])
    return run


# -- the operator -------------------------------------------------------------
def repeated_lines(docs: DataFrame, scratch: Scratch, threshold: int, min_chars: int) -> DataFrame:
    """(row, line, near) of every occurrence to remove, for (row, place, text) rows."""
    seen = scratch.write(docs.mapInArrow(_occurrences, "row long, place long, line int, h long"), "seen")
    first = scratch.write(seen.groupBy("h").agg(F.min(F.struct("place", "row", "line")).alias("first"),
                                                F.count("*").alias("n")), "first")
    texts_only = docs.select("text")
    keyed = texts_only.mapInArrow(_line_keys(min_chars, threshold), "key long, asks boolean, h long")
    units = scratch.write(keyed.repartition("key").sortWithinPartitions("key", "asks", "h")
                          .mapInArrow(_units(PAGE), "unit long, page int, h long, asks boolean")
                          .groupBy("unit", "page", "h").agg(F.min("asks").alias("asks")), "units")
    scratch.release()
    met = units.select("h").distinct()
    wanted = Bitmap.of(met, "h", BITMAP_BITS)
    lines = scratch.write(
        texts_only.mapInArrow(_texts(min_chars, wanted), "h long, text string").join(met, "h", "left_semi")
        .groupBy("h").agg(F.first("text").alias("text"))
        .join(first.select("h", "first.*"), "h"), "lines")
    members = scratch.write(units.join(lines, "h"), "members")
    pages = scratch.write(units.groupBy("unit", "page").agg(F.count("*").alias("n")), "pages")
    x, y = pages.alias("x"), pages.where("page > 0").alias("y")
    crossing = x.join(y, (F.col("x.unit") == F.col("y.unit")) & (F.col("x.page") < F.col("y.page"))).select(
        F.col("x.unit").alias("unit"), F.col("x.page").alias("page"), F.col("y.page").alias("other"))
    cols = ["unit", "page", "other", "side", "h", "asks", "text", "place", "row", "line"]
    alone = members.withColumn("other", F.col("page")).withColumn("side", F.lit(0)).select(*cols)
    left = members.join(crossing, ["unit", "page"]).withColumn("side", F.lit(0)).select(*cols)
    right = (members.withColumnRenamed("page", "other").join(crossing, ["unit", "other"])
             .withColumn("side", F.lit(1)).select(*cols))
    near = scratch.write(alone.union(left).union(right).repartition("unit", "page", "other")
                         .sortWithinPartitions("unit", "page", "other")
                         .mapInArrow(_near(threshold), "h long").distinct(), "near")
    marked = scratch.write(
        first.join(near.withColumn("near", F.lit(True)), "h", "left")
        .where("n > 1 or near").select("h", "first", F.coalesce("near", F.lit(False)).alias("near")), "marked")
    same = (F.col("first.row") == F.col("row")) & (F.col("first.line") == F.col("line"))
    return seen.join(marked, "h").where(F.col("near") | ~same).select("row", "line", "near")


def _placed(rows: DataFrame) -> DataFrame:
    """(row, place, text) of numbered rows: the row's number and its document's place in the order."""
    return rows.select("row", F.coalesce(F.col("doc.doc_id").cast("long"), F.lit(_NO_ID)).alias("place"),
                       F.col("doc.text").alias("text"))


def line_report(docs: DataFrame, threshold: int = THRESHOLD, min_chars: int = MIN_CHARS) -> DataFrame:
    """doc_id, n_lines, n_removed, n_near and the removed line numbers of each document."""
    scratch = Scratch(docs.sparkSession, "lines")
    rows, text = scratch.number(docs, "doc_id", "text"), F.col("doc.text")
    removed = repeated_lines(_placed(rows), scratch, threshold, min_chars).groupBy("row").agg(
        F.count("*").alias("n_removed"), F.count(F.when(F.col("near"), 1)).alias("n_near"),
        F.array_sort(F.collect_list("line")).alias("lines"))
    own = rows.select("row", F.col("doc.doc_id").alias("doc_id"),
                      F.when(text.isNull(), 0).otherwise(
                          F.regexp_count(text, F.lit("\n")) + 1).cast("long").alias("n_lines"))
    return own.join(removed, "row", "left").select(
        "doc_id", "n_lines", F.coalesce("n_removed", F.lit(0)).alias("n_removed"),
        F.coalesce("n_near", F.lit(0)).alias("n_near"),
        F.coalesce(F.array_join("lines", ","), F.lit("")).alias("removed_lines"))


def drop_repeated_lines(docs: DataFrame, threshold: int = THRESHOLD, min_chars: int = MIN_CHARS) -> DataFrame:
    """``docs`` without the removed lines; rows of which no text is left are dropped."""
    scratch = Scratch(docs.sparkSession, "lines")
    rows = scratch.number(docs)
    removed = scratch.write(repeated_lines(_placed(rows), scratch, threshold, min_chars).groupBy("row").agg(
        F.collect_set("line").alias("lines")), "removed")
    scratch.keep_only("rows", "removed")
    scratch.release()
    text = F.col("doc.text")
    kept = F.array_join(F.filter(F.split(text, "\n"), lambda x, i: ~F.array_contains("lines", i)), "\n")
    joined = (rows.join(removed.hint("merge"), "row", "left")  # the same plan at every size
              .withColumn("cut", F.when(F.col("lines").isNull(), text).otherwise(kept)))
    left = joined.where(F.col("lines").isNull() | F.col("cut").rlike(r"[^\x20\x09-\x0D]"))
    return left.select(*[F.col("cut").alias(c) if c == "text" else F.col(f"doc.`{c}`").alias(c) for c in docs.columns])


def op9_query(documents: DataFrame) -> DataFrame:
    return line_report(documents)


ORACLE_SQL = rf"""
WITH l AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line,
         unnest(range(len(string_split(text, chr(10))))) AS i
  FROM documents WHERE text IS NOT NULL),
first AS (
  SELECT line, length(line) AS n, min((doc_id, i)) AS at FROM l
  WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY line),
near AS (
  SELECT DISTINCT y.line FROM first x JOIN first y
    ON x.n >= {MIN_CHARS} AND y.n >= {MIN_CHARS}
   AND x.n BETWEEN y.n - {THRESHOLD} AND y.n + {THRESHOLD} AND x.at < y.at
   AND levenshtein(x.line, y.line) <= {THRESHOLD}),
removed AS (
  SELECT l.doc_id, l.i, near.line IS NOT NULL AS near
  FROM l JOIN first ON l.line = first.line LEFT JOIN near ON near.line = l.line
  WHERE near.line IS NOT NULL OR (l.doc_id, l.i) <> first.at)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN 0 ELSE len(string_split(d.text, chr(10))) END AS n_lines,
       coalesce(r.n, 0) AS n_removed, coalesce(r.n_near, 0) AS n_near, coalesce(r.lines, '') AS removed_lines
FROM documents d LEFT JOIN (
  SELECT doc_id, count(*) AS n, count(*) FILTER (near) AS n_near,
         string_agg(CAST(i AS VARCHAR), ',' ORDER BY i) AS lines
  FROM removed GROUP BY doc_id) r USING (doc_id)
"""
