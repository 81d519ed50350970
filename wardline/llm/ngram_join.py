"""N-gram Jaccard join: count vectors in R-trees.

Documents are sets of distinct word shingles (five words, A-Z lower-cased;
with fewer words the whole sequence).  Two documents link when their sets have
a Jaccard similarity of at least ``percent`` %.  Result: the connected
components of the links.  No link between different sets is lost.

1. Profile (one pass): a hash of each set, its size and its count vector.
   Documents with the same set are one class from here on.  Shingles that
   several documents of a task share are counted along; the frequent ones
   become a bitmap of fixed size.
2. Routing: linked sets of n elements share one of the first n - ceil(t n) + 1
   elements in any common order.  The order puts frequent elements last, so
   passages that many documents share seldom bring documents together.  Rows
   (element, class) are dealt by element; classes that meet form a unit, a
   unit of more than ``PAGE`` classes is cut into pages along the set size.
3. Count vectors and R-trees: the bound drops pairs that cannot reach the
   needed overlap.  The first rounds let the classes of a unit meet in small
   random buckets and form the components of the links found there; they only
   save work, so a bucket gives the likeliest pairs that connect it and a few
   for each class, not all of its pairs.  Then R-trees are joined (of one page,
   and of every two pages of a unit whose sizes fit) and give all remaining
   pairs of different components, with subtrees of one component skipped.  A
   pair that shares many units is sent by the first of them: each row names the
   first units of its class, and a pair with a named earlier unit in common is
   left to that one.  A group of near copies thus costs a few verifications for
   each member, not one for each pair or unit.
4. Verification compares the sets themselves, built again from the texts.

Hot groups: exact copies collapse by an aggregate; the pairs of a class with
many partners are salted; pages bound what a task holds.  Only bitmaps of fixed
size reach the driver.  Sets and classes are told apart by 64-bit hashes.

Defined results: a null or empty text, or one without words, has the empty
set and links with nothing, so its component is its own id; repeated rows each
get their row; a row with a null id joins components but never names one (a
component without any id is null); an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardline.llm import rtree
from wardline.llm.bitmaps import Bitmap
from wardline.llm.components import components
from wardline.llm.scratch import Scratch
from wardline.llm.text import chunks, mix64, segment_sums, shingles, sort_distinct, words

PERCENT = 80
WIDTH = 5
GROUPS = 256
PAGE = 4096
BITMAP_BITS = 23
COUNT_TOKENS = 1 << 22     # elements that a task counts at a time
FREQUENT = 8               # documents that make an element frequent
PAIRS_PER_SALT = 2000
ROUNDS = 3
BUCKET = 24               # classes that meet at random in a first round
BEST = 2                  # pairs that a class has in its bucket beyond those that connect the bucket
FIRST_UNITS = 16          # units that a class names, so that a pair is sent by one unit only
SALT = np.uint64(0x5851F42D4C957F2D)


# -- sets ---------------------------------------------------------------------
def sets_of(data: np.ndarray, off: np.ndarray, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """Sorted 63-bit elements of each document's set, and the bounds."""
    h, first = shingles(words(data, off, lower=True), width)
    return sort_distinct(h >> np.uint64(1), first)


def class_hash(elements: np.ndarray, first: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each set."""
    n = np.diff(first).astype(np.uint64)
    one, two = segment_sums(mix64(elements), first), segment_sums(mix64(elements ^ SALT), first)
    return mix64(one ^ mix64(two ^ mix64(n)))


def count_vectors(elements: np.ndarray, first: np.ndarray) -> np.ndarray:
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
    group = (elements >> np.uint64(63 - GROUPS.bit_length() + 1)).astype(np.int64)
    counts = np.bincount(doc * GROUPS + group, minlength=(len(first) - 1) * GROUPS)
    return np.minimum(counts, rtree.SATURATED).astype(np.uint8).reshape(-1, GROUPS)


def _fixed_binary(rows: np.ndarray) -> pa.Array:
    n, width = len(rows), rows.shape[1] * rows.itemsize if rows.ndim == 2 else rows.itemsize
    off = pa.py_buffer((np.arange(n + 1) * width).astype(np.int32).tobytes())
    return pa.Array.from_buffers(pa.binary(), n, [None, off, pa.py_buffer(np.ascontiguousarray(rows).tobytes())])


def _int64(values: np.ndarray) -> pa.Array:
    return pa.array(values.astype(np.uint64).view(np.int64))


# -- step 1: profile ----------------------------------------------------------
def _profile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", "n", "cls", "vec", "element", "seen"]
    seen_sets: set[int] = set()
    held, n_held = [], 0

    def frequent() -> Iterator[pa.RecordBatch]:
        values, counts = np.unique(np.concatenate(held), return_counts=True) if held else (np.zeros(0, np.uint64),) * 2
        values, counts = values[counts > 1], counts[counts > 1]
        if len(values):
            none = lambda t: pa.nulls(len(values), t)
            yield pa.RecordBatch.from_arrays([none(id_type), none(pa.int32()), none(pa.int64()), none(pa.binary()),
                                              _int64(values), pa.array(counts.astype(np.int64))], names=names)

    for batch in batches:
        id_type = batch.schema.field("doc_id").type
        for a, b, data, off in chunks(batch.column("text")):
            elements, first = sets_of(data, off)
            n, cls = np.diff(first), class_hash(elements, first)
            k = b - a
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").slice(a, k), pa.array(n.astype(np.int32)), _int64(cls),
                 _fixed_binary(count_vectors(elements, first)), pa.nulls(k, pa.int64()), pa.nulls(k, pa.int64())],
                names=names)
            for i, c in enumerate(cls.tolist()):
                if n[i] and c not in seen_sets:
                    seen_sets.add(c)
                    held.append(elements[first[i]:first[i + 1]])
                    n_held += int(n[i])
            if n_held >= COUNT_TOKENS:
                yield from frequent()
                held, n_held = [], 0
                seen_sets.clear()
    if held:
        yield from frequent()


# -- step 2: routing ----------------------------------------------------------
def _route(bitmap: Bitmap, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen_sets: set[int] = set()
        for batch in batches:
            for _, _, data, off in chunks(batch.column("text")):
                elements, first = sets_of(data, off)
                n, cls = np.diff(first), class_hash(elements, first)
                fresh = np.zeros(len(n), dtype=bool)
                for i, c in enumerate(cls.tolist()):
                    if n[i] and c not in seen_sets:
                        seen_sets.add(c)
                        fresh[i] = True
                if len(seen_sets) > 1 << 20:
                    seen_sets.clear()  # copies that come again are dropped after the exchange
                late = bitmap.has(elements)  # frequent elements come last in the common order
                ordered = elements | (late.astype(np.uint64) << np.uint64(63))
                for i in np.flatnonzero(segment_sums(late.astype(np.int64), first)).tolist():
                    ordered[first[i]:first[i + 1]].sort()
                length = np.where(fresh, n - -(-percent * n // 100) + 1, 0)
                doc = np.repeat(np.arange(len(n)), n)
                take = np.arange(len(elements)) - first[doc] < length[doc]
                yield pa.RecordBatch.from_arrays(
                    [_int64(ordered[take]), _int64(cls[doc[take]]), pa.array(n[doc[take]].astype(np.int32))],
                    names=["element", "cls", "n"])
    return run


def _units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by element, size and class -> (unit, page, cls, n) of elements with two classes or more."""
    el, cl, nn = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)
    page = 0                     # pages already sent of the run in hand
    sent: set[int] = set()

    def rows(unit, page_no, cls, n):
        return pa.RecordBatch.from_arrays(
            [pa.array(unit), pa.array(page_no.astype(np.int32)), pa.array(cls), pa.array(n)],
            names=["unit", "page", "cls", "n"])

    def whole_runs(el, cl, nn):
        start = np.flatnonzero(np.append(True, el[1:] != el[:-1]))
        size = np.diff(np.append(start, len(el)))
        unit = segment_sums(mix64(cl.view(np.uint64)), np.append(start, len(el))) ^ mix64(size.astype(np.uint64))
        keep = size > 1
        for r in np.flatnonzero(keep).tolist():
            u = int(unit[r])
            if u in sent:
                keep[r] = False
            else:
                sent.add(u)
        if len(sent) > 1 << 20:
            sent.clear()  # units that come again are dropped after the exchange
        run = np.repeat(np.arange(len(size)), size)
        take = keep[run]
        if take.any():
            yield rows(unit.view(np.int64)[run[take]], np.zeros(int(take.sum())), cl[take], nn[take])

    def one_page(el, cl, nn, page_no):
        unit = mix64(el.view(np.uint64) ^ SALT).view(np.int64)
        return rows(unit, np.full(len(el), page_no), cl, nn)

    def distinct(el, cl, nn):
        keep = np.append(True, (el[1:] != el[:-1]) | (cl[1:] != cl[:-1])) if len(el) else np.zeros(0, bool)
        return el[keep], cl[keep], nn[keep]

    for batch in batches:
        new = [batch.column(i).to_numpy() for i in range(3)]
        el, cl, nn = distinct(*[np.concatenate(x) for x in zip((el, cl, nn), new)])
        if not len(el):
            continue
        last = int(np.searchsorted(el, el[-1]))  # the run in hand goes on in the next batch
        if last:
            if page:
                end = int(np.searchsorted(el, el[0], side="right"))
                yield one_page(el[:end], cl[:end], nn[:end], page)
                page = 0
                if end < last:
                    yield from whole_runs(el[end:last], cl[end:last], nn[end:last])
            else:
                yield from whole_runs(el[:last], cl[:last], nn[:last])
            el, cl, nn = el[last:], cl[last:], nn[last:]
        while len(el) > 2 * PAGE:
            yield one_page(el[:PAGE], cl[:PAGE], nn[:PAGE], page)
            el, cl, nn, page = el[PAGE:], cl[PAGE:], nn[PAGE:], page + 1
    if len(el):
        if page:
            yield one_page(el, cl, nn, page)
        else:
            yield from whole_runs(el, cl, nn)


# -- step 3: trees ------------------------------------------------------------
def consecutive_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Consecutive rows with equal keys, as tables (rows are sorted by the keys)."""
    held: list[pa.Table] = []
    held_key = None
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [batch.column(k).to_numpy() for k in keys]
        change = np.zeros(batch.num_rows, dtype=bool)
        for c in cols:
            change[1:] |= c[1:] != c[:-1]
        bounds = [0, *np.flatnonzero(change).tolist(), batch.num_rows]
        for a, b in zip(bounds, bounds[1:]):
            key = tuple(c[a] for c in cols)
            if held and key != held_key:
                yield pa.concat_tables(held)
                held = []
            held_key = key
            held.append(pa.Table.from_batches([batch.slice(a, b - a)]))
    if held:
        yield pa.concat_tables(held)


def _vectors(col: pa.ChunkedArray) -> np.ndarray:
    if isinstance(col, pa.ChunkedArray):
        col = pa.concat_arrays(col.chunks) if col.num_chunks != 1 else col.chunk(0)
    off = np.frombuffer(col.buffers()[1], dtype=np.int32)[col.offset:col.offset + len(col) + 1]
    return np.frombuffer(col.buffers()[2], dtype=np.uint8)[off[0]:off[-1]].reshape(len(col), GROUPS)


class _Pairs:
    """Collects pairs and yields them as batches."""

    def __init__(self):
        self.a, self.b, self.n = [], [], 0

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        low = np.minimum(a, b)
        self.a.append(low)
        self.b.append(np.maximum(a, b))
        self.n += len(low)

    def flush(self, least: int = 1) -> Iterator[pa.RecordBatch]:
        if self.n >= least:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(self.a)), pa.array(np.concatenate(self.b))],
                                             names=["a", "b"])
            self.__init__()


def _bucket_pairs(percent: int):
    """Rows sorted by (unit, bucket): likely pairs of a bucket that differ in component and pass the bound."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = _Pairs()
        for t in _whole_buckets(batches):
            unit, bucket, cls, comp = (t[c].to_numpy() for c in ("unit", "bucket", "cls", "comp"))
            n, vec = t["n"].to_numpy().astype(np.int64), _vectors(t["vec"])
            left, right, score = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
            step = 1
            while step < len(cls):
                i = np.flatnonzero((unit[step:] == unit[:-step]) & (bucket[step:] == bucket[:-step]))
                if not len(i):
                    break
                i = i[comp[i] != comp[i + step]]
                for a in range(0, len(i), 1 << 16):
                    x, y = i[a:a + (1 << 16)], i[a:a + (1 << 16)] + step
                    bound, need = rtree.overlap_bound(vec[x], vec[y], n[x], n[y]), rtree.needed(n[x], n[y], percent)
                    keep = bound >= need
                    left.append(x[keep])
                    right.append(y[keep])
                    score.append(bound[keep] / need[keep])
                step += 1
            x, y = np.concatenate(left), np.concatenate(right)
            group = np.cumsum(np.append(False, (unit[1:] != unit[:-1]) | (bucket[1:] != bucket[:-1])))
            keep = _likeliest(x, y, np.concatenate(score), group, comp)
            out.add(cls[x[keep]], cls[y[keep]])
            yield from out.flush(10_000)
        yield from out.flush()
    return run


def _likeliest(x: np.ndarray, y: np.ndarray, score: np.ndarray, group: np.ndarray, comp: np.ndarray) -> list[int]:
    """Of the row pairs (x, y): those of highest score that connect the components of each group of rows, and those
    of rows with fewer than ``BEST`` pairs so far."""
    label = np.unique(comp, return_inverse=True)[1]
    up = np.unique(group * (int(label.max()) + 1) + label, return_inverse=True)[1]
    up, own = list(range(len(up))), up.tolist()   # component of each row within its group, and their union

    def top(a: int) -> int:
        while up[a] != a:
            up[a] = a = up[up[a]]
        return a

    had, kept = [0] * len(own), []
    left, right = x.tolist(), y.tolist()
    for k in np.argsort(-score, kind="stable").tolist():
        i, j = left[k], right[k]
        a, b = top(own[i]), top(own[j])
        if a != b or had[i] < BEST or had[j] < BEST:
            up[a] = b
            had[i] += 1
            had[j] += 1
            kept.append(k)
    return kept


def _whole_buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Tables of whole (unit, bucket) groups, many groups at a time."""
    rest = None
    for batch in batches:
        if not batch.num_rows:
            continue
        t = pa.Table.from_batches([batch])
        t = pa.concat_tables([rest, t]) if rest is not None else t
        unit, bucket = t["unit"].to_numpy(), t["bucket"].to_numpy()
        other = np.flatnonzero((unit != unit[-1]) | (bucket != bucket[-1]))
        cut = int(other[-1]) + 1 if len(other) else 0
        if cut:
            yield t.slice(0, cut)
        rest = t.slice(cut).combine_chunks()
    if rest is not None and rest.num_rows:
        yield rest


def _tree_pairs(percent: int):
    """Rows sorted by (unit, page, other, side): pairs of different components that pass the bound and share no
    earlier unit that both name."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = _Pairs()
        for t in consecutive_groups(batches, ["unit", "page", "other"]):
            side, cls = t["side"].to_numpy(), t["cls"].to_numpy()
            n, comp, vec = t["n"].to_numpy().astype(np.int64), t["comp"].to_numpy(), _vectors(t["vec"])
            rows = [np.flatnonzero(side == s) for s in (0, 1)]
            if not len(rows[0]) or (t["page"][0] != t["other"][0] and not len(rows[1])):
                continue
            if not len(rows[1]):
                rows[1] = rows[0]
            named, known = _earlier(t["first"], t["unit"][0].as_py())
            sides = [(vec[r], n[r], comp[r], cls[r], named[r], known[r]) for r in rows]
            left = rtree.build(*sides[0][:3])
            right = left if rows[1] is rows[0] else rtree.build(*sides[1][:3])
            points, sizes, labels, ids, named, known = zip(*sides)
            for i, j in rtree.join(left, right, points, sizes, labels, percent):
                same = (named[0][i][:, :, None] == named[1][j][:, None, :]) & known[0][i][:, :, None]
                first = ~(same & known[1][j][:, None, :]).any(axis=(1, 2))
                out.add(ids[0][i[first]], ids[1][j[first]])
                yield from out.flush(10_000)
        yield from out.flush()
    return run


def _earlier(first: pa.ChunkedArray, unit: int) -> tuple[np.ndarray, np.ndarray]:
    """The units that each row names, and which of these places hold one before ``unit``."""
    first = first.combine_chunks()
    first = pa.concat_arrays(first.chunks) if isinstance(first, pa.ChunkedArray) else first
    size = first.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    known = np.arange(FIRST_UNITS) < size[:, None]
    named = np.zeros(known.shape, np.int64)
    named[known] = first.flatten().to_numpy()
    return named, known & (named < unit)


# -- step 4: verification -----------------------------------------------------
def _class_texts(bitmap: Bitmap):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for a, b, data, off in chunks(batch.column("text")):
                elements, first = sets_of(data, off)
                cls = class_hash(elements, first)
                wanted = bitmap.has(cls) & (np.diff(first) > 0)
                for i in np.flatnonzero(wanted).tolist():
                    c = int(cls[i])
                    wanted[i] = c not in seen
                    seen.add(c)
                if len(seen) > 1 << 20:
                    seen.clear()
                at = np.flatnonzero(wanted)
                if len(at):
                    yield pa.RecordBatch.from_arrays([_int64(cls[at]), batch.column("text").take(pa.array(a + at))],
                                                     names=["cls", "text"])
    return run


def _linked(percent: int):
    """Rows sorted by (a, salt, not hub): the hub's text, then its partners' -> links."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hub, hub_set = None, None
        for batch in batches:
            a_col, b_col = batch.column("a").to_numpy(), batch.column("b").to_numpy()
            for s, e, data, off in chunks(batch.column("text")):
                elements, first = sets_of(data, off)
                links = []
                for i in range(e - s):
                    a, b, own = a_col[s + i], b_col[s + i], elements[first[i]:first[i + 1]]
                    if a == b:
                        hub, hub_set = a, own.copy()
                        continue
                    assert hub == a
                    at = np.searchsorted(hub_set, own)
                    both = int((hub_set[np.minimum(at, len(hub_set) - 1)] == own).sum())
                    if 100 * both >= percent * (len(hub_set) + len(own) - both):
                        links.append((a, b))
                if links:
                    x, y = zip(*links)
                    yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()), pa.array(y, pa.int64())],
                                                     names=["a", "b"])
    return run


def _verify(scratch: Scratch, pairs: DataFrame, texts: DataFrame, percent: int, name: str) -> DataFrame:
    """The pairs (a, b) whose sets reach the similarity."""
    hubs = pairs.groupBy("a").agg(F.ceil(F.count("*") / PAIRS_PER_SALT).cast("int").alias("salts"))
    salted = pairs.join(hubs, "a").withColumn("salt", F.pmod(F.xxhash64("b"), F.col("salts")).cast("int"))
    # texts are always dealt, never a small side broadcast to them: the same plan at every size
    partners = salted.hint("merge").join(texts.withColumnRenamed("cls", "b"), "b").select("a", "salt", "b", "text")
    heads = (hubs.hint("merge").join(texts.withColumnRenamed("cls", "a"), "a")
             .withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))
             .select("a", "salt", F.col("a").alias("b"), "text"))
    met = heads.union(partners).repartition("a", "salt").sortWithinPartitions("a", "salt", F.col("a") != F.col("b"))
    return scratch.write(met.mapInArrow(_linked(percent), "a long, b long"), name)


# -- the join -----------------------------------------------------------------
def link_components(docs: DataFrame, percent: int = PERCENT, scratch: Scratch | None = None) -> DataFrame:
    """doc_id, n_shingles, component_id and root (one number for each component) for each row of ``docs`` (doc_id, text).

    The result reads the tables ``profile`` and ``named`` of ``scratch``; all others are dropped as they are consumed.
    """
    scratch = scratch or Scratch(docs.sparkSession, "ngram")
    docs = docs.select(docs["doc_id"], docs["text"])
    id_type = docs.schema["doc_id"].dataType.simpleString()
    profile = scratch.write(docs.mapInArrow(
        _profile, f"doc_id {id_type}, n int, cls long, vec binary, element long, seen long"), "profile")
    rows = profile.where("n is not null").select("doc_id", "n", "cls", "vec")
    frequent = Bitmap.of(profile.where("element is not null").groupBy("element").agg(F.sum("seen").alias("seen"))
                         .where(F.col("seen") >= FREQUENT), "element", BITMAP_BITS)

    texts_only = docs.select("text")
    routed = texts_only.mapInArrow(_route(frequent, percent), "element long, cls long, n int")
    units = scratch.write(
        routed.repartition("element").sortWithinPartitions("element", "n", "cls")
        .mapInArrow(_units, "unit long, page int, cls long, n int")
        .distinct(), "units")

    met = units.select("cls").distinct()
    wanted = Bitmap.of(met, "cls", BITMAP_BITS)
    vectors = scratch.write(rows.select("cls", "vec").join(met, "cls", "left_semi").groupBy("cls")
                            .agg(F.first("vec").alias("vec")), "vectors")
    texts = scratch.write(
        texts_only.mapInArrow(_class_texts(wanted), "cls long, text string").join(met, "cls", "left_semi")
        .groupBy("cls").agg(F.first("text").alias("text")), "texts")

    # first rounds: each class in the largest of its units, in small random buckets
    sizes = units.groupBy("unit").agg(F.count("*").alias("size"))
    home = scratch.write(
        units.join(sizes, "unit").groupBy("cls").agg(F.max(F.struct("size", "unit", "n")).alias("u"))
        .select("cls", "u.unit", "u.size", "u.n").join(vectors, "cls"), "home")
    scratch.release()
    links, comps = None, None
    for turn in range(ROUNDS):
        rows_in = home if comps is None else home.join(_mixed_units(home, comps), "unit", "left_semi")
        pairs = (_labelled(rows_in, comps)
                 .withColumn("bucket", F.pmod(F.xxhash64("cls", F.lit(turn)), F.ceil(F.col("size") / BUCKET)))
                 .select("unit", "bucket", "cls", "n", "vec", "comp")
                 .repartition("unit", "bucket").sortWithinPartitions("unit", "bucket")
                 .mapInArrow(_bucket_pairs(percent), "a long, b long").distinct())
        pairs = scratch.write(pairs, f"bucket-pairs-{turn}")
        found = _verify(scratch, pairs, texts, percent, f"bucket-links-{turn}")
        scratch.drop(f"bucket-pairs-{turn}")
        links = found if links is None else links.union(found)
        comps = components(scratch, links, f"bucket-{turn}")
        scratch.release()

    # then all pairs of different components in all units, by their trees
    mixed = units.join(_mixed_units(units, comps), "unit", "left_semi")
    first = mixed.groupBy("cls").agg(F.slice(F.sort_array(F.collect_set("unit")), 1, FIRST_UNITS).alias("first"))
    labelled = scratch.write(_labelled(mixed, comps).join(vectors.join(first, "cls"), "cls"), "labelled")
    scratch.drop("home", "vectors")
    pages = scratch.write(labelled.groupBy("unit", "page").agg(F.min("n").alias("low"), F.max("n").alias("high")),
                          "pages")
    x, y = pages.alias("x"), pages.where("page > 0").alias("y")
    fits = 100 * F.col("x.high") >= percent * F.col("y.low")  # pages run along the size
    crossing = x.join(y, (F.col("x.unit") == F.col("y.unit")) & (F.col("x.page") < F.col("y.page")) & fits).select(
        F.col("x.unit").alias("unit"), F.col("x.page").alias("page"), F.col("y.page").alias("other"))
    cols = ["unit", "page", "other", "side", "cls", "n", "vec", "comp", "first"]
    alone = labelled.withColumn("other", F.col("page")).withColumn("side", F.lit(0)).select(*cols)
    left = labelled.join(crossing, ["unit", "page"]).withColumn("side", F.lit(0)).select(*cols)
    right = (labelled.withColumnRenamed("page", "other").join(crossing, ["unit", "other"])
             .withColumn("side", F.lit(1)).select(*cols))
    rest = (alone.union(left).union(right).repartition("unit", "page", "other")
            .sortWithinPartitions("unit", "page", "other", "side", "n", "cls")
            .mapInArrow(_tree_pairs(percent), "a long, b long").distinct())
    tree_pairs = scratch.write(rest, "tree-pairs")
    scratch.drop("labelled", "pages", "units")
    scratch.release()
    more = _verify(scratch, tree_pairs, texts, percent, "tree-links")
    scratch.drop("tree-pairs", "texts")

    # components of both rounds, and the smallest id of each
    roots = components(scratch, links.union(more), "all")
    classes = rows.where("n > 0").groupBy("cls").agg(F.min("doc_id").alias("least"))
    named = scratch.write(classes.join(roots.withColumnRenamed("node", "cls"), "cls", "left")
                          .select("cls", "least", F.coalesce("root", "cls").alias("root")), "classes")
    ids = named.groupBy("root").agg(F.min("least").alias("component_id"))
    by_class = scratch.write(named.join(ids, "root").select("cls", "component_id", "root"), "named")
    scratch.keep_only("profile", "named", "rows")
    full = rows.where("n > 0").select("doc_id", "n", "cls").join(by_class, "cls").select(
        "doc_id", F.col("n").cast("long").alias("n_shingles"), "component_id", "root")
    empty = rows.where("n = 0").select("doc_id", F.lit(0).cast("long").alias("n_shingles"),
                                       F.col("doc_id").alias("component_id"), F.lit(None).cast("long").alias("root"))
    return full.union(empty)


def _labelled(rows: DataFrame, comps: DataFrame | None) -> DataFrame:
    """Rows with the component of their class (its own, if it has no link yet)."""
    if comps is None:
        return rows.withColumn("comp", F.col("cls"))
    return (rows.join(comps.withColumnRenamed("node", "cls"), "cls", "left")
            .withColumn("comp", F.coalesce("root", "cls")).drop("root"))


def _mixed_units(units: DataFrame, comps: DataFrame) -> DataFrame:
    """Units with classes of two components or more."""
    comp = F.coalesce("root", "cls")
    return (units.join(comps.withColumnRenamed("node", "cls"), "cls", "left").groupBy("unit")
            .agg(F.min(comp).alias("low"), F.max(comp).alias("high")).where("low <> high").select("unit"))


def keep_one_per_group(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The rows of ``docs``, one for each component: the one with the smallest id (null last).

    Rows with an empty set all stay.
    """
    scratch = Scratch(docs.sparkSession, "groups")
    rows = scratch.number(docs)
    groups = link_components(rows.select(F.col("row").alias("doc_id"), "doc.text"), percent, scratch)
    ids = rows.select("row", F.col("doc.doc_id").alias("id"))
    best = (groups.where("root is not null").select(F.col("doc_id").alias("row"), "root").join(ids, "row")
            .groupBy("root").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "row")).alias("best"))
            .select(F.col("best.row").alias("_row")))
    kept = scratch.write(best.union(groups.where("root is null").select("doc_id")), "kept")
    scratch.keep_only("rows", "kept")
    scratch.release()
    return (rows.withColumnRenamed("row", "_row").join(kept.hint("merge"), "_row", "left_semi")
            .select("doc.*"))


def op1_query(documents: DataFrame) -> DataFrame:
    return link_components(documents).select("doc_id", "n_shingles", "component_id")


ORACLE_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                                              'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words
  FROM documents),
s AS (
  SELECT DISTINCT doc_id, shingle FROM (
    SELECT doc_id, unnest(CASE WHEN len(words) >= 5
                               THEN list_transform(range(1, len(words) - 3), lambda i: list_aggregate(words[i:i + 4], 'string_agg', ' '))
                               WHEN len(words) > 0 THEN [list_aggregate(words, 'string_agg', ' ')]
                               ELSE [] END) AS shingle
    FROM w)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
shared AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS common
  FROM s x JOIN s y ON x.shingle = y.shingle AND x.doc_id <> y.doc_id GROUP BY ALL),
links AS (
  SELECT a, b FROM shared JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b
  WHERE 100 * common >= 80 * (p.n + q.n - common)),
reach AS (
  SELECT doc_id, doc_id AS other FROM documents
  UNION
  SELECT r.doc_id, l.b FROM reach r JOIN links l ON l.a = r.other)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, r.component_id
FROM documents d LEFT JOIN n USING (doc_id)
JOIN (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id) r USING (doc_id)
"""
