"""Quality rules: base counts and divergence from language references.

One pass over the whole texts takes two histograms of each document:
character classes, and a list of very common words of the four languages plus
"any other word".  A second one counts words, their code points, symbols,
repeated lines and words in repeated five-word windows, and judges each
document by the distance of its histograms from its language's reference.  The
distance is Jensen-Shannon's (square root of the divergence in bits, 0 to 1).
It is only judged where the document is long enough for it (``MIN_CHARS``
characters, ``MIN_WORDS`` words), because a short text is far from any
reference by chance.  What chance adds to the squared distance of words falls
with their number, so the limit is that of a very long text plus
``WORD_NOISE`` over the number of words.

Junk must not define what is normal.  So a reference is a trimmed mean: each
document that is long enough has one vote, its shares (documents with equal
shares vote once, so copies add nothing).  It starts as the mean of all votes
of the language; then, ``ROUNDS`` times, it becomes the mean of the half of
them nearest to it.  Junk that is a minority of a language drops out.

A language with fewer than ``MIN_VOTERS`` votes, or none given (null), has no
reference of its own, so a wrong label can't make one for a few documents:
these are judged by the nearest of the ``DEFAULT_LANGS`` references with most
votes.

Defined results: a null text has no words (it fails the base rule); without
any reference documents are judged by the base rule alone; repeated rows are
judged each; an empty table gives an empty result; other columns pass through
``keep_clean`` untouched and are ignored otherwise.  Not told apart: junk that
is most of a language, or that fills a language of its own with
``MIN_VOTERS`` different documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wardline.llm.scratch import Scratch
from wardline.llm.text import chunks, mix64, powers, segment_sums, shingles, sort_distinct, utf8, words

MIN_BASE_WORDS = 10
MAX_REPEAT_PERCENT = 20
WINDOW = 5
MIN_CHARS = 200
MIN_WORDS = 60
MAX_CLASS_DISTANCE = 0.33
MAX_WORD_DISTANCE = 0.20
WORD_NOISE = 8.0
VOTE = 1 << 20      # shares of a document are whole parts of this, so that sums don't depend on their order
MIN_VOTERS = 20
ROUNDS = 4
BINS = 128          # steps in which the sum of both distances (0 to 2) is ordered
DEFAULT_LANGS = 16

# Very common words of English, German, French and Spanish.
COMMON_WORDS = (
    "the of and to in that is was for on with as be by this are or an it at from not which have "
    "der die und den von zu das mit sich des auf ist im dem nicht ein eine als auch es "
    "la le les et des en un une du que est pour qui dans sur pas au par plus "
    "el los las y por con no se lo su para al del como"
).split()
COMMON_WORDS = sorted(set(COMMON_WORDS))
SYMBOLS = b"#*$%&|<>"


def _byte_classes() -> np.ndarray:
    """Class of each byte that begins a code point; continuation bytes have none (255)."""
    cls = np.full(256, 6, dtype=np.uint8)            # other ASCII symbols
    cls[np.arange(97, 123)] = 0                      # a-z
    cls[np.arange(65, 91)] = 1                       # A-Z
    cls[np.arange(48, 58)] = 2                       # 0-9
    cls[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = 3    # white space
    cls[list(b".,;:!?'\"()-")] = 4                   # punctuation of prose
    cls[np.arange(0, 9)] = 5                         # control characters
    cls[np.arange(14, 32)] = 5
    cls[127] = 5
    cls[0x80:0xC0] = 255
    cls[0xC0:0xE0] = 7                               # U+0080 to U+07FF: accented letters and near scripts
    cls[0xE0:0xF0] = 8                               # U+0800 to U+FFFF
    cls[0xF0:] = 9
    return cls


N_CLASSES = 10
_CLASS = _byte_classes()
_IS_SYMBOL = np.isin(np.arange(256), list(SYMBOLS))

FEATURES = T.StructType([
    *[T.StructField(c, T.LongType()) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")],
    T.StructField("class_distance", T.DoubleType()), T.StructField("word_distance", T.DoubleType()),
    T.StructField("base_failed", T.BooleanType()), T.StructField("kept", T.BooleanType())])
VOTES = "lang string, classes array<int>, common array<int>"


def _common_hashes() -> tuple[np.ndarray, np.ndarray]:
    data, off = utf8(pa.array(COMMON_WORDS))
    h = words(data, off, lower=True).hash
    order = np.argsort(h)
    return h[order], order


def _counts(data: np.ndarray, off: np.ndarray) -> list[np.ndarray]:
    """The five counts for a chunk of documents."""
    n_docs = len(off) - 1
    w = words(data, off)
    n_words = np.diff(w.first)
    begins = _CLASS[data] != 255
    points = np.concatenate([[0], np.cumsum(begins)])
    word_chars = segment_sums(points[w.end] - points[w.start], w.first)
    n_symbols = segment_sums(_IS_SYMBOL[data].astype(np.int64), off)

    # lines with a word; a document of k line breaks has k + 1 lines
    breaks = np.flatnonzero(data == 10)
    starts = np.union1d(off[:-1], breaks + 1)
    starts = starts[starts < len(data)]
    n_line_words = np.diff(np.searchsorted(w.start, np.append(starts, len(data))))
    line_doc = np.searchsorted(off, starts, side="right") - 1
    ends = np.append(starts[1:], len(data))
    rel = np.arange(len(data)) - np.repeat(starts, ends - starts) if len(data) else np.zeros(0, np.int64)
    value = (data.astype(np.uint64) + np.uint64(1)) * powers(int(rel.max()) + 1 if len(rel) else 1)[rel]
    value[data == 10] = 0  # the break at a line's end is not part of it
    line_hash = segment_sums(value, np.append(starts, len(data)))
    with_word = n_line_words > 0
    first = np.searchsorted(line_doc[with_word], np.arange(n_docs + 1))
    _, distinct = sort_distinct(mix64(line_hash[with_word]), first)
    n_dup_lines = np.diff(first) - np.diff(distinct)

    # words inside five-word windows that occur twice or more in their document
    sh, sh_first = shingles(w, WINDOW)
    long_enough = n_words >= WINDOW
    sh_doc = np.repeat(np.arange(n_docs), np.diff(sh_first))
    own = mix64(sh ^ mix64(sh_doc.astype(np.uint64) + np.uint64(1)))
    order = np.argsort(own, kind="stable")
    same = np.zeros(len(own) + 1, dtype=bool)
    same[1:-1] = own[order][1:] == own[order][:-1]
    repeated = np.zeros(len(own), dtype=bool)
    repeated[order] = same[1:] | same[:-1]
    at = (w.first[sh_doc] + np.arange(len(sh)) - sh_first[sh_doc])[repeated & long_enough[sh_doc]]
    cover = np.zeros(len(w.start) + 1, dtype=np.int64)
    np.add.at(cover, at, 1)
    np.add.at(cover, at + WINDOW, -1)
    n_repeat = segment_sums((np.cumsum(cover[:-1]) > 0).astype(np.int64), w.first)

    return [n_words, word_chars, n_symbols, n_dup_lines, n_repeat]


def _histograms(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Counts of character classes and of common words for a chunk of documents."""
    n_docs = len(off) - 1
    begins = _CLASS[data] != 255
    doc_of_byte = np.repeat(np.arange(n_docs), np.diff(off))
    classes = np.bincount(doc_of_byte[begins] * N_CLASSES + _CLASS[data][begins],
                          minlength=n_docs * N_CLASSES).reshape(n_docs, N_CLASSES)
    w = words(data, off, lower=True)
    hashes, place = _common_hashes()
    found = np.searchsorted(hashes, w.hash).clip(0, len(hashes) - 1)
    slot = np.where(hashes[found] == w.hash, place[found], len(hashes))
    width = len(hashes) + 1
    word_doc = np.repeat(np.arange(n_docs), np.diff(w.first))
    common = np.bincount(word_doc * width + slot, minlength=n_docs * width).reshape(n_docs, width)
    return classes, common


def js_distance(counts: np.ndarray, reference: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distance of each pair of rows of counts; NaN if one of them is empty."""
    with np.errstate(divide="ignore", invalid="ignore"):
        p = counts / counts.sum(axis=1, keepdims=True)
        q = reference / reference.sum(axis=1, keepdims=True)
        mid = (p + q) / 2
        total = (np.where(p > 0, p * np.log2(p / mid), 0) + np.where(q > 0, q * np.log2(q / mid), 0)).sum(axis=1) / 2
        total[np.isnan(p[:, 0]) | np.isnan(q[:, 0])] = np.nan
        return np.sqrt(np.maximum(total, 0))


def _lists(m: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(m) + 1) * m.shape[1], pa.int32()),
                                    pa.array(m.ravel(), pa.int32()))


def _votes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Shares of classes and common words of each document that is long enough to be judged."""
    for batch in batches:
        for a, _, data, off in chunks(batch.column("text")):
            classes, common = _histograms(data, off)
            n_chars, n_words = classes.sum(axis=1), common.sum(axis=1)
            at = np.flatnonzero((n_chars >= MIN_CHARS) & (n_words >= MIN_WORDS))
            yield pa.RecordBatch.from_arrays(
                [batch.column("lang").take(pa.array(a + at)), _lists(classes[at] * VOTE // n_chars[at, None]),
                 _lists(common[at] * VOTE // n_words[at, None])], names=["lang", "classes", "common"])


def _bins(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Votes with their distance from the reference in the same row, in steps."""
    for batch in batches:
        n = batch.num_rows
        by_class = js_distance(_rows(batch.column("classes"), 0, n, N_CLASSES),
                               _rows(batch.column("ref_classes"), 0, n, N_CLASSES))
        width = len(COMMON_WORDS) + 1
        by_word = js_distance(_rows(batch.column("common"), 0, n, width), _rows(batch.column("ref_common"), 0, n, width))
        step = ((by_class + by_word) * BINS / 2).astype(np.int32)
        yield pa.RecordBatch.from_arrays(
            [batch.column("lang"), batch.column("classes"), batch.column("common"), pa.array(step)],
            names=["lang", "classes", "common", "step"])


def _summed(votes: DataFrame, *by: str) -> DataFrame:
    def sums(column: str, width: int) -> Column:
        return F.array(*[F.sum(F.element_at(column, i + 1)) for i in range(width)]).alias(column)
    return votes.groupBy(*by).agg(sums("classes", N_CLASSES), sums("common", len(COMMON_WORDS) + 1),
                                  F.sum("n").alias("n"))


def references(scratch: Scratch, docs: DataFrame) -> DataFrame:
    """(_ref_lang, ref_classes, ref_common, voters): trimmed means of the votes of each language."""
    votes = scratch.write(docs.select(docs["lang"].cast("string").alias("lang"), docs["text"]).where("lang is not null")
                          .mapInArrow(_votes, VOTES).distinct(), "votes")

    def written(sums: DataFrame, name: str) -> DataFrame:
        return scratch.write(sums.select(F.col("lang").alias("_ref_lang"), F.col("classes").alias("ref_classes"),
                                         F.col("common").alias("ref_common"), "voters"), name)

    refs = written(_summed(votes.withColumn("n", F.lit(1)), "lang").withColumn("voters", F.col("n"))
                   .where(F.col("voters") >= MIN_VOTERS), "references0")
    whole = Window.partitionBy("lang")  # at most BINS + 1 rows for each language
    upto = whole.orderBy("step").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    for k in range(ROUNDS):
        steps = _summed(votes.join(refs, F.col("lang") == F.col("_ref_lang"))
                        .select("lang", "classes", "common", "ref_classes", "ref_common")
                        .mapInArrow(_bins, VOTES + ", step int").withColumn("n", F.lit(1)), "lang", "step")
        near = (steps.withColumn("voters", F.sum("n").over(whole)).withColumn("before", F.sum("n").over(upto) - F.col("n"))
                .where(2 * F.col("before") < F.col("voters")))
        refs = written(_summed(near, "lang", "voters"), f"references{k + 1}")
    return refs


def _rows(col: pa.Array, a: int, b: int, width: int) -> np.ndarray:
    """Rows a to b of a column of lists of ``width`` numbers (null: zeros)."""
    part = col.slice(a, b - a)
    out = np.zeros((b - a, width))
    there = part.is_valid().to_numpy(zero_copy_only=False)
    out[there] = part.flatten().to_numpy().reshape(-1, width)
    return out


def _nearest(classes: np.ndarray, common: np.ndarray, defaults: list) -> tuple[np.ndarray, np.ndarray]:
    """Both distances of each document from the reference that is nearest to it."""
    pairs = np.array([[js_distance(classes, np.array([r["ref_classes"]], dtype=float)),
                       js_distance(common, np.array([r["ref_common"]], dtype=float))] for r in defaults])
    best = np.nan_to_num(pairs).sum(axis=1).argmin(axis=0)
    return tuple(pairs[best, :, np.arange(len(classes))].T)


def _judge(max_class: float, max_word: float, defaults: list):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        used = ("_text", "ref_classes", "ref_common")
        for batch in batches:
            names = [n for n in batch.schema.names if n not in used]
            for a, b, data, off in chunks(batch.column("_text")):
                counts = _counts(data, off)
                classes, common = _histograms(data, off)
                n_words, n_repeat = counts[0], counts[4]
                by_class = js_distance(classes, _rows(batch.column("ref_classes"), a, b, N_CLASSES))
                by_word = js_distance(common, _rows(batch.column("ref_common"), a, b, common.shape[1]))
                unknown = np.flatnonzero(batch.column("ref_classes").slice(a, b - a).is_null()
                                         .to_numpy(zero_copy_only=False))
                if len(unknown) and defaults:
                    by_class[unknown], by_word[unknown] = _nearest(classes[unknown], common[unknown], defaults)
                by_class[classes.sum(axis=1) < MIN_CHARS] = np.nan
                by_word[n_words < MIN_WORDS] = np.nan
                failed = (n_words < MIN_BASE_WORDS) | (100 * n_repeat > MAX_REPEAT_PERCENT * n_words)
                limit = np.sqrt(max_word ** 2 + WORD_NOISE / np.maximum(n_words, 1))
                kept = ~failed & ~(by_class > max_class) & ~(by_word > limit)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(n).slice(a, b - a) for n in names]
                    + [pa.array(c.astype(np.int64)) for c in counts]
                    + [pa.array(d, mask=np.isnan(d)) for d in (by_class, by_word)]
                    + [pa.array(failed), pa.array(kept)],
                    names=names + [f.name for f in FEATURES])
    return run


def judge(rows: DataFrame, refs: DataFrame, max_class: float = MAX_CLASS_DISTANCE,
          max_word: float = MAX_WORD_DISTANCE) -> DataFrame:
    """Replace ``_text`` and ``_lang`` by counts, both distances and the verdict ``kept``."""
    most = refs.orderBy(F.desc("voters"), "_ref_lang").limit(DEFAULT_LANGS).collect()
    defaults = [{c: r[c] for c in ("ref_classes", "ref_common")} for r in most]
    known = rows.join(refs, F.col("_lang") == F.col("_ref_lang"), "left").drop("_lang", "_ref_lang", "voters")
    schema = T.StructType([f for f in rows.schema.fields if f.name not in ("_text", "_lang")] + FEATURES.fields)
    return known.mapInArrow(_judge(max_class, max_word, defaults), schema)


def _with_language(docs: DataFrame, *columns: Column) -> DataFrame:
    return docs.select(*columns, docs["lang"].cast("string").alias("_lang"), docs["text"].alias("_text"))


def assess(docs: DataFrame) -> DataFrame:
    """One row of counts, distances and verdict for each document."""
    refs = references(Scratch(docs.sparkSession, "quality"), docs)
    return judge(_with_language(docs, docs["doc_id"]), refs)


def keep_clean(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are kept, with their own columns."""
    refs = references(Scratch(docs.sparkSession, "quality"), docs)
    return judge(_with_language(docs, F.struct("*").alias("_row")), refs).where("kept").select("_row.*")


def op5_query(documents: DataFrame) -> DataFrame:
    return assess(documents).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                                    "base_failed", "kept", "class_distance", "word_distance")
