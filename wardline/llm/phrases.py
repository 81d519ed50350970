"""Phrase collocation mining with an FM-index per shard over word ids.

Texts are lower-cased (A-Z), split at ``. , ; : ! ?`` and line ends into pieces
and those at spaces and tabs into words.  A shard is a few megabytes of text in
one task: its words become ids, a bidirectional FM-index is built over them,
and whole levels of phrases grow by interval extension, to the right and to the
left in turn.  Counts are summed across shards.  There are three passes: words;
pairs of frequent words; longer phrases, grown only where all pairs inside them
are frequent.  Bit arrays of bounded size tell what is frequent, without false
negatives (a full one costs only more shuffle, never a phrase).

No shard holds more than ``SHARD_BYTES`` of text or one longer word: longer
texts are cut at the end of a piece, or else between two words, and the words
that both parts then hold are counted once more and taken off.

Defined results: a null text is empty and a null language is ``und``; empty
texts and texts without words give nothing; repeated rows count each; an empty
table gives an empty result; ties are broken by phrase in UTF-8 byte order;
other columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wardline.llm.bitmaps import Bitmap
from wardline.llm.fmindex import Level, TwoWayIndex
from wardline.llm.scratch import Scratch
from wardline.llm.text import LOWER, mix64, utf8

MIN_COUNT = 30
MAX_WORDS = 4
KEEP_PERCENT = 80     # a phrase goes if a longer one has this share of its occurrences
TOP = 2000
SHARD_BYTES = 4 << 20
BITS = (20, 26)       # least and largest size of a bit array of frequent words or pairs (8 MB)
SLICES = 256          # parts of a language that rank by themselves before the last ranking

_BREAK = np.zeros(256, dtype=bool)
_BREAK[list(b".,;:!?\n\x0b\x0c\r")] = True
_GAP = _BREAK.copy()
_GAP[list(b" \t")] = True
ROWS = 1 << 16        # phrases that go to Spark at a time


# -- shards -------------------------------------------------------------------
def cuts(data: np.ndarray, limit: int) -> Iterator[tuple[int, int, int]]:
    """(start, end, weight) of the parts of a text: parts overlap by up to ``MAX_WORDS - 1`` words where a piece
    is cut, and the overlap is given again with weight -1."""
    at, n = 0, len(data)
    while n - at > limit:
        size, end, again = limit, None, None
        while end is None and at + size < n:
            window = data[at:at + size]
            last = np.flatnonzero(_BREAK[window])
            if len(last):
                end = again = at + int(last[-1]) + 1
                break
            gap = _GAP[window]
            starts = np.flatnonzero(~gap & np.concatenate([[True], gap[:-1]]))
            if len(starts) > 2 * MAX_WORDS:  # the last word may be cut; it goes to the next part
                end, again = at + int(starts[-1]), at + int(starts[-MAX_WORDS])
            size *= 2
        if end is None:
            break
        yield at, end, 1
        if again < end:
            yield again, end, -1
        at = again
    yield at, n, 1


class Shard:
    """Texts of one task until they are counted."""

    def __init__(self):
        self.parts: list[np.ndarray] = []
        self.langs: list[str] = []
        self.size = 0

    def add(self, part: np.ndarray, lang: str) -> None:
        self.parts += [part, _LINE_END]  # a line end behind every text ends its last piece
        self.langs.append(lang)
        self.size += len(part) + 1

    def words(self) -> "Words | None":
        if not self.size:
            return None
        ends = np.cumsum([len(p) for p in self.parts])[1::2]
        data = LOWER[np.concatenate(self.parts)]
        self.parts = []
        gap = _GAP[data]
        start = np.flatnonzero(~gap & np.concatenate([[True], gap[:-1]]))
        if not len(start):
            return None
        end = np.flatnonzero(gap & np.concatenate([[False], ~gap[:-1]]))
        offsets = np.concatenate([[0], np.cumsum(end - start)]).astype(np.int64)
        coded = pa.LargeStringArray.from_buffers(
            len(start), pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data[~gap]))).dictionary_encode()
        text = np.searchsorted(ends, start, side="right")
        names, lang = np.unique(np.array(self.langs, dtype=object), return_inverse=True)
        known = len(coded.dictionary)
        ids, tagged = pd.factorize(lang[text] * known + coded.indices.to_numpy())
        piece = np.cumsum(_BREAK[data], dtype=np.int32)[start]
        return Words(tagged // known, tagged % known, names.tolist(), coded.dictionary, ids.astype(np.int32), piece)


_LINE_END = np.frombuffer(b"\n", dtype=np.uint8)


class Words:
    """The words of a shard in their order, and its distinct (language, word); ids count from 0."""

    def __init__(self, lang: np.ndarray, word: np.ndarray, langs: list[str], texts: pa.Array, ids: np.ndarray,
                 piece: np.ndarray):
        self.langs, self.ids, self.piece = langs, ids, piece
        self.lang = lang
        self.texts = texts.take(pa.array(word))
        self.tagged = pc.binary_join_element_wise(
            pa.array(langs, pa.large_string()).take(pa.array(lang)), self.texts, pa.scalar("\t", pa.large_string()))
        self._hashes: np.ndarray | None = None

    @property
    def hashes(self) -> np.ndarray:
        if self._hashes is None:
            self._hashes = np.array([xxhash.xxh3_64_intdigest(t) for t in self.tagged.cast(pa.large_binary()).to_pylist()],
                                    dtype=np.uint64)
        return self._hashes

    def index(self, keep: np.ndarray) -> TwoWayIndex:
        """The index of the sequence in which words that are not kept separate like the ends of pieces; its ids are
        those of the words plus 1."""
        there = keep[self.ids]
        place = np.flatnonzero(there)
        piece = self.piece[place]
        apart = np.ones(len(place), dtype=bool)
        apart[1:] = (piece[1:] != piece[:-1]) | (place[1:] != place[:-1] + 1)
        at = np.arange(len(place)) + np.cumsum(apart)
        sequence = np.zeros((int(at[-1]) if len(at) else 0) + 2, dtype=np.int32)
        sequence[at] = self.ids[place] + 1
        return TwoWayIndex(sequence)

    def rows(self, level: Level, weight: int) -> Iterator[pa.RecordBatch]:
        """The phrases of a level with their counts."""
        for at in range(0, len(level.count), ROWS):
            words = [pa.array(w - 1) for w in level.words[at:at + ROWS].T]
            parts = [self.tagged.take(words[0]), *[self.texts.take(w) for w in words[1:]]]
            phrase = pc.binary_join_element_wise(*parts, pa.scalar(" ", pa.large_string())) if len(parts) > 1 else parts[0]
            yield _counts(phrase, level.count[at:at + ROWS] * weight)

    def single_rows(self, weight: int) -> Iterator[pa.RecordBatch]:
        """Every word with its count, and the number of all words of each language under an empty one."""
        count = np.bincount(self.ids, minlength=len(self.lang)).astype(np.int64)
        yield _counts(self.tagged, count * weight)
        n = np.bincount(self.lang, weights=count, minlength=len(self.langs)).astype(np.int64)
        yield _counts(pa.array([f"{la}\t" for la in self.langs], pa.large_string()), n * weight)


def _counts(key: pa.Array, f: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([key.cast(pa.string()), pa.array(f)], names=["key", "f"])


def pair_hash(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mix64(a * np.uint64(0x9E3779B97F4A7C15) + mix64(b))


def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, Words]]:
    """(weight, words) for every few megabytes of a task's texts."""
    held = {1: Shard(), -1: Shard()}

    def full(least: int):
        for weight, shard in held.items():
            if shard.size > least:
                held[weight] = Shard()
                found = shard.words()
                if found:
                    yield weight, found

    for batch in batches:
        data, off = utf8(batch.column("text"))
        langs = batch.column("lang").to_pylist()
        for i, lang in enumerate(langs):
            text = data[off[i]:off[i + 1]]
            for start, end, weight in cuts(text, SHARD_BYTES):
                held[weight].add(text[start:end], lang)
                yield from full(SHARD_BYTES)
    yield from full(0)


# -- passes -------------------------------------------------------------------
def _single(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of words, and of all words."""
    for weight, words in shards(batches):
        yield from words.single_rows(weight)


def _pairs(common: Bitmap):
    """Counts of pairs of words that may both be frequent."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for weight, words in shards(batches):
            index = words.index(common.has(words.hashes))
            yield from words.rows(index.right(index.single()), weight)
    return run


def _long(common: Bitmap, frequent: Bitmap, max_words: int):
    """Counts of phrases of three words and more of which every pair may be frequent."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for weight, words in shards(batches):
            index = words.index(common.has(words.hashes))

            def known(level: Level, new: slice) -> Level:
                pair = level.words[:, new] - 1
                return level.take(frequent.has(pair_hash(words.hashes[pair[:, 0]], words.hashes[pair[:, 1]])))

            level = known(index.right(index.single()), slice(0, 2))
            for k in range(3, max_words + 1):
                # the new pair stands at the end that has grown
                level = known(index.right(level), slice(-2, None)) if k % 2 else known(index.left(level), slice(0, 2))
                yield from words.rows(level, weight)
    return run


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Hashes of words, or of pairs."""
    for batch in batches:
        langs, phrases = batch.column("lang").to_pylist(), [p.split(" ") for p in batch.column("phrase").to_pylist()]
        sides = [np.array([xxhash.xxh3_64_intdigest(f"{la}\t{p[i]}") for la, p in zip(langs, phrases)], dtype=np.uint64)
                 for i in range(len(phrases[0]) if phrases else 1)]
        h = pair_hash(*sides) if len(sides) == 2 else sides[0]
        yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64))], names=["h"])


def _bits(phrases: DataFrame) -> Bitmap:
    bits = min(BITS[1], max(BITS[0], math.ceil(math.log2(16 * phrases.count() + 1))))
    return Bitmap.of(phrases.select("lang", "phrase").mapInArrow(_hashed, "h long"), "h", bits)


def count_phrases(docs: DataFrame, min_count: int = MIN_COUNT, max_words: int = MAX_WORDS) -> DataFrame:
    """(lang, k, phrase, f): all phrases of up to ``max_words`` words with f >= ``min_count`` occurrences; the
    row with k = 0 of a language has the number of its words."""
    scratch = Scratch(docs.sparkSession, "phrases")
    texts = docs.select(docs["text"].cast("string").alias("text"),
                        F.coalesce(docs["lang"].cast("string"), F.lit("und")).alias("lang"))
    # the key is the language, a tab and the phrase; words hold no tab
    phrase = F.substring_index("key", "\t", -1)

    def summed(count, name: str) -> DataFrame:
        rows = texts.mapInArrow(count, "key string, f long").groupBy("key").agg(F.sum("f").alias("f"))
        rows = rows.where((F.col("f") >= min_count) | F.endswith("key", F.lit("\t"))).withColumn("phrase", phrase)
        return scratch.write(rows.select(
            F.expr("substr(key, 1, length(key) - length(phrase) - 1)").alias("lang"),
            F.when(F.col("phrase") == "", 0).otherwise(
                F.length("phrase") - F.length(F.replace("phrase", F.lit(" "), F.lit(""))) + 1).alias("k"),
            "phrase", "f"), name)

    counts = summed(_single, "words")
    if max_words > 1:
        common = _bits(counts.where("k = 1"))
        pairs = summed(_pairs(common), "pairs")
        counts = counts.unionByName(pairs)
    if max_words > 2:
        counts = counts.unionByName(summed(_long(common, _bits(pairs), max_words), "long"))
    return counts


# -- scores -------------------------------------------------------------------
def _exact(c: str | Column) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("decimal(38,0)")


def score_phrases(counts: DataFrame) -> DataFrame:
    """(lang, phrase, k, a, l, r, score, left_words, left_best, right_words, right_best) for every phrase of two
    words and more in ``counts``.

    l, r and score belong to the cut with the lowest score, the first of them.  left_words and right_words are the
    numbers of counted phrases that have one word more on that side, and left_best and right_best the largest of
    their counts (null without any).
    """
    phrases = counts.where("k >= 2").select("lang", "phrase", "k", F.col("f").alias("a"))
    known = counts.where("k >= 1").select("lang", F.col("phrase").alias("part"), "f")
    cut = (phrases.withColumn("at", F.explode(F.sequence(F.lit(1), F.col("k") - 1)))
           .withColumn("first", F.expr("substring_index(phrase, ' ', at)"))
           .withColumn("rest", F.expr("substring_index(phrase, ' ', at - k)")))
    cut = (cut.join(known.withColumnsRenamed({"part": "first", "f": "l"}), ["lang", "first"])
           .join(known.withColumnsRenamed({"part": "rest", "f": "r"}), ["lang", "rest"]))
    score = F.expr("(cast(2000000 as decimal(38,0)) * a) div (cast(l as decimal(38,0)) + r)")
    lowest = cut.groupBy("lang", "phrase", "k", "a").agg(F.min(F.struct(score.alias("score"), "at", "l", "r")).alias("c"))
    longer = counts.where("k >= 3").select(
        "lang", "f", F.explode(F.array(
            F.struct(F.expr("substring_index(phrase, ' ', 1 - k)").alias("phrase"), F.lit(True).alias("left")),
            F.struct(F.expr("substring_index(phrase, ' ', k - 1)").alias("phrase"), F.lit(False).alias("left")))).alias("p"))
    grown = longer.groupBy("lang", "p.phrase").agg(
        F.count_if("p.left").alias("left_words"), F.max(F.when(F.col("p.left"), F.col("f"))).alias("left_best"),
        F.count_if(~F.col("p.left")).alias("right_words"), F.max(F.when(~F.col("p.left"), F.col("f"))).alias("right_best"))
    return (lowest.join(grown, ["lang", "phrase"], "left")
            .select("lang", "phrase", "k", "a", "c.l", "c.r", "c.score",
                    F.coalesce("left_words", F.lit(0)).alias("left_words"), "left_best",
                    F.coalesce("right_words", F.lit(0)).alias("right_words"), "right_best"))


def collocations(docs: DataFrame, min_count: int = MIN_COUNT, max_words: int = MAX_WORDS,
                 keep_percent: int = KEEP_PERCENT, top: int = TOP) -> DataFrame:
    """Each language's ``top`` phrases by score with their rank, without those that mostly stand inside a longer
    one; n is the number of words of the language.

    A phrase inside a longer one stands inside a phrase with one word more that is at least as frequent as the
    longer one, so the counts of its own extensions decide.
    """
    counts = count_phrases(docs, min_count, max_words)
    scored = score_phrases(counts)
    best = F.greatest("left_best", "right_best")
    inside = F.coalesce(_exact(best) * 100 >= _exact("a") * keep_percent, F.lit(False))
    order = (F.desc("score"), F.desc("a"), F.col("phrase"))

    def ranked(df: DataFrame, *keys: str) -> DataFrame:
        # the first ranking deals a language over many tasks and keeps the best of each
        return (df.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
                .where(F.col("rank") <= top))

    dealt = scored.where(~inside).withColumn("slice", F.pmod(F.xxhash64("phrase"), F.lit(SLICES)))
    first = ranked(ranked(dealt, "lang", "slice").drop("rank", "slice"), "lang")
    return first.join(counts.where("k = 0").select("lang", F.col("f").alias("n")), "lang")


def op11_query(documents: DataFrame) -> DataFrame:
    return collocations(documents).select(
        "lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


ORACLE_SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
worded AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
starts AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM worded),
grams AS (
  SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase
  FROM starts, (VALUES (1), (2), (3), (4)) AS ks(k) WHERE i + k - 1 <= len(w)),
counted AS (SELECT lang, k, phrase, count(*) AS f FROM grams GROUP BY ALL),
totals AS (SELECT lang, sum(f)::BIGINT AS n FROM counted WHERE k = 1 GROUP BY lang),
candidates AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM counted WHERE k >= 2 AND f >= 30),
cut AS (
  SELECT c.lang, c.phrase, p, x.f AS l, y.f AS r,
         (2000000::HUGEINT * c.a) // (x.f::HUGEINT + y.f) AS score
  FROM (SELECT *, unnest(range(1, k)) AS p FROM candidates) c
  JOIN counted x ON x.lang = c.lang AND x.phrase = array_to_string(c.w[1:c.p], ' ')
  JOIN counted y ON y.lang = c.lang AND y.phrase = array_to_string(c.w[c.p + 1:], ' ')),
lowest AS (SELECT * FROM cut QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, p) = 1),
inner_parts AS (
  SELECT lang, k, a, w, unnest(range(1, k)) AS i, size FROM candidates, (VALUES (2), (3)) AS s(size) WHERE size < k),
inside AS (
  SELECT lang, array_to_string(w[i:i + size - 1], ' ') AS phrase, max(a) AS longest
  FROM inner_parts WHERE i + size - 1 <= k GROUP BY ALL),
kept AS (
  SELECT c.lang, c.phrase, c.a, o.l, o.r, t.n, o.score::BIGINT AS score
  FROM candidates c JOIN lowest o USING (lang, phrase) JOIN totals t USING (lang)
  LEFT JOIN inside s USING (lang, phrase)
  WHERE s.longest IS NULL OR 100 * s.longest < 80 * c.a),
ranked AS (SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank,
                  phrase, a, l, r, n, score FROM kept)
SELECT * FROM ranked WHERE rank <= 2000
"""
