"""Spelling variant grouping by blocked Gram matrices of letter counts.

Two words are near if one inserted, deleted or replaced letter makes one the
other.  Their letter counts then differ by 1 in one letter (adjacent lengths)
or in two (equal lengths): a squared distance of at most two.  A block of words
is a matrix of letter counts; its product with itself (or with another block)
gives all squared distances at once, pairs at most two apart in equal or
adjacent lengths are kept, and their edits are verified on the words.

Which words meet: the alphabet has four parts, and near words have equal counts
in at least two of them.  So each word goes to six cells, one for each two
parts, by a hash of its counts there; near words meet in at least one cell and
are taken in the first.  A cell of more than ``PAGE`` words is dealt into pages
and each pair of pages is a block of its own, so no task holds a whole cell.

Defined results: null and empty texts have no words; repeated rows count each;
a null document id is written as ``null`` in the typing slip of the query; an
empty table gives an empty result; ties go to the smallest word in code-point
order; words of any length are compared; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardline.llm.scratch import Scratch
from wardline.llm.text import mix64

MIN_LENGTH = 5
MIN_COUNT = 3
RATIO = 2        # a form has at least this many times the occurrences
PAGE = 4096      # words of a cell that one block holds
BLOCK = 128      # rows of one Gram matrix
EXACT = 2048     # letters up to which 32-bit floats hold all products exactly
SLIP = 97        # the query deletes a letter of every so many (document, word)

RUN = "([A-Za-zÀ-ÿ]+)"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# Letters by how common they are, to share them out evenly.
_COMMON = "etaoinsrhldcumfpgwybvkxjqz"
PARTS = 4
# every byte value of Latin-1 has a column; capitals A-Z do not occur
_PART_OF = np.arange(256) % PARTS
for _i, _c in enumerate(_COMMON):
    _PART_OF[ord(_c)] = _i % PARTS
COMBOS = [(i, j) for i in range(PARTS) for j in range(i + 1, PARTS)]
_LETTERS = np.concatenate([np.arange(97, 123), np.arange(0xC0, 0x100)])
_COLUMN = np.full(256, -1)
_COLUMN[_LETTERS] = np.arange(len(_LETTERS))
_COLUMN_PART = _PART_OF[_LETTERS]
_FACTOR = mix64(np.arange(1, len(_LETTERS) + 1, dtype=np.uint64)) | np.uint64(1)

CELLS = "cell long, combo int, word string, n long"
NEAR = "word string, near string, near_n long, number long"
PAIRS = "word string, near string, n long, near_n long"


# -- words --------------------------------------------------------------------
def word_counts(docs: DataFrame, slip: int | None = SLIP) -> DataFrame:
    """(word, n): runs of Latin letters, A-Z lower-cased, of at least ``MIN_LENGTH`` letters and ``MIN_COUNT``
    occurrences.  With ``slip``, one of so many (document, run) loses a letter first."""
    runs = docs.select(
        F.coalesce(docs["doc_id"].cast("string"), F.lit("null")).alias("id"),
        F.explode(F.regexp_extract_all(docs["text"], F.lit(RUN), F.lit(1))).alias("run")
    ).withColumn("run", F.translate("run", _UPPER, _LOWER))
    word = F.col("run")
    if slip:
        runs = runs.withColumn("h", F.crc32(F.concat_ws(":", "id", "run").cast("binary")))
        at = (F.col("h") % F.length("run")).cast("int")
        word = F.when(F.col("h") % slip == 0, F.concat(F.col("run").substr(F.lit(1), at),
                                                       F.col("run").substr(at + 2, F.length("run")))).otherwise(word)
    return (runs.select(word.alias("word")).where(F.length("word") >= MIN_LENGTH)
            .groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= MIN_COUNT))


# -- blocks -------------------------------------------------------------------
class Block:
    """Words as letters and letter counts."""

    def __init__(self, words: pa.Array):
        self.length = pc.utf8_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
        self.letters = np.frombuffer("".join(words.to_pylist()).encode("latin-1"), dtype=np.uint8)
        self.start = np.cumsum(self.length) - self.length
        width = len(_LETTERS)
        at = np.repeat(np.arange(len(words)) * width, self.length) + _COLUMN[self.letters]
        exact = np.float32 if self.length.max(initial=0) <= EXACT else np.float64
        self.counts = np.bincount(at, minlength=len(words) * width).reshape(-1, width).astype(exact)
        self.norm = (self.counts * self.counts).sum(axis=1)


def close_pairs(x: Block, used: np.ndarray, a: slice, b: slice, cell: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows (i in a, j in b, i < j) of one cell whose squared distance is at most two in equal or adjacent lengths."""
    distance = used[a] @ used[b].T
    distance *= -2
    distance += x.norm[a][:, None]
    distance += x.norm[b][None, :]
    i, j = np.nonzero(distance <= 2)
    i, j = i + a.start, j + b.start
    keep = (i < j) & (cell[i] == cell[j]) & (abs(x.length[i] - x.length[j]) <= 1)
    return i[keep], j[keep]


def first_meeting(x: Block, i: np.ndarray, j: np.ndarray, combo: np.ndarray) -> np.ndarray:
    """Whether the cell's two parts are the first two in which the pair has equal counts."""
    differs = x.counts[i] != x.counts[j]
    equal = np.column_stack([~differs[:, _COLUMN_PART == p].any(axis=1) for p in range(PARTS)])
    first = np.full(len(i), -1)
    for k in reversed(range(len(COMBOS))):
        p, q = COMBOS[k]
        first[equal[:, p] & equal[:, q]] = k
    return first == combo[i]


def one_edit(x: Block, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Whether one inserted, deleted or replaced letter makes word i word j (their lengths differ by one at most)."""
    swap = x.length[i] > x.length[j]
    short, long = np.where(swap, j, i), np.where(swap, i, j)
    out = np.zeros(len(i), dtype=bool)
    order = np.argsort(x.length[short], kind="stable")
    step = 1 << 14
    for at in range(0, len(order), step):  # words of like length side by side
        rows = order[at:at + step]
        width = int(x.length[short[rows]].max())
        if width > 64:
            for r in rows.tolist():
                out[r] = _one_edit(*(x.letters[x.start[w]:x.start[w] + x.length[w]] for w in (short[r], long[r])))
            continue
        n, m = x.length[short[rows]], x.length[long[rows]]
        place = np.arange(width)
        inside = place < n[:, None]

        def letters(word, shift):
            at_ = x.start[word][:, None] + place + shift[:, None]
            return x.letters[np.minimum(at_, len(x.letters) - 1)]
        s = letters(short[rows], np.zeros(len(rows), np.int64))
        plain = (s != letters(long[rows], np.zeros(len(rows), np.int64))) & inside
        moved = (s != letters(long[rows], np.ones(len(rows), np.int64))) & inside
        prefix = np.where(plain.any(axis=1), plain.argmax(axis=1), n)          # equal letters from the left
        last = np.where(moved.any(axis=1), width - moved[:, ::-1].argmax(axis=1), 0)  # behind it the rest is equal
        out[rows] = np.where(n == m, plain.sum(axis=1) == 1, prefix >= last)
    return out


def _one_edit(s: np.ndarray, t: np.ndarray) -> bool:
    differs = np.flatnonzero(s != t[:len(s)])
    if len(s) == len(t):
        return len(differs) == 1
    k = differs[0] if len(differs) else len(s)
    return bool((s[k:] == t[k + 1:]).all())


# -- Spark steps --------------------------------------------------------------
def _cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each word in its six cells."""
    for batch in batches:
        counts = Block(batch.column("word")).counts.astype(np.uint64) * _FACTOR
        own = [counts[:, _COLUMN_PART == p].sum(axis=1, dtype=np.uint64) for p in range(PARTS)]
        for k, (p, q) in enumerate(COMBOS):
            key = mix64(own[p] + mix64(own[q] + np.uint64(k)))
            yield pa.RecordBatch.from_arrays(
                [pa.array(key.view(np.int64)), pa.array(np.full(len(key), k, np.int32)), batch.column("word"),
                 batch.column("n")], names=["cell", "combo", "word", "n"])


def _meet(pairs: bool):
    """Near words in each block of rows that share a meeting; rows come sorted by meeting.

    Rows of a meeting come from one page or two; in a meeting of two pages only words of different pages are
    compared, as each page has a meeting of its own.
    """
    def found(table: pa.Table) -> pa.RecordBatch | None:
        x = Block(table["word"].combine_chunks())
        cell, combo, side = (table[c].to_numpy() for c in ("meeting", "combo", "side"))
        used = np.ascontiguousarray(x.counts[:, x.counts.any(axis=0)])
        left, right = [], []
        n = len(cell)
        for a in range(0, n, BLOCK):
            last = cell[min(a + BLOCK, n) - 1]
            for b in range(a, n, BLOCK):
                if b > a and cell[b] != last:
                    break  # sorted by meeting: later rows have other ones
                i, j = close_pairs(x, used, slice(a, min(a + BLOCK, n)), slice(b, min(b + BLOCK, n)), cell)
                for keep in (lambda i, j: (side[i] < 0) | (side[i] != side[j]), lambda i, j: one_edit(x, i, j),
                             lambda i, j: first_meeting(x, i, j, combo)):
                    if len(i):
                        ok = keep(i, j)
                        i, j = i[ok], j[ok]
                left.append(i)
                right.append(j)
        i, j = np.concatenate(left), np.concatenate(right)
        if not len(i):
            return None
        words, count = table["word"].combine_chunks(), table["n"].to_numpy()
        if pairs:
            return pa.RecordBatch.from_arrays(
                [words.take(pa.array(i)), words.take(pa.array(j)), pa.array(count[i]), pa.array(count[j])],
                names=["word", "near", "n", "near_n"])
        i, j = np.concatenate([i, j]), np.concatenate([j, i])
        # UTF-8 byte order is code-point order
        rank = np.empty(n, np.int64)
        rank[pc.sort_indices(words.cast(pa.binary())).to_numpy()] = np.arange(n)
        by = np.lexsort((rank[j], -count[j], i))
        i, j = i[by], j[by]
        top = np.flatnonzero(np.concatenate([[True], i[1:] != i[:-1]]))
        number = np.diff(np.append(top, len(i)))
        return pa.RecordBatch.from_arrays(
            [words.take(pa.array(i[top])), words.take(pa.array(j[top])), pa.array(count[j[top]]), pa.array(number)],
            names=["word", "near", "near_n", "number"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows = 0
        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows < 4 * BLOCK:
                continue
            table = pa.Table.from_batches(held)
            meeting = table["meeting"].to_numpy()
            whole = int(np.searchsorted(meeting, meeting[-1]))  # the last meeting may go on
            if whole:
                out = found(table.slice(0, whole))
                if out:
                    yield out
            held, rows = table.slice(whole).to_batches(), len(meeting) - whole
        if rows:
            out = found(pa.Table.from_batches(held))
            if out:
                yield out
    return run


def _meetings(scratch: Scratch, words: DataFrame) -> DataFrame:
    """(meeting, combo, side, word, n): the rows of every block, sorted by meeting in each task.

    A cell of up to ``PAGE`` words is one meeting (side -1); a larger one has a meeting for each page and for each
    two pages, where side tells the pages apart.
    """
    cells = scratch.write(words.select("word", "n").mapInArrow(_cells, CELLS), "cells")
    hot = cells.groupBy("cell").count().where(F.col("count") > PAGE).select(
        "cell", F.ceil(F.col("count") / PAGE).cast("int").alias("pages"))
    rows = cells.join(hot, "cell", "left").withColumn("pages", F.coalesce("pages", F.lit(1)))
    page = F.pmod(F.xxhash64("word"), F.col("pages")).cast("int")
    rows = (rows.withColumn("page", page)
            .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("pages") - 1)))
            .withColumn("meeting", F.when(F.col("pages") == 1, F.col("cell")).otherwise(
                F.xxhash64("cell", F.least("page", "other"), F.greatest("page", "other"))))
            .withColumn("side", F.when(F.col("page") == F.col("other"), -1).otherwise(F.col("page"))))
    return (rows.select("meeting", "combo", "side", "word", "n")
            .repartition("meeting").sortWithinPartitions("meeting", "word"))


def near_pairs(words: DataFrame) -> DataFrame:
    """(word, near, n, near_n): every pair of near words of ``words`` (word, n) once."""
    return _meetings(Scratch(words.sparkSession, "spelling"), words).mapInArrow(_meet(True), PAIRS)


def group_variants(words: DataFrame, ratio: int = RATIO) -> DataFrame:
    """(word, n, n_near, form, form_n, root) for ``words`` (word, n), one row a word.

    form is the near word with the most occurrences if it has at least ``ratio`` times the word's; root is the last
    one on the way from form to form.  Each step multiplies n, so the way has at most log(n) steps and doubling
    them finds its end after a few joins.
    """
    scratch = Scratch(words.sparkSession, "spelling")
    words = scratch.write(words.select("word", "n"), "words")
    near = _meetings(scratch, words).mapInArrow(_meet(False), NEAR)
    best = near.groupBy("word").agg(F.sum("number").alias("n_near"),
                                    F.min(F.struct((-F.col("near_n")).alias("order"), "near")).alias("b"))
    formed = F.col("form_n") >= F.col("n") * ratio
    known = words.join(best.select("word", "n_near", F.col("b.near").alias("form"), (-F.col("b.order")).alias("form_n")),
                       "word", "left")
    known = scratch.write(known.select(
        "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
        F.when(formed, F.col("form")).alias("form"), F.when(formed, F.col("form_n")).alias("form_n")), "forms")
    ways = known.where("form is not null").select("word", F.col("form").alias("to"))
    step = 0
    while True:
        ahead = ways.select(F.col("word").alias("to"), F.col("to").alias("next"))
        ways = scratch.write(ways.join(ahead, "to", "left").select(
            "word", F.coalesce("next", "to").alias("to"), F.col("next").isNotNull().alias("moved")), f"ways-{step}")
        if ways.where("moved").isEmpty():
            break
        ways, step = ways.drop("moved"), step + 1
    return known.join(ways.select("word", F.col("to").alias("root")), "word", "left").withColumn(
        "root", F.coalesce("root", "word"))


def op12_query(documents: DataFrame) -> DataFrame:
    return group_variants(word_counts(documents)).select("word", "form", "root", "n", "n_near", "form_n")


# Near words share what is left without one letter: at the same place if it was replaced, or one is the other's rest.
ORACLE_SQL = r"""
WITH RECURSIVE table_steps(v, c, step) AS (
  SELECT v, v, 0 FROM range(256) AS r(v)
  UNION ALL SELECT v, CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, step + 1
  FROM table_steps WHERE step < 8),
crc AS (SELECT list(c ORDER BY v) AS t FROM table_steps WHERE step = 8),
runs AS (
  SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-z\x{C0}-\x{FF}]+')),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents),
counted AS (SELECT doc_id, run, count(*) AS c FROM runs GROUP BY ALL),
hex AS (SELECT *, hex(encode(concat(coalesce(doc_id::VARCHAR, 'null'), ':', run))) AS x FROM counted),
bytes AS (
  SELECT doc_id, run, c, list_transform(range(0, len(x) // 2), lambda i:
    (instr('0123456789ABCDEF', x[2 * i + 1]) - 1) * 16 + instr('0123456789ABCDEF', x[2 * i + 2]) - 1) AS b FROM hex),
hashed AS (
  SELECT run, c, xor(list_reduce(list_prepend(4294967295::BIGINT, b::BIGINT[]), lambda s, y:
    xor(s // 256, t[xor(s % 256, y) + 1])), 4294967295) AS h FROM bytes, crc),
slipped AS (
  SELECT CASE WHEN h % 97 = 0 THEN concat(run[1:h % length(run)], run[h % length(run) + 2:]) ELSE run END AS word, c
  FROM hashed),
words AS (
  SELECT word, sum(c)::BIGINT AS n FROM slipped WHERE length(word) >= 5 GROUP BY word HAVING sum(c) >= 3),
cut AS (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words),
rests AS (SELECT word, n, i, concat(word[1:i - 1], word[i + 1:]) AS rest FROM cut),
near AS (
  SELECT a.word, b.word AS near, b.n AS near_n FROM rests a JOIN rests b ON a.rest = b.rest AND a.i = b.i
  WHERE a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM rests a JOIN words b ON a.rest = b.word
  UNION SELECT b.word, a.word, a.n FROM rests a JOIN words b ON a.rest = b.word),
best AS (
  SELECT word, count(*) AS n_near, first(near ORDER BY near_n DESC, near) AS near,
         max(near_n) AS near_n FROM near GROUP BY word),
forms AS (
  SELECT w.word, w.n, coalesce(b.n_near, 0) AS n_near,
         CASE WHEN b.near_n >= 2 * w.n THEN b.near END AS form, CASE WHEN b.near_n >= 2 * w.n THEN b.near_n END AS form_n
  FROM words w LEFT JOIN best b USING (word)),
ways(word, last) AS (
  SELECT word, word FROM forms UNION ALL SELECT y.word, f.form FROM ways y JOIN forms f ON f.word = y.last
  WHERE f.form IS NOT NULL)
SELECT f.word, f.form, y.last AS root, f.n, f.n_near, f.form_n FROM forms f
JOIN ways y ON y.word = f.word JOIN forms e ON e.word = y.last AND e.form IS NULL
"""
