"""Toxicity scores by a counterfactual-regularised classifier.

A logistic regression on which words a text has: whole words and their first
4 to 6 letters, so that endings not seen in training count as well.  Only
features that labels depend on beyond chance are kept (chi-squared above
2 log(features tested)).  Labelled sentences that mention a group of people are
rewritten with the other groups of the same list, and squared changes of the
score are added to the loss, so mentioning a group does not become a sign of
toxicity by itself.

What is learned from is bounded: at most ``MAX_ROWS`` labelled documents, taken
by a hash of their ids, and ``MAX_FEATURES`` features; only those reach the
driver, as lists of feature numbers.  Scoring reads every document as a whole,
long ones slice by slice.

Defined results: null and empty texts get the score of no features; without
labels all scores are 0.25; repeated rows are scored each; a repeated label of
a document counts as toxic if one of them is, and a repeated id is learned from
its smallest text; a null id is not held out; labels that are null or of unknown
documents are not used; an empty table gives an empty result; other columns are
ignored, whatever their names.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardline.llm.scratch import Scratch
from wardline.llm.text import chunks

MAX_ROWS = 20_000      # labelled documents that are learned from
MAX_FEATURES = 4_096
MIN_DOCUMENTS = 3      # of a feature
RIDGE = 0.2
CHANCE = 2.0             # chi-squared of a feature in units of the log of their number
SWAP_PENALTY = 10.0
PREFIXES = (4, 5, 6)
HELD_WORDS = 1 << 20   # words whose features a task remembers
SLICE_BYTES = 2 << 20  # of a long text at a time

# Names of groups by list, each with a neutral word first.  Terms of a list are swapped for each other.
IDENTITY_TERMS = (
    ("people", "women", "men", "muslims", "christians", "jews", "hindus", "buddhists", "atheists", "immigrants",
     "refugees", "foreigners", "lesbians", "gays", "blacks", "whites", "asians", "africans", "europeans", "americans"),
    ("person", "woman", "man", "muslim", "christian", "jew", "hindu", "buddhist", "atheist", "immigrant", "refugee",
     "foreigner", "lesbian", "gay", "transgender"),
    ("ordinary", "female", "male", "black", "white", "asian", "african", "jewish", "islamic", "catholic", "protestant",
     "disabled", "deaf", "blind", "elderly", "young", "homosexual", "heterosexual"),
    ("menschen", "frauen", "männer", "muslime", "christen", "juden", "einwanderer", "flüchtlinge", "ausländer"),
    ("personnes", "femmes", "hommes", "musulmans", "chrétiens", "juifs", "immigrés", "réfugiés", "étrangers"),
    ("personas", "mujeres", "hombres", "musulmanes", "cristianos", "judíos", "inmigrantes", "refugiados",
     "extranjeros"),
)
_LIST_OF = {t: terms for terms in IDENTITY_TERMS for t in terms}

_LETTER = np.zeros(256, dtype=bool)
_LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = True
_LETTERS = re.compile(r"[^\W\d_]+")
_SENTENCE = re.compile(r"[^.!?\n]+")


# -- features -----------------------------------------------------------------
def word_features(run: str) -> list[str]:
    """Features of a run of ASCII letters and other characters; punctuation beyond ASCII cuts it."""
    out = []
    for word in _LETTERS.findall(run.lower()):
        out.append(word)
        out.extend(f"{word[:n]}-" for n in PREFIXES if len(word) >= n)
    return out


class Reader:
    """Features of documents; with a ``model`` only those it knows, by number."""

    def __init__(self, model: dict[str, int] | None = None):
        self.numbers: dict[str, int] = {} if model is None else model
        self.fixed = model is not None
        self.known: dict[str, tuple[int, ...]] = {}

    def of_word(self, run: str) -> tuple[int, ...]:
        found = self.known.get(run)
        if found is None:
            if self.fixed:
                found = tuple({n for f in word_features(run) if (n := self.numbers.get(f)) is not None})
            else:
                found = tuple({self.numbers.setdefault(f, len(self.numbers)) for f in word_features(run)})
            if len(self.known) >= HELD_WORDS:
                self.known.clear()
            self.known[run] = found
        return found

    def pairs(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distinct (document, feature) of a chunk."""
        if len(data) > 2 * SLICE_BYTES:  # one long text: slices that end behind a word
            found, at = [], 0
            while at < len(data):
                end = min(at + SLICE_BYTES, len(data))
                while end < len(data):
                    gaps = np.flatnonzero(~_LETTER[data[end:end + SLICE_BYTES]])
                    if len(gaps):
                        end += int(gaps[0])
                        break
                    end = min(end + SLICE_BYTES, len(data))
                found.append(self._pairs(data[at:end], np.array([0, end - at]))[1])
                at = end
            feature = np.unique(np.concatenate(found))
            return np.zeros(len(feature), np.int64), feature
        return self._pairs(data, off)

    def _pairs(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        letter = _LETTER[data]
        edge = np.zeros(len(data) + 1, dtype=bool)
        edge[off] = True
        before = np.concatenate([[False], letter[:-1]])
        after = np.concatenate([letter[1:], [False]])
        start = np.flatnonzero(letter & (~before | edge[:-1]))
        end = np.flatnonzero(letter & (~after | edge[1:])) + 1
        if not len(start):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        ends = np.concatenate([[0], np.cumsum(end - start)]).astype(np.int64)
        runs = pa.LargeStringArray.from_buffers(
            len(start), pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(data[letter]))).dictionary_encode()
        lists = [self.of_word(r) for r in runs.dictionary.to_pylist()]
        size = np.array([len(x) for x in lists], dtype=np.int64)
        flat = np.array([f for x in lists for f in x], dtype=np.int64)
        code = runs.indices.to_numpy()
        doc = np.searchsorted(off, start, side="right") - 1
        known = size[code] > 0
        code, doc = code[known], doc[known]
        width = len(lists)
        both = np.unique(doc * width + code)
        doc, code = both // width, both % width
        n = size[code]
        first = np.cumsum(size) - size
        at = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first[code], n)
        span = int(flat.max(initial=0)) + 1
        both = np.unique(np.repeat(doc, n) * span + flat[at])
        return both // span, both % span


def _tested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many toxic and other documents of a task have each feature."""
    reader, counts = Reader(), [np.zeros(0, np.int64)] * 2
    for batch in batches:
        toxic = batch.column("toxic").to_numpy()
        for a, _, data, off in chunks(batch.column("text")):
            doc, feature = reader.pairs(data, off)
            for label in (0, 1):
                new = np.bincount(feature[toxic[a + doc] == label], minlength=len(reader.numbers))
                new[:len(counts[label])] += counts[label]
                counts[label] = new
    if reader.numbers:
        yield pa.RecordBatch.from_arrays([pa.array(list(reader.numbers)), pa.array(counts[1]), pa.array(counts[0])],
                                         names=["feature", "toxic", "other"])


def _rows(model: dict[str, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(model)
        for batch in batches:
            for a, b, data, off in chunks(batch.column("text")):
                doc, feature = reader.pairs(data, off)
                first = np.searchsorted(doc, np.arange(b - a + 1))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("toxic").slice(a, b - a),
                     pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(feature.astype(np.int32)))],
                    names=["toxic", "features"])
    return run


# -- counterfactual sentences -------------------------------------------------
def swaps(text: str, reader: Reader) -> Counter:
    """{(features gained, features lost): times} for each sentence with a group's name and each other name of its
    list put in its place; only sentences whose score could change."""
    found: Counter = Counter()
    for sentence in _SENTENCE.findall(text):
        words = _LETTERS.findall(sentence.lower())
        for term in set(words) & _LIST_OF.keys():
            rest = {f for w in words if w != term for f in reader.of_word(w)}
            old = set(reader.of_word(term)) - rest
            for other in _LIST_OF[term]:
                new = set(reader.of_word(other)) - rest
                if other != term and new != old:
                    found[tuple(sorted(new - old)), tuple(sorted(old - new))] += 1
    return found


def _swapped(model: dict[str, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, found = Reader(model), Counter()
        for batch in batches:
            for text in batch.column("text").to_pylist():
                found.update(swaps(text or "", reader))
        if found:
            integers = pa.list_(pa.int32())
            yield pa.RecordBatch.from_arrays(
                [pa.array([g for g, _ in found], integers), pa.array([x for _, x in found], integers),
                 pa.array(list(found.values()), pa.int64())], names=["gained", "lost", "times"])
    return run


# -- fitting ------------------------------------------------------------------
@dataclass
class Sparse:
    """Rows of numbers, most of them zero."""

    row: np.ndarray
    column: np.ndarray
    value: np.ndarray
    height: int
    width: int

    def dot(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, weights=self.value * w[self.column], minlength=self.height)

    def back(self, r: np.ndarray) -> np.ndarray:
        return np.bincount(self.column, weights=self.value * r[self.row], minlength=self.width)


def sparse(lists: list[list[tuple[int, float]]], width: int) -> Sparse:
    flat = [(i, c, v) for i, x in enumerate(lists) for c, v in x]
    row, column, value = (np.array(x) for x in zip(*flat)) if flat else (np.zeros(0, np.int64),) * 3
    return Sparse(row.astype(np.int64), column.astype(np.int64), value.astype(float), len(lists), width)


def fit(x: Sparse, y: np.ndarray, change: Sparse, times: np.ndarray, ridge: float = RIDGE,
        penalty: float = SWAP_PENALTY, rounds: int = 200) -> tuple[np.ndarray, float]:
    """Weights and intercept with the least loss

        sum log(1 + exp(-s)) + ridge / 2 |w|^2 + penalty / 2 sum times (change w)^2

    by Newton steps whose equations are solved by conjugate gradients.
    """
    w, b = np.zeros(x.width), float(np.log((y.sum() + 0.5) / (len(y) - y.sum() + 1.5)))
    if not len(y) or not x.width:
        return w, b

    def loss(w, b):
        z = x.dot(w) + b
        c = change.dot(w)
        return np.logaddexp(0, z).sum() - (y * z).sum() + ridge / 2 * w @ w + penalty / 2 * (times * c * c).sum()

    for _ in range(rounds):
        p = 1 / (1 + np.exp(-(x.dot(w) + b)))
        grad = np.append(x.back(p - y) + ridge * w + penalty * change.back(times * change.dot(w)), (p - y).sum())
        if np.abs(grad).max() < 1e-6 * len(y):
            break
        h = p * (1 - p)

        def curve(v):
            hz = h * (x.dot(v[:-1]) + v[-1])
            return np.append(x.back(hz) + ridge * v[:-1] + penalty * change.back(times * change.dot(v[:-1])),
                             hz.sum() + 1e-9 * v[-1])
        step = conjugate_gradients(curve, -grad)
        size, now = 1.0, loss(w, b)
        while loss(w + size * step[:-1], b + size * step[-1]) > now and size > 1e-8:
            size /= 2
        w, b = w + size * step[:-1], b + size * float(step[-1])
    return w, b


def conjugate_gradients(curve, target: np.ndarray, rounds: int = 100) -> np.ndarray:
    x, r = np.zeros_like(target), target.copy()
    d, size = r.copy(), r @ r
    goal = 1e-8 * size
    for _ in range(rounds):
        q = curve(d)
        a = size / (d @ q)
        x, r = x + a * d, r - a * q
        new = r @ r
        if new <= goal:
            break
        d, size = r + new / size * d, new
    return x


@dataclass
class Model:
    """Feature numbers, their weights and the intercept."""

    numbers: dict[str, int]
    weights: np.ndarray
    intercept: float


def held_out(doc_id: Column) -> Column:
    """A fifth of the ids, which are never learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def labelled(docs: DataFrame, labels: DataFrame, scratch: Scratch, max_rows: int = MAX_ROWS) -> DataFrame:
    """(text, toxic) of at most ``max_rows`` labelled documents outside the held-out fifth, one row an id."""
    chosen = (labels.select(labels["doc_id"].alias("id"), labels["toxic"].cast("int").alias("toxic"))
              .where(F.col("toxic").isNotNull() & F.col("id").isNotNull() & ~held_out(F.col("id")))
              .groupBy("id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("id"), "id").limit(max_rows))
    chosen = scratch.write(chosen, "ids")
    texts = docs.select(docs["doc_id"].alias("id"), F.coalesce(docs["text"].cast("string"), F.lit("")).alias("text"))
    return scratch.write(texts.join(chosen, "id").groupBy("id").agg(F.min("text").alias("text"),
                                                                     F.first("toxic").alias("toxic"))
                         .select("text", (F.col("toxic") != 0).cast("long").alias("toxic")), "sample")


def train(sample: DataFrame, scratch: Scratch, max_features: int = MAX_FEATURES, ridge: float = RIDGE,
          penalty: float = SWAP_PENALTY) -> Model:
    """The classifier of a bounded sample (text, toxic)."""
    tested = scratch.write(
        sample.mapInArrow(_tested, "feature string, toxic long, other long").groupBy("feature")
        .agg(F.sum("toxic").alias("a"), F.sum("other").alias("b")), "tested")
    n1, n0 = sample.agg(F.coalesce(F.sum("toxic"), F.lit(0)), F.coalesce(F.sum(1 - F.col("toxic")), F.lit(0))).first()
    a, b = F.col("a").cast("double"), F.col("b").cast("double")
    chi = (n1 + n0) * (a * (n0 - b) - b * (n1 - a)) ** 2 / (F.lit(float(n1)) * n0 * (a + b) * (n1 + n0 - a - b))
    top = (tested.where((a + b >= MIN_DOCUMENTS) & (a + b < n1 + n0))
           .select("feature", chi.alias("chi")).where(F.col("chi") > CHANCE * np.log(max(tested.count(), 2)))
           .orderBy(F.desc("chi"), "feature").limit(max_features).collect()) if n1 and n0 else []
    numbers = {r.feature: i for i, r in enumerate(top)}
    rows = sample.mapInArrow(_rows(numbers), "toxic long, features array<int>").collect()
    changes = (sample.mapInArrow(_swapped(numbers), "gained array<int>, lost array<int>, times long")
               .groupBy("gained", "lost").agg(F.sum("times").alias("times")).collect())
    x = sparse([[(f, 1.0) for f in r.features] for r in rows], len(numbers))
    change = sparse([[(f, 1.0) for f in r.gained] + [(f, -1.0) for f in r.lost] for r in changes], len(numbers))
    weights, intercept = fit(x, np.array([r.toxic for r in rows], float), change,
                             np.array([r.times for r in changes], float), ridge, penalty)
    return Model(numbers, weights, intercept)


def _scored(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(model.numbers)
        for batch in batches:
            names = [n for n in batch.schema.names if n != "_text"]
            for a, b, data, off in chunks(batch.column("_text")):
                doc, feature = reader.pairs(data, off)
                total = np.bincount(doc, weights=model.weights[feature], minlength=b - a) + model.intercept
                yield pa.RecordBatch.from_arrays(
                    [batch.column(n).slice(a, b - a) for n in names] + [pa.array(1 / (1 + np.exp(-total)))],
                    names=names + ["_score"])
    return run


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(_row, _score): every row of ``docs`` but its text, and the probability that it is toxic."""
    rest = F.struct(*[docs[c] for c in docs.columns if c != "text"])
    rows = docs.select(rest.alias("_row"), docs["text"].cast("string").alias("_text"))
    row = rows.schema["_row"].dataType.simpleString()
    return rows.mapInArrow(_scored(model), f"_row {row}, _score double")


def op13_query(documents: DataFrame, labels: DataFrame) -> DataFrame:
    docs = documents.select(documents["doc_id"], documents["text"])
    scratch = Scratch(docs.sparkSession, "toxicity")
    model = train(labelled(docs, labels, scratch), scratch)
    return score(docs, model).select(
        F.col("_row.doc_id").alias("doc_id"), held_out(F.col("_row.doc_id")).alias("held_out"),
        F.col("_score").alias("score"), (F.col("_score") >= 0.5).cast("int").alias("predicted"))
