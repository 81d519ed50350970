"""License scans: exact phrases, and short notices with bounded errors.

Base labels: places where the words of a fixed phrase stand one after the
other.  The method's labels: canonical notices that occur with at most
``errors`` edits.  By the pigeonhole principle a notice cut into errors + 1
seeds has a seed that stands in the text unchanged, so an Aho-Corasick pass
over the seeds gives every place where the notice can be; around these places
the bounded-error matching of the ``regex`` library verifies the edits and
reports the span.  Texts are compared as their words joined by single spaces.

Defined results: a null or empty text has no words and no labels; overlapping
places all count; repeated rows are scanned each; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame

from wardline.llm.scratch import clean_columns

# Base phrases and their labels.
BASE_PHRASES = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))

# Openings of well-known notices, as words joined by spaces.
NOTICES = (
    ("permission is hereby granted free of charge to any person obtaining a copy", "mit"),
    ("released under the mit license", "mit"),
    ("licensed under the mit license", "mit"),
    ("licensed under the apache license version 2 0", "apache-2"),
    ("under the terms of the apache license version 2 0", "apache-2"),
    ("licensed under the gnu general public license version 3", "gpl-3"),
    ("licensed under the gnu general public license version 2", "gpl-2"),
    ("under the terms of the gnu general public license", "gpl"),
    ("under the terms of the gnu lesser general public license", "lgpl"),
    ("under the terms of the gnu affero general public license", "agpl"),
    ("redistribution and use in source and binary forms with or without modification", "bsd"),
    ("released under the bsd license", "bsd"),
    ("subject to the terms of the mozilla public license", "mpl"),
    ("licensed under cc by nc 4 0", "cc-by-nc"),
    ("licensed under a creative commons attribution noncommercial", "cc-by-nc"),
    ("licensed under a creative commons attribution sharealike", "cc-by-sa"),
    ("licensed under a creative commons attribution 4 0", "cc-by"),
    ("this is free and unencumbered software released into the public domain", "unlicense"),
    ("all rights reserved", "all-rights-reserved"),
)
LETTERS_PER_ERROR = 12

_KEEP = bytes(range(48, 58)) + bytes(range(97, 123)) + bytes(range(128, 256))
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if b in _KEEP else 32 for b in range(256))


def normal_words(text: bytes) -> bytes:
    """The words of a text (A-Z lower-cased) joined by single spaces."""
    return b" ".join(text.translate(_TABLE).split())


@dataclass(frozen=True)
class Match:
    label: str
    start: int   # character offset in the normalised text
    end: int
    errors: int
    score: float


def best_of_overlaps(matches: list[Match]) -> list[Match]:
    """Without matches that overlap one with fewer errors (notices of a family differ by a word)."""
    kept: list[Match] = []
    for m in sorted(matches, key=lambda m: (m.errors, m.start, -m.end)):
        if not any(k.errors < m.errors and m.start < k.end and k.start < m.end for k in kept):
            kept.append(m)
    return sorted(kept, key=lambda m: (m.start, m.end, m.label))


class Scanner:
    """Searches normalised texts for notices with bounded errors."""

    def __init__(self, notices=NOTICES, letters_per_error: int = LETTERS_PER_ERROR):
        import ahocorasick
        import regex

        self.notices, seeds = [], {}
        for n, (text, label) in enumerate(notices):
            errors = len(text) // letters_per_error
            # a seed of every one of the errors + 1 pieces
            bounds = [len(text) * i // (errors + 1) for i in range(errors + 2)]
            for a, b in zip(bounds, bounds[1:]):
                seeds.setdefault(text[a:b], []).append((n, a))
            pattern = regex.compile(f"(?b)(?<![0-9a-z])(?:{regex.escape(text)}){{e<={errors}}}(?![0-9a-z])")
            self.notices.append((text, label, errors, pattern))
        self.automaton = ahocorasick.Automaton()
        for seed, places in seeds.items():
            self.automaton.add_word(seed, (len(seed), places))
        self.automaton.make_automaton()

    def windows(self, text: str) -> dict[int, list[tuple[int, int]]]:
        """Per notice, the merged ranges of the text in which a seed allows a match."""
        ranges: dict[int, list[tuple[int, int]]] = {}
        for last, (length, places) in self.automaton.iter(text):
            begin = last + 1 - length
            for n, offset in places:
                notice, _, errors, _ = self.notices[n]
                at = begin - offset
                lo, hi = max(0, at - errors - 1), min(len(text), at + len(notice) + errors + 1)
                own = ranges.setdefault(n, [])
                if own and lo <= own[-1][1]:
                    own[-1] = (min(lo, own[-1][0]), max(hi, own[-1][1]))
                else:
                    own.append((lo, hi))
        return ranges

    def search(self, text: str) -> list[Match]:
        found = []
        for n, ranges in self.windows(text).items():
            notice, label, errors, pattern = self.notices[n]
            # the best match of a range, then those in front of it and behind it
            left = list(ranges)
            while left:
                lo, hi = left.pop()
                m = pattern.search(text, lo, hi) if hi > lo else None
                if m is None:
                    continue
                edits = sum(m.fuzzy_counts)
                found.append(Match(label, m.start(), m.end(), edits, 1 - edits / len(notice)))
                left += [(lo, m.start()), (max(m.end(), lo + 1), hi)]
        return best_of_overlaps(found)


def base_places(words: bytes, phrases=BASE_PHRASES) -> list[tuple[int, str]]:
    """(word index, label) of every place where a phrase's words stand consecutively."""
    found, padded = [], b" " + words + b" "
    for phrase, label in phrases:
        needle = b" " + phrase.encode() + b" "
        at, counted, index = padded.find(needle), 0, 0
        while at >= 0:
            index += padded.count(b" ", counted, at)
            counted = at
            found.append((index, label))
            at = padded.find(needle, at + 1)
    return sorted(found)


def scan(docs: DataFrame, notices=NOTICES) -> DataFrame:
    """Counts, places, labels, score and matched spans of each document."""
    docs = clean_columns(docs, "doc_id", "text")
    id_type = docs.schema["doc_id"].dataType.simpleString()
    match_type = pa.list_(pa.struct([("label", pa.string()), ("begin", pa.int64()), ("end", pa.int64()),
                                     ("errors", pa.int32()), ("score", pa.float64()), ("found", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(notices)
        for batch in batches:
            texts = batch.column("text").cast(pa.large_binary())
            rows = []
            for i in range(len(texts)):
                words = normal_words(texts[i].as_py() or b"")
                base = base_places(words)
                text = words.decode()
                matches = scanner.search(text)
                base_labels = {label for _, label in base}
                labels = base_labels | {m.label for m in matches}
                score = 1.0 if base else max([m.score for m in matches], default=0.0)
                rows.append((words.count(b" ") + 1 if words else 0, len(base),
                             base[0][0] if base else None, base[-1][0] if base else None,
                             ",".join(sorted(base_labels)), ",".join(sorted(labels)), score,
                             [{"label": m.label, "begin": m.start, "end": m.end, "errors": m.errors,
                               "score": m.score, "found": text[m.start:m.end]} for m in matches]))
            cols = list(zip(*rows)) if rows else [()] * 8
            types = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), match_type]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *[pa.array(c, t) for c, t in zip(cols, types)]],
                names=["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score",
                       "matches"])

    return docs.mapInArrow(run, f"doc_id {id_type}, n_words long, n_base long, first_word long, last_word long, "
                                "base_labels string, labels string, score double, matches array<struct<label:string,"
                                "begin:bigint,end:bigint,errors:int,score:double,found:string>>")


def op10_query(documents: DataFrame) -> DataFrame:
    return scan(documents).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels",
                                  "score")
