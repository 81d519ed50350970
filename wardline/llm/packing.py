"""Best-fit decreasing packing of tokenised documents into fixed-size sequences.

Documents become token ids (and one end id); only documents longer than a
sequence are cut, into full pieces and a last shorter one.  A full piece is a
sequence of its own.  All other pieces are dealt into groups by a hash and
each group is packed best-fit decreasing: longest piece first, into the open
sequence with the least room that still holds it.  A segment tree over the
possible remaining capacities finds that sequence in logarithmic time.  A
group has about ``GROUP_PIECES`` pieces, so packing is spread over tasks and
each group wastes little: its last, partly filled sequences.

The tokenizer drops white space, so a text's ids are the ids of its
white-space separated chunks one after the other; chunks repeat a lot and
their ids are remembered by each worker (up to ``CACHE_CHUNKS`` chunks, then
the memory starts anew).

Defined results: a null text is an empty one (only the end id); repeated rows
are packed each; an empty table gives an empty result; other columns are
ignored; a null doc_id is kept as null.
"""

from __future__ import annotations

import re
import sys
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardline.llm.scratch import Scratch, clean_columns

MAX_TOKENS = 2048
END_ID = 0
VOCABULARY = "word_bpe_49k.json"
GROUP_PIECES = 32_768
CACHE_CHUNKS = 700_000
SEQUENCES_PER_GROUP = 1 << 32

_tokenizers: dict = {}


# A word of these letters is already composed, is lower-cased letter by letter and is one unit of the tokenizer;
# one mark after it is another unit.
_PLAIN = re.compile("([a-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+)([.,;:!?]?)").fullmatch


def id_bytes(ids: list[int]) -> bytes:
    """Little-endian unsigned 32-bit numbers."""
    packed = array("I", ids)
    if sys.byteorder == "big":
        packed.byteswap()
    return packed.tobytes()


def byte_letters() -> dict[int, int]:
    """The character for each byte in a byte-level vocabulary: printable ones themselves, the rest from 256 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in printable]
    return {b: b for b in printable} | {b: 256 + i for i, b in enumerate(others)}


class ChunkTokenizer:
    """Token ids of texts as little-endian unsigned 32-bit bytes."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.letters = byte_letters()
        self.known: dict[bytes, bytes] = {}

    def plain_ids(self, word: str) -> bytes:
        """Ids of a word of plain letters, from the model alone."""
        unit = word.lower().encode().decode("latin-1").translate(self.letters)
        return id_bytes([t.id for t in self.model.tokenize(unit)])

    def encode(self, chunks: list[str]) -> list[bytes]:
        return [id_bytes(e.ids) for e in self.tokenizer.encode_batch(chunks, add_special_tokens=False)]

    def learn(self, parts: list[bytes]) -> None:
        known, hard = self.known, []
        for part in parts:
            if part in known:
                continue
            plain = _PLAIN(part.decode())
            if plain is None:
                hard.append(part)
                continue
            word, mark = plain.groups()
            base = word.encode()
            ids = known.get(base)
            if ids is None:
                ids = known[base] = self.plain_ids(word)
            if mark:
                known[part] = ids + self.mark(mark)
        hard = list(set(hard))
        for part, ids in zip(hard, self.encode([h.decode() for h in hard])):
            known[part] = ids

    def mark(self, mark: str) -> bytes:
        key = mark.encode()
        if key not in self.known:
            self.known[key] = self.encode([mark])[0]
        return self.known[key]

    def ids(self, text: bytes) -> bytes:
        # the tokenizer lower-cases everything but its special tokens, which begin like this
        parts = (text if b"<|" in text else text.lower()).split()  # bytes.split: ASCII white space only
        known = self.known
        try:
            return b"".join([known[p] for p in parts])
        except KeyError:
            pass
        if len(known) > CACHE_CHUNKS:
            known.clear()
        self.learn(parts)
        return b"".join([known[p] for p in parts])


def tokenizer(path: str) -> ChunkTokenizer:
    if path not in _tokenizers:
        _tokenizers[path] = ChunkTokenizer(path)
    return _tokenizers[path]


def piece_rows(text: bytes, tok: ChunkTokenizer, max_tokens: int) -> Iterator[tuple[int, int, int, int]]:
    """(piece, start, length, crc32 of the ids) of one document."""
    ids = tok.ids(text) + END_ID.to_bytes(4, "little")
    n = len(ids) // 4
    for piece, start in enumerate(range(0, n, max_tokens)):
        length = min(max_tokens, n - start)
        yield piece, start, length, zlib.crc32(ids[4 * start:4 * (start + length)])


def pieces(docs: DataFrame, path: str, max_tokens: int = MAX_TOKENS) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 for each piece of each document."""
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = tokenizer(path)
        for batch in batches:
            texts = batch.column("text").cast(pa.large_binary())
            rows, at = [], []
            for i in range(len(texts)):
                for row in piece_rows(texts[i].as_py() or b"", tok, max_tokens):
                    rows.append(row)
                    at.append(i)
            if not rows:
                continue
            piece, start, length, crc = zip(*rows)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(pa.array(at)), pa.array(piece, pa.int32()), pa.array(start, pa.int64()),
                 pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
                names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.mapInArrow(cut, f"doc_id {id_type}, piece int, start long, length long, ids_crc32 long")


class OpenBins:
    """Open bins by remaining capacity, under a segment tree that finds the tightest fit."""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.open = [0] * (2 * self.size)  # number of open bins below each node
        self.bins: list[list[int]] = [[] for _ in range(capacity + 1)]

    def add(self, room: int, bin_id: int) -> None:
        self.bins[room].append(bin_id)
        node = self.size + room
        while node:
            self.open[node] += 1
            node >>= 1

    def take(self, need: int) -> tuple[int, int] | None:
        """Remove and return (room, bin) with the least room of at least ``need``."""
        tree, node = self.open, self.size + need
        if not tree[node]:
            # climb until a right sibling has an open bin, then descend to its left
            while node > 1 and (node & 1 or not tree[node + 1]):
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < self.size:
                node = 2 * node if tree[2 * node] else 2 * node + 1
        room = node - self.size
        while node:
            tree[node] -= 1
            node >>= 1
        return room, self.bins[room].pop()


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each length; lengths must be in falling order."""
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    free, n_bins = OpenBins(capacity), 0
    for i, length in enumerate(lengths.tolist()):
        found = free.take(length)
        if found is None:
            room, b, n_bins = capacity, n_bins, n_bins + 1
        else:
            room, b = found
        bins[i], offsets[i] = b, capacity - room
        if room > length:
            free.add(room - length, b)
    return bins, offsets


def pack(parts: DataFrame, scratch: Scratch, max_tokens: int = MAX_TOKENS, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """Add sequence_id and offset to pieces."""
    parts = scratch.write(parts, "pieces")
    n_groups = max(1, -(-parts.count() // group_pieces))
    # the place in the written table sets equal rows apart
    key = F.xxhash64("doc_id", "piece", "start", "ids_crc32", F.monotonically_increasing_id())
    grouped = parts.withColumn("_group", F.pmod(key, F.lit(n_groups)))

    def fill(table: pa.Table) -> pa.Table:
        table = table.sort_by([("length", "descending"), ("doc_id", "ascending"), ("piece", "ascending"),
                               ("ids_crc32", "ascending")])
        bins, offsets = best_fit_decreasing(table["length"].to_numpy(), max_tokens)
        group = table["_group"][0].as_py()
        return (table.drop_columns(["_group"])
                .append_column("sequence_id", pa.array(group * SEQUENCES_PER_GROUP + bins))
                .append_column("offset", pa.array(offsets)))

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in parts.schema.fields)
    return grouped.groupBy("_group").applyInArrow(fill, f"{schema}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, path: str | None = None, max_tokens: int = MAX_TOKENS,
                   group_pieces: int = GROUP_PIECES) -> DataFrame:
    """Tokenise, cut and pack ``docs`` (doc_id, text); ``path`` is the vocabulary file on the executors."""
    if path is None:
        import public_tokenizers
        path = public_tokenizers.path(VOCABULARY)
    scratch = Scratch(docs.sparkSession, "pack")
    return pack(pieces(clean_columns(docs, "doc_id", "text"), path, max_tokens), scratch, max_tokens, group_pieces)


def op3_query(documents: DataFrame) -> DataFrame:
    return pack_documents(documents)
