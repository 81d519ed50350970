"""Membership of hashed values in a bit array of fixed size: no false negatives."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_CHUNK_BITS = 19  # a group builds 64 KB of the array


class Bitmap:
    """The low bits of a hash are the place of its bit.  Its size does not grow with the data."""

    def __init__(self, words: np.ndarray):
        self.words = words

    @classmethod
    def of(cls, df: DataFrame, column: str, bits: int) -> "Bitmap":
        """Groups build chunks of the array; the driver joins them (2^(bits - 3) bytes in all)."""
        chunk_bits = min(bits, _CHUNK_BITS)

        def build(table: pa.Table) -> pa.Table:
            at = np.unique(table["at"].to_numpy() & ((1 << chunk_bits) - 1))
            own = np.zeros(1 << chunk_bits, dtype=np.uint8)
            own[at] = 1
            return pa.table({"chunk": table["chunk"].slice(0, 1), "packed": [np.packbits(own, bitorder="little").tobytes()]})

        places = df.select(F.col(column).bitwiseAND(F.lit((1 << bits) - 1)).alias("at")).distinct()
        parts = places.withColumn("chunk", F.shiftright("at", chunk_bits)).groupBy("chunk").applyInArrow(
            build, "chunk long, packed binary").collect()
        packed = np.zeros(1 << (bits - 3), dtype=np.uint8)
        width = 1 << (chunk_bits - 3)
        for part in parts:
            packed[part["chunk"] * width:(part["chunk"] + 1) * width] = np.frombuffer(part["packed"], np.uint8)
        return cls(packed)

    def has(self, values: np.ndarray) -> np.ndarray:
        at = values & np.uint64(len(self.words) * 8 - 1)
        return (self.words[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1
