"""Sharding by a hypergeometric communication matrix.

Rows are dealt into blocks.  How many rows of each block go to each shard is
drawn exactly, as the counts of a uniformly random arrangement: block by
block and shard by shard a hypergeometric number of what is left.  Each block
then permutes its own rows and cuts them at these counts, the pieces are
exchanged, and every shard permutes what it received.  The result is a
uniform shuffle whose shard sizes are exact, at most one apart (law ``rows``).

The driver draws ``blocks x shards`` numbers (at most ``MAX_BLOCKS`` blocks);
rows stay in DataFrames and only SQL functions touch them.

Defined results: a null text has no bytes; rows with equal id and text are
rows of their own; with fewer rows than shards some shards stay empty; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import json
import math
import random

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wardline.llm.scratch import Scratch, clean_columns

ROWS_PER_BLOCK = 50_000
MAX_BLOCKS = 4096
SEED = 20260


def draw_hypergeometric(rng: random.Random, good: int, bad: int, n: int) -> int:
    """How many of ``n`` draws without replacement are good, by inversion from the mode outwards."""
    low, high = max(0, n - bad), min(n, good)
    if low >= high:
        return low
    mode = min(high, max(low, (n + 1) * (good + 1) // (good + bad + 2)))

    def log_choose(a: int, b: int) -> float:
        return math.lgamma(a + 1) - math.lgamma(b + 1) - math.lgamma(a - b + 1)

    at_mode = math.exp(log_choose(good, mode) + log_choose(bad, n - mode) - log_choose(good + bad, n))
    u = rng.random() - at_mode
    up = down = mode
    p_up = p_down = at_mode
    while u > 0:
        moved = False
        if up < high:
            p_up *= (good - up) * (n - up) / ((up + 1) * (bad - n + up + 1))
            up, moved = up + 1, True
            u -= p_up
            if u <= 0:
                return up
        if down > low:
            p_down *= down * (bad - n + down) / ((good - down + 1) * (n - down + 1))
            down, moved = down - 1, True
            u -= p_down
            if u <= 0:
                return down
        if not moved or (p_up == 0 and p_down == 0):
            return mode  # what rounding left over
    return mode


def communication_matrix(block_rows: list[int], n_shards: int, seed: int) -> list[list[int]]:
    """Rows of each block for each shard; row sums are the blocks', column sums differ by one at most."""
    rng = random.Random(seed)
    total = sum(block_rows)
    sizes = [total // n_shards + (s < total % n_shards) for s in range(n_shards)]
    rng.shuffle(sizes)
    left, matrix = sizes, []
    for n in block_rows:
        row, rest = [], sum(left)
        for s in range(n_shards):
            rest -= left[s]
            k = draw_hypergeometric(rng, left[s], rest, n)
            row.append(k)
            n -= k
        left = [a - b for a, b in zip(left, row)]
        matrix.append(row)
    return matrix


def blocks_for(rows: int, rows_per_block: int) -> int:
    return max(1, min(MAX_BLOCKS, -(-rows // rows_per_block)))


def bucket_of(key: Column, n: int) -> Column:
    return F.pmod(F.xxhash64(key, F.lit(n)), F.lit(n)).cast("int")


def shard(docs: DataFrame, n_shards: int = 24, *, rows_per_block: int = ROWS_PER_BLOCK, seed: int = SEED) -> DataFrame:
    """doc_id, size, text_crc32, shard and slot for each row of ``docs`` (doc_id, text)."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "shard")
    text = F.coalesce(docs["text"], F.lit(""))
    rows = docs.select(docs["doc_id"], (F.octet_length(text) + 8).cast("long").alias("size"),
                       F.crc32(text).alias("text_crc32"))
    for name, salt in (("k1", seed), ("k2", seed + 1)):
        rows = rows.withColumn(name, F.xxhash64("doc_id", "size", "text_crc32", F.lit(salt)))
    rows = scratch.write(rows, "rows")
    n = rows.count()

    # counts of each block, the matrix, and each block's cuts
    n_blocks = blocks_for(n, rows_per_block)
    blocked = rows.withColumn("block", bucket_of(F.col("k1"), n_blocks))
    counts = {r["block"]: r["n"] for r in blocked.groupBy("block").agg(F.count("*").alias("n")).collect()}
    matrix = communication_matrix([counts.get(b, 0) for b in range(n_blocks)], n_shards, seed)
    literal = F.from_json(F.lit(json.dumps(matrix)), "array<array<bigint>>")
    sent = scratch.write(spark.range(1).select(F.posexplode(literal).alias("block", "sent")), "matrix")

    # permute each block, cut it, and note which shard each piece goes to
    order = Window.partitionBy("block").orderBy("k1", "doc_id", "text_crc32", "size")
    ranked = blocked.withColumn("place", F.row_number().over(order).cast("long") - 1)
    # a shard's piece of a block starts after the pieces of the shards before it
    starts = F.transform(F.sequence(F.lit(1), F.lit(n_shards)), lambda s: F.aggregate(
        F.slice(F.col("sent"), F.lit(1), s), F.lit(0).cast("long"), lambda a, x: a + x))
    ends = scratch.write(sent.select("block", starts.alias("ends")), "ends")
    n_rooms = blocks_for(-(-n // n_shards), rows_per_block)
    dealt = scratch.write(
        ranked.join(ends, "block")
        .withColumn("shard", F.size(F.filter("ends", lambda e: e <= F.col("place"))).cast("int"))
        .select("doc_id", "size", "text_crc32", "k2", "shard", bucket_of(F.col("k2"), n_rooms).alias("room")), "dealt")

    # permute each shard: rooms of random rows, one after the other
    before = Window.partitionBy("shard").orderBy("room").rowsBetween(Window.unboundedPreceding, -1)
    offsets = scratch.write(dealt.groupBy("shard", "room").agg(F.count("*").alias("_n"))
                            .select("shard", "room", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before")),
                            "offsets")
    inside = Window.partitionBy("shard", "room").orderBy("k2", "doc_id", "text_crc32", "size")
    return (dealt.withColumn("_in", F.row_number().over(inside).cast("long") - 1)
            .join(offsets, ["shard", "room"])
            .select("doc_id", "size", "text_crc32", "shard", (F.col("_before") + F.col("_in")).alias("slot")))


def op4_query(documents: DataFrame) -> DataFrame:
    return shard(clean_columns(documents, "doc_id", "text"), 24).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"))
