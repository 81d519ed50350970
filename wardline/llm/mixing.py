"""Mixing sources to target weights by Pareto order sampling.

Every document has an expected number of copies: its source's target over its
source's size, times its preference if one is given, at most ``max_copies``.
The whole part of that number is certain.  The rest is an inclusion
probability p, and documents of a source are ranked by Pareto's ratio
``(u / (1 - u)) / (p / (1 - p))`` for a random u that depends on the seed and
the document alone.  Documents are taken in this order as long as their words
stay within what the certain copies leave of the target; one more document,
the one of the rest whose size is nearest to what is still open, completes a
source if that brings it nearer.

Only DataFrame functions are used.  The order is never sorted as a whole: the
ratio is cut into ``BUCKETS`` ranges, sums of words for each range tell in
which one a source's order ends, and only this range is ordered.  What each
document needs to know is then a row for its source (target and cut).

Defined results: a null text has no words; a null source is a source of its
own, last in the order of sources; documents without words are never taken;
rows that agree in id and text rank alike and share their fate at the cut; an
empty table gives an empty result; other columns of the input are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wardline.llm.ranks import with_index
from wardline.llm.scratch import Scratch, clean_columns

WEIGHTS = (1, 2, 3)
MAX_COPIES = 3
BUCKETS = 4096
SEED = "mix-1"
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def random_key(doc_id: Column, text: Column, seed: str = SEED) -> Column:
    """A digest of the seed and the document: the same in every run."""
    own = F.coalesce(doc_id.cast("string"), F.lit("")), F.coalesce(F.md5(text), F.lit(""))
    return F.md5(F.concat_ws("|", F.lit(seed), *own))


def uniform(key: Column) -> Column:
    """A number inside (0, 1) from the first 52 bits of a digest."""
    return (F.conv(F.substring(key, 1, 13), 16, 10).cast("double") + 0.5) / float(2 ** 52)


def source_targets(scratch: Scratch, sizes: DataFrame, weights=WEIGHTS, max_copies: int = MAX_COPIES,
                   total_share: float = 1.0) -> DataFrame:
    """(source, source_size, target) for (source, size) rows.

    Weights repeat along the sources in code point order, null last.  They
    share ``total_share`` of all sizes; a target stops at ``max_copies``
    times its source's size and the excess goes to the others by weight.
    """
    per_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = with_index(scratch, per_source, "sources", "_rank", F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]),
                          (F.col("_rank") % len(weights) + 1).cast("int"))
    table = scratch.write(ranked.select("source", "source_size", weight.alias("weight"),
                                        (F.col("source_size") * max_copies).alias("cap")), "weights")
    # the level rises until no further source is capped; each step is one aggregate of three numbers
    level, n_capped = 0.0, -1
    total = (table.agg(F.sum("source_size")).first()[0] or 0) * total_share
    while True:
        capped = F.col("cap") <= F.col("weight") * level
        full, open_weight, n = table.agg(
            F.coalesce(F.sum(F.when(capped, F.col("cap"))), F.lit(0)),
            F.coalesce(F.sum(F.when(~capped, F.col("weight"))), F.lit(0.0)),
            F.count(F.when(capped, 1))).first()
        if n == n_capped or not open_weight:
            break
        level, n_capped = (total - full) / open_weight, n
    target = F.least(F.col("cap").cast("double"), F.col("weight") * F.lit(float(level)))
    return scratch.write(table.select("source", "source_size", target.alias("target")), "targets")


def with_odds(docs: DataFrame, targets: DataFrame, max_copies: int) -> DataFrame:
    """Add certain copies, inclusion probability, Pareto ratio and its range to (source, size, key, preference)."""
    joined = docs.join(targets.withColumnRenamed("source", "_source"),
                       F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    copies = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    expected = F.least(F.lit(float(max_copies)), copies * F.col("preference"))
    u, p = uniform(F.col("key")), F.col("p")
    ratio = F.when((F.col("size") > 0) & (p > 0), (u / (1 - u)) * ((1 - p) / p))
    return (joined.withColumn("whole", F.floor(expected))
            .withColumn("p", expected - F.floor(expected))
            .withColumn("ratio", ratio)
            .withColumn("bucket", F.floor(F.col("ratio") / (1 + F.col("ratio")) * BUCKETS)))


def cuts(scratch: Scratch, odds: DataFrame) -> DataFrame:
    """(source, end_bucket, cut_ratio, cut_key, open): the last place of each source's order
    that is taken, and the words that are still open after it."""
    by_bucket = odds.groupBy("source", "bucket").agg(
        F.sum("size").alias("words"), F.sum(F.col("whole") * F.col("size")).alias("certain"),
        F.first("target").alias("target"))
    own = Window.partitionBy("source")
    summed = scratch.write(
        by_bucket.withColumn("need", F.col("target") - F.sum("certain").over(own))
        .where("bucket is not null")
        .withColumn("through", F.sum("words").over(own.orderBy("bucket"))), "buckets")
    ends = scratch.write(summed.where("through > need").groupBy("source").agg(
        F.min(F.struct("bucket", "through", "words", "need")).alias("end")).select("source", "end.*"), "ends")
    in_end = odds.where("ratio is not null").alias("d").join(
        ends.alias("e"), F.col("d.source").eqNullSafe(F.col("e.source")) & (F.col("d.bucket") == F.col("e.bucket")))
    along = Window.partitionBy("source").orderBy("ratio", "key").rowsBetween(Window.unboundedPreceding, 0)
    placed = in_end.select("d.source", "d.size", "ratio", "key", "need",
                           (F.col("through") - F.col("words")).alias("before")) \
        .withColumn("reached", F.col("before") + F.sum("size").over(along))
    inside = placed.where("reached <= need").groupBy("source").agg(
        F.max(F.struct("ratio", "key", "reached")).alias("last"))
    # a source whose order never exceeds the need is taken whole; one that ends before the
    # first document of its range is cut at the range's lower end
    every = scratch.write(odds.groupBy("source").agg(F.count("*").alias("_n")).drop("_n"), "cut-sources")
    on = lambda a, b: F.col(f"{a}.source").eqNullSafe(F.col(f"{b}.source"))
    lower = F.when(F.col("t.bucket").isNull(), F.lit(float("inf"))).otherwise(
        F.col("t.bucket") / (F.lit(float(BUCKETS)) - F.col("t.bucket")))
    return scratch.write(
        every.alias("s").join(ends.alias("t"), on("s", "t"), "left").join(inside.alias("i"), on("s", "i"), "left")
        .select("s.source", F.coalesce(F.col("i.last.ratio"), lower).alias("cut_ratio"),
                F.coalesce(F.col("i.last.key"), F.lit("")).alias("cut_key"),
                F.col("t.bucket").alias("end_bucket"),
                (F.col("t.need") - F.coalesce(F.col("i.last.reached"), F.col("t.through") - F.col("t.words"))
                 ).alias("open")), "cuts")


def mix(docs: DataFrame, *, weights=WEIGHTS, max_copies: int = MAX_COPIES, total_share: float = 1.0,
        preference: str | None = None, seed: str = SEED) -> DataFrame:
    """doc_id, key, size, source, source_size, target, copies and taken words for each row of ``docs``.

    ``preference`` names a column of positive numbers (null: 1) that scale the
    expected copies inside a source; without it all documents of a source
    have the same probability.
    """
    scratch = Scratch(docs.sparkSession, "mix")
    liked = F.coalesce(docs[preference].cast("double"), F.lit(1.0)) if preference else F.lit(1.0)
    rows = scratch.write(docs.select(
        docs["doc_id"], docs["source"], word_count(docs["text"]).alias("size"),
        random_key(docs["doc_id"], docs["text"], seed).alias("key"), liked.alias("preference")), "rows")
    targets = source_targets(scratch, rows.select("source", "size"), weights, max_copies, total_share)
    odds = with_odds(rows, targets, max_copies)
    end = cuts(scratch, odds).withColumnRenamed("source", "_source")
    joined = odds.join(end, F.col("source").eqNullSafe(F.col("_source")))
    before = F.col("end_bucket").isNull() | (F.col("bucket") < F.col("end_bucket")) | (
        (F.col("bucket") == F.col("end_bucket")) & (
            (F.col("ratio") < F.col("cut_ratio"))
            | ((F.col("ratio") == F.col("cut_ratio")) & (F.col("key") <= F.col("cut_key")))))
    ranked = joined.withColumn("drawn", F.col("ratio").isNotNull() & before)
    miss = F.abs(F.col("size") - F.col("open"))
    last = scratch.write(
        ranked.where(~F.col("drawn") & F.col("ratio").isNotNull() & (miss < F.col("open")))
        .groupBy("source").agg(F.min(F.struct(miss.alias("miss"), "key")).alias("last"))
        .select(F.col("source").alias("_last_of"), F.col("last.key").alias("last_key")), "completing")
    placed = ranked.join(last, F.col("source").eqNullSafe(F.col("_last_of")), "left")
    drawn = F.col("drawn") | F.coalesce(F.col("key") == F.col("last_key"), F.lit(False))
    copies = F.when(F.col("size") > 0, F.col("whole") + drawn.cast("long")).otherwise(0).cast("long")
    return placed.select("doc_id", "key", "size", "source", "source_size", "target", copies.alias("copies"),
                         (copies * F.col("size")).alias("taken"))


def repeat_by_mix(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` as often as the mix takes them, with their own columns."""
    seed = options.get("seed", SEED)
    # rows with the same key agree in id and text; they have the same copies
    copies = (mix(docs, **options).groupBy("key").agg(F.max("copies").cast("int").alias("copies"))
              .where("copies > 0"))
    keyed = docs.select(F.struct("*").alias("doc"), random_key(docs["doc_id"], docs["text"], seed).alias("key"))
    return (keyed.join(copies, "key").select("doc", F.explode(F.sequence(F.lit(1), "copies")).alias("copy"))
            .select("doc.*"))


def op2_query(documents: DataFrame) -> DataFrame:
    return mix(clean_columns(documents, "doc_id", "source", "text")).select(
        "doc_id", "size", "source_size", "target", "taken")
