"""Per-group scans that survive hot groups: row numbers, running sums, lags.

Queue positions, token sequences, "people ahead" counts and "previous
request" lookups are all ordered scans over a (day, doctor | department |
test | pharmacy | token) group.  A plain window puts a whole group into one
task, so a group holding a third of all rows would serialise the job.  Each
helper here (``number_rows``, ``running_sum``, ``lag_within``) therefore:

1. checks for hot groups on a seeded Bernoulli sample of the key columns
   (only whether there are any reaches the driver);
2. scans ordinary groups with a window (``partitionBy(group).orderBy(...)``)
   -- the common case;
3. cuts the hot groups into slices: a range exchange on (group, order) gives
   every task a run of rows, a window scans each (group, slice), and a table
   with one row per (group, slice) carries counts, sums and values from slice
   to slice.

Both ways give the same values; the check decides only where the work is done.
Sliced rows are checkpointed (reliable checkpoint in the session's
``spark.checkpoint.dir``), so a row keeps its slice also after an executor
loss.  Everything stays in DataFrame functions; nested columns pass through.
``order_by`` must end in a unique tie-break.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wardline.session import ensure_checkpoint_dir

DEFAULT_HOT_ROWS = 2_000_000
SAMPLE_HITS = 200
_ANY_HOT: dict = {}


def hot_group_rows(spark) -> int:
    """Rows above which a group is sliced (``wardline.hotGroupRows`` of the session)."""
    return int(spark.conf.get("wardline.hotGroupRows", str(DEFAULT_HOT_ROWS)))


def _order_cols(order_by: Sequence[str | Column]) -> list[Column]:
    return [F.col(c) if isinstance(c, str) else c for c in order_by]


def _match(left: str, right: str, keys: Sequence[str]) -> Column:
    return reduce(lambda a, b: a & b, [F.col(f"{left}.{k}").eqNullSafe(F.col(f"{right}.{k}")) for k in keys])


def _split_hot(df: DataFrame, keys: list[str], hot_rows: int | None) -> tuple[DataFrame, DataFrame] | None:
    """(ordinary rows, rows of hot groups), or None when the check finds no hot group.

    The check counts a sample of the key columns (a group at the limit shows
    about ``2 * SAMPLE_HITS`` rows), so its exchange is tiny however many
    groups there are.
    """
    spark = df.sparkSession
    limit = hot_rows or hot_group_rows(spark)
    fraction = min(1.0, SAMPLE_HITS / (limit / 2.0))
    only_keys, threshold = df.select(*keys), limit
    if fraction < 1.0:
        only_keys = only_keys.sample(withReplacement=False, fraction=fraction, seed=20240115)
        threshold = fraction * limit / 2.0
    sizes = only_keys.groupBy(*keys).agg(F.count(F.lit(1)).alias("_wl_rows"))
    hot = sizes.where(F.col("_wl_rows") > threshold).select(*keys)
    # several queries of a session often check the same input
    memo = (spark.sparkContext.applicationId, sizes.semanticHash(), limit)
    if memo not in _ANY_HOT:
        _ANY_HOT[memo] = not hot.isEmpty()
    if not _ANY_HOT[memo]:
        return None
    ensure_checkpoint_dir(spark)
    hot = hot.checkpoint(eager=True)
    a, b = df.alias("_wl_a"), hot.alias("_wl_b")
    cond = _match("_wl_a", "_wl_b", keys)
    return a.join(b, cond, "left_anti"), a.join(b, cond, "left_semi")


def _scan(df: DataFrame, keys: Sequence[str], hot_rows: int | None, strategy: str, whole, sliced) -> DataFrame:
    """Run ``whole`` on ordinary groups and ``sliced`` on hot ones (or one of them on all, for tests)."""
    keys = list(keys)
    if strategy == "window":
        return whole(df)
    if strategy == "range":
        return sliced(df)
    split = _split_hot(df, keys, hot_rows)
    if split is None:
        return whole(df)
    return whole(split[0]).unionByName(sliced(split[1]))


def _slices(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """Rows with ``_wl_slice``: consecutive runs of the (group, order) sequence."""
    ensure_checkpoint_dir(df.sparkSession)
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return (df.repartitionByRange(n, *[F.col(k) for k in keys], *order)
            .withColumn("_wl_slice", F.spark_partition_id()).checkpoint(eager=True))


def _carry(rows: DataFrame, per_slice: DataFrame, keys: list[str]) -> DataFrame:
    """Join what each (group, slice) receives from earlier slices."""
    a, b = rows.alias("_wl_a"), per_slice.alias("_wl_b")
    cond = _match("_wl_a", "_wl_b", [*keys, "_wl_slice"])
    carried = [c for c in per_slice.columns if c not in (*keys, "_wl_slice")]
    return a.join(b, cond).select("_wl_a.*", *[F.col(f"_wl_b.{c}") for c in carried])


def running_sum(df: DataFrame, partition_by: Sequence[str], order_by: Sequence[str | Column],
                value_col: str, name: str, hot_rows: int | None = None,
                strategy: str = "auto") -> DataFrame:
    """Add ``name`` = sum of ``value_col`` over the group's rows up to and
    including this one (rows frame; nulls count as 0)."""
    return number_rows(df, partition_by, order_by, name, None, hot_rows, strategy, value_col)


def number_rows(df: DataFrame, partition_by: Sequence[str], order_by: Sequence[str | Column],
                name: str, count_name: str | None = None, hot_rows: int | None = None,
                strategy: str = "auto", value_col: str | None = None) -> DataFrame:
    """Add ``name`` = 1..n (BIGINT) within each ``partition_by`` group in ``order_by`` order.

    ``order_by`` must end in a unique tie-break so numbers are deterministic.
    ``count_name`` optionally adds the group size.  ``strategy``: ``auto``
    (slices for hot groups), ``window`` or ``range`` (forces one way; for
    tests).  With ``value_col`` the result is a running sum of that column.
    """
    keys, order = list(partition_by), _order_cols(order_by)
    value = F.coalesce(F.col(value_col), F.lit(0)).cast("long") if value_col else F.lit(1).cast("long")

    def along(*by: str) -> Column:
        return F.sum(value).over(Window.partitionBy(*by).orderBy(*order)
                                 .rowsBetween(Window.unboundedPreceding, Window.currentRow))

    def whole(d: DataFrame) -> DataFrame:
        if value_col:
            out = d.withColumn(name, along(*keys))
        else:
            out = d.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("long"))
        return out.withColumn(count_name, F.count(F.lit(1)).over(Window.partitionBy(*keys))) if count_name else out

    def sliced(d: DataFrame) -> DataFrame:
        rows = _slices(d, keys, order)
        totals = rows.groupBy(*keys, "_wl_slice").agg(F.sum(value).alias("_wl_sum"), F.count(F.lit(1)).alias("_wl_n"))
        before = Window.partitionBy(*keys).orderBy("_wl_slice").rowsBetween(Window.unboundedPreceding, -1)
        per_slice = totals.select(
            *keys, "_wl_slice", F.coalesce(F.sum("_wl_sum").over(before), F.lit(0)).alias("_wl_before"),
            F.sum("_wl_n").over(Window.partitionBy(*keys)).alias("_wl_total"))
        local = rows.withColumn("_wl_local", along(*keys, "_wl_slice"))
        out = _carry(local, per_slice, keys).withColumn(name, F.col("_wl_local") + F.col("_wl_before"))
        if count_name:
            out = out.withColumn(count_name, F.col("_wl_total"))
        return out.drop("_wl_slice", "_wl_local", "_wl_before", "_wl_total")

    return _scan(df, keys, hot_rows, strategy, whole, sliced)


def lag_within(df: DataFrame, partition_by: Sequence[str], order_by: Sequence[str | Column],
               col: str, name: str, ignore_nulls: bool = False, hot_rows: int | None = None,
               strategy: str = "auto") -> DataFrame:
    """Add ``name`` = ``col`` of the previous row of the group (``lag``), or
    with ``ignore_nulls`` the last non-null ``col`` before this row."""
    keys, order = list(partition_by), _order_cols(order_by)

    def previous(value: str, by: list[str], *along: Column) -> Column:
        w = Window.partitionBy(*by).orderBy(*along)
        if ignore_nulls:
            return F.last(value, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
        return F.lag(value).over(w)

    def whole(d: DataFrame) -> DataFrame:
        return d.withColumn(name, previous(col, keys, *order))

    def sliced(d: DataFrame) -> DataFrame:
        rows = _slices(d, keys, order)
        by = [*keys, "_wl_slice"]
        w = Window.partitionBy(*by).orderBy(*order)
        local = rows.withColumn("_wl_i", F.row_number().over(w)).withColumn("_wl_prev", previous(col, by, *order))
        # what a slice hands on: its last row's value, or the last one that is not null
        last = F.coalesce(F.col(col), F.col("_wl_prev")) if ignore_nulls else F.col(col)
        n = F.count(F.lit(1)).over(Window.partitionBy(*by))
        tails = local.withColumn("_wl_n", n).where("_wl_i = _wl_n").select(*by, last.alias("_wl_tail"))
        per_slice = tails.select(*by, previous("_wl_tail", keys, F.col("_wl_slice")).alias("_wl_in"))
        out = _carry(local, per_slice, keys)
        value = (F.coalesce(F.col("_wl_prev"), F.col("_wl_in")) if ignore_nulls
                 else F.when(F.col("_wl_i") == 1, F.col("_wl_in")).otherwise(F.col("_wl_prev")))
        return out.withColumn(name, value).drop("_wl_slice", "_wl_i", "_wl_prev", "_wl_in")

    return _scan(df, keys, hot_rows, strategy, whole, sliced)
