"""Token numbering, queue depth at arrival and expected times (§2.5 W9-W11).

The reference numbers a token with ``COUNT(*) + 1`` and estimates the wait
with another ``COUNT(*)`` at insert time, one request at a time and without
a lock.  Over a log both become ordered scans per (group, day):

* the sequence is a row number in arrival order (unique, deterministic);
* the depth at arrival is a running sum of +/-1 deltas: +1 when a token
  arrives (it is active), and on every later status change the difference
  between its new and previous "active" flag (previous via ``lag`` over the
  token's own requests).  The sum over earlier events is the queue a new
  arrival finds in front of it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardline.functions.columns import seq3
from wardline.operators.ranking import lag_within, number_rows, running_sum


def sequence_numbers(df: DataFrame, group: Sequence[str], order: Sequence[str], prefix: F.Column,
                     name: str = "issued_number") -> DataFrame:
    """``{prefix}{nnn}`` with the per-group arrival sequence (never truncated)."""
    out = number_rows(df, list(group), list(order), "sequence")
    return out.withColumn(name, seq3(prefix, F.col("sequence")))


def department_initial(name: F.Column) -> F.Column:
    """First character of the submitted department text, upper-cased; 'T' if empty."""
    first = F.upper(F.substring(F.coalesce(name, F.lit("")), 1, 1))
    return F.when(first == "", F.lit("T")).otherwise(first)


def depth_at_arrival(arrivals: DataFrame, updates: DataFrame, group: Sequence[str],
                     active: Sequence[str], stored: DataFrame | None = None) -> DataFrame:
    """Active tokens of the same group present when each token arrived.

    ``arrivals``: token_id, ts, group columns (token starts active); further
    columns are passed through.  ``updates``: req_id, token_id, ts, new_status
    (requests for unknown tokens are ignored, as the reference's UPDATE
    matches nothing).  ``stored``: token_id, group columns and status of
    tokens that are there before any arrival.  Returns the columns of
    ``arrivals`` and ``patients_ahead``.
    """
    before = None if stored is None else stored.select(
        "token_id", *group, F.col("status").isin(*active).cast("int").alias("_act"))
    return _depth(arrivals, updates.withColumn("_act", F.col("new_status").isin(*active).cast("int")),
                  list(group), ["token_id"], before)


def depth_of_kinds(arrivals: DataFrame, updates: DataFrame, active: dict[str, Sequence[str]]) -> DataFrame:
    """W10 for tokens of several kinds in one pass: ``kind`` is part of the token and of the
    group (kind, group_id, queue_date); ``active`` holds each kind's active statuses."""
    flag = F.lit(False)
    for kind, statuses in active.items():
        flag = flag | ((F.col("kind") == kind) & F.col("new_status").isin(*statuses))
    return _depth(arrivals, updates.withColumn("_act", flag.cast("int")),
                  ["kind", "group_id", "queue_date"], ["kind", "token_id"])


def _depth(arrivals: DataFrame, updates: DataFrame, group: list[str], token: list[str],
           stored: DataFrame | None = None) -> DataFrame:
    cols = list(dict.fromkeys([*token, "ts", *group]))
    carried = [c for c in arrivals.columns if c not in cols]
    a = arrivals.select(*cols, F.lit(0).alias("_kind"), F.col("token_id").cast("long").alias("_seq"),
                        F.lit(1).alias("_act"), F.struct(F.lit(0), *carried).alias("_carried"))
    blank = F.lit(None).cast(a.schema["_carried"].dataType).alias("_carried")
    known = arrivals.select(*dict.fromkeys([*token, *group]))
    if stored is not None:
        first = F.to_timestamp_ntz(F.lit("1900-01-01 00:00:00")).alias("ts")
        old = stored.select(*token, first, *group, F.lit(-1).alias("_kind"), F.col("token_id").cast("long").alias("_seq"),
                            "_act", blank).select(*a.columns)
        known, a = known.unionByName(stored.select(*known.columns)), a.unionByName(old)
    u = updates.select(*token, "ts", F.col("req_id").cast("long").alias("_seq"), "_act").join(known, token).select(
        *cols, F.lit(1).alias("_kind"), "_seq", "_act", blank)
    ev = a.unionByName(u)
    # Previous flag of the same token (skew-safe lag over the token's events).
    ev = lag_within(ev, token, ["ts", "_kind", "_seq"], "_act", "_prev_act")
    ev = ev.withColumn("_delta", F.col("_act") - F.coalesce(F.col("_prev_act"), F.lit(0)))
    summed = running_sum(ev, group, ["ts", "_kind", "_seq"], "_delta", "_running")
    return summed.where(F.col("_kind") == 0).select(
        *cols, *[F.col(f"_carried.{c}") for c in carried], (F.col("_running") - F.col("_delta")).alias("patients_ahead"))
