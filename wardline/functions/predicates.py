"""Row predicates and ordering tiers (§2.2 F1-F4, F8, F10-F12, F17).

Builders return Columns, so filters stay inside Catalyst: a day filter on
``queue_date`` prunes partitions and pushes down to Parquet.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardline.functions.columns import (LAB_ACTIVE, OPD_ACTIVE, PHARMACY_ACTIVE, starts_pb,
                                        upper_key)

ACTIVE = {"opd": OPD_ACTIVE, "lab": LAB_ACTIVE, "pharmacy": PHARMACY_ACTIVE}
# Valid booking statuses per kind.
VALID_BOOKING = {"opd": ("booked", "confirmed"), "lab": ("booked", "checked_in", "in_progress")}


def on_day(df: DataFrame, as_of=None, day_col: str = "queue_date") -> DataFrame:
    """the business-day filter; ``as_of=None`` keeps every day."""
    return df if as_of is None else df.where(F.col(day_col) == F.lit(as_of).cast("date"))


def is_active(kind: str, status: str = "status") -> Column:
    """active statuses of an OPD, lab or pharmacy token."""
    return F.col(status).isin(*ACTIVE[kind])


def valid_bookings(df: DataFrame, kind: str, as_of=None, status: str = "status") -> DataFrame:
    """bookings that can still be used: valid status and not dated
    before ``as_of`` (all days when ``as_of`` is None)."""
    out = df.where(F.col(status).isin(*VALID_BOOKING[kind]))
    if as_of is not None:
        out = out.where(F.col("appointment_date") >= F.lit(as_of).cast("date"))
    return out


def apply_filters(df: DataFrame, **opts) -> DataFrame:
    """optional equality filters composed at run time; 0, '' and None mean
    "not set", as the endpoints' ``if ($x > 0)`` / ``if (!empty($x))``."""
    for col_name, value in opts.items():
        if value is None or value == 0 or value == "":
            continue
        df = df.where(F.col(col_name) == F.lit(value))
    return df


def is_prebooked(token_type: str = "token_type", type_: str | None = "type",
                 number: str = "token_number") -> Column:
    """F8: ``token_type = 'prebooked' [OR type = 'prebooked'] OR number LIKE 'PB%'``."""
    c = (F.col(token_type) == "prebooked") | starts_pb(number)
    if type_:
        c = c | (F.col(type_) == "prebooked")
    return c


def queue_time(prebooked: Column) -> Column:
    """pre-booked tokens queue at their expected time (else arrival time)."""
    return F.when(prebooked, F.coalesce("expected_sod", "created_sod")).otherwise(F.col("created_sod"))


def tier_live() -> Column:
    """F11(a): consulting, then pre-booked (type or PB number), then the rest."""
    return (F.when(F.col("status") == "consulting", 0)
            .when((F.col("token_type") == "prebooked") | starts_pb("token_number"), 1).otherwise(2))


def tier_worklist() -> Column:
    """F11(b): consulting, pre-booked, review, rest."""
    typ = F.coalesce("token_type", "type")
    return (F.when(F.col("status") == "consulting", 0)
            .when((typ == "prebooked") | starts_pb("token_number"), 1)
            .when(typ == "review", 2).otherwise(3))


def tier_status() -> Column:
    """F11(c): consulting 1, waiting 2, completed 3, cancelled 4, else 5."""
    return (F.when(F.col("status") == "consulting", 1).when(F.col("status") == "waiting", 2)
            .when(F.col("status") == "completed", 3).when(F.col("status") == "cancelled", 4)
            .otherwise(5))


def checkin_tag(checked_in: bool) -> Column:
    """the check-in tag literal."""
    return F.lit("checked_in" if checked_in else "not_checked_in")


def is_you(token: str, viewer: str) -> Column:
    """case-insensitive match of a listed token with the viewer's token."""
    return upper_key(token) == upper_key(viewer)
