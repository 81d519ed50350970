"""Queue snapshots (§2.5 W*, §2.6 L*, §2.7 U1/U2).

The reference computes one queue for one doctor (or test) for today, by
pulling the ordered rows into PHP and counting.  Here every queue of every
day is computed at once: branches are unioned (UNION ALL, duplicates kept),
not-arrived bookings are found with a left-anti join on (booking id, day),
and positions come from ``number_rows`` partitioned by the queue key with
``queue_date`` first.  Nothing is collected.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardline.functions.columns import (LAB_ACTIVE, OPD_ACTIVE, effective_type, starts_pb,
                                        upper_key)
from wardline.operators.ranking import number_rows

def booked_not_arrived(bookings: DataFrame, tokens: DataFrame, statuses=("booked",),
                       match_booking_id: bool = False) -> DataFrame:
    """Bookings in ``statuses`` with no live (non-cancelled) token on their day.

    The token matches by ``token_number`` (J8) and, with ``match_booking_id``,
    also by ``booking_id`` (J9).  The OR key is exploded into one key column
    so the anti join stays an equi join (no nested loop).
    """
    live = tokens.where(F.col("status") != "cancelled")
    keys = live.select(F.col("queue_date").alias("_d"), upper_key("token_number").alias("_k"))
    if match_booking_id:
        keys = keys.unionByName(
            live.where(F.col("booking_id").isNotNull())
                .select(F.col("queue_date").alias("_d"), upper_key("booking_id").alias("_k")))
    b = bookings.where(F.col("status").isin(*statuses))
    return b.join(keys, (F.col("appointment_date") == F.col("_d"))
                  & (upper_key("booking_id") == F.col("_k")), "left_anti")


def live_queue_rows(tokens: DataFrame, bookings: DataFrame, variant: str = "endpoint") -> DataFrame:
    """The three-branch union behind the live queue (U1), before ordering.

    ``variant='endpoint'``: the patient/staff endpoint; ``'script'``: the
    hand-run SQL script, whose walk-in branch only excludes PB numbers.
    """
    active = tokens.where(F.col("status").isin(*OPD_ACTIVE))
    pb_num = starts_pb("token_number")
    if variant == "endpoint":
        eff = effective_type()
        first = active.where((F.col("token_type") == "prebooked") | (F.col("type") == "prebooked") | pb_num)
        first = first.select(
            "id", "token_number", "patient_name", eff.alias("token_type"), "status", "doctor_id",
            "queue_date", F.coalesce("expected_sod", "created_sod").alias("appointment_sod"),
            "created_at", F.lit("checked_in").alias("checkin_status"), F.lit(1).alias("branch"))
        second = active.where((eff != "prebooked") & ~pb_num)
        second = second.select(
            "id", "token_number", "patient_name", eff.alias("token_type"), "status", "doctor_id",
            "queue_date", F.col("created_sod").alias("appointment_sod"), "created_at",
            F.lit("checked_in").alias("checkin_status"), F.lit(2).alias("branch"))
    else:
        first = active.where((F.col("token_type") == "prebooked") | pb_num).select(
            "id", "token_number", "patient_name", F.lit("prebooked").alias("token_type"), "status",
            "doctor_id", "queue_date",
            F.coalesce("expected_sod", "created_sod").alias("appointment_sod"), "created_at",
            F.lit("checked_in").alias("checkin_status"), F.lit(1).alias("branch"))
        second = active.where(~pb_num).select(
            "id", "token_number", "patient_name",
            F.coalesce("token_type", F.lit("walkin")).alias("token_type"), "status", "doctor_id",
            "queue_date", F.col("created_sod").alias("appointment_sod"), "created_at",
            F.lit("checked_in").alias("checkin_status"), F.lit(2).alias("branch"))
    waiting = booked_not_arrived(bookings, tokens).select(
        "id", F.col("booking_id").alias("token_number"), "patient_name",
        F.lit("prebooked").alias("token_type"), F.lit("waiting").alias("status"), "doctor_id",
        F.col("appointment_date").alias("queue_date"), "appointment_sod",
        F.lit(None).cast("timestamp_ntz").alias("created_at"),
        F.lit("not_checked_in").alias("checkin_status"), F.lit(3).alias("branch"))
    return first.unionByName(second).unionByName(waiting)


def live_queue(tokens: DataFrame, bookings: DataFrame, scope: str = "doctor",
               variant: str = "endpoint") -> DataFrame:
    """Ordered live queue with position, people ahead and total.

    ``scope='doctor'`` numbers per (queue_date, doctor_id) as the staff board
    does; ``scope='day'`` numbers the whole day (the patient page sends no
    doctor).  Order: consulting first, pre-booked before others, queue time,
    created_at (not-arrived bookings have none and sort first), then the
    branch and id so equal keys get a fixed order.
    """
    rows = live_queue_rows(tokens, bookings, variant)
    consult_first = F.when(F.col("status") == "consulting", 0).otherwise(1)
    pb_first = F.when((F.col("token_type") == "prebooked") | starts_pb("token_number"), 0).otherwise(1)
    rows = rows.withColumn("_t1", consult_first).withColumn("_t2", pb_first)
    order = ["_t1", "_t2", "appointment_sod"]
    if variant == "endpoint":
        order.append(F.col("created_at").asc_nulls_first())
    order += ["branch", "id"]
    group = ["queue_date", "doctor_id"] if scope == "doctor" else ["queue_date"]
    ranked = number_rows(rows, group, order, "position", count_name="total_in_queue")
    return ranked.drop("_t1", "_t2").withColumn("people_ahead", F.col("position") - 1)


# Rows that one screen of the application shows.
WORKLIST_SHOWN = 20
ARRIVALS_SHOWN = 10
HEAD_SHOWN = 5


def queue_neighbourhood(queue: DataFrame, group: list[str], size: int = 5) -> DataFrame:
    """For every token in a queue, the ``size`` entries shown around it.

    The window starts at max(0, pos-3), is shifted back at the tail, and is
    the whole queue when it holds ``size`` or fewer.  A token number listed
    twice keeps its last position (the reference's loop overwrites).  The
    range join on position is rewritten as an equi join on an exploded
    sequence of at most ``size`` positions per token.
    """
    me = queue.groupBy(*group, F.upper("token_number").alias("viewer_token")).agg(
        F.max("position").alias("viewer_position"), F.max("total_in_queue").alias("_n"))
    start = F.greatest(F.lit(0), F.col("viewer_position") - 3)
    start = F.when(start + size > F.col("_n"), F.greatest(F.lit(0), F.col("_n") - size)).otherwise(start)
    me = me.withColumn("_start", start)
    me = me.withColumn("position", F.explode(F.sequence(
        F.col("_start") + 1, F.least(F.col("_start") + size, F.col("_n")))))
    shown = queue.select(*group, "position", "token_number", "status", "checkin_status",
                         "token_type")
    return me.join(shown, [*group, "position"]).select(
        *group, "viewer_token", "viewer_position", F.col("position").alias("shown_position"),
        F.col("token_number").alias("shown_token"), "status", "checkin_status", "token_type",
        (F.upper("token_number") == F.col("viewer_token")).alias("is_you"))


def lab_queue(lab_tokens: DataFrame, lab_bookings: DataFrame, lab_tests: DataFrame) -> DataFrame:
    """Lab tokens of the day plus booked, not-arrived lab bookings, per test.

    Order: in_progress first, scheduled time, created_at, then branch and id.
    """
    active = lab_tokens.where(F.col("token_status").isin(*LAB_ACTIVE)).select(
        F.col("token_id").alias("id"), "token_number", "patient_name", "patient_type",
        F.col("token_status").alias("status"), "test_id", F.col("scheduled_date").alias("queue_date"),
        "scheduled_sod", "created_at", F.lit("checked_in").alias("checkin_status"),
        F.lit(1).alias("branch"))
    arrived = lab_tokens.where((F.col("token_status") != "cancelled") & F.col("booking_id").isNotNull()) \
        .select(F.col("booking_id").alias("_b"), F.col("scheduled_date").alias("_d"))
    pending = lab_bookings.where(F.col("booking_status") == "booked").join(
        arrived, (F.col("booking_id") == F.col("_b")) & (F.col("appointment_date") == F.col("_d")),
        "left_anti").select(
        F.col("booking_id").alias("id"), F.col("booking_code").alias("token_number"), "patient_name",
        F.lit("prebooked").alias("patient_type"), F.col("booking_status").alias("status"), "test_id",
        F.col("appointment_date").alias("queue_date"), F.col("appointment_sod").alias("scheduled_sod"),
        "created_at", F.lit("not_checked_in").alias("checkin_status"), F.lit(2).alias("branch"))
    rows = active.unionByName(pending).withColumn(
        "_t1", F.when(F.col("status") == "in_progress", 0).otherwise(1))
    ranked = number_rows(rows, ["queue_date", "test_id"],
                         ["_t1", "scheduled_sod", "created_at", "branch", "id"],
                         "position", count_name="total_in_queue")
    names = lab_tests.select("test_id", "test_name")
    return ranked.drop("_t1").join(names, "test_id", "left") \
        .withColumn("people_ahead", F.col("position") - 1)


def doctor_worklist(tokens: DataFrame, limit: int | None = None) -> DataFrame:
    """Per (day, doctor) the active tokens (the first ``limit`` if given) in four tiers.

    Tiers: consulting, pre-booked (type or PB number), review, rest; then
    expected time (NULL first) and id.  The top-k is a per-group
    ``row_number <= k`` that Spark prunes inside the window.
    """
    t = tokens.where(F.col("status").isin(*OPD_ACTIVE))
    typ = F.coalesce("token_type", "type")
    tier = (F.when(F.col("status") == "consulting", 0)
            .when((typ == "prebooked") | starts_pb("token_number"), 1)
            .when(typ == "review", 2).otherwise(3))
    t = t.select("id", "token_number", "patient_name", effective_type().alias("type"), "status",
                 "expected_sod", "doctor_id", "department_id", "queue_date",
                 tier.alias("priority_order"),
                 F.when(F.col("status") == "consulting", 0).otherwise(1).alias("_c"))
    ranked = number_rows(t, ["queue_date", "doctor_id"],
                         ["_c", "priority_order", F.col("expected_sod").asc_nulls_first(), "id"],
                         "position")
    return (ranked if limit is None else ranked.where(F.col("position") <= limit)).drop("_c")


def expected_arrivals(bookings: DataFrame, tokens: DataFrame, limit: int | None = None) -> DataFrame:
    """Booked or confirmed bookings (the first ``limit`` if given) per (day, doctor)
    with no live token matching by number or booking id."""
    rows = booked_not_arrived(bookings, tokens, statuses=("booked", "confirmed"),
                              match_booking_id=True)
    rows = rows.select(F.col("id").alias("prebook_id"), F.col("booking_id").alias("token_number"),
                       "patient_name", "doctor_id", "department_id",
                       F.col("appointment_date").alias("queue_date"),
                       F.col("appointment_sod").alias("expected_sod"))
    ranked = number_rows(rows, ["queue_date", "doctor_id"], ["expected_sod", "prebook_id"], "position")
    return ranked if limit is None else ranked.where(F.col("position") <= limit)


def simple_queue(tokens: DataFrame) -> DataFrame:
    """The script's day queue -- consulting, pre-booked, review, rest, then created_at."""
    t = tokens.where(F.col("status").isin(*OPD_ACTIVE))
    tier = (F.when(F.col("status") == "consulting", 0)
            .when(F.col("token_type") == "prebooked", 1)
            .when(F.col("token_type") == "review", 2).otherwise(3))
    t = t.select("id", "token_number", "patient_name",
                 F.coalesce("token_type", F.lit("walkin")).alias("token_type"), "status",
                 "queue_date", "created_sod", "created_at", tier.alias("_tier"))
    return number_rows(t, ["queue_date"], ["_tier", "created_at", "id"], "position").drop("_tier")


def all_tokens(tokens: DataFrame) -> DataFrame:
    """Every token of a (day, doctor), any status, in the board order:
    consulting, waiting, completed, cancelled, other; expected time; id."""
    rank = (F.when(F.col("status") == "consulting", 1).when(F.col("status") == "waiting", 2)
            .when(F.col("status") == "completed", 3).when(F.col("status") == "cancelled", 4)
            .otherwise(5))
    t = tokens.select("id", "token_number", "patient_name", effective_type().alias("type"), "status",
                      "expected_sod", "doctor_id", "department_id", "queue_date", "created_sod",
                      rank.alias("_rank"))
    return number_rows(t, ["queue_date", "doctor_id"],
                       ["_rank", F.col("expected_sod").asc_nulls_first(), "id"],
                       "list_order", count_name="count").drop("_rank")
