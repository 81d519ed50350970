"""Request-shaped views: one day, optional doctor / department / test filters.

The registered queries compute every day at once.  A caller that serves one
screen ("today's queue of doctor 3 for token A012") uses these views: the
inputs are cut to the day first (``queue_date`` filters reach the Parquet
scan), then the same all-days operators run on that slice, so both paths
share one implementation.  Unset filters follow the application's
convention: 0 / '' / None mean "not set".
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardline.functions.predicates import apply_filters, on_day
from wardline.operators import directory, lookups, queues, stats


def live_queue_view(h, as_of, doctor_id: int = 0, current_token: str = "") -> dict[str, DataFrame]:
    """Queue of one day (one doctor when ``doctor_id`` > 0), the five rows
    shown around ``current_token`` (head of the queue when absent), and the
    summary (total, current position, people ahead)."""
    t = on_day(h.tokens, as_of)
    b = on_day(h.prebooked_appointments, as_of, "appointment_date")
    scope = "doctor" if doctor_id else "day"
    q = queues.live_queue(t, b, scope=scope)
    q = apply_filters(q, doctor_id=doctor_id)
    key = F.upper(F.trim(F.lit(current_token or "")))
    summary = q.agg(F.count(F.lit(1)).alias("total_in_queue"),
                    F.max(F.when(F.upper("token_number") == key, F.col("position"))).alias("_pos")) \
        .select("total_in_queue", F.coalesce("_pos", F.lit(0)).alias("current_position"),
                F.greatest(F.coalesce("_pos", F.lit(0)) - 1, F.lit(0)).alias("people_ahead"))
    if current_token:
        group = ["queue_date"] + (["doctor_id"] if doctor_id else [])
        around = queues.queue_neighbourhood(q, group).where(F.col("viewer_token") == key)
        # a viewer who is not listed sees the head of the queue
        head = q.where(F.col("position") <= queues.HEAD_SHOWN).select(
            *group, key.alias("viewer_token"), F.lit(0).cast("long").alias("viewer_position"),
            F.col("position").alias("shown_position"), F.col("token_number").alias("shown_token"), "status",
            "checkin_status", "token_type", F.lit(False).alias("is_you"))
        listed = summary.where("current_position > 0").select(F.lit(1).alias("_listed"))
        head = head.withColumn("_listed", F.lit(1)).join(listed, "_listed", "left_anti").drop("_listed")
        shown = around.unionByName(head)
    else:
        shown = q.where(F.col("position") <= queues.HEAD_SHOWN)
    return {"queue": q, "shown": shown, "summary": summary}


def lab_queue_view(h, as_of, test_code: str, current_token: str = "") -> DataFrame:
    """One test's lab queue of one day with the viewer flag."""
    tests = h.lab_tests.where(F.col("test_code") == F.upper(F.trim(F.lit(test_code))))
    q = queues.lab_queue(on_day(h.lab_tokens, as_of, "scheduled_date"),
                         on_day(h.prebooked_lab_appointments, as_of, "appointment_date"), tests)
    q = q.join(tests.select("test_id"), "test_id")
    return q.withColumn("is_you", F.upper("token_number") == F.upper(F.trim(F.lit(current_token or ""))))


def doctor_queue_view(h, as_of, doctor_id: int = 0, department_id: int = 0,
                      include_not_arrived: bool = True) -> dict[str, DataFrame]:
    """Staff worklist (first 20) and expected arrivals (first 10)."""
    t = apply_filters(on_day(h.tokens, as_of), doctor_id=doctor_id, department_id=department_id)
    out = {"worklist": queues.doctor_worklist(t, queues.WORKLIST_SHOWN)}
    if include_not_arrived:
        b = apply_filters(on_day(h.prebooked_appointments, as_of, "appointment_date"), doctor_id=doctor_id)
        out["expected"] = queues.expected_arrivals(b, on_day(h.tokens, as_of), queues.ARRIVALS_SHOWN)
    return out


def day_tokens_view(h, as_of, doctor_id: int = 0) -> DataFrame:
    """Every token of a day (any status) in board order."""
    return queues.all_tokens(apply_filters(on_day(h.tokens, as_of), doctor_id=doctor_id))


def opd_queue_view(h, as_of, department_id: int = 0, doctor_id: int = 0,
                   status: str = "") -> dict[str, DataFrame]:
    """Enriched tokens of a day with the status counters and current token."""
    t = apply_filters(on_day(h.tokens, as_of), department_id=department_id, doctor_id=doctor_id,
                      status=status)
    return {"queue": directory.tokens_enriched(t, h.doctors, h.departments),
            "stats": stats.status_counts(t, ["queue_date"], ["waiting", "consulting", "completed"]),
            "current": stats.current_tokens(on_day(h.tokens, as_of), on_day(h.pharmacy_tokens, as_of), h.doctors,
                                             h.departments)
            .where(F.col("scope") == "day")}


def doctor_list_view(h, as_of, department_id: int = 0, department: str = "") -> DataFrame:
    """Doctors (optionally of one department, by id or name) with today's wait."""
    d = h.doctors
    if department_id:
        d = d.where(F.col("department_id") == department_id)
    elif department:
        dep = h.departments.where(F.col("name") == department).select(F.col("id").alias("department_id"))
        d = d.join(dep, "department_id")
    return stats.doctor_wait(d, h.tokens, as_of=as_of)


def pharmacy_queue_view(h, as_of, pharmacy_id: int = 0, status: str = "") -> dict[str, DataFrame]:
    """A pharmacy's queue of one day with counters."""
    t = apply_filters(on_day(h.pharmacy_tokens, as_of), pharmacy_id=pharmacy_id, status=status)
    return {"queue": directory.pharmacy_queue(t, h.pharmacies),
            "stats": stats.status_counts(t, ["queue_date"],
                                         ["waiting", "processing", "completed", "cancelled"])}


def status_poll(h, as_of, token: str = "", booking_id: str = "") -> DataFrame:
    """One status poll (three-step fallback) as a one-row request table."""
    spark = h.spark
    req = spark.createDataFrame([(0, as_of, token, booking_id)],
                                "req_id long, d date, token string, booking string")
    return lookups.token_status(req, h.tokens, h.prebooked_appointments, h.doctors, h.departments)


def live_queue_response(h, as_of, doctor_id: int = 0, current_token: str = "") -> DataFrame:
    """The live-queue screen as one JSON document, shaped like the
    application's response: ``{success, queue[<=5], total_in_queue,
    current_position, people_ahead}``.  Built from ``live_queue_view``; the
    array holds at most five rows (a bounded ``collect_list``)."""
    v = live_queue_view(h, as_of, doctor_id, current_token)
    shown = v["shown"]
    if current_token:
        shown = shown.select(F.col("shown_position").alias("position"),
                             F.col("shown_token").alias("token_number"), "token_type", "status",
                             "checkin_status", "is_you")
    else:
        shown = shown.select("position", "token_number", "token_type", "status", "checkin_status",
                             F.lit(False).alias("is_you"))
    item = F.struct("position", "token_number", "token_type", "status", "checkin_status", "is_you")
    items = shown.agg(F.sort_array(F.collect_list(F.struct(F.col("position").alias("_o"),
                                                          item.alias("_v")))).alias("_items"),
                      F.lit(1).alias("_k"))
    summary = v["summary"].withColumn("_k", F.lit(1))
    doc = summary.join(items, "_k", "left")  # two one-row frames on a constant key
    return doc.select(F.to_json(F.struct(
        F.lit(True).alias("success"),
        F.coalesce(F.transform("_items", lambda x: x["_v"]), F.array()).alias("queue"),
        "total_in_queue", "current_position", "people_ahead")).alias("response"))
