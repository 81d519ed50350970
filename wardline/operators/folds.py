"""Write endpoints as folds over request logs (§2.10 T1-T13).

The reference mutates rows one request at a time.  Each fold here takes a
whole log plus the tables and returns the resulting changes.  The rules are
written so they need only per-key aggregates (last request per token, last
consulting request per department and day, first accepted request per
booking) and equi joins -- no per-row Python, no ordering of the whole log.
Request order is (ts, req_id) everywhere.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardline.functions.columns import (LAB_ACTIVE, OPD_MINUTES_PER_PATIENT,
                                        PHARMACY_MINUTES_PER_PATIENT, hms, seq3, sod, upper_key,
                                        wrap_sod)
from wardline.operators.admission import refusal_text
from wardline.operators.numbering import department_initial, depth_at_arrival
from wardline.operators.ranking import lag_within, number_rows
from wardline.operators.requests import ENUMS, reschedule_checks
from wardline.session import ensure_checkpoint_dir

# Fixed texts of the application.
CANCEL_DEFAULT_REASON = "due to being late"
CANCEL_MESSAGE = "Your token has been cancelled {reason}. Please contact reception."
PHARMACY_CANCEL_DEFAULT = "Cancelled by patient"
MSG_INVALID_DEPARTMENT = "Invalid department"
MSG_LAB_MISSING = "Missing required fields: test_code, patient_name, patient_age, patient_phone"
MSG_LAB_TEST = "Invalid test code or test not available"
MSG_PHARMACY_INVALID = "Invalid pharmacy selected"
MSG_PHARMACY_NAME = "Patient name is required"
MSG_PHARMACY_INACTIVE = "Selected pharmacy not found or inactive"
MSG_NOT_FOUND = "Token not found"
MSG_ALREADY_CANCELLED = "Token is already cancelled"
MSG_COMPLETED = "Cannot cancel a completed token"
MSG_ID_REQUIRED = "Token number or ID is required"
MSG_BOOKING_REQUIRED = "Booking ID is required"
MSG_BOOKING_CANCELLED = "Booking cancelled successfully"
MSG_BOOKING_NOT_CHANGED = "Booking cancelled"
MSG_LAB_CANCELLED = "Lab booking cancelled successfully"
MSG_LAB_NOT_FOUND = "Booking not found or already cancelled"


def _order(prefix: str = "") -> F.Column:
    return F.struct(F.col(f"{prefix}ts").alias("ts"), F.col(f"{prefix}req_id").alias("req_id"))


# -- T5 -----------------------------------------------------------------------------
def opd_status_fold(tokens: DataFrame, status_log: DataFrame, until_day_end: bool = False) -> DataFrame:
    """T5: final OPD status after a log of OPD status requests.

    A request for an unknown token or with an invalid status does nothing.
    Setting ``consulting`` first completes every consulting token of the
    target's department created on the request day.  Hence a token ends as
    its last own request (or its snapshot status), except that a token left
    consulting is completed when a later consulting request exists for its
    department on its own day.  ``until_day_end`` keeps only requests made
    up to the token's own day (the status when its day closed).
    """
    t = tokens.select("id", "department_id", "queue_date", "status")
    r = status_log.where(F.col("new_status").isin(*ENUMS["opd_status"])).join(
        t.select(F.col("id").alias("token_id"), "department_id", F.col("queue_date").alias("_td")),
        "token_id")
    mine = r.where(F.col("d") <= F.col("_td")) if until_day_end else r
    own = mine.groupBy("token_id").agg(F.max_by(F.struct(_order().alias("o"), "new_status"),
                                             _order()).alias("own"))
    last_consult = r.where(F.col("new_status") == "consulting").groupBy(
        "department_id", F.col("d").alias("queue_date")).agg(F.max(_order()).alias("c_last"))
    j = t.join(own, t.id == own.token_id, "left").join(last_consult, ["department_id", "queue_date"], "left")
    eff = F.coalesce(F.col("own.new_status"), F.col("status"))
    displaced = (eff == "consulting") & F.col("c_last").isNotNull() & (
        F.col("own").isNull() | (F.col("c_last") > F.col("own.o")))
    final = F.when(displaced, F.lit("completed")).otherwise(eff)
    return j.select("id", "queue_date", "department_id", F.col("status").alias("old_status"),
                    final.alias("new_status"), (final != F.col("status")).alias("changed"))


# -- T6 / T13 -----------------------------------------------------------------------
def _cancel_requests(cancel_log: DataFrame) -> DataFrame:
    T = upper_key("token")
    B = F.coalesce(upper_key("booking_id"), T)
    return cancel_log.select(
        "req_id", "ts", "d", F.coalesce(F.col("token_id"), F.lit(0)).alias("token_id"),
        T.alias("T"), B.alias("B"),
        F.coalesce(F.trim("reason"), F.lit(CANCEL_DEFAULT_REASON)).alias("reason"),
        F.coalesce(F.col("notify"), F.lit(True)).alias("notify"),
        ((T == "") & (F.coalesce(F.col("token_id"), F.lit(0)) == 0)).alias("rejected"))


def cancel_tokens(tokens: DataFrame, bookings: DataFrame, cancel_log: DataFrame) -> DataFrame:
    """Tokens and bookings cancelled by a log of OPD cancel requests.

    By id: that token, any day.  Otherwise tokens of the request day whose
    number equals the token text or whose booking id equals the booking text
    (J14: two equi joins).  A PB booking text (and a differing PB token text)
    also cancels the booking.  No status guard.  Each target is reported
    once, with the first request that hit it.
    """
    r = _cancel_requests(cancel_log).where(~F.col("rejected"))
    t = tokens.select("id", "token_number", "booking_id", "queue_date", "status")
    # the first request of an id, or of a text and day, decides: one row per key meets the tokens
    def first_by(rows: DataFrame, *keys: str) -> DataFrame:
        return rows.groupBy(*keys).agg(F.min(_order()).alias("first"))

    by_id = first_by(r.where(F.col("token_id") > 0), "token_id").join(t, F.col("token_id") == F.col("id"))
    rn = r.where(F.col("token_id") <= 0)
    num, bid = first_by(rn, "T", "d"), first_by(rn, "B", "d")
    by_num = num.join(t, (num.T == upper_key(t.token_number)) & (num.d == t.queue_date))
    by_bid = bid.join(t, (bid.B == upper_key(t.booking_id)) & (bid.d == t.queue_date))
    hits = by_id.select("first", "id").unionByName(by_num.select("first", "id")).unionByName(
        by_bid.select("first", "id"))
    tok = hits.groupBy("id").agg(F.min("first").alias("first")).join(t, "id").select(
        F.lit("token").alias("target"), F.col("id").cast("string").alias("target_key"),
        "queue_date", F.col("status").alias("old_status"), F.col("first.req_id").alias("req_id"))
    pb_keys = r.where(F.col("B").startswith("PB")).select("req_id", "ts", F.col("B").alias("_k")) \
        .unionByName(r.where((F.col("T") != F.col("B")) & F.col("T").startswith("PB"))
                     .select("req_id", "ts", F.col("T").alias("_k")))
    pb_keys = first_by(pb_keys, "_k")
    b = bookings.select(upper_key("booking_id").alias("_k"), "booking_id", "appointment_date", "status")
    bk = pb_keys.join(b, "_k").select(
        F.lit("booking").alias("target"), F.col("booking_id").alias("target_key"),
        F.col("appointment_date").alias("queue_date"), F.col("status").alias("old_status"),
        F.col("first.req_id").alias("req_id"))
    return tok.unionByName(bk).withColumn("new_status", F.lit("cancelled"))


MSG_CANCEL_REQUIRED = "Token number or ID is required"
MSG_CANCELLED = "Token cancelled successfully"


def cancel_answers(tokens: DataFrame, bookings: DataFrame, cancel_log: DataFrame) -> DataFrame:
    """The answer to every OPD cancel request, with how many tokens and bookings it names.

    The endpoint reports success also when nothing matched; only a request without number and id is refused.
    A request by id names at most one token, one by text those of its day whose number or booking id it is.
    Tokens are counted per text and day before they meet the requests.
    """
    r = _cancel_requests(cancel_log)
    t = tokens.select(F.col("id").cast("long").alias("id"), upper_key("token_number").alias("N"),
                      upper_key("booking_id").alias("K"), F.col("queue_date").alias("d"))
    by_num = t.groupBy(F.col("N").alias("T"), "d").agg(F.count(F.lit(1)).alias("_num"))
    by_bid = t.where(F.col("K").isNotNull()).groupBy(F.col("K").alias("B"), "d").agg(F.count(F.lit(1)).alias("_bid"))
    both = t.where(F.col("K").isNotNull()).groupBy(F.col("N").alias("T"), F.col("K").alias("B"), "d").agg(
        F.count(F.lit(1)).alias("_both"))
    r = r.join(t.select(F.col("id").alias("token_id"), F.lit(1).alias("_id")), "token_id", "left")
    r = r.join(by_num, ["T", "d"], "left").join(by_bid, ["B", "d"], "left").join(both, ["T", "B", "d"], "left")
    b = bookings.groupBy(upper_key("booking_id").alias("B")).agg(F.count(F.lit(1)).alias("_n"))
    r = r.join(b.withColumnRenamed("_n", "_booked"), "B", "left").join(
        b.select(F.col("B").alias("T"), F.col("_n").alias("_other")), "T", "left")
    zero = F.lit(0).cast("long")
    named = F.when(F.col("token_id") > 0, F.coalesce(F.col("_id").cast("long"), zero)).otherwise(
        F.coalesce("_num", zero) + F.coalesce("_bid", zero) - F.coalesce("_both", zero))
    booked = F.when(F.col("B").startswith("PB"), F.coalesce("_booked", zero)).otherwise(zero) + F.when(
        (F.col("T") != F.col("B")) & F.col("T").startswith("PB"), F.coalesce("_other", zero)).otherwise(zero)
    ok = ~F.col("rejected")
    return r.select("req_id", ok.alias("success"),
                    F.when(ok, F.lit(MSG_CANCELLED)).otherwise(F.lit(MSG_CANCEL_REQUIRED)).alias("message"),
                    F.when(ok, F.col("notify")).alias("notified"), F.when(ok, F.col("reason")).alias("reason"),
                    F.when(ok, named).alias("tokens_named"), F.when(ok, booked).alias("bookings_named"))


def cancel_notifications(cancel_log: DataFrame) -> DataFrame:
    """One pending notification row per accepted cancel request with notify on."""
    r = _cancel_requests(cancel_log).where(~F.col("rejected") & F.col("notify"))
    head, tail = CANCEL_MESSAGE.split("{reason}")
    return r.select("req_id", F.col("T").alias("token_number"), F.col("B").alias("booking_id"),
                    F.lit("cancelled").alias("notification_type"),
                    F.concat(F.lit(head), F.col("reason"), F.lit(tail)).alias("message"),
                    F.lit("pending").alias("delivery_status"))


# -- T7 -----------------------------------------------------------------------------
def _keyed_requests(log: DataFrame, col: str) -> DataFrame:
    """Requests with their booking text as the application reads it; '' when it counts as missing."""
    text = upper_key(col)
    return log.select("req_id", "ts", F.when(F.coalesce(text, F.lit("")).isin("", "0"), F.lit(""))
                      .otherwise(text).alias("B"))


def _first_per(requests: DataFrame, key: str) -> DataFrame:
    """The first request of each key: later ones find the change made."""
    return requests.groupBy(key).agg(F.min(_order()).alias("first"))


def cancel_bookings(bookings: DataFrame, log: DataFrame) -> DataFrame:
    """The answer to every booking cancel request.

    A request with an id always succeeds; its message tells whether the
    booking changed (it exists, was not cancelled, and no earlier request
    cancelled it).  Only a request without an id fails.
    """
    r = _keyed_requests(log, "booking_id")
    # the first request of an id decides, so only one row per id meets the bookings
    first = _first_per(r.where(F.col("B") != ""), "B")
    b = bookings.select(upper_key("booking_id").alias("B"), "status")
    changing = first.join(b, "B").where(F.col("status") != "cancelled").select(
        F.col("first.req_id").alias("req_id")).distinct().withColumn("_changed", F.lit(True))
    x = r.join(changing, "req_id", "left")
    changed = F.coalesce(F.col("_changed"), F.lit(False))
    given = F.col("B") != ""
    return x.select("req_id", F.col("B").alias("booking_id"), given.alias("success"), changed.alias("changed"),
                    F.when(~given, F.lit(MSG_BOOKING_REQUIRED)).when(changed, F.lit(MSG_BOOKING_CANCELLED))
                    .otherwise(F.lit(MSG_BOOKING_NOT_CHANGED)).alias("message"))


def cancel_booking_targets(tokens: DataFrame, bookings: DataFrame, log: DataFrame) -> DataFrame:
    """The bookings and the tokens of any day (by booking id or number) that a
    log of booking cancel requests sets to cancelled, with the first request of each."""
    first = _first_per(_keyed_requests(log, "booking_id").where(F.col("B") != ""), "B")
    b = bookings.select(upper_key("booking_id").alias("B"), "booking_id", "status")
    booking_rows = first.join(b, "B").select(
        F.lit("booking").alias("target"), F.col("booking_id").alias("target_key"),
        F.col("status").alias("old_status"), F.col("first.req_id").alias("req_id"))
    t = tokens.select("id", "token_number", "booking_id", "status")
    hits = first.join(t, F.col("B") == upper_key("booking_id")).select("first", "id") \
        .unionByName(first.join(t, F.col("B") == upper_key("token_number")).select("first", "id"))
    tok = hits.groupBy("id").agg(F.min("first").alias("first")).join(t, "id").select(
        F.lit("token").alias("target"), F.col("id").cast("string").alias("target_key"),
        F.col("status").alias("old_status"), F.col("first.req_id").alias("req_id"))
    return booking_rows.unionByName(tok).withColumn("new_status", F.lit("cancelled"))


# -- T8 -----------------------------------------------------------------------------
def reschedule(bookings: DataFrame, log: DataFrame, tokens: DataFrame) -> DataFrame:
    """Reschedule requests applied in order per booking.

    Checks (F7) reject a request before any change.  An accepted request
    sets the date (and the time when given); it reports the values before
    it, and "no changes" when nothing differed (MySQL counts only changed
    rows).  Per booking the state after request k is the last accepted date
    and the last accepted non-empty time up to k, found with windows over the
    booking's own requests.  ``token_time_updated``: a time was given and a
    token has the booking (``reschedule_tokens`` gives these tokens).
    """
    chk = reschedule_checks(log)
    b = bookings.select(upper_key("booking_id").alias("booking_id"), F.col("appointment_date").alias("d0"),
                        F.col("appointment_sod").alias("t0"))
    with_token = tokens.select(upper_key("booking_id").alias("booking_id")).distinct().withColumn(
        "_has_token", F.lit(True))
    x = chk.join(b, "booking_id", "left").join(with_token, "booking_id", "left")
    found = F.col("d0").isNotNull()
    ok = F.col("accepted") & found
    x = x.withColumn("_ok", ok).withColumn(
        "_new_d", F.when(ok, F.try_to_date("new_date"))).withColumn(
        "_new_t", F.when(ok & (F.col("new_time") != ""),
                         (F.substring("new_time", 1, 2).cast("int") * 3600
                          + F.substring("new_time", 4, 2).cast("int") * 60
                          + F.substring("new_time", 7, 2).cast("int"))))
    # Last accepted date / time before each request of the booking (skew-safe scan).
    x = lag_within(x, ["booking_id"], ["ts", "req_id"], "_new_d", "_prev_d", ignore_nulls=True)
    x = lag_within(x, ["booking_id"], ["ts", "req_id"], "_new_t", "_prev_t", ignore_nulls=True)
    x = x.withColumn("old_date", F.coalesce(F.col("_prev_d"), F.col("d0")))
    x = x.withColumn("old_sod", F.coalesce(F.col("_prev_t"), F.col("t0")))
    new_d = F.coalesce(F.col("_new_d"), F.col("old_date"))
    new_t = F.coalesce(F.col("_new_t"), F.col("old_sod"))
    changed = (new_d != F.col("old_date")) | (new_t != F.col("old_sod"))
    result = (F.when(~F.col("accepted"), F.col("reason"))
              .when(~found, F.lit("Booking ID not found"))
              .when(changed, F.lit("Appointment rescheduled successfully"))
              .otherwise(F.lit("No changes made to the appointment")))
    return x.select("req_id", "booking_id", F.col("_ok").alias("applied"),
                    (F.col("_ok") & changed).alias("success"), result.alias("message"),
                    F.when(F.col("_ok"), F.col("old_date")).alias("old_date"),
                    F.when(F.col("_ok"), hms("old_sod")).alias("old_time"),
                    F.when(F.col("_ok"), new_d).alias("new_date"),
                    F.when(F.col("_ok"), hms(new_t)).alias("new_time"),
                    F.coalesce(F.col("_ok") & (F.col("new_time") != "") & F.col("_has_token"), F.lit(False))
                    .alias("token_time_updated"))


def reschedule_tokens(bookings: DataFrame, log: DataFrame, tokens: DataFrame) -> DataFrame:
    """T8, token side: tokens of a booking take the time of its last accepted request with a time."""
    known = bookings.select(upper_key("booking_id").alias("booking_id")).distinct()
    timed = reschedule_checks(log).where(F.col("accepted") & (F.col("new_time") != "")).join(known, "booking_id")
    last = timed.groupBy("booking_id").agg(F.max(F.struct("ts", "req_id", "new_time")).alias("last"))
    t = tokens.select("id", upper_key("booking_id").alias("booking_id"), F.col("expected_sod").alias("_old"))
    return t.join(last, "booking_id").select(
        F.col("id").alias("token_id"), "booking_id", F.col("last.req_id").alias("req_id"),
        hms("_old").alias("old_time"), F.col("last.new_time").alias("new_time"))


# -- T9 -----------------------------------------------------------------------------
def _lab_hits(lab_bookings: DataFrame, log: DataFrame) -> DataFrame:
    """The first request of each code whose booking can be cancelled."""
    b = lab_bookings.where(F.col("booking_status").isin("booked", "checked_in")).select(
        upper_key("booking_code").alias("B"), "booking_status")
    return _first_per(_keyed_requests(log, "booking_code").where(F.col("B") != ""), "B").join(b, "B")


def cancel_lab(lab_bookings: DataFrame, log: DataFrame) -> DataFrame:
    """The answer to every lab cancel request.  It succeeds when the booking is
    booked or checked in; a later request finds it cancelled."""
    r = _keyed_requests(log, "booking_code")
    hit = _lab_hits(lab_bookings, log).select(F.col("first.req_id").alias("req_id")).distinct().withColumn(
        "_hit", F.lit(True))
    x = r.join(hit, "req_id", "left")
    ok = F.coalesce(F.col("_hit"), F.lit(False))
    return x.select("req_id", F.col("B").alias("booking_code"), ok.alias("success"),
                    F.when(F.col("B") == "", F.lit(MSG_BOOKING_REQUIRED)).when(ok, F.lit(MSG_LAB_CANCELLED))
                    .otherwise(F.lit(MSG_LAB_NOT_FOUND)).alias("message"))


def cancel_lab_targets(lab_bookings: DataFrame, lab_tokens: DataFrame, log: DataFrame) -> DataFrame:
    """The cancelled bookings, and the active lab tokens numbered like them."""
    hits = _lab_hits(lab_bookings, log)
    bk = hits.select(F.lit("booking").alias("target"), F.col("B").alias("target_key"),
                     F.col("booking_status").alias("old_status"), F.col("first.req_id").alias("req_id"))
    lt = lab_tokens.where(F.col("token_status").isin(*LAB_ACTIVE)).select(
        upper_key("token_number").alias("B"), "token_id", "token_status")
    tk = hits.join(lt, "B").select(F.lit("lab_token").alias("target"),
                                   F.col("token_id").cast("string").alias("target_key"),
                                   F.col("token_status").alias("old_status"), F.col("first.req_id").alias("req_id"))
    return bk.unionByName(tk).withColumn("new_status", F.lit("cancelled"))


# -- T10 / T11 ----------------------------------------------------------------------
def cancel_pharmacy(pharmacy_tokens: DataFrame, log: DataFrame) -> DataFrame:
    """Pharmacy cancel requests, each accepted or refused with the reason.

    The token is found by id, or by number on the request day (lowest id).
    Refused when already cancelled or completed; the first accepted request
    cancels it, so every later request for it is refused as cancelled.
    """
    r = log.select("req_id", "ts", "d", F.coalesce("token_id", F.lit(0)).alias("token_id"),
                   upper_key("token_number").alias("T"),
                   F.coalesce(F.trim("reason"), F.lit(PHARMACY_CANCEL_DEFAULT)).alias("reason"))
    t = pharmacy_tokens.select("id", "token_number", "queue_date", "status")
    by_id = r.where(F.col("token_id") > 0).join(t, r.token_id == t.id, "left").select(
        "req_id", F.col("id").alias("target_id"))
    rn = r.where((F.col("token_id") <= 0) & (F.col("T") != ""))
    # the lowest id of a number and day is found once, not for every request
    lowest = t.groupBy(upper_key("token_number").alias("T"), F.col("queue_date").alias("d")).agg(
        F.min("id").alias("target_id"))
    by_num = rn.join(lowest, ["T", "d"], "left").select("req_id", "target_id")
    target = by_id.unionByName(by_num)
    x = r.join(target, "req_id", "left").join(t.select(F.col("id").alias("target_id"), "status"),
                                              "target_id", "left")
    snap_ok = F.col("status").isNotNull() & ~F.col("status").isin("cancelled", "completed")
    first_ok = x.where(snap_ok).groupBy("target_id").agg(F.min(_order()).alias("_first"))
    x = x.join(first_ok, "target_id", "left")
    is_first = snap_ok & (_order() == F.col("_first"))
    msg = (F.when((F.col("T") == "") & (F.col("token_id") == 0), F.lit(MSG_ID_REQUIRED))
           .when(F.col("status").isNull(), F.lit(MSG_NOT_FOUND))
           .when(F.col("status") == "completed", F.lit(MSG_COMPLETED))
           .when(is_first, F.lit(None).cast("string"))
           .otherwise(F.lit(MSG_ALREADY_CANCELLED)))
    return x.select("req_id", "target_id", F.col("status").alias("snapshot_status"),
                    msg.isNull().alias("accepted"), msg.alias("refusal"),
                    F.when(msg.isNull(), F.col("reason")).alias("cancellation_reason"))


def pharmacy_status_fold(pharmacy_tokens: DataFrame, log: DataFrame) -> DataFrame:
    """Pharmacy status requests: validated (positive id, known
    status, existing token), each reporting old and new status; the old
    status of a request is the new status of the previous valid one."""
    t = pharmacy_tokens.select(F.col("id").alias("token_id"), F.col("status").alias("snap"),
                               "token_number")
    r = log.select("req_id", "ts", "token_id", F.trim("new_status").alias("new_status"))
    x = r.join(t, "token_id", "left")
    valid_status = F.col("new_status").isin(*ENUMS["pharmacy_status"])
    reason = (F.when(F.col("token_id") <= 0, F.lit("Invalid token ID"))
              .when(~valid_status, F.concat(F.lit("Invalid status. Must be: "),
                                            F.lit(", ".join(ENUMS["pharmacy_status"]))))
              .when(F.col("snap").isNull(), F.lit(MSG_NOT_FOUND)))
    x = x.withColumn("reason", reason)
    ok = x.where(F.col("reason").isNull())
    ok = lag_within(ok, ["token_id"], ["ts", "req_id"], "new_status", "_prev_status")
    ok = ok.withColumn("old_status", F.coalesce(F.col("_prev_status"), F.col("snap")))
    bad = x.where(F.col("reason").isNotNull()).withColumn("old_status", F.lit(None).cast("string"))
    cols = ["req_id", "token_id", "token_number", "old_status", "new_status", "reason"]
    out = ok.select(*cols).unionByName(bad.select(*cols))
    return out.withColumn("accepted", F.col("reason").isNull())


# -- T12 ----------------------------------------------------------------------------
def break_state(break_log: DataFrame) -> DataFrame:
    """Doctor break row per (doctor, day) after break requests.

    A start upserts the row (start time, on_break, end cleared); an end
    before any start that day does nothing; later ends move break_end.  So:
    start = last start; end = last end if it came after it; one aggregate.
    Doctor-days without a start have no row (``break_state_on`` adds the
    default ones of a day).
    """
    r = break_log.where(F.col("action").isin(*ENUMS["break_action"]) & (F.col("doctor_id") != 0))
    last = r.groupBy("doctor_id", F.col("d").alias("break_date")).agg(
        F.max(F.when(F.col("action") == "start_break", _order())).alias("s"),
        F.max(F.when(F.col("action") == "end_break", _order())).alias("e"))
    # No doctor check: the reference's break table has no foreign key.
    ended = F.coalesce(F.col("e") > F.col("s"), F.lit(False))
    return last.where(F.col("s").isNotNull()).select(
        "doctor_id", "break_date", F.col("s.ts").alias("break_start"), F.when(ended, F.col("e.ts")).alias("break_end"),
        F.when(ended, F.lit("available")).otherwise(F.lit("on_break")).alias("status"), (~ended).alias("is_on_break"))


def break_state_on(doctors: DataFrame, break_log: DataFrame, day) -> DataFrame:
    """T12 for one day: every doctor, 'available' without a break by default."""
    own = break_state(break_log.where(F.col("d") == F.lit(day).cast("date")))
    return doctors.select(F.col("id").alias("doctor_id")).join(own, "doctor_id", "left").select(
        "doctor_id", F.lit(day).cast("date").alias("break_date"), "break_start", "break_end",
        F.coalesce("status", F.lit("available")).alias("status"),
        F.coalesce("is_on_break", F.lit(False)).alias("is_on_break"))


# -- T1 / T2 / T3 -------------------------------------------------------------------
def _opd_requests(log: DataFrame, departments: DataFrame, doctors: DataFrame) -> DataFrame:
    """Walk-in requests with their department: by name (case-insensitive), else the doctor's."""
    dep = departments.select(F.upper(F.rtrim("name")).alias("_dn"), F.col("id").alias("_dep_by_name"))
    doc = doctors.select(F.col("id").alias("doctor_id"), F.col("department_id").alias("_dep_by_doc"))
    r = log.withColumn("_dn", F.upper(F.rtrim(F.coalesce("department", F.lit("")))))
    r = r.join(dep, "_dn", "left").join(doc, "doctor_id", "left")
    dept = F.coalesce(F.col("_dep_by_name"), F.when(F.col("doctor_id") > 0, F.col("_dep_by_doc")))
    return r.withColumn("department_id", dept).withColumn("valid", dept.isNotNull())


def _lab_requests(log: DataFrame, lab_tests: DataFrame) -> DataFrame:
    """Lab requests with their test and the reason against them, if any."""
    r = log.withColumn("_code", upper_key("test_code"))
    missing = ((F.col("_code") == "") | (F.trim("patient_name") == "") | (F.trim("patient_phone") == "")
               | (F.coalesce("patient_age", F.lit(0)) <= 0))
    tests = lab_tests.select(F.col("test_code").alias("_code"), "test_id", "fee", "slot_duration")
    r = r.join(tests, "_code", "left")
    reason = F.when(missing, F.lit(MSG_LAB_MISSING)).when(F.col("test_id").isNull(), F.lit(MSG_LAB_TEST))
    # a request with a reason is answered before the admission check
    return r.withColumn("reason", reason).withColumn("valid", reason.isNull())


def admission_asks(opd_log: DataFrame, lab_log: DataFrame, checkin_log: DataFrame, departments: DataFrame,
                   doctors: DataFrame, lab_tests: DataFrame, bookings: DataFrame) -> DataFrame:
    """All requests for a token, as ``admission.admit`` takes them.

    Lab requests with a reason against them and check-ins without a valid
    booking are answered before the admission check and are left out.
    """
    same = ["ts", "d", "patient_id"]
    opd = _opd_requests(opd_log, departments, doctors).select(
        F.col("req_id").alias("uid"), F.lit("opd").alias("kind"), *same, F.col("patient_phone").alias("phone"), "valid",
        F.lit(None).cast("string").alias("booking"))
    lab = _lab_requests(lab_log, lab_tests).where("valid").select(
        F.col("req_id").alias("uid"), F.lit("lab").alias("kind"), *same, F.col("patient_phone").alias("phone"), "valid",
        F.lit(None).cast("string").alias("booking"))
    visits = _checkin_requests(checkin_log, bookings, doctors).select(
        F.col("req_id").alias("uid"), F.lit("checkin").alias("kind"), *same, F.col("patient_phone").alias("phone"),
        F.lit(True).alias("valid"), F.col("B").alias("booking"))
    return opd.unionByName(lab).unionByName(visits)


def stored_tokens(tokens: DataFrame, lab_tokens: DataFrame) -> DataFrame:
    """OPD and lab tokens that are there before the log."""
    opd = tokens.select(F.lit(False).alias("lab"), F.col("id").cast("long").alias("token_id"),
                        F.col("queue_date").alias("d"), "patient_id", F.col("patient_phone").alias("phone"), "status")
    lab = lab_tokens.select(F.lit(True).alias("lab"), F.col("token_id").cast("long").alias("token_id"),
                            F.col("scheduled_date").alias("d"), "patient_id", F.col("patient_phone").alias("phone"),
                            F.col("token_status").alias("status"))
    return opd.unionByName(lab)


def token_changes(status_log: DataFrame, lab_status_log: DataFrame, issued_log: DataFrame) -> DataFrame:
    """Status changes of stored and issued tokens of both sorts."""
    def part(log: DataFrame, lab: bool, status: str) -> DataFrame:
        return log.select(F.lit(lab).alias("lab"), F.col("token_id").cast("long").alias("token_id"), "ts",
                          F.col("req_id").alias("id"), F.col(status).alias("status"))
    return (part(status_log, False, "new_status").unionByName(part(lab_status_log, True, "new_status"))
            .unionByName(part(issued_log, False, "new_status")).unionByName(part(issued_log, True, "lab_status")))


def issued_tokens(admissions: DataFrame, opd_log: DataFrame, lab_log: DataFrame, checkin_log: DataFrame,
                  departments: DataFrame, doctors: DataFrame, lab_tests: DataFrame, bookings: DataFrame,
                  tokens: DataFrame, lab_tokens: DataFrame, issued_base: int) -> DataFrame:
    """Every token that the logs issue, numbered behind the tokens stored for its day: kind, req_id, ts, d, token_id,
    group_id (department or test), token_number."""
    ok = admissions.where("admitted").select(F.col("uid").alias("req_id"), "kind")
    walkin = _opd_requests(opd_log, departments, doctors).where("valid").select(
        F.lit("opd").alias("kind"), "req_id", "ts", "d", F.col("department_id").alias("group_id"),
        department_initial(F.col("department")).alias("prefix"), F.lit(None).cast("string").alias("own"))
    visit = _checkin_requests(checkin_log, bookings, doctors).select(
        F.lit("checkin").alias("kind"), "req_id", "ts", "d", F.col("department_id").alias("group_id"),
        F.lit("").alias("prefix"), F.col("booking_id").alias("own"))
    lab = _lab_requests(lab_log, lab_tests).where("valid").select(
        F.lit("lab").alias("kind"), "req_id", "ts", "d", F.col("test_id").alias("group_id"),
        F.concat(F.col("_code"), F.lit("-")).alias("prefix"), F.lit(None).cast("string").alias("own"))
    new = walkin.unionByName(visit).unionByName(lab).join(ok, ["req_id", "kind"]).withColumn("_lab", F.col("kind") == "lab")
    day = tokens.select(F.lit(False).alias("_lab"), F.col("department_id").alias("group_id"), F.col("queue_date").alias("d"))
    day = day.unionByName(lab_tokens.select(F.lit(True).alias("_lab"), F.col("test_id").alias("group_id"),
                                            F.col("scheduled_date").alias("d")))
    before = day.groupBy("_lab", "group_id", "d").agg(F.count(F.lit(1)).alias("_before"))
    new = number_rows(new, ["_lab", "group_id", "d"], ["ts", "req_id"], "_n").join(before, ["_lab", "group_id", "d"], "left")
    number = F.col("_n") + F.coalesce("_before", F.lit(0))
    return new.select("kind", "req_id", "ts", "d", (F.lit(issued_base) + F.col("req_id")).alias("token_id"), "group_id",
                      F.coalesce("own", seq3(F.col("prefix"), number)).alias("token_number"))


def _answered(admissions: DataFrame, kind: str, issued: DataFrame, tokens: DataFrame, lab_tokens: DataFrame) -> DataFrame:
    """req_id, admitted, taken and the refusal's text for the requests of one kind."""
    numbers = issued.select((F.col("kind") == "lab").alias("_lab"), "token_id", "token_number").unionByName(
        tokens.select(F.lit(False).alias("_lab"), F.col("id").cast("long").alias("token_id"), "token_number")).unionByName(
        lab_tokens.select(F.lit(True).alias("_lab"), F.col("token_id").cast("long").alias("token_id"), "token_number"))
    numbers = numbers.select(F.when(F.col("_lab"), "lab").otherwise("opd").alias("blocker_kind"),
                             F.col("token_id").alias("blocker_token_id"), F.col("token_number").alias("_number"))
    x = admissions.where(F.col("kind") == kind).join(numbers, ["blocker_kind", "blocker_token_id"], "left")
    text = refusal_text(kind, F.col("by_account"), F.col("blocker_kind"), F.col("_number"), F.col("blocker_status"))
    return x.select(F.col("uid").alias("req_id"), "admitted", "taken", text.alias("_refusal"))


def issue_opd(opd_log: DataFrame, departments: DataFrame, doctors: DataFrame, admissions: DataFrame,
              issued: DataFrame, tokens: DataFrame, lab_tokens: DataFrame, status_log: DataFrame,
              issued_log: DataFrame) -> DataFrame:
    """Walk-in token issue over a request log.

    A patient with an active token of the day is refused first; then a request
    without a department.  Number = initial of the submitted department text
    ('T' when empty) + sequence of the (department, day), behind its stored
    tokens; ahead = waiting tokens of the department when issued, stored ones
    included; expected time = request time + 10 min per patient, modulo 24 h.
    """
    arrivals = issued.where("kind <> 'lab'").select("token_id", "ts", F.col("group_id").alias("department_id"), "d", "kind",
                                                    "req_id", "token_number")
    stored = tokens.select(F.col("id").cast("long").alias("token_id"), "department_id", F.col("queue_date").alias("d"), "status")
    updates = status_log.select("token_id", "ts", "req_id", "new_status").unionByName(
        issued_log.select("token_id", "ts", "req_id", "new_status"))
    ok = depth_at_arrival(arrivals, updates, ["department_id", "d"], ["waiting"], stored).where("kind = 'opd'")
    exp = wrap_sod(sod("ts") + F.col("patients_ahead") * (OPD_MINUTES_PER_PATIENT * 60))
    acc = ok.select("req_id", F.lit(True).alias("accepted"), F.lit(None).cast("string").alias("reason"),
                    "token_id", "token_number", "department_id", F.col("d").alias("queue_date"),
                    "patients_ahead", hms(exp).alias("expected_time"))
    r = _opd_requests(opd_log, departments, doctors)
    x = r.join(_answered(admissions, "opd", issued, tokens, lab_tokens), "req_id").where("not admitted")
    rej = x.select(
        "req_id", F.lit(False).alias("accepted"),
        F.coalesce(F.col("_refusal"), F.lit(MSG_INVALID_DEPARTMENT)).alias("reason"),
        F.lit(None).cast("bigint").alias("token_id"), F.lit(None).cast("string").alias("token_number"),
        F.lit(None).cast("int").alias("department_id"), F.col("d").alias("queue_date"),
        F.lit(None).cast("long").alias("patients_ahead"), F.lit(None).cast("string").alias("expected_time"))
    return acc.unionByName(rej)


def issue_lab(lab_log: DataFrame, lab_tests: DataFrame, admissions: DataFrame, issued: DataFrame, tokens: DataFrame,
              lab_tokens: DataFrame, lab_status_log: DataFrame, issued_log: DataFrame) -> DataFrame:
    """Lab token issue: required fields, gender normalised, active test by
    code, one active token per patient and day, number ``{code}-{nnn}`` per (test, day) behind its stored
    tokens, queue position = active tokens of the test + 1, wait = ahead x slot, fee when amount <= 0."""
    r = _lab_requests(lab_log, lab_tests)
    arrivals = issued.where("kind = 'lab'").select("token_id", "ts", F.col("group_id").alias("test_id"), "d", "req_id",
                                                   "token_number")
    arrivals = arrivals.join(r.select("req_id", "patient_gender", "payment_amount", "fee", "slot_duration"), "req_id")
    stored = lab_tokens.select(F.col("token_id").cast("long").alias("token_id"), "test_id",
                               F.col("scheduled_date").alias("d"), F.col("token_status").alias("status"))
    updates = lab_status_log.select("token_id", "ts", "req_id", "new_status").unionByName(
        issued_log.select("token_id", "ts", "req_id", F.col("lab_status").alias("new_status")))
    ok = depth_at_arrival(arrivals, updates, ["test_id", "d"], list(LAB_ACTIVE), stored)
    g = F.lower(F.trim("patient_gender"))
    acc = ok.select(
        "req_id", F.lit(True).alias("accepted"), F.lit(None).cast("string").alias("reason"), "token_id",
        "token_number", "test_id", F.col("d").alias("queue_date"),
        F.when(g.isin(*ENUMS["gender"]), g).otherwise(F.lit("other")).alias("patient_gender"),
        F.when(F.col("payment_amount") <= 0, F.col("fee")).otherwise(F.col("payment_amount"))
        .cast("double").alias("payment_amount"),
        (F.col("patients_ahead") + 1).alias("queue_position"),
        (F.col("patients_ahead") * F.col("slot_duration")).alias("wait_time"))
    x = r.join(_answered(admissions, "lab", issued, tokens, lab_tokens), "req_id", "left")
    rej = x.where(~F.coalesce("admitted", F.lit(False))).select(
        "req_id", F.lit(False).alias("accepted"), F.coalesce("reason", "_refusal").alias("reason"),
        F.lit(None).cast("bigint").alias("token_id"),
        F.lit(None).cast("string").alias("token_number"), F.lit(None).cast("int").alias("test_id"),
        F.col("d").alias("queue_date"), F.lit(None).cast("string").alias("patient_gender"),
        F.lit(None).cast("double").alias("payment_amount"), F.lit(None).cast("long").alias("queue_position"),
        F.lit(None).cast("long").alias("wait_time"))
    return acc.unionByName(rej)


def issue_pharmacy(log: DataFrame, pharmacies: DataFrame, status_log: DataFrame) -> DataFrame:
    """Pharmacy token issue: valid id, name, active pharmacy; number
    ``PH{id}-{nnn}`` per (pharmacy, day); ahead = waiting tokens with a lower
    id at issue; estimated wait 3 min each."""
    ph = (pharmacies.where(F.col("is_active")).select(
        F.col("id").alias("pharmacy_id"), F.lit(True).alias("_active")))
    r = log.join(ph, "pharmacy_id", "left")
    reason = (F.when(F.coalesce("pharmacy_id", F.lit(0)) <= 0, F.lit(MSG_PHARMACY_INVALID))
              .when(F.coalesce(F.trim("patient_name"), F.lit("")) == "", F.lit(MSG_PHARMACY_NAME))
              .when(F.col("_active").isNull(), F.lit(MSG_PHARMACY_INACTIVE)))
    r = r.withColumn("reason", reason)
    ok = r.where(F.col("reason").isNull()).withColumn("token_id", (F.col("req_id") + 1).cast("bigint"))
    ok = number_rows(ok, ["pharmacy_id", "d"], ["ts", "req_id"], "sequence")
    ok = ok.withColumn("token_number", seq3(F.concat(F.lit("PH"), F.col("pharmacy_id").cast("string"),
                                                     F.lit("-")), "sequence"))
    depth = depth_at_arrival(ok.select("token_id", "ts", "pharmacy_id", "d"), status_log,
                             ["pharmacy_id", "d"], ["waiting"])
    ok = ok.join(depth.select("token_id", "patients_ahead"), "token_id")
    acc = ok.select("req_id", F.lit(True).alias("accepted"), F.lit(None).cast("string").alias("reason"),
                    "token_id", "token_number", "pharmacy_id", F.col("d").alias("queue_date"),
                    "patients_ahead",
                    F.concat((F.col("patients_ahead") * PHARMACY_MINUTES_PER_PATIENT).cast("string"),
                             F.lit(" mins")).alias("estimated_wait"))
    rej = r.where(F.col("reason").isNotNull()).select(
        "req_id", F.lit(False).alias("accepted"), "reason", F.lit(None).cast("bigint").alias("token_id"),
        F.lit(None).cast("string").alias("token_number"), "pharmacy_id", F.col("d").alias("queue_date"),
        F.lit(None).cast("long").alias("patients_ahead"), F.lit(None).cast("string").alias("estimated_wait"))
    return acc.unionByName(rej)


# -- T4 -----------------------------------------------------------------------------
MSG_INVALID_BOOKING = "Invalid or expired booking"


def dominance_count(df: DataFrame, keys: list[str], order: list[str], value: str, weight: str,
                    out: str) -> DataFrame:
    """For every row: the rows of its group that come earlier in ``order``,
    have a smaller ``value`` and ``weight`` = 1 (a 2-D dominance count).

    Divide and conquer over the rank in ``order``: at level L, rows are cut
    into blocks of 2^(L+1) consecutive ranks; the left half of a block counts
    for the right half.  Every earlier/later pair meets in exactly one level
    (the highest bit where their ranks differ), and each level is one
    ``count_before`` -- a running sum over (group, block) that is itself
    skew-safe.  log2(largest group) levels, no Python per group, no pairs.
    """
    from wardline.operators.lookups import count_before
    ranked = number_rows(df, keys, order, "_rk").withColumn("_p", F.col("_rk") - 1)
    biggest = ranked.agg(F.max("_rk")).collect()[0][0] or 0
    levels = int(biggest - 1).bit_length() if biggest > 1 else 0
    base = ranked.select("req_id")
    if levels == 0:
        return base.withColumn(out, F.lit(0).cast("long"))
    # All levels in one pass: each row appears once per level, keyed by
    # (group, level, block); probe ids encode (request, level).
    lv = F.explode(F.sequence(F.lit(0), F.lit(levels - 1))).alias("_lv")
    x = ranked.select("req_id", *keys, F.col(value).alias("_t"), F.col(weight).alias("_w"), "_p", lv)
    x = x.withColumn("_blk", F.expr("shiftright(_p, _lv + 1)")) \
         .withColumn("_half", F.expr("shiftright(_p, _lv) & 1"))
    probes = x.where(F.col("_half") == 1).select(
        (F.col("req_id") * 64 + F.col("_lv")).alias("_pid"), *keys, "_lv", "_blk", "_t")
    counted = x.where((F.col("_half") == 0) & (F.col("_w") == 1)).select(*keys, "_lv", "_blk", "_t")
    c = count_before(probes, counted, keys + ["_lv", "_blk"], "_c")
    summed = c.groupBy(F.floor(F.col("_pid") / 64).cast("long").alias("req_id")).agg(F.sum("_c").alias(out))
    return base.join(summed, "req_id", "left").select(
        "req_id", F.coalesce(F.col(out), F.lit(0)).cast("long").alias(out))


def _checkin_requests(log: DataFrame, bookings: DataFrame, doctors: DataFrame) -> DataFrame:
    """Check-in requests with their valid booking: booked or confirmed, and not dated before the request day."""
    r = log.select("req_id", "ts", "d", "patient_id", upper_key("booking_id").alias("B"))
    doc = doctors.select(F.col("id").alias("doctor_id"))
    b = bookings.where(F.col("status").isin("booked", "confirmed")).join(doc, "doctor_id").select(
        upper_key("booking_id").alias("B"), "booking_id", "doctor_id", "department_id", "patient_phone",
        "appointment_date", "appointment_sod", F.col("status").alias("snap_status"))
    return r.join(b, "B").where(F.col("appointment_date") >= F.col("d"))


def checkin_bookings(bookings: DataFrame, tokens: DataFrame, doctors: DataFrame, log: DataFrame,
                     admissions: DataFrame, issued: DataFrame, lab_tokens: DataFrame) -> DataFrame:
    """T4: check-in of pre-booked appointments over a request log.

    A request succeeds for a booking that is booked or confirmed and not
    dated before the request day, if the patient (account, else the booking's
    phone) has no active token of the day; the first such request per booking
    turns it ``checked_in`` and later ones find it invalid.  The new token takes the booking
    id as number and the appointment time as expected time.  Patients ahead
    = the snapshot count (active pre-booked tokens of the doctor that day
    with an earlier time + booked bookings that day with an earlier slot)
    plus the effect of earlier check-ins of the same batch: each adds a token
    with an earlier time, and removes a booked booking of that day from the
    count.  That last term is a 2-D dominance count per (doctor, day),
    computed by ``dominance_count`` over the accepted check-ins only.
    """
    from wardline.operators.lookups import count_before
    from wardline.functions.columns import OPD_ACTIVE, starts_pb
    answered = _answered(admissions, "checkin", issued, tokens, lab_tokens)
    # The accepted check-ins (one row per booking, small) feed four branches
    # below; a reliable checkpoint stops each branch from re-joining the log
    # with the booking table.
    ensure_checkpoint_dir(log.sparkSession)
    acc = _checkin_requests(log, bookings, doctors).join(
        answered.where("admitted").select("req_id"), "req_id", "left_semi").checkpoint(eager=True)
    # Snapshot count (A8 rule on the request day).
    probes = acc.select(F.col("req_id").alias("_pid"), "doctor_id", F.col("d").alias("queue_date"),
                        F.col("appointment_sod").alias("_t"))
    tok = tokens.where(F.col("status").isin(*OPD_ACTIVE)
                       & ((F.col("token_type") == "prebooked") | starts_pb("token_number"))).select(
        "doctor_id", "queue_date", F.coalesce("expected_sod", "created_sod").alias("_t"))
    bk = bookings.where(F.col("status") == "booked").select(
        "doctor_id", F.col("appointment_date").alias("queue_date"), F.col("appointment_sod").alias("_t"))
    snap = count_before(probes, tok.unionByName(bk), ["doctor_id", "queue_date"], "_snap")
    weight = F.when((F.col("snap_status") == "booked") & (F.col("appointment_date") == F.col("d")),
                    F.lit(0)).otherwise(F.lit(1))
    batch = dominance_count(acc.select("req_id", "ts", "doctor_id", "d", "appointment_sod", weight.alias("w")),
                            ["doctor_id", "d"], ["ts", "req_id"], "appointment_sod", "w", "_extra")
    x = acc.join(snap, acc.req_id == snap._pid).join(batch, "req_id")
    ahead = F.col("_snap") + F.col("_extra")
    ok = x.select("req_id", "B", F.lit(True).alias("accepted"), F.lit(None).cast("string").alias("reason"),
                  F.col("booking_id").alias("token_number"), "doctor_id", "department_id",
                  F.col("d").alias("queue_date"), hms("appointment_sod").alias("expected_time"),
                  ahead.alias("patients_ahead"), (ahead * OPD_MINUTES_PER_PATIENT).alias("wait_time"))
    r = log.select("req_id", "d", upper_key("booking_id").alias("B")).join(answered, "req_id", "left")
    rej = r.where(~F.coalesce("admitted", F.lit(False))).select(
        "req_id", "B", F.lit(False).alias("accepted"),
        F.coalesce(F.when(~F.col("taken"), F.col("_refusal")), F.lit(MSG_INVALID_BOOKING)).alias("reason"),
        F.lit(None).cast("string").alias("token_number"), F.lit(None).cast("int").alias("doctor_id"),
        F.lit(None).cast("int").alias("department_id"), F.col("d").alias("queue_date"),
        F.lit(None).cast("string").alias("expected_time"), F.lit(None).cast("long").alias("patients_ahead"),
        F.lit(None).cast("long").alias("wait_time"))
    return ok.unionByName(rej).withColumnRenamed("B", "booking_id")
