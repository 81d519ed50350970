"""Request-driven lookups (§2.3 J3/J7/J11/J14, §2.4 A8/A9, §2.7 U3, §2.9 R1-R3).

The reference answers one request with up to three dependent queries.  Here
a whole table of requests is answered at once: each lookup step is an equi
join against a pre-aggregated side (one row per key and day), steps are
combined with ``coalesce`` in the reference's fallback order, and OR keys
are split into separate equi joins.  Counting "patients ahead" is a running
sum over a per-(doctor | test, day) timeline (``count_before``), never a
self join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardline.functions.columns import (LAB_ACTIVE, OPD_ACTIVE, OPD_MINUTES_PER_PATIENT, hms,
                                        starts_pb, upper_key, wrap_sod)
from wardline.operators.admission import refusal_text
from wardline.operators.ranking import running_sum

# Fixed texts of the application (admission refusals, status reason).
ACTIVE_KIND_LABEL = {"opd": "OPD consultation", "lab": "Lab test"}
REFUSAL_ACCOUNT = ("You already have an active {kind} token ({token}) from your account. "
                   "Only one token per account is allowed. Please complete, cancel, or wait for it "
                   "to expire.")
REFUSAL_PHONE = ("You already have an active {kind} token ({token}). You can only have one token "
                 "at a time. Please complete, cancel, or wait for it to expire.")
LATE_REASON = "due to being late"
OPD_VALID_BOOKING = ("booked", "confirmed")
LAB_VALID_BOOKING = ("booked", "checked_in", "in_progress")


# -- U3 / R1 / R2 ---------------------------------------------------------------------
def active_tokens(tokens: DataFrame, lab_tokens: DataFrame, doctors: DataFrame,
                  lab_tests: DataFrame) -> DataFrame:
    """Active OPD and lab tokens of every day with a type tag and the
    doctor or test name (the reference's correlated scalar subqueries)."""
    doc = doctors.select(F.col("id").alias("doctor_id"), F.col("name").alias("location_name"))
    opd = tokens.where(F.col("status").isin(*OPD_ACTIVE)).join(doc, "doctor_id", "left").select(
        F.lit("opd").alias("token_type"), F.lit(0).alias("kind_rank"), "id", "token_number",
        F.col("status").alias("token_status"), "patient_id", "patient_phone", "queue_date",
        "location_name")
    tests = lab_tests.select("test_id", F.col("test_name").alias("location_name"))
    lab = lab_tokens.where(F.col("token_status").isin(*LAB_ACTIVE)).join(tests, "test_id", "left").select(
        F.lit("lab").alias("token_type"), F.lit(1).alias("kind_rank"), F.col("token_id").alias("id"),
        "token_number", "token_status", "patient_id", "patient_phone",
        F.col("scheduled_date").alias("queue_date"), "location_name")
    return opd.unionByName(lab)


# Fixed text of the application.
LAB_BOOKING_NOT_FOUND = "Booking not found or already completed. Please check your Lab Booking ID."


def _first_active(active: DataFrame, key: str) -> DataFrame:
    """One row per (key, day): OPD before lab, then lowest id (pre-aggregated
    before the request join, so a busy key never fans out)."""
    payload = F.struct("token_type", "token_number", "token_status", "location_name")
    return active.where(F.col(key).isNotNull()).groupBy(key, "queue_date").agg(
        F.min_by(payload, F.struct("kind_rank", "id")).alias("hit"))


def active_token_lookup(requests: DataFrame, active: DataFrame) -> DataFrame:
    """Per request the patient's active token of the request day, looked
    up by patient id when logged in, else by phone."""
    by_id = _first_active(active, "patient_id").withColumnRenamed("hit", "hit_id")
    by_phone = _first_active(active, "patient_phone").withColumnRenamed("hit", "hit_phone")
    r = requests.select("req_id", "d", "patient_id", "patient_phone")
    kind = (F.when(F.col("patient_id").isNotNull(), F.lit("patient_id"))
            .when(F.coalesce(F.trim("patient_phone"), F.lit("")) != "", F.lit("phone"))
            .otherwise(F.lit("none")))
    r = r.withColumn("key_kind", kind)
    r = r.join(by_id, (r.patient_id == by_id.patient_id) & (r.d == by_id.queue_date), "left") \
        .drop(by_id.patient_id).drop(by_id.queue_date)
    r = r.join(by_phone, (F.col("key_kind") == "phone") & (r.patient_phone == by_phone.patient_phone)
               & (r.d == by_phone.queue_date), "left").drop(by_phone.patient_phone).drop(by_phone.queue_date)
    hit = (F.when(F.col("key_kind") == "patient_id", F.col("hit_id"))
           .when(F.col("key_kind") == "phone", F.col("hit_phone")))
    return r.select("req_id", "key_kind", hit.alias("hit")).select(
        "req_id", "key_kind", F.col("hit").isNotNull().alias("found"),
        F.col("hit.token_type").alias("token_type"), F.col("hit.token_number").alias("token_number"),
        F.col("hit.token_status").alias("token_status"),
        F.col("hit.location_name").alias("location_name"))


def admission(lookup: DataFrame) -> DataFrame:
    """R2: allow a new token only when the patient has no active one today."""
    label = F.when(F.col("token_type") == "opd", F.lit(ACTIVE_KIND_LABEL["opd"])).otherwise(
        F.lit(ACTIVE_KIND_LABEL["lab"]))

    def fill(template: str) -> F.Column:
        head, rest = template.split("{kind}")
        mid, tail = rest.split("{token}")
        return F.concat(F.lit(head), label, F.lit(mid), F.col("token_number"), F.lit(tail))

    msg = (F.when(~F.col("found"), F.lit(None).cast("string"))
           .when(F.col("key_kind") == "patient_id", fill(REFUSAL_ACCOUNT))
           .otherwise(fill(REFUSAL_PHONE)))
    return lookup.select("req_id", (~F.col("found")).alias("allowed"),
                         F.col("token_number").alias("existing_token"), msg.alias("message"))


# -- R3 -----------------------------------------------------------------------------
def token_status(requests: DataFrame, tokens: DataFrame, bookings: DataFrame, doctors: DataFrame,
                 departments: DataFrame) -> DataFrame:
    """Status poll with the reference's three-step fallback.

    ``requests``: req_id, d, token, booking.  Step 1: today's token whose
    number or booking id equals the token text (two equi joins, lowest id);
    step 2: the booking; step 3: today's token by booking id.  Only step 1
    carries the doctor's location.
    """
    hit = F.struct("id", "status", "token_number", "booking_id", "doctor_id", "department_id")
    t = tokens.select("id", "token_number", "booking_id", "status", "doctor_id", "department_id", "queue_date")
    r = requests.select("req_id", "d", upper_key("token").alias("T"), upper_key("booking").alias("B"))
    # Match first: the lowest id of every text and day, found once, meets the requests.
    by_num = t.select(upper_key("token_number").alias("T"), F.col("queue_date").alias("d"), hit.alias("p"))
    by_bid = t.where(F.col("booking_id").isNotNull()).select(
        upper_key("booking_id").alias("T"), F.col("queue_date").alias("d"), hit.alias("p"))
    s1 = by_num.unionByName(by_bid).where(F.col("T") != "").groupBy("T", "d").agg(F.min_by("p", "p.id").alias("s1"))
    s2 = bookings.select(upper_key("booking_id").alias("B"),
                         F.struct("status", "booking_id", "doctor_id", "department_id").alias("s2")).where(
        F.col("B") != "")
    s3 = by_bid.where(F.col("T") != "").groupBy(F.col("T").alias("B"), "d").agg(F.min_by("p", "p.id").alias("s3"))
    x = r.join(s1, ["T", "d"], "left").join(s2, "B", "left").join(s3, ["B", "d"], "left")
    status = F.coalesce("s1.status", "s2.status", "s3.status")
    step = (F.when(F.col("s1").isNotNull(), 1).when(F.col("s2").isNotNull(), 2)
            .when(F.col("s3").isNotNull(), 3))

    def of_step(field: str) -> F.Column:
        return (F.when(step == 1, F.col(f"s1.{field}")).when(step == 2, F.col(f"s2.{field}"))
                .when(step == 3, F.col(f"s3.{field}")))

    x = x.select("req_id", "T", "B", status.alias("_status"), step.alias("step"), "s1", "s2", "s3",
                 of_step("doctor_id").alias("doctor_id"), of_step("department_id").alias("department_id"))
    # Then enrich the answers.
    doc = doctors.select(F.col("id").alias("doctor_id"), F.col("name").alias("doctor_name"),
                         "floor_block", "wing", "room_number")
    dep = departments.select(F.col("id").alias("department_id"), F.col("name").alias("department_name"))
    x = x.join(doc, "doctor_id", "left").join(dep, "department_id", "left")
    step, status = F.col("step"), F.col("_status")

    def place(field: str) -> F.Column:
        return F.when(step == 1, F.coalesce(F.col(field), F.lit(""))).when(step.isNotNull(), F.lit("")).alias(field)

    return x.select(
        "req_id",
        F.when((F.col("T") == "") & (F.col("B") == ""), F.lit(None).cast("string"))
         .otherwise(F.coalesce(status, F.lit("not_found"))).alias("status"),
        F.when(status == "cancelled", F.lit(LATE_REASON)).alias("reason"),
        F.when(step == 1, F.col("s1.token_number")).when(step == 3, F.col("s3.token_number"))
         .alias("token_number"),
        F.when(step == 1, F.coalesce(F.col("s1.booking_id"), F.col("B")))
         .when(step == 2, F.col("s2.booking_id")).when(step == 3, F.col("s3.booking_id"))
         .alias("booking_id"),
        "doctor_name", "department_name", place("floor_block"), place("wing"), place("room_number"), "step")


# -- J3 / J7 / A8 / A9 -----------------------------------------------------------------
def verify_bookings(requests: DataFrame, bookings: DataFrame, doctors: DataFrame,
                    departments: DataFrame) -> DataFrame:
    """Booking details for each verification request; a booking is valid
    when booked or confirmed and not dated before the request day."""
    doc = doctors.select(F.col("id").alias("doctor_id"), F.col("name").alias("doctor_name"),
                         F.col("fees").alias("doctor_fees"), "floor_block", "wing", "room_number")
    dep = (departments.select(F.col("id").alias("department_id"),
                                         F.col("name").alias("department_name")))
    b = bookings.where(F.col("status").isin(*OPD_VALID_BOOKING)).join(doc, "doctor_id") \
        .join(dep, "department_id").select(
        upper_key("booking_id").alias("_bk"), "booking_id", "patient_name", "patient_phone",
        "appointment_date", "appointment_sod", "status", "doctor_id", "doctor_name", "doctor_fees",
        "floor_block", "wing", "room_number", "department_id", "department_name")
    r = requests.select("req_id", "d", upper_key("booking_id").alias("_req"))
    x = r.join(b, (r._req == b._bk) & (b.appointment_date >= r.d), "left")
    return x.select(
        "req_id", F.col("booking_id").isNotNull().alias("found"), "booking_id", "patient_name",
        "patient_phone", F.date_format("appointment_date", "dd MMM yyyy").alias("appointment_date"),
        hms("appointment_sod").alias("appointment_time"), "status", "doctor_id", "doctor_name",
        "doctor_fees", "floor_block", "wing", "room_number", "department_id", "department_name")


def count_before(probes: DataFrame, counted: DataFrame, keys: list[str], out: str) -> DataFrame:
    """For each probe (``_pid``, keys, ``_t``) the number of counted rows
    (keys, ``_t``) with the same keys and a strictly smaller ``_t``.

    One union ordered by (time, probes before counted rows) and a running sum
    of the counted flag: rank-based, no self join, skew-safe via running_sum.
    """
    p = probes.select("_pid", *keys, "_t", F.lit(0).alias("_kind"), F.lit(0).alias("_v"))
    c = counted.where(F.col("_t").isNotNull()).select(
        F.lit(None).cast(probes.schema["_pid"].dataType).alias("_pid"), *keys, "_t",
        F.lit(1).alias("_kind"), F.lit(1).alias("_v"))
    u = p.unionByName(c)
    r = running_sum(u, keys, [F.col("_t").asc_nulls_first(), "_kind", "_pid"], "_v", out)
    return r.where(F.col("_kind") == 0).select("_pid", out)


def booking_ahead(bookings: DataFrame, tokens: DataFrame) -> DataFrame:
    """Patients ahead of every valid OPD booking on its own day: active
    pre-booked tokens of the doctor with an earlier queue time plus booked
    bookings with an earlier slot; wait = 10 min each."""
    valid = bookings.where(F.col("status").isin(*OPD_VALID_BOOKING))
    probes = valid.select(F.col("id").alias("_pid"), "doctor_id",
                          F.col("appointment_date").alias("queue_date"),
                          F.col("appointment_sod").alias("_t"))
    tok = tokens.where(F.col("status").isin(*OPD_ACTIVE)
                       & ((F.col("token_type") == "prebooked") | starts_pb("token_number"))).select(
        "doctor_id", "queue_date", F.coalesce("expected_sod", "created_sod").alias("_t"))
    bk = bookings.where(F.col("status") == "booked").select(
        "doctor_id", F.col("appointment_date").alias("queue_date"), F.col("appointment_sod").alias("_t"))
    ahead = count_before(probes, tok.unionByName(bk), ["doctor_id", "queue_date"], "patients_ahead")
    out = valid.join(ahead, valid.id == ahead._pid).drop("_pid")
    return out.select("id", "booking_id", "doctor_id", F.col("appointment_date").alias("queue_date"),
                      hms("appointment_sod").alias("appointment_time"), "patients_ahead",
                      (F.col("patients_ahead") * OPD_MINUTES_PER_PATIENT).alias("wait_time"))


def _lab_ahead(probes: DataFrame, lab_tokens: DataFrame, lab_bookings: DataFrame) -> DataFrame:
    """A9 core: probes (_pid, test_id, queue_date, _t) -> people ahead: all
    active lab tokens of the test that day (no time test, as in the
    reference) plus booked bookings with an earlier slot."""
    active = lab_tokens.where(F.col("token_status").isin(*LAB_ACTIVE)).groupBy(
        "test_id", F.col("scheduled_date").alias("queue_date")).agg(F.count(F.lit(1)).alias("_active"))
    bk = lab_bookings.where(F.col("booking_status") == "booked").select(
        "test_id", F.col("appointment_date").alias("queue_date"), F.col("appointment_sod").alias("_t"))
    earlier = count_before(probes, bk, ["test_id", "queue_date"], "_earlier")
    p = probes.join(earlier, "_pid").join(active, ["test_id", "queue_date"], "left")
    return p.select("_pid", (F.coalesce("_active", F.lit(0)) + F.col("_earlier")).alias("people_ahead"))


def lab_booking_ahead(lab_bookings: DataFrame, lab_tokens: DataFrame, lab_tests: DataFrame) -> DataFrame:
    """A9 over all days: each valid lab booking counted on its own date."""
    tests = lab_tests.select("test_id", "test_code", "duration_minutes")
    valid = lab_bookings.where(F.col("booking_status").isin(*LAB_VALID_BOOKING)).join(tests, "test_id")
    probes = valid.select(F.col("booking_id").alias("_pid"), "test_id",
                          F.col("appointment_date").alias("queue_date"),
                          F.col("appointment_sod").alias("_t"))
    ahead = _lab_ahead(probes, lab_tokens, lab_bookings)
    v = valid.join(ahead, valid.booking_id == ahead._pid)
    wait = F.col("people_ahead") * F.col("duration_minutes")
    return v.select("booking_id", "booking_code", "test_id", "test_code",
                    F.col("appointment_date").alias("queue_date"),
                    hms("appointment_sod").alias("scheduled_time"), "people_ahead",
                    wait.alias("wait_time"),
                    hms(wrap_sod(F.col("appointment_sod") + wait * 60)).alias("expected_time"),
                    (F.col("people_ahead") + 1).alias("position"))


def verify_lab_bookings(requests: DataFrame, lab_bookings: DataFrame, lab_tokens: DataFrame,
                        lab_tests: DataFrame, active: DataFrame) -> DataFrame:
    """J7 + A9: lab booking by code for each request: found, or the message against it.

    A patient (account, else the booking's phone) with an active token of the request day is refused, as at
    check-in.  Ahead is counted on the request day (the reference counts today's queue even for later dates).
    """
    tests = lab_tests.select("test_id", "test_code", "test_name", "duration_minutes")
    b = lab_bookings.where(F.col("booking_status").isin(*LAB_VALID_BOOKING)).join(tests, "test_id")
    r = requests.select("req_id", "d", "patient_id", upper_key("lab_code").alias("_code"))
    x = r.join(b, (r._code == b.booking_code) & (b.appointment_date >= r.d))
    found = active_token_lookup(x.select("req_id", "d", "patient_id", "patient_phone"), active).where("found")
    kind = F.when(F.col("token_type") == "opd", F.lit("opd")).otherwise(F.lit("lab"))
    refused = found.select("req_id", refusal_text("checkin", F.col("key_kind") == "patient_id", kind,
                                                  F.col("token_number"), F.col("token_status")).alias("_refusal"))
    x = x.join(refused, "req_id", "left")
    probes = x.where("_refusal is null").select(
        F.col("req_id").alias("_pid"), "test_id", F.col("d").alias("queue_date"), F.col("appointment_sod").alias("_t"))
    ahead = _lab_ahead(probes, lab_tokens, lab_bookings)
    v = x.join(ahead, x.req_id == ahead._pid, "left")
    wait = F.col("people_ahead") * F.col("duration_minutes")
    shown = [F.col("booking_code").alias("booking_id"), F.col("test_id"), F.col("test_code"), F.col("test_name"),
             F.col("patient_name"), F.col("patient_phone"), F.col("appointment_date"),
             hms("appointment_sod").alias("scheduled_time"),
             hms(wrap_sod(F.col("appointment_sod") + wait * 60)).alias("expected_time"), F.col("booking_status"),
             F.col("people_ahead"), wait.alias("wait_time"), (F.col("people_ahead") + 1).alias("position")]
    answer = F.when(F.col("_refusal").isNull(), F.struct(*shown))
    v = v.select("req_id", "_refusal", answer.alias("_a"))
    out = requests.select("req_id").join(v, "req_id", "left")
    is_found = F.col("_a").isNotNull()
    return out.select("req_id", "_a.*", is_found.alias("found"), F.when(
        ~is_found, F.coalesce("_refusal", F.lit(LAB_BOOKING_NOT_FOUND))).alias("message"))
