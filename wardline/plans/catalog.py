"""

Every entry takes ``(spark, sf_dir)``, reads the domain tables derived from
the input tables (``wardline.sources.hospital``, staged once per session by
``wardline.sources.staging``) and runs one operator over all days at once.  Results go through ``portable`` so that both the Spark plan
and the DuckDB oracle (``wardline.plans.oracle``) expose the same types:
integers as BIGINT, days as ``yyyy-MM-dd`` text.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wardline.functions.columns import hms, sod
from wardline.operators import queues
from wardline.sources.merge import MergeTable
from wardline.sources.snapshots import DaySnapshots
from wardline.sources.staging import scratch_path, staged_hospital

QueryFn = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, QueryFn] = {}


def register(name: str):
    def deco(fn):
        QUERIES[name] = fn
        return fn
    return deco


def portable(df: DataFrame) -> DataFrame:
    """Cast result columns to types both engines print the same way."""
    cols = []
    for f in df.schema.fields:
        c = F.col(f.name)
        if isinstance(f.dataType, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
            c = c.cast("bigint")
        elif isinstance(f.dataType, T.DateType):
            c = F.date_format(c, "yyyy-MM-dd")
        elif isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType)):
            c = F.date_format(c, "yyyy-MM-dd HH:mm:ss")
        elif isinstance(f.dataType, T.DecimalType):
            c = c.cast("bigint")
        cols.append(c.alias(f.name))
    return df.select(*cols)


def _h(spark: SparkSession, sf_dir: str):
    return staged_hospital(spark, sf_dir)


# -- queues -------------------------------------------------------------------
_LIVE_OUT = ["queue_date", "position", "id", "token_number", "patient_name", "token_type",
             "status", "doctor_id", "checkin_status", "appointment_sod", "people_ahead",
             "total_in_queue"]


@register("live_queue")
def q_live_queue(spark, sf_dir):
    h = _h(spark, sf_dir)
    return portable(queues.live_queue(h.tokens, h.prebooked_appointments, scope="doctor")
                    .select(*_LIVE_OUT))


@register("live_queue_day")
def q_live_queue_day(spark, sf_dir):
    h = _h(spark, sf_dir)
    return portable(queues.live_queue(h.tokens, h.prebooked_appointments, scope="day")
                    .select(*_LIVE_OUT))


@register("combined_queue_script")
def q_combined_queue_script(spark, sf_dir):
    h = _h(spark, sf_dir)
    q = queues.live_queue(h.tokens, h.prebooked_appointments, scope="day", variant="script")
    return portable(q.select("queue_date", "position", "token_number", "patient_name", "token_type",
                             "status", hms("appointment_sod").alias("appointment_time"),
                             "checkin_status"))


@register("simple_queue")
def q_simple_queue(spark, sf_dir):
    h = _h(spark, sf_dir)
    q = queues.simple_queue(h.tokens)
    return portable(q.select("queue_date", "position", "token_number", "patient_name", "token_type",
                             "status", hms("created_sod").alias("created_time")))


@register("queue_neighbourhood")
def q_queue_neighbourhood(spark, sf_dir):
    h = _h(spark, sf_dir)
    q = queues.live_queue(h.tokens, h.prebooked_appointments, scope="day")
    return portable(queues.queue_neighbourhood(q, ["queue_date"]))


@register("lab_queue")
def q_lab_queue(spark, sf_dir):
    h = _h(spark, sf_dir)
    q = queues.lab_queue(h.lab_tokens, h.prebooked_lab_appointments, h.lab_tests)
    return portable(q.select("queue_date", "test_id", "test_name", "position", "id", "token_number",
                             "patient_name", "patient_type", "status", "checkin_status",
                             "people_ahead", "total_in_queue"))


@register("doctor_worklist")
def q_doctor_worklist(spark, sf_dir):
    h = _h(spark, sf_dir)
    q = queues.doctor_worklist(h.tokens, queues.WORKLIST_SHOWN)
    return portable(q.select("queue_date", "doctor_id", "position", "id", "token_number",
                             "patient_name", "type", "status", "expected_sod", "department_id",
                             "priority_order", F.lit("checked_in").alias("checkin_status")))


@register("expected_arrivals")
def q_expected_arrivals(spark, sf_dir):
    h = _h(spark, sf_dir)
    q = queues.expected_arrivals(h.prebooked_appointments, h.tokens, queues.ARRIVALS_SHOWN)
    return portable(q.select("queue_date", "doctor_id", "position", "prebook_id", "token_number",
                             "patient_name", F.lit("prebooked").alias("type"),
                             F.lit("not_arrived").alias("status"), "expected_sod",
                             F.lit("not_checked_in").alias("checkin_status")))


@register("all_tokens")
def q_all_tokens(spark, sf_dir):
    h = _h(spark, sf_dir)
    q = queues.all_tokens(h.tokens)
    return portable(q.select("queue_date", "doctor_id", "list_order", "id", "token_number",
                             "patient_name", "type", "status", "expected_sod",
                             hms("created_sod").alias("created_time"), "count"))


# -- directory and enrichment ------------------------------------------------------
from wardline.functions.columns import hhmm_ampm  # noqa: E402
from wardline.operators import directory, stats  # noqa: E402


@register("departments")
def q_departments(spark, sf_dir):
    h = _h(spark, sf_dir)
    return portable(directory.department_list(h.departments, h.doctors))


@register("pharmacies_active")
def q_pharmacies_active(spark, sf_dir):
    h = _h(spark, sf_dir)
    return portable(directory.active_pharmacies(h.pharmacies, h.pharmacy_staff))


@register("doctor_locations")
def q_doctor_locations(spark, sf_dir):
    return portable(directory.doctor_locations(_h(spark, sf_dir).doctors))


@register("doctor_directory")
def q_doctor_directory(spark, sf_dir):
    h = _h(spark, sf_dir)
    return portable(directory.doctor_directory(h.doctors, h.departments))


@register("tokens_enriched")
def q_tokens_enriched(spark, sf_dir):
    h = _h(spark, sf_dir)
    return portable(directory.tokens_enriched(h.tokens, h.doctors, h.departments))


@register("pharmacy_queue")
def q_pharmacy_queue(spark, sf_dir):
    h = _h(spark, sf_dir)
    return portable(directory.pharmacy_queue(h.pharmacy_tokens, h.pharmacies))


@register("view_lab_queue")
def q_view_lab_queue(spark, sf_dir):
    h = _h(spark, sf_dir)
    return portable(directory.view_lab_queue(h.lab_tokens, h.lab_tests))


@register("view_prebooked_labs")
def q_view_prebooked_labs(spark, sf_dir):
    h = _h(spark, sf_dir)
    return portable(directory.view_prebooked_labs(h.prebooked_lab_appointments, h.lab_tests))


@register("lab_bookings_ordered")
def q_lab_bookings_ordered(spark, sf_dir):
    h = _h(spark, sf_dir)
    return portable(directory.lab_bookings_ordered(h.prebooked_lab_appointments, h.lab_tests))


# -- counters -----------------------------------------------------------------------
@register("doctor_wait")
def q_doctor_wait(spark, sf_dir):
    h = _h(spark, sf_dir)
    return portable(stats.doctor_wait(h.doctors, h.tokens))


@register("doctor_idle")
def q_doctor_idle(spark, sf_dir):
    h = _h(spark, sf_dir)
    first, last = h.tokens.agg(F.min("queue_date"), F.max("queue_date")).first()
    return portable(stats.doctor_idle(h.doctors, h.tokens, first, last))


@register("opd_stats")
def q_opd_stats(spark, sf_dir):
    h = _h(spark, sf_dir)
    return portable(stats.status_counts(h.tokens, ["queue_date", "doctor_id"],
                                        ["waiting", "consulting", "completed", "cancelled"]))


@register("pharmacy_stats")
def q_pharmacy_stats(spark, sf_dir):
    h = _h(spark, sf_dir)
    return portable(stats.status_counts(h.pharmacy_tokens, ["queue_date", "pharmacy_id"],
                                        ["waiting", "processing", "completed", "cancelled"]))


@register("department_wait")
def q_department_wait(spark, sf_dir):
    h = _h(spark, sf_dir)
    return portable(stats.department_load(h.tokens).select(
        "queue_date", "department_id", "waiting", "wait_minutes"))


@register("daily_issued")
def q_daily_issued(spark, sf_dir):
    h = _h(spark, sf_dir)
    return portable(stats.department_load(h.tokens).select(
        "queue_date", "department_id", "issued", "next_sequence"))


@register("lab_wait")
def q_lab_wait(spark, sf_dir):
    h = _h(spark, sf_dir)
    return portable(stats.lab_wait(h.lab_tokens, h.lab_tests))


@register("pharmacy_wait")
def q_pharmacy_wait(spark, sf_dir):
    return portable(stats.pharmacy_wait(_h(spark, sf_dir).pharmacy_tokens))


@register("current_tokens")
def q_current_tokens(spark, sf_dir):
    h = _h(spark, sf_dir)
    return portable(stats.current_tokens(h.tokens, h.pharmacy_tokens, h.doctors, h.departments))


@register("bookings_per_test")
def q_bookings_per_test(spark, sf_dir):
    h = _h(spark, sf_dir)
    return portable(stats.bookings_per_test(h.prebooked_lab_appointments, h.lab_tests))


@register("lab_capacity")
def q_lab_capacity(spark, sf_dir):
    h = _h(spark, sf_dir)
    return portable(stats.lab_capacity(h.prebooked_lab_appointments, h.lab_tests))


@register("slot_availability")
def q_slot_availability(spark, sf_dir):
    h = _h(spark, sf_dir)
    return portable(stats.slot_availability(h.prebooked_lab_appointments, h.lab_tests))


@register("queue_totals")
def q_queue_totals(spark, sf_dir):
    h = _h(spark, sf_dir)
    live = queues.live_queue(h.tokens, h.prebooked_appointments, scope="doctor")
    work = queues.doctor_worklist(h.tokens)
    arr = queues.expected_arrivals(h.prebooked_appointments, h.tokens)
    return portable(stats.queue_totals(live, work, arr, h.tokens))


@register("doctor_remaining")
def q_doctor_remaining(spark, sf_dir):
    h = _h(spark, sf_dir)
    return portable(stats.doctor_remaining(queues.doctor_worklist(h.tokens)))


# -- lookups ------------------------------------------------------------------------
from wardline.operators import lookups  # noqa: E402


def _active(h):
    return lookups.active_tokens(h.tokens, h.lab_tokens, h.doctors, h.lab_tests)


@register("active_tokens")
def q_active_tokens(spark, sf_dir):
    h = _h(spark, sf_dir)
    return portable(_active(h).drop("kind_rank"))


@register("active_token_by_patient")
def q_active_token_by_patient(spark, sf_dir):
    h = _h(spark, sf_dir)
    return portable(lookups.active_token_lookup(h.lookup_log, _active(h)))


@register("admission")
def q_admission(spark, sf_dir):
    h = _h(spark, sf_dir)
    return portable(lookups.admission(lookups.active_token_lookup(h.lookup_log, _active(h))))


def status_requests(h):
    """Status polls: token text from the lookup log; every fourth also sends a booking id."""
    lg = h.lookup_log
    return lg.select("req_id", "d", "token",
                     F.when(F.col("req_id") % 4 == 1, F.col("booking_id")).otherwise(F.lit(""))
                     .alias("booking"))


@register("token_status")
def q_token_status(spark, sf_dir):
    h = _h(spark, sf_dir)
    return portable(lookups.token_status(status_requests(h), h.tokens, h.prebooked_appointments,
                                         h.doctors, h.departments))


@register("verify_bookings")
def q_verify_bookings(spark, sf_dir):
    h = _h(spark, sf_dir)
    return portable(lookups.verify_bookings(h.lookup_log, h.prebooked_appointments, h.doctors,
                                            h.departments))


@register("verify_lab_bookings")
def q_verify_lab_bookings(spark, sf_dir):
    h = _h(spark, sf_dir)
    return portable(lookups.verify_lab_bookings(h.lookup_log, h.prebooked_lab_appointments,
                                                h.lab_tokens, h.lab_tests, _active(h)))


@register("booking_ahead")
def q_booking_ahead(spark, sf_dir):
    h = _h(spark, sf_dir)
    return portable(lookups.booking_ahead(h.prebooked_appointments, h.tokens))


@register("lab_booking_ahead")
def q_lab_booking_ahead(spark, sf_dir):
    h = _h(spark, sf_dir)
    return portable(lookups.lab_booking_ahead(h.prebooked_lab_appointments, h.lab_tokens,
                                              h.lab_tests))


# -- numbering, labels, requests, tables -------------------------------------------------
from wardline.functions.columns import hour_label, seq3, starts_pb, ucfirst, wrap_sod  # noqa: E402
from wardline.operators import bodies, folds, labels, numbering, requests, tables  # noqa: E402


@register("opd_token_numbers")
def q_opd_token_numbers(spark, sf_dir):
    h = _h(spark, sf_dir)
    dep = (h.departments.select(F.col("id").alias("department_id"),
                                           F.col("name").alias("_dn")))
    t = h.tokens.select("id", "department_id", "queue_date", "created_at").join(dep, "department_id")
    out = numbering.sequence_numbers(t, ["department_id", "queue_date"], ["created_at", "id"],
                                     numbering.department_initial(F.col("_dn")))
    return portable(out.select("id", "queue_date", "department_id", "sequence", "issued_number"))


@register("lab_token_numbers")
def q_lab_token_numbers(spark, sf_dir):
    h = _h(spark, sf_dir)
    lt = h.lab_tests.select("test_id", "test_code")
    t = h.lab_tokens.select("token_id", "test_id", "scheduled_date", "created_at").join(lt, "test_id")
    out = numbering.sequence_numbers(t, ["test_id", "scheduled_date"], ["created_at", "token_id"],
                                     F.concat(F.col("test_code"), F.lit("-")))
    return portable(out.select("token_id", F.col("scheduled_date").alias("queue_date"), "test_id",
                               "sequence", "issued_number"))


@register("pharmacy_token_numbers")
def q_pharmacy_token_numbers(spark, sf_dir):
    h = _h(spark, sf_dir)
    t = h.pharmacy_tokens.select("id", "pharmacy_id", "queue_date", "created_at")
    out = numbering.sequence_numbers(
        t, ["pharmacy_id", "queue_date"], ["created_at", "id"],
        F.concat(F.lit("PH"), F.col("pharmacy_id").cast("string"), F.lit("-")))
    return portable(out.select("id", "queue_date", "pharmacy_id", "sequence", "issued_number"))


def _arrivals(h):
    """Tokens of every kind and their status requests, in one shape; ``kind`` is part of the group."""
    opd = h.tokens.select(F.lit("opd").alias("kind"), F.col("id").cast("long").alias("token_id"),
                          F.col("created_at").alias("ts"), F.col("department_id").alias("group_id"), "queue_date")
    lab = h.lab_tokens.select(F.lit("lab").alias("kind"), F.col("token_id").cast("long"),
                              F.col("created_at").alias("ts"), F.col("test_id").alias("group_id"),
                              F.col("scheduled_date").alias("queue_date"))
    ph = h.pharmacy_tokens.select(F.lit("pharmacy").alias("kind"), F.col("id").cast("long").alias("token_id"),
                                  F.col("created_at").alias("ts"), F.col("pharmacy_id").alias("group_id"), "queue_date")
    logs = []
    for kind, log in (("opd", h.status_log), ("lab", h.lab_status_log), ("pharmacy", h.pharmacy_status_log)):
        logs.append(log.select(F.lit(kind).alias("kind"), "req_id", F.col("token_id").cast("long").alias("token_id"),
                               "ts", "new_status"))
    return opd.unionByName(lab).unionByName(ph), logs[0].unionByName(logs[1]).unionByName(logs[2])


@register("depth_at_arrival")
def q_depth_at_arrival(spark, sf_dir):
    h = _h(spark, sf_dir)
    arrivals, updates = _arrivals(h)
    # a lab token in progress still waits in the lab's queue; the other queues count waiting ones
    depth = numbering.depth_of_kinds(arrivals, updates, {"opd": ["waiting"], "lab": ["waiting", "in_progress"],
                                                         "pharmacy": ["waiting"]})
    slots = h.lab_tests.select(F.lit("lab").alias("kind"), F.col("test_id").alias("group_id"), "slot_duration")
    minutes = (F.when(F.col("kind") == "opd", F.lit(10)).when(F.col("kind") == "pharmacy", F.lit(3))
               .otherwise(F.col("slot_duration")))
    return portable(depth.join(slots, ["kind", "group_id"], "left").select(
        "kind", "token_id", "queue_date", "group_id", "patients_ahead",
        (F.col("patients_ahead") * minutes).alias("wait_minutes")))


@register("expected_times")
def q_expected_times(spark, sf_dir):
    h = _h(spark, sf_dir)
    opd = numbering.depth_at_arrival(
        h.tokens.select(F.col("id").alias("token_id"), F.col("created_at").alias("ts"),
                        F.col("department_id").alias("group_id"), "queue_date"),
        h.status_log, ["group_id", "queue_date"], ["waiting"])
    # the depth keeps the arrival's time, so nothing is joined back
    e = opd.withColumn("expected_sod", wrap_sod(sod("ts") + F.col("patients_ahead") * 600))
    return portable(e.select("token_id", "queue_date", "patients_ahead", "expected_sod",
                             hms("expected_sod").alias("expected_time"),
                             hhmm_ampm("expected_sod").alias("expected_label")))


@register("scalar_suite")
def q_scalar_suite(spark, sf_dir):
    h = _h(spark, sf_dir)
    t = h.tokens
    wrapped = wrap_sod(F.col("created_sod") + 600 * (F.col("id") % 200))
    return portable(t.select(
        "id", "queue_date", hms("created_sod").alias("created_time"),
        hhmm_ampm("created_sod").alias("created_label"), hour_label("created_sod").alias("board_time"),
        seq3("T", "id").alias("padded"), wrapped.alias("wrapped_sod"), hms(wrapped).alias("wrapped_time"),
        ucfirst("status").alias("status_title"), F.upper("status").alias("status_upper"),
        F.date_format("queue_date", "dd MMM yyyy").alias("day_label"),
        starts_pb("token_number").alias("is_pb"),
        F.col("patient_phone").rlike(r"^[0-9]{10}$").alias("phone_ok"),
        requests.intval(F.substring("token_number", 2, 10)).alias("number_part")))


@register("status_labels")
def q_status_labels(spark, sf_dir):
    h = _h(spark, sf_dir)
    return portable(labels.status_labels(h.tokens, h.lab_tokens, h.pharmacy_tokens))


@register("queue_badges")
def q_queue_badges(spark, sf_dir):
    h = _h(spark, sf_dir)
    q = queues.live_queue(h.tokens, h.prebooked_appointments, scope="day")
    return portable(labels.queue_badges(queues.queue_neighbourhood(q, ["queue_date"])))


@register("pharmacy_board")
def q_pharmacy_board(spark, sf_dir):
    h = _h(spark, sf_dir)
    return portable(labels.pharmacy_board(directory.pharmacy_queue(h.pharmacy_tokens, h.pharmacies)))


@register("next_patient")
def q_next_patient(spark, sf_dir):
    h = _h(spark, sf_dir)
    return portable(labels.next_patient(queues.doctor_worklist(h.tokens)))


@register("pharmacy_next")
def q_pharmacy_next(spark, sf_dir):
    h = _h(spark, sf_dir)
    return portable(labels.pharmacy_next(directory.pharmacy_queue(h.pharmacy_tokens, h.pharmacies)))


@register("parse_props")
def q_parse_props(spark, sf_dir):
    from wardline.sources.driver import read_table
    ev = read_table(spark, sf_dir, "events").select("event_id", F.to_date("ts").alias("queue_date"), "props")
    p = requests.parse_requests(ev, "props", ("k",))
    return portable(p.select("event_id", "queue_date", "k_raw", "k_present", "k", (F.col("k") > 0).alias("k_valid")))


@register("request_bodies")
def q_request_bodies(spark, sf_dir):
    """Every JSON body with its typed fields or the reason against it."""
    parsed = bodies.parse_bodies(_h(spark, sf_dir).body_log)
    return portable(parsed.select("req_id", "kind", "problem", "complaint", *bodies.FIELDS))


@register("body_rejects")
def q_body_rejects(spark, sf_dir):
    return portable(bodies.rejects(bodies.parse_bodies(_h(spark, sf_dir).body_log)))


@register("request_rejects")
def q_request_rejects(spark, sf_dir):
    h = _h(spark, sf_dir)
    a = requests.validate_enum(h.status_log, "new_status", "opd_status", "opd_status")
    b = requests.validate_enum(h.pharmacy_status_log, "new_status", "pharmacy_status",
                               "pharmacy_status")
    c = requests.validate_enum(h.lab_status_log, "new_status", "lab_status", "lab_status")
    d = requests.validate_enum(h.break_log, "action", "break_action", "doctor_break")
    return portable(a.unionByName(b).unionByName(c).unionByName(d))


@register("booking_checks")
def q_booking_checks(spark, sf_dir):
    h = _h(spark, sf_dir)
    return portable(requests.reschedule_checks(h.reschedule_log).drop("d", "ts"))


def _doctor_updates(h):
    s = read_supplier(h)
    k = F.col("s_suppkey")
    upd1 = s.select((k + 1).cast("int").alias("id"),
                                      F.concat(F.col("s_name"), F.lit(" (updated)")).alias("name"),
                                      F.lit(1000).alias("fees"), F.col("department_id"),
                                      F.lit(None).cast("string").alias("floor_block"), F.lit(1).alias("seq"))
    upd2 = s.where("s_acctbal > 5000").select((k + 1).cast("int").alias("id"), F.col("s_name").alias("name"),
                                       F.lit(1200).alias("fees"), F.col("department_id"),
                                       F.lit("Annex").alias("floor_block"), F.lit(2).alias("seq"))
    new = s.select((k + 1000001).cast("int").alias("id"),
                                      F.concat(F.lit("New "), F.col("s_name")).alias("name"),
                                      F.lit(500).alias("fees"), F.col("department_id"),
                                      F.lit("Block N").alias("floor_block"), F.lit(1).alias("seq"))
    return upd1.unionByName(upd2).unionByName(new)


def read_supplier(h):
    from wardline.sources.driver import read_table
    s = read_table(h.spark, h.sf_dir, "supplier").select("s_suppkey", "s_name", "s_nationkey", "s_acctbal")
    n = read_table(h.spark, h.sf_dir, "nation").select("n_nationkey", "n_regionkey")
    return s.join(n, s.s_nationkey == n.n_nationkey).withColumn(
        "department_id", (F.col("n_regionkey") + 1).cast("int"))


@register("upsert_doctors")
def q_upsert_doctors(spark, sf_dir):
    h = _h(spark, sf_dir)
    base = h.doctors.select("id", "name", "fees", "department_id", "floor_block")
    table = MergeTable(spark, scratch_path(spark, "upsert_doctors"), base.schema)
    table.create(base)
    table.upsert(_doctor_updates(h), ["id"], ["name", "fees"], "seq")
    return portable(table.read())


@register("insert_absent")
def q_insert_absent(spark, sf_dir):
    h = _h(spark, sf_dir)
    base = h.doctors.select("id", "name", "department_id")
    s = read_supplier(h)
    k = F.col("s_suppkey")
    cand = s.select((k + 1).cast("int").alias("id"), F.lit("Dup").alias("name"),
                                      "department_id", F.lit(1).alias("seq")) \
        .unionByName(s.select((k + 2000001).cast("int").alias("id"),
                                                F.concat(F.lit("Staff "), F.col("s_name")).alias("name"),
                                                "department_id", F.lit(1).alias("seq")))
    return portable(tables.insert_absent(base, cand, ["id"], "seq"))


# -- folds ------------------------------------------------------------------------------
@register("opd_status_fold")
def q_opd_status_fold(spark, sf_dir):
    h = _h(spark, sf_dir)
    return portable(folds.opd_status_fold(h.tokens, h.status_log))


@register("cancel_tokens")
def q_cancel_tokens(spark, sf_dir):
    h = _h(spark, sf_dir)
    return portable(folds.cancel_tokens(h.tokens, h.prebooked_appointments, h.cancel_log))


@register("cancel_answers")
def q_cancel_answers(spark, sf_dir):
    h = _h(spark, sf_dir)
    return portable(folds.cancel_answers(h.tokens, h.prebooked_appointments, h.cancel_log))


@register("cancel_notifications")
def q_cancel_notifications(spark, sf_dir):
    return portable(folds.cancel_notifications(_h(spark, sf_dir).cancel_log))


@register("cancel_bookings")
def q_cancel_bookings(spark, sf_dir):
    h = _h(spark, sf_dir)
    return portable(folds.cancel_bookings(h.prebooked_appointments, h.booking_cancel_log))


@register("cancel_booking_targets")
def q_cancel_booking_targets(spark, sf_dir):
    h = _h(spark, sf_dir)
    return portable(folds.cancel_booking_targets(h.tokens, h.prebooked_appointments, h.booking_cancel_log))


@register("reschedule_tokens")
def q_reschedule_tokens(spark, sf_dir):
    h = _h(spark, sf_dir)
    return portable(folds.reschedule_tokens(h.prebooked_appointments, h.reschedule_log, h.tokens))


@register("reschedule")
def q_reschedule(spark, sf_dir):
    h = _h(spark, sf_dir)
    return portable(folds.reschedule(h.prebooked_appointments, h.reschedule_log, h.tokens))


@register("cancel_lab_targets")
def q_cancel_lab_targets(spark, sf_dir):
    h = _h(spark, sf_dir)
    return portable(folds.cancel_lab_targets(h.prebooked_lab_appointments, h.lab_tokens, h.lab_cancel_log))


@register("cancel_lab")
def q_cancel_lab(spark, sf_dir):
    h = _h(spark, sf_dir)
    return portable(folds.cancel_lab(h.prebooked_lab_appointments, h.lab_cancel_log))


@register("cancel_pharmacy")
def q_cancel_pharmacy(spark, sf_dir):
    h = _h(spark, sf_dir)
    return portable(folds.cancel_pharmacy(h.pharmacy_tokens, h.pharmacy_cancel_log))


@register("pharmacy_status_fold")
def q_pharmacy_status_fold(spark, sf_dir):
    h = _h(spark, sf_dir)
    return portable(folds.pharmacy_status_fold(h.pharmacy_tokens, h.pharmacy_status_log))


@register("break_state")
def q_break_state(spark, sf_dir):
    h = _h(spark, sf_dir)
    return portable(folds.break_state(h.break_log))


@register("issue_opd")
def q_issue_opd(spark, sf_dir):
    h = _h(spark, sf_dir)
    return portable(folds.issue_opd(h.opd_issue_log, h.departments, h.doctors, h.admissions, h.issued, h.tokens,
                                    h.lab_tokens, h.status_log, h.issued_log))


@register("issue_lab")
def q_issue_lab(spark, sf_dir):
    h = _h(spark, sf_dir)
    return portable(folds.issue_lab(h.lab_issue_log, h.lab_tests, h.admissions, h.issued, h.tokens, h.lab_tokens,
                                    h.lab_status_log, h.issued_log))


@register("issue_pharmacy")
def q_issue_pharmacy(spark, sf_dir):
    h = _h(spark, sf_dir)
    return portable(folds.issue_pharmacy(h.pharmacy_issue_log, h.pharmacies, h.pharmacy_status_log))


@register("checkin_bookings")
def q_checkin_bookings(spark, sf_dir):
    h = _h(spark, sf_dir)
    return portable(folds.checkin_bookings(h.prebooked_appointments, h.tokens, h.doctors, h.checkin_log,
                                           h.admissions, h.issued, h.lab_tokens))


# -- streaming operators (batch twins) --------------------------------------------------
from wardline.streaming import alerts  # noqa: E402


@register("status_alerts")
def q_status_alerts(spark, sf_dir):
    h = _h(spark, sf_dir)
    return portable(alerts.status_alerts(h.tokens, h.status_log, h.doctors))


@register("expired_tokens")
def q_expired_tokens(spark, sf_dir):
    h = _h(spark, sf_dir)
    return portable(alerts.expired_tokens(h.tokens, h.status_log))


@register("staff_roster")
def q_staff_roster(spark, sf_dir):
    h = _h(spark, sf_dir)
    return portable(directory.staff_roster(h.staff, h.departments))


@register("pharmacy_roster")
def q_pharmacy_roster(spark, sf_dir):
    h = _h(spark, sf_dir)
    return portable(directory.pharmacy_roster(h.pharmacy_staff, h.pharmacies))


# -- table maintenance and responses --------------------------------------------------
@register("harmonize_bookings")
def q_harmonize_bookings(spark, sf_dir):
    """OPD and lab bookings in one layout; what a table lacks takes its default."""
    h = _h(spark, sf_dir)
    layout = T.StructType([
        T.StructField("code", T.StringType()), T.StructField("patient_name", T.StringType()),
        T.StructField("appointment_date", T.DateType()), T.StructField("appointment_sod", T.LongType()),
        T.StructField("status", T.StringType()), T.StructField("department_id", T.LongType()),
        T.StructField("test_id", T.LongType()), T.StructField("kind", T.StringType())])
    opd = tables.harmonize(h.prebooked_appointments.withColumnRenamed("booking_id", "code"), layout,
                           {"kind": "opd", "test_id": 0})
    lab = tables.harmonize(h.prebooked_lab_appointments.withColumnRenamed("booking_code", "code")
                           .withColumnRenamed("booking_status", "status"), layout, {"kind": "lab", "department_id": 0})
    return portable(opd.unionByName(lab))


@register("backfill_locations")
def q_backfill_locations(spark, sf_dir):
    """Doctors of a department take its name as wing; the others keep theirs."""
    h = _h(spark, sf_dir)
    values = h.departments.where(F.col("id") % 2 == 0).select(F.col("id").alias("department_id"),
                                                              F.upper("name").alias("wing"))
    base = h.doctors.select("id", "department_id", "wing")
    table = MergeTable(spark, scratch_path(spark, "backfill_locations"), base.schema)
    table.create(base)
    table.backfill(values, ["department_id"], ["wing"])
    return portable(table.read())


@register("reset_bookings")
def q_reset_bookings(spark, sf_dir):
    """All bookings, those of the last day back to 'booked'."""
    h = _h(spark, sf_dir)
    last = h.prebooked_appointments.agg(F.max("appointment_date")).first()[0]
    return portable(tables.reset_bookings(h.prebooked_appointments, last).select(
        "id", "booking_id", "appointment_date", "status"))


@register("wipe_day")
def q_wipe_day(spark, sf_dir):
    """The day-partitioned tokens after the first day has been removed."""
    h = _h(spark, sf_dir)
    rows = h.tokens.select("id", "token_number", "status", "queue_date")
    store = DaySnapshots(spark, scratch_path(spark, "wipe_day"), rows.schema)
    days = [r[0] for r in rows.select("queue_date").distinct().collect()]  # a row for each day
    store.commit(rows, days)
    store.wipe([min(days)] if days else [])
    return portable(store.read())


@register("public_queue")
def q_public_queue(spark, sf_dir):
    """F18 + S11: every live queue row as the JSON text of a board, without personal data."""
    h = _h(spark, sf_dir)
    q = directory.public_view(queues.live_queue(h.tokens, h.prebooked_appointments, scope="doctor"))
    shown = portable(q.select("queue_date", "doctor_id", "position", "token_number", "status"))
    return tables.to_response(shown)
