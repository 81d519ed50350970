"""Directory and enrichment joins (§2.1 S2/S3, §2.2 F16/F18, §2.3 J1/J2/J5-J7, §2.6 L6).

Dimension sides are broadcast only when their size is fixed by the domain
(departments come from ``region``, pharmacies from ``nation``, four lab
tests); doctors grow with the supplier table, so their joins are left to
the planner and AQE, which broadcasts them only after measuring them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardline.functions.columns import LAB_ACTIVE, hhmm_ampm
from wardline.operators.ranking import number_rows


def department_list(departments: DataFrame, doctors: DataFrame | None = None) -> DataFrame:
    """Departments in name order (as a rank column).

    With ``doctors``, each department also carries its doctor count (one
    partial aggregation of the doctor table joined to the five-row list), the
    figure the department picker shows next to each entry's doctor list.
    """
    out = number_rows(departments.withColumn("_all", F.lit(1)), ["_all"], ["name", "id"],
                      "name_order", strategy="window").drop("_all")
    if doctors is not None:
        n = doctors.groupBy(F.col("department_id").alias("id")).agg(F.count(F.lit(1)).alias("doctor_count"))
        out = out.join(n, "id", "left").withColumn("doctor_count", F.coalesce("doctor_count", F.lit(0)))
    return out


def active_pharmacies(pharmacies: DataFrame, staff: DataFrame | None = None) -> DataFrame:
    """S3: active pharmacies, counters defaulted, location text; with
    ``staff``, the number of pharmacy staff on each roster."""
    out = pharmacies.where(F.col("is_active")).select(
        "id", "name", "block", "floor", "wing",
        F.coalesce("cash_counter", F.lit("Counter A")).alias("cash_counter"),
        F.coalesce("online_counter", F.lit("Counter 1")).alias("online_counter"),
        F.format_string("Block: %s, Floor: %s, Wing: %s", F.coalesce("block", F.lit("")),
                        F.coalesce("floor", F.lit("")), F.coalesce("wing", F.lit(""))).alias("location"),
    )
    if staff is not None:
        n = staff.groupBy(F.col("pharmacy_id").alias("id")).agg(F.count(F.lit(1)).alias("staff_count"))
        out = out.join(n, "id", "left").withColumn("staff_count", F.coalesce("staff_count", F.lit(0)))
    return out


def location_struct(prefix: str = "") -> F.Column:
    """F16: ``struct<floor_block, wing, room_number>`` with NULL parts as ''."""
    return F.struct(*[F.coalesce(F.col(f"{prefix}{c}"), F.lit("")).alias(c)
                      for c in ("floor_block", "wing", "room_number")])


def location_text(loc: str = "location") -> F.Column:
    """F16: the parts joined by ', ', empty parts skipped."""
    parts = F.array(*[F.col(f"{loc}.{c}") for c in ("floor_block", "wing", "room_number")])
    return F.array_join(F.filter(parts, lambda p: p != F.lit("")), ", ")


def doctor_locations(doctors: DataFrame) -> DataFrame:
    """F16: every doctor with the location object and its display text."""
    d = doctors.select(F.col("id").alias("doctor_id"), F.col("name").alias("doctor_name"),
                       location_struct().alias("location"))
    return d.select("doctor_id", "doctor_name", F.col("location.floor_block").alias("floor_block"),
                    F.col("location.wing").alias("wing"),
                    F.col("location.room_number").alias("room_number"),
                    location_text().alias("location_text"))


def doctor_directory(doctors: DataFrame, departments: DataFrame) -> DataFrame:
    """Doctors with their department, ordered by department then doctor name."""
    dep = (departments.select(F.col("id").alias("department_id"),
                                         F.col("name").alias("department")))
    d = doctors.join(dep, "department_id").select(
        "id", "name", "fees", "department", "department_id", "floor_block", "wing", "room_number")
    # ORDER BY department, name: the global order is (department, rank in department).
    return number_rows(d, ["department"], ["name", "id"], "name_order")


def tokens_enriched(tokens: DataFrame, doctors: DataFrame, departments: DataFrame) -> DataFrame:
    """Tokens with doctor and department names, board times and day order."""
    doc = doctors.select(F.col("id").alias("doctor_id"), F.col("name").alias("doctor_name"))
    dep = (departments.select(F.col("id").alias("department_id"),
                                         F.col("name").alias("department_name")))
    t = tokens.join(doc, "doctor_id", "left").join(dep, "department_id", "left")
    t = t.select("id", "token_number", "patient_name", "patient_phone", "status", "type",
                 "doctor_id", "department_id", "queue_date", "created_at",
                 hhmm_ampm("expected_sod").alias("expected_time"),
                 hhmm_ampm("created_sod").alias("created_time"), "doctor_name", "department_name")
    return number_rows(t, ["queue_date"], ["created_at", "id"], "day_order").drop("created_at")


def pharmacy_queue(pharmacy_tokens: DataFrame, pharmacies: DataFrame) -> DataFrame:
    """Pharmacy tokens with their pharmacy, in arrival order per (day, pharmacy)."""
    ph = (pharmacies.select(F.col("id").alias("pharmacy_id"),
                                       F.col("name").alias("pharmacy_name"), "block", "floor", "wing"))
    t = pharmacy_tokens.join(ph, "pharmacy_id").select(
        "id", "token_number", "patient_name", "patient_phone", "status", "payment_method",
        "pharmacy_id", "pharmacy_name", "block", "floor", "wing", "queue_date", "created_at",
        hhmm_ampm("created_sod").alias("created_time"))
    return number_rows(t, ["queue_date", "pharmacy_id"], ["created_at", "id"], "position") \
        .drop("created_at")


def view_lab_queue(lab_tokens: DataFrame, lab_tests: DataFrame) -> DataFrame:
    """The ``today_lab_queue`` view for every day (active lab tokens by queue position)."""
    tests = lab_tests.select("test_id", "test_name")
    return lab_tokens.where(F.col("token_status").isin(*LAB_ACTIVE)).join(tests, "test_id").select(
        "token_id", "token_number", "test_name", "patient_name", "patient_type", "scheduled_sod",
        "token_status", "queue_position", F.col("scheduled_date").alias("queue_date"))


def view_prebooked_labs(lab_bookings: DataFrame, lab_tests: DataFrame) -> DataFrame:
    """The ``today_prebooked_labs`` view for every day, ranked by time."""
    tests = lab_tests.select("test_id", "test_name", "test_code")
    b = lab_bookings.join(tests, "test_id").select(
        "booking_id", "booking_code", "test_name", "test_code", "patient_name", "patient_phone",
        "appointment_sod", "booking_status", F.col("appointment_date").alias("queue_date"))
    return number_rows(b, ["queue_date"], ["appointment_sod", "booking_id"], "time_order")


def lab_bookings_ordered(lab_bookings: DataFrame, lab_tests: DataFrame) -> DataFrame:
    """Lab bookings with test name in (test, date, time) order, ranked per test."""
    tests = lab_tests.select("test_id", "test_name")
    b = lab_bookings.join(tests, "test_id").select(
        "booking_id", "booking_code", "test_id", "test_name", "patient_name", "appointment_date",
        "appointment_sod", "booking_status")
    return number_rows(b, ["test_id"], ["appointment_date", "appointment_sod", "booking_id"],
                       "list_order")


def public_view(queue: DataFrame) -> DataFrame:
    """board projection without personal data (no name or phone)."""
    return queue.drop("patient_name", "patient_phone")


def staff_roster(staff: DataFrame, departments: DataFrame) -> DataFrame:
    """Staff with their department name (left join; no credentials)."""
    dep = departments.select(F.col("id").alias("dept_id"), F.col("name").alias("department_name"))
    return staff.join(dep, "dept_id", "left").select(
        "id", "name", "email", "role", "dept_id", "doc_id", "department_name")


def pharmacy_roster(pharmacy_staff: DataFrame, pharmacies: DataFrame) -> DataFrame:
    """Pharmacy staff with their pharmacy (inner join; no credentials)."""
    ph = (pharmacies.select(F.col("id").alias("pharmacy_id"), F.col("name").alias("pharmacy_name"),
                                       "block", "floor", "wing"))
    return pharmacy_staff.join(ph, "pharmacy_id").select(
        "id", "staff_id", "name", "pharmacy_id", "pharmacy_name", "block", "floor", "wing")
