"""Counters and wait estimates (§2.4 A*).

The reference counts with PHP loops or one ``COUNT(*)`` query per doctor
(N+1).  Each counter here is one ``groupBy`` with conditional counts: the
aggregation is partial (map-side) and the shuffle carries one row per group
and task, so a hot doctor or test costs nothing extra.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wardline.functions.columns import (LAB_ACTIVE, OPD_MINUTES_PER_PATIENT,
                                        PHARMACY_MINUTES_PER_PATIENT, hms)
from wardline.operators.ranking import lag_within


def count_if(cond) -> F.Column:
    return F.count(F.when(cond, F.lit(1)))


def status_counts(df: DataFrame, keys: list[str], statuses: list[str],
                  status_col: str = "status") -> DataFrame:
    """A1 / A2: total plus one count per status value for each group."""
    aggs = [F.count(F.lit(1)).alias("total")]
    aggs += [count_if(F.col(status_col) == s).alias(s) for s in statuses]
    return df.groupBy(*keys).agg(*aggs)


def doctor_wait(doctors: DataFrame, tokens: DataFrame, as_of=None) -> DataFrame:
    """Waiting patients per doctor and the 10-minute estimate.

    With ``as_of`` every doctor gets a row (zero when idle), as the directory
    does for one day.  Over all days a row exists per doctor and day with
    tokens; a doctor x day grid would be a cross product.
    """
    t = tokens if as_of is None else tokens.where(F.col("queue_date") == F.lit(as_of))
    counts = t.groupBy("doctor_id", "queue_date").agg(
        count_if(F.col("status") == "waiting").alias("patients_waiting"))
    docs = doctors.select(F.col("id").alias("doctor_id"), F.col("name").alias("doctor_name"),
                          "department_id")
    if as_of is None:
        out = counts.join(docs, "doctor_id")
    else:
        out = docs.join(counts, "doctor_id", "left").withColumn(
            "patients_waiting", F.coalesce("patients_waiting", F.lit(0))) \
            .withColumn("queue_date", F.lit(as_of).cast("date"))
    return out.withColumn("wait_time", F.col("patients_waiting") * OPD_MINUTES_PER_PATIENT)


def department_load(tokens: DataFrame) -> DataFrame:
    """A4 / A5: per (day, department) tokens issued and waiting, with wait minutes."""
    return tokens.groupBy("queue_date", "department_id").agg(
        F.count(F.lit(1)).alias("issued"),
        count_if(F.col("status") == "waiting").alias("waiting"),
    ).withColumn("wait_minutes", F.col("waiting") * OPD_MINUTES_PER_PATIENT) \
     .withColumn("next_sequence", F.col("issued") + 1)


def lab_wait(lab_tokens: DataFrame, lab_tests: DataFrame) -> DataFrame:
    """Per (day, test) issued and active lab tokens; wait = active x slot_duration."""
    agg = lab_tokens.groupBy(F.col("scheduled_date").alias("queue_date"), "test_id").agg(
        F.count(F.lit(1)).alias("issued"),
        count_if(F.col("token_status").isin(*LAB_ACTIVE)).alias("active"))
    tests = lab_tests.select("test_id", "test_code", "slot_duration")
    return agg.join(tests, "test_id").withColumn(
        "wait_minutes", F.col("active") * F.col("slot_duration")).drop("slot_duration")


def pharmacy_wait(pharmacy_tokens: DataFrame) -> DataFrame:
    """Per (day, pharmacy) issued and waiting tokens; wait = waiting x 3 min."""
    return pharmacy_tokens.groupBy("queue_date", "pharmacy_id").agg(
        F.count(F.lit(1)).alias("issued"),
        count_if(F.col("status") == "waiting").alias("waiting"),
    ).withColumn("wait_minutes", F.col("waiting") * PHARMACY_MINUTES_PER_PATIENT)


def doctor_idle(doctors: DataFrame, tokens: DataFrame, first, last) -> DataFrame:
    """A3 / J12, the zeros: for every doctor the stretches of days, between ``first`` and ``last``, on which nobody
    waits for them (wait 0), as (from, to, days).

    Gaps between the days with waiting patients: each such day looks back at the one before it (one row per doctor
    and day, a day outside at both ends), so there is no doctor x day grid.  ``idle_on`` gives any one day of it.
    """
    day = F.col("queue_date")
    busy = tokens.where(F.col("status") == "waiting").where(day.between(F.lit(first), F.lit(last))).select(
        F.col("doctor_id"), day).distinct()
    docs = doctors.select(F.col("id").alias("doctor_id"), F.col("name").alias("doctor_name"), "department_id")
    ends = F.explode(F.array(F.date_sub(F.lit(first).cast("date"), 1), F.date_add(F.lit(last).cast("date"), 1)))
    marks = docs.select("doctor_id", ends.alias("queue_date")).unionByName(
        busy.join(docs.select("doctor_id"), "doctor_id", "left_semi"))
    gaps = lag_within(marks, ["doctor_id"], ["queue_date"], "queue_date", "_before").where(
        F.datediff("queue_date", "_before") > 1)
    return gaps.join(docs, "doctor_id").select(
        "doctor_id", "doctor_name", "department_id", F.date_add("_before", 1).alias("idle_from"),
        F.date_sub("queue_date", 1).alias("idle_to"), (F.datediff("queue_date", "_before") - 1).alias("idle_days"),
        F.lit(0).alias("wait_time"))


def idle_on(idle: DataFrame, day) -> DataFrame:
    """Doctors without waiting patients on one day, shaped like ``doctor_wait``."""
    at = F.lit(day).cast("date")
    return idle.where(at.between(F.col("idle_from"), F.col("idle_to"))).select(
        "doctor_id", "doctor_name", "department_id", at.alias("queue_date"), F.lit(0).cast("long").alias("patients_waiting"),
        "wait_time")


def current_tokens(tokens: DataFrame, pharmacy_tokens: DataFrame, doctors: DataFrame,
                   departments: DataFrame) -> DataFrame:
    """A10: the token being served, at three scopes.

    ``day``: lowest-id consulting OPD token of the day (the reference's
    unordered LIMIT 1, fixed to lowest id); ``department``: the same per
    department, 'None' when the department has tokens but none consulting;
    ``pharmacy``: the oldest processing pharmacy token.  The day's token comes
    with the names of its doctor and department.
    """
    consulting = F.when(F.col("status") == "consulting", F.struct("id", "token_number"))
    day = tokens.where(F.col("status") == "consulting").groupBy("queue_date").agg(
        F.min_by(F.struct("token_number", "doctor_id", "department_id"), "id").alias("_c"))
    doc = doctors.select(F.col("id").alias("_doc"), F.col("name").alias("doctor_name"))
    dep = departments.select(F.col("id").alias("_dep"), F.col("name").alias("department_name"))
    day = day.join(doc, F.col("_c.doctor_id") == F.col("_doc"), "left").join(
        dep, F.col("_c.department_id") == F.col("_dep"), "left").select(
        F.lit("day").alias("scope"), "queue_date", F.lit(None).cast("int").alias("scope_id"),
        F.col("_c.token_number").alias("current_token"), "doctor_name", "department_name")
    dept = tokens.groupBy("queue_date", "department_id").agg(
        F.min(consulting).alias("_c")).select(
        F.lit("department").alias("scope"), "queue_date", F.col("department_id").alias("scope_id"),
        F.coalesce(F.col("_c.token_number"), F.lit("None")).alias("current_token"))
    ph = pharmacy_tokens.where(F.col("status") == "processing").groupBy("queue_date", "pharmacy_id").agg(
        F.min_by("token_number", F.struct("created_at", "id")).alias("current_token")).select(
        F.lit("pharmacy").alias("scope"), "queue_date", F.col("pharmacy_id").alias("scope_id"),
        "current_token")
    return day.unionByName(dept.unionByName(ph), allowMissingColumns=True)


def bookings_per_test(lab_bookings: DataFrame, lab_tests: DataFrame) -> DataFrame:
    """Lab bookings per test per day (with the test name)."""
    agg = lab_bookings.groupBy(F.col("appointment_date").alias("queue_date"), "test_id").agg(
        F.count(F.lit(1)).alias("total_bookings"))
    return agg.join(lab_tests.select("test_id", "test_name"), "test_id")


def slot_availability(lab_bookings: DataFrame, lab_tests: DataFrame) -> DataFrame:
    """A12 by slot: capacity, live bookings and what is left of every slot of every test and day with bookings.

    A test's day is cut into slots of its slot duration; a booking belongs to the slot that its time falls into and
    slots without bookings are filled in.  The day's capacity is shared out equally, and the seats that are left by
    whole shares (largest remainder, where all remainders are equal) go to the slots with most bookings, then the
    earlier ones.  So the rows of a day add up to ``lab_capacity``.
    """
    tests = lab_tests.select("test_id", "test_code", "daily_capacity",
                             (F.col("slot_duration") * 60).alias("_seconds"),
                             F.expr("cast(floor(86400 / (slot_duration * 60)) as int)").alias("_slots"))
    live = lab_bookings.where(F.col("booking_status") != "cancelled").join(tests, "test_id")
    # what is left of a day behind its last whole slot belongs to that slot
    slot = F.least(F.floor(F.col("appointment_sod") / F.col("_seconds")), F.col("_slots") - 1).cast("int")
    booked = live.groupBy("test_id", F.col("appointment_date").alias("slot_date"), slot.alias("_slot")).agg(
        F.count(F.lit(1)).alias("booked_count"))
    days = booked.select("test_id", "slot_date").distinct().join(tests, "test_id")
    calendar = days.withColumn("_slot", F.explode(F.sequence(F.lit(0), F.col("_slots") - 1)))
    rows = calendar.join(booked, ["test_id", "slot_date", "_slot"], "left").withColumn(
        "booked_count", F.coalesce("booked_count", F.lit(0)))
    # at most a day's slots in a group
    nth = F.row_number().over(Window.partitionBy("test_id", "slot_date").orderBy(F.desc("booked_count"), "_slot"))
    share = F.floor(F.col("daily_capacity") / F.col("_slots"))
    total = (share + F.when(nth <= F.col("daily_capacity") - share * F.col("_slots"), 1).otherwise(0)).cast("long")
    rows = rows.withColumn("total_capacity", total).withColumn("slot_sod", F.col("_slot") * F.col("_seconds"))
    return rows.select("test_id", "test_code", "slot_date", hms("slot_sod").alias("slot_time"), "slot_sod",
                       "total_capacity", "booked_count",
                       (F.col("total_capacity") - F.col("booked_count")).alias("available_count"))


def lab_capacity(lab_bookings: DataFrame, lab_tests: DataFrame) -> DataFrame:
    """Day-level availability = daily_capacity - live bookings (not cancelled)."""
    agg = lab_bookings.where(F.col("booking_status") != "cancelled").groupBy(
        F.col("appointment_date").alias("slot_date"), "test_id").agg(
        F.count(F.lit(1)).alias("booked_count"))
    tests = (lab_tests.select("test_id", "test_code",
                                         F.col("daily_capacity").alias("total_capacity")))
    return agg.join(tests, "test_id").withColumn(
        "available_count", F.col("total_capacity") - F.col("booked_count"))


def queue_totals(live: DataFrame, worklist: DataFrame, arrivals: DataFrame,
                 tokens: DataFrame) -> DataFrame:
    """Per (day, doctor) the four counters of the boards over all rows, and how
    many rows of the worklist and of the arrivals a screen shows."""
    from wardline.operators.queues import ARRIVALS_SHOWN, WORKLIST_SHOWN
    k = ["queue_date", "doctor_id"]
    names = ["total_in_queue", "total_waiting", "total_expected", "count"]
    parts = [df.select(*k, *[F.lit(1 if n == name else 0).alias(n) for n in names])
             for name, df in zip(names, (live, worklist, arrivals, tokens))]
    union = parts[0]
    for p in parts[1:]:
        union = union.unionByName(p)
    out = union.groupBy(*k).agg(*[F.sum(n).alias(n) for n in names])
    return out.withColumn("waiting_shown", F.least("total_waiting", F.lit(WORKLIST_SHOWN))) \
        .withColumn("expected_shown", F.least("total_expected", F.lit(ARRIVALS_SHOWN)))


def doctor_remaining(worklist: DataFrame) -> DataFrame:
    """Staff board counter -- the current patient is the consulting one,
    else the head of the worklist; remaining = max(0, total - (index + 1))."""
    g = worklist.groupBy("queue_date", "doctor_id").agg(
        F.count(F.lit(1)).alias("total"),
        F.min(F.when(F.col("status") == "consulting", F.col("position"))).alias("_cur"))
    idx = F.coalesce(F.col("_cur"), F.lit(1)) - 1
    rem = F.greatest(F.lit(0), F.col("total") - (idx + 1))
    text = (F.when(F.col("total") == 0, F.lit("No tokens in queue"))
            .when(rem <= 0, F.lit("Last patient in queue"))
            .otherwise(F.concat(rem.cast("string"), F.lit(" more token"),
                                F.when(rem != 1, F.lit("s")).otherwise(F.lit("")),
                                F.lit(" waiting"))))
    return g.select("queue_date", "doctor_id", "total", idx.alias("current_index"),
                    rem.alias("remaining"), text.alias("queue_status"))
