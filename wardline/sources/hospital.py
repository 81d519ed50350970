"""Domain tables derived from the driver's input tables (FIXTURES.md §4).

The application works on departments, doctors, OPD tokens, bookings, lab and
pharmacy tables.  The test inputs are a star schema plus an ``events`` stream,
so every domain table is a deterministic projection of them:

* dimensions come from ``region`` / ``supplier`` / ``nation`` / ``customer``
  and one fixed lookup list (the four lab tests of the application seed);
* stored facts (tokens, bookings, lab and pharmacy tokens) share out
  ``events`` by ``event_id``; the request logs hold every event, as the
  request kind or kinds that its type stands for.  All grow with the input.

Everything is lazy; nothing is collected.  Token numbers are per-group row
numbers over (department, day) / (test, day) / (pharmacy, day), computed by
``wardline.operators.ranking`` (skew-safe for hot groups).
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wardline.functions.columns import seq3, sod
from wardline.operators.ranking import number_rows
from wardline.sources.driver import read_table

# Fixed lookup values of the application seed: lab tests
# (test_id, test_code, test_name, duration_minutes, fee, slot_duration,
#  daily_capacity, advance_booking_days).
LAB_TESTS = [
    (1, "MRI", "MRI Scan", 45, 8000, 45, 12, 21),
    (2, "CT", "CT Scan", 25, 5000, 30, 16, 14),
    (3, "BT", "Blood Test", 10, 500, 10, 50, 7),
    (4, "XR", "X-Ray", 15, 800, 15, 30, 7),
]

_LAB_TEST_SCHEMA = T.StructType([
    T.StructField("test_id", T.IntegerType()),
    T.StructField("test_code", T.StringType()),
    T.StructField("test_name", T.StringType()),
    T.StructField("duration_minutes", T.IntegerType()),
    T.StructField("fee", T.IntegerType()),
    T.StructField("slot_duration", T.IntegerType()),
    T.StructField("daily_capacity", T.IntegerType()),
    T.StructField("advance_booking_days", T.IntegerType()),
])


N_PHARMACIES = 25  # rows of ``nation``

# Tokens that a replayed log issues have ids of their own, beyond those of the stored tokens.
ISSUED_ID_BASE = 1_000_000_000_000


# Tables whose rows are one event each, with their day column.
ROUTED = {"status_log": "d", "break_log": "d", "lookup_log": "d", "cancel_log": "d", "booking_cancel_log": "d",
          "reschedule_log": "d", "lab_cancel_log": "d", "pharmacy_cancel_log": "d", "pharmacy_status_log": "d",
          "lab_status_log": "d", "checkin_log": "d", "issued_log": "d", "pharmacy_issue_log": "d",
          "prebooked_lab_appointments": "appointment_date"}


def _status(mapping: dict[str, str], default: str) -> F.Column:
    """``CASE event_type WHEN k THEN v ... ELSE default END``."""
    expr = None
    for k, v in mapping.items():
        expr = (F.when(F.col("event_type") == k, v) if expr is None
                else expr.when(F.col("event_type") == k, v))
    return expr.otherwise(default)


def _phone(user_id: str = "user_id") -> F.Column:
    return F.concat(F.lit("9"), F.format_string("%09d", F.col(user_id) + 1))


def _patient_name() -> F.Column:
    return F.concat(F.lit("Patient "), (F.col("user_id") + 1).cast("string"))


def with_day(events: DataFrame) -> DataFrame:
    """Events with their day ``d``, with seconds of day and an 8-event block id."""
    return events.select(
        "event_id", "ts", "user_id", "event_type", "value", "d",
        sod("ts").alias("sod"),
        F.floor(F.col("event_id") / 8).cast("bigint").alias("m"),
    )


class Hospital:
    """Lazy domain tables over one input directory."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir

    # -- inputs -----------------------------------------------------------
    @cached_property
    def events(self) -> DataFrame:
        """``events`` with business day, seconds of day and an 8-event block id."""
        e = read_table(self.spark, self.sf_dir, "events").select(
            "event_id", "ts", "user_id", "event_type", "value")
        return with_day(e.withColumn("d", F.to_date("ts")))

    def _route(self, taken: F.Column | None, *columns) -> DataFrame:
        """A table whose rows are one event each: those that are ``taken`` (None: all), as ``columns``."""
        rows = self.events if taken is None else self.events.where(taken)
        return rows.select(*columns)

    def routed_types(self) -> dict[str, T.DataType]:
        """Columns of the routed rows; text where tables differ in a column's type."""
        types: dict[str, T.DataType] = {}
        for name, day in ROUTED.items():
            for f in getattr(self, name).schema.fields:
                if f.name != day:
                    types[f.name] = f.dataType if types.get(f.name, f.dataType) == f.dataType else T.StringType()
        return types

    def routed_rows(self) -> DataFrame:
        """(log, day, and the columns of all of ``ROUTED``): the rows of every table in ``ROUTED`` from one scan of
        the events.  A column that a table lacks is null; its day column is left to ``day``."""
        rules, types, rows = _Rules(self.spark, self.sf_dir), self.routed_types(), []
        for name, day in ROUTED.items():
            taken, columns = getattr(rules, name)
            own = dict(zip(getattr(self, name).columns, columns))
            fields = [(F.col(own[c]) if isinstance(own[c], str) else own[c]) if c in own and c != day else F.lit(None)
                      for c in types]
            row = F.struct(F.lit(name).alias("log"), *[c.cast(t).alias(n) for c, (n, t) in zip(fields, types.items())])
            rows.append(row if taken is None else F.when(taken, row))
        return self.events.select(F.col("d").alias("day"), F.explode(F.array_compact(F.array(*rows))).alias("r")).select(
            "r.log", "day", *[f"r.{c}" for c in types])

    # -- dimensions (bounded) -------------------------------------------
    @cached_property
    def departments(self) -> DataFrame:
        r = read_table(self.spark, self.sf_dir, "region")
        return r.select(
            (F.col("r_regionkey") + 1).cast("int").alias("id"),
            F.col("r_name").alias("name"),
            F.concat(F.lit("Care unit "), (F.col("r_regionkey") + 1).cast("string")).alias("description"),
        )

    @cached_property
    def doctors(self) -> DataFrame:
        s = read_table(self.spark, self.sf_dir, "supplier").select("s_suppkey", "s_name", "s_nationkey")
        n = read_table(self.spark, self.sf_dir, "nation").select("n_nationkey", "n_regionkey")
        k = F.col("s_suppkey")
        return s.join(n, s.s_nationkey == n.n_nationkey).select(
            (k + 1).cast("int").alias("id"),
            F.col("s_name").alias("name"),
            (F.col("n_regionkey") + 1).cast("int").alias("department_id"),
            (F.lit(300) + F.lit(50) * (k % 8)).cast("int").alias("fees"),
            F.when(k % 5 == 4, F.lit(None).cast("string"))
             .otherwise(F.concat(F.lit("Block "), (k % 5).cast("string"))).alias("floor_block"),
            F.when(k % 3 == 0, F.lit("East")).when(k % 3 == 1, F.lit("West"))
             .otherwise(F.lit(None).cast("string")).alias("wing"),
            F.when(k % 7 == 3, F.lit(""))
             .otherwise(F.concat(F.lit("R"), (F.lit(100) + k % 40).cast("string"))).alias("room_number"),
            (k % 6 != 5).alias("available"),
        )

    @cached_property
    def lab_tests(self) -> DataFrame:
        return self.spark.createDataFrame(LAB_TESTS, _LAB_TEST_SCHEMA)

    @cached_property
    def pharmacies(self) -> DataFrame:
        """Pharmacies, one per nation; every sixth is inactive."""
        n = read_table(self.spark, self.sf_dir, "nation")
        k = F.col("n_nationkey")
        return n.select(
            (k + 1).cast("int").alias("id"),
            F.concat(F.col("n_name"), F.lit(" Pharmacy")).alias("name"),
            F.substring(F.lit("ABCDE"), (k % 5 + 1).cast("int"), 1).alias("block"),
            (k % 4).cast("string").alias("floor"),
            F.when(F.col("n_regionkey") == 0, "East").when(F.col("n_regionkey") == 1, "West")
             .when(F.col("n_regionkey") == 2, "North").when(F.col("n_regionkey") == 3, "South")
             .otherwise("Central").alias("wing"),
            (k % 6 != 5).alias("is_active"),
            F.when(k % 3 == 0, F.lit(None).cast("string"))
             .otherwise(F.concat(F.lit("Cash "), (k % 3).cast("string"))).alias("cash_counter"),
            F.when(k % 4 == 1, F.lit(None).cast("string"))
             .otherwise(F.concat(F.lit("Online "), (k % 4).cast("string"))).alias("online_counter"),
        )

    @cached_property
    def n_doctors(self) -> int:
        """How many doctors share the patients (one number, from the table's footers)."""
        return max(1, read_table(self.spark, self.sf_dir, "supplier").count())

    # -- facts --------------------------------------------------------------
    @cached_property
    def tokens(self) -> DataFrame:
        """OPD tokens: even events; numbers ``{initial}{nnn}`` per department and day."""
        ev = self.events.where(F.col("event_id") % 2 == 0)
        eid = F.col("event_id")
        t0 = ev.select(
            (eid + 1).cast("bigint").alias("id"),
            "event_id",
            ((eid + F.col("user_id")) % self.n_doctors + 1).cast("int").alias("doctor_id"),
            F.when(eid % 3 == 0, F.lit(None).cast("bigint"))
             .otherwise((F.col("user_id") + 1).cast("bigint")).alias("patient_id"),
            _patient_name().alias("patient_name"),
            _phone().alias("patient_phone"),
            F.col("ts").alias("created_at"),
            F.col("d").alias("queue_date"),
            F.col("sod").alias("created_sod"),
            _status({"purchase": "completed", "error": "cancelled", "signup": "consulting"},
                    "waiting").alias("status"),
            F.when(eid % 12 == 0, "prebooked").when(eid % 14 == 2, "review")
             .when(eid % 22 == 6, F.lit(None).cast("string")).otherwise("walkin").alias("token_type"),
            F.when(eid % 26 == 4, "prebooked").otherwise("walkin").alias("type"),
            F.when(eid % 10 == 0, F.lit(None).cast("int"))
             .otherwise(((F.col("sod") + 600 * (eid % 5)) % 86400).cast("int")).alias("expected_sod"),
        )
        doc = self.doctors.select(F.col("id").alias("doctor_id"), "department_id")
        dep = self.departments.select(F.col("id").alias("department_id"),
                                      F.col("name").alias("_dep_name"))
        t = t0.join(doc, "doctor_id").join(dep, "department_id")
        t = number_rows(t, ["department_id", "queue_date"], ["created_at", "id"], "_seq")
        pb = F.col("token_type") == "prebooked"
        pb_number = seq3("PB", F.col("event_id") + 1)
        return t.select(
            "id", "event_id", "doctor_id", "department_id", "patient_id", "patient_name",
            "patient_phone", "created_at", "queue_date", "created_sod", "status",
            "token_type", "type", "expected_sod",
            F.when(pb, pb_number).alias("booking_id"),
            F.when(pb, pb_number).otherwise(
                seq3(F.upper(F.substring("_dep_name", 1, 1)), F.col("_seq"))).alias("token_number"),
        )

    @cached_property
    def prebooked_appointments(self) -> DataFrame:
        """OPD bookings: events with ``event_id % 4 = 1``; 15-minute slots."""
        ev = self.events.where(F.col("event_id") % 4 == 1)
        eid = F.col("event_id")
        b = ev.select(
            (eid + 1).cast("bigint").alias("id"),
            seq3("PB", eid).alias("booking_id"),
            ((eid - 1 + F.col("user_id")) % self.n_doctors + 1).cast("int").alias("doctor_id"),
            _patient_name().alias("patient_name"),
            _phone().alias("patient_phone"),
            F.col("d").alias("appointment_date"),
            (F.col("sod") - F.col("sod") % 900).cast("int").alias("appointment_sod"),
            _status({"purchase": "checked_in", "error": "cancelled", "signup": "confirmed"},
                    "booked").alias("status"),
            F.col("ts").alias("created_at"),
        )
        doc = self.doctors.select(F.col("id").alias("doctor_id"), "department_id")
        return b.join(doc, "doctor_id", "left")

    @cached_property
    def lab_tokens(self) -> DataFrame:
        """Lab tokens: ``event_id % 8 = 3``; numbers ``{code}-{nnn}`` per test and day."""
        ev = self.events.where(F.col("event_id") % 8 == 3)
        eid, m = F.col("event_id"), F.col("m")
        lt = self.lab_tests.select("test_id", "test_code")
        t = ev.join(lt, (m % 4 + 1) == lt.test_id).select(
            (eid + 1).cast("bigint").alias("token_id"),
            "event_id", "test_id", "test_code",
            _patient_name().alias("patient_name"),
            (F.col("user_id") + 1).cast("bigint").alias("patient_id"),
            _phone().alias("patient_phone"),
            F.when(m % 3 == 0, "prebooked").otherwise("walkin").alias("patient_type"),
            F.when(m % 3 == 0, (eid + 5).cast("bigint")).alias("booking_id"),
            F.col("d").alias("scheduled_date"),
            F.when(m % 5 == 0, F.lit(None).cast("int")).otherwise(F.col("sod")).alias("scheduled_sod"),
            F.col("ts").alias("created_at"),
            _status({"purchase": "completed", "error": "cancelled", "signup": "in_progress"},
                    "waiting").alias("token_status"),
        )
        t = number_rows(t, ["test_id", "scheduled_date"], ["created_at", "event_id"], "_seq")
        return t.withColumn("token_number", seq3(F.concat(F.col("test_code"), F.lit("-")), "_seq")) \
                .withColumnRenamed("_seq", "queue_position").drop("test_code")

    @cached_property
    def prebooked_lab_appointments(self) -> DataFrame:
        """Lab bookings: ``event_id % 8 = 7``."""
        eid = F.col("event_id")
        return self._route(
            eid % 8 == 7, 
            (eid + 1).cast("bigint").alias("booking_id"),
            seq3("LB", eid).alias("booking_code"),
            (F.col("m") % 4 + 1).cast("int").alias("test_id"),
            _patient_name().alias("patient_name"),
            _phone().alias("patient_phone"),
            F.col("d").alias("appointment_date"),
            (F.col("sod") - F.col("sod") % 900).cast("int").alias("appointment_sod"),
            F.col("ts").alias("created_at"),
            _status({"purchase": "completed", "error": "cancelled", "signup": "checked_in"},
                    "booked").alias("booking_status"),
        )

    @cached_property
    def pharmacy_tokens(self) -> DataFrame:
        """Pharmacy tokens: ``event_id % 3 = 0``; numbers ``PH{id}-{nnn}`` per pharmacy and day."""
        ev = self.events.where(F.col("event_id") % 3 == 0)
        eid = F.col("event_id")
        t = ev.select(
            (eid + 1).cast("bigint").alias("id"),
            "event_id",
            (F.col("user_id") % N_PHARMACIES + 1).cast("int").alias("pharmacy_id"),
            _patient_name().alias("patient_name"),
            _phone().alias("patient_phone"),
            F.col("ts").alias("created_at"),
            F.col("d").alias("queue_date"),
            F.col("sod").alias("created_sod"),
            F.when(eid % 2 == 0, "cash").otherwise("online").alias("payment_method"),
            _status({"purchase": "completed", "error": "cancelled", "signup": "processing"},
                    "waiting").alias("status"),
        )
        t = number_rows(t, ["pharmacy_id", "queue_date"], ["created_at", "event_id"], "_seq")
        return t.withColumn(
            "token_number",
            seq3(F.concat(F.lit("PH"), F.col("pharmacy_id").cast("string"), F.lit("-")), "_seq"),
        ).drop("_seq")

    # -- request logs (inputs of the replay folds) -------------------------
    @cached_property
    def status_log(self) -> DataFrame:
        """OPD status-change requests against earlier tokens."""
        target = F.floor(F.col("event_id") / 2).cast("bigint") * 2 + 1 - 2 * (F.col("m") % 5)
        return self._route(target >= 1, 
            F.col("event_id").alias("req_id"), "ts", "d",
            target.cast("bigint").alias("token_id"),
            _status({"view": "waiting", "purchase": "completed", "error": "cancelled"},
                    "consulting").alias("new_status"),
        )

    @cached_property
    def break_log(self) -> DataFrame:
        """Doctor break requests: start on signup, end on purchase."""
        return self._route(
            F.col("event_type").isin("signup", "purchase"), 
            F.col("event_id").alias("req_id"), "ts", "d",
            (F.col("user_id") % self.n_doctors + 1).cast("int").alias("doctor_id"),
            F.when(F.col("event_type") == "signup", "start_break").otherwise("end_break").alias("action"),
        )

    # -- more request logs (one per write endpoint) -------------------------
    # Every event is a lookup, a cancel, a reschedule and so on: each log has a row for each event.  Ids point at
    # rows near the event: ``_booking`` at an OPD booking, 8 m + 7 at a lab booking.
    @property
    def _booking(self) -> F.Column:
        return F.floor(F.col("event_id") / 4).cast("bigint") * 4 + 1

    @cached_property
    def lookup_log(self) -> DataFrame:
        """Read-side lookups: active-token checks, booking verification, status polls."""
        e, m, booking = F.col("event_id"), F.col("m"), self._booking
        return self._route(None, 
            F.col("event_id").alias("req_id"), "ts", "d",
            F.when(e % 3 == 0, (F.col("user_id") + 1).cast("bigint")).alias("patient_id"),
            _phone().alias("patient_phone"),
            F.concat(F.when(m % 4 == 0, "pb").otherwise("PB"),
                     F.format_string("%03d", booking - 4 * (m % 3))).alias("booking_id"),
            F.concat(F.when(m % 5 == 0, " lb").otherwise("LB"),
                     F.format_string("%03d", 8 * m + 7)).alias("lab_code"),
            F.when(m % 3 == 0, seq3("PB", booking))
             .when(m % 3 == 1, seq3("a", m % 30 + 1)).otherwise(F.lit("")).alias("token"),
        )

    @cached_property
    def cancel_log(self) -> DataFrame:
        """OPD cancel requests: by token id, by token/booking number, or by walk-in number."""
        m, booking = F.col("m"), self._booking
        token = F.floor(F.col("event_id") / 2).cast("bigint") * 2 - 3
        return self._route(None, 
            F.col("event_id").alias("req_id"), "ts", "d",
            F.when(m % 3 == 0, token).otherwise(F.lit(0).cast("bigint")).alias("token_id"),
            F.when(m % 3 == 0, F.lit("")).when(m % 3 == 1, seq3(" pb", booking - 4))
             .otherwise(seq3("A", m % 40 + 1)).alias("token"),
            F.when(m % 4 == 2, seq3("PB", booking - 8)).alias("booking_id"),
            F.when(F.col("event_type") == "error", F.lit("at patient request")).alias("reason"),
            (F.col("event_type") != "view").alias("notify"),
        )

    @cached_property
    def booking_cancel_log(self) -> DataFrame:
        return self._route(None, 
            F.col("event_id").alias("req_id"), "ts", "d",
            seq3(F.when(F.col("m") % 3 == 0, F.lit("pb")).otherwise(F.lit("PB")), self._booking - 8).alias("booking_id"))

    @cached_property
    def reschedule_log(self) -> DataFrame:
        m, s = F.col("m"), F.col("sod")
        et = F.col("event_type")
        minute = (s / 60).cast("int") % 60
        return self._route(None, 
            F.col("event_id").alias("req_id"), "ts", "d",
            seq3("PB", self._booking).alias("booking_id"),
            F.when(et == "error", F.regexp_replace(F.col("d").cast("string"), "-", "/"))
             .when(et == "click", F.date_sub("d", 1).cast("string"))
             .when(et == "signup", F.lit(""))
             .when(et == "view", F.col("d").cast("string"))
             .otherwise(F.date_add("d", 2).cast("string")).alias("new_date"),
            F.when(m % 3 == 0, F.lit(""))
             .when(m % 3 == 1, F.format_string("%02d:%02d:00", ((s / 3600).cast("int") + 1) % 24,
                                               minute - (s / 60).cast("int") % 15))
             .otherwise(F.lit("9:30")).alias("new_time"),
        )

    @cached_property
    def lab_cancel_log(self) -> DataFrame:
        m = F.col("m")
        return self._route(None, 
            F.col("event_id").alias("req_id"), "ts", "d",
            seq3(F.when(m % 2 == 0, F.lit("lb")).otherwise(F.lit("LB")), 8 * m - 1).alias("booking_code"))

    @cached_property
    def pharmacy_cancel_log(self) -> DataFrame:
        m = F.col("m")
        by_number = m % 4 == 3
        token = F.floor(F.col("event_id") / 3).cast("bigint") * 3 + 1
        return self._route(None, 
            F.col("event_id").alias("req_id"), "ts", "d",
            F.when(by_number, F.lit(0).cast("bigint")).otherwise(token - 3 * (m % 3)).alias("token_id"),
            F.when(by_number, seq3(F.concat(F.lit("PH"), (F.col("user_id") % N_PHARMACIES + 1).cast("string"),
                                            F.lit("-")), m % 50 + 1)).otherwise(F.lit("")).alias("token_number"),
            F.when(F.col("event_type") != "error", F.lit("Patient left")).alias("reason"),
        )

    @cached_property
    def pharmacy_status_log(self) -> DataFrame:
        m, token = F.col("m"), F.floor(F.col("event_id") / 3).cast("bigint") * 3 + 1
        return self._route(None, 
            F.col("event_id").alias("req_id"), "ts", "d",
            (token - 3 * (m % 4)).alias("token_id"),
            _status({"view": "processing", "purchase": "completed", "error": "cancelled",
                     "click": "waiting"}, "ready").alias("new_status"),
        )

    @cached_property
    def lab_status_log(self) -> DataFrame:
        m = F.col("m")
        return self._route(None, 
            F.col("event_id").alias("req_id"), "ts", "d",
            (8 * m + 4 - 8 * (m % 3)).alias("token_id"),
            _status({"view": "in_progress", "purchase": "completed", "error": "cancelled",
                     "click": "waiting"}, "no_show").alias("new_status"),
        )

    # Every event asks for one token: clicks and views for a walk-in visit, signups and purchases for a lab test,
    # errors for the check-in of a booking.  Large values come from patients who are logged in; a click is made on
    # the phone that a patient shares with another one.
    @property
    def _account(self) -> F.Column:
        return F.when(F.col("value") >= 20, (F.col("user_id") + 1).cast("bigint"))

    def _asks(self, *types: str) -> DataFrame:
        return self.events.where(F.col("event_type").isin(*types))

    @cached_property
    def checkin_log(self) -> DataFrame:
        m = F.col("m")
        return self._route(F.col("event_type") == "error", 
            F.col("event_id").alias("req_id"), "ts", "d", self._account.alias("patient_id"),
            seq3(F.when(m % 5 == 1, F.lit("pb")).otherwise(F.lit("PB")), self._booking - 4 * (m % 2))
            .alias("booking_id"))

    @cached_property
    def opd_issue_log(self) -> DataFrame:
        """Walk-in issue requests (department text and/or doctor)."""
        e = F.col("event_id")
        ev = self._asks("click", "view").withColumn(
            "_doc", ((e + F.col("user_id")) % self.n_doctors + 1).cast("int"))
        doc = self.doctors.select(F.col("id").alias("_doc"), F.col("department_id").alias("_dep"))
        dep = self.departments.select(F.col("id").alias("_dep"), F.col("name").alias("_dname"))
        j = ev.join(doc, "_doc", "left").join(dep, "_dep", "left")
        shared = F.concat(F.lit("9"), F.format_string("%09d", F.col("user_id") - F.col("user_id") % 2 + 1))
        return j.select(
            F.col("event_id").alias("req_id"), "ts", "d",
            F.when(e % 11 == 5, F.lit(0)).otherwise(F.col("_doc")).cast("int").alias("doctor_id"),
            F.when(e % 7 == 0, F.lit("")).when(e % 7 == 1, F.lower("_dname"))
             .when(e % 7 == 2, F.lit("Cardiology")).otherwise(F.col("_dname")).alias("department"),
            _patient_name().alias("patient_name"), self._account.alias("patient_id"),
            F.when(e % 31 == 0, F.lit("")).when(F.col("event_type") == "click", shared).otherwise(_phone())
            .alias("patient_phone"),
        )

    @cached_property
    def lab_issue_log(self) -> DataFrame:
        e, m = F.col("event_id"), F.col("m")
        lt = self.lab_tests.select(F.col("test_id").alias("_t"), F.col("test_code").alias("_c"))
        j = self._asks("purchase", "signup").join(lt, (m % 4 + 1) == lt._t)
        u = F.col("user_id")
        return j.select(
            F.col("event_id").alias("req_id"), "ts", "d",
            F.when(m % 7 == 0, F.lit("ecg")).when(m % 7 == 1, F.lower("_c"))
             .when(m % 7 == 2, F.concat(F.lit(" "), F.col("_c"), F.lit(" "))).otherwise(F.col("_c"))
             .alias("test_code"),
            F.when(e % 13 == 0, F.lit("")).otherwise(_patient_name()).alias("patient_name"),
            F.when(e % 17 == 0, F.lit(0)).otherwise(18 + u % 60).cast("int").alias("patient_age"),
            F.when(u % 4 == 0, "Male").when(u % 4 == 1, "female").when(u % 4 == 2, "x")
             .otherwise("").alias("patient_gender"),
            self._account.alias("patient_id"), _phone().alias("patient_phone"),
            F.when(m % 2 == 0, F.lit(0)).otherwise(100 * (m % 7)).cast("int").alias("payment_amount"),
        )

    @cached_property
    def issued_log(self) -> DataFrame:
        """Status changes of tokens that the logs above issue; ``lab_status`` is the word of the lab for it."""
        return self._route(None, 
            F.col("event_id").alias("req_id"), "ts", "d",
            (F.lit(ISSUED_ID_BASE) + F.col("event_id") - 1 - F.col("m") % 6).alias("token_id"),
            _status({"view": "waiting", "signup": "consulting", "error": "cancelled"}, "completed").alias("new_status"),
            _status({"view": "waiting", "signup": "in_progress", "error": "cancelled"}, "completed").alias("lab_status"))

    @cached_property
    def pharmacy_issue_log(self) -> DataFrame:
        e = F.col("event_id")
        return self._route(None, 
            F.col("event_id").alias("req_id"), "ts", "d",
            F.when(e % 19 == 0, F.lit(6)).when(e % 23 == 0, F.lit(0))
             .otherwise(F.col("user_id") % N_PHARMACIES + 1).cast("int").alias("pharmacy_id"),
            F.when(e % 29 == 0, F.lit("")).otherwise(_patient_name()).alias("patient_name"),
            _phone().alias("patient_phone"),
            F.when(e % 2 == 0, "cash").otherwise("online").alias("payment_method"),
        )

    @cached_property
    def body_log(self) -> DataFrame:
        """JSON bodies as clients send them: the number k of every event's ``props`` put into a request of the kind
        that type and value stand for; some are cut off, some have wrong types, some are the props themselves."""
        e = read_table(self.spark, self.sf_dir, "events").select(
            "event_id", "ts", F.to_date("ts").alias("d"), "event_type", "props",
            F.coalesce(F.col("value") < 10, F.lit(False)).alias("small"),
            F.coalesce(F.get_json_object("props", "$.k").try_cast("int"), F.lit(0)).alias("k"))
        k = F.col("k").cast("string")

        def pick(yes: str, no: str) -> F.Column:
            return F.when(F.col("small"), yes).otherwise(no)

        kind = (F.when(F.col("event_type") == "view", F.when(F.col("k") < 50, pick("verify", "checkin")).otherwise("lab_verify"))
                .when(F.col("event_type") == "click", pick("reschedule", "break"))
                .when(F.col("event_type") == "error", pick("lab_cancel", "pharmacy_cancel"))
                .when(F.col("event_type") == "purchase", pick("pharmacy_status", "opd_status")).otherwise("booking_cancel"))
        form = F.col("k") % 6
        booking = (F.when(form == 0, F.concat(F.lit('"booking_id": " pb'), k, F.lit('"')))
                   .when(form == 1, F.concat(F.lit('"booking_id": '), k))
                   .when(form == 2, F.concat(F.lit('"booking_id": {"id": '), k, F.lit("}")))
                   .otherwise(F.concat(F.lit('"booking_id": "PB'), k, F.lit('"'))))
        token = (F.when(form == 1, F.concat(F.lit('"token_id": "'), k, F.lit('abc"')))
                 .when(form == 2, F.lit('"token_id": [1, 2]')).otherwise(F.concat(F.lit('"token_id": '), k)))
        status = (F.when(F.col("k") % 4 == 0, F.lit('"status": "waiting"')).when(F.col("k") % 4 == 1, F.lit('"status": "ready"'))
                  .when(F.col("k") % 4 == 2, F.lit('"status": "completed"')).otherwise(F.lit('"status": null')))
        day = F.date_format("d", "yyyy-MM-dd")
        moved = (F.when(F.col("k") % 5 == 0, F.concat(F.lit('"new_date": "'), day, F.lit('"')))
                 .when(F.col("k") % 5 == 1, F.lit('"new_date": "2024/02/01"')).when(F.col("k") % 5 == 2, F.lit('"new_date": 20240201'))
                 .when(F.col("k") % 5 == 3, F.lit('"new_date": "2020-02-01"')).otherwise(F.lit('"new_date": "2024-03-01 "')))
        time = F.when(F.col("k") % 3 == 0, F.lit(', "new_time": "10:30:00"')).when(
            F.col("k") % 3 == 1, F.lit(', "new_time": "9:30"')).otherwise(F.lit(""))
        action = F.when(F.col("k") % 3 == 0, F.lit('"action": "start_break"')).when(
            F.col("k") % 3 == 1, F.lit('"action": "end_break"')).otherwise(F.lit('"action": "lunch"'))
        number = F.when(F.col("k") % 2 == 0, F.concat(F.lit('"token_number": "ph1-0'), k, F.lit('"'))).otherwise(
            F.lit('"reason": true'))
        inner = (F.when(kind == "reschedule", F.concat(booking, F.lit(", "), moved, time))
                 .when(kind == "break", F.concat(F.regexp_replace(token, "token_id", "doctor_id"), F.lit(", "), action))
                 .when(kind == "pharmacy_cancel", F.concat(token, F.lit(", "), number))
                 .when(kind.isin("pharmacy_status", "opd_status"), F.concat(token, F.lit(", "), status)).otherwise(booking))
        body = (F.when(form == 3, F.concat(F.lit("{"), inner)).when(F.col("k") % 10 == 4, F.col("props"))
                .otherwise(F.concat(F.lit("{"), inner, F.lit("}"))))
        return e.select(F.col("event_id").alias("req_id"), "ts", "d", kind.alias("kind"), body.alias("body"))

    # -- staff rosters (credentials are never loaded) --------------------------
    @cached_property
    def staff(self) -> DataFrame:
        """OPD staff: customers with a balance of 2,500 and more, or without one."""
        c = read_table(self.spark, self.sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey", "c_acctbal")
        k = F.col("c_custkey")
        role = F.when(k % 3 == 0, "doctor").when(k % 3 == 1, "nurse").otherwise("reception")
        return c.where(F.coalesce(F.col("c_acctbal") >= 2500, F.lit(True))).select(
            (k + 1).cast("int").alias("id"), F.col("c_name").alias("name"),
            F.concat(F.lower(F.regexp_replace("c_name", "#", ".")), F.lit("@clinic.test")).alias("email"),
            role.alias("role"),
            F.when(k % 7 == 0, F.lit(None).cast("int")).otherwise(F.col("c_nationkey") % 6 + 1)
             .cast("int").alias("dept_id"),
            F.when(role == "doctor", (k % 100 + 1).cast("int")).alias("doc_id"))

    @cached_property
    def pharmacy_staff(self) -> DataFrame:
        """Pharmacy staff: all other customers."""
        c = read_table(self.spark, self.sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey", "c_acctbal")
        k = F.col("c_custkey")
        return c.where(F.col("c_acctbal") < 2500).select(
            (k + 1).cast("int").alias("id"), F.concat(F.lit("PHS"), F.format_string("%04d", k)).alias("staff_id"),
            F.col("c_name").alias("name"), (F.col("c_nationkey") % 27 + 1).cast("int").alias("pharmacy_id"))


class _Rules(Hospital):
    """The rules of the routed tables instead of the tables."""

    def _route(self, taken, *columns):
        return taken, columns
