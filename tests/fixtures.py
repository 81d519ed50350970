"""Small hand-made domain tables for unit tests (FIXTURES.md §2-§3)."""

import datetime as dt

from pyspark.sql import types as T

DAY = dt.date(2024, 1, 15)

TOKEN_SCHEMA = T.StructType([
    T.StructField("id", T.LongType()), T.StructField("token_number", T.StringType()),
    T.StructField("patient_name", T.StringType()), T.StructField("patient_phone", T.StringType()),
    T.StructField("patient_id", T.LongType()), T.StructField("department_id", T.IntegerType()),
    T.StructField("doctor_id", T.IntegerType()), T.StructField("status", T.StringType()),
    T.StructField("type", T.StringType()), T.StructField("token_type", T.StringType()),
    T.StructField("expected_sod", T.IntegerType()), T.StructField("booking_id", T.StringType()),
    T.StructField("created_at", T.TimestampNTZType()), T.StructField("queue_date", T.DateType()),
    T.StructField("created_sod", T.IntegerType()),
])

BOOKING_SCHEMA = T.StructType([
    T.StructField("id", T.LongType()), T.StructField("booking_id", T.StringType()),
    T.StructField("patient_name", T.StringType()), T.StructField("patient_phone", T.StringType()),
    T.StructField("department_id", T.IntegerType()), T.StructField("doctor_id", T.IntegerType()),
    T.StructField("appointment_date", T.DateType()), T.StructField("appointment_sod", T.IntegerType()),
    T.StructField("status", T.StringType()), T.StructField("created_at", T.TimestampNTZType()),
])


def hms(h, m=0, s=0):
    return h * 3600 + m * 60 + s


def token(id, number, doctor=1, status="waiting", token_type="walkin", type_="walkin",
          expected=None, created=(9, 0), booking=None, department=1, day=DAY, phone=None, patient_id=None):
    created_at = dt.datetime.combine(day, dt.time(*created))
    return (id, number, f"Patient {id}", phone or f"9{id:09d}", patient_id, department, doctor, status,
            type_, token_type, expected, booking, created_at, day, hms(*created))


def booking(id, booking_id, doctor, at, status="booked", department=1, day=DAY):
    return (id, booking_id, f"Booked {id}", f"8{id:09d}", department, doctor, day, hms(*at), status,
            dt.datetime.combine(day, dt.time(8, 0)))


def seed_bookings():
    """Sixteen bookings of five doctors, all 'booked' today (seed layout)."""
    slots = {1: [(10, 0), (10, 30), (11, 0), (11, 30)], 2: [(10, 0), (10, 45), (11, 30)],
             3: [(9, 30), (10, 15), (11, 0)], 4: [(11, 0), (11, 30), (12, 0)],
             5: [(10, 0), (10, 30), (11, 0)]}
    rows, n = [], 0
    for doctor, times in slots.items():
        for t in times:
            n += 1
            rows.append(booking(n, f"PB{n:03d}", doctor, t, department=doctor))
    return rows


def frames(spark, tokens, bookings):
    return (spark.createDataFrame(tokens, TOKEN_SCHEMA), spark.createDataFrame(bookings, BOOKING_SCHEMA))
