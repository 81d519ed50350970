"""JSON bodies of single requests."""

import datetime as dt

from wardline.operators import bodies


def _parse(spark, *rows):
    df = spark.createDataFrame([(i, k, dt.date(2024, 1, 10), b) for i, (k, b) in enumerate(rows)],
                               "req_id long, kind string, d date, body string")
    return [r.asDict() for r in bodies.parse_bodies(df).orderBy("req_id").collect()], df


def test_problems_and_complaints(spark):
    got, df = _parse(
        spark, ("checkin", '{"booking_id": " pb7 "}'), ("checkin", "{}"), ("checkin", '{"booking_id": "PB'), ("checkin", None),
        ("checkin", "[1]"), ("checkin", '{"booking_id": ["PB1"]}'), ("checkin", '{"booking_id": 0}'),
        ("break", '{"doctor_id": "3x", "action": "end_break", "booking_id": {}}'), ("break", '{"action": "end_break"}'),
        ("pharmacy_cancel", '{"token_id": 5}'), ("reschedule", '{"booking_id": "a", "new_date": "2024-01-09"}'),
        ("opd_status", '{"token_id": 4, "status": " waiting"}'))
    assert [(r["problem"], r["complaint"]) for r in got] == [
        (None, None), (None, "Booking ID is required"), (bodies.NOT_JSON, None), (bodies.NOT_JSON, None),
        (bodies.NOT_JSON, None), ("booking_id must be a text or a number", None), (None, "Booking ID is required"),
        (None, None), (None, "Doctor ID is required"), (None, None), (None, "Cannot reschedule to a past date"),
        (None, "Invalid status")]
    assert got[0]["booking_id"] == "PB7" and got[0]["token_id"] is None
    assert (got[7]["doctor_id"], got[7]["action"]) == (3, "end_break")
    assert (got[9]["token_number"], got[9]["token_id"], got[9]["reason"]) == ("", 5, "Cancelled by patient")
    parsed = bodies.parse_bodies(df)
    assert {r.req_id for r in bodies.rejects(parsed).collect()} == {2, 3, 4, 5}
    ok = bodies.accepted(parsed, "break")
    assert ok.columns == ["req_id", "d", "body", "doctor_id", "action"] and [r.req_id for r in ok.collect()] == [7]


def test_no_bodies(spark):
    assert _parse(spark, ("checkin", "{}"))[1].limit(0).transform(bodies.parse_bodies).count() == 0
