"""Hand-derivable expectations from the seed data (FIXTURES.md §2)."""

from pyspark.sql import functions as F

from replays import checkin
from fixtures import DAY, booking, frames, hms, seed_bookings, token
from wardline.operators import folds, numbering, queues, stats


def _queue(spark, tokens, bookings, doctor=1):
    t, b = frames(spark, tokens, bookings)
    q = queues.live_queue(t, b, scope="doctor").where(F.col("doctor_id") == doctor)
    return [(r.position, r.token_number, r.checkin_status) for r in q.orderBy("position").collect()]


def test_seed_queue_orders_by_appointment_time(spark):
    got = _queue(spark, [], seed_bookings())
    assert got == [(1, "PB001", "not_checked_in"), (2, "PB002", "not_checked_in"),
                   (3, "PB003", "not_checked_in"), (4, "PB004", "not_checked_in")]


def test_early_checkin_keeps_slot_position(spark):
    # PB003 checks in first (09:00): it keeps position 3, ordered by its slot.
    tok = [token(100, "PB003", doctor=1, token_type="prebooked", expected=hms(11), booking="PB003",
                 created=(9, 0))]
    got = _queue(spark, tok, seed_bookings())
    assert [p for p, n, _ in got if n == "PB003"] == [3]
    assert [n for _, n, _ in got] == ["PB001", "PB002", "PB003", "PB004"]
    assert dict((n, c) for _, n, c in got)["PB003"] == "checked_in"


def test_consulting_first_then_prebooked_then_walkins(spark):
    tok = [token(1, "A001", created=(8, 0)), token(2, "A002", created=(8, 5), status="consulting"),
           token(3, "PB001", token_type="prebooked", expected=hms(10), booking="PB001", created=(9, 30))]
    got = _queue(spark, tok, seed_bookings()[:4])
    assert [n for _, n, _ in got] == ["A002", "PB001", "PB002", "PB003", "PB004", "A001"]


def test_lab_and_token_numbers_and_waits(spark):
    t, _ = frames(spark, [token(i, f"X{i}", created=(9, i)) for i in range(1, 4)], [])
    dep = spark.createDataFrame([(1, "ASIA")], "department_id int, _dn string")
    out = numbering.sequence_numbers(t.join(dep, "department_id"), ["department_id", "queue_date"],
                                     ["created_at", "id"], numbering.department_initial(F.col("_dn")))
    assert sorted(r.issued_number for r in out.collect()) == ["A001", "A002", "A003"]
    docs = spark.createDataFrame([(1, "Dr One", 1), (2, "Dr Two", 1)], "id int, name string, department_id int")
    w = stats.doctor_wait(docs, t, as_of=DAY).orderBy("doctor_id").collect()
    assert [(r.doctor_id, r.patients_waiting, r.wait_time) for r in w] == [(1, 3, 30), (2, 0, 0)]


def test_checkin_creates_token_with_slot_time(spark):
    import datetime as dt
    t, b = frames(spark, [], seed_bookings()[:4])
    docs = spark.createDataFrame([(1, "Dr One", 1)], "id int, name string, department_id int")
    log = spark.createDataFrame(
        [(1, dt.datetime(2024, 1, 15, 9, 0), DAY, "pb003"), (2, dt.datetime(2024, 1, 15, 9, 5), DAY, "PB003"),
         (3, dt.datetime(2024, 1, 15, 9, 10), DAY, "PB004")],
        "req_id long, ts timestamp_ntz, d date, booking_id string")
    out = {r.req_id: r for r in checkin(spark, b, t, docs, log).collect()}
    assert out[1].accepted and out[1].token_number == "PB003" and out[1].expected_time == "11:00:00"
    assert out[1].patients_ahead == 2          # PB001, PB002 still booked earlier
    assert not out[2].accepted                 # already checked in by request 1
    assert out[3].patients_ahead == 3          # PB001, PB002 booked + PB003's new token
