"""Lookup and fold rules on small hand-made tables."""

import datetime as dt

from pyspark.sql import functions as F

from replays import checkin
from fixtures import DAY, booking, frames, hms, token
from wardline.operators import folds, labels, lookups

TS = lambda h, m=0: dt.datetime(2024, 1, 15, h, m)


def _docs(spark):
    return spark.createDataFrame([(1, "Dr One", 1, "Block 1", None, "R101")],
                                 "id int, name string, department_id int, floor_block string, wing string, "
                                 "room_number string")


def _deps(spark):
    return spark.createDataFrame([(1, "ASIA")], "id int, name string")


def test_status_poll_steps(spark):
    t, b = frames(spark, [token(1, "A001", status="consulting"),
                          token(2, "PB009", token_type="prebooked", booking="PB009", status="cancelled")],
                  [booking(1, "PB007", 1, (10, 0), status="confirmed"),
                   booking(2, "PB009", 1, (11, 0), status="checked_in")])
    req = spark.createDataFrame(
        [(1, DAY, "a001", ""), (2, DAY, "", "pb007"), (3, DAY, "X1", "PB009"), (4, DAY, "", ""),
         (5, DAY, "ZZZ", "")], "req_id long, d date, token string, booking string")
    out = {r.req_id: r for r in lookups.token_status(req, t, b, _docs(spark), _deps(spark)).collect()}
    assert (out[1].status, out[1].step, out[1].floor_block, out[1].wing) == ("consulting", 1, "Block 1", "")
    assert (out[2].status, out[2].step, out[2].token_number, out[2].floor_block) == ("confirmed", 2, None, "")
    # booking found first (step 2) even though a token also carries it
    assert (out[3].status, out[3].step) == ("checked_in", 2)
    assert out[4].status is None
    assert (out[5].status, out[5].step) == ("not_found", None)


def test_admission_keys_and_messages(spark):
    t, _ = frames(spark, [token(1, "A001", phone="9000000001", patient_id=None),
                          token(2, "A002", phone="9000000002", patient_id=77)], [])
    lab = spark.createDataFrame([(5, "MRI-001", 1, "9000000001", None, DAY, "waiting")],
                                "token_id long, token_number string, test_id int, patient_phone string, "
                                "patient_id long, scheduled_date date, token_status string")
    tests = spark.createDataFrame([(1, "MRI Scan")], "test_id int, test_name string")
    act = lookups.active_tokens(t, lab, _docs(spark), tests)
    req = spark.createDataFrame([(1, DAY, None, "9000000001"), (2, DAY, 77, "x"), (3, DAY, None, "9111111111")],
                                "req_id long, d date, patient_id long, patient_phone string")
    out = {r.req_id: r for r in lookups.admission(lookups.active_token_lookup(req, act)).collect()}
    assert not out[1].allowed and out[1].existing_token == "A001"      # OPD before lab
    assert "You can only have one token at a time" in out[1].message
    assert not out[2].allowed and "from your account" in out[2].message
    assert out[3].allowed and out[3].message is None


def test_cancel_booking_and_lab_cancel(spark):
    t, b = frames(spark, [token(1, "PB003", token_type="prebooked", booking="PB003",
                                day=dt.date(2024, 1, 14))], [booking(1, "PB003", 1, (10, 0))])
    log = spark.createDataFrame([(1, TS(9), "pb003"), (2, TS(10), "PB003"), (3, TS(10), "PB999"), (4, TS(10), " ")],
                                "req_id long, ts timestamp_ntz, booking_id string")
    out = {r.req_id: (r.success, r.message) for r in folds.cancel_bookings(b, log).collect()}
    assert out == {1: (True, "Booking cancelled successfully"), 2: (True, "Booking cancelled"),
                   3: (True, "Booking cancelled"), 4: (False, "Booking ID is required")}
    hit = {(r.target, r.req_id) for r in folds.cancel_booking_targets(t, b, log).collect()}
    assert hit == {("booking", 1), ("token", 1)}                            # token of another day too
    lb = spark.createDataFrame([(8, "LB007", "booked"), (16, "LB015", "completed")],
                               "booking_id long, booking_code string, booking_status string")
    lt = spark.createDataFrame([(4, "LB007", "waiting")], "token_id long, token_number string, token_status string")
    llog = spark.createDataFrame([(1, TS(9), "lb007"), (2, TS(10), "LB007"), (3, TS(11), "LB015")],
                                 "req_id long, ts timestamp_ntz, booking_code string")
    got = sorted((r.target, r.target_key, r.req_id) for r in folds.cancel_lab_targets(lb, lt, llog).collect())
    assert got == [("booking", "LB007", 1), ("lab_token", "4", 1)]
    answers = {r.req_id: (r.success, r.message) for r in folds.cancel_lab(lb, llog).collect()}
    assert answers == {1: (True, "Lab booking cancelled successfully"),
                       2: (False, "Booking not found or already cancelled"),
                       3: (False, "Booking not found or already cancelled")}


def test_break_rules(spark):
    log = spark.createDataFrame(
        [(1, TS(8), DAY, 1, "end_break"), (2, TS(9), DAY, 1, "start_break"), (3, TS(10), DAY, 1, "end_break"),
         (4, TS(11), DAY, 1, "end_break"), (5, TS(9), DAY, 2, "start_break"), (6, TS(10), DAY, 3, "end_break")],
        "req_id long, ts timestamp_ntz, d date, doctor_id int, action string")
    out = {r.doctor_id: r for r in folds.break_state(log).collect()}
    assert out[1].status == "available" and out[1].break_end == TS(11)      # later end moves break_end
    assert out[2].status == "on_break" and out[2].break_end is None
    assert 3 not in out                                                   # end without a row: no-op
    doctors = spark.createDataFrame([(i,) for i in (1, 2, 3, 4)], "id int")
    day = {r.doctor_id: (r.status, r.is_on_break) for r in folds.break_state_on(doctors, log, DAY).collect()}
    assert day == {1: ("available", False), 2: ("on_break", True), 3: ("available", False), 4: ("available", False)}


def test_reschedule_chain_and_pharmacy_status_chain(spark):
    _, b = frames(spark, [], [booking(1, "PB001", 1, (10, 0))])
    log = spark.createDataFrame(
        [(1, TS(8), DAY, "PB001", "2024-01-17", "11:00:00"), (2, TS(9), DAY, "PB001", "2024-01-17", ""),
         (3, TS(10), DAY, "PB001", "2024-01-10", "")],
        "req_id long, ts timestamp_ntz, d date, booking_id string, new_date string, new_time string")
    t, _ = frames(spark, [token(7, "A001", booking="pb001"), token(8, "A002")], [])
    out = {r.req_id: r for r in folds.reschedule(b, log, t).collect()}
    assert out[1].token_time_updated and not out[2].token_time_updated
    assert not folds.reschedule(b, log, t.limit(0)).where("token_time_updated").count()
    assert [(r.token_id, r.new_time) for r in folds.reschedule_tokens(b, log, t).collect()] == [(7, "11:00:00")]
    assert out[1].success and (out[1].old_date, out[1].old_time) == (DAY, "10:00:00")
    assert not out[2].success and out[2].message == "No changes made to the appointment"
    assert out[3].message == "Cannot reschedule to a past date"
    ph = spark.createDataFrame([(1, "PH1-001", "waiting")], "id long, token_number string, status string")
    plog = spark.createDataFrame([(1, TS(8), 1, "processing"), (2, TS(9), 1, "bogus"), (3, TS(10), 1, "completed")],
                                 "req_id long, ts timestamp_ntz, token_id long, new_status string")
    got = {r.req_id: (r.old_status, r.accepted) for r in folds.pharmacy_status_fold(ph, plog).collect()}
    assert got == {1: ("waiting", True), 2: (None, False), 3: ("processing", True)}


def test_pharmacy_next_actions(spark):
    q = spark.createDataFrame(
        [(DAY, 1, 1, "processing", 1), (DAY, 1, 2, "waiting", 2), (DAY, 2, 3, "completed", 1),
         (DAY, 2, 4, "waiting", 2), (DAY, 2, 5, "waiting", 3), (DAY, 3, 6, "completed", 1)],
        "queue_date date, pharmacy_id int, id long, status string, position int")
    got = {r.pharmacy_id: (r.action, r.next_token_id) for r in labels.pharmacy_next(q).collect()}
    assert got == {1: ("busy", None), 2: ("call_next", 4), 3: ("empty", None)}


def test_lab_ahead_counts_all_active_tokens(spark):
    lab_tokens = spark.createDataFrame([(1, 1, DAY, "waiting"), (2, 1, DAY, "in_progress"), (3, 1, DAY, "completed")],
                                       "token_id long, test_id int, scheduled_date date, token_status string")
    lb = spark.createDataFrame(
        [(10, "LB010", 1, DAY, hms(9), "booked"), (11, "LB011", 1, DAY, hms(8), "booked"),
         (12, "LB012", 1, DAY, hms(10), "checked_in")],
        "booking_id long, booking_code string, test_id int, appointment_date date, appointment_sod int, "
        "booking_status string")
    tests = spark.createDataFrame([(1, "MRI", 45)], "test_id int, test_code string, duration_minutes int")
    got = {r.booking_code: r.people_ahead for r in lookups.lab_booking_ahead(lb, lab_tokens, tests).collect()}
    assert got == {"LB011": 2, "LB010": 3, "LB012": 4}


def test_dominance_count_matches_brute_force(spark):
    import random
    rnd = random.Random(7)
    rows = [(i, rnd.randint(0, 2), rnd.randint(0, 40), rnd.randint(0, 1), TS(8, rnd.randint(0, 59)))
            for i in range(300)]
    df = spark.createDataFrame(rows, "req_id long, g int, v int, w int, ts timestamp_ntz")
    got = {r.req_id: r.c for r in folds.dominance_count(df, ["g"], ["ts", "req_id"], "v", "w", "c").collect()}
    for rid, g, v, w, ts in rows:
        want = sum(1 for r2, g2, v2, w2, ts2 in rows
                   if g2 == g and (ts2, r2) < (ts, rid) and v2 < v and w2 == 1)
        assert got[rid] == want


def test_checkin_counts_earlier_confirmed_checkins(spark):
    bks = [booking(1, "PB001", 1, (10, 0)), booking(2, "PB002", 1, (10, 30)),
           booking(3, "PB003", 1, (11, 0), status="confirmed"), booking(4, "PB004", 1, (11, 30))]
    t, b = frames(spark, [], bks)
    docs = spark.createDataFrame([(1, "Dr One", 1)], "id int, name string, department_id int")
    log = spark.createDataFrame([(1, TS(9), DAY, "PB003"), (2, TS(9, 5), DAY, "PB004")],
                                "req_id long, ts timestamp_ntz, d date, booking_id string")
    out = {r.req_id: r.patients_ahead for r in checkin(spark, b, t, docs, log).collect()}
    # PB003 was confirmed (not counted as booked); once checked in it is a token ahead of PB004
    assert out == {1: 2, 2: 3}


def test_checkin_refuses_a_patient_with_an_active_token(spark):
    bks = [booking(1, "PB001", 1, (10, 0)), booking(2, "PB002", 1, (10, 30)), booking(3, "PB003", 1, (11, 0))]
    phone = {r[1]: r[3] for r in bks}
    held = [token(7, "A007", phone=phone["PB001"]), token(8, "A008", status="completed", phone=phone["PB002"]),
            token(9, "A009", status="consulting", patient_id=5)]
    t, b = frames(spark, held, bks)
    docs = spark.createDataFrame([(1, "Dr One", 1)], "id int, name string, department_id int")
    log = spark.createDataFrame(
        [(1, TS(9), DAY, "PB001", None), (2, TS(9, 1), DAY, "PB002", None), (3, TS(9, 2), DAY, "PB003", 5),
         (4, TS(9, 3), DAY, "PB001", 6), (5, TS(9, 4), DAY, "PB001", 7)],
        "req_id long, ts timestamp_ntz, d date, booking_id string, patient_id long")
    out = {r.req_id: (r.accepted, r.reason) for r in checkin(spark, b, t, docs, log).collect()}
    assert out[1] == (False, "You already have an active OPD consultation token (A007). You can only have one token at a "
                             "time. Please complete, cancel, or wait for it to expire before checking in.")
    assert out[2][0] and out[4][0]      # an ended token does not block; another account may use the phone's booking
    assert out[3] == (False, "You already have an active OPD consultation token (A009) from your account. Only one token "
                             "per account is allowed. Please complete, cancel, or wait for it to expire before checking in.")
    assert out[5] == (False, "Invalid or expired booking")
