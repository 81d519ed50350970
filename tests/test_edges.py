"""The twelve edge rows of FIXTURES.md §3."""

import datetime as dt

from pyspark.sql import functions as F

from fixtures import DAY, booking, frames, hms, token
from wardline.functions.columns import seq3, wrap_sod, hms as hms_col
from wardline.operators import folds, queues


def _rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def test_walkin_with_prebooked_type_appears_twice(spark):                     # 1
    t, b = frames(spark, [token(1, "A001", token_type="walkin", type_="prebooked")], [])
    q = queues.live_queue(t, b)
    assert q.where(F.col("token_number") == "A001").count() == 2


def test_null_token_type_falls_back_to_type(spark):                           # 2
    t, b = frames(spark, [token(1, "A001", token_type=None, type_="walkin")], [])
    assert _rows(queues.live_queue(t, b), "token_type") == [("walkin",)]


def test_lowercase_pb_is_prebooked(spark):                                    # 3
    t, b = frames(spark, [token(1, "pb001", token_type="walkin", created=(12, 0)),
                          token(2, "A001", created=(8, 0))], [])
    q = queues.live_queue(t, b).orderBy("position")
    assert [r.token_number for r in q.collect()] == ["pb001", "A001"]


def test_cancelled_token_brings_booking_back(spark):                           # 4
    t, b = frames(spark, [token(1, "PB001", status="cancelled", token_type="prebooked", booking="PB001")],
                  [booking(1, "PB001", 1, (10, 0))])
    q = queues.live_queue(t, b)
    assert _rows(q, "token_number", "checkin_status") == [("PB001", "not_checked_in")]


def test_confirmed_booking_only_in_expected_arrivals(spark):                   # 5
    t, b = frames(spark, [], [booking(1, "PB001", 1, (10, 0), status="confirmed")])
    assert queues.live_queue(t, b).count() == 0
    assert _rows(queues.expected_arrivals(b, t), "token_number") == [("PB001",)]


def test_null_created_at_sorts_first(spark):                                  # 6
    t, b = frames(spark, [token(1, "PB002", token_type="prebooked", expected=hms(10), booking="PB002",
                                created=(9, 0))],
                  [booking(1, "PB001", 1, (10, 0))])
    q = queues.live_queue(t, b).orderBy("position")
    assert [r.token_number for r in q.collect()] == ["PB001", "PB002"]


def test_sequence_over_999_is_not_truncated(spark):                           # 7
    df = spark.createDataFrame([(999,), (1000,), (12345,)], "n int")
    assert [r[0] for r in df.select(seq3("A", "n")).collect()] == ["A999", "A1000", "A12345"]


def test_expected_time_wraps_over_midnight(spark):                            # 8
    df = spark.createDataFrame([(hms(23, 50), 3)], "s int, ahead int")
    got = df.select(hms_col(wrap_sod(F.col("s") + F.col("ahead") * 600))).collect()[0][0]
    assert got == "00:20:00"


def test_department_initial_collision_gives_equal_numbers(spark):             # 9
    from wardline.operators import numbering
    t, _ = frames(spark, [token(1, "x", department=1, created=(9, 0)),
                          token(2, "y", department=2, created=(9, 1))], [])
    dep = spark.createDataFrame([(1, "AFRICA"), (2, "ASIA")], "department_id int, _dn string")
    out = numbering.sequence_numbers(t.join(dep, "department_id"), ["department_id", "queue_date"],
                                     ["created_at", "id"], numbering.department_initial(F.col("_dn")))
    assert [r.issued_number for r in out.collect()] == ["A001", "A001"]


def test_second_consulting_completes_the_first(spark):                        # 10
    t, _ = frames(spark, [token(1, "A001"), token(2, "A002")], [])
    log = spark.createDataFrame(
        [(10, dt.datetime(2024, 1, 15, 10, 0), DAY, 1, "consulting"),
         (11, dt.datetime(2024, 1, 15, 10, 5), DAY, 2, "consulting")],
        "req_id long, ts timestamp_ntz, d date, token_id long, new_status string")
    out = dict((r.id, r.new_status) for r in folds.opd_status_fold(t, log).collect())
    assert out == {1: "completed", 2: "consulting"}


def test_neighbourhood_head_middle_tail_absent(spark):                        # 11
    t, b = frames(spark, [token(i, f"A{i:03d}", created=(9, i)) for i in range(1, 9)], [])
    q = queues.live_queue(t, b, scope="day")
    nb = queues.queue_neighbourhood(q, ["queue_date"])
    shown = {}
    for r in nb.collect():
        shown.setdefault(r.viewer_token, []).append(r.shown_position)
    assert sorted(shown["A001"]) == [1, 2, 3, 4, 5]        # head
    assert sorted(shown["A005"]) == [3, 4, 5, 6, 7]        # middle: start = pos - 3
    assert sorted(shown["A008"]) == [4, 5, 6, 7, 8]        # tail: shifted back
    assert "A999" not in shown                             # the view adds the head for absent viewers


def test_pharmacy_cancel_guard_vs_unguarded_opd_cancel(spark):               # 12
    ph = spark.createDataFrame([(1, "PH1-001", DAY, "completed"), (2, "PH1-002", DAY, "waiting")],
                               "id long, token_number string, queue_date date, status string")
    log = spark.createDataFrame(
        [(1, dt.datetime(2024, 1, 15, 10), DAY, 1, "", None), (2, dt.datetime(2024, 1, 15, 11), DAY, 2, "", None),
         (3, dt.datetime(2024, 1, 15, 12), DAY, 2, "", None)],
        "req_id long, ts timestamp_ntz, d date, token_id long, token_number string, reason string")
    out = {r.req_id: r for r in folds.cancel_pharmacy(ph, log).collect()}
    assert out[1].refusal == "Cannot cancel a completed token"
    assert out[2].accepted and out[2].cancellation_reason == "Cancelled by patient"
    assert out[3].refusal == "Token is already cancelled"
    t, b = frames(spark, [token(5, "A005", status="completed")], [])
    clog = spark.createDataFrame([(1, dt.datetime(2024, 1, 15, 10), DAY, 5, "", None, None, True)],
                                 "req_id long, ts timestamp_ntz, d date, token_id long, token string, "
                                 "booking_id string, reason string, notify boolean")
    c = folds.cancel_tokens(t, b, clog).collect()
    assert [(r.target, r.target_key, r.old_status) for r in c] == [("token", "5", "completed")]
