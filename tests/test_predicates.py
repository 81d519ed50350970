"""Predicate and tier builders."""

import datetime as dt

from pyspark.sql import functions as F

from fixtures import DAY, booking, frames, hms, token
from wardline.functions import predicates as P


def test_day_filter_and_optional_filters(spark):
    t, _ = frames(spark, [token(1, "A001", doctor=1), token(2, "A002", doctor=2),
                          token(3, "A003", doctor=2, day=dt.date(2024, 1, 16))], [])
    assert P.on_day(t, None).count() == 3
    assert P.on_day(t, DAY).count() == 2
    assert P.apply_filters(t, doctor_id=0, status="").count() == 3      # not set
    assert P.apply_filters(t, doctor_id=2, status="waiting").count() == 2


def test_active_and_valid_bookings(spark):
    t, b = frames(spark, [token(1, "A1", status="waiting"), token(2, "A2", status="completed")],
                  [booking(1, "PB001", 1, (10, 0), status="confirmed"),
                   booking(2, "PB002", 1, (10, 0), status="checked_in"),
                   booking(3, "PB003", 1, (10, 0), day=dt.date(2024, 1, 10))])
    assert t.where(P.is_active("opd")).count() == 1
    assert P.valid_bookings(b, "opd").count() == 2
    assert P.valid_bookings(b, "opd", as_of=DAY).count() == 1


def test_tiers_and_tags(spark):
    t, _ = frames(spark, [token(1, "A1", status="consulting"), token(2, "pb2", created=(9, 30)),
                          token(3, "R3", token_type="review", expected=hms(11)), token(4, "A4")], [])
    rows = {r.id: r for r in t.select(
        "id", P.tier_live().alias("a"), P.tier_worklist().alias("b"), P.tier_status().alias("c"),
        P.is_prebooked().alias("pb"), P.queue_time(P.is_prebooked()).alias("qt"),
        P.checkin_tag(True).alias("tag"), P.is_you("token_number", F.lit(" PB2 ")).alias("you")).collect()}
    assert (rows[1].a, rows[1].b, rows[1].c) == (0, 0, 1)
    assert (rows[2].a, rows[2].b, rows[2].pb, rows[2].you) == (1, 1, True, True)
    assert (rows[3].b, rows[3].qt) == (2, hms(9))
    assert (rows[4].a, rows[4].b, rows[4].c, rows[4].tag) == (2, 3, 2, "checked_in")


def test_public_view_drops_personal_fields(spark):
    from wardline.operators import directory, queues
    t, b = frames(spark, [token(1, "A001")], [])
    board = directory.public_view(queues.live_queue(t, b))
    assert "patient_name" not in board.columns and "patient_phone" not in board.columns
    assert board.count() == 1
