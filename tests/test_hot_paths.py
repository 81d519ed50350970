"""Queries stay exact when their groups take the hot (range-partitioned) path.

A tiny ``wardline.hotGroupRows`` makes most (day, doctor) / (day) / token
groups "hot", so every skew-safe operator runs its range scan with
partition-boundary patches; results must still equal the SQL oracle.
"""

import pytest

import __spark_entry__ as entry
from paths import SF001
from oracle_compare import compare, duck

HOT_QUERIES = ["live_queue_day", "live_queue", "lab_queue", "tokens_enriched", "depth_at_arrival",
               "status_alerts", "issue_opd", "reschedule", "pharmacy_status_fold", "booking_ahead",
               "checkin_bookings"]


@pytest.fixture(scope="module")
def hot_session(spark):
    spark.conf.set("wardline.hotGroupRows", "5")
    yield spark
    spark.conf.unset("wardline.hotGroupRows")


@pytest.mark.parametrize("name", HOT_QUERIES)
def test_hot_path_matches_oracle(hot_session, name):
    res = compare(hot_session, duck(SF001), SF001, entry.queries()[name], entry.oracle_sql()[name])
    assert res["ok"], res
