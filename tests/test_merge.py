"""Copy-on-write upserts, idle stretches and slot calendars."""

import datetime as dt
import tempfile

from pyspark.sql import functions as F

from paths import SF001
from wardline.operators import stats, tables
from wardline.sources.merge import MergeTable
from wardline.sources.staging import staged_hospital


def _table(spark):
    base = spark.range(0, 1000).select("id", (F.col("id") % 7).alias("a"), F.lit("old").alias("b"))
    t = MergeTable(spark, tempfile.mkdtemp(prefix="wl-merge-", dir="/tmp"), base.schema)
    t.create(base.repartitionByRange(10, "id"))
    return t, base


def _rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_upsert_rewrites_only_touched_files(spark):
    t, base = _table(spark)
    before = set(t.files())
    assert len(before) == 10
    updates = spark.createDataFrame([(5, 50, "x", 1), (5, 51, "x", 2), (7, 70, "x", 1), (5000, 1, "new", 1)],
                                    "id long, a long, b string, seq int")
    touched = t.upsert(updates, ["id"], ["a"], "seq")
    assert len(touched) == 1 and before - set(touched) <= set(t.files())
    assert _rows(t.read()) == _rows(tables.upsert(base, updates, ["id"], ["a"], "seq").select("id", "a", "b"))


def test_backfill_rewrites_only_touched_files(spark):
    t, base = _table(spark)
    before = set(t.files())
    values = spark.createDataFrame([(3, "v"), (990, "w"), (7777, "gone")], "id long, b string")
    touched = t.backfill(values, ["id"], ["b"])
    assert len(touched) == 2 and len(before & set(t.files())) == 8
    assert _rows(t.read()) == _rows(tables.backfill(base, values, ["id"], ["b"]).select("id", "a", "b"))
    assert t.backfill(values.where("id = 7777"), ["id"], ["b"]) == []


def test_upsert_into_an_empty_table_and_readers_of_old_files(spark):
    t, _ = _table(spark)
    old = t.read()
    t.upsert(spark.createDataFrame([(1, 9, "n", 1)], "id long, a long, b string, seq int"), ["id"], ["a"], "seq")
    assert old.count() == 1000 and t.read().where("id = 1").first().a == 9
    empty = MergeTable(spark, tempfile.mkdtemp(prefix="wl-merge-", dir="/tmp"), t.schema)
    assert empty.read().count() == 0
    empty.upsert(spark.createDataFrame([(1, 9, "n", 1)], "id long, a long, b string, seq int"), ["id"], ["a"], "seq")
    assert _rows(empty.read()) == [(1, 9, "n")]


def test_idle_stretches_give_every_day(spark):
    h = staged_hospital(spark, SF001)
    first, last = h.tokens.agg(F.min("queue_date"), F.max("queue_date")).first()
    idle = stats.doctor_idle(h.doctors, h.tokens, first, last)
    for day in (first, first + dt.timedelta(days=9), last):
        want = stats.doctor_wait(h.doctors, h.tokens, day).where("patients_waiting = 0").select("doctor_id", "wait_time")
        assert _rows(stats.idle_on(idle, day).select("doctor_id", "wait_time")) == _rows(want)
    quiet = stats.doctor_idle(h.doctors, h.tokens.limit(0), first, last)
    assert {(r.idle_from, r.idle_to) for r in quiet.collect()} == {(first, last)} and quiet.count() == h.doctors.count()


def test_slots_add_up_to_the_day(spark):
    h = staged_hospital(spark, SF001)
    slots = stats.slot_availability(h.prebooked_lab_appointments, h.lab_tests)
    sums = slots.groupBy("test_id", "slot_date").agg(*[F.sum(c).alias(c) for c in (
        "total_capacity", "booked_count", "available_count")])
    day = stats.lab_capacity(h.prebooked_lab_appointments, h.lab_tests).select(
        "test_id", "slot_date", "total_capacity", "booked_count", "available_count")
    assert _rows(sums) == _rows(day) and slots.where("booked_count = 0").count() > 0
