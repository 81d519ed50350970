
import pytest

import __spark_entry__ as entry
from paths import SF001

FORBIDDEN = ("BroadcastNestedLoopJoin", "CartesianProduct")


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_no_nested_loop_or_cartesian(spark, name):
    df = entry.queries()[name](spark, SF001)
    plan = _plan(df)
    for bad in FORBIDDEN:
        assert bad not in plan, f"{name}: {bad}"


def test_windows_are_partitioned(spark):
    """Every Window operator has partition keys, except the department list
    (a window over the five departments of the region table)."""
    import re
    for name, fn in entry.queries().items():
        plan = _plan(fn(spark, SF001))
        for m in re.finditer(r"Window \[.*?\], \[(.*?)\], \[", plan):
            if name == "departments":
                continue
            assert m.group(1).strip(), f"{name}: window without partition keys"


def test_scans_prune_columns(spark):
    """The live queue reads only the token columns it needs: the phone and
    patient id of the staged token table never reach its scans."""
    import re
    df = entry.queries()["live_queue"](spark, SF001)
    plan = df._jdf.queryExecution().executedPlan().toString()
    schemas = re.findall(r"ReadSchema: (struct<[^\n]*>)", plan)
    assert schemas, "no parquet scans found"
    for rs in schemas:
        assert "patient_phone" not in rs and "patient_id" not in rs, rs


def test_views_prune_day_folders(spark):
    """Every fact scan of a one-day view reads only the folder of its day."""
    import datetime as dt
    import re
    from wardline.plans import views
    from wardline.sources.staging import staged_hospital
    h, day = staged_hospital(spark, SF001), dt.date(2024, 1, 10)
    live, doctor = views.live_queue_view(h, day, 3), views.doctor_queue_view(h, day, doctor_id=2)
    frames = [live["queue"], live["summary"], views.lab_queue_view(h, day, "mri"), doctor["worklist"],
              views.day_tokens_view(h, day, doctor_id=2), views.opd_queue_view(h, day)["stats"],
              views.pharmacy_queue_view(h, day, pharmacy_id=1)["queue"]]  # a status poll finds bookings of any day
    for df in frames:
        scans = re.findall(r"FileScan parquet \[[^\n]*", _plan(df))
        facts = [x for x in scans if re.match(r"FileScan parquet \[[^\]]*(queue_date|_date|day)#", x)]
        assert facts
        for x in facts:
            assert re.search(r"PartitionFilters: \[[^\]]*(queue_date|appointment_date|scheduled_date|day)", x), x


def test_logs_come_from_one_scan_of_events(spark):
    from wardline.sources.hospital import Hospital
    plan = _plan(Hospital(spark, SF001).routed_rows())
    assert plan.count("FileScan parquet") == 1


def test_routed_tables_equal_the_derived_ones(spark):
    from wardline.sources.hospital import ROUTED, Hospital
    from wardline.sources.staging import staged_hospital
    h, staged = Hospital(spark, SF001), staged_hospital(spark, SF001)
    for name in ROUTED:
        a, b = getattr(h, name), getattr(staged, name)
        assert a.columns == b.columns
        assert sorted(map(repr, a.collect())) == sorted(map(repr, b.collect())), name
