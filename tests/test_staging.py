"""Staged tables: what a query does not read is not computed."""

import os

from paths import SF001
from wardline.operators import folds
from wardline.sources.hospital import ROUTED, Hospital
from wardline.sources.staging import StagedHospital
from wardline.streaming import alerts


def test_reading_a_log_stages_the_events_alone(spark, tmp_path):
    h = StagedHospital(Hospital(spark, SF001), str(tmp_path))
    assert h.status_log.count() > 0 and h.lab_status_log.count() > 0
    assert sorted(os.listdir(tmp_path)) == ["events"]


def test_logs_scan_the_staged_events_and_prune_their_days(spark, tmp_path):
    h = StagedHospital(Hospital(spark, SF001), str(tmp_path))
    for name, day in ROUTED.items():
        log = getattr(h, name)
        plan = log.where(log[day] == "2024-01-10")._jdf.queryExecution().executedPlan().toString()
        scans = [x for x in plan.splitlines() if "FileScan parquet" in x]
        assert len(scans) == 1 and str(tmp_path)[:40] in scans[0] and "PartitionFilters: [isnotnull(day" in scans[0], name


def _staged_by(spark, tmp_path, fold) -> list[str]:
    h = StagedHospital(Hospital(spark, SF001), str(tmp_path))
    assert fold(h).count() > 0
    return sorted(os.listdir(tmp_path))


def test_pharmacy_status_fold_stages_what_it_reads(spark, tmp_path):
    assert _staged_by(spark, tmp_path, lambda h: folds.pharmacy_status_fold(h.pharmacy_tokens, h.pharmacy_status_log)) == [
        "events", "pharmacy_tokens"]


def test_reschedule_stages_what_it_reads(spark, tmp_path):
    assert _staged_by(spark, tmp_path, lambda h: folds.reschedule(h.prebooked_appointments, h.reschedule_log, h.tokens)) == [
        "events", "prebooked_appointments", "tokens"]


def test_status_alerts_stages_what_it_reads(spark, tmp_path):
    assert _staged_by(spark, tmp_path, lambda h: alerts.status_alerts(h.tokens, h.status_log, h.doctors)) == [
        "doctors", "events", "tokens"]


def test_issue_lab_stages_what_it_reads(spark, tmp_path):
    fold = lambda h: folds.issue_lab(h.lab_issue_log, h.lab_tests, h.admissions, h.issued, h.tokens, h.lab_tokens,
                                     h.lab_status_log, h.issued_log)
    assert _staged_by(spark, tmp_path, fold) == [
        "admissions", "departments", "doctors", "events", "issued", "lab_issue_log", "lab_tokens", "opd_issue_log",
        "prebooked_appointments", "tokens"]


def test_checkin_bookings_stages_what_it_reads(spark, tmp_path):
    fold = lambda h: folds.checkin_bookings(h.prebooked_appointments, h.tokens, h.doctors, h.checkin_log,
                                            h.admissions, h.issued, h.lab_tokens)
    assert _staged_by(spark, tmp_path, fold) == [
        "admissions", "departments", "doctors", "events", "issued", "lab_issue_log", "lab_tokens", "opd_issue_log",
        "prebooked_appointments", "tokens"]
