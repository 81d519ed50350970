"""Check-ins replayed over hand-made tables, with no other requests."""

from pyspark.sql import functions as F

from paths import SF001
from wardline.operators import admission, folds
from wardline.sources.hospital import ISSUED_ID_BASE
from wardline.sources.staging import staged_hospital, written_tables


def admissions_of(h, opd_log, lab_log, checkin_log, doctors, bookings, tokens, lab_tokens, status_log):
    """(admissions, issued tokens) of three logs over the given tables."""
    dims = (h.departments, doctors, h.lab_tests, bookings)
    asks = folds.admission_asks(opd_log, lab_log, checkin_log, *dims)
    changes = folds.token_changes(status_log, h.lab_status_log.limit(0), h.issued_log.limit(0))
    admissions = admission.admit(asks, folds.stored_tokens(tokens, lab_tokens), changes, ISSUED_ID_BASE,
                                 written_tables(h.spark, "replay"))
    return admissions, folds.issued_tokens(admissions, opd_log, lab_log, checkin_log, *dims, tokens, lab_tokens,
                                           ISSUED_ID_BASE)


def checkin(spark, bookings, tokens, doctors, log):
    h = staged_hospital(spark, SF001)
    if "patient_id" not in log.columns:
        log = log.withColumn("patient_id", F.lit(None).cast("long"))
    lab = h.lab_tokens.limit(0)
    admissions, issued = admissions_of(h, h.opd_issue_log.limit(0), h.lab_issue_log.limit(0), log, doctors, bookings,
                                       tokens, lab, h.status_log.limit(0))
    return folds.checkin_bookings(bookings, tokens, doctors, log, admissions, issued, lab)
