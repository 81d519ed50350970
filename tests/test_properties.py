
from pyspark.sql import functions as F

from paths import SF001
from replays import admissions_of
from wardline.operators import folds, queues
from wardline.sources.hospital import Hospital


def _h(spark):
    return Hospital(spark, SF001)


def test_positions_dense_and_ahead(spark):
    h = _h(spark)
    for scope, keys in (("doctor", ["queue_date", "doctor_id"]), ("day", ["queue_date"])):
        q = queues.live_queue(h.tokens, h.prebooked_appointments, scope=scope)
        bad = q.groupBy(*keys).agg(F.min("position").alias("lo"), F.max("position").alias("hi"),
                                   F.count("*").alias("n"), F.countDistinct("position").alias("k"),
                                   F.max("total_in_queue").alias("t")) \
            .where((F.col("lo") != 1) | (F.col("hi") != F.col("n")) | (F.col("k") != F.col("n"))
                   | (F.col("t") != F.col("n")))
        assert bad.count() == 0
        assert q.where(F.col("people_ahead") != F.col("position") - 1).count() == 0


def test_token_numbers_unique_per_department_day(spark):
    h = _h(spark)
    walk = h.tokens.where(F.col("token_type").isNull() | (F.col("token_type") != "prebooked"))
    dup = walk.groupBy("department_id", "queue_date", "token_number").count().where(F.col("count") > 1)
    # departments sharing an initial may share numbers, but never inside one department
    assert dup.count() == 0


def test_one_consulting_per_department_day_for_same_day_requests(spark):
    h = _h(spark)
    t = h.tokens.withColumn("status", F.lit("waiting"))
    same_day = h.status_log.join(t.select(F.col("id").alias("token_id"), F.col("queue_date").alias("_td")),
                                 "token_id").where(F.col("d") == F.col("_td")).drop("_td")
    f = folds.opd_status_fold(t, same_day)
    multi = f.where(F.col("new_status") == "consulting").groupBy("department_id", "queue_date").count() \
        .where(F.col("count") > 1)
    assert multi.count() == 0


def test_status_fold_composes_over_split_logs(spark):
    """fold(L1 ++ L2) == fold(fold(L1), L2): replaying a log in two batches."""
    h = _h(spark)
    log = h.status_log
    cut = log.approxQuantile("req_id", [0.5], 0.0)[0]
    l1, l2 = log.where(F.col("req_id") <= cut), log.where(F.col("req_id") > cut)
    whole = folds.opd_status_fold(h.tokens, log).select("id", "new_status")
    mid = folds.opd_status_fold(h.tokens, l1).select("id", F.col("new_status").alias("_s"))
    t1 = h.tokens.join(mid, "id").withColumn("status", F.col("_s")).drop("_s")
    two = folds.opd_status_fold(t1, l2).select("id", "new_status")
    assert sorted(whole.collect()) == sorted(two.collect())


def test_replay_is_deterministic(spark):
    h = _h(spark)
    def issue():
        admissions, issued = admissions_of(h, h.opd_issue_log, h.lab_issue_log, h.checkin_log, h.doctors,
                                           h.prebooked_appointments, h.tokens, h.lab_tokens, h.status_log)
        return folds.issue_opd(h.opd_issue_log, h.departments, h.doctors, admissions, issued, h.tokens, h.lab_tokens,
                               h.status_log, h.issued_log)
    a, b = issue(), issue()
    cols = ["req_id", "token_number", "patients_ahead"]
    assert sorted(a.select(*cols).collect()) == sorted(b.select(*cols).collect())
