"""Request-shaped views agree with the all-days queries on the same day."""

import datetime as dt

from pyspark.sql import functions as F

from paths import SF001
from wardline.operators import queues
from wardline.plans import views
from wardline.sources.hospital import Hospital

DAY = dt.date(2024, 1, 10)


def test_live_queue_view_matches_all_days(spark):
    h = Hospital(spark, SF001)
    allq = queues.live_queue(h.tokens, h.prebooked_appointments, scope="doctor") \
        .where((F.col("queue_date") == DAY) & (F.col("doctor_id") == 3))
    v = views.live_queue_view(h, DAY, doctor_id=3)
    cols = ["position", "token_number", "status"]
    assert sorted(v["queue"].select(*cols).collect()) == sorted(allq.select(*cols).collect())
    s = v["summary"].collect()[0]
    assert s.total_in_queue == allq.count() and s.current_position == 0
    if allq.count():
        tok = allq.orderBy(F.desc("position")).first().token_number
        v2 = views.live_queue_view(h, DAY, doctor_id=3, current_token=tok.lower())
        s2 = v2["summary"].collect()[0]
        assert s2.current_position >= 1 and s2.people_ahead == s2.current_position - 1
        assert v2["shown"].count() == min(5, allq.count())


def test_a_viewer_who_is_not_listed_sees_the_head(spark):
    h = Hospital(spark, SF001)
    v = views.live_queue_view(h, DAY, doctor_id=3, current_token="ZZZ9")
    n = v["queue"].count()
    assert sorted(r.shown_position for r in v["shown"].collect()) == list(range(1, min(5, n) + 1))
    assert v["summary"].collect()[0].current_position == 0


def test_other_views_run(spark):
    h = Hospital(spark, SF001)
    assert views.lab_queue_view(h, DAY, "mri").where(F.col("test_name") != "MRI Scan").count() == 0
    dq = views.doctor_queue_view(h, DAY, doctor_id=2)
    assert dq["worklist"].where(F.col("doctor_id") != 2).count() == 0
    assert views.day_tokens_view(h, DAY, doctor_id=2).where(F.col("queue_date") != DAY).count() == 0
    assert views.opd_queue_view(h, DAY, status="waiting")["stats"].count() == 1
    assert views.doctor_list_view(h, DAY, department="ASIA").count() > 0
    assert views.pharmacy_queue_view(h, DAY, pharmacy_id=1)["queue"].count() > 0
    tok = h.tokens.where(F.col("queue_date") == DAY).first().token_number
    assert views.status_poll(h, DAY, token=tok).collect()[0].step == 1


def test_live_queue_response_shape(spark):
    import json
    h = Hospital(spark, SF001)
    doc = json.loads(views.live_queue_response(h, DAY, doctor_id=3).collect()[0][0])
    assert doc["success"] is True and set(doc) == {"success", "queue", "total_in_queue", "current_position",
                                                    "people_ahead"}
    assert len(doc["queue"]) == min(5, doc["total_in_queue"])
    assert [q["position"] for q in doc["queue"]] == sorted(q["position"] for q in doc["queue"])
    if doc["queue"]:
        tok = doc["queue"][-1]["token_number"]
        doc2 = json.loads(views.live_queue_response(h, DAY, doctor_id=3, current_token=tok).collect()[0][0])
        assert doc2["current_position"] >= 1 and any(q["is_you"] for q in doc2["queue"])
