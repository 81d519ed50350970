"""Status-change alerts and day expiry (§2.11 M1, M3, M4) -- batch twins.

The patient page polls the token status and alerts when it becomes
``cancelled`` ("Token Cancelled") or ``consulting`` ("Your Turn"), and stops
polling after a cancellation.  We emit on transitions only.  A token's
status between its own requests can also change because a consulting
request for another token of its department on its day completes it
(the status endpoint's reset), so "status before request k" is the previous
own status, or ``completed`` when it was consulting and such a request
falls between request k-1 and k.  That is a count over the (department,
day) timeline of consulting requests, done with ``count_before``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardline.operators.folds import opd_status_fold
from wardline.operators.lookups import LATE_REASON, count_before
from wardline.operators.ranking import lag_within, running_sum
from wardline.operators.requests import ENUMS

# Fixed texts of the alerts.
CANCEL_TITLE = "❌ Token Cancelled"
CANCEL_BODY = "Your token {token} has been cancelled {reason}. Please contact reception."
TURN_TITLE = "\U0001f514 Your Turn!"
TURN_BODY = "Token {token} is now being called. Please proceed to {place}."
DEFAULT_PLACE = "the consultation room"


def _fill(template: str, **cols: F.Column) -> F.Column:
    parts, rest = [], template
    while "{" in rest:
        head, tail = rest.split("{", 1)
        name, rest = tail.split("}", 1)
        parts += [F.lit(head), cols[name]]
    parts.append(F.lit(rest))
    return F.concat(*parts)


def status_alerts(tokens: DataFrame, status_log: DataFrame, doctors: DataFrame) -> DataFrame:
    """M1 batch twin: one alert per transition into cancelled/consulting."""
    t = tokens.select(F.col("id").alias("token_id"), "department_id", "queue_date",
                      F.col("status").alias("snap"), "token_number", "doctor_id")
    r = status_log.where(F.col("new_status").isin(*ENUMS["opd_status"])).join(t, "token_id")
    order = F.struct("ts", "req_id")
    counted = r.where(F.col("new_status") == "consulting").select(
        "department_id", F.col("d").alias("queue_date"), order.alias("_t"))
    probes = r.select(F.col("req_id").alias("_pid"), "department_id", "queue_date", order.alias("_t"))
    p_now = count_before(probes, counted, ["department_id", "queue_date"], "p_now")
    r = r.join(p_now, r.req_id == p_now._pid).drop("_pid")
    # Previous own request of the token (skew-safe lag over its requests).
    order_cols = ["ts", "req_id"]
    r = r.withColumn("_cur", F.struct("new_status", "d", "p_now"))
    r = lag_within(r, ["token_id"], order_cols, "_cur", "_prev")
    prev_status = F.col("_prev.new_status")
    r = r.withColumn("prev", F.coalesce(prev_status, F.col("snap"))) \
         .withColumn("_prev_counted", F.coalesce(
             ((prev_status == "consulting") & (F.col("_prev.d") == F.col("queue_date"))).cast("int"),
             F.lit(0))) \
         .withColumn("_p_prev", F.coalesce(F.col("_prev.p_now"), F.lit(0)))
    between = F.col("p_now") - F.col("_p_prev") - F.col("_prev_counted")
    displaced = (F.col("prev") == "consulting") & (between > 0)
    before = F.when(displaced, F.lit("completed")).otherwise(F.col("prev"))
    alert = F.col("new_status").isin("cancelled", "consulting") & (F.col("new_status") != before)
    r = r.withColumn("_cancel_alert", (alert & (F.col("new_status") == "cancelled")).cast("int")) \
         .withColumn("_alert", alert)
    r = running_sum(r, ["token_id"], order_cols, "_cancel_alert", "_cancels_upto")
    r = r.withColumn("_cancels_before", F.col("_cancels_upto") - F.col("_cancel_alert"))
    doc = doctors.select(F.col("id").alias("doctor_id"), F.col("name").alias("doctor_name"))
    out = r.where(F.col("_alert") & (F.col("_cancels_before") == 0)).join(doc, "doctor_id", "left")
    title = F.when(F.col("new_status") == "cancelled", F.lit(CANCEL_TITLE)).otherwise(F.lit(TURN_TITLE))
    msg = F.when(F.col("new_status") == "cancelled",
                 _fill(CANCEL_BODY, token=F.col("token_number"), reason=F.lit(LATE_REASON))) \
        .otherwise(_fill(TURN_BODY, token=F.col("token_number"),
                         place=F.coalesce(F.col("doctor_name"), F.lit(DEFAULT_PLACE))))
    return out.select("token_id", "req_id", "queue_date", F.col("new_status").alias("alert"),
                      title.alias("title"), msg.alias("message"))


def expired_tokens(tokens: DataFrame, status_log: DataFrame) -> DataFrame:
    """M4 batch twin: tokens still waiting or consulting when their day closed.

    Every read filters to "today", so such a token silently expires at
    midnight; the streaming form drops its state at the same point.
    """
    f = opd_status_fold(tokens, status_log, until_day_end=True)
    live = f.where(F.col("new_status").isin("waiting", "consulting"))
    t = tokens.select("id", "token_number", "doctor_id")
    return live.join(t, "id").select(
        "id", "token_number", "queue_date", "department_id", "doctor_id",
        F.col("new_status").alias("status_at_close"),
        F.date_format(F.date_add("queue_date", 1), "yyyy-MM-dd 00:00:00").alias("expired_at"))
