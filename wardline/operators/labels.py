"""Board presentation rules (§2.2 F13-F15, §2.10 T14/T15).

The boards map statuses to labels and pick badges in page script; here the
same rules are ``when`` chains / map lookups over whole queues, so a board
for every doctor, pharmacy and day is one projection.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardline.operators.ranking import number_rows, running_sum

# Status aliases -> board category, category labels, the staff
# selector labels for OPD statuses and the pharmacy labels.
STATUS_CATEGORY = {
    "waiting": "waiting",
    "consulting": "inprogress", "in_progress": "inprogress", "in progress": "inprogress",
    "completed": "completed", "done": "completed",
    "skipped": "skipped", "cancelled": "skipped", "canceled": "skipped",
    "break": "break", "on_break": "break", "on break": "break",
}
CATEGORY_LABEL = {"waiting": "Waiting", "inprogress": "In progress", "completed": "Completed",
                  "skipped": "Skipped", "break": "On Break"}
CATEGORY_CLASS = {"waiting": "status-waiting", "inprogress": "status-inprogress",
                  "completed": "status-completed", "skipped": "status-skipped",
                  "break": "status-break"}
STAFF_LABEL = {"consulting": "In Process", "waiting": "Waiting", "completed": "Completed",
               "cancelled": "Cancelled"}
PHARMACY_LABEL = {"waiting": "Waiting", "processing": "Processing", "completed": "Completed",
                  "cancelled": "Cancelled"}


def _lookup(mapping: dict[str, str], key: F.Column) -> F.Column:
    return F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])[key]


def display_status(status: F.Column) -> tuple[F.Column, F.Column, F.Column]:
    """(category, label, css class) of a raw status; empty -> waiting,
    unknown values pass through as their own category and label."""
    low = F.lower(status)
    cat = F.when(status.isNull() | (status == ""), F.lit("waiting")).otherwise(
        F.coalesce(_lookup(STATUS_CATEGORY, low), low))
    label = F.coalesce(_lookup(CATEGORY_LABEL, cat), cat)
    css = F.coalesce(_lookup(CATEGORY_CLASS, cat), F.lit("status-waiting"))
    return cat, label, css


def status_labels(tokens: DataFrame, lab_tokens: DataFrame, pharmacy_tokens: DataFrame) -> DataFrame:
    """F13 over every OPD, lab and pharmacy token: category, label, class and
    the board-specific label (staff selector for OPD, pharmacy board text)."""
    opd = tokens.select(F.lit("opd").alias("source"), "id", "queue_date", "status")
    lab = lab_tokens.select(F.lit("lab").alias("source"), F.col("token_id").alias("id"),
                            F.col("scheduled_date").alias("queue_date"),
                            F.col("token_status").alias("status"))
    ph = pharmacy_tokens.select(F.lit("pharmacy").alias("source"), "id", "queue_date", "status")
    u = opd.unionByName(lab).unionByName(ph)
    cat, label, css = display_status(F.col("status"))
    board = (F.when(F.col("source") == "opd",
                    F.coalesce(_lookup(STAFF_LABEL, F.col("status")), F.lit("Waiting")))
             .when(F.col("source") == "pharmacy",
                   F.coalesce(_lookup(PHARMACY_LABEL, F.col("status")), F.col("status")))
             .otherwise(label))
    return u.select("source", "id", "queue_date", "status", cat.alias("category"),
                    label.alias("label"), css.alias("css_class"), board.alias("board_label"))


def queue_badges(neighbourhood: DataFrame) -> DataFrame:
    """badge of every row a patient sees: YOU, In Consult, Booked, Walk-in.

    The page tests the PB prefix case-sensitively (unlike the SQL side)."""
    you = F.col("is_you") | (F.upper("shown_token") == F.upper("viewer_token"))
    booked = (F.col("token_type") == "prebooked") | F.col("shown_token").startswith("PB")
    badge = (F.when(you, F.lit("YOU")).when(F.col("status") == "consulting", F.lit("In Consult"))
             .when(booked, F.lit("Booked")).otherwise(F.lit("Walk-in")))
    return neighbourhood.withColumn("badge", badge)


def pharmacy_board(pharmacy_queue: DataFrame) -> DataFrame:
    """the pharmacy boards -- non-cancelled tokens in arrival order, the
    staff waiting list, and the token now being served (first processing).
    Running counts along the one arrival order."""
    group, order = ["queue_date", "pharmacy_id"], ["position", "id"]
    q = pharmacy_queue.where(F.col("status") != "cancelled").withColumn(
        "_waits", (F.col("status") == "waiting").cast("int")).withColumn(
        "_serves", (F.col("status") == "processing").cast("int"))
    q = number_rows(q, group, order, "board_position")
    q = running_sum(q, group, order, "_waits", "_n_waiting")
    q = running_sum(q, group, order, "_serves", "_n_serving")
    return q.select("queue_date", "pharmacy_id", "id", "token_number", "status", "board_position",
                    F.when(F.col("_waits") == 1, F.col("_n_waiting")).alias("waiting_position"),
                    ((F.col("_serves") == 1) & (F.col("_n_serving") == 1)).alias("now_serving"))


def next_patient(worklist: DataFrame) -> DataFrame:
    """The staff "next patient" action for every (day, doctor) worklist:
    complete the current token (the consulting one, else the head -- both are
    position 1), then promote the new head (position 2) to consulting.
    Emitted as two status requests for the T5 fold."""
    w = worklist.where(F.col("position") <= 2)
    return w.select("queue_date", "doctor_id", F.col("position").alias("step"),
                    F.col("id").alias("token_id"), "token_number",
                    F.when(F.col("position") == 1, F.lit("completed")).otherwise(F.lit("consulting"))
                    .alias("new_status"))


def pharmacy_next(pharmacy_queue: DataFrame) -> DataFrame:
    """T15: "call next" per (day, pharmacy): allowed only when nothing is
    processing; the first waiting token (arrival order) becomes processing."""
    g = pharmacy_queue.groupBy("queue_date", "pharmacy_id").agg(
        F.count(F.when(F.col("status") == "processing", 1)).alias("processing"),
        F.min(F.when(F.col("status") == "waiting", F.struct("position", "id"))).alias("_first"))
    g = g.withColumn("_next", F.col("_first.id"))
    action = (F.when(F.col("processing") > 0, F.lit("busy"))
              .when(F.col("_next").isNull(), F.lit("empty")).otherwise(F.lit("call_next")))
    return g.select("queue_date", "pharmacy_id", "processing", action.alias("action"),
                    F.when(action == "call_next", F.col("_next")).alias("next_token_id"),
                    F.when(action == "call_next", F.lit("processing")).alias("new_status"))
