"""JSON bodies of the POST endpoints as typed requests (§2.1 S10, §2.2 F5, F7).

A body is parsed once into a VARIANT; fields are read from it by path.  A body
that is no JSON object, or that has an object, a list or a truth value where a
text or a number belongs, is rejected with the problem; all others get the
endpoint's defaults and coercions and its own first complaint, if any.  Works on
batch and streaming input alike.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardline.operators.requests import (ENUMS, MSG_BOOKING_REQUIRED, MSG_DATE_FORMAT, MSG_DATE_PAST,
                                         MSG_DATE_REQUIRED, MSG_TIME_FORMAT, intval)

# The fields that each endpoint reads, and how.
BODY_FIELDS = {
    "booking_cancel": {"booking_id": "key"},
    "lab_cancel": {"booking_id": "key"},
    "checkin": {"booking_id": "key"},
    "verify": {"booking_id": "key"},
    "lab_verify": {"booking_id": "key"},
    "reschedule": {"booking_id": "key", "new_date": "trim", "new_time": "trim"},
    "pharmacy_cancel": {"token_number": "key", "token_id": "int", "reason": "trim"},
    "pharmacy_status": {"token_id": "int", "status": "trim"},
    "opd_status": {"token_id": "int", "status": "text"},
    "break": {"doctor_id": "int", "action": "text"},
}
DEFAULTS = {("pharmacy_cancel", "reason"): "Cancelled by patient"}
MSG_LAB_BOOKING_REQUIRED = "Lab Booking ID is required"
MSG_TOKEN_REQUIRED = "Token number or ID is required"
MSG_TOKEN_INVALID = "Invalid token ID"
MSG_STATUS_OF = "Invalid status. Must be: "
MSG_TOKEN_STATUS_REQUIRED = "Token ID and status are required"
MSG_STATUS = "Invalid status"
MSG_DOCTOR_REQUIRED = "Doctor ID is required"
MSG_ACTION = "Invalid action. Use start_break or end_break"
NOT_JSON = "body is not a JSON object"
MISTYPED = "{field} must be a text or a number"

FIELDS = list(dict.fromkeys(f for fields in BODY_FIELDS.values() for f in fields))


def _empty(text: Column) -> Column:
    """PHP ``empty`` of a text."""
    return text.isin("", "0")


def _complaints() -> dict[str, Column]:
    """Each endpoint's first complaint about the typed fields (null: none); ``d`` is the request's day."""
    f = {name: F.col(name) for name in FIELDS}
    booking = F.when(_empty(f["booking_id"]), F.lit(MSG_BOOKING_REQUIRED))
    has_time = ~_empty(f["new_time"])
    return {
        "booking_cancel": booking, "lab_cancel": booking, "checkin": booking, "verify": booking,
        "lab_verify": F.when(_empty(f["booking_id"]), F.lit(MSG_LAB_BOOKING_REQUIRED)),
        "reschedule": booking.when(_empty(f["new_date"]), F.lit(MSG_DATE_REQUIRED))
        .when(~f["new_date"].rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), F.lit(MSG_DATE_FORMAT))
        .when(f["new_date"] < F.date_format("d", "yyyy-MM-dd"), F.lit(MSG_DATE_PAST))
        .when(has_time & ~f["new_time"].rlike(r"^[0-9]{2}:[0-9]{2}:[0-9]{2}$"), F.lit(MSG_TIME_FORMAT)),
        "pharmacy_cancel": F.when(_empty(f["token_number"]) & (f["token_id"] == 0), F.lit(MSG_TOKEN_REQUIRED)),
        "pharmacy_status": F.when(f["token_id"] <= 0, F.lit(MSG_TOKEN_INVALID))
        .when(~f["status"].isin(*ENUMS["pharmacy_status"]), F.lit(MSG_STATUS_OF + ", ".join(ENUMS["pharmacy_status"]))),
        "opd_status": F.when((f["token_id"] == 0) | _empty(f["status"]), F.lit(MSG_TOKEN_STATUS_REQUIRED))
        .when(~f["status"].isin(*ENUMS["opd_status"]), F.lit(MSG_STATUS)),
        "break": F.when(f["doctor_id"] == 0, F.lit(MSG_DOCTOR_REQUIRED))
        .when(~f["action"].isin(*ENUMS["break_action"]), F.lit(MSG_ACTION)),
    }


def parse_bodies(requests: DataFrame, body: str = "body") -> DataFrame:
    """Requests (kind, d, ``body``, ...) with typed fields, ``problem`` (why the body is rejected) and ``complaint``
    (the endpoint's first one); fields of other kinds and of rejected bodies are null."""
    parsed = requests.withColumn("_v", F.try_parse_json(body))
    fields = F.array_compact(F.array(*[
        F.when(F.col("kind").isin(*[k for k, names in BODY_FIELDS.items() if f in names])
               & F.schema_of_variant(F.try_variant_get("_v", f"$.{f}", "variant")).rlike("^(OBJECT|ARRAY|BOOLEAN)"),
               F.lit(MISTYPED.format(field=f))) for f in FIELDS]))
    not_object = ~F.coalesce(F.schema_of_variant("_v").startswith("OBJECT"), F.lit(False))
    problem = F.when(not_object, F.lit(NOT_JSON)).otherwise(F.try_element_at(fields, F.lit(1)))
    out = parsed.withColumn("problem", problem)
    for f in FIELDS:
        out = out.withColumn(f, _field(f))
    complaint = F.lit(None).cast("string")
    for kind, says in _complaints().items():
        complaint = F.when(F.col("kind") == kind, says).otherwise(complaint)
    return out.withColumn("complaint", F.when(F.col("problem").isNull(), complaint)).drop("_v")


def _field(name: str) -> Column:
    raw = F.try_variant_get("_v", f"$.{name}", "string")
    value = None
    for how in dict.fromkeys(fields[name] for fields in BODY_FIELDS.values() if name in fields):
        kinds = [k for k, fields in BODY_FIELDS.items() if fields.get(name) == how]
        if how == "int":
            typed = F.coalesce(intval(raw), F.lit(0).cast("bigint"))
        else:
            default = next((d for (k, n), d in DEFAULTS.items() if n == name and k in kinds), "")
            text = {"key": F.upper(F.trim(raw)), "trim": F.trim(raw)}.get(how, raw)
            typed = F.coalesce(text, F.lit(default))
        value = F.when(F.col("kind").isin(*kinds), typed) if value is None else value.when(F.col("kind").isin(*kinds), typed)
    return F.when(F.col("problem").isNull(), value)


def accepted(bodies: DataFrame, kind: str) -> DataFrame:
    """The requests of one kind without problem or complaint, with that kind's fields."""
    rows = bodies.where((F.col("kind") == kind) & F.col("problem").isNull() & F.col("complaint").isNull())
    return rows.drop(*[f for f in FIELDS if f not in BODY_FIELDS[kind]], "problem", "complaint", "kind")


def rejects(bodies: DataFrame) -> DataFrame:
    """Bodies that were not understood, as they came."""
    return bodies.where(F.col("problem").isNotNull()).select("req_id", "kind", "body", "problem")
