"""Request-log ingestion and validation (§2.1 S10, §2.2 F5-F7).

Requests arrive as JSON bodies; ``parse_requests`` turns them into typed
columns with the PHP coercions (``intval`` keeps a leading integer, missing
or unparsable values default to 0).  Validation never drops a row silently:
every rule yields a reason column, rejects are the rows with a reason.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Allowed enum values per request field, and the reference's
# rejection texts for reschedule requests.
ENUMS = {
    "opd_status": ("waiting", "consulting", "completed", "cancelled"),
    "pharmacy_status": ("waiting", "processing", "completed", "cancelled"),
    "lab_status": ("waiting", "in_progress", "completed", "cancelled", "no_show"),
    "break_action": ("start_break", "end_break"),
    "gender": ("male", "female", "other"),
}
MSG_BOOKING_REQUIRED = "Booking ID is required"
MSG_DATE_REQUIRED = "New appointment date is required"
MSG_DATE_FORMAT = "Invalid date format. Use YYYY-MM-DD"
MSG_DATE_PAST = "Cannot reschedule to a past date"
MSG_TIME_FORMAT = "Invalid time format. Use HH:MM:SS"


def intval(c: F.Column) -> F.Column:
    """PHP ``intval`` of text: leading (signed) integer after blanks, else 0."""
    digits = F.regexp_extract(c, r"^\s*([+-]?[0-9]+)", 1)
    return F.coalesce(F.when(digits != "", digits.try_cast("bigint")), F.lit(0).cast("bigint"))


# Request fields per endpoint kind with their coercion and the
# default used when the field is missing (the endpoints' ``?? default``).
REQUEST_FIELDS = {
    "opd_issue": {"patient_name": ("str", "Walk-in Patient"), "patient_age": ("int", 0),
                  "patient_phone": ("str", ""), "department": ("str", ""), "doctor_id": ("int", 0),
                  "type": ("str", "walkin")},
    "lab_issue": {"test_code": ("upper", ""), "patient_name": ("trim", ""), "patient_age": ("int", 0),
                  "patient_gender": ("lower", ""), "patient_phone": ("trim", ""),
                  "scheduled_time": ("str", None), "payment_amount": ("float", 0.0)},
    "pharmacy_issue": {"pharmacy_id": ("int", 0), "patient_id": ("int", None), "patient_name": ("trim", ""),
                       "patient_phone": ("trim", ""), "payment_method": ("trim", "cash"),
                       "notes": ("trim", "")},
    "opd_cancel": {"token": ("upper", ""), "token_id": ("int", 0), "booking_id": ("upper", None),
                   "reason": ("trim", "due to being late"), "notify": ("bool", True)},
    "opd_status": {"token_id": ("int", 0), "status": ("str", "")},
}


def _coerce(raw: F.Column, how: str, default) -> F.Column:
    if how == "int":
        value = F.when(raw.isNull(), F.lit(default).cast("bigint")).otherwise(intval(raw))
    elif how == "float":
        num = F.regexp_extract(raw, r"^\s*([+-]?([0-9]+\.?[0-9]*|\.[0-9]+))", 1)
        value = F.when(raw.isNull(), F.lit(default).cast("double")).otherwise(
            F.coalesce(F.when(num != "", num.try_cast("double")), F.lit(0.0)))
    elif how == "bool":
        # PHP (bool): '', '0', 'false'(JSON false) are false
        value = F.when(raw.isNull(), F.lit(default)).otherwise(~F.lower(F.trim(raw)).isin("", "0", "false"))
    else:
        text = {"upper": F.upper(F.trim(raw)), "lower": F.lower(F.trim(raw)), "trim": F.trim(raw)}.get(how, raw)
        value = F.coalesce(text, F.lit(default).cast("string"))
    return value


def parse_typed(df: DataFrame, kind: str, body_col: str = "body") -> DataFrame:
    """JSON request bodies of one endpoint kind -> typed, defaulted columns.

    Works the same on a batch DataFrame and on ``readStream`` input.
    """
    out = df
    for name, (how, default) in REQUEST_FIELDS[kind].items():
        raw = F.get_json_object(F.col(body_col), f"$.{name}")
        out = out.withColumn(name, _coerce(raw, how, default))
    return out


def parse_requests(df: DataFrame, body_col: str = "props", fields=("k",)) -> DataFrame:
    """JSON body -> one raw text column and one coerced integer per field.

    ``get_json_object`` returns the JSON value as text (numbers included),
    so the coercion is the same for ``{"k": 12}`` and ``{"k": "12abc"}``.
    """
    out = df
    for f in fields:
        raw = F.get_json_object(F.col(body_col), f"$.{f}")
        out = out.withColumn(f"{f}_raw", raw).withColumn(f"{f}_present", raw.isNotNull()) \
                 .withColumn(f, intval(raw))
    return out


def validate_enum(df: DataFrame, column: str, enum: str, source: str, key: str = "req_id") -> DataFrame:
    """rows of ``df`` whose ``column`` is outside the allowed set, with the reason."""
    allowed = ENUMS[enum]
    bad = df.where(~F.coalesce(F.col(column).isin(*allowed), F.lit(False)))
    reason = F.concat(F.lit("Invalid value for "), F.lit(column), F.lit(". Must be: "),
                      F.lit(", ".join(allowed)))
    return bad.select(F.lit(source).alias("source"), F.col(key).alias("req_id"),
                      F.col(column).alias("value"), reason.alias("reason"))


def reschedule_checks(requests: DataFrame) -> DataFrame:
    """the reschedule request checks in the reference's order; NULL reason = accepted.

    ``d`` (the request day) plays the part of "today".
    """
    bid = F.upper(F.trim("booking_id"))
    nd = F.trim("new_date")
    nt = F.trim("new_time")
    reason = (F.when(F.coalesce(bid, F.lit("")) == "", F.lit(MSG_BOOKING_REQUIRED))
              .when(F.coalesce(nd, F.lit("")) == "", F.lit(MSG_DATE_REQUIRED))
              .when(~nd.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), F.lit(MSG_DATE_FORMAT))
              .when(nd < F.date_format("d", "yyyy-MM-dd"), F.lit(MSG_DATE_PAST))
              .when((F.coalesce(nt, F.lit("")) != "") & ~nt.rlike(r"^[0-9]{2}:[0-9]{2}:[0-9]{2}$"),
                    F.lit(MSG_TIME_FORMAT)))
    return requests.select("req_id", "ts", "d", bid.alias("booking_id"), nd.alias("new_date"),
                           nt.alias("new_time"), reason.alias("reason"),
                           reason.isNull().alias("accepted"))
