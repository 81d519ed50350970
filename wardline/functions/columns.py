"""Column builders shared by the operators (scalar functions, §2.2 / §2.8).

All of these are built-in Spark expressions, so they stay inside
whole-stage codegen; none of them is a Python UDF.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the application (status sets, service times, labels).
OPD_ACTIVE = ("waiting", "consulting")
LAB_ACTIVE = ("waiting", "in_progress")
PHARMACY_ACTIVE = ("waiting", "processing")
OPD_MINUTES_PER_PATIENT = 10
PHARMACY_MINUTES_PER_PATIENT = 3
LAB_BOARD_MINUTES_PER_PATIENT = 15
SECONDS_PER_DAY = 86400


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def sod(ts: str | Column) -> Column:
    """Seconds of day of a timestamp (the reference's ``TIME(ts)``)."""
    t = col(ts)
    return (F.hour(t) * 3600 + F.minute(t) * 60 + F.second(t)).cast("int")


def hms(seconds: str | Column) -> Column:
    """``HH:MM:SS`` text of a seconds-of-day value; NULL stays NULL."""
    s = col(seconds)
    return F.when(s.isNotNull(), F.format_string("%02d:%02d:%02d", (s / 3600).cast("int"),
                                                 ((s / 60).cast("int")) % 60, s % 60))


def hhmm_ampm(seconds: str | Column) -> Column:
    """``hh:mm AM`` (two-digit 12-hour clock), the reference's ``date('h:i A')``."""
    s = col(seconds)
    h = (s / 3600).cast("int")
    h12 = F.when(h % 12 == 0, F.lit(12)).otherwise(h % 12)
    return F.when(s.isNotNull(), F.format_string(
        "%02d:%02d %s", h12, ((s / 60).cast("int")) % 60,
        F.when(h < 12, F.lit("AM")).otherwise(F.lit("PM"))))


def hour_label(seconds: str | Column) -> Column:
    """12-hour clock without a leading zero (``9:05 AM``), as the boards show."""
    s = col(seconds)
    h = (s / 3600).cast("int")
    h12 = F.when(h % 12 == 0, F.lit(12)).otherwise(h % 12)
    return F.when(s.isNotNull(), F.format_string(
        "%d:%02d %s", h12, ((s / 60).cast("int")) % 60,
        F.when(h < 12, F.lit("AM")).otherwise(F.lit("PM"))))


def seq3(prefix: str | Column, n: str | Column) -> Column:
    """``{prefix}{n:03d}``: at least three digits and never truncated.

    ``lpad`` would cut 1000 to '100'; ``format_string`` widens instead.
    """
    p = F.lit(prefix) if isinstance(prefix, str) else prefix
    return F.concat(p, F.format_string("%03d", col(n)))


def upper_key(c: str | Column) -> Column:
    """Key normalisation for the case-insensitive collation of the reference."""
    return F.upper(F.trim(col(c)))


def starts_pb(token_number: str | Column) -> Column:
    """``token_number LIKE 'PB%'`` under a case-insensitive collation."""
    return F.upper(col(token_number)).startswith("PB")


def effective_type(token_type: str = "token_type", type_: str = "type") -> Column:
    """``COALESCE(token_type, type, 'walkin')``."""
    return F.coalesce(F.col(token_type), F.col(type_), F.lit("walkin"))


def wrap_sod(seconds: Column) -> Column:
    """Clock arithmetic modulo 24 h (``date('H:i', strtotime('+n minutes'))``)."""
    return F.pmod(seconds, F.lit(SECONDS_PER_DAY)).cast("int")


def ucfirst(c: str | Column) -> Column:
    """PHP ``ucfirst``: upper-case the first character only (not ``initcap``)."""
    x = col(c)
    return F.concat(F.upper(F.substring(x, 1, 1)), F.substring(x, 2, 1 << 30))
