"""Stage the derived domain tables once per session.

In the application the domain tables are stored tables; here they are
derived from the input tables (``Hospital``), which costs joins and a
numbering window per table.  ``staged_hospital`` writes each domain table
to Parquet under the session's checkpoint directory the first time a query
needs it and reads it back afterwards, so every query starts from a stored
table (with its statistics and column pruning) instead of recomputing the
derivation.  The write also cuts the lineage: a lost executor re-reads the
staged files instead of replaying the adapter.
"""

from __future__ import annotations

import hashlib
import os
import threading
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardline.session import ensure_checkpoint_dir
from wardline.sources.hospital import ISSUED_ID_BASE, ROUTED, Hospital, with_day

DOMAIN_TABLES = ("departments", "doctors", "tokens", "prebooked_appointments", "lab_tokens",
                 "prebooked_lab_appointments", "pharmacy_tokens", "status_log", "break_log",
                 "lookup_log", "cancel_log", "booking_cancel_log", "reschedule_log",
                 "lab_cancel_log", "pharmacy_cancel_log", "pharmacy_status_log", "lab_status_log",
                 "checkin_log", "opd_issue_log", "lab_issue_log", "pharmacy_issue_log", "issued_log", "body_log", "staff",
                 "pharmacy_staff")

# what the derived tables read of an event
STAGED_EVENT_COLUMNS = ("event_id", "ts", "user_id", "event_type", "value")

# derived from domain tables by operators, staged like them
DERIVED_TABLES = ("admissions", "issued")

_LOCK = threading.Lock()
_CACHE: dict[tuple[str, str], "StagedHospital"] = {}


# day columns of the tables that are not routed
DAY_COLUMNS = {"tokens": "queue_date", "prebooked_appointments": "appointment_date", "lab_tokens": "scheduled_date",
               "pharmacy_tokens": "queue_date", "opd_issue_log": "d", "lab_issue_log": "d", "issued": "d",
               "body_log": "d"}


class StagedHospital:
    """``Hospital`` whose domain tables are read from staged Parquet, facts in a folder for each day.

    The logs are not stored again: each is a projection of ``events``, staged
    once in a folder for each day.  A query computes only the logs it reads,
    and a filter on the day column prunes folders.  Staging also deals the
    events over the tasks, so that the derivations do not depend on how the
    input file is cut.
    """

    def __init__(self, base: Hospital, root: str):
        self.base = base
        self.root = root
        self.spark = base.spark
        self.sf_dir = base.sf_dir
        self._tables: dict[str, DataFrame] = {}
        self._locks = {n: threading.Lock() for n in (*DOMAIN_TABLES, *DERIVED_TABLES, "events")}

    def _stage_events(self) -> None:
        """Write the event columns that tables are derived from, once; the tables' plans start from there."""
        with self._locks["events"]:
            if "events" not in self._tables:
                path = f"{self.root}/events"
                rows = self.base.events.select(*STAGED_EVENT_COLUMNS, F.col("d").alias("day"))
                rows.hint("rebalance", "day").write.mode("overwrite").partitionBy("day").parquet(path)
                self._tables["events"] = self.base.events = with_day(
                    self.spark.read.schema(rows.schema).parquet(path).withColumnRenamed("day", "d"))

    def _stage(self, name: str) -> DataFrame:
        with self._locks[name]:
            if name not in self._tables:
                if name in ROUTED or name in DAY_COLUMNS:
                    self._stage_events()
                if name in ROUTED:
                    self._tables[name] = getattr(self.base, name)
                    return self._tables[name]
                path = f"{self.root}/{name}"
                table = self._derive(name) if name in DERIVED_TABLES else getattr(self.base, name)
                day = DAY_COLUMNS.get(name)
                if day:
                    table.hint("rebalance", day).write.mode("overwrite").partitionBy(day).parquet(path)
                else:
                    table.write.mode("overwrite").parquet(path)
                self._tables[name] = self.spark.read.schema(table.schema).parquet(path).select(*table.columns)
            return self._tables[name]

    def _derive(self, name: str) -> DataFrame:
        from wardline.operators import admission, folds
        logs = (self.opd_issue_log, self.lab_issue_log, self.checkin_log)
        dims = (self.departments, self.doctors, self.lab_tests, self.prebooked_appointments)
        if name == "admissions":
            return admission.admit(
                folds.admission_asks(*logs, *dims), folds.stored_tokens(self.tokens, self.lab_tokens),
                folds.token_changes(self.status_log, self.lab_status_log, self.issued_log), ISSUED_ID_BASE,
                written_tables(self.spark, "admissions"))
        return folds.issued_tokens(self.admissions, *logs, *dims, self.tokens, self.lab_tokens, ISSUED_ID_BASE)

    def stage_all(self, names=DOMAIN_TABLES, threads: int = 4) -> None:
        """Stage several tables at once: independent Spark jobs submitted from
        a few driver threads share the cluster instead of running one by one."""
        from concurrent.futures import ThreadPoolExecutor
        with ThreadPoolExecutor(max_workers=threads) as pool:
            list(pool.map(self._stage, names))

    def __getattr__(self, name: str):
        if name in DOMAIN_TABLES or name in DERIVED_TABLES:
            return self._stage(name)
        return getattr(self.base, name)


def staged_hospital(spark: SparkSession, sf_dir: str) -> StagedHospital:
    sf_abs = os.path.abspath(sf_dir)
    key = (spark.sparkContext.applicationId, sf_abs)
    with _LOCK:
        if key not in _CACHE:
            tag = hashlib.sha1(f"{key[0]}|{sf_abs}".encode()).hexdigest()[:16]
            root = f"{ensure_checkpoint_dir(spark).rstrip('/')}/wardline-domain/{tag}"
            _CACHE[key] = StagedHospital(Hospital(spark, sf_dir), root)
        return _CACHE[key]


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new folder name below the shared checkpoint directory."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/wardline-scratch/{label}-{uuid.uuid4().hex}"


def written_tables(spark: SparkSession, label: str):
    """``keep(df, name)``: write a table into a new folder below the shared checkpoint directory and scan it."""
    root = scratch_path(spark, label)

    def keep(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{root}/{name}")
        return spark.read.schema(df.schema).parquet(f"{root}/{name}")
    return keep
