"""Board refresh and break state as streams (§2.11 M2, M5).

The boards poll every 5-10 s.  As a stream: each micro-batch of requests is
appended to the request-log table (one partition per batch id, so a retried
batch overwrites itself -- idempotent), then only the days the batch touched
are recomputed from the tables and written over their ``queue_date``
partitions (dynamic partition overwrite).  The set of touched days in a
batch is tiny (one or two), so collecting it is bounded.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardline.operators import folds, queues
from wardline.operators.tables import replace_days


def touched_days(batch: DataFrame, col: str = "d") -> list:
    """Distinct days of a micro-batch (bounded: a batch spans a day or two)."""
    return [r[0] for r in batch.select(col).distinct().collect()]


def refresh_sink(log_path: str, out_path: str,
                 recompute: Callable[[DataFrame, list], DataFrame],
                 touched: Callable[[DataFrame], list] = touched_days) -> Callable[[DataFrame, int], None]:
    """``foreachBatch`` writer: append the batch to the log, then overwrite the
    recomputed partitions of the days the batch can change; a day without
    rows loses its partition."""
    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        batch.withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite") \
             .option("partitionOverwriteMode", "dynamic").partitionBy("batch_id").parquet(log_path)
        days = touched(batch)
        if not days:
            return
        log = spark.read.parquet(log_path).drop("batch_id")
        rows = recompute(log, days).persist()
        try:
            replace_days(rows, out_path, "queue_date", days)
        finally:
            rows.unpersist()
    return write


def status_touched_days(tokens: DataFrame) -> Callable[[DataFrame], list]:
    """Days a batch of status requests can change: each target token's own day,
    and the request day of every consulting request (its reset)."""
    def touched(batch: DataFrame) -> list:
        own = batch.join(tokens.select(F.col("id").alias("token_id"), F.col("queue_date").alias("_day")),
                         "token_id").select("_day")
        reset = batch.where(F.col("new_status") == "consulting").select(F.col("d").alias("_day"))
        return [r[0] for r in own.union(reset).distinct().collect()]
    return touched


def live_board(tokens: DataFrame, bookings: DataFrame) -> Callable[[DataFrame, list], DataFrame]:
    """M2: live queue per (day, doctor) after applying the status log so far."""
    def recompute(log: DataFrame, days: list) -> DataFrame:
        t = tokens.where(F.col("queue_date").isin(days))
        fold = folds.opd_status_fold(t, log).select("id", F.col("new_status").alias("_s"))
        t = t.join(fold, "id").withColumn("status", F.col("_s")).drop("_s")
        b = bookings.where(F.col("appointment_date").isin(days))
        return queues.live_queue(t, b, scope="doctor").drop("created_at", "branch")
    return recompute


def break_board() -> Callable[[DataFrame, list], DataFrame]:
    """M5: doctor break rows of the touched days."""
    def recompute(log: DataFrame, days: list) -> DataFrame:
        return folds.break_state(log.where(F.col("d").isin(days))) \
            .withColumnRenamed("break_date", "queue_date")
    return recompute
