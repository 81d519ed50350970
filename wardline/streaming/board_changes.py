"""Boards as incrementally maintained views with a changelog (§2.11 M2).

The screens poll their whole list every 5-10 s.  Here a micro-batch of status
requests is routed to the days it can change, only those days are read -- the
tables' day folders and the log's -- folded and ranked, and each row is compared
with the day's last snapshot.  What differs goes to the changelog as insert,
update or delete; the new snapshots replace the old ones in one step.

    log        root/log/day=.../batch=...      requests, filed under each day that they affect
    snapshots  root/board                      ``DaySnapshots`` of the ranked board
    changes    root/changes/batch=...          op, day, key, old and new position and status

A batch that is retried overwrites its own files in the log and the changelog, so
it leaves what one run leaves: its changes are taken against the snapshots
from before its first commit, which the manifest names.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardline.operators import queues
from wardline.operators.requests import ENUMS
from wardline.sources.snapshots import DaySnapshots

BOARD = ["queue_date", "group_id", "branch", "id", "token_number", "status", "position"]
CHANGES = ("op string, queue_date date, group_id long, branch string, id long, token_number string, "
           "old_position long, position long, old_status string, status string")


@dataclass(frozen=True)
class Board:
    """A board: how requests reach days, and how a day's tables and requests become ranked rows.

    ``route(requests)`` gives the log's rows with ``day``; ``rank(days, log)``
    the columns of ``BOARD`` for those days, where (group_id, branch, id) is a
    row's key.
    """

    name: str
    route: Callable[[DataFrame], DataFrame]
    rank: Callable[[list, DataFrame], DataFrame]


def _order() -> F.Column:
    return F.struct("ts", "req_id")


def _days_of(df: DataFrame, day: str, days: list) -> DataFrame:
    return df.where(F.col(day).isin(days))


def _last_own(log: DataFrame) -> DataFrame:
    return log.where("own").groupBy(F.col("token_id").alias("_token")).agg(
        F.max_by(F.struct(_order().alias("o"), "new_status"), _order()).alias("_own"))


# -- OPD boards ---------------------------------------------------------------
def _route_opd(tokens: DataFrame) -> Callable[[DataFrame], DataFrame]:
    """A request is filed under its token's day, and if it is consulting, as a reset under its own day."""
    known = tokens.select(F.col("id").alias("token_id"), "department_id", F.col("queue_date").alias("_td"))

    def route(requests: DataFrame) -> DataFrame:
        r = requests.where(F.col("new_status").isin(*ENUMS["opd_status"])).join(known, "token_id")
        cols = ["req_id", "ts", "token_id", "department_id", "new_status"]
        own = r.select(F.col("_td").alias("day"), *cols, F.lit(True).alias("own"))
        reset = r.where("new_status = 'consulting'").select(F.col("d").alias("day"), *cols, F.lit(False).alias("own"))
        return own.unionByName(reset)
    return route


def _opd_now(tokens: DataFrame, days: list, log: DataFrame) -> DataFrame:
    """Tokens of the days with their status after the requests filed there (the fold of §2.10 T5)."""
    t = _days_of(tokens, "queue_date", days)
    resets = log.where("not own").groupBy("department_id", F.col("day").alias("queue_date")).agg(
        F.max(_order()).alias("_reset"))
    t = t.join(_last_own(log), t.id == F.col("_token"), "left").join(resets, ["department_id", "queue_date"], "left")
    status = F.coalesce("_own.new_status", "status")
    over = (status == "consulting") & F.col("_reset").isNotNull() & (
        F.col("_own").isNull() | (F.col("_reset") > F.col("_own.o")))
    return t.withColumn("status", F.when(over, "completed").otherwise(status)).drop("_own", "_reset", "_token")


def _board(df: DataFrame, group: str, branch: F.Column) -> DataFrame:
    return df.select("queue_date", F.col(group).cast("long").alias("group_id"), branch.alias("branch"),
                     F.col("id").cast("long").alias("id"), "token_number", "status",
                     F.col("position").cast("long").alias("position"))


def live_board(tokens: DataFrame, bookings: DataFrame) -> Board:
    """The live queue of every doctor."""
    def rank(days: list, log: DataFrame) -> DataFrame:
        q = queues.live_queue(_opd_now(tokens, days, log), _days_of(bookings, "appointment_date", days), scope="doctor")
        return _board(q, "doctor_id", F.col("branch").cast("string"))
    return Board("live", _route_opd(tokens), rank)


def worklist_board(tokens: DataFrame) -> Board:
    """The worklist of every doctor on the staff screen."""
    def rank(days: list, log: DataFrame) -> DataFrame:
        return _board(queues.doctor_worklist(_opd_now(tokens, days, log)), "doctor_id", F.lit("token"))
    return Board("worklist", _route_opd(tokens), rank)


# -- lab and pharmacy boards --------------------------------------------------
def _route_own(tokens: DataFrame, token: str, day: str, statuses: str) -> Callable[[DataFrame], DataFrame]:
    known = tokens.select(F.col(token).alias("token_id"), F.col(day).alias("day"))

    def route(requests: DataFrame) -> DataFrame:
        r = requests.where(F.col("new_status").isin(*ENUMS[statuses]))
        return r.join(known, "token_id").select("day", "req_id", "ts", "token_id", F.lit(None).cast("int").alias("department_id"),
                                                "new_status", F.lit(True).alias("own"))
    return route


def _own_now(tokens: DataFrame, token: str, status: str, log: DataFrame) -> DataFrame:
    t = tokens.join(_last_own(log), tokens[token] == F.col("_token"), "left")
    return t.withColumn(status, F.coalesce("_own.new_status", status)).drop("_own", "_token")


def lab_board(lab_tokens: DataFrame, lab_bookings: DataFrame, lab_tests: DataFrame) -> Board:
    """The queue of every lab test."""
    def rank(days: list, log: DataFrame) -> DataFrame:
        now = _own_now(_days_of(lab_tokens, "scheduled_date", days), "token_id", "token_status", log)
        q = queues.lab_queue(now, _days_of(lab_bookings, "appointment_date", days), lab_tests)
        return _board(q, "test_id", F.col("checkin_status"))
    return Board("lab", _route_own(lab_tokens, "token_id", "scheduled_date", "lab_status"), rank)


def pharmacy_board(pharmacy_tokens: DataFrame, pharmacies: DataFrame) -> Board:
    """The tokens of every pharmacy that are not cancelled, in the order of their arrival."""
    from wardline.operators.directory import pharmacy_queue

    def rank(days: list, log: DataFrame) -> DataFrame:
        now = _own_now(_days_of(pharmacy_tokens, "queue_date", days), "id", "status", log)
        return _board(pharmacy_queue(now.where("status <> 'cancelled'"), pharmacies), "pharmacy_id", F.lit("token"))
    return Board("pharmacy", _route_own(pharmacy_tokens, "id", "queue_date", "pharmacy_status"), rank)


# -- maintenance --------------------------------------------------------------
def changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """Rows of two snapshots that differ, as inserts, updates and deletes."""
    key = ["queue_date", "group_id", "branch", "id"]
    a = old.select(*key, F.struct("token_number", "status", "position").alias("a"))
    b = new.select(*key, F.struct("token_number", "status", "position").alias("b"))
    op = F.when(F.col("a").isNull(), "insert").when(F.col("b").isNull(), "delete").otherwise("update")
    return a.join(b, key, "full").where("a is null or b is null or a <> b").select(
        op.alias("op"), *key, F.coalesce("b.token_number", "a.token_number").alias("token_number"),
        F.col("a.position").alias("old_position"), F.col("b.position").alias("position"),
        F.col("a.status").alias("old_status"), F.col("b.status").alias("status"))


class BoardSink:
    """``foreachBatch`` writer that maintains one board below ``root``."""

    def __init__(self, spark: SparkSession, board: Board, root: str):
        self.board, self.root = board, root.rstrip("/")
        schema = board.rank([], self._log(spark, [], empty=True)).select(*BOARD).schema
        self.snapshots = DaySnapshots(spark, f"{self.root}/board", schema)

    LOG = ("req_id long, ts timestamp_ntz, token_id long, department_id int, new_status string, own boolean, day date, "
           "batch long")

    def _log(self, spark: SparkSession, days: list, empty: bool = False) -> DataFrame:
        if empty:
            return spark.createDataFrame([], self.LOG)
        return spark.read.schema(self.LOG).parquet(f"{self.root}/log").where(F.col("day").isin(days))

    def start(self, spark: SparkSession, days: list) -> None:
        """The snapshots of ``days`` before any request."""
        self.snapshots.commit(self.board.rank(days, self._log(spark, days, empty=True)).select(*BOARD), days)

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        routed = self.board.route(batch).withColumn("batch", F.lit(batch_id).cast("long"))
        routed.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day", "batch").parquet(
            f"{self.root}/log")
        # a batch touches a day or two; their number is that of the day folders just written
        days = [r[0] for r in spark.read.schema(self.LOG).parquet(f"{self.root}/log").where(F.col("batch") == batch_id)
                .select("day").distinct().collect()]
        if not days:
            return
        version, content = self.snapshots.manifest()
        if content["batches"].get(self.board.name, -1) >= batch_id:
            return
        new = self.board.rank(days, self._log(spark, days).where(F.col("batch") <= batch_id)).select(*BOARD)
        new = new.persist()
        try:
            old = self.snapshots.read(days, version if version else None)
            changes(old, new).write.mode("overwrite").parquet(f"{self.root}/changes/batch={batch_id}")
            # the changelog is complete before the snapshots move on; a crash between the two repeats both
            self.snapshots.commit(new, days, (self.board.name, batch_id))
        finally:
            new.unpersist()

    def changelog(self, spark: SparkSession) -> DataFrame:
        """All changes with the batch that made them."""
        return spark.read.schema(f"{CHANGES}, batch long").parquet(f"{self.root}/changes")
