"""Day snapshots that change as a whole, and boards that are maintained with a changelog."""

import datetime as dt
import os
import tempfile

import pytest
from pyspark.sql import functions as F

from paths import SF001
from wardline.operators import folds, queues
from wardline.sources.snapshots import CommitConflict, DaySnapshots
from wardline.sources.staging import staged_hospital
from wardline.streaming import board_changes
from pyspark.sql import types as T

SCHEMA = T.StructType([T.StructField("queue_date", T.DateType()), T.StructField("id", T.LongType())])
D1, D2, D3 = (dt.date(2024, 1, d) for d in (1, 2, 3))


def _store(spark):
    return DaySnapshots(spark, tempfile.mkdtemp(prefix="wl-snap-", dir="/tmp"), SCHEMA)


def _rows(df):
    return sorted(tuple(r) for r in df.collect())


def _frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def test_a_change_is_seen_whole_or_not_at_all(spark, monkeypatch):
    store = _store(spark)
    store.commit(_frame(spark, [(D1, 1), (D2, 2), (D3, 3)]), [D1, D2, D3])
    before = store.read()
    # the writer dies behind its files and in front of its manifest
    publish = DaySnapshots._publish
    monkeypatch.setattr(DaySnapshots, "_publish", lambda *a: (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(OSError):
        store.commit(_frame(spark, [(D1, 10), (D2, 20)]), [D1, D2], ("w", 1))
    monkeypatch.setattr(DaySnapshots, "_publish", publish)
    assert _rows(store.read()) == [(D1, 1), (D2, 2), (D3, 3)]
    # the batch comes again
    store.commit(_frame(spark, [(D1, 10), (D2, 20)]), [D1, D2], ("w", 1))
    assert _rows(store.read()) == [(D1, 10), (D2, 20), (D3, 3)]
    # a reader that began before still reads what it began with
    assert _rows(before) == [(D1, 1), (D2, 2), (D3, 3)]
    assert store.commit(_frame(spark, [(D1, 99)]), [D1], ("w", 1)) is None
    assert _rows(store.read()) == [(D1, 10), (D2, 20), (D3, 3)]


def test_wipe_vacuum_and_old_versions(spark):
    store = _store(spark)
    assert store.read().count() == 0
    first = store.commit(_frame(spark, [(D1, 1), (D2, 2)]), [D1, D2])
    store.wipe([D1])
    assert _rows(store.read()) == [(D2, 2)] and _rows(store.read(version=first)) == [(D1, 1), (D2, 2)]
    assert _rows(store.read([D1, D2])) == [(D2, 2)] and _rows(store.read([D1])) == []
    store.commit(_frame(spark, [(D2, 3)]), [D2])
    assert store.vacuum(keep=1) == 2 and _rows(store.read()) == [(D2, 3)]


def test_two_writers_of_one_version(spark, monkeypatch):
    store = _store(spark)
    store.commit(_frame(spark, [(D1, 1)]), [D1])
    stale = store.manifest()
    store.commit(_frame(spark, [(D1, 2)]), [D1])
    monkeypatch.setattr(store, "manifest", lambda version=None: stale)
    with pytest.raises(CommitConflict):
        store.commit(_frame(spark, [(D1, 3)]), [D1])
    monkeypatch.undo()
    assert _rows(store.read()) == [(D1, 2)]


def test_reading_a_day_reads_its_folder(spark):
    store = _store(spark)
    store.commit(_frame(spark, [(D1, 1), (D2, 2)]), [D1, D2])
    assert all("queue_date=2024-01-02" in f for f in store.read([D2]).inputFiles())


# -- boards -------------------------------------------------------------------
def _boards(h):
    return {
        "live": (board_changes.live_board(h.tokens, h.prebooked_appointments), h.status_log),
        "worklist": (board_changes.worklist_board(h.tokens), h.status_log),
        "lab": (board_changes.lab_board(h.lab_tokens, h.prebooked_lab_appointments, h.lab_tests), h.lab_status_log),
        "pharmacy": (board_changes.pharmacy_board(h.pharmacy_tokens, h.pharmacies), h.pharmacy_status_log),
    }


def _whole(h, name):
    """The board after the whole log, by the batch operators."""
    if name in ("live", "worklist"):
        f = folds.opd_status_fold(h.tokens, h.status_log).select("id", F.col("new_status").alias("_s"))
        t = h.tokens.join(f, "id").withColumn("status", F.col("_s")).drop("_s")
        q = (queues.live_queue(t, h.prebooked_appointments, scope="doctor") if name == "live" else queues.doctor_worklist(t))
        return q.select("queue_date", F.col("doctor_id").alias("g"), "id", "token_number", "status", "position")
    if name == "lab":
        last = h.lab_status_log.where(F.col("new_status").isin("waiting", "in_progress", "completed", "cancelled", "no_show")) \
            .groupBy("token_id").agg(F.max_by("new_status", F.struct("ts", "req_id")).alias("_s"))
        t = h.lab_tokens.join(last, "token_id", "left").withColumn("token_status", F.coalesce("_s", "token_status"))
        q = queues.lab_queue(t, h.prebooked_lab_appointments, h.lab_tests)
        return q.select("queue_date", F.col("test_id").alias("g"), "id", "token_number", "status", "position")
    from pyspark.sql import Window
    last = h.pharmacy_status_log.where("new_status <> 'ready'").groupBy("token_id").agg(
        F.max_by("new_status", F.struct("ts", "req_id")).alias("_s"))
    t = h.pharmacy_tokens.join(last, F.col("id") == F.col("token_id"), "left").withColumn("status", F.coalesce("_s", "status"))
    t = t.join(h.pharmacies.select(F.col("id").alias("pharmacy_id")), "pharmacy_id").where("status <> 'cancelled'")
    w = Window.partitionBy("queue_date", "pharmacy_id").orderBy("created_at", "id")
    return t.select("queue_date", F.col("pharmacy_id").alias("g"), "id", "token_number", "status",
                    F.row_number().over(w).alias("position"))


@pytest.mark.parametrize("name", ["live", "worklist", "lab", "pharmacy"])
def test_board_stream_equals_the_batch_board(spark, name):
    h = staged_hospital(spark, SF001)
    board, log = _boards(h)[name]
    root = tempfile.mkdtemp(prefix="wl-board-", dir="/tmp")
    sink = board_changes.BoardSink(spark, board, root)
    days = [r[0] for r in h.tokens.select("queue_date").distinct().collect()]
    sink.start(spark, days)
    start = {tuple(r)[:4]: tuple(r)[4:] for r in sink.snapshots.read().select(*board_changes.BOARD).collect()}
    for i, cut in enumerate([("2024-01-01", "2024-01-12"), ("2024-01-12", "2024-01-25"), ("2024-01-25", "2024-03-01")]):
        log.where((F.col("d") >= cut[0]) & (F.col("d") < cut[1])).coalesce(1).write.parquet(os.path.join(root, "in", f"{i}"))
    stream = (spark.readStream.schema(log.schema).option("maxFilesPerTrigger", 1)
              .option("recursiveFileLookup", "true").parquet(os.path.join(root, "in")))
    q = (stream.writeStream.foreachBatch(sink).option("checkpointLocation", os.path.join(root, "ckpt"))
         .trigger(availableNow=True).start())
    q.awaitTermination(600)
    got = sink.snapshots.read()
    cols = ["queue_date", "id", "token_number", "status", "position"]
    assert sorted(map(str, got.select("group_id", *cols).collect())) == sorted(map(str, _whole(h, name).select(
        F.col("g").cast("long").alias("group_id"), "queue_date", F.col("id").cast("long").alias("id"), "token_number",
        "status", F.col("position").cast("long").alias("position")).collect()))
    # the changelog, applied to the first snapshots, gives the last ones
    for r in sorted(sink.changelog(spark).collect(), key=lambda r: r.batch):
        key = (r.queue_date, r.group_id, r.branch, r.id)
        if r.op == "delete":
            assert start.pop(key)[2] == r.old_position
        else:
            assert (r.op == "insert") == (key not in start)
            start[key] = (r.token_number, r.status, r.position)
    assert start == {tuple(r)[:4]: tuple(r)[4:] for r in got.select(*board_changes.BOARD).collect()}


def test_a_batch_reads_only_its_days_and_can_come_again(spark):
    h = staged_hospital(spark, SF001)
    board, log = _boards(h)["lab"]
    sink = board_changes.BoardSink(spark, board, tempfile.mkdtemp(prefix="wl-board-", dir="/tmp"))
    day = log.where("d = '2024-01-10'")
    sink(day, 0)
    version = sink.snapshots.manifest()[0]
    first = _rows(sink.changelog(spark))
    sink(day, 0)
    assert sink.snapshots.manifest()[0] == version and _rows(sink.changelog(spark)) == first and first
    days = sorted({r[0] for r in sink.snapshots.read().select("queue_date").distinct().collect()})
    plan = board.rank(days, sink._log(spark, days))._jdf.queryExecution().executedPlan().toString()
    import re
    for scan in re.findall(r"FileScan parquet \[[^\n]*", plan):
        if re.match(r"FileScan parquet \[[^\]]*(queue_date|_date|day)#", scan):
            assert re.search(r"PartitionFilters: \[[^\]]*(_date|day)", scan), scan
