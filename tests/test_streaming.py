"""Stream parity: the streaming folds reproduce their batch twins."""

import datetime as dt
import os
import tempfile

import pytest
from pyspark.sql import functions as F

from paths import SF001
from wardline.sources.hospital import Hospital
from wardline.streaming import alerts, boards, break_stream, status_stream


def _split_write(df, path, n_files, order_col="ts"):
    """Write ``df`` as ``n_files`` parquet files in time order (one micro-batch each)."""
    from pyspark.sql import Window
    w = Window.orderBy(order_col, "req_id")
    ranked = df.withColumn("_b", F.ntile(n_files).over(w))
    for b in range(1, n_files + 1):
        ranked.where(F.col("_b") == b).drop("_b").coalesce(1).write.mode("overwrite") \
            .parquet(os.path.join(path, f"part={b:03d}"))


def _status_events(h, per_key=status_stream.TOKENS_PER_KEY):
    routed = status_stream.route_requests(h.status_log, h.tokens, h.doctors, per_key)
    return status_stream.arrival_events(h.tokens, h.doctors, per_key).unionByName(routed)


def _flush(spark, path, part):
    """An event far ahead, so that the frontier passes all others."""
    row = (-1, dt.date(2024, 6, 1), 0, dt.datetime(2024, 6, 1), -1, 0, -1, "completed", "", "")
    spark.createDataFrame([row], status_stream.EVENT_SCHEMA).coalesce(1).write.parquet(os.path.join(path, f"part={part:03d}"))


def _run_status(spark, ev_dir, root, name, lateness="1 day"):
    stream = (spark.readStream.schema(status_stream.EVENT_SCHEMA).option("maxFilesPerTrigger", 1)
              .option("recursiveFileLookup", "true").parquet(ev_dir))
    out = status_stream.status_fold_stream(stream, lateness)
    q = (out.writeStream.format("parquet").option("path", os.path.join(root, "out")).outputMode("append")
         .option("checkpointLocation", os.path.join(root, "ckpt")).trigger(availableNow=True).start())
    q.awaitTermination(900)
    return spark.read.parquet(os.path.join(root, "out"))


def _same_as_batch(h, got):
    assert got.where(F.col("kind") == "late").count() == 0
    a = got.where(F.col("kind") == "alert").select("token_id", "req_id", "alert", "message")
    b = alerts.status_alerts(h.tokens, h.status_log, h.doctors).select("token_id", "req_id", "alert", "message")
    assert sorted(a.collect()) == sorted(b.collect()) and a.count() > 0
    # M3: the status feed ends each token in the batch fold's final status
    from pyspark.sql import Window
    from wardline.operators import folds
    feed = got.where(F.col("kind") == "status")
    w = Window.partitionBy("token_id").orderBy(F.desc("ts"), F.desc("req_id"))
    last = feed.withColumn("_r", F.row_number().over(w)).where(F.col("_r") == 1) \
        .select("token_id", F.col("alert").alias("final"))
    fold = folds.opd_status_fold(h.tokens, h.status_log)
    joined = fold.join(last, fold.id == last.token_id, "left")
    assert joined.where(F.coalesce(F.col("final"), F.col("old_status")) != F.col("new_status")).count() == 0
    assert feed.count() > 0
    # every day is closed behind the last event
    expired = got.where(F.col("kind") == "expired").select("token_id", "queue_date")
    twin = alerts.expired_tokens(h.tokens, h.status_log).select(F.col("id").alias("token_id"), "queue_date")
    assert sorted(expired.collect()) == sorted(twin.collect()) and expired.count() > 0


@pytest.mark.parametrize("per_key", [status_stream.TOKENS_PER_KEY, 3])
def test_status_stream_with_shuffled_files_and_a_restart_matches_batch(spark, per_key):
    """Files hold events up to a day apart in any order; the query stops between them and goes on from its checkpoint."""
    h = Hospital(spark, SF001)
    root = tempfile.mkdtemp(prefix="wl-stream-", dir="/tmp")
    ev_dir = os.path.join(root, "events")
    shuffled = _status_events(h, per_key).withColumn(
        "_at", F.unix_timestamp("ts") + F.pmod(F.xxhash64("token_id", "req_id", "kind"), F.lit(80_000)))
    _split_write(shuffled, ev_dir, 4, "_at")
    _run_status(spark, ev_dir, root, "first")
    _flush(spark, ev_dir, 5)
    _same_as_batch(h, _run_status(spark, ev_dir, root, "second"))


def test_only_events_beyond_the_lateness_are_late(spark):
    h = Hospital(spark, SF001)
    root = tempfile.mkdtemp(prefix="wl-late-", dir="/tmp")
    ev_dir = os.path.join(root, "events")
    events = _status_events(h).where("kind <> 0 and ts < '2024-01-06'")
    early = (F.col("ts") < "2024-01-02 06:00:00")
    held = early & (F.col("req_id") % 5 == 0)
    events.where(~held & (F.col("ts") < "2024-01-03")).coalesce(1).write.parquet(os.path.join(ev_dir, "part=001"))
    events.where(~held & (F.col("ts") >= "2024-01-03")).coalesce(1).write.parquet(os.path.join(ev_dir, "part=002"))
    events.where(held).coalesce(1).write.parquet(os.path.join(ev_dir, "part=003"))
    _flush(spark, ev_dir, 4)
    late = _run_status(spark, ev_dir, root, "late").where("kind = 'late'").select("req_id", "token_id")
    # a reset is its own event: one row for each routed event
    assert sorted(late.collect()) == sorted(events.where(held).select("req_id", "token_id").collect())
    assert late.count() > 0


def test_state_of_a_day_is_dropped(spark):
    h = Hospital(spark, SF001)
    root = tempfile.mkdtemp(prefix="wl-state-", dir="/tmp")
    ev_dir = os.path.join(root, "events")
    _split_write(_status_events(h).where("ts < '2024-01-08'"), ev_dir, 3)
    _run_status(spark, ev_dir, root, "state")
    held = spark.read.format("statestore").option("stateVarName", "tokens").load(os.path.join(root, "ckpt"))
    days = {r[0] for r in held.select("key.key_day").distinct().collect()}
    # the frontier is a day behind 2024-01-07, so its events wait; a day is kept one day longer
    assert min(days) >= dt.date(2024, 1, 5) and max(days) == dt.date(2024, 1, 6)


def test_board_refresh_is_partition_scoped_and_idempotent(spark):
    h = Hospital(spark, SF001)
    root = tempfile.mkdtemp(prefix="wl-board-", dir="/tmp")
    sink = boards.refresh_sink(os.path.join(root, "log"), os.path.join(root, "board"),
                               boards.live_board(h.tokens, h.prebooked_appointments))
    log = h.status_log.where(F.col("d") == "2024-01-02")
    sink(log, 0)
    sink(log, 0)  # retried batch: same result
    board = spark.read.parquet(os.path.join(root, "board"))
    assert [r[0].isoformat() for r in board.select("queue_date").distinct().collect()] == ["2024-01-02"]
    # equals the batch operator over the same inputs
    from wardline.operators import folds, queues
    t = h.tokens.where(F.col("queue_date") == "2024-01-02")
    f = folds.opd_status_fold(t, log).select("id", F.col("new_status").alias("_s"))
    t = t.join(f, "id").withColumn("status", F.col("_s")).drop("_s")
    want = queues.live_queue(t, h.prebooked_appointments.where(F.col("appointment_date") == "2024-01-02"))
    cols = ["doctor_id", "position", "token_number", "status"]
    assert sorted(board.select(*cols).collect()) == sorted(want.select(*cols).collect())


def test_board_and_break_streams_end_to_end(spark):
    """M2 / M5: request streams through foreachBatch; final boards equal the
    batch operators over the whole log."""
    from wardline.operators import folds, queues
    h = Hospital(spark, SF001)
    root = tempfile.mkdtemp(prefix="wl-boards-", dir="/tmp")
    _split_write(h.status_log, os.path.join(root, "status_in"), 3)
    _split_write(h.break_log, os.path.join(root, "break_in"), 3)

    def run(src, schema_df, sink, name):
        stream = (spark.readStream.schema(schema_df.schema).option("maxFilesPerTrigger", 1)
                  .option("recursiveFileLookup", "true").parquet(os.path.join(root, src)))
        q = (stream.writeStream.foreachBatch(sink).option("checkpointLocation", os.path.join(root, name))
             .trigger(availableNow=True).start())
        q.awaitTermination(600)

    board_path = os.path.join(root, "board")
    run("status_in", h.status_log, boards.refresh_sink(os.path.join(root, "status_log"), board_path,
                                                       boards.live_board(h.tokens, h.prebooked_appointments),
                                                       boards.status_touched_days(h.tokens)),
        "ck1")
    days = boards.status_touched_days(h.tokens)(h.status_log)
    t = h.tokens.where(F.col("queue_date").isin(days))
    f = folds.opd_status_fold(t, h.status_log).select("id", F.col("new_status").alias("_s"))
    t = t.join(f, "id").withColumn("status", F.col("_s")).drop("_s")
    want = queues.live_queue(t, h.prebooked_appointments.where(F.col("appointment_date").isin(days)))
    cols = ["doctor_id", "position", "token_number", "status"]
    got = spark.read.parquet(board_path)
    assert sorted(got.select(*cols).collect()) == sorted(want.select(*cols).collect())

    break_path = os.path.join(root, "breaks")
    run("break_in", h.break_log, boards.refresh_sink(os.path.join(root, "break_log"), break_path,
                                                     boards.break_board()), "ck2")
    want_b = folds.break_state(h.break_log).select("doctor_id", "status", "break_start")
    got_b = spark.read.parquet(break_path).select("doctor_id", "status", "break_start")
    assert sorted(got_b.collect()) == sorted(want_b.collect())


def _run_breaks(spark, schema, in_dir, root, stored=None):
    stream = (spark.readStream.schema(schema).option("maxFilesPerTrigger", 1)
              .option("recursiveFileLookup", "true").parquet(in_dir))
    def sink(batch, batch_id):
        batch.write.mode("overwrite").parquet(os.path.join(root, "out", f"batch={batch_id}"))
    q = (break_stream.break_stream(stream, stored).writeStream.foreachBatch(sink).outputMode("update")
         .option("checkpointLocation", os.path.join(root, "ckpt")).trigger(availableNow=True).start())
    q.awaitTermination(600)
    return break_stream.latest(spark.read.schema(break_stream.OUTPUT).option("recursiveFileLookup", "true")
                               .parquet(os.path.join(root, "out")))


def _breaks(df):
    return sorted((r.doctor_id, r.break_date, r.break_start, r.break_end, r.status, r.is_on_break)
                  for r in df.select("doctor_id", "break_date", F.col("break_start").cast("timestamp").alias("break_start"),
                                     F.col("break_end").cast("timestamp").alias("break_end"), "status", "is_on_break")
                  .collect())


def _key(rows):
    return [tuple(str(x) for x in r) for r in rows]


def test_break_stream_with_a_restart_matches_batch(spark):
    from wardline.operators import folds
    h = Hospital(spark, SF001)
    root = tempfile.mkdtemp(prefix="wl-breaks-", dir="/tmp")
    in_dir = os.path.join(root, "in")
    # requests of a day in any order
    log = h.break_log.withColumn("_at", F.unix_date("d") * 100 + F.pmod(F.xxhash64("req_id"), F.lit(100)))
    parts = [log.where("d < '2024-01-11'"), log.where("d >= '2024-01-11'")]
    _split_write(parts[0], os.path.join(in_dir, "a"), 2, "_at")
    _run_breaks(spark, h.break_log.schema, in_dir, root)
    _split_write(parts[1], os.path.join(in_dir, "b"), 2, "_at")
    got = _run_breaks(spark, h.break_log.schema, in_dir, root)
    assert _key(_breaks(got)) == _key(_breaks(folds.break_state(h.break_log)))
    held = spark.read.format("statestore").option("stateVarName", "last").load(os.path.join(root, "ckpt"))
    days = {r[0] for r in held.select("key.break_date").distinct().collect()}
    assert days and min(days) >= dt.date(2024, 1, 11)  # state of days behind the watermark is gone


def test_break_stream_starts_from_the_stored_table(spark):
    from wardline.operators import folds
    h = Hospital(spark, SF001)
    root = tempfile.mkdtemp(prefix="wl-breaks-", dir="/tmp")
    in_dir = os.path.join(root, "in")
    day = h.break_log.where("d = '2024-01-09'")
    noon = F.col("ts") < "2024-01-09 12:00:00"
    before = folds.break_state(day.where(noon))
    day.where(~noon).coalesce(1).write.parquet(in_dir)
    got = _run_breaks(spark, h.break_log.schema, in_dir, root, before)
    want, unchanged = folds.break_state(day), _breaks(before)
    assert set(_key(_breaks(got))) == set(_key(_breaks(want))) - set(_key(unchanged)) and got.count() > 0
