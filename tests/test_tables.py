"""Table maintenance operators."""

import datetime as dt
import json
import os
import tempfile

from pyspark.sql import functions as F
from pyspark.sql import types as T

from wardline.operators import requests, tables


def test_harmonize_adds_missing_and_defaults(spark):
    df = spark.createDataFrame([(1, "x")], "id int, name string")
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("name", T.StringType()),
                           T.StructField("icon", T.StringType()), T.StructField("fees", T.IntegerType())])
    out = tables.harmonize(df, schema, {"fees": 0}).collect()[0]
    assert (out.id, out.name, out.icon, out.fees) == (1, "x", None, 0)


def test_upsert_last_wins_for_listed_first_for_new(spark):
    base = spark.createDataFrame([(1, "a", 10, 7)], "id int, name string, fees int, dep int")
    upd = spark.createDataFrame([(1, "b", 20, 9, 1), (1, "c", 30, 8, 2), (2, "n", 5, 3, 1), (2, "m", 6, 4, 2)],
                                "id int, name string, fees int, dep int, seq int")
    got = {r.id: (r.name, r.fees, r.dep) for r in tables.upsert(base, upd, ["id"], ["name", "fees"], "seq").collect()}
    assert got == {1: ("c", 30, 7), 2: ("m", 6, 3)}


def test_insert_absent_and_backfill(spark):
    base = spark.createDataFrame([(1, "a")], "id int, name string")
    new = spark.createDataFrame([(1, "dup", 1), (2, "b", 1)], "id int, name string, seq int")
    got = sorted((r.id, r.name, r.source) for r in tables.insert_absent(base, new, ["id"], "seq").collect())
    assert got == [(1, "a", "base"), (2, "b", "inserted")]
    vals = spark.createDataFrame([(1, "z")], "id int, name string")
    assert tables.backfill(base, vals, ["id"], ["name"]).collect()[0].name == "z"


def test_reset_and_replace_days(spark):
    day = dt.date(2024, 1, 15)
    b = spark.createDataFrame([(1, day, "cancelled"), (2, dt.date(2024, 1, 16), "cancelled")],
                              "id int, appointment_date date, status string")
    got = {r.id: r.status for r in tables.reset_bookings(b, day).collect()}
    assert got == {1: "booked", 2: "cancelled"}
    path = os.path.join(tempfile.mkdtemp(prefix="wl-days-", dir="/tmp"), "t")
    d1 = spark.createDataFrame([(1, day), (2, dt.date(2024, 1, 16))], "v int, queue_date date")
    tables.replace_days(d1, path)
    tables.replace_days(spark.createDataFrame([(3, day)], "v int, queue_date date"), path)
    assert sorted(r.v for r in spark.read.parquet(path).collect()) == [2, 3]


def test_responses(spark):
    df = spark.createDataFrame([(1, 2, "A"), (1, 1, "B"), (2, 1, "C")], "g int, pos int, tok string")
    one = json.loads(tables.to_response(df.where("g = 2")).collect()[0][0])
    assert one == {"g": 2, "pos": 1, "tok": "C"}
    grp = {r.g: json.loads(r.queue) for r in tables.grouped_response(df, ["g"], "pos", ["pos", "tok"]).collect()}
    assert grp[1] == [{"pos": 1, "tok": "B"}, {"pos": 2, "tok": "A"}]


def test_intval_matches_php(spark):
    df = spark.createDataFrame([("12abc",), (" 7",), ("abc",), ("",), (None,), ("-3x",), ("4.9",)], "s string")
    assert [r[0] for r in df.select(requests.intval(F.col("s"))).collect()] == [12, 7, 0, 0, 0, -3, 4]


def test_parse_typed_batch_and_stream(spark):
    rows = [('{"token": " pb003 ", "notify": false}',), ('{"token_id": "12abc"}',), ('{}',)]
    df = spark.createDataFrame(rows, "body string")
    got = requests.parse_typed(df, "opd_cancel").select("token", "token_id", "booking_id", "reason", "notify").collect()
    assert tuple(got[0]) == ("PB003", 0, None, "due to being late", False)
    assert tuple(got[1]) == ("", 12, None, "due to being late", True)
    assert tuple(got[2]) == ("", 0, None, "due to being late", True)
    lab = spark.createDataFrame([('{"test_code": " mri", "payment_amount": "12.5x", "patient_age": 30}',)],
                                "body string")
    r = requests.parse_typed(lab, "lab_issue").collect()[0]
    assert (r.test_code, r.payment_amount, r.patient_age, r.patient_gender) == ("MRI", 12.5, 30, "")
    # the same columns on a stream
    import tempfile, os
    d = tempfile.mkdtemp(prefix="wl-req-", dir="/tmp")
    df.write.mode("overwrite").json(os.path.join(d, "in"))
    stream = spark.readStream.schema("body string").json(os.path.join(d, "in"))
    q = (requests.parse_typed(stream, "opd_cancel").writeStream.format("memory").queryName("parsed_requests")
         .option("checkpointLocation", os.path.join(d, "ck")).trigger(availableNow=True).start())
    q.awaitTermination(300)
    assert spark.table("parsed_requests").count() == 3


def test_a_day_without_rows_loses_its_partition(spark, tmp_path):
    import datetime as dt
    path = str(tmp_path / "days")
    days = [dt.date(2024, 1, 1), dt.date(2024, 1, 2), dt.date(2024, 1, 3)]
    tables.replace_days(spark.createDataFrame([(i, d) for i, d in enumerate(days)], "v int, queue_date date"), path)
    tables.replace_days(spark.createDataFrame([(9, days[0])], "v int, queue_date date"), path, days=days[:2])
    left = sorted((r.v, r.queue_date) for r in spark.read.parquet(path).collect())
    assert left == [(2, days[2]), (9, days[0])]
    tables.delete_days(spark, path, [days[2], dt.date(2030, 1, 1)])
    assert [r.v for r in spark.read.parquet(path).collect()] == [9]
