from datetime import datetime

from wardline.operators.ranking import lag_within, number_rows


def test_nested_timestamps_keep_their_microseconds(spark):
    rows = [(0, i, (datetime(2024, 1, 1, 0, 0, 0, 123456 + i), i)) for i in range(50)]
    df = spark.createDataFrame(rows, "g int, id int, s struct<at:timestamp_ntz,n:int>")
    for strategy in ("window", "range"):
        out = {r.id: r.s.at.microsecond for r in number_rows(df, ["g"], ["id"], "pos", strategy=strategy).collect()}
        assert out == {i: 123456 + i for i in range(50)}
        lag = {r.id: r.p for r in lag_within(df, ["g"], ["id"], "s", "p", strategy=strategy).collect()}
        assert lag[0] is None and all(lag[i].at.microsecond == 123455 + i for i in range(1, 50))


def test_positions_are_long_on_both_ways(spark):
    df = spark.range(20).selectExpr("id % 2 as g", "id")
    for strategy in ("window", "range"):
        assert dict(number_rows(df, ["g"], ["id"], "pos", "n", strategy=strategy).dtypes)["pos"] == "bigint"
