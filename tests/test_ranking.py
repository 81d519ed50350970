"""number_rows / running_sum: the hot-group (range) path equals the window path."""

from pyspark.sql import functions as F

from wardline.operators.ranking import number_rows, running_sum


def _data(spark):
    # one hot group (g=0 holds ~1/3 of rows), many small ones, a NULL key group
    df = spark.range(0, 3000).select(
        F.when(F.col("id") % 3 == 0, F.lit(0)).when(F.col("id") % 97 == 1, F.lit(None))
         .otherwise(F.col("id") % 11 + 1).alias("g"),
        ((F.col("id") * 7919) % 1000).alias("k"), F.col("id"),
        (F.col("id") % 4).alias("v"))
    return df


def test_range_equals_window(spark):
    df = _data(spark)
    a = number_rows(df, ["g"], ["k", "id"], "pos", count_name="n", strategy="window")
    b = number_rows(df, ["g"], ["k", "id"], "pos", count_name="n", strategy="range")
    assert sorted(a.select("id", "pos", "n").collect()) == sorted(b.select("id", "pos", "n").collect())


def test_auto_split_hot_group(spark):
    df = _data(spark)
    a = number_rows(df, ["g"], ["k", "id"], "pos", strategy="window")
    b = number_rows(df, ["g"], ["k", "id"], "pos", hot_rows=500)  # g=0 is hot
    assert sorted(a.select("id", "pos").collect()) == sorted(b.select("id", "pos").collect())


def test_running_sum_paths(spark):
    df = _data(spark)
    a = running_sum(df, ["g"], ["k", "id"], "v", "s", strategy="window")
    b = running_sum(df, ["g"], ["k", "id"], "v", "s", hot_rows=500)
    c = running_sum(df, ["g"], ["k", "id"], "v", "s", strategy="range")
    ra = sorted(a.select("id", "s").collect())
    assert ra == sorted(b.select("id", "s").collect()) == sorted(c.select("id", "s").collect())


def test_positions_are_dense(spark):
    df = _data(spark)
    b = number_rows(df, ["g"], ["k", "id"], "pos", count_name="n", strategy="range")
    bad = b.groupBy("g").agg(F.min("pos").alias("lo"), F.max("pos").alias("hi"),
                             F.count("*").alias("c"), F.max("n").alias("n")) \
        .where((F.col("lo") != 1) | (F.col("hi") != F.col("c")) | (F.col("n") != F.col("c")))
    assert bad.count() == 0


from wardline.operators.ranking import lag_within  # noqa: E402


def _lag_data(spark):
    return spark.range(0, 3000).select(
        F.when(F.col("id") % 3 == 0, F.lit(0)).otherwise(F.col("id") % 13 + 1).alias("g"),
        ((F.col("id") * 7919) % 1000).alias("k"), F.col("id"),
        F.when(F.col("id") % 5 == 0, F.lit(None)).otherwise(F.col("id") * 10).alias("v"))


def test_lag_paths_agree(spark):
    df = _lag_data(spark)
    for ign in (False, True):
        a = lag_within(df, ["g"], ["k", "id"], "v", "p", ignore_nulls=ign, strategy="window")
        b = lag_within(df, ["g"], ["k", "id"], "v", "p", ignore_nulls=ign, strategy="range")
        c = lag_within(df, ["g"], ["k", "id"], "v", "p", ignore_nulls=ign, hot_rows=500)
        ra = sorted(a.select("id", "p").collect())
        assert ra == sorted(b.select("id", "p").collect()), ign
        assert ra == sorted(c.select("id", "p").collect()), ign
