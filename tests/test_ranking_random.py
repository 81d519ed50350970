"""Randomised check of the range-partitioned scans against pandas."""

import pandas as pd
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from wardline.operators.ranking import lag_within, number_rows, running_sum

rows = st.lists(st.tuples(st.one_of(st.none(), st.integers(0, 3)),      # group (NULL allowed)
                          st.integers(0, 20),                            # order key (ties)
                          st.one_of(st.none(), st.integers(-5, 5))),     # value (NULL allowed)
                min_size=1, max_size=60)


def _expected(data):
    df = pd.DataFrame(data, columns=["g", "k", "v"])
    df["id"] = range(len(df))
    df["gk"] = df["g"].fillna(-1)
    df = df.sort_values(["gk", "k", "id"])
    grp = df.groupby("gk", sort=False)
    df["pos"] = grp.cumcount() + 1
    df["s"] = grp["v"].transform(lambda x: x.fillna(0).cumsum())
    df["lag"] = grp["v"].shift(1)
    df["last"] = grp["v"].transform(lambda x: x.ffill().shift(1))
    return df.set_index("id")


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(data=rows, parts=st.integers(1, 6))
def test_range_scans_match_pandas(spark, data, parts):
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        exp = _expected(data)
        sdf = spark.createDataFrame([(g, k, v, i) for i, (g, k, v) in enumerate(data)],
                                    "g int, k int, v int, id int")
        order = ["k", "id"]
        pos = {r.id: r.pos for r in number_rows(sdf, ["g"], order, "pos", strategy="range").collect()}
        sums = {r.id: r.s for r in running_sum(sdf, ["g"], order, "v", "s", strategy="range").collect()}
        lag = {r.id: r.p for r in lag_within(sdf, ["g"], order, "v", "p", strategy="range").collect()}
        last = {r.id: r.p for r in lag_within(sdf, ["g"], order, "v", "p", ignore_nulls=True,
                                              strategy="range").collect()}
        for i, row in exp.iterrows():
            assert pos[i] == row.pos
            assert sums[i] == row.s
            assert (lag[i] is None and pd.isna(row.lag)) or lag[i] == row.lag
            assert (last[i] is None and pd.isna(row["last"])) or last[i] == row["last"]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
