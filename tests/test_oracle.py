"""Every registered query equals its DuckDB oracle (sf0.001), and the
adapter tables equal their SQL twins."""

import pytest

import __spark_entry__ as entry
from paths import SF001
from wardline.plans.catalog import QUERIES
from wardline.plans.oracle import SQL
from oracle_compare import compare, duck, rows_of


@pytest.fixture(scope="module")
def con():
    return duck(SF001)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_oracle(spark, con, name):
    res = compare(spark, con, SF001, QUERIES[name], SQL.get(name))
    assert res["ok"], res


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(SQL)
    assert set(QUERIES) <= set(entry.queries()) and set(SQL) <= set(entry.oracle_sql())


def test_entry_smoke(spark):
    df = entry.entry(spark)
    assert df.count() > 0
    assert df.columns == entry.entry(spark).columns


ADAPTER_TABLES = ["departments", "doctors", "tokens", "prebooked_appointments", "lab_tokens",
                  "prebooked_lab_appointments", "pharmacies", "pharmacy_tokens", "status_log", "break_log",
                  "lookup_log", "cancel_log", "booking_cancel_log", "reschedule_log", "lab_cancel_log",
                  "pharmacy_cancel_log", "pharmacy_status_log", "lab_status_log", "checkin_log",
                  "opd_issue_log", "lab_issue_log", "pharmacy_issue_log", "staff", "pharmacy_staff"]


@pytest.mark.parametrize("table", ADAPTER_TABLES)
def test_adapter_table_matches_sql(spark, con, table):
    from wardline.plans.catalog import portable
    from wardline.plans.oracle import ADAPTER
    from wardline.sources.hospital import Hospital
    df = portable(getattr(Hospital(spark, SF001), table))
    a = rows_of(df.columns, [tuple(r) for r in df.collect()])
    rel = con.sql(ADAPTER + f" SELECT * FROM {table}")
    cols = []
    for c, t in zip(rel.columns, [str(x) for x in rel.types]):
        if t == "DATE":
            cols.append(f"CAST({c} AS VARCHAR) AS {c}")
        elif t.startswith("TIMESTAMP"):
            cols.append(f"strftime({c}, '%Y-%m-%d %H:%M:%S') AS {c}")
        else:
            cols.append(c)
    r2 = con.sql(ADAPTER + " SELECT " + ", ".join(cols) + f" FROM {table}")
    assert sorted(df.columns) == sorted(r2.columns)
    assert a == rows_of(r2.columns, r2.fetchall())
