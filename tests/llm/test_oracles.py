"""Registered queries of the training-data operators: DuckDB where SQL can express them, all tables."""

import pytest

import __spark_entry__ as entry
from oracle_compare import compare, duck
from wardline.llm.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_matches_sql(spark, name):
    res = compare(spark, duck(SF), SF, QUERIES[name], ORACLE_SQL[name])
    assert res["ok"], res


def test_every_operator_is_registered():
    numbers = sorted(int(name[2:].split("_")[0]) for name in QUERIES)
    assert numbers == list(range(1, 14))
    assert set(QUERIES) | {"pipeline"} <= set(entry.queries())
    assert set(ORACLE_SQL) <= set(entry.oracle_sql())
