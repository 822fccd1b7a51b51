"""Every registered query against its SQL."""

import pytest

import __spark_entry__ as entry
from conftest import DATA
from oracle import compare, connect


@pytest.fixture(scope="module")
def duck():
    connection = connect(DATA)
    yield connection
    connection.close()


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    assert compare(entry.queries()[name](spark, DATA), duck, entry.oracle_sql()[name]) == []


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0


def test_sketched_stats_are_close(spark):
    stats = {r["column_name"]: r for r in entry.queries()["column_stats_sketch"](spark, DATA).collect()}
    exact = spark.read.parquet(f"{DATA}/lineitem.parquet").select("l_partkey").distinct().count()
    assert abs(stats["l_partkey"]["distinct_count"] - exact) <= 0.2 * exact
    assert stats["l_returnflag"]["distinct_count"] == 3
