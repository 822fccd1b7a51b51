import json

import pytest
from conftest import DATA, plan_text, rows

from pipekit.sources import (
    JdbcSource,
    PagedEntitySource,
    TableSource,
    apply_types,
    first_row,
    mapped_types,
    oracle_url,
    parameterized,
    range_predicates,
    read_pages,
    read_table,
    since,
    spark_type,
    sqlserver_url,
)


def test_since_is_strict_unless_inclusive(spark):
    df = spark.range(5)
    assert rows(since(df, "id", 3)) == [(4,)]
    assert rows(since(df, "id", 3, inclusive=True)) == [(3,), (4,)]
    assert since(df, "id", None) is df


def test_since_is_typed_by_the_column_and_pushed(spark):
    orders = read_table(spark, DATA, "orders")
    late = since(orders, "o_orderdate", "1998-06-01 00:00:00")
    assert "GreaterThan(o_orderdate,1998-06-01T00:00)" in plan_text(late)
    hostile = since(spark.createDataFrame([("a",), ("b",)], "s string"), "s", "' OR '1'='1")
    assert hostile.count() == 2  # compared as a value, not read as SQL


def test_table_source(spark):
    spark.range(4).createOrReplaceTempView("four")
    source = TableSource(spark)
    assert source.read_table("four").count() == 4
    assert rows(source.read_incremental("four", "id", 2)) == [(3,)]
    assert first_row(source.read_table("four")).count() == 1


def test_parameterized_binds_values(spark):
    df = parameterized(spark, "SELECT id FROM {t} WHERE id > :low", {"low": 1}, t=spark.range(4))
    assert rows(df) == [(2,), (3,)]


def test_jdbc_urls_and_options(spark):
    assert oracle_url("h", 1521, "PROD") == "jdbc:oracle:thin:@h:1521:PROD"
    assert sqlserver_url("h", "sales") == "jdbc:sqlserver://h;databaseName=sales"
    source = JdbcSource(spark, oracle_url("h", 1, "s"), "me", "secret")
    options = source.options(dbtable="t", partitionColumn="id", lowerBound=1, upperBound=9, numPartitions=4)
    assert options["fetchsize"] == "10000" and options["numPartitions"] == "4" and options["user"] == "me"
    assert "fetchsize" not in JdbcSource(spark, "jdbc:x", fetch_size=None).options()
    assert "secret" not in repr(source)


def test_range_predicates_cover_every_row_once(spark):
    df = spark.createDataFrame([(i,) for i in [None, -5, 0, 3, 3, 7, 99]], "k int")
    for cuts in ([], [3], [0, 3, 50]):
        counts = [df.filter(predicate).count() for predicate in range_predicates("k", cuts)]
        assert sum(counts) == 7
    text = spark.createDataFrame([("a",), ("m'x",), ("z",)], "s string")
    assert sum(text.filter(p).count() for p in range_predicates("s", ["m''".replace("''", "'")])) == 3


def _write_pages(folder):
    folder.mkdir()
    for page in range(5):
        entities = [{"id": page * 10 + i, "name": f"n{i}"} for i in range(3)]
        (folder / f"page-{page}.json").write_text(json.dumps({"value": entities, "@odata.nextLink": f"p{page + 1}"} if page < 4 else {"value": entities}))
    return folder


def test_landed_pages(spark, tmp_path):
    folder = _write_pages(tmp_path / "pages")
    df = read_pages(spark, str(folder), "id bigint, name string")
    assert df.columns == ["id", "name"] and df.count() == 15


def test_live_paging_splits_pages_over_tasks(spark, tmp_path):
    folder = _write_pages(tmp_path / "pages")
    spark.dataSource.register(PagedEntitySource)
    df = spark.read.format("paged_entity").options(url=f"file://{folder}/page-{{page}}.json", pages=5, pagesPerTask=2).load()
    assert df.rdd.getNumPartitions() == 3
    assert df.count() == 15
    parsed = df.selectExpr("from_json(entity, 'id bigint, name string') AS e").select("e.*")
    assert parsed.agg({"id": "sum"}).head()[0] == sum(p * 10 + i for p in range(5) for i in range(3))


def test_type_names():
    assert spark_type("oracle", "NUMBER(10,2)") == "decimal(10,2)"
    assert spark_type("oracle", "NUMBER(5)") == "decimal(5,0)"
    assert spark_type("oracle", "VARCHAR2(40 BYTE)") == "string"
    assert spark_type("oracle", "TIMESTAMP(6) WITH TIME ZONE") == "timestamp"
    assert spark_type("sqlserver", "bit") == "boolean"
    assert mapped_types("sqlserver", {"a": "int", "b": "decimal(9,3)"}) == {"a": "int", "b": "decimal(9,3)"}
    with pytest.raises(ValueError, match="geometry"):
        spark_type("sqlserver", "geometry")


def test_apply_types_modes(spark):
    df = spark.createDataFrame([("1", "2024-01-01"), ("x", "never"), (None, None)], "n string, d string")
    types = {"n": "int", "d": "date"}
    flagged = apply_types(df, types, on_error="flag")
    assert [r["_bad_types"] for r in flagged.collect()] == [[], ["d", "n"], []]
    assert apply_types(df, types, on_error="null").filter("n is null").count() == 2
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        apply_types(df, types).collect()
    with pytest.raises(ValueError):
        apply_types(df, types, on_error="maybe")
