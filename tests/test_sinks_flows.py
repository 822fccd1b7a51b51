import uuid

import pytest
from conftest import day, rows

from pyspark.sql import functions as F

from pipekit.operators.clean import DropNulls
from pipekit.operators.expectations import ExpectationSuite, ExpectNonNull, ExpectUnique
from pipekit.operators.merge import ALWAYS, MergeRule
from pipekit.plans.flow import BatchFlow, IncrementalFlow, run_simple, standard_flow
from pipekit.protocols import Source, Step, Validator, Writer
from pipekit.session import scratch_path, shared_dir
from pipekit.sinks import PathWriter, TableStore, TableWriter, create_from_query, create_if_absent
from pipekit.sources import JdbcSource, TableSource


@pytest.fixture
def name():
    return f"t_{uuid.uuid4().hex}"


@pytest.fixture
def store(spark, tmp_path):
    return TableStore(spark, str(tmp_path / "tables"))


def test_shared_folder_comes_from_the_session(spark):
    assert shared_dir(spark) == spark.conf.get("spark.checkpoint.dir")
    assert scratch_path(spark, "x") != scratch_path(spark, "x")
    assert scratch_path(spark, "x").startswith(shared_dir(spark))


def test_writers(spark, name, tmp_path):
    TableWriter(["p"]).write(spark.range(10).selectExpr("id", "id % 2 AS p"), name)
    assert spark.table(name).count() == 10
    TableWriter(["p"]).write(spark.range(1).selectExpr("id", "id AS p"), name, mode="append")
    assert spark.table(name).count() == 11
    PathWriter(str(tmp_path)).write(spark.range(3), "out")
    PathWriter(str(tmp_path)).write(spark.range(2), "out")
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2
    with pytest.raises(ValueError, match="mode"):
        TableWriter().write(spark.range(1), name, mode="replace")


def test_create_if_absent(spark, name):
    assert create_if_absent(spark.range(3), name)
    assert not create_if_absent(spark.range(99), name)
    assert spark.table(name).count() == 3
    create_from_query(spark, f"SELECT id * 2 AS twice FROM {name}", name + "_q")
    assert rows(spark.table(name + "_q")) == [(0,), (2,), (4,)]


def test_publish_moves_the_table(spark, store, name):
    store.replace(spark.range(3), name)
    store.replace(spark.table(name).union(spark.range(10, 11)), name)  # reads what it replaces
    assert spark.table(name).count() == 4
    store.replace(spark.range(2).selectExpr("id", "'x' AS s"), name)  # other columns
    assert spark.table(name).columns == ["id", "s"]


def test_managed_tables_are_not_touched(spark, store, name):
    spark.range(3).write.saveAsTable(name)
    with pytest.raises(ValueError, match="external"):
        store.replace(spark.range(1), name)
    assert spark.table(name).count() == 3


def test_publish_partitioned(spark, store, name):
    store.replace(spark.range(9).selectExpr("id", "id % 3 AS p"), name, ["p"])
    assert spark.table(name).filter("p = 1").count() == 3
    store.replace(spark.range(4).selectExpr("id", "7 + id % 2 AS p"), name, ["p"])
    assert rows(spark.table(name).select("p").distinct()) == [(7,), (8,)]


def test_append_adds_columns_without_rewriting(spark, store, name):
    store.replace(spark.range(2), name)
    before = set(spark.table(name).inputFiles())
    store.append_evolving(spark.createDataFrame([("new", 7)], "note string, id bigint"), name)
    assert rows(spark.table(name).select("id", "note")) == [(0, None), (1, None), (7, "new")]
    assert before <= set(spark.table(name).inputFiles())
    store.append_evolving(spark.range(8, 9), name)
    assert spark.table(name).filter("note IS NULL").count() == 3


SCHEMA = "k int, v int, _timestamp timestamp"


def test_table_upsert_reports_what_was_written(spark, store, name):
    store.replace(spark.createDataFrame([(1, 10, day(1)), (2, 20, day(5)), (9, 9, day(1))], SCHEMA), name)
    changes = spark.createDataFrame([(1, 11, day(2)), (2, 21, day(2)), (3, 31, day(2)), (9, 0, day(3))], SCHEMA)
    rule = MergeRule(["k"], delete_condition="source.v = 0")
    stats = store.upsert(name, changes, rule)
    assert (stats.rows_updated, stats.rows_inserted, stats.rows_deleted, stats.rows_unchanged) == (1, 1, 1, 1)
    assert spark.table(name).columns == ["k", "v", "_timestamp"]
    assert rows(spark.table(name).select("k", "v")) == [(1, 11), (2, 20), (3, 31)]
    again = store.upsert(name, changes.filter("v > 0"), MergeRule(["k"]))
    assert (again.rows_updated, again.rows_inserted, again.rows_unchanged) == (0, 0, 3)


def test_partition_upsert_rewrites_only_touched_partitions(spark, store, name):
    schema = "p string, k int, v int"
    store.replace(spark.createDataFrame([(p, k, 0) for p in "abc" for k in (1, 2)], schema), name, ["p"])
    def files_of(p):
        return sorted(spark.table(name).filter(F.col("p") == p).select("_metadata.file_path").distinct().collect())
    untouched = files_of("c")
    changes = spark.createDataFrame([("a", 1, 5), ("a", 3, 6), ("new d", 1, 7)], schema)
    stats = store.upsert_partitions(name, changes, MergeRule(["p", "k"], ALWAYS), ["p"])
    assert (stats.rows_updated, stats.rows_inserted, stats.rows_unchanged) == (1, 2, 1)
    assert rows(spark.table(name).select("p", "k", "v")) == [
        ("a", 1, 5), ("a", 2, 0), ("a", 3, 6), ("b", 1, 0), ("b", 2, 0), ("c", 1, 0), ("c", 2, 0), ("new d", 1, 7),
    ]
    assert files_of("c") == untouched
    with pytest.raises(ValueError, match="not merge keys"):
        store.upsert_partitions(name, changes, MergeRule(["k"], ALWAYS), ["p"])


def test_partition_upsert_with_several_partition_columns_and_nulls(spark, store, name):
    schema = "p string, q int, k int, v int"
    store.replace(spark.createDataFrame([("a", 1, 1, 0), ("a", 2, 1, 0), ("b", 1, 1, 0)], schema), name, ["p", "q"])
    rule = MergeRule(["p", "q", "k"], ALWAYS)
    store.upsert_partitions(name, spark.createDataFrame([("a", 1, 1, 5), ("b", 2, 1, 6)], schema), rule, ["p", "q"])
    store.upsert_partitions(name, spark.createDataFrame([(None, 2, 1, 9)], schema), rule, ["p", "q"])
    got = rows(spark.table(name).select("p", "q", "k", "v"))
    assert got == [(None, 2, 1, 9), ("a", 1, 1, 5), ("a", 2, 1, 0), ("b", 1, 1, 0), ("b", 2, 1, 6)]


def test_partition_values_that_folders_escape(spark, store, name):
    schema = "p string, k int, v int"
    odd = ["a:b", "x/y", "50%", "it's", "e=f", "back\\slash", "plain"]
    store.replace(spark.createDataFrame([(p, 1, 0) for p in odd], schema), name, ["p"])
    rule = MergeRule(["p", "k"], "true", delete_condition="source.v < 0")
    changes = spark.createDataFrame([(p, 1, 5) for p in odd[:4]] + [("e=f", 1, -1)], schema)
    stats = store.upsert_partitions(name, changes, rule, ["p"])
    assert (stats.rows_updated, stats.rows_deleted) == (4, 1)
    got = dict(spark.table(name).select("p", "v").collect())
    assert got == {"a:b": 5, "x/y": 5, "50%": 5, "it's": 5, "back\\slash": 0, "plain": 0}  # the emptied one is gone


def test_everything_deleted(spark, store, name):
    schema = "p int, k int, v int"
    rule = MergeRule(["p", "k"], ALWAYS, delete_condition="source.v < 0")
    store.replace(spark.createDataFrame([(1, 1, 0), (2, 2, 0)], schema), name, ["p"])
    gone = spark.createDataFrame([(1, 1, -1), (2, 2, -1)], schema)
    assert store.upsert_partitions(name, gone, rule, ["p"]).rows_deleted == 2
    assert spark.table(name).count() == 0
    flat = name + "_flat"
    store.replace(spark.createDataFrame([(1, 1, 0), (2, 2, 0)], schema), flat)
    assert store.upsert(flat, gone, rule).rows_deleted == 2
    assert spark.table(flat).count() == 0
    assert store.upsert(flat, gone.limit(0), rule).rows_deleted == 0


SUITE = ExpectationSuite([ExpectNonNull(["id"]), ExpectUnique(["id"])])


def test_flow_publishes_what_it_audited(spark, store, name):
    spark.createDataFrame([(1,), (None,), (2,)], "id int").createOrReplaceTempView("raw_ids")
    flow = BatchFlow(TableSource(spark), [DropNulls(["id"])], SUITE, store)
    result = flow.execute("raw_ids", name)
    assert result and result.status == "published" and result.validation.metrics["unique_id"]["total_rows"] == 2
    assert rows(spark.table(name)) == [(1,), (2,)]


def test_failed_audit_leaves_the_old_table(spark, store, name):
    store.replace(spark.range(5), name)
    spark.range(3).unionAll(spark.range(3)).createOrReplaceTempView("doubled")
    flow = BatchFlow(TableSource(spark), [], SUITE, store)
    result = flow.execute("doubled", name)
    assert not result and result.status == "rejected" and result.validation.error_count == 1
    assert spark.table(name).count() == 5
    flow.on_invalid = "raise"
    with pytest.raises(ValueError, match="duplicates"):
        flow.execute("doubled", name)


def test_flow_reports_errors(spark, store, name):
    result = BatchFlow(TableSource(spark), [], SUITE, store).execute("no_such_table", name)
    assert result.status == "error" and "no_such_table" in result.error
    spark.range(0).createOrReplaceTempView("nothing")
    strict = BatchFlow(TableSource(spark), [DropNulls(["id"])], SUITE, store, require_rows=True)
    assert "no input rows" in strict.execute("nothing", name).error
    assert not spark.catalog.tableExists(name)
    loose = BatchFlow(TableSource(spark), [DropNulls(["id"])], SUITE, store)
    assert loose.execute("nothing", name)


def test_standard_flow_with_its_defaults(spark, store, name):
    sales = [(1, "2024-01-01", " a ", "d ", 7), (None, "2024-01-01", "b", "d", 7), (2, "2024-01-02", "c", " e", 8)]
    spark.createDataFrame(sales, "id int, created_date string, name string, description string, customer_id int").createOrReplaceTempView("sales")
    spark.createDataFrame([(7, "Kim", "north")], "customer_id int, customer_name string, region string").createOrReplaceTempView("dim_customers")
    assert standard_flow(TableSource(spark), store).execute("sales", name)
    got = rows(spark.table(name).select("id", "name", "description", "customer_name", "region"))
    assert got == [(1, "a", "d", "Kim", "north"), (2, "c", "e", None, None)]


def test_simple_run(spark, name):
    run_simple(spark.range(3), lambda df: df.filter("id > 0"), SUITE, TableWriter(), name)
    assert spark.table(name).count() == 2
    with pytest.raises(ValueError, match="validation failed"):
        run_simple(spark.range(3), lambda df: df.unionAll(df), SUITE, TableWriter(), name)
    assert spark.table(name).count() == 2


def test_incremental_flow_moves_its_mark(spark, store, name):
    schema = "k int, v int, at int"
    suite = ExpectationSuite([ExpectNonNull(["k"])])
    flow = IncrementalFlow(TableSource(spark), [], suite, store, MergeRule(["k"], "source.at > target.at", order_by=["at"]), "at")
    spark.createDataFrame([(1, 10, 1), (2, 20, 2)], schema).createOrReplaceTempView("changing")
    first = flow.execute("changing", name, None)
    assert first.high_water_mark == 2 and first.stats.rows_inserted == 2
    spark.createDataFrame([(1, 10, 1), (2, 20, 2), (2, 21, 4), (3, 30, 2)], schema).createOrReplaceTempView("changing")
    second = flow.execute("changing", name, first.high_water_mark)  # k=3 shares the old mark and is not lost
    assert second.high_water_mark == 4
    assert rows(spark.table(name).select("k", "v")) == [(1, 10), (2, 21), (3, 30)]
    third = flow.execute("changing", name, 99)
    assert third and third.high_water_mark == 99
    spark.createDataFrame([(None, 1, 100)], schema).createOrReplaceTempView("changing")
    bad = flow.execute("changing", name, 99)
    assert bad.status == "rejected" and bad.high_water_mark == 99


def test_protocols(spark):
    assert isinstance(TableSource(spark), Source) and isinstance(JdbcSource(spark, "jdbc:x"), Source)
    assert isinstance(TableWriter(), Writer) and isinstance(SUITE, Validator) and isinstance(DropNulls(["x"]), Step)
