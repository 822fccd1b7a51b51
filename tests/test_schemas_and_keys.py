"""Type widening, uniqueness over increments, page chains, stored sketches, durable stream counters."""

import random
from datetime import date, datetime

import pytest
from conftest import rows
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pipekit.operators.rules import QualityRule
from pipekit.operators.sketches import daily_sketches, drift, merged_stats
from pipekit.operators.unique_index import UniqueKeyIndex
from pipekit.operators.widening import NarrowingError, append_widening, common_schema, common_type
from pipekit.sinks import TableStore
from pipekit.sources.page_chain import page_chain
from pipekit.streaming import CountedBatches

B, S, I, L, F4, F8 = T.ByteType(), T.ShortType(), T.IntegerType(), T.LongType(), T.FloatType(), T.DoubleType()
D, N, Z, X = T.DateType(), T.TimestampNTZType(), T.TimestampType(), T.StringType()


def dec(p, s):
    return T.DecimalType(p, s)


@pytest.mark.parametrize(
    "left, right, common",
    [
        (B, S, S), (S, I, I), (I, L, L), (B, L, L), (L, dec(20, 0), dec(20, 0)), (I, dec(5, 2), dec(12, 2)), (L, dec(10, 4), dec(24, 4)),
        (dec(10, 2), dec(8, 5), dec(13, 5)), (dec(38, 0), dec(38, 10), F8), (F4, F8, F8), (I, F4, F8), (L, F8, F8), (dec(9, 2), F8, F8),
        (D, N, N), (N, Z, Z), (D, Z, Z), (T.NullType(), X, X), (T.ArrayType(I), T.ArrayType(L), T.ArrayType(L)),
    ],
)
def test_every_edge_of_the_lattice(left, right, common):
    assert common_type(left, right) == common == common_type(right, left)


@pytest.mark.parametrize("left, right", [(X, I), (D, I), (T.BooleanType(), I), (X, D), (T.BinaryType(), X), (T.ArrayType(X), T.ArrayType(I))])
def test_nothing_else_is_common(left, right):
    with pytest.raises(NarrowingError):
        common_type(left, right)


def test_promotion_is_associative():
    kinds = [B, S, I, L, F4, F8, dec(5, 2), dec(20, 0), dec(12, 4)]
    for a in kinds:
        for b in kinds:
            for c in kinds:
                assert common_type(common_type(a, b), c) == common_type(a, common_type(b, c)), (a, b, c)


def test_append_widening(spark):
    base = spark.createDataFrame([(1, 2.5, date(2024, 1, 1), (1, "x"))], "a int, b float, c date, s struct<p:int,q:string>")
    more = spark.createDataFrame([((7 << 40, "y"), 1 << 40, "new")], "s struct<p:bigint,r:string>, a bigint, d string")
    both = append_widening(base, more)
    assert both.schema.simpleString() == "struct<a:bigint,b:float,c:date,s:struct<p:bigint,q:string,r:string>,d:string>"
    assert [tuple(r) for r in both.orderBy("a").collect()] == [
        (1, 2.5, date(2024, 1, 1), (1, "x", None), None),
        (1 << 40, None, None, (7 << 40, None, "y"), "new"),
    ]
    assert common_schema(base.schema, base.schema).simpleString() == base.schema.simpleString()


def test_table_widens_and_narrowing_writes_nothing(spark, tmp_path):
    store, name = TableStore(spark, str(tmp_path)), "widened_table"
    spark.sql(f"DROP TABLE IF EXISTS {name}")
    store.replace(spark.createDataFrame([(1, "a")], "k int, p string"), name, ["p"])
    assert store.append_widening(spark.createDataFrame([(2, "b")], "k int, p string"), name) == []
    assert store.append_widening(spark.createDataFrame([(1 << 40, "a", 1.5)], "k bigint, p string, x double"), name) == ["k"]
    assert rows(spark.table(name).select("k", "p", "x")) == [(1, "a", None), (1099511627776, "a", 1.5), (2, "b", None)]
    assert store.append_widening(spark.createDataFrame([(3, "a")], "k int, p string"), name) == []  # narrower rows fit
    with pytest.raises(NarrowingError):
        store.append_widening(spark.createDataFrame([("x", "a")], "k string, p string"), name)
    assert spark.table(name).count() == 4
    spark.sql(f"DROP TABLE {name}")
    store.replace(spark.createDataFrame([(1, 1)], "k int, p int"), name, ["p"])
    with pytest.raises(ValueError, match="partition"):
        store.append_widening(spark.createDataFrame([(1, 1 << 40)], "k int, p bigint"), name)
    spark.sql(f"DROP TABLE {name}")


def test_duplicates_over_increments(spark, tmp_path):
    index = UniqueKeyIndex(spark, str(tmp_path), ["a", "b"], buckets=4)
    index.create()
    schema = "a string, b string, other int"
    first = spark.createDataFrame([("a", "bc", 1), ("x", None, 2), (None, None, 3)], schema)
    assert index.duplicates(first).collect() == [] and index.validate(first)
    index.add(first, 0)
    index.add(first, 0)  # a replay
    second = spark.createDataFrame([("ab", "c", 1), ("x", None, 2), (None, "x", 3), ("n", "n", 4), ("n", "n", 5), (None, None, 6)], schema)
    got = sorted((tuple(r) for r in index.duplicates(second).collect()), key=str)
    assert got == sorted([("x", None, 1, True), (None, None, 1, True), ("n", "n", 2, False)], key=str)
    verdict = index.validate(second)
    assert not verdict and "2 keys are in the table already, 1 are repeated" in verdict.errors[0]
    index.add(second.filter("other = 4"), 1)
    assert index.duplicates(second.filter("other = 5")).head().in_table


def test_only_the_buckets_of_the_increment_are_read(spark, tmp_path):
    index = UniqueKeyIndex(spark, str(tmp_path), ["k"], buckets=8)
    index.add(spark.range(1000).selectExpr("id AS k"), 0)
    touched = {r.bucket for r in index._digested(spark.range(1).selectExpr("id AS k")).collect()}
    assert len(touched) == 1 and index.duplicates(spark.range(1).selectExpr("id AS k")).count() == 1


def chain(spark, *pages):
    found = page_chain(spark.createDataFrame(list(pages), "page int, next int"))
    return {r.page: (r.start, r.position, r.fault) for r in found.collect()}


def test_a_whole_chain(spark):
    got = chain(spark, *[(i, i + 1 if i < 99 else None) for i in random.Random(1).sample(range(100), 100)])
    assert got == {i: (0, i, None) for i in range(100)}


def test_faults_of_chains(spark):
    assert chain(spark, (1, 2), (2, None), (2, None)) == {1: (1, 0, None), 2: (1, 1, None)}
    assert chain(spark, (1, 2), (3, None)) == {1: (1, 0, "gap"), 3: (3, 0, "second chain")}
    assert chain(spark, (1, 2), (2, 3), (3, 1)) == {i: (1, None, "cycle") for i in (1, 2, 3)}
    assert chain(spark, (5, 5)) == {5: (5, None, "cycle")}
    assert chain(spark, (1, 3), (2, 3), (3, None)) == {1: (1, 0, None), 2: (2, 0, "fork"), 3: (1, 1, None)}
    assert chain(spark, (2, 1), (1, None), (7, 8), (8, 9), (9, 7)) == {2: (2, 0, None), 1: (2, 1, None), 7: (7, None, "cycle"), 8: (7, None, "cycle"), 9: (7, None, "cycle")}
    assert chain(spark, (None, 1), (1, None)) == {1: (1, 0, None)}
    assert page_chain(spark.createDataFrame([], "page int, next int")).collect() == []


def test_a_long_cycle_and_a_long_chain_take_few_rounds(spark):
    pages = [(i, (i + 1) % 37) for i in range(37)] + [(100 + i, 101 + i if i < 64 else None) for i in range(65)]
    got = chain(spark, *pages)
    assert all(got[i] == (0, None, "cycle") for i in range(37)) and all(got[100 + i] == (100, i, None) for i in range(65))


def test_sketches_merge_as_their_rows(spark):
    frame = spark.range(30_000).selectExpr("id % 10 AS day", "id % 3000 AS k", "if(id % 7 = 0, NULL, id * 1.0D) AS v", "concat('t', id % 50) AS t")
    stored = daily_sketches(frame, F.col("day"), ["k", "v", "t"])
    got = {r.column_name: r for r in merged_stats(stored, [0.0, 0.5, 1.0]).collect()}
    assert (got["k"].row_count, got["v"].null_count, got["t"].quantiles) == (30_000, 4286, None)
    assert abs(got["k"].distinct_count - 3000) < 60 and got["t"].distinct_count == 50
    assert (got["v"].least, got["v"].greatest) == (1.0, 29999.0) and abs(got["v"].quantiles[1] - 15_000) < 300
    some = {r.column_name: r for r in merged_stats(stored.filter("day < 3")).collect()}
    assert some["k"].row_count == 9000
    per_day = merged_stats(stored, by=["period"])
    assert per_day.count() == 30


def test_drift(spark):
    frame = spark.range(20_000).selectExpr("id % 2 AS late", "if(id % 2 = 1, id % 4000, id % 2000) * 1.0D AS v", "id % 100 AS same")
    got = {r.column_name: r.drifted for r in drift(daily_sketches(frame, F.col("late"), ["v", "same"]), F.col("period") == 1).collect()}
    assert got == {"v": True, "same": False}


def test_counters_survive_restarts_replays_and_empty_batches(spark, tmp_path):
    sink = CountedBatches(spark, str(tmp_path / "out"), [QualityRule("small", "v < 10"), QualityRule("known", "v IS NOT NULL")])
    sink.write_batch(spark.createDataFrame([(1,), (20,), (None,)], "v int"), 0)
    sink.write_batch(spark.createDataFrame([(30,)], "v int"), 1)
    sink.write_batch(spark.createDataFrame([(1,), (20,), (None,)], "v int"), 0)  # again, after a crash
    sink.write_batch(spark.createDataFrame([], "v int"), 2)
    again = CountedBatches(spark, sink.root, sink.rules)
    assert rows(again.metrics()) == [("known", 3, 4, 1), ("small", 3, 4, 2)]
    assert spark.read.option("recursiveFileLookup", True).parquet(f"{sink.root}/data").count() == 1


def test_store_follows_columns_partitions_and_nulls(spark, tmp_path):
    from pipekit.operators.merge import ALWAYS, MergeRule

    store, name = TableStore(spark, str(tmp_path / "s")), "null_partitions"
    spark.sql(f"DROP TABLE IF EXISTS {name}")
    schema = "p string, k int, v int"
    store.replace(spark.createDataFrame([(None, 1, 1), ("a", 2, 2), ("b", 3, 3)], schema), name, ["p"])
    rule = MergeRule(["p", "k"], ALWAYS)
    stats = store.upsert_partitions(name, spark.createDataFrame([(None, 1, 9), ("a", 2, 20), ("c", 4, 4)], schema), rule, ["p"])
    # A NULL key matches nothing: its row is new; the others of its partition are unchanged.
    assert (stats.rows_updated, stats.rows_inserted, stats.rows_deleted, stats.rows_unchanged) == (1, 2, 0, 1)
    assert rows(spark.table(name).select("p", "k", "v")) == [(None, 1, 1), (None, 1, 9), ("a", 2, 20), ("b", 3, 3), ("c", 4, 4)]
    files = spark.table(name).select(F.col("_metadata.file_path").alias("f")).distinct().collect()
    assert all("_action" not in spark.read.parquet(r.f).columns for r in files)
    gone = MergeRule(["p", "k"], ALWAYS, delete_condition="source.v < 0")
    assert store.upsert_partitions(name, spark.createDataFrame([("c", 4, -1)], schema), gone, ["p"]).rows_deleted == 1
    assert rows(spark.table(name).select("p").distinct()) == [(None,), ("a",), ("b",)]
    store.replace(spark.createDataFrame([("z", 1, 1)], schema), name, ["p"])  # all other partitions go
    assert rows(spark.table(name).select("p", "k", "v")) == [("z", 1, 1)]
    spark.sql(f"DROP TABLE {name}")


def test_upsert_writes_the_table_columns_only(spark, tmp_path):
    from pipekit.operators.merge import ALWAYS, MergeRule

    store, name = TableStore(spark, str(tmp_path / "u")), "plain_files"
    spark.sql(f"DROP TABLE IF EXISTS {name}")
    assert store.create_empty(name, T.StructType([T.StructField("k", I), T.StructField("v", I)])) and not store.create_empty(name, None)
    first = store.upsert(name, spark.createDataFrame([(1, 1), (2, 2), (None, 3)], "k int, v int"), MergeRule(["k"], ALWAYS))
    assert (first.rows_inserted, first.rows_unchanged) == (3, 0)
    second = store.upsert(name, spark.createDataFrame([(1, -1), (2, 5)], "k int, v int"), MergeRule(["k"], ALWAYS, delete_condition="source.v < 0"))
    assert (second.rows_updated, second.rows_inserted, second.rows_deleted, second.rows_unchanged) == (1, 0, 1, 1)
    folder = spark.sql(f"DESCRIBE TABLE EXTENDED {name}").filter("col_name = 'Location'").head().data_type
    assert spark.read.parquet(folder).columns == ["k", "v"]
    none = store.upsert(name, spark.createDataFrame([], "k int, v int"), MergeRule(["k"], ALWAYS))
    assert (none.rows_updated, none.rows_inserted, none.rows_deleted, none.rows_unchanged) == (0, 0, 0, 2)
    spark.sql(f"DROP TABLE {name}")


def test_named_table_is_clustered(spark, tmp_path):
    store, name = TableStore(spark, str(tmp_path / "z")), "clustered_table"
    spark.sql(f"DROP TABLE IF EXISTS {name}")
    frame = spark.range(2000).selectExpr("concat('s', id * 37 % 2000) AS s", "id AS k")
    store.replace(frame.repartition(8, "k"), name)
    assert store.optimize(name, ["s", "k"]) == 2000 and rows(spark.table(name)) == rows(frame)
    ranges = spark.table(name).groupBy(F.col("_metadata.file_path")).agg(F.min("k").alias("low"), F.max("k").alias("high")).collect()
    assert len(ranges) == 8 and sum(r.high - r.low for r in ranges) < 8 * 1500
    spark.sql(f"DROP TABLE {name}")
