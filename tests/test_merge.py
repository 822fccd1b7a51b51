import pytest
from conftest import day, plan_text, rows

from pyspark.sql import functions as F

from pipekit.operators.latest import as_of, latest_per_key, unique_or_fail
from pipekit.operators.merge import ALWAYS, MergeRule, append_evolving, merge_plan, merge_stats, upsert

SCHEMA = "k int, v int, _timestamp timestamp"


@pytest.fixture
def target(spark):
    return spark.createDataFrame([(1, 10, day(1)), (2, 20, day(5))], SCHEMA)


@pytest.fixture
def source(spark):
    return spark.createDataFrame([(1, 11, day(2)), (2, 21, day(2)), (3, 31, day(2)), (None, 41, day(2))], SCHEMA)


def values(df):
    return rows(df.select("k", "v"))


def test_newer_rows_win(target, source):
    plan = merge_plan(target, source, MergeRule(["k"]))
    assert values(upsert(target, source, MergeRule(["k"]))) == [(None, 41), (1, 11), (2, 20), (3, 31)]
    assert merge_stats(plan).head().asDict() == {
        "rows_updated": 1,
        "rows_inserted": 2,
        "rows_deleted": 0,
        "rows_unchanged": 1,
    }


def test_unconditional_upsert(target, source):
    assert values(upsert(target, source, MergeRule(["k"], ALWAYS))) == [(None, 41), (1, 11), (2, 21), (3, 31)]


def test_upsert_twice_is_once(target, source):
    keyed = source.filter("k IS NOT NULL")
    once = upsert(target, keyed, MergeRule(["k"]))
    assert rows(upsert(once, keyed, MergeRule(["k"]))) == rows(once)


def test_null_keys_never_match_and_are_never_merged(spark, target):
    old = target.union(spark.createDataFrame([(None, 1, day(1))], SCHEMA))
    new = spark.createDataFrame([(None, 2, day(9)), (None, 3, day(9))], SCHEMA)
    merged = upsert(old, new, MergeRule(["k"], order_by=["_timestamp"]))
    assert values(merged) == [(None, 1), (None, 2), (None, 3), (1, 10), (2, 20)]


def test_null_in_condition_means_no_update(spark, target):
    assert values(upsert(target, spark.createDataFrame([(1, 9, None)], SCHEMA), MergeRule(["k"]))) == [(1, 10), (2, 20)]


def test_several_changes_to_one_key(spark, target):
    feed = spark.createDataFrame([(1, 12, day(3)), (1, 11, day(2)), (3, 7, day(1)), (3, 8, day(1))], SCHEMA)
    with pytest.raises(Exception, match="several changes"):
        upsert(target, feed, MergeRule(["k"])).collect()
    assert values(upsert(target, feed, MergeRule(["k"], order_by=["_timestamp", "v"]))) == [(1, 12), (2, 20), (3, 8)]


def test_duplicate_target_rows_are_all_updated(spark, source):
    doubled = spark.createDataFrame([(1, 10, day(1)), (1, 19, day(1))], SCHEMA)
    merged = upsert(doubled, source.filter("k = 1"), MergeRule(["k"]))
    assert values(merged) == [(1, 11), (1, 11)]


def test_delete(spark, target):
    feed = spark.createDataFrame([(1, 0, day(9), "D"), (5, 0, day(9), "D"), (6, 6, day(9), "U")], SCHEMA + ", op string")
    rule = MergeRule(["k"], delete_condition="source.op = 'D'", insert_condition="op <> 'D'", ignore=["op"])
    assert values(upsert(target, feed, rule)) == [(2, 20), (6, 6)]
    assert merge_stats(merge_plan(target, feed, rule)).head().rows_deleted == 1


def test_several_keys(spark):
    old = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (1, None, 3)], "k int, s string, v int")
    new = spark.createDataFrame([(1, "a", 10), (1, None, 30)], "k int, s string, v int")
    merged = upsert(old, new, MergeRule(["k", "s"], ALWAYS))
    assert rows(merged.select("v")) == [(10,), (2,), (3,), (30,)]


def test_columns_must_agree_unless_evolving(spark, target):
    wide = spark.createDataFrame([(1, 11, day(2), "new"), (3, 31, day(2), "x")], SCHEMA + ", note string")
    with pytest.raises(ValueError, match="note"):
        upsert(target, wide, MergeRule(["k"]))
    merged = upsert(target, wide, MergeRule(["k"], evolve=True))
    assert rows(merged.select("k", "v", "note")) == [(1, 11, "new"), (2, 20, None), (3, 31, "x")]
    narrow = target.select("k", "_timestamp").withColumn("_timestamp", F.lit(day(9)))
    assert values(upsert(target, narrow, MergeRule(["k"], evolve=True))) == [(1, 10), (2, 20)]
    with pytest.raises(ValueError, match="merge keys"):
        upsert(target, wide, MergeRule(["nope"], evolve=True))


def test_columns_are_aligned_by_name_and_type(spark, target):
    shuffled = spark.createDataFrame([(day(9), 3, 30)], "_timestamp timestamp, k bigint, v bigint")
    merged = upsert(target, shuffled, MergeRule(["k"]))
    assert merged.schema.simpleString() == target.schema.simpleString()
    assert values(merged) == [(1, 10), (2, 20), (3, 30)]


def test_small_change_set_does_not_shuffle_the_target(spark, tmp_path):
    spark.range(1000).selectExpr("id AS k", "id AS v").write.parquet(str(tmp_path / "t"))
    spark.range(0, 2000, 500).selectExpr("id AS k", "-id AS v").write.parquet(str(tmp_path / "s"))
    old, new = spark.read.parquet(str(tmp_path / "t")), spark.read.parquet(str(tmp_path / "s"))
    merged = upsert(old, new, MergeRule(["k"], ALWAYS, order_by=["v"]))
    text = plan_text(merged)
    assert "BroadcastHashJoin LeftOuter" in text and "SortMergeJoin" not in text
    assert merged.filter("v < 0").count() == 3 and merged.count() == 1002


def test_hot_key_merge_is_whole(spark):
    old = spark.range(3000).selectExpr("if(id % 3 = 0, 7, id) AS k", "id AS v")
    new = spark.createDataFrame([(7, -1), (8, -2), (5000, -3)], "k bigint, v bigint")
    merged = upsert(old, new, MergeRule(["k"], ALWAYS))
    assert merged.count() == 3001
    assert merged.filter("k = 7").agg({"v": "max"}).head()[0] == -1


def test_latest_limits_before_the_shuffle(spark):
    df = spark.range(100).selectExpr("id % 3 AS k", "id AS at", "id AS n")
    newest = latest_per_key(df, ["k"], ["at"])
    assert rows(newest.select("k", "n")) == [(0, 99), (1, 97), (2, 98)]
    text = plan_text(newest)
    assert text.index("Exchange") > 0 and "Partial" in text and "WindowGroupLimit" in text
    assert rows(as_of(df, ["k"], "at", F.lit(10)).select("k", "n")) == [(0, 9), (1, 10), (2, 8)]


def test_ties_are_broken_by_the_later_columns(spark):
    df = spark.createDataFrame([(1, 5, 1), (1, 5, 2)], "k int, at int, id int")
    assert latest_per_key(df, ["k"], ["at", "id"]).head().id == 2


def test_unique_or_fail_keeps_rows(spark):
    df = spark.createDataFrame([("a", 1, None), ("b", 2, "x")], "s string, k int, t string")
    assert rows(unique_or_fail(df, ["k"], "twice").select(*df.columns)) == rows(df)
    with pytest.raises(Exception, match="twice"):
        unique_or_fail(df.union(df), ["k"], "twice").count()


def test_append_evolving(spark):
    a, b = spark.createDataFrame([(1, "x")], "k int, s string"), spark.createDataFrame([(2, 0.5)], "k int, f double")
    both = append_evolving(a, b)
    assert both.columns == ["k", "s", "f"] and both.count() == 2


def test_column_names_with_dots(spark):
    old = spark.createDataFrame([(1, 1)], "k int, `v.x` int")
    new = spark.createDataFrame([(1, 2), (2, 3)], "k int, `v.x` int")
    merged = upsert(old, new, MergeRule(["k"], ALWAYS))
    assert rows(merged) == [(1, 2), (2, 3)]


def test_hot_change_key(spark):
    """A third of the changes concern one key, matched or not."""
    old = spark.range(100).selectExpr("id AS k", "0L AS v")
    new = spark.range(3000).selectExpr("if(id % 3 = 0, 5, if(id % 3 = 1, 500, id + 1000)) AS k", "id + 1 AS v")
    merged = upsert(old, new, MergeRule(["k"], ALWAYS, order_by=["v"]))
    assert merged.count() == 100 + 1 + 1000
    got = dict(merged.filter("k IN (5, 500)").collect())
    assert got == {5: 2998, 500: 2999}


def test_merge_stats_cut_the_joins_by_size(spark, monkeypatch):
    """The number of shuffle partitions does not bound a task's rows; the session's settings are as before."""
    target = spark.range(100).selectExpr("id AS k", "id AS v")
    seen = []
    plan = merge_plan(target, target, MergeRule(["k"], ALWAYS, order_by=["v"]))
    keys = ["spark.sql.adaptive.coalescePartitions.initialPartitionNum", "spark.sql.adaptive.advisoryPartitionSizeInBytes"]
    before = [spark.conf.get(key, None) for key in keys]
    real = type(plan).first
    monkeypatch.setattr(type(plan), "first", lambda df: (seen.extend(spark.conf.get(key, None) for key in keys), real(df))[1])
    assert tuple(merge_stats(plan).head()) == (100, 0, 0, 0)
    assert seen == [b or own for b, own in zip(before, ["200", "16m"])] and before == [spark.conf.get(key, None) for key in keys]
