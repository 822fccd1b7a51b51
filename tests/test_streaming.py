import pytest
from conftest import rows

from pyspark.sql import types as T

from pipekit.operators.merge import MergeRule
from pipekit.operators.rules import QualityRule, expect_or_drop
from pipekit.streaming import (
    ChangeApplier,
    drop_late_duplicates,
    expect_stream,
    file_stream,
    run_available,
    stream_metrics,
    write_stream,
)

RULES = [QualityRule("small", "id < 8"), QualityRule("odd", "nullif(id, 3) % 2 = 1")]
SCHEMA = T.StructType([T.StructField("id", T.LongType())])


@pytest.fixture
def folder(spark, tmp_path):
    path = tmp_path / "in"
    spark.range(10).repartition(3).write.parquet(str(path))
    return path


def test_restart_adds_nothing_and_new_files_once(spark, folder, tmp_path):
    out, progress = str(tmp_path / "out"), str(tmp_path / "progress")

    def drain():
        run_available(write_stream(file_stream(spark, str(folder), SCHEMA, max_files=1), out, progress))
        return spark.read.schema(SCHEMA).parquet(out).count()

    assert drain() == 10
    assert drain() == 10
    spark.range(10, 12).write.mode("append").parquet(str(folder))
    assert drain() == 12


def test_dropping_equals_batch_and_counts(spark, folder, tmp_path):
    stream = expect_stream(file_stream(spark, str(folder), SCHEMA), RULES)
    query = run_available(write_stream(stream, str(tmp_path / "out"), str(tmp_path / "progress")))
    got = spark.read.schema(SCHEMA).parquet(str(tmp_path / "out"))
    assert rows(got) == rows(expect_or_drop(spark.range(10), RULES))
    assert stream_metrics(query) == {"total_records": 10, "failed_small": 2, "failed_odd": 5}


def test_flag_and_fail(spark, folder, tmp_path):
    flagged = expect_stream(file_stream(spark, str(folder), SCHEMA), RULES, "flag")
    run_available(write_stream(flagged, str(tmp_path / "out"), str(tmp_path / "p1")))
    got = {r.id: r._failed_rules for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got[1] == [] and got[8] == ["odd", "small"] and got[3] == []
    failing = expect_stream(file_stream(spark, str(folder), SCHEMA), RULES, "fail")
    with pytest.raises(Exception, match="expectation failed"):
        run_available(write_stream(failing, str(tmp_path / "out2"), str(tmp_path / "p2")))
    with pytest.raises(ValueError, match="ignore"):
        expect_stream(file_stream(spark, str(folder), SCHEMA), RULES, "ignore")


def test_late_duplicates(spark, tmp_path):
    data = "VALUES (1, timestamp_ntz'2024-01-01 00:00:00'), (1, timestamp_ntz'2024-01-01 00:01:00'), (2, timestamp_ntz'2024-01-01 00:02:00')"
    df = spark.sql(f"SELECT * FROM {data} AS t(id, at)")
    df.write.parquet(str(tmp_path / "in"))
    stream = drop_late_duplicates(file_stream(spark, str(tmp_path / "in"), df.schema), ["id"], "at", "10 minutes")
    run_available(write_stream(stream.select("id"), str(tmp_path / "out"), str(tmp_path / "progress")))
    assert rows(spark.read.parquet(str(tmp_path / "out"))) == [(1,), (2,)]


def test_salted_duplicates(spark, tmp_path):
    """One key with a third of the rows, copies in every file."""
    copies = spark.range(0, 3000, 1, 6).selectExpr(
        "if(id % 3 = 0, -1, id) AS id", "timestamp'2024-01-01 00:00:00' + make_dt_interval(0, 0, 0, id % 60) AS at"
    )
    copies.write.parquet(str(tmp_path / "in"))
    stream = file_stream(spark, str(tmp_path / "in"), copies.schema, max_files=3)
    single = drop_late_duplicates(stream, ["id"], "at", "10 minutes", salts=3)
    run_available(write_stream(single.select("id"), str(tmp_path / "out"), str(tmp_path / "progress")))
    got = spark.read.parquet(str(tmp_path / "out"))
    assert got.count() == got.distinct().count() == 2001


def test_changes_over_batches_and_restart(spark, tmp_path):
    target = spark.createDataFrame([(1, 10), (2, 20), (3, 30)], "k int, v int")
    feed_schema = T.StructType.fromDDL("k int, v int, op string, seq int")
    rule = MergeRule(
        ["k"], "true", ["seq"], delete_condition="source.op = 'D'", insert_condition="op <> 'D'", ignore=["op", "seq"]
    )
    applier = ChangeApplier(str(tmp_path / "versions"), target.schema, rule)
    applier.start_from(target)
    folder, progress = str(tmp_path / "feed"), str(tmp_path / "progress")

    def feed(*changes):
        spark.createDataFrame(list(changes), feed_schema).coalesce(1).write.mode("append").parquet(folder)

    def drain():
        applier.run(file_stream(spark, folder, feed_schema, max_files=1), progress)
        return rows(applier.current(spark))

    feed((1, 11, "U", 1), (1, 12, "U", 2), (2, 0, "D", 1), (9, 0, "D", 1))
    assert drain() == [(1, 12), (3, 30)]
    feed((2, 22, "U", 3))
    feed((1, 0, "D", 4), (4, 40, "U", 4))
    assert drain() == [(2, 22), (3, 30), (4, 40)]
    assert drain() == [(2, 22), (3, 30), (4, 40)]
    replay = spark.createDataFrame([(1, 0, "D", 4), (4, 40, "U", 4)], feed_schema)
    applier.apply(replay, 2)  # a batch that is run again after a crash
    assert rows(applier.current(spark)) == [(2, 22), (3, 30), (4, 40)]
