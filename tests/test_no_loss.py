"""Cases in which rows or columns were once lost without an error."""

import json

import pytest
from conftest import rows

from pipekit.operators.layout import compact, write_branches
from pipekit.operators.merge import ALWAYS, MergeRule
from pipekit.operators.percentiles import exact_percentiles
from pipekit.operators.rules import QualityRule, quality_gate
from pipekit.sinks import TableStore
from pipekit.sources.paged import read_pages


def test_a_partitioned_table_is_really_replaced(spark, tmp_path):
    store = TableStore(spark, str(tmp_path))
    name = "no_loss_partitioned"
    store.replace(spark.createDataFrame([(1, "a", 10), (2, "b", 20)], "id long, p string, v long"), name, ["p"])
    try:
        stats = store.upsert(name, spark.createDataFrame([(1, "a", 11), (3, "b", 30)], "id long, p string, v long"), MergeRule(["id"], ALWAYS, order_by=["v"]))
        assert (stats.rows_updated, stats.rows_inserted) == (1, 1)
        assert rows(spark.table(name).select("id", "p", "v")) == [(1, "a", 11), (2, "b", 20), (3, "b", 30)]
        with pytest.raises(ValueError, match="partitioned by"):
            store.replace(spark.table(name), name, ["id"])
        evolving = MergeRule(["id", "p"], ALWAYS, order_by=["v"], evolve=True)
        more = spark.createDataFrame([(1, "a", 12, "new")], "id long, p string, v long, extra string")
        store.upsert_partitions(name, more, evolving, ["p"])
        assert rows(spark.table(name).filter("id = 1").select("v", "extra")) == [(12, "new")]
        with pytest.raises(ValueError, match="empty text"):
            store.upsert_partitions(name, spark.createDataFrame([(1, "", 1, "x")], more.schema), evolving, ["p"])
        assert store.optimize(name) == 3
        assert "_action" not in spark.table(name).columns and spark.table(name).count() == 3
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")


def test_compaction_keeps_late_columns(spark, tmp_path):
    small = str(tmp_path / "small")
    spark.range(5).write.parquet(small)
    spark.range(5, 8).selectExpr("id", "'x' AS late").write.mode("append").parquet(small)
    compact(spark, small, str(tmp_path / "big"))
    assert spark.read.parquet(str(tmp_path / "big")).filter("late = 'x'").count() == 3


def test_branches_with_any_name(spark, tmp_path):
    df = spark.createDataFrame([("eu: late", 1), ("eu: late", 2), ("us/x", 3)], "route string, id long")
    folders = write_branches(df, "route", str(tmp_path / "b"), ["eu: late", "us/x", "none"])
    assert [spark.read.parquet(folders[n]).count() for n in ("eu: late", "us/x", "none")] == [2, 1, 0]
    with pytest.raises(Exception, match="no branch is named"):
        write_branches(df, "route", str(tmp_path / "c"), ["eu: late"])


def test_broken_pages_stop_the_job(spark, tmp_path):
    (tmp_path / "page.json").write_text(json.dumps({"value": [{"id": 1}, {"id": 2}]})[:-4])
    with pytest.raises(Exception, match="(?i)malformed"):
        read_pages(spark, str(tmp_path), "id bigint").collect()


def test_gate_and_percentiles_on_dirty_input(spark):
    df = spark.createDataFrame([(1, float("nan")), (1, 2.0), (1, 4.0)], "k long, v double")
    gate = quality_gate(df, [QualityRule("fine", "k = 1"), QualityRule("unplanned", "nowhere > 0")]).head()
    assert (gate.passed, gate.first_failed_rule) == (False, "unplanned")
    assert exact_percentiles(df, ["k"], "v", {"median": 0.5}).head().median == 3.0
