"""What the planner makes of the registered queries."""

import pytest
from conftest import DATA, plan_text

import __spark_entry__ as entry
from pyspark.sql import functions as F

from pipekit.operators.merge import ALWAYS, MergeRule, upsert
from pipekit.operators.runlog import recovery_time
from pipekit.plans.registry import QUERIES


@pytest.fixture
def no_broadcast(spark):
    """Plans as they are when no side is small."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


WRITES = {
    "batch_publish",
    "cdc_apply",
    "cdc_apply_folded",
    "change_log_stats",
    "column_sketches",
    "expect_unique_increment",
    "incremental_publish",
    "incremental_publish_partitioned",
    "lineage_downstream",
    "page_chain",
    "paged_entities",
    "run_simple",
    "upsert_partitions",
    "upsert_table_stats",
    "validate_table",
    "widen_append",
}
LAZY = sorted(
    name
    for name in QUERIES
    if name not in WRITES
    and not name.startswith(("stream_", "compact", "zorder", "write_", "archive", "table_", "create_", "path_"))
)


@pytest.mark.parametrize("name", LAZY)
def test_no_cross_joins_and_no_python(spark, no_broadcast, name):
    text = plan_text(entry.queries()[name](spark, DATA))
    for unwanted in ("CartesianProduct", "BroadcastNestedLoopJoin", "EvalPython", "InPandas", "InArrow"):
        assert unwanted not in text


def test_filters_and_columns_reach_the_scan(spark):
    text = plan_text(entry.queries()["parameterized_query"](spark, DATA))
    assert "EqualTo(l_returnflag,A)" in text and "GreaterThanOrEqual(l_quantity,25.0)" in text
    assert "l_shipdate" in text.split("PushedFilters")[1].split("\n")[0]
    assert "l_comment" not in text and "l_tax" not in text


def test_orders_are_aggregated_before_the_join(spark, no_broadcast):
    tree = plan_text(entry.queries()["customer_360"](spark, DATA)).split("\n\n")[0]
    nodes = [line.strip(" +-:*") for line in tree.splitlines()]
    orders_side = nodes[[i for i, n in enumerate(nodes) if n.startswith("HashAggregate")][0] :]
    assert orders_side[0].startswith("HashAggregate") and orders_side[1].startswith("Exchange")
    assert orders_side[2].startswith("HashAggregate")  # partial counts, then the shuffle, then the join


def test_cleaning_is_one_stage(spark):
    text = plan_text(entry.queries()["clean_chain"](spark, DATA))
    assert "Exchange" not in text and text.split("\n\n")[0].count("Project") == 1


def test_large_merge_splits_the_target_not_the_outer_join(spark, no_broadcast, tmp_path):
    """The target is the left side of a left join, which AQE may split; a full outer join it may not."""
    spark.range(100).selectExpr("id AS k", "id AS v").write.parquet(str(tmp_path / "t"))
    old = spark.read.parquet(str(tmp_path / "t"))
    text = plan_text(upsert(old, old, MergeRule(["k"], ALWAYS, order_by=["v"])))
    assert "SortMergeJoin LeftOuter" in text and "FullOuter" not in text


def test_a_busy_pipeline_is_split_by_time(spark):
    runs = spark.range(1000).select(
        F.lit("only").alias("p"), F.timestamp_seconds("id").alias("at"), (F.col("id") % 2 == 0).alias("ok"), "id"
    )
    text = plan_text(recovery_time(runs, "p", "at", F.col("ok"), "id", slices=4))
    assert "rangepartitioning(" in text
    row = recovery_time(runs, "p", "at", F.col("ok"), "id", slices=4).head()
    assert (row.failures, row.recovered, row.mttr_seconds) == (500, 499, 1.0)


def test_skewed_join_is_split_at_run_time(spark, tmp_path):
    """One key with a third of the rows, no broadcast: AQE cuts its partition."""
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "10k",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "10k",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.shuffle.partitions": "20",
    }
    for key, value in settings.items():
        spark.conf.set(key, value)
    try:
        from pipekit.operators.enrich import lookup_join

        hot = F.when(F.col("id") % 3 == 0, F.lit(7)).otherwise(F.col("id"))
        df = spark.range(0, 60_000, 1, 8).select(hot.alias("k"), F.col("id").alias("row"))
        lookup = spark.range(60_000).select(F.col("id").alias("k"), F.col("id").alias("extra"))
        joined = lookup_join(df, lookup, "k", ["extra"])
        assert joined.count() == 60_000
        joined.collect()
        assert "skew=true" in plan_text(joined).replace("isSkew=true", "skew=true")
    finally:
        for key in settings:
            spark.conf.unset(key)
        spark.conf.set("spark.sql.shuffle.partitions", "4")
