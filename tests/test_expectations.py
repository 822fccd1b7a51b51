import pytest
from conftest import DATA, plan_text

from pyspark.sql import functions as F
from pyspark.sql import types as T

from pipekit.operators.expectations import (
    Expectation,
    ExpectationSuite,
    ExpectNonNull,
    ExpectUnique,
    SchemaExpectation,
)
from pipekit.operators.stats import column_stats, freshness


def test_null_counts_ignore_nan(nulls_nan):
    result = ExpectationSuite([ExpectNonNull(["b", "x"], 0.25)]).validate(nulls_nan)
    metrics = result.metrics["non_null_b,x"]
    assert metrics == {"b_null_count": 2, "b_null_rate": 0.5, "x_null_count": 1, "x_null_rate": 0.25}
    assert result.error_count == 1 and "b: 2 NULLs are 50.00% of the rows" in result.errors[0]


def test_unique_counts_null_rows(nulls_nan):
    result = ExpectationSuite([ExpectUnique(["a", "b"])]).validate(nulls_nan)
    assert result.metrics["unique_a,b"] == {"total_rows": 4, "unique_rows": 2, "duplicate_count": 2}
    assert not result


def test_empty_frame_is_valid(empty):
    result = ExpectationSuite([ExpectNonNull(["id"]), ExpectUnique(["id"])]).validate(empty)
    assert result.is_valid and result.metrics["non_null_id"]["id_null_rate"] == 0


def test_severity_decides_between_errors_and_warnings(nulls_nan):
    suite = ExpectationSuite([ExpectNonNull(["b"], severity="warning"), ExpectUnique(["x"])])
    result = suite.validate(nulls_nan)
    assert result.is_valid and result.error_count == 0 and len(result.warnings) == 1


def test_broken_expectation_becomes_an_error(nulls_nan):
    class Raises(Expectation):
        def measures(self):
            return {"worst": F.max(F.col("b").cast("int"))}

        def limits(self):
            return {"worst": 1.0}

    suite = ExpectationSuite([ExpectNonNull(["nope"]), ExpectNonNull(["a"]), Raises("raises")])
    result = suite.validate(nulls_nan)
    assert result.error_count == 2 and set(result.metrics) == {"non_null_a"}
    assert any("non_null_nope failed" in e for e in result.errors)
    assert any("raises failed" in e for e in result.errors)


def test_custom_expectation(spark):
    class MeanBelow(Expectation):
        def measures(self):
            return {"mean": F.avg("id")}

        def limits(self):
            return {"mean": 10.0}

    suite = ExpectationSuite([MeanBelow("mean_below"), ExpectUnique(["id"])])
    assert suite.validate(spark.range(10))
    assert suite.validate(spark.range(100)).errors == ["mean_below: mean is 49.5, limit 10"]


def test_counters_share_a_scan_and_keys_travel_alone(spark):
    lineitem = spark.read.parquet(f"{DATA}/lineitem.parquet")
    plain = ExpectationSuite([ExpectNonNull([c]) for c in ("l_partkey", "l_suppkey", "l_shipdate")]).report(lineitem)
    assert plan_text(plain).count("Scan parquet") == 2  # in the tree and in the details: one scan
    keyed = ExpectationSuite(
        [ExpectNonNull(["l_tax"]), ExpectUnique(["l_partkey"]), ExpectUnique(["l_orderkey"])]
    ).report(lineitem)
    text = plan_text(keyed)
    assert "Expand" not in text
    for column, kind in (("l_tax", "double"), ("l_partkey", "bigint"), ("l_orderkey", "bigint")):
        assert f"ReadSchema: struct<{column}:{kind}>" in text


def test_names_must_differ():
    with pytest.raises(ValueError, match="differ"):
        ExpectationSuite([ExpectUnique(["a"]), ExpectUnique(["a"])])


def test_schema_expectation(spark):
    loose = T.StructType([T.StructField("id", T.LongType(), True)])
    frame = spark.range(1)
    assert SchemaExpectation(frame.schema).validate(frame)
    assert not SchemaExpectation(loose).validate(frame)  # nullability differs
    assert SchemaExpectation(loose, check_nullability=False).validate(frame)
    wrong = SchemaExpectation(T.StructType([T.StructField("id", T.StringType())]), False).validate(frame)
    assert "instead of" in wrong.errors[0]


def test_freshness(spark):
    df = spark.sql("SELECT timestamp'2024-01-01 00:59:00' AS ts, 'a' AS kind")
    now = F.lit("2024-01-01 02:00:00").cast("timestamp")
    assert freshness(df, "ts", 0, now).head().asDict()["delay_hours"] == 1  # whole elapsed hours
    assert freshness(df, "ts", 1, now, by=["kind"]).head().freshness_status == "FRESH"
    assert freshness(df, "ts", 0, now).head().freshness_status == "STALE"
    assert freshness(df.limit(0), "ts", 5, now).head().freshness_status == "UNKNOWN"


def test_column_stats(nulls_nan):
    exact = {r.column_name: r for r in column_stats(nulls_nan, ["a", "b"], exact_distinct=True).collect()}
    sketch = {r.column_name: r for r in column_stats(nulls_nan, ["a", "b"]).collect()}
    assert exact["b"].null_count == 2 and exact["b"].distinct_count == 1 and exact["a"].max_value == "2"
    assert exact["a"].distinct_count == sketch["a"].distinct_count == 2
