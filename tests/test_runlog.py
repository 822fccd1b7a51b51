import math
import random
import statistics

import numpy as np
import pytest
from conftest import plan_text

from pyspark.sql import functions as F

from pipekit.operators.percentiles import exact_percentiles
from pipekit.operators.runlog import cost_per_unit, recovery_time, run_durations, run_reliability


@pytest.fixture
def log(spark):
    """One pipeline holds a third of the runs and has long outages."""
    rng = random.Random(7)
    entries = []
    for i in range(1500):
        pipeline = 0 if i % 3 == 0 else rng.randrange(1, 12)
        ok = rng.random() < (0.05 if pipeline == 0 else 0.6)
        entries.append((i, pipeline, 1_700_000_000 + i * 37 + rng.randrange(20), ok, rng.randrange(1, 900) / 8))
    return entries, spark.createDataFrame(
        entries, "id int, pipeline int, s bigint, ok boolean, cost double"
    ).withColumn("at", F.timestamp_seconds("s"))


def brute_recovery(entries):
    result = {}
    for pipeline in {e[1] for e in entries}:
        runs = sorted((e[2], e[0], e[3]) for e in entries if e[1] == pipeline)
        waits, failures = [], 0
        for i, (at, _, ok) in enumerate(runs):
            if ok:
                continue
            failures += 1
            later = [t for t, _, good in runs[i + 1 :] if good]
            if later:
                waits.append(min(later) - at)
        result[pipeline] = (failures, len(waits), statistics.fmean(waits) if waits else None)
    return result


@pytest.mark.parametrize("slices", [1, 3, 16])
def test_recovery_time_over_slices(log, slices):
    entries, df = log
    got = {r.pipeline: r for r in recovery_time(df, "pipeline", "at", F.col("ok"), "id", slices).collect()}
    for pipeline, (failures, recovered, mean) in brute_recovery(entries).items():
        assert (got[pipeline].failures, got[pipeline].recovered) == (failures, recovered)
        assert got[pipeline].mttr_seconds == (pytest.approx(mean) if mean is not None else None)


def test_copies_of_a_run_count_each(log):
    entries, df = log
    doubled = df.unionAll(df.filter("pipeline = 0"))
    got = {r.pipeline: r for r in recovery_time(doubled, "pipeline", "at", F.col("ok"), "id", 4).collect()}
    expected = brute_recovery(entries)
    assert got[0].failures == 2 * expected[0][0] and got[0].recovered == 2 * expected[0][1]
    assert got[0].mttr_seconds == pytest.approx(expected[0][2])
    assert got[3].failures == expected[3][0]


def test_recovery_never(spark):
    df = spark.sql("SELECT 1 AS p, timestamp'2024-01-01' AS at, false AS ok, 1 AS id")
    row = recovery_time(df, "p", "at", F.col("ok"), "id").head()
    assert (row.failures, row.recovered, row.mttr_seconds) == (1, 0, None)


def test_reliability_and_cost(log):
    entries, df = log
    got = {r.pipeline: r for r in run_reliability(df, ["pipeline"], F.col("ok")).collect()}
    zero = [e for e in entries if e[1] == 0]
    assert got[0].runs == len(zero) and got[0].success_rate == pytest.approx(sum(e[3] for e in zero) / len(zero))
    costs = cost_per_unit(df, ["pipeline"], "cost", F.lit(2)).filter("pipeline = 0").head()
    assert costs.total_cost == sum(e[4] for e in zero) and costs.total_units == 2 * len(zero)


def test_exact_percentiles_small_groups(log):
    entries, df = log
    got = {r.pipeline: r for r in exact_percentiles(df, ["pipeline"], "cost", {"p50": 0.5, "p95": 0.95, "top": 1.0, "low": 0.0}).collect()}
    for pipeline, row in got.items():
        values = [e[4] for e in entries if e[1] == pipeline]
        for name, q in (("p50", 0.5), ("p95", 0.95), ("top", 1.0), ("low", 0.0)):
            assert row[name] == pytest.approx(np.quantile(values, q))


def test_exact_percentiles_large_group(spark):
    """Large enough for brackets; a third of the values is one number."""
    df = spark.range(90_000).selectExpr("id % 2 AS g", "if(id % 3 = 0, 500, (id * 7919) % 1009) AS v")
    got = {r.g: r for r in exact_percentiles(df, ["g"], "v", {"p10": 0.1, "p50": 0.5, "p99": 0.99}).collect()}
    ids = np.arange(90_000)
    values = np.where(ids % 3 == 0, 500, (ids * 7919) % 1009)
    for g in (0, 1):
        for name, q in (("p10", 0.1), ("p50", 0.5), ("p99", 0.99)):
            assert got[g][name] == pytest.approx(np.quantile(values[ids % 2 == g], q))
        assert got[g].n == 45_000


def test_exact_percentiles_distinct_values(spark):
    df = spark.range(40_001).selectExpr("1 AS g", "(id * 15485863) % 40001 AS v")
    row = exact_percentiles(df, ["g"], "v", {"p50": 0.5, "p25": 0.25}).head()
    assert row.p50 == 20_000 and row.p25 == 10_000


def test_percentiles_of_a_huge_group_of_one_value_and_a_tiny_one(spark):
    df = spark.range(1_000_003).selectExpr("if(id < 3, 'tiny', 'huge') AS g", "if(id < 3, id * 1.5D, 7.25D) AS v")
    got = {r.g: r for r in exact_percentiles(df, ["g"], "v", {"p50": 0.5, "p90": 0.9}).collect()}
    assert (got["huge"].n, got["huge"].p50, got["huge"].p90) == (1_000_000, 7.25, 7.25)
    assert (got["tiny"].n, got["tiny"].p50) == (3, 1.5) and got["tiny"].p90 == pytest.approx(2.7)


def test_percentiles_of_values_of_any_size_and_sign(spark):
    rng = random.Random(5)
    values = [rng.choice([-1, 1]) * 10.0 ** rng.uniform(-300, 300) for _ in range(500)] + [0.0, -0.0, 5e-324, float("inf")] + [1.0 + i * 2.0**-52 for i in range(50)]
    marks = {f"p{i}": i / 40 for i in range(41)}
    row = exact_percentiles(spark.createDataFrame([(1, v) for v in values], "g int, v double"), ["g"], "v", marks).head()
    ordered = sorted(values)
    for name, q in marks.items():
        at = q * (len(values) - 1)
        low, high = ordered[math.floor(at)], ordered[math.ceil(at)]
        assert row[name] == (low if low == high else low + (high - low) * (at - math.floor(at))), name


def test_percentiles_rank_nothing_in_a_window(spark):
    text = plan_text(exact_percentiles(spark.range(100).selectExpr("id % 2 AS g", "id AS v"), ["g"], "v", {"m": 0.5}))
    assert "Window" not in text


def test_percentiles_with_null_groups_and_values(spark):
    df = spark.createDataFrame([(None, 1.0), (None, 3.0), ("a", None)], "g string, v double")
    assert [(r.g, r.n, r.m) for r in exact_percentiles(df, ["g"], "v", {"m": 0.5}).collect()] == [(None, 2, 2.0)]


def test_durations_compare_adjacent_periods(spark):
    df = spark.createDataFrame([("a", 0, 10.0), ("a", 1, 16.0), ("a", 3, 99.0)], "p string, w int, d double")
    got = {r.period: r for r in run_durations(df, "p", F.col("w"), "d", 1.5).collect()}
    assert got[1].previous_p50 == 10.0 and got[1].regressed
    assert got[3].previous_p50 is None and not got[3].regressed


def test_groups_are_counted_before_the_shuffle(spark):
    text = plan_text(run_reliability(spark.range(10).selectExpr("id % 2 AS p"), ["p"], F.lit(True)))
    assert text.index("partial_count") > 0
