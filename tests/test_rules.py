import pytest
from conftest import plan_text, rows

from pyspark.sql import functions as F

from pipekit.functions import failed_names, fails, holds
from pipekit.operators.rules import (
    QualityRule,
    date_range_rule,
    email_rule,
    expect_or_drop,
    expect_or_fail,
    failing_rows,
    is_clean,
    not_null_rule,
    quality_alerts,
    quality_gate,
    quality_report,
    split_quarantine,
    tag_failures,
    validate_dataframe,
    validate_table,
)


def test_id_rule_passes(users):
    report = validate_dataframe(users, [not_null_rule("id")])
    assert (report.rules_passed, report.rules_failed, report.total_records) == (1, 0, 3)
    assert bool(report)


def test_ready_made_rules(users):
    rules = [not_null_rule("id"), email_rule(), date_range_rule("created_date")]
    report = validate_dataframe(users, rules)
    email = report.rule_results[1]
    assert email.failed_records == 1 and email.failure_rate == pytest.approx(1 / 3) and not email.passed
    assert report.rule_results[2].failed_records == 0
    assert report.is_valid  # the e-mail rule only warns
    assert report.to_dataframe(users.sparkSession).count() == 3


def test_null_verdict_passes_unless_told_otherwise(spark):
    df = spark.createDataFrame([(1,), (None,), (-1,)], "x int")
    lenient, strict = QualityRule("pos", "x > 0"), QualityRule("strict", "x > 0", null_fails=True)
    counts = {r.rule_name: r.failed_records for r in quality_report(df, [lenient, strict]).collect()}
    assert counts == {"pos": 1, "strict": 2}
    assert rows(expect_or_drop(df, [lenient])) == [(None,), (1,)]
    assert rows(expect_or_drop(df, [strict])) == [(1,)]
    assert rows(df.filter(holds("x > 0"))) == [(1,)]
    assert df.filter(fails("x > 0")).count() == 1


def test_empty_input(empty):
    row = quality_report(empty, [not_null_rule("id")]).head()
    assert (row.total_records, row.failed_records, row.failure_rate, row.passed) == (0, 0, 0.0, True)
    assert validate_dataframe(empty, [not_null_rule("id")]).total_records == 0
    assert quality_gate(empty, [not_null_rule("id")]).head().passed


def test_threshold_is_a_fraction(spark):
    df = spark.range(100)
    rule = QualityRule("most", "id >= 5", max_failure_rate=0.05)
    assert quality_report(df, [rule]).head().passed
    assert not quality_report(df, [QualityRule("most", "id >= 6", max_failure_rate=0.05)]).head().passed


def test_unplannable_rule_gets_an_error_row(users):
    rules = [QualityRule("broken", "nothing_here = 1"), QualityRule("number", "id + 1"), not_null_rule("id")]
    report = {r.rule_name: r for r in quality_report(users, rules).collect()}
    assert report["broken"].status == "error" and not report["broken"].passed and "nothing_here" in report["broken"].error
    assert report["number"].status == "error"
    assert report["no_nulls_in_id"].passed
    eager = validate_dataframe(users, rules)
    assert (eager.rules_passed, eager.rules_failed, eager.is_valid) == (1, 2, False)


def test_run_time_error_is_isolated(spark):
    df = spark.createDataFrame([("1",), ("x",)], "s string")
    rules = [QualityRule("a", "s IS NOT NULL"), QualityRule("cast", "CAST(s AS int) > 0"), QualityRule("b", "s <> 'x'")]
    results = {r.rule_name: r for r in validate_dataframe(df, rules).rule_results}
    assert results["a"].passed and results["b"].failed_records == 1
    assert results["cast"].status == "error" and "CAST_INVALID_INPUT" in results["cast"].error


def test_rules_share_one_scan(spark):
    from conftest import DATA

    customer = spark.read.parquet(f"{DATA}/customer.parquet")
    rules = [QualityRule(f"r{i}", f"c_acctbal > {i}") for i in range(20)]
    text = plan_text(quality_report(customer, rules))
    assert text.count("Scan parquet") == 2  # once in the tree, once in the details: one scan
    assert "ReadSchema: struct<c_acctbal:double>" in text


def test_validate_table(spark, users):
    users.createOrReplaceTempView("users_view")
    report = validate_table(spark, "users_view", [not_null_rule("email")])
    assert report.table_name == "users_view" and report.is_valid


def test_gate_and_is_clean(users):
    ok, bad = not_null_rule("id"), QualityRule("small", "id < 3")
    assert quality_gate(users, [ok]).head().asDict() == {"passed": True, "first_failed_rule": None}
    assert quality_gate(users, [ok, bad]).head().asDict() == {"passed": False, "first_failed_rule": "small"}
    assert is_clean(users, [ok]) and not is_clean(users, [ok, bad])


def test_quarantine_and_valid_make_the_input(nulls_nan):
    rules = [QualityRule("has_b", "b IS NOT NULL"), QualityRule("a_small", "a < 2"), QualityRule("x_big", "x > 1")]
    valid, bad = split_quarantine(nulls_nan, rules)
    assert valid.count() + bad.count() == nulls_nan.count()
    assert bad.filter(F.size("_failed_rules") == 0).isEmpty()
    assert failing_rows(nulls_nan, rules).count() == bad.count()
    assert tag_failures(nulls_nan, []).filter(F.size("_failed_rules") > 0).isEmpty()
    assert failed_names({}) is not None


def test_expect_or_fail(users):
    assert expect_or_fail(users, [not_null_rule("id")]).count() == 3
    with pytest.raises(Exception, match="expectation failed: small"):
        expect_or_fail(users, [QualityRule("small", "id < 3")]).count()


def test_alerts(users):
    rules = [QualityRule("small", "id < 3", severity="warning"), QualityRule("bad", "nope"), not_null_rule("id")]
    alerts = {r.rule_name: r for r in quality_alerts(quality_report(users, rules)).collect()}
    assert set(alerts) == {"small", "bad"}
    assert alerts["small"].level == "warning" and alerts["small"].message == "small: 1 of 3 records"
    assert alerts["bad"].level == "critical"


def test_severity_is_checked():
    with pytest.raises(ValueError, match="fatal"):
        QualityRule("x", "true", severity="fatal")
