"""SQL-condition rules: one shared scan counts the failures of any number of rules."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import asdict, dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pipekit.functions import any_fails, failed_names, fails, rate

SEVERITIES = ("error", "warning", "info")
REPORT_SCHEMA = (
    "rule_name string, description string, severity string, total_records bigint, failed_records bigint, "
    "failure_rate double, max_failure_rate double, passed boolean, status string, error string"
)


@dataclass(frozen=True)
class QualityRule:
    """A SQL condition that rows should meet.

    ``max_failure_rate`` is a fraction (0.01 allows one row in a hundred).  A NULL verdict passes unless
    ``null_fails``.
    """

    name: str
    sql_condition: str
    description: str = ""
    max_failure_rate: float = 0.0
    severity: str = "error"
    null_fails: bool = False

    def __post_init__(self) -> None:
        if self.severity not in SEVERITIES:
            raise ValueError(f"severity must be one of {SEVERITIES}, not {self.severity!r}")

    @property
    def failure(self) -> Column:
        return fails(self.sql_condition, self.null_fails)


def not_null_rule(column: str, **settings: Any) -> QualityRule:
    """The key column has a value."""
    return QualityRule(f"no_nulls_in_{column}", f"{column} IS NOT NULL", f"{column} should not be null", **settings)


# Fixed value: the e-mail pattern of the ready-made rule.
EMAIL_PATTERN = "^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\\\\.[a-zA-Z]{2,}$"


def email_rule(column: str = "email", max_failure_rate: float = 0.01, severity: str = "warning") -> QualityRule:
    """The column looks like an e-mail address; one in a hundred may not."""
    return QualityRule(
        f"valid_{column}_format",
        f"{column} RLIKE '{EMAIL_PATTERN}'",
        f"{column} should be an e-mail address",
        max_failure_rate,
        severity,
    )


def date_range_rule(column: str, first: str = "2020-01-01", last: str = "current_date()", **settings: Any) -> QualityRule:
    """The column lies between a first date and a last one; ``last`` is a SQL expression."""
    return QualityRule(
        f"reasonable_{column}", f"{column} BETWEEN '{first}' AND {last}", f"{column} should be in range", **settings
    )


def analysis_error(df: DataFrame, condition: str) -> str | None:
    """Why the condition cannot be planned on this frame, or None.  Runs no job."""
    try:
        kind = df.select(F.expr(condition).alias("verdict")).schema["verdict"].dataType.simpleString()
    except Exception as error:  # noqa: BLE001 - any analysis failure is the answer
        return str(error).splitlines()[0]
    return None if kind in {"boolean", "void"} else f"the condition is {kind}, not boolean"


def _split_by_analysis(df: DataFrame, rules: Sequence[QualityRule]) -> tuple[list[QualityRule], dict[str, str]]:
    sound, broken = [], {}
    for rule in rules:
        error = analysis_error(df, rule.sql_condition)
        if error is None:
            sound.append(rule)
        else:
            broken[rule.name] = error
    return sound, broken


def _counters(rules: Sequence[QualityRule]) -> list[Column]:
    counts = [F.count_if(rule.failure).alias(f"_failed_{i}") for i, rule in enumerate(rules)]
    return [F.count(F.lit(1)).alias("_total"), *counts]


def _report_row(rule: QualityRule, total: Column, failed: Column, error: str | None = None) -> Column:
    failure_rate = rate(failed, total) if error is None else F.lit(None).cast("double")
    passed = failure_rate <= F.lit(rule.max_failure_rate) if error is None else F.lit(False)
    return F.struct(
        F.lit(rule.name).alias("rule_name"),
        F.lit(rule.description).alias("description"),
        F.lit(rule.severity).alias("severity"),
        total.alias("total_records"),
        (failed if error is None else F.lit(None).cast("bigint")).alias("failed_records"),
        failure_rate.alias("failure_rate"),
        F.lit(float(rule.max_failure_rate)).alias("max_failure_rate"),
        passed.alias("passed"),
        F.lit("ok" if error is None else "error").alias("status"),
        F.lit(error).cast("string").alias("error"),
    )


def quality_report(df: DataFrame, rules: Sequence[QualityRule]) -> DataFrame:
    """A row per rule, lazily, from one aggregate over one scan.

    Nothing but counters crosses the network.  A rule that cannot be planned gets a row with status
    ``error``; one that fails while running (a bad cast) stops this job - see :func:`validate_dataframe`.
    """
    if not rules:
        raise ValueError("give at least one rule")
    sound, broken = _split_by_analysis(df, rules)
    counted = df.agg(*_counters(sound))
    place = {rule.name: i for i, rule in enumerate(sound)}
    total = F.col("_total")
    rows = [
        _report_row(rule, total, F.lit(None), broken[rule.name])
        if rule.name in broken
        else _report_row(rule, total, F.col(f"_failed_{place[rule.name]}"))
        for rule in rules
    ]
    return counted.select(F.inline(F.array(*rows)))


@dataclass(frozen=True)
class RuleResult:
    rule_name: str
    description: str
    severity: str
    total_records: int
    failed_records: int | None
    failure_rate: float | None
    max_failure_rate: float
    passed: bool
    status: str
    error: str | None


@dataclass(frozen=True)
class RuleReport:
    """Outcome of a rule set.  True in a boolean context when no rule of severity ``error`` failed."""

    table_name: str | None
    total_records: int
    rule_results: list[RuleResult] = field(default_factory=list)

    @property
    def rules_passed(self) -> int:
        return sum(result.passed for result in self.rule_results)

    @property
    def rules_failed(self) -> int:
        return len(self.rule_results) - self.rules_passed

    @property
    def is_valid(self) -> bool:
        return all(result.passed for result in self.rule_results if result.severity == "error")

    def __bool__(self) -> bool:
        return self.is_valid

    def to_dataframe(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([tuple(asdict(r).values()) for r in self.rule_results], REPORT_SCHEMA)


def _run_rules(df: DataFrame, rules: Sequence[QualityRule]) -> tuple[int | None, dict[str, int], dict[str, str]]:
    """Total, failures per rule and run-time errors per rule.  One job if nothing raises; otherwise the set
    is halved until the raising rules are alone, so the others keep sharing scans."""
    try:
        row = df.agg(*_counters(rules)).head()
        return row["_total"], {rule.name: row[f"_failed_{i}"] for i, rule in enumerate(rules)}, {}
    except Exception as error:  # noqa: BLE001 - reported per rule
        if not rules:
            raise
        if len(rules) == 1:
            return None, {}, {rules[0].name: str(error).splitlines()[0]}
    middle = len(rules) // 2
    total_a, failed_a, errors_a = _run_rules(df, rules[:middle])
    total_b, failed_b, errors_b = _run_rules(df, rules[middle:])
    return (total_a if total_a is not None else total_b), {**failed_a, **failed_b}, {**errors_a, **errors_b}


def validate_dataframe(df: DataFrame, rules: Sequence[QualityRule], table_name: str | None = None) -> RuleReport:
    """Runs the rules now.  A rule that raises while running is isolated from the others."""
    sound, errors = _split_by_analysis(df, rules)
    total, failed, raised = _run_rules(df, sound)
    errors.update(raised)
    if total is None:
        total = df.count()
    results = []
    for rule in rules:
        common = (rule.name, rule.description, rule.severity, total)
        if rule.name in errors:
            results.append(RuleResult(*common, None, None, rule.max_failure_rate, False, "error", errors[rule.name]))
            continue
        share = failed[rule.name] / total if total else 0.0
        passed = share <= rule.max_failure_rate
        results.append(RuleResult(*common, failed[rule.name], share, rule.max_failure_rate, passed, "ok", None))
    return RuleReport(table_name, total, results)


def validate_table(spark: SparkSession, table_name: str, rules: Sequence[QualityRule]) -> RuleReport:
    return validate_dataframe(spark.table(table_name), rules, table_name)


def failing_rows(df: DataFrame, rules: Sequence[QualityRule]) -> DataFrame:
    """Rows that break at least one rule."""
    return df.filter(any_fails([rule.failure for rule in rules]))


def is_clean(df: DataFrame, rules: Sequence[QualityRule]) -> bool:
    """Whether no row breaks any rule.  Runs a job that stops at the first failing row it meets."""
    return failing_rows(df, rules).isEmpty()


def quality_gate(df: DataFrame, rules: Sequence[QualityRule]) -> DataFrame:
    """One row: whether every rule has zero failures, and the first rule in list order that has some or
    cannot be planned."""
    sound, broken = _split_by_analysis(df, rules)
    counted = df.agg(*_counters(sound))
    place = {id(rule): i for i, rule in enumerate(sound)}
    first = F.coalesce(
        *[
            F.lit(rule.name) if rule.name in broken else F.when(F.col(f"_failed_{place[id(rule)]}") > 0, F.lit(rule.name))
            for rule in rules
        ],
        F.lit(None).cast("string"),
    )
    return counted.select(first.isNull().alias("passed"), first.alias("first_failed_rule"))


def expect_or_drop(df: DataFrame, rules: Sequence[QualityRule]) -> DataFrame:
    """Without the rows that break a rule.  The rows dropped are exactly the rows a report counts."""
    return df.filter(~any_fails([rule.failure for rule in rules]))


def expect_or_fail(df: DataFrame, rules: Sequence[QualityRule]) -> DataFrame:
    """The frame itself; the job stops at a row that breaks a rule.  The check is a filter, so it cannot be
    pruned away."""
    checked = df
    for rule in rules:
        stop = F.raise_error(F.lit(f"expectation failed: {rule.name}"))
        checked = checked.filter(F.when(rule.failure, stop).otherwise(F.lit(True)).cast("boolean"))
    return checked


def tag_failures(df: DataFrame, rules: Sequence[QualityRule]) -> DataFrame:
    """Adds ``_failed_rules``, the sorted names of the rules the row breaks (empty for a valid row)."""
    return df.withColumn("_failed_rules", failed_names({rule.name: rule.failure for rule in rules}))


def split_quarantine(df: DataFrame, rules: Sequence[QualityRule]) -> tuple[DataFrame, DataFrame]:
    """Valid rows, and quarantined rows with the names of the rules they break.  Every row is in one."""
    return expect_or_drop(df, rules), tag_failures(failing_rows(df, rules), rules)


def mark_outcome(df: DataFrame, rules: Sequence[QualityRule]) -> DataFrame:
    """Adds ``_failed_rules`` and ``_outcome`` (``valid`` or ``quarantined``): write it by
    ``layout.write_branches`` to evaluate the input once for both."""
    outcome = F.when(F.size("_failed_rules") == 0, F.lit("valid")).otherwise(F.lit("quarantined"))
    return tag_failures(df, rules).withColumn("_outcome", outcome)


ALERT_LEVELS: Mapping[str, str] = {"error": "critical", "warning": "warning", "info": "notice"}


def quality_alerts(report: DataFrame) -> DataFrame:
    """A row per failed rule of a report, with an alert level by severity."""
    level = F.lit(None).cast("string")
    for severity, name in ALERT_LEVELS.items():
        level = F.when(F.col("severity") == severity, F.lit(name)).otherwise(level)
    counted = F.format_string("%s: %d of %d records", "rule_name", "failed_records", "total_records")
    message = F.when(F.col("status") == "error", F.concat_ws(": ", "rule_name", "error")).otherwise(counted)
    return report.filter(~F.col("passed")).select("rule_name", level.alias("level"), message.alias("message"))
