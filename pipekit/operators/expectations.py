"""Expectations: named measures with limits, measured together by a suite in one job."""

from __future__ import annotations

from abc import ABC, abstractmethod
from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pipekit.functions import rate

TOTAL = "total_rows"
# In the frame that a uniqueness expectation measures: how many rows share the combination.
COPIES = "_copies"


class Expectation(ABC):
    """Subclass this: ``measures`` are aggregate columns, ``limits`` the highest value a measure may have.

    A suite evaluates the measures of all its expectations, so an expectation never runs a job of its own.
    With ``distinct_columns`` the measures are taken over one row per combination of those columns, with
    the number of rows that share it in ``_copies``.
    """

    def __init__(self, name: str, severity: str = "error") -> None:
        if severity not in {"error", "warning", "info"}:
            raise ValueError(f"unknown severity {severity!r}")
        self.name = name
        self.severity = severity

    @abstractmethod
    def measures(self) -> dict[str, Column]:
        """Metric name to aggregate column."""

    @abstractmethod
    def limits(self) -> dict[str, float]:
        """Metric name to the highest allowed value."""

    def distinct_columns(self) -> Sequence[str] | None:
        """Columns whose distinct combinations the expectation measures, if it does."""
        return None

    def message(self, metric: str, metrics: dict[str, float]) -> str:
        return f"{self.name}: {metric} is {metrics[metric]:g}, limit {self.limits()[metric]:g}"


class ExpectNonNull(Expectation):
    """The share of NULLs in each column is at most ``max_null_rate`` (a fraction)."""

    def __init__(self, columns: Sequence[str], max_null_rate: float = 0.0, severity: str = "error") -> None:
        super().__init__(f"non_null_{','.join(columns)}", severity)
        self.columns = list(columns)
        self.max_null_rate = max_null_rate

    def measures(self) -> dict[str, Column]:
        found: dict[str, Column] = {}
        for column in self.columns:
            nulls = F.count_if(F.col(column).isNull())
            found[f"{column}_null_count"] = nulls
            found[f"{column}_null_rate"] = rate(nulls, F.count(F.lit(1)))
        return found

    def limits(self) -> dict[str, float]:
        return {f"{column}_null_rate": float(self.max_null_rate) for column in self.columns}

    def message(self, metric: str, metrics: dict[str, float]) -> str:
        column = metric.removesuffix("_null_rate")
        nulls = metrics[f"{column}_null_count"]
        return f"{column}: {nulls:.0f} NULLs are {metrics[metric]:.2%} of the rows, allowed {self.max_null_rate:.2%}"


class ExpectUnique(Expectation):
    """No combination of the columns occurs twice; NULLs count as equal."""

    def __init__(self, columns: Sequence[str], severity: str = "error") -> None:
        super().__init__(f"unique_{','.join(columns)}", severity)
        self.columns = list(columns)

    def distinct_columns(self) -> Sequence[str]:
        return self.columns

    def measures(self) -> dict[str, Column]:
        total, distinct = F.coalesce(F.sum(COPIES), F.lit(0)), F.count(F.lit(1))
        return {TOTAL: total, "unique_rows": distinct, "duplicate_count": total - distinct}

    def limits(self) -> dict[str, float]:
        return {"duplicate_count": 0.0}

    def message(self, metric: str, metrics: dict[str, float]) -> str:
        return f"{', '.join(self.columns)}: {metrics[metric]:.0f} rows are duplicates"


@dataclass(frozen=True)
class ValidationResult:
    """``error_count`` counts messages, not rows.  True in a boolean context when valid."""

    is_valid: bool
    error_count: int
    errors: list[str] = field(default_factory=list)
    warnings: list[str] = field(default_factory=list)
    metrics: dict[str, dict[str, Any]] = field(default_factory=dict)

    def __bool__(self) -> bool:
        return self.is_valid


class ExpectationSuite:
    """Expectations checked together."""

    def __init__(self, expectations: Sequence[Expectation]) -> None:
        names = [expectation.name for expectation in expectations]
        if len(set(names)) != len(names):
            raise ValueError(f"expectation names must differ: {names}")
        self.expectations = list(expectations)

    def _passes(self) -> list[list[Expectation]]:
        """Expectations grouped by what they can share.

        All plain counters share one scan and send one row per task over the network.  Each set of distinct
        columns gets a scan of just those columns and a grouping with partial counts: the shuffle carries
        the keys and nothing else.  Putting the counters into the distinct aggregation would save the narrow
        scan but drag every counter along with every key, and several distinct sets in one aggregation
        would first copy every row once per set.
        """
        plain = [e for e in self.expectations if not e.distinct_columns()]
        keyed = [e for e in self.expectations if e.distinct_columns()]
        sets = sorted({tuple(e.distinct_columns()) for e in keyed})
        by_set = [[e for e in keyed if tuple(e.distinct_columns()) == s] for s in sets]
        return [plain, *by_set] if plain else by_set

    @staticmethod
    def _measure(df: DataFrame, group: Sequence[Expectation]) -> DataFrame:
        columns = group[0].distinct_columns()
        if columns:
            df = df.groupBy(*columns).agg(F.count(F.lit(1)).alias(COPIES))
        aggregates, rows = [], []
        for e, expectation in enumerate(group):
            limits = expectation.limits()
            for m, (metric, column) in enumerate(expectation.measures().items()):
                alias = f"_m_{e}_{m}"
                aggregates.append(column.cast("double").alias(alias))
                limit = F.lit(limits.get(metric)).cast("double")
                rows.append(
                    F.struct(
                        F.lit(expectation.name).alias("expectation"),
                        F.lit(expectation.severity).alias("severity"),
                        F.lit(metric).alias("metric"),
                        F.col(alias).alias("value"),
                        limit.alias("max_value"),
                        F.coalesce(F.col(alias) <= limit, F.lit(True)).alias("passed"),
                    )
                )
        return df.agg(*aggregates).select(F.inline(F.array(*rows)))

    def report(self, df: DataFrame) -> DataFrame:
        """A row per expectation and metric, lazily and in one job: value, limit (if any) and verdict."""
        if not self.expectations:
            raise ValueError("the suite has no expectations")
        return self._union(df, self._passes())

    def validate(self, df: DataFrame) -> ValidationResult:
        """Measures now.  An expectation that cannot be planned or that raises becomes an error message and
        does not disturb the others."""
        measured: dict[str, dict[str, float]] = {}
        problems: dict[str, str] = {}
        self._collect(df, self._passes(), measured, problems)
        errors, warnings = [], []
        for expectation in self.expectations:
            if expectation.name in problems:
                errors.append(f"{expectation.name} could not be measured: {problems[expectation.name]}")
                continue
            metrics = measured[expectation.name]
            broken = [m for m, limit in expectation.limits().items() if metrics[m] is not None and metrics[m] > limit]
            texts = [expectation.message(metric, metrics) for metric in broken]
            (errors if expectation.severity == "error" else warnings).extend(texts)
        return ValidationResult(not errors, len(errors), errors, warnings, measured)

    def _collect(
        self,
        df: DataFrame,
        passes: list[list[Expectation]],
        measured: dict[str, dict[str, float]],
        problems: dict[str, str],
    ) -> None:
        """Runs all passes as one job.  If that raises, the expectations are halved until the raising ones are
        alone, so that the others still share scans."""
        if not passes:
            return
        try:
            rows = self._union(df, passes).collect()  # a row per metric
        except Exception as error:  # noqa: BLE001 - reported per expectation
            if len(passes) > 1:
                halves = passes[: len(passes) // 2], passes[len(passes) // 2 :]
            elif len(passes[0]) > 1:
                halves = [passes[0][: len(passes[0]) // 2]], [passes[0][len(passes[0]) // 2 :]]
            else:
                problems[passes[0][0].name] = str(error).splitlines()[0]
                return
            for half in halves:
                self._collect(df, half, measured, problems)
            return
        for row in rows:
            measured.setdefault(row["expectation"], {})[row["metric"]] = row["value"]

    def _union(self, df: DataFrame, passes: list[list[Expectation]]) -> DataFrame:
        parts = [self._measure(df, group) for group in passes]
        return reduce(lambda left, right: left.unionByName(right), parts)


class SchemaExpectation:
    """The frame has exactly the expected schema: names, order, types and, unless told otherwise,
    nullability.  Needs no job."""

    def __init__(self, expected: Any, check_nullability: bool = True) -> None:
        self.expected = expected
        self.check_nullability = check_nullability

    def validate(self, df: DataFrame) -> ValidationResult:
        actual, expected = df.schema, self.expected
        if not self.check_nullability:
            actual = [(f.name, f.dataType) for f in actual.fields]
            expected = [(f.name, f.dataType) for f in expected.fields]
        if actual == expected:
            return ValidationResult(True, 0)
        found, wanted = df.schema.simpleString(), self.expected.simpleString()
        detail = f"{found} instead of {wanted}" if found != wanted else "nullability differs"
        return ValidationResult(False, 1, [f"schema mismatch: {detail}"])
