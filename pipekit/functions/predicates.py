"""One definition of "this row breaks the rule", shared by counting, dropping, tagging and streaming."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def named(column: str) -> Column:
    """The column of exactly that name, also when it contains dots."""
    return F.col("`" + column.replace("`", "``") + "`")


def _condition(condition: str | Column) -> Column:
    return F.expr(condition) if isinstance(condition, str) else condition


def fails(condition: str | Column, null_fails: bool = False) -> Column:
    """True where the condition is broken.  A NULL verdict passes unless ``null_fails``."""
    verdict = _condition(condition)
    if null_fails:
        return ~F.coalesce(verdict, F.lit(False))
    return F.coalesce(~verdict, F.lit(False))


def holds(condition: str | Column) -> Column:
    """True where the condition is certainly true, false where it is false or NULL."""
    return F.coalesce(_condition(condition), F.lit(False))


def any_fails(conditions: list[Column]) -> Column:
    return reduce(lambda left, right: left | right, conditions, F.lit(False))


def failed_names(named: Mapping[str, Column]) -> Column:
    """Sorted array of the names whose failure column is true."""
    if not named:
        return F.array().cast("array<string>")
    flags = [F.when(failure, F.lit(name)) for name, failure in sorted(named.items())]
    return F.array_compact(F.array(*flags))
