"""Cleaning rules: callables from frame to frame, chained with ``DataFrame.transform``."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TEXT_OPERATIONS: dict[str, Callable[[Column], Column]] = {"trim": F.trim, "upper": F.upper, "lower": F.lower}


@dataclass(frozen=True)
class DropNulls:
    """Keeps rows that have a value in every listed column.  NaN counts as missing in float columns."""

    columns: Sequence[str]

    def __call__(self, df: DataFrame) -> DataFrame:
        return df.dropna(subset=list(self.columns))


@dataclass(frozen=True)
class StandardizeText:
    """Applies ``trim`` (spaces only), ``upper`` or ``lower`` to the listed columns, in one projection."""

    columns: Sequence[str]
    operation: str = "trim"

    def __post_init__(self) -> None:
        if self.operation not in TEXT_OPERATIONS:
            raise ValueError(f"unknown text operation {self.operation!r}, expected one of {sorted(TEXT_OPERATIONS)}")

    def __call__(self, df: DataFrame) -> DataFrame:
        apply = TEXT_OPERATIONS[self.operation]
        return df.withColumns({column: apply(F.col(column)) for column in self.columns})


def chain(df: DataFrame, steps: Iterable[Callable[[DataFrame], DataFrame]]) -> DataFrame:
    """The steps in list order.  Adjacent projections and filters collapse into one stage."""
    return reduce(lambda frame, step: frame.transform(step), steps, df)


@dataclass
class Cleaner:
    """An extensible list of cleaning rules that is itself a step."""

    rules: list[Callable[[DataFrame], DataFrame]] = field(default_factory=list)

    def add(self, rule: Callable[[DataFrame], DataFrame]) -> Cleaner:
        self.rules.append(rule)
        return self

    def __call__(self, df: DataFrame) -> DataFrame:
        return chain(df, self.rules)
