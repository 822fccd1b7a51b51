"""Shapes a user implements to plug own parts into a flow; no base class is needed."""

from __future__ import annotations

from typing import Any, Protocol, runtime_checkable

from pyspark.sql import DataFrame


@runtime_checkable
class Source(Protocol):
    def read_table(self, name: str) -> DataFrame: ...

    def read_incremental(
        self, name: str, watermark_column: str, last_value: Any, inclusive: bool = False
    ) -> DataFrame: ...


@runtime_checkable
class Step(Protocol):
    """Anything callable from frame to frame: a cleaning rule, an enrichment, a plain function."""

    def __call__(self, df: DataFrame) -> DataFrame: ...


@runtime_checkable
class Validator(Protocol):
    """``validate`` returns an object whose truth value is the verdict."""

    def validate(self, df: DataFrame) -> Any: ...


@runtime_checkable
class Writer(Protocol):
    def write(self, df: DataFrame, destination: str, mode: str = "overwrite") -> None: ...
