"""Who may see what: levels, row policies, entitlements, masks, tags."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pipekit.functions import any_fails, holds, rate


def filter_by_level(df: DataFrame, column: str, user_level: str, order: Sequence[str]) -> DataFrame:
    """Rows at or below the user's level.  ``order`` lists the levels from lowest to highest; a row with
    an unknown level is shown to nobody.  Becomes an IN filter that the scan can use."""
    if user_level not in order:
        raise ValueError(f"unknown level {user_level!r}")
    visible = list(order[: list(order).index(user_level) + 1])
    return df.filter(F.col(column).isin(visible))


@dataclass(frozen=True)
class RowPolicy:
    """Grants the rows that satisfy a SQL predicate to the listed principals (users or groups)."""

    name: str
    predicate: str
    principals: frozenset[str]


def secure(df: DataFrame, policies: Iterable[RowPolicy], principal: str, groups: Iterable[str] = ()) -> DataFrame:
    """Rows granted to the principal by any policy.  No grant, no rows."""
    identities = {principal, *groups}
    granted = [holds(policy.predicate) for policy in policies if identities & policy.principals]
    return df.filter(any_fails(granted)) if granted else df.filter(F.lit(False))


def entitled(df: DataFrame, entitlements: DataFrame, on: Sequence[str], **attributes: str) -> DataFrame:
    """Rows whose key columns the user's attributes entitle them to.

    ``attributes`` select the user's entitlement rows; those are made distinct first, and a semi join
    neither multiplies rows nor carries entitlement columns.
    """
    for column, value in attributes.items():
        entitlements = entitlements.filter(F.col(column) == F.lit(value))
    return df.join(entitlements.select(*on).distinct(), on=list(on), how="left_semi")


def mask_chars(column: str) -> Column:
    """Letters and digits replaced (X, x, n), everything else kept."""
    return F.mask(F.col(column))


def mask_hash(column: str) -> Column:
    """SHA-256 in hex: equal values stay equal."""
    return F.sha2(F.col(column), 256)


def mask_tail(visible: int = 4) -> Mapping:
    """Everything but the last ``visible`` characters becomes a star."""

    def apply(column: str) -> Column:
        return F.regexp_replace(F.col(column), f".(?=.{{{visible}}})", "*")

    return apply


def mask_null(column: str) -> Column:
    return F.lit(None)


MASKS = {"chars": mask_chars, "hash": mask_hash, "null": mask_null, "tail": mask_tail()}


def mask_columns(df: DataFrame, masks: Mapping[str, str]) -> DataFrame:
    """Replaces columns by masked ones; values of ``masks`` are keys of ``MASKS`` or callables."""
    types = {field.name: field.dataType for field in df.schema.fields}
    masked = {}
    for column, kind in masks.items():
        build = kind if callable(kind) else MASKS.get(kind)
        if build is None:
            raise ValueError(f"unknown mask {kind!r}, expected one of {sorted(MASKS)}")
        value = build(column)
        masked[column] = value.cast(types[column]) if kind == "null" else value
    return df.withColumns(masked)


@dataclass(frozen=True)
class TagPattern:
    """A content pattern.  ``literal``, if given, is a text that every match contains: looking for it first
    is far cheaper than the pattern and spares most rows the pattern."""

    pattern: str
    literal: str | None = None

    def found_in(self, column: str) -> Column:
        hit = F.col(column).rlike(self.pattern)
        return hit if self.literal is None else F.col(column).contains(self.literal) & hit


# Column content patterns, in the common subset of Java and RE2 syntax.
TAG_PATTERNS: dict[str, TagPattern] = {
    "email": TagPattern(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", "@"),
    "ipv4": TagPattern(r"\b[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\b", "."),
    "phone": TagPattern(r"\b[0-9]{3}[-. ][0-9]{3,4}[-. ][0-9]{4}\b"),
    "url": TagPattern(r"https?://[A-Za-z0-9./_-]+", "://"),
}


def classify_columns(
    df: DataFrame, columns: Sequence[str], patterns: Mapping[str, TagPattern] = TAG_PATTERNS, min_rate: float = 0.5
) -> DataFrame:
    """How often each column's text matches each pattern, and whether it gets the tag.

    One aggregate over one scan, unpivoted to a row per column and pattern.
    """
    pairs = [(column, tag) for column in columns for tag in patterns]
    counters = [F.count(F.col(c)).alias(f"_seen_{i}") for i, c in enumerate(columns)]
    counters += [F.count_if(patterns[tag].found_in(c)).alias(f"_hits_{i}") for i, (c, tag) in enumerate(pairs)]
    counted = df.agg(*counters)
    place = {column: i for i, column in enumerate(columns)}
    rows = [
        F.struct(
            F.lit(column).alias("column_name"),
            F.lit(tag).alias("tag"),
            F.col(f"_seen_{place[column]}").alias("seen"),
            F.col(f"_hits_{i}").alias("hits"),
            rate(F.col(f"_hits_{i}"), F.col(f"_seen_{place[column]}")).alias("hit_rate"),
        )
        for i, (column, tag) in enumerate(pairs)
    ]
    long = counted.select(F.inline(F.array(*rows)))
    return long.withColumn("tagged", (F.col("hits") > 0) & (F.col("hit_rate") >= F.lit(float(min_rate))))


def route_rows(df: DataFrame, routes: Mapping[str, str | Column], default: str = "default") -> DataFrame:
    """Adds ``_route``: the first branch, in mapping order, whose condition is certainly true."""
    branch = None
    for name, condition in routes.items():
        branch = (F if branch is None else branch).when(holds(condition), F.lit(name))
    return df.withColumn("_route", F.lit(default) if branch is None else branch.otherwise(F.lit(default)))
