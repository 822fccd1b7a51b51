"""Lookup enrichment: left outer equi-join on a same-named column.

No broadcast hint is given.  Spark broadcasts a lookup whose measured size is under
``spark.sql.autoBroadcastJoinThreshold`` and shuffles a larger one; AQE then splits oversized partitions
of the left side.  ``split_hot_keys`` is for lookups too large to broadcast under heavy skew.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pipekit.operators.latest import unique_or_fail

ON_DUPLICATE = ("error", "first", "multiply")


def _prepared_lookup(lookup: DataFrame, key: str, columns: Sequence[str], on_duplicate: str) -> DataFrame:
    slim = lookup.select(key, *columns)
    if on_duplicate == "multiply":
        return slim
    # A NULL key joins nothing, so it needs neither a check nor a shuffle slot.
    slim = slim.filter(F.col(key).isNotNull())
    if on_duplicate == "error":
        return unique_or_fail(slim, [key], f"duplicate lookup key in {key}")
    packed = F.min(F.struct(*columns)).alias("_first") if columns else F.count(F.lit(1)).alias("_first")
    grouped = slim.groupBy(key).agg(packed)
    return grouped.select(key, *[F.col(f"_first.{column}").alias(column) for column in columns])


def lookup_join(
    df: DataFrame,
    lookup: DataFrame,
    key: str,
    columns: Sequence[str],
    on_duplicate: str = "multiply",
    split_hot_keys: bool = False,
) -> DataFrame:
    """Adds ``columns`` of ``lookup`` to every row of ``df``; unmatched rows keep NULLs.

    ``on_duplicate``: ``multiply`` repeats a row per matching lookup row, ``first`` takes the smallest
    value tuple per key, ``error`` stops the job.
    """
    if on_duplicate not in ON_DUPLICATE:
        raise ValueError(f"on_duplicate must be one of {ON_DUPLICATE}, not {on_duplicate!r}")
    clash = sorted(set(columns) & set(df.columns))
    if clash:
        raise ValueError(f"lookup columns already present: {clash}")
    prepared = _prepared_lookup(lookup, key, columns, on_duplicate)
    if split_hot_keys:
        if on_duplicate == "multiply":
            raise ValueError("split_hot_keys needs unique lookup keys: on_duplicate error or first")
        return _split_join(df, prepared, key)
    return df.join(prepared, on=key, how="left")


HOT_SHARE = 0.01


def hot_keys(df: DataFrame, key: str, share: float = HOT_SHARE) -> list:
    """Keys that each hold at least ``share`` of the rows; at most ``1 / share`` of them.  Runs a job.

    The counts are combined before the shuffle, so a hot key costs one row per task; the total is the
    sum of the counts.  Only the key column is read.
    """
    counts = df.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    total = df.agg(F.count(F.lit(1)).alias("total"))
    threshold = F.greatest(F.lit(1.0), total.scalar() * F.lit(share))
    hot = counts.filter(F.col(key).isNotNull() & (F.col("n") >= threshold))
    return [row[0] for row in hot.select(key).collect()]


def _split_join(df: DataFrame, lookup: DataFrame, key: str) -> DataFrame:
    """Rows of hot keys meet a lookup of at most ``1 / HOT_SHARE`` rows, which is broadcast, so they are
    never shuffled.  Rows with NULL keys match nothing and skip the join.  The rest joins as usual."""
    hot = hot_keys(df, key)
    missing = [column for column in lookup.columns if column != key]
    types = {field.name: field.dataType for field in lookup.schema.fields}
    unkeyed = df.filter(F.col(key).isNull()).withColumns({c: F.lit(None).cast(types[c]) for c in missing})
    keyed = df.filter(F.col(key).isNotNull())
    if not hot:
        return keyed.join(lookup, on=key, how="left").unionByName(unkeyed)
    is_hot = F.col(key).isin(hot)
    heavy = keyed.filter(is_hot).join(F.broadcast(lookup.filter(is_hot)), on=key, how="left")
    light = keyed.filter(~is_hot).join(lookup.filter(~is_hot), on=key, how="left")
    return light.unionByName(heavy).unionByName(unkeyed)


@dataclass(frozen=True)
class Lookup:
    """An enrichment step.  ``lookup`` is a frame or the name of a catalog table."""

    lookup: DataFrame | str
    key: str
    columns: Sequence[str]
    on_duplicate: str = "multiply"
    split_hot_keys: bool = False

    def __call__(self, df: DataFrame) -> DataFrame:
        lookup = df.sparkSession.table(self.lookup) if isinstance(self.lookup, str) else self.lookup
        return lookup_join(df, lookup, self.key, self.columns, self.on_duplicate, self.split_hot_keys)


@dataclass
class Enricher:
    """Named enrichments applied in the order they were added; itself a step."""

    sources: dict[str, Callable[[DataFrame], DataFrame]] = field(default_factory=dict)

    def add(self, name: str, source: Callable[[DataFrame], DataFrame]) -> Enricher:
        self.sources[name] = source
        return self

    def __call__(self, df: DataFrame) -> DataFrame:
        return reduce(lambda frame, source: frame.transform(source), self.sources.values(), df)
