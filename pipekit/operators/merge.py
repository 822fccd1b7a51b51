"""Upsert and change apply on plain frames, planned as joins.

The target is left-joined with the changes, and changes without a partner are appended.  That form
(rather than one full outer join) lets Spark broadcast a small change set, so the target is not shuffled
at all; with a large one both sides shuffle on the key and AQE may split an oversized target partition,
which it cannot do for a full outer join.  Changes with a NULL key match nothing and skip the joins.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pipekit.functions import holds, named
from pipekit.operators.latest import latest_per_key, unique_or_fail

NEWER = "source._timestamp > target._timestamp"
ALWAYS = "true"
ACTIONS = ("updated", "inserted", "deleted", "unchanged")


@dataclass(frozen=True)
class MergeRule:
    """How changes meet a target.

    ``update_condition`` and ``delete_condition`` are SQL over ``source.`` and ``target.`` columns; a NULL
    verdict means no.  ``insert_condition`` is SQL over the change's own columns.  With ``order_by`` the
    newest of several changes to a key wins (descending, later columns break ties); without it several
    changes to one key stop the job.  ``ignore`` names change columns that are not part of the table;
    any other extra column needs ``evolve``.
    """

    keys: Sequence[str]
    update_condition: str = NEWER
    order_by: Sequence[str] = ()
    delete_condition: str | None = None
    insert_condition: str | None = None
    evolve: bool = False
    ignore: Sequence[str] = ()


def _all_keys_present(keys: Sequence[str]) -> Column:
    return reduce(lambda left, right: left & right, [named(key).isNotNull() for key in keys])


def _of(side: str, column: str) -> Column:
    return F.col(f"{side}.`{column.replace('`', '``')}`")


def _check_columns(target: DataFrame, source: DataFrame, rule: MergeRule) -> list[str]:
    extra = [c for c in source.columns if c not in target.columns and c not in rule.ignore]
    missing = [c for c in target.columns if c not in source.columns]
    if not rule.evolve and (extra or missing):
        raise ValueError(f"columns differ: only in source {extra}, only in target {missing}; set evolve to allow")
    lost = [key for key in rule.keys if key not in target.columns or key not in source.columns]
    if lost:
        raise ValueError(f"merge keys missing: {lost}")
    return extra


def one_change_per_key(keyed: DataFrame, rule: MergeRule) -> DataFrame:
    """The change that counts for each key; every key column has a value here."""
    if rule.order_by:
        return latest_per_key(keyed, rule.keys, rule.order_by)
    return unique_or_fail(keyed, rule.keys, f"several changes for one key {list(rule.keys)}; give order_by")


def reduced_changes(source: DataFrame, rule: MergeRule) -> DataFrame:
    """The changes that count: one per key, and all with a NULL key.  A merge reads its changes several times, so
    callers write this first."""
    present = _all_keys_present(rule.keys)
    single = one_change_per_key(source.filter(present), rule).select(*map(named, source.columns))
    return single.unionByName(source.filter(~present))


def merge_plan(target: DataFrame, source: DataFrame, rule: MergeRule, reduced: bool = False) -> DataFrame:
    """Every row of the merged table, and every deleted one, with its ``_action``.  ``reduced`` changes have one row
    per key already."""
    extra = _check_columns(target, source, rule)
    target_types = {f.name: f.dataType for f in target.schema.fields}
    source_types = {f.name: f.dataType for f in source.schema.fields}
    columns = [*target.columns, *extra]
    keys = list(rule.keys)
    keyed = source.filter(_all_keys_present(keys))
    changes = keyed if reduced else one_change_per_key(keyed, rule)
    marked = changes.withColumn("_change", F.lit(True)).alias("source")
    same_key = reduce(lambda left, right: left & right, [_of("target", k) == _of("source", k) for k in keys])
    paired = target.alias("target").join(marked, same_key, "left")
    matched = _of("source", "_change").isNotNull()
    action = F.when(matched & holds(rule.update_condition), F.lit("updated")).otherwise(F.lit("unchanged"))
    if rule.delete_condition:
        action = F.when(matched & holds(rule.delete_condition), F.lit("deleted")).otherwise(action)
    paired = paired.withColumn("_action", action)
    take = F.col("_action") == "updated"

    def kept(column: str) -> Column:
        if column in extra:
            return F.when(take, _of("source", column)).alias(column)
        if column not in source_types:
            return _of("target", column).alias(column)
        new = _of("source", column).cast(target_types[column])
        return F.when(take, new).otherwise(_of("target", column)).alias(column)

    merged = paired.select(*[kept(column) for column in columns], "_action")

    # Keys of the target that a change refers to.  Both key lists are made distinct with partial results per
    # task, so a hot key is one row each, and only keys are read.  Newest-per-key runs on what is left.
    wanted = keyed.select(*keys) if reduced else keyed.select(*keys).distinct()
    present = target.select(*keys).join(wanted, on=keys, how="left_semi").distinct()
    unmatched = keyed.join(present, on=keys, how="left_anti").select(*map(named, source.columns))
    single = unmatched if reduced else one_change_per_key(unmatched, rule)
    new_rows = single.unionByName(source.filter(~_all_keys_present(keys)))
    if rule.insert_condition:
        new_rows = new_rows.filter(holds(rule.insert_condition))

    def inserted(column: str) -> Column:
        if column in extra:
            return named(column)
        if column not in source_types:
            return F.lit(None).cast(target_types[column]).alias(column)
        return named(column).cast(target_types[column]).alias(column)

    added = new_rows.select(*[inserted(column) for column in columns], F.lit("inserted").alias("_action"))
    return merged.unionByName(added)


def merged_rows(plan: DataFrame) -> DataFrame:
    """The table after the merge."""
    return plan.filter(F.col("_action") != "deleted").drop("_action")


def action_counts() -> list[Column]:
    return [F.count_if(F.col("_action") == action).alias(f"rows_{action}") for action in ACTIONS]


#: While a merge is counted: shuffles start with this many partitions, however few the session has, which AQE joins again up to the size given, so that what a
#: task of the joins sorts does not follow the table.  Settings that the session has itself hold.
COUNTING = {
    "spark.sql.adaptive.coalescePartitions.initialPartitionNum": "200",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16m",
}


def merge_stats(plan: DataFrame) -> DataFrame:
    """One row: ``rows_updated, rows_inserted, rows_deleted, rows_unchanged``, counted at once."""
    spark, counts = plan.sparkSession, plan.agg(*action_counts())
    ours = {key: value for key, value in COUNTING.items() if spark.conf.get(key, None) is None}
    for key, value in ours.items():
        spark.conf.set(key, value)
    try:
        row = counts.first()
    finally:
        for key in ours:
            spark.conf.unset(key)
    return spark.createDataFrame([tuple(row)], counts.schema)


def upsert(target: DataFrame, source: DataFrame, rule: MergeRule) -> DataFrame:
    return merged_rows(merge_plan(target, source, rule))


def append_evolving(base: DataFrame, more: DataFrame) -> DataFrame:
    """Both row sets by column name; a column that one side lacks is NULL there."""
    return base.unionByName(more, allowMissingColumns=True)
