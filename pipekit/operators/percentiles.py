"""Exact percentiles per group by radix selection: no group, and no part of one, is ever ranked together."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pipekit.functions import order_bits
from pipekit.session import cut_lineage

DIGIT_BITS = 16
PASSES = 64 // DIGIT_BITS


def _join(left: DataFrame, right: DataFrame, columns: Sequence[str], how: str) -> DataFrame:
    """Joins on equal columns; NULL is a group of its own.  The right side's columns of that name are dropped."""
    renamed = right.withColumnsRenamed({c: f"_r{i}" for i, c in enumerate(columns)})
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_r{i}")) for i, c in enumerate(columns)])
    joined = left.join(renamed, same, how)
    return joined.drop(*[f"_r{i}" for i in range(len(columns))])


def _histogram(rows: DataFrame, keys: Sequence[str], done: int) -> DataFrame:
    """Per group and leading digits (``_prefix``) the next digit's counts, in order.

    Equal digits are counted per task before the shuffle; a histogram has at most 65,536 entries."""
    shift = 64 - DIGIT_BITS * (done + 1)
    digit = F.shiftright("_bits", shift)
    if done:
        prefix = F.shiftright("_bits", shift + DIGIT_BITS)
        digit = digit.bitwiseAND((1 << DIGIT_BITS) - 1)
    else:
        prefix = F.lit(0).cast("bigint")  # the first digit has the sign
    counted = rows.groupBy(*keys, prefix.alias("_prefix"), digit.alias("_digit")).agg(
        F.sum("_c").alias("_c"), F.max("_v").alias("_v")
    )
    entries = F.sort_array(F.collect_list(F.struct("_digit", "_c", "_v")))
    return counted.groupBy(*keys, "_prefix").agg(entries.alias("_entries"))


#: The entry that holds ``_rank``: struct of its digit, the rank within it and its largest value.
_FOUND = """
aggregate(_entries, named_struct('digit', CAST(NULL AS BIGINT), 'rest', _rank, 'value', CAST(NULL AS DOUBLE)), (done, entry) ->
    CASE WHEN done.digit IS NOT NULL THEN done
         WHEN done.rest < entry._c THEN named_struct('digit', entry._digit, 'rest', done.rest, 'value', entry._v)
         ELSE named_struct('digit', done.digit, 'rest', done.rest - entry._c, 'value', done.value) END)
"""


def exact_percentiles(df: DataFrame, keys: Sequence[str], value: str, percentiles: Mapping[str, float]) -> DataFrame:
    """Linearly interpolated percentiles of ``value`` per group, with the group's number of values.

    A value's bits order as it does.  Each of four passes counts the values by their next 16 bits, among those that share
    the bits found so far with a wanted rank, and descends into the entry that holds the rank.  The first pass reads every
    row; what shares its 16 bits with a rank (within one sixteenth of a power of two) is kept, equal values as one row with
    their number, and read by the other three.  Groups of any size take the same way.  NaN counts as missing, and a
    group without values has no row.
    """
    if not keys:
        raise ValueError("give at least one key; a constant column makes the whole frame one group")
    keys, names = list(keys), list(percentiles)
    number = F.col(value).cast("double")
    numbers = df.select(*keys, number.alias("_v")).filter("_v IS NOT NULL AND NOT isnan(_v)")
    numbers = numbers.select(*keys, "_v", order_bits("_v").alias("_bits"), F.lit(1).cast("bigint").alias("_c"))

    place = [*keys, "_prefix"]

    def descend(looking: DataFrame, done: int) -> DataFrame:
        found = looking.withColumn("_f", F.expr(_FOUND))
        prefix = F.shiftleft("_prefix", DIGIT_BITS) + F.col("_f.digit") if done else F.col("_f.digit")
        columns = [prefix.alias("_prefix"), F.col("_f.rest").alias("_rank"), F.col("_f.value").alias("_value")]
        return found.select(*keys, "_n", "_i", *columns)

    # Two ranks per percentile: those of the values beside its position.
    size = F.expr("aggregate(_entries, 0L, (n, entry) -> n + entry._c)")
    sized = _histogram(numbers, keys, 0).withColumn("_n", size)
    positions = [F.lit(float(percentiles[name])) * (F.col("_n") - 1) for name in names]
    ranks = [step(at).cast("bigint") for at in positions for step in (F.floor, F.ceil)]
    targets = cut_lineage(descend(sized.select("*", F.posexplode(F.array(*ranks)).alias("_i", "_rank")), 0))

    near = _join(numbers.withColumn("_prefix", F.shiftright("_bits", 64 - DIGIT_BITS)), targets, place, "left_semi")
    near = cut_lineage(near.groupBy(*keys, "_bits").agg(F.sum("_c").alias("_c"), F.max("_v").alias("_v")))
    for done in range(1, PASSES):
        wanted = near.withColumn("_prefix", F.shiftright("_bits", 64 - DIGIT_BITS * done))
        histogram = _histogram(_join(wanted, targets, place, "left_semi"), keys, done)
        targets = cut_lineage(descend(_join(targets.drop("_value"), histogram, place, "inner"), done))

    values = [F.max(F.when(F.col("_i") == i, F.col("_value"))).alias(f"_at_{i}") for i in range(2 * len(names))]
    grouped = targets.groupBy(*keys).agg(F.max("_n").alias("n"), *values)
    results = []
    for j, name in enumerate(names):
        at = F.lit(float(percentiles[name])) * (F.col("n") - 1)
        low, high = F.col(f"_at_{2 * j}"), F.col(f"_at_{2 * j + 1}")
        results.append(F.when(low == high, low).otherwise(low + (high - low) * (at - F.floor(at))).alias(name))
    return grouped.select(*keys, "n", *results)
