"""Z-order key: per-column bucket numbers with their bits interleaved."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def bucket_of(value: Column, cuts: Sequence[float]) -> Column:
    """Number of cut points at or below the value, 0 for NULL.  ``cuts`` is an ascending list.

    A balanced CASE tree: log2(cuts) comparisons per row, all inside generated code.
    """
    if len(cuts) > 255:
        raise ValueError("at most 255 cut points; the expression grows with them")

    def pick(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        middle = (low + high) // 2
        return F.when(value < F.lit(cuts[middle]), pick(low, middle)).otherwise(pick(middle + 1, high))

    return F.when(value.isNull(), F.lit(0)).otherwise(pick(0, len(cuts)))


def rank_bucket(value: Column, cuts: Column, bits: int) -> Column:
    """Number of cut points at or below the value, 0 for NULL: a binary search in the ascending array ``cuts`` of at most
    ``2**bits - 1`` points of the value's own type.  ``bits`` comparisons a row, for any number of cuts."""

    def step(found: Column, weight: Column) -> Column:
        # Past the end there is no point: the comparison is NULL, and the search goes on below.
        return F.when(F.get(cuts, found + weight - 1) <= value, found + weight).otherwise(found)

    return F.aggregate(F.array(*[F.lit(1 << b) for b in range(bits - 1, -1, -1)]), F.lit(0), step)


def interleave_bits(buckets: Sequence[Column], bits: int) -> Column:
    """Morton code: bit i of column c goes to position i * len(buckets) + c."""
    width = len(buckets)
    if width * bits > 62:
        raise ValueError("the interleaved key does not fit in a bigint")
    code = F.lit(0).cast("bigint")
    for bit in range(bits):
        for offset, bucket in enumerate(buckets):
            picked = F.getbit(bucket.cast("bigint"), F.lit(bit)).cast("bigint")
            code = code.bitwiseOR(F.shiftleft(picked, bit * width + offset))
    return code
