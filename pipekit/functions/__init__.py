"""Column helpers; every one is a composition of built-in functions and stays inside codegen."""

from pipekit.functions.exact import (
    added,
    counted,
    counted_if,
    exact_sums,
    greatest,
    least,
    limbs,
    merge_states,
    order_bits,
    rate,
    rounded,
    sum_states,
)
from pipekit.functions.predicates import any_fails, failed_names, fails, holds, named
from pipekit.functions.zorder import bucket_of, interleave_bits, rank_bucket

__all__ = [
    "added",
    "any_fails",
    "bucket_of",
    "counted",
    "counted_if",
    "exact_sums",
    "failed_names",
    "fails",
    "greatest",
    "holds",
    "interleave_bits",
    "least",
    "limbs",
    "merge_states",
    "named",
    "order_bits",
    "rank_bucket",
    "rate",
    "rounded",
    "sum_states",
]
