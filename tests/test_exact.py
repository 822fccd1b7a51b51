"""Sums that do not depend on partitioning, and the order-preserving bits of doubles."""

import itertools
import math
import random
import struct

import pytest
from pyspark.sql import functions as F

from pipekit.functions import added, counted, counted_if, exact_sums, greatest, least, merge_states, order_bits, rounded, sum_states
from pipekit.functions.exact import limbs

EDGES = [
    0.0, -0.0, 1.0, -1.0, 0.1, 1 / 3, 5e-324, -5e-324, 2.2250738585072014e-308, 2.225073858507201e-308, 1e-310, 1.7976931348623157e308,
    -1.7976931348623157e308, 2.0**1023, 2.0**-1022, 2.0**-1074, 1e16, 1e15 + 0.5, 9007199254740993.0, 1e300, -1e-300, 123456.789,
    math.nextafter(1.0, 0), math.nextafter(1.0, 2), math.nextafter(2.0, 0), math.nextafter(2.0**-1022, 0), math.nextafter(8.0, 0), 2.0**20, 2.0**52,
]


def expected(values):
    try:
        return math.fsum(values)
    except OverflowError:
        return None


def test_limbs_hold_every_double(spark):
    rng = random.Random(1)
    values = EDGES + [struct.unpack("<d", rng.randbytes(8))[0] for _ in range(3000)]
    values = [v for v in values if math.isfinite(v)]
    for row in spark.createDataFrame([(v,) for v in values], "v double").select("v", limbs("v").alias("x")).collect():
        x, parts = row.x, [row.x.d0, row.x.d1, row.x.d2, row.x.d3]
        whole = sum(d << (20 * i) for i, d in enumerate(parts))
        numerator, denominator = row.v.as_integer_ratio()
        shift = 20 * x.bin
        assert whole * 2 ** max(shift, 0) * denominator == numerator * 2 ** max(-shift, 0), row.v
        assert all(0 <= d < 1 << 20 for d in parts[:3]) and abs(parts[3]) <= 1 << 20


def test_single_values_come_back(spark):
    frame = spark.createDataFrame([(i, v) for i, v in enumerate(EDGES)], "i int, v double")
    for row in exact_sums(frame, ["i"], {"s": F.col("v")}).collect():
        assert row.s == EDGES[row.i], EDGES[row.i]


@pytest.mark.parametrize("seed", range(6))
def test_sum_is_the_nearest_double(spark, seed):
    rng = random.Random(seed)
    kinds = [
        lambda: rng.uniform(-1, 1),
        lambda: rng.uniform(0, 1e5),
        lambda: rng.choice([1e16, 1.0, -1e16, 1e-16, 0.1]),
        lambda: math.ldexp(rng.uniform(-1, 1), rng.randrange(-1070, 900)),
        lambda: rng.choice(EDGES[:11]),
        lambda: math.ldexp(1.0, rng.randrange(-60, 60)) * rng.choice([1, -1]),
    ]
    rows = [(g, kinds[seed]()) for g in range(40) for _ in range(rng.randrange(1, 60))]
    frame = spark.createDataFrame(rows, "g int, v double")
    for row in exact_sums(frame, ["g"], {"s": F.col("v")}).collect():
        assert row.s == expected([v for g, v in rows if g == row.g])


def test_ties_round_to_even_and_sticky_bits_count(spark):
    one, half = 2.0**53, 1.0
    cases = [[one, half], [one, half, 5e-324], [one + 2, half], [one + 2, half, -5e-324], [-one, -half, -5e-324], [1e308, 1e308, -1e308], [one, -one]]
    frame = spark.createDataFrame([(i, v) for i, values in enumerate(cases) for v in values], "i int, v double")
    got = {r.i: r.s for r in exact_sums(frame, ["i"], {"s": F.col("v")}).collect()}
    for i, values in enumerate(cases):
        assert got[i] == (1e308 if values[0] == 1e308 else math.fsum(values)), values


def test_order_of_rows_and_partitions_changes_nothing(spark):
    rng = random.Random(2)
    values = [rng.uniform(-1e9, 1e9) * 10.0 ** rng.randrange(-20, 20) for _ in range(20_000)]
    frame = spark.createDataFrame([(i % 3, v) for i, v in enumerate(values)], "g int, v double")
    bits = set()
    for parts in (1, 3, 7, 16):
        shuffled = frame.orderBy(F.rand(parts)).repartition(parts)
        found = exact_sums(shuffled, ["g"], {"s": F.col("v")}).orderBy("g").collect()
        bits.add(b"".join(struct.pack("<d", r.s) for r in found))
    assert bits == {b"".join(struct.pack("<d", math.fsum(values[g::3])) for g in range(3))}


def test_special_values(spark):
    inf, nan = float("inf"), float("nan")
    huge = [1.7976931348623157e308] * 3  # the exact sum is beyond the largest double
    cases = [[None, None], [None, 2.5], [inf, 1.0], [-inf, 1e308], [inf, -inf], [nan, inf, 1.0], huge]
    frame = spark.createDataFrame([(i, v) for i, values in enumerate(cases) for v in values], "i int, v double")
    got = [r.s for r in exact_sums(frame, ["i"], {"s": F.col("v")}).orderBy("i").collect()]
    assert got[:4] == [None, 2.5, inf, -inf] and math.isnan(got[4]) and math.isnan(got[5]) and got[6] == inf


def test_several_sums_and_merging(spark):
    rng = random.Random(3)
    rows = [(g, o, rng.uniform(0, 1e6), rng.choice([None, rng.uniform(0, 1e-6)])) for g in range(3) for o in range(20) for _ in range(5)]
    frame = spark.createDataFrame(rows, "g int, o int, v double, w double")
    others = {"n": counted(), "few": counted_if(F.col("v") < 1e5), "low": least(F.col("v")), "high": greatest(F.col("v"))}
    for row in exact_sums(frame, ["g"], {"v": F.col("v"), "w": F.col("w")}, others).collect():
        mine = [r for r in rows if r[0] == row.g]
        assert row.v == math.fsum(r[2] for r in mine) and row.w == math.fsum(r[3] for r in mine if r[3] is not None)
        assert (row.n, row.few) == (100, sum(r[2] < 1e5 for r in mine))
        assert (row.low, row.high) == (min(r[2] for r in mine), max(r[2] for r in mine))
    per_order = sum_states(frame, ["g", "o"], {"v": F.col("v")}, {"lines": counted()})
    merged = merge_states(per_order, ["g"], "v", {"orders": counted(), "lines": added(F.col("lines"))})
    for row in merged.withColumn("v", rounded("v")).collect():
        assert (row.orders, row.lines, row.v) == (20, 100, math.fsum(r[2] for r in rows if r[0] == row.g))


def test_bits_order_as_values_do(spark):
    rng = random.Random(4)
    values = EDGES + [float("inf"), float("-inf")] + [struct.unpack("<d", rng.randbytes(8))[0] for _ in range(3000)]
    values = [v for v in values if not math.isnan(v)] + [math.nextafter(2.0**e, d) for e, d in itertools.product(range(-1022, 1023, 31), (0, 1e308))]
    frame = spark.createDataFrame([(v,) for v in values], "v double").select("v", order_bits("v").alias("b"))
    for row in frame.collect():
        bits = struct.unpack("<q", struct.pack("<d", abs(row.v)))[0]
        assert row.b == (-bits if row.v < 0 else bits), row.v
