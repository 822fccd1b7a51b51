"""Sums of doubles that do not depend on how rows were spread, and the order-preserving bits of a double.

Floating addition is not associative, so a plain sum changes in its last digits with the number of partitions, and with
a task that is run again.  Here each value is split, without error, into four integer *limbs* of 20 bits at a place that
its exponent gives (its *bin*).  Limbs of one bin are added as integers, which is exact in any order; a group has one
row per bin (there are 106, and values of like size share one or two), and its limbs are rounded to a double once, at the end.
The result is the double nearest to the exact sum.  A group may hold about 10**12 rows; beyond, Spark stops at the
integer overflow rather than return a wrong sum.

NULL values count as missing; the sum of none is NULL.  A NaN, or infinities of both signs, give NaN.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS = 20
MASK = (1 << BITS) - 1
LIMBS = ("d0", "d1", "d2", "d3")
#: Bins of finite doubles, from the smallest to the largest exponent, and the one that counts NaN and infinities.
LOWEST, HIGHEST, SPECIAL = -57, 48, 1000


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def _moved(value: str, places: str) -> str:
    """``value * 2**(20 * places)``, exact where a double can hold it.  Powers of two are exact; the way is made in two
    halves, since the power itself may be out of range."""
    half = f"pow(2D, ({places}) * {BITS // 2})"
    return f"({value}) * {half} * {half}"


def _let(name: str, value: str, body: str) -> str:
    """``body``, where ``name`` stands for a value that is computed once."""
    return f"transform(array({value}), {name} -> {body})[0]"


def limbs(column: str) -> Column:
    """struct<bin, d0, d1, d2, d3> of a double column: its value is the sum of ``d[i] * 2**(20 * (bin + i))``.

    As SQL text, since building such an expression from parts takes longer than running it on small tables."""
    v = _quoted(column)
    special = f"(isnan({v}) OR abs({v}) = double('Infinity'))"
    # The logarithm may be off by one; four limbs have room for that.
    exponent = f"floor(log2(CASE WHEN NOT {special} AND {v} <> 0D THEN abs({v}) ELSE 1D END))"
    place = f"CAST(floor(({exponent} - 53) / {BITS}) AS INT)"
    scaled = f"(CASE WHEN {special} THEN 0D ELSE {_moved(v, f'-{place}')} END)"
    high = f"floor({scaled} / {2.0 ** (2 * BITS)!r}D)"  # a bigint, as the rest is
    low = f"floor({scaled} - CAST({high} AS DOUBLE) * {2.0 ** (2 * BITS)!r}D)"

    def part(finite: str, marks: str, name: str) -> str:
        return f"CAST(CASE WHEN {special} THEN CASE WHEN {marks} THEN 1 ELSE 0 END ELSE {finite} END AS BIGINT) AS {name}"

    parts = [
        f"CASE WHEN {special} THEN {SPECIAL} ELSE {place} END AS bin",
        part(f"{low} & {MASK}L", f"isnan({v})", "d0"),
        part(f"shiftright({low}, {BITS})", f"{v} = double('Infinity')", "d1"),
        part(f"{high} & {MASK}L", f"{v} = double('-Infinity')", "d2"),
        part(f"shiftright({high}, {BITS})", "false", "d3"),
    ]
    return F.expr(f"CASE WHEN {v} IS NOT NULL THEN struct({', '.join(parts)}) END")


def _carried(sums: str) -> str:
    """Digits of 20 bits, the lowest first, and what is left over: below 0 for a negative total."""
    total = "done.carry + limb"
    step = f"named_struct('carry', shiftright({total}, {BITS}), 'digits', concat(done.digits, array(({total}) & {MASK}L)))"
    return f"aggregate({sums}, named_struct('carry', 0L, 'digits', CAST(array() AS ARRAY<BIGINT>)), (done, limb) -> {step})"


def _magnitude(digits: str) -> str:
    """Four leading digits hold more than 60 bits: the last of them need only know whether anything follows."""
    a, b, c, d = (f"coalesce(get({digits}, top - {i}), 0L)" for i in range(4))
    rest = f"exists(slice({digits}, 1, greatest(top - 3, 0)), x -> x <> 0)"
    high = f"CAST({a} * {1 << BITS} + {b} AS DOUBLE) * {2.0 ** (2 * BITS)!r}D"
    low = f"CAST(({c} * {1 << BITS} + {d}) | CASE WHEN {rest} THEN 1L ELSE 0L END AS DOUBLE)"
    nearest = _moved(f"{high} + {low}", "lowest + top - 3")  # one addition: rounded once
    top = f"array_max(transform({digits}, (x, i) -> CASE WHEN x <> 0 THEN i END))"
    return _let("top", top, f"CASE WHEN top IS NULL THEN 0D ELSE {nearest} END")


def rounded(column: str) -> Column:
    """The double nearest to the total of an array of limbs; NULL if it is empty."""
    state = _quoted(column)
    negative = _let("minus", _carried("transform(sums, x -> -x)"), f"-{_magnitude('minus.digits')}")
    signed = f"CASE WHEN plus.carry < 0 THEN {negative} ELSE {_magnitude('plus.digits')} END"
    limb = " ".join(f"WHEN {i} THEN part.{name}" for i, name in enumerate(LIMBS))
    at = f"aggregate(parts, 0L, (total, part) -> total + CASE place - part.bin {limb} ELSE 0L END)"
    # The carry of a limb needs three more digits.
    sums = f"transform(sequence(lowest, array_max(transform(parts, x -> x.bin)) + 7), place -> {at})"
    total = _let("sums", sums, _let("plus", _carried("sums"), signed))
    finite = _let("parts", f"filter({state}, x -> x.bin <> {SPECIAL})", _let("lowest", "array_min(transform(parts, x -> x.bin))", total))
    nan, plus, minus = (f"exists({state}, x -> x.bin = {SPECIAL} AND x.{d} > 0)" for d in LIMBS[:3])
    return F.expr(
        f"CASE WHEN size({state}) <= 0 THEN NULL WHEN {nan} OR ({plus} AND {minus}) THEN double('NaN') "
        f"WHEN {plus} THEN double('Infinity') WHEN {minus} THEN double('-Infinity') ELSE {finite} END"
    )


@dataclass(frozen=True)
class Merged:
    """An aggregate in two steps: over rows, then over the first step's results."""

    value: Column
    first: Callable[[Column], Column]
    then: Callable[[Column], Column]


def counted(value: Column | None = None) -> Merged:
    """Rows, or rows with a value."""
    return Merged(F.lit(1) if value is None else value, F.count, F.sum)


def counted_if(condition: Column) -> Merged:
    return counted(F.when(condition, 1))


def added(value: Column) -> Merged:
    """Sum of integers."""
    return Merged(value, F.sum, F.sum)


def least(value: Column) -> Merged:
    return Merged(value, F.min, F.min)


def greatest(value: Column) -> Merged:
    return Merged(value, F.max, F.max)


def _columns(keys: Sequence[str | Column]) -> list[Column]:
    return [F.col(f"`{key}`") if isinstance(key, str) else key for key in keys]


def sum_states(
    df: DataFrame, keys: Sequence[str | Column], sums: Mapping[str, Column], others: Mapping[str, Merged] | None = None
) -> DataFrame:
    """One row per group: for each sum the array of its limbs, to be merged further or ``rounded``, and ``others``.

    Rows are combined per task and bin before the shuffle; only limbs travel."""
    others = others or {}
    doubles = df.withColumns({f"_value_{i}": value.cast("double") for i, value in enumerate(sums.values())})
    split = doubles.withColumns({f"_limbs_{i}": limbs(f"_value_{i}") for i in range(len(sums))})
    bins = [F.col(f"_limbs_{i}.bin").alias(f"_bin_{i}") for i in range(len(sums))]
    totals = [F.sum(f"_limbs_{i}.{d}").alias(f"_{d}_{i}") for i in range(len(sums)) for d in LIMBS]
    firsts = [m.first(m.value).alias(f"_other_{j}") for j, m in enumerate(others.values())]
    per_bin = split.groupBy(*_columns(keys), *bins).agg(*totals, *firsts)
    names = per_bin.columns[: len(keys)]

    def state(i: int) -> Column:
        # With several sums a bin of one meets several of another; ``rounded`` adds limbs of equal bins.
        limb = F.struct(F.col(f"_bin_{i}").alias("bin"), *[F.col(f"_{d}_{i}").alias(d) for d in LIMBS])
        return F.collect_list(F.when(F.col(f"_bin_{i}").isNotNull(), limb))

    states = [state(i).alias(name) for i, name in enumerate(sums)]
    lasts = [m.then(F.col(f"_other_{j}")).alias(name) for j, (name, m) in enumerate(others.items())]
    return per_bin.groupBy(*_columns(names)).agg(*states, *lasts)


def merge_states(
    df: DataFrame, keys: Sequence[str | Column], state: str, others: Mapping[str, Merged] | None = None
) -> DataFrame:
    """Sums of larger groups from the limb arrays of smaller ones; ``others`` count each row of ``df`` once."""
    others = others or {}
    parts = df.select("*", F.posexplode_outer(state).alias("_at", "_limb"))
    once = F.coalesce(F.col("_at"), F.lit(0)) == 0
    totals = [F.sum(f"_limb.{d}").alias(f"_{d}") for d in LIMBS]
    firsts = [m.first(F.when(once, m.value)).alias(f"_other_{j}") for j, m in enumerate(others.values())]
    per_bin = parts.groupBy(*_columns(keys), F.col("_limb.bin").alias("_bin")).agg(*totals, *firsts)
    names = per_bin.columns[: len(keys)]
    limb = F.struct(F.col("_bin").alias("bin"), *[F.col(f"_{d}").alias(d) for d in LIMBS])
    merged = F.collect_list(F.when(F.col("_bin").isNotNull(), limb)).alias(state)
    lasts = [m.then(F.col(f"_other_{j}")).alias(name) for j, (name, m) in enumerate(others.items())]
    return per_bin.groupBy(*_columns(names)).agg(merged, *lasts)


def exact_sums(
    df: DataFrame, keys: Sequence[str | Column], sums: Mapping[str, Column], others: Mapping[str, Merged] | None = None
) -> DataFrame:
    """One row per group: the keys, each sum as the double nearest to its exact value, and ``others``."""
    states = sum_states(df, keys, sums, others)
    return states.withColumns({name: rounded(name) for name in sums})


def order_bits(column: str) -> Column:
    """A bigint that orders as the double column does (NaN apart): its sign times the bits of its magnitude.  Zeros are
    equal."""
    size = f"abs({_quoted(column)})"
    rough = f"floor(log2(CASE WHEN {size} > 0D AND {size} < double('Infinity') THEN {size} ELSE 1D END))"
    exponent = f"greatest({rough}, -1022L)"
    half = f"floor({exponent} / 2)"
    # Two multiplications by half the exponent each, since 2**1074 is no double.
    unit = f"({size} * pow(2D, -{half}) * pow(2D, {half} - {exponent}))"
    # The logarithm may be off by one: the unit is brought into [1, 2), or is below 1 for a subnormal.
    small, large = f"({unit} < 1D AND {exponent} > -1022)", f"{unit} >= 2D"
    shifted = f"(CASE WHEN {small} THEN {unit} * 2D WHEN {large} THEN {unit} / 2D ELSE {unit} END)"
    power = f"(CASE WHEN {small} THEN {exponent} - 1 WHEN {large} THEN {exponent} + 1 ELSE {exponent} END)"
    digits = f"floor({shifted} * {2.0**52!r}D)"  # the leading bit adds one to a normal number's exponent
    finite = f"CASE WHEN {shifted} < 1D THEN {digits} ELSE ({power} + 1022) * {1 << 52}L + {digits} END"
    bits = f"CASE WHEN {size} = 0D THEN 0L WHEN {size} = double('Infinity') THEN {0x7FF << 52}L ELSE {finite} END"
    return F.expr(f"CAST(CASE WHEN {_quoted(column)} < 0D THEN -({bits}) ELSE {bits} END AS BIGINT)")


def rate(part: Column, whole: Column) -> Column:
    """``part / whole`` as a fraction, 0.0 for an empty whole."""
    return F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")), F.lit(0.0))
