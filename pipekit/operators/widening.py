"""Common schemas of a table and what is added to it, by a promotion lattice.

    tinyint < smallint < int < bigint < decimal(20,0) < double
    float < double
    decimal(p,s) < decimal with as many whole and as many fractional digits as either < double
    date < timestamp without zone < timestamp

A promotion keeps every value, but for the last steps to double, which round as any double does.  Everything else (text to
a number, a narrower type for a column that the table has wider) is refused; so nothing is ever cast to NULL.  Arrays, maps
and structs are common when their parts are; a struct may gain fields.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pipekit.functions import named

_WHOLE = [T.ByteType(), T.ShortType(), T.IntegerType(), T.LongType()]
#: Digits of the largest value of each whole type.
_DIGITS = {T.ByteType(): 3, T.ShortType(): 5, T.IntegerType(): 10, T.LongType(): 20}
_TIMES = [T.DateType(), T.TimestampNTZType(), T.TimestampType()]
MAX_DIGITS = 38


class NarrowingError(ValueError):
    """Two types without a common one above both."""


def _as_decimal(kind: T.DataType) -> T.DecimalType | None:
    if isinstance(kind, T.DecimalType):
        return kind
    return T.DecimalType(_DIGITS[kind], 0) if kind in _DIGITS else None


def common_type(left: T.DataType, right: T.DataType, column: str = "column") -> T.DataType:
    """The least type that both promote to."""
    if left == right:
        return left
    if isinstance(left, T.NullType):
        return right
    if isinstance(right, T.NullType):
        return left
    for ladder in (_WHOLE, _TIMES):
        if left in ladder and right in ladder:
            return max(left, right, key=ladder.index)
    pair = _as_decimal(left), _as_decimal(right)
    if None not in pair:
        scale = max(d.scale for d in pair)
        digits = max(d.precision - d.scale for d in pair) + scale
        return T.DecimalType(digits, scale) if digits <= MAX_DIGITS else T.DoubleType()
    floating = (T.FloatType, T.DoubleType)
    if isinstance(left, floating) or isinstance(right, floating):
        if all(isinstance(kind, floating) or _as_decimal(kind) for kind in (left, right)):
            return T.DoubleType()
    if isinstance(left, T.ArrayType) and isinstance(right, T.ArrayType):
        return T.ArrayType(common_type(left.elementType, right.elementType, f"{column}[]"))
    if isinstance(left, T.MapType) and isinstance(right, T.MapType):
        key = common_type(left.keyType, right.keyType, f"{column}.key")
        return T.MapType(key, common_type(left.valueType, right.valueType, f"{column}.value"))
    if isinstance(left, T.StructType) and isinstance(right, T.StructType):
        return common_schema(left, right, f"{column}.")
    raise NarrowingError(f"{column}: {left.simpleString()} and {right.simpleString()} have no common type that keeps their values")


def common_schema(table: T.StructType, change: T.StructType, prefix: str = "") -> T.StructType:
    """Columns of both by name, the table's first, each with the common type."""
    new = {f.name: f for f in change.fields}
    fields = []
    for field in table.fields:
        other = new.pop(field.name, None)
        kind = common_type(field.dataType, other.dataType, prefix + field.name) if other else field.dataType
        fields.append(T.StructField(field.name, kind))
    return T.StructType([*fields, *[T.StructField(f.name, f.dataType) for f in new.values()]])


def changed_columns(table: T.StructType, common: T.StructType) -> list[str]:
    """Columns of the table whose type the common schema widens."""
    plain = {f.name: f.dataType for f in common_schema(table, table).fields}
    return [f.name for f in common.fields if f.name in plain and plain[f.name] != f.dataType]


def fitted(df: DataFrame, schema: T.StructType) -> DataFrame:
    """The frame with a wider schema's columns, in its order; columns it lacks are NULL."""
    kinds = {f.name: f.dataType for f in df.schema.fields}

    def column(field: T.StructField) -> Column:
        if field.name not in kinds:
            return F.lit(None).cast(field.dataType).alias(field.name)
        return _cast(named(field.name), kinds[field.name], field.dataType).alias(field.name)

    return df.select(*[column(f) for f in schema.fields])


def _cast(value: Column, old: T.DataType, new: T.DataType) -> Column:
    """Struct fields are matched by name, which a plain cast does not do."""
    if isinstance(new, T.StructType):
        kinds = {f.name: f.dataType for f in old.fields}
        parts = [
            (_cast(value[f.name], kinds[f.name], f.dataType) if f.name in kinds else F.lit(None).cast(f.dataType)).alias(f.name)
            for f in new.fields
        ]
        return F.when(value.isNotNull(), F.struct(*parts))
    if isinstance(new, T.ArrayType):
        return F.transform(value, lambda x: _cast(x, old.elementType, new.elementType))
    if isinstance(new, T.MapType):
        keys = F.transform_keys(value, lambda k, _: _cast(k, old.keyType, new.keyType))
        return F.transform_values(keys, lambda _, v: _cast(v, old.valueType, new.valueType))
    return value.cast(new)


def append_widening(base: DataFrame, more: DataFrame) -> DataFrame:
    """Both row sets under their common schema."""
    schema = common_schema(base.schema, more.schema)
    return fitted(base, schema).unionByName(fitted(more, schema))
