"""Source-to-target type mapping."""

from __future__ import annotations

import re
from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Column type names of the two databases and the Spark types that hold them.
SOURCE_TYPES: dict[str, dict[str, str]] = {
    "oracle": {
        "binary_double": "double",
        "binary_float": "float",
        "blob": "binary",
        "char": "string",
        "clob": "string",
        "date": "timestamp",
        "float": "double",
        "integer": "decimal(38,0)",
        "nchar": "string",
        "nclob": "string",
        "number": "decimal(38,10)",
        "nvarchar2": "string",
        "raw": "binary",
        "timestamp": "timestamp",
        "varchar2": "string",
    },
    "sqlserver": {
        "bigint": "bigint",
        "binary": "binary",
        "bit": "boolean",
        "char": "string",
        "date": "date",
        "datetime": "timestamp",
        "datetime2": "timestamp",
        "decimal": "decimal(18,0)",
        "float": "double",
        "int": "int",
        "money": "decimal(19,4)",
        "nchar": "string",
        "numeric": "decimal(18,0)",
        "nvarchar": "string",
        "real": "float",
        "smallint": "smallint",
        "text": "string",
        "tinyint": "smallint",
        "uniqueidentifier": "string",
        "varbinary": "binary",
        "varchar": "string",
    },
}

_SIZED = re.compile(r"^\s*([a-z_0-9]+)\s*(?:\(\s*(\d+)\s*(?:,\s*(\d+)\s*)?[^)]*\))?.*$", re.IGNORECASE)


def spark_type(system: str, source_type: str) -> str:
    """Spark type for a declared column type such as ``NUMBER(10,2)`` or ``varchar(40)``."""
    match = _SIZED.match(source_type)
    base = match.group(1).lower() if match else source_type.lower()
    try:
        mapped = SOURCE_TYPES[system][base]
    except KeyError:
        raise ValueError(f"no Spark type known for {system} type {source_type!r}") from None
    if mapped.startswith("decimal") and base in {"number", "decimal", "numeric"} and match and match.group(2):
        return f"decimal({match.group(2)},{match.group(3) or 0})"
    return mapped


def mapped_types(system: str, declared: Mapping[str, str]) -> dict[str, str]:
    """Column name to Spark type, from column name to declared source type."""
    return {column: spark_type(system, source_type) for column, source_type in declared.items()}


def apply_types(df: DataFrame, mapping: Mapping[str, str], on_error: str = "fail") -> DataFrame:
    """Cast the mapped columns in place.

    ``on_error``: ``fail`` stops the job at a value that does not convert, ``null`` keeps NULL for it,
    ``flag`` also adds ``_bad_types``, the sorted names of the columns whose value did not convert.
    """
    if on_error not in {"fail", "null", "flag"}:
        raise ValueError(f"on_error must be fail, null or flag, not {on_error!r}")
    if on_error == "fail":
        return df.withColumns({column: F.col(column).cast(target) for column, target in mapping.items()})
    casts = {column: F.col(column).try_cast(target) for column, target in mapping.items()}
    if on_error == "flag":
        broken = [F.when(F.col(c).isNotNull() & casts[c].isNull(), F.lit(c)) for c in sorted(mapping)]
        casts["_bad_types"] = F.array_compact(F.array(*broken))
    return df.withColumns(casts)
