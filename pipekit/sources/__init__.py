"""Scans: parquet tables, JDBC databases, paged entity exports, typed projections."""

from pipekit.sources.jdbc import JdbcSource, oracle_url, range_predicates, sqlserver_url
from pipekit.sources.paged import ENTITY_SCHEMA, PagedEntitySource, explode_pages, read_pages
from pipekit.sources.tables import TableSource, first_row, parameterized, read_table, since
from pipekit.sources.types import apply_types, mapped_types, spark_type

__all__ = [
    "ENTITY_SCHEMA",
    "JdbcSource",
    "PagedEntitySource",
    "TableSource",
    "apply_types",
    "explode_pages",
    "first_row",
    "mapped_types",
    "oracle_url",
    "parameterized",
    "range_predicates",
    "read_pages",
    "read_table",
    "since",
    "spark_type",
    "sqlserver_url",
]
