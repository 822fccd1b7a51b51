"""Write, audit, publish on plain parquet tables.

A table is an external table whose location names one finished version.  A change writes a new version
next to it, audits those very files, and then moves the location: readers see the old version or the new
one, and a failed audit leaves the old one in place.  The partitions of a partitioned table move one by one; the
table is never absent.  A merge writes its changes, one per key, before it uses them, so its source is read once.
Concurrent writers of one table are not coordinated; run one at a time.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from dataclasses import dataclass
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pipekit.functions import named
from pipekit.operators.layout import file_row, zorder_cluster
from pipekit.operators.merge import ACTIONS, MergeRule, action_counts, merge_plan, reduced_changes
from pipekit.operators.widening import changed_columns, common_schema, fitted
from pipekit.session import cut_lineage

NULL_FOLDER = "__HIVE_DEFAULT_PARTITION__"


@dataclass(frozen=True)
class MergeStats:
    rows_updated: int
    rows_inserted: int
    rows_deleted: int
    rows_unchanged: int


@dataclass(frozen=True)
class TableStore:
    """``root`` holds the versions: a folder that the whole cluster reaches (default: the warehouse, which a cluster
    session must name)."""

    spark: SparkSession
    root: str | None = None

    def version_path(self, name: str) -> str:
        local = self.spark.sparkContext.master.startswith("local")
        if not self.root and not local and not self.spark.sparkContext.getConf().contains("spark.sql.warehouse.dir"):
            raise RuntimeError("give root, or set spark.sql.warehouse.dir to a folder that all executors share")
        root = (self.root or self.spark.conf.get("spark.sql.warehouse.dir")).rstrip("/")
        return f"{root}/{name.replace('.', '/')}/v-{uuid.uuid4().hex}"

    def stage(self, df: DataFrame, name: str, partition_by: Sequence[str] = ()) -> str:
        """Writes the frame as an unpublished version; returns its path.  A published table's own partition
        columns hold; others are refused."""
        partition_by = self._layout(name, partition_by)
        path = self.version_path(name)
        rows = df.hint("rebalance", *partition_by) if partition_by else df
        writer = rows.write.mode("errorifexists")
        (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
        return path

    def _layout(self, name: str, partition_by: Sequence[str] = ()) -> list[str]:
        """The partition columns of a version: the table's, if there is one."""
        if not self.spark.catalog.tableExists(name):
            return list(partition_by)
        own = [c.name for c in self.spark.catalog.listColumns(name) if c.isPartition]
        if partition_by and list(partition_by) != own:
            raise ValueError(f"{name} is partitioned by {own}, not by {list(partition_by)}")
        return own

    def read_stage(self, path: str, schema: T.StructType) -> DataFrame:
        return self.spark.read.schema(schema).parquet(path)

    def publish(self, name: str, path: str, schema: T.StructType, partition_by: Sequence[str] = ()) -> None:
        """Makes a finished version the table.  Only metadata changes.  An unpartitioned table moves in one step, the
        partitions of a partitioned one one by one.  Columns added at the end are added to the table's entry; any other
        change of columns needs a new entry, and the table is absent for a moment."""
        spark = self.spark
        known = spark.catalog.tableExists(name)
        partition_by = self._layout(name, partition_by)
        if known and spark.catalog.getTable(name).tableType != "EXTERNAL":
            raise ValueError(f"{name} is not an external table; publishing would drop its files")
        if known and _extends(_ordered(spark.table(name).schema, partition_by), _ordered(schema, partition_by)):
            self._add_columns(name, schema)
            if partition_by:
                self._move_partitions(name, path, partition_by, self._partitions(name, partition_by))
            else:
                spark.sql(f"ALTER TABLE {name} SET LOCATION '{path}'")
        else:
            # The table is external: dropping its entry leaves the files of every version alone.
            spark.sql(f"DROP TABLE IF EXISTS {name}")
            columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
            layout = f"PARTITIONED BY ({', '.join(f'`{c}`' for c in partition_by)})" if partition_by else ""
            spark.sql(f"CREATE TABLE {name} ({columns}) USING parquet {layout} LOCATION '{path}'")
            if partition_by:
                spark.sql(f"MSCK REPAIR TABLE {name}")
        spark.catalog.refreshTable(name)

    def _partitions(self, name: str, partition_by: Sequence[str]) -> set[tuple[str | None, ...]]:
        """Values of the partitions that the catalog knows."""
        rows = self.spark.sql(f"SHOW PARTITIONS {name}").collect()
        return {_values(row[0]) for row in rows}

    def _move_partitions(
        self, name: str, path: str, partition_by: Sequence[str], replaced: set[tuple[str | None, ...]]
    ) -> None:
        """Points partitions to a version's folders: new ones are added at once, known ones move one by one, and those
        of ``replaced`` that the version does not have are dropped at once."""
        written = self._partition_folders(path)
        known = self._partitions(name, partition_by)
        places = {values: f"LOCATION '{path}/{folder}'" for values, folder in written.items()}
        added = [f"PARTITION ({_spec(partition_by, v)}) {place}" for v, place in places.items() if v not in known]
        if added:
            self.spark.sql(f"ALTER TABLE {name} ADD IF NOT EXISTS {' '.join(added)}")
        for values in written.keys() & known:
            self.spark.sql(f"ALTER TABLE {name} PARTITION ({_spec(partition_by, values)}) SET {places[values]}")
        gone = [f"PARTITION ({_spec(partition_by, v)})" for v in (replaced & known) - written.keys()]
        if gone:
            self.spark.sql(f"ALTER TABLE {name} DROP IF EXISTS {', '.join(gone)}")

    def replace(self, df: DataFrame, name: str, partition_by: Sequence[str] = ()) -> None:
        """Stages and publishes in one step, without an audit.  The frame may read the table itself."""
        self.publish(name, self.stage(df, name, partition_by), df.schema, partition_by)

    def create_empty(self, name: str, schema: T.StructType, partition_by: Sequence[str] = ()) -> bool:
        """A table without rows, unless it exists; tells whether it was made."""
        if self.spark.catalog.tableExists(name):
            return False
        self.replace(self.spark.createDataFrame([], schema), name, partition_by)
        return True

    def optimize(self, name: str, zorder_by: Sequence[str] = (), files: int | None = None) -> int:
        """Rewrites a named table as few files, checks the number of rows and publishes; returns that number.

        With ``zorder_by`` the rows of an unpartitioned table are clustered along the Z-order curve of those columns, in
        ``files`` files (as many as there are now if it is not given)."""
        table, own = self.spark.table(name), self._layout(name)
        if zorder_by and own:
            raise ValueError(f"{name} is partitioned by {own}; its files follow the partitions, not a curve")
        if zorder_by:
            files = files or max(1, table.select(F.col("_metadata.file_path")).distinct().count())
            path = self.stage(zorder_cluster(table, zorder_by, files, tie_breakers=[file_row()]), name)
        else:
            path = self.stage(table if own else table.hint("rebalance"), name)
        rows, written = table.count(), self.read_stage(path, table.schema).count()
        if rows != written:
            raise RuntimeError(f"{name} has {rows} rows, its compacted version {written}; the old version stays")
        self.publish(name, path, table.schema)
        return rows

    def _add_columns(self, name: str, schema: T.StructType) -> None:
        existing = self.spark.table(name).schema.names
        new = [f for f in schema.fields if f.name not in existing]
        if new:
            added = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in new)
            self.spark.sql(f"ALTER TABLE {name} ADD COLUMNS ({added})")

    def append_widening(self, df: DataFrame, name: str) -> list[str]:
        """Appends rows whose columns may be wider than the table's, or new; returns the columns that were widened.

        If none is, only the new rows are written.  Otherwise the old ones are rewritten under the common schema, as a
        finished version.  A narrower column or one without a common type raises before anything is written."""
        table = self.spark.table(name)
        common = common_schema(table.schema, df.schema)
        wider = changed_columns(table.schema, common)
        if not wider:
            self.append_evolving(fitted(df, common), name)
            return []
        both = fitted(table, common).unionByName(fitted(df, common))
        own = self._layout(name)
        if set(wider) & set(own):
            raise ValueError(f"{sorted(set(wider) & set(own))} partition the table; their type cannot change")
        self.replace(both, name, own)
        return wider

    def append_evolving(self, df: DataFrame, name: str) -> None:
        """Appends by column name; columns the table lacks are added to it first.  Only the new rows are
        written: older files simply have no such column and read as NULL."""
        self._add_columns(name, df.schema)
        types = {f.name: f.dataType for f in self.spark.table(name).schema.fields}
        rows = df.select(
            *[
                (F.col(column) if column in df.columns else F.lit(None)).cast(kind).alias(column)
                for column, kind in types.items()
            ]
        )
        rows.write.insertInto(name)
        self.spark.catalog.refreshTable(name)

    def _merged(
        self, target: DataFrame, changes: DataFrame, rule: MergeRule, name: str, partition_by: Sequence[str]
    ) -> tuple[str, T.StructType, MergeStats]:
        """Stages the merge of written changes.  Actions are counted by the tasks that write the files, each once
        however often it is run; the files hold the table's columns only."""
        plan = merge_plan(target, changes, rule, reduced=True)
        counts = Observation()
        rows = (plan.hint("rebalance", *partition_by) if partition_by else plan).observe(counts, *action_counts())
        kept = rows.filter(F.col("_action") != "deleted").drop("_action")
        path = self.version_path(name)
        writer = kept.write.mode("errorifexists")
        (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
        found = counts.get
        return path, kept.schema, MergeStats(*[found.get(f"rows_{action}", 0) for action in ACTIONS])

    def upsert(self, name: str, source: DataFrame, rule: MergeRule) -> MergeStats:
        """Merges changes into a table, rewriting all of it, and publishes the result."""
        target, changes = self.spark.table(name), cut_lineage(reduced_changes(source, rule))
        path, columns, stats = self._merged(target, changes, rule, name, self._layout(name))
        self.publish(name, path, columns)
        return stats

    def upsert_partitions(self, name: str, source: DataFrame, rule: MergeRule, partition_by: Sequence[str]) -> MergeStats:
        """Merges changes into a partitioned table by rewriting only the partitions they fall into, however many; NULL
        is a partition too.

        The partition columns must be among the merge keys, so that a row cannot move.  Counts cover the
        rewritten partitions.  Each partition's location moves on its own.  The names of the touched partitions pass
        the driver, as all partition names of the table do in its catalog.
        """
        outside = [column for column in partition_by if column not in rule.keys]
        if outside:
            raise ValueError(f"partition columns {outside} are not merge keys: a row could change partition")
        if list(partition_by) != self._layout(name):
            raise ValueError(f"{name} is partitioned by {self._layout(name)}, not by {list(partition_by)}")
        target, changes = self.spark.table(name), cut_lineage(reduced_changes(source, rule))
        types = {f.name: f.dataType for f in target.schema.fields}
        values = [named(column).cast(types[column]).cast("string").alias(column) for column in partition_by]
        touched = {tuple(row) for row in changes.select(*values).distinct().collect()}
        if any(value == "" for one in touched for value in one):
            raise ValueError("a partition value is the empty text, which a folder cannot name")
        if not touched:
            return MergeStats(0, 0, 0, 0)
        slim = target.filter(_in_partitions(partition_by, touched))
        path, columns, stats = self._merged(slim, changes, rule, name, partition_by)
        self._add_columns(name, columns)
        self._move_partitions(name, path, partition_by, touched)
        self.spark.catalog.refreshTable(name)
        return stats

    def _partition_folders(self, path: str) -> dict[tuple[str | None, ...], str]:
        """Partition values of a staged version, and the folder of each, from the file listing alone."""
        files = self.spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet")
        listed = files.option("recursiveFileLookup", True).load(path).select("path")
        start = F.instr("path", path.removeprefix("file:")) + len(path.removeprefix("file:")) + 1
        inside = F.substr("path", start)
        folder = F.regexp_replace(inside, "/[^/]*$", "").alias("folder")
        found = [row.folder for row in listed.select(folder).distinct().collect()]
        return {_values(f): f for f in found}


def _ordered(schema: T.StructType, partition_by: Sequence[str]) -> list[tuple[str, T.DataType]]:
    """Names and types, partition columns first."""
    fields = sorted(schema.fields, key=lambda f: f.name not in partition_by)
    return [(f.name, f.dataType) for f in fields]


def _extends(old: list[tuple[str, T.DataType]], new: list[tuple[str, T.DataType]]) -> bool:
    return new[: len(old)] == old


def _values(folder: str) -> tuple[str | None, ...]:
    """Partition values that a folder such as ``a=1/b=x`` names."""
    texts = [unquote(part.split("=", 1)[1]) for part in folder.split("/")]
    return tuple(None if text == NULL_FOLDER else text for text in texts)


def _in_partitions(columns: Sequence[str], wanted: set[tuple[str | None, ...]]) -> Column:
    """Whether a row lies in one of the partitions.  Only partition columns are read, so the filter prunes them."""
    texts = [F.coalesce(named(column).cast("string"), F.lit(NULL_FOLDER)) for column in columns]
    names = ["\0".join(NULL_FOLDER if v is None else v for v in one) for one in wanted]
    return F.concat_ws("\0", *texts).isin(sorted(names))


def _spec(columns: Sequence[str], values: Sequence[str | None]) -> str:
    """Text of a PARTITION clause."""
    quoted = ["null" if v is None else "'" + v.replace("\\", "\\\\").replace("'", "\\'") + "'" for v in values]
    return ", ".join(f"`{column}` = {value}" for column, value in zip(columns, quoted))
