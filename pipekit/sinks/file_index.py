"""Datasets as a list of their files, with each file's size, rows and zone (least and greatest value of some columns).

The list is a small parquet table, one version per change.  A range probe reads the list first and then only the files whose
zone meets the range.  Compaction packs small files into bins of about the target size and rewrites only those; the
others stay where they are, under the next version of the list.  Clustering rewrites all files along a Z-order curve.

A change writes its files, then its list, then one row into ``current``, which is the commit: readers see the old list or
the new one.  One writer at a time; files of old versions are not deleted.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pipekit.functions import named
from pipekit.operators.layout import MIB, file_row, zorder_cluster
from pipekit.session import cut_lineage

#: Small files that are packed together by one task.
FILES_PER_GROUP = 10_000
#: Files up to which a rewrite's list is broadcast; their paths have passed the driver by then.
BROADCAST_FILES = 100_000


@dataclass(frozen=True)
class Compaction:
    """What a compaction did."""

    files_before: int
    files_after: int
    small_before: int
    small_after: int
    bytes_total: int
    bytes_rewritten: int


def first_fit(sizes: Sequence[int], capacity: int) -> list[int]:
    """Bin of each file, largest files first, each into the first bin that has room.

    The bins' rooms are kept in a tournament tree, so a file finds its bin in log(files) steps."""
    order = sorted(range(len(sizes)), key=lambda i: (-sizes[i], i))
    width = 1 << max(1, (len(sizes) - 1).bit_length())
    room = [capacity] * (2 * width)
    bins = [0] * len(sizes)
    for i in order:
        need, node = min(sizes[i], capacity), 1
        while node < width:
            node = 2 * node if room[2 * node] >= need else 2 * node + 1
        bins[i] = node - width
        room[node] -= need
        while node > 1:
            node //= 2
            room[node] = max(room[2 * node], room[2 * node + 1])
    return bins


def _pack(capacity: int):
    """Files that share a bin, the group's bins numbered without gaps."""

    def run(key: tuple, files: pd.DataFrame) -> pd.DataFrame:
        files = files.sort_values("path", ignore_index=True)
        files["bin"] = first_fit(files["bytes"].tolist(), capacity)
        files = files[files.groupby("bin")["bin"].transform("size") > 1]
        return files.assign(bin=pd.factorize(files["bin"])[0])[["path", "bytes", "grp", "bin"]]

    return run


@dataclass(frozen=True)
class FileIndex:
    """``zones`` are the columns whose ranges are listed; they must be orderable."""

    spark: SparkSession
    root: str
    schema: T.StructType
    zones: Sequence[str]

    # ------------------------------------------------------------ the list

    def _version(self) -> int:
        current = self.spark.read.schema("version long").parquet(f"{self.root}/current")
        return current.agg(F.max("version")).head()[0]

    def files(self) -> DataFrame:
        """``path, bytes, rows``, and ``low_<i>, high_<i>`` of the i-th zone column (NULL if a file has no value)."""
        path = f"{self.root}/lists/v-{self._version()}"
        return self.spark.read.schema(self._list_schema()).parquet(path)

    def _list_schema(self) -> T.StructType:
        types = {f.name: f.dataType for f in self.schema.fields}
        fields = [T.StructField("path", T.StringType()), T.StructField("bytes", T.LongType()), T.StructField("rows", T.LongType())]
        for i, column in enumerate(self.zones):
            fields += [T.StructField(f"{side}_{i}", types[column]) for side in ("low", "high")]
        return T.StructType(fields)

    def _listed(self, folder: str) -> DataFrame:
        """The files of a folder, from a pass over their zone columns.  Files without rows are left out."""
        read = self.spark.read.schema(self.schema).option("recursiveFileLookup", True).parquet(folder)
        zones = []
        for i, column in enumerate(self.zones):
            zones += [F.min(named(column)).alias(f"low_{i}"), F.max(named(column)).alias(f"high_{i}")]
        # With a collected size Spark keeps the groups' buffers in a hash map; strings' ranges alone would make it sort all rows by file.
        size = F.element_at(F.collect_set(F.col("_metadata.file_size")), 1).alias("bytes")
        files = read.groupBy(F.col("_metadata.file_path").alias("path"))
        return files.agg(size, F.count(F.lit(1)).alias("rows"), *zones).select(self._list_schema().names)

    def _publish(self, files: DataFrame, version: int) -> None:
        files.coalesce(1).write.mode("overwrite").parquet(f"{self.root}/lists/v-{version}")
        current = self.spark.createDataFrame([(version,)], "version long").coalesce(1)
        current.write.mode("append").parquet(f"{self.root}/current")

    def _folder(self) -> str:
        return f"{self.root}/data/v-{uuid.uuid4().hex}"

    # ------------------------------------------------------------ writing

    def start_from(self, df: DataFrame) -> None:
        """Writes the frame as it is spread, one file or more per task."""
        self._start(df, -1)

    def _start(self, df: DataFrame, before: int) -> None:
        folder = self._folder()
        df.select(*[named(f.name) for f in self.schema.fields]).write.parquet(folder)
        self._publish(self._listed(folder), before + 1)

    def append(self, df: DataFrame) -> None:
        """Adds files; the others stay."""
        version, old, folder = self._version(), self.files(), self._folder()
        df.select(*[named(f.name) for f in self.schema.fields]).write.parquet(folder)
        self._publish(old.unionByName(self._listed(folder)), version + 1)

    def compact(self, target_bytes: int = 512 * MIB, small_share: float = 0.5) -> Compaction:
        """Rewrites the files below ``small_share`` of the target that can be packed with another one."""
        files = cut_lineage(self.files())
        small = files.filter(F.col("bytes") < F.lit(target_bytes * small_share))
        groups = max(1, -(-small.count() // FILES_PER_GROUP))
        dealt = small.select("path", "bytes", F.pmod(F.xxhash64("path"), F.lit(groups)).alias("grp"))
        packed = cut_lineage(dealt.groupBy("grp").applyInPandas(_pack(target_bytes), "path string, bytes long, grp long, bin long"))
        # One row per group of thousands of files: where its bins' numbers begin.
        bins = packed.groupBy("grp").agg((F.max("bin") + 1).alias("bins"))
        first = F.sum("bins").over(Window.orderBy("grp")) - F.col("bins")
        numbered = packed.join(bins.select("grp", first.alias("first")), "grp")
        rewritten = cut_lineage(numbered.select("path", "bytes", (F.col("first") + F.col("bin")).cast("int").alias("bin")))
        before = files.agg(F.count(F.lit(1)).alias("files"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes")).head()
        moved = rewritten.agg(
            F.count(F.lit(1)).alias("files"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"), (F.max("bin") + 1).alias("bins")
        ).head()
        if moved.files:
            folder, version = self._folder(), self._version()
            rows = self.read(rewritten).withColumn("path", F.col("_metadata.file_path"))
            small_list = F.broadcast if moved.files <= BROADCAST_FILES else lambda df: df
            binned = rows.join(small_list(rewritten.select("path", "bin")), "path")
            # A bin has about the target's bytes: one task writes it as one file, row by row as they come.
            names = [named(f.name) for f in self.schema.fields]
            binned.repartitionById(moved.bins, F.col("bin")).select(*names).write.parquet(folder)
            kept = files.join(rewritten, "path", "left_anti").select(*files.columns)
            self._publish(kept.unionByName(self._listed(folder)), version + 1)
        after = self.files()
        small_after = after.filter(F.col("bytes") < F.lit(target_bytes * small_share)).count()
        return Compaction(before.files, after.count(), small.count(), small_after, before.bytes, moved.bytes)

    def cluster(self, columns: Sequence[str], files: int) -> None:
        """Rewrites all rows along the Z-order curve of the columns."""
        version = self._version()
        # Rows of one file have distinct numbers, so copies of a row spread over files too.
        read = self.read(self.files()).withColumn("_row", file_row())
        self._start(zorder_cluster(read, columns, files, tie_breakers=["_row"]), version)

    # ------------------------------------------------------------ reading

    def read(self, files: DataFrame | None = None) -> DataFrame:
        """The rows of the listed files, all by default.  Their paths pass the driver, as in any read of files."""
        paths = [r.path for r in (self.files() if files is None else files).select("path").distinct().collect()]
        read = self.spark.read.schema(self.schema)
        return read.parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def _meeting(self, ranges: dict[str, tuple[Column, Column]]) -> DataFrame:
        meets = F.lit(True)
        for column, (low, high) in ranges.items():
            i = list(self.zones).index(column)
            meets &= (F.col(f"low_{i}") <= high) & (F.col(f"high_{i}") >= low)
        return self.files().filter(F.coalesce(meets, F.lit(False)))

    def between(self, ranges: dict[str, tuple[Column, Column]]) -> DataFrame:
        """Rows whose zone columns lie in all the ranges (both ends included); files that cannot have any are not opened."""
        inside = F.lit(True)
        for column, (low, high) in ranges.items():
            inside &= named(column).between(low, high)
        return self.read(self._meeting(ranges)).filter(inside)

    def probe(self, ranges: dict[str, tuple[Column, Column]]) -> DataFrame:
        """One row: ``files, rows`` of the dataset, ``files_read, rows_read`` of those that the ranges meet."""
        met = self._meeting(ranges).select("path", F.lit(1).alias("met"))
        listed = self.files().select("path", "rows").join(met, "path", "left")
        rows = F.coalesce(F.sum(F.when(F.col("met") == 1, F.col("rows"))), F.lit(0))
        return listed.agg(
            F.count(F.lit(1)).alias("files"),
            F.coalesce(F.sum("rows"), F.lit(0)).alias("rows"),
            F.count("met").alias("files_read"),
            rows.alias("rows_read"),
        )
