"""Physical layout: compaction, clustering, partitioned writes, tiers.

These run write jobs.  Rows are rewritten to a new path and never in place; publishing the new path is
the caller's step (:mod:`pipekit.sinks`).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pipekit.functions import holds, interleave_bits, rank_bucket

MIB = 1 << 20
#: Stored bytes of a file whose rows one task gathers and sorts: as rows they take several times as much.
SORTED_BYTES = 128 * MIB
#: Rows whose values cut a column into ranks.
SAMPLE_ROWS = 20_000


def stored_bytes(spark: SparkSession, path: str) -> int:
    """Bytes in the parquet files under a path, from their listing alone (no file is opened)."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", True)
    return files.load(path).agg(F.coalesce(F.sum("length"), F.lit(0))).head()[0]


def file_count(spark: SparkSession, path: str, target_bytes: int = 512 * MIB) -> int:
    """How many files of about the target size the parquet files under a path would make."""
    return max(1, -(-stored_bytes(spark, path) // target_bytes))


def compact(
    spark: SparkSession, path: str, out: str, target_bytes: int = 512 * MIB, partition_by: Sequence[str] = ()
) -> None:
    """Rewrites many small files as few large ones.

    An unpartitioned table needs no shuffle: the scan packs small files into splits of the target size,
    and every split is written as one file.  A partitioned table is rebalanced by its partition columns;
    AQE then joins small partitions and splits large ones.  The files' schemas are merged, so a column that
    only later files have stays.
    """
    if partition_by:
        rows = spark.read.option("mergeSchema", True).parquet(path).hint("rebalance", *partition_by)
        rows.write.partitionBy(*partition_by).parquet(out)
        return
    packing = spark.newSession()  # same executors, own settings: the caller's, but for the packing of splits
    for key, value in spark.conf.getAll.items():
        if key.startswith("spark.sql.") and spark.conf.isModifiable(key):
            packing.conf.set(key, value)
    packing.conf.set("spark.sql.files.maxPartitionBytes", str(target_bytes))
    packing.conf.set("spark.sql.files.minPartitionNum", "1")
    packing.conf.set("spark.sql.files.openCostInBytes", "0")
    packing.read.option("mergeSchema", True).parquet(path).write.parquet(out)


def rank_cuts(df: DataFrame, columns: Sequence[str], buckets: int, sample_rows: int = SAMPLE_ROWS) -> dict[str, Column]:
    """Array of cut points that split each column into buckets of about equal size, from the sorted values of a sample of
    about ``sample_rows`` rows.  Any orderable type has cuts; NULL and NaN give none.  A frequent value is several of the points, so
    that its neighbours lie as far apart as their ranks."""
    total = df.count()
    sampled = df.select(*columns).sample(min(1.0, sample_rows / max(total, 1)), seed=7)
    ordered = sampled.agg(*[F.sort_array(F.collect_list(c)).alias(c) for c in columns])  # a sample's values

    def points(column: str) -> Column:
        places = F.transform(F.sequence(F.lit(1), F.lit(buckets - 1)), lambda i: (i * F.size(column) / buckets).cast("int"))
        found = F.array_compact(F.transform(places, lambda at: F.get(column, at)))
        # Through text, so that a time without zone is not read in the zone of the driver's machine.
        return F.transform(found, lambda point: point.cast("string")).alias(column)

    row = ordered.select(*map(points, columns)).head()
    types = {f.name: f.dataType for f in df.schema.fields}
    cuts = {}
    for column in columns:
        texts = [text for text in row[column] if text != "NaN"]
        cuts[column] = F.array(*[F.lit(text) for text in texts]).cast(T.ArrayType(types[column]))
    return cuts


def key_bits(columns: int, files: int) -> int:
    """Bits per column: cells enough for sixteen times the files, so that a file's range can follow the curve."""
    return max(4, min(62 // columns, -(-(max(files, 1) * 16 - 1).bit_length() // columns)))


def with_zorder_key(df: DataFrame, columns: Sequence[str], bits: int = 4, name: str = "_z") -> DataFrame:
    """Adds the interleaved bucket numbers of the columns.  Runs a job for the cut points.

    The bucket numbers get a projection of their own, so each is worked out once per row and not once per
    bit.
    """
    cuts = rank_cuts(df, columns, 1 << bits)
    numbers = {f"_b{i}": rank_bucket(F.col(column), cuts[column], bits) for i, column in enumerate(columns)}
    code = interleave_bits([F.col(number) for number in numbers], bits)
    return df.withColumns(numbers).withColumn(name, code).drop(*numbers)


def zorder_cluster(
    df: DataFrame, columns: Sequence[str], files: int, bits: int | None = None, tie_breakers: Sequence[str | Column] = ()
) -> DataFrame:
    """Rows ranged and sorted along the Z-order curve of the columns, for narrow min/max per file.

    The curve buckets by rank, so a long tail does not flatten the rest; the columns may have any orderable type, and the
    number of buckets follows the number of files.  Range partitioning cannot split
    equal keys: the columns themselves and the ``tie_breakers`` extend the key, so a cell that holds a
    third of the table still spreads over files.  Over a parquet scan, ``file_row()`` tells even exact
    copies apart.
    """
    ties = [F.col(t) if isinstance(t, str) else t for t in tie_breakers]
    tied = df.withColumns({f"_t{i}": t for i, t in enumerate(ties)}) if ties else df
    keyed = with_zorder_key(tied, columns, bits or key_bits(len(columns), files))
    order = ["_z", *columns, *[f"_t{i}" for i in range(len(ties))]]
    ranged = keyed.repartitionByRange(files, *order).sortWithinPartitions("_z", *columns)
    return ranged.drop("_z", *[f"_t{i}" for i in range(len(ties))])


def file_row() -> Column:
    """A number that tells rows of a parquet scan apart and is the same when a task is retried."""
    return F.xxhash64(F.col("_metadata.file_path"), F.col("_metadata.row_index"))


def bloom_options(columns: Sequence[str], expected_distinct: int | None = None) -> dict[str, str]:
    """Writer options that add bloom filters for point lookups on the columns."""
    options = {f"parquet.bloom.filter.enabled#{column}": "true" for column in columns}
    if expected_distinct:
        options.update({f"parquet.bloom.filter.expected.ndv#{c}": str(expected_distinct) for c in columns})
    return options


def write_layout(
    df: DataFrame,
    path: str,
    partition_by: Sequence[str] = (),
    sort_by: Sequence[str] = (),
    compression: str = "zstd",
    bloom_columns: Sequence[str] = (),
    mode: str = "errorifexists",
    options: Mapping[str, str] | None = None,
) -> None:
    """Partitioned, sorted, compressed parquet with optional bloom filters.

    With partition columns the rows are rebalanced by them first: few files per partition, and a partition
    with a third of the rows is split over tasks by AQE.
    """
    rows = df.hint("rebalance", *partition_by) if partition_by else df
    if sort_by:
        rows = rows.sortWithinPartitions(*partition_by, *sort_by)
    settings = {"compression": compression, **bloom_options(bloom_columns), **(options or {})}
    writer = rows.write.mode(mode).options(**settings)
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def archive_split(df: DataFrame, cold: str | Column) -> DataFrame:
    """Adds ``_tier``: ``archive`` where the condition certainly holds, else ``hot``."""
    return df.withColumn("_tier", F.when(holds(cold), F.lit("archive")).otherwise(F.lit("hot")))


def write_branches(df: DataFrame, column: str, path: str, names: Sequence[str]) -> dict[str, str]:
    """Writes the rows of every branch (a tier, a route, valid or quarantined) to a folder of its own, in one
    pass over the input and without a shuffle; returns branch name to path.  Each named branch can be read
    afterwards, also one that got no rows.  A row of no named branch stops the job."""
    unlisted = F.raise_error(F.concat(F.lit("no branch is named "), F.coalesce(F.col(column).cast("string"), F.lit("NULL"))))
    number = unlisted.cast("int")  # folders carry numbers: names may hold what a path cannot
    for i, name in reversed(list(enumerate(names))):
        number = F.when(F.col(column) == name, F.lit(i)).otherwise(number)
    df.withColumn("_branch", number).drop(column).write.partitionBy("_branch").parquet(path)
    folders = {name: f"{path}/_branch={i}" for i, name in enumerate(names)}
    body = df.drop(column)
    for folder in folders.values():
        body.limit(0).write.mode("append").parquet(folder)  # an empty branch still has a folder and a schema
    return folders


def write_tiers(df: DataFrame, cold: str | Column, path: str) -> tuple[str, str]:
    """Writes both tiers in one pass over the input; returns the hot and the archive path."""
    folders = write_branches(archive_split(df, cold), "_tier", path, ["hot", "archive"])
    return folders["hot"], folders["archive"]
