"""Merge-on-read: base files plus a keyed change log.

A batch of changes is written beside the table, newest per key, in as many rows as it has keys: its cost does not depend
on the table's size.  A read takes the newest of base and log per key.  When the log of a *bucket* (a hash range of the
keys) has passed a share of its base, a fold rewrites that bucket alone.

Files under ``root``, a folder that the whole cluster reaches:

* ``log/batch=<n>/bucket=<b>``: the changes of batch n.  A replayed batch overwrites its own folder.
* ``base/version=<v>/bucket=<b>``: folded rows, with the order and batch of the change each came from.
* ``state``: a file per fold, a row per folded bucket: its base version, its number of rows, and the last batch folded in.
  That file is the commit: a fold that fails before it leaves nothing that is read.

One writer at a time; files of old versions and folded batches are not deleted.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.query import StreamingQuery

from pipekit.functions import holds, named
from pipekit.operators.latest import latest_per_key, unique_or_fail
from pipekit.streaming.ingest import run_available

_STATE = "version long, bucket int, base string, rows long, folded long"
#: Columns that the files have beside the table's, and the columns that their folders name.
_ORDER, _DELETED = "_order", "_deleted"
_RESERVED = (_ORDER, _DELETED, "bucket", "batch", "version")


@dataclass(frozen=True)
class BucketState:
    bucket: int
    base: str
    rows: int
    folded: int


@dataclass(frozen=True)
class ChangeLogTable:
    """A table of ``schema`` whose rows are named by ``keys``.

    ``order_by`` names change columns: the greatest wins, whatever batch it comes in, so a late older change is ignored
    (NULL is the lowest; on equal order the later batch wins).  Without it the later batch wins, and several changes to a
    key in one batch stop the job.  ``delete_when`` is SQL over a change's columns; with an order, a deleted key stays in
    the files as a mark, so that older changes do not bring it back.  A change with a NULL key matches nothing and is
    always a new row, as in a merge.  Change columns that are in neither ``schema`` nor ``order_by`` are ignored.
    """

    spark: SparkSession
    root: str
    schema: T.StructType
    keys: Sequence[str]
    order_by: Sequence[T.StructField] = ()
    delete_when: str | None = None
    buckets: int = 64

    def __post_init__(self) -> None:
        if taken := [f.name for f in self.schema.fields if f.name in _RESERVED]:
            raise ValueError(f"columns {taken} have names that the table's files use")

    # ------------------------------------------------------------ files

    @property
    def _row(self) -> T.StructType:
        order = T.StructType([T.StructField(f"o{i}", field.dataType) for i, field in enumerate(self.order_by)])
        extra = [
            T.StructField(_ORDER, T.StructType([*order.fields, T.StructField("batch", T.LongType())])),
            T.StructField(_DELETED, T.BooleanType()),
        ]
        return T.StructType([*[T.StructField(f.name, f.dataType) for f in self.schema.fields], *extra])

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*[named(key) for key in self.keys]), F.lit(self.buckets)).cast("int")

    def _keyed(self) -> Column:
        return reduce(lambda a, b: a & b, [named(key).isNotNull() for key in self.keys])

    def _rows_of(self, df: DataFrame, order: Sequence[Column], batch: int, deleted: Column) -> DataFrame:
        columns = [named(f.name).cast(f.dataType).alias(f.name) for f in self.schema.fields]
        parts = [value.cast(f.dataType).alias(f"o{i}") for i, (value, f) in enumerate(zip(order, self.order_by, strict=True))]
        place = F.struct(*parts, F.lit(batch).cast("long").alias("batch")).alias(_ORDER)
        return df.select(*columns, place, deleted.alias(_DELETED)).withColumn("bucket", self._bucket())

    def _write(self, rows: DataFrame, path: str) -> None:
        rows.hint("rebalance", "bucket").write.mode("overwrite").partitionBy("bucket").parquet(path)

    def state(self) -> dict[int, BucketState]:
        """The newest state of every bucket that was ever folded: at most ``buckets`` rows."""
        rows = self.spark.read.schema(_STATE).parquet(f"{self.root}/state")
        newest = rows.groupBy("bucket").agg(F.max_by(F.struct("base", "rows", "folded"), "version").alias("s"))
        return {r.bucket: BucketState(r.bucket, r.s.base, r.s.rows, r.s.folded) for r in newest.collect()}

    def _publish(self, base: str, buckets: Sequence[int], folded: int) -> None:
        written = self.spark.read.schema(T.StructType([*self._row.fields, T.StructField("bucket", T.IntegerType())]))
        found = written.parquet(f"{self.root}/base/version={base}").groupBy("bucket").count()
        rows = {r.bucket: r["count"] for r in found.collect()}
        version = 0
        if folded >= 0:
            version = 1 + self.spark.read.schema(_STATE).parquet(f"{self.root}/state").agg(F.max("version")).head()[0]
        state = [(version, b, base if b in rows else "", rows.get(b, 0), folded) for b in buckets]
        self.spark.createDataFrame(state, _STATE).coalesce(1).write.mode("append").parquet(f"{self.root}/state")

    # ------------------------------------------------------------ writing

    def start_from(self, target: DataFrame) -> None:
        """The initial table.  Its rows are older than any change."""
        base = f"v-{uuid.uuid4().hex}"
        nothing = [F.lit(None)] * len(self.order_by)
        rows = self._rows_of(target, nothing, -1, F.lit(False))
        self._write(rows, f"{self.root}/base/version={base}")
        self._write(rows.limit(0), f"{self.root}/log")  # the folder exists from here on
        self._publish(base, range(self.buckets), -1)

    def changes(self, df: DataFrame, batch: int) -> DataFrame:
        """What a batch writes: its newest change per key."""
        deleted = holds(self.delete_when) if self.delete_when else F.lit(False)
        rows = self._rows_of(df, [named(f.name) for f in self.order_by], batch, deleted)
        keyed = rows.filter(self._keyed())
        if self.order_by:
            newest = latest_per_key(keyed, self.keys, [_ORDER])
        else:
            newest = unique_or_fail(keyed, list(self.keys), f"several changes for one key {list(self.keys)}; give order_by")
        return newest.unionByName(rows.filter(~self._keyed() & ~F.col(_DELETED)))

    def apply(self, df: DataFrame, batch: int) -> None:
        """Adds a batch to the log.  Nothing of the table is read or rewritten."""
        self._write(self.changes(df, batch), f"{self.root}/log/batch={batch}")

    def run(self, stream: DataFrame, checkpoint: str) -> StreamingQuery:
        """Applies everything a stream has now, batch by batch."""
        writer = stream.writeStream.foreachBatch(lambda df, batch: self.apply(df, batch))
        return run_available(writer.option("checkpointLocation", checkpoint))

    # ------------------------------------------------------------ reading

    def _base(self, state: dict[int, BucketState], buckets: Sequence[int]) -> DataFrame:
        """Base rows of some buckets, as one scan of exactly their folders."""
        extra = [T.StructField("version", T.StringType()), T.StructField("bucket", T.IntegerType())]
        schema = T.StructType([*self._row.fields, *extra])
        folders = [f"{self.root}/base/version={state[b].base}/bucket={b}" for b in buckets if b in state and state[b].rows]
        if not folders:
            return self.spark.createDataFrame([], schema).drop("version")
        return self.spark.read.schema(schema).option("basePath", f"{self.root}/base").parquet(*folders).drop("version")

    def _pending(self, state: dict[int, BucketState], up_to: int | None = None) -> DataFrame:
        """Log rows not folded yet.  The filter names folders, so folded batches are not opened."""
        folders = [T.StructField("batch", T.LongType()), T.StructField("bucket", T.IntegerType())]
        log = self.spark.read.schema(T.StructType([*self._row.fields, *folders])).parquet(f"{self.root}/log")
        after: dict[int, list[int]] = {}
        for b in range(self.buckets):
            after.setdefault(state[b].folded if b in state else -1, []).append(b)
        wanted = [(F.col("batch") > n) & F.col("bucket").isin(inside) for n, inside in after.items()]
        pending = log.filter(reduce(lambda a, b: a | b, wanted))
        return (pending if up_to is None else pending.filter(F.col("batch") <= up_to)).drop("batch")

    def _newest(self, base: DataFrame, pending: DataFrame) -> DataFrame:
        """Base and log as one row per key, marks of deleted keys included; NULL keys stay as they are.

        The base stays on the left of a left join, so a small log is broadcast and the base is not shuffled."""
        columns, keys = base.columns, list(self.keys)
        change = latest_per_key(pending.filter(self._keyed()), keys, [_ORDER])
        at = {c: f"_new_{i}" for i, c in enumerate(columns)}
        same = reduce(lambda a, b: a & b, [named(k) == F.col(at[k]) for k in keys])
        joined = base.join(change.select(*[named(c).alias(new) for c, new in at.items()]), same, "left")
        wins = F.col(at[_DELETED]).isNotNull() & (F.col(at[_ORDER]) >= F.col(_ORDER))
        kept = joined.select(*[F.when(wins, F.col(at[c])).otherwise(named(c)).alias(c) for c in columns])
        names = [named(k) for k in keys]
        known = base.select(*names).join(change.select(*names), keys, "left_semi")
        added = change.join(known, keys, "left_anti").select(*map(named, columns))
        return kept.unionByName(added).unionByName(pending.filter(~self._keyed()))

    def _merged(self, state: dict[int, BucketState], pending: DataFrame, buckets: Sequence[int]) -> DataFrame:
        return self._newest(self._base(state, buckets), pending.filter(F.col("bucket").isin(list(buckets))))

    def _dirty(self, pending: DataFrame) -> dict[int, int]:
        """Pending rows per bucket."""
        return {r.bucket: r["count"] for r in pending.groupBy("bucket").count().collect()}

    def read(self) -> DataFrame:
        """The table now.  Buckets without pending changes are read as they are, without a join."""
        state = self.state()
        pending = self._pending(state)
        dirty = sorted(self._dirty(pending))
        clean = self._base(state, [b for b in range(self.buckets) if b not in set(dirty)])
        rows = clean.unionByName(self._merged(state, pending, dirty)) if dirty else clean
        return rows.filter(~F.col(_DELETED)).select(*[named(f.name) for f in self.schema.fields])

    # ------------------------------------------------------------ folding

    def fold(self, share: float = 0.1) -> list[int]:
        """Rewrites the buckets whose log has more than ``share`` of their base's rows; returns them."""
        state = self.state()
        pending = self._pending(state)
        ripe = sorted(b for b, n in self._dirty(pending).items() if n > share * (state[b].rows if b in state else 0))
        if not ripe:
            return []
        last = pending.filter(F.col("bucket").isin(ripe)).agg(F.max(f"{_ORDER}.batch")).head()[0]
        merged = self._merged(state, pending, ripe)
        if not self.order_by:
            merged = merged.filter(~F.col(_DELETED))  # no older change can arrive
        base = f"v-{uuid.uuid4().hex}"
        self._write(merged, f"{self.root}/base/version={base}")
        self._publish(base, ripe, last)
        return ripe

    def statistics(self, batch: int) -> DataFrame:
        """One row, of a batch that is not folded yet: ``rows_updated, rows_inserted, rows_deleted, rows_ignored``.  Only the
        batch's buckets are read, and of these the keys.  Deletes of absent keys and older changes are ignored."""
        state = self.state()
        everything = self._pending(state, batch)
        mine = everything.filter(F.col(f"{_ORDER}.batch") == batch)
        if any(bucket.folded >= batch for bucket in state.values()):
            raise ValueError(f"batch {batch} is folded already")
        dirty = self._dirty(mine)
        if not dirty:
            return self.spark.range(1).selectExpr(*[f"0L AS rows_{a}" for a in ("updated", "inserted", "deleted", "ignored")])
        before = self._merged(state, everything.filter(F.col(f"{_ORDER}.batch") < batch), sorted(dirty)).filter(self._keyed())
        old = before.select(*[named(k) for k in self.keys], F.col(_ORDER).alias("_was"), F.col(_DELETED).alias("_gone"))
        joined = mine.join(old, list(self.keys), "left")
        newer = F.coalesce(F.col(_ORDER) >= F.col("_was"), F.lit(True))
        there = F.coalesce(~F.col("_gone"), F.lit(False))
        outcome = (
            F.when(newer & there & F.col(_DELETED), "deleted")
            .when(newer & there, "updated")
            .when(newer & ~F.col(_DELETED), "inserted")
            .otherwise("ignored")
        )
        counted = [F.count_if(outcome == a).alias(f"rows_{a}") for a in ("updated", "inserted", "deleted", "ignored")]
        return joined.agg(*counted)
