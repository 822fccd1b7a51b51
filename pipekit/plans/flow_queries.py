"""Streams and whole flows."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pipekit.operators.expectations import ExpectationSuite, ExpectNonNull
from pipekit.operators.merge import MergeRule
from pipekit.operators.rules import QualityRule
from pipekit.operators.clean import StandardizeText
from pipekit.plans.flow import IncrementalFlow, run_simple, standard_flow
from pipekit.plans.registry import Tables, fresh_name, register
from pipekit.session import scratch_path
from pipekit.sinks import ChangeLogTable, PathWriter, TableStore
from pipekit.sources import TableSource
from pipekit.streaming import ChangeApplier, CountedBatches, drop_late_duplicates, expect_stream, file_stream, run_available, write_stream


def _stream(t: Tables, name: str) -> DataFrame:
    # A stream's source is a directory or glob; this one matches the table whether it is a file or a folder.
    return file_stream(t.spark, f"{t.directory}/{name}.parq*t", getattr(t, name).schema)


def _drain(t: Tables, stream: DataFrame, tag: str) -> DataFrame:
    out = scratch_path(t.spark, tag)
    run_available(write_stream(stream, f"{out}/data", f"{out}/progress"))
    return t.spark.read.schema(stream.schema).parquet(f"{out}/data")


@register("stream_ingest", "select * from events")
def _stream_ingest(t: Tables):
    return _drain(t, _stream(t, "events"), "ingest")


EVENT_RULES = [
    QualityRule("cheap", "value < 30"),
    QualityRule("known", "nullif(event_type, 'view') <> 'error'"),
]


@register(
    "stream_expect_or_drop",
    "select * from events where value < 30 and coalesce(nullif(event_type, 'view') <> 'error', true)",
)
def _stream_expect_or_drop(t: Tables):
    return _drain(t, expect_stream(_stream(t, "events"), EVENT_RULES), "expect")


@register(
    "stream_metrics",
    """
    select 'cheap' as rule_name, 8::bigint as batches, count(*) as total_records, count(*) filter (where not (value < 30)) as failed_records,
           count(*) filter (where value < 30 and coalesce(nullif(event_type, 'view') <> 'error', true)) as rows_written from events
    union all
    select 'known', 8, count(*), count(*) filter (where not (nullif(event_type, 'view') <> 'error')),
           count(*) filter (where value < 30 and coalesce(nullif(event_type, 'view') <> 'error', true)) from events
    """,
)
def _stream_metrics(t: Tables):
    """Events in eight files, one a batch, in two runs of a query that remembers three batches: the counters know all."""
    spark = t.spark.newSession()
    spark.conf.set("spark.sql.streaming.numRecentProgressUpdates", "3")
    root = scratch_path(spark, "counted")
    sink = CountedBatches(spark, f"{root}/out", EVENT_RULES)
    for half in (0, 1):  # the second run goes on where the first one ended
        some = t.events.filter(F.col("event_id") % 2 == half)
        some.repartition(4, "event_id").write.mode("append").parquet(f"{root}/in")
        sink.run(file_stream(spark, f"{root}/in", t.events.schema, max_files=1), f"{root}/progress")
    written = spark.read.schema(t.events.schema).option("recursiveFileLookup", True).parquet(f"{root}/out/data").count()
    return sink.metrics().withColumn("rows_written", F.lit(written).cast("bigint"))


@register("stream_dedup", "select event_id, user_id, event_type, value from events")
def _stream_dedup(t: Tables):
    """Every event arrives twice, the second time a minute later; which copy stays is not defined."""
    events = _stream(t, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    again = events.withColumn("ts", F.col("ts") + F.expr("INTERVAL '1' MINUTE"))
    single = drop_late_duplicates(events.unionByName(again), ["event_id"], "ts", "10 minutes")
    return _drain(t, single.select("event_id", "user_id", "event_type", "value"), "dedup")


def _placed_before_2000(t: Tables) -> DataFrame:
    old = t.orders.filter(F.col("o_orderdate") < F.lit("2000-01-01 00:00:00").cast("timestamp_ntz"))
    return old.select("o_orderkey", "o_custkey", "o_totalprice")


def _order_feed(orders: DataFrame, seq: int, price: Column) -> DataFrame:
    """A change of every order but the pending ones placed before 2000: finished orders are deleted."""
    late = F.col("o_orderdate") >= F.lit("2000-01-01 00:00:00").cast("timestamp_ntz")
    op = F.when(F.col("o_orderstatus") == "F", F.lit("delete")).otherwise(F.lit("upsert"))
    changed = orders.filter(late | (F.col("o_orderstatus") != "P"))
    return changed.select("o_orderkey", "o_custkey", price.alias("o_totalprice"), op.alias("op"), F.lit(seq).alias("seq"))


def _revised(by: float) -> Column:
    """Open orders cost more, pending ones what they did."""
    return F.col("o_totalprice") + F.when(F.col("o_orderstatus") == "O", F.lit(by)).otherwise(F.lit(0.0))


@register(
    "cdc_apply",
    """
    select o_orderkey, o_custkey, o_totalprice from orders where o_orderstatus = 'P'
    union all select o_orderkey, o_custkey, o_totalprice + 5 from orders where o_orderstatus = 'O'
    """,
)
def _cdc_apply(t: Tables):
    """The target holds the orders placed before 2000.  The feed deletes finished orders, revises open ones twice, adds
    the later ones and says nothing about the others."""
    target, orders = _placed_before_2000(t), _stream(t, "orders")
    rule = MergeRule(
        ["o_orderkey"],
        "true",
        order_by=["seq"],
        delete_condition="source.op = 'delete'",
        insert_condition="op <> 'delete'",
        ignore=["op", "seq"],
    )
    root = scratch_path(t.spark, "changes")
    applier = ChangeApplier(f"{root}/versions", target.schema, rule)
    applier.start_from(target)
    stale = _order_feed(orders, 1, F.lit(0.0)).withColumn("op", F.lit("upsert"))
    applier.run(_order_feed(orders, 2, _revised(5.0)).unionByName(stale), f"{root}/progress")
    return applier.current(t.spark)


def _order_log(t: Tables) -> ChangeLogTable:
    """The target of orders before 2000 with a first batch of changes, from a stream, in its log."""
    target = _placed_before_2000(t)
    order = [T.StructField("seq", T.IntegerType())]
    root = scratch_path(t.spark, "log")
    table = ChangeLogTable(t.spark, f"{root}/table", target.schema, ["o_orderkey"], order, "op = 'delete'", buckets=8)
    table.start_from(target)
    table.run(_order_feed(_stream(t, "orders"), 2, _revised(5.0)), f"{root}/progress")
    return table


@register(
    "cdc_apply_folded",
    """
    select o_orderkey, o_custkey, o_totalprice from orders where o_orderstatus = 'P'
    union all
    select o_orderkey, o_custkey, o_totalprice + case when o_custkey % 50 = 0 then 7 else 5 end from orders
    where o_orderstatus = 'O'
    """,
)
def _cdc_apply_folded(t: Tables):
    """After the first batch, buckets with more than a tenth of changes are folded.  Then older changes of all orders
    arrive late, which count for nothing, and newer ones of some customers' open orders, which stay in the log."""
    table = _order_log(t)
    table.fold(0.1)
    table.apply(_order_feed(t.orders, 1, F.lit(0.0)).withColumn("op", F.lit("upsert")), 1)
    table.fold(0.1)
    some = t.orders.filter((F.col("o_custkey") % 50 == 0) & (F.col("o_orderstatus") == "O"))
    table.apply(_order_feed(some, 3, _revised(7.0)), 2)
    table.fold(0.5)
    return table.read()


@register(
    "change_log_stats",
    """
    with changed as (select o_orderstatus = 'F' as gone, o_orderdate < timestamp '2000-01-01 00:00:00' as old from orders
                     where o_orderstatus <> 'P' or o_orderdate >= timestamp '2000-01-01 00:00:00')
    select count(*) filter (where old and not gone) as rows_updated, count(*) filter (where not old and not gone) as rows_inserted,
           count(*) filter (where old and gone) as rows_deleted, count(*) filter (where not old and gone) as rows_ignored
    from changed
    """,
)
def _change_log_stats(t: Tables):
    """What the first batch did, told from the batch and the keys it concerns."""
    return _order_log(t).statistics(0)


@register(
    "batch_publish",
    """
    select o_orderkey as id, o_orderdate as created_date, trim('  ' || o_orderpriority || ' ') as name,
           o_orderstatus as description, o_custkey as customer_id, c_name as customer_name, n_name as region
    from orders left join customer on o_custkey = c_custkey left join nation on c_nationkey = n_nationkey
    where o_totalprice >= 5000
    """,
)
def _batch_publish(t: Tables):
    """The ready-made flow, from orders with missing ids and padded text to a published table."""
    sales = t.orders.select(
        F.when(F.col("o_totalprice") >= 5000, F.col("o_orderkey")).alias("id"),
        F.col("o_orderdate").alias("created_date"),
        F.concat(F.lit("  "), "o_orderpriority", F.lit(" ")).alias("name"),
        F.concat(F.lit(" "), "o_orderstatus", F.lit("  ")).alias("description"),
        F.col("o_custkey").alias("customer_id"),
    )
    customers = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"), "left").select(
        F.col("c_custkey").alias("customer_id"), F.col("c_name").alias("customer_name"), F.col("n_name").alias("region")
    )
    view, table = fresh_name("sales"), fresh_name("published")
    sales.createOrReplaceTempView(view)
    store = TableStore(t.spark, scratch_path(t.spark, "tables"))
    result = standard_flow(TableSource(t.spark), store, lookup=customers, on_invalid="raise").execute(view, table)
    assert result, result
    return t.spark.table(table).select(
        "id", "created_date", "name", "description", "customer_id", "customer_name", "region"
    )


@register(
    "incremental_publish",
    """
    with present as (select o_orderkey, o_totalprice, o_orderdate from orders where o_orderdate < timestamp '1999-01-01'),
    late as (select o_orderkey, o_totalprice + case when o_orderstatus = 'F' then 1 else 0 end as o_totalprice, o_orderdate
             from orders where o_orderdate >= timestamp '1998-01-01')
    select * from present where o_orderkey not in (select o_orderkey from late) union all select * from late
    """,
)
def _incremental_publish(t: Tables):
    """A table that holds the orders before 1999 takes in what the source has since 1998."""
    columns = ["o_orderkey", "o_totalprice", "o_orderdate"]
    view, table = fresh_name("changed"), fresh_name("merged")
    raised = F.when(F.col("o_orderstatus") == "F", F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice"))
    t.orders.select("o_orderkey", raised.alias("o_totalprice"), "o_orderdate").createOrReplaceTempView(view)
    store = TableStore(t.spark, scratch_path(t.spark, "tables"))
    store.replace(t.orders.filter(F.col("o_orderdate") < F.lit("1999-01-01").cast("timestamp_ntz")).select(*columns), table)
    flow = IncrementalFlow(
        TableSource(t.spark),
        [],
        ExpectationSuite([ExpectNonNull(columns)]),
        store,
        MergeRule(["o_orderkey"], "source.o_totalprice <> target.o_totalprice"),
        "o_orderdate",
    )
    result = flow.execute(view, table, datetime(1998, 1, 1))
    assert result, result
    return t.spark.table(table)


@register(
    "incremental_publish_partitioned",
    """
    select o_orderkey, o_orderstatus, case when o_orderstatus = 'F' and o_orderdate > timestamp '1998-01-01 00:00:00'
           then o_totalprice + 1 else o_totalprice end as o_totalprice, o_orderdate,
           case when o_orderdate > timestamp '1998-01-01 00:00:00' and (o_orderstatus = 'F' or o_orderdate >= timestamp '1999-01-01 00:00:00')
           then o_orderpriority end as o_orderpriority
    from orders
    """,
)
def _incremental_publish_partitioned(t: Tables):
    """As ``incremental_publish``, by partitions of the status; the source brings a column that the table lacks."""
    columns = ["o_orderkey", "o_orderstatus", "o_totalprice", "o_orderdate"]
    view, table = fresh_name("changed"), fresh_name("merged")
    raised = F.when(F.col("o_orderstatus") == "F", F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice"))
    changed = t.orders.select("o_orderkey", "o_orderstatus", raised.alias("o_totalprice"), "o_orderdate", "o_orderpriority")
    changed.createOrReplaceTempView(view)
    store = TableStore(t.spark, scratch_path(t.spark, "tables"))
    early = t.orders.filter(F.col("o_orderdate") < F.lit("1999-01-01").cast("timestamp_ntz"))
    store.replace(early.select(*columns), table, ["o_orderstatus"])
    rule = MergeRule(["o_orderstatus", "o_orderkey"], "source.o_totalprice <> target.o_totalprice", evolve=True)
    suite = ExpectationSuite([ExpectNonNull(columns)])
    flow = IncrementalFlow(TableSource(t.spark), [], suite, store, rule, "o_orderdate", False, ["o_orderstatus"])
    result = flow.execute(view, table, datetime(1998, 1, 1))
    assert result, result
    return t.spark.table(table)


@register("run_simple", "select c_custkey, trim(c_name) as c_name, c_acctbal from customer where c_acctbal >= 0")
def _run_simple(t: Tables):
    """The short flow; one whose audit fails writes nothing."""
    base, suite = scratch_path(t.spark, "simple"), ExpectationSuite([ExpectNonNull(["c_name"])])
    padded = t.customer.select("c_custkey", F.concat(F.lit(" "), "c_name", F.lit("  ")).alias("c_name"), "c_acctbal")
    writer = PathWriter(base)
    run_simple(padded.filter("c_acctbal >= 0"), StandardizeText(["c_name"], "trim"), suite, writer, "customers")
    try:
        run_simple(padded, lambda df: df.withColumn("c_name", F.lit(None).cast("string")), suite, writer, "customers")
    except ValueError:
        return t.spark.read.parquet(f"{base}/customers")
    raise RuntimeError("the audit let NULL names pass")
