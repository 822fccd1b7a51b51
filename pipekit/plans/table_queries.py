"""Upserts, change apply, layout jobs, lineage, run log."""

from __future__ import annotations

from dataclasses import asdict

from pyspark.sql import functions as F

from pipekit.operators.access import route_rows
from pipekit.operators.latest import as_of, latest_per_key
from pipekit.operators.layout import (
    MIB,
    SORTED_BYTES,
    compact,
    file_count,
    file_row,
    write_branches,
    write_layout,
    write_tiers,
    zorder_cluster,
)
from pipekit.operators.lineage import downstream, lineage_edges
from pipekit.operators.merge import ALWAYS, MergeRule, append_evolving, merge_plan, merge_stats, upsert
from pipekit.operators.runlog import cost_per_unit, recovery_time, run_durations, run_reliability
from pipekit.plans.registry import Tables, fresh_name, register
from pipekit.session import scratch_path
from pipekit.sinks import FileIndex, PathWriter, TableStore, TableWriter, create_from_query, create_if_absent

# The target holds the orders placed before 2000; the feed has a revision of every order, dated a day later
# for finished orders and a day earlier for others, and an older one before that.  Urgent orders have lost
# their key on the way.
MERGE_CTES = """
    target as (select o_orderkey as k, o_custkey, o_totalprice as price, o_orderdate as changed_at
               from orders where o_orderdate < timestamp '2000-01-01 00:00:00'),
    feed as (select case when o_orderpriority <> '1-URGENT' then o_orderkey end as k, o_custkey,
                    o_totalprice + 10 as price,
                    o_orderdate + case when o_orderstatus = 'F' then interval 1 day else interval (-1) day end
                    as changed_at
             from orders
             union all
             select o_orderkey, o_custkey, 0.0::double, o_orderdate - interval 30 day from orders
             where o_orderpriority <> '1-URGENT'),
    source as (select * from feed where k is null
               union all (select * from feed where k is not null
                          qualify row_number() over (partition by k order by changed_at desc) = 1)),
"""


def _before_2000(t: Tables):
    return t.orders.filter(F.col("o_orderdate") < F.lit("2000-01-01 00:00:00").cast("timestamp_ntz"))


def _target(t: Tables):
    return _before_2000(t).select(
        F.col("o_orderkey").alias("k"),
        "o_custkey",
        F.col("o_totalprice").alias("price"),
        F.col("o_orderdate").alias("changed_at"),
    )


def _feed(t: Tables):
    day = F.expr("INTERVAL '1' DAY")
    has_key = F.col("o_orderpriority") != "1-URGENT"
    finished = F.col("o_orderstatus") == "F"
    newest = t.orders.select(
        F.when(has_key, F.col("o_orderkey")).alias("k"),
        "o_custkey",
        (F.col("o_totalprice") + 10).alias("price"),
        F.when(finished, F.col("o_orderdate") + day).otherwise(F.col("o_orderdate") - day).alias("changed_at"),
    )
    older = t.orders.filter(has_key).select(
        F.col("o_orderkey").alias("k"),
        "o_custkey",
        F.lit(0.0).alias("price"),
        (F.col("o_orderdate") - 30 * day).alias("changed_at"),
    )
    return newest.unionByName(older)


NEWER_RULE = MergeRule(["k"], "source.changed_at > target.changed_at", order_by=["changed_at"])


@register(
    "upsert_newer",
    f"""
    with {MERGE_CTES}
    merged as (
        select coalesce(t.k, s.k) as k, t.k is not null as old, s.k is not null as new, s.changed_at > t.changed_at as newer,
               t.o_custkey as tc, s.o_custkey as sc, t.price as tp, s.price as sp, t.changed_at as ta, s.changed_at as sa
        from target t full join source s on t.k = s.k)
    select k, case when old and newer is not true then tc else sc end as o_custkey,
           case when old and newer is not true then tp else sp end as price,
           case when old and newer is not true then ta else sa end as changed_at from merged
    """,
)
def _upsert_newer(t: Tables):
    return upsert(_target(t), _feed(t), NEWER_RULE)


@register(
    "upsert_always",
    f"""
    with {MERGE_CTES}
    kept as (select * from target where k not in (select k from source where k is not null))
    select * from kept union all select * from source
    """,
)
def _upsert_always(t: Tables):
    return upsert(_target(t), _feed(t), MergeRule(["k"], ALWAYS, order_by=["changed_at"]))


@register(
    "upsert_stats",
    f"""
    with {MERGE_CTES}
    pairs as (select t.k is not null as old, s.o_custkey is not null as new, s.changed_at > t.changed_at as newer
              from target t full join source s on t.k = s.k)
    select count(*) filter (where old and new and newer) as rows_updated,
           count(*) filter (where not old) as rows_inserted, 0::bigint as rows_deleted,
           count(*) filter (where old and not coalesce(newer, false)) as rows_unchanged from pairs
    """,
)
def _upsert_stats(t: Tables):
    return merge_stats(merge_plan(_target(t), _feed(t), NEWER_RULE))


@register(
    "upsert_delete",
    f"""
    with {MERGE_CTES}
    kept as (select t.* from target t where t.k not in (select k from source where k is not null)),
    changed as (select s.* from source s join target t on s.k = t.k where not (s.price < 100000)),
    added as (select s.* from source s where s.k is null or s.k not in (select k from target))
    select * from kept union all select * from changed union all select * from added where not (price < 100000)
    """,
)
def _upsert_delete(t: Tables):
    """Cheap orders are deletions: a matched row goes, an unmatched one never comes."""
    rule = MergeRule(
        ["k"], ALWAYS, order_by=["changed_at"], delete_condition="source.price < 100000", insert_condition="NOT price < 100000"
    )
    return upsert(_target(t), _feed(t), rule)


PARTIES = """
    select s_suppkey as id, s_name as name, s_acctbal as balance, null::varchar as segment from supplier
    union all select c_custkey, c_name, null, c_mktsegment from customer
"""


def _suppliers(t: Tables):
    return t.supplier.select(
        F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance")
    )


def _customers(t: Tables):
    return t.customer.select(
        F.col("c_mktsegment").alias("segment"), F.col("c_custkey").alias("id"), F.col("c_name").alias("name")
    )


@register("schema_evolve_append", PARTIES)
def _schema_evolve_append(t: Tables):
    return append_evolving(_suppliers(t), _customers(t))


@register(
    "latest_per_key",
    """
    select event_id, ts, user_id, event_type, value from events
    qualify row_number() over (partition by user_id order by ts desc, event_id desc) = 1
    """,
)
def _latest_per_key(t: Tables):
    events = t.events.select("event_id", "ts", "user_id", "event_type", "value")
    return latest_per_key(events, ["user_id"], ["ts", "event_id"])


@register(
    "as_of_snapshot",
    """
    select event_id, ts, user_id, event_type, value from events where ts <= timestamp '2024-01-15 00:00:00'
    qualify row_number() over (partition by user_id order by ts desc, event_id desc) = 1
    """,
)
def _as_of_snapshot(t: Tables):
    events = t.events.select("event_id", "ts", "user_id", "event_type", "value")
    instant = F.lit("2024-01-15 00:00:00").cast("timestamp_ntz")
    return as_of(events, ["user_id"], "ts", instant, ["event_id"])


@register("compact", "select * from lineitem")
def _compact(t: Tables):
    out = scratch_path(t.spark, "compact")
    compact(t.spark, f"{t.directory}/lineitem.parquet", out)
    return t.spark.read.parquet(out)


@register("compact_partitioned", "select * from orders")
def _compact_partitioned(t: Tables):
    loose, out = scratch_path(t.spark, "loose"), scratch_path(t.spark, "compact")
    t.orders.write.partitionBy("o_orderstatus").parquet(loose)
    compact(t.spark, loose, out, partition_by=["o_orderstatus"])
    return t.spark.read.parquet(out).select(*t.orders.columns)


@register("zorder_cluster", "select * from lineitem")
def _zorder_cluster(t: Tables):
    out = scratch_path(t.spark, "zorder")
    files = file_count(t.spark, f"{t.directory}/lineitem.parquet", SORTED_BYTES)
    clustered = zorder_cluster(t.lineitem, ["l_partkey", "l_shipdate"], files, tie_breakers=[file_row()])
    clustered.write.parquet(out)
    return t.spark.read.parquet(out)


@register("write_layout", "select * from orders")
def _write_layout(t: Tables):
    out = scratch_path(t.spark, "layout")
    write_layout(
        t.orders, out, ["o_orderpriority"], sort_by=["o_orderkey"], bloom_columns=["o_custkey"], compression="zstd"
    )
    return t.spark.read.parquet(out).select(*t.orders.columns)


@register(
    "archive_split",
    """
    select o_orderkey, o_orderdate, case when o_orderdate < timestamp '1998-01-01 00:00:00' then 'archive' else 'hot' end
           as tier from orders
    """,
)
def _archive_split(t: Tables):
    hot, archive = write_tiers(
        t.orders, "o_orderdate < timestamp_ntz'1998-01-01 00:00:00'", scratch_path(t.spark, "tiers")
    )
    read = t.spark.read.schema(t.orders.schema)
    parts = [read.parquet(path).withColumn("tier", F.lit(tier)) for path, tier in ((hot, "hot"), (archive, "archive"))]
    return parts[0].unionByName(parts[1]).select("o_orderkey", "o_orderdate", "tier")


ROUTED = """
    select event_id, user_id, value, case when event_type = 'error' then 'incident' when value > 25 then 'large'
           else 'default' end as branch from events
"""


@register("write_branches", ROUTED)
def _write_branches(t: Tables):
    routed = route_rows(t.events, {"incident": "event_type = 'error'", "large": "value > 25"})
    folders = write_branches(routed, "_route", scratch_path(t.spark, "branches"), ["incident", "large", "default"])
    parts = [t.spark.read.parquet(path).withColumn("branch", F.lit(name)) for name, path in folders.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).select("event_id", "user_id", "value", "branch")


@register("path_writer", "select * from supplier")
def _path_writer(t: Tables):
    base = scratch_path(t.spark, "paths")
    PathWriter(base, options={"compression": "zstd"}).write(t.supplier, "suppliers")
    return t.spark.read.parquet(f"{base}/suppliers")


@register("table_writer", "select * from orders union all select * from orders where o_orderstatus = 'F'")
def _table_writer(t: Tables):
    name = fresh_name("written")
    writer = TableWriter(["o_orderpriority"], {"path": scratch_path(t.spark, "tables")})
    writer.write(t.orders, name)
    writer.write(t.orders.filter(F.col("o_orderstatus") == "F"), name, mode="append")
    return t.spark.table(name).select(*t.orders.columns)


@register("create_if_absent", "select * from part")
def _create_if_absent(t: Tables):
    """The second call finds the table and leaves it alone."""
    name = fresh_name("created")
    create_if_absent(t.part, name, ["p_brand"], path=scratch_path(t.spark, "tables"))
    create_if_absent(t.part.filter("p_size > 10"), name, path=scratch_path(t.spark, "tables"))
    return t.spark.table(name).select(*t.part.columns)


@register(
    "create_from_query",
    "select c_nationkey, count(*) as customers, max(c_acctbal) as richest from customer group by c_nationkey",
)
def _create_from_query(t: Tables):
    view, name = fresh_name("customers"), fresh_name("by_nation")
    t.customer.createOrReplaceTempView(view)
    query = f"SELECT c_nationkey, count(*) AS customers, max(c_acctbal) AS richest FROM {view} GROUP BY c_nationkey"
    create_from_query(t.spark, query, name, path=scratch_path(t.spark, "tables"))
    return t.spark.table(name)


@register("table_evolve_append", PARTIES)
def _table_evolve_append(t: Tables):
    """The table gains a column; the files it had before are not rewritten."""
    store, name = TableStore(t.spark, scratch_path(t.spark, "tables")), fresh_name("evolving")
    store.replace(_suppliers(t), name)
    store.append_evolving(_customers(t), name)
    return t.spark.table(name)


def _without_late(t: Tables, *statuses: str):
    """Orders without those of some status placed from 2000 on."""
    late = F.col("o_orderdate") >= F.lit("2000-01-01 00:00:00").cast("timestamp_ntz")
    return t.orders.filter(~(late & F.col("o_orderstatus").isin(*statuses)))


@register(
    "upsert_partitions",
    """
    select o_orderstatus, o_orderkey, case when o_orderstatus = 'F' then 0.0::double else o_totalprice end as o_totalprice
    from orders
    """,
)
def _upsert_partitions(t: Tables):
    """All finished orders change and the later open ones come in: two partitions are rewritten, pending orders are not."""
    store, name = TableStore(t.spark, scratch_path(t.spark, "tables")), fresh_name("by_status")
    columns = ["o_orderstatus", "o_orderkey", "o_totalprice"]
    store.replace(_without_late(t, "F", "O").select(*columns), name, ["o_orderstatus"])
    price = F.when(F.col("o_orderstatus") == "F", F.lit(0.0)).otherwise(F.col("o_totalprice"))
    late = F.col("o_orderdate") >= F.lit("2000-01-01 00:00:00").cast("timestamp_ntz")
    changed = t.orders.filter((F.col("o_orderstatus") == "F") | ((F.col("o_orderstatus") == "O") & late))
    changes = changed.withColumn("o_totalprice", price).select(*columns)
    store.upsert_partitions(name, changes, MergeRule(["o_orderstatus", "o_orderkey"], ALWAYS), ["o_orderstatus"])
    return t.spark.table(name).select(*columns)


@register(
    "upsert_table_stats",
    """
    select count(*) filter (where finished and old) as rows_updated, count(*) filter (where finished and not old) as rows_inserted,
           0::bigint as rows_deleted, count(*) filter (where not finished) as rows_unchanged
    from (select o_orderstatus = 'F' as finished, o_orderdate < timestamp '2000-01-01 00:00:00' as old from orders)
    """,
)
def _upsert_table_stats(t: Tables):
    """Statistics of a published merge, as counted by the tasks that wrote its files."""
    store, name = TableStore(t.spark, scratch_path(t.spark, "tables")), fresh_name("merged")
    store.replace(_without_late(t, "F"), name)
    finished = t.orders.filter(F.col("o_orderstatus") == "F")
    stats = store.upsert(name, finished, MergeRule(["o_orderkey"], ALWAYS))
    return t.spark.createDataFrame([tuple(asdict(stats).values())], ", ".join(f"{c} bigint" for c in asdict(stats)))


@register(
    "widen_append",
    """
    select s_suppkey::bigint as id, s_acctbal::double as amount, timestamp '2024-01-01 00:00:00' as since, null::varchar as note
    from supplier
    union all select o_orderkey::bigint, o_totalprice, o_orderdate, o_orderpriority from orders
    """,
)
def _widen_append(t: Tables):
    """A table of int, float and date takes in rows of bigint, double and timestamp, and one more column."""
    store, name = TableStore(t.spark, scratch_path(t.spark, "tables")), fresh_name("widened")
    # Whole amounts are exact as floats; the supplier's own ones come back by a second append.
    old = t.supplier.select(
        F.col("s_suppkey").cast("int").alias("id"), F.lit(0.0).cast("float").alias("amount"), F.lit("2024-01-01").cast("date").alias("since")
    )
    store.replace(old.limit(0), name)
    narrow = t.supplier.select(F.col("s_suppkey").cast("int").alias("id"), F.lit("2024-01-01").cast("date").alias("since"), "s_acctbal")
    store.append_widening(narrow.withColumnRenamed("s_acctbal", "amount"), name)
    wide = t.orders.select(
        F.col("o_orderkey").cast("bigint").alias("id"), F.col("o_totalprice").alias("amount"),
        F.col("o_orderdate").alias("since"), F.col("o_orderpriority").alias("note"),
    )
    store.append_widening(wide, name)
    return t.spark.table(name)


#: Stored bytes of the orders that make one part of ``compact_files``.
PART_BYTES = 64 * MIB


def _orders_index(t: Tables, name: str, spread) -> FileIndex:
    index = FileIndex(t.spark, scratch_path(t.spark, name), t.orders.schema, ["o_orderpriority", "o_orderdate", "o_custkey"])
    index.start_from(spread(t.orders))
    return index


@register(
    "compact_files",
    """
    select 2 * count(*) as row_count, 2 * sum(o_orderkey)::bigint as key_sum, 13 as files_before, 12 as small_before, true as fewer_files,
           true as fewer_small_files, true as large_file_kept, true as only_small_rewritten from orders
    """,
)
def _compact_files(t: Tables):
    """Each part of the orders once as twelve small files and once as a large one: the small ones are packed, the large one stays by
    reference.  Parts follow the table's size, so that no file does; the file counts are those of a part."""
    parts = file_count(t.spark, f"{t.directory}/orders.parquet", PART_BYTES)
    part = F.pmod(F.xxhash64(F.lit("part"), "o_orderkey"), F.lit(parts)).cast("int")
    piece = F.pmod(F.xxhash64(F.lit("piece"), "o_orderkey"), F.lit(12)).cast("int")
    index = _orders_index(t, "compact", lambda orders: orders.repartitionById(parts, part))
    large = index.files().collect()
    index.append(t.orders.repartitionById(12 * parts, 12 * part + piece))
    done = index.compact(target_bytes=max(f.bytes for f in large))
    facts = index.read().agg(F.count(F.lit(1)).alias("row_count"), F.sum("o_orderkey").cast("bigint").alias("key_sum"))
    kept = index.files().filter(F.col("path").isin([f.path for f in large])).count() == len(large)
    return facts.select(
        "*",
        (F.lit(done.files_before) / parts).cast("int").alias("files_before"),
        (F.lit(done.small_before) / parts).cast("int").alias("small_before"),
        F.lit(done.files_after < done.files_before).alias("fewer_files"),
        F.lit(done.small_after < done.small_before).alias("fewer_small_files"),
        F.lit(kept).alias("large_file_kept"),
        F.lit(0 < done.bytes_rewritten <= done.bytes_total - sum(f.bytes for f in large)).alias("only_small_rewritten"),
    )


@register(
    "zorder_probe",
    """
    with probes as (
        select 'priority' as probe, count(*) as matching from orders where o_orderpriority = '1-URGENT'
        union all select 'date', count(*) from orders
        where o_orderdate between timestamp '1998-01-01 00:00:00' and timestamp '1998-06-30 00:00:00'
        union all select 'both', count(*) from orders where o_orderpriority = '1-URGENT'
        and o_orderdate between timestamp '1998-01-01 00:00:00' and timestamp '1998-06-30 00:00:00')
    select probe, matching, true as same_rows, true as all_read_before, true as few_read_after, 16::bigint as files from probes
    """,
)
def _zorder_probe(t: Tables):
    """Sixteen files before and after clustering by a string and a time: what range probes read, and that they lose nothing."""
    index = _orders_index(t, "zorder", lambda orders: orders.repartition(16, "o_orderkey"))

    def at(text: str):
        return F.lit(text).cast("timestamp_ntz")

    urgent = {"o_orderpriority": (F.lit("1-URGENT"), F.lit("1-URGENT"))}
    months = {"o_orderdate": (at("1998-01-01 00:00:00"), at("1998-06-30 00:00:00"))}
    probes = {"priority": urgent, "date": months, "both": {**urgent, **months}}
    before = {name: (index.probe(ranges).head(), index.between(ranges).count()) for name, ranges in probes.items()}
    index.cluster(["o_orderpriority", "o_orderdate"], 16)
    rows = []
    for name, ranges in probes.items():
        (old, found), new, matching = before[name], index.probe(ranges).head(), index.between(ranges).count()
        rows.append((name, matching, matching == found, old.rows_read == old.rows, 2 * new.rows_read < old.rows_read, new.files))
    schema = "probe string, matching long, same_rows boolean, all_read_before boolean, few_read_after boolean, files long"
    return t.spark.createDataFrame(rows, schema)


@register(
    "write_layout_facts",
    """
    select o_orderpriority, count(*) as row_count, min(o_orderkey) as first_key, max(o_orderkey) as last_key, true as sorted from orders group by 1
    """,
)
def _write_layout_facts(t: Tables):
    """Rows per partition folder, and that each file is sorted."""
    out = scratch_path(t.spark, "layout")
    write_layout(t.orders, out, ["o_orderpriority"], sort_by=["o_orderkey"], bloom_columns=["o_custkey"])
    place = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("at")]
    rows = t.spark.read.parquet(out).select("o_orderpriority", "o_orderkey", *place)
    ahead = rows.select("file", (F.col("at") - 1).alias("at"), F.col("o_orderkey").alias("next_key"))
    pairs = rows.join(ahead, ["file", "at"], "left")
    return pairs.groupBy("o_orderpriority").agg(
        F.count(F.lit(1)).alias("row_count"),
        F.min("o_orderkey").alias("first_key"),
        F.max("o_orderkey").alias("last_key"),
        F.coalesce(F.bool_and(F.col("o_orderkey") <= F.col("next_key")), F.lit(True)).alias("sorted"),
    )


@register(
    "lineage_edges",
    """
    select source_table, target_table, max(l_shipdate) as last_seen, count(*) as runs from (
        select 'part_' || l_partkey as source_table, 'order_' || l_orderkey as target_table, l_shipdate from lineitem
        union all select 'supplier_' || l_suppkey, 'order_' || l_orderkey, l_shipdate from lineitem) group by 1, 2
    """,
)
def _lineage_edges(t: Tables):
    """Each line item is a run that built an order from a part and a supplier."""
    runs = t.lineitem.select(
        F.concat(F.lit("order_"), "l_orderkey").alias("target"),
        F.array(F.concat(F.lit("part_"), "l_partkey"), F.concat(F.lit("supplier_"), "l_suppkey")).alias("sources"),
        "l_shipdate",
    )
    return lineage_edges(runs, "target", "sources", "l_shipdate")


@register(
    "lineage_downstream",
    """
    with recursive edges as (
        select 'part_' || (p_partkey // 2) as source_table, 'part_' || p_partkey as target_table from part
        union all select 'part_' || p_partkey, 'part_3' from part where p_size = 1),
    reached(table_name) as (
        select target_table from edges where source_table = 'part_3'
        union select target_table from edges join reached on source_table = table_name)
    select table_name from reached
    """,
)
def _lineage_downstream(t: Tables):
    """Parts form a binary tree by number, with some edges back to part 3: a graph with cycles."""
    name = F.concat(F.lit("part_"), "p_partkey")
    tree = t.part.select(F.expr("concat('part_', p_partkey div 2)").alias("source_table"), name.alias("target_table"))
    back = t.part.filter(F.col("p_size") == 1).select(name, F.lit("part_3"))
    return downstream(tree.union(back), "part_3")


@register(
    "run_reliability",
    """
    select user_id, count(*) as runs, count(*) filter (where event_type <> 'error') as succeeded,
           count(*) filter (where event_type <> 'error')::double / count(*) as success_rate
    from events group by user_id
    """,
)
def _run_reliability(t: Tables):
    return run_reliability(t.events, ["user_id"], F.col("event_type") != "error")


@register(
    "run_mttr",
    """
    with marked as (
        select user_id, event_type = 'error' as failed, epoch_us(ts) as us,
               min(case when event_type <> 'error' then epoch_us(ts) end) over (
                   partition by user_id order by ts, event_id rows between 1 following and unbounded following) as next
        from events)
    select user_id, count(*) filter (where failed) as failures,
           count(*) filter (where failed and next is not null) as recovered,
           round(sum(next - us) filter (where failed)::double
                 / nullif(count(*) filter (where failed and next is not null), 0) / 1e6, 3) as mttr_seconds
    from marked group by user_id
    """,
)
def _run_mttr(t: Tables):
    mttr = recovery_time(t.events, "user_id", "ts", F.col("event_type") != "error", "event_id")
    return mttr.withColumn("mttr_seconds", F.round("mttr_seconds", 3))


@register(
    "cost_per_unit",
    """
    select ts::date::varchar as day, round(sum(value), 4) as total_cost,
           sum(regexp_extract(props, '[0-9]+')::bigint)::bigint as total_units,
           round(sum(value) / nullif(sum(regexp_extract(props, '[0-9]+')::bigint), 0)::double, 6)
           as cost_per_unit
    from events group by 1
    """,
)
def _cost_per_unit(t: Tables):
    units = F.regexp_extract("props", "[0-9]+", 0).cast("bigint")
    costs = cost_per_unit(t.events, [F.to_date("ts").cast("string").alias("day")], "value", units)
    return costs.withColumns({"total_cost": F.round("total_cost", 4), "cost_per_unit": F.round("cost_per_unit", 6)})


@register(
    "run_durations",
    """
    with periods as (
        select user_id, date_diff('day', date '2024-01-01', ts::date)::integer // 7 as period, count(*) as n,
               quantile_cont(value, 0.5) as p50, quantile_cont(value, 0.95) as p95 from events group by 1, 2)
    select p.user_id, p.period::integer as period, p.n, round(p.p50, 6) as p50, round(p.p95, 6) as p95,
           round(b.p50, 6) as previous_p50, coalesce(p.p50 > b.p50 * 1.5, false) as regressed
    from periods p left join periods b on b.user_id = p.user_id and b.period = p.period - 1
    """,
)
def _run_durations(t: Tables):
    week = F.floor(F.datediff("ts", F.lit("2024-01-01").cast("date")) / 7)
    compared = run_durations(t.events, "user_id", week, "value", 1.5)
    return compared.withColumns({c: F.round(c, 6) for c in ("p50", "p95", "previous_p50")})
