"""Sources, cleaning and enrichment."""

from __future__ import annotations

from pyspark.sql import functions as F

from pipekit.operators.clean import Cleaner, DropNulls, StandardizeText, chain
from pipekit.operators.enrich import Enricher, Lookup, lookup_join
from pipekit.operators.gold import customer_360, daily_revenue, user_features
from pipekit.plans.registry import Tables, register
from pipekit.session import scratch_path
from pipekit.sources.page_chain import page_chain
from pipekit.sources import apply_types, first_row, parameterized, read_pages, since


@register(
    "customer_360",
    """
    select c_custkey, c_name, c_mktsegment, n_name, r_name,
           coalesce(n_orders, 0) as n_orders, coalesce(total_spent, 0.0::double) as total_spent, last_order
    from customer
    left join nation on c_nationkey = n_nationkey
    left join region on n_regionkey = r_regionkey
    left join (select o_custkey, count(*) as n_orders, max(o_orderdate) as last_order,
                      round(sum(o_totalprice), 2) as total_spent
               from orders group by o_custkey) on c_custkey = o_custkey
    """,
)
def _customer_360(t: Tables):
    return customer_360(t.customer, t.nation, t.region, t.orders)


@register(
    "gold_daily_revenue",
    """
    select o_orderdate::date::varchar as order_date, count(distinct o_orderkey) as n_orders, count(*) as n_lines,
           round(sum(l_extendedprice * (1 - l_discount)), 4) as revenue
    from orders join lineitem on o_orderkey = l_orderkey group by 1
    """,
)
def _daily_revenue(t: Tables):
    return daily_revenue(t.orders, t.lineitem).withColumn("order_date", F.col("order_date").cast("string"))


@register(
    "user_features",
    """
    select user_id, count(*) as n_events, count(*) filter (where event_type = 'purchase') as n_purchases,
           count(*) filter (where event_type = 'error') as n_errors,
           coalesce(round(sum(value) filter (where event_type = 'purchase'), 2), 0.0) as spend,
           min(ts) as first_seen, max(ts) as last_seen
    from events group by user_id
    """,
)
def _user_features(t: Tables):
    return user_features(t.events)


@register("incremental_read", "select * from orders where o_orderdate > timestamp '1998-06-01 00:00:00'")
def _incremental_read(t: Tables):
    return since(t.orders, "o_orderdate", "1998-06-01 00:00:00")


@register(
    "parameterized_query",
    """
    select l_orderkey, l_linenumber, l_quantity, l_shipdate from lineitem
    where l_returnflag = 'A' and l_quantity >= 25 and l_shipdate < timestamp '1999-01-01 00:00:00'
    """,
)
def _parameterized_query(t: Tables):
    return parameterized(
        t.spark,
        """
        SELECT l_orderkey, l_linenumber, l_quantity, l_shipdate FROM {lineitem}
        WHERE l_returnflag = :flag AND l_quantity >= :least AND l_shipdate < CAST(:before AS timestamp_ntz)
        """,
        {"flag": "A", "least": 25, "before": "1999-01-01 00:00:00"},
        lineitem=t.lineitem,
    )


@register("first_row", "select * from orders order by o_totalprice desc, o_orderkey limit 1")
def _first_row(t: Tables):
    """The dearest order."""
    return first_row(t.orders.orderBy(F.desc("o_totalprice"), "o_orderkey"))


@register("paged_entities", "select c_custkey, c_name, c_nationkey, c_acctbal from customer")
def _paged_entities(t: Tables):
    """Customers exported in pages of a hundred, as an entity service would, and read back."""
    entity = F.struct("c_custkey", "c_name", "c_nationkey", "c_acctbal")
    pages = t.customer.groupBy(F.expr("c_custkey div 100").alias("page")).agg(F.collect_list(entity).alias("value"))
    landed = scratch_path(t.spark, "pages")
    pages.select("value").write.json(landed)
    schema = "c_custkey: bigint, c_name: string, c_nationkey: int, c_acctbal: double"
    return read_pages(t.spark, landed, schema, multi_line=False)


@register(
    "page_chain",
    """
    with recursive landed as (
        select distinct c_custkey // 50 as page,
               case c_custkey // 50 % 10 when 5 then null when 8 then c_custkey // 50 - 2 else c_custkey // 50 + 1 end as next
        from customer where c_custkey // 50 % 10 <> 3),
    before as (select next as page, min(page) as before from landed where next is not null group by 1),
    walk(page, start, position) as (
        select page, page, 0::bigint from landed where page not in (select page from before)
        union all
        select l.page, w.start, w.position + 1 from walk w join before b on b.before = w.page join landed l on l.page = b.page)
    select l.page, coalesce(w.start, l.page // 10 * 10 + 6) as start, w.position, l.next,
           case when w.page is null then 'cycle'
                when l.next is not null and l.next not in (select page from landed) then 'gap'
                when b.before <> l.page then 'fork'
                when w.position = 0 and l.page <> (select min(page) from walk where position = 0) then 'second chain' end as fault
    from landed l left join walk w on w.page = l.page left join before b on b.page = l.next
    """,
)
def _page_chain(t: Tables):
    """Customers in pages of fifty, each naming the next one.  Of every ten pages one was not landed, one ends the chain
    and one leads back."""
    page = F.expr("c_custkey div 50")
    last = F.col("page") % 10
    named = F.when(last == 8, F.col("page") - 2).when(last != 5, F.col("page") + 1)
    entity = F.struct("c_custkey", "c_name")
    pages = t.customer.groupBy(page.alias("page")).agg(F.collect_list(entity).alias("value")).withColumn("next", named)
    landed = scratch_path(t.spark, "chain")
    pages.filter(last != 3).write.json(landed)
    return page_chain(t.spark.read.schema("page long, next long").json(landed))


@register(
    "type_mapping",
    """
    select p_partkey::varchar as p_partkey, try_cast(substr(p_brand, 7) as integer) as brand_no,
           try_cast(case when p_size > 40 then 'n/a' else p_size::varchar end as integer) as size_text,
           round(p_retailprice)::bigint as p_retailprice,
           case when p_size > 40 then 'size_text' else '' end as bad_types
    from part
    """,
)
def _type_mapping(t: Tables):
    raw = t.part.select(
        "p_partkey",
        F.substr("p_brand", F.lit(7)).alias("brand_no"),
        F.when(F.col("p_size") > 40, "n/a").otherwise(F.col("p_size").cast("string")).alias("size_text"),
        # A cast to bigint truncates in Spark and rounds in the oracle; whole numbers suit both.
        F.round("p_retailprice").alias("p_retailprice"),
    )
    types = {"p_partkey": "string", "brand_no": "int", "size_text": "int", "p_retailprice": "bigint"}
    typed = apply_types(raw, types, on_error="flag")
    return typed.withColumn("bad_types", F.array_join("_bad_types", ",")).drop("_bad_types")


def dirty_customers(t: Tables):
    """Customers with NULLs and padding: the shared tables have neither."""
    return t.customer.select(
        "c_custkey",
        F.nullif("c_mktsegment", F.lit("BUILDING")).alias("c_mktsegment"),
        F.nullif("c_nationkey", F.lit(7)).alias("c_nationkey"),
        F.concat(F.lit("  "), "c_name", F.lit(" ")).alias("c_name"),
        "c_acctbal",
    )


DIRTY_CUSTOMERS = """
    (select c_custkey, nullif(c_mktsegment, 'BUILDING') as c_mktsegment, nullif(c_nationkey, 7) as c_nationkey,
            '  ' || c_name || ' ' as c_name, c_acctbal from customer)
"""


@register(
    "clean_drop_nulls",
    f"select * from {DIRTY_CUSTOMERS} where c_mktsegment is not null and c_nationkey is not null",
)
def _clean_drop_nulls(t: Tables):
    return dirty_customers(t).transform(DropNulls(["c_mktsegment", "c_nationkey"]))


@register("clean_trim", f"select * replace (trim(c_name) as c_name) from {DIRTY_CUSTOMERS}")
def _clean_trim(t: Tables):
    return dirty_customers(t).transform(StandardizeText(["c_name"], "trim"))


@register("clean_upper", "select * replace (upper(p_name) as p_name, upper(p_brand) as p_brand) from part")
def _clean_upper(t: Tables):
    return t.part.transform(StandardizeText(["p_name", "p_brand"], "upper"))


@register("clean_lower", "select * replace (lower(s_name) as s_name) from supplier")
def _clean_lower(t: Tables):
    return t.supplier.transform(StandardizeText(["s_name"], "lower"))


@register(
    "clean_chain",
    f"""
    select * replace (upper(trim(c_name)) as c_name, lower(c_mktsegment) as c_mktsegment)
    from {DIRTY_CUSTOMERS} where c_mktsegment is not null
    """,
)
def _clean_chain(t: Tables):
    cleaner = Cleaner([DropNulls(["c_mktsegment"]), StandardizeText(["c_name"], "trim")])
    cleaner.add(StandardizeText(["c_name"], "upper")).add(StandardizeText(["c_mktsegment"], "lower"))
    return dirty_customers(t).transform(cleaner)


def _customer_lookup(t: Tables):
    """Customers in debt are missing from the lookup, so some orders stay unmatched."""
    return t.customer.filter(F.col("c_acctbal") >= 0).withColumnRenamed("c_custkey", "o_custkey")


@register(
    "enrich_lookup",
    """
    select orders.*, c_name, c_nationkey
    from orders left join (select * from customer where c_acctbal >= 0) on o_custkey = c_custkey
    """,
)
def _enrich_lookup(t: Tables):
    return lookup_join(t.orders, _customer_lookup(t), "o_custkey", ["c_name", "c_nationkey"])


@register(
    "enrich_chain",
    """
    select orders.*, c_name, c_nationkey, n_name, n_regionkey
    from orders
    left join (select * from customer where c_acctbal >= 0) on o_custkey = c_custkey
    left join nation on c_nationkey = n_nationkey
    """,
)
def _enrich_chain(t: Tables):
    nations = t.nation.withColumnRenamed("n_nationkey", "c_nationkey")
    enricher = Enricher().add(
        "customer", Lookup(_customer_lookup(t), "o_custkey", ["c_name", "c_nationkey"], on_duplicate="error")
    )
    enricher.add("nation", Lookup(nations, "c_nationkey", ["n_name", "n_regionkey"], on_duplicate="first"))
    return chain(t.orders, [enricher])


@register(
    "enrich_hot_keys",
    """
    select l_orderkey, l_linenumber, l_quantity, part_key, p_name, p_brand
    from (select *, case when l_returnflag = 'R' then 3 when l_quantity < 5 then null else l_partkey end
                    as part_key from lineitem)
    left join (select * from part where p_size > 10) on part_key = p_partkey
    """,
)
def _enrich_hot_keys(t: Tables):
    """Returned lines, a third of all, refer to one part, and small ones to none: the hot part never shuffles."""
    key = F.when(F.col("l_returnflag") == "R", F.lit(3)).when(F.col("l_quantity") < 5, F.lit(None))
    lines = t.lineitem.select("l_orderkey", "l_linenumber", "l_quantity", key.otherwise(F.col("l_partkey")).alias("part_key"))
    parts = t.part.filter(F.col("p_size") > 10).withColumnRenamed("p_partkey", "part_key")
    return lookup_join(lines, parts, "part_key", ["p_name", "p_brand"], on_duplicate="first", split_hot_keys=True)
