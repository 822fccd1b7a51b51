"""Rules, expectations, statistics, access control."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from pipekit.operators.access import (
    RowPolicy,
    classify_columns,
    entitled,
    filter_by_level,
    mask_columns,
    route_rows,
    secure,
)
from pipekit.operators.expectations import ExpectationSuite, ExpectNonNull, ExpectUnique, SchemaExpectation
from pipekit.operators.percentiles import exact_percentiles
from pipekit.operators.rules import (
    QualityRule,
    expect_or_drop,
    expect_or_fail,
    failing_rows,
    quality_alerts,
    quality_gate,
    quality_report,
    split_quarantine,
    tag_failures,
    validate_table,
)
from pipekit.operators.sketches import daily_sketches, merged_stats
from pipekit.operators.stats import column_stats, freshness
from pipekit.plans.ingest_queries import DIRTY_CUSTOMERS, dirty_customers
from pipekit.operators.unique_index import UniqueKeyIndex
from pipekit.plans.registry import Tables, fresh_name, register
from pipekit.session import scratch_path
from pipekit.sinks import TableStore

CUSTOMER_RULES = [
    QualityRule("balance_not_negative", "c_acctbal >= 0", "no debts", 0.1, "warning"),
    QualityRule("has_nation", "c_nationkey IS NOT NULL", "nation known", 0.0, "error"),
    QualityRule("known_segment", "c_mktsegment IN ('AUTOMOBILE', 'MACHINERY', 'HOUSEHOLD')", "segment", 0.5, "info"),
    QualityRule("named", "c_name RLIKE 'Customer#[0-9]+'", "name has the usual form"),
    QualityRule("segment_strict", "c_mktsegment <> 'FURNITURE'", "NULL fails too", 0.25, "error", null_fails=True),
]

CUSTOMER_COUNTS = f"""
    (select count(*) as total, unnest([
        {{'rule_name': 'balance_not_negative', 'description': 'no debts', 'severity': 'warning', 'allowed': 0.1::double,
          'failed': count(*) filter (where not (c_acctbal >= 0))}},
        {{'rule_name': 'has_nation', 'description': 'nation known', 'severity': 'error', 'allowed': 0.0::double,
          'failed': count(*) filter (where not (c_nationkey is not null))}},
        {{'rule_name': 'known_segment', 'description': 'segment', 'severity': 'info', 'allowed': 0.5::double,
          'failed': count(*) filter (where not (c_mktsegment in ('AUTOMOBILE', 'MACHINERY', 'HOUSEHOLD')))}},
        {{'rule_name': 'named', 'description': 'name has the usual form', 'severity': 'error', 'allowed': 0.0::double,
          'failed': count(*) filter (where not regexp_matches(c_name, 'Customer#[0-9]+'))}},
        {{'rule_name': 'segment_strict', 'description': 'NULL fails too', 'severity': 'error', 'allowed': 0.25::double,
          'failed': count(*) filter (where not coalesce(c_mktsegment <> 'FURNITURE', false))}}]) as r
     from {DIRTY_CUSTOMERS})
"""


@register(
    "rule_failures",
    """
    select rule_name, failed_records, coalesce(failed_records::double / total, 0.0::double) as failure_rate from (
        select count(*) as total, unnest([
            {'rule_name': 'cheap', 'failed_records': count(*) filter (where not (value < 30))},
            {'rule_name': 'no_error', 'failed_records': count(*) filter (where not (event_type <> 'error'))},
            {'rule_name': 'january', 'failed_records': count(*) filter (where not
                (ts between timestamp '2024-01-02 00:00:00' and timestamp '2024-01-31 00:00:00'))}], recursive := true)
        from events)
    """,
)
def _rule_failures(t: Tables):
    rules = [
        QualityRule("cheap", "value < 30"),
        QualityRule("no_error", "event_type <> 'error'"),
        QualityRule("january", "ts BETWEEN timestamp_ntz'2024-01-02 00:00:00' AND timestamp_ntz'2024-01-31 00:00:00'"),
    ]
    return quality_report(t.events, rules).select("rule_name", "failed_records", "failure_rate")


@register(
    "quality_report",
    f"""
    select r.rule_name, r.description, r.severity, total as total_records, r.failed as failed_records,
           r.failed::double / total as failure_rate, r.allowed as max_failure_rate,
           r.failed::double / total <= r.allowed as passed, 'ok' as status
    from {CUSTOMER_COUNTS}
    union all
    select 'broken', 'no such column', 'error', count(*), null, null, 0.0::double, false, 'error' from customer
    """,
)
def _quality_report(t: Tables):
    rules = [*CUSTOMER_RULES, QualityRule("broken", "no_such_column > 0", "no such column")]
    return quality_report(dirty_customers(t), rules).drop("error")


@register(
    "quality_gate",
    f"""
    select bool_and(r.failed = 0) as passed, min(r.rule_name) filter (where r.failed > 0) as first_failed_rule
    from {CUSTOMER_COUNTS} where r.rule_name in ('named', 'has_nation')
    """,
)
def _quality_gate(t: Tables):
    named, has_nation = CUSTOMER_RULES[3], CUSTOMER_RULES[1]
    return quality_gate(dirty_customers(t), [named, has_nation])


@register(
    "quality_alerts",
    f"""
    select r.rule_name, case r.severity when 'error' then 'critical' when 'warning' then 'warning' else 'notice' end
           as level, r.rule_name || ': ' || r.failed || ' of ' || total || ' records' as message
    from {CUSTOMER_COUNTS} where r.failed::double / total > r.allowed
    """,
)
def _quality_alerts(t: Tables):
    return quality_alerts(quality_report(dirty_customers(t), CUSTOMER_RULES))


@register(
    "expect_non_null",
    f"""
    select 'non_null_c_mktsegment,c_nationkey' as expectation, 'error' as severity, m.metric, m.value, m.max_value,
           coalesce(m.value <= m.max_value, true) as passed
    from (select unnest([
        {{'metric': 'c_mktsegment_null_count', 'value': count(*) filter (where c_mktsegment is null)::double,
          'max_value': null::double}},
        {{'metric': 'c_mktsegment_null_rate', 'value': count(*) filter (where c_mktsegment is null)::double / count(*),
          'max_value': 0.1::double}},
        {{'metric': 'c_nationkey_null_count', 'value': count(*) filter (where c_nationkey is null)::double,
          'max_value': null::double}},
        {{'metric': 'c_nationkey_null_rate', 'value': count(*) filter (where c_nationkey is null)::double / count(*),
          'max_value': 0.1::double}}]) as m
        from {DIRTY_CUSTOMERS})
    """,
)
def _expect_non_null(t: Tables):
    return ExpectationSuite([ExpectNonNull(["c_mktsegment", "c_nationkey"], 0.1)]).report(dirty_customers(t))


UNIQUE_LINES = """
    select 'unique_l_orderkey,line' as expectation, 'error' as severity, m.metric, m.value, m.max_value,
           coalesce(m.value <= m.max_value, true) as passed
    from (select unnest([
        {'metric': 'total_rows', 'value': count(*)::double, 'max_value': null::double},
        {'metric': 'unique_rows', 'value': count(distinct (l_orderkey, nullif(l_linenumber, 3)))::double,
         'max_value': null::double},
        {'metric': 'duplicate_count', 'value': (count(*) - count(distinct (l_orderkey, nullif(l_linenumber, 3))))::double,
         'max_value': 0.0::double}]) as m
        from lineitem)
"""


def _lines(t: Tables):
    return t.lineitem.withColumn("line", F.nullif("l_linenumber", F.lit(3)))


@register("expect_unique", UNIQUE_LINES)
def _expect_unique(t: Tables):
    return ExpectationSuite([ExpectUnique(["l_orderkey", "line"])]).report(_lines(t))


@register(
    "expectation_suite",
    UNIQUE_LINES
    + """
    union all
    select 'non_null_line', 'warning', m.metric, m.value, m.max_value, coalesce(m.value <= m.max_value, true)
    from (select unnest([
        {'metric': 'line_null_count', 'value': count(*) filter (where l_linenumber = 3)::double, 'max_value': null::double},
        {'metric': 'line_null_rate', 'value': count(*) filter (where l_linenumber = 3)::double / count(*),
         'max_value': 0.0::double}]) as m from lineitem)
    """,
)
def _expectation_suite(t: Tables):
    suite = ExpectationSuite([ExpectUnique(["l_orderkey", "line"]), ExpectNonNull(["line"], severity="warning")])
    return suite.report(_lines(t))


@register(
    "expectation_suite_split",
    """
    with lines as (select count(*)::double as total, count(distinct (l_orderkey, l_linenumber))::double as pairs,
                          count(distinct l_partkey)::double as parts,
                          count(*) filter (where l_returnflag is null)::double as missing from lineitem)
    select 'unique_l_orderkey,l_linenumber' as expectation, 'total_rows' as metric, total as value from lines
    union all select 'unique_l_orderkey,l_linenumber', 'unique_rows', pairs from lines
    union all select 'unique_l_orderkey,l_linenumber', 'duplicate_count', total - pairs from lines
    union all select 'unique_l_partkey', 'total_rows', total from lines
    union all select 'unique_l_partkey', 'unique_rows', parts from lines
    union all select 'unique_l_partkey', 'duplicate_count', total - parts from lines
    union all select 'non_null_l_returnflag', 'l_returnflag_null_count', missing from lines
    union all select 'non_null_l_returnflag', 'l_returnflag_null_rate', missing / total from lines
    """,
)
def _expectation_suite_split(t: Tables):
    """Two distinct sets: each is counted by its own pruned scan, the plain counters share a third."""
    suite = ExpectationSuite(
        [ExpectUnique(["l_orderkey", "l_linenumber"]), ExpectUnique(["l_partkey"]), ExpectNonNull(["l_returnflag"])]
    )
    return suite.report(t.lineitem).select("expectation", "metric", "value")


SHIP_RULES = [
    QualityRule("big_enough", "l_quantity > 5"),
    QualityRule("flag_known", "flag <> 'R'"),
    QualityRule("ships_after_order", "l_shipdate >= o_orderdate"),
]


def _shipped(t: Tables):
    orders = t.orders.select(F.col("o_orderkey").alias("l_orderkey"), "o_orderdate")
    lines = t.lineitem.withColumn("flag", F.nullif("l_returnflag", F.lit("N")))
    kept = lines.select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_shipdate", "flag")
    return kept.join(orders, "l_orderkey")


SHIPPED = """
    (select l_orderkey, l_linenumber, l_partkey, l_quantity, l_shipdate, nullif(l_returnflag, 'N') as flag, o_orderdate
     from lineitem join orders on l_orderkey = o_orderkey)
"""


@register(
    "expect_or_drop",
    f"""
    select * from {SHIPPED}
    where l_quantity > 5 and coalesce(flag <> 'R', true) and l_shipdate >= o_orderdate
    """,
)
def _expect_or_drop(t: Tables):
    return expect_or_drop(_shipped(t), SHIP_RULES)


@register(
    "quarantine",
    f"""
    select *, concat_ws(',', case when not (l_quantity > 5) then 'big_enough' end,
                        case when not (flag <> 'R') then 'flag_known' end,
                        case when not (l_shipdate >= o_orderdate) then 'ships_after_order' end) as failed_rules
    from {SHIPPED} where not (l_quantity > 5) or not (flag <> 'R') or not (l_shipdate >= o_orderdate)
    """,
)
def _quarantine(t: Tables):
    _, quarantined = split_quarantine(_shipped(t), SHIP_RULES)
    return quarantined.withColumn("failed_rules", F.array_join("_failed_rules", ",")).drop("_failed_rules")


@register(
    "quarantine_summary",
    f"""
    select case when failed_rules = '' then 'valid' else failed_rules end as outcome, count(*) as n_rows from (
        select concat_ws(',', case when not (l_quantity > 5) then 'big_enough' end,
                         case when not (flag <> 'R') then 'flag_known' end,
                         case when not (l_shipdate >= o_orderdate) then 'ships_after_order' end) as failed_rules
        from {SHIPPED}) group by 1
    """,
)
def _quarantine_summary(t: Tables):
    names = F.array_join("_failed_rules", ",")
    outcome = F.when(F.size("_failed_rules") == 0, F.lit("valid")).otherwise(names).alias("outcome")
    return tag_failures(_shipped(t), SHIP_RULES).groupBy(outcome).agg(F.count(F.lit(1)).alias("n_rows"))


@register("expect_or_fail", "select o_orderkey, o_custkey, o_totalprice, true as other_rule_stopped from orders")
def _expect_or_fail(t: Tables):
    """Every order passes the first rules; the last one fails for some, which stops its job."""
    orders = t.orders.select("o_orderkey", "o_custkey", "o_totalprice")
    rules = [QualityRule("price", "o_totalprice > 0"), QualityRule("key", "o_orderkey >= 0")]
    try:
        expect_or_fail(orders, [*rules, QualityRule("cheap", "o_totalprice < 100000")]).agg(F.max("o_totalprice")).collect()
        stopped = False
    except Exception as error:  # noqa: BLE001 - the rule's name is in the message
        stopped = "cheap" in str(error)
    return expect_or_fail(orders, rules).withColumn("other_rule_stopped", F.lit(stopped))


@register("failing_rows", "select * from customer where not (c_acctbal >= 0) or not (c_mktsegment <> 'BUILDING')")
def _failing_rows(t: Tables):
    rules = [QualityRule("balance", "c_acctbal >= 0"), QualityRule("segment", "c_mktsegment <> 'BUILDING'")]
    return failing_rows(t.customer, rules)


@register(
    "freshness",
    """
    select event_type, max(ts) as latest,
           datesub('hour', max(ts), timestamp '2024-01-31 02:30:00') as delay_hours,
           case when datesub('hour', max(ts), timestamp '2024-01-31 02:30:00') > 3 then 'STALE' else 'FRESH' end
           as freshness_status
    from events group by event_type
    """,
)
def _freshness(t: Tables):
    return freshness(t.events, "ts", 3, F.lit("2024-01-31 02:30:00").cast("timestamp_ntz"), by=["event_type"])


@register(
    "column_stats",
    f"""
    select 'c_mktsegment' as column_name, count(*) as row_count, count(*) - count(c_mktsegment) as null_count,
           (count(*) - count(c_mktsegment))::double / count(*) as null_rate, min(c_mktsegment) as min_value,
           max(c_mktsegment) as max_value, count(distinct c_mktsegment) as distinct_count from {DIRTY_CUSTOMERS}
    union all
    select 'c_nationkey', count(*), count(*) - count(c_nationkey), (count(*) - count(c_nationkey))::double / count(*),
           min(c_nationkey)::varchar, max(c_nationkey)::varchar, count(distinct c_nationkey) from {DIRTY_CUSTOMERS}
    union all
    select 'c_name', count(*), 0, 0.0::double, min(c_name), max(c_name), count(distinct c_name) from {DIRTY_CUSTOMERS}
    """,
)
def _column_stats(t: Tables):
    return column_stats(dirty_customers(t), ["c_mktsegment", "c_nationkey", "c_name"], exact_distinct=True)


@register(
    "freshness_now",
    "select event_type, max(ts) as latest, 'STALE' as freshness_status from events group by event_type",
)
def _freshness_now(t: Tables):
    """Against the clock: the events are years old."""
    return freshness(t.events, "ts", 24, by=["event_type"]).drop("delay_hours")


@register(
    "validate_table",
    """
    with counted as (select count(*) as total, count(*) filter (where not (c_acctbal >= 0)) as debts,
                            count(*) filter (where not (c_custkey is not null)) as unnamed from customer)
    select 'id_known' as rule_name, total as total_records, unnamed as failed_records, unnamed = 0 as passed, 1::bigint as rules_passed
    from counted union all
    select 'no_debts', total, debts, debts = 0, 1 from counted
    """,
)
def _validate_table(t: Tables):
    """Rules on a table by its name: every id is known, some balances are negative."""
    store, name = TableStore(t.spark, scratch_path(t.spark, "tables")), fresh_name("customers")
    store.replace(t.customer, name)
    report = validate_table(t.spark, name, [QualityRule("id_known", "c_custkey IS NOT NULL"), QualityRule("no_debts", "c_acctbal >= 0")])
    results = report.to_dataframe(t.spark).select("rule_name", "total_records", "failed_records", "passed")
    return results.withColumn("rules_passed", F.lit(report.rules_passed).cast("bigint"))


@register(
    "schema_expectation",
    """
    select 'same' as expected, true as is_valid, 0::bigint as errors, count(*) as row_count from orders
    union all select 'reordered', false, 1, count(*) from orders union all select 'retyped', false, 1, count(*) from orders
    """,
)
def _schema_expectation(t: Tables):
    """A table against its own schema, one in another order and one with another type."""
    fields = t.orders.schema.fields
    retyped = [T.StructField(f.name, T.StringType()) if f.name == "o_custkey" else f for f in fields]
    wanted = {"same": fields, "reordered": fields[::-1], "retyped": retyped}
    verdicts = {name: SchemaExpectation(T.StructType(some)).validate(t.orders) for name, some in wanted.items()}
    rows = [F.struct(F.lit(n).alias("expected"), F.lit(bool(v)).alias("is_valid"), F.lit(v.error_count).cast("bigint").alias("errors")) for n, v in verdicts.items()]
    return t.orders.agg(F.count(F.lit(1)).alias("row_count")).select(F.inline(F.array(*rows)), "row_count")


@register(
    "expect_unique_increment",
    """
    with increment as (
        select o_orderkey, false as old from orders where o_orderdate >= timestamp '2000-01-01 00:00:00'
        union all select o_orderkey, false from orders where o_orderdate >= timestamp '2000-01-01 00:00:00' and o_orderkey % 50 = 0
        union all select o_orderkey, true from orders where o_orderdate < timestamp '2000-01-01 00:00:00' and o_custkey % 40 = 0)
    select o_orderkey, count(*) as in_increment, bool_or(old) as in_table from increment group by 1 having bool_or(old) or count(*) > 1
    """,
)
def _expect_unique_increment(t: Tables):
    """The index knows the orders before 2000.  The increment has the later ones, some of them twice, and some old ones."""
    late = F.col("o_orderdate") >= F.lit("2000-01-01 00:00:00").cast("timestamp_ntz")
    index = UniqueKeyIndex(t.spark, scratch_path(t.spark, "keys"), ["o_orderkey"], buckets=16)
    index.add(t.orders.filter(~late), 0)
    new = t.orders.filter(late)
    increment = new.unionByName(new.filter("o_orderkey % 50 = 0")).unionByName(t.orders.filter(~late & (F.col("o_custkey") % 40 == 0)))
    return index.duplicates(increment)


@register(
    "column_sketches",
    """
    with days as (select * from events where ts < timestamp '2024-01-16 00:00:00'),
    long as (select 'user_id' as column_name, user_id::varchar as v, user_id::double as x from days
             union all select 'value', value::varchar, value from days
             union all select 'event_type', event_type, null from days)
    select column_name, count(*) as row_count, count(*) - count(v) as null_count, count(distinct v) as distinct_values,
           true as distinct_within, min(x) as least, max(x) as greatest, true as median_within from long group by 1
    """,
)
def _column_sketches(t: Tables):
    """Sketches stored per day, merged over the first half of the month: how near they come to the exact figures."""
    columns, path = ["user_id", "value", "event_type"], scratch_path(t.spark, "sketches")
    daily_sketches(t.events, F.to_date("ts"), columns).write.partitionBy("period").parquet(path)
    stored = t.spark.read.parquet(path).filter(F.col("period") < F.lit("2024-01-16").cast("date"))
    merged = merged_stats(stored, [0.45, 0.55])
    exact = t.events.filter(F.col("ts") < F.lit("2024-01-16 00:00:00").cast("timestamp_ntz"))
    pairs = [F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("v"), F.expr(f"try_cast({c} AS double)").alias("x")) for c in columns]
    long = exact.select(F.inline(F.array(*pairs)))
    medians = exact_percentiles(long, ["column_name"], "x", {"median": 0.5}).drop("n")
    counts = long.groupBy("column_name").agg(F.countDistinct("v").alias("distinct_values")).join(medians, "column_name", "left")
    off = F.abs(F.col("distinct_count") - F.col("distinct_values"))
    between = F.col("median").between(F.col("quantiles")[0], F.col("quantiles")[1])
    return merged.join(counts, "column_name").select(
        "column_name",
        "row_count",
        "null_count",
        "distinct_values",
        (off <= 0.1 * F.col("distinct_values")).alias("distinct_within"),
        "least",
        "greatest",
        F.coalesce(between, F.lit(True)).alias("median_within"),
    )


@register("column_stats_sketch")
def _column_stats_sketch(t: Tables):
    """Distinct counts are estimates here, so there is no SQL to match."""
    return column_stats(t.lineitem, ["l_orderkey", "l_partkey", "l_suppkey", "l_returnflag", "l_shipdate"])


LEVELS = ["BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY", "AUTOMOBILE"]


@register("rls_level", "select * from customer where c_mktsegment in ('BUILDING', 'FURNITURE', 'HOUSEHOLD')")
def _rls_level(t: Tables):
    return filter_by_level(t.customer, "c_mktsegment", "HOUSEHOLD", LEVELS)


@register("rls_policy", "select * from customer where c_acctbal > 5000 or c_nationkey in (1, 2, 3)")
def _rls_policy(t: Tables):
    policies = [
        RowPolicy("wealthy", "c_acctbal > 5000", frozenset({"analysts"})),
        RowPolicy("home", "c_nationkey IN (1, 2, 3)", frozenset({"kim"})),
        RowPolicy("everything", "true", frozenset({"auditors"})),
    ]
    return secure(t.customer, policies, "kim", groups=["analysts"])


@register(
    "abac_entitled",
    "select * from customer where c_nationkey in (select n_nationkey from nation where n_regionkey = 1)",
)
def _abac_entitled(t: Tables):
    team = F.concat(F.lit("team_"), F.col("n_regionkey").cast("string")).alias("team")
    return entitled(
        t.customer,
        t.nation.select(F.col("n_nationkey").alias("c_nationkey"), team),
        on=["c_nationkey"],
        team="team_1",
    ).select(*t.customer.columns)


@register(
    "mask_columns",
    """
    select c_custkey, sha256(c_name) as c_name, c_nationkey, c_acctbal,
           regexp_replace(regexp_replace(regexp_replace(c_mktsegment, '[A-Z]', 'X', 'g'), '[a-z]', 'x', 'g'),
                          '[0-9]', 'n', 'g') as c_mktsegment,
           repeat('*', greatest(length(c_name) - 4, 0)) || right(c_name, 4) as tail
    from customer
    """,
)
def _mask_columns(t: Tables):
    frame = t.customer.withColumn("tail", F.col("c_name"))
    return mask_columns(frame, {"c_name": "hash", "c_mktsegment": "chars", "tail": "tail"})


@register(
    "classify_columns",
    r"""
    with patterns as (select * from (values
            ('email', '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}'),
            ('ipv4', '\b[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\b'),
            ('phone', '\b[0-9]{3}[-. ][0-9]{3,4}[-. ][0-9]{4}\b'),
            ('url', 'https?://[A-Za-z0-9./_-]+')) as p(tag, pattern)),
         texts as (select 'text' as column_name, text as content from documents
                   union all select 'source', source from documents
                   union all select 'url', url from pages)
    select column_name, tag, count(content) as seen,
           count(*) filter (where regexp_matches(content, pattern)) as hits,
           count(*) filter (where regexp_matches(content, pattern))::double / count(content) as hit_rate,
           count(*) filter (where regexp_matches(content, pattern))::double / count(content) >= 0.01
               and count(*) filter (where regexp_matches(content, pattern)) > 0 as tagged
    from texts, patterns group by 1, 2
    """,
)
def _classify_columns(t: Tables):
    texts = classify_columns(t.documents, ["text", "source"], min_rate=0.01)
    return texts.unionByName(classify_columns(t.pages, ["url"], min_rate=0.01))


@register(
    "route_rows",
    """
    select event_id, user_id, event_type, value,
           case when event_type = 'error' then 'incidents' when value > 25 then 'large'
                when nullif(event_type, 'view') <> 'click' then 'other' else 'default' end as _route
    from events
    """,
)
def _route_rows(t: Tables):
    routes = {
        "incidents": "event_type = 'error'",
        "large": "value > 25",
        "other": "nullif(event_type, 'view') <> 'click'",
    }
    return route_rows(t.events, routes).select("event_id", "user_id", "event_type", "value", "_route")
