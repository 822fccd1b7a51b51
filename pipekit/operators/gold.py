"""Gold-layer aggregates over customers, orders and events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pipekit.functions import added, counted, counted_if, exact_sums, greatest, least, merge_states, rounded, sum_states


def customer_360(customer: DataFrame, nation: DataFrame, region: DataFrame, orders: DataFrame) -> DataFrame:
    """A row per customer with place, number and value of orders and the last order date.

    Orders are aggregated by customer before the join, so a customer with a third of all orders costs one
    row per task, and the join reuses the aggregation's partitioning.
    """
    others = {"n_orders": counted(), "last_order": greatest(F.col("o_orderdate"))}
    spent = exact_sums(orders, ["o_custkey"], {"total_spent": F.col("o_totalprice")}, others)
    places = nation.join(region, nation.n_regionkey == region.r_regionkey, "left")
    joined = customer.join(spent, customer.c_custkey == spent.o_custkey, "left").join(
        places, customer.c_nationkey == places.n_nationkey, "left"
    )
    return joined.select(
        "c_custkey",
        "c_name",
        "c_mktsegment",
        "n_name",
        "r_name",
        F.coalesce("n_orders", F.lit(0).cast("bigint")).alias("n_orders"),
        F.round(F.coalesce("total_spent", F.lit(0.0)), 2).alias("total_spent"),
        "last_order",
    )


def daily_revenue(orders: DataFrame, lineitem: DataFrame) -> DataFrame:
    """Orders, lines and net revenue per order date.  Lines are summed per order before the join; what is joined is
    the exact state of that sum, rounded once at the end."""
    net = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    per_order = sum_states(lineitem, ["l_orderkey"], {"revenue": net}, {"_lines": counted()})
    joined = orders.select("o_orderkey", "o_orderdate").join(per_order, F.col("o_orderkey") == F.col("l_orderkey"))
    day = F.to_date("o_orderdate").alias("order_date")
    merged = merge_states(joined, [day], "revenue", {"n_orders": counted(), "n_lines": added(F.col("_lines"))})
    return merged.select("order_date", "n_orders", "n_lines", F.round(rounded("revenue"), 4).alias("revenue"))


def user_features(events: DataFrame) -> DataFrame:
    """Activity features per user: counts by kind, spend, activity span."""
    kind = F.col("event_type")
    others = {
        "n_events": counted(),
        "n_purchases": counted_if(kind == "purchase"),
        "n_errors": counted_if(kind == "error"),
        "first_seen": least(F.col("ts")),
        "last_seen": greatest(F.col("ts")),
    }
    features = exact_sums(events, ["user_id"], {"spend": F.when(kind == "purchase", F.col("value"))}, others)
    spend = F.round(F.coalesce("spend", F.lit(0.0)), 2).alias("spend")
    return features.select("user_id", "n_events", "n_purchases", "n_errors", spend, "first_seen", "last_seen")
