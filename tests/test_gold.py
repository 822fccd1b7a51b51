"""Gold aggregates on values that a cast per line would round or refuse."""

from pipekit.operators.gold import daily_revenue


def test_daily_revenue_rounds_only_the_sum(spark):
    orders = spark.sql("select id as o_orderkey, timestamp_ntz'2024-01-01 00:00:00' as o_orderdate from range(2)")
    small = "select 0 as l_orderkey, 0.00004D as l_extendedprice, 0.0D as l_discount from range(10)"
    assert daily_revenue(orders, spark.sql(small)).head().revenue == 0.0004
    large = "select 1 as l_orderkey, 2e15D as l_extendedprice, 0.5D as l_discount"
    row = daily_revenue(orders, spark.sql(large)).head()
    assert (row.n_orders, row.n_lines, row.revenue) == (1, 1, 1e15)
