"""Relational extras on the star schema: joins, grouping sets, windows, set operations."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .base import query

one = lambda: F.count(F.lit(1))
query("join_revenue_by_nation",
    "SELECT n_name, count(*) AS n_orders, count(DISTINCT c_custkey) AS n_customers FROM orders JOIN customer ON o_custkey = c_custkey "
    "JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name")(lambda load: load("orders").join(load("customer"), F.col(
            "o_custkey") == F.col("c_custkey")).join(F.broadcast(load("nation")), F.col("c_nationkey") == F.col("n_nationkey")).groupBy(
        "n_name").agg(one().alias("n_orders"), F.countDistinct("c_custkey").alias("n_customers")))
query("anti_customers",
    "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")(lambda load: load("customer")
    .join(load("orders"), F.col("o_custkey") == F.col("c_custkey"), "left_anti").select("c_custkey"))
query("cube_lineitem",
    "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")(lambda load: load(
        "lineitem").cube("l_returnflag", "l_linestatus").agg(one().alias("n")))
query("rollup_lineitem",
    "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")(lambda load: load(
        "lineitem").rollup("l_returnflag", "l_linestatus").agg(one().alias("n")))
query("pivot_status",
    "SELECT l_returnflag, count(*) FILTER (WHERE l_linestatus = 'O') AS o, count(*) FILTER (WHERE l_linestatus = 'F') AS f FROM lineitem "
    "GROUP BY 1")(lambda load: load("lineitem").groupBy("l_returnflag").pivot("l_linestatus", ["O", "F"]).agg(one()).select("l_returnflag",
        F.coalesce("O", F.lit(0)).alias("o"), F.coalesce("F", F.lit(0)).alias("f")))
query("rank_orders",
    "SELECT o_custkey, o_orderkey, rank() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)::BIGINT AS rk FROM orders")(
    lambda load: load("orders").select("o_custkey", "o_orderkey", F.rank().over(Window.partitionBy("o_custkey").orderBy("o_orderdate",
                "o_orderkey")).cast("long").alias("rk")))
query("except_parts", "SELECT DISTINCT p_partkey FROM part EXCEPT SELECT DISTINCT l_partkey FROM lineitem")(lambda load: load("part")
    .select("p_partkey").distinct().exceptAll(load("lineitem").select(F.col("l_partkey").alias("p_partkey")).distinct()))
